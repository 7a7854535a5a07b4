"""A graph of pipeline steps: order, and what happens after a failure."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter


def order(steps: dict[str, list[str]]) -> list[str]:
    """Steps after what they need; a cycle is an error. Needs that are no steps are disabled ones and count as done."""
    graph = {k: [d for d in v if d in steps] for k, v in steps.items()}
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError(f"the steps depend on each other: {e.args[1]}") from e


def run(steps: dict[str, list[str]], do: Callable[[str], object]) -> dict[str, str]:
    """``ok``, ``failed`` or ``skipped`` for each step; what needs a failed or skipped step is skipped."""
    state: dict[str, str] = {}
    for name in order(steps):
        if any(state.get(d, "ok") != "ok" for d in steps[name]):
            state[name] = "skipped"
            continue
        try:
            do(name)
            state[name] = "ok"
        except Exception:
            state[name] = "failed"
    return state
