"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle, table
from . import language, lookalike, mixing, neardup, packing, qapairs, readlevel, scans, sitelines, tokens
from .tables import all_texts, children, scanned_units


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(children(spark, d)).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(children(spark, d)).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(table(spark, d, "chunks"), table(spark, d, "lang_samples")).withColumnRenamed("id", "chunk_id")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "chunks"), table(spark, d, "lang_samples")).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "line_no")


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.without_repeated(table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "text", "n_removed")


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.block_report(table(spark, d, "chunks")).withColumnRenamed("site", "domain")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(children(spark, d)).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_members(table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "canonical_id", "class_size", "n_forms")


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_text(table(spark, d, "chunks")).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return qapairs.defective_pairs(table(spark, d, "golden_rows"), table(spark, d, "lang_samples")).withColumnRenamed("id", "question_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(scanned_units(spark, d), all_texts(spark, d))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(scanned_units(spark, d), all_texts(spark, d))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"), ["doc_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.divided(p7_packed(spark, d))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), table(spark, d, "pack_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packed(spark, d), table(spark, d, "pack_specs"))


def _mix_sizes(spark: SparkSession, d: str) -> DataFrame:
    own = broadcast_if_small(settle(table(spark, d, "mix_targets").select("source").distinct(), "mix-sources"), 100)
    docs = table(spark, d, "documents").join(own, "source", "left_semi")
    return settle(tokens.token_counts(docs, ["doc_id", "source"]), "mix-sizes")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _mix_sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.exhausted(mixing.select(sizes, targets), sizes, targets).select("mix_name", "source")


def p8_selected(spark: SparkSession, d: str) -> DataFrame:
    return mixing.select(_mix_sizes(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _mix_sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.select(sizes, targets), sizes, targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return readlevel.reading_levels(table(spark, d, "documents").where("lang = 'en'"), table(spark, d, "level_samples")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_cleaned": p3_cleaned,
    "p3_blocks": p3_blocks,
    "p4_found": p4_found,
    "p4_canonical": p4_canonical,
    "p4_text": p4_text,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_repaired": p6_repaired,
    "p7_found": p7_found,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_selected": p8_selected,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}

_LINES = r"""l AS (SELECT DISTINCT chunk_id, domain, source_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text IS NOT NULL AND domain IS NOT NULL AND chunk_id IS NOT NULL),
 k AS (SELECT *, regexp_replace(regexp_replace(lower(line), '[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}\x{200b}\x{feff}]+', '', 'g'), '\p{Nd}+', '0', 'g') AS key FROM l), n AS (SELECT domain, count(DISTINCT source_id) AS site_pages FROM k WHERE regexp_matches(key, '\p{L}') GROUP BY 1),
 r AS (SELECT domain, key FROM k JOIN n USING (domain) WHERE regexp_matches(key, '\p{L}') GROUP BY domain, key HAVING count(DISTINCT source_id) >= 5 AND count(DISTINCT source_id) >= 0.1 * any_value(site_pages))"""

#: SQL of the queries it can express over whole tables: the support of lines is a count, their blocks and all other operators are none.
SQL: dict[str, str] = {
    "p3_found": f"WITH {_LINES} SELECT DISTINCT chunk_id, line_no FROM k JOIN r USING (domain, key)",
    "p3_cleaned": f"WITH {_LINES}, g AS (SELECT chunk_id, list(DISTINCT line_no) AS gone FROM k JOIN r USING (domain, key) GROUP BY 1), t AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT chunk_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {{'x': x, 'i': i - 1}}), lambda s: NOT list_contains(gone, s.i)), lambda s: s.x), chr(10)) END AS text, coalesce(len(gone), 0) AS n_removed FROM t LEFT JOIN g USING (chunk_id)",
}
