"""The queries of the numbered problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm import answers as p3
from codegrain.llm import containers as p6
from codegrain.llm import cross_split as p5
from codegrain.llm import formatting_duplicates as p1
from codegrain.llm import lookalikes as p8
from codegrain.llm import mixing as p7
from codegrain.llm import splitting as p4
from codegrain.llm import syntax as p2
from codegrain.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = read_table(spark, sf_dir, "primevul_train", spread_by="idx")
    return p1.formatting_duplicates(train, "idx", "func", "ingested_at").select(F.col("keep").alias("keep_idx"), F.col("copy").alias("copy_idx"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = read_table(spark, sf_dir, "primevul_train", spread_by="idx")
    return p1.collapsed(train, "idx", "func", "ingested_at").select(F.col("keep").alias("keep_idx"), "copies")


def _p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.verdicts(read_table(spark, sf_dir, "primevul_train", spread_by="idx"), "idx", "func", "file_path", "ingested_at", "vulnir", "project")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.ill_formed(_p2_verdicts(spark, sf_dir), "idx", "func", "vulnir")


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p2_verdicts(spark, sf_dir).withColumnRenamed("source", "project").where("verdict is not null")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.rates(_p2_verdicts(spark, sf_dir)).withColumnRenamed("source", "project")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = p3.fit_language(read_table(spark, sf_dir, "documents", spread_by="doc_id"), "doc_id", "text", "lang", home="en")
    pairs, answers = read_table(spark, sf_dir, "train_llama_paired", spread_by="pair_id"), ["root_cause", "safety_justification"]
    return p3.defects(pairs, language, p3.fit_manner(pairs, "pair_id", answers), "pair_id", "cve_desc", ["cve_desc", "func_before", "func_after"], answers, "enriched_at")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = p4.pieces(read_table(spark, sf_dir, "primevul_train", spread_by="idx"), "idx", "func", "ingested_at").withColumnRenamed("idx", "rec_id")
    pairs = p4.pieces(read_table(spark, sf_dir, "train_aug_paired", spread_by="pair_id"), "pair_id", "func_before", "ingested_at").withColumnRenamed("pair_id", "rec_id")
    named = [df.select(F.lit(name).alias("table_name"), "*") for name, df in (("primevul_train", train), ("train_aug_paired", pairs))]
    return named[0].unionByName(named[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).where("piece = 1").select("table_name", "rec_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = read_table(spark, sf_dir, "primevul_train", spread_by="idx"), read_table(spark, sf_dir, "primevul_valid", spread_by="idx")
    pairs = p5.overlapping_pairs(train, valid, "idx", "func", "ingested_at")
    return pairs.select(F.col("left_key").alias("train_idx"), F.col("right_key").alias("valid_idx"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = read_table(spark, sf_dir, "primevul_train", spread_by="idx"), read_table(spark, sf_dir, "primevul_valid", spread_by="idx")
    return p5.overlap_report(train, valid, "idx", "func", "ingested_at", "project", ("train", "valid")).withColumnRenamed("source", "project")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.fill_containers(read_table(spark, sf_dir, "documents", spread_by="doc_id"), "doc_id", "text", "crawled_at")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.fill_report(p6_containers(spark, sf_dir))


def p7_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = read_table(spark, sf_dir, "documents", spread_by="doc_id"), read_table(spark, sf_dir, "mix_targets")
    draw, _, _ = p7.mix(documents, targets, "doc_id", "text", "source", "crawled_at")
    return draw.withColumnRenamed("k", "doc_id").withColumnRenamed("n", "n_tokens")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = read_table(spark, sf_dir, "documents", spread_by="doc_id"), read_table(spark, sf_dir, "mix_targets")
    return p7.shares(*p7.mix(documents, targets, "doc_id", "text", "source", "crawled_at"))


def p8_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.unified(read_table(spark, sf_dir, "documents", "doc_id", "text", "crawled_at", spread_by="doc_id"), "text").select("doc_id", "unified")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = p8.lookalike_pairs(read_table(spark, sf_dir, "documents", spread_by="doc_id"), "doc_id", "text", "crawled_at")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of texts that look the same, without pairs: each text's class and spelling, by their smallest doc_id."""
    return p8.lookalike_classes(read_table(spark, sf_dir, "documents", spread_by="doc_id"), "doc_id", "text", "crawled_at").withColumnRenamed("k", "doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_collapsed, p2_found, p2_files, p2_rates, p3_found, p4_found, p4_pieces, p5_found, p5_report, p6_containers, p6_report, p7_draw, p7_shares, p8_found, p8_unified, p8_classes)
}
ORACLES: dict[str, str] = {
    "p4_found": """SELECT DISTINCT 'primevul_train' AS table_name, idx AS rec_id FROM primevul_train WHERE floor(length(func) / 3.5) > 1000
        UNION ALL SELECT DISTINCT 'train_aug_paired', pair_id FROM train_aug_paired WHERE floor(length(func_before) / 3.5) > 1000""",
}
