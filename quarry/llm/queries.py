"""Registered queries of the llm operators, each over its whole table with production parameters,
and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (decision_list, decontaminate, lexical_search, license_scan, mixing, near_dedup, period_runs, rule_ensemble,
                        sentence_pieces, suffix_dedup, token_counts, token_output, warc)
from quarry.llm.store import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    slot = F.transform("slots", lambda p: p["slot"])
    return mixing.mix(mixing.sized(docs)).select("doc_id", "size", "source_size", "target", "taken", F.size("slots").cast("long").alias("n_pieces"),
                                                 F.array_min(slot).alias("first_slot"), F.array_max(slot).alias("last_slot"))


ORACLE["op1_mixing"] = mixing.ORACLE


@query
def op1_mix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule itself: every piece of every block with its slot."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mix(mixing.sized(docs)).select("doc_id", "source", F.explode("slots").alias("p")).select("p.*", "doc_id", "source")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_notices(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


@query
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages", "page_id", "url", "html"))


ORACLE["op7_warc"] = warc.ORACLE


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=2, percent=80)


ORACLE["op9_near_dedup"] = near_dedup.ORACLE


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verbatim_matches(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"),
        keep=["doc_id"]).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


ORACLE["op10_decontamination"] = decontaminate.ORACLE


@query
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE["op12_lexical_search"] = lexical_search.ORACLE


@query
def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.run_digests(period_runs.with_loops(table(spark, sf_dir, "documents", "doc_id", "text")))
