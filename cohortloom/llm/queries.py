"""Queries of the text problems (p6, p8, p9, p10), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import canonical, mixing, packing, splitting, tokens
from cohortloom.sources.tables import table

FIELDS = ["race", "ethnicity", "smoking", "status"]


def p6_mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "dp3_variables_of_interest").select("row_id", *FIELDS), "row_id", FIELDS, table(spark, d, "canonical_values"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_mapped(spark, d).where("not exact").select("row_id", "field_name", "canonical_value")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return canonical.value_report(p6_mapped(spark, d))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.with_tokens(table(spark, d, "documents").select("doc_id", "text"), "text"), "doc_id", "n_tokens")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_packed(spark, d).where("was_cut").select("doc_id").distinct()


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.sized(table(spark, d, "documents").select("doc_id", "source", "lang", "text")), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece_no = 0").select("doc_id")


QUERIES = {f.__name__: f for f in (p6_mapped, p6_found, p6_report, p8_packed, p8_report, p8_found, p9_mixture, p9_report, p10_pieces, p10_found)}
#: None: edit metrics, tokenizers and the solved program have no counterpart in SQL; tests hold them against brute force.
SQL: dict[str, str] = {}
