"""Named queries of this subpackage, each over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill import runtime
from cartomill.llm import entity_match, language, length_buckets, plain_text, streaming_bpe
from cartomill.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def _sources(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("city_summary", "boundary_candidate", "city_area", "country_info")]


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.found(*_sources(spark, d))


@query("p1_confidence")
def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match(*_sources(spark, d)).drop("km")


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return plain_text.found(table(spark, d, "city_summary"), table(spark, d, "city_area"))


@query("p5_plain")
def p5_plain(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its plain form."""
    names = plain_text.fields(table(spark, d, "city_summary"), table(spark, d, "city_area"))
    return plain_text.rewrite(names, ["record_kind", "record_key", "field_name"], "text")


@query("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return streaming_bpe.encode(table(spark, d, "documents"), "doc_id", "text")


@query("p6_round_trip")
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each text decoded from its ids; equal to the text, or empty for a null one."""
    ids = streaming_bpe.encode(table(spark, d, "documents"), "doc_id", "text")
    return streaming_bpe.decode(ids, "doc_id", "ids").select("doc_id", F.col("text").alias("decoded"))


ORACLES["p6_round_trip"] = "SELECT doc_id, coalesce(text, '') AS decoded FROM documents"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return runtime.cut(streaming_bpe.count_tokens(table(spark, d, "documents"), "doc_id", "text"))


@query("p7_packed")
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return length_buckets.pack(_sizes(spark, d), "doc_id", "n_tokens")


@query("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of their room that is filled, by buckets alone and topped up."""
    return length_buckets.fill(_sizes(spark, d), "doc_id", "n_tokens")


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "documents"), table(spark, d, "lang_sample"))


@query("p8_segments")
def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", language.named_language(F.col("lang")).alias("label"))
    return language.segments(docs, table(spark, d, "lang_sample"), label="label").drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
