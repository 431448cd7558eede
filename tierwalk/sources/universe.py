"""Registrants and funds of the ticker lists, and the lookup of tickers by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Positional rows of {data: [[...]]}; missing values are empty."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "data array<array<string>>").alias("d"))
    return doc.select(F.explode("d.data").alias("r")).select(*[F.coalesce(F.get("r", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def companies(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, ["cik", "name", "ticker", "exchange"])


def funds(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, ["cik", "series_id", "class_id", "symbol"])


def ticker_lookup(spark: SparkSession, path: str, key) -> DataFrame:
    """key, place, cik, ticker, title: of equal keys the last entry counts, at the place of the first."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<cik_str: string, ticker: string, title: string>>").alias("m"))
    rows = doc.select(F.posexplode(F.map_entries("m")).alias("place", "e")).select("place", F.col("e.value.cik_str").alias("cik"), F.col("e.value.ticker").alias("ticker"), F.col("e.value.title").alias("title"))
    keyed = rows.withColumn("key", key(F.col("title"))).groupBy("key")
    return keyed.agg(F.min("place").alias("place"), F.max_by(F.struct("cik", "ticker", "title"), "place").alias("r")).select("key", "place", "r.*")


def named(universe: DataFrame, terms: list[str], name: str = "name") -> DataFrame:
    """Rows whose name holds a term, once for each such term."""
    low = F.lower(F.col(name))
    hit = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms]))
    return universe.withColumn("term", F.explode(hit))


def listed_on(exchange: Column, wanted: str) -> Column:
    return F.lower(F.btrim(exchange)) == wanted.strip().lower()


def by_cik(universe: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each registrant: its last one."""
    rest = [c for c in universe.columns if c != "cik"]
    return universe.groupBy("cik").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select("cik", "_r.*")


def ciks(universe: DataFrame) -> DataFrame:
    """Distinct registrants, of companies or funds."""
    return universe.select("cik").filter("cik <> ''").distinct()


def exchanges(universe: DataFrame) -> DataFrame:
    """Companies of each exchange."""
    return universe.groupBy("exchange").agg(F.count(F.lit(1)).alias("n"))
