"""Documents by address: a cache table, what it lacks, and a bounded fetch with retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attempts, seconds between requests and after the n-th failure (times n).
ATTEMPTS, PAUSE, BACKOFF = 5, 0.15, 1.5


def cache_name(path: Column, url: Column) -> Column:
    """File name of a cached address: its path, 120 characters at most, and the start of a digest."""
    return F.concat(F.substring(path, 1, 120), F.lit("."), F.substring(F.sha2(url, 256), 1, 16))


def cached(spark: SparkSession, path: str) -> DataFrame:
    """url, content of a cache; empty where there is none yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = "url string, content string"
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def store(documents: DataFrame, path: str) -> None:
    """Adds documents (url, content) to a cache; addresses without content aren't kept, so they are asked for again."""
    documents.filter(F.col("content").isNotNull()).select("url", "content").write.mode("append").parquet(path)


def _get(url: str) -> tuple[int, bytes]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=30) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def fetch(urls: DataFrame, at_once: int = 8, get: Callable[[str], tuple[int, bytes]] = _get, attempts: int = ATTEMPTS, pause: float = PAUSE, backoff: float = BACKOFF) -> DataFrame:
    """url, content of distinct addresses, `at_once` at a time; null where a source says anything but success, or too much too often."""

    def run(frames):
        import time

        def one(url):
            for n in range(1, attempts + 1):
                time.sleep(pause)
                try:
                    status, body = get(url)
                except OSError:
                    status, body = 0, b""
                if status == 200:
                    return body.decode("utf-8", "replace")
                if status not in (0, 429):
                    return None
                time.sleep(backoff * n)
            return None

        for f in frames:
            f["content"] = f["url"].map(one)
            yield f[["url", "content"]]

    return urls.select("url").distinct().repartition(at_once, "url").mapInPandas(run, "url string, content string")


def complete(urls: DataFrame, path: str, **how) -> DataFrame:
    """url, content of addresses: those of the cache, the others fetched and added to it first."""
    spark = urls.sparkSession
    lacking = urls.select("url").distinct().join(cached(spark, path).select("url"), "url", "left_anti")
    store(fetch(lacking, **how), path)
    return urls.select("url").distinct().join(cached(spark, path).dropDuplicates(["url"]), "url", "left")


def json_documents(documents: DataFrame, schema: str) -> DataFrame:
    """documents with `data`, their content as JSON; what is no JSON is null, so that its address can be fetched again."""
    return documents.withColumn("data", F.from_json("content", schema, {"mode": "PERMISSIVE"}))


def registrant_list(spark: SparkSession, path: str) -> DataFrame:
    """cik of a list, one a line, blanks left out; a comment on a line stays part of it."""
    return spark.read.text(path).select(F.btrim("value").alias("cik")).filter("cik <> ''")
