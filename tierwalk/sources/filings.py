"""Filings of registrants: submission documents with columnar arrays, addresses and cached contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECENT = {"form": "form", "accessionNumber": "accession", "filingDate": "filing_date", "primaryDocument": "primary_doc"}
SCHEMA = "name string, stateOfIncorporation string, sic string, sicDescription string, filings struct<recent: struct<" + ", ".join(f"{n}: array<string>" for n in RECENT) + ">>"


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each JSON document; cik is the number in its file's name."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return docs.withColumn("cik", F.regexp_extract(F.col("_metadata.file_name"), r"0*(\d+)\D*$", 1))


def recent(docs: DataFrame, forms: list[str], limit: int = 20) -> DataFrame:
    """cik, company, place and fields of the first `limit` filings of these forms; the arrays are cut where one is short.

    All of it happens inside a document's row, so nothing is exchanged.
    """
    arrays = [F.col(f"filings.recent.{n}") for n in RECENT]
    rows = F.slice(F.arrays_zip(*arrays), 1, F.least(*[F.coalesce(F.array_size(a), F.lit(0)) for a in arrays]))
    kept = F.slice(F.filter(rows, lambda r: r["form"].isin(forms)), 1, limit)
    return docs.select("cik", F.coalesce("name", F.lit("")).alias("company"), F.posexplode(kept).alias("place", "_f")).select("cik", "company", "place", *[F.coalesce(f"_f.{n}", F.lit("")).alias(to) for n, to in RECENT.items()])


def padded(cik: Column) -> Column:
    """A registrant number of ten digits."""
    return F.lpad(F.btrim(cik), 10, "0")


def address(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """Address of a filing's document, or of its text bundle where it has no primary document."""
    folder = F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"))
    return F.concat(folder, F.when(document != "", document).otherwise(F.concat(accession, F.lit(".txt"))))


def with_content(filings: DataFrame, contents: DataFrame) -> DataFrame:
    """Filings with their content (accession, content); those without are dropped, after any limit."""
    return filings.join(contents.filter("content <> ''").select("accession", "content"), "accession")


def fetch_plan(filings: DataFrame) -> DataFrame:
    """cik, n: how many filings of each registrant can be fetched."""
    return filings.filter("accession <> '' and primary_doc <> ''").groupBy("cik").agg(F.count(F.lit(1)).alias("n"))
