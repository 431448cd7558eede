"""The corpus pipeline: each stage's result is written as Parquet and read as the next one's documents.

Null texts count as empty in every stage and aren't toxic, near-duplicate or contaminated; of several empty texts exact
deduplication keeps one. Decisions are made for rows, not for ids: rows with null ids, and rows that share an id, are
judged like others and each by itself, and of rows equal in id and text one stays. Ties go to the largest id in exact
deduplication and to the smallest one among near copies (and, of rows with one id, to the last or first row read).
Texts are taken whole, however long. Columns other than those of documents are left behind. An empty table gives an
empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from tierwalk.llm.common import Work, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon's score puts under the threshold stay."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.accept(docs.select(*COLUMNS), lexicon, 0.3)


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """Rows with a key of their own: doc_id and the row's place in its Parquet file; of other inputs, numbered once and written."""
    rows = docs.select(*COLUMNS)
    try:
        place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"))
        return docs.select(*COLUMNS, F.struct(F.col("doc_id").cast("long").alias("doc_id"), *place).alias("key"))
    except AnalysisException:
        key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("number"))
        return Work(docs.sparkSession, name).write("numbered", rows.withColumn("key", key))


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose keys are kept. Keys grow with the documents, so they are exchanged at every size."""
    keys = kept.select(F.col("key.file").alias("file"), F.col("key.number").alias("number")).hint("merge")
    return rows.withColumns({"file": F.col("key.file"), "number": F.col("key.number")}).join(keys, ["file", "number"], "left_semi").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    rows = _keyed(docs, "exact-rows")
    return _only(rows, exact_dedup.duplicates(rows, id_col="key", keep="largest").filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, Jaccard 0.8) the one with the smallest doc_id stays."""
    rows = _keyed(docs, "near-rows")
    return _only(rows, ngram_join.jaccard_components(rows, n=5, percent=80, id_col="key").filter("key = component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item stay."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), 10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the byte-level ids and of what they decode to."""
    return bpe.roundtrip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies), ("decontaminate", drop_contaminated), ("byte_bpe", encode)]

#: The learned lexicon, Jaccard components and byte-pair ids aren't SQL; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(name, stage(spark, docs, sf_dir))
    return docs
