"""Exact deduplication by a tree of merges over sorted runs of digests. DataFrame functions only.

Every input row gets a digest (SHA-256), a second digest and a length; the three together are the verified key. Rows
are dealt to FAN**ROUNDS runs by their ids. A run is sorted by key and holds one entry for each of its keys: the
identifier that stays and the number of rows. In every round groups of FAN runs are exchanged and merged into one;
entries of equal keys become one, and the level is written, sorted, to the shared folder, so that a lost executor
costs one level's tasks. After the last round one run is left, spread over the partitions by key.

A key with a third of all rows is one entry for each task and run before anything is exchanged, and at most FAN
entries for each run after that; no task holds a run or a group whole.

Null texts count as empty ones. Texts are digested whole, however long. Of equal texts the row with the largest (or smallest)
identifier stays; rows with null or equal identifiers are rows of their own, and of rows alike in both one stays. An empty
table has an empty result. Other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import Work, columns

FAN, ROUNDS = 4, 3
KEY = ("sha", "h2", "bytes")


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """The id, and the verified key of the text: sha (32 bytes), h2 (xxhash64) and bytes. Null counts as empty."""
    text: Column = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    if normalise is not None:
        text = normalise(text)
    return columns(docs, [id_col, text_col]).select(F.col(f"`{id_col}`"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.xxhash64(text).alias("h2"), F.octet_length(text).alias("bytes"))


def merged_groups(rows: DataFrame, work: Work, id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row for each key: sha, h2, bytes, keep_id, group_size. The result doesn't depend on the runs."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    run = F.pmod(F.xxhash64(id_col), F.lit(FAN**ROUNDS)).cast("int")
    level = rows.withColumn("run", run).groupBy("run", *KEY).agg(best(id_col).alias("keep_id"), F.count(F.lit(1)).alias("n"))
    for r in range(ROUNDS):
        runs = work.write(f"runs{r}", level.sortWithinPartitions("run", *KEY))
        merged = runs.withColumn("run", F.floor(F.col("run") / FAN).cast("int"))
        level = merged.groupBy("run", *KEY).agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return level.select(*KEY, "keep_id", F.col("n").alias("group_size"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null counts as empty text. Of repeated rows with the same id and text all are marked alike; ids that are structs
    with a row number tell them apart. An empty table gives an empty one. A null id stays only where its group has no other.
    """
    work = Work(docs.sparkSession, "exact")
    rows = work.write("rows", signed(docs, id_col, text_col, normalise))
    groups = work.write("groups", merged_groups(rows, work, id_col, keep))
    work.drop(*(f"runs{r}" for r in range(ROUNDS)))
    # both sides are exchanged here, so that a hot text is split as a skewed partition
    return rows.join(groups, list(KEY)).select(F.col(f"`{id_col}`"), "keep_id", "group_size", F.col(f"`{id_col}`").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
