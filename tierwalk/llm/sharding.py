"""Balanced label propagation: documents move towards their neighbours' shards under quotas. DataFrame functions only.

Neighbours of a document are the documents with an equal text; its neighbours' labels are its group's counts
of shards, so a round joins groups' counts to one row per group; ties go by a hash of the group. Only groups that fit
into a shard move. What a shard takes in is limited, by hash of the group, to its quota less the rows of such
groups that stay; documents without links are in nobody's way. Rounds go on until the cut groups stop falling.
At the end whole numbers are put right: shards over their quota give up rows, alone ones first, then those of
groups larger than a shard, then the largest groups. Law `rows`: counts differ by one at most.

A null text counts as empty and has 1 byte of size. Rows with equal or null ids are rows of their own.
Tables of fewer rows than shards leave shards empty; an empty table gives an empty one. Long texts count as others: law
`rows` has no regard for size. Columns other than id and text are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.llm.common import Work, columns


#: Rows of forty bytes that may be broadcast.
FEW = 1 << 18


def ranked(df: DataFrame, key: str, order: list[str], work: Work, name: str) -> DataFrame:
    """df with pos: place of a row among the rows of its key, from 0, in that order; no task holds a key whole."""
    at = work.write(name, df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()))
    # a row for each partition and key: bounded by partitions and shards
    parts = at.groupBy(F.shiftright("_at", 33).alias("_part"), key).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = work.write(f"{name}-parts", parts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    # as many rows as partitions times keys; broadcast while that is few
    few = F.broadcast(parts) if parts.count() <= FEW else parts
    return at.withColumn("_part", F.shiftright("_at", 33)).join(few, ["_part", key]).withColumn("pos", F.col("_at") - F.col("_low") + F.col("_off")).drop("_at", "_part", "_low", "_n", "_off")


def propagate(docs: DataFrame, shards: int = 8, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, grp (digest of the text), shard, slot for each row of docs."""
    work = Work(docs.sparkSession, "shards")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = columns(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("grp"), F.monotonically_increasing_id().alias("uid"))
    state = work.write("start", rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")))
    total = state.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    # a cell is a group's rows that start in one shard; they stay together, so rounds work on counts of cells
    cells = state.groupBy("grp", F.col("shard").alias("first")).agg(F.count(F.lit(1)).alias("n"))
    cells = work.write("cells", cells.join(cells.groupBy("grp").agg(F.sum("n").alias("m")), "grp").withColumn("shard", F.col("first")))
    fits = (F.col("m") > 1) & (F.col("m") <= max(1, min(quota)))
    linked, rest = cells.filter(fits), cells.filter(~fits)
    open_to, last, k = [True] * shards, None, 0
    while True:
        free = F.get(F.array(*map(F.lit, open_to)), F.col("shard"))
        counts = linked.groupBy("grp", "shard").agg(F.sum("n").alias("n"))
        best = counts.groupBy("grp").agg(F.max(F.struct(free.alias("free"), "n", F.xxhash64("grp", "shard", F.lit(k)).alias("tie"), "shard"))["shard"].alias("want"), F.count(F.lit(1)).alias("spread"))
        best = work.write(f"best{k}", best.filter("spread > 1").select("grp", "want"))
        cut = best.count()
        if not cut or k >= rounds and cut >= last:
            break
        last = cut
        wish = work.write(f"wish{k}", linked.join(best, "grp", "left").withColumn("want", F.coalesce("want", "shard")))
        flow = [[0] * shards for _ in range(shards)]
        for r in wish.groupBy("shard", "want").agg(F.sum("n").alias("n")).collect():  # shards x shards numbers
            flow[r["shard"]][r["want"]] = r["n"]
        # the largest shares of the wishes that no shard's quota forbids, counting what leaves it
        share = [1.0] * shards
        for _ in range(100):
            for j in range(shards):
                more = sum(flow[i][j] for i in range(shards) if i != j)
                room = quota[j] - sum(flow[j]) + sum(share[i] * flow[j][i] for i in range(shards) if i != j)
                share[j] = min(share[j], max(0.0, room / more)) if more else 1.0
        open_to = [x >= 1.0 for x in share]
        # a group moves as a whole or not at all
        goes = F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.get(F.array(*map(F.lit, share)), F.col("want"))
        linked = work.write(f"state{k}", wish.withColumn("shard", F.when(goes, F.col("want")).otherwise(F.col("shard"))).drop("want"))
        k += 1
    # rows follow their cells; a hot group is a cell for each shard, and a skewed one of these is split
    placed = linked.unionByName(rest).select("grp", "first", "m", F.col("shard").alias("to"))
    state = work.write("moved", state.withColumnRenamed("shard", "first").join(placed, ["grp", "first"]).drop("first").withColumnRenamed("to", "shard"))
    # whole numbers: rows over the quota go; alone ones first, then groups that no shard holds, then by group
    turn = F.when(F.col("m") == 1, 0).when(~fits, 1).otherwise(2)
    placed = ranked(state.withColumns({"turn": turn, "less": -F.col("m")}), "shard", ["turn", "less", "grp", "uid"], work, "placed")
    load = [0] * shards
    for r in state.groupBy("shard").count().collect():  # one number for each shard
        load[r["shard"]] = r["count"]
    over = [max(0, load[s] - quota[s]) for s in range(shards)]
    lead = [sum(over[:s]) for s in range(shards)]
    under, edge = [max(0, quota[s] - load[s]) for s in range(shards)], 0
    index = F.get(F.array(*map(F.lit, lead)), F.col("shard")) + F.col("pos")
    to = F.lit(None).cast("int")
    for s in reversed(range(shards)):
        edge = sum(under[: s + 1])
        to = F.when(index < edge, s).otherwise(to)
    moved = placed.withColumn("shard", F.when(F.col("pos") < F.get(F.array(*map(F.lit, over)), F.col("shard")), to).otherwise(F.col("shard"))).drop("pos")
    out = ranked(moved, "shard", ["doc_id", "uid"], work, "slots").withColumnRenamed("pos", "slot")
    return out.select("doc_id", "size", "text_crc32", "grp", "shard", F.col("slot").cast("long").alias("slot"))
