"""Substring deduplication by content-defined chunks of a gear rolling hash.

A cut falls after a byte whose gear hash (over the last bytes) has its lowest bits clear, never within the
minimum of the last cut; a chunk never exceeds the maximum. Chunks with equal digests (128 bits) are copies.
The first place of a digest (smallest doc_id, then offset) is the original. Copied chunks next to each other are a
run; a run counts from LEAST_RUN bytes on, since short chunks, as of a common phrase, also recur by chance. Inside
the runs that count, neighbouring chunks that aren't the original are one span to remove.

Null and empty texts have no chunks. Long texts are chunked whole. An empty table has an empty result; columns other than
id and text are left behind. Repeated rows are copies of each other: one of them is the original.
Whitespace runs and case are left as they are. Offsets are in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.llm.common import Work, columns, ship, sliced

#: One value for each byte, from a seeded generator.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
WINDOW, BITS, LEAST, MOST = 16, 5, 16, 192
#: Bytes of a run of copied chunks from which it counts: about half of a passage of fifty words.
LEAST_RUN = 160


def cuts(data: bytes, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if not n:
        return []
    g = GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(n, np.uint32)
    for k in range(min(WINDOW, n)):
        h[k:] += g[: n - k] << np.uint32(k)
    # the top bits of the 16-bit hash see the whole window
    places = np.flatnonzero((h & np.uint32(0xFFFF)) >> np.uint32(16 - bits) == 0) + 1
    out, last = [], 0
    for p in [*places.tolist(), n]:
        while p - last > most:
            last += most
            out.append(last)
        if p - last >= least or p == n and p > last:
            out.append(p)
            last = p
    return out


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid (a number of the row), doc_id, start, end, d1, d2 (128-bit digest) for every chunk; and for every row one with a null start.

    Numbers are the same in one written result only.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            n = b.num_rows
            row, start, end, digest = list(range(n)), [None] * n, [None] * n, [bytes(16)] * n
            for i, t in enumerate(b.column(2)):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                a = 0
                for e in cuts(data):
                    row.append(i)
                    start.append(a)
                    end.append(e)
                    digest.append(xxhash.xxh3_128_digest(data[a:e]))
                    a = e
            d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)], pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], ["uid", "doc_id", "start", "end", "d1", "d2"])

    rows = columns(docs, [id_col, text_col]).select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "uid long, doc_id long, start int, end int, d1 long, d2 long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """Per row, with its doc_id: n_chunks, n_repeated (copied chunks in runs that count), n_removed (those of them that aren't the original), n_bytes, repeated_bytes, spans to remove (start, end)."""
    work = Work(docs.sparkSession, "chunks")
    every = work.write("rows", chunked(docs, id_col, text_col))
    rows = every.filter("start is not null")
    first = work.write("first", rows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start", "uid")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # both sides are exchanged for this join, so a digest with very many rows is split as skewed
    original = (F.col("f.uid") == F.col("uid")) & (F.col("f.start") == F.col("start"))
    known = rows.join(first, ["d1", "d2"], "left").select("uid", "start", "end", F.col("n").isNotNull().alias("copy"), (F.col("n").isNotNull() & ~original).alias("extra"))
    # chunks tile a row's text, so what lies between two that aren't copied is a run; a row's chunks are few and sorted once
    inside = Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumns({"run": F.when(F.col("copy"), F.count_if(~F.col("copy")).over(inside)).otherwise(-1), "part": F.count_if(~F.col("extra")).over(inside)})
    length = (F.col("end") - F.col("start")).cast("long")
    pieces = known.groupBy("uid", "run", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if("extra").alias("extra"), F.sum(length).alias("bytes"), F.min(F.when(F.col("extra"), F.col("start"))).alias("start"), F.max(F.when(F.col("extra"), F.col("end"))).alias("end"))
    span = F.struct("start", "end")
    runs = pieces.groupBy("uid", "run").agg(F.sum("n").alias("n"), F.sum("extra").alias("extra"), F.sum("bytes").alias("bytes"), F.collect_list(F.when(F.col("extra") > 0, span)).alias("spans"))
    counts = (F.col("run") >= 0) & (F.col("bytes") >= least_run)
    per = runs.groupBy("uid").agg(
        F.sum("n").alias("n_chunks"), F.sum(F.when(counts, F.col("n")).otherwise(0)).alias("n_repeated"), F.sum(F.when(counts, F.col("extra")).otherwise(0)).alias("n_removed"), F.sum("bytes").alias("n_bytes"),
        F.sum(F.when(counts, F.col("bytes")).otherwise(0)).alias("repeated_bytes"), F.array_sort(F.flatten(F.collect_list(F.when(counts, F.col("spans"))))).alias("spans"),
    )
    ids = every.filter("start is null").select("uid", "doc_id")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_chunks", "n_repeated", "n_removed", "n_bytes", "repeated_bytes")}
    return ids.join(per, "uid", "left").drop("uid").withColumns(zero | {"spans": F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))})
