"""Jaccard self-join of documents on word n-grams, as a blocked sparse product of the document by n-gram incidence.

A row of the matrix is a distinct set of 64-bit n-gram hashes; documents with equal sets share a row, named by a
128-bit digest of the set. Columns (n-grams) have one order for all rows, from rare to frequent: by a sketch of fixed
size that counts all documents, then by hash. Any order gives whole results; a good one makes columns short.

Inside the product a row goes by the first 64 bits of its name; two rows of one such number are both checked, so that
none is lost.

The product X X^T is taken in blocks. Two rows of similarity t or more share a column within the first
|x| - ceil(t |x|) + 1 of each, so only those are multiplied to find pairs. At the first column that two rows share, at
places i and j, their overlap is at most min(|x| - i, |y| - j); a pair has to pass this bound, and the bound of the
sizes, in at least one column. The overlaps of the pairs left are counted over all columns.

Links only have to connect, so the product goes in two rounds. First every row of a column meets the column's pivot,
the row where the column comes first, which is the one with the fewest rare n-grams: linear in the column. Links are
contracted; then rows of one column that are still apart meet each other. No link between components is lost.

Null and empty texts have no n-grams and link with nothing: component_id is their own id. Repeated rows are equal sets.
Rows that share an id are rows of their own. Rows with a null id link as others do, but no component is named by
them while it has another id. Empty tables give empty tables. Columns other than the id and the text are left behind.
Texts are hashed in pieces of hashing.PIECE bytes or one text, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierwalk.llm import hashing
from tierwalk.llm.common import Work, columns, ship, tidy
from tierwalk.llm.components import connected

#: Slots of the sketch, its bits, and the slots of one of its parts; the size is fixed, whatever the input's.
SLOTS_LOG, PART_LOG = 21, 16


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """One byte for each slot: four times the binary logarithm of the n-grams counted there, over all rows of (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS_LOG, np.int64)
        for b in batches:
            for _, _, _, g in hashing.sets(b.column(0), n):
                np.add.at(total, _slots(g), 1)  # no array of all slots for each piece
        parts = total.reshape(-1, 1 << PART_LOG)
        some = np.flatnonzero(parts.any(axis=1))
        packed = [pa.compress(parts[i].astype(np.uint64).tobytes(), codec="zstd", asbytes=True) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(pa.decompress(packed, 8 << PART_LOG, codec="zstd", asbytes=True), np.uint64)
                sums[part] = sums[part] + got if part in sums else got
        level = [np.rint(4 * np.log2(np.maximum(s, 1))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["part", "level"])

    out = np.zeros(1 << SLOTS_LOG, np.uint8)
    parts = 1 << (SLOTS_LOG - PART_LOG)
    summed = texts.mapInArrow(tidy(count), "part int, counts binary").repartition(parts, "part").mapInArrow(tidy(add), "part int, level binary")
    for r in summed.collect():  # SLOTS bytes in all
        out[r["part"] << PART_LOG : (r["part"] + 1) << PART_LOG] = np.frombuffer(r["level"], np.uint8)
    return out


def _incidence(rows: DataFrame, ranks, n: int, num: int, den: int) -> DataFrame:
    """For every row (id, text_hash, text) one row id, text_hash, n_shingles, sig; and for its set, once in a task, the first columns: row, size, gram, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = ranks.value
        seen: set[bytes] = set()
        for b in batches:
            for lo, hi, at, g in hashing.sets(b.column(2), n):
                sizes = np.diff(at)
                sigs = [xxhash.xxh3_128_digest(g[i:j].data) if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), none, none, none], names)
                out, whose = [], []
                for r, s in enumerate(sigs):
                    if s is None or s in seen:
                        continue
                    seen.add(s)
                    x = g[at[r] : at[r + 1]]
                    k = len(x) - -(-num * len(x) // den) + 1
                    rank = level[_slots(x)]
                    if k < len(x):  # only rows up to the k-th smallest have to be put in order
                        few = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1])
                        x, rank = x[few], rank[few]
                    out.append(x[np.lexsort((x, rank))[:k]])
                    whose.append(r)
                if not out:
                    continue
                k = np.array([len(o) for o in out])
                who = np.repeat(np.array(whose), k)
                pos = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                none = pa.nulls(len(who), pa.int64())
                row = np.array([int.from_bytes(sigs[r][:8], "big", signed=True) for r in whose], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 0).take(none), none, pa.array(sizes[who], pa.int64()), pa.nulls(len(who), pa.binary()), pa.array(np.repeat(row, k)), pa.array(np.concatenate(out).view(np.int64)), pa.array(pos, pa.int64())], names)

    names = ["id", "text_hash", "n", "sig", "row", "gram", "pos"]
    whole = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("text_hash", "n")), T.StructField("sig", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("row", "gram", "pos"))])
    for f in whole:
        f.nullable = True
    return rows.select("id", "text_hash", "text").mapInArrow(tidy(run), whole)


def _near(sizes: tuple[Column, Column], places: tuple[Column, Column], num: int, den: int) -> Column:
    """The size bound, and the bound at the first column that two rows share."""
    (x, y), (i, j) = sizes, places
    least = F.ceil(F.lit(num) * (x + y) / F.lit(num + den))
    return (den * F.least(x, y) >= num * F.greatest(x, y)) & (F.least(x - i, y - j) >= least)


def _row(sig: str) -> Column:
    """The first 64 bits of a row's name."""
    half = lambda a: F.conv(F.hex(F.substring(sig, a, 4)), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(5))


def _overlaps(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Names (a, b) of pairs (a, b) of rows that overlap enough; sets are (row, sig, grams)."""
    side = lambda c: sets.select(F.col("row").alias(c), F.struct("sig", "grams").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("sa.sig").alias("a"), F.col("sb.sig").alias("b"), F.col("sa.grams").alias("ga"), F.col("sb.grams").alias("gb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                # places of x's columns in y: both are sorted
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(tidy(run), "a binary, b binary")


def _whole_rows(rows: DataFrame, reps: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """row, sig and sorted grams of the wanted rows (row), hashed again from one document of each set."""
    of = wanted.join(reps, "row").select(F.col("from.id").alias("rid"), F.col("from.text_hash").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, at, g in hashing.sets(b.column(0), n):
                got = [g[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in got], pa.binary()), pa.array(got, pa.binary())], ["sig", "grams"])

    found = rows.join(of, (rows["text_hash"] == of["text_hash"]) & rows["id"].eqNullSafe(of["rid"]), "left_semi")
    # rows that repeat id and text are the same set again
    return found.select("text").mapInArrow(tidy(run), "sig binary, grams binary").dropDuplicates(["sig"]).withColumn("row", _row("sig"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_shingles, and component_id (smallest id reachable by links of percent/100 or more) for each row of docs; ids are of any type that has an order."""
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "ngram")
    num, den = percent, 100
    text = F.col(f"`{text_col}`")
    rows = columns(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    ranks = spark.sparkContext.broadcast(frequencies(rows.select("text"), n))
    incidence = work.write("incidence", _incidence(rows, ranks, n, num, den))
    members = incidence.filter("gram is null")
    reps = members.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.min(F.struct("id", "text_hash")).alias("from"))
    reps = work.write("reps", reps.withColumn("row", _row("sig")))
    # numbers only, so that aggregates need no sort: the size and the place of a column in its row are one
    posts = incidence.filter("gram is not null").select("gram", "row", F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("at"))
    pos, size = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("at", 32)
    low = F.shiftleft(F.least(pos, F.lit((1 << 15) - 1)), 48).bitwiseOR(F.shiftrightunsigned("row", 16))
    ends = posts.groupBy("gram").agg(F.min(low).alias("first"), F.min("row").alias("p"), F.max("row").alias("q")).filter("p <> q").select("gram", "first")
    # an exchange at every size: what is shared grows with the documents
    shared = posts.join(ends.hint("merge"), "gram").select("gram", "row", size.alias("size"), pos.alias("pos"), (low == F.col("first")).alias("pivot"))
    shared = work.write("shared", shared.distinct())
    pivots = shared.filter("pivot").select("gram", F.col("row").alias("prow"), F.col("size").alias("psize"), F.col("pos").alias("ppos"))
    met = shared.filter("not pivot").join(pivots, "gram").filter(_near((F.col("size"), F.col("psize")), (F.col("pos"), F.col("ppos")), num, den))
    pairs = work.write("pairs0", met.select(F.least("row", "prow").alias("a"), F.greatest("row", "prow").alias("b")).distinct())
    links = work.write("links0", _overlaps(pairs, work.write("sets0", _whole_rows(rows, reps, _nodes(pairs), n)), num, den))
    roots = work.write("roots0", connected(links, work, "c0"))
    # the second round: rows of one column in different components
    comps = roots.filter("node <> root").select(_row("node").alias("row"), _row("root").alias("comp"))
    now = work.write("now", shared.drop("pivot").join(comps, "row", "left").withColumn("comp", F.coalesce("comp", "row")))
    mixed = now.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("gram")
    left = work.write("left", now.join(mixed, "gram", "left_semi"))
    x, y = left.alias("x"), left.alias("y")
    found = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.comp") != F.col("y.comp")) & _near((F.col("x.size"), F.col("y.size")), (F.col("x.pos"), F.col("y.pos")), num, den))
    found = work.write("pairs1", found.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    more = work.write("links1", _overlaps(found, work.write("sets1", _whole_rows(rows, reps, _nodes(found), n)), num, den))
    roots = work.write("roots", _joined(roots, more, work))
    named = roots.join(reps.select(F.col("sig").alias("node"), "rep"), "node")
    names = named.groupBy("root").agg(F.min("rep").alias("name"))
    named = work.write("named", reps.select("sig", "rep").join(roots.join(names, "root").select(F.col("node").alias("sig"), "name"), "sig", "left").select("sig", F.coalesce("name", "rep").alias("name")))
    work.drop("reps", "shared", "now", "left", "pairs0", "pairs1", "links0", "links1", "sets0", "sets1", "roots0", "roots")
    # both sides are exchanged, so that a set with very many copies is split as skewed
    out = members.select("id", "n", "sig").join(named, "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "id").alias("component_id"))
    out = work.write("out", out)
    work.drop("incidence", "named")
    return out


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()


def _joined(roots: DataFrame, links: DataFrame, work: Work) -> DataFrame:
    """Components (node, root) after more links (a, b) between them."""
    a, b = roots.withColumnsRenamed({"node": "a", "root": "ra"}), roots.withColumnsRenamed({"node": "b", "root": "rb"})
    edges = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    over = work.write("over", connected(edges, work, "c1")).withColumnsRenamed({"node": "old", "root": "new"})
    kept = roots.join(over, roots["root"] == over["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    # components that were single rows are nodes of the new links only
    fresh = over.select(F.col("old").alias("node"), F.col("new").alias("root")).join(roots, "node", "left_anti")
    return kept.unionByName(fresh)
