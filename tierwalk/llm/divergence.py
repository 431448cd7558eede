"""Source divergence audit: how far the terms of one source's texts lie from those of the others, and which terms say so.

Texts are counted once, in bytes, with what a task has counted added up before the exchange. Of each language the terms in
at least `least` of its documents are kept. A term has, in a group (language, source), the share
p = 1 + floor(10^9 * (count + 1) / (N + V)), and a pair of groups the sum of floor((p - q)^2 / q) over all kept terms.

That sum is split at a term's spread, the number of groups that have it:

* heavy terms, in at least half of their language's groups, go into dense numpy tiles of terms x groups, filled with the
  share of a zero count, and every pair of rows is summed over the tile;
* light terms are summed as if no group had two of them in common with another: absent pairs by number, a group's own
  terms against the other's zero share through the group's histogram of counts; then sparse postings correct the pairs of
  groups that share a term.

Both partial sums are of 64-bit integers and are added exactly. Shares are taken by long division in base 1,000, so counts
up to 9 * 10^15 a group are exact too.

Null texts, languages and sources are ''. Empty texts and texts without terms count as documents, and their groups appear in
the result. Long texts are counted as a stream of terms. Rows that are repeated count each time, whatever their ids. Ties
go to the smaller item in UTF-8. An empty table has an empty result. Columns other than text, lang and source are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.llm.common import Work, columns, ship, sliced, text_or_empty

#: Distinct (group, term) pairs that a task holds before it hands them on.
HELD = 400_000
#: Bytes of a text that are matched at once; longer texts are matched one term at a time.
AT_ONCE = 4 << 20
#: 64-bit numbers in a tile's terms x groups, and in what one step makes of them; sparse pairs that are held before they are summed.
TILE, STEP, PAIRS = 1 << 21, 1 << 19, 1 << 20

_terms = re.compile(rb"[a-z\x80-\xff]+")


class _Counts:
    """Documents and occurrences of every term in every group, until they are taken."""

    def __init__(self) -> None:
        self.of: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        if group not in self.of:
            self.of[group] = Counter(), Counter()
            self.held += 1
        docs, n = self.of[group]
        before = len(n)
        low = text.lower()  # of bytes: A-Z only
        if len(low) <= AT_ONCE:
            found = _terms.findall(low)
            n.update(found)
            docs.update(set(found))
        else:
            own = Counter(m.group() for m in _terms.finditer(low))
            n.update(own)
            docs.update(own.keys())
        self.held += len(n) - before

    def taken(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in self.of.items():
            terms = [b"", *n]  # the empty term tells that the group is there
            made = [pa.array([lang]).take(zeros := pa.array(np.zeros(len(terms), np.int32))), pa.array([source]).take(zeros), pa.array(terms, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*made, pa.array([0, *(docs[t] for t in n)], pa.int64()), pa.array([0, *n.values()], pa.int64())], ["lang", "source", "term", "docs", "n"])
        self.of, self.held = {}, 0


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs, n of every group, and a row with an empty term for each group."""
    ship(docs.sparkSession)

    def count(batches):
        counts = _Counts()
        for b in batches:
            for s in sliced([b], 256):
                for text, lang, source in zip(s.column(0).cast(pa.large_binary()).to_pylist(), s.column(1).to_pylist(), s.column(2).to_pylist(), strict=True):
                    counts.add((lang, source), text)
                if counts.held > HELD:
                    yield from counts.taken()
        yield from counts.taken()

    rows = columns(docs, ["text", "lang", "source"]).select(text_or_empty().alias("text"), text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"))
    parts = rows.mapInArrow(count, "lang string, source string, term string, docs long, n long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), by long division so that nothing overflows; total is over count."""
    rest, out = count + F.lit(1), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * F.lit(1000)
        out, rest = out * F.lit(1000) + _div(rest, total), rest % total
    return out + F.lit(1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of 64-bit integers."""
    d = p - q
    d *= d
    return d // q


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    new = np.ones(len(keys[0]) + 1, bool)
    new[1:-1] = False
    for k in keys:
        new[1:-1] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _by_term(batches, names: list[str]) -> Iterator[tuple[str, int, np.ndarray, list[np.ndarray]]]:
    """lang, number of its groups, where terms start (and the end), and the named columns, for pieces of sorted rows that hold whole terms of one language."""
    rest = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
            keys = [np.asarray(t[c].combine_chunks().dictionary_encode().indices) for c in ("lang", "term")]
            at = _runs(keys)
            last = int(at[-2])
            yield from _pieces(t, keys[0], at[:-1], names)
            rest = t.slice(last).combine_chunks().to_batches()[0]
    if rest is not None:
        t = pa.Table.from_batches([rest])
        yield from _pieces(t, np.zeros(t.num_rows, int), np.array([0, t.num_rows]), names)


def _pieces(t: pa.Table, lang: np.ndarray, at: np.ndarray, names: list[str]):
    if len(at) < 2:
        return
    cut = np.flatnonzero(np.diff(lang[at[:-1]])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at) - 1], strict=True):
        lo, hi = int(at[a]), int(at[b])
        yield t["lang"][lo].as_py(), t["groups"][lo].as_py(), at[a : b + 1] - lo, [t[n].to_numpy()[lo:hi] for n in names]


def _rows(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(a), np.int32))), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())], ["lang", "a", "b", "part"])


def dense(batches):
    """Sums over tiles of heavy terms, for every pair of groups; a group's row of a term is there with a zero count, and again if it has the term."""
    for lang, groups, at, (gid, p) in _by_term(batches, ["gid", "p"]):
        term = np.repeat(np.arange(len(at) - 1), np.diff(at))
        most = max(1, TILE // groups)
        for first in range(0, len(at) - 1, most):
            rows = slice(at[first], at[min(first + most, len(at) - 1)])
            tile = np.zeros((min(most, len(at) - 1 - first), groups), np.int64)
            np.maximum.at(tile, (term[rows] - first, gid[rows]), p[rows])
            tile = np.ascontiguousarray(tile.T)
            for a in range(groups):
                total = np.empty(groups, np.int64)
                step = max(1, STEP // tile.shape[1])
                for b in range(0, groups, step):
                    total[b : b + step] = apart(tile[a], tile[b : b + step]).sum(axis=1)
                yield _rows(lang, np.full(groups, a), np.arange(groups), total)


class _Pairs:
    """Sums for ordered pairs of one language's groups."""

    def __init__(self) -> None:
        self.key, self.value, self.n = [], [], 0

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        self.key.append(key)
        self.value.append(value)
        self.n += len(key)
        if self.n > PAIRS:
            self.fold()

    def fold(self) -> None:
        key, value = np.concatenate(self.key), np.concatenate(self.value)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        at = _runs([key])[:-1]
        self.key, self.value, self.n = [key[at]], [np.add.reduceat(value, at)], len(at)


def sparse(batches):
    """What pairs of groups that share a light term differ from the sum that takes the other's count for zero."""
    held, now, size = _Pairs(), None, 0

    def taken():
        if held.n:
            held.fold()
            key, value = held.key[0], held.value[0]
            for i in range(0, len(key), 10_000):
                k = key[i : i + 10_000]
                yield _rows(now, k // size, k % size, value[i : i + 10_000])

    for lang, groups, at, (gid, p, zero) in _by_term(batches, ["gid", "p", "zero"]):
        if now is not None and (lang != now or held.n > PAIRS // 2):
            yield from taken()
            held = _Pairs()
        now, size = lang, groups
        gid = gid.astype(np.int64)
        start, spread = np.repeat(at[:-1], np.diff(at)), np.repeat(np.diff(at), np.diff(at))
        made = np.concatenate(([0], np.cumsum(spread)))
        a = 0
        while a < len(gid):  # rows whose partners fit a step, or one row
            b = max(a + 1, int(np.searchsorted(made, made[a] + STEP, "right")) - 1)
            i = np.repeat(np.arange(a, b), spread[a:b])
            j = np.arange(len(i)) - np.repeat(made[a:b] - made[a], spread[a:b]) + start[i]
            other = i != j
            i, j = i[other], j[other]
            both = apart(p[i], p[j]) - apart(p[i], zero[j]) - apart(zero[i], p[j]) + apart(zero[i], zero[j])
            held.add(gid[i] * size + gid[j], both)
            a = b
    yield from taken()


def audit(docs: DataFrame, *, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language, the farthest first (`pair`), and the `top` terms over the language's share (`term`)."""
    spark = docs.sparkSession
    work = Work(spark, "divergence")
    counts = work.write("counts", term_counts(docs))
    terms = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("spread")).filter(F.col("docs") >= least)
    terms = work.write("terms", terms.drop("docs"))
    kept = work.write("kept", counts.filter("term != ''").select("lang", "source", "term", "n").join(terms, ["lang", "term"]))

    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter("term = ''").select("lang", "source").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "group_n"])
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"gid": F.row_number().over(of_lang.orderBy("source")) - 1, "groups": F.count("*").over(of_lang).cast("int"), "all": F.greatest(F.col("group_n") + F.col("v"), F.lit(1))})
    groups = work.write("groups", groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("all"))))

    rows = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("all")))
    over = rows.withColumn("q", share(F.col("total"), F.col("lang_n") + F.col("v"))).filter("p > q")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    said = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)

    heavy = F.col("spread") * 2 >= F.col("groups")
    names = groups.select("lang", "gid", "groups", "zero")
    held = rows.filter(heavy).select("lang", "term", "gid", "groups", "p")
    absent = terms.join(names, "lang").filter(heavy).select("lang", "term", "gid", "groups", F.col("zero").alias("p"))
    sums = "lang string, a int, b int, part long"
    by_term = lambda df: df.repartition("lang", "term").sortWithinPartitions("lang", "term", "gid")
    tiles = by_term(held.unionByName(absent)).mapInArrow(dense, sums)
    light = rows.filter(~heavy)
    fixes = by_term(light.filter("spread > 1").select("lang", "term", "gid", "groups", "p", "zero")).mapInArrow(sparse, sums)
    parts = tiles.unionByName(fixes).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))

    # of each group's light terms, how many have each count
    histogram = light.groupBy("lang", "gid", "p").agg(F.count("*").alias("m")).groupBy("lang", "gid").agg(F.collect_list(F.struct("p", "m")).alias("light"), F.sum("m").alias("own"))
    light_v = terms.join(groups.select("lang", "groups").distinct(), "lang").filter(~heavy).groupBy("lang").agg(F.count("*").alias("light_v"))
    side = groups.join(histogram, ["lang", "gid"], "left").join(light_v, "lang", "left").fillna(0, ["own", "light_v"])
    side = work.write("sides", side.select("lang", "source", "gid", "zero", "own", "light_v", F.coalesce("light", F.expr("cast(array() as array<struct<p: bigint, m: bigint>>)")).alias("light")))
    a = side.withColumnsRenamed({"gid": "a", "zero": "zero_a", "own": "own_a", "light": "light_a"})
    b = side.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("zero").alias("zero_b"), F.col("own").alias("own_b"), F.col("light").alias("light_b"))
    nothing = F.lit(0).cast("long")
    none = gap(F.col("zero_a"), F.col("zero_b"))
    mine = F.aggregate("light_a", nothing, lambda s, x: s + x["m"] * gap(x["p"], F.col("zero_b")))
    theirs = F.aggregate("light_b", nothing, lambda s, x: s + x["m"] * gap(F.col("zero_a"), x["p"]))
    absent_sum = (F.col("light_v") - F.col("own_a") - F.col("own_b")) * none + mine + theirs
    pairs = a.join(b, "lang").filter("a != b").select("lang", "source", "item", "a", "b", absent_sum.alias("rest"))
    value = F.col("rest") + F.coalesce("part", nothing)
    pairs = pairs.join(parts, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(first)).unionByName(said)
