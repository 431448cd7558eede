"""Benchmark decontamination by suffix arrays over the documents.

An Arrow batch of documents is a shard: its words are numbered by the benchmark's vocabulary, and the suffixes of its
word sequence that can begin a match (the first two words are neighbours in the benchmark) are sorted by their first
words. Every benchmark suffix is binary-searched in that array by the words of a window; suffixes with a whole window
as prefix are the places: a range, however many they are. The runs of words that met windows cover, in the documents and
in the items, are then sorted by all their words (ranks of 1, 2, 4, ... words); the nearest item suffix above or below gives each
suffix its longest verbatim match, with its places in the document and in the item. Nothing is quadratic in a repetitive
text. Nothing of a shard outlives its batch, so no exchange is needed and a lost executor costs its batches only.

Items come in blocks of BLOCK_BYTES, so what is broadcast is bounded whatever the benchmark's size (about fifty bytes
for each of its words); a shard is one Arrow batch (64 MB, or one longer text).

Null texts have no words and no hits. Repeated rows give repeated results. Rows with null ids are judged like others.
Empty tables give empty tables (or, without items, no hits). Columns of other names are left behind. Of longest matches of one
length the first in the document counts, then the first in the items. Items of fewer words than a window are one window; items
without words none. Words are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm import hashing
from tierwalk.llm.common import Work, columns, ship

#: Bytes of benchmark text that one pass over the documents takes, and pairs of rows and items that are listed at once.
BLOCK_BYTES, PAIRS = 8 << 20, 1 << 20


def _numbers(column: pa.Array, table: hashing.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all rows, each row followed by a 0, and where rows start; unknown words are 0."""
    parts, starts, total = [], [], 0
    data, offsets = hashing.as_bytes(column)
    for a, b in hashing.pieces(offsets):
        with np.errstate(over="ignore"):
            h, _, _, bounds = hashing.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hashing.LETTERS)
        at = bounds + np.arange(len(bounds))
        out = np.zeros(at[-1], np.int32)
        out[np.arange(len(h)) + np.repeat(np.arange(b - a), np.diff(bounds))] = table.find(h)
        parts.append(out)
        starts.append(at[:-1] + total)
        total += at[-1]
    return np.concatenate([*parts, np.empty(0, np.int32)]), np.concatenate([*starts, np.array([total])])


def _keys(seq: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k numbers from each place on as one comparable value, whose order is that of the numbers."""
    return np.ascontiguousarray(seq[at[:, None] + np.arange(k)].astype(">u4")).view(f"S{4 * k}").ravel()


class Items:
    """One block of benchmark items as word numbers, and their windows in order."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        self.names = [str(i) for i, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        data, offsets = hashing.as_bytes(texts)
        with np.errstate(over="ignore"):
            vocabulary = np.unique(hashing.words(data, offsets, hashing.LETTERS)[0])
        self.table = hashing.Table(vocabulary)
        seq, self.starts = _numbers(texts, self.table)
        self.seq = np.concatenate((seq, np.zeros(window, np.int32)))
        length = np.diff(self.starts) - 1
        #: for a length of windows: distinct keys, where each key's places begin, the places in order
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        pairs = []
        for k in np.unique(np.minimum(length[length > 0], window)).tolist():
            some = np.flatnonzero(np.minimum(length, window) == k)
            n = length[some] - k + 1
            at = np.repeat(self.starts[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            keys = _keys(self.seq, at, k)
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.windows[k] = keys[new], np.concatenate((new, [len(at)])), at
            if k > 1:
                pairs.append(self.seq[at].astype(np.int64) << 32 | self.seq[at + 1])
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.alone = np.zeros(len(vocabulary) + 1, bool)
        if 1 in self.windows:
            self.alone[self.seq[self.windows[1][2]]] = True

    def suffixes(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The array of a shard (numbers and a window of zeros): places in the order of their suffixes, and the keys."""
        body = seq[: len(seq) - self.window]
        fits = self.alone[body]
        if len(self.pairs):
            pair = body.astype(np.int64) << 32 | seq[1 : len(body) + 1]
            near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            fits |= self.pairs[near] == pair
        at = np.flatnonzero(fits)
        keys = _keys(seq, at, self.window)
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    def search(self, seq: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length k of windows: k, places in the shard in suffix order, and for every window that is met its range of them and its range of places in `windows[k]`.

        A window that is met often on both sides is two ranges; pairs of places are never listed.
        """
        at, keys = self.suffixes(seq)
        if not len(at):
            return
        raw = keys.view(np.uint8).reshape(len(at), 4 * self.window)
        for k, (want, first, _) in self.windows.items():
            have = keys if k == self.window else np.ascontiguousarray(raw[:, : 4 * k]).view(f"S{4 * k}").ravel()
            low, high = np.searchsorted(have, want, "left"), np.searchsorted(have, want, "right")
            met = np.flatnonzero(high > low)
            if len(met):
                yield k, at, low[met], high[met], first[met], first[met + 1]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one after the other."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _regions(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that windows of k words at these places cover; windows that only touch are apart, as no match goes through."""
    at = np.unique(at)
    end = at + k
    new = np.concatenate(([True], at[1:] >= end[:-1]))
    first = np.flatnonzero(new)
    return at[first], end[np.append(first[1:], len(at)) - 1]


class Suffixes:
    """All suffixes of some runs of words in full order, by ranks of their first 1, 2, 4, ... words; a run's end differs from anything else."""

    def __init__(self, runs: list[np.ndarray]):
        parts, n = [], 0
        for r in runs:
            parts += [r.astype(np.int64), np.array([-1 - n])]
            n += 1
        text = np.concatenate(parts)
        most = max(map(len, runs))
        self.ranks = [np.unique(text, return_inverse=True)[1]]
        while 1 << len(self.ranks) <= most and int(self.ranks[-1].max()) < len(text) - 1:
            step, last = 1 << (len(self.ranks) - 1), self.ranks[-1]
            ahead = np.zeros(len(text), np.int64)
            ahead[:-step] = last[step:] + 1
            self.ranks.append(np.unique(last * (len(text) + 1) + ahead, return_inverse=True)[1])
        if 1 << len(self.ranks) <= most:  # all differ already
            self.order = np.argsort(self.ranks[-1], kind="stable")
        else:
            step, last = 1 << (len(self.ranks) - 1), self.ranks[-1]
            ahead = np.zeros(len(text), np.int64)
            ahead[:-step] = last[step:] + 1
            self.order = np.argsort(last * (len(text) + 1) + ahead, kind="stable")

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words the suffixes at x and y have in common."""
        x, y, length = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        last = len(self.order) - 1
        for j in range(len(self.ranks) - 1, -1, -1):
            for _ in range(2 if j == len(self.ranks) - 1 else 1):
                same = self.ranks[j][np.minimum(x, last)] == self.ranks[j][np.minimum(y, last)]
                same &= (x <= last) & (y <= last)
                x[same] += 1 << j
                y[same] += 1 << j
                length[same] += 1 << j
        return length


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_BYTES or one item, read through an iterator, so that the driver holds one partition's and one block's rows at a time."""
    block, size = [], 0
    rows = columns(benchmark, [item_col, text_col]).filter(F.col(f"`{text_col}`").isNotNull())
    for r in rows.toLocalIterator():
        more = len(r[1].encode("utf-8", "surrogatepass"))
        if block and size + more > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += more
    if block:
        yield block


MATCH = "struct<length: long, start: long, item: string, item_start: long>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (start, end in words), items (sorted, distinct), longest (length, start, item, item_start in words; null without hits) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "decon")
    rows = columns(docs, [id_col, text_col]).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"row long, doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>, longest {MATCH}"
    blocks = [spark.sparkContext.broadcast(Items([], window))]
    parts = []
    for k, block in enumerate(_blocks(benchmark, item_col, item_text) if benchmark is not None else []):
        shared = spark.sparkContext.broadcast(Items(block, window))
        if k == 0:
            blocks = [shared]
            continue
        if k == 1:  # row numbers have to be the same in every pass
            rows = work.write("rows", rows)
            parts.append(work.write("block0", rows.mapInArrow(_scan(blocks[0]), schema)))
        parts.append(work.write(f"block{k}", rows.mapInArrow(_scan(shared), schema)))
        shared.destroy()
    if not parts:
        out = rows.mapInArrow(_scan(blocks[0]), schema)
    else:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max_by("longest", F.struct("longest.length", -F.col("longest.start"))).alias("longest"))
    return out.select("doc_id", "n_words", F.array_sort("spans").alias("spans"), F.array_sort("items").alias("items"), "longest")


def _matches(index: Items, column: pa.Array, matches: bool = True) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, set[int]], dict[int, tuple[int, int, int, int]]]:
    """Words of each row; and for rows with hits: merged spans, items, and the longest match (length, start, item, start in the item)."""
    seq, starts = _numbers(column, index.table)
    counts = np.diff(starts) - 1
    seq = np.concatenate((seq, np.zeros(index.window, np.int32)))
    empty = np.empty(0, np.int64)
    marks, pairs, places, short, held = [], [empty], empty, [], 0
    for k, at, low, high, first, last in index.search(seq):
        of = index.windows[k][2]
        marks.append(np.unique(at[_ranges(low, high)]) * (index.window + 1) + k)
        mine = of[_ranges(first, last)]
        if k == index.window:
            places = mine
        else:  # whole items, which can't match further
            short.append((at[_ranges(low, high)], np.repeat(of[first], high - low), k))
        # each window's rows and items, each once, and then all of its rows with all of its items
        number = np.arange(len(low))
        rows = np.unique(np.repeat(number, high - low) * len(starts) + np.searchsorted(starts, at[_ranges(low, high)], "right") - 1)
        items = np.unique(np.repeat(number, last - first) * len(index.names) + np.searchsorted(index.starts, mine, "right") - 1)
        n = np.bincount(items // len(index.names), minlength=len(low))
        begin = np.cumsum(n) - n
        window = rows // len(starts)
        made = np.cumsum(n[window])
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(made, (made[a - 1] if a else 0) + PAIRS, "right")))
            w = window[a:b]
            pairs.append(np.repeat(rows[a:b] % len(starts), n[w]) * len(index.names) + items[_ranges(begin[w], begin[w] + n[w])] % len(index.names))
            held += len(pairs[-1])
            if held > 4 * PAIRS:
                pairs = [np.unique(np.concatenate(pairs))]
                held = 0
            a = b
    spans: dict[int, list[list[int]]] = {}
    items_of: dict[int, set[int]] = {}
    if not marks:
        return counts, spans, items_of, {}
    marks = np.unique(np.concatenate(marks))
    at, size = marks // (index.window + 1), marks % (index.window + 1)
    # spans of a row merge where they touch
    order = np.lexsort((size, at))
    at, size = at[order], size[order]
    row = np.searchsorted(starts, at, "right") - 1
    end = np.maximum.accumulate(at + size)
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] > end[:-1]))))
    for r, a, e in zip(row[new].tolist(), at[new].tolist(), end[np.append(new[1:], len(at)) - 1].tolist(), strict=True):
        spans.setdefault(r, []).append([a - int(starts[r]), e - int(starts[r])])
    for x in np.unique(np.concatenate(pairs)).tolist():
        items_of.setdefault(x // len(index.names), set()).add(x % len(index.names))
    longest: dict[int, tuple[int, int, int, int]] = {}
    for d, q, k in sorted(short, key=lambda x: x[2]) if matches else ():
        row = np.searchsorted(starts, d, "right") - 1
        first = np.lexsort((q, d, row))
        for f in first[np.concatenate(([True], row[first][1:] != row[first][:-1]))].tolist():
            i = int(np.searchsorted(index.starts, q[f], "right")) - 1
            longest[int(row[f])] = (k, int(d[f] - starts[row[f]]), i, int(q[f] - index.starts[i]))
    if matches and len(places):
        longest |= _longest(index, seq, starts, at[size == index.window], places)
    return counts, spans, items_of, longest


def _longest(index: Items, seq: np.ndarray, starts: np.ndarray, at: np.ndarray, places: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """The longest verbatim match of each row with whole windows at these places; of several the first in the row, then in the items.

    A match lies in the words that met windows cover, in the shard as in the items. The suffixes of these runs are sorted
    together, and a suffix's longest match is with the nearest suffix of an item above or below it.
    """
    da, de = _regions(at, index.window)
    qa, qe = _regions(places, index.window)
    suffixes = Suffixes([seq[a:e] for a, e in zip(da, de, strict=True)] + [index.seq[a:e] for a, e in zip(qa, qe, strict=True)])
    lengths = np.concatenate((de - da, qe - qa))
    begin = np.cumsum(lengths + 1) - lengths - 1
    run = np.repeat(np.arange(len(lengths)), lengths + 1)
    inside = np.arange(len(run)) - begin[run]
    own = np.concatenate((da, qa))[run] + inside  # each suffix's place in the shard or in the items
    word, is_item = inside < lengths[run], run >= len(da)
    order = suffixes.order[word[suffixes.order]]
    n, item = len(order), is_item[order]
    number = np.arange(n)
    above = np.maximum.accumulate(np.where(item, number, -1))
    below = np.minimum.accumulate(np.where(item, number, n)[::-1])[::-1]
    best = np.zeros(n, np.int64)
    doc = np.flatnonzero(~item)
    for near in (above[doc], below[doc]):
        ok = (near >= 0) & (near < n)
        best[doc[ok]] = np.maximum(best[doc[ok]], suffixes.common(order[doc[ok]], order[near[ok]]))
    place = own[order[doc]]
    row = np.searchsorted(starts, place, "right") - 1
    first = np.lexsort((place, -best[doc], row))
    first = first[np.concatenate(([True], row[first][1:] != row[first][:-1]))]
    # of the item suffixes that share a winner's words, which stand together, the first place
    shared = np.concatenate((suffixes.common(order[:-1], order[1:]), [0]))
    where = np.where(item, own[order], np.iinfo(np.int64).max)
    out = {}
    for size_ in np.unique(best[doc[first]]).tolist():
        group = np.concatenate(([0], np.cumsum(shared[:-1] < size_)))
        least = np.minimum.reduceat(where, np.flatnonzero(np.concatenate(([True], shared[:-1] < size_))))
        for f in first[best[doc[first]] == size_].tolist():
            r, q = int(row[f]), int(least[group[doc[f]]])
            i = int(np.searchsorted(index.starts, q, "right")) - 1
            out[r] = (size_, int(place[f] - starts[r]), i, q - int(index.starts[i]))
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            counts, spans, items, longest = _matches(index, b.column(2))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(counts, pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in spans.get(i, ())] for i in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted({index.names[j] for j in items.get(i, ())}) for i in range(n)], pa.list_(pa.string())),
                    pa.array([{"length": m[0], "start": m[1], "item": index.names[m[2]], "item_start": m[3]} if (m := longest.get(i)) else None for i in range(n)], pa.struct([("length", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])),
                ],
                ["row", "doc_id", "n_words", "spans", "items", "longest"],
            )

    return run


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the query from hits(), and the longest match's length, start, item and start in the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit = []
            for spans in b.column(2).to_pylist():
                covered, last = 0, 0
                for s, e in sorted((x["start"], x["end"]) for x in spans):
                    covered += max(0, e - max(s, last))
                    last = max(last, e)
                n_hit.append(covered)
            items = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]), pa.array([n > 0 for n in n_hit]), b.column(4)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
            )

    return found.mapInArrow(run, f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest {MATCH}").select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.coalesce("longest.length", F.lit(0)).cast("long").alias("longest"), F.col("longest.start").alias("longest_start"), F.col("longest.item").alias("longest_item"), F.col("longest.item_start").alias("longest_item_start")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows without hits, with their columns; decided row by row in the scan, so ids don't matter. Blocks of items follow each other."""
    spark = docs.sparkSession
    ship(spark)
    place = docs.columns.index(text_col)

    def without(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[list(_matches(shared.value, b.column(place), False)[2])] = False
                yield b.filter(pa.array(keep))

        return run

    for block in _blocks(benchmark, item_col, item_text):
        docs = docs.mapInArrow(without(spark.sparkContext.broadcast(Items(block, window))), docs.schema)
    return docs
