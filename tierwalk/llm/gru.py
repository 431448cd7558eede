"""Language-model scoring by a gated recurrent network with a class-factored softmax.

Word counts are a table over all training documents and grow with them. The network, fitted by truncated
backpropagation in numpy, predicts the KNOWN most frequent words, the end and one sign for any other word;
classes hold about as many words as there are classes. It starts from a bounded sample (START_TOKENS), so that
partitions share a start; then each partition learns from its part of all training documents, and the partitions' networks are averaged, weighted by tokens, once for each of EPOCHS passes. A word
outside KNOWN costs the sign and then its share, (c + 1) / (sum over such words of (c + 1), one unseen included).
The state is carried through a document from its start to its end, window by window.

Words are 64-bit hashes everywhere. Counts of the HOT most frequent go to the scan as one table of bounded size; other
words are joined with the whole table of counts.

Null and empty texts are the end alone. Rows with null ids are training rows. Rows with equal ids are rows of their
own. Without training words, every word has the unseen word's share. Empty tables give empty tables. Documents of an
Arrow batch (10,000 rows, or 64 MB and one row) go forward together, GROUP of about one length at once.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm import hashing
from tierwalk.llm.common import Work, columns, ship, sliced

KNOWN, HIDDEN, WINDOW, BATCH = 2000, 32, 32, 32
#: Of so many training documents one is learnt from: all.
SHARE = 1
START_TOKENS, EPOCHS = 200_000, 1
#: In a pass over all documents: streams side by side, words of a block (unless one document has more), rate of the first steps.
STREAMS, BLOCK, RATE = 256, 1 << 18, 0.02
#: Words whose counts the scan holds at most, and words that a task counts before it gives them away.
HOT, HELD = 1 << 19, 1 << 22
#: States of one window of the scorer at most.
STATES = 1 << 17
#: States whose words are predicted at once, and documents that go forward together: what they need stays in a processor's own cache.
CHUNK, GROUP = 1 << 11, 1 << 10
END, OTHER = 0, 1


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words, as they come out of a text."""
    data, offsets = hashing.as_bytes(pa.array(words, pa.string()))
    return hashing.words(data, offsets, hashing.SPACED)[0]


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a text column: first row, last row (not included), hashes of all words, and where each row's start."""
    data, offsets = hashing.as_bytes(column)
    for a, b in hashing.pieces(offsets):
        with np.errstate(over="ignore"):
            h, _, _, bounds = hashing.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hashing.SPACED)
        yield a, b, h, bounds


_numbers = np.arange(CHUNK)


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gate(a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """From the parts of word (a) and state (u), by gate, the new value; a becomes the gates. `sides` halves the first two, as a sigmoid is (1 + tanh(x / 2)) / 2."""
    zr, g = a[:2], a[2]
    zr += u[:2]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    g += zr[1] * u[2]
    return np.tanh(g, out=g)


class GRU:
    """Gated recurrent network over word numbers; numbers are in order of frequency, so classes are ranges."""

    def __init__(self, vocab: np.ndarray, hidden: int = HIDDEN, seed: int = 7):
        self.table = hashing.Table(vocab)
        n = len(vocab) + 2
        self.per = max(1, int(np.ceil(np.sqrt(n))))
        c = -(-n // self.per)
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.sizes = np.minimum(self.per, n - self.per * np.arange(c))
        self.p = {"E": r(n + 1, hidden), "W": r(hidden, 3 * hidden), "U": r(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "C": r(hidden, c), "cb": np.zeros(c, np.float32), "V": r(c, hidden, self.per), "vb": np.zeros((c, self.per), np.float32)}
        self.start, self.t = n, 0
        for k, s in enumerate(self.sizes):
            self.p["vb"][k, s:] = -1e9

    def ids(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts given as hashes, each text with the end after it, and where the texts start."""
        at = bounds + np.arange(len(bounds))
        out = np.full(at[-1], END, np.int64)
        out[np.arange(len(h)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = self.table.find(h) + 1
        return out, at

    def sides(self, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For `_gate`, by gate: what words (all, if None) add, and the weights of the state."""
        p, n = self.p, self.p["U"].shape[0]
        half = np.array([0.5, 0.5, 1], np.float32)[:, None, None]
        by_gate = lambda w: w.reshape(-1, 3, n).transpose(1, 0, 2) * half
        e = p["E"] if words is None else p["E"][words.ravel()]
        return e @ by_gate(p["W"]) + by_gate(p["b"]), by_gate(p["U"])

    def step(self, x: np.ndarray, h: np.ndarray):
        p, n = self.p, h.shape[1]
        e = p["E"][x]
        a, u = e @ p["W"] + p["b"], h @ p["U"]
        z, r = _sig(a[:, :n] + u[:, :n]), _sig(a[:, n : 2 * n] + u[:, n : 2 * n])
        g = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
        return (1 - z) * h + z * g, (e, h, z, r, g, u[:, 2 * n :])

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log probability of each y after states h; with grads, also d loss / d h."""
        p, n = self.p, h.shape[1]
        k = y // self.per
        order = np.argsort(k.astype(np.int16) if len(self.sizes) < 1 << 15 else k, kind="stable")
        k, j = k[order], y[order] % self.per
        edges = np.searchsorted(k, np.arange(len(self.sizes) + 1)).tolist()
        # biases are weights of a further part of the state that is always 1
        inner, outer = np.concatenate((p["V"], p["vb"][:, None]), axis=1), np.concatenate((p["C"], p["cb"][None]))
        dv, dc = (None, None) if grads is None else (np.zeros_like(inner), np.zeros_like(outer))
        # no state is beyond -1 and 1, so short sums of weights tell that no power overflows
        real = np.arange(self.per) < self.sizes[:, None]
        small = max(np.abs(outer).sum(axis=0).max(), (np.abs(inner).sum(axis=1) * real).max()) < 60
        out, back = np.empty(len(y)), None if grads is None else np.empty_like(h)

        def softmax(v: np.ndarray, one: np.ndarray) -> np.ndarray:
            """Log probability of one number in each row of v; v becomes its gradient."""
            every = _numbers[: len(one)]
            if not small:
                v -= v.max(axis=1, keepdims=True)
            own = v[every, one].astype(np.float64)
            np.exp(v, out=v)
            total = v @ np.ones(v.shape[1], v.dtype)
            if grads is not None:
                v *= (1 / total)[:, None]
                v[every, one] -= 1
            return own - np.log(total)

        for a in range(0, len(y), CHUNK):
            b = min(a + CHUNK, len(y))
            at = order[a:b]
            x = np.empty((b - a, n + 1), h.dtype)
            x[:, :n], x[:, n] = h[at], 1
            v = x @ outer
            found = softmax(v, k[a:b])
            if grads is not None:
                dc += x.T @ v
                dh = v @ p["C"].T
            v = np.empty((b - a, self.per), h.dtype)
            parts = [(c, max(edges[c], a) - a, min(edges[c + 1], b) - a) for c in range(int(k[a]), int(k[b - 1]) + 1) if edges[c] < edges[c + 1]]
            for c, lo, hi in parts:
                np.matmul(x[lo:hi], inner[c], out=v[lo:hi])
            out[at] = found + softmax(v, j[a:b])
            if grads is not None:
                for c, lo, hi in parts:
                    dv[c] += x[lo:hi].T @ v[lo:hi]
                    dh[lo:hi] += v[lo:hi] @ p["V"][c].T
                back[at] = dh
        if grads is None:
            return out
        for name, d in (("C", dc[:-1]), ("cb", dc[-1]), ("V", dv[:, :-1]), ("vb", dv[:, -1])):
            grads[name] += d
        return out, back

    def fit(self, docs: list[np.ndarray], epochs: int = EPOCHS) -> None:
        self.learn(docs for _ in range(epochs))

    def learn(self, blocks: Iterable[list[np.ndarray]], rate: float = 0.01, batch: int = BATCH) -> int:
        """Truncated backpropagation over up to `batch` parallel streams of each block's documents; Adam. Returns the words predicted."""
        p, n, made, seen = self.p, self.p["U"].shape[0], 0, 0
        mom = {k: np.zeros_like(v) for k, v in p.items()}
        var = {k: np.zeros_like(v) for k, v in p.items()}
        for docs in blocks:
            if not docs:
                continue
            flow = np.concatenate([np.concatenate(([self.start], d)) for d in docs])
            last = len(flow) - 1
            streams = min(batch, max(1, last // WINDOW))
            steps = -(-last // streams)
            flow = np.concatenate((flow, np.full(streams * steps - last, self.start)))
            # streams overlap by one word, so that every word is predicted once
            x = flow[np.arange(streams)[:, None] * steps + np.arange(steps + 1)].T
            h = np.zeros((streams, n), np.float32)
            for a in range(0, steps, WINDOW):
                xs, y = x[a : min(a + WINDOW, steps)], x[a + 1 : min(a + WINDOW, steps) + 1].ravel()
                first = xs == self.start
                fresh = first.any(axis=1).tolist()
                side, u_of = self.sides(xs if xs.size < len(p["E"]) else None)
                gates = side.reshape(3, *xs.shape, n) if xs.size < len(p["E"]) else side.take(xs, axis=1)
                h0, hs, us = np.empty_like(gates[0]), np.empty_like(gates[0]), np.empty_like(gates)
                for i in range(len(xs)):
                    if fresh[i]:
                        h = h * ~first[i][:, None]
                    h0[i] = h
                    np.matmul(h, u_of, out=us[:, i])
                    g = _gate(gates[:, i], us[:, i])
                    np.subtract(g, h, out=hs[i])
                    hs[i] *= gates[0, i]
                    hs[i] += h
                    h = hs[i]
                use = y != self.start
                if not use.any():
                    continue
                grads = {k: np.zeros_like(v) for k, v in p.items()}
                states = hs.reshape(-1, n)
                if use.all():
                    _, dall = self.log_probs(states, y, grads)
                else:
                    dall = np.zeros((len(y), n), np.float32)
                    _, dall[use] = self.log_probs(states[use], y[use], grads)
                dall = dall.reshape(hs.shape)
                # gradients of the three sums in the gates, and of the new value's part that comes from the state
                da, dn = np.empty_like(gates), np.empty_like(h0)
                u_back = p["U"].reshape(n, 3, n).transpose(1, 2, 0).copy()
                back = np.zeros_like(h)
                for i in range(len(xs) - 1, -1, -1):
                    d, (z, r, g), (dz, dr, dg) = dall[i], gates[:, i], da[:, i]
                    d += back
                    keep = 1 - z
                    np.multiply(g, g, out=dg)
                    np.subtract(1, dg, out=dg)
                    dg *= z
                    dg *= d
                    np.multiply(dg, r, out=dn[i])
                    np.subtract(1, r, out=dr)
                    dr *= dn[i]
                    dr *= us[2, i]
                    d *= keep
                    np.subtract(g, h0[i], out=dz)
                    dz *= z
                    dz *= d
                    back = dz @ u_back[0]
                    back += dr @ u_back[1]
                    back += dn[i] @ u_back[2]
                    back += d
                    if fresh[i]:
                        back *= ~first[i][:, None]
                before = h0.reshape(-1, n).T
                grads["U"] += np.concatenate([before @ d.reshape(-1, n) for d in (da[0], da[1], dn)], axis=1)
                # sums over each word's places: a row for each part of the gates
                present = np.zeros(len(p["E"]), bool)
                present[xs] = True
                word, place = np.flatnonzero(present), (np.cumsum(present) - 1)[xs.ravel()]
                sums = np.stack([np.bincount(place, part, len(word)) for d in da for part in np.array(d.reshape(-1, n).T, np.float64, order="C")]).astype(np.float32)
                grads["b"] += sums.sum(axis=1)
                grads["W"] += (sums @ p["E"][word]).T
                grads["E"][word] = (p["W"] @ sums).T
                self.t, made, seen = self.t + 1, made + 1, seen + int(use.sum())
                lr = rate * np.sqrt(1 - 0.999**made) / (1 - 0.9**made) / (1 + self.t / 400)
                for k, g in grads.items():
                    g = np.clip(g / len(y), -1, 1)
                    mom[k] += np.float32(0.1) * (g - mom[k])
                    var[k] += np.float32(0.001) * (g * g - var[k])
                    p[k] -= np.float32(lr) * mom[k] / (np.sqrt(var[k]) + np.float32(1e-8))
        return seen

    def score(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log probability of each whole document (word numbers, where each starts); all go forward together."""
        side, u_of = self.sides()
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros(len(order))
        for a in range(0, len(order), GROUP):
            at = order[a : a + GROUP]
            out[at] = self._score(flat, lengths[at], bounds[at], side, u_of)
        return out

    def _score(self, flat: np.ndarray, lengths: np.ndarray, first: np.ndarray, side: np.ndarray, u_of: np.ndarray) -> np.ndarray:
        """Scores of documents by length, the longest first; side and u_of come from `sides`."""
        n = self.p["U"].shape[0]
        total = np.zeros(len(first))
        h = np.zeros((len(first), n), np.float32)
        last = np.full(len(first), self.start)
        t, most = 0, int(lengths.max(initial=0))
        while t < most:
            # documents alive at the window's steps; a window holds STATES states or one step
            alive = np.searchsorted(-lengths, -np.arange(t, min(most, t + 256)), "left")
            wide = max(1, int(np.searchsorted(np.cumsum(alive), STATES, "right")))
            alive = alive[:wide]
            hs, ys = np.empty((int(alive.sum()), n), np.float32), np.empty(int(alive.sum()), np.int64)
            at = 0
            for k in alive.tolist():
                a, x = side.take(last[:k], axis=1), h[:k]
                g = _gate(a, x @ u_of)
                g -= x
                g *= a[0]
                x += g
                hs[at : at + k] = x
                ys[at : at + k] = last[:k] = flat[first[:k] + t]
                at, t = at + k, t + 1
            rows = np.concatenate([np.arange(k) for k in alive])
            total += np.bincount(rows, self.log_probs(hs, ys), minlength=len(total))
        return total


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _counts(rows: DataFrame) -> DataFrame:
    """word (its hash), n: words of a task's rows (text) counted before any exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, fresh = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0

        def add() -> None:
            w, back = np.unique(np.concatenate(word), return_inverse=True)
            c = np.bincount(back, np.concatenate(n), minlength=len(w)).astype(np.int64)
            word[:], n[:] = [w], [c]

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(word[0].view(np.int64)), pa.array(n[0])], ["word", "n"])
            word[:], n[:] = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            return out

        for b in batches:
            for _, _, h, _ in texts_of(b.column(0)):
                w, c = np.unique(h, return_counts=True)
                word.append(w)
                n.append(c)
                fresh += len(w)
                if fresh > HELD // 4:
                    add()
                    fresh = 0
                    if len(word[0]) > HELD:
                        yield give()
        add()
        yield give()

    return rows.select("text").mapInArrow(run, "word long, n long")


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of words down to the least count that leaves at most `most` of them, in order of frequency."""
    level = F.floor(F.log2("c") * 8).cast("int")
    left, low = most, None
    for r in counts.groupBy(level.alias("l")).count().orderBy(F.desc("l")).collect():  # some hundred rows
        left -= r["count"]
        if left < 0:
            break
        low = r["l"]
    got = counts.filter(F.lit(False) if low is None else level >= low).toPandas()
    w, c = got["word"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(np.int64)
    order = np.lexsort((w, -c))
    return w[order], c[order]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    work = Work(spark, "gru")
    rows = columns(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("held_out", held_out())
    train = rows.filter("not held_out")
    # every word of the training rows with its count; the end's count is the number of rows
    counts = work.write("counts", _counts(train).groupBy("word").agg(F.sum("n").alias("c")))
    n_docs = train.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    hot, hot_counts = _frequent(counts, HOT)
    top = hot[:KNOWN]
    model = GRU(top)
    # shares of words outside the network's own: whatever the base measure leaves
    rest = max(1, n + v + 1 - int((hot_counts[:KNOWN] + 1).sum()) - (n_docs + 1 if n_docs else 0))
    _start(model, train, START_TOKENS)
    part = train.filter(F.pmod(F.xxhash64(F.lit("share"), "doc_id", "text"), F.lit(SHARE)) == 0).select("text")
    for k in range(EPOCHS):
        _pass_over(model, part, work, f"pass{k}")
    base_of = np.log10((np.concatenate(([0], hot_counts)) + 1) / float(n + v + 1))
    share_of = np.log10((np.concatenate(([0], hot_counts)) + 1) / float(rest))
    share_of[1 : 1 + len(top)] = 0
    shared = spark.sparkContext.broadcast((model, hot, base_of, share_of))
    held: dict[str, hashing.Table] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words, base, share = shared.value
        table = held.get("table") or held.setdefault("table", hashing.Table(words))
        for b in batches:
            flat, bounds, known, sums, rare = [], [np.zeros(1, np.int64)], [], [], []
            for lo, hi, h, at in texts_of(b.column(3)):
                f, starts = m.ids(h, at)
                flat.append(f)
                bounds.append(starts[1:] + bounds[-1][-1])
                number = table.find(h)
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                add = lambda x: np.bincount(row, x, minlength=hi - lo)  # noqa: B023, E731
                known.append(add(number > 0))
                seen = number > 0
                sums.append((add(np.where(seen, base[number], 0)), add(np.where(seen, share[number], 0))))
                others = np.flatnonzero(~seen)
                order = others[np.lexsort((h[others], row[others]))]
                w, r = h[order], row[order]
                new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])))[: len(w)])
                rare.append((w[new].view(np.int64), r[new] + lo, np.diff(np.concatenate((new, [len(w)])))))
            if not flat:
                continue
            at = np.concatenate(bounds)
            net = m.score(np.concatenate(flat), at) / np.log(10)
            none = pa.nulls(b.num_rows, pa.int64())
            cat = np.concatenate
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at)), pa.array(cat(known).astype(np.int64)), pa.array(cat([x[0] for x in sums])), pa.array(cat([x[1] for x in sums]) + net), none, none], names)
            who = pa.array(cat([x[1] for x in rare]))
            w, c = pa.array(cat([x[0] for x in rare])), pa.array(cat([x[2] for x in rare]))
            none = pa.nulls(len(w), pa.int64())
            empty = pa.nulls(len(w), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(who), none, pa.nulls(len(w), pa.bool_()), none, none, empty, empty, w, c], names)

    names = ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "net", "word", "n"]
    # row numbers are made and written once
    every = work.write("net", rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, net double, word long, n long"))
    c = F.coalesce("c", F.lit(0))
    met = every.filter("word is not null").select("uid", "word", "n").join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("base2"), F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(rest)))).alias("share2"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known2")
    )
    end = float(np.log10((n_docs + 1) / (n + v + 1)))
    zero = F.lit(0.0)
    return every.filter("word is null").join(met, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0)) + int(n_docs > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) + end).alias("base_score"), (F.col("net") + F.coalesce("share2", zero)).alias("score"),
    )


def _start(model: GRU, train: DataFrame, tokens: int) -> None:
    """Fits the network to whole documents, in the order of a hash, until they have `tokens` words."""
    near = train.filter("doc_id is not null").select("doc_id", "text", F.xxhash64(F.lit("start"), "doc_id").alias("o"))
    # ids first: a hundred words a document is less than any corpus has, and a short sample only starts less well
    least = near.select("o").orderBy("o").limit(tokens // 100).agg(F.max("o").alias("m")).first()["m"]
    if least is None:
        return
    fit, size = [], 0
    for r in near.filter(F.col("o") <= least).select("text").toLocalIterator():
        if size >= tokens:
            break
        for _, _, h, bounds in texts_of(pa.array([r["text"]], pa.string())):
            fit.append(model.ids(h, bounds)[0])
            size += len(fit[-1])
    model.fit(fit, 2)


def _pass_over(model: GRU, rows: DataFrame, work: Work, name: str) -> int:
    """One pass over every row: partitions learn from where model is, and model becomes their average. Returns the words learnt from."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = "n long, t long, net binary"
    keys = sorted(model.p)

    def row(n: int, t: int, flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([t], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], ["n", "t", "net"])

    def texts(m: GRU, batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for _, _, h, bounds in texts_of(b.column(0)):
                flat, at = m.ids(h, bounds)
                held += np.split(flat, at[1:-1])
                size += len(flat)
                if size >= BLOCK:
                    yield held
                    held, size = [], 0
        yield held

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = copy.deepcopy(shared.value)
        n = m.learn(texts(m, batches), RATE, STREAMS)
        if n:
            yield row(n, m.t, np.concatenate([m.p[k].ravel() for k in keys]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t, total = 0, 0, np.float64(0)
        for b in sliced(batches, 16):  # a row is a whole network
            for w, s, net in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, t, total = n + w, max(t, s), total + w * np.frombuffer(net, np.float32).astype(np.float64)
        if n:
            yield row(n, t, total / n)

    nets = work.write(name, rows.mapInArrow(learn, schema))
    # at most eight networks reach the driver, whatever the number of partitions
    got = nets.coalesce(8).mapInArrow(merge, schema).collect()
    seen = sum(r["n"] for r in got)
    if seen:
        flat, at = sum(r["n"] / seen * np.frombuffer(r["net"], np.float32).astype(np.float64) for r in got), 0
        for k in keys:
            v = model.p[k]
            model.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        model.t = max(r["t"] for r in got)
    shared.destroy()
    return seen
