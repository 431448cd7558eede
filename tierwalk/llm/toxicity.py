"""Toxicity by a weighted lexicon matched with one Aho-Corasick automaton.

Texts are folded first: compatibility forms, homoglyphs of other scripts, digits and signs that stand for
letters inside a word. The lexicon holds whole words and word beginnings with weights (smoothed log odds of
labelled rows), learned from labelled rows; phrases of exceptions cover the matches inside them. A text's
features are the weighted matches over its length, the strongest weight and the number of matches; a
logistic curve fitted on the training rows turns them into a score.

Null and empty texts have no matches and get the score of a text without matches. Labels other than 0 and 1,
null ids and unmatched labels teach nothing. Without labelled rows the seed lexicon is used with weight 3. Long texts are
folded and matched whole, in time linear in their length and their matches. Repeated rows are scored each by itself; empty
tables give empty tables; other columns are ignored (scored) or kept (accept).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import Work, columns, ship, sliced, tidy

#: Labelled rows that a fit uses at most (those with the smallest hashes), and patterns that a task counts before it gives them away.
FIT_ROWS = 200_000
HELD = 100_000
# Seeds and exceptions.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown")
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "pond scum", "class clown")
# What stands for a letter, by look.
LOOKS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "ο": "o", "ι": "i", "ν": "v", "τ": "t", "ρ": "p", "ı": "i", "ɡ": "g", "м": "m", "т": "t", "к": "k", "н": "h", "в": "b"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_looks = str.maketrans(LOOKS)
_signs = str.maketrans(SIGNS)
_signed = re.compile(rf"(?<!\S)[^\s{re.escape(''.join(SIGNS))}]*[{re.escape(''.join(SIGNS))}]\S*")
_letter = re.compile(r"[^\W\d_]")
_tail = re.compile(r"(?:[^\w$@]|_)+$")
_word = re.compile(r"\w+")
_foreign = re.compile(f"[{''.join(LOOKS)}]")


def _read(m: re.Match) -> str:
    """A word with signs in it: they are letters if it has a letter, but not at its end."""
    return _tail.sub("", m[0]).translate(_signs) if _letter.search(m[0]) else m[0]


def fold(text: str | None) -> str:
    """Lower-case words, one space around each; look-alikes and signs inside words are letters."""
    t = text or ""
    if t.isascii():
        t = t.lower()
    else:
        t = unicodedata.normalize("NFKC", t).lower()
        if _foreign.search(t):
            t = t.translate(_looks)
    if any(s in t for s in SIGNS):
        t = _signed.sub(_read, t)
    return f" {' '.join(_word.findall(t))} "


class Lexicon:
    """Patterns with weights, exceptions, and the curve from features to a score."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, curve=(-3.5, 4.0, 0.5, 0.6)):
        self.weights = weights
        self.exceptions = exceptions
        self.curve = np.asarray(curve, float)
        self.machine = None

    def __getstate__(self):
        return self.__dict__ | {"machine": None}

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the lexicon's matches outside exceptions; of those with one start the longest."""
        if self.machine is None:
            m = ahocorasick.Automaton()
            for p, w in self.weights.items():
                m.add_word(p, (len(p), w))
            for p in self.exceptions:
                m.add_word(f" {p} ", (len(p) + 2, None))
            m.make_automaton()
            self.machine = m if len(m) else False
        if not self.machine:
            return []
        best: dict[int, tuple[int, float]] = {}
        safe = []
        for end, (n, w) in self.machine.iter(folded):
            start = end - n + 1
            if w is None:
                safe.append((start, end))
            elif start not in best or best[start][0] < n:
                best[start] = (n, w)
        # one sweep over both by their starts: of the exceptions that begin before a match the one that ends last
        out, safe, k, far = [], sorted(safe), 0, -1
        for s, (n, w) in sorted(best.items()):
            while k < len(safe) and safe[k][0] <= s:
                far = max(far, safe[k][1])
                k += 1
            if far < s + n - 1:
                out.append((s, s + n, w))
        return out

    def features(self, text: str | None) -> list[float]:
        t = fold(text)
        w = [x[2] for x in self.matches(t)]
        words = max(1, t.count(" ") - 1)
        total = max(0.0, sum(w))
        return [1.0, np.log1p(100 * total / words) / 5, max(w, default=0.0) / 5, np.log1p(total)]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self.curve))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        b = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
            b += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b)
        self.curve = b


@lru_cache(1 << 14)
def _of_word(w: str) -> tuple[str, ...]:
    return (f" {w} ", *(f" {w[:n]}" for n in range(4, min(len(w), 8) + 1)))


def _patterns(text: str | None) -> set[str]:
    """Whole words and beginnings of words that a text holds."""
    out: set[str] = set()
    for w in set(fold(text).split()):
        out.update(_of_word(w))
    return out


def learn(labelled: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon from rows (text, toxic), toxic 0 or 1; they are read three times and should be a written table."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select("text", F.col("toxic").cast("long").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts of a task's rows, given away when there are many, so that few rows are exchanged
        got: dict[str, int] = {}  # rows, and toxic ones from the 32nd bit on

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([v >> 32 for v in got.values()], pa.int64()), pa.array([v & 0xFFFFFFFF for v in got.values()], pa.int64())], ["p", "a", "n"])
            got.clear()
            return out

        for b in batches:
            for t, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                one = 1 + (toxic << 32)
                for p in _patterns(t.as_py()):
                    got[p] = got.get(p, 0) + one
                if len(got) > HELD:
                    yield flush()
        if got:
            yield flush()

    sums = rows.groupBy("toxic").count().collect()
    total = {r["toxic"]: r["count"] for r in sums}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return Lexicon({f" {s}": 3.0 for s in SEEDS}, exceptions)
    counts = rows.mapInArrow(tidy(run), "p string, a long, n long").groupBy("p").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    # log odds, less some standard errors of theirs
    odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (neg + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("n") - F.col("a") + 0.5))
    # as many as the sample has; its size is bounded, so theirs is
    top = counts.filter("a >= 5").select("p", (odds - 1.5 * error).alias("w")).filter("w > 1").collect()
    lexicon = Lexicon({r["p"]: float(r["w"]) for r in top} | {f" {s} ": 3.0 for s in SEEDS if not any(r["p"] == f" {s} " for r in top)}, exceptions)
    shared = spark.sparkContext.broadcast(lexicon)

    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [shared.value.features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], ["f", "y"])

    # four numbers for each row of the bounded sample
    got = rows.mapInArrow(tidy(feats), "f array<double>, y long").toPandas()
    lexicon.fit_curve(np.array(got["f"].tolist()), got["y"].to_numpy(float))
    return lexicon


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from labels of rows that aren't held out, of at most FIT_ROWS different rows.

    Ids are chosen among the labels, before any text is read; the chosen ones are few enough to broadcast (16 bytes
    each), so documents are scanned once, without an exchange, and only the sample's texts are written. Where ids are
    repeated and their rows are more than FIT_ROWS, those with the smallest hashes are used, equal ones once.
    """
    y = columns(labels, ["doc_id", "toxic"]).filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    work = Work(docs.sparkSession, "toxicity")
    found = columns(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), "doc_id")
    sample = work.write("sample", found.select("text", "toxic", F.xxhash64("doc_id", "text").alias("hash")))
    if sample.count() > FIT_ROWS:
        least = sample.select("hash").distinct().orderBy("hash").limit(FIT_ROWS).agg(F.max("hash").alias("most"))
        sample = work.write("fewer", sample.join(least, F.col("hash") <= F.col("most")).dropDuplicates(["hash"]))
    lexicon = learn(sample.select("text", "toxic"), exceptions)
    work.close()
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score for each row of docs; a scan without shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, score double")


def accept(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """Rows that score under the threshold, with their columns; decided row by row, so null ids are kept or dropped by text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            yield b.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
