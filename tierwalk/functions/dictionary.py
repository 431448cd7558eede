"""Many tokens looked for at once: one automaton for a whole table, walked once over each text.

A `Matcher` is sent to the tasks with its table and builds its automaton there when first used; a lookup table on the driver is
bounded by LIMIT tokens. `find` takes tables of any size: beyond the bound its tokens stay a DataFrame and meet the texts by
their rarest grams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a table that is sent to tasks (some 100 bytes each).
LIMIT = 200_000


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


class Matcher:
    """Which of the tokens a text holds. Tokens are numbered in their order; equal ones have numbers of their own, empty ones are in no text."""

    def __init__(self, tokens: Sequence[str]):
        self.tokens = tuple(tokens)
        self.machine = None

    def __getstate__(self):
        return {"tokens": self.tokens, "machine": None}

    def _all(self, text: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        if self.machine is None:
            numbers: dict[str, list[int]] = {}
            for i, t in enumerate(self.tokens):
                if t:
                    numbers.setdefault(t, []).append(i)
            self.machine = ahocorasick.Automaton()
            for t, n in numbers.items():
                self.machine.add_word(t, (len(t), tuple(n)))
            self.machine.make_automaton()
        if not len(self.machine) or not text:
            return
        for last, (n, numbers) in self.machine.iter(text):
            yield last - n + 1, last + 1, numbers

    def first(self, text: str, words: bool = False) -> dict[int, int]:
        """Of every token that occurs its number and the place where it first begins; with `words` only between word boundaries."""
        out: dict[int, int] = {}
        for start, end, numbers in self._all(text):
            if words and ((start > 0 and _inside(text[start - 1])) == _inside(text[start]) or (end < len(text) and _inside(text[end])) == _inside(text[end - 1])):
                continue
            for i in numbers:
                out.setdefault(i, start)
        return out


def first_entry(entries: Sequence[int], found: dict[int, int]) -> tuple[int, int, int] | None:
    """(entry, token, place): of the entries (one number for each token) the smallest that has a token in the text, and of its tokens the first in the text, then in the table."""
    if not found:
        return None
    entry = min(entries[i] for i in found)
    place, token = min((at, i) for i, at in found.items() if entries[i] == entry)
    return entry, token, place


_KINDS = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
#: Rows that are worked out before they are put into Arrow's form.
ROWS = 1000


def struct_udf(make, kind: str):
    """A function of strings to a tuple (or None) as an Arrow-batched function of columns. Of rows alike in a batch one is worked out."""
    fields = [[x.strip() for x in p.split(":")] for p in kind.removeprefix("struct<").removesuffix(">").split(",")]
    blank = (None,) * len(fields)
    form = pa.struct([(name, _KINDS[k]) for name, k in fields])

    @F.arrow_udf(kind)
    def run(*parts: pa.Array) -> pa.Array:
        distinct = [p.dictionary_encode("encode") for p in parts]
        codes = np.zeros(len(parts[0]), np.int64)
        for d in distinct:
            # codes stay below the number of rows, so they don't overflow
            codes = np.unique(codes * len(d.dictionary) + d.indices.to_numpy(), return_inverse=True)[1]
        first = np.unique(codes, return_index=True)[1]
        done = []
        for at in range(0, len(first), ROWS):
            some = pa.array(first[at : at + ROWS])
            rows = [make(*row) or blank for row in zip(*[p.take(some).to_pylist() for p in parts], strict=True)]
            done.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], fields=list(form)))
        out = pa.concat_arrays(done) if done else pa.array([], form)
        return out if len(out) == len(codes) else out.take(pa.array(codes))

    return run


def mentions(text: Column, tokens: Sequence[str]) -> Column:
    """The tokens that a text holds in any case, in the order of the list; none for null."""
    matcher = Matcher([t.upper() for t in tokens])

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[tokens[i] for i in sorted(matcher.first(t.upper()))] if t else [] for t in texts], dtype=object)

    return run(text)


def find(texts: DataFrame, table: DataFrame, key: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, entry, token, at, n for every text that holds a token: the first entry of the table, its token that comes first in the text, where (from 1), and how many of all tokens the text holds.

    table: token, entry (a number; the least counts first). Tokens are compared in any case. Null or empty tokens and texts match nothing.
    """
    known = table.select(F.lower("token").alias("token"), F.col("entry").cast("long").alias("entry")).filter("token <> ''").groupBy("token").agg(F.min("entry").alias("entry"))
    rows = known.orderBy("entry", "token").limit(limit + 1).collect()
    low = texts.select(F.col(key).alias("_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    if len(rows) <= limit:
        matcher, entries = Matcher([r["token"] for r in rows]), [r["entry"] for r in rows]

        def one(t):
            found = matcher.first(t or "")
            hit = first_entry(entries, found)
            return None if hit is None else (hit[0], rows_[hit[1]], hit[2] + 1, len(found))

        rows_ = [r["token"] for r in rows]
        return low.select("_id", struct_udf(one, "struct<entry: long, token: string, at: int, n: int>")("_low").alias("_f")).filter("_f.entry is not null").select(F.col("_id").alias(key), "_f.*")
    from tierwalk.operators import linkage

    met = linkage.holds(low, known, "_low", "token").select("_id", "entry", "token", F.instr(F.col("_low"), F.col("token")).alias("at"))
    # tokens of the least entry only, then the first in the text; numbers of the rest are counted
    return met.groupBy("_id").agg(F.min(F.struct("entry", "at", "token")).alias("_f"), F.count(F.lit(1)).cast("int").alias("n")).select(F.col("_id").alias(key), "_f.entry", "_f.token", "_f.at", "n")
