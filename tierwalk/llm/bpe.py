"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end a valid encoding of that
prefix. The table of those last tokens is filled from left to right: a token that ends at byte i is
the right one when it stands alone, or when it may follow the last token of the prefix before it. Two
tokens may follow each other when encoding their joined bytes gives the two tokens again; that is
decided on the merge tree alone. Reading the table backwards gives the encoding; appending bytes only
extends the table, and an edit only needs the table from the edited byte on.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tierwalk.llm.common import columns, ship, sliced

#: Entries that a worker keeps: pieces and their ids, and answers to "may these two tokens be neighbours".
PIECE_CACHE = 250_000
PAIR_CACHE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        by_end: dict[bytes, set[int]] = {}
        for t in ranks:
            by_end.setdefault(t[-3:], set()).add(len(t))
        #: lengths of the tokens of three bytes or more that end in given three bytes
        self.lengths = {b: tuple(sorted(n)) for b, n in by_end.items() if len(b) == 3}
        self.halves = self._halves()
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        #: two generations: what is still in use moves from the older to the younger
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merge(self, data: bytes, below: int) -> list[bytes]:
        """Plain merging of a short byte string by tokens whose rank is under `below`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self) -> dict[int, tuple[int, int]]:
        """For each token the two tokens that its last merge joins; absent where it is no merge (single bytes)."""
        out = {}
        for t, r in self.ranks.items():
            if len(t) > 1:
                parts = self._merge(t, r)
                if len(parts) == 2:
                    out[r] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether `left` then `right` is how their joined bytes are encoded.

        The pair is broken by any merge across the seam that comes before the seam's own neighbours
        are built. Going down the right edge of the left tree and the left edge of the right tree,
        the younger side is opened first; a seam merge older than what was opened last breaks it.
        """
        bytes_of, halves, rank_of = self.bytes_of, self.halves, self.ranks.get
        limit = 1 << 60
        while True:
            joined = rank_of(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                if left in halves:
                    limit, left = left, halves[left][1]
                elif right in halves:
                    limit, right = right + 1, halves[right][0]
                else:
                    return True
            elif right in halves:
                limit, right = right + 1, halves[right][0]
            elif left in halves:
                limit, left = left, halves[left][1]
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            got = self.pairs[key] = self.fits(left, right)
        return got

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fills the table for the prefixes of data that it lacks; last[i] is the last token of data[:i + 1]."""
        get, lengths, known, fits = self.ranks.get, self.lengths.get, self.pairs.get, self._fits
        for i in range(len(last), len(data)):
            end = i + 1
            t = get(data[i:end])
            if t is not None and i:
                p = last[i - 1]
                ok = known(p << 20 | t)
                if not (ok or ok is None and fits(p, t)):
                    t = None
            if t is None and i:
                t = get(data[i - 1 : end])
                if t is not None and i > 1:
                    p = last[i - 2]
                    ok = known(p << 20 | t)
                    if not (ok or ok is None and fits(p, t)):
                        t = None
                if t is None:
                    for n in lengths(data[i - 2 : end], ()):
                        if n > end:
                            break
                        t = get(data[end - n : end])
                        if t is None:
                            continue
                        if n == end:
                            break
                        p = last[i - n]
                        ok = known(p << 20 | t)
                        if ok or ok is None and fits(p, t):
                            break
                        t = None
            if t is None:
                raise ValueError("the rank table can't encode this text")
            last.append(t)
        return last

    def back(self, last: list[int]) -> list[int]:
        """The ids of the whole data from its table."""
        out, i, size = [], len(last), self.bytes_of
        while i:
            out.append(last[i - 1])
            i -= len(size[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.back(self.extend(data, []))

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Table of data + more from the table of data."""
        return data + more, self.extend(data + more, list(last))

    def edit(self, data: bytes, last: list[int], at: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Table after data[at:end] becomes new; only prefixes from the edited byte on are computed again."""
        data = data[:at] + new + data[end:]
        return data, self.extend(data, last[:at])

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text; each match of the pattern is encoded by itself."""
        young, old = self.pieces, self.older
        out = []
        for p in self.pattern.findall(text):
            got = young.get(p)
            if got is None:
                got = old.get(p)
                if got is None:
                    got = self.packed(p)
                if len(p) <= 64:
                    if len(young) >= PIECE_CACHE:
                        self.older, self.pieces = old, young = young, {}
                    young[p] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each worker process and vocabulary."""
    key = (path, pattern)
    if key not in _coders:
        _coders[key] = ByteBPE(read_ranks(path), pattern)
    return _coders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: the id column and token_ids array<int>. A null text counts as empty and has no ids."""
    ship(docs.sparkSession)
    rows = columns(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for b in sliced(batches, 500):
            ids = [np.frombuffer(c.encode_packed(t or ""), "<i4") for t in b.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], [id_col, "token_ids"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, token_ids array<int>")


def roundtrip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; digests of both directions. One pass, no shuffle; an Arrow batch (64 MB, or one longer text) in memory.

    Null texts count as empty: no ids, the digests of no bytes. Repeated rows give repeated results, null ids stay null. An
    empty table gives an empty one; other columns are left behind.
    """
    ship(docs.sparkSession)
    rows = columns(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(1):
                ids = c.encode_packed(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
