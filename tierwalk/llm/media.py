"""Media columns: texts as lossless WebP images in a binary column, images as pixel arrays.

A payload is the text's UTF-8 with bytes 255 after it up to a positive multiple of 576. Each byte is a grey pixel, 576 in
a row; after PART rows a new image begins, and the column's value is the images one after the other (a RIFF file tells
its length), so no more than one image is coded or decoded at a time however long the text. The encoder takes a palette
where few bytes occur, else the predictor (none, left, top) whose residuals have the smallest entropy.

Null texts are empty ones: a row of 255. Equal texts have equal images. Repeated rows and ids are rows of their own; an
empty table gives an empty result; other columns are ignored. A null image has null pixels, and a damaged one too, with the reason in
`error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm import webp
from tierwalk.llm.common import Work, columns, ship, text_or_empty

ROW, PART = 576, 1024
#: Bytes that a task gathers before it hands rows on, if no single row is longer.
BATCH = 4 << 20


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (ROW if not text else -len(text) % ROW)


def _entropy(n: np.ndarray) -> float:
    """Bits that samples with these counts of values need."""
    n = n[n > 0]
    return float(-(n * np.log2(n / n.sum())).sum())


def image(samples: np.ndarray) -> bytes:
    """A WebP file of grey samples (rows x columns of bytes), by the transforms that promise most."""
    grey = np.uint32(webp.BLACK) | samples.astype(np.uint32) * np.uint32(0x010101)
    counts = lambda x: np.bincount(x.reshape(-1), minlength=256)
    found = counts(samples)
    if np.count_nonzero(found) <= 16:
        return webp.encode(grey, palette=True)
    top = samples.copy()
    top[1:] -= samples[:-1]
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    plain, by_mode = _entropy(found), {1: _entropy(counts(left)), 2: _entropy(counts(top))}
    mode = min(by_mode, key=by_mode.get)
    if by_mode[mode] < 0.98 * plain:
        tiles = np.full((-(-samples.shape[0] >> 9), -(-samples.shape[1] >> 9)), mode)
        return webp.encode(grey, predictor=(tiles, 9), subtract_green=True)
    return webp.encode(grey, subtract_green=True)


def encoded(text: bytes) -> bytes:
    """The payload's images, one after the other."""
    samples = np.frombuffer(payload(text), np.uint8).reshape(-1, ROW)
    return b"".join(image(samples[i : i + PART]) for i in range(0, len(samples), PART))


def images(media: bytes) -> Iterator[np.ndarray]:
    """Pixels of each of the images in a value."""
    at = 0
    while at < len(media):
        if len(media) < at + 8:
            raise ValueError("the value ends early")
        end = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield webp.decode(media[at:end])
        at = end


def _in_turn(batches, make, schema: pa.Schema):
    """Rows that `make` gives for each row of the batches, in batches of about BATCH bytes."""
    rows, held = [], 0
    for b in batches:
        for r in range(b.num_rows):
            new, size = make([c[r].as_py() for c in b.columns])
            rows += new
            held += size
            if held > BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def one(row):
        media = encoded(row[1])
        return [{"doc_id": row[0], "n_bytes": len(row[1]), "media": media}], len(media)

    rows = columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: _in_turn(batches, one, schema), "doc_id long, n_bytes long, media binary")


def decode_images(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, part, width, height, argb (four bytes a pixel, blue first), error: a row for each image of each value."""
    ship(df.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary()), ("error", pa.string())])

    def one(row):
        key, value = row
        blank = {"key": key, "part": 0, "width": None, "height": None, "argb": None, "error": None}
        if value is None:
            return [blank], 0
        out, size = [], 0
        try:
            for i, argb in enumerate(images(value)):
                out.append({**blank, "part": i, "width": argb.shape[1], "height": argb.shape[0], "argb": argb.astype("<u4").tobytes()})
                size += 4 * argb.size
        except ValueError as e:
            out.append({**blank, "part": len(out), "error": str(e)})
        return out, size

    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{media}`").alias("value")).mapInArrow(lambda b: _in_turn(b, one, schema), "key long, part int, width int, height int, argb binary, error string")
    return rows.withColumnRenamed("key", key)


def features(parts: list[np.ndarray]) -> str:
    """Size, mean, spread, edges to the left and above, and 16 coarse rows of mean grey, all in whole numbers."""
    height, n = sum(len(p) for p in parts), sum(p.size for p in parts)
    found, value = sum(np.bincount(p.reshape(-1), minlength=256) for p in parts), np.arange(256)
    total, squares = int(found @ value), int(found @ value**2)
    apart = lambda a, b: int((np.maximum(a, b) - np.minimum(a, b)).sum(dtype=np.int64))
    across = sum(apart(p[:, 1:], p[:, :-1]) for p in parts)
    down = sum(apart(p[1:], p[:-1]) for p in parts)
    by_row = np.concatenate([p.sum(axis=1, dtype=np.int64) for p in parts])
    coarse = np.add.reduceat(by_row, np.arange(16) * height // 16) if height >= 16 else by_row[np.arange(16) % height]
    coarse = coarse // (ROW * np.maximum(1, np.diff(np.append(np.arange(16) * height // 16, height)))) if height >= 16 else coarse // ROW
    return f"{ROW}x{height};mean={total * 1000 // n};var={(n * squares - total * total) // (n * n)};across={across * 1000 // n};down={down * 1000 // n};rows={bytes(coarse.astype(np.uint8)).hex()}"


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of payloads, from the stored images alone."""
    ship(stored.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = pa.schema([(n, pa.string() if n.endswith("256") or n == "feature" else pa.int64()) for n in names])

    def one(row):
        doc_id, n_bytes, media = row
        parts = []
        for argb in images(media):
            samples = (argb & np.uint32(255)).astype(np.uint8)
            if (argb != (np.uint32(webp.BLACK) | samples.astype(np.uint32) * np.uint32(0x010101))).any():
                raise ValueError(f"the image of document {doc_id} isn't grey")
            parts.append(samples)
        data = b"".join(p.tobytes() for p in parts)
        found = [doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(parts)]
        return [dict(zip(names, found, strict=True))], 400

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lambda b: _in_turn(b, one, schema), ", ".join(f"{n} {'string' if n.endswith('256') or n == 'feature' else 'long'}" for n in names))


def stored_payloads(docs: DataFrame) -> DataFrame:
    """Writes every text as images into a table of the shared folder, reads it and returns what the images hold."""
    return read_back(Work(docs.sparkSession, "media").write("images", encode_texts(docs)))
