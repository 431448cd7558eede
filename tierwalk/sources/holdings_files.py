"""Land-holdings tables from CSV and spreadsheet files; the header's row and a CSV's delimiter are found by looking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.operators.holdings import HEADER_WORDS

DELIMITERS = (",", "\t", "|", ";")


def header_row(rows: list[list[str]], words: tuple[str, ...] = HEADER_WORDS, least: int = 3) -> int:
    """The first of the given rows in whose cells three or more of the words occur; the first row where none has."""
    for i, row in enumerate(rows):
        cells = [str(c or "").strip().lower() for c in row]
        if sum(any(w in c for c in cells) for w in words) >= least:
            return i
    return 0


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns by the header's names, and seq; the delimiter is the one that the first lines hold equally often."""
    import csv as text

    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect()).lstrip("﻿")
    try:
        sep = text.Sniffer().sniff(head[:4096], "".join(DELIMITERS)).delimiter
    except text.Error:
        sep = max(DELIMITERS, key=head.split("\n", 1)[0].count)
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    named = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return named.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in named.columns], F.monotonically_increasing_id().alias("seq"))


def spreadsheet(spark: SparkSession, path: str, scan: int = 10) -> DataFrame:
    """The first sheet of each .xlsx file: columns by the header found in its first rows, rows with any value, and seq. A sheet is one row of work."""

    def cells(frames):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        def place(ref):
            n = 0
            for ch in re.match("[A-Z]+", ref)[0]:
                n = n * 26 + ord(ch) - 64
            return n - 1

        name = lambda e: e.tag.rsplit("}", 1)[-1]
        for f in frames:
            for data in f["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = z.namelist()
                    words = []
                    if "xl/sharedStrings.xml" in names:
                        words = ["".join(t.text or "" for t in s.iter() if name(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if name(s) == "si"]
                    sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
                    out, line = [], 0
                    for _, e in ElementTree.iterparse(z.open(sheet)):
                        if name(e) != "row":
                            continue
                        row = []
                        for i, c in enumerate(x for x in e if name(x) == "c"):
                            at = place(c.get("r")) if c.get("r") else i
                            row += [""] * (at + 1 - len(row))
                            value = "".join(t.text or "" for t in c.iter() if name(t) in ("v", "t"))
                            row[at] = (words[int(value)] if c.get("t") == "s" and value else value).strip()
                        out.append((line, row))
                        line += 1
                        e.clear()
                        if len(out) == 5000:
                            yield pd.DataFrame(out, columns=["line", "cells"])
                            out = []
                    yield pd.DataFrame(out, columns=["line", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "line long, cells array<string>")
    top = [r["cells"] for r in rows.filter(F.col("line") < scan).orderBy("line").collect()]
    at = header_row(top)
    heads = [(i, h.strip()) for i, h in enumerate(top[at] if top else []) if h.strip()]
    data = rows.filter(F.col("line") > at).select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(h) for i, h in heads], F.col("line").alias("seq"))
    return data.filter(F.concat_ws("", *[F.col(f"`{h}`") for _, h in heads]) != "") if heads else data


def read(spark: SparkSession, path: str) -> DataFrame:
    return spreadsheet(spark, path) if path.lower().endswith((".xlsx", ".xls")) else csv(spark, path)
