"""Readers of the tab-separated submission index: folders and archives of periods, rows decoded, one row for each accession number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.functions.text import BLANKS
from tierwalk.operators.order import numbered

# The fields of a row, in order.
FIELDS = (
    "adsh", "cik", "name", "sic", "countryba", "stprba", "cityba", "zipba", "bas1", "bas2", "baph", "countryma", "stprma", "cityma", "zipma", "mas1", "mas2", "countryinc", "stprinc", "ein", "former", "changed", "afs", "wksi", "fye",
    "form", "period", "fy", "fp", "filed", "accepted", "prevrpt", "detail", "instance", "nciks", "aciks", "pubfloatusd", "floatdate", "floataxis", "floatmems",
)
KEPT = ("adsh", "cik", "name", "sic", "countryba", "stprba", "cityba", "countryma", "countryinc", "stprinc", "ein", "former", "changed", "form", "period", "filed", "nciks", "aciks")
#: Fields that a row has at least, up to the list of registrants.
LEAST = 36
MEMBERS = ("sub.tsv", "sub.txt")


def _listed(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names in a folder, in order, and whether each is a folder; read through Spark's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)) if fs.exists(p) else []


def _lines_of_file(spark: SparkSession, path: str, period: str, rank: int) -> DataFrame:
    lines = spark.read.text(path).select("value", F.struct(F.lit(rank).alias("entry"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    return lines.withColumn("source_period", F.lit(period))


def folder(spark: SparkSession, path: str, rank: int = 0) -> DataFrame | None:
    """Lines of the first of MEMBERS in a folder; its name without _notes is the period. None without such a file."""
    names = [n for n, _ in _listed(spark, path)]
    member = next((m for m in MEMBERS if m in names), None)
    period = path.rstrip("/").rsplit("/", 1)[-1].replace("_notes", "")
    return _lines_of_file(spark, f"{path.rstrip('/')}/{member}", period, rank) if member else None


def archive(spark: SparkSession, path: str, rank: int = 0) -> DataFrame:
    """Lines of the index in an archive, whose name is the period; an archive that can't be read has none."""
    period = path.rsplit("/", 1)[-1].removesuffix(".zip").replace("_notes", "")
    members = MEMBERS

    def unpacked(frames):
        import io
        import zipfile

        import pandas as pd

        for f in frames:
            for data in f["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        name = next((n for m in members for n in z.namelist() if n.rsplit("/", 1)[-1] == m), None)
                        if name is None:
                            continue
                        part = []
                        with io.TextIOWrapper(z.open(name), "utf-8", errors="replace", newline="\n") as lines:
                            for i, line in enumerate(lines):
                                part.append((line.rstrip("\r\n"), i))
                                if len(part) == 10000:
                                    yield pd.DataFrame(part, columns=["value", "line"])
                                    part = []
                        yield pd.DataFrame(part, columns=["value", "line"])
                except (zipfile.BadZipFile, OSError):
                    continue

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpacked, "value string, line long")
    return rows.select("value", F.struct(F.lit(rank).alias("entry"), F.lit(0).cast("long").alias("block"), F.col("line")).alias("at"), F.lit(period).alias("source_period"))


def decoded(lines: DataFrame) -> DataFrame:
    """Rows of KEPT, source_period and seq (any order) from lines (value, at, source_period).

    A file's first line that isn't blank is left out if it begins with the first field's name. Rows need LEAST fields and a
    registrant; fields are stripped; what is no number of registrants is 0. Of rows with one accession number (also an empty one)
    the first counts.
    """
    some = lines.filter(F.btrim("value", F.lit(BLANKS)) != "")
    heads = some.groupBy("source_period", F.col("at.entry").alias("entry")).agg(F.min("at").alias("_first"))  # a row for each file
    rows = some.withColumn("entry", F.col("at.entry")).join(heads, ["source_period", "entry"]).filter(~((F.col("at") == F.col("_first")) & F.col("value").startswith("adsh")))
    rows = rows.withColumn("f", F.split("value", "\t", -1)).filter(F.size("f") >= LEAST)
    field = lambda n: F.btrim(F.get("f", F.lit(FIELDS.index(n))), F.lit(BLANKS))
    rows = rows.select(*[(F.coalesce(field(n).try_cast("int"), F.lit(0)) if n == "nciks" else field(n)).alias(n) for n in KEPT], "source_period", F.col("at").alias("seq")).filter("cik <> ''")
    rest = [c for c in rows.columns if c != "adsh"]
    return rows.groupBy("adsh").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("adsh", "r.*")


def read(spark: SparkSession, base: str) -> DataFrame:
    """All periods under a folder, in the order of their names: folders with _notes in their name or ending in q1 to q4, and archives; a period counts once. seq numbers the rows in their order from 1."""
    parts, seen = [], set()
    for rank, (name, is_folder) in enumerate(_listed(spark, base)):
        path, period = f"{base.rstrip('/')}/{name}", name.removesuffix(".zip").replace("_notes", "")
        if period in seen:
            continue
        if is_folder and ("_notes" in name or name.lower().endswith(("q1", "q2", "q3", "q4"))):
            part = folder(spark, path, rank)
        elif not is_folder and name.endswith(".zip"):
            part = archive(spark, path, rank)
        else:
            continue
        if part is not None:
            seen.add(period)
            parts.append(part)
    if not parts:
        parts.append(spark.createDataFrame([], "value string, at struct<entry: int, block: long, line: long>, source_period string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rows = decoded(out).withColumnRenamed("seq", "_at")
    return numbered(rows, ["_at"], "seq").drop("_at")
