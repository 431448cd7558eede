"""Pipe-delimited edge files: comment lines with facts, a header, then a row for each edge. Several files are read side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.functions.text import flag, let, sanitized

# The columns of an edge file.
COLUMNS = (
    "source", "source_type", "source_jurisdiction", "source_risk_tier", "target", "target_type", "target_jurisdiction", "target_risk_tier", "relationship", "detail", "company_name", "company_cik",
    "state_affiliation", "state_affiliation_sub", "state_affiliation_detail", "role_is_executive", "role_is_board", "role_is_ownership", "role_is_obscuring", "chain_depth", "filing_accession", "filing_form", "filing_date", "method", "notes",
)
RATINGS = ("CRITICAL", "HIGH", "ELEVATED", "MODERATE", "LOW", "UNKNOWN")


#: A line whose fields (divided by \x01) are as `sanitized` leaves them: printable ASCII without | and ", no spaces at either end.
_FIELD = r'(?:[!#-{}~]++(?: ++[!#-{}~]++)*+)?+'


def line(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> Column:
    """An edge as a line; booleans are Y or empty, nulls are empty.

    Most lines need no change, which one pattern over the whole line tells; the others are put in order field by field, in an
    array, so that a line's code stays small however many columns it has.
    """
    kinds = dict(df.dtypes)
    fields = [flag(F.col(c)) if kinds[c] == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    clean = rf"^{_FIELD}(?:\x01{_FIELD}){{{len(columns) - 1}}}\z"
    whole = lambda t: F.when(t.rlike(clean), F.replace(t, F.lit("\x01"), F.lit("|"))).otherwise(F.array_join(F.transform(F.array(*fields), sanitized), "|"))
    return let(F.concat_ws("\x01", *fields), whole)


def header(root_cik: str, made: str, columns: tuple[str, ...] = COLUMNS) -> dict[str, str]:
    """Facts of an edge file about one registrant."""
    return {"Generated": made, "Root CIK": root_cik, "Delimiter": "|", "Fields": " | ".join(columns)}


def write(edges: DataFrame, path: str, facts: dict[str, str], order: list[str], columns: tuple[str, ...] = COLUMNS) -> None:
    """Writes parts that, in the order of their names, are one edge file. Ranges of `order` are sorted side by side."""
    spark = edges.sparkSession
    top = [f"# {k}: {v}" for k, v in facts.items()] + ["|".join(columns)]
    keys = [f"_o{i}" for i in range(len(order))]
    rows = edges.select(line(edges, columns).alias("value"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(*keys).sortWithinPartitions(*keys)
    spark.createDataFrame([("\n".join(top),)], "value string").coalesce(1).union(rows.select("value")).write.mode("overwrite").text(path)


def write_by_root(edges: DataFrame, path: str, order: list[str], made: str, root: str = "root_cik", rating: str = "rating", columns: tuple[str, ...] = COLUMNS) -> None:
    """Edge files of all roots in one job, in folders by rating and root. A root's folder is one edge file, in parts: the first begins with
    the facts and the header, and a root with many edges goes to several tasks. Only the folders of `path` are replaced.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    rows = edges.select(F.col(rating).alias("rating"), F.col(root).cast("string").alias("root_cik"), F.lit(1).alias("_p"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], line(edges, columns).alias("value"))
    facts = [F.lit(f"# {k}: {v}\n") if k != "Root CIK" else F.concat(F.lit("# Root CIK: "), "root_cik", F.lit("\n")) for k, v in header("", made, columns).items()]
    kinds = dict(rows.dtypes)
    tops = rows.select("rating", "root_cik").distinct().select("rating", "root_cik", F.lit(0).alias("_p"), *[F.lit(None).cast(kinds[k]).alias(k) for k in keys], F.concat(*facts, F.lit("|".join(columns))).alias("value"))
    by = ("rating", "root_cik", "_p", *keys)
    rows.unionByName(tops).repartitionByRange(*by).sortWithinPartitions(*by).select("rating", "root_cik", "value").write.mode("overwrite").partitionBy("rating", "root_cik").text(path)


def read_by_root(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """folder, rating, root_cik, at (the place in a root's file) and the columns of all edges under folders that `write_by_root` made."""
    if not paths:
        return spark.createDataFrame([], "folder string, rating string, root_cik string, at struct<file: string, block: long, seq: long>, " + ", ".join(f"{c} string" for c in columns))
    every = None
    for p in paths:
        one = spark.read.schema("value string, rating string, root_cik string").text(p)
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
        one = one.select("value", F.lit(p).alias("folder"), "rating", "root_cik", at.alias("at"))
        every = one if every is None else every.unionByName(one)
    of = ["folder", "rating", "root_cik"]
    heads = every.filter(~F.col("value").startswith("#")).groupBy(*of).agg(F.min("at").alias("head"))
    rows = every.join(heads, of).filter(F.col("at") > F.col("head")).withColumn("f", F.split("value", r"\|", -1))
    return rows.select(*of, "at", *[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).alias("at"))


def _with_head(lines: DataFrame) -> DataFrame:
    """Lines with their own file's header's place: the first line that is no comment. A row for each file is joined."""
    heads = lines.filter(~F.col("value").startswith("#")).groupBy(F.col("file").alias("_f")).agg(F.min("at").alias("head"))
    return lines.join(heads, F.col("file") == F.col("_f"), "left").drop("_f")


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS, one: bool = True) -> DataFrame:
    """Rows with a source. Lines up to a file's header are left out; later ones may start with #.

    A path that `write` made is one file in several parts, of which only the first has a header (one); a pattern over
    separate files has a header in each (one=False).
    """
    lines = _lines(spark, path)
    if one and "*" not in path and "," not in path:
        lines = lines.withColumns({"at": F.struct("file", "at.block", "at.seq"), "file": F.lit("")})
    rows = _with_head(lines).filter(F.col("at") > F.col("head")).withColumn("f", F.split("value", r"\|", -1))
    return rows.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)], *([] if one else ["file"])).filter("source <> ''")


def facts(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of the comment lines before each file's header."""
    lines = _with_head(_lines(spark, path))
    pair = r"^#\s*([^:]+):\s*(.*)$"
    top = lines.filter((F.col("head").isNull() | (F.col("at") < F.col("head"))) & F.col("value").rlike(pair))
    return top.select("file", F.btrim(F.regexp_extract("value", pair, 1)).alias("key"), F.btrim(F.regexp_extract("value", pair, 2)).alias("value"))


def completed(spark: SparkSession, path: str) -> DataFrame:
    """file, cik: files with a header and at least a row, and the registrant of their name without a rating before it, so that a run can go on with the others."""
    rows = _lines(spark, path).filter(F.col("value").contains("|") & ~F.col("value").startswith("#"))
    full = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return full.select("file", F.regexp_extract(F.regexp_replace(name, rf"^({'|'.join(RATINGS)})_", ""), r"(\d+)", 1).alias("cik"))


def combined(parts: list[DataFrame]) -> DataFrame:
    """All rows of several results, one after the other."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
