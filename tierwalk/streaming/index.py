"""Incremental forms of the index and the registers: new files become rows of tables as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.functions.text import BLANKS
from tierwalk.operators import gaps
from tierwalk.session import stored
from tierwalk.sources.submissions import FIELDS, KEPT, LEAST


def period_date(period: Column, otherwise: Column) -> Column:
    """The last month of a period's name (2024q1, 2024_02): what its rows' time is; `otherwise` where a name has none."""
    year, quarter, month = (F.regexp_extract(F.lower(period), p, 1) for p in (r"^(\d{4})", r"^\d{4}q([1-4])", r"^\d{4}[_-](0[1-9]|1[0-2])"))
    last = F.when(quarter != "", quarter.try_cast("int") * 3).when(month != "", month.try_cast("int"))
    return F.coalesce(F.make_date(year.try_cast("int"), last, F.lit(1)).cast("timestamp"), otherwise)


def submissions(spark: SparkSession, pattern: str, within: str = "400 days", **options) -> DataFrame:
    """A stream of decoded rows of new files <period>_notes/sub.tsv, one for each accession number: the first in the order of periods and lines, in whatever order files arrive.

    A row waits until no file of a period that is `within` of its own can come, as far as the newest period tells, so what is
    held is the rows of that span. Files of older periods come too late and are left out; an accession number that returns after a longer
    gap is a row again. A file's first line that isn't blank is its header if it begins with the first field's name; files are read whole. options: of the stream's source.
    """
    files = spark.readStream.options(**options).text(pattern, wholetext=True)
    files = files.select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:_notes)?/[^/]+$", 1).alias("source_period"), F.col("_metadata.file_modification_time").alias("_made"))
    some = F.filter(F.split("value", r"\r?\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    lines = files.withColumn("_time", period_date(F.col("source_period"), F.col("_made"))).select("source_period", "_time", F.posexplode(some).alias("_line", "value"))
    lines = lines.filter("not (_line = 0 and startswith(value, 'adsh'))")
    rows = lines.withColumn("f", F.split("value", "\t", -1)).filter(F.size("f") >= LEAST)
    field = lambda n: F.btrim(F.get("f", F.lit(FIELDS.index(n))), F.lit(BLANKS))
    rows = rows.select("_time", "_line", *[(F.coalesce(field(n).try_cast("int"), F.lit(0)) if n == "nciks" else field(n)).alias(n) for n in KEPT], "source_period").filter("cik <> ''")
    first = F.min_by(F.struct(*KEPT, "source_period"), F.struct("source_period", "_line"))
    return rows.withWatermark("_time", within).groupBy(F.session_window("_time", within), "adsh").agg(first.alias("_r")).select("_r.*")


class Gaps:
    """A gap analysis that follows inserts: state entities and federal names come in any order, and what the gaps are is known after every batch without comparing all anew.

    Of a batch, new entities meet all federal names and new federal names all entities, by grams; the names that are thereby
    shown are kept. An entity is a gap while its name isn't among them. Each batch has folders of its own and its number, so a batch that
    is done again replaces itself.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str):
        self.spark, self.base, self.schema = spark, base.rstrip("/"), schema

    def _table(self, name: str, schema: str) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.base}/{name}")

    def add(self, batch: int, entities: DataFrame | None = None, federal: DataFrame | None = None) -> None:
        """Takes new entities and new federal names (name) in."""
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={batch}")
        earlier = lambda name, schema: self._table(name, schema).filter(F.col("batch") != batch).drop("batch")
        old_e, old_f = earlier("entities", self.schema).select(F.upper("name").alias("_n")).distinct(), earlier("federal", "name string").select(F.col("name").alias("_f")).distinct()
        new_e = entities.select(F.upper("name").alias("_n")).distinct() if entities is not None else old_e.limit(0)
        new_f = federal.select(F.upper("name").alias("_f")).distinct() if federal is not None else old_f.limit(0)
        shown = gaps.known_names(new_e, old_f.union(new_f).distinct()).union(gaps.known_names(old_e, new_f)).distinct()
        write(shown.join(earlier("shown", "_n string"), "_n", "left_anti"), "shown")
        if entities is not None:
            write(entities, "entities")
        if federal is not None:
            write(new_f.select(F.col("_f").alias("name")), "federal")

    def now(self) -> DataFrame:
        """The gaps by now, with scores."""
        long = self._table("federal", "name string").select(F.col("name").alias("_f")).filter(F.length("_f") > gaps.SHORT)
        return gaps.scored(self._table("entities", self.schema).drop("batch"), self._table("shown", "_n string").select("_n").distinct(), long)

    def follow(self, entities: DataFrame, federal: DataFrame, checkpoint: str):
        """Starts one query over both streams, so that no two batches pass each other unseen."""
        of = entities.select(F.struct(*entities.columns).alias("entity"), F.lit(None).cast("string").alias("federal"))
        both = of.unionByName(federal.select(F.col("name").alias("federal")), allowMissingColumns=True)

        def take(rows: DataFrame, batch: int) -> None:
            rows = stored(rows, "gap-batch")
            self.add(batch, rows.filter("federal is null").select("entity.*"), rows.filter("federal is not null").select(F.col("federal").alias("name")))

        return both.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_entities(entities: DataFrame, table: str, checkpoint: str):
    """Starts a query that appends a stream of state entities to a table; the gaps are worked out from it whenever they are asked for."""
    return entities.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").start()


def gaps_so_far(spark: SparkSession, table: str, schema: str, federal: DataFrame) -> DataFrame:
    """The gaps among the state entities that a table has by now."""
    return gaps.gaps(spark.read.schema(schema).parquet(table), federal)


def save(entities: DataFrame, federal: DataFrame, path: str) -> None:
    """A snapshot of what a gap analysis knows: all fields of its entities, and the federal names."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    federal.write.mode("overwrite").parquet(f"{path}/federal")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/federal")
