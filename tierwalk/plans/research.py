"""Research over many registrants: choosing them in one of seven ways, chains side by side, results with a log of what is finished."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.dims import tables
from tierwalk.operators import report, scan, targets
from tierwalk.plans import chain
from tierwalk.session import stored
from tierwalk.sources import documents, edge_files


@dataclass(frozen=True)
class Choice:
    """One way is used, in this order: exchange, words searched for, a list's path, a list, all adversarial countries by name, codes of the index, all adversarial codes."""

    exchange: str = ""
    search: tuple[str, ...] = ()
    cik_file: str = ""
    ciks: tuple[str, ...] = ()
    all_adversarial: bool = False
    codes: tuple[str, ...] = ()
    all_codes: bool = False
    limit: int = 0
    prefilter: bool = False
    notes: dict = field(default_factory=dict)


def select(spark: SparkSession, choice: Choice, companies: DataFrame | None = None, sub: DataFrame | None = None, done: DataFrame | None = None, known: tables.Tables = tables.DEFAULT) -> tuple[DataFrame, DataFrame | None]:
    """Targets (cik, name, at) in order, after limit, exclusion of those done and the index's filter; and what found them (or None).

    companies: cik, name, ticker, exchange, seq. All adversarial countries take in the registrants whose codes in the index are theirs.
    """
    place = lambda part, seq: F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("ord"), seq.cast("long").alias("seq"))
    found = None

    def coded(codes: Sequence[str]) -> DataFrame:
        hit = targets.by_code(sub, codes)
        # in the index's order: a registrant stands where its first row does, and has the name of its latest row, the first of several
        latest = sub.groupBy("cik").agg(F.max_by("name", F.struct(F.col("filed"), -F.col("seq"))).alias("name"), F.min("seq").alias("seq"))
        return hit.join(latest, "cik").select("cik", "name", place(1, F.col("seq")).alias("at"))

    if choice.exchange:
        out = companies.filter(F.lower("exchange") == choice.exchange.strip().lower()).select("cik", "name", place(0, F.col("seq")).alias("at"))
    elif choice.search or choice.all_adversarial:
        words = choice.search or tuple(c.lower() for c in tables.TIERS["ADVERSARIAL"])
        found = targets.found_by(companies, targets.terms(spark, words, expansions=known.expansions))
        out = targets.union(targets.targets(found))
        if choice.all_adversarial and sub is not None:
            more = coded(tuple(tables.ADVERSARIAL_CODES)).join(out.select("cik"), "cik", "left_anti")
            out = out.unionByName(more)
    elif choice.cik_file:
        out = documents.registrant_list(spark, choice.cik_file).select("cik", F.lit("").alias("name"), place(0, F.monotonically_increasing_id()).alias("at"))
    elif choice.ciks:
        out = spark.createDataFrame([(c.strip(), "", i) for i, c in enumerate(choice.ciks)], "cik string, name string, i int").select("cik", "name", place(0, F.col("i")).alias("at"))
    elif choice.codes or choice.all_codes:
        out = coded(tuple(c.upper() for c in choice.codes) or tuple(tables.ADVERSARIAL_CODES))
    else:
        raise ValueError("no way of choosing registrants is given")
    return targets.chosen(out, choice.limit, done, sub if choice.prefilter else None), found


def expansion_report(found: DataFrame) -> dict:
    """What terms found whom: registrants by country, and the matches of each."""
    rows = found.orderBy("ord", "seq").collect()  # registrants chosen by name
    return {"by_country": {r["country"]: r["n"] for r in targets.by_nation(found).collect()}, "matches": {r["cik"]: [m.asDict() for m in r["matches"]] for r in rows}}


def code_report(sub: DataFrame) -> dict:
    """How many registrants each code and field found, and how many have business and incorporation in different countries."""
    found = scan.country_scan(sub, conduit=True)
    return {
        "codes": {r["code"]: r["n"] for r in scan.counts_by(found, "matched_codes", "code").collect()}, "fields": {r["field"]: r["n"] for r in scan.counts_by(found, "matched_fields", "field").collect()},
        "moved_abroad": found.filter(scan.moved_abroad(found)).count(), "intermediaries": scan.go_betweens(found, True).count(),
    }


class Output:
    """A folder of results with a log of what is finished.

    A batch of roots is written to edges/<batch> (edge files by rating and root), results/<batch> and totals/<batch>; then commits/<batch> tells
    that all of it is there. What has no commit doesn't count and is written anew by the next run, which takes the same number. Of a
    root in several batches the last counts.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.jvm.Path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join((self.base, *parts))

    def batches(self) -> list[str]:
        """Numbers of the finished batches, in order."""
        folder = self.jvm.Path(self.path("commits"))
        return sorted(f.getPath().getName() for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def _commit(self, batch: str, facts: dict) -> None:
        """Fails if the batch is finished already: two runs at once don't mix."""
        out = self.fs.create(self.jvm.Path(self.path("commits", batch)), False)
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()

    def add(self, edges: DataFrame, results: DataFrame, made: str, facts: dict) -> str:
        """Writes one batch: edges (root_cik, seq and the edge's columns) and results (root_cik, rating, at, ...), a row for each root, also of roots without edges."""
        batch = f"{int(self.batches()[-1]) + 1 if self.batches() else 0:06d}"
        results.write.mode("overwrite").parquet(self.path("results", batch))
        known = self.spark.read.parquet(self.path("results", batch)).select("root_cik", "rating")
        edge_files.write_by_root(edges.join(known, "root_cik"), self.path("edges", batch), ["seq"], made)
        self._commit(batch, {"batch": batch, "roots": known.count(), "made": made, **facts})
        return batch

    def log(self) -> list[dict]:
        """What each commit says, in order: a line for each batch."""
        if not self.batches():
            return []
        rows = self.spark.read.text([self.path("commits", b) for b in self.batches()], wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda r: r["batch"])

    def results(self) -> DataFrame | None:
        """One row for each finished root, from the last batch that has it; None before the first batch."""
        every = None
        for b in self.batches():
            one = self.spark.read.parquet(self.path("results", b)).withColumn("batch", F.lit(b))
            every = one if every is None else every.unionByName(one, allowMissingColumns=True)
        if every is None:
            return None
        rest = [c for c in every.columns if c != "root_cik"]
        return every.groupBy("root_cik").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("root_cik", "_r.*")

    def edges(self) -> DataFrame:
        """All edges of finished roots, with root_cik, rating, place (the root's order), at (the edge's)."""
        paths = {b: self.path("edges", b) for b in self.batches()}
        rows = edge_files.read_by_root(self.spark, list(paths.values())).withColumn("batch", F.element_at(F.split("folder", "/"), -1))
        last = self.results()
        if last is None:
            return rows.withColumn("place", F.lit(None).cast("string")).drop("folder", "batch")
        return rows.drop("folder", "rating").join(last.select("root_cik", "batch", "rating", F.col("at").alias("place")), ["root_cik", "batch"]).drop("batch")

    def compact(self, made: str) -> str:
        """Writes all edges of finished roots, in the roots' order, as one edge file (in parts) and gives its path."""
        rows, path = self.edges(), self.path("combined")
        facts = edge_files.header("all", made) | {"Roots": self.results().count() if self.batches() else 0}
        edge_files.write(rows, path, facts, ["place", "root_cik", "at"])
        return path


def _written(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def tell(out: Output, made: str, asked: int | None = None) -> DataFrame:
    """Writes what all finished roots come to: results (JSON lines, in order), triage, totals, manifest with progress. Returns the results."""
    rated = out.results()
    rated.orderBy("at", "root_cik").select(F.to_json(F.struct(*[c for c in rated.columns if c not in ("at", "batch")])).alias("value")).write.mode("overwrite").text(out.path("research"))
    report.triage_lines(rated).write.mode("overwrite").text(out.path("triage"))
    n, log = rated.count(), out.log()
    _written(out.spark, out.path("summary"), report.run_summary(rated))
    _written(out.spark, out.path("manifest"), json.dumps({"finished": n, "targets": n if asked is None else asked, "edges": sum(b["edges"] for b in log), "batches": log, "made": made}, indent=2))
    return rated


def run(spark: SparkSession, chosen: DataFrame, filings: DataFrame, companies: DataFrame, out: str, sub: DataFrame | None = None, found: DataFrame | None = None, batches: int = 1, made: str | None = None, **how) -> DataFrame:
    """Chains of all targets in `batches` jobs; each is committed when its edges are written, and the reports then tell of all roots finished so far. Returns the results.

    Roots that `out` has finished are left alone, so a run that broke off is taken up by running it again: what it wrote without a
    commit is written anew, and the end is the same as without the break. Roots are dealt to batches by a hash, so a batch is one
    job of chains side by side however many roots there are.
    """
    made = made or datetime.now(timezone.utc).isoformat()
    result = Output(spark, out)
    targets_ = stored(chosen.select("cik", "name", F.to_json("at").alias("at"), F.pmod(F.xxhash64("cik"), F.lit(batches)).alias("batch")), "targets")
    asked = targets_.count()
    if found is not None:
        _written(spark, result.path("expansion"), json.dumps(expansion_report(found), indent=2))
    for b in range(batches):
        todo = targets_.filter(F.col("batch") == b).join(finished(spark, out), "cik", "left_anti")
        n = todo.count()
        if n == 0:
            continue
        done = chain.run(filings, companies, todo.select("cik"), sub=sub, **how)
        rated = todo.select(F.col("cik").alias("root_cik"), F.col("name").alias("target"), "at").join(report.rated_roots(done.edges), "root_cik", "left")
        rated = rated.withColumns({"rating": F.coalesce("rating", F.lit("UNKNOWN")), "score": F.coalesce("score", F.lit(0))})
        result.add(done.edges, rated, made, {"edges": done.edges.count(), "batch_of": batches})
        tell(result, made, asked)
    return tell(result, made, asked) if result.batches() else spark.createDataFrame([], "root_cik string, rating string, score int")


def finished(spark: SparkSession, out: str) -> DataFrame:
    """cik of the roots that `out` has finished, with or without edges."""
    rated = Output(spark, out).results()
    return spark.createDataFrame([], "cik string") if rated is None else rated.select(F.col("root_cik").alias("cik"))
