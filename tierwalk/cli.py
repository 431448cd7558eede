"""Command line: `run` a chain of one registrant, `research` chains of many, `warm` a document cache, `report` on an edge file, `holdings` against a ticker list, `scan` an index, `draw` a graph.

Exit codes: 0 done, 1 wrong arguments, 2 the chain could not be built, 3 its result could not be written.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk import config
from tierwalk.dims import tables
from tierwalk.operators import edges, graph, holdings, linkage, report, scan
from tierwalk.plans import chain, research
from tierwalk.sources import documents, edge_files, holdings_files, submissions, universe


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tierwalk", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    r.add_argument("--cik", required=True)
    r.add_argument("--data", required=True, help="folder of Parquet tables filings and companies")
    for name in ("--forms", "--index-dir", "--issuer-name", "--issuer-country", "--log-level", "--log-file", "--tables"):
        r.add_argument(name)
    r.add_argument("--depth", type=int)
    r.add_argument("--limit", type=int)
    r.add_argument("--out", required=True)
    m = sub.add_parser("research")
    m.add_argument("--data", required=True, help="folder of Parquet tables filings, companies and, for searches, universe")
    m.add_argument("--out", required=True)
    for name in ("--exchange", "--search", "--cik-file", "--cik-list", "--xbrl-search", "--index-dir", "--tables"):
        m.add_argument(name, default="")
    for name in ("--all-adversarial", "--all-adversarial-xbrl", "--prefilter"):
        m.add_argument(name, action="store_true")
    for name, value in (("--limit", 0), ("--depth", 2), ("--most-ciks", 100), ("--batches", 1)):
        m.add_argument(name, type=int, default=value)
    w = sub.add_parser("warm")
    w.add_argument("urls", help="text file of addresses")
    w.add_argument("cache")
    w.add_argument("--at-once", type=int, default=8)
    for name, inputs in (("report", ("edges",)), ("draw", ("edges",)), ("scan", ("index",)), ("holdings", ("table", "tickers"))):
        q = sub.add_parser(name)
        for i in inputs:
            q.add_argument(i)
        q.add_argument("--out")
    q.add_argument("--threshold", type=float, default=0.8)
    q.add_argument("--all-adversarial", action="store_true")
    q.add_argument("--include-hk", action="store_true")
    sub.choices["draw"].add_argument("--root")
    sub.choices["draw"].add_argument("--html", action="store_true")
    sub.choices["draw"].add_argument("--hops", type=int, default=2)
    sub.choices["scan"].add_argument("--conduit", action="store_true")
    return p


def typed(rows: DataFrame) -> DataFrame:
    """Rows of an edge file with flags and depth as such, and their order."""
    flags = {f: F.col(f) == "Y" for f in edges.FLAGS}
    return rows.withColumns(flags | {"chain_depth": F.coalesce(F.col("chain_depth").try_cast("int"), F.lit(0)), "seq": F.monotonically_increasing_id()})


def _chain(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        s = config.load(forms=tuple(a.forms.split(",")) if a.forms else None, depth=a.depth, filings_per_cik=a.limit, index_dir=a.index_dir, out=a.out, log_level=a.log_level, log_file=a.log_file)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    log = config.logger(s)
    try:
        filings = spark.read.parquet(f"{a.data}/filings").filter(F.col("form").isin(*s.forms) & (F.col("place") < s.filings_per_cik))
        roots = spark.createDataFrame([(a.cik,)], "cik string")
        sub = submissions.read(spark, s.index_dir) if s.descend else None
        names = {str(int(a.cik)): a.issuer_name} if a.issuer_name else None
        done = chain.run(filings, spark.read.parquet(f"{a.data}/companies"), roots, s.depth, s.most_ciks, sub, s.descension_depth, names, a.issuer_country, known=tables.Tables.load(spark, a.tables) if a.tables else tables.DEFAULT)
    except Exception:
        log.exception("the chain of %s could not be built", a.cik)
        return 2
    try:
        edge_files.write(done.edges, s.out, edge_files.header(a.cik, datetime.now(timezone.utc).isoformat()), ["seq"])
    except Exception:
        log.exception("%s could not be written", s.out)
        return 3
    log.info("%d edges of %s in %s", done.edges.count(), a.cik, s.out)
    return 0


def _research(spark: SparkSession, a: argparse.Namespace) -> int:
    words = lambda x: tuple(w.strip() for w in x.split(",") if w.strip())
    choice = research.Choice(a.exchange, words(a.search), a.cik_file, words(a.cik_list), a.all_adversarial, words(a.xbrl_search), a.all_adversarial_xbrl, a.limit, a.prefilter)
    sub = submissions.read(spark, a.index_dir) if a.index_dir else None
    named = a.exchange or a.search or a.all_adversarial
    known = tables.Tables.load(spark, a.tables) if a.tables else tables.DEFAULT
    try:
        chosen, found = research.select(spark, choice, spark.read.parquet(f"{a.data}/universe") if named else None, sub, research.finished(spark, a.out), known)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    read = lambda name: spark.read.parquet(f"{a.data}/{name}")
    rated = research.run(spark, chosen, read("filings"), read("companies"), a.out, sub, found, a.batches, known=known, max_depth=a.depth, cap=a.most_ciks)
    print(report.triage(rated))
    return 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.appName("tierwalk").getOrCreate()
    if a.command == "run":
        return _chain(spark, a)
    if a.command == "research":
        return _research(spark, a)
    if a.command == "warm":
        got = documents.complete(spark.read.text(a.urls).select(F.btrim("value").alias("url")).filter("url <> ''"), a.cache, at_once=a.at_once)
        print("{} of {} documents".format(*got.agg(F.count("content"), F.count(F.lit(1))).first()))
        return 0
    if a.command == "holdings":
        rows = holdings.named(holdings_files.read(spark, a.table))
        held = holdings.rollup(holdings.of_countries(rows, holdings.wanted_countries(not a.all_adversarial, a.include_hk)))
        matched = linkage.fuzzy(held, universe.ticker_lookup(spark, a.tickers, linkage.bare_name), "entity_name", a.threshold)
        if a.out:
            holdings.write(matched, a.out)
        text = holdings.summary(matched)
    elif a.command == "scan":
        text = report.scan_report(scan.country_scan(submissions.read(spark, a.index), a.conduit))
    else:
        rows = typed(edge_files.read(spark, a.edges))
        if a.command == "draw":
            if a.root:
                rows = graph.neighbourhood(rows, spark.createDataFrame([(a.root,)], "node string"), a.hops)
            lines = spark.createDataFrame([(report.page(rows),)], "value string") if a.html else report.drawn(rows)
            if a.out:
                lines.coalesce(1).write.mode("overwrite").text(a.out)
                return 0
            text = "\n".join(r[0] for r in lines.collect())
        else:
            root = edge_files.facts(spark, a.edges).filter("key = 'Root CIK'").select("value").limit(1).collect()
            text = report.detailed_report(rows, root[0][0] if root else "")
    if a.out and a.command != "holdings":
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
