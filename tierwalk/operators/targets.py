"""Choosing registrants to look at: searches by term, kind and country, unions, exclusions, counts of what found whom."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.dims import tables
from tierwalk.functions import lookup
from tierwalk.operators import linkage

TERMS = "term string, kind string, country string, ord int"


def terms(spark: SparkSession, keywords: Iterable[str], least: int | None = None, expansions: dict | None = None) -> DataFrame:
    """term, kind, country, ord of search words; with least only terms of that many characters, each once."""
    rows, n = [], 0
    for k in keywords:
        country = lookup.canonical(k, expansions)
        keep = {t.lower() for t in lookup.search_terms(k, least, expansions)} if least and country else None
        for kind, found in lookup.search_terms_by_kind(k, expansions).items():
            for t in found:
                if keep is None or t.lower() in keep:
                    rows.append((t, kind, country or k, n))
                    n += 1
    return spark.createDataFrame(rows, TERMS)


def found_by(companies: DataFrame, wanted: DataFrame) -> DataFrame:
    """cik, name, ticker and the matches (term, kind, country) of each company found, in the terms' order; seq is the company's place."""
    found = linkage.searched(companies.select("cik", "name", "ticker", "seq"), wanted)
    return found.groupBy("cik", "name", "ticker", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term", "kind", "country"))), lambda m: F.struct(m["term"].alias("term"), m["kind"].alias("kind"), m["country"].alias("country"))).alias("matches"), F.min("ord").alias("ord"))


def targets(found: DataFrame) -> DataFrame:
    """One row for each registrant: the find of the first term, then the first place."""
    return linkage.first_of_each(found)


def union(*parts: DataFrame) -> DataFrame:
    """cik, name, ord of several target tables one after the other; of one registrant the first counts."""
    out = None
    for i, p in enumerate(parts):
        rows = p.select("cik", "name", F.struct(F.lit(i).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("seq").cast("long").alias("seq")).alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("cik").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at"))


def chosen(found: DataFrame, limit: int = 0, done: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """Targets (cik, name, at) in order: the first `limit` (0: all), without those done, only those present in an index."""
    out = found.orderBy("at").limit(limit) if limit else found
    if done is not None:
        out = out.join(done.select("cik"), "cik", "left_anti")
    return out if present is None else out.join(present.select("cik").distinct(), "cik", "left_semi")


def by_nation(found: DataFrame) -> DataFrame:
    """country, n: registrants that terms of a country found."""
    return found.select("cik", F.explode(F.array_distinct(F.transform("matches", lambda m: m["country"]))).alias("country")).groupBy("country").agg(F.count_distinct("cik").alias("n"))


def by_code(sub: DataFrame, codes: Sequence[str] = tuple(tables.ADVERSARIAL_CODES)) -> DataFrame:
    """cik, matched_code (the first of the codes that a field of the registrant has) and matched_fields of it and of later codes."""
    fields = ("countryba", "countryinc", "countryma")
    wanted = F.array(*map(F.lit, codes))
    hits = F.filter(F.array(*[F.struct(F.array_position(wanted, F.col(f)).alias("at"), F.lit(f).alias("field"), F.col(f).alias("code")) for f in fields]), lambda x: x["at"] > 0)
    rows = sub.select("cik", F.explode(hits).alias("h"))
    return rows.groupBy("cik").agg(F.min_by("h.code", "h.at").alias("matched_code"), F.array_sort(F.collect_set("h.field")).alias("matched_fields"))


def expansion_summary(spark: SparkSession, expansions: dict | None = None) -> DataFrame:
    """country, kind, n: search terms of each country."""
    table = tables.expansions() if expansions is None else expansions
    return spark.createDataFrame([(c, k, len(t)) for c, kinds in sorted(table.items()) for k, t in kinds.items() if t], "country string, kind string, n int")
