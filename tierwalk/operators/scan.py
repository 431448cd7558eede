"""Scan of a submission index for country codes, and what follows from it: counts, cross table, go-betweens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.dims import tables

FIELDS = ("countryba", "countryinc", "countryma")


def _codes(conduit: bool) -> dict[str, str]:
    return tables.ADVERSARIAL_CODES | (tables.CONDUIT_CODES if conduit else {})


def country_scan(sub: DataFrame, conduit: bool = False) -> DataFrame:
    """A row for each registrant with a wanted code in any field of any filing: its latest row's attributes, matched_fields, matched_codes, tier, forms, filing_dates.

    Arrays are sorted and distinct. A registrant is CONDUIT only where none of its codes is ADVERSARIAL.
    """
    wanted = F.array(*map(F.lit, _codes(conduit)))
    sets = {f: F.collect_set(F.nullif(F.col(f), F.lit(""))).alias(f"_{f}") for f in FIELDS}
    best = F.max_by(F.struct("name", "sic", *FIELDS, "former"), F.struct(F.col("filed"), -F.col("seq"))).alias("_r")
    per = sub.groupBy("cik").agg(best, *sets.values(), F.array_sort(F.collect_set(F.nullif(F.col("form"), F.lit("")))).alias("forms"), F.array_sort(F.collect_set(F.nullif(F.col("filed"), F.lit("")))).alias("filing_dates"))
    hits = {f: F.array_intersect(F.col(f"_{f}"), wanted) for f in FIELDS}
    out = per.select(
        "cik", "_r.*", F.array_compact(F.array(*[F.when(F.size(h) > 0, F.lit(f)) for f, h in hits.items()])).alias("matched_fields"),
        F.array_sort(F.array_distinct(F.concat(*hits.values()))).alias("matched_codes"), "forms", "filing_dates",
    ).filter(F.size("matched_codes") > 0)
    worst = F.arrays_overlap("matched_codes", F.array(*map(F.lit, tables.ADVERSARIAL_CODES)))
    return out.withColumn("tier", F.when(worst, "ADVERSARIAL").otherwise("CONDUIT"))


def counts_by(found: DataFrame, column: str, name: str) -> DataFrame:
    """Registrants for each code (matched_codes) or field (matched_fields)."""
    return found.select(F.explode(column).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def cross_table(found: DataFrame) -> DataFrame:
    """code, and the registrants of each field: a registrant's fields count under every code it matched."""
    rows = found.select(F.explode("matched_codes").alias("code"), "matched_fields")
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("matched_fields", f)).alias(f"n_{f}") for f in FIELDS])


def go_betweens(found: DataFrame, conduit: bool = False) -> DataFrame:
    """Rows whose latest filing has a wanted country beside another, with a description (of all wanted codes)."""
    own = F.array_distinct(F.array_remove(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in FIELDS]), ""))
    rows = found.withColumn("_own", own)
    wanted = F.array(*map(F.lit, _codes(conduit)))
    rows = rows.filter((F.size(F.array_intersect("_own", wanted)) > 0) & (F.size(F.array_except("_own", wanted)) > 0))
    every = _codes(True)
    codes = F.array(*map(F.lit, every))
    names = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])
    flagged = F.array_join(F.transform(F.array_sort(F.array_intersect("_own", codes)), lambda c: F.element_at(names, c)), ",")
    clean = F.array_join(F.array_sort(F.array_except("_own", codes)), ",")
    has = lambda f: F.coalesce(F.col(f), F.lit("")).isin(*every)
    ba, inc, ma = map(has, FIELDS)
    text = (
        F.when(inc & ~ba, F.concat(F.lit("inc:"), flagged, F.lit(" but operates in "), clean)).when(ba & ~inc, F.concat(F.lit("based in "), flagged, F.lit(" but inc:"), clean))
        .when(ma & ~ba, F.concat(F.lit("mail:"), flagged, F.lit(" but based in "), clean)).otherwise(F.concat(F.lit("mixed: "), flagged, F.lit(" + "), clean))
    )
    return rows.withColumn("pattern", F.when((flagged != "") & (clean != ""), text).otherwise("")).drop("_own")


def moved_abroad(sub: DataFrame) -> Column:
    """Whether business and incorporation are in different countries, both known."""
    return (F.col("countryba") != F.col("countryinc")) & (F.col("countryba") != "") & (F.col("countryinc") != "")
