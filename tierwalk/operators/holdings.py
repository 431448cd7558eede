"""Land holdings: columns by alias, country filter, rollup of entities, coverage."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.functions.text import amount, country_key, county_code

# Names of columns, the first that a table has counts; words of a header; countries.
ALIASES: dict[str, tuple[str, ...]] = {
    "country": ("country", "country of investor", "investor_country", "foreign_country", "country_of_origin", "nation", "investor country", "foreign country"),
    "entity_name": ("owner name 1/", "owner name", "owner name 1", "owner_name", "entity_name", "entity name", "investor_name", "investor name", "name", "owner", "beneficial_owner", "beneficial owner", "foreign person", "foreign_person", "holder", "filer"),
    "state": ("state", "st", "state_code", "us_state", "location_state"),
    "county": ("county", "county_name", "fips_county", "location_county"),
    "fips": ("fips", "fips_code", "fips code", "county_fips", "county fips"),
    "acres": ("number of acres", "number_of_acres", "acres", "acreage", "total_acres", "area_acres", "reported_acres"),
    "owner_id": ("owner id", "owner_id", "ownerid"),
    "parcel_id": ("parcel id", "parcel_id", "parcelid"),
    "country_code": ("country code", "country_code", "countrycode"),
    "owner_type": ("owner type", "owner_type", "ownertype"),
    "type_of_interest": ("type of interest", "type_of_interest", "interest_type", "ownership_type", "interest"),
    "percent_ownership": ("percent of ownership", "percent_of_ownership", "ownership_pct", "pct_ownership", "percent ownership"),
    "acquisition_year": ("acquisition year", "acquisition_year", "acq_year", "year"),
    "current_value": ("current value", "current_value", "value"),
    "citizenship": ("citizenship",),
    "secondary_china": ("secondary interest in china",),
    "secondary_iran": ("secondary interest in iran",),
    "secondary_russia": ("secondary interest in russia",),
    "secondary_nk": ("secondary interest in north korea",),
}
HEADER_WORDS = ("state", "county", "country", "acres", "owner", "fips")
CHINA = ("china", "prc", "people's republic of china", "peoples republic of china", "p.r.c.", "chinese")
HONG_KONG = ("hong kong", "hk", "macau", "macao")
ADVERSARIAL = (
    *CHINA, *HONG_KONG, "russia", "russian federation", "iran", "islamic republic of iran", "north korea", "dprk", "democratic people's republic of korea", "belarus", "myanmar", "burma", "cuba", "venezuela", "syria", "nicaragua",
)
FLAGS = ("secondary_china", "secondary_iran", "secondary_russia", "secondary_nk")


def resolved(headers: Iterable[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, str]:
    """The header of each field that has one; case, blanks and slashes at the end don't count."""
    bare = lambda s: s.strip().lower().rstrip("/").rstrip()
    have = {bare(h): h for h in headers}
    return {f: next(have[bare(a)] for a in names if bare(a) in have) for f, names in aliases.items() if any(bare(a) in have for a in names)}


def named(raw: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """The fields of raw under their own names, '' where a table has no such column, and seq. Without a country or an entity's name it is no such table."""
    found = resolved([c for c in raw.columns if c != "seq"], aliases)
    missing = [f for f in ("country", "entity_name") if f not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(raw.columns)}")
    return raw.select(*[(F.coalesce(F.col(f"`{found[f]}`").cast("string"), F.lit("")) if f in found else F.lit("")).alias(f) for f in aliases], "seq")


def wanted_countries(china_only: bool = True, hong_kong: bool = False, own: Sequence[str] = ()) -> tuple[str, ...]:
    if own:
        return tuple(own)
    return (CHINA + (HONG_KONG if hong_kong else ())) if china_only else ADVERSARIAL


def of_countries(rows: DataFrame, countries: Sequence[str], secondary: bool = True) -> DataFrame:
    """Rows of these countries, and rows with a secondary interest in China if asked."""
    ok: Column = country_key(F.col("country")).isin(*countries)
    return rows.filter(ok | (F.btrim("secondary_china") == "1") if secondary else ok)


def rollup(rows: DataFrame) -> DataFrame:
    """A row for each entity: attributes of its first row, distinct counties and county codes, acres, holdings, or-ed flags."""
    first = ("country", "country_code", "state", "owner_type")
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    filled = rows.withColumn("entity_name", F.btrim("entity_name")).filter("entity_name <> ''")
    per = filled.groupBy("entity_name").agg(
        F.min_by(F.struct(*first), "seq").alias("_f"), distinct(F.nullif("county", F.lit(""))).alias("counties"), distinct(county_code(F.nullif("fips", F.lit("")))).alias("fips_codes"),
        F.round(F.sum(amount(F.col("acres"))), 2).alias("total_acres"), F.count(F.lit(1)).alias("holding_count"), *[F.bool_or(F.btrim(f) == "1").alias(f) for f in FLAGS],
    )
    return per.select("entity_name", "_f.country", "_f.country_code", "_f.state", "counties", "fips_codes", "total_acres", "holding_count", "_f.owner_type", *FLAGS)


def coverage(matched: DataFrame) -> DataFrame:
    """One row over entities with match_type: how many and how much land are matched, and the shares."""
    hit = F.col("match_type") != "none"
    acres = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("total_acres"))), F.lit(0.0))
    per = matched.agg(F.count(F.lit(1)).alias("entities"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"), acres(F.lit(True)).alias("acres"), acres(hit).alias("matched_acres"), acres(~hit).alias("unmatched_acres"))
    share = F.when(F.col("entities") > 0, F.col("matched") / F.col("entities") * 100).otherwise(0.0)
    return per.withColumns({"coverage_pct": share, "gap_pct": 100 - share})


def top_unmatched(matched: DataFrame, most: int = 30) -> DataFrame:
    """The unmatched entities with most land; ties by name."""
    return matched.filter("match_type = 'none'").orderBy(F.desc("total_acres"), "entity_name").limit(most)


FILE_COLUMNS = ("entity_name", "country", "country_code", "state", "counties", "fips_codes", "total_acres", "holding_count", "owner_type", *FLAGS, "cik", "sec_name", "ticker", "match_type", "match_score")


def write(matched: DataFrame, out: str) -> None:
    """Matched and unmatched entities as CSV with all fields quoted, the registrants to look at, and the summary."""
    rows = matched.select(*FILE_COLUMNS)
    for name, part in (("matched", rows.filter("match_type <> 'none'")), ("unmatched", rows.filter("match_type = 'none'"))):
        part.repartitionByRange("entity_name").sortWithinPartitions("entity_name").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{out}/{name}")
    ciks = rows.filter("cik <> ''").groupBy("cik").agg(F.min_by("sec_name", "entity_name").alias("sec_name"))
    ciks.repartitionByRange("cik").sortWithinPartitions("cik").select(F.concat("cik", F.lit("  # "), "sec_name").alias("value")).write.mode("overwrite").text(f"{out}/target_ciks")
    rows.sparkSession.createDataFrame([(summary(matched),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")


def summary(matched: DataFrame) -> str:
    """The coverage summary as text: counts, land, matched entities by land, the largest unmatched ones."""
    c = coverage(matched).first()
    rule = "-" * 70
    lines = ["=" * 70, "HOLDINGS COVERAGE ANALYSIS", "=" * 70, f"Unique entities:     {c['entities']}", f"Total acreage:       {c['acres']:,.1f} acres", rule]
    lines += [f"Matched entities:       {c['matched']:>4} ({c['coverage_pct']:.1f}%)", f"Matched acreage:        {c['matched_acres']:>12,.1f} acres", f"Unmatched entities:     {c['unmatched']:>4} ({c['gap_pct']:.1f}%)", f"Unmatched acreage:      {c['unmatched_acres']:>12,.1f} acres", rule, "TOP UNMATCHED ENTITIES"]
    for u in top_unmatched(matched).collect():  # thirty rows
        flags = [n for n, f in (("SEC_CHINA", "secondary_china"), ("SEC_IRAN", "secondary_iran"), ("SEC_RUSSIA", "secondary_russia")) if u[f]]
        lines.append(f"  {u['entity_name'][:45]:<45}  {u['total_acres']:>10,.1f} ac  {u['state'][:2]:>2}  {u['country'][:15]}" + (f"  [{','.join(flags)}]" if flags else ""))
    return "\n".join(lines)
