"""Records of a submission index: filters, one row per key, statistics, co-registrants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.functions.text import stripped

# The forms that describe a registrant best.
PREFERRED_FORMS = ("10-K", "20-F", "10-K/A")


def by_cik(sub: DataFrame, cik: str) -> DataFrame:
    return sub.filter(F.col("cik") == cik.strip())


def by_country(sub: DataFrame, code: str, field: str = "countryba") -> DataFrame:
    """Rows with this country in a field: countryba (business), countryinc (incorporation) or countryma (mailing)."""
    return sub.filter(F.col(field) == code.upper())


def by_industry(sub: DataFrame, code: str, prefix: bool = False) -> DataFrame:
    return sub.filter(F.col("sic").startswith(code) if prefix else F.col("sic") == code)


def by_form(sub: DataFrame, form: str) -> DataFrame:
    return sub.filter(F.upper("form") == form.upper())


def first_per_key(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The row that comes first in order `seq`; an aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("_r"))
    return picked.select(*keys, "_r.*")


def best_per_key(df: DataFrame, keys: list[str], preferred: Column, latest: str, seq: str) -> DataFrame:
    """The row of a preferred form, then the latest, then the first in order."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(preferred.cast("int"), F.col(latest), -F.col(seq))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def best_record(sub: DataFrame) -> DataFrame:
    """The one row of every registrant that describes it best."""
    return best_per_key(sub, ["cik"], F.col("form").isin(*PREFERRED_FORMS), "filed", "seq")


def listed(sub: DataFrame, column: str = "aciks") -> DataFrame:
    """cik, other, adsh, form, filed, seq: a row for each other registrant that a filing lists."""
    other = F.explode(F.array_distinct(F.split(stripped(F.col(column)), r"\s+")))
    return sub.select("cik", other.alias("other"), "adsh", "form", "filed", "seq").filter("other <> '' and other <> cik")


def co_registrants(sub: DataFrame, column: str = "aciks") -> DataFrame:
    """cik, others: the registrants listed in a registrant's own filings, without itself, in the order of strings."""
    pairs = listed(sub, column).select("cik", "other").distinct()
    return pairs.groupBy("cik").agg(F.array_sort(F.collect_list("other")).alias("others"))


def stats(sub: DataFrame) -> DataFrame:
    """One row: rows, registrants, periods, and distinct countries, industries and forms, blanks left out."""
    some = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return sub.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("cik").alias("unique_ciks"), some("source_period").alias("periods_loaded"), some("countryba").alias("countries_ba"), some("countryinc").alias("countries_inc"),
        some("sic").alias("unique_sics"), some("form").alias("unique_forms"),
    )


def ciks(sub: DataFrame) -> DataFrame:
    return sub.select("cik").distinct()
