"""Column functions over names, codes and fields of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of ASCII fields.
BLANKS = " \t\n\r\x0b\x0c"
# Company suffixes of the linkage, tried once each in this order.
SUFFIXES = (
    ", LLC", " LLC", ", LP", " LP", ", INC", " INC", ", INC.", " INC.", ", CORP", " CORP", ", CORP.", " CORP.", ", LTD", " LTD", ", LTD.", " LTD.", ", CO.", " CO.", " CO", ", L.P.", " L.P.", ", L.L.C.", " L.L.C.",
)


def let(value: Column, then) -> Column:
    """then(value), with value worked out once for a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at the ends; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sanitized(c: Column) -> Column:
    """A field of a pipe-delimited file: null is empty, other than printable ASCII is a space, | is /, double quotes are single."""
    return F.btrim(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x20-\x7E]", " "), '|"', "/'"))


def flag(c: Column) -> Column:
    return F.when(c, "Y").otherwise("")


def registrant(c: Column) -> Column:
    """A registrant number without leading zeros; '' where it isn't a number."""
    return F.coalesce(stripped(c).try_cast("bigint").cast("string"), F.lit(""))


def filer_of(accession: Column) -> Column:
    """The registrant number that an accession number begins with; null where it has another form."""
    form = r"^0*(\d{5,10})-\d{2}-\d{6}$"
    return F.when(accession.rlike(form), F.regexp_extract(accession, form, 1).try_cast("bigint").cast("string"))


def _named(c: Column) -> Column:
    """Registrant numbers after CIK, with : or #, as often as they stand there."""
    named = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)\bCIK\s*[:#]?\s*0*([0-9]{3,10})\b"), F.lit(1))
    return F.transform(named, lambda x: x.cast("bigint").cast("string"))


def registrants_in(c: Column) -> Column:
    """Distinct registrant numbers that a text names: after CIK, with : or #, first; then in addresses of documents."""
    linked = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)/CIK0*([0-9]{5,10})\.json"), F.lit(1))
    return F.array_distinct(F.concat(_named(c), F.transform(linked, lambda x: x.cast("bigint").cast("string"))))


def related_registrants(content: Column, text: Column, accession: Column, own: Column, distinct: bool = True) -> Column:
    """Registrants that a filing names, in order: in its header, in its text, then the filer; without its own.

    Without distinct a number stands there as often as it is named. Numbers in addresses also follow the word CIK, so those
    after it are all of a text.
    """
    header = F.regexp_extract_all(F.substring(F.coalesce(content, F.lit("")), 1, 10000), F.lit(r"CENTRAL INDEX KEY:\s*0*(\d{5,10})"), F.lit(1))
    header = F.transform(header, lambda x: x.cast("bigint").cast("string"))
    body = F.when(text != "", text).otherwise(content)
    every = F.concat(header, registrants_in(body) if distinct else _named(body), F.array_compact(F.array(filer_of(accession))))
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(every) if distinct else every, lambda x: x != F.coalesce(own, F.lit(""))))


def number_tokens(c: Column, least: int, most: int) -> Column:
    """Distinct digit runs of a text, in order of appearance, without leading zeros."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"\b(\d{{{least},{most}}})\b"), F.lit(1))
    return F.array_distinct(F.transform(runs, lambda x: x.cast("bigint").cast("string")))


def bare_name(c: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """A name for exact linkage: upper case, and each suffix that is at the end when its turn comes is taken off, once."""
    name = stripped(F.upper(c))
    ends = F.array(*map(F.lit, suffixes))
    return stripped(F.aggregate(ends, name, lambda n, s: F.when(F.endswith(n, s), F.left(n, F.length(n) - F.length(s))).otherwise(n)))


def one_spaced(c: Column) -> Column:
    """Runs of white space are one space; none at the ends; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def county_code(c: Column) -> Column:
    """The part before a point, with zeros in front up to five digits; longer codes stay."""
    code = F.split_part(c, F.lit("."), F.lit(1))
    return F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code)


def country_key(c: Column) -> Column:
    """A country's name for comparison: lower case, without points."""
    return F.replace(F.lower(stripped(F.coalesce(c, F.lit("")))), F.lit("."), F.lit(""))


def amount(c: Column) -> Column:
    """A number with whatever else is in the field left out; 0 where none is left or it is no number."""
    return F.coalesce(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.]", "").try_cast("double"), F.lit(0.0))
