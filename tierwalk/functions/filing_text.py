"""Sections of a filing: markup off, characters and blanks put in order, signature block, narrative, countries."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.functions.text import let, stripped

# What ends a signature block, what begins a narrative, and the country names looked for.
SIGNATURE_ENDS = ("POWER OF ATTORNEY", "EXHIBIT", "INDEX TO EXHIBITS", "TABLE OF CONTENTS")
NARRATIVE_HEADINGS = ("DIRECTORS AND EXECUTIVE OFFICERS", "BOARD OF DIRECTORS", "MANAGEMENT", "EXECUTIVE OFFICERS", "CORPORATE GOVERNANCE")
NARRATIVE_LENGTH = 20000
COUNTRIES = (
    "United States", "U.S.", "USA", "China", "People's Republic of China", "PRC", "Hong Kong", "Taiwan", "Japan", "Korea", "India", "Canada", "Mexico", "Brazil",
    "Germany", "France", "United Kingdom", "UK", "Russia", "Singapore", "United Arab Emirates", "UAE", "Saudi Arabia", "Australia", "New Zealand",
)


def unescaped(c: Column) -> Column:
    """Entities as characters; the only step here that needs Python. What comes before it is worked out once."""

    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        return pa.array((None if x is None else html.unescape(x) for x in (v.as_py() for v in s)), pa.string())

    return run(c)


def without_tags(c: Column) -> Column:
    """Line breaks for br and for tags that begin with p; no other tags. Null is empty."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<\s*br\s*/?\s*>", "\n"), r"(?i)<\s*/?\s*p[^>]*>", "\n")
    return F.regexp_replace(lines, r"<[^>]+>", "")


def plain(c: Column) -> Column:
    """Lines end in \\n, other than printable ASCII is a space, runs of blanks are one, at most one empty line in a row."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"[^\x09\x0A\x20-\x7E]", " ")
    return stripped(F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"))


def _earliest(upper: Column, words: tuple[str, ...]) -> Column:
    """Place (from 1) of whichever word comes first; null without any."""
    return F.least(*[F.nullif(F.instr(upper, F.lit(w)), F.lit(0)) for w in words])


def signature_block(text: Column) -> Column:
    """What follows the first line that only says SIGNATURE or SIGNATURES, up to the first ending; '' without one."""

    def cut(tail: Column) -> Column:
        return let(let(F.upper(tail), lambda u: _earliest(u, SIGNATURE_ENDS)), lambda end: F.when(end.isNull(), tail).otherwise(F.left(tail, end - 1)))

    return F.coalesce(stripped(let(F.get(F.split(text, r"(?imd)^\s*SIGNATURES?\s*$", 2), F.lit(1)), cut)), F.lit(""))


def narrative(text: Column) -> Column:
    """NARRATIVE_LENGTH characters from the first heading on; '' without one."""
    start = let(F.upper(text), lambda u: _earliest(u, NARRATIVE_HEADINGS))
    return F.coalesce(stripped(F.substr(text, start, F.lit(NARRATIVE_LENGTH))), F.lit(""))


def countries(text: Column, names: tuple[str, ...] = COUNTRIES) -> Column:
    """The names that a text holds in any case, as substrings, in the order of the list."""
    every = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n.upper()).alias("upper")) for n in names])
    return let(F.upper(F.coalesce(text, F.lit(""))), lambda u: F.transform(F.filter(every, lambda n: F.contains(u, n["upper"])), lambda n: n["name"]))


def sections(filings: DataFrame, content: str = "content") -> DataFrame:
    """filings with full_text, signatures, narrative and countries (an array) in the place of the content."""
    bare = filings.withColumn("full_text", without_tags(F.col(content)))
    t = F.col("full_text")
    # only texts with entities go to Python
    whole = bare.withColumn("full_text", plain(F.coalesce(unescaped(F.when(F.contains(t, F.lit("&")), t)), t)))
    return whole.withColumns({"signatures": signature_block(t), "narrative": narrative(t), "countries": countries(t)}).drop(content)
