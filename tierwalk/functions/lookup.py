"""First matches of names in ordered tables: jurisdictions with tiers, state affiliations, roles (one automaton for each table), sectors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierwalk.dims import tables
from tierwalk.functions import dictionary
from tierwalk.functions.text import blank_to_null, let


def any_of(tokens: Sequence[str]) -> str:
    return "|".join(map(re.escape, tokens))


def jurisdiction(name: Column, override: Column | None = None, context: Column | None = None, table: Sequence[tables.Jurisdiction] | None = None) -> Column:
    """country, tier and matched token: the override with its own tier, else the first country in the table with a token anywhere in the name, else in the context.

    Tokens count in any case and inside words; of a country's tokens the one counts that comes first in the text. Null where
    nothing matches or the name is missing.
    """
    table = tables.jurisdictions() if table is None else table
    kind = "struct<country: string, tier: string, token: string>"
    every = [(n, t) for n, j in enumerate(table) for t in j.tokens]
    matcher, entries = dictionary.Matcher([t.lower() for _, t in every]), [n for n, _ in every]
    known = [(j.country, j.tier) for j in table]

    def one(name, *context):
        for t in (name, *context) if name else ():
            low = (t or "").lower()
            hit = dictionary.first_entry(entries, matcher.first(low))
            if hit:
                entry, token, at = hit
                n = len(every[token][1])
                return (*known[entry], t[at : at + n] if len(low) == len(t) else every[token][1])
        return None

    found = dictionary.struct_udf(one, kind)(name, *([context] if context is not None else []))
    found = F.when(found["country"].isNotNull(), found)
    if override is None:
        return found
    given = blank_to_null(override)
    return F.when(given.isNotNull(), F.struct(given.alias("country"), tier_of(given, table).alias("tier"), F.lit(None).cast("string").alias("token")).cast(kind)).otherwise(found)


def tier_of(country: Column, table: Sequence[tables.Jurisdiction] | None = None) -> Column:
    """The tier of a country's name; MONITORED for any other."""
    table = tables.jurisdictions() if table is None else table
    known = F.create_map(*[F.lit(x) for j in table for x in (j.country, j.tier)])
    return F.coalesce(F.try_element_at(known, country), F.lit("MONITORED"))


def affiliation(name: Column, country: Column | None = None, table: Sequence[tables.Affiliation] = tables.AFFILIATIONS) -> Column:
    """category, sub, detail, confidence of the first entry whose keywords a name holds, among those open for the issuer's country; category "None" without one.

    An entry's detail may name its first keyword, in the list's order, that the name holds.
    """
    every = [(n, k) for n, a in enumerate(table) for k in a.keywords]
    matcher = dictionary.Matcher([k for _, k in every])
    entries = tuple(table)

    def one(name, country):
        found: dict[int, int] = {}
        for i in matcher.first((name or "").lower()):
            n = every[i][0]
            if not entries[n].gate or country is None or country in entries[n].gate:
                found[n] = min(i, found.get(n, i))
        if not found:
            return "None", None, None, 0.0
        a, keyword = entries[min(found)], every[found[min(found)]][1]
        return a.category, a.sub, a.detail.replace("{}", keyword, 1), a.confidence

    country = F.lit(None).cast("string") if country is None else country
    return dictionary.struct_udf(one, "struct<category: string, sub: string, detail: string, confidence: double>")(name, country)


#: Characters before and after the start of a name that its role is looked for in.
AROUND = 200


def around(name: Column, context: Column, low: Column | None = None) -> Column:
    """What stands around the name's first occurrence in the context in any case, the whole context without one; null where either is empty. low: the context in lower case, if it is at hand."""
    ctx = F.coalesce(context, F.lit(""))
    low = F.lower(ctx) if low is None else low

    def window(at: Column) -> Column:
        start = F.greatest(F.lit(1), at - AROUND)
        return F.when(at > 0, F.substr(ctx, start, at + AROUND - start)).otherwise(ctx)

    return F.when((F.coalesce(name, F.lit("")) != "") & (ctx != ""), let(F.instr(low, F.lower(name)), window))


def role(name: Column, context: Column, table: Sequence[tuple[str, tuple[str, ...]]] | None = None) -> Column:
    """role, confidence and the flags executive, board, supervisory, ownership, obscuring: the first role with a phrase, as whole words, around the name's first occurrence.

    Without an occurrence the whole context counts. "officer" and "director" as parts of words are weak roles; then Unknown.
    """
    return role_in(around(name, context), table)


def role_in(window: Column, table: Sequence[tuple[str, tuple[str, ...]]] | None = None) -> Column:
    """`role` of what stands around a name; Unknown where it is null."""
    table = tables.roles() if table is None else table
    every = [(n, w.lower()) for n, (_, words) in enumerate(table) for w in words]
    matcher, entries, names = dictionary.Matcher([w for _, w in every]), [n for n, _ in every], [r for r, _ in table]

    def one(window):
        low = (window or "").lower()
        hit = dictionary.first_entry(entries, matcher.first(low, words=True))
        return None if hit is None else names[hit[0]], "Officer" if "officer" in low else "Director" if "director" in low else None

    # both come out of one walk, so that the context goes no further than the walk
    label = dictionary.struct_udf(one, "struct<strong: string, weak: string>")(window)
    strong, weak = label["strong"], label["weak"]
    is_in = lambda roles: F.coalesce(strong.isin(*roles), F.lit(False))
    lone = strong.isNull() & weak.isNotNull()
    return F.struct(
        F.coalesce(strong, weak, F.lit("Unknown")).alias("role"), F.when(strong.isNotNull(), 0.9).when(weak.isNotNull(), 0.5).otherwise(0.0).alias("confidence"),
        (is_in(tables.EXECUTIVE_ROLES) | (lone & (weak == "Officer"))).alias("executive"), (is_in(tables.BOARD_ROLES) | (lone & (weak == "Director"))).alias("board"),
        is_in(tables.SUPERVISORY_ROLES).alias("supervisory"), is_in(tables.OWNERSHIP_ROLES).alias("ownership"), is_in(tables.OBSCURING_ROLES).alias("obscuring"),
    )


def sectors(code: Column, table: dict[str, tuple[tuple[int, int], ...]] = tables.SECTORS) -> Column:
    """Sectors of an industry code, in the table's order; none where it is no number."""
    n = F.btrim(code.cast("string")).try_cast("int")

    def inside(ranges):
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | n.between(lo, hi)
        return hit

    return F.array_compact(F.array(*[F.when(inside(r), F.lit(s)) for s, r in table.items()]))


def canonical(keyword: str, expansions: dict | None = None) -> str | None:
    """The country that a search word stands for; None for any other word."""
    k = keyword.strip().lower()
    return k if k in (tables.expansions() if expansions is None else expansions) else tables.ALIASES.get(k)


def search_terms(keyword: str, least: int = 4, expansions: dict | None = None) -> list[str]:
    """Terms of a country's word, by kind, each once in any case, of `least` characters or more; another word stays as it is."""
    table = tables.expansions() if expansions is None else expansions
    country = canonical(keyword, table)
    if country not in table:
        return [keyword]
    terms = {}
    for kind in tables.TERM_KINDS:
        for t in table[country].get(kind, ()):
            terms.setdefault(t.lower(), t)
    return [t for t in terms.values() if len(t) >= least]


def search_terms_by_kind(keyword: str, expansions: dict | None = None) -> dict[str, list[str]]:
    """All terms of a country's word by kind, short ones too."""
    table = tables.expansions() if expansions is None else expansions
    country = canonical(keyword, table)
    return {k: list(table[country][k]) for k in tables.TERM_KINDS if table[country].get(k)} if country in table else {"raw_keyword": [keyword]}
