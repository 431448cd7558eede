"""Ownership chains of many roots in one job: who is related to whom, edges of all filings met, subsidiaries below, merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.dims import tables
from tierwalk.functions import filing_text, text
from tierwalk.functions.subsidiaries import STATES
from tierwalk.operators import edges, graph, linkage, records, report
from tierwalk.session import stored

#: Codes of incorporation that aren't states; where a code is both, the country counts, as in the data's own use.
COUNTRIES = {c: n for c, n in (tables.ADVERSARIAL_CODES | tables.CONDUIT_CODES).items()} | {"AR": "Argentina", "CO": "Colombia", "IL": "Israel", "SC": "Seychelles", "MT": "Malta", "X0": "United Kingdom", "E9": "Cayman Islands", "D0": "Bermuda", "F4": "China", "K3": "Hong Kong", "U0": "Singapore"}
CODES = STATES | {"MI": "Michigan"} | COUNTRIES


@dataclass
class Chain:
    """Edges (root_cik, seq and edges.COLUMNS, company_name, company_cik), visited (root, node, depth, rank), filings met."""

    edges: DataFrame
    visited: DataFrame
    filings: DataFrame


def related(filings: DataFrame, agents: tuple[str, ...] = tables.FILING_AGENTS) -> DataFrame:
    """Steps (parent, child, ord, is_filer) from registrants to those that their filings (cik, accession, form, content, bundle, place) name.

    Filing agents are left out. A filer is who an accession number begins with, or who an ownership report's bundle heads.
    """
    whole = filing_text.sections(filings.withColumn("raw", F.col("content")))
    ownership = F.col("form").startswith("SC 13") & (F.coalesce("bundle", F.lit("")) != "")
    own = text.related_registrants(F.col("raw"), F.col("full_text"), F.col("accession"), F.col("cik"))
    bundled = F.when(ownership, text.related_registrants(F.col("bundle"), filing_text.plain(filing_text.without_tags(F.col("bundle"))), F.col("accession"), F.col("cik"))).otherwise(F.array().cast("array<string>"))
    rows = stored(whole.select("cik", "place", "accession", ownership.alias("_own"), "bundle", F.array_distinct(F.concat(own, bundled)).alias("names")), "related")
    steps = rows.select(F.col("cik").alias("parent"), "place", F.posexplode("names").alias("i", "child")).groupBy("parent", "child").agg(F.min(F.struct("place", "i")).alias("ord"))
    heads = F.when(F.col("_own"), F.transform(F.regexp_extract_all(F.substring("bundle", 1, 10000), F.lit(r"CENTRAL INDEX KEY:\s*0*(\d{5,10})"), F.lit(1)), lambda x: x.cast("bigint").cast("string"))).otherwise(F.array().cast("array<string>"))
    filers = rows.select(F.col("cik").alias("parent"), F.explode(F.array_compact(F.concat(F.array(text.filer_of(F.col("accession"))), heads))).alias("child")).distinct().withColumn("is_filer", F.lit(True))
    out = steps.join(filers, ["parent", "child"], "left").withColumn("is_filer", F.coalesce("is_filer", F.lit(False)))
    return out.filter(~F.col("child").isin(*agents)) if agents else out


def ascend(filings: DataFrame, roots: DataFrame, max_depth: int = 2, cap: int | None = 100) -> DataFrame:
    """visited (root, node, depth, rank): from every root (cik) to registrants that its filings name; further up only to filers."""
    start = roots.select(text.registrant(F.col("cik")).alias("root")).filter("root <> ''")
    return graph.ranked_walk(related(filings), start, max_depth, cap, deeper="is_filer")[0]


def descend(sub: DataFrame, roots: DataFrame, max_depth: int = 3, cap: int | None = 500, known: tables.Tables = tables.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """visited, and subsidiary edges (root_cik and edges.COLUMNS, seq) from every root (cik) down the submission index.

    A parent's filing is its latest that lists another registrant, the index's first of several, else its best record; a child without records is named by its number.
    """
    steps = records.listed(sub).select(F.col("cik").alias("parent"), F.col("other").alias("child")).distinct().withColumn("ord", F.col("child"))
    visited, found = graph.ranked_walk(steps, roots.select(F.btrim("cik").alias("root")), max_depth, cap)
    info = ("name", "countryba", "countryinc", "stprinc", "sic", "former")
    best = records.best_record(sub)
    about = best.select("cik", F.struct("cik", *info).alias("info"))
    listing = records.listed(sub).groupBy("cik").agg(F.max_by(F.struct(F.col("adsh").alias("accession"), "form", F.col("filed").alias("filing_date")), F.struct(F.col("filed"), -F.col("seq"))).alias("f"))
    rows = found.join(about.select(F.col("cik").alias("parent"), F.col("info").alias("p")), "parent").join(about.select(F.col("cik").alias("child"), F.col("info").alias("c")), "child", "left").join(listing.withColumnRenamed("cik", "parent"), "parent")
    unknown = F.struct(F.col("child").alias("cik"), F.concat(F.lit("CIK "), "child").alias("name"), *[F.lit("").alias(c) for c in info[1:]])
    pairs = rows.select(F.col("p").alias("parent"), F.coalesce("c", unknown).alias("child"), "f.*", "depth", F.col("root").alias("root_cik"), F.struct(F.lit(3).alias("part"), "rank", F.col("ord").cast("string").alias("a"), F.lit("").alias("b")).alias("seq"))
    return visited, edges.subsidiary_edges(pairs, keep=("root_cik", "seq"), known=known)


def run(filings: DataFrame, companies: DataFrame, roots: DataFrame, max_depth: int = 2, cap: int = 100, sub: DataFrame | None = None, descension_depth: int = 3, issuer_names: dict[str, str] | None = None, issuer_country: str | None = None, known: tables.Tables = tables.DEFAULT) -> Chain:
    """The chains of all roots (cik).

    filings: cik, accession, form, filing_date, content, bundle, place (in a registrant's list), company; companies: cik, name, state,
    sic, sic_description. With a submission index (sub) every visited registrant is descended from, and institutions that the index
    knows by exactly their name are too. Edges are merged for each root by itself, in the order: incorporation, filings, subsidiaries.
    """
    met = stored(ascend(filings, roots, max_depth, cap), "visited")
    # texts of the registrants met are parsed and searched once, however many roots meet them; only what is found meets the roots
    nodes = met.select(F.col("node").alias("cik")).distinct()
    parts = stored(filing_text.sections(filings.join(nodes, "cik")).select("cik", "place", "company", "accession", "form", "filing_date", *report.TEXTS), "sections")
    found = stored(report.extracts(parts, known), "extracts")
    mine = found.join(met.select(F.col("root").alias("root_cik"), F.col("node").alias("cik"), "depth", "rank"), "cik")
    own = F.lit(None).cast("string")
    for cik, name in (issuer_names or {}).items():
        own = F.when(F.col("root_cik") == cik, name).otherwise(own)
    issuer = F.coalesce(*[text.blank_to_null(c) for c in (own, F.col("company"), F.col("_name"))], F.col("cik"))
    named = mine.join(companies.select("cik", F.col("name").alias("_name")), "cik", "left").withColumns({"issuer": issuer, "issuer_country": F.lit(issuer_country).cast("string"), "key": F.struct("root_cik", "rank", "place", "cik")})
    told = report.edges_from(named, known)
    order = lambda part, rank, a, b: F.struct(F.lit(part).alias("part"), rank.cast("long").alias("rank"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    wide = lambda c: F.lpad(c.cast("string"), 10, "0")
    told = told.withColumns({"root_cik": F.col("seq.key.root_cik"), "seq": order(2, F.col("seq.key.rank"), wide(F.col("seq.key.place")), F.concat(wide(F.col("seq.kind")), wide(F.col("seq.ord"))))})
    homes = companies.join(met.select(F.col("root").alias("root_cik"), F.col("node").alias("cik"), "rank"), "cik").withColumn("seq", order(1, F.col("rank"), F.col("cik"), F.lit("")))
    every = edges.incorporation_edges(homes, CODES, keep=("root_cik", "seq"), known=known).unionByName(told)
    if sub is not None:
        starts = met.select(F.col("root").alias("root_cik"), F.col("node").alias("cik"))
        bodies = told.filter("relationship = 'institution_role'").select("root_cik", F.col("source").alias("name")).distinct()
        starts = starts.unionByName(linkage.unique_in_index(bodies, sub).filter("matched_cik is not null").select("root_cik", F.col("matched_cik").alias("cik")))
        _, below = descend(sub, starts.select("cik").distinct(), descension_depth, known=known)
        every = every.unionByName(below.withColumnRenamed("root_cik", "cik").join(starts, "cik").drop("cik"))
    merged = edges.merged(every, ("root_cik", *edges.KEY))
    return Chain(stored(edges.company(merged), "edges"), met, parts)
