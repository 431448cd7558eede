"""From filings to edges, and from edges to summaries and reports. Aggregates are DataFrames; only small ones are rendered on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.dims import tables
from tierwalk.functions import lookup, names, owners
from tierwalk.functions.text import blank_to_null, let
from tierwalk.operators import edges, graph
from tierwalk.operators.order import numbered

SIGNS = {"CRITICAL": "\U0001f534", "HIGH": "\U0001f7e0", "ELEVATED": "\U0001f7e1", "MODERATE": "\U0001f535", "LOW": "\U0001f7e2", "UNKNOWN": "⚪"}


#: Columns of a filing that are read for extracts and not kept with them.
TEXTS = ("full_text", "signatures", "narrative", "countries")


def extracts(filings: DataFrame, known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """Everything that filings (form, the columns of sections, and any others, which are kept) tell of people, institutions, owners and countries.

    kind and ord keep their order in a filing: 0 people who sign, 1 people of the narrative (not compared with those), both with a
    role; 2 institutions; 3 owners of ownership reports, with percent, class_title, owner_notes; 4 countries. Nothing of it depends on
    who asks, so a filing that many roots meet is read once.
    """
    return _named(filings, known).unionByName(_held(filings), allowMissingColumns=True)


def _base(filings: DataFrame) -> list[str]:
    return [c for c in filings.columns if c not in TEXTS]


def _named(filings: DataFrame, known: tables.Tables) -> DataFrame:
    """Extracts of every kind but owners; all texts go to the extractors once, side by side."""
    base = _base(filings)
    read = filings.select(*base, "full_text", names.signers(F.concat_ws("\n", "signatures", "full_text")).alias("_0"), names.people_in(F.col("narrative")).alias("_1"), names.institutions_in(F.col("narrative")).alias("_2"), F.col("countries").alias("_4"))
    none = F.array().cast("array<struct<kind: int, ord: int, name: string, _around: string>>")
    # what stands around people is cut out while the text is in one place, so that rows of names don't each carry it
    around = lambda k, x, low: lookup.around(x, F.col("full_text"), low) if k < 2 else F.lit(None).cast("string")
    of_kind = lambda k, low: F.coalesce(F.transform(f"_{k}", lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("ord"), x.alias("name"), around(k, x, low).alias("_around"))), none)
    every = let(F.lower(F.coalesce("full_text", F.lit(""))), lambda low: F.concat(*[of_kind(k, low) for k in (0, 1, 2, 4)]))
    out = read.select(*base, F.explode(every).alias("_f")).select(*base, "_f.*")
    return out.withColumn("role", F.when(F.col("kind") < 2, lookup.role_in(F.col("_around"), known.roles))).drop("_around")


def _held(filings: DataFrame) -> DataFrame:
    """Extracts of owners."""
    return owners.owners(filings.filter(F.upper("form").isin(*owners.FORMS)).select(*_base(filings), "full_text")).drop("full_text").withColumnRenamed("owner", "name").withColumn("kind", F.lit(3))


def edges_from(found: DataFrame, known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """Edges from extracts with key, issuer, issuer_country and depth, in order by seq (key, kind, ord)."""
    return _edges(found.filter("kind <> 3"), found.filter("kind = 3"), known)


def _edges(named: DataFrame, held: DataFrame, known: tables.Tables) -> DataFrame:
    seq = F.struct("key", "kind", "ord")
    return edges.named_edges(named.withColumn("seq", seq), known=known).unionByName(edges.owner_edges(held.withColumn("seq", seq).withColumnRenamed("name", "owner"), known=known))


def filing_edges(filings: DataFrame, known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """All edges of filings (key, cik, issuer, issuer_country, accession, form, filing_date, depth and the columns of sections), in order by seq."""
    # each kind's extracts are worked out in one branch, not once for the filter of each
    return _edges(_named(filings, known), _held(filings), known)


def counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows for each value of a column."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """Values by falling count, of equal counts the first met (seq) first."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("_s")).orderBy(F.desc("n"), "_s").drop("_s")


def tier_counts(rows: DataFrame) -> DataFrame:
    """tier, n over both ends of every edge."""
    tier = F.explode(F.array("source_risk_tier", "target_risk_tier"))
    return rows.select(tier.alias("tier")).filter("tier <> ''").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def first_per_name(rows: DataFrame, relationship: str) -> DataFrame:
    """The first edge of every source in a relationship."""
    mine = rows.filter(F.col("relationship") == relationship)
    rest = [c for c in mine.columns if c != "source"]
    return mine.groupBy("source").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("_r")).select("source", "_r.*")


def analysis(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each group: edges, distinct sources, targets and entities, companies, first and last date, the largest depth (what is no number doesn't count)."""
    some = lambda c: blank_to_null(F.col(c))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_edges"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"), F.size(F.array_union(F.collect_set("source"), F.collect_set("target"))).cast("long").alias("n_entities") if by else F.count_distinct("source").alias("_"),
        F.array_sort(F.collect_set(some("company_name"))).alias("companies"), F.array_sort(F.collect_set(some("company_cik"))).alias("ciks"), F.min(some("filing_date")).alias("first_date"), F.max(some("filing_date")).alias("last_date"),
        F.greatest(F.lit(0), F.max(F.col("chain_depth").cast("string").try_cast("int"))).alias("max_depth"),
    )


def depth_gap(max_depth: int, n_jurisdictions: int, chain_length: int) -> tuple[int, int]:
    """Effective depth of a chain, and by how much it passes three."""
    depth = max(max_depth, n_jurisdictions, chain_length)
    return depth, max(0, depth - 3)


def tree(rows: DataFrame, root: str, most: int = 20) -> tuple[list[str], int]:
    """Lines of the ownership tree around a root, and the chain's length: owners above, the root, subsidiaries below."""
    start = rows.sparkSession.createDataFrame([(root,)], "node string")
    found = graph.levels(rows, start, most).collect()  # the entities of one chain
    above = sorted(((r["level"], r["node"]) for r in found if r["side"] == "above"), reverse=True)
    below = sorted((r["level"], r["node"]) for r in found if r["side"] == "below")
    up, down = max((x for x, _ in above), default=0), max((x for x, _ in below), default=0)
    lines = [f"{'  ' * (up - level)}{name}" for level, name in above]
    lines += [f"{'  ' * up}* {root}"] + [f"{'  ' * (up + level)}|-- {name}" for level, name in below]
    return lines, up + 1 + down


def executive_summary(rows: DataFrame, root_cik: str = "", lines_of_tree: int = 15) -> str:
    """A page of Markdown about the edges of one root: rating with reasons, chain, exposure, affiliations, people."""
    rated = edges.ratings(rows).first()
    told = analysis(rows).first()
    title = next((r["company_name"] for r in rows.filter(F.col("company_cik") == root_cik).filter("company_name <> ''").select("company_name").limit(1).collect()), (told["companies"] or ["Unknown Entity"])[0])
    entities = rows.select("source").union(rows.select("target")).distinct().count()
    out = [f"# Executive Summary: {title}", "", f"## {SIGNS[rated['rating']]} Risk Rating: **{rated['rating']}** (score: {rated['score']}/100)", "", "| | |", "|---|---|", f"| **Entity** | {title} |"]
    out += [f"| **CIK** | {root_cik} |"] if root_cik else []
    out += [f"| **Critical Sector** | {', '.join(rated['sectors'])} |"] if rated["sectors"] else []
    out += [f"| **Edges Analyzed** | {told['total_edges']} |", f"| **Entities Discovered** | {entities} |", f"| **BFS Depth Reached** | {told['max_depth']} |", ""]
    if rated["reasons"]:
        out += ["## Risk Factors", "", *[f"- {r}" for r in rated["reasons"]], ""]
    root = graph.root_name(rows).first()["root"]
    if root:
        lines, length = tree(rows, root)
        out += ["## Ownership Chain", "", f"**{length}-tier chain**", "", "```", *lines[:lines_of_tree], *([f"  ... ({len(lines) - lines_of_tree} more lines)"] if len(lines) > lines_of_tree else []), "```", ""]
    exposed = [(t, rated[t]) for t in ("adversarial", "conduit", "opacity") if rated[t]]
    if exposed:
        out += ["## Jurisdictional Exposure", "", *[f"- **{t.title()}:** {', '.join(j)}" for t, j in exposed], ""]
    held = rows.filter("state_affiliation <> ''").groupBy("source", "state_affiliation").agg(F.min("seq").alias("s"), F.first("state_affiliation_sub").alias("sub")).orderBy("s").limit(50).collect()
    if held:
        out += ["## State-Actor Affiliations", "", *[f"- **{r['state_affiliation']}{' (' + r['sub'] + ')' if r['sub'] else ''}:** {r['source']}" for r in held], ""]
    people = first_per_name(rows, "person_role").orderBy("seq")
    lead, board = people.filter("role_is_executive").limit(8).collect(), people.filter("role_is_board and not role_is_executive").limit(8).collect()
    if lead or board:
        out += ["## Key Personnel", ""]
        out += ["**Executives:** " + "; ".join(f"{r['source']} ({r['detail']})" for r in lead), ""] if lead else []
        out += ["**Board:** " + "; ".join(r["source"] for r in board), ""] if board else []
    if rated["sectors"] and rated["adversarial"]:
        out += [f"> **⚠ SUPPLY CHAIN ALERT:** {title} operates in **{', '.join(rated['sectors'])}** with ownership exposure to **{', '.join(rated['adversarial'])}**.", ""]
    return "\n".join(out)


def detailed_report(rows: DataFrame, root_cik: str = "") -> str:
    """The executive summary, followed by counts of relationships, forms and tiers, and tables of owners, people and institutions."""
    out = [executive_summary(rows, root_cik, 10**6)]
    for title, table, column in (("Relationships", most_common(rows, "relationship"), "relationship"), ("Filing Forms", most_common(rows.filter("filing_form <> ''"), "filing_form"), "filing_form"), ("Risk Tiers", tier_counts(rows).orderBy(F.desc("n"), "tier"), "tier")):
        out += [f"## {title}", "", "| | Count |", "|---|---|", *[f"| {r[column]} | {r['n']} |" for r in table.collect()], ""]
    told, lists = analysis(rows).first(), (("Beneficial Owners", "beneficial_owner"), ("People", "person_role"), ("Institutions", "institution_role"))
    for title, relationship in lists:
        found = first_per_name(rows, relationship).orderBy("seq").limit(200).collect()
        if found:
            out += [f"## {title}", "", "| Name | Detail | Jurisdiction | Tier | Affiliation |", "|---|---|---|---|---|", *[f"| {r['source']} | {r['detail'] or ''} | {r['source_jurisdiction'] or ''} | {r['source_risk_tier'] or ''} | {r['state_affiliation'] or ''} |" for r in found], ""]
    n = edges.summary(rows).first()
    depth, gap = depth_gap(told["max_depth"], len(n["unique_jurisdictions"]), 0)
    return "\n".join([*out, f"Filings from {told['first_date'] or '-'} to {told['last_date'] or '-'}; effective depth {depth}, {gap} beyond three.", ""])


def rated_roots(rows: DataFrame, root: str = "root_cik") -> DataFrame:
    """A row for each root: summary, rating and first company by name, all roots in one job."""
    keys = [root]
    firsts = rows.groupBy(root).agg(F.min(blank_to_null(F.col("company_name"))).alias("company_name"))
    return edges.summary(rows, keys).drop("adversarial_jurisdictions").join(edges.ratings(rows, keys).select(root, "score", "rating", "sectors", "reasons", "adversarial"), root).join(firsts, root)


def triage_lines(rated: DataFrame, root: str = "root_cik") -> DataFrame:
    """value: the roots by falling score as Markdown, then how many there are of each rating. Lines are made and sorted as rows; only counts reach the driver."""
    spark = rated.sparkSession
    sign = F.create_map(*[F.lit(x) for k, v in SIGNS.items() for x in (k, v)])
    cells = [F.concat(sign[F.col("rating")], F.lit(" **"), "rating", F.lit("**")), F.col("score").cast("string"), F.col(root), F.coalesce("company_name", F.concat(F.lit("CIK "), root)), F.array_join(F.coalesce("sectors", F.array().cast("array<string>")), ", "), F.array_join(F.coalesce("adversarial", F.array().cast("array<string>")), ", ")]
    ordered = numbered(rated.select(F.col(root).alias("_r"), (-F.col("score")).alias("_s"), F.concat(F.lit(" | "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("_c")), ["_s", "_r"], "_i")
    n = {r["rating"]: r["n"] for r in counts(rated, "rating").collect()}
    head = ["# Triage Manifest", "", f"CIKs processed: {sum(n.values())}", "", "| Priority | Rating | Score | CIK | Company | Sectors | Adversarial Jurisdictions |", "|---|---|---|---|---|---|---|"]
    tail = ["", "| Rating | Count |", "|---|---|", *[f"| {SIGNS[k]} **{k}** | {n[k]} |" for k in SIGNS if k in n], ""]
    ends = spark.createDataFrame([(p, i, x) for p, part in ((0, head), (2, tail)) for i, x in enumerate(part)], "p int, i long, value string")
    lines = ordered.select(F.lit(1).alias("p"), F.col("_i").alias("i"), F.concat(F.lit("| "), F.col("_i").cast("string"), "_c").alias("value"))
    return ends.unionByName(lines).orderBy("p", "i").select("value")


def triage(rated: DataFrame, root: str = "root_cik") -> str:
    """The lines of triage_lines as one text, for a report of few roots."""
    return "\n".join(r["value"] for r in triage_lines(rated, root).collect())


def run_summary(rated: DataFrame) -> str:
    """Totals over all roots as text."""
    t = rated.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_edges", "adversarial_edges", "state_affiliated_edges", "obscuring_role_edges")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("adversarial")))).alias("places")).first()
    return "\n".join([f"Total edges             : {t['total_edges']}", f"Total adversarial edges : {t['adversarial_edges']}", f"Total state-affiliated  : {t['state_affiliated_edges']}", f"Total obscuring roles   : {t['obscuring_role_edges']}", f"Adversarial jurisdictions found: {', '.join(t['places']) or 'none'}"])


def scan_report(found: DataFrame, most: int = 50) -> str:
    """The country scan as Markdown: counts by tier, code and field, the go-betweens."""
    from tierwalk.operators import scan

    out = ["# Country Scan", "", "| Tier | CIKs |", "|---|---|", *[f"| {r['tier']} | {r['n']} |" for r in counts(found, "tier").orderBy("tier").collect()], "", "| Code | CIKs | Business | Incorporation | Mailing |", "|---|---|---|---|---|"]
    out += [f"| {r['code']} | {r['n']} | {r['n_countryba']} | {r['n_countryinc']} | {r['n_countryma']} |" for r in scan.cross_table(found).orderBy(F.desc("n"), "code").collect()]
    rows = scan.go_betweens(found, True).orderBy("tier", "name").limit(most).collect()
    return "\n".join([*out, "", "| CIK | Name | Pattern |", "|---|---|---|", *[f"| {r['cik']} | {r['name']} | {r['pattern']} |" for r in rows], ""])


def drawn(rows: DataFrame) -> DataFrame:
    """value: the lines of a graph in DOT, in order; names as labels, and as ids with letters, digits and underscores only."""
    key = lambda c: F.concat(F.lit("n_"), F.regexp_replace(F.btrim(c), r"[^\p{L}\p{N}_]", "_"))
    label = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    nodes = graph.nodes(rows).select(F.lit(1).alias("o"), F.concat(F.lit("  "), key(F.col("name")), F.lit(' [label="'), label(F.col("name")), F.lit('", class="'), F.col("type"), F.lit('"];')).alias("value"))
    links = rows.select(F.lit(2).alias("o"), F.concat(F.lit("  "), key(F.col("source")), F.lit(" -> "), key(F.col("target")), F.lit(' [label="'), label(F.concat_ws(" ", "relationship", blank_to_null(F.col("detail")))), F.lit('"];')).alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "digraph ownership {"), (3, "}")], "o int, value string")
    return ends.unionByName(nodes).unionByName(links).orderBy("o", "value").select("value")


def page(rows: DataFrame, most: int = 400) -> str:
    """An HTML page that draws the nodes with most edges (`most` of them) on a circle, with names and relationships to point at."""
    from html import escape
    from math import cos, pi, sin

    degree = rows.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    top = degree.filter("name <> ''").orderBy(F.desc("n"), "name").limit(most)
    names = [r["name"] for r in top.collect()]
    both = rows.join(top.select(F.col("name").alias("source")), "source", "left_semi").join(top.select(F.col("name").alias("target")), "target", "left_semi")
    links = both.groupBy("source", "target", "relationship").agg(F.count(F.lit(1)).alias("n")).orderBy("source", "target", "relationship").limit(20 * most).collect()
    at = {n: (500 + 420 * cos(2 * pi * i / max(1, len(names))), 500 + 420 * sin(2 * pi * i / max(1, len(names)))) for i, n in enumerate(names)}
    line = lambda r: f'<line x1="{at[r["source"]][0]:.1f}" y1="{at[r["source"]][1]:.1f}" x2="{at[r["target"]][0]:.1f}" y2="{at[r["target"]][1]:.1f}"><title>{escape(r["source"])} - {escape(r["relationship"])} ({r["n"]}) - {escape(r["target"])}</title></line>'
    dot = lambda n: f'<circle cx="{at[n][0]:.1f}" cy="{at[n][1]:.1f}" r="5"><title>{escape(n)}</title></circle>'
    style = "<style>line{stroke:#999;stroke-width:1.5}circle{fill:#247}line:hover{stroke:#c30}</style>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Ownership graph</title>{style}</head><body><svg viewBox="0 0 1000 1000">{"".join(map(line, links))}{"".join(map(dot, names))}</svg></body></html>'
