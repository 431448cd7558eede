"""Ownership edges: building them from people, institutions, owners, countries and registrants; merging, summary, rating.

An edge is a flat row of COLUMNS; `seq` (any type with an order) keeps the order of edges through every operator.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.dims import tables
from tierwalk.functions import lookup
from tierwalk.functions.text import blank_to_null
from tierwalk.operators.order import numbered
from tierwalk.session import stored

TIERS = ("ADVERSARIAL", "CONDUIT", "OPACITY")
#: What makes two edges one.
KEY = ["source", "source_type", "target", "target_type", "relationship", "detail", "filing_accession"]
JURISDICTIONS = ["source_jurisdiction", "source_risk_tier", "target_jurisdiction", "target_risk_tier"]
AFFILIATIONS = ["state_affiliation", "state_affiliation_sub", "state_affiliation_detail"]
FLAGS = ["role_is_executive", "role_is_board", "role_is_ownership", "role_is_obscuring"]
COLUMNS = [*KEY[:4], *JURISDICTIONS, "relationship", "detail", *AFFILIATIONS, *FLAGS, "chain_depth", "filing_accession", "filing_form", "filing_date", "method", "notes", "source_notes", "target_notes"]


def _edges(rows: DataFrame, values: dict[str, Column | str | bool | int | None], sides: tuple[Column | None, Column | None], affiliated: Column | None, lead: Sequence[Column], keep: Sequence[str], known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """Edges from rows with a filing (accession, form, filing_date, depth).

    sides: jurisdiction structs of source and target (None: unknown); affiliated: the name whose state affiliation counts,
    under the target's jurisdiction; lead: parts of the notes before the affiliation's (nulls are left out).
    """
    none, text = F.lit(None), "string"
    base = {
        "chain_depth": F.col("depth").cast("int"), "filing_accession": F.col("accession"), "filing_form": F.col("form"), "filing_date": F.col("filing_date"), "source_notes": none.cast(text), "target_notes": none.cast(text),
        **{f: F.lit(False) for f in FLAGS},
    }
    rows = rows.withColumns({f"_{n}": s if s is not None else none.cast("struct<country: string, tier: string, token: string>") for n, s in zip(("source", "target"), sides, strict=True)})
    target = F.col("_target.country")
    aff = lookup.affiliation(affiliated, target, known.affiliations) if affiliated is not None else none.cast("struct<category: string, sub: string, detail: string, confidence: double>")
    rows = rows.withColumn("_aff", F.when(F.col("_has") if "_has" in rows.columns else F.lit(True), aff)).withColumn("_aff", F.when(F.col("_aff.category") != "None", F.col("_aff")))
    base |= {"source_jurisdiction": F.col("_source.country"), "source_risk_tier": F.col("_source.tier"), "target_jurisdiction": target, "target_risk_tier": F.col("_target.tier")}
    base |= {"state_affiliation": F.col("_aff.category"), "state_affiliation_sub": F.col("_aff.sub"), "state_affiliation_detail": F.col("_aff.detail")}
    said = F.when(F.col("_aff").isNotNull(), F.concat(F.lit("state_affiliation: "), F.col("_aff.category")))
    more = [said, F.concat(F.lit("subcategory: "), F.col("_aff.sub")), F.col("_aff.detail")]
    base["notes"] = blank_to_null(F.concat_ws("; ", *lead, *(more if values.pop("affiliation_notes", True) else [said])))
    values = base | {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return rows.select(*[values[c].alias(c) for c in COLUMNS], *keep)


def role_edges(people: DataFrame, institutions: bool = False, keep: Sequence[str] = ("seq",), known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """Edges from people (name, role: a struct of lookup.role, issuer, issuer_country, a filing) to their issuers; of institutions if asked."""
    kind = "institution" if institutions else "person"
    target = lookup.jurisdiction(F.col("issuer"), F.col("issuer_country"), table=known.jurisdictions)
    flags = {f"role_is_{k}": F.col(f"role.{k}") for k in ("executive", "board", "ownership", "obscuring")}
    values = {"source": F.col("name"), "source_type": kind, "target": F.col("issuer"), "target_type": "company", "relationship": f"{kind}_role", "detail": F.col("role.role"), "method": "role_extraction", **flags}
    return _edges(people, values, (lookup.jurisdiction(F.col("name"), table=known.jurisdictions), target), F.col("name"), [F.lit("method: signature_or_narrative")], keep, known)


def owner_edges(owners: DataFrame, keep: Sequence[str] = ("seq",), known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """Edges from beneficial owners (owner, percent, class_title, owner_notes, issuer, issuer_country, a filing) to issuers."""
    percent = F.concat(F.col("percent").cast("string"), F.lit("%"))
    detail = F.coalesce(F.concat(percent, F.coalesce(F.concat(F.lit(" of "), blank_to_null(F.col("class_title"))), F.lit(""))), F.lit(""))
    values = {"source": F.col("owner"), "source_type": "person_or_institution", "target": F.col("issuer"), "target_type": "company", "relationship": "beneficial_owner", "detail": detail, "method": "sc13", "role_is_ownership": True}
    target = lookup.jurisdiction(F.col("issuer"), F.col("issuer_country"), table=known.jurisdictions)
    return _edges(owners, values, (lookup.jurisdiction(F.col("owner"), table=known.jurisdictions), target), F.col("owner"), [F.lit("method: sc13"), blank_to_null(F.col("owner_notes"))], keep, known)


def country_edges(mentions: DataFrame, keep: Sequence[str] = ("seq",), known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """Edges from issuers to the countries (country) that a filing names."""
    values = {"source": F.col("issuer"), "source_type": "company", "target": F.col("country"), "target_type": "country", "relationship": "country_association", "detail": "", "method": "country_extraction"}
    place = F.struct(F.col("country").alias("country"), lookup.tier_of(F.col("country"), known.jurisdictions).alias("tier"), F.lit(None).cast("string").alias("token"))
    return _edges(mentions, values, (None, place), None, [], keep, known)


def named_edges(rows: DataFrame, keep: Sequence[str] = ("seq",), known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """role_edges of people (kind under 2, with role) and of institutions (kind 2, with the role Unknown) and country_edges (kind 4) in one pass over rows with name, issuer, issuer_country, a filing."""
    person, place = F.col("kind") < 2, F.col("kind") == 4
    by_kind = lambda a, b, c: F.when(person, a).when(place, c).otherwise(b)
    name = F.when(~place, F.col("name"))
    values = {
        "source": F.when(place, F.col("issuer")).otherwise(F.col("name")), "source_type": by_kind("person", "institution", "company"), "target": F.when(place, F.col("name")).otherwise(F.col("issuer")), "target_type": F.when(place, "country").otherwise("company"),
        "relationship": by_kind("person_role", "institution_role", "country_association"), "detail": by_kind(F.col("role.role"), "Unknown", ""), "method": F.when(place, "country_extraction").otherwise("role_extraction"),
        **{f"role_is_{k}": F.when(person, F.col(f"role.{k}")).otherwise(False) for k in ("executive", "board", "ownership", "obscuring")},
    }
    issuer = lookup.jurisdiction(F.when(~place, F.col("issuer")), F.col("issuer_country"), table=known.jurisdictions)
    country = F.struct(F.col("name").alias("country"), lookup.tier_of(F.col("name"), known.jurisdictions).alias("tier"), F.lit(None).cast("string").alias("token"))
    sides = lookup.jurisdiction(name, table=known.jurisdictions), F.when(place, country).otherwise(issuer)
    return _edges(rows, values, sides, name, [F.when(~place, F.lit("method: signature_or_narrative"))], keep, known)


def incorporation_edges(companies: DataFrame, states: dict[str, str], keep: Sequence[str] = ("seq",), known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """Edges from companies (cik, name, state, sic, sic_description) to where they are incorporated; blank states have none."""
    names = F.create_map(*[F.lit(x) for pair in states.items() for x in pair])
    rows = companies.filter("state <> ''").withColumns({
        "place": F.coalesce(F.try_element_at(names, F.upper("state")), F.col("state")), "accession": F.concat(F.lit("CIK-"), "cik"), "form": F.lit("company_info"), "filing_date": F.lit(""), "depth": F.lit(0),
    })
    values = {
        "source": F.coalesce(F.col("name"), F.concat(F.lit("CIK "), "cik")), "source_type": "company", "target": F.col("place"), "target_type": "country", "relationship": "incorporated_in", "detail": F.coalesce("sic_description", F.lit("")),
        "method": "company_metadata", "source_notes": F.concat(F.lit("CIK: "), "cik"), "target_notes": F.concat(F.lit("code: "), "state"),
    }
    place = F.struct(F.col("place").alias("country"), lookup.tier_of(F.col("place"), known.jurisdictions).alias("tier"), F.lit(None).cast("string").alias("token"))
    return _edges(rows, values, (None, place), None, [F.concat(F.lit("SIC: "), F.coalesce("sic", F.lit("")), F.lit(" -- "), F.coalesce("sic_description", F.lit("")))], keep, known)


def subsidiary_edges(pairs: DataFrame, keep: Sequence[str] = ("seq",), known: tables.Tables = tables.DEFAULT) -> DataFrame:
    """Edges from parents to the registrants that their filings list.

    pairs: structs parent and child (cik, name, countryba, countryinc, stprinc, sic, former), a filing and its depth. A country code
    stands for the jurisdiction as it is, so its tier is MONITORED; affiliations that need a country's name don't apply then.
    """
    side = lambda s: lookup.jurisdiction(F.col(f"{s}.name"), F.col(f"{s}.countryba"), table=known.jurisdictions)
    child = lambda c: blank_to_null(F.col(f"child.{c}"))
    place = F.concat(F.lit("incorporated: "), child("countryinc"), F.coalesce(F.concat(F.lit("/"), child("stprinc")), F.lit("")))
    values = {
        "source": F.col("parent.name"), "source_type": "company", "target": F.col("child.name"), "target_type": "company", "relationship": "consolidated_subsidiary", "detail": "co-registrant in consolidated filing",
        "method": "xbrl_co_registrant", "role_is_ownership": True, "source_notes": F.concat(F.lit("CIK: "), F.col("parent.cik")), "target_notes": F.concat(F.lit("CIK: "), F.col("child.cik")), "affiliation_notes": False,
    }
    return _edges(pairs, values, (side("parent"), side("child")), F.col("child.name"), [place, F.concat(F.lit("SIC: "), child("sic")), F.concat(F.lit("former: "), child("former"))], keep, known)


#: Edges of one key that are folded in one row; those of a key with more are folded in segments of so many different notes.
SEGMENT = 1000


def merged(edges: DataFrame, key: Sequence[str] = tuple(KEY), seq: str = "seq", segment: int = SEGMENT) -> DataFrame:
    """One edge for each key, in its first edge's place (seq).

    A later edge only counts if it has notes that those gathered so far don't hold: then its notes follow after "; ", it fills in
    jurisdictions and affiliations that are missing, its flags are or-ed and its smaller depth counts.

    Keys with up to `segment` edges are dealt once and folded in a row. Of a key with more, edges whose notes an earlier one had are left
    out first; the rest is cut into segments of its order, which tasks go through side by side and leave out what an earlier note of the
    segment holds; what remains is streamed in order past the notes gathered so far, so no row or task holds more of a key
    than its result and one segment. Which keys have more is told by counts of the keys' hashes; keys with one hash go one way together.
    """
    parts = [c for c in edges.columns if c not in key and c != seq]
    one = F.struct(F.col(seq).alias("_seq"), *parts)
    named = lambda df: df.select(*[F.col(c) if c in key else F.col("_e._seq").alias(seq) if c == seq else F.col(f"_e.{c}").alias(c) for c in edges.columns])
    hashed = F.xxhash64(*key)
    many = stored(edges.groupBy(hashed.alias("_h")).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > segment).select("_h"), "many-edges")
    if many.isEmpty():
        return named(_folded(edges.select(*key, one.alias("_e")), key, parts))
    few = named(_folded(edges.join(many, hashed == F.col("_h"), "left_anti").select(*key, one.alias("_e")), key, parts))
    # an edge whose notes an earlier one of its key had, or that has none and isn't the first, changes nothing: gone before anything is gathered
    firsts = edges.join(many, hashed == F.col("_h"), "left_semi").withColumn("_n", F.coalesce("notes", F.lit(""))).groupBy(*key, "_n").agg(F.min_by(one, F.col(seq)).alias("_e"))
    return few.unionByName(_streamed(named(firsts), key, seq, segment))


def _folded(rows: DataFrame, key: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Edges of a key (_e) gathered and folded in a row."""
    fill, flags = [c for c in parts if c in JURISDICTIONS + AFFILIATIONS], [c for c in parts if c in FLAGS]
    groups = rows.groupBy(*key).agg(F.array_sort(F.collect_list("_e")).alias("_all"))

    def take(acc: Column, e: Column) -> Column:
        more = (F.coalesce(e["notes"], F.lit("")) != "") & ~F.contains(F.coalesce(acc["notes"], F.lit("")), e["notes"])
        value = {"notes": F.when(F.coalesce(acc["notes"], F.lit("")) != "", F.concat(acc["notes"], F.lit("; "), e["notes"])).otherwise(e["notes"])}
        value |= {c: F.coalesce(blank_to_null(acc[c]), e[c]) for c in fill} | {c: acc[c] | e[c] for c in flags} | {"chain_depth": F.least(acc["chain_depth"], e["chain_depth"])}
        return F.when(more, F.struct(acc["_seq"].alias("_seq"), *[value.get(c, acc[c]).alias(c) for c in parts])).otherwise(acc)

    return groups.withColumn("_e", F.aggregate(F.slice("_all", 2, F.size("_all")), F.get("_all", F.lit(0)), take))


def _streamed(edges: DataFrame, key: Sequence[str], seq: str, segment: int) -> DataFrame:
    """The same fold for keys with many notes: by segments side by side, then in order."""
    columns = edges.columns
    fill, flags = [c for c in columns if c in JURISDICTIONS + AFFILIATIONS], [c for c in columns if c in FLAGS]
    placed = numbered(edges.withColumn("_g", F.to_json(F.struct(*key), {"ignoreNullFields": "false"})), [seq], "_i", ["_g"])
    placed = placed.withColumn("_s", F.floor((F.col("_i") - 1) / segment))

    def thinned(batches):
        now, notes = None, []
        for b in batches:
            keep = []
            for group, s, i, note in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_g", "_s", "_i", "notes")], strict=True):
                if (group, s) != now:
                    now, notes = (group, s), []
                # what a single earlier note holds, the gathered ones hold too
                keep.append(i == 1 or bool(note) and not any(note in n for n in notes))
                if note and keep[-1]:
                    notes.append(note)
            yield b.filter(pa.array(keep, pa.bool_()))

    def carried(batches):
        now, acc, notes = None, None, ""
        for b in batches:
            out = []
            for e in b.to_pylist():
                if e["_g"] != now:
                    if acc is not None:
                        out.append(acc | {"notes": notes or acc["notes"]})
                    now, acc, notes = e["_g"], e, e["notes"] or ""
                elif e["notes"] and e["notes"] not in notes:
                    notes += ("; " if notes else "") + e["notes"]
                    for c in fill:
                        acc[c] = acc[c] or e[c]
                    for c in flags:
                        acc[c] = True if acc[c] or e[c] else None if acc[c] is None or e[c] is None else False
                    acc["chain_depth"] = min((x for x in (acc["chain_depth"], e["chain_depth"]) if x is not None), default=None)
            yield pa.RecordBatch.from_pylist(out, b.schema)
        if acc is not None:
            yield pa.RecordBatch.from_pylist([acc | {"notes": notes or acc["notes"]}], b.schema)

    thin = placed.repartition("_g", "_s").sortWithinPartitions("_g", "_s", "_i").mapInArrow(thinned, placed.schema)
    return thin.repartition("_g").sortWithinPartitions("_g", "_i").mapInArrow(carried, placed.schema).select(*columns)


def tier_bucket(source: Column, target: Column) -> Column:
    """The one bucket of an edge: the source's tier if it counts, else the target's."""
    return F.when(source.isin(*TIERS), source).when(target.isin(*TIERS), target)


def summary(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each group: edges by bucket and kind, the largest depth, jurisdictions and adversarial ones (sorted)."""
    bucket = tier_bucket(F.col("source_risk_tier"), F.col("target_risk_tier"))
    place = lambda s, ok: F.collect_set(F.when(ok, blank_to_null(F.col(f"{s}_jurisdiction"))))
    both = lambda ok: F.array_sort(F.array_union(*[place(s, ok(s)) for s in ("source", "target")]))
    return edges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_edges"), *[F.count_if(bucket == t).alias(f"{t.lower()}_edges") for t in TIERS], F.count_if(F.coalesce("state_affiliation", F.lit("")) != "").alias("state_affiliated_edges"),
        F.count_if("role_is_obscuring").alias("obscuring_role_edges"), F.count_if("role_is_ownership").alias("ownership_edges"), F.greatest(F.lit(0), F.max("chain_depth")).alias("max_chain_depth"),
        both(lambda s: F.lit(True)).alias("unique_jurisdictions"), both(lambda s: F.col(f"{s}_risk_tier") == "ADVERSARIAL").alias("adversarial_jurisdictions"),
    )


#: Points of a rating and least scores of its bands.
POINTS = {"adversarial": 40, "three_affiliated": 25, "affiliated": 15, "conduit": 10, "opacity": 10, "obscuring": 10, "deep": 5, "sector": 10}
BANDS = (("CRITICAL", 60), ("HIGH", 40), ("ELEVATED", 25), ("MODERATE", 10))


def ratings(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each group: score, rating, reasons (in order), and what they come from.

    Jurisdictions count for each tier on either side; affiliated entities as distinct pairs of entity and category; the industry
    is that of the last incorporation edge's notes.
    """
    of = lambda t: F.array_sort(F.array_distinct(F.concat(*[F.collect_set(F.when(F.col(f"{s}_risk_tier") == t, blank_to_null(F.col(f"{s}_jurisdiction")))) for s in ("source", "target")])))
    code = F.regexp_extract("notes", r"SIC:\s*(\S+)", 1)
    has_code = (F.col("relationship") == "incorporated_in") & (code != "")
    per = edges.groupBy(*by).agg(
        of("ADVERSARIAL").alias("adversarial"), of("CONDUIT").alias("conduit"), of("OPACITY").alias("opacity"), F.count_distinct(F.when(blank_to_null(F.col("state_affiliation")).isNotNull(), F.struct("source", "state_affiliation"))).cast("int").alias("n_affiliated"),
        F.count_distinct(F.when(F.col("role_is_obscuring"), F.col("source"))).cast("int").alias("n_obscuring"), F.greatest(F.lit(0), F.max("chain_depth")).alias("max_depth"),
        F.max_by(F.when(has_code, code), F.when(has_code, F.col("seq"))).alias("sic"),
    )
    per = per.withColumn("sectors", lookup.sectors(F.col("sic")))
    some = lambda c: F.size(c) > 0
    listed = lambda c: F.array_join(c, ", ")
    parts = [
        (some("adversarial"), POINTS["adversarial"], F.concat(F.lit("Adversarial-nation jurisdictions detected: "), listed("adversarial"))),
        (F.col("n_affiliated") >= 3, POINTS["three_affiliated"], F.concat("n_affiliated", F.lit(" state-actor affiliated entities"))),
        (F.col("n_affiliated").between(1, 2), POINTS["affiliated"], F.concat("n_affiliated", F.lit(" state-actor affiliated entity(ies)"))),
        (some("conduit"), POINTS["conduit"], F.concat(F.lit("Conduit jurisdictions: "), listed("conduit"))),
        (some("opacity"), POINTS["opacity"], F.concat(F.lit("Opacity jurisdictions: "), listed("opacity"))),
        (F.col("n_obscuring") > 0, POINTS["obscuring"], F.concat("n_obscuring", F.lit(" obscuring-role entities (nominees, proxies, intermediaries)"))),
        (F.col("max_depth") >= 5, POINTS["deep"], F.concat(F.lit("Deep ownership chain (depth "), "max_depth", F.lit(")"))),
        (some("sectors"), POINTS["sector"], F.concat(F.lit("Critical sector(s): "), listed("sectors"))),
    ]
    score = sum((F.when(ok, n).otherwise(0) for ok, n, _ in parts), F.lit(0))
    rating = F.lit("LOW")
    for band, least in reversed(BANDS):
        rating = F.when(F.col("score") >= least, band).otherwise(rating)
    return per.withColumn("score", score).withColumns({"rating": rating, "reasons": F.array_compact(F.array(*[F.when(ok, text) for ok, _, text in parts]))})


def company(edges: DataFrame) -> DataFrame:
    """edges with company_name and company_cik: of the side whose notes begin with CIK:, the target's first; '' without one."""
    out = {"company_name": F.lit(""), "company_cik": F.lit("")}
    for side in ("source", "target"):
        mine = F.coalesce(F.col(f"{side}_notes").startswith("CIK:"), F.lit(False))
        out["company_cik"] = F.when(mine, F.btrim(F.replace(F.col(f"{side}_notes"), F.lit("CIK: "), F.lit("")))).otherwise(out["company_cik"])
        out["company_name"] = F.when(mine, F.col(side)).otherwise(out["company_name"])
    return edges.withColumns(out)
