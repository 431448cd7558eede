"""Operators against plain versions, and chains from end to end."""

import random
from collections import deque
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tierwalk import cli, config
from tierwalk.operators import edges, gaps, graph, holdings, linkage, order, records, report, scan, targets
from tierwalk.plans import chain, research
from tierwalk.sources import edge_files
from tierwalk.streaming import index


def queue_walk(steps, root, depth, cap):
    """The walk as a queue, node by node."""
    visited, met, queue = [], [], deque([(root, 0)])
    while queue:
        node, d = queue.popleft()
        if node in visited:
            continue
        if cap and len(visited) >= cap:
            break
        visited.append(node)
        for child in sorted(steps.get(node, ())):
            met.append((node, child, d))
            if d + 1 <= depth and child not in visited:
                queue.append((child, d + 1))
    return visited, met


@pytest.mark.parametrize("seed", range(4))
def test_ranked_walk_like_a_queue(spark, seed):
    rng = random.Random(seed)
    graphs = {f"g{g}": {f"g{g}n{i}": {f"g{g}n{rng.randrange(9)}" for _ in range(rng.randrange(4))} for i in range(9)} for g in range(6)}
    rows = [(p, c, c) for g in graphs.values() for p, cs in g.items() for c in cs]
    roots = spark.createDataFrame([(f"{g}n0",) for g in graphs], "root string")
    depth, cap = seed % 3 + 1, [None, 3, 5, 1][seed]
    visited, met = graph.ranked_walk(spark.createDataFrame(rows, "parent string, child string, ord string"), roots, depth, cap)
    visited, met = visited.collect(), met.collect()
    for g, steps in graphs.items():
        want, want_met = queue_walk(steps, f"{g}n0", depth, cap)
        mine = [r.node for r in sorted((r for r in visited if r.root == f"{g}n0"), key=lambda r: r["rank"])]
        assert mine == want
        assert [(r.parent, r.child, r.depth) for r in sorted((r for r in met if r.root == f"{g}n0"), key=lambda r: (r["rank"], r.ord))] == want_met


def test_neighbourhood_levels_and_roots(spark):
    rows = [(1, "A", "B", "beneficial_owner", "Z", "", 0), (2, "B", "C", "beneficial_owner", "B", "2", 0), (3, "C", "D", "consolidated_subsidiary", "C", "3", 1), (4, "C", "A", "consolidated_subsidiary", "C", "3", 0), (5, "X", "Y", "person_role", "C", "3", 0)]
    e = spark.createDataFrame(rows, "seq int, source string, target string, relationship string, company_name string, company_cik string, chain_depth int").withColumns({"source_type": F.lit("s"), "target_type": F.lit("t")})
    near = lambda r, k: sorted(x.seq for x in graph.neighbourhood(e, spark.createDataFrame([(r,)], "node string"), k).collect())
    # one step from D is C; two steps are B and A as well
    assert near("D", 1) == [3] and near("D", 2) == [1, 2, 3, 4]
    assert near("D", 0) == [] and near("nobody", 1) == [1, 2, 3, 4, 5] and near("X", 1) == [5]
    got = {(r.side, r.node, r.level) for r in graph.levels(e, spark.createDataFrame([("C",)], "node string")).collect()}
    assert got == {("above", "B", 1), ("above", "A", 2), ("below", "D", 1), ("below", "A", 1)}
    assert graph.root_name(e).first()["root"] == "C"
    assert graph.root_name(e.withColumns({"company_name": F.lit(""), "company_cik": F.lit("")})).first()["root"] == "Y"
    assert {(r.name, r.type) for r in graph.nodes(e).collect()} >= {("B", "t"), ("A", "s")}


def plain_merge(rows, key):
    out = {}
    for r in rows:
        k = tuple(r[c] for c in key)
        if k not in out:
            out[k] = dict(r)
        elif r["notes"] and r["notes"] not in (out[k]["notes"] or ""):
            m = out[k]
            m["notes"] = f"{m['notes']}; {r['notes']}" if m["notes"] else r["notes"]
            m["source_jurisdiction"] = m["source_jurisdiction"] or r["source_jurisdiction"]
            m["role_is_board"] = m["role_is_board"] or r["role_is_board"]
            m["chain_depth"] = min(m["chain_depth"], r["chain_depth"])
    return sorted(out.values(), key=lambda r: r["seq"])


@pytest.mark.parametrize("segment", [1000, 4])
def test_merging_edges_like_a_fold(spark, segment):
    rng = random.Random(5)
    key = ["source", "target"]
    rows = [{"seq": i, "source": rng.choice("ab"), "target": rng.choice("xyz"), "notes": rng.choice([None, "", "n1", "n2", "n", "n1; n2", "m", "2; m", " m", "k;", "abc", "b", "x; y", "y"]), "source_jurisdiction": rng.choice([None, "", "J", "K"]), "role_is_board": rng.random() < 0.3, "chain_depth": rng.randrange(6)} for i in range(160)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "seq long, source string, target string, notes string, source_jurisdiction string, role_is_board boolean, chain_depth int").repartition(5)
    once = edges.merged(df, key, segment=segment)
    got = [r.asDict() for r in once.orderBy("seq").collect()]
    assert got == plain_merge(rows, key)
    assert [r.asDict() for r in edges.merged(once, key).orderBy("seq").collect()] == got


def test_containment_and_fuzzy_like_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    wholes, parts = [word(rng.randrange(0, 14)) for _ in range(60)], [word(rng.randrange(0, 9)) for _ in range(40)]
    wholes += [word(30) for _ in range(10)]
    parts += [w[3:17] for w in wholes[-5:]] + [w[2:9] for w in wholes[-5:]]
    a, b = spark.createDataFrame([(i, w) for i, w in enumerate(wholes)], "i int, w string"), spark.createDataFrame([(j, p) for j, p in enumerate(parts)], "j int, p string")
    got = {(r.i, r.j) for r in linkage.holds(a, b, "w", "p").collect()}
    assert got == {(i, j) for i, w in enumerate(wholes) for j, p in enumerate(parts) if p and p in w}
    names = [f"{word(rng.randrange(3, 12))} {word(4)}".upper() for _ in range(30)]
    known = [(n[:-1] + "X", i, str(i)) for i, n in enumerate(names[:15])] + [(f"{word(5)} {word(3)}".upper(), 15 + i, str(15 + i)) for i in range(40)] + [(names[20], 99, "99")]
    lookup = spark.createDataFrame([(k, p, c, k.title(), "T") for k, p, c in known], "key string, place int, cik string, title string, ticker string")
    got = {r.n: (r.cik, r.match_type, r.match_score) for r in linkage.fuzzy(spark.createDataFrame([(n,) for n in names], "n string"), lookup, "n").collect()}
    for n in names:
        best, score = "", 0.0
        if n in {k for k, _, _ in known}:
            assert got[n][1:] == ("exact", 1.0)
            continue
        for k, _, c in known:
            if abs(len(k) - len(n)) <= max(len(k), len(n)) * 0.4 and (s := SequenceMatcher(None, n, k).ratio()) > score and s >= 0.8:
                best, score = c, s
        assert got[n] == (best, "fuzzy" if best else "none", pytest.approx(score, abs=6e-4))


def test_candidates_are_few_and_complete(spark):
    """Of random names, all pairs of ratio 0.8 are candidates, and candidates are under a hundredth of all pairs."""
    rng = random.Random(4)
    letters = "EEEEEEEEEEEETTTTTTTTTAAAAAAAAOOOOOOOOIIIIIIINNNNNNNSSSSSSHHHHHHRRRRRRDDDDLLLLCCCUUUMMWWFFGGYYPPBVKJXQZ"
    name = lambda: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 10))) for _ in range(rng.randrange(2, 5)))
    right = sorted({name() for _ in range(400)})
    left = sorted({name() for _ in range(60)} | {r[:4] + rng.choice(letters) + r[5:-1] for r in right[:60]} | {r + " GROUP" for r in right[60:90]} | {"A", "\U0001f600 Ñ"})
    df = lambda x: spark.createDataFrame([(n,) for n in x], "_k string")
    for t, most in ((0.8, 0.01), (0.5, 1.0)):
        got = {(r._k, r._o) for r in linkage.near(df(left), df(right), t).collect()}
        fits = lambda a, b: min(len(a), len(b)) >= 0.6 * max(len(a), len(b)) and SequenceMatcher(None, a, b).ratio() >= t  # noqa: B023, E731
        want = {(a, b) for a in left for b in right if fits(a, b)}
        assert want and want <= got and len(got) <= most * len(left) * len(right)


def test_common_beginnings_dont_meet(spark):
    """100,000 names with one beginning: each term meets a few texts, those of its rarest gram."""
    start = "CHINA NATIONAL PETROLEUM AND NATURAL GAS "
    whole = spark.range(100_000).select(F.concat(F.lit(start), F.lpad(F.conv(F.col("id") * 7919 % 100_003, 10, 36), 6, "0")).alias("w"))
    terms = whole.filter("xxhash64(w) % 50 = 0").select(F.col("w").alias("p"))
    _, rarest = linkage.rarest_grams(whole, terms, "w", "p")
    assert rarest.count() == terms.count() > 1000 and rarest.agg(F.max("_gram_n")).first()[0] <= 5
    assert linkage.holds(whole, terms, "w", "p").filter("w = p").count() == terms.count()


SUB = "adsh string, cik string, name string, sic string, countryba string, countryinc string, stprinc string, countryma string, former string, form string, filed string, aciks string, source_period string, seq int"


@pytest.fixture(scope="module")
def sub(spark):
    row = lambda i, cik, name, form, filed, aciks="", ba="US", inc="US", former="": (f"a-{i}", cik, name, "3674", ba, inc, "DE", ba, former, form, filed, aciks, "q", i)
    rows = [row(1, "1", "Root Inc", "10-K", "20240101", "2 3 4"), row(2, "2", "Leaf Two", "8-K", "20240101"), row(3, "2", "Leaf Two", "10-Q", "20240301", "5 2"), row(4, "3", "Gazprom Unit", "8-K", "20240101", "", "CN"), row(5, "3", "Gazprom Unit", "20-F", "20230101", "", "CN", "KY"), row(6, "5", "Leaf Five", "8-K", "20240101", former="Old Root")]
    return spark.createDataFrame(rows, SUB)


def test_descent(spark, sub):
    roots = spark.createDataFrame([(" 1 ",), ("77",)], "cik string")
    visited, found = chain.descend(sub, roots, 1)
    got = {(r.source, r.target, r.chain_depth, r.filing_accession) for r in found.collect()}
    assert got == {("Root Inc", "Leaf Two", 0, "a-1"), ("Root Inc", "Gazprom Unit", 0, "a-1"), ("Root Inc", "CIK 4", 0, "a-1"), ("Leaf Two", "Leaf Five", 1, "a-3")}
    by = {r.target: r for r in found.collect()}
    assert (by["Gazprom Unit"].target_jurisdiction, by["Gazprom Unit"].target_risk_tier, by["Gazprom Unit"].state_affiliation) == ("CN", "MONITORED", None)
    assert by["Gazprom Unit"].notes == "incorporated: KY/DE; SIC: 3674" and by["Leaf Five"].notes == "incorporated: US/DE; SIC: 3674; former: Old Root" and by["CIK 4"].notes is None
    assert {(r.root, r.node) for r in visited.collect()} == {("1", "1"), ("1", "2"), ("1", "3"), ("1", "4"), ("77", "77")}
    assert chain.descend(sub, roots, 0)[1].count() == 3
    assert {r.cik: r.others for r in records.co_registrants(sub).collect()} == {"1": ["2", "3", "4"], "2": ["5"]}


def test_index_linkage(spark, sub):
    entries = spark.createDataFrame([("leaf five",), ("Root",), ("Gazprom UNIT",), ("none",)], "name string")
    assert {r.name: r.matched_cik for r in linkage.subsidiaries_in_index(entries, sub).collect()} == {"leaf five": "5", "Root": None, "Gazprom UNIT": "3", "none": None}
    assert {r.name: r.matched_cik for r in linkage.unique_in_index(entries, sub).collect()} == {"leaf five": "5", "Root": None, "Gazprom UNIT": "3", "none": None}
    found = scan.country_scan(sub, conduit=True)
    assert [(r.cik, r.tier, r.matched_fields, r.matched_codes) for r in found.collect()] == [("3", "ADVERSARIAL", ["countryba", "countryinc", "countryma"], ["CN", "KY"])]
    assert "| 3 | Gazprom Unit | based in China but inc:US |" in report.scan_report(found) and "| CN | 1 | 1 | 1 | 1 |" in report.scan_report(found)


def test_gaps_registers_and_state(spark, tmp_path):
    schema = "name string, state string, entity_type string, jurisdiction_of_formation string, registered_agent string, officers array<string>, formation_date string, seq int"
    rows = [("Acme Holdings Global", "DE", "LLC", "KY", "CSC", ["A B"], "2020", 1), ("acme", "TX", "Corp", "", None, None, None, 2), ("Big Federal Name LLC", "TX", "LLC", None, "Jo", [], "", 3), ("FED", "NV", "LP", "NV", "", [], "", 4), ("", "TX", "", "", "", [], "", 5), ("Zed", "TX", "Corp", "", "", [], "", 6)]
    state, federal = spark.createDataFrame(rows, schema), spark.createDataFrame([("ACME",), ("FEDERAL NAME",)], "name string")
    found = gaps.gaps(state, federal)
    got = {r.seq: r for r in found.collect()}
    assert set(got) == {1, 6} and got[1].risk_score == 1.0 and got[6].risk_score == 0.0 and got[1].gap_type == "private_only"
    assert got[1].risk_indicators == ["shell_name_pattern: holdings, global", "privacy_state: DE", "layering_vehicle: LLC", "foreign_formation: KY", "commercial_registered_agent"]
    assert tuple(gaps.buckets(found).first()) == (1, 0, 1)
    text = gaps.report(found, 2, 6, ["TX", "DE"])
    assert "States ingested: DE, TX" in text and "Officers: A B" in text and "Score: 1.00" in text
    registers = gaps.registers(spark)
    assert [r.tier for r in gaps.by_access(registers, "paywall", "api").collect()][:2] == ["paywall", "api"]
    asked = spark.createDataFrame([("tx", 5), ("CA", 5), ("??", 1)], "state string, n int")
    assert sorted((r.state, r.cost) for r in gaps.cost(asked, registers).collect()) == [("??", 0.0), ("CA", 0.0), ("tx", 5.0)]
    index.save(state, federal, str(tmp_path / "s"))
    again = index.load(spark, str(tmp_path / "s"))
    assert gaps.gaps(*again).count() == 2
    assert index.gaps_so_far(spark, str(tmp_path / "s" / "entities"), schema, federal).count() == 2


def test_holdings(spark, tmp_path):
    rows = [("China", "Acme, LLC ", "TX", "Bell", "48", "1,000 ac", "", 1), ("Canada", "Acme, LLC", "IA", "", "48.0", "x", "1", 2), ("P.R.C", "Beta", "IA", "Polk", "", "5", "", 3), ("Canada", "Maple", "IA", "Polk", "", "5", "", 4), ("China", " ", "IA", "Polk", "", "5", "", 5)]
    raw = spark.createDataFrame(rows, "Country string, `Owner Name 1/` string, State string, County string, FIPS string, `Number of Acres` string, `Secondary Interest In China` string, seq int")
    held = holdings.rollup(holdings.of_countries(holdings.named(raw), holdings.wanted_countries()))
    got = {r.entity_name: r for r in held.collect()}
    assert set(got) == {"Acme, LLC", "Beta"} and (got["Acme, LLC"].total_acres, got["Acme, LLC"].holding_count, got["Acme, LLC"].fips_codes, got["Acme, LLC"].secondary_china) == (1000.0, 2, "00048", True)
    lookup = spark.createDataFrame([("ACME", 0, "7", "Acme Inc", "A")], "key string, place int, cik string, title string, ticker string")
    matched = linkage.fuzzy(held, lookup, "entity_name")
    assert holdings.coverage(matched).first()["coverage_pct"] == 50.0
    holdings.write(matched, str(tmp_path / "h"))
    assert [r.value for r in spark.read.text(str(tmp_path / "h" / "target_ciks")).collect()] == ["7  # Acme Inc"]
    assert spark.read.option("header", True).csv(str(tmp_path / "h" / "unmatched")).count() == 1
    assert "Unmatched entities:        1 (50.0%)" in holdings.summary(matched)
    with pytest.raises(ValueError, match="entity_name"):
        holdings.named(spark.createDataFrame([("x", 1)], "Country string, seq int"))


def test_targets(spark):
    companies = spark.createDataFrame([("1", "China Mobile Ltd", "CHL", 0), ("2", "Acme", "PRCX", 1), ("3", "Gazprom PJSC", "OGZ", 2), ("4", "Other", None, 3)], "cik string, name string, ticker string, seq int")
    found = targets.found_by(companies, targets.terms(spark, ["china", "russia"]))
    assert {(r.cik, r.matches[0]["term"]) for r in found.collect()} == {("1", "China"), ("2", "PRC"), ("3", "gazprom")}
    assert {(r.country, r.n) for r in targets.by_nation(found).collect()} == {("china", 2), ("russia", 1)}
    assert {r.cik for r in targets.found_by(companies, targets.terms(spark, ["china"], least=4)).collect()} == {"1"}
    every = targets.union(targets.targets(found), companies.withColumn("ord", F.lit(0)))
    assert [r.cik for r in every.orderBy("at").collect()] == ["1", "2", "3", "4"]
    done, present = spark.createDataFrame([("1",)], "cik string"), spark.createDataFrame([("2",), ("1",)], "cik string")
    assert [r.cik for r in targets.chosen(every, 2, done, present).collect()] == ["2"]
    assert targets.expansion_summary(spark).filter("country = 'china'").count() == 2


FILING = "NAME OF ISSUER: Acme\nNAME OF REPORTING PERSON\nAlpha Fund LP\nPERCENT OF CLASS: 5%\nTITLE OF CLASS OF SECURITIES\nCommon\n\nMANAGEMENT\nAnn B. Poe, age 52, Director of Leaf Five Group in China\n\nSIGNATURES\n/s/ Ann B. Poe\nEXHIBIT\nCIK 222222"


def test_chain_from_end_to_end(spark, sub, tmp_path, capsys):
    bundle = "CENTRAL INDEX KEY: 0000333333\n"
    filings = [("111111", "0000444444-24-000001", "SC 13D", "2024-02-01", FILING, bundle, 0, "Acme"), ("222222", "0000555555-24-000001", "10-K", "2024-01-01", "CIK 111111 CIK 666666", None, 0, ""), ("333333", "x", "10-K", "", "", None, 0, "")]
    filings = spark.createDataFrame(filings, "cik string, accession string, form string, filing_date string, content string, bundle string, place int, company string")
    companies = spark.createDataFrame([("111111", "Acme", "KY", "3674", "Chips"), ("222222", "Two Co", "", "", "")], "cik string, name string, state string, sic string, sic_description string")
    roots = spark.createDataFrame([("0000111111",)], "cik string")
    done = chain.run(filings, companies, roots, 1, 10, sub=sub)
    assert {(r.node, r.depth) for r in done.visited.collect()} == {("111111", 0), ("222222", 1), ("333333", 1), ("444444", 1)}
    # further up only filers are followed
    assert {r.node for r in chain.ascend(filings, roots, 3).collect()} == {"111111", "222222", "333333", "444444", "555555"}
    got = done.edges.orderBy("seq").collect()
    assert [r.relationship for r in got][:2] == ["incorporated_in", "person_role"]
    by = {(r.relationship, r.source): r for r in got}
    owner = by["beneficial_owner", "Alpha Fund LP"]
    assert (owner.detail, owner.notes, owner.target) == ("5.0% of Common", "method: sc13; issuer: Acme", "Acme")
    person = by["person_role", "Ann B. Poe"]
    assert person.detail == "Director" and person.role_is_board and not person.role_is_ownership
    assert by["country_association", "Acme"].target_risk_tier == "ADVERSARIAL"
    assert by["incorporated_in", "Acme"].target == "Cayman Islands" and by["incorporated_in", "Acme"].company_cik == "111111"
    rated = report.rated_roots(done.edges)
    row = rated.first()
    assert (row.root_cik, row.rating, row.score) == ("111111", "CRITICAL", 60) and row.sectors == ["Semiconductors & Electronics"]
    assert "| 1 | \U0001f534 **CRITICAL** | 60 | 111111 | Acme |" in report.triage(rated) and "Total edges" in report.run_summary(rated)
    page = report.executive_summary(done.edges, "111111")
    assert "# Executive Summary: Acme" in page and "SUPPLY CHAIN ALERT" in page and "* Acme" in page
    data = str(tmp_path / "data")
    filings.write.parquet(f"{data}/filings")
    companies.write.parquet(f"{data}/companies")
    out = str(tmp_path / "out")
    assert cli.main(["run", "--cik", "111111", "--data", data, "--depth", "1", "--out", out], spark) == 0
    assert edge_files.read(spark, out).count() == done.edges.count()
    assert cli.main(["report", out], spark) == 0 and "## Relationships" in capsys.readouterr().out
    assert cli.main(["draw", out, "--root", "Acme", "--hops", "1"], spark) == 0 and "digraph" in capsys.readouterr().out
    assert cli.main(["run", "--cik", "1", "--data", data, "--depth", "99", "--out", out], spark) == 1
    assert cli.main(["run", "--cik", "1", "--data", data + "x", "--out", out], spark) == 2
    assert cli.main(["nothing"], spark) == 1
    assert cli.main(["draw", out, "--html"], spark) == 0 and "<title>Acme - country_association (1) - China</title>" in capsys.readouterr().out
    assert cli.main(["research", "--data", data, "--out", str(tmp_path / "r")], spark) == 1


def test_ratings_and_bands(spark):
    base = {"seq": 1, "source": "A", "target": "B", "relationship": "r", "notes": "", "source_jurisdiction": None, "source_risk_tier": "ADVERSARIAL", "target_jurisdiction": "X", "target_risk_tier": "CONDUIT", "state_affiliation": None, "role_is_obscuring": False, "role_is_ownership": False, "chain_depth": 0}
    schema = "seq int, source string, target string, relationship string, notes string, source_jurisdiction string, source_risk_tier string, target_jurisdiction string, target_risk_tier string, state_affiliation string, role_is_obscuring boolean, role_is_ownership boolean, chain_depth int"
    rate = lambda *rows: edges.ratings(spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)).first()
    assert (rate({}).score, rate({}).rating) == (10, "MODERATE")  # a tier without a jurisdiction doesn't count
    many = rate(*[{"source": s, "state_affiliation": "SOE", "source_jurisdiction": "China"} for s in "ABC"], {"relationship": "incorporated_in", "notes": "SIC: 3674 -- x", "seq": 2, "chain_depth": 5, "role_is_obscuring": True})
    assert (many.score, many.rating, many.n_affiliated) == (100, "CRITICAL", 3) and many.reasons[1] == "3 state-actor affiliated entities"
    assert rate({"relationship": "incorporated_in", "notes": "SIC:  -- x"}).sectors == []
    assert report.depth_gap(2, 5, 4) == (5, 2)


def test_settings(tmp_path):
    s = config.load({"TIERWALK_DEPTH": "4", "TIERWALK_FORMS": "10-K, 20-F"}, depth=None, index_dir="x", log_level="debug")
    assert (s.depth, s.forms, s.descend, s.log_level) == (4, ("10-K", "20-F"), True, "DEBUG")
    for bad in ({"depth": 0}, {"depth": 11}, {"descension_depth": 11}, {"most_ciks": 0}, {"log_level": "LOUD"}):
        with pytest.raises(ValueError):
            config.load({}, **bad)
    for _ in range(2):
        log = config.logger(config.load({}, log_file=str(tmp_path / "l.txt")))
    assert len(log.handlers) == 2
    log.info("once")
    assert (tmp_path / "l.txt").read_text().count("once") == 1


def test_research(spark, sub, tmp_path):
    companies = spark.createDataFrame([("111111", "China Acme", "CA", "NYSE", 0), ("222222", "Two Co", "TC", "OTC", 1), ("3", "Gazprom Unit", None, "OTC", 2)], "cik string, name string, ticker string, exchange string, seq int")
    pick = lambda **c: [r.cik for r in research.select(spark, research.Choice(**c), companies, sub)[0].orderBy("at").collect()]
    assert pick(exchange=" otc ") == ["222222", "3"] and pick(search=("china",)) == ["111111"] and pick(ciks=("5", " 7 ")) == ["5", "7"] and pick(ciks=("5", "7"), limit=1) == ["5"]
    assert pick(ciks=("5", "7"), prefilter=True) == ["5"] and pick(all_codes=True) == ["3"] and pick(codes=("ky",)) == ["3"] and set(pick(all_adversarial=True)) == {"111111", "3"}
    (tmp_path / "l.txt").write_text("9\n\n8\n")
    assert pick(cik_file=str(tmp_path / "l.txt")) == ["9", "8"]
    with pytest.raises(ValueError):
        pick()
    filings = spark.createDataFrame([(c, f"0000{c}-24-000001", "SC 13D", "2024-02-01", FILING, None, 0, "") for c in ("111111", "222222")], "cik string, accession string, form string, filing_date string, content string, bundle string, place int, company string")
    about = companies.select("cik", "name", F.lit("CN").alias("state"), F.lit("3674").alias("sic"), F.lit("").alias("sic_description"))
    chosen, found = research.select(spark, research.Choice(search=("china", "russia")), companies)
    out = str(tmp_path / "out")
    rated = research.run(spark, chosen, filings, about, out, found=found, max_depth=1)
    assert {r.root_cik: r.rating for r in rated.collect()} == {"111111": "HIGH", "3": "HIGH"}
    assert {r.cik for r in research.finished(spark, out).collect()} == {"111111", "3"}
    assert research.select(spark, research.Choice(search=("china", "russia")), companies, done=research.finished(spark, out))[0].count() == 0
    assert "HIGH" in "".join(r[0] for r in spark.read.text(f"{out}/triage").collect())
    assert research.code_report(sub) == {"codes": {"CN": 1, "KY": 1}, "fields": {"countryba": 1, "countryinc": 1, "countryma": 1}, "moved_abroad": 1, "intermediaries": 1}


def _research_inputs(spark, monkeypatch):
    """Five roots, of which the last has no edges; a chain gives a root of number n as many edges as its last digit, at their places."""
    ciks = ("111111", "222222", "333333", "444444", "7")
    row = F.explode(F.sequence(F.lit(1), F.pmod(F.col("cik").cast("int"), F.lit(10))))

    def edges_of(filings, companies, roots, sub=None, **how):
        rows = roots.filter("cik <> '7'").select(F.col("cik").alias("root_cik"), row.alias("seq"))
        flags = {c: F.lit(False) for c in edges.FLAGS}
        values = {c: F.concat(F.lit(f"{c[:3]} "), F.col("root_cik"), F.lit(" "), F.col("seq").cast("string")) for c in edge_files.COLUMNS if c not in flags and c != "chain_depth"}
        return chain.Chain(rows.withColumns(values | flags | {"chain_depth": F.lit(1), "source_risk_tier": F.lit("ADVERSARIAL"), "target_risk_tier": F.lit("CONDUIT")}), None, None)

    monkeypatch.setattr(chain, "run", edges_of)
    return research.select(spark, research.Choice(ciks=ciks))[0], None, None


def _all_of(spark, out):
    """Everything that a finished folder tells, without the numbers of batches."""
    result = research.Output(spark, out)
    files = {(r.root_cik, r.rating, line) for r in result.edges().collect() for line in ["|".join(str(r[c]) for c in edge_files.COLUMNS)]}
    texts = {n: [r.value for r in spark.read.text(f"{out}/{n}").collect()] for n in ("triage", "research", "summary")}
    path = result.compact("now")
    parts = sorted(Path(path).glob("part-*"))
    return files, texts, "".join(p.read_text() for p in parts), {r.cik for r in research.finished(spark, out).collect()}


def test_research_broken_off_and_taken_up_again(spark, tmp_path, monkeypatch):
    """A run that breaks off, after one batch and in the midst of the next, and is taken up again ends like one that doesn't."""
    chosen, filings, about = _research_inputs(spark, monkeypatch)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    research.run(spark, chosen, filings, about, whole, max_depth=1, made="now")

    own, calls = research.Output._commit, []

    def breaks(self, batch, facts):
        calls.append(batch)
        if len(calls) == 2:  # the edges are there, the commit isn't
            raise RuntimeError("lost")
        own(self, batch, facts)

    monkeypatch.setattr(research.Output, "_commit", breaks)
    with pytest.raises(RuntimeError):
        research.run(spark, chosen, filings, about, broken, max_depth=1, batches=2, made="now")
    n = research.finished(spark, broken).count()
    assert 0 < n < 5
    monkeypatch.setattr(research.Output, "_commit", own)
    research.run(spark, chosen, filings, about, broken, max_depth=1, made="now")
    assert _all_of(spark, whole) == _all_of(spark, broken)
    files, _, combined, done = _all_of(spark, broken)
    assert done == {"111111", "222222", "333333", "444444", "7"} and {r for r, _, _ in files} == done - {"7"}
    lines = combined.splitlines()
    assert lines.count("|".join(edge_files.COLUMNS)) == 1 and sum(not x.startswith("#") for x in lines) == 1 + len(files)
    assert "# Roots: 5" in lines


def test_a_root_run_again_replaces_its_edges(spark, tmp_path):
    out = research.Output(spark, str(tmp_path / "o"))
    row = lambda root, source: (root, 1, *[source if c == "source" else "x" for c in edge_files.COLUMNS])
    schema = "root_cik string, seq int, " + ", ".join(f"{c} string" for c in edge_files.COLUMNS)
    rated = lambda *r: spark.createDataFrame([(x, "HIGH", 1) for x in r], "root_cik string, rating string, at int")
    assert out.results() is None and out.edges().count() == 0 and research.finished(spark, out.base).count() == 0
    out.add(spark.createDataFrame([row("0011", "first"), row("22", "kept")], schema), rated("0011", "22"), "now", {"edges": 2})
    out.add(spark.createDataFrame([row("0011", "second")], schema), rated("0011"), "now", {"edges": 1})
    assert {(r.root_cik, r.source) for r in out.edges().collect()} == {("0011", "second"), ("22", "kept")}
    assert [b["edges"] for b in out.log()] == [2, 1]


def test_edge_files_of_large_roots_are_whole(spark, tmp_path):
    """A root with most edges lies in several parts; the first has the header, and no edge is taken for one."""
    n = 3000
    rows = spark.range(n).select(F.when(F.col("id") % 10 < 9, "big").otherwise(F.concat(F.lit("r"), F.col("id") % 5)).alias("root_cik"), F.lit("LOW").alias("rating"), F.col("id").alias("seq"), *[F.concat(F.lit(f"{c} "), "id").alias(c) for c in edge_files.COLUMNS])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows lie in one part
    edge_files.write_by_root(rows, str(tmp_path / "e"), ["seq"], "now")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = edge_files.read_by_root(spark, [str(tmp_path / "e")])
    assert got.count() == n and got.select("source").distinct().count() == n
    parts = sorted((tmp_path / "e" / "rating=LOW" / "root_cik=big").glob("part-*"))
    texts = [p.read_text() for p in parts]
    assert len(parts) > 1 and texts[0].startswith("# Generated: now\n# Root CIK: big\n") and sum(t.count("|".join(edge_files.COLUMNS)) for t in texts) == 1
    assert [x.split("|")[0] for t in texts for x in t.splitlines() if x.startswith("source ")] == [f"source {i}" for i in range(n) if i % 10 < 9]


def test_a_walk_from_a_hub(spark):
    """A root with 60,000 neighbours: they are ranked in several tasks, as a queue would, and the cap falls in their midst."""
    n = 60_000
    hub = spark.range(n).select(F.lit("hub").alias("parent"), F.concat(F.lit("n"), "id").alias("child"), F.xxhash64("id").alias("ord"))
    steps = hub.unionByName(spark.createDataFrame([("n7", "deep", 1), ("other", "n7", 1)], "parent string, child string, ord long"))
    roots = spark.createDataFrame([("hub",), ("other",)], "root string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    visited, met = graph.ranked_walk(steps, roots, 2, n - 5)
    rows = visited.filter("root = 'hub' and depth = 1").orderBy("rank").select("node", "rank").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [r.child for r in hub.orderBy("ord").limit(n - 6).collect()]
    assert [r.node for r in rows] == want and [r.rank for r in rows] == list(range(2, n - 4))
    assert {(r.node, r.depth, r.rank) for r in visited.filter("root = 'other'").collect()} == {("other", 0, 1), ("n7", 1, 2), ("deep", 2, 3)}
    assert met.filter("root = 'hub' and depth = 0").count() == n


def test_numbers_across_tasks(spark):
    """Ordinals of a group that lies in many tasks, and of many small groups."""
    df = spark.range(20_000).select(F.when(F.col("id") % 7 < 6, None).otherwise(F.col("id") % 50).alias("g"), F.xxhash64("id").alias("o")).repartition(8)
    got = order.numbered(df, ["o"], "n", ["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.n, r.o))
    for rows in by.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1)) and [o for _, o in rows] == sorted(o for _, o in rows)
    assert len(got) == 20_000 and order.numbered(df.limit(0), ["o"], "n").count() == 0
