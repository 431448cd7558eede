"""Extraction from texts and first matches in tables."""

import pickle
import random
import re
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierwalk.dims import tables
from tierwalk.functions import dictionary, filing_text, lookup, names, owners, scanning, subsidiaries, text
from tierwalk.operators import edges, targets


def one(spark, column, *values, schema=None):
    """What a column function makes of each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_sections(spark):
    raw = "<p>SIGNATURES</p>Ann Lee &amp; Co<br>EXHIBIT 1<pre>x</pre>"
    rows = filing_text.sections(spark.createDataFrame([(1, raw), (2, None), (3, "MANAGEMENT " + "y" * 30000 + " China and PRC\r\n\r\n\r\n\r\nend é")], "k int, content string"))
    got = {r.k: r for r in rows.collect()}
    assert (got[1].full_text, got[1].signatures) == ("SIGNATURES\nAnn Lee & Co\nEXHIBIT 1\nx", "Ann Lee & Co")
    assert (got[2].full_text, got[2].signatures, got[2].narrative, got[2].countries) == ("", "", "", [])
    assert len(got[3].narrative) == 20000 and got[3].countries == ["China", "PRC"] and got[3].full_text.endswith("PRC\n\nend")


def test_signers(spark):
    got = one(spark, names.signers, "/s/ Long WanChairmanMarch 24, 2026", "/s/ Ann B. Poe\nBy: ann b. poe\nBy: Ann B. Poe\nBy: Carl Ray, Esq", "/s/ Acme Holdings LLC", None, "/s/ X2 Y", "/s/ Jo Fitz Iii\n")
    assert got == [["Long Wan"], ["Ann B. Poe"], [], [], [], ["Jo Fitz Iii"]]


def test_people_and_long_capital_runs(spark):
    got = one(spark, names.people_in, "Alice M. Johnson, age 52, has served; Bob Lee, Director; President: Carol Day", "Aaaa " * 20000, "nothing here")
    assert got[0][:2] == ["Alice M. Johnson", "Bob Lee"] and "Carol Day" in got[0]
    assert got[1:] == [[], []]


# the pattern as a whole; it is quadratic, so short texts only
_whole = re.compile(r"\b([A-Z][A-Za-z0-9&.,'()\- ]+?\s(?:" + "|".join(map(re.escape, names.COMPANY_ENDS)) + r")(?:\b|$))", re.I)


def plain_institutions(t):
    out = [m.strip() for m in _whole.findall(t)]
    return list(dict.fromkeys(m for m in out if 5 <= len(m) <= 80 and not m[0].islower() and not m.lower().startswith(names.SENTENCE_STARTS)))


def test_institutions_like_the_whole_pattern(spark):
    texts = ["The Fund; ABC Capital Partners LP and XYZ Asset Management Co., Ltd.\nof Bank", "see Foo Inc. x", "A Co", "Acme\nTrust", "One Two Three LLCX Four LLC", "a b" * 200, "X (Y) & Z-Bank Group Corp."]
    word = st.sampled_from(["Acme", "of", "Capital", "LP", "Inc.", "Co", "the", "(x)", "Trust\n", ";", "B&B", "Asset", "Management", "Group", "L.P.", "9", "-"])

    @given(st.lists(word, max_size=14).map(" ".join))
    @settings(max_examples=300, deadline=None)
    def collect(t):
        texts.append(t)

    collect()
    assert one(spark, names.institutions_in, *texts) == [plain_institutions(t) for t in texts]
    assert one(spark, names.institutions_in, "Word " * 40000)[0] == []


WORD, ANY, SPACE_SIGNS = "[A-Z][a-z]+", "[A-Za-z]{2,}", r"\s*[,\-—–]+\s*"
NAME = rf"{WORD}(?: [A-Z]\.?)? (?:{WORD} ?)+".replace(" ", r"\s")
WORDS = rf"{ANY}(?: [A-Za-z]\.?)? (?:{ANY} ?){{1,3}}".replace(" ", r"\s")


def plain_scans():
    """Whole patterns, which need a stack or time that grows with a text: for short texts only."""
    titles = "|".join(map(re.escape, names.TITLES))
    stops = "|".join([*map(re.escape, names.AFTER_NAMES), r"\n", r"\r", r"\(", "$"])
    found = lambda pattern, t: [m[1] for m in re.finditer(pattern, t)]
    return {
        "names": lambda t: found(rf"({NAME})", t), "aged": lambda t: found(rf"({NAME})\s*,\s*(?:(?:age|Age|AGE)\s+)?[0-9]{{2}}\s*[,.]", t),
        "before": lambda t: found(rf"({WORDS}){SPACE_SIGNS}(?i:{titles})", t), "after": lambda t: found(rf"(?i:{titles})\s*[:\-—–]+\s*({WORDS})", t),
        "signed": lambda t: found(rf"/s/\s*([A-Z][A-Za-z.\-' ]{{2,50}}?)(?={stops})", t), "by": lambda t: found(rf"By:\s*/?s?/?\s*([A-Z][A-Za-z.\-' ]{{2,50}}?)(?={stops})", t),
    }


def own_scans():
    return {
        "names": scanning.names_in, "aged": scanning.aged, "before": lambda t: scanning.before_titles(t, names._then_title), "after": lambda t: scanning.after_titles(t, names._title_then),
        "signed": lambda t: scanning.signed(t, names._mark, names._stop), "by": lambda t: scanning.signed(t, names._by, names._stop),
    }


@pytest.mark.parametrize("what", sorted(plain_scans()))
def test_scans_like_whole_patterns(what):
    own, plain = own_scans()[what], plain_scans()[what]
    parts = ["Ann", "Bo", "B.", "C", "d", "Poe", "McRay", "x", " ", " ", " ", "  ", ",", ", ", "age ", "45", "7", ".", "-", "—", "\n", "Director", "vice president", "Chairman", ":", ": ", "/s/", "/s/ ", "By:", "By: ", "s/", "(", "O'Neil", "March", "éa"]
    rng = random.Random(what)
    for n in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(3 + n % 22)))
        assert [x.strip() for x in own(t)] == [x.strip() for x in plain(t)], t


def test_long_runs_are_linear():
    took = []
    for n in (20_000, 160_000):
        start = time.process_time()
        for t in ("Word " * (n // 5), "Aa" * (n // 2), "A. " * (n // 3), "/s/ " * (n // 4), "Ann, " * (n // 5), "By:" + " " * n, "director: " * (n // 10), "NAME OF REPORTING PERSON" + "\n" * n):
            for f in (*own_scans().values(), owners.page):
                f(t)
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0] + 1


def test_kinds_and_names(spark):
    assert one(spark, names.kind_of, " Acme  Bank ", "Ann B. Poe", "Ann  Poe", "ann poe", "", None) == ["institution", "person", "person", "unknown", "unknown", "unknown"]
    assert one(spark, names.is_person_name, "Ann Poe", "Ann", "A Poe", "Ann Poe Inc", "Ann 2 Poe", "Al X Iii", "Ann O'Neil-Day.") == [True, False, False, False, False, False, True]
    rng = random.Random(9)
    some = ["".join(rng.choice(["Ann", "B.", "Poe", " ", "  ", "Inc", "co", ".", ",", "X", "iii", "-", "é", "'", "9"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    assert one(spark, names.is_person_name, *some) == [names.person_name(n) for n in some]
    assert one(spark, lambda c: names.clean_person(c, ("mr",), ("officer",)), "Name: Ann  Poe,", "Ann Poe Name", "Mr Poe", "Chief Officer", "Ann", None) == ["Ann Poe", "Ann Poe", "", "", "", ""]
    assert one(spark, lambda c: names.wide_kind_of(c, ("holdings", "institute")), "Ministry of X", "Y Institute", "Z Holdings", "Ann Poe", "q", None) == ["government", "institution", "organization", "person", "unknown", "unknown"]


def test_owners(spark):
    page = "NAME OF REPORTING PERSON\n{}\nI.R.S. IDENTIFICATION NO\nPERCENT OF CLASS: {}%\n"
    texts = [
        page.format("Alpha Fund LP - 12-3456789", "5.5") + page.format("CHECK THE APPROPRIATE BOX", "x") + page.format("2. Beta, Inc.", "12") + "TITLE OF CLASS OF SECURITIES\nCommon\nNAME OF ISSUER: Acme\n",
        page.format("1,234,567", "1"), "", page.format("Alpha Fund LP", "7") + page.format("Alpha Fund LP", "8"),
    ]
    rows = owners.owners(spark.createDataFrame(list(enumerate(texts)), "k int, full_text string")).orderBy("k", "ord").collect()
    assert [(r.k, r.owner, r.percent, r.class_title, r.owner_notes) for r in rows] == [(0, "Alpha Fund LP", 5.5, "Common", "issuer: Acme"), (0, "Beta, Inc", 12.0, "Common", "issuer: Acme"), (3, "Alpha Fund LP", 7.0, None, None)]


def test_subsidiaries(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    contents = [
        "<table>" + row("Name of Subsidiary", "State") + row("• Acme (1)", "DE.") + row("Beta", "X", "wholly-owned") + row("Page", "3") + row("Gamma  -  Nevada") + row("ab", "DE") + row("", "") + "</table>",
        "<table>" + row("lead") + row("First", "NY", "1100%") + "</table>", "Name of Subsidiary    Jurisdiction\nAcme Unit     Ohio      51.5%\n-----\n12\nno columns here",
        "<p>Name of Subsidiary</p>Acme&nbsp;One<br>", "<table><tr><td><table>" + row("In ner", "TX") + "</table></td></tr></table>", None, "Acme     Ohio",
    ]
    got = subsidiaries.subsidiaries(spark.createDataFrame(list(enumerate(contents)), "k int, content string")).orderBy("k", "ord").collect()
    assert [(r.k, r.name, r.jurisdiction, r.ownership_pct) for r in got] == [
        (0, "Acme", "Delaware", None), (0, "Beta", "X", 100.0), (0, "Gamma", "Nevada", None), (1, "First", "New York", 100.0), (2, "Acme Unit", "Ohio", 51.5), (4, "In nerTX", "In ner", None), (4, "In ner", "Texas", None), (4, "In ner", "Texas", None),
    ]
    assert one(spark, subsidiaries.share, "150%", "12.5 % owned", "Wholly Owned", "0%", "x") == [None, 12.5, 100.0, None, None]
    page = "<tr><td>1</td><td>d</td><td><a href='/ix?doc=/a/b.htm'>b</a></td><td> ex-21.1 </td></tr>"
    pages = spark.createDataFrame([(1, page), (2, "<tr><td>1</td><td>EX-21 list</td><td><a href=/c.htm>c</a></td></tr>"), (3, "none")], "k int, html string")
    assert [r.list_url for r in subsidiaries.list_address(pages, base="x://h").orderBy("k").collect()] == ["x://h/a/b.htm", "x://h/c.htm", None]


def test_registrants(spark):
    assert one(spark, text.registrants_in, "CIK 0000123456 and CIK: 987654. 1999", "/CIK0000012345.json cik#12345", None) == [["123456", "987654"], ["12345"], []]
    assert one(spark, text.filer_of, "0000921895-13-001960", "x") == ["921895", None]
    got = spark.range(1).select(text.related_registrants(F.lit("CENTRAL INDEX KEY: 0000777777\nCIK 888888 CIK 5555"), F.lit("CIK 888888 CIK 5555"), F.lit("0000999999-24-000001"), F.lit("5555")).alias("x")).first()["x"]
    assert got == ["777777", "888888", "999999"]


def test_bare_names_and_codes(spark):
    assert one(spark, text.bare_name, "acme co., ltd.", "Acme Inc. LLC", "Acme, LLC INC", " x co ") == ["ACME", "ACME", "ACME, LLC", "X"]
    assert one(spark, text.county_code, "48.0", "123456", None) == ["00048", "123456", None]
    assert one(spark, text.amount, "$1,200.5 ac", "1.2.3", None) == [1200.5, 0.0, 0.0]
    assert one(spark, text.country_key, " P.R.C. ", None) == ["prc", ""]


@pytest.mark.parametrize(("name", "country", "tier"), [("New Jersey Water", "Jersey", "OPACITY"), ("Indiana Steel", "India", "STANDARD"), ("Roman Holdings of Tirana", "Iran", "ADVERSARIAL"), ("CURAÇAO Trust", "Curacao", "OPACITY"), ("XJ-129 Special Vehicle", None, None), ("", None, None)])
def test_jurisdictions(spark, name, country, tier):
    got = one(spark, lookup.jurisdiction, name)[0]
    assert (got and (got["country"], got["tier"])) == (country and (country, tier))


def test_jurisdiction_override_context_and_tiers(spark):
    rows = spark.createDataFrame([("Acme", "Delaware", None), ("Acme", "", "made in beijing, China"), (None, None, "China")], "n string, o string, c string")
    got = [r["j"] for r in rows.select(lookup.jurisdiction(F.col("n"), F.col("o"), F.col("c")).alias("j")).collect()]
    assert [g and tuple(g) for g in got] == [("Delaware", "MONITORED", None), ("China", "ADVERSARIAL", "beijing"), None]
    assert one(spark, lookup.tier_of, "China", "US", None) == ["ADVERSARIAL", "MONITORED", "MONITORED"]


def test_affiliations(spark):
    rows = spark.createDataFrame([("PJSC Gazprom", None), ("PJSC Gazprom", "France"), ("Sinopec", "Hong Kong"), ("Mansudae", "France"), ("Kingston", None), ("A Nominee of Bearer Share", None), ("China Investment Corporation", None), (None, None)], "n string, c string")
    got = [tuple(r["a"])[:3] for r in rows.select(lookup.affiliation(F.col("n"), F.col("c")).alias("a")).collect()]
    assert got == [("State-Linked", "Russia", "Matched Russia state keywords"), ("None", None, None), ("SOE", "PRC", "Matched PRC SOE keywords"), ("State-Linked", "DPRK", "Matched DPRK keywords"), ("PEP", None, "Matched PEP keywords"), ("Shell-Proxy", None, "Matched shell/proxy keyword: nominee"), ("SWF", None, "Matched sovereign wealth fund keywords"), ("None", None, None)]


def test_roles(spark):
    pad = "z " * 150
    rows = spark.createDataFrame([("Ann Poe", "Ann Poe, Vice Chairman"), ("Ann Poe", "president " + pad + "ann poe, CFO of it"), ("Bo Ray", "chief executive officer"), ("Ann Poe", "Ann Poe, back-officers"), ("Ann Poe", "Ann Poe, nominee shareholder"), ("Ann Poe", ""), (None, "CEO")], "n string, c string")
    got = [r["r"] for r in rows.select(lookup.role(F.col("n"), F.col("c")).alias("r")).collect()]
    assert [(g["role"], g["confidence"]) for g in got] == [("Chairman", 0.9), ("CFO", 0.9), ("CEO", 0.9), ("Officer", 0.5), ("Nominee", 0.9), ("Unknown", 0.0), ("Unknown", 0.0)]
    assert got[4]["obscuring"] and got[1]["executive"] and got[0]["board"] and got[3]["executive"]


def test_matcher_like_a_plain_search():
    rng = random.Random(2)
    for _ in range(300):
        tokens = ["".join(rng.choice("ab _é") for _ in range(rng.randrange(4))) for _ in range(6)]
        t = "".join(rng.choice("ab _é") for _ in range(rng.randrange(12)))
        m = pickle.loads(pickle.dumps(dictionary.Matcher(tokens)))
        assert m.first(t) == {i: t.find(x) for i, x in enumerate(tokens) if x and x in t}
        words = {i: h.start() for i, x in enumerate(tokens) if x and (h := re.search(rf"\b{re.escape(x)}\b", t))}
        assert m.first(t, words=True) == words
    assert dictionary.first_entry([2, 1, 1], {0: 0, 1: 7, 2: 3}) == (1, 2, 3) and dictionary.first_entry([], {}) is None


@pytest.mark.parametrize("limit", [100, 3])
def test_find_by_automaton_and_by_join(spark, limit):
    """A table beyond the bound stays a DataFrame and gives the same rows."""
    texts = spark.createDataFrame([(1, "The Red fox and the BLUE fox"), (2, "nothing"), (3, None), (4, ""), (5, "blue red"), (6, "foxglove")], "id int, text string")
    table = spark.createDataFrame([("red", 2), ("Blue", 1), ("fox", 2), ("blue", 5), ("", 0), (None, 0), ("gl", 9)], "token string, entry int")
    got = sorted(tuple(r) for r in dictionary.find(texts, table, "id", limit=limit).collect())
    assert got == [(1, 1, "blue", 21, 3), (5, 1, "blue", 1, 2), (6, 2, "fox", 1, 2)]


def test_tables_from_a_folder(spark, tmp_path):
    (tmp_path / "jurisdictions.csv").write_text("tier,country,token\nCONDUIT,Freedonia,Freedonia\nOPACITY,Sylvania,Sylvan\nCONDUIT,Freedonia,Fredville\n")
    (tmp_path / "affiliations.csv").write_text('category,sub,detail,confidence,gate,keyword\nSOE,F,Matched: {},0.9,Freedonia;Sylvania,Duck Works\nPEP,,Said,0.5,,general\n')
    (tmp_path / "roles.csv").write_text("role,phrase\nFirefly,fire fly\nDirector,director\n")
    (tmp_path / "terms.csv").write_text("country,kind,term\nFreedonia,country_names,Freedonia\nFreedonia,city_names,Fredville\n")
    known = tables.Tables.load(spark, str(tmp_path))
    assert known.jurisdictions[0] == tables.Jurisdiction("Freedonia", "CONDUIT", ("Freedonia", "Fredville")) and known.expansions == {"freedonia": {"country_names": ("Freedonia",), "city_names": ("Fredville",)}}
    row = ("Bo of DUCK WORKS", None, "Fredville Sylvan Ltd", None, "a", "10-K", "", 0, 1)
    people = spark.createDataFrame([row], "name string, x string, issuer string, issuer_country string, accession string, form string, filing_date string, depth int, seq int")
    got = edges.role_edges(people.withColumn("role", lookup.role(F.col("name"), F.lit("the Fire Fly"), known.roles)), known=known).first()
    assert (got.target_jurisdiction, got.target_risk_tier, got.state_affiliation, got.state_affiliation_detail, got.detail) == ("Freedonia", "CONDUIT", "SOE", "Matched: duck works", "Firefly")
    assert [r.term for r in targets.terms(spark, ["freedonia"], expansions=known.expansions).orderBy("ord").collect()] == ["Freedonia", "Fredville"]
    assert tables.Tables.load(spark, str(tmp_path / "none")) == tables.DEFAULT
    (tmp_path / "terms.csv").write_text("country,kind,term\nX,colours,red\n")
    with pytest.raises(ValueError, match="colours"):
        tables.Tables.load(spark, str(tmp_path))
    (tmp_path / "terms.csv").write_text("country,term\nX,red\n")
    with pytest.raises(ValueError, match="kind"):
        tables.Tables.load(spark, str(tmp_path))


def test_search_terms():
    assert lookup.canonical(" PRC ") == "china" and lookup.canonical("acme") is None and lookup.search_terms("acme") == ["acme"]
    assert "China" in lookup.search_terms("chinese") and "PRC" not in lookup.search_terms("china") and "PRC" in lookup.search_terms_by_kind("china")["country_names"]
    assert {c for c in string.ascii_lowercase} and lookup.search_terms_by_kind("acme") == {"raw_keyword": ["acme"]}


def test_sectors(spark):
    assert one(spark, lookup.sectors, " 3674 ", "2910", "--", None) == [["Semiconductors & Electronics"], ["Chemicals & Petrochemicals", "Energy & Utilities"], [], []]
    assert set(tables.TIERS) == {"ADVERSARIAL", "CONDUIT", "OPACITY", "MONITORED", "STANDARD"}


def test_tables_from_a_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("country,token,ord\nX,b,2\nX,a,1\nY,c,3\n")
    assert tables.read(spark, str(tmp_path / "t.csv"), "country", "token", "ord") == {"X": ("a", "b"), "Y": ("c",)}
