"""Small tests of what a reviewer found; each failed before its finding was mended."""

import numpy as np
from pyspark.sql import functions as F

from tierwalk.functions import owners, text
from tierwalk.functions.text import flag, sanitized
from tierwalk.llm import gru, webp
from tierwalk.sources import edge_files


def test_every_mention_of_a_registrant(spark):
    """the query's SQL tells a number as often as a filing names it."""
    raw = "CENTRAL INDEX KEY: 0000777777 /CIK0000888888.json CIK # 888888 CIK # 5555"
    row = spark.range(1).select(*[text.related_registrants(F.lit(raw), F.lit(raw), F.lit("0000888888-24-000001"), F.lit("5555"), distinct=d).alias(str(d)) for d in (True, False)]).first()
    assert row["True"] == ["777777", "888888"]
    assert row["False"] == ["777777", "888888", "888888", "888888"]


def test_lines_are_cleaned_as_fields_are(spark):
    """one pattern over a line, with the same lines as field by field; the code doesn't grow with the columns."""
    odd = ["plain", "", None, " a", "a ", "a  b", 'x|"y', "é", "\x01", "a\x01b", "a\n", "\n", "tab\there", "|", "~!"]
    rows = spark.createDataFrame([(a, b, b is None) for a in odd for b in odd], "a string, b string, f boolean")
    got = rows.select(edge_files.line(rows, ("a", "f", "b")).alias("got"), F.concat_ws("|", sanitized(F.col("a")), flag(F.col("f")), sanitized(F.col("b"))).alias("want"))
    assert [r for r in got.collect() if r.got != r.want] == []
    wide = spark.createDataFrame([tuple("x" for _ in edge_files.COLUMNS)], ", ".join(f"{c} string" for c in edge_files.COLUMNS))
    plan = wide.select(edge_files.line(wide).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 1


def test_filings_are_read_once_for_all_edges(spark):
    """people, institutions and countries come out of one pass over the texts."""
    from tierwalk.operators import report

    text_ = "John Q. Public, age 52, Director, of Acme Capital Partners LLC\n/s/ Jane Doe\n"
    rows = [(k, "7", "Issuer China", None, "a", "10-K", "2024-01-01", 0, text_, text_, text_, ["China"]) for k in range(3)]
    df = spark.createDataFrame(rows, "key long, cik string, issuer string, issuer_country string, accession string, form string, filing_date string, depth int, full_text string, signatures string, narrative string, countries array<string>")
    got = report.filing_edges(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    found = {(r.source, r.relationship, r.target, r.detail) for r in got.collect()}
    assert {("Jane Doe", "person_role", "Issuer China", "Director"), ("Issuer China", "country_association", "China", "")} <= found and any(r == "institution_role" for _, r, _, _ in found)


def test_rows_alike_are_worked_out_once(spark):
    """of equal rows of a batch one goes through Python, and nulls stay nulls."""
    from tierwalk.functions.dictionary import struct_udf

    def make(a, b):
        return None if a is None else (f"{a}{b}", float(len(a)), [a, None])

    df = spark.createDataFrame([("x", None), (None, "y"), ("x", "y"), ("x", "y"), ("zz", "y")] * 700, "a string, b string").coalesce(1)
    got = df.select("a", "b", struct_udf(make, "struct<s: string, n: double, l: array<string>>")("a", "b").alias("r")).collect()
    assert len(got) == 3500
    for r in got:
        assert tuple(r.r) == ((None, None, None) if r.a is None else (f"{r.a}{r.b}", float(len(r.a)), [r.a, None]))


def test_edges_are_dealt_once(spark):
    """without a key of many edges whole rows go through one exchange, and nothing but the list of such keys is written."""
    from tierwalk.operators import edges

    df = spark.createDataFrame([("a", 1, "x", 2), ("a", 2, "y", 1), ("a", 3, "x", 0), ("b", 4, None, 5), ("b", 5, "z", 4)], "k string, seq long, notes string, chain_depth int")
    for segment in (1, 2, 1000):
        got = edges.merged(df, ("k",), segment=segment)
        assert sorted(map(tuple, got.collect())) == [("a", 1, "x; y", 1), ("b", 4, "z", 4)]
    plan = edges.merged(df, ("k",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Relation" not in plan


def test_names_of_few_letters_meet_seldom(spark):
    """names over a small alphabet meet by halves with characters left out; none that counts is lost."""
    import random
    from difflib import SequenceMatcher

    from tierwalk.operators import linkage

    rng = random.Random(5)
    name = lambda: "".join(rng.choice("AEIOURSTLNMCDPBG") for _ in range(7)) + " " + "".join(rng.choice("AEIOURSTLNMCDPBG") for _ in range(9))
    right = [name() for _ in range(300)]
    left = sorted({name() for _ in range(200)} | {r[:4] + "X" + r[5:] for r in right[:50]} | {r[:15] for r in right[50:100]})
    df = lambda x: spark.createDataFrame([(n,) for n in x], "_k string")
    got = {(r._k, r._o) for r in linkage.near(df(left), df(right), 0.8).collect()}
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert len(want) >= 100 and want <= got and len(got) < 0.005 * len(left) * len(right)


def test_registrants_are_never_broadcast(spark):
    """F1 of round 4: lookups look small as files; joined by broadcast they take the driver's memory."""
    from tierwalk.operators import linkage

    lookup = spark.createDataFrame([("ACME", 1, "1", "Acme", "A"), ("BETTER BANK", 2, "2", "Better Bank", "B"), ("BETTER BANK", 3, "3", "Better Bank", "C")], "key string, place int, cik string, title string, ticker string")
    left = spark.createDataFrame([("Acme, LLC",), ("Bettor Bank",), ("Zebra",), (None,), ("a name that is rather longer than most names are",)], "n string")
    got = linkage.fuzzy(left, lookup, "n")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.n, r.cik, r.match_type) for r in got.collect()} == {("Acme, LLC", "1", "exact"), ("Bettor Bank", "2", "fuzzy"), ("Zebra", "", "none"), (None, "", "none"), ("a name that is rather longer than most names are", "", "none")}


def test_filings_are_dealt_to_all_tasks(spark):
    """F2 of round 4: texts are made in all tasks, however few the file of orders has, and rows of names don't carry the text."""
    from tierwalk.dims import tables
    from tierwalk.operators import report
    from tierwalk.plans import proxies

    assert proxies.filings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.createDataFrame([(1, "10-K", "Jane Doe, Director", "/s/ Jane Doe\n", "Mary Roe, President", ["China"])], "key int, form string, full_text string, signatures string, narrative string, countries array<string>")
    named = report._named(df, tables.DEFAULT)
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate explode" in x)
    assert "full_text" not in generate.rsplit("[", 2)[1]
    assert ("Jane Doe", "Director") in {(r.name, r.role and r.role.role) for r in named.collect()}


def test_patterns_in_any_case():
    """F2 of round 4: ASCII texts are searched in lower case, others by folding, with the same matches."""
    import re

    from tierwalk.functions import scanning

    pattern = r"(?:director|chief)\s*[:,]+"
    for t in ("DIRECTOR: x, Chief , y", "D\u0131rector: Chief:", "\u0130\u0130 director: chieF,", "", "no match"):
        assert [m.span() for m in scanning.AnyCase(pattern).finditer(t)] == [m.span() for m in re.finditer(pattern, t, re.I)]


def test_copies_in_an_image_run_into_themselves():
    """A copy that is longer than its distance repeats what it has; prefixes are looked up up to the longest copy."""
    out = np.array([1, 2, 3, 0, 0, 0, 0, 0, 0, 0], np.uint32)
    webp._copy(out, np.array([3, 8]), np.array([5, 2]), np.array([2, 7]))
    assert out.tolist() == [1, 2, 3, 2, 3, 2, 3, 2, 2, 3]
    value = np.arange(1, webp.MOST_LENGTH + 1)
    assert all((a == b).all() for a, b in zip(webp.prefixes(value), webp._prefixes(value), strict=True))
    assert [webp._few_codes(x) for x in ([0, 2, 1, 2], [0, 1, 0])] == [webp.codes_of(np.array(x)).tolist() for x in ([0, 2, 1, 2], [0, 1, 0])]


def test_every_training_document_is_learnt_from(spark, monkeypatch):
    """the network's pass reads all training rows, not one in eight."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    read, pass_over = [], gru._pass_over
    monkeypatch.setattr(gru, "_pass_over", lambda model, rows, work, name: read.append(rows.count()) or pass_over(model, rows, work, name))
    assert gru.score(docs).count() == 60
    assert read == [docs.filter(~gru.held_out()).count()] * gru.EPOCHS


def test_owners_are_read_once(spark):
    """one Python worker a task, not one that leaves filings without names out and one that reads the rest again."""
    pages = spark.createDataFrame([(1, "NAME OF REPORTING PERSON\nAlpha Fund LP\nPERCENT OF CLASS: 7.5%\n"), (2, "no cover page"), (3, None)], "key int, full_text string")
    got = owners.owners(pages)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.key, r.ord, r.owner, r.percent) for r in got.collect()] == [(1, 0, "Alpha Fund LP", 7.5)]
