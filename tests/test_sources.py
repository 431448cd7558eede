"""Readers and writers over small files."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tierwalk.operators import gaps, records
from tierwalk.operators import holdings as land
from tierwalk.sources import documents, edge_files, filings, holdings_files, state_filings, submissions, universe
from tierwalk.streaming import index


def row(adsh, cik, name="N", n="1", **more):
    values = {"adsh": adsh, "cik": cik, "name": name, "nciks": n} | more
    return "\t".join(values.get(f, "") for f in submissions.FIELDS)


def test_index_of_folders_and_archives(spark, tmp_path):
    head = "\t".join(submissions.FIELDS)
    (tmp_path / "2024q1_notes").mkdir()
    (tmp_path / "2024q1_notes" / "sub.tsv").write_text("\n" + "\n".join([head, row("1-1", " 11 ", '"Quoted', "x", aciks="12 13"), row("1-2", ""), "too\tshort", row("", "14"), row("", "15"), row("adsh-late", "16")]) + "\n")
    (tmp_path / "2024q1_notes" / "sub.txt").write_text(row("9-9", "99"))
    (tmp_path / "2024q2").mkdir()
    (tmp_path / "2024q2" / "sub.txt").write_text("\n".join([row("1-1", "21", "later"), row("2-1", "22", n="3")]))
    (tmp_path / "2024q3").mkdir()
    (tmp_path / "other").mkdir()
    with zipfile.ZipFile(tmp_path / "2024q4_notes.zip", "w") as z:
        z.writestr("in/sub.tsv", "\n".join([head, row("4-1", "41", "Zipped"), row("2-1", "42")]).encode() + b"\n\xff")
    (tmp_path / "2024q5.zip").write_bytes(b"no archive")
    got = submissions.read(spark, str(tmp_path)).collect()
    assert {(r.adsh, r.cik, r.name, r.nciks, r.source_period) for r in got} == {("1-1", "11", '"Quoted', 0, "2024q1"), ("", "14", "N", 1, "2024q1"), ("adsh-late", "16", "N", 1, "2024q1"), ("2-1", "22", "N", 3, "2024q2"), ("4-1", "41", "Zipped", 1, "2024q4")}
    assert [r.aciks for r in got if r.adsh == "1-1"] == ["12 13"]
    assert [r.adsh for r in sorted(got, key=lambda r: r.seq)] == ["1-1", "", "adsh-late", "2-1", "4-1"] and sorted(r.seq for r in got) == [1, 2, 3, 4, 5]
    assert records.best_record(submissions.read(spark, str(tmp_path))).count() == 5
    assert submissions.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("arrival", [(0, 1, 2, 3), (2, 0, 3, 1)])
def test_index_as_a_stream(spark, tmp_path, arrival):
    """Files in any order of arrival give the rows of the batch reader once a later period has come; nothing is held of what is done."""
    head = "\t".join(submissions.FIELDS)
    files = {
        "2023q4": [head, row("1-1", "10", "first"), row("1-9", "19")], "2024_01": ["", head, row("1-1", "11", "later"), row("1-1", "12"), row("1-2", "13"), row("adsh-x", "14")],
        "2024q1": [row("1-2", "23"), row("", "24"), row("1-3", "25")], "2024q2": [head, row("1-3", "33"), "short\tline", row("2-1", "", "no registrant"), row("2-2", "34")],
    }
    names, source = list(files), tmp_path / "in"

    def arrive(name, lines):
        (source / f"{name}_notes").mkdir(parents=True)
        (source / f"{name}_notes" / "sub.tsv").write_text("\n".join(lines) + "\n")
        q = index.submissions(spark, str(source / "*")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    for i in arrival:
        arrive(names[i], files[names[i]])
    want = {(r.adsh, r.cik, r.name, r.source_period) for r in submissions.read(spark, str(source)).collect()}
    arrive("2030q1", [head, row("9-9", "99")])
    q = arrive("2030q2", [head])
    got = [(r.adsh, r.cik, r.name, r.source_period) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want == {("1-1", "10", "first", "2023q4"), ("1-9", "19", "N", "2023q4"), ("1-2", "13", "N", "2024_01"), ("adsh-x", "14", "N", "2024_01"), ("", "24", "N", "2024q1"), ("1-3", "25", "N", "2024q1"), ("2-2", "34", "N", "2024q2")}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_times_of_periods(spark):
    rows = spark.createDataFrame([("2024q3",), ("2024_02",), ("2024-11",), ("other",)], "p string").select(index.period_date(F.col("p"), F.lit("2000-01-01").cast("timestamp")).cast("string").alias("t"))
    assert [r.t[:10] for r in rows.collect()] == ["2024-09-01", "2024-02-01", "2024-11-01", "2000-01-01"]


def test_gaps_under_inserts(spark, tmp_path):
    """After every batch the gaps are those of a whole analysis; a batch that is done again changes nothing; streams bring the same."""
    schema = "name string, state string, entity_type string, jurisdiction_of_formation string, registered_agent string, officers array<string>, formation_date string, seq int"
    rng = random.Random(3)
    words = ["ALPHA", "BETA", "GAMMA", "DELTA", "OMEGA"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    entity = lambda i: (name().title(), "DE", "LLC", "", None, [], "", i)
    follow, every, known = index.Gaps(spark, str(tmp_path / "g"), schema), [], []
    for batch in range(2):
        new, names = [entity(10 * batch + i) for i in range(6)] + [("", "DE", "LLC", "", None, [], "", 10 * batch + 9)], [name() for _ in range(2)] + ["AB"]
        every += new
        known += names
        for _ in range(1 + batch % 2):
            follow.add(batch, spark.createDataFrame(new, schema), spark.createDataFrame([(n,) for n in names], "name string"))
        want = gaps.gaps(spark.createDataFrame(every, schema), spark.createDataFrame([(n.upper(),) for n in known], "name string"))
        key = lambda df: sorted((r.seq, r.entity_name, r.risk_score) for r in df.collect())
        assert key(follow.now()) == key(want)
    spark.createDataFrame(every, schema).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(n,) for n in known], "name string").write.parquet(str(tmp_path / "f"))
    streamed = index.Gaps(spark, str(tmp_path / "s"), schema)
    streamed.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), spark.readStream.schema("name string").parquet(str(tmp_path / "f")), str(tmp_path / "c")).awaitTermination()
    assert key(streamed.now()) == key(want)


def test_recent_filings(spark, tmp_path):
    recent = {"form": ["10-K", "8-K", "10-K", "10-K"], "accessionNumber": ["1-1", "1-2", "1-3", "1-4"], "filingDate": ["d1", "d2", "d3", "d4"], "primaryDocument": ["a.htm", "b.htm", ""]}
    (tmp_path / "CIK0000000042.json").write_text(json.dumps({"name": "ACME", "filings": {"recent": recent}}))
    (tmp_path / "CIK0000000043.json").write_text(json.dumps({"name": None}))
    got = filings.recent(filings.submissions(spark, str(tmp_path)), ["10-K"], 5).orderBy("place")
    assert [(r.cik, r.company, r.accession, r.primary_doc) for r in got.collect()] == [("42", "ACME", "1-1", "a.htm"), ("42", "ACME", "1-3", "")]
    assert [(r.cik, r.n) for r in filings.fetch_plan(got).collect()] == [("42", 1)]
    urls = got.select(filings.address("x://h/", F.col("cik"), F.col("accession"), F.col("primary_doc")).alias("u")).collect()
    assert [r.u for r in urls] == ["x://h/42/11/a.htm", "x://h/42/13/1-3.txt"]
    content = spark.createDataFrame([("1-1", "text"), ("1-3", "")], "accession string, content string")
    assert [r.accession for r in filings.with_content(got, content).collect()] == ["1-1"]


def test_fetch_with_retries_and_cache(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def get(url):
        with open(seen, "a") as f:
            f.write(url + "\n")
        with open(seen) as f:
            n = f.read().split().count(url)
        return {"a": (200, b"A\xff"), "b": (429, b"") if n < 3 else (200, b"B"), "c": (404, b"")}[url]

    urls, cache = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "url string"), str(tmp_path / "cache")
    how = {"get": get, "pause": 0, "backoff": 0, "at_once": 2}
    for _ in range(2):
        assert {(r.url, r.content) for r in documents.complete(urls, cache, **how).collect()} == {("a", "A�"), ("b", "B"), ("c", None)}
    assert sorted(open(seen).read().split()) == ["a", "b", "b", "b", "c", "c"]
    data = documents.json_documents(spark.createDataFrame([('{"x": 1}',), ("no",)], "content string"), "x int").collect()
    assert [r.data.x if r.data else None for r in data] == [1, None]
    (tmp_path / "list.txt").write_text("1\n\n 2 # two\n")
    assert [r.cik for r in documents.registrant_list(spark, str(tmp_path / "list.txt")).collect()] == ["1", "2 # two"]
    name = spark.range(1).select(documents.cache_name(F.lit("/p" * 100), F.lit("u")).alias("n")).first()["n"]
    assert len(name) == 120 + 1 + 16


def test_universe(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"fields": ["cik"], "data": [[7, "China Fund", "CF", "NYSE"], [8, "Other", None, "OTC"]]}))
    got = universe.companies(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in got.orderBy("cik").collect()] == [("7", "China Fund", "CF", "NYSE"), ("8", "Other", "", "OTC")]
    assert universe.funds(spark, str(tmp_path / "c.json")).columns == ["cik", "series_id", "class_id", "symbol"]
    assert [(r.cik, r.term) for r in universe.named(got, ["CHINA", "zz"]).collect()] == [("7", "CHINA")]
    assert got.filter(universe.listed_on(F.col("exchange"), " nyse")).count() == 1
    twice = got.withColumn("seq", F.monotonically_increasing_id()).unionByName(got.filter("cik = '7'").withColumns({"ticker": F.lit("LAST"), "seq": F.lit(1 << 60)}))
    assert {r.cik: r.ticker for r in universe.by_cik(twice).collect()} == {"7": "LAST", "8": ""}
    assert universe.ciks(twice).count() == 2 and {r.exchange: r.n for r in universe.exchanges(got).collect()} == {"NYSE": 1, "OTC": 1}
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 1, "ticker": "A", "title": "Acme"}, "1": {"cik_str": 2, "ticker": "B", "title": "Bee"}, "2": {"cik_str": 3, "ticker": "C", "title": "ACME"}}))
    look = universe.ticker_lookup(spark, str(tmp_path / "t.json"), F.upper).orderBy("place")
    assert [tuple(r) for r in look.collect()] == [("ACME", 0, "3", "C", "ACME"), ("BEE", 1, "2", "B", "Bee")]


def test_edge_files(spark, tmp_path):
    cols = ("source", "target", "role_is_board", "notes")
    edges = spark.createDataFrame([(3, "#Third", "T", None, "x"), (1, "First|One", 'say "hi"', True, None), (2, None, "lost", False, "n")], "seq int, source string, target string, role_is_board boolean, notes string")
    out = str(tmp_path / "e")
    edge_files.write(edges, out, {"root": "42", "made": "a: b"}, ["seq"], cols)
    assert [tuple(r) for r in edge_files.read(spark, out, cols).collect()] == [("First/One", "say 'hi'", "Y", ""), ("#Third", "T", "", "x")]
    assert {(r.key, r.value) for r in edge_files.facts(spark, out).collect()} == {("root", "42"), ("made", "a: b")}
    (tmp_path / "HIGH_CIK12.csv").write_text("# a: b\nsource|target\nx|y\n#z|w\n")
    (tmp_path / "CIK13.csv").write_text("# a: c\nsource|target\n")
    many = edge_files.read(spark, str(tmp_path / "*.csv"), cols, one=False)
    assert sorted((r.source, r.target) for r in many.collect()) == [("#z", "w"), ("x", "y")]
    assert sorted(r.value for r in edge_files.facts(spark, str(tmp_path / "*.csv")).collect()) == ["b", "c"]
    assert [(r.file.rsplit("/", 1)[1], r.cik) for r in edge_files.completed(spark, str(tmp_path / "*.csv")).collect()] == [("HIGH_CIK12.csv", "12")]
    (tmp_path / "none.csv").write_text("# a: b\n")
    assert edge_files.read(spark, str(tmp_path / "none.csv"), cols).count() == 0
    rated = edges.withColumns({"root_cik": F.lit("7"), "rating": F.lit("HIGH")})
    edge_files.write_by_root(rated, str(tmp_path / "roots"), ["seq"], "now", columns=cols)
    assert [tuple(r) for r in edge_files.read(spark, str(tmp_path / "roots" / "rating=HIGH" / "root_cik=7"), cols).collect()] == [("First/One", "say 'hi'", "Y", ""), ("#Third", "T", "", "x")]
    assert edge_files.read_by_root(spark, [str(tmp_path / "roots")], cols).filter("source <> ''").count() == 2
    assert edge_files.combined([edges, edges]).count() == 6


def sheet(path, rows):
    words = sorted({c for r in rows for c in r if c})
    cells = lambda i, r: "".join(f'<c r="{chr(65 + j)}{i + 1}" t="s"><v>{words.index(c)}</v></c>' for j, c in enumerate(r) if c)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{w}</t></si>" for w in words) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(f'<row r="{i + 1}">{cells(i, r)}</row>' for i, r in enumerate(rows)) + "</sheetData></worksheet>")


def test_holdings_files(spark, tmp_path):
    rows = [["A title", ""], ["State", "County", "Country ", "Owner Name 1/", "Number of Acres"], ["TX", "Bell", "China", "Acme, LLC", "1,200"], ["", "", "", "", ""], ["IA", "Polk", "P.R.C.", "", "5"], ["IA", "", "Canada", "Maple", "7"]]
    sheet(tmp_path / "h.xlsx", rows)
    got = land.named(holdings_files.read(spark, str(tmp_path / "h.xlsx")))
    assert sorted((r.country, r.entity_name, r.acres, r.fips) for r in got.collect()) == [("Canada", "Maple", "7", ""), ("China", "Acme, LLC", "1,200", ""), ("P.R.C.", "", "5", "")]
    (tmp_path / "h.csv").write_text("﻿Country;Owner;Acres\nChina;\"A; B\";3\nIran;C;4\n", encoding="utf-8")
    rows = land.named(holdings_files.read(spark, str(tmp_path / "h.csv")))
    assert sorted((r.country, r.entity_name, r.acres) for r in rows.collect()) == [("China", "A; B", "3"), ("Iran", "C", "4")]
    assert holdings_files.header_row([["x"], ["state", "county of", "owner"]]) == 1 and holdings_files.header_row([["x"], ["y"]]) == 0


def test_state_filings(spark, tmp_path):
    text = "Entity Name: Blue Ranch LP\nType of Entity: LP\nStatus: Active\nDate Filed: 2020\nRegistered Agent: Jane Roe\nRegistered Office Address: 1 Main\nManagers:\nJohn B. Smith\nAmy Poe\n"
    bare = spark.createDataFrame([(text, "f"), ("x\nA longer first line\n", "g"), ("", "h")], "text string, source_file string")
    got = {r.source_file: r for r in state_filings.entities(bare).collect()}
    assert (got["f"].name, got["f"].entity_type, got["f"].formation_date, got["f"].registered_agent_address) == ("Blue Ranch LP", "LP", "2020", "1 Main")
    assert got["f"].officers[0].startswith("John B. Smith") and got["g"].name == "A longer first line" and got["h"].name == ""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.pdf", "two")
        z.writestr("a.pdf", "one")
        z.writestr("n.txt", "no")
    (tmp_path / "c.pdf").write_text("three")
    assert sorted(r.text for r in state_filings.texts(spark, str(tmp_path), lambda b: b.decode() or None).collect()) == ["one", "three", "two"]
