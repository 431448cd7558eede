"""Null and repeated ids, ties, long texts, clashing columns; and plain versions of matching, ranks and chunks."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tierwalk.llm import bpe, chunks, decontaminate, exact_dedup, gru, linkgraph, ngram_join, sharding, tokenstore, toxicity
from tierwalk.llm.common import Work

#: Names that operators use inside, as columns of the input.
SCHEMA = "text string, doc_id long, row long, uid long, grp string, sig binary, gram long, n long, held_out boolean, score double, shard int, word long, keep_id long, part int, start int"
LONG = " ".join(np.random.default_rng(11).choice([f"word{i}" for i in range(3000)], 300_000))
ROWS = [(None, 1), ("", 2), ("a tie", 3), ("a tie", 4), ("a tie", 4), ("no id", None), ("no id", None), ("other", None), (LONG, 5), (LONG + " end", 6), ("x y", 7), ("z", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(t, d, 1, 2, "g", b"s", 3, 4, True, 0.5, 6, 7, 8, 9, 10) for t, d in ROWS], SCHEMA).repartition(3)


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def of_rows(f):
    return Counter((d, *f(t or "")) for t, d in ROWS)


def test_token_files(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, out = tokenstore.tokenizer(path), Work(spark, "t").path("f")
    tokenstore.write(docs, out, path)
    got = tokenstore.read(spark, out)

    def plain(t):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert counted(got, "doc_id", "n_tokens", "ids_crc32") == of_rows(plain)
    # starts are gapless, ids ascend, nulls come first
    rows = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect())
    assert [r[0] for r in rows] == [0, *itertools.accumulate(r[1] for r in rows)][:-1]
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)


def test_tokens_of_many_rows_without_ids(spark):
    """Rows without ids, alike or not, are dealt to several tasks; starts stay gapless and ids ascend."""
    docs = spark.range(4000).select(F.when(F.col("id") % 40 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text")).repartition(8)
    out = Work(spark, "t").path("f")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tokenstore.write(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["n"] for r in spark.read.parquet(out).groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert len(parts) > 2 and max(parts) < 3000
    rows = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in tokenstore.read(spark, out).collect())
    assert len(rows) == 4000 and [r[0] for r in rows] == [0, *itertools.accumulate(r[1] for r in rows)][:-1]
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)


def test_byte_bpe(docs):
    got = bpe.roundtrip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert counted(got, "doc_id", "decoded_sha256") == of_rows(lambda t: (hashlib.sha256(t.encode()).hexdigest(),))
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert Counter(len(r["token_ids"]) for r in ids.collect()) == Counter(r["n_tokens"] for r in got.collect())


def test_toxicity(spark, docs):
    lexicon = toxicity.Lexicon({" tie ": 3.0})
    got = toxicity.scored(docs, lexicon)
    assert counted(got, "doc_id", "score") == of_rows(lambda t: (lexicon.score(t),))
    assert toxicity.accept(docs, lexicon).columns == docs.columns
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).weights


def test_matches_like_a_plain_matcher():
    rng = random.Random(2)
    for _ in range(150):
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))  # noqa: B023, E731
        text = toxicity.fold(" ".join(word() for _ in range(rng.randrange(12))))
        weights = {rng.choice([f" {w} ", f" {w}"]): rng.random() for w in {word() for _ in range(5)}}
        exceptions = {f"{word()} {word()}" for _ in range(3)}
        safe = [(i, i + len(e) + 1) for e in exceptions for i in range(len(text)) if text.startswith(f" {e} ", i)]
        want = []
        for i in range(len(text)):
            fits = [p for p in weights if text.startswith(p, i)]
            if fits:
                p = max(fits, key=len)
                if not any(a <= i and i + len(p) - 1 <= b for a, b in safe):
                    want.append((i, i + len(p), weights[p]))
        assert toxicity.Lexicon(weights, tuple(exceptions)).matches(text) == want
    assert toxicity.fold("ІDІОT 1D10T! (a$$), x²") == " idiot idiot ass x2 "


def test_shards(docs):
    got = sharding.propagate(docs, 8).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == of_rows(lambda t: (len(t.encode()) + 1,))
    n = Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n.get(s, 0) for s in range(8)) <= 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(ROWS)


def test_scores(docs):
    got = gru.score(docs)
    assert counted(got, "doc_id", "n_tokens") == of_rows(lambda t: (len(t.split()) + 1,))
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got.collect())


def test_exact_copies(docs):
    groups = defaultdict(list)
    for t, d in ROWS:
        groups[t or ""].append(d)
    got = exact_dedup.duplicates(docs, keep="largest")
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    assert counted(got, "doc_id", "keep_id", "group_size", "kept") == Counter((d, best[t or ""], len(groups[t or ""]), d == best[t or ""]) for t, d in ROWS)
    small = exact_dedup.duplicates(docs)
    assert counted(small, "keep_id") == Counter((min((d for d in groups[t or ""] if d is not None), default=None),) for t, _ in ROWS)


def test_near_copies(docs):
    got = ngram_join.jaccard_components(docs, 4, 85)
    names = {LONG: 5, LONG + " end": 5, "a tie": 3}
    assert counted(got, "doc_id", "component_id") == Counter((d, names.get(t, d)) for t, d in ROWS)


def test_windows_blocks_and_longest_matches(spark, docs, monkeypatch):
    words = LONG.split()
    items = [(1, " ".join(words[100:140])), (2, "lead " + " ".join(words[105:130]) + " tail"), (3, "a tie"), (4, None), (5, " ".join(words[500:512])), (6, "no")]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id int, text string, row long, doc_id long")
    one = decontaminate.hits(docs, bench, 10).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    monkeypatch.setattr(decontaminate, "PAIRS", 3)
    many = decontaminate.hits(docs, bench, 10).collect()
    key = lambda r: repr((r["doc_id"], r["n_words"], r["items"]))
    assert [(r["doc_id"], r["items"], r["longest"]) for r in sorted(one, key=key)] == [(r["doc_id"], r["items"], r["longest"]) for r in sorted(many, key=key)]
    by = defaultdict(list)
    for r in one:
        by[r["doc_id"]].append(r)
    assert by[5][0]["items"] == ["1", "2", "5"] and tuple(by[5][0]["longest"]) == (40, 100, "1", 0)
    assert [(s["start"], s["end"]) for s in by[5][0]["spans"]] == [(100, 140), (500, 512)]
    assert by[3][0]["items"] == ["3"] and tuple(by[3][0]["longest"]) == (2, 0, "3", 0)
    assert sorted(str(r["items"]) for r in by[None]) == ["['6']", "['6']", "[]"]
    kept = decontaminate.clean(docs, bench, 10)
    assert kept.columns == docs.columns
    assert counted(kept, "doc_id", "text") == Counter((d, t) for t, d in ROWS if t not in ("a tie", "no id", LONG, LONG + " end"))


def test_chunks_like_a_plain_table(spark, docs):
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(map(str, rng.integers(0, 10**5, n)))
    shared = [word(60), word(12), word(200)]
    texts = [word(20) + shared[i % 3] + word(int(rng.integers(1, 40))) + shared[(i + 1) % 3] for i in range(12)] + [shared[0], "", "short"]
    own = spark.createDataFrame([(t, i, 1, 2, "g", b"s", 3, 4, True, 0.5, 6, 7, 8, 9, 10) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    table = defaultdict(list)
    cut = {}
    for i, t in enumerate(texts):
        data, ends = t.encode(), chunks.cuts(t.encode())
        cut[i] = [(a, b, xxhash.xxh3_128_digest(data[a:b])) for a, b in zip([0, *ends], ends)]
        for a, _, d in cut[i]:
            table[d].append((i, a))
    got = {r["doc_id"]: r for r in chunks.repeats(own).collect()}
    for i, t in enumerate(texts):
        runs, here = [], []
        for c in [*cut[i], None]:
            if c and len(table[c[2]]) > 1:
                here.append(c)
            elif here:
                runs.append(here)
                here = []
        runs = [r for r in runs if r[-1][1] - r[0][0] >= chunks.LEAST_RUN]
        spans = []
        for r in runs:
            last = None
            for a, b, d in r:
                if min(table[d]) != (i, a):
                    if last is not None and last == a:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
                    last = b
        r = got[i]
        assert (r["n_chunks"], r["n_repeated"], r["n_bytes"]) == (len(cut[i]), sum(map(len, runs)), len(t.encode()))
        assert [[s["start"], s["end"]] for s in r["spans"]] == spans
    assert any(r["spans"] for r in got.values())
    assert counted(chunks.repeats(docs), "doc_id", "n_bytes") == of_rows(lambda t: (len(t.encode()),))


def plain_rank(edges, seeds, rounds=200):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    rank = {s: 1 / len(seeds) for s in seeds}
    for _ in range(rounds):
        new = defaultdict(float, {s: 0.15 / len(seeds) for s in seeds})
        for a, r in rank.items():
            for b in out[a]:
                new[b] += 0.85 * r / len(out[a])
        rank = new
    return rank


def test_ranks_like_a_plain_loop(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.com" for i in range(12)] + ["casino.com", "xxx-a.com"]
    links = {h: sorted({rng.choice(hosts) for _ in range(3)}) for h in hosts}
    pages = [(f"http://{h}/p", "".join(f'<a href="http://{x}/">' for x in to), 1.0, "k") for h, to in links.items()] * 2
    pages += [("http://x.fr.org/fr/1", '<a href="http://h1.com/">', 1.0, "k"), ("http://h3.com/" + "q" * 10**6, "<p>" * 10**6, 1.0, "k")]
    df = spark.createDataFrame([(i if i != 5 else None, *p) for i, p in enumerate(pages)], "page_id long, url string, html string, trust double, rank string")
    edges = {(r["src"], r["dst"]) for r in linkgraph.host_edges(df).collect()}
    assert {(h, x) for h, to in links.items() for x in to if h != x} <= edges
    got = {r["host"]: r for r in linkgraph.judge(df).collect()}
    trust, bad = plain_rank(edges, ["x.fr.org"]), plain_rank({(b, a) for a, b in edges}, ["casino.com", "xxx-a.com"])
    for h, r in got.items():
        assert (r["trust"], r["distrust"]) == (pytest.approx(trust.get(h, 0), abs=2e-3), pytest.approx(bad.get(h, 0), abs=2e-3))
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["distrust"] > 0 and r["distrust"] > r["trust"] else "allow")
    assert linkgraph.judge(df).count() == len(pages)
