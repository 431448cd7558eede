"""Each operator against a plain version on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tierwalk.llm import bpe, chunks, decontaminate, exact_dedup, gru, hashing, linkgraph, ngram_join, rangecoder, sharding, tokenstore, toxicity
from tierwalk.llm.common import Work

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grams string, rep long"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choice(words, 40)) for _ in range(25)]
    for i in range(12):  # near copies
        w = out[i % 4].split()
        w[int(rng.integers(40))] = f"x{i}"
        out.append(" ".join(w))
    out += [out[0]] * 4 + [None, "", "one two", "one two", "ONE Two", " \n", " ".join(rng.choice(words, 6000)), "Zoë said: \U0001f600 naïve x"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i * 3, t, None, "s", None, "g", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n).astype(np.uint32) for n in (0, 1, 700)] + [np.tile(np.arange(20, dtype=np.uint32), 40)]
    coded = rangecoder.encode_blocks(blocks)
    for a, b in zip(blocks, rangecoder.decode_blocks(coded), strict=True):
        assert (a == b).all()
    assert len(coded[3]) < 800
    assert (rangecoder.decode_blocks([coded[3]])[0] == blocks[3]).all()
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([coded[2][:-1] + bytes([coded[2][-1] ^ 1])])


def test_token_files(spark, docs, none, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenstore.tokenizer(path)
    out = Work(spark, "t").path("f")
    tokenstore.write(docs, out, path)
    got, start = rows(tokenstore.read(spark, out, with_ids=True)), 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        r = got[i * 3]
        assert (r["start"], r["n_tokens"], r["token_ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    tokenstore.write(none, out + "0", path)
    assert tokenstore.read(spark, out + "0").count() == 0


def test_bpe_like_library(spark, docs, none, texts):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.roundtrip_digests(docs, path, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        r = got[i * 3]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.roundtrip_digests(none, path, public_tokenizers.PATTERN).count() == 0
    c = bpe.coder(path, public_tokenizers.PATTERN)
    a, b = b"unbelievable", b"ness of things"
    table = c.extend(a, [])
    assert c.append(a, table, b)[1] == c.extend(a + b, [])
    assert c.edit(a, table, 3, 5, b"xyz")[1] == c.extend(a[:3] + b"xyz" + a[5:], [])


def test_toxicity(spark, none):
    pairs = [(i, ("you " + ("idіot" if i % 2 else "1diot") + " word" if i % 5 == 0 else "a calm word about the clown fish") + f" n{i}") for i in range(200)]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in pairs] + [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    got = rows(toxicity.scored(docs, lexicon))
    assert all((got[i]["score"] >= 0.3) == (i % 5 == 0) for i in range(200))
    assert got[900]["score"] == got[901]["score"] < 0.3
    assert toxicity.accept(docs, lexicon).count() == 162
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.Lexicon({" clown ": 3.0}).matches(toxicity.fold("a clown fish")) == []


def test_shards(spark, docs, none, texts):
    got = sharding.propagate(docs, 8).collect()
    sizes = defaultdict(list)
    for r in got:
        sizes[r["shard"]].append(r["slot"])
        t = texts[r["doc_id"] // 3] or ""
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert len(got) == len(texts)
    assert {len(s) for s in sizes.values()} <= {len(texts) // 8, len(texts) // 8 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert sharding.propagate(none, 8).count() == 0


def test_shards_leave_no_group_cut_that_fits(spark):
    texts = [f"alone {i}" for i in range(1200)] + [f"pair {i}" for i in range(200)] * 2
    texts += [f"group {i}" for i in range(60) for _ in range(3 + i % 20)] + ["many"] * 900
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    at, sizes = defaultdict(set), defaultdict(int)
    for r in sharding.propagate(docs, 8).collect():
        at[texts[r["doc_id"]]].add(r["shard"])
        sizes[r["shard"]] += 1
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert [t for t, s in at.items() if len(s) > 1] == ["many"]


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("hot", [1 << 19, 40])
def test_gru(spark, docs, none, texts, hot, monkeypatch):
    monkeypatch.setattr(gru, "HOT", hot)
    monkeypatch.setattr(gru, "KNOWN", 20)
    got = rows(gru.score(docs))
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i * 3).encode()) % 7 != 2]
    count = defaultdict(int)
    for t in train:
        for w in [*spaced(t), None]:
            count[w] += 1
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        w = [*spaced(t), None]
        r = got[i * 3]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count.get(x, 0) > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0
    assert gru.score(none).count() == 0


def test_gru_keeps_rows_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b a", None, None, None, None, None), (None, "a b a", None, None, None, None, None), (5, "c", None, None, None, None, None), (5, "a", None, None, None, None, None)], SCHEMA)
    got = gru.score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in got) == [(0, 4, 4), (0, 4, 4), (5, 2, 2), (5, 2, 2)]


def few_words(n):
    m = gru.GRU(gru.word_hashes([f"w{i}" for i in range(n)]))
    return m, lambda t: m.ids(*next(iter(gru.texts_of(pa.array([t], pa.string()))))[2:])[0]


def test_gru_is_a_distribution():
    m, ids = few_words(30)
    assert ids("w0 W29 other").tolist() == [2, 31, gru.OTHER, gru.END]
    m.fit([np.arange(2, 20)] * 20, epochs=1)
    h = np.random.default_rng(0).standard_normal((1, gru.HIDDEN)).astype(np.float32)
    total = sum(np.exp(m.log_probs(h, np.array([y]))[0]) for y in range(32))
    assert total == pytest.approx(1, abs=1e-4)


def test_gru_scores_like_a_plain_forward_pass(monkeypatch):
    monkeypatch.setattr(gru, "STATES", 7)
    m, ids = few_words(30)
    m.fit([np.arange(2, 20)] * 20, epochs=1)
    docs = [ids(t) for t in ("w1 w2 w3 " * 90, "w5", "", "x w3 w3 w1")]
    got = m.score(np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
    for d, g in zip(docs, got, strict=True):
        h, last, total = np.zeros((1, gru.HIDDEN), np.float32), np.array([m.start]), 0.0
        for y in d:
            h, _ = m.step(last, h)
            total += m.log_probs(h, np.array([y]))[0]
            last = np.array([y])
        assert g == pytest.approx(total, rel=1e-4)


def test_gru_gradients():
    m, _ = few_words(10)
    rng = np.random.default_rng(1)
    h, y = rng.standard_normal((6, gru.HIDDEN)), rng.integers(0, 12, 6)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    grads = {k: np.zeros_like(v) for k, v in m.p.items()}
    _, dh = m.log_probs(h, y, grads)
    loss = lambda: -m.log_probs(h, y).sum()
    for x, g in ((m.p["C"], grads["C"]), (m.p["V"], grads["V"]), (m.p["cb"], grads["cb"]), (h, dh)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = x[at]
        x[at] = old + 1e-5
        up = loss()
        x[at] = old - 1e-5
        assert g[at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3)
        x[at] = old


def test_gru_learns_a_cycle():
    # the loss through time falls to what only a state can reach: every word's successor is known
    m, _ = few_words(18)
    flow = np.tile(np.arange(2, 20), 40)
    m.fit([flow] * 10, epochs=12)
    assert m.score(flow, np.array([0, len(flow)]))[0] / len(flow) > -0.3


def test_gru_learns_from_its_share_of_documents(spark, monkeypatch):
    monkeypatch.setattr(gru, "SHARE", 1)
    pairs = [(i, " ".join(f"v{(i * 3 + k) % 9}" for k in range(40))) for i in range(120)]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in pairs], SCHEMA).repartition(3)
    seen, one = [], gru._pass_over
    monkeypatch.setattr(gru, "_pass_over", lambda *a: seen.append(one(*a)))
    got = gru.score(docs).collect()
    assert seen == [got[0]["train_tokens"]] * gru.EPOCHS


def test_word_hashes_like_words(texts):
    of = {}
    for alphabet, find in ((hashing.SPACED, spaced), (hashing.LETTERS, lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))):
        data, offsets = hashing.as_bytes(pa.array([*texts, "ends", "Ends here"]).slice(1))
        h, start, end, bounds = hashing.words(data, offsets, alphabet)
        for i, t in enumerate([*texts, "ends", "Ends here"][1:]):
            assert [data[a:b].tobytes().decode().lower() for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]], strict=True)] == [w.lower() for w in find(t)]
            for w, x in zip(find(t), h[bounds[i] : bounds[i + 1]], strict=True):
                assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def test_exact(spark, docs, none, texts):
    got = rows(exact_dedup.duplicates(docs, keep="largest"))
    for i, t in enumerate(texts):
        same = [j * 3 for j, u in enumerate(texts) if (u or "") == (t or "")]
        r = got[i * 3]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), i * 3 == max(same))
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.duplicates(none).count() == 0


def test_link_graph(spark):
    pages = spark.createDataFrame(
        [(0, None, None), (1, "no scheme", ""), (2, "http://A.Example.net/en/x?q", None), (3, "https://b.net/", ""), (4, "http://shop.casino.com", '<a href="http://c.com/">'), (5, "http://c.com/p#x", '<a href="http://shop.casino.com/a">'), (6, "http://d.org/fr/1", '<a href="http://e.com/">'), (7, "http://e.com/fr", None), (8, "http://x.example.com/de/1", None)],
        "page_id long, url string, html string",
    )
    got = rows(linkgraph.judge(pages), "page_id")
    assert [(got[i]["host"], got[i]["rule"], got[i]["verdict"]) for i in range(9)] == [
        ("", None, "allow"), ("", None, "allow"), ("a.example.net", "example.net/en/", "allow"), ("b.net", "net/", "block"), ("shop.casino.com", None, "block"), ("c.com", None, "block"), ("d.org", "org/fr/", "allow"), ("e.com", None, "allow"), ("x.example.com", "example.com/de/", "block"),
    ]
    assert linkgraph.judge(pages.limit(0)).count() == 0


def test_link_graph_joins_hosts_and_resolves_links(spark):
    urls = [("http://casino.shop.com/", None), ("http://www.shop.com/", None), ("http://m.one.example.com/", None), ("http://casino.two.example.com/", None), ("http://cap.com/", "<A HREF = '//CASINO.shop.com/y'>"), ("http://up.com/", '<a href=HTTPS://up.casino.co.uk>'), ("http://rel.com/", '<a href="/casino.shop.com/"> <a data-href="//casino.shop.com">'), ("http://hand.com/", None), ("http://b.co.uk/", None)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(urls)], "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in linkgraph.judge(pages, seeds=(("hand.com", "block"),)).collect()}
    assert got == {"casino.shop.com": "block", "www.shop.com": "block", "m.one.example.com": "allow", "casino.two.example.com": "block", "cap.com": "block", "up.com": "block", "rel.com": "allow", "hand.com": "block", "b.co.uk": "allow"}
    assert {(r["src"], r["dst"]) for r in linkgraph.host_edges(pages).collect()} >= {("m.one.example.com", "one.example.com"), ("one.example.com", "m.one.example.com"), ("up.casino.co.uk", "casino.co.uk")}


def test_link_graph_distrust_from_rules_and_far_away(spark):
    chain = [(i, f"http://c{i}.com/", f'<a href="http://c{i + 1}.com/">') for i in range(14)] + [(14, "http://c14.com/", '<a href="http://casino.com/">')]
    more = [(20, "http://ruled.net/x", None), (21, "http://to-ruled.com/", '<a href="http://ruled.net/">'), (22, "http://part.example.com/de/1", None), (23, "http://part.example.com/en/1", None), (24, "http://to-part.com/", '<a href="http://part.example.com/">')]
    got = rows(linkgraph.judge(spark.createDataFrame(chain + more, "page_id long, url string, html string")), "page_id")
    assert {got[i]["verdict"] for i in range(15)} == {"block"} and got[21]["verdict"] == "block"
    assert got[23]["verdict"] == got[24]["verdict"] == "allow"


def test_chunks(spark, none):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(map(str, rng.integers(0, 10**6, n)))
    shared = word(80)
    t = [word(50) + " " + shared + " " + word(30), word(41) + shared + word(9), word(90), None, ""]
    docs = spark.createDataFrame([(i, x, None, None, None, None, None) for i, x in enumerate(t)], SCHEMA)
    got = rows(chunks.repeats(docs))
    assert got[0]["n_removed"] == 0 and got[0]["repeated_bytes"] > 300
    assert got[1]["n_removed"] > 3 and got[2]["n_repeated"] == got[3]["n_chunks"] == got[4]["n_chunks"] == 0
    assert "".join(t[1].encode()[s["start"] : s["end"]].decode() for s in got[1]["spans"]) in shared
    assert chunks.repeats(none).count() == 0
    for data in (b"", b"a" * 5000, t[0].encode()):
        assert sum(b - a for a, b in zip([0, *chunks.cuts(data)], chunks.cuts(data))) == len(data)


def test_chunks_of_repeated_ids(spark):
    text = " ".join(map(str, np.random.default_rng(6).integers(0, 10**6, 80)))
    for key in (4, None):
        got = chunks.repeats(spark.createDataFrame([(key, text, None, None, None, None, None)] * 2, SCHEMA)).collect()
        assert [r["n_bytes"] for r in got] == [len(text)] * 2
        assert sorted(r["n_removed"] for r in got) == [0, got[0]["n_chunks"]] and got[0]["n_chunks"] == got[0]["n_repeated"] > 1


def test_decontamination(spark, docs, none, texts):
    items = [(1, " ".join(texts[3].split()[5:20])), (2, "w1 w2 zzz"), (3, "ONE two"), (4, None), (5, "..."), (6, " ".join(texts[-2].split()[100:111])), (10, texts[3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.report(decontaminate.hits(docs, bench, 10)))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in enumerate(texts):
        w, hit, ids = find(t), set(), set()
        for item, text in items:
            x = find(text)
            k = min(10, len(x))
            for a in range(len(x) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[a : a + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(item))
        r = got[i * 3]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(ids), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert decontaminate.hits(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(decontaminate.hits(docs, bench.limit(0))).collect())


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_components(spark, docs, none, texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    got = rows(ngram_join.jaccard_components(docs, n, percent))
    assert [(got[i * 3]["n_shingles"], got[i * 3]["component_id"]) for i in range(len(texts))] == [(len(s), r * 3) for s, r in zip(sets, root, strict=True)]
    assert ngram_join.jaccard_components(none, n, percent).count() == 0
