"""The pipeline against a plain version, stage by stage."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tierwalk.llm import toxicity
from tierwalk.llm.common import Work, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MORE = SCHEMA + ", key string, number long, gram string, sig string, kept boolean, score double, number_2 int"


def tables(spark, rows, schema, labels, items):
    root = Work(spark, "tables").base
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def alphanumeric(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(rows, lexicon, items):
    """(doc_id, text) that should reach the last stage, with numbers for rows that are alike."""
    left = [r[:2] for r in rows if lexicon.score(r[1]) < 0.3]
    groups = {}
    for d, t in left:
        groups.setdefault(t or "", []).append((d is not None, d or 0, d, t))
    left = [max(g, key=lambda x: x[:2])[2:] for g in groups.values()]
    sets = []
    for _, t in left:
        w = spaced(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(left)))
    for i, j in combinations(root[:], 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    groups = {}
    for r, (d, t) in zip(root, left, strict=True):
        groups.setdefault(r, []).append((d is not None, d or 0, d, t))
    left = [min(g, key=lambda x: x[:2])[2:] for g in groups.values()]
    windows = {tuple(w[i : i + min(10, len(w))]) for x in items if (w := alphanumeric(x[1])) for i in range(len(w) - min(10, len(w)) + 1)}
    return [(d, t) for d, t in left if not any(tuple(w[i : i + k]) in windows for w in [alphanumeric(t)] for k in {len(x) for x in windows} for i in range(len(w) - k + 1))]


def test_like_a_plain_version(spark):
    base = [f"plain sentence number {i} about rivers and a quiet town with bridges, gardens and long slow afternoons by water {i * 7}" for i in range(30)]
    item = " ".join(f"bench{k}" for k in range(14))
    near = " ".join(f"tok{k}" for k in range(60))
    long = " ".join(np.random.default_rng(3).choice([f"w{i}" for i in range(5000)], 250_000))
    rows = [(i, t, "en", "s", None) for i, t in enumerate(base)]
    rows += [(100 + i, f"you are an idiot and a moron {i} scum", "en", "s", None) for i in range(20)]
    rows += [(200, near, None, None, None), (201, near, None, None, None), (202, near + " more", None, None, None), (203, item + " tail", None, None, None), (204, None, None, None, None), (205, "", None, None, None)]
    # null and repeated ids, rows alike in id and text, one id with two texts, a text of some MB
    rows += [(None, "a row without an id that is clean", None, None, None)] * 2 + [(None, item + " no id", None, None, None), (None, near + " without id", None, None, None)]
    rows += [(300, "one text twice", None, None, None)] * 2 + [(301, "first text of an id", None, None, None), (301, near, None, None, None), (400, long, None, None, None)]
    wide = [(*r, "k", 1, "g", "s", True, 0.5, 2) for r in rows]
    items = [(1, item), (2, None), (3, "")]
    root = tables(spark, wide, MORE, [(r[0], 1, int(100 <= (r[0] or 0) < 120)) for r in rows], items)
    lexicon = toxicity.fit(table(spark, root, "documents"), table(spark, root, "labels"))
    want = plain(rows, lexicon, items)
    assert Counter(d for d, _ in want)[300] == 1 and Counter(d for d, _ in want)[None] == 1
    got = corpus_pipeline.run(spark, root).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in want)
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in want}
    for r in got:
        ids = lib.encode_ordinary(texts[r["decoded_sha256"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_stages_of_tables_without_files(spark):
    rows = [(1, "same text here", None, None, None), (1, "same text here", None, None, None), (None, "same text here", None, None, None), (2, "other", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert sorted(r["doc_id"] for r in stage(spark, docs.filter("doc_id is not null"), "").collect()) == [1, 2]


@pytest.mark.parametrize("k", range(5))
def test_stages_of_empty_tables(spark, k):
    root = tables(spark, [], SCHEMA, [], [])
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), root)
    assert out.count() == 0
    assert out.columns == (corpus_pipeline.COLUMNS if k < 4 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
