"""Long repetitive texts in linear time, longest matches against a plain version, bounded samples."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tierwalk.llm import decontaminate, toxicity


def plain(docs, items, window):
    """Spans, items and the longest match of each text, word by word."""
    out = []
    for d in docs:
        hit, mine, best = [False] * len(d), set(), (0, 0, 0, 0)
        for n, q in enumerate(items):
            k = min(window, len(q))
            for i in range(len(d)):
                for j in range(len(q)):
                    m = 0
                    while i + m < len(d) and j + m < len(q) and d[i + m] == q[j + m]:
                        m += 1
                    if k and m >= k:
                        mine.add(n)
                        hit[i : i + m] = [True] * m
                        best = max(best, (m, -i, -n, -j))
        out.append((hit, mine, (best[0], -best[1], -best[2], -best[3]) if mine else None))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matches_like_word_by_word(seed):
    rng = random.Random(seed)
    text = lambda most: [rng.choice("abc"[: 2 + seed % 2]) for _ in range(rng.randrange(most))]
    for _ in range(25):
        docs, items = [text(40) for _ in range(6)], [text(14) for _ in range(5)]
        docs[0] = docs[0] + items[0] + docs[1]
        index = decontaminate.Items([(i, " ".join(q)) for i, q in enumerate(items)], 4)
        counts, spans, of, longest = decontaminate._matches(index, pa.array([" ".join(d) for d in docs]))
        for r, (hit, mine, best) in enumerate(plain(docs, items, 4)):
            assert counts[r] == len(docs[r]) and of.get(r, set()) == mine and longest.get(r) == best
            covered = [False] * len(docs[r])
            for a, e in spans.get(r, ()):
                covered[a:e] = [True] * (e - a)
            assert covered == hit


@pytest.mark.parametrize("pairs", [1, 1 << 20])
def test_pieces_give_the_same_items(monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    index = decontaminate.Items([(i, "a b c d e f") for i in range(9)], 4)
    _, _, of, longest = decontaminate._matches(index, pa.array(["a b c d", "x", "b c d e f a b c d e f"]))
    assert of == {0: set(range(9)), 2: set(range(9))} and longest == {0: (4, 0, 0, 0), 2: (6, 5, 0, 0)}


def test_one_word_over_and_over():
    """A text of 20,000 equal words against an item of 4,000: within seconds and 200 MB, and twice the text takes about twice as long."""
    took = []
    for n in (10_000, 20_000, 40_000):
        index = decontaminate.Items([(7, "a " * (n // 5))], 10)
        column = pa.array(["a " * n + "b"])
        if n == 20_000:
            tracemalloc.start()
        start = time.process_time()
        counts, spans, of, longest = decontaminate._matches(index, column)
        took.append(time.process_time() - start)
        if n == 20_000:
            assert tracemalloc.get_traced_memory()[1] < 200e6
            tracemalloc.stop()
        assert spans == {0: [[0, n]]} and of == {0: {0}} and longest == {0: (n // 5, 0, 0, 0)} and counts[0] == n + 1
    assert took[2] < 3 and took[2] < 8 * took[0] + 0.3


def test_exceptions_over_and_over():
    lexicon = toxicity.Lexicon({" clown ": 3.0})
    took = []
    for n in (4_000, 32_000):
        text = toxicity.fold("a clown fish and clown " * n)
        start = time.process_time()
        got = lexicon.matches(text)
        took.append(time.process_time() - start)
        assert len(got) == n
    assert took[1] < 24 * took[0] + 0.5


def test_fit_takes_so_many_rows_and_no_more(spark, monkeypatch):
    """Repeated ids don't make the sample larger than its bound; equal rows count once then."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 50)
    texts = [f"a nice day number {i}" for i in range(300)] + ["same text"] * 200
    docs = spark.createDataFrame([(t, i % 2 + 1) for i, t in enumerate(texts)], "text string, doc_id long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda rows, exceptions: seen.append(rows.count()) or toxicity.Lexicon({}))
    toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 100_000)
    toxicity.fit(docs, labels)
    held = {r.doc_id for r in labels.filter(toxicity.held_out()).collect()}
    assert seen == [50, sum(i % 2 + 1 not in held for i in range(len(texts)))]


def test_learned_weights_and_curve_like_a_plain_version(spark):
    """Weights are log odds less one and a half standard errors, from documents with a pattern; the curve is where the ridge's slope is zero."""
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        toxic = int(rng.random() < 0.4)
        rows.append((" ".join(rng.choice(["foul", "vile"] if toxic and rng.random() < 0.5 else ["fine", "good", "word", "text"]) for _ in range(8)), toxic))
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    pos, neg = sum(t for _, t in rows), sum(1 - t for _, t in rows)
    for p in (" foul ", " vile ", " foul", " fine "):
        a, n = (sum(toxic == want and p in toxicity.fold(t) for t, toxic in rows) for want in (1, 0))
        w = np.log((a + 0.5) / (pos + 1)) - np.log((n + 0.5) / (neg + 1)) - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (n + 0.5))
        assert lexicon.weights.get(p) == (pytest.approx(w) if a >= 5 and w > 1 else None)
    x, y = np.array([lexicon.features(t) for t, _ in rows]), np.array([t for _, t in rows])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ lexicon.curve))) - 1e-2 * lexicon.curve
    assert np.abs(slope).max() < 1e-6
