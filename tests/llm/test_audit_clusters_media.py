"""Source divergence, kd-tree clusters and media columns against plain versions; nulls, ties, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tierwalk.llm import divergence, kmeans, media, webp

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, least=3, top=200):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for t, lang, s in rows:
        words = [w.translate(LOW) for w in TERM.findall(t or "")]
        docs[lang or ""].update(set(words))
        n[lang or "", s or ""].update(words)
    out, f = [], lambda p, q: (p - q) ** 2 // q
    for lang, own in docs.items():
        kept = [t for t, c in own.items() if c >= least]
        of = {s: c for (a, s), c in n.items() if a == lang}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} for s, c in of.items()}
        all_ = {t: sum(c[t] for c in of.values()) for t in kept}
        q = {t: 1 + 10**9 * (all_[t] + 1) // (sum(all_.values()) + len(kept)) for t in kept}
        for s in of:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in of if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, o.decode(), -v, i + 1) for i, (v, o) in enumerate(found)]
    return Counter(out)


def audit_rows(spark, rows, **more):
    # names that the operator uses inside, as further columns
    docs = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], "text string, lang string, source string, n long, term string, gid int, value long").repartition(3)
    return Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs, **more).collect())


def test_audit(spark):
    rng = random.Random(5)
    words = ["a", "B", "zoë", "É", "мир", "x1y", "über"] + [f"{c}{d}" for c in "abcdefgh" for d in "uvwxyz"]
    rows = []
    for i in range(260):
        s = f"s{rng.randrange(9)}"
        pool = words if rng.random() < 0.5 else words[int(s[1]) * 3 : int(s[1]) * 3 + 12]
        rows.append((" ".join(rng.choice(pool) for _ in range(rng.randrange(30))), rng.choice(["en", "de"]), s))
    rows += [(None, "en", "s0"), ("", "en", "empty"), ("123 !?", None, None), (None, None, "q"), ("word " * 3, "xx", "one"), ("solo", "yy", "s"), ("solo", "yy", "s"), ("solo", "yy", "s")] + rows[:20]
    rows += [("a b " * 30_000, "en", "s1")]
    assert audit_rows(spark, rows) == plain_audit(rows)
    assert audit_rows(spark, rows, least=1, top=4) == plain_audit(rows, 1, 4)


def test_audit_of_nothing(spark):
    assert not audit_rows(spark, [])


def test_tiles_and_postings_add_up(monkeypatch):
    """Pieces far smaller than the data give the same sums."""
    rng = np.random.default_rng(3)
    for name, n in (("TILE", 40), ("STEP", 30), ("PAIRS", 25)):
        monkeypatch.setattr(divergence, name, n)
    groups, zero = 6, rng.integers(1, 50, 6)
    share, rows = {}, []
    for t in range(40):
        for g in sorted(rng.choice(groups, rng.integers(1, groups + 1), replace=False).tolist()):
            share[t, g] = int(zero[g] + rng.integers(0, 1000))
            rows.append(("en", f"{t:03}", g, groups, share[t, g], int(zero[g])))
    names = ["lang", "term", "gid", "groups", "p", "zero"]
    batch = lambda r: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*r, strict=True)], names)
    cut = [batch(rows[i : i + 7]) for i in range(0, len(rows), 7)]
    f = lambda p, q: (p - q) ** 2 // q
    at = lambda t, g: share.get((t, g), int(zero[g]))
    want = {(a, b): sum(f(at(t, a), at(t, b)) for t in range(40)) for a in range(groups) for b in range(groups) if a != b}

    def total(batches):
        out = Counter()
        for b in batches:
            for r in b.to_pylist():
                out[r["a"], r["b"]] += r["part"]
        return out

    fixes = total(divergence.sparse(cut))
    for (a, b), v in want.items():
        mine = sum(f(p, int(zero[b])) for (t, g), p in share.items() if g == a)
        theirs = sum(f(int(zero[a]), p) for (t, g), p in share.items() if g == b)
        own = sum(g == a for _, g in share), sum(g == b for _, g in share)
        assert (40 - sum(own)) * f(int(zero[a]), int(zero[b])) + mine + theirs + fixes[a, b] == v
    filled = sorted(rows + [("en", f"{t:03}", g, groups, int(zero[g]), int(zero[g])) for t in range(40) for g in range(groups)])
    tiles = total(divergence.dense([batch(filled[i : i + 9]) for i in range(0, len(filled), 9)]))
    assert all(tiles[k] == v for k, v in want.items())


def plain_clusters(rows, k, rounds, width, seed):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if of[j] else m for j, m in enumerate(c)]
    got = [(i, *near(v)) for i, v in kept]
    by = Counter()
    for _, d, j in got:
        by[j] += d
    return Counter((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in got)


def cluster_rows(spark, rows, **p):
    df = spark.createDataFrame([(i, v, 1, 2, "h") for i, v in rows], "vec_id long, embedding array<float>, cluster int, x long, h string").repartition(2)
    return Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in kmeans.clusters(df, **p).collect())


def test_clusters(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(i % 4, 0.3, 3))]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(500, 530)] + [(7, [1.0, 2.0, 3.0])] * 3 + [(None, [0.0, 0.0, -0.001])]
    rows += [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 0.0, 0.0]), (905, [])]
    p = {"k": 8, "rounds": 5, "width": 3, "seed": 3}
    assert cluster_rows(spark, rows, **p) == plain_clusters(rows, **p)
    few = rows[:3] + rows[-6:]
    assert cluster_rows(spark, few, **p) == plain_clusters(few, **p)
    assert not cluster_rows(spark, rows[-6:], **p)


def test_trees_rule_centroids_out():
    """On clustered vectors whole nodes are assigned, on equal ones ties go to the smaller number, and every vector counts once."""
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 4, (3000, 2)) + rng.choice([0, 900, 1800], 3000)[:, None]).astype(np.int64)
    tree, c = kmeans.Tree(x), np.array([[0, 0], [900, 900], [1800, 1800], [0, 0]])
    tree = kmeans.Tree.unpacked(tree.packed(), 2)
    whole, single, of = 0, 0, Counter()
    for nodes, j in tree.assigned(c):
        if len(nodes) and nodes[0] < 0:
            single += len(nodes)
            of.update(j.tolist())
        else:
            whole += int(tree.count[nodes].sum())
            for n, one in zip(tree.count[nodes].tolist(), j.tolist(), strict=True):
                of[one] += n
    assert whole + single == 3000 and whole > 1500
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert of == Counter(d.argmin(axis=1).tolist()) and 3 not in of


def test_large_components_are_exact():
    x = np.array([[(1 << 27) - 1, -(1 << 27) + 1], [5, 7]])
    c = np.array([[-(1 << 27) + 1, (1 << 27) - 1], [4, 7]])
    assert kmeans.distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, m, strict=True)) for m in c] for p in x]


def pictures():
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (1, 9), (6, 1), (19, 33)):
        yield rng.integers(0, 1 << 32, (h, w), dtype=np.uint32)
        yield rng.choice(rng.integers(0, 1 << 32, 5, dtype=np.uint32), (h, w))
        yield (np.add.outer(np.arange(h) * 3, np.arange(w) * 2) % 256 * 0x010101 + webp.BLACK).astype(np.uint32)


@pytest.mark.parametrize("cache", [0, 1, 6, 11])
def test_every_transform_comes_back(cache):
    rng = np.random.default_rng(cache)
    for a in pictures():
        d = tuple(-(-x >> 2) for x in a.shape)
        modes, cross = (rng.integers(0, 16, d), 2), (rng.integers(0, 1 << 32, d, dtype=np.uint32), 2)
        for how in ({}, {"subtract_green": True}, {"predictor": modes}, {"cross": cross}, {"predictor": modes, "cross": cross, "subtract_green": True}, {"palette": True}):
            if "palette" not in how or len(np.unique(a)) <= 256:
                assert (webp.decode(webp.encode(a, cache=cache, **how)) == a).all()


def test_predictors_like_a_plain_version():
    rng = np.random.default_rng(2)
    a, modes = rng.integers(0, 1 << 32, (7, 9), dtype=np.uint32), rng.integers(0, 14, (2, 3))
    p = [[[v >> s & 255 for s in (24, 16, 8, 0)] for v in row] for row in a.tolist()]
    want = np.zeros((7, 9), np.uint32)
    half = lambda x, y: [(i + j) // 2 for i, j in zip(x, y, strict=True)]
    clip = lambda v: max(0, min(255, v))
    for y in range(7):
        for x in range(9):
            if y == 0 or x == 0:
                g = [255, 0, 0, 0] if x == y == 0 else p[0][x - 1] if y == 0 else p[y - 1][0]
            else:
                le, t, tl = p[y][x - 1], p[y - 1][x], p[y - 1][x - 1]
                tr = p[y - 1][x + 1] if x < 8 else p[y][0]
                near = sum(abs(i - j) for i, j in zip(t, tl, strict=True)), sum(abs(i - j) for i, j in zip(le, tl, strict=True))
                both = half(le, t)
                g = [
                    [255, 0, 0, 0], le, t, tr, tl, half(half(le, tr), t), half(le, tl), both, half(tl, t), half(t, tr), half(half(le, tl), half(t, tr)), le if near[0] < near[1] else t,
                    [clip(i + j - k) for i, j, k in zip(le, t, tl, strict=True)], [clip(i + int((i - k) / 2)) for i, k in zip(both, tl, strict=True)],
                ][modes[y >> 2, x >> 2]]
            r = [(i - j) & 255 for i, j in zip(p[y][x], g, strict=True)]
            want[y, x] = r[0] << 24 | r[1] << 16 | r[2] << 8 | r[3]
    assert (webp.predict(a, modes, 2) == want).all()
    assert (webp.unpredict(want, modes, 2) == a).all()


def by_symbol(data):
    """The same file, but read symbol by symbol as an image with groups is."""
    own, webp._pixels = webp._pixels, lambda bits, w, h, cache, codes: webp._pixels_by_group(bits, w, h, cache, [codes], np.zeros((h, w), int), 0)
    try:
        return webp.decode(data)
    finally:
        webp._pixels = own


@pytest.mark.parametrize("cache", [0, 3])
def test_walk_over_bits_like_symbol_by_symbol(cache):
    for a in pictures():
        a = np.concatenate((a, a, a[::-1]))
        data = webp.encode(a, cache=cache, subtract_green=True)
        assert (by_symbol(data) == a).all() and (webp.decode(data) == a).all()


def test_groups_of_codes():
    """Two tiles with codes of their own: an image of one row, 8 pixels a tile, written by hand."""
    out = webp._Out()
    for v, n in ((15, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (1, 3)):  # 16 x 1, no transform, no cache, groups by tiles of 8
        out.put(v, n)
    webp._write_image(out, np.array([[webp.BLACK, webp.BLACK | 1 << 8]], np.uint32), False)
    for green in ((3, 200), (9, 77)):
        out.put(1 | 1 << 1 | 1 << 2, 3)
        out.put(green[0], 8)
        out.put(green[1], 8)
        for only in (1, 2, 255, 0):  # red, blue, alpha, distance
            out.put(5 | only << 3, 11)
    for k in range(16):
        out.put(k & 1, 1)
    body = b"\x2f" + out.bytes()
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    want = [0xFF010002 | (((3, 200), (9, 77))[k >> 3][k & 1] << 8) for k in range(16)]
    assert webp.decode(data).tolist() == [want]


def test_damage_is_told():
    data = webp.encode(np.arange(600, dtype=np.uint32).reshape(20, 30) * np.uint32(7919))
    for bad in (b"", data[:30], b"RIFX" + data[4:], data[:20] + b"\0" + data[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    rng = random.Random(3)
    for _ in range(150):
        at = rng.randrange(21, len(data))
        try:
            webp.decode(data[:at] + bytes([data[at] ^ 1 << rng.randrange(8)]) + data[at + 1 :])
        except ValueError:
            pass


def test_copies_are_found():
    a = np.full((4, 300), 7, np.uint32)
    b = np.tile(np.arange(50, dtype=np.uint32) << np.uint32(8), (8, 5))
    assert len(webp.encode(a)) < 80 and len(webp.encode(b)) < 250
    rng = np.random.default_rng(6)
    for most in (3, 200, 1 << 31):
        x = rng.integers(0, most, 500).astype(np.uint32)
        x = np.concatenate((x, x[20:400], x[:9], x))
        start, length, dist = webp.copies(x)
        assert (start[1:] >= (start + length)[:-1]).all() and length.sum() > (800 if most > 3 else 0)
        for s, n, d in zip(start.tolist(), length.tolist(), dist.tolist(), strict=True):
            assert 0 < d <= s and all(x[i] == x[i - d] for i in range(s, s + n))


TEXTS = [(1, "a short text"), (2, None), (3, ""), (3, "same id"), (None, "no id"), (4, "x" * 576), (5, "ÿ\xff€ \U0001f600" * 300), (6, "ab" * 700_000), (7, "a short text"), (7, "a short text")]


def test_media_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, b"m", 2) for i, t in TEXTS], "doc_id long, text string, n_bytes int, media binary, part int").repartition(3)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in media.stored_payloads(docs).collect())

    def want(i, t):
        text = (t or "").encode()
        p = text + b"\xff" * ((-len(text)) % 576 or 576 * (not text))
        return i, len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])

    assert got == Counter(want(i, t) for i, t in TEXTS)
    stored = media.encode_texts(docs)
    twins = {(r["media_bytes"], r["media_sha256"], r["feature"]) for r in media.read_back(stored).filter("doc_id in (1, 7)").collect()}
    assert len(twins) == 1
    assert not media.stored_payloads(docs.filter("doc_id = 99")).collect()
    pixels = {(r["doc_id"], r["part"]): r for r in media.decode_images(stored.filter("doc_id = 6")).collect()}
    assert sorted(pixels) == [(6, 0), (6, 1), (6, 2)] and pixels[6, 0]["height"] == media.PART
    assert bytes(pixels[6, 0]["argb"])[:8] == b"aaa\xffbbb\xff"


def test_bad_images_are_rows(spark):
    good = media.encoded(b"hello")
    df = spark.createDataFrame([(1, None), (2, good + good), (3, good[:40]), (4, b"nothing"), (5, good + b"RIFF")], "doc_id long, media binary")
    rows = sorted((r["doc_id"], r["part"], r["argb"] is None, r["error"] is None) for r in media.decode_images(df).collect())
    assert rows == [(1, 0, True, True), (2, 0, False, True), (2, 1, False, True), (3, 0, True, False), (4, 0, True, False), (5, 0, False, True), (5, 1, True, False)]
