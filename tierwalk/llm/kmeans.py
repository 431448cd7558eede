"""Centroid clustering by kd-tree filtering: Lloyd's rounds, exact in integers, over kd-trees that are built once.

Vectors of `width` finite components become integers floor(1024 * x). Every task cuts its vectors into trees of at most
`TREE` vectors; a tree's nodes hold how many vectors they have, their integer sums and their bounding box. A round passes
the centroids down each tree, one level at a time: a centroid goes when another one is strictly nearer in the whole box, a
node with one centroid left is assigned whole, and leaves are resolved vector by vector. What comes back from a task is a
count and sums for each centroid. The trees are a written table, so a lost executor costs its own tasks only.

Vectors with other lengths, with null or with infinite components are left out, and so are null vectors. A null vec_id is
hashed as an empty one. Equal vectors and repeated ids are vectors of their own; of seeds with one hash the one with the
smaller components comes first. With fewer vectors than centroids each vector is a centroid. An empty table has an empty
result. Other columns are ignored. Components from 2^17 on (times 1024: 2^27) would not let squared distances fit 64 bits; they
raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import Work, columns, ship, sliced

#: Vectors in a tree, and in a leaf.
TREE, LEAF = 4096, 16
#: From this on products of components may not be exact in 64-bit floats.
FLOATS = 1 << 22


class Tree:
    """Points in the order of the leaves; node 1 is the root and node i's children are 2 i and 2 i + 1."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        levels = max(0, int(np.ceil(np.log2(max(1, len(points) / LEAF)))))
        self.start = np.zeros(2 << levels, np.int64)
        self.end = np.zeros(2 << levels, np.int64)
        self.start[1], self.end[1] = 0, len(points)
        for node in range(1, 1 << levels):
            a, b = int(self.start[node]), int(self.end[node])
            mid = (a + b) // 2
            rows = self.order[a:b]
            own = points[rows]
            widest = own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))]
            self.order[a:b] = rows[np.argpartition(widest, mid - a)] if 0 < mid - a < b - a else rows
            self.start[2 * node], self.end[2 * node] = a, mid
            self.start[2 * node + 1], self.end[2 * node + 1] = mid, b
        self.points = points[self.order]
        first = 1 << levels
        at = self.start[first:]
        self.count = self.end - self.start
        width = points.shape[1]
        self.sums, self.low, self.high = (np.zeros((2 << levels, width), np.int64) for _ in range(3))
        self.sums[first:] = np.add.reduceat(self.points, at)
        self.low[first:] = np.minimum.reduceat(self.points, at)
        self.high[first:] = np.maximum.reduceat(self.points, at)
        for level in range(levels, 0, -1):
            up, down = slice(1 << level - 1, 1 << level), self.sums[1 << level : 2 << level]
            self.sums[up] = down[::2] + down[1::2]
            self.low[up] = np.minimum(self.low[1 << level : 2 << level : 2], self.low[(1 << level) + 1 : 2 << level : 2])
            self.high[up] = np.maximum(self.high[1 << level : 2 << level : 2], self.high[(1 << level) + 1 : 2 << level : 2])

    PARTS = ("start", "end", "sums", "low", "high")

    def packed(self) -> dict[str, bytes]:
        return {"points": self.points.astype("<i4").tobytes(), **{n: getattr(self, n).astype("<i8" if n == "sums" else "<i4").tobytes() for n in self.PARTS}}

    @classmethod
    def unpacked(cls, parts: dict[str, bytes], width: int) -> Tree:
        self = cls.__new__(cls)
        self.points = np.frombuffer(parts["points"], "<i4").astype(np.int64).reshape(-1, width)
        for n in cls.PARTS:
            values = np.frombuffer(parts[n], "<i8" if n == "sums" else "<i4").astype(np.int64)
            setattr(self, n, values.reshape(-1, width) if n in ("sums", "low", "high") else values)
        self.count = self.end - self.start
        return self

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes and the centroid that each belongs to as a whole; or, with negative nodes, rows (-1 - row) of leaves and theirs."""
        norms = (centroids * centroids).sum(axis=1)
        nodes, left = np.array([1]), np.ones((1, len(centroids)), bool)
        leaves = len(self.start) // 2
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            # any centroid may be the rival; the one nearest to the box's middle rules out most
            middle = distances((low + high) // 2, centroids)
            rival = np.argmin(np.where(left, middle, np.iinfo(np.int64).max), axis=1)
            ahead = centroids[None, :, :] - centroids[rival][:, None, :]
            corner = np.where(ahead > 0, high[:, None, :], low[:, None, :])
            # the least that a centroid is farther away than the rival, over the whole box
            least = norms[None, :] - norms[rival][:, None] - 2 * (corner * ahead).sum(axis=2)
            left &= ~(least > 0)
            whole = left.sum(axis=1) == 1
            yield nodes[whole], rival[whole]
            nodes, left = nodes[~whole], left[~whole]
            if not len(nodes):
                return
            if nodes[0] >= leaves:
                size = self.count[nodes]
                rows = np.repeat(self.start[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                far = distances(self.points[rows], centroids)
                far[~np.repeat(left, size, axis=0)] = np.iinfo(np.int64).max
                yield -1 - rows, np.argmin(far, axis=1)  # the first of equal distances
                return
            nodes, left = np.repeat(nodes * 2, 2), np.repeat(left, 2, axis=0)
            nodes[1::2] += 1


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: through 64-bit floats only while their products and sums are whole numbers under 2^53."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < FLOATS and points.shape[1] <= 256:
        cross = (points.astype(np.float64) @ centroids.astype(np.float64).T).astype(np.int64)
    else:
        cross = points @ centroids.T
    return (points * points).sum(axis=1)[:, None] - 2 * cross + (centroids * centroids).sum(axis=1)[None, :]


def integers(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id and the components of the vectors that count, as integers."""
    v = columns(vectors, ["vec_id", "embedding"]).filter((F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    whole = lambda x: F.when(F.abs(x) < (1 << 17), F.floor(x.cast("double") * 1024)).otherwise(F.raise_error(F.lit("a component of 2^17 or more has no exact squared distance")).cast("long"))
    return v.select("vec_id", F.transform("embedding", whole).alias("x"))


def trees(points: DataFrame, width: int) -> DataFrame:
    """One row for each tree."""
    ship(points.sparkSession)

    def build(batches):
        for b in sliced(batches, TREE):
            x = b.column(1).flatten().to_numpy().reshape(-1, width)
            tree = Tree(x)
            yield pa.RecordBatch.from_pylist([{"ids": b.column(0).take(pa.array(tree.order)).to_pylist(), **tree.packed()}], schema)

    schema = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), *((n, pa.binary()) for n in Tree.PARTS)])
    return points.mapInArrow(build, "ids array<long>, points binary, " + ", ".join(f"{n} binary" for n in Tree.PARTS))


def _each(batches, width: int):
    for b in batches:
        for r in range(b.num_rows):
            row = b.slice(r, 1)
            yield row.column(0)[0].values, Tree.unpacked({n: row.column(row.schema.get_field_index(n))[0].as_py() for n in ("points", *Tree.PARTS)}, width)


def _moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' means; an empty one stays. Gathers a row for each centroid."""
    k, width = centroids.shape

    def sums(batches):
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, tree in _each(batches, width):
            for nodes, c in tree.assigned(centroids):
                if len(nodes):
                    own = nodes[0] >= 0
                    np.add.at(total, c, tree.sums[nodes] if own else tree.points[-1 - nodes])
                    np.add.at(n, c, tree.count[nodes] if own else 1)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(have, pa.int32()), "n": pa.array(n[have]), "x": pa.array(list(total[have]), pa.list_(pa.int64()))})

    parts = forest.mapInArrow(sums, "c int, n long, x array<long>").select("c", "n", F.posexplode("x").alias("i", "x"))
    found = parts.groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()
    new = centroids.copy()
    for r in found:
        new[r["c"], r["i"]] = int(r["x"]) // r["n"]
    return new


def fit(vectors: DataFrame, *, k: int, rounds: int, width: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """The trees, written, and the centroids after all rounds."""
    work = Work(vectors.sparkSession, "kd-trees")
    points = integers(vectors, width)
    forest = work.write("trees", trees(points, width))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.select(named.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, width)
    for _ in range(rounds if len(first) else 0):
        centroids = _moved(forest, centroids)
    return forest, centroids


def assign(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector in the trees."""
    width = centroids.shape[1]

    def nearest(batches):
        for ids, tree in _each(batches, width):
            cluster = np.empty(len(tree.points), np.int64)
            for nodes, c in tree.assigned(centroids):
                if len(nodes) and nodes[0] < 0:
                    cluster[-1 - nodes] = c
                else:
                    for node, own in zip(nodes.tolist(), c.tolist(), strict=True):
                        cluster[tree.start[node] : tree.end[node]] = own
            d = tree.points - centroids[cluster]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cluster, pa.int32()), pa.array((d * d).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(nearest, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, *, k: int, rounds: int, width: int, seed: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    forest, centroids = fit(vectors, k=k, rounds=rounds, width=width, seed=seed)
    spark = vectors.sparkSession
    rows = Work(spark, "clusters").write("rows", assign(forest, centroids))
    totals = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    of = [(c, totals.get(c, 0), sum(totals.values()), ",".join(map(str, x))) for c, x in enumerate(centroids.tolist())]
    named = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, x string")
    sides = F.broadcast(named.select("cluster", "cluster_inertia", "inertia", F.sha2("x", 256).alias("centroid_sha256")))  # k rows
    return rows.join(sides, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
