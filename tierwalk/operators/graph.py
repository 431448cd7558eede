"""Breadth-first walks over edge tables; every level is a written table, and ranks are given by ranges, not by a window over a root's level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.operators.order import numbered
from tierwalk.session import stored


def walk(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: nodes reachable from roots (node) along edges (parent, child), with the fewest steps."""
    steps = stored(edges.select("parent", "child").filter("parent is not null and child is not null").distinct(), "steps")
    levels = [stored(roots.select("node").distinct().withColumn("depth", F.lit(0)), "walk")]
    for d in range(1, max_depth + 1):
        found = levels[-1].join(steps, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        fresh = found.join(reduce(DataFrame.unionByName, levels).select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        levels.append(stored(fresh, "walk"))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def ranked_walk(steps: DataFrame, roots: DataFrame, max_depth: int, cap: int | None = None, deeper: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A queue's walk from every root (root), all side by side: visited (root, node, depth, rank) and edges (root, parent, child, depth, rank, ord).

    steps: parent, child, ord (of a parent's children). Nodes are visited in the order in which they are first met: by their
    parent's rank, then ord. A root's walk ends at `cap` visited nodes. An edge is met for every child of a visited node, visited
    or not, also at max_depth. deeper: a boolean column of steps; below the root only steps where it holds are taken.
    """
    steps = stored(steps.filter("parent is not null and child is not null"), "steps")
    levels = [stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("rank")).distinct(), "walk")]
    found = []
    for d in range(max_depth + 1):
        out = levels[-1].join(steps, F.col("node") == F.col("parent"))
        if deeper and d:
            out = out.filter(deeper)
        found.append(stored(out.select("root", "parent", "child", "depth", "rank", "ord"), "edges"))
        if d == max_depth:
            break
        seen = reduce(DataFrame.unionByName, levels)
        fresh = found[-1].groupBy("root", F.col("child").alias("node")).agg(F.min(F.struct("rank", "ord")).alias("_at")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        before = seen.groupBy("root").agg(F.max("rank").alias("_n"))
        # a root's level lies in as many tasks as its nodes need
        placed = numbered(fresh.select("root", "_at", "node"), ["_at", "node"], "_place", ["root"])
        fresh = placed.join(before, "root").select("root", "node", F.lit(d + 1).alias("depth"), (F.col("_n") + F.col("_place")).alias("rank"))
        levels.append(stored(fresh if cap is None else fresh.filter(F.col("rank") <= cap), "walk"))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, found)


def neighbourhood(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """Edges (source, target, ...) whose ends are both at most `hops` steps from a root (node), in either direction; all edges where no root is a node."""
    both = edges.select(F.col("source").alias("parent"), F.col("target").alias("child")).union(edges.select("target", "source"))
    known = roots.join(both.select(F.col("parent").alias("node")), "node", "left_semi")
    if known.isEmpty():
        return edges
    near = stored(walk(both, known, hops).select("node"), "near")
    return edges.join(near.withColumnRenamed("node", "source"), "source", "left_semi").join(near.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


def levels(edges: DataFrame, roots: DataFrame, most: int = 20) -> DataFrame:
    """side, node, level: owners above the roots (by beneficial_owner) and subsidiaries below (by consolidated_subsidiary), each at its least level."""
    trimmed = edges.select("relationship", F.btrim("source").alias("source"), F.btrim("target").alias("target")).filter("source <> '' and target <> ''")
    up = trimmed.filter("relationship = 'beneficial_owner'").select(F.col("target").alias("parent"), F.col("source").alias("child"))
    down = trimmed.filter("relationship = 'consolidated_subsidiary'").select(F.col("source").alias("parent"), F.col("target").alias("child"))
    one = lambda steps, side: walk(steps, roots, most).filter("depth > 0").select(F.lit(side).alias("side"), "node", F.col("depth").alias("level"))
    return one(up, "above").unionByName(one(down, "below"))


def nodes(edges: DataFrame) -> DataFrame:
    """name, type: every end of an edge with the type it has first (by seq, source before target)."""
    ends = edges.select(F.col("source").alias("name"), F.col("source_type").alias("type"), F.struct("seq", F.lit(0).alias("side")).alias("_at"))
    ends = ends.union(edges.select("target", "target_type", F.struct("seq", F.lit(1))))
    return ends.filter("name <> ''").groupBy("name").agg(F.min_by("type", "_at").alias("type"))


def root_name(edges: DataFrame) -> DataFrame:
    """One row, root: the company named most at depth 0, else by number and name, else the issuer of most roles, else the first by name; ties go to the first met."""
    name, cik = F.btrim(F.coalesce("company_name", F.lit(""))), F.btrim(F.coalesce("company_cik", F.lit("")))
    rows = edges.select(name.alias("n"), cik.alias("c"), "target", "relationship", F.coalesce(F.col("chain_depth").cast("string").try_cast("int"), F.lit(0)).alias("d"), "seq")

    def most(df: DataFrame, by: list[str], choice: int) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.min("seq").alias("s")).select(F.lit(choice).alias("choice"), (-F.col("k")).alias("k"), "s", F.col(by[-1]).alias("root"))

    choices = most(rows.filter("n <> '' and d = 0"), ["n"], 0).union(most(rows.filter("n <> '' and c <> ''"), ["c", "n"], 1)).union(most(rows.filter("relationship in ('person_role', 'institution_role')"), ["target"], 2))
    picked = choices.agg(F.min(F.struct("choice", "k", "s", "root"))["root"].alias("root"))
    last = rows.filter("n <> ''").agg(F.min("n").alias("other"))
    return picked.join(last).select(F.coalesce(F.nullif("root", F.lit("")), "other").alias("root"))
