"""Connected components and first-wins suppression as rounds of joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.staging import Staged, drop_staged, stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): component is the smallest node reachable; rounds of joins, see ``_components``. What the rows are read from stays in the shared folder."""
    return _components(edges, src, dst, max_rounds)[0]


def staged_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """The components as a staged table; nothing else of theirs is left in the shared folder."""
    found, rest = _components(edges, src, dst, max_rounds)
    written = stage(found, "components")
    for done in rest:
        drop_staged(done)
    return written


def _components(edges: DataFrame, src: str, dst: str, max_rounds: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Rows (node, component): component is the smallest node reachable.

    Large-star / small-star rounds on edges that point from the larger to the smaller node. Each
    round is two aggregations of minima (combined before the shuffle) joined back to the
    edges; a hub is a join key that adaptive execution can split, never a collected list. Rounds
    grow with the logarithm of the longest path. Self-loops are kept as nodes of their own
    component; rows with a null end are ignored. Raises if ``max_rounds`` do not settle it.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = ends.where("u = v").select(F.col("u").alias("node"))
    now = stage(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops = stage(nodes.distinct(), "loops")
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = _mark(after)
        if mark[0]:
            drop_staged(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).union(loops).distinct()
    roots = roots.join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), (now, loops)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def first_wins(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst", max_rounds: int = 1000, task_edges: int = 200_000) -> DataFrame:
    """The nodes that a loop in ascending order keeps when each kept node drops its later neighbours. Rows: (node).

    Connected components are independent: each of up to ``task_edges`` edges is settled in one task. Larger ones are cut into ranges of nodes of so many
    edges; see ``_settle_ranges``. Null nodes and edges with a null end are ignored. Raises if ``max_rounds`` do not settle it.
    """
    every = nodes.select(F.col(node).alias("n")).where("n is not null").distinct()
    with Staged() as staged:
        links = staged(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"), (F.col(src) != F.col(dst)).alias("_two")).where("_two").select("a", "b").distinct(), "links")
        parts = staged_components(links, "a", "b")
        staged.tables.append(parts)
        dealt = links.join(parts, links.a == parts.node).select("a", "b", "component")
        sizes = staged(dealt.groupBy("component").agg(F.count("*").alias("_m")), "sizes")
        kind = links.schema["a"].dataType.simpleString()

        def settle(rows):
            return pd.DataFrame({"n": [n for n, kept in _decided(rows.a, rows.b, [0] * len(rows), True) if not kept]}, dtype=rows.a.dtype)

        small = dealt.join(sizes.where(F.col("_m") <= task_edges), "component")
        gone = staged.keep(staged(small.groupBy("component").applyInPandas(settle, f"n {kind}"), "dropped"))
        large = staged(dealt.join(sizes.where(F.col("_m") > task_edges), "component").select("a", "b"), "large")
        for found in _settle_ranges(large, kind, task_edges, max_rounds):
            gone = gone.unionByName(found.where("not kept").select("n"))
    return every.join(gone, "n", "left_anti").withColumnRenamed("n", node)


def _decided(a, b, state, whole: bool) -> list[tuple]:
    """(node, kept) of the nodes that a loop in ascending order can decide from the edges (later node, earlier node) of a range of later nodes.

    ``state`` of the earlier node is 1 if it is known to be kept, 2 if dropped, else 0: then it is decided here before, or not yet. With ``whole`` the
    edges are a whole component: an earlier node that is nowhere a later one is kept.
    """
    own = set(a)
    found: dict = {}
    now, hit, open_ = None, False, False

    def close() -> None:
        if now is not None and (hit or not open_):
            found[now] = not hit

    for x, y, s in sorted(zip(a, b, state, strict=True)):
        if x != now:
            close()
            now, hit, open_ = x, False, False
        if s == 0:
            # nodes come in order, so y has had its turn
            kept = found.get(y, None if y in own or not whole else True)
        else:
            kept = s == 1
        hit, open_ = hit or kept is True, open_ or kept is None
    close()
    return list(found.items())


def _settle_ranges(edges: DataFrame, kind: str, task_edges: int, max_rounds: int) -> list[DataFrame]:
    """Staged tables (n, kept) that decide every node of the edges (a later, b earlier).

    Nodes are cut into ranges by order, with about ``task_edges`` edges to earlier nodes each. In a round every range goes through its nodes in order as far as they
    depend on its own or on decided ones, so a chain of dependencies costs a round only where it enters another range; what is decided then goes to
    the edges by a join. A node with more than ``task_edges`` earlier neighbours is decided by an aggregate instead, partly before the shuffle.
    """
    out: list[DataFrame] = []
    total = edges.count()
    if not total:
        return out
    ranges = max(1, -(-total // task_edges))
    wide = stage(edges.groupBy("a").agg(F.count("*").alias("_m")).where(F.col("_m") > task_edges).select("a"), "wide")
    roots = stage(edges.select(F.col("b").alias("n")).distinct().join(edges.select(F.col("a").alias("n")), "n", "left_anti").withColumn("kept", F.lit(True)), "decided")
    narrow = edges.join(wide, "a", "left_anti").repartitionByRange(ranges, "a").withColumn("part", F.spark_partition_id())
    active = stage(narrow.unionByName(edges.join(wide, "a", "left_semi").withColumn("part", F.lit(-1))).withColumn("state", F.lit(0)), "active")
    out.append(roots)

    def settle(rows):
        found = _decided(rows.a, rows.b, rows.state, False)
        return pd.DataFrame({"n": [n for n, _ in found], "kept": [k for _, k in found]}).astype({"n": rows.a.dtype, "kept": bool})

    for _ in range(max_rounds):
        new = out[-1].select("n", "kept")
        known = active.join(new.withColumnRenamed("n", "a").select("a"), "a", "left_anti").join(new.withColumnRenamed("n", "b"), "b", "left")
        known = known.withColumn("state", F.when(F.col("kept").isNull(), F.col("state")).when(F.col("kept"), 1).otherwise(2)).select("a", "b", "part", "state")
        after = stage(known, "active")
        drop_staged(active)
        active = after
        if active.isEmpty():
            break
        told = active.where("part = -1").groupBy("a").agg(F.max((F.col("state") == 1).cast("int")).alias("hit"), F.min("state").alias("least"))
        of_wide = told.where("hit = 1 or least = 2").select(F.col("a").alias("n"), (F.col("hit") == 0).alias("kept"))
        out.append(stage(active.where("part >= 0").groupBy("part").applyInPandas(settle, f"n {kind}, kept boolean").unionByName(of_wide), "decided"))
    else:
        raise RuntimeError(f"suppression did not settle in {max_rounds} rounds")
    for done in (active, wide):
        drop_staged(done)
    return out
