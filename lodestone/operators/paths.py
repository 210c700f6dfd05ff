"""Shortest paths with their nodes by a search from both ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lodestone.shared import Scratch


def shortest_paths(edges: DataFrame, pairs: DataFrame, *, max_depth: int = 5) -> DataFrame:
    """(source, target, length, path) of the pairs(source, target) joined by at most max_depth undirected edges(a, b).

    path is the array of nodes from source to target; of several shortest ones
    the first by its nodes in order. A node is joined to itself by itself alone.
    Null ends, repeated pairs and repeated edges count once or not at all; pairs
    out of reach have no row.

    Levels grow from both ends in turn, of the sources and targets still
    unjoined only, so that a search of depth d reads neighbours of neighbours
    d / 2 deep. Where two levels first meet, the nodes that stand on a shortest
    path are found back through the levels, and the path is walked among these.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.write(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    wanted = pairs.where("source is not null and target is not null").select("source", "target").distinct()
    alone = wanted.where("source = target").select("source", "target", F.lit(0).alias("length"), F.array("source").alias("path"))
    rest = scratch.write(wanted.where("source <> target"), "wanted")
    levels: dict[str, list[DataFrame]] = {side: [rest.select(F.col(side), F.col(side).alias("node")).distinct()] for side in ("source", "target")}
    out = [alone]
    for depth in range(1, max_depth + 1):
        side = "source" if depth % 2 else "target"
        known = levels[side]
        front = known[-1].join(rest.select(side).distinct(), side, "left_semi")
        step = front.join(both, front["node"] == both["a"]).select(side, F.col("b").alias("node")).distinct()
        # Neighbours of a level stand in it, in the one before or in the next.
        for old in known[-2:]:
            step = step.join(old, [side, "node"], "left_anti")
        known.append(scratch.write(step, f"{side}{depth}"))
        ahead, back = levels["source"], levels["target"]
        met = rest.join(ahead[-1], "source").join(back[-1], ["target", "node"]).select("source", "target", "node")
        met = scratch.write(met, f"met{depth}")
        if not met.isEmpty():
            out.append(_walked(met, both, ahead, back, scratch, depth))
            rest = scratch.write(rest.join(met.select("source", "target").distinct(), ["source", "target"], "left_anti"), f"rest{depth}")
            if rest.isEmpty():
                break
    return reduce(DataFrame.unionByName, out)


def _walked(met: DataFrame, both: DataFrame, ahead: list[DataFrame], back: list[DataFrame], scratch: Scratch, depth: int) -> DataFrame:
    """The paths of pairs whose levels meet at `depth` edges."""
    pair = ["source", "target"]
    half = len(ahead) - 1
    on = {half: met}
    for i in range(half - 1, -1, -1):  # towards the source
        near = on[i + 1].join(both, on[i + 1]["node"] == both["a"]).select(*pair, F.col("b").alias("node")).distinct()
        on[i] = near.join(ahead[i], ["source", "node"], "left_semi")
    for i in range(half + 1, depth + 1):  # towards the target
        near = on[i - 1].join(both, on[i - 1]["node"] == both["a"]).select(*pair, F.col("b").alias("node")).distinct()
        on[i] = near.join(back[depth - i], ["target", "node"], "left_semi")
    on = {i: scratch.write(df, f"on{depth}-{i}") for i, df in on.items()}
    path = on[0].select(*pair, F.col("node").alias("at"), F.array("node").alias("path"))
    for i in range(1, depth + 1):
        step = path.join(both, path["at"] == both["a"]).select(*pair, "path", F.col("b").alias("node"))
        step = step.join(on[i], [*pair, "node"], "left_semi").groupBy(*pair).agg(F.min(F.struct("node", "path")).alias("s"))
        path = step.select(*pair, F.col("s.node").alias("at"), F.concat("s.path", F.array("s.node")).alias("path"))
    return path.select(*pair, F.lit(depth).alias("length"), "path")


def neighbourhoods(edges: DataFrame, starts: DataFrame, *, max_depth: int = 2) -> DataFrame:
    """(start, node, depth, outward, inward) of the nodes within max_depth edges(a, b) of each of starts(node), along them, against them or both.

    depth is the least either way; outward and inward are the least along and
    against the edges, null where there is none. A start is its own at depth 0.
    """
    scratch = Scratch(edges.sparkSession, "around")
    own = starts.where("node is not null").select(F.col("node").alias("start"), "node").distinct()
    edges = scratch.write(edges.where("a is not null and b is not null").select("a", "b").distinct(), "edges")
    found = {}
    for name, a, b in (("outward", "a", "b"), ("inward", "b", "a")):
        seen, front = own.withColumn("depth", F.lit(0)), own
        for depth in range(1, max_depth + 1):
            step = front.join(edges, front["node"] == edges[a]).select("start", F.col(b).alias("node")).distinct()
            front = scratch.write(step.join(seen, ["start", "node"], "left_anti"), f"{name}{depth}")
            seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
        found[name] = seen.select("start", "node", F.col("depth").alias(name))
    both = found["outward"].join(found["inward"], ["start", "node"], "full_outer")
    return both.select("start", "node", F.least("outward", "inward").alias("depth"), "outward", "inward")
