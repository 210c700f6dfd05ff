"""Property-graph operators over nodes(label, id, …) and edges(src_label, src_id, rel, dst_label, dst_id, confidence, …)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.ordered import placed
from lodestone.shared import Scratch, unused

END = ("src_label", "src_id", "dst_label", "dst_id")


def merged_nodes(batches: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """Nodes of several loads in order: of each (label, id) and field the first value that isn't null."""
    union = None
    for i, b in enumerate(batches):
        part = b.select("label", "id", *fields, F.lit(i).alias("_load"))
        union = part if union is None else union.unionByName(part)
    firsts = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_load"))).alias(c) for c in fields]
    return union.where("id is not null").groupBy("label", "id").agg(*firsts)


def merged_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, one of each (src, rel, dst): the most confident."""
    src = nodes.select(F.col("label").alias("src_label"), F.col("id").alias("src_id"))
    dst = nodes.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id"))
    live = edges.join(src, ["src_label", "src_id"], "left_semi").join(dst, ["dst_label", "dst_id"], "left_semi")
    return live.groupBy(*END, "rel").agg(F.max("confidence").alias("confidence"))


def with_reverse(edges: DataFrame, prefix: str = "rev_") -> DataFrame:
    """Edges and their reverses."""
    back = edges.select(F.col("dst_label").alias("src_label"), F.col("dst_id").alias("src_id"), F.concat(F.lit(prefix), "rel").alias("rel"), F.col("src_label").alias("dst_label"), F.col("src_id").alias("dst_id"), "confidence")
    return edges.select(*back.columns).unionByName(back)


def hop_scores(edges: DataFrame, start_label: str, end_label: str, *, max_hops: int = 3, middle: Sequence[str] = ()) -> DataFrame:
    """(start, end, hops, score, paths) over directed walks of 1 to max_hops edges through middle labels.

    A walk's score is the product of its confidences (1 for null); score is the
    best one's, at most 1. Walks that share an end are combined after each hop,
    so the middle of the search grows with pairs and not with walks.
    """
    step = edges.select("src_label", "src_id", "dst_label", "dst_id", F.coalesce("confidence", F.lit(1.0)).alias("c"))
    front = step.where(F.col("src_label") == start_label).groupBy(F.col("src_id").alias("start"), F.col("dst_label").alias("label"), F.col("dst_id").alias("at")).agg(F.max("c").alias("score"), F.count("*").alias("paths"))
    found = None
    for hop in range(1, max_hops + 1):
        ends = front.where(F.col("label") == end_label).select("start", F.col("at").alias("end"), F.lit(hop).alias("hops"), F.least(F.lit(1.0), "score").alias("score"), "paths")
        found = ends if found is None else found.unionByName(ends)
        if hop < max_hops:
            through = front.where(F.col("label").isin(*middle))
            front = through.join(step, (through["label"] == step["src_label"]) & (through["at"] == step["src_id"])).groupBy("start", F.col("dst_label").alias("label"), F.col("dst_id").alias("at")).agg(F.max(F.col("score") * F.col("c")).alias("score"), F.sum("paths").alias("paths"))
    return found


def bounded_paths(edges: DataFrame, start: Column, end: Column, *, max_depth: int = 4, least: float = 0.001, top: int | None = 10) -> DataFrame:
    """Undirected paths of 1 to max_depth distinct edges from nodes where `start` holds (on column node) to nodes where `end` does.

    edges has id, a, b, confidence. score is the geometric mean of confidences;
    paths under `least` go; the best `top` by score, then hops, then the text of
    the path are kept (None: all). Repeats of an edge are cut at every step.
    """
    both = edges.select("id", F.col("a").alias("x"), F.col("b").alias("y"), F.coalesce("confidence", F.lit(1.0)).alias("c")).unionByName(edges.select("id", F.col("b").alias("x"), F.col("a").alias("y"), F.coalesce("confidence", F.lit(1.0)).alias("c")))
    both = both.distinct()
    nodes = both.select(F.col("x").alias("node")).distinct()
    front = nodes.where(start).select("node", F.array("node").alias("path"), F.array().cast("array<string>").alias("used"), F.lit(1.0).alias("product"))
    goals = nodes.where(end).select(F.col("node").alias("goal"))
    found = None
    for depth in range(1, max_depth + 1):
        if depth == max_depth:  # only edges into a goal can end a path here
            both = both.join(goals, both["y"] == goals["goal"], "left_semi")
        front = front.join(both, front["node"] == both["x"]).where(~F.array_contains("used", F.col("id").cast("string")))
        front = front.select(F.col("y").alias("node"), F.concat("path", F.array("y")).alias("path"), F.concat("used", F.array(F.col("id").cast("string"))).alias("used"), (F.col("product") * F.col("c")).alias("product"))
        hits = front.join(goals, front["node"] == goals["goal"], "left_semi").select(F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"), F.lit(depth).alias("hops"), F.pow("product", F.lit(1.0 / depth)).alias("score"))
        found = hits if found is None else found.unionByName(hits)
    found = found.where(F.col("score") >= least)
    return found.orderBy(F.col("score").desc(), "hops", "path").limit(top) if top else found


def bfs(edges: DataFrame, starts: DataFrame, *, max_depth: int = 2) -> DataFrame:
    """(node, depth) of what starts(node) reach over undirected edges (a, b): each node once, at its least depth."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    seen = starts.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, max_depth + 1):
        front = front.join(both, front["node"] == both["x"]).select(F.col("y").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen


def explored(edges: DataFrame, starts: DataFrame, *, max_depth: int = 2) -> DataFrame:
    """edges that a walk of up to max_depth steps along their direction from starts(label, id) goes over, each once with the step that first does.

    A start that no edge leaves gives nothing.
    """
    front, found = starts.select("label", "id").distinct(), None
    keys = ["src_label", "src_id", "rel", "dst_label", "dst_id"]
    for depth in range(1, max_depth + 1):
        own = edges.join(front.select(F.col("label").alias("src_label"), F.col("id").alias("src_id")), ["src_label", "src_id"], "left_semi").dropDuplicates(keys)
        own = own.select(*edges.columns).withColumn("depth", F.lit(depth))
        found = own if found is None else found.unionByName(own.join(found.select(*keys), keys, "left_anti").select(*found.columns))
        front = own.select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id")).distinct()
    return found


def shortest_lengths(edges: DataFrame, starts: DataFrame, goals: DataFrame, *, max_depth: int = 5) -> DataFrame:
    """(node, depth) of the goals(node) reached from starts within max_depth steps."""
    return bfs(edges, starts, max_depth=max_depth).join(goals.select("node").distinct(), "node", "left_semi")


def neighbours(edges: DataFrame, node_label: str, node_id: object, *, most: int = 50) -> DataFrame:
    """Edges of one node in either direction: direction, rel, label, id, confidence; the most confident `most`."""
    out = edges.where((F.col("src_label") == node_label) & (F.col("src_id") == node_id)).select(F.lit("out").alias("direction"), "rel", F.col("dst_label").alias("label"), F.col("dst_id").alias("id"), "confidence")
    back = edges.where((F.col("dst_label") == node_label) & (F.col("dst_id") == node_id)).select(F.lit("in").alias("direction"), "rel", F.col("src_label").alias("label"), F.col("src_id").alias("id"), "confidence")
    return out.unionByName(back).orderBy(F.col("confidence").desc(), "direction", "rel", "label", "id").limit(most)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label, id and out_degree of every node, 0 where it has no edge."""
    count = edges.groupBy(F.col("src_label").alias("label"), F.col("src_id").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("label", "id").join(count, ["label", "id"], "left").fillna(0, ["out_degree"])


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, avg/max/min out-degree, isolated nodes, density."""
    touched = edges.select(F.col("src_label").alias("label"), F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id"))).distinct().withColumn("_t", F.lit(True))
    own = degrees(nodes, edges).join(touched, ["label", "id"], "left")
    row = own.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.avg("out_degree").alias("avg_degree"), F.max("out_degree").alias("max_degree"), F.min("out_degree").alias("min_degree"), F.count_if(F.col("_t").isNull()).alias("isolated"))
    return row.withColumn("density", F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))


def relation_summary(edges: DataFrame) -> DataFrame:
    """Per relation: edges and distinct ends."""
    return edges.groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src_id").alias("sources"), F.countDistinct("dst_id").alias("targets"))


def entity_counts(edges: DataFrame) -> DataFrame:
    """Distinct ids of each label at either end."""
    both = edges.select(F.col("src_label").alias("label"), F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id")))
    return both.distinct().groupBy("label").agg(F.count("*").alias("n"))


def wrong_directions(edges: DataFrame, allowed: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Edges whose (src_label, rel, dst_label) isn't allowed, counted."""
    ok = None
    for s, r, d in allowed:
        c = (F.col("src_label") == s) & (F.col("rel") == r) & (F.col("dst_label") == d)
        ok = c if ok is None else ok | c
    return edges.where(~ok).groupBy("src_label", "rel", "dst_label").agg(F.count("*").alias("n"))


#: Pairs of rows of one value that a task joins.
VALUE_PAIRS = 4_000_000


def derived_edges(left: DataFrame, right: DataFrame, via: str, rel: str, labels: tuple[str, str]) -> DataFrame:
    """Edges between left(src_id, via) and right(dst_id, via) that share a value, each once.

    Ends that share several values are joined at the least one only, so that the
    edges need no shuffle of their own. A value with many pairs is dealt over
    blocks of both sides.
    """
    def ends(df: DataFrame, key: str, out: str) -> DataFrame:
        lists = df.where(F.col(via).isNotNull()).groupBy(key).agg(F.collect_set(via).alias(out))
        return lists.withColumn("_via", F.explode(out)).withColumn(out, F.when(F.size(out) > 1, F.col(out)))

    l, r = ends(left, "src_id", "_l"), ends(right, "dst_id", "_r")
    met = l.groupBy("_via").agg(F.count("*").alias("_x")).join(r.groupBy("_via").agg(F.count("*").alias("_y")), "_via")
    n = F.least(F.ceil(F.sqrt(F.col("_x").cast("double") * F.col("_y") / VALUE_PAIRS)), F.lit(512)).cast("long")
    met = met.select("_via", n.alias("_b"))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return df.join(met, "_via").withColumn(own, F.pmod(F.xxhash64(key), F.col("_b"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1))).drop("_b")

    both = dealt(l, "src_id", "_p", "_q").join(dealt(r, "dst_id", "_q", "_p"), ["_via", "_p", "_q"])
    first = F.col("_l").isNull() | F.col("_r").isNull() | (F.col("_via") == F.array_min(F.array_intersect("_l", "_r")))
    return both.where(first).select(F.lit(labels[0]).alias("src_label"), "src_id", F.lit(rel).alias("rel"), F.lit(labels[1]).alias("dst_label"), "dst_id")


def edge_lists(edges: DataFrame) -> DataFrame:
    """(src_label, rel, dst_label) with the count of its different pairs and their digest, a sum that no order changes: nothing is gathered."""
    kind = ["src_label", "rel", "dst_label"]
    pairs = edges.select(*kind, F.concat_ws("-", F.col("src_id").cast("string"), F.col("dst_id").cast("string")).alias("pair")).distinct()
    share = F.conv(F.substring(F.md5(F.col("pair").cast("binary")), 1, 8), 16, 10).cast("long")
    return pairs.groupBy(*kind).agg(F.count("*").alias("pairs"), F.sum(share).alias("digest"))


def node_disjoint_edges(edges: DataFrame, split: Column, split_dst: Column) -> DataFrame:
    """Edges whose ends fall in the same split, which depends on each end's id alone."""
    other = unused("_d", edges)
    own = edges.withColumns({other: split_dst, unused("_s", edges): split})
    return own.where(F.col(other) == F.col(unused("_s", edges))).drop(other).drop("split").withColumnRenamed(unused("_s", edges), "split")


def _turn_of(i: Column, ahead: dict[str, Column]) -> Column:
    """Whether the i-th of equal components goes to a split: whether a j from 0 exists at which j plus the turns of the others before the split's j-th is i.

    ahead: for each other split how many of its turns come before the split's
    first one, less than 0 if it starts that many later.
    """
    (x, y) = ahead.values()
    tries = [i, F.floor((i - x) / 2), F.floor((i - y) / 2), F.floor((i - x - y) / 3)]

    def fits(j: Column) -> Column:
        return (j >= 0) & (j + F.greatest(F.lit(0), x + j) + F.greatest(F.lit(0), y + j) == i)

    out = fits(tries[0])
    for j in tries[1:]:
        out = out | fits(j)
    return out


def component_split(components: DataFrame, *, size: str | None = None, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(component, size, split): whole components, largest first, ties by their name, each to the split that is furthest below its target.

    components has a row for each member in `component`, or with `size` a row
    for each component. Targets are the whole parts of train and val of all
    members and the rest for test; equal shortfalls go to train, then val, then
    test. Empty input gives no rows; null components are left out.

    What a split lacks changes by one size while components are of one size, so
    that the turns of the splits follow from what they lack at its start: the
    loop runs over distinct sizes, of which n members have at most sqrt(2n), and
    components find their split by their place among those of their size.
    """
    own = components.where("component is not null")
    sizes = own.groupBy("component").agg(F.count("*").alias("size")) if size is None else own.select("component", F.col(size).cast("long").alias("size"))
    scratch = Scratch(components.sparkSession, "split")
    sizes = scratch.write(sizes, "sizes")
    runs = sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    total = sum(r["size"] * r["n"] for r in runs)
    lack = [int(total * train), int(total * val)]
    lack.append(total - sum(lack))
    rows, first = [], 0
    for r in runs:
        rows.append((r["size"], first, *lack))
        left = r["n"]
        lack = _dealt(lack, r["size"], left)
        first += left
    starts = scratch.spark.createDataFrame(rows, "size long, first long, train long, val long, test long")
    own = placed(sizes, [F.col("size").desc(), F.col("component")]).join(starts, "size").withColumn("i", F.col("position") - F.col("first"))
    names = ["train", "val", "test"]

    def ahead(name: str) -> dict[str, Column]:
        out = {}
        for other in names:
            if other != name:
                more = F.col(other) - F.col(name)
                before = names.index(other) < names.index(name)
                out[other] = F.floor(more / F.col("size")) + 1 if before else F.ceil(more / F.col("size"))
        return out

    split = F.when(_turn_of(F.col("i"), ahead("train")), "train").when(_turn_of(F.col("i"), ahead("val")), "val").otherwise("test")
    return own.select("component", "size", split.alias("split"))


def _dealt(lack: list[int], size: int, n: int) -> list[int]:
    """What three splits lack after n components of a size, each given to the one that lacks most, the first of equals."""

    def turn(k: int, j: int) -> int:
        """How many turns come before a split's j-th."""
        more = [lack[m] - lack[k] for m in range(3)]
        return j + sum(max(0, j + (more[m] // size + 1 if m < k else -(-more[m] // size))) for m in range(3) if m != k)

    return [x - size * bisect_left(range(n), n, key=lambda j, k=k: turn(k, j)) for k, x in enumerate(lack)]


#: Draws of a task.
DRAWS = 500_000


def weighted_negatives(left: DataFrame, right: DataFrame, known: DataFrame, a: str, b: str, per_left: int) -> DataFrame:
    """For each left id, per_left right ids that aren't known partners, drawn one after the other without repeats by weights 1 / (2 + degree).

    Draws fall on positions in the right ids by degree, by a hash of the left id
    and the draw's number; repeats and known partners are passed over. Left ids
    that these draws leave short (most of the right ids are known) get the rest
    from all their pairs, the least -ln(u) * (2 + degree) first, u from a hash of
    the pair; all get fewer where fewer are left.
    """
    from lodestone.operators.joins import all_pairs

    scratch = Scratch(left.sparkSession, "negatives")
    known = scratch.write(known.select(a, b).groupBy(a, b).agg(F.count("*").alias("_m")), "known")
    degree = known.groupBy(b).agg(F.sum("_m").alias("_deg"))
    pool = right.where(F.col(b).isNotNull()).select(b).distinct().join(degree, b, "left").fillna(0, ["_deg"]).select(b, "_deg")
    pool = scratch.write(pool, "pool")
    left = scratch.write(left.where(F.col(a).isNotNull()).select(a).distinct(), "left")
    classes = pool.groupBy("_deg").agg(F.count("*").alias("n")).orderBy("_deg").collect()
    if not classes:
        return all_pairs(left, pool).select(a, b)
    size = np.array([r["n"] for r in classes])
    start, upto = np.cumsum(size) - size, np.cumsum(size / (2.0 + np.array([r["_deg"] for r in classes])))

    @F.pandas_udf("long")
    def position(u: pd.Series, v: pd.Series) -> pd.Series:
        k = np.minimum(np.searchsorted(upto, u.to_numpy() * upto[-1], "right"), len(size) - 1)
        return pd.Series(start[k] + np.minimum((v.to_numpy() * size[k]).astype(np.int64), size[k] - 1))

    def share(digest: Column, at: int) -> Column:
        return (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    at = placed(pool, [F.col("_deg"), F.col(b)], position="_at").select(b, "_at")
    draws = 4 * per_left + 16
    # A fixed number of partitions: ids are few bytes and many draws, so they are not to be put together.
    drawn = left.repartition(max(1, -(-left.count() * draws // DRAWS)), a).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    own = F.md5(F.concat_ws(":", F.col(a).cast("string"), F.col("_n").cast("string")).cast("binary"))
    drawn = drawn.withColumn("_h", own).withColumn("_at", position(share(F.col("_h"), 1), share(F.col("_h"), 9)))
    drawn = drawn.join(at.hint("merge"), "_at").groupBy(a, b).agg(F.min("_n").alias("_n")).join(known, [a, b], "left_anti")
    picked = drawn.withColumn("_k", F.row_number().over(W.partitionBy(a).orderBy("_n"))).where(F.col("_k") <= per_left)
    picked = scratch.write(picked.select(a, b), "picked")
    short = left.join(picked.groupBy(a).agg(F.count("*").alias("_got")), a, "left").fillna(0, ["_got"]).where(F.col("_got") < per_left)
    short = scratch.write(short, "short")
    if short.isEmpty():
        return picked
    rest = all_pairs(short, pool).join(known, [a, b], "left_anti").join(picked, [a, b], "left_anti")
    u = share(F.md5(F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string")).cast("binary")), 1)
    rest = rest.withColumn("_k", F.row_number().over(W.partitionBy(a).orderBy(-F.log(u) * (2 + F.col("_deg")), b))).where(F.col("_k") + F.col("_got") <= per_left)
    return picked.unionByName(rest.select(a, b))
