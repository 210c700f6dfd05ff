"""Connected components by alternating star contraction.

Every step is a partial aggregation and an equi-join on node ids, so a hub with
many edges is combined before the shuffle and never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.shared import Scratch


def _marks(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list but the smallest of each component; component is that smallest node.

    Edges with a null end and self loops are ignored; repeated edges count
    once; an empty edge list has no components. Rounds grow with the logarithm
    of the longest path; exceeding max_rounds raises instead of returning
    unfinished labels.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    e = e.where("_a is not null and _b is not null and hi <> lo").select("hi", "lo").distinct()
    e = scratch.write(e, "e0")
    held = _marks(e)
    if not held[0]:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for turn in range(1, max_rounds + 1):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        step = large.join(low, "hi")
        small = step.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(step.select("hi", F.col("m").alias("lo"))).distinct()
        e = scratch.write(small, f"e{turn}")
        marks = _marks(e)
        scratch.drop(f"e{turn - 1}")
        if marks == held:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        held = marks
    raise RuntimeError(f"components unfinished after {max_rounds} rounds")
