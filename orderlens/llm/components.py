"""Distributed connected components by randomised contraction.

Every round each vertex takes the neighbour (or itself) that comes first in a fresh pseudorandom
order as its representative, and edges are contracted onto representatives. The number of vertices
that still have edges falls by a constant factor a round in expectation whatever the graph's shape:
long chains and hubs alike. Representatives are chosen by an aggregate that combines before the
shuffle, so a hub that holds a third of all edges costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.llm.store import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (columns a, b of one type, self-loops allowed).

    Nulls, repeated edges and both directions are fine. Vertices are in one component exactly when
    they have the same root, which is one of its members (not necessarily the smallest).
    """
    kind = edges.schema["a"].dataType
    live = edges.select("a", "b").where("a is not null and b is not null").distinct()
    live = scratch.write(live, f"{name}-edges-0")
    ids = live.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = scratch.write(ids.withColumn("root", F.col("id").cast(kind)), f"{name}-labels-0")
    n = 0
    while not live.where("a != b").isEmpty():
        n += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("o"), c.alias("v"))  # noqa: E731, B023
        both = (live.where("a != b").select("a", "b")
                .select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
                                          F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w"))
        # the order's hash and the vertex as two long-friendly aggregates would lose ties: the struct keeps them
        chosen = (both.groupBy("v").agg(F.min(order(F.col("w"))).alias("m"))
                  .select("v", F.least(F.col("m"), order(F.col("v")))["v"].alias("to")))
        chosen = scratch.write(chosen, f"{name}-chosen-{n}")
        a, b = (chosen.select(F.col("v").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        contracted = (live.where("a != b").join(a, "a").join(b, "b").where("to_a != to_b")
                      .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        live = scratch.write(contracted, f"{name}-edges-{n}")
        step = chosen.select(F.col("v").alias("root"), "to")
        labels = scratch.write(labels.join(step, "root", "left").select("id", F.coalesce("to", "root").alias("root")), f"{name}-labels-{n}")
        scratch.drop(f"{name}-edges-{n - 1}", f"{name}-labels-{n - 1}", f"{name}-chosen-{n}")
    return labels
