"""Connected components: within one task while the edges are few, by alternating large-star and small-star steps otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.labels import least_labels
from quire.llm.tables import dropped, mapped, written

#: Distinct edges up to which one task (some 100 MB) solves the graph; each step in DataFrames costs the driver memory.
FEW = 1 << 20


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in batches]
    if held:
        edges = np.concatenate(held, axis=1)
        node, index = np.unique(edges, return_inverse=True)
        u, v = index.reshape(edges.shape)
        component = node[least_labels(u, v, len(node))]
        for k in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (node, component)], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)`` for each node on an edge; the label is the smallest node.

    No edges give an empty table; loops and repeated edges are harmless; null ends are ignored. Up to ``FEW``
    distinct edges are solved by one task, more of them in DataFrames, with the same rows. Each step is a partial-aggregated minimum and an equi-join whose large keys adaptive execution can split; a
    star with any number of points takes the same few steps.
    """
    now = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if now.count() <= FEW:
        return mapped(now.coalesce(1), _solved, "node long, component long")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = new
        if tuple(got) == mark:
            break
        mark = tuple(got)
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return stars.unionByName(roots.select("node", F.col("node").alias("component")))
