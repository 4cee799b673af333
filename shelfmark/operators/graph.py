"""Connected components of a link table.

A table of at most SMALL_GRAPH links is worked on by one task, which holds some megabytes. A larger one takes rounds of minimum
labels with pointer jumping, in which all state stays distributed; each round is cut by a stored table, so a lost executor costs
one round at most. Group sums are combined before their shuffle, and the joins are plain equi-joins that adaptive execution
splits when skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import cut

MOST_ROUNDS = 100
#: Links that one task may hold.
SMALL_GRAPH = 500_000


def smallest_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes is linked with, itself included: hooking to minima and pointer jumping."""
    label = np.arange(n)
    while True:
        before = label
        low = np.minimum(label[u], label[v])
        label = label.copy()
        for end in (u, v):
            np.minimum.at(label, before[end], low)
            np.minimum.at(label, end, low)
        while (above := label[label] != label).any():
            label = np.where(above, label[label], label)
        if (label == before).all():
            return label


def _in_one_task(ends: DataFrame) -> DataFrame:
    """(node, component) of at most SMALL_GRAPH links."""
    kind = ends.schema["u"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            columns = [table["u"].to_numpy(), table["v"].to_numpy()]
            nodes, at = np.unique(np.concatenate(columns), return_inverse=True)
            label = smallest_reachable(at[: len(columns[0])], at[len(columns[0]) :], len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, table["u"].type), pa.array(nodes[label], table["u"].type)], ["node", "component"])

    return ends.repartition(1).mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL_GRAPH) -> DataFrame:
    """(node, component) for each node that has a link; component is the smallest node reachable.

    Rows with a null end, self links and repeated links add nothing; without links there are no rows.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    once = cut(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if isinstance(once.schema["u"].dataType, T.IntegralType | T.StringType) and once.count() <= small:
        return cut(_in_one_task(once))
    both = cut(once.union(once.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("component")))
    for _ in range(MOST_ROUNDS):
        around = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
        hooked = labels.join(around, F.col("node") == F.col("u")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("above"))
        jumped = cut(hooked.join(roots, F.col("component") == F.col("root")).select("node", "was", F.least("component", "above").alias("component")))
        changed = jumped.filter("was <> component").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")


def merge_components(labels: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, component) of known components with further links.

    labels is of connected_components, and edges, a stored table, has src and dst. Where there are many, only the new links, between components, are
    worked on.
    """
    fresh_links = edges.select("src", "dst")
    if not fresh_links.limit(1).count():
        return labels
    if labels.count() <= small // 2:
        return connected_components(fresh_links.unionByName(labels.select(F.col("node").alias("src"), F.col("component").alias("dst"))), small=small)
    known = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    between = fresh_links
    for end in ("src", "dst"):
        between = between.join(known, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_component", end)).drop("_node", "_component")
    moved = connected_components(between, small=small)
    fresh = moved.select("node", F.col("node").alias("component")).join(known, F.col("node") == F.col("_node"), "left_anti")
    above = moved.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    all_nodes = labels.select("node", "component").unionByName(fresh)
    return cut(all_nodes.join(above, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_component", "component").alias("component")))
