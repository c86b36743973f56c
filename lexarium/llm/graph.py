"""Connected components of a table of links, without gathering them anywhere.

Alternating large-star and small-star rounds: each vertex hands its neighbours to the smallest of them, until every
vertex points to the smallest of its component.  A round costs two grouped minima and two joins; stars of any size are summed before the shuffle
and their joins can be split.  Links are first reduced to forests within Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Cuts


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links (a, b) and the smallest vertex of each one's component, by pointer jumping."""
    vertex, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertex))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            return vertex, vertex[label]
        label = new


def _reduced(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if len(a):
                vertex, label = smallest_labels(a, b)
                own = vertex != label
                yield pa.RecordBatch.from_arrays([pa.array(vertex[own]), pa.array(label[own])], names=["u", "v"])

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u bigint, v bigint")


def components(links: DataFrame, cuts: Cuts, name: str = "components") -> DataFrame:
    """(vertex, component) for every vertex of the links (u, v) that is not the smallest of its component."""
    now = cuts.cut(_reduced(links.where("u <> v")).distinct(), f"{name}0")
    rounds = 0
    while True:
        rounds += 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        parent = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(parent.select("u", F.col("m").alias("v")))
        after = cuts.cut(small.where("u <> v").distinct(), f"{name}{rounds}")
        # done when each vertex has one link, and it leads to a vertex that has none
        open_ = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        cuts.drop(f"{name}{rounds - 1}")
        now = after
        if not open_:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
