"""Connected components of an edge table, by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Every half round needs each
node's smallest neighbour: an aggregation with map-side combine. The minima are written out before they
are joined back to the edges, so both sides of that join are exchanges and a hub's edges can be split
over tasks by the adaptive skew join. Edges shrink towards stars and the loop ends when a round
changes nothing. Lineage is cut by tables in the shared folder; each round's table is deleted
once the next is written.

An edge table of a proven small size (counted as it is written) goes to one task instead, which labels it in one pass: the
rounds of a small table are all fixed cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from goldlink.plans.scratch import discard, materialize
from goldlink.plans.workers import ship

#: Edges (16 bytes each) that one task may take.
LOCAL = 200_000

#: Below so many edges a round is one plan: no key can be large then, and each extra job costs more than it saves.
SMALL = 20_000


def smallest_in_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for edges a-b among range(n)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _at_once(edges: DataFrame) -> DataFrame:
    """node, component of at most ``LOCAL`` edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if read:
            u, v = (np.concatenate(x) for x in zip(*read, strict=True))
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = smallest_in_component(len(nodes), at[: len(u)], at[len(u) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])

    ship(edges.sparkSession)
    return edges.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def _write(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their count and checksums, taken while they are written."""
    seen = Observation()
    checks = (F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("a"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))).alias("b"))
    table = materialize(edges.observe(seen, *checks), "cc-edges")
    return table, tuple(seen.get[k] for k in ("n", "a", "b"))


def _half(edges: DataFrame, large: bool, cut: bool) -> tuple[DataFrame, DataFrame | None]:
    """One star operation on directed pairs (u > v); also the table of minima, if one was written."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select("u", "v")
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if cut:
        least = materialize(least, "cc-min")
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct(), least if cut else None


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` for every node with an edge; component is the smallest node of the group.

    Edges with a null end and self-loops are ignored. The result is backed by a table in the shared folder.
    """
    u, v = F.col(src), F.col(dst)
    current, before = _write(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    if 0 < before[0] <= LOCAL:
        out = materialize(_at_once(current), "cc-labels")
        discard(current)
        out._rounds = 1
        return out
    rounds = 0
    while before[0] > 0:
        if rounds == max_rounds:
            raise RuntimeError(f"no convergence after {max_rounds} rounds")
        rounds += 1
        cut = before[0] > SMALL
        middle, first = _half(current, True, cut)
        if cut:
            middle = materialize(middle, "cc-middle")
        after, second = _half(middle, False, cut)
        after, now = _write(after)
        for table in (first, middle, second, current):
            discard(table)
        current = after
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out._rounds = rounds
    return out
