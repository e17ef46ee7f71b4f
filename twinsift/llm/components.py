"""Connected components of an undirected graph kept as a table of edges: stars within tasks, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from twinsift.llm._util import forget, materialise

_CHUNK = 1 << 20  # edges that a task joins at once


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that are not their component's smallest, and that smallest node of each."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    low = np.arange(len(nodes))
    while len(x):
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], m)
        np.minimum.at(low, low[y], m)
        while not np.array_equal(jumped := low[low], low):
            low = jumped
        apart = low[x] != low[y]
        x, y = x[apart], y[apart]
    some = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[some], nodes[low[some]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, a chunk of them at a time, as the stars of what they join: never more edges, and no long paths."""
    held, n = [], 0

    def close():
        u, v = stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= _CHUNK:
            yield close()
            held, n = [], 0
    if n:
        yield close()


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """edges as a table, and their number and the sum of their hashes, from the write itself."""
    seen = Observation(name)
    out = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> node, component (the smallest node that edges reach).

    Nulls and loops are left out; repeated edges count once; no edges, no rows. Each task first joins its own edges into
    stars. Then every node's minimum comes from a partially aggregated group and is written before the edges are joined
    with it, so Spark can split a node that a third of the edges share. Each round is written to the shared scratch
    folder, so a lost executor costs one round at most.
    """
    given = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    now, seen = _counted(given.mapInArrow(_contract, "u long, v long").distinct(), "start")
    forget(given)
    for turn in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        forget(low)
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # u is the larger end here, and each has few
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        after, state = _counted(small, f"round {turn}")
        forget(now)
        forget(large)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._twinsift_path = now._twinsift_path  # so that the caller can forget() it
    return out
