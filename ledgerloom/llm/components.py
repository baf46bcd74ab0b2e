"""Connected components of a graph given as edges, by alternating star contraction.

Before each round the stored edges are contracted a chunk at a time, so that a round starts from stars
and few rounds are left. A chunk is bounded; what it holds of a larger graph the rounds put together.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch
from ledgerloom.operators.lookup import with_group_values

CHUNK = 1 << 17  # edges that a task contracts at once


def _stars(u, v):
    """Edges from every node to the smallest one it is connected with; the smallest has none."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(at, 2)
    own = np.arange(len(nodes))
    root = own.copy()
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return nodes[root != own], nodes[root[root != own]]


def _contract(batches, chunk):
    """The stars of each chunk of a partition's edges."""
    held, rows = [], 0

    def contracted():
        u, v = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(u, v)], ["u", "v"])

    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(2)])
        rows += batch.num_rows
        if rows >= chunk:
            yield contracted()
            held, rows = [], 0
    if held:
        yield contracted()


def _contracted(edges, rows, chunk):
    """The edges, `rows` in number, contracted in tasks of about a chunk."""
    tasks = max(1, -(-rows // chunk))
    return edges.coalesce(tasks).mapInArrow(partial(_contract, chunk=chunk), "u long, v long")


def _both(u, v, other_u, other_v):
    """Two edges of a row as rows; both come from one pass over the rows."""
    ends = [(u, v), (other_u, other_v)]
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends]))


def _to_smallest(edges):
    """Add the smallest neighbour of `u` to every edge; a hub's edges are split over many tasks."""
    return with_group_values(edges, ["u"], smallest=F.min("v"))


def _large_star(edges):
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    return (
        _to_smallest(edges.select(_both("u", "v", "v", "u")))
        .filter("v > u")
        .select(F.col("v").alias("u"), F.least("u", "smallest").alias("v"))
        .distinct()
    )


def _small_star(edges):
    """Every node (u > v on all edges) and its neighbours move to its smallest neighbour."""
    joined = _to_smallest(edges)
    return joined.select(_both("u", "smallest", "v", "smallest")).filter("u > v").distinct()


def _state(edges):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def connected_components(
    edges: DataFrame, scratch: Scratch, max_rounds: int = 50, chunk: int = CHUNK
) -> DataFrame:
    """Rows (node, component) for every node that has an edge to another one; `component` is the
    smallest node reachable.

    `edges` has two long columns `a` and `b`, in any direction and repeated at will; null ends and
    loops are left out. Each round contracts chunks of about `chunk` edges, makes two joins on hashed keys
    and is written to the shared folder; the number of rounds grows at most with the logarithm of the
    longest path. The driver sees four numbers per round, never an edge.
    """
    edges = (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = scratch.store(edges, "edges")
    rows = _state(edges)[0]
    for _ in range(max_rounds):
        stars = scratch.store(_contracted(edges, rows, chunk), "stars")
        scratch.drop(edges)
        before = _state(stars)
        edges = scratch.store(_small_star(_large_star(stars)), "edges")
        scratch.drop(stars)
        state = _state(edges)
        rows = state[0]
        if state == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))
            )
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
