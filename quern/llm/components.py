"""Connected components by contraction, for ids that are hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import skew_lookup, staged


#: A graph of so many edges at most is finished in one task.
ONE_TASK = 1 << 20


def finished(edges: DataFrame) -> DataFrame:
    """node, root of a graph of ONE_TASK edges at most."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0), b.column(1)) for b in batches]
        if not parts:
            return
        a, b = (pa.concat_arrays([x[i] for x in parts]) for i in (0, 1))
        known = pa.concat_arrays([a, b]).dictionary_encode()
        at = known.indices.to_numpy()
        a, b = at[: len(a)], at[len(a) :]
        label = np.arange(len(known.dictionary))
        while True:  # every node takes the least label at the other ends of its edges, and that node's label
            old, least = label, np.minimum(label[a], label[b])
            label = label.copy()
            for end in (a, b, old[a], old[b]):
                np.minimum.at(label, end, least)
            while (label[label] != label).any():
                label = label[label]
            if (label == old).all():
                break
        nodes = known.dictionary
        for x in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([nodes.slice(x, 1 << 16), nodes.take(pa.array(label[x : x + (1 << 16)]))], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); the root is one node of the component.

    In each round every node points to the least of itself and its neighbours, edges are redrawn between the nodes
    pointed to, and equal ones and loops vanish.  As ids are hashes, a node is a local minimum with a chance that does
    not depend on the graph's shape, so the rounds grow with the logarithm of the nodes.  What is left of ONE_TASK edges
    or fewer is finished in one task.  Rounds are staged tables.
    Lookups of hubs go through skew_lookup, minima are pre-aggregated.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while (n := edges.count()) > ONE_TASK:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"), F.count("*").alias("degree")).select(F.col("a").alias("node"), "to", "degree"), "pointers", 2 * n)
        maps.append(to)
        left = skew_lookup(edges, to.select(F.col("node").alias("a"), F.col("to").alias("ta"), F.col("degree").alias("da")), "a", "da", 2 * n, F.col("b"))
        left = left.select("ta", "b")
        both = skew_lookup(left, to.select(F.col("node").alias("b"), F.col("to").alias("tb"), F.col("degree").alias("db")), "b", "db", 2 * n, F.col("ta"))
        edges = staged(both.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges", n)
    roots = staged(finished(edges), "finished", 2 * n)
    if not maps:
        return roots
    # From the last round back: the root of a node is the root of what it points to, if that has one.
    for to in reversed(maps):
        # How many nodes point to a node is at most one more than its degree in that round's graph.
        n, to = to.count(), to.select("node", "to")
        count = to.groupBy("to").agg(F.count("*").alias("pointing"))
        known = count.join(roots.select(F.col("node").alias("to"), "root"), "to", "left")
        found = skew_lookup(to, staged(known.select("to", F.coalesce("root", "to").alias("root"), "pointing"), "roots", n), "to", "pointing", n, F.col("node"))
        roots = found.select("node", "root")
    return staged(roots, "components", maps[0].count())
