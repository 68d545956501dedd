"""Connected components of a link table: tasks contract the links they hold; what is left is contracted in one task if it holds it, else joined by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.llm import _words
from matrel.llm._io import written

#: Links a task holds before it contracts them, and below which one task finishes; bounds its memory.
HELD = 1 << 20


def roots(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[rows], root[cols])
        new = root.copy()
        # the label of a node's label goes down too, so that chains shrink by halves
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        np.minimum.at(new, root[rows], low)
        np.minimum.at(new, root[cols], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contracted(edges: DataFrame, least: bool = False) -> DataFrame:
    """Fewer links with the same components: in each task every node hangs on the least one it is connected with there; ``least``: that one on itself too."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def hung() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            a, b = (rows.column(k).to_numpy() for k in (0, 1))
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = roots(len(names), at[: len(a)], at[len(a) :])
            moved = np.arange(len(names)) if least else np.flatnonzero(root != np.arange(len(names)))
            own = rows.schema.field(0).type
            return pa.RecordBatch.from_arrays([pa.array(names[moved], own), pa.array(names[root[moved]], own)], names=["a", "b"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                held = [hung()]
                n = held[0].num_rows
                if n >= HELD // 2:  # little was gained: pass them on
                    yield held.pop()
                    n = 0
        if n:
            yield hung()

    return edges.mapInArrow(_words.tidy(run), f"a {kind}, b {kind}")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on links ``a > b``: every node hangs its neighbours on the least node it sees."""
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    # Written first, so that both sides of the join come from a shuffle of their own and a
    # node with very many links can be split over tasks.
    least = written(seen.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = seen.join(least, seen["a"] == least["u"])
    hung = joined.where(F.col("b") > F.col("a")) if large else joined.where(F.col("b") != F.col("m"))
    out = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a <> b").distinct()
    return written(out if large else _contracted(out).distinct(), "links")


def _loose(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one that itself hangs on another."""
    twice = edges.groupBy("a").count().where("count > 1").select("a")
    again = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return bool(twice.unionByName(again).head(1))


def components(links: DataFrame) -> DataFrame:
    """Rows ``id, component_id`` for every node of ``links`` (columns ``a, b``, of one orderable type).

    ``component_id`` is the least id reachable. Nodes without links aren't in the result.
    Links to oneself, repeated links and links with a null end count for nothing; an empty table gives none.
    No links or components are collected. Fewer than ``HELD`` contracted links need no shuffle; with more, each round is a few shuffles, of which
    there are about as many as the logarithm of the longest chain between tasks.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(_contracted(edges), "links")
    if edges.count() < HELD:
        return _contracted(edges.coalesce(1), least=True).toDF("id", "component_id")
    edges = written(edges.distinct(), "links")
    while _loose(edges):
        edges = _star(_star(edges, large=True), large=False)
    # links are now stars: (node, least)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(edges.groupBy(F.col("b").alias("id")).agg(F.min("b").alias("component_id")))
