"""Connected components over edge tables of any size, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


class Forest:
    """Components of rows of one task, by hooking and pointer jumping over arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(up := root[root], root):
                root[:] = up


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(r)


def _written(least: DataFrame, made: list) -> DataFrame:
    """Minima, written before they are joined back, so that a hub's edges can be split over tasks."""
    made.append(materialize(least))
    return made[-1]


def _large(edges: DataFrame, made: list) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = _written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), made)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small(edges: DataFrame, made: list) -> DataFrame:
    least = _written(edges.groupBy("hi").agg(F.min("lo").alias("m")), made)
    moved = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, limit: int = 60) -> DataFrame:
    """(id, component): the smallest vertex reachable from each vertex of an edge; vertices without an edge are absent.

    Each round is two grouped minima joined back to their edges; a hub's edges need not fit one task, and no list of
    neighbours is gathered. Rounds grow with the logarithm of the vertices. Tables of a round replace the last one's.
    """
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = materialize(now)
    state = _state(now)
    for _ in range(limit):
        if state[0] == 0:
            break
        made: list[DataFrame] = []
        stars = materialize(_large(now, made))
        new = materialize(_small(stars, made))
        for old in (now, stars, *made):
            drop_materialized(old)
        now, last, state = new, state, _state(new)
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(roots)
