"""Operator 2: near-duplicate embeddings by comparing blocks of vectors with a bound from few rotated coordinates.

All vectors of a label meet each other, in blocks of at most about ``CHUNK``. Of unit vectors after a fixed rotation, the
product of the leading coordinates and the product of the lengths of the rests sum up to a bound of the cosine. One
matrix product in single precision gives this bound for a tile of pairs; only pairs whose bound reaches the threshold,
less a margin for rounding, are decided by their cosine in double precision. Where a tile holds many such pairs, a product
of all coordinates decides those beyond the margin, and the others are decided one by one. So no link is lost or added.

Equal vectors of a label are one class and go through once. A block is one row, its vectors one binary value. A label of
one block is compared where that row is read. The blocks of larger labels meet in a cartesian product of the written
table's partitions, which reads them again and again but writes nothing: disk grows with the input, work with the square
of a label's vectors. Tasks return counts of links and edges of spanning forests, never the links themselves.

Only vectors with the same non-null label and dimension are compared. Vectors that are null, empty, zero or hold a null
or a non-finite number, and rows with a null id, link with nothing: no links, a component of their own.
"""

from __future__ import annotations

from collections import OrderedDict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices
from .components import Forest, connected_components
from .textops import GOLDEN, mix

#: Vectors of a block (about; fewer beyond 64 dimensions), blocks of a label that are written side by side, decoded blocks that a worker keeps.
CHUNK, BESIDE, DECODED = 16384, 4, 12
#: Rows and columns of a tile, the share of its pairs from which all coordinates are multiplied, and that of its links from
#: which they are summed up as a matrix.
ROWS, COLUMNS, MANY, DENSE = 256, 1024, 1 / 512, 1 / 16
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    if dim not in _rotations:
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))
        _rotations[dim] = q * np.sign(np.diag(r))
    return _rotations[dim]


def prepare(df: DataFrame, id_col: str, vector_col: str, label_col: str, vectors: bool) -> DataFrame:
    """(id, label, dim, s1, s2): comparable vectors, with a signature of the raw numbers. With ``vectors`` also (mult, wide, v):
    equal ones of a batch as one row of the smallest id, their number, and the raw numbers in single or double precision."""
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    wide = df.schema[vector_col].dataType.elementType.simpleString() != "float"

    def work(batches):
        for batch in slices(batches, rows=2048):
            lists = batch.column(2)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            start, flat = np.cumsum(size) - size, lists.flatten().to_numpy(zero_copy_only=False)  # a null number comes as NaN
            for dim in np.unique(size[size > 0]):
                at = np.flatnonzero(size == dim)
                x = flat[start[at][:, None] + np.arange(dim)].astype(np.float64) + 0.0
                with np.errstate(all="ignore"):
                    keep = np.isfinite(x).all(1) & ((x * x).sum(1) != 0.0)
                at, x = at[keep], x[keep]
                words = x.view(np.uint64)
                s1 = mix(words + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(GOLDEN)).sum(1, dtype=np.uint64).view(np.int64)
                s2 = np.bitwise_xor.reduce(mix(words ^ np.uint64(0x5851F42D4C957F2D)), axis=1).view(np.int64)
                out = pa.table({"id": batch.column(0).take(pa.array(at)), "label": batch.column(1).take(pa.array(at)), "dim": pa.array(np.full(len(at), dim, np.int32)), "s1": s1, "s2": s2})
                if vectors:
                    out = out.append_column("row", pa.array(np.arange(len(at)))).group_by(["label", "dim", "s1", "s2"]).aggregate([("id", "min"), ("id", "count"), ("row", "min")])
                    rows = (x if wide else x.astype(np.float32))[out["row_min"].to_numpy()]
                    out = pa.table({"id": out["id_min"], **{c: out[c] for c in ("label", "dim", "s1", "s2")}, "mult": out["id_count"], "wide": pa.array(np.full(len(rows), wide)), "v": pa.array([r.tobytes() for r in rows], pa.binary())})
                yield from out.to_batches()

    vector = F.col(vector_col).cast("array<double>") if wide else F.col(vector_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("x")).filter("id is not null and label is not null and x is not null")
    return rows.mapInArrow(work, f"id {kinds[0]}, label {kinds[1]}, dim int, s1 bigint, s2 bigint" + ", mult bigint, wide boolean, v binary" * vectors)


def blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """(label, dim, part, parts, wide, ids, mult, v): the classes of a label by the parts that ``large`` (label, dim, parts) names for it, one part otherwise."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        listed = lambda c: pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group[c].chunk(0))
        one = group.slice(0, 1).select(["label", "dim", "part", "parts", "wide"])
        return one.append_column("ids", listed("id")).append_column("mult", listed("mult")).append_column("v", pa.array([b"".join(group["v"].to_pylist())], pa.binary()))

    # equal vectors meet by their signature first, so that copies don't fill the group of a block
    rows = rows.groupBy("label", "dim", "s1", "s2").agg(F.min("id").alias("id"), F.sum("mult").alias("mult"), F.first("wide").alias("wide"), F.first("v").alias("v"))
    # rows of a large label that fall into neighbouring parts are written by the same task
    dealt = rows.join(F.broadcast(large), ["label", "dim"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod("s1", "parts").cast("int"))
    dealt = dealt.withColumn("beside", F.xxhash64("label", "dim", F.floor(F.col("part") / BESIDE)))
    return dealt.repartition("beside").groupBy("beside", "label", "dim", "part").applyInArrow(work, f"label {kinds['label']}, dim int, part int, parts int, wide boolean, ids array<{kinds['id']}>, mult array<bigint>, v binary")


class Block:
    """A decoded block: raw numbers, their lengths, unit vectors after the rotation, and leading coordinates with the length of the rest."""

    def __init__(self, ids: pa.Array, mult: np.ndarray, wide: bool, v: bytes, cosine: float):
        self.plain = bool((mult == 1).all())
        self.raw = np.frombuffer(v, np.float64 if wide else np.float32).reshape(len(ids), -1)
        x = self.raw.astype(np.float64)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((x * x).sum(1))
            extreme = ~np.isfinite(self.norm) | (self.norm < 1e-150)
        if extreme.any():  # scaled first
            x[extreme] /= np.abs(x[extreme]).max(1)[:, None]
            self.raw, self.norm = x, np.sqrt((x * x).sum(1))
        dim = x.shape[1]
        unit = (x / self.norm[:, None]) @ rotation(dim).T
        # enough coordinates that few pairs of random directions pass; only the speed depends on it
        lead = 20 + int(1.8 * (1 - cosine) * dim)
        # rows of one orthant stand together, so that close vectors fill few tiles and most tiles hold none
        order = np.argsort((unit[:, :12] > 0) @ (1 << np.arange(min(12, dim))), kind="stable")
        self.ids, self.mult, self.raw, self.norm, unit = ids.take(pa.array(order)), mult[order], self.raw[order], self.norm[order], unit[order]
        self.unit = unit.astype(np.float32)
        self.lead = np.concatenate([unit[:, :lead], np.sqrt((unit[:, lead:] ** 2).sum(1))[:, None]], 1).astype(np.float32) if lead + 1 < dim else self.unit

    def decide(self, p: np.ndarray, other: Block, q: np.ndarray, cosine: float) -> np.ndarray:
        out = np.empty(len(p), bool)
        for at in range(0, len(p), 65536):
            i, j = p[at : at + 65536], q[at : at + 65536]
            out[at : at + 65536] = np.einsum("ij,ij->i", self.raw[i].astype(np.float64), other.raw[j].astype(np.float64)) / (self.norm[i] * other.norm[j]) >= cosine
        return out


def margin(n: int) -> float:
    """More than single precision errs in a product of two unit vectors of ``n`` coordinates."""
    return 2.5e-7 * (n + 8)


def compare(x: Block, y: Block, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of ``x`` and of ``y``, and edges (rows of x, rows of y) that connect what the links connect."""
    same = x is y
    nx, ny = np.zeros(len(x.ids), np.int64), np.zeros(len(y.ids), np.int64)
    forest = Forest(len(nx) + len(ny))
    low, high = np.float32(cosine - margin(x.lead.shape[1])), margin(x.unit.shape[1])
    bound, tile, bits = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, bool)
    waiting: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}

    def settle() -> None:
        for decided, pairs in waiting.items():
            if pairs:
                p, q = (np.concatenate(k) for k in zip(*pairs))
                pairs.clear()
                if not decided:
                    ok = x.decide(p, y, q, cosine)
                    p, q = p[ok], q[ok]
                np.add.at(nx, p, y.mult[q])
                np.add.at(ny, q, x.mult[p])
                forest.link(p, q if same else q + len(nx))

    size = 0
    for a in range(0, len(nx), ROWS):
        r = slice(a, min(len(nx), a + ROWS))
        for b in range(a // COLUMNS * COLUMNS if same else 0, len(ny), COLUMNS):
            c = slice(b, min(len(ny), b + COLUMNS))
            shape = (r.stop - r.start, c.stop - c.start)
            area = shape[0] * shape[1]
            g, hit = bound[:area].reshape(shape), bits[:area].reshape(shape)
            np.matmul(x.lead[r], y.lead[c].T, out=g)
            if g.max() < low:
                continue
            np.greater_equal(g, low, out=hit)
            if same and b < r.stop:
                hit &= np.arange(r.start, r.stop)[:, None] < np.arange(c.start, c.stop)[None, :]
            n = np.count_nonzero(hit)
            decided = n >= MANY * area
            if decided:
                full = tile[:area].reshape(shape)
                np.matmul(x.unit[r], y.unit[c].T, out=full)
                hit &= full >= np.float32(cosine - high)
                p, q = np.divmod(np.flatnonzero(hit & (full < np.float32(cosine + high))), shape[1])
                hit[p, q] = x.decide(p + a, y, q + b, cosine)
                n = np.count_nonzero(hit)
                if n >= DENSE * area:
                    nx[r] += np.add.reduce(hit.view(np.uint8), 1, dtype=np.int32) if y.plain else (hit @ y.mult[c].astype(np.float64)).astype(np.int64)
                    ny[c] += np.add.reduce(hit.view(np.uint8), 0, dtype=np.int32) if x.plain else (x.mult[r].astype(np.float64) @ hit).astype(np.int64)
                    left, right = np.arange(r.start, r.stop), np.arange(c.start, c.stop) + (0 if same else len(nx))
                    while True:  # of the links between trees one for each row and column, until there are none
                        u, w = forest.root[left], forest.root[right]
                        if (u == u[0]).all() and (w == u[0]).all():
                            break
                        hit &= u[:, None] != w[None, :]
                        row, column = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                        if not len(row):
                            break
                        forest.link(np.concatenate([left[row], left[hit[:, column].argmax(0)]]), np.concatenate([right[hit[row].argmax(1)], right[column]]))
                    continue
            if n:
                p, q = np.divmod(np.flatnonzero(hit), shape[1])
                waiting[decided].append((p + a, q + b))
                size += n
                if size > 1 << 16:
                    settle()
                    size = 0
    settle()
    if same:
        nx += ny
        ny = np.zeros(0, np.int64)
    tied = np.flatnonzero(forest.root != np.arange(len(forest.root)))
    return nx, ny, tied, forest.root[tied]


class Tally:
    """Links and trees over the blocks that one task has met."""

    def __init__(self) -> None:
        self.at: dict = {}
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.size, self.edges = 0, []

    def place(self, key: tuple, block: Block) -> int:
        if key not in self.at:
            self.at[key] = (len(self.ids), self.size)
            self.ids.append(block.ids)
            self.counts.append(np.zeros(len(block.ids), np.int64))
            self.size += len(block.ids)
        return self.at[key]

    def add(self, keys: tuple, x: Block, y: Block, cosine: float) -> None:
        (i, left), (j, right) = self.place(keys[0], x), self.place(keys[1], y)
        nx, ny, a, b = compare(x, y, cosine)
        self.counts[i] += nx
        if x is not y:
            self.counts[j] += ny
        if len(a):
            n = len(x.ids)
            self.edges.append(np.stack([np.where(e < n, e + left, e - n + right) for e in (a, b)]))

    def batches(self):
        if not self.ids:
            return
        forest, count = Forest(self.size), np.concatenate(self.counts)
        if self.edges:
            forest.link(*np.concatenate(self.edges, axis=1))
        ids = pa.concat_arrays(self.ids)
        some, tied = np.flatnonzero(count), np.flatnonzero(forest.root != np.arange(self.size))
        if len(some):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.nulls(len(some), ids.type), pa.array(count[some])], ["id", "other", "n"])
        if len(tied):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(tied)), ids.take(pa.array(forest.root[tied])), pa.array(np.zeros(len(tied), np.int64))], ["id", "other", "n"])


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Rows of blocks are large: few go to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


PARTS = ("label", "dim", "part", "ids", "mult", "wide", "v")


def links(table: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(id, other, n): links of ``id`` counted in a task, or (other not null) an edge of a spanning forest. Takes one block
    in each row, or two with the columns of the second after the first's."""
    pairs = len(table.columns) > len(PARTS)

    def work(batches):
        known: OrderedDict[tuple, Block] = OrderedDict()

        def block(batch: pa.RecordBatch, i: int, at: int) -> tuple[tuple, Block]:
            key = tuple(batch.column(at + k)[i].as_py() for k in range(3))
            if key in known:
                known.move_to_end(key)
            else:
                ids, mult, wide, v = (batch.column(at + k)[i] for k in range(3, 7))
                known[key] = Block(ids.values, mult.values.to_numpy(), wide.as_py(), v.as_py(), cosine)
                if len(known) > DECODED:
                    known.popitem(last=False)
            return key, known[key]

        tally = Tally()
        for batch in batches:
            for i in range(batch.num_rows):
                k, x = block(batch, i, 0)
                m, y = block(batch, i, len(PARTS)) if pairs else (k, x)
                tally.add((k, m), x, y, cosine)
            if not pairs and tally.size > 1 << 18:  # a label of one block is met once
                yield from tally.batches()
                tally = Tally()
        yield from tally.batches()

    return table.mapInArrow(work, f"id {kind}, other {kind}, n bigint")


def near_duplicates(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``df``: the id, ``n_links`` (other vectors linked directly), ``component_id`` and ``kept``."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    ready = materialize(prepare(df, id_col, vector_col, label_col, vectors=False))
    same = ["label", "dim", "s1", "s2"]
    classes = ready.groupBy(*same).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"))
    # a count that is a little off makes blocks a little larger or smaller
    of_label = ready.groupBy("label", "dim").agg(F.approx_count_distinct("s1").alias("m"))
    parts = F.ceil(F.col("m") * F.greatest(F.col("dim") / 64, F.lit(1.0)) / CHUNK).cast("int")
    large = materialize(of_label.select("label", "dim", parts.alias("parts")).filter("parts > 1"))
    dealt = materialize(blocks(prepare(df, id_col, vector_col, label_col, vectors=True), large))
    with batch_rows(spark, 8):
        found = materialize(links(dealt.filter("parts = 1").select(*PARTS), cosine, kind))
    if not large.isEmpty():
        x = dealt.filter("parts > 1").select(*(F.col(c).alias(f"x_{c}") for c in PARTS))
        y = dealt.filter("parts > 1").select(*(F.col(c).alias(f"y_{c}") for c in PARTS))
        # not as an equality, for which all blocks of a label would be moved to one task
        meet = (F.col("x_label") <= F.col("y_label")) & (F.col("x_label") >= F.col("y_label")) & (F.col("x_dim") <= F.col("y_dim")) & (F.col("x_dim") >= F.col("y_dim")) & (F.col("x_part") <= F.col("y_part"))
        with batch_rows(spark, 1):
            found = found.unionAll(materialize(links(x.join(y.hint("shuffle_replicate_nl"), meet), cosine, kind)))
    counts = found.filter("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("other is not null"), "id", "other")
    known = classes.select(*same, F.col("id").alias("r"), "mult").join(counts.withColumnRenamed("id", "r"), "r", "left").join(roots.withColumnRenamed("id", "r"), "r", "left")
    known = known.select(*same, (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "r").alias("c"))
    linked = ready.select("id", *same).join(known, same).select("id", "n", "c")
    # rows that can't be compared: as often as they occur beyond the comparable rows of their id
    usable = ready.groupBy("id").agg(F.count(F.lit(1)).alias("used"))
    total = df.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("all"))
    alone = total.join(usable, "id", "left").withColumn("left", F.col("all") - F.coalesce("used", F.lit(0))).filter("left > 0")
    alone = alone.select("id", F.explode(F.sequence(F.lit(1), F.col("left").cast("int"))).alias("x")).select("id", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("c"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
