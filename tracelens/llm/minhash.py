"""Operator 10: near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its distinct word shingles. One hash per shingle serves all registers: its first
bits name a bucket, and of the smallest rest in a bucket the register keeps the count of leading zeros and the mantissa
bits after them, 16 bits in all. Empty buckets borrow from fixed other ones. Bands of registers propose pairs; the
Jaccard estimate from the registers, corrected for chance collisions, drops clear misses; full sets confirm the rest.

Documents with equal sets are one class and go through once, whatever their number. In a bucket of a band each member
is first held against one hub only. Components of the confirmed links then show which buckets are settled; in the
others, members of different components are held against each other, so that every proposed link counts. Nothing is
capped. Members of the open buckets are gathered into families, whose documents meet as pairs of bounded chunks; there
products of incidence matrices give all intersections of those that share a bucket, and only edges of spanning forests
leave the task. A family of more than ``FAMILY`` documents meets bucket by bucket instead, which takes more copies of
texts and finds the same.

Null and empty texts, and null ids, link with nothing and form a component of their own. Of rows that repeat an id with
different texts the one with the smallest hash of its text takes part; the others link with nothing either, and stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import bytes_of, drop_materialized, hashed, materialize, slices, wanted_rows
from .components import Forest, connected_components

#: Registers, bits of their mantissa, bands and registers of a band.
REGISTERS, MANTISSA, BANDS, ROWS = 256, 10, 48, 5
#: Documents of a chunk, columns of an incidence matrix, and the most documents that go through as one family.
CHUNK, WIDTH, FAMILY = 1000, 4096, 20_000
_rng = np.random.Generator(np.random.PCG64(20250101))
BAND = np.stack([_rng.choice(REGISTERS, ROWS, replace=False) for _ in range(BANDS)])
BORROW = np.stack([_rng.permutation(REGISTERS) for _ in range(REGISTERS)])
SALT = _rng.integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
#: Chance that two registers of different sets agree although their minima differ.
COLLISION = 0.17 * 2.0**-MANTISSA * 2
#: Standard errors below the threshold at which the estimate rules a pair out.
SLACK = 7.0
_u = np.uint64


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles, A-Z lower-cased; of a shorter text, its word sequence as one."""
    _, _, h = textops.word_hashes(data, lower=True)
    if not len(h):
        return h
    return np.unique(textops.windows(h, min(k, len(h))))


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a sorted set, as two signed longs."""
    if not len(s):
        return 0, 0
    a = textops.mix(s * _u(textops.GOLDEN)).sum(dtype=_u)
    b = np.bitwise_xor.reduce(textops.mix(s ^ _u(0x5851F42D4C957F2D))) + _u(len(s))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def registers(s: np.ndarray) -> tuple[np.ndarray, int]:
    """Registers of a non-empty sorted set, and how many buckets held a shingle."""
    bits = REGISTERS.bit_length() - 1
    edges = np.arange(REGISTERS, dtype=_u) << _u(64 - bits)
    first = np.searchsorted(s, edges)
    stop = np.append(first[1:], len(s))
    full = first < stop
    rest = s[np.minimum(first, len(s) - 1)] << _u(bits)
    high, low = (rest >> _u(32)).astype(np.float64), (rest & _u(0xFFFFFFFF)).astype(np.float64)
    length = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    zeros = np.minimum(64 - length, 57)
    mantissa = ((rest << (zeros + 1).astype(_u)) >> _u(64 - MANTISSA)).astype(np.uint16)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa
    if not full.all():
        empty = np.flatnonzero(~full)
        out[empty] = out[BORROW[empty, full[BORROW[empty]].argmax(1)]]
    return out, int(full.sum())


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of all bands of registers (rows: documents)."""
    picked = regs[:, BAND].astype(_u) + _u(1)
    return textops.mix((textops.mix(picked * SALT)).sum(2, dtype=_u) ^ (np.arange(1, BANDS + 1, dtype=_u) * _u(textops.GOLDEN))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for collisions."""
    same = (a == b).mean(1)
    return np.clip((same - COLLISION) / (1 - COLLISION), 0, 1)


def sketch(rows: DataFrame, k: int) -> DataFrame:
    """(id, t, n, s1, s2, regs, full) of rows (id, t, text): set size, signature, registers and filled buckets."""
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, rows=512, size=4 << 20):
            n, s1, s2, regs, full = [], [], [], [], []
            for data in bytes_of(batch, "text"):
                s = shingles(data, k)
                a, b = signature(s)
                r, f = registers(s) if len(s) else (np.empty(0, np.uint16), 0)
                for column, value in zip((n, s1, s2, regs, full), (len(s), a, b, r.tobytes(), f)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip((n, s1, s2, regs, full), kinds))], ["id", "t", "n", "s1", "s2", "regs", "full"])

    return rows.select("id", "t", "text").mapInArrow(work, f"id {id_type}, t bigint, n bigint, s1 bigint, s2 bigint, regs binary, full int")


def bands(classes: DataFrame) -> DataFrame:
    """(key, id) for every band of every class."""

    def work(batches):
        for batch in slices(batches, rows=2048):
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel(), pa.int64()), ids], ["key", "id"])

    return classes.select("id", "regs").mapInArrow(work, f"key bigint, id {classes.schema['id'].dataType.simpleString()}")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that set sizes and the estimate don't rule out."""
    at = percent / 100
    kind = classes.schema["id"].dataType.simpleString()
    side = lambda c: classes.select(F.col("id").alias(c), F.struct("n", "full", "regs").alias(f"{c}_"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("a_.n", "b_.n") * 100 >= F.greatest("a_.n", "b_.n") * percent)
    flat = both.select("a", "b", F.least("a_.full", "b_.full").alias("m"), F.col("a_.regs").alias("x"), F.col("b_.regs").alias("y"))

    def work(batches):
        for batch in slices(batches, rows=4096):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS) for i in (3, 4))
            error = np.sqrt(at * (1 - at) / np.maximum(1, batch.column(2).to_numpy()))
            keep = pa.array(estimate(x, y) >= at - SLACK * error)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return flat.mapInArrow(work, f"a {kind}, b {kind}")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity. ``texts``: (id, text) of every document that may occur."""
    kind = texts.schema["id"].dataType.simpleString()
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")

    def work(batches):
        known: dict = {}

        def of(i, text: bytes) -> np.ndarray:
            if i not in known:
                if len(known) >= 256:
                    known.clear()
                known[i] = shingles(text, k)
            return known[i]

        for batch in slices(batches, rows=512, size=8 << 20):
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            keep = []
            for i, j, x, y in zip(*ids, bytes_of(batch, "a_text"), bytes_of(batch, "b_text")):
                p, q = of(i, x), of(j, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(work, f"a {kind}, b {kind}")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets, ``left`` against ``right``, by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1  # others are in no intersection
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place = np.full(len(sets), -1)
    place[left] = np.arange(len(left))
    other = np.full(len(sets), -1)
    other[right] = np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(values), WIDTH):
        a, b = np.searchsorted(column, (at, at + WIDTH))
        if a == b:
            continue
        r, c = row[a:b], column[a:b] - at
        x, y = np.zeros((len(left), WIDTH), np.float32), np.zeros((len(right), WIDTH), np.float32)
        x[place[r[place[r] >= 0]], c[place[r] >= 0]] = 1
        y[other[r[other[r] >= 0]], c[other[r] >= 0]] = 1
        out += x @ y.T
    return out


def settle(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) that join components through links within a unit. ``members``: (unit, id, c, keys, text), c the component
    so far, keys the buckets; only documents that share a bucket are held against each other."""
    kind = members.schema["id"].dataType.simpleString()
    # written before it is joined, so that a large unit can be split over tasks
    sizes = materialize(members.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    split = members.join(sizes, "unit").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    split = split.select("unit", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "c", "keys", "text")

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, chunk = group["id"], group["chunk"].to_numpy()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        _, known = np.unique(group["c"].to_numpy(zero_copy_only=False), return_inverse=True)
        edges: tuple[list, list] = ([], [])
        if known.any():
            sets = [shingles(x or b"", k) for x in group["text"].cast(pa.binary()).to_pylist()]
            n = np.array([len(s) for s in sets], np.float64)
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            common = overlaps(sets, left, right)
            met = overlaps([np.asarray(x, np.int64) for x in group["keys"].to_pylist()], left, right) > 0
            p, q = np.nonzero(met & (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (known[left][:, None] != known[right][None, :]))
            forest = Forest(int(known.max()) + 1)
            for a, b in zip(left[p].tolist(), right[q].tolist()):
                if forest.root[known[a]] != forest.root[known[b]]:
                    forest.link(known[[a]], known[[b]])
                    edges[0].append(a)
                    edges[1].append(b)
        return pa.table([ids.take(pa.array(x, pa.int64())).combine_chunks() for x in edges], names=["a", "b"])

    return split.groupBy("unit", "i", "j").applyInArrow(work, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept`` and the hash of
    the text."""
    rows = hashed(df, id_col, text_col)
    sketches = materialize(sketch(rows, k))
    # ids with more than one text
    several = materialize(sketches.filter("id is not null").groupBy("id").agg(F.min("t").alias("t"), F.max("t").alias("z")).filter("t <> z").select("id", "t"))
    some = several.limit(1).count() > 0
    if some:
        others = sketches.join(several.withColumnRenamed("t", "chosen"), "id").filter("t <> chosen").select("id", "t").distinct()
        others = materialize(others)
        rows = rows.join(others, ["id", "t"], "left_anti")
    live = sketches.filter("n > 0 and id is not null")
    live = live.join(others, ["id", "t"], "left_anti") if some else live
    classes = materialize(live.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("full").alias("full"), F.first("regs").alias("regs")))
    keyed = materialize(bands(classes))
    # written before it is joined, so that a large bucket can be split over tasks
    groups = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub")).filter("size > 1"))
    members = materialize(keyed.join(groups, "key"))
    drop_materialized(keyed)
    star = materialize(members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    wanted = star.select(F.col("a").alias("id")).unionAll(star.select("b")).distinct()
    texts = materialize(wanted_rows(rows.select("id", "text"), wanted).dropDuplicates(["id"]))
    links = materialize(confirm(likely(star, classes, percent), texts, k, percent))
    drop_materialized(star)
    found = materialize(connected_components(links, "a", "b"))
    # buckets of three and more whose members aren't all in one component yet
    large = materialize(members.filter("size > 2").join(found.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id")))
    drop_materialized(members)
    open_keys = materialize(large.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("key"))
    rest = materialize(large.join(open_keys, "key").select("key", "id", "hub", "c"))
    drop_materialized(large)
    if rest.limit(1).count():
        family = materialize(connected_components(rest, "hub", "id").withColumnRenamed("component", "family"))
        size = materialize(family.groupBy("family").agg(F.count(F.lit(1)).alias("m")))
        of_key = rest.join(family, "id").join(size, "family")
        unit = F.when(F.col("m") <= FAMILY, F.concat(F.lit("f"), "family")).otherwise(F.concat(F.lit("k"), "key"))
        units = of_key.groupBy(unit.alias("unit"), "id", "c").agg(F.collect_list("key").alias("keys"))  # as many as there are bands
        more = materialize(settle(materialize(units).join(texts, "id"), k, percent))
        found = materialize(connected_components(links.unionAll(more), "a", "b"))
    of_class = materialize(classes.select("s1", "s2", F.col("id").alias("r")).join(found.withColumnRenamed("id", "r"), "r", "left").select("s1", "s2", F.coalesce("component", "r").alias("c")))
    joined = live.select("id", "t", "n", "s1", "s2").join(of_class, ["s1", "s2"]).select("id", "t", "n", "c")
    alone = sketches.filter("not (n > 0 and id is not null)").select("id", "t", "n", F.col("id").alias("c"))
    if some:
        alone = alone.unionAll(sketches.filter("n > 0").join(others, ["id", "t"], "left_semi").select("id", "t", "n", F.col("id").alias("c")))
    out = joined.unionAll(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"), F.col("t").alias("text_hash"))
