"""Operator 1: passages that repeat across documents, by sparse suffix arrays.

A text's suffixes are kept only where a window of words has its minimiser, so that any two places which share a passage
of the least length share a kept suffix at the same word of it. Suffixes whose first words occur once in the corpus go
at once. Each of the others stands for the passages of the least length whose minimiser it is, and carries their hashes.
Suffixes that start alike meet, and among them equal hashes: so every repeated passage of the least length is found with
all its places, whatever stands around it, and the smallest of all places is the first. A longer passage is the union of
those inside it.

Words are runs of bytes other than ASCII white space. Documents of equal words are one class: the smallest id stands
for it, the others repeat it as a whole. Of the places of a passage, the one in the smallest id (then at the smallest
position) comes first. Null and empty texts, texts shorter than the least length, and rows with a null id have no
repeated passage. Of rows that repeat an id with different texts one counts, the one with the smallest hash of its text;
``text_hash`` names it, and the others are neither searched nor cut. Only starts with at most ``HEAVY`` suffixes are
gathered in one task; the passages of more frequent ones meet by aggregates and a join. Both ways find the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .common import bytes_of, drop_materialized, hashed, materialize, slices, unused, wanted_rows

#: Words of the least passage and of a suffix's start. A window of LEAST - SEED + 1 starts has one suffix at least.
LEAST, SEED = 50, 20
#: Suffixes of one start that are compared in one task.
HEAVY = 50
_u = np.uint64


def choices(hashes: np.ndarray, least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For each passage of the least length the position of its minimiser, and the hashes of all starts: of every
    ``least - seed + 1`` successive starts the leftmost smallest."""
    starts = textops.windows(hashes, seed)
    w = least - seed + 1
    if len(starts) < w:
        return np.empty(0, np.int64), starts[:0]
    order = textops.mix(starts ^ _u(0xD1B54A32D192ED03))
    views = np.lib.stride_tricks.sliding_window_view(order, w)
    chosen = np.empty(len(views), np.int64)
    for at in range(0, len(views), 1 << 15):
        chosen[at : at + (1 << 15)] = views[at : at + (1 << 15)].argmin(1)
    return chosen + np.arange(len(views)), starts


def minimisers(hashes: np.ndarray, least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept suffixes."""
    chosen, starts = choices(hashes, least, seed)
    at = np.unique(chosen)
    return at, starts[at]


def scan(rows: DataFrame, least: int, seed: int) -> DataFrame:
    """One row per id of (id, t, text): (id, t, n, s1, s2, at array<int>, h array<bigint>): words, signature of the word
    sequence, kept suffixes."""
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, rows=512, size=4 << 20):
            n, s1, s2, at, h = [], [], [], [], []
            for data in bytes_of(batch, "text"):
                _, _, words = textops.word_hashes(data)
                place = np.arange(1, len(words) + 1, dtype=_u) * _u(textops.GOLDEN)
                n.append(len(words))
                s1.append(int(textops.mix(words + place).sum(dtype=_u).astype(np.int64)))
                s2.append(int(np.bitwise_xor.reduce(textops.mix(words ^ place), initial=_u(0)).astype(np.int64)))
                p, q = minimisers(words, least, seed)
                at.append(p.astype(np.int32))
                h.append(q.view(np.int64))
            columns = [pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "t", "n", "s1", "s2", "at", "h"])

    scanned = materialize(rows.filter("id is not null").select("id", "t", "text").mapInArrow(work, f"id {id_type}, t bigint, n bigint, s1 bigint, s2 bigint, at array<int>, h array<bigint>"))
    # counted before they meet: a repeated id may be on any number of rows
    chosen = scanned.groupBy("id").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("id", "t")
    repeated = materialize(chosen)
    if repeated.limit(1).count() == 0:
        return scanned
    once = scanned.join(repeated, ["id", "t"]).groupBy("id", "t").agg(*(F.first(c).alias(c) for c in ("n", "s1", "s2", "at", "h")))
    return materialize(scanned.join(repeated.select("id"), "id", "left_anti").unionByName(once))


def passages_at(suffixes: DataFrame, texts: DataFrame, least: int, seed: int) -> DataFrame:
    """(h, id, p, k array<bigint>, big): for each suffix the hashes of the passages whose minimiser it is; they begin at word ``p`` and the next ones."""
    id_type = texts.schema["id"].dataType.simpleString()
    per_text = suffixes.groupBy("id", "t").agg(F.collect_list("at").alias("at"), F.collect_list(F.when(F.col("c") > HEAVY, F.col("at"))).alias("often"))  # of one document

    def work(batches):
        for batch in slices(batches, rows=256, size=4 << 20):
            ids = batch.column(0)
            rows, h, p, k, sizes, big = [], [], [], [], [], []
            for i, (at, often, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), bytes_of(batch, "text"))):
                _, _, words = textops.word_hashes(data)
                chosen, starts = choices(words, least, seed)
                wanted = np.isin(chosen, at)
                begin = np.flatnonzero(wanted & np.append(True, chosen[1:] != chosen[:-1])[: len(chosen)])
                rows.append(np.full(len(begin), i))
                h.append(starts[chosen[begin]])
                p.append(begin)
                big.append(np.isin(chosen[begin], often))
                k.append(textops.windows(words, least)[wanted])
                sizes.append(np.bincount(np.searchsorted(begin, np.flatnonzero(wanted), side="right") - 1, minlength=len(begin)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), pa.array(np.concatenate(k).view(np.int64)))
            columns = [pa.array(np.concatenate(h).view(np.int64)), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(p), pa.int32()), lists, pa.array(np.concatenate(big))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "id", "p", "k", "big"])

    found = wanted_rows(texts, suffixes.select("id", "t").distinct(), ("id", "t")).dropDuplicates(["id", "t"])
    return per_text.join(found, ["id", "t"]).select("id", "at", "often", "text").mapInArrow(work, f"h bigint, id {id_type}, p int, k array<bigint>, big boolean")


MATCH = ["id", "from", "to", "source", "first"]


def gathered(rows: DataFrame, least: int, seed: int) -> DataFrame:
    """Matches of suffixes that start alike: (id, from, to, source, first), the passages of a suffix with one answer in a row put together."""
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches):
        held = None
        for batch in slices(batches, rows=4096):
            batch = batch if held is None else pa.concat_batches([held, batch])
            h = batch.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield _matches(batch.slice(0, cut), least, seed)
            held = batch.slice(cut)
        if held is not None:
            yield _matches(held, least, seed)

    return rows.repartition("h").sortWithinPartitions("h", "id", "p").mapInArrow(work, f"id {id_type}, `from` int, `to` int, source {id_type}, first boolean")


def _matches(batch: pa.RecordBatch, least: int, seed: int) -> pa.RecordBatch:
    """Matches among rows sorted by (h, id, p); all rows of an ``h`` are there."""
    h, ids, sizes = batch.column(0).to_numpy(), batch.column(1), batch.column(3).value_lengths().to_numpy()
    keys = batch.column(3).flatten().to_numpy()
    row = np.repeat(np.arange(len(h)), sizes)
    place = np.repeat(batch.column(2).to_numpy() - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(keys))
    doc = np.cumsum(np.append(True, ids.slice(1).to_numpy(zero_copy_only=False) != ids.slice(0, len(h) - 1).to_numpy(zero_copy_only=False)))
    order = np.argsort(keys, kind="stable")  # equal passages stay in the order of their places
    k, r, p = keys[order], row[order], place[order]
    d = doc[r]
    new = np.append(True, (k[1:] != k[:-1]) | (h[r[1:]] != h[r[:-1]]))
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    low, high = start[group], np.append(start[1:], len(k))[group] - 1
    foreign = d != d[low]
    later = foreign | (p - p[low] >= seed)
    # places of one document that lie closer are a passage that repeats itself word by word
    kind = np.empty(len(k), np.int8)
    kind[order] = np.where(later, 2, (d[high] != d) | (p[high] - p >= seed))
    source = np.empty(len(k), np.int64)
    source[order] = np.where(foreign, r[low], r[high])
    begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])))
    stop = np.append(begin[1:], len(k)) - 1
    least_source = np.minimum.reduceat(source, begin)
    some = kind[begin] > 0
    begin, stop, least_source = begin[some], stop[some], least_source[some]
    columns = [ids.take(pa.array(row[begin])), pa.array(place[begin], pa.int32()), pa.array(place[stop] + least, pa.int32()), ids.take(pa.array(least_source)), pa.array(kind[begin] == 1)]
    return pa.RecordBatch.from_arrays(columns, MATCH)


def spread(rows: DataFrame, least: int, seed: int) -> DataFrame:
    """The same matches as of :func:`gathered`, one a passage, for starts of any number of suffixes: no group meets in one task."""
    each = rows.select("h", "id", "p", F.posexplode("k").alias("i", "k")).select("h", "k", "id", (F.col("p") + F.col("i")).alias("p"))
    place = F.struct("id", "p")
    groups = each.groupBy("h", "k").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter(f"low.id <> high.id or high.p - low.p >= {seed}")
    known = materialize(groups)
    found = each.join(known, ["h", "k"]).withColumn("later", F.expr(f"id <> low.id or p - low.p >= {seed}"))
    source = F.when(F.col("id") != F.col("low.id"), F.col("low.id")).otherwise(F.col("high.id"))
    return found.filter(f"later or high.id <> id or high.p - p >= {seed}").select("id", F.col("p").alias("from"), (F.col("p") + least).alias("to"), source.alias("source"), (~F.col("later")).alias("first"))


def merged(intervals: DataFrame) -> DataFrame:
    """(id, first, from, to, source): unions of the overlapping or touching intervals of each document and kind."""
    ordered = Window.partitionBy("id", "first").orderBy("from", "to")
    reach = F.max("to").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("new", F.coalesce((F.col("from") > reach).cast("int"), F.lit(1)))
    numbered = opened.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "first", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.min("source").alias("source")).drop("island")


def repeated_passages(df: DataFrame, least: int = LEAST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal repeated stretch of a document: the id, ``start_word``, ``end_word`` (exclusive), ``n_words``,
    ``source_id`` (another document with a passage of it: of its first
    place the last one's, else the first one's) and ``first`` (its passages are the first of all their
    places; every other place is not ``first``)."""
    rows = hashed(df, id_col, text_col)
    scanned = scan(rows, least, seed)
    whole = scanned.filter(F.col("n") >= least).select("id", "t", "n", "s1", "s2")
    classes = materialize(whole.groupBy("s1", "s2").agg(F.min("id").alias("r"), F.max("id").alias("z")).filter("r <> z"))
    copies = materialize(whole.join(classes, ["s1", "s2"]).select("id", "t", "n", "r", "z"))
    distinct = scanned.join(copies.filter("id <> r").select("id"), "id", "left_anti")
    suffixes = materialize(distinct.select("id", "t", F.explode(F.arrays_zip("at", "h")).alias("x")).select("id", "t", "x.at", "x.h"))
    # written before it is joined, so that a frequent start can be split over tasks
    often = materialize(suffixes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    wanted = materialize(suffixes.join(often, "h"))
    drop_materialized(suffixes)
    around = materialize(passages_at(wanted, rows, least, seed))
    matches = gathered(around.filter("not big").drop("big"), least, seed).unionAll(spread(around.filter("big").drop("big"), least, seed))
    whole_copies = copies.select("id", F.lit(0).alias("from"), F.col("n").cast("int").alias("to"), F.when(F.col("id") == F.col("r"), F.col("z")).otherwise(F.col("r")).alias("source"), (F.col("id") == F.col("r")).alias("first"))
    # a copy has what its class has; what it repeats as a whole is said once
    spans = merged(matches.unionAll(whole_copies)).join(scanned.select("id", "t"), "id")
    return spans.select(
        F.col("id").alias(id_col), F.col("from").cast("long").alias("start_word"), F.col("to").cast("long").alias("end_word"), (F.col("to") - F.col("from")).cast("long").alias("n_words"),
        F.col("source").alias("source_id"), "first", F.col("t").alias("text_hash"),
    )


def without(df: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the stretches that aren't ``first`` cut out of ``text_col``; rows keep their other columns. Rows whose
    text isn't the one that was searched under their id stay whole."""
    key, hash_col, spans_col = unused(df, "id"), unused(df, "hash"), unused(df, "cut")
    cut = passages.filter("not first").groupBy(F.col(id_col).alias(key), F.col("text_hash").alias(hash_col)).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias(spans_col))
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = df.join(cut, (F.col(id_col) == F.col(key)) & (text == F.col(hash_col)), "left").drop(key, hash_col)
    keep = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def work(batches):
        for batch in slices(batches, rows=512, size=4 << 20):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            for i, spans in enumerate(batch.column(batch.schema.get_field_index(spans_col)).to_pylist()):
                if spans and texts[i]:
                    texts[i] = remove(texts[i].encode(), [(s["start_word"], s["end_word"]) for s in spans]).decode()
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(columns, keep)

    return joined.mapInArrow(work, schema)


def remove(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of sorted spans; the white space before a span stays."""
    starts, ends = textops.word_spans(data)
    out, at = [], 0
    for a, b in spans:
        b = min(b, len(starts))
        if a >= b or starts[a] < at:
            continue
        out.append(data[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else int(ends[b - 1])
    return b"".join([*out, data[at:]])
