"""Operator 3: packing documents into training sequences.

Each document becomes token ids plus an end id, cut into pieces of one window and a rest. Only the histogram of the
rests' lengths (at most one count per length, whatever the corpus) reaches the driver. There, shallow combinations of
two to four lengths that fill a window are the columns of a non-negative least-squares problem; its rounded solution
says how often each is used, and what is left is packed greedily, largest first with the best fit beside it. The
resulting runs of slots are small; every piece finds its slot by its rank among the pieces of its length. Where a
sequence would keep a gap, a piece may be cut once more, at a block of 64 ids, to fill it.

Null and empty texts become a piece of the end id alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, materialize, slices
from .textops import Store, span_hashes, word_spans

WINDOW = 4096
END_ID = 2
#: Ids of a block whose checksum is kept, so that a piece can be cut without tokenising again.
BLOCK = 64
#: Pieces of one length that are numbered together.
GROUP = 50_000
#: Signs that are tokens apart from the letters before them.
SIGNS = ".,;:!?%&$#*"
#: 1 for ASCII letters and digits, 2 for SIGNS.
KINDS = np.zeros(256, np.int8)
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KINDS[[ord(c) for c in SIGNS]] = 2
#: Entries after which a worker's cache of words is emptied.
CACHE = 1_500_000
_tokenizers: dict = {}


def word_pieces(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of words, cut between ASCII letters or digits and SIGNS: there the tokenizer's own pieces end."""
    starts, ends = word_spans(data)
    kind = KINDS[np.frombuffer(data, np.uint8)]
    cut = np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


class WordIds:
    """Ids of words by a tokenizers file, cached. White space never joins what it separates there.

    The words of a batch, ASCII case folded, are hashed at once; only its distinct ones are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.store = Store(CACHE)

    def parts(self, words: list[str]) -> list[np.ndarray]:
        """Ids of distinct words, many encoded in one call; a token belongs to the word in which it begins."""
        out = []
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            starts = np.cumsum([0, *[len(w) + 1 for w in part]])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.array([x[0] for x in found.offsets], np.int64)
            cut = np.searchsorted(begin, starts).tolist()
            ids = np.array(found.ids, np.uint32)
            out += [ids[a:b] for a, b in zip(cut, cut[1:])]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text in UTF-8."""
        data = b" ".join(texts)
        starts, ends = word_pieces(data)
        hashes, second = span_hashes(data, starts, ends, lower=True), span_hashes(data, starts, ends, lower=True, other=True)
        if b"<|" in data:  # special tokens heed the case
            opened = np.frombuffer(data, np.uint8)
            opened = np.concatenate([[0], np.cumsum((opened[:-1] == 60) & (opened[1:] == 124))])
            exact = opened[ends - 1] > opened[starts]
            hashes = np.where(exact, span_hashes(data, starts, ends) ^ np.uint64(1), hashes)
            second = np.where(exact, span_hashes(data, starts, ends, other=True) ^ np.uint64(1), second)
        edges = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))
        if not len(starts):
            return [np.empty(0, np.uint32)] * len(texts)
        words = lambda at: [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        ids, stop = self.store.gather(hashes, second, lambda at: self.parts(words(at)))
        stop = stop[edges].tolist()
        return [ids[a:b] for a, b in zip(stop, stop[1:])]


def tokenizer(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def _matrix(size: int) -> list[int]:
    """The linear map on a CRC-32 state that ``size`` zero bytes make, as the images of the 32 single bits."""
    zero = zlib.crc32(bytes(size))
    return [_state(1 << b, size) ^ _state(0, size) for b in range(32)] if zero is not None else []


def _state(state: int, size: int) -> int:
    return zlib.crc32(bytes(size), state ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


_maps: dict[int, list[int]] = {}


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two strings one after the other, from their own CRCs and the second one's size in bytes."""
    if size not in _maps:
        _maps[size] = _matrix(size)
    out, images = second, _maps[size]
    for b in range(32):
        if first >> b & 1:
            out ^= images[b]
    return out


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of each document: ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and the ``blocks``' checksums of a rest."""
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4")

    def work(batches):
        ids = tokenizer(tokenizer_path)
        for batch in slices(batches, rows=256, size=2 << 20):
            rows: list[list] = [[], [], [], [], [], []]
            for k, found in enumerate(ids.encode(bytes_of(batch, "text"))):
                data = np.concatenate([found, end]).astype("<u4", copy=False).tobytes()
                total = len(data) // 4
                for at in range(0, total, window):
                    part = data[4 * at : 4 * (at + window)]
                    n = len(part) // 4
                    blocks = [zlib.crc32(part[i : i + 4 * BLOCK]) for i in range(0, len(part), 4 * BLOCK)] if n < window else []
                    for column, value in zip(rows, (k, at, n, zlib.crc32(part), total, np.array(blocks, "<u4").tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:5]), pa.array(rows[5], pa.binary())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "blocks"],
            )

    schema = f"id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, blocks binary"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def combinations(counts: np.ndarray, window: int = WINDOW, points: int = 12) -> list[tuple[int, ...]]:
    """Combinations of two to four lengths that fill the window exactly; beside each length, quantiles of all lengths."""
    there = np.flatnonzero(counts)
    if not len(there):
        return []
    ranks = np.cumsum(counts[there])
    some = np.unique(there[np.searchsorted(ranks, (np.arange(points) + 0.5) / points * ranks[-1])]).tolist()
    found = set()
    for a in there.tolist():
        for fixed in ((), *((b,) for b in some), *((b, c) for i, b in enumerate(some) for c in some[i:])):
            rest = window - a - sum(fixed)
            if 0 < rest < window and counts[rest]:
                found.add(tuple(sorted((a, *fixed, rest), reverse=True)))
    return sorted(found)


def solve(counts: np.ndarray, columns: list[tuple[int, ...]], steps: int = 200) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: repeats x of each column with A x close to the counts."""
    if not columns:
        return np.zeros(0)
    row = np.concatenate([np.array(c) for c in columns])
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    n, m = len(counts), len(columns)
    target = np.bincount(col, counts[row], m)
    x = np.full(m, max(1e-9, counts.sum() / (3.0 * m)))
    for _ in range(steps):
        fitted = np.bincount(row, x[col], n)
        x *= target / np.maximum(np.bincount(col, fitted[row], m), 1e-12)
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how often)], times) that use up the counts of the lengths below the window."""
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    columns = combinations(left, window)
    repeats = np.rint(solve(left, columns)).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        need: dict[int, int] = {}
        for length in columns[k]:
            need[length] = need.get(length, 0) + 1
        times = min(int(repeats[k]), *(int(left[a] // u) for a, u in need.items()))
        if times > 0:
            for a, u in need.items():
                left[a] -= u * times
            patterns.append((sorted(need.items(), reverse=True), times))
    there = np.flatnonzero(left).tolist()
    while there:
        need, room = {}, window
        k = len(there) - 1
        while k >= 0 and room > 0:
            a = there[k]
            if a > room:
                k = int(np.searchsorted(there[: k + 1], room, side="right")) - 1
                continue
            u = min(room // a, int(left[a]))
            need[a] = u
            room -= u * a
            k -= 1
        times = min(int(left[a] // u) for a, u in need.items())
        for a, u in need.items():
            left[a] -= u * times
        patterns.append((sorted(need.items(), reverse=True), times))
        there = [a for a in there if left[a] > 0]
    return patterns


class Slots:
    """Where the pieces of each length go, looked up by length and rank.

    A pattern of one piece that leaves a wide gap, used many times, gives up some of its sequences: their pieces, as
    one stream of blocks, fill the gaps of the others. Each row of ``rows`` holds the first rank, pieces per sequence,
    first sequence, offset, sequences that stay (0: all), blocks of a piece, and blocks that fit in a gap.
    """

    def __init__(self, counts: np.ndarray, window: int = WINDOW, block: int = BLOCK):
        self.window, self.block, self.sequences = window, block, 0
        runs = []
        for need, times in plan(counts, window):
            gap = (window - sum(a * u for a, u in need)) // block
            stay, size = 0, -(-need[0][0] // block)
            if len(need) == 1 and need[0][1] == 1 and gap >= 2 and (given := times * gap // (size + gap)):
                stay = times - given
            offset = 0
            for a, u in need:
                runs.append((a, u * times, (u, self.sequences, offset, stay, size, gap)))
                offset += a * u
            self.sequences += stay or times
        runs.sort()
        low: dict[int, int] = {}
        keys, rows = [], []
        for a, n, rest in runs:
            keys.append((a << 44) + low.get(a, 0))
            rows.append((low.get(a, 0), *rest))
            low[a] = low.get(a, 0) + n
        self.keys, self.rows = np.array(keys, np.int64), np.array(rows, np.int64).reshape(-1, 7)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, and the row of those to be cut (-1: whole). Full windows follow the packed sequences."""
        if not len(self.keys):
            return self.sequences + rank, np.zeros_like(rank), np.full(len(rank), -1)
        at = np.searchsorted(self.keys, (length << 44) + rank, side="right") - 1
        row, whole = self.rows[at], length == self.window
        nth = rank - row[:, 0]
        cut = np.where(~whole & (row[:, 4] > 0) & (nth >= row[:, 4]), at, -1)
        return np.where(whole, self.sequences + rank, row[:, 2] + nth // row[:, 1]), np.where(whole, 0, row[:, 3] + nth % row[:, 1] * length), cut

    def parts(self, at: int, length: int, rank: int):
        """(first block, end block, sequence, offset) of a piece that fills gaps."""
        first, _, sequence, _, stay, size, gap = self.rows[at].tolist()
        donor = rank - first - stay
        short = size * self.block - length
        x, stop = donor * size, (donor + 1) * size
        while x < stop:
            to = min(stop, (x // gap + 1) * gap)
            ended = x // size - (x // gap * gap) // size  # pieces that ended in this gap before
            yield x - donor * size, to - donor * size, sequence + x // gap, length + x % gap * self.block - ended * short
            x = to


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    spark = df.sparkSession
    cut = materialize(pieces(df, tokenizer_path, id_col, text_col, window))
    counts = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most one row per length
        counts[r["length"]] = r["count"]
    slots = Slots(np.append(counts[:window], 0), window)
    # pieces of a length are numbered in bounded groups, as many as it takes
    salts = np.maximum(1, -(-counts // GROUP))
    begin = np.cumsum(salts) - salts
    groups = spark.createDataFrame([(n, int(salts[n]), int(begin[n])) for n in np.flatnonzero(counts).tolist()], "length bigint, salts int, begin bigint")
    salted = cut.join(F.broadcast(groups), "length").withColumn("salt", (F.col("begin") + F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.col("salts"))).cast("int")).drop("salts", "begin")
    sizes = np.zeros(int(salts.sum()), np.int64)
    for r in salted.groupBy("salt").count().collect():  # one row per group
        sizes[r["salt"]] = r["count"]
    before = np.cumsum(sizes) - sizes
    before -= np.repeat(before[begin], salts)
    ordered = Window.partitionBy("salt").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(ordered).cast("long") - 1)

    def place(batches):
        for batch in slices(batches, rows=4096):
            t = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in numbers}
            rank = t["rank"] + before[t["salt"]]
            sequence, offset, at = slots.find(t["length"], rank)
            yield from _rows(batch, np.flatnonzero(at < 0), [*(t[c] for c in numbers[:4]), sequence, offset])
            if len(cut_up := np.flatnonzero(at >= 0)):
                blocks, out = batch.column(batch.schema.get_field_index("blocks")).to_pylist(), []
                for i in cut_up.tolist():
                    sums = np.frombuffer(blocks[i], "<u4").tolist()
                    n, start = int(t["length"][i]), int(t["start"][i])
                    for a, b, seq, off in slots.parts(int(at[i]), n, int(rank[i])):
                        crc = 0
                        for j in range(a, b):
                            crc = joined_crc(crc, sums[j], 4 * min(BLOCK, n - j * BLOCK))
                        out.append((i, start + a * BLOCK, min(n, b * BLOCK) - a * BLOCK, crc, int(t["doc_tokens"][i]), seq, off))
                columns = np.array(out, np.int64).T
                yield from _rows(batch, columns[0], columns[1:], pick=False)

    numbers = ["start", "length", "ids_crc32", "doc_tokens", "salt", "rank"]
    id_type = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {id_type}", *(f"`{n}` bigint" for n in NAMES[1:])])
    return ranked.select("id", *numbers, "blocks").mapInArrow(place, schema).withColumnRenamed("id", id_col)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _rows(batch: pa.RecordBatch, index: np.ndarray, columns, pick: bool = True):
    if len(index):
        ids = batch.column(0).take(pa.array(index, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x[index] if pick else x, pa.int64()) for x in columns)], NAMES)
