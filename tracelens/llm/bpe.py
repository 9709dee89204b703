"""Operator 9: byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Every code point has a class (letter, number, white space, space,
other); a small automaton marks the characters that contractions such as ``'ll`` have claimed. Its transition
functions on four states fit in one byte each, and composing them is associative, so a blocked prefix scan over
all characters of a batch yields every state at once. Class changes then give the boundaries. The slices between
them feed pair merging with a cache; byte offsets of the tokens are kept.

Nulls and empty texts give empty lists. Ids outside the vocabulary raise an error when decoding.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of
from .textops import BASE, Store, code_hashes, code_table, mix

LETTER, NUMBER, OTHER, WHITE, SPACE, BREAK = range(6)
MAX_CODE = 0x110000
#: Entries after which a worker's cache of merged slices is emptied.
CACHE = 1_000_000
BLOCK = 128
#: Bytes up to which a slice is merged in a plain list.
SHORT = 40
_classes: list[np.ndarray] = []
_vocabularies: dict = {}


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        import regex

        text = "".join(chr(c) for c in range(MAX_CODE) if not 0xD800 <= c < 0xE000)
        table = np.full(MAX_CODE, OTHER, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
        table[32] = SPACE
        _classes.append(table)
    return _classes[0]


def _pack(images: list[int]) -> int:
    return sum(v << (2 * s) for s, v in enumerate(images))


#: States: 0 none, 1 and 2 so many characters of a contraction to come, 3 a contraction has just ended.
STEP = [_pack([0, 3, 1, 0]), _pack([1, 3, 1, 1]), _pack([2, 3, 1, 2])]


def _compose() -> np.ndarray:
    f = np.arange(256, dtype=np.uint16)
    g = f[None, :]
    out = np.zeros((256, 256), dtype=np.uint16)
    for s in range(4):
        mid = (f[:, None] >> (2 * s)) & 3
        out |= ((g >> (2 * mid)) & 3) << (2 * s)
    return out.astype(np.uint8).ravel()


COMPOSE = _compose()


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of packed transition functions: blocks side by side, then their totals."""
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = COMPOSE[(int(out[i - 1]) << 8) | int(functions[i])]
        return out
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, _pack([0, 1, 2, 3]), dtype=np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = COMPOSE[(grid[j - 1].astype(np.intp) << 8) | grid[j]]
    before = scan(grid[-1])[:-1]
    for j in range(BLOCK):
        grid[j, 1:] = COMPOSE[(before.astype(np.intp) << 8) | grid[j, 1:]]
    return grid.T.ravel()[:n]


def boundaries(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Positions where a slice begins. ``breaks``: positions of separators between texts, slices of their own."""
    n = len(codes)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    kind = classes()[codes]
    kind[breaks] = BREAK
    prev = np.empty_like(kind)
    prev[0], prev[1:] = BREAK, kind[:-1]
    step = np.full(n, STEP[0], dtype=np.uint8)
    # the apostrophe opens a contraction where a match begins: not after a space or within other signs
    marks = np.flatnonzero((codes == 39) & (kind == OTHER) & (prev != OTHER) & (prev != SPACE))
    if len(marks):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = padded[marks + 1], padded[marks + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        step[marks[one]], step[marks[two]] = STEP[1], STEP[2]
    state = np.empty(n, dtype=np.uint8)
    state[0], state[1:] = 0, scan(step)[:-1] & 3
    white, was_white = kind >= WHITE, prev >= WHITE
    white &= kind != BREAK
    was_white &= prev != BREAK
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = kind[1:] < WHITE
    start = np.where(white, ~was_white | follows, (kind != prev) & (prev != SPACE))
    start |= kind == BREAK
    start[1:] |= kind[:-1] == BREAK
    start = np.where(state == 0, start, state == 3)
    start[0] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of a tiktoken file, with cached pair merging."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.token: list = [None] * (max(self.ranks.values(), default=-1) + 1)
        for k, v in self.ranks.items():
            self.token[v] = k
        self.sizes = np.array([len(t or b"") for t in self.token], np.int32)
        self.store = Store(CACHE)
        self.table = code_table(MAX_CODE)
        self.other = mix(self.table ^ np.uint64(BASE))

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, len(self.token)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[x] for x in parts]

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left; n log n for any length."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n <= SHORT:
            return self._merge_short(piece)
        after, before, end = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            push(i)
        dead = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or end[j] != stop:
                continue
            dead[j], end[i], after[i] = 1, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if not dead[i]]


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and byte lengths of the tokens of each text."""
    joined = "\n".join(texts)
    if not joined:
        return [np.empty(0, np.int32)] * len(texts), [np.empty(0, np.int32)] * len(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(sizes) + np.arange(len(texts))
    starts = boundaries(codes, stops[:-1])
    ends = np.append(starts[1:], len(codes))
    pieces = lambda at: [np.array(vocab.merge(joined[a:b].encode()), np.uint32) for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    ids, bound = vocab.store.gather(code_hashes(codes, starts, vocab.table), code_hashes(codes, starts, vocab.other), pieces)
    ids = ids.astype(np.int32)
    lengths = vocab.sizes[ids]
    cuts = list(zip(bound[np.searchsorted(starts, stops - sizes)].tolist(), bound[np.searchsorted(starts, stops)].tolist()))
    return [ids[a:b] for a, b in cuts], [lengths[a:b] for a, b in cuts]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` array<int> and ``offsets`` array<int> (UTF-8 byte where each token begins) of every text."""
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches):
        vocab = vocabulary(vocab_path)
        for batch in slices(batches, rows=256, size=1 << 20):
            ids, lengths = encode_texts(texts_of(batch, "text"), vocab)
            starts = [np.cumsum(x, dtype=np.int32) - x for x in lengths]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, pa.int32()), _lists(starts, pa.int32())], ["id", "ids", "offsets"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {id_type}, ids array<int>, offsets array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` binary, the bytes that the ids stand for (null ids: empty); an unknown id is an error."""
    schema = df.schema
    keep = [c for c in df.columns if c != out_col]

    def work(batches):
        token = vocabulary(vocab_path).token
        for batch in slices(batches, rows=1024, size=4 << 20):
            ids = batch.column(batch.schema.get_field_index(ids_col))
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            if unknown := {i for i in np.unique(flat).tolist() if not 0 <= i < len(token) or token[i] is None}:
                raise ValueError(f"unknown token ids: {sorted(unknown)[:5]}")
            out = [b"".join([token[i] for i in flat[a:b].tolist()]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.binary())], [*keep, out_col])

    fields = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep).mapInArrow(work, f"{fields}, `{out_col}` binary")
