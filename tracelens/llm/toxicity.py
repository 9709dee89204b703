"""Operator 5: toxicity by compression distance.

Two zstandard dictionaries are trained by zstandard's own trainer, one on toxic and one on ordinary text. Overlapping
windows of a few words are compressed with both; how many bytes the toxic dictionary saves is a window's distance.
Counts and shares of windows beyond fixed distances, weighed by a logistic regression on training rows that the
dictionaries haven't seen, give the calibrated score.

Most of a toxic text is ordinary, so a plain dictionary of it would say little. Each dictionary's own part is therefore
trained on those windows of its class that profit most from other texts of the class, over a long stretch of the other
class's text, and that aren't copied from one document to another. Around the own parts both dictionaries hold the same
ordinary text, and the same false alarms: ordinary windows that a first pair of dictionaries called toxic.

The fit takes at most ``per_class`` labelled rows of a class (the only bound); scoring reads every text whole. Null
and empty texts have no window and get the score of a document without any sign. With labels of one class only,
or none, every score is 0. Rows that repeat an id are scored one by one; in the fit one of them counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, textops
from .common import bytes_of, fold, slices
from .textops import word_spans

#: Words of a window, and how many words further the next one begins.
WORDS, STEP = 3, 2
#: Spaces after a window while it is compressed: the match finder leaves the last bytes of its input alone, and the
#: block always shrinks, so that no window is stored raw.
TAIL = 24
#: The end of a dictionary, whose last bytes aren't indexed.
END = b"\n" * 16
#: Bytes of text that windows are judged by while own parts are trained: of the other class, and of the own class.
AGAINST, FOR = 2_000_000, 400_000
#: Bytes of a dictionary's parts: ordinary text, the own part, false alarms of each round, frequent ordinary text.
BASE, OWN, ALARMS, FREQUENT = 80_000, 4_000, 30_000, 8_000
#: Share of a class's windows that its own part is trained on, bytes of a trained segment, rounds of false alarms.
PROFIT, SEGMENT, ROUNDS = 0.03, 12, 3
#: Words of a stretch that makes two texts copies of each other there.
COPIED = 10
#: Distances in bytes, of two successive windows, that are counted.
DISTANCES = (2, 3, 4, 6, 8, 12)
#: Windows compressed in one call.
CALL = 1 << 15


def windows(data: bytes, words: int = WORDS, step: int = STEP) -> np.ndarray:
    """Offsets and lengths of windows of ``words`` words that cover a text, each with the byte before and the byte after it."""
    starts, ends = word_spans(data)
    n = len(starts)
    first = np.arange(0, min(n, max(1, n - words + step)), step)
    a = np.maximum(starts[first] - 1, 0)
    b = np.minimum(ends[np.minimum(first + words, n) - 1] + 1, len(data))
    return np.stack([a, b - a], 1)


def normal(data: bytes) -> bytes:
    """A text in lower case with a space before its first word."""
    return b" " + data.decode().lower().encode()


class Meter:
    """Distances of windows under a pair of dictionaries, ordinary and toxic."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters(
            window_log=22, hash_log=17, chain_log=19, search_log=8, min_match=4, target_length=64, strategy=z.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS
        )
        self.segments, self.pair = z.BufferWithSegments, []
        for content in (ordinary, toxic):
            known = z.ZstdCompressionDict(content + END, dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            self.pair.append(z.ZstdCompressor(dict_data=known, compression_params=params))

    def of(self, data: bytes, parts: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each of the windows of ``data``."""
        out = [self._some(data, parts[at : at + CALL]) for at in range(0, len(parts), CALL)]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _some(self, data: bytes, parts: np.ndarray) -> np.ndarray:
        size = parts[:, 1]
        padded = size + TAIL
        start = np.cumsum(padded) - padded
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        copy = np.full(int(padded.sum()), 32, np.uint8)
        copy[np.repeat(start, size) + inside] = np.frombuffer(data, np.uint8)[np.repeat(parts[:, 0], size) + inside]
        windows = self.segments(copy.tobytes(), np.stack([start, padded], 1).astype(np.uint64).tobytes())
        plain, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(windows)), np.int64, len(parts)) for c in self.pair)
        return plain - toxic


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def scores(self, meter: Meter, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.stack([features(d) for d in distances(texts, meter)]) @ self.weights, -30, 30)))


def distances(texts: list[bytes], meter: Meter) -> list[np.ndarray]:
    """Bytes that the toxic dictionary saves on each window of each text."""
    data = [normal(t) for t in texts]
    parts = [windows(t) for t in data]
    begin = np.cumsum([0, *map(len, data)])
    every = np.concatenate([p + (at, 0) for p, at in zip(parts, begin)]) if parts else np.empty((0, 2), np.int64)
    return np.split(meter.of(b"".join(data), every), np.cumsum([len(p) for p in parts])[:-1])


def features(d: np.ndarray) -> np.ndarray:
    """Of a document's distances, each added to the next one's: counts beyond each limit (logarithms and shares), their
    mean and greatest. What a text really holds shows in each window over it, the accidents of one match do not."""
    d = d[:-1] + d[1:] if len(d) > 1 else d
    counts = (d[:, None] >= np.array(DISTANCES)).sum(0)
    n = max(1, len(d))
    return np.array([1.0, *np.log1p(counts), *np.sqrt(counts / n), d.mean() if len(d) else 0.0, min(12, max(0, int(d.max()))) / 4 if len(d) else 0.0])


def trained(samples: list[bytes], size: int, segment: int, alike: int = 6) -> bytes:
    """The content that zstandard's trainer makes of samples. It gives up early where segments are short for so few
    samples; then they grow."""
    import zstandard as z

    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    for k in range(segment, 65, 4):
        # its tables of codes, some 250 bytes, come first and aren't used
        try:
            out = z.train_dictionary(size + 400, samples, k=k, d=alike).as_bytes()
        except z.ZstdError:  # too few samples
            return b"".join(samples)[-size:]
        if len(out) >= size:
            break
    return out[-min(size, max(1, len(out) - 250)) :]


def apart(texts: list[bytes], parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text which of its windows lie in no stretch of words that another text has too."""
    hashes = [textops.word_hashes(t)[2] for t in texts]
    runs = [textops.windows(h, min(COPIED, len(h))) if len(h) else h for h in hashes]
    value, count = np.unique(np.concatenate([np.unique(r) for r in runs]), return_counts=True)
    out = []
    for r, p in zip(runs, parts):
        copied = np.concatenate([[0], np.cumsum(count[np.searchsorted(value, r)] > 1)])
        at = STEP * np.arange(len(p))  # a window lies in the stretches that begin before it and end after it
        out.append(copied[np.minimum(at + 1, len(r))] == copied[np.clip(at + WORDS - COPIED, 0, len(r))])
    return out


def own_part(halves: list[list[int]], others: list[int], texts: list[bytes], parts: list[np.ndarray], single: list[np.ndarray]) -> bytes:
    """Trained on windows that profit from the class's other half."""
    foreign = b"".join(texts[i] for i in others)[:AGAINST]
    gain, text, place = [], [], []
    for half, rest in (halves, halves[::-1]):
        meter = Meter(foreign, foreign + b"".join(texts[i] for i in half)[:FOR])
        for i in rest:
            own = parts[i][single[i]]
            gain.append(meter.of(texts[i], own))
            text.append(np.full(len(own), i))
            place.append(own)
    gain, text, place = np.concatenate(gain), np.concatenate(text), np.concatenate(place)
    if not len(gain):
        return b""
    best = np.flatnonzero(gain >= np.quantile(gain, 1 - PROFIT))
    samples = [texts[i][a : a + n] for i, (a, n) in zip(text[best].tolist(), place[best].tolist())]
    return trained(samples, OWN, SEGMENT)


def dictionaries(texts: list[bytes], toxic: np.ndarray, half: np.ndarray) -> tuple[bytes, bytes]:
    """The contents of the ordinary and of the toxic dictionary. ``half``: 0 or 1 by text."""
    parts = [windows(t) for t in texts]
    single = apart(texts, parts)
    rows = [np.flatnonzero(toxic == k).tolist() for k in (0, 1)]
    own = [own_part([[i for i in rows[k] if half[i] == h] for h in (0, 1)], rows[1 - k], texts, parts, single) for k in (0, 1)]
    size = min(map(len, own))
    plain, bad = (x[len(x) - size :] for x in own)
    base = b"".join(texts[i] for i in rows[0])[:BASE]
    often = trained([texts[i][at : at + 300] for i in rows[0] for at in range(0, len(texts[i]), 300)], FREQUENT, 64, 8)
    words = [Counter(), Counter()]
    for k in (0, 1):
        for i in rows[k]:
            words[k].update({texts[i][a : a + n] for a, n in windows(texts[i], 1, 1).tolist()})
    # labels err: a word that toxic documents have more than twice as often is no false alarm
    known = sorted(words[0])
    fair = np.array([words[1][w] < 2 or words[1][w] * len(rows[0]) <= 2 * words[0][w] * len(rows[1]) for w in known])
    sizes = np.array([len(w) for w in known])
    alarms = b""
    for _ in range(ROUNDS):
        meter = Meter(base + plain + alarms + often, base + bad + alarms + often)
        alone = meter.of(b"".join(known), np.stack([np.cumsum(sizes) - sizes, sizes], 1)) >= 1
        spared = {known[j] for j in np.flatnonzero(alone & ~fair)}
        found = []
        for i in rows[0]:
            for a, n in parts[i][meter.of(texts[i], parts[i]) >= 2].tolist():
                t = texts[i][a : a + n]
                if not any(t[p : p + q] in spared for p, q in windows(t, 1, 1).tolist()):
                    found.append(t)
        one = [known[j] for j in np.flatnonzero(alone & fair)]
        if not found and not one:
            break
        alarms += trained(found, ALARMS, 32) + trained(one, ALARMS, 16)
    return base + plain + alarms + often, base + bad + alarms + often


def cut(margin: np.ndarray, y: np.ndarray, share: float) -> float:
    """The margin with the fewest errors where ``share`` of all documents are toxic; the middle of the best stretch."""
    at = np.sort(np.unique(margin))
    missed = np.searchsorted(np.sort(margin[y == 1]), at, side="right") / max(1, (y == 1).sum())
    wrong = 1 - np.searchsorted(np.sort(margin[y == 0]), at, side="right") / max(1, (y == 0).sum())
    error = share * missed + (1 - share) * wrong
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((at[best[0]] + (at[best[-1] + 1] if best[-1] + 1 < len(at) else at[best[-1]])) / 2)


def train(texts: list[bytes], toxic: list[int], share: float | None = None) -> Model | None:
    """Dictionaries from two rows of three, weights and the cut at 0.5 from the third. ``share``: of toxic ones among all
    documents, of which the rows may be a balanced sample."""
    y = np.array(toxic)
    if len(set(toxic)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 6:
        return None
    place = np.zeros(len(y), dtype=int)
    for k in (0, 1):
        place[y == k] = np.arange((y == k).sum()) % 3
    used = [i for i in np.flatnonzero(place < 2).tolist() if texts[i].split()]
    if len({int(y[i]) * 2 + int(place[i]) for i in used}) < 4:
        return None
    plain, bad = dictionaries([normal(texts[i]) for i in used], y[used], place[used])
    held = place == 2
    x = np.stack([features(d) for d in distances([t for t, h in zip(texts, held) if h], Meter(plain, bad))])
    weights = logistic(x, y[held])
    weights[0] -= cut(x @ weights, y[held], float(y.mean()) if share is None else share)
    return Model(bad, plain, weights)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from at most ``per_class`` training rows of each class, all that the driver gathers."""
    rows = labelled.sample(documents, labels, "toxic", folds, held_out, per_class, id_col, text_col).orderBy("id").collect()
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (fold(id_col, folds) != held_out)).agg(F.avg((F.col("toxic") >= 1).cast("double"))).first()[0]
    return train([(r["text"] or "").encode() for r in rows], [r["label"] for r in rows], known)


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``score`` and ``predicted``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches):
        meter = Meter(model.ordinary, model.toxic) if model else None
        for batch in slices(batches, rows=64, size=1 << 20):
            scores = model.scores(meter, bytes_of(batch, "text")) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["id", "score", "predicted"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose text the model doesn't call toxic, all columns as they were."""
    def work(batches):
        meter = Meter(model.ordinary, model.toxic) if model else None
        for batch in slices(batches, rows=64, size=1 << 20):
            yield batch if model is None else batch.filter(pa.array(model.scores(meter, bytes_of(batch, text_col)) < 0.5))

    return df.mapInArrow(work, df.schema)
