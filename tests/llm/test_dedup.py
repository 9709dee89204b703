"""Operators that join rows with each other, and the pipeline, against brute force."""

import collections
import random
import tempfile

import numpy as np
import pytest

from tracelens.llm import embed_dedup, minhash, suffix_dedup
from tracelens.llm.components import connected_components


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, i) for i in range(2000, 2100)] + [(5, 5)]
    want = Union({x for e in edges for x in e})
    for a, b in edges:
        want.join(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: want.find(x) for e in edges if e[0] != e[1] for x in e}


def test_minhash_against_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for family in range(12):
        base = prose(rng, rng.choice([6, 40, 200]))
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
            docs.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    docs += [docs[0]] * 5 + ["", None, "a", "A", "a b", "\t\n"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    low = lambda t: [w for w in (t or "").lower().split()]
    sets = {i: frozenset([tuple(w)] if 0 < len(w) < 4 else zip(w, w[1:], w[2:], w[3:])) for i, t in enumerate(docs) for w in [low(t)]}
    want = Union(sets)
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want.join(i, j)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want.find(i), want.find(i) == i) for i, s in sets.items()}


def test_minhash_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string, kept boolean")).count() == 0
    text = "a b c d e f g h"
    rows = minhash.near_duplicates(spark.createDataFrame([(1, text), (2, text), (2, "other words " * 9), (3, "other words " * 9), (4, text * 20_000)], "doc_id long, text string")).collect()
    chosen = min((r.text_hash, r.component_id) for r in rows if r.doc_id == 2)[1]
    want = {(1, text): 1, (2, text): 1, (2, "o"): 2, (3, "o"): 3} if chosen == 1 else {(1, text): 1, (2, text): 2, (2, "o"): 2, (3, "o"): 2}
    assert sorted(r.component_id for r in rows) == sorted([*want.values(), 4])
    rows = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("1", "1", True), ("1", "1", True), ("None", "None", True)]


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 800, dtype=np.uint64)
    for share in (0.5, 0.8):
        n = int(800 * (1 - share) / share / 2)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)])) for _ in range(2))
        a, b = (np.unique(minhash.textops.mix(x)) for x in (a, b))
        assert abs(float(minhash.estimate(minhash.registers(a)[0][None], minhash.registers(b)[0][None])[0]) - share) < 0.15


@pytest.mark.parametrize("chunk", [2500, 20])
def test_embeddings_against_brute_force(spark, chunk, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(25):
        center = rng.standard_normal(32)
        for _ in range(8):
            rows.append((len(rows), (center + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist(), int(k % 3)))
    rows += [(len(rows) + i, rows[3][1], rows[3][2]) for i in range(4)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, rows[0][1], None), (n + 4, [1.0, None], 1), (n + 5, [], 1), (n + 6, [1.0, 0.0], 1), (n + 7, [2.0, 0.1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    want, links = Union(range(len(rows))), collections.Counter()
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                want.join(i, j)
                links[i] += 1
                links[j] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], want.find(i), want.find(i) == i) for i in range(len(rows))}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_suffixes_against_brute_force(spark):
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (50, 55, 90, 300)]
    docs = []
    for i in range(60):
        w = prose(rng, rng.choice([0, 20, 120, 400]))
        if i % 2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        docs.append(" \n".join(w))
    docs += [docs[1], docs[1], " ".join(prose(rng, 49)), None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = suffix_dedup.repeated_passages(df).collect()
    places = collections.defaultdict(list)
    words = {i: (t or "").split() for i, t in enumerate(docs)}
    for i, w in words.items():
        for p in range(len(w) - 49):
            places[tuple(w[p : p + 50])].append((i, p))
    want, got, gone = (collections.defaultdict(set) for _ in range(3))
    for v in places.values():
        for i, p in v if len(v) > 1 else ():
            want[i].update(range(p, p + 50))
    for r in out:
        got[r.doc_id].update(range(r.start_word, r.end_word))
        if not r.first:
            gone[r.doc_id].update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50 and r.source_id != r.doc_id
    assert got == want
    for v in places.values():  # each passage stays somewhere
        assert any(not set(range(p, p + 50)) <= gone[i] for i, p in v)
    cleaned = {r.doc_id: r.text for r in suffix_dedup.without(df, suffix_dedup.repeated_passages(df)).collect()}
    for i, w in words.items():
        assert (cleaned[i] or "").split() == [x for k, x in enumerate(w) if k not in gone[i]]


def repeated_and_gone(spark, docs, partitions=1):
    """Words of ``docs`` in passages that repeat and words that ``without`` cuts, by document."""
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(partitions)
    got, gone = collections.defaultdict(set), collections.defaultdict(set)
    for r in suffix_dedup.repeated_passages(df).collect():
        assert r.source_id != r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
        if not r.first:
            gone[r.doc_id].update(range(r.start_word, r.end_word))
    return got, gone


@pytest.mark.parametrize("heavy", [10_000, 2])
def test_one_holder_keeps_a_passage(spark, heavy, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    rng = random.Random(11)
    spans, docs = collections.defaultdict(dict), []
    passages = [prose(rng, n) for n in (50, 55, 62, 80)]
    for holder in range(12):
        for k, passage in enumerate(passages):
            before = prose(rng, rng.randrange(5, 60))
            spans[k][len(docs)] = (len(before), len(before) + len(passage))
            docs.append(" ".join(before + passage + prose(rng, rng.randrange(5, 60))))
    got, gone = repeated_and_gone(spark, docs, 5)
    for holders in spans.values():
        keeps = [i for i, (a, b) in holders.items() if not gone[i] & set(range(a, b))]
        assert keeps == [min(holders)]
        assert all(got[i] == set(range(a, b)) for i, (a, b) in holders.items())
        assert all(gone[i] == got[i] for i in holders if i != min(holders))


def test_edited_versions_against_brute_force(spark):
    rng = random.Random(13)
    base, docs = prose(rng, 300), []
    for _ in range(150):
        docs.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.05 else w for w in base))
    for k in (18, 24, 30):  # pairs that others share more with on one side only
        left, seed, right = prose(rng, 40), prose(rng, 20), prose(rng, 40)
        for a, b in [(15, 15), (15, 15), *[(40, 5)] * 4, *[(5, 40)] * 4]:
            docs.append(" ".join(prose(rng, k) + left[40 - a :] + seed + right[:b] + prose(rng, k)))
    places = collections.defaultdict(list)
    for i, t in enumerate(docs):
        w = t.split()
        for p in range(len(w) - 49):
            places[tuple(w[p : p + 50])].append((i, p))
    want, cut = collections.defaultdict(set), collections.defaultdict(set)
    for v in places.values():
        for i, p in v if len(v) > 1 else ():
            want[i].update(range(p, p + 50))
            if (i, p) != min(v):
                cut[i].update(range(p, p + 50))
    got, gone = repeated_and_gone(spark, docs, 4)
    assert got == want and gone == cut


def test_pipeline_on_small_tables(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    insult = lambda i: [x for w in prose(rng, 4) for x in ("moron", w)] if i % 5 == 0 else []
    rows = [(i, " ".join(prose(rng, 60) + insult(i) + prose(rng, 60)), "en", "s", 0) for i in range(300)]
    passage, other = " ".join(prose(rng, 70)), " ".join(prose(rng, 60))
    rows += [(700, rows[1][1], "en", "s", 0), (701, "x y z. " + passage, "en", "s", 0), (702, passage + " " + other + " mail bob@example.com now", "en", "s", 0), (703, None, None, None, None), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 5 == 0)) for r in rows[:300]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.dtypes == docs.dtypes, name
        kept.append({r.doc_id: r.text for r in now.collect()})
    toxic = {i for i in range(300) if i % 5 == 0}
    assert set(kept[0]) == {r[0] for r in rows} - toxic
    assert set(kept[1]) == set(kept[0]) - {700}
    assert kept[2][702].split() == [*other.split(), "mail", "bob@example.com", "now"] and passage.split()[5] in kept[2][701]
    assert "<EMAIL>" in kept[3][702] and kept[3][703] is None
    pieces = cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept[3])


@pytest.mark.parametrize("family", [20_000, 3])
def test_families_of_any_size_give_the_same(spark, family, monkeypatch):
    monkeypatch.setattr(minhash, "FAMILY", family)
    monkeypatch.setattr(minhash, "CHUNK", 7)
    rng = random.Random(21)
    base, docs = prose(rng, 60), []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(3000)}"
        docs.append(" ".join(w))
    sets = [frozenset(zip(w, w[1:], w[2:], w[3:])) for w in map(str.split, docs)]
    want = Union(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want.join(i, j)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == {i: want.find(i) for i in range(len(docs))}


def test_shared_cores_with_different_surroundings(spark):
    rng = random.Random(1)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for size in (30, 40, 45):
        core = word(size)
        for _ in range(40):
            left = rng.randrange(51 - size)
            passage = word(left) + core + word(50 - size - left)
            docs += [" ".join(word(30) + passage + word(30)) for _ in range(2)]
    got, gone = repeated_and_gone(spark, docs, 5)
    assert all(30 <= min(got[i]) < max(got[i]) < 80 and len(got[i]) == 50 for i in range(len(docs)))
    assert all((len(gone[i]) == 50) == (i % 2 == 1) for i in range(len(docs)))


def test_suffixes_on_odd_tables(spark):
    rng = random.Random(2)
    big = " ".join(prose(rng, 300))
    df = spark.createDataFrame([(1, big, 1), (1, "short", 2), (1, big, 3), (2, "x " + big, 4), (None, big, 5), (3, None, 6)], "doc_id long, text string, __id int")
    found = suffix_dedup.repeated_passages(df)
    rows = found.collect()
    assert {r.doc_id for r in rows} in ({1, 2}, set())
    cut = suffix_dedup.without(df, found)
    assert cut.columns == df.columns
    texts = {r["__id"]: r.text for r in cut.collect()}
    assert texts[2] == "short" and texts[5] == big and texts[6] is None and texts[1] == texts[3] == big
    assert texts[4].split() == (["x"] if rows else ["x", *big.split()])
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0 and suffix_dedup.without(df.limit(0), found).count() == 0


def test_embeddings_write_no_multiple_of_the_input(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    x[3000:3040] = x[7] + 0.05 * x[3000:3040]
    path = f"file://{tempfile.mkdtemp()}/embeddings"
    spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(path)
    monkeypatch.setattr(embed_dedup, "CHUNK", 400)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = moved()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.read.parquet(path)).collect()}
    assert moved() - before < 4 * x.nbytes
    near = {7, *range(3000, 3040)}
    assert got == {i: (40, 7) if i in near else (0, i) for i in range(6000)}


def test_embeddings_at_the_threshold(spark):
    a = [1.0, 0.0]
    rows = [(1, a, 1, 5), (2, [0.93, float(np.sqrt(1 - 0.93**2))], 1, 5), (3, [0.9299999, float(np.sqrt(1 - 0.9299999**2))], 1, 5), (None, a, 1, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    x, y = np.array(rows[0][1]), np.array(rows[1][1])
    tie = bool(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    assert got[1] == int(tie) and got[2] == int(tie) + 1 and got[3] == 1 and got[None] == 0


def test_pipeline_loses_no_text(spark):
    cp = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    a, b = (" ".join(prose(rng, 80)) for _ in range(2))
    docs = spark.createDataFrame([(1, a, "en", "s", 0), (1, b, "en", "s", 0), (1, a, "de", "t", 0), (2, a, "en", "s", 0), (None, a, "en", "s", 0), (None, a, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.doc_id != 2) == sorted([("1", a), ("1", b), ("None", a), ("None", a)])
