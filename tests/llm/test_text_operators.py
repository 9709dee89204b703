"""Operators that work on one text at a time, against brute force and round trips."""

import base64
import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelens.llm import bpe, html_main, packing, pii, quality_clf, quality_rules, textops, toxicity

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

ODD = st.text(alphabet="'strevlmd  \n\t12²é!\x1c　中x.,|%<>@+-()", max_size=80)
BYTE_PATH, WORD_PATH = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoding():
    with open(BYTE_PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(ODD, max_size=6))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_tiktoken(texts):
    encoding = test_bpe_equals_tiktoken.encoding
    ids, _ = bpe.encode_texts(texts, bpe.vocabulary(BYTE_PATH)) if texts else ([], [])
    assert [x.tolist() for x in ids] == [encoding.encode_ordinary(t) for t in texts]


@pytest.fixture(autouse=True, scope="module")
def _share(encoding):
    test_bpe_equals_tiktoken.encoding = encoding


def test_bpe_long_slice(encoding):
    text = "a" * 5000 + " " * 900 + "'" * 70
    ids, lengths = bpe.encode_texts([text], bpe.vocabulary(BYTE_PATH))
    assert ids[0].tolist() == encoding.encode_ordinary(text) and lengths[0].sum() == len(text)


def test_scan_composes_transition_functions():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 256, 1000).astype(np.uint8)
    got = bpe.scan(f)
    for s in range(4):
        state = s
        for i, x in enumerate(f.tolist()):
            state = x >> (2 * state) & 3
            assert int(got[i]) >> (2 * s) & 3 == state


def test_bpe_frames(spark):
    df = spark.createDataFrame([(1, "it's  x\n"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    out = bpe.decode(bpe.encode(df, BYTE_PATH), BYTE_PATH).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out) == [(1, b"it's  x\n"), (2, b""), (3, b""), (3, b"")]
    assert all(len(r.ids) == len(r.offsets) for r in out)


@given(ODD)
@settings(max_examples=150, deadline=None)
def test_words_and_windows(text):
    data = text.encode()
    starts, ends, hashes = textops.word_hashes(data)
    assert [data[a:b] for a, b in zip(starts, ends)] == data.split()
    by = collections.defaultdict(set)
    for w, h in zip(data.split(), hashes.tolist()):
        by[h].add(w)
    assert all(len(x) == 1 for x in by.values())


@given(st.text(alphabet="ab c\n", max_size=120))
@settings(max_examples=150, deadline=None)
def test_quality_statistics(text):
    got = quality_rules.judge(text.encode())
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    cover = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    assert (got["n_words"], got["word_chars"], got["n_repeat_words"], got["n_dup_lines"]) == (len(words), sum(map(len, words)), len(cover), dup)
    assert got["base_failed"] == (len(words) < 50 or 100 * len(cover) > 50 * len(words))


def test_quality_rules_keep_prose_and_drop_navigation():
    rng = random.Random(8)
    prose = "\n".join("The " + " ".join(rng.choice(["cat", "of", "town", "sat", "by", "fire", "warm", "river"]) + str(rng.randrange(90)) for _ in range(11)) + "." for _ in range(8))
    bars = "\n".join(" | ".join(f"item{i}{j}" for j in range(9)) for i in range(8))
    assert quality_rules.judge(prose.encode())["kept"] and not quality_rules.judge(bars.encode())["kept"]
    mixed = quality_rules.judge((prose + "\n" + "Home | About | Help | Login").encode())
    assert mixed["kept"] and "Home" not in mixed["clean_text"]


def test_quality_frames(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (2, "x " * 100)], "doc_id long, text string")
    assert sorted((r.n_words, r.kept) for r in quality_rules.clean(df).collect()) == [(0, False), (0, False), (100, False)]
    assert quality_rules.clean(df.limit(0)).count() == 0


def base_spans(t):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@given(st.text(alphabet="1234567890..@@ab+- ()-99", max_size=90))
@settings(max_examples=300, deadline=None)
def test_pii_base(text):
    assert pii.find(text) == base_spans(text)
    assert set(pii.find(text)) <= set(pii.spans_of(text)[1])


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write anna at example dot com please", "email", "anna at example dot com"),
        ("ｊohn@ехample.com", "email", "ｊohn@ехample.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("card four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
        ("ip １９２.１６８.1.1 up", "ip", "１９２.１６８.1.1"),
        ("jane​doe@mail.example.com", "email", "jane​doe@mail.example.com"),
    ],
)
def test_pii_disguises(text, kind, found):
    assert (kind, found) in [(k, text[a:b]) for a, b, k in pii.spans_of(text)[1]]


def test_pii_leaves_prose_alone():
    text = "We met at noon, at the dot of twelve; one or two of us were late. Un deux! Version 1.2.3 of 2024-01-15."
    assert pii.spans_of(text) == ([], [])


def test_pii_frames_and_mask(spark):
    df = spark.createDataFrame([(1, "a b@c.de x", "k"), (2, None, None), (3, "", "k")], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    assert got[1].spans == "email:2:8" and got[1].redacted == "a <EMAIL> x" and got[2].n_email == 0
    assert sorted(str(r.text) for r in pii.mask(df).collect()) == ["", "None", "a <EMAIL> x"]


def test_html_blocks():
    prose = "The cat sat on the mat and it was the best of all the mats in the house, for it was warm and it was by the fire. " * 3
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href='/'>Home of the</a></nav><div class='cookie-notice'>We use the cookies of the site</div><aside>the of and</aside><article><h1>A &amp; B</h1><p>{prose}<b>end</b>.</p><script>var t='</p>';</script><p>Short\n one.<br>Two</article><div id='comments'><p>{prose}</p></div><form>the name of</form><footer>&copy; the end"
    assert html_main.main_text(page) == " ".join(f"A & B {prose}end. Short one. Two".split())
    plain = f"<div class=sidebar>{prose}</div><div><h2>Head</h2><p>{prose}</p><p>Bit.</p><p>{prose}</p></div>"
    assert html_main.main_text(plain) == " ".join(f"Head {prose} Bit. {prose}".split())
    assert html_main.main_text("") == "" and html_main.main_text("<p>") == "" and html_main.main_text("1 < 2") == "1 < 2"


def test_html_frames(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x y</p></article>"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_main.extract(df).collect()) == [(1, "u", "x y", 3), (2, None, "", 0)]


def documents(n, rng, bad):
    words = ["the", "of", "and", "thing", "other", "house", "garden", "river", "stone"]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_held_out(spark):
    rows = documents(400, random.Random(3), ["moron", "scumbag"])
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    truth = {i: y for i, _, y in rows}
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert got[900].predicted == got[901].predicted == 0
    assert toxicity.fit(docs, labels.limit(0)) is None and {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_quality_classifier_held_out(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = [rng.choice(["The", "cat", "sat", "by", "the", "fire."]) for _ in range(80)]
        good = i % 4 != 0
        rows.append((i, " ".join(w) if good else " ".join(x + "%%%" for x in w), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_clf.classify(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95 and 0 <= got[900].score <= 1


def verify_packing(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_PATH)
    ids = {k: np.array([*tokenizer.encode(v or "", add_special_tokens=False).ids, 2], "<u4") for k, v in docs}
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r["offset"], r.length))
    for parts, total in [*((by[k], len(v)) for k, v in ids.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == total if total is not None else at <= 4096
    return 1 - sum(map(len, ids.values())) / (4096 * len(sequences))


def test_packing(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["hello", "it's", "World,", "é.", "a%%%", "<|EndOfText|>"]) for _ in range(rng.choice([0, 5, 900, 3000])))) for i in range(120)]
    docs += [(1000 + i, "hello world it's fine " * 500 + "x" * (i % 3)) for i in range(200)] + [(5000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert verify_packing(packing.pack(df, WORD_PATH).collect(), docs) < 0.08  # some two hundred sequences, most of one length
    assert packing.pack(df.limit(0), WORD_PATH).count() == 0
    assert packing.pack(df.limit(1).unionAll(df.limit(1)), WORD_PATH).count() == 2


def test_crc_join():
    assert packing.joined_crc(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_least_squares_uses_the_counts():
    counts = np.zeros(4097, np.int64)
    counts[[1000, 3096, 2048]] = [50, 50, 40]
    patterns = packing.plan(counts[:4097])
    assert sum(t for _, t in patterns) == 70
    assert sorted(patterns) == [(((2048, 2),), 20), (((3096, 1), (1000, 1)), 50)] or sum(u * a for (need, _) in patterns for a, u in need) == 4096 * len(patterns)


PROSE = "The cat sat on the mat and it was the best of all the mats in the house, for it was warm and it was by the fire. "
STORY = f"<h1>A title of the day</h1><p>{PROSE * 3}</p><p>{PROSE * 3}</p>"


@pytest.mark.parametrize(
    "page, titled",
    [
        (f"<ul><li class=menu>Home<li class=menu>About</ul><article>{STORY}</article>", True),
        (f"<li class=menu>Home<li class=menu>About</ul><article>{STORY}</article>", True),
        (f"<p class=ad>Buy now<p>{PROSE * 3}<p>{PROSE * 3}", False),
        (f"<form action=/s><input name=q><article>{STORY}</article>", True),
        (f"<form id=all><nav><a href=/>Home</a></nav><div>{STORY}</div><footer>of the site</footer></form>", True),
        (f"<div class='col hidden-xs'>{STORY}</div>", True),
        (f"<div class='content has-sidebar'>{STORY}</div>", True),
        (f"<div class='legal guide'>{STORY}</div>", True),
        (f"<div>{STORY}</div><article><a href=/x>More of the news of the day and of the week for you</a></article>", True),
        (f"<article>{STORY}</article><div id=comments><article class=comment><p>{PROSE * 9}</p></article></div>", True),
        (f"<div class=post>{STORY}</div><ol class=comment-list><li><p>{PROSE * 9}</p></ol><div class='cookie-notice'>{PROSE}</div>", True),
        (f"<header><h1>Site</h1><p>{PROSE}</p></header><main>{STORY}</main><aside><p>{PROSE * 3}</p></aside><footer><p>{PROSE * 2}</p></footer>", True),
        (f"<table><tr><td><a href=/>x</a><td>{STORY}</table>", True),
    ],
)
def test_html_disturbances(page, titled):
    assert html_main.main_text(f"<body>{page}") == ("A title of the day " if titled else "") + " ".join((PROSE * 6).split())


def tree_text(page):
    """Text outside of named parts by Python's own parser, for pages whose tags are all closed."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.out = [], []

        def handle_starttag(self, tag, attrs):
            self.stack.append((tag, dict(attrs).get("class", "")))
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.stack.pop()
            self.out.append(" ")

        def handle_data(self, data):
            if not any(t in ("nav", "footer", "aside", "script") or c in ("ad", "comments") for t, c in self.stack):
                self.out.append(data)

    tree = Tree()
    tree.feed(page)
    return " ".join("".join(tree.out).split())


def test_html_against_a_tree_walk():
    rng = random.Random(12)
    for _ in range(60):
        story = "".join(rng.choice([f"<p>{PROSE * 3}</p>", f"<p>{PROSE * 2} &amp; more</p>", "<p>Short bit.</p>", f"<div><h2>Head</h2><p>{PROSE * 3}</p></div>"]) for _ in range(rng.randrange(3, 8))) + f"<p>{PROSE * 4}</p>"
        noise = [f"<nav><ul><li>Home</li><li>{PROSE}</li></ul></nav>", f"<div class='ad'>{PROSE * 2}</div>", f"<aside><p>{PROSE * 3}</p></aside>", f"<div class='comments'><p>{PROSE * 5}</p></div>", "<script>var x = 1;</script>", f"<footer><p>{PROSE}</p></footer>"]
        rng.shuffle(noise)
        k = rng.randrange(len(noise))
        page = f"<html><body>{''.join(noise[:k])}<article>{story}</article>{''.join(noise[k:])}</body></html>"
        assert html_main.main_text(page) == tree_text(page)


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{PROSE * 4000}</p>", "t", 1), (1, "u", f"<p>{PROSE * 4000}</p>", "t", 1), (None, None, "<<<>", None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(html_main.extract(df).collect(), key=lambda r: r.n_chars)
    assert [r.n_chars for r in got] == [4, 4000 * len(PROSE) - 1, 4000 * len(PROSE) - 1] and got[1] == got[2]
    assert html_main.extract(df.limit(0)).count() == 0


def test_toxicity_distances_are_differences_of_compressed_lengths():
    import zstandard as z

    rng = random.Random(4)
    plain = " ".join(f"w{rng.randrange(500)}" for _ in range(3000)).encode()
    bad = b" you are a total scumbag and nobody wants a scumbag here "
    meter = toxicity.Meter(plain, bad + plain)
    params = z.ZstdCompressionParameters(window_log=22, hash_log=17, chain_log=19, search_log=8, min_match=4, target_length=64, strategy=z.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)

    def size(window, content):
        known = z.ZstdCompressionDict(content + toxicity.END, dict_type=z.DICT_TYPE_RAWCONTENT)
        return len(z.ZstdCompressor(dict_data=known, compression_params=params).compress(window + b" " * toxicity.TAIL))

    texts = [b"W1 w2 w3 you are a total scumbag w9", b"", b"w1", b"\xc3\x84 a\tb"]
    for text, got in zip(texts, toxicity.distances(texts, meter)):
        low = b" " + text.decode().lower().encode()
        starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0d]+", low)]
        ends = [m.end() for m in re.finditer(rb"[^\x20\x09-\x0d]+", low)]
        windows = [low[starts[i] - 1 : ends[min(i + 2, len(ends) - 1)] + 1] for i in range(0, min(len(starts), max(1, len(starts) - 1)), 2)]
        assert got.tolist() == [size(w, plain) - size(w, bad + plain) for w in windows]
    assert toxicity.distances(texts, meter)[0].max() >= 4


def test_long_texts_are_read_whole():
    rng = random.Random(6)
    words = [f"w{rng.randrange(400)}" for _ in range(40_000)]
    meter = toxicity.Meter(" ".join(words[:2000]).encode(), " ".join(words[:2000]).encode() + b" scumbag moron ")
    d = toxicity.distances([" ".join([*words, "scumbag", "moron"]).encode()], meter)[0]
    assert len(d) == 20_001 and d[-1] > 3


def test_fits_are_bounded_on_repeated_rows(spark):
    from tracelens.llm import labelled

    docs = spark.createDataFrame([(7, "b"), *[(7, "a")] * 500, *[(i, "x") for i in range(100, 140)]], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), *[(i, i % 2) for i in range(100, 140)]], "doc_id long, toxic int")
    rows = labelled.sample(docs, labels, "toxic", 5, 9, 24).collect()
    assert len(rows) == 41 and sorted(r.text for r in rows if r.id == 7) == ["a"]


def test_prior_from_positives_and_unlabelled_rows(spark):
    rng = random.Random(15)
    prose = lambda: " ".join(rng.choice(["The", "cat", "sat", "by", "the", "warm", "fire."]) for _ in range(rng.randrange(40, 90)))
    junk = lambda: " ".join(rng.choice(["a%%%", "b###", "|", "1234"]) for _ in range(rng.randrange(40, 90)))
    rows = [(i, junk() if i % 10 < 3 else prose()) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in rows if i % 10 >= 3 and i % 2], "doc_id long, quality int")
    table = quality_clf.features(docs)
    model = quality_clf.fit(table, docs, labels)
    assert abs(model.prior - 0.7) < 0.05
    got = {r.doc_id: r.predicted for r in quality_clf.score(table, model).collect()}
    assert np.mean([got[i] == (i % 10 >= 3) for i, _ in rows]) > 0.97
    assert quality_clf.fit(table, docs, labels.limit(0)) is None
    assert quality_clf.classify(docs.limit(0), labels).count() == 0
    clash = spark.createDataFrame([(1, "t", 1), (1, "t", 1), (None, None, 2)], "doc_id long, text string, score int")
    assert [r.score for r in quality_clf.classify(clash, labels.limit(0)).collect()] == [0.5] * 3


def test_store_notices_colliding_hashes():
    store = textops.Store(100)
    make = lambda at: [np.array([int(i)], np.uint32) for i in at]
    one, two = np.array([5, 5], np.uint64), np.array([1, 2], np.uint64)
    ids, bound = store.gather(one, two, make)
    assert ids.tolist() == [0, 1] and bound.tolist() == [0, 1, 2]
    assert store.gather(np.array([5], np.uint64), np.array([1], np.uint64), make)[0].tolist() == [0]


def test_bpe_unknown_ids_and_odd_tables(spark):
    df = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="unknown token ids"):
        bpe.decode(df, BYTE_PATH).collect()
    none = spark.createDataFrame([], "doc_id long, text string, ids string, offsets int")
    assert bpe.decode(bpe.encode(none, BYTE_PATH), BYTE_PATH).count() == 0
    long = spark.createDataFrame([(1, "it's  x\n" * 60_000)], "doc_id long, text string")
    assert bytes(bpe.decode(bpe.encode(long, BYTE_PATH), BYTE_PATH).first().decoded) == b"it's  x\n" * 60_000


def test_text_operators_on_odd_tables(spark):
    long = "word, " * 50_000 + "a@b.cd"
    df = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, None, 2)], "doc_id long, text string, n_words int")
    found = sorted(pii.detect(df, redacted=False).collect(), key=lambda r: r.n_email)
    assert [r.n_email for r in found] == [0, 1, 1] and found[1].spans == f"email:{len(long) - 6}:{len(long)}"
    assert pii.detect(df.limit(0)).count() == 0 and pii.mask(df.limit(0)).count() == 0
    assert sorted(r.n_words for r in quality_rules.clean(df).collect()) == [0, 50_001, 50_001]
    packed = packing.pack(df.withColumnRenamed("n_words", "length"), WORD_PATH).collect()
    assert len({(r.sequence_id, r["offset"]) for r in packed}) == len(packed) and sum(r.length for r in packed if r.doc_id == 2) == 1


def test_boilerplate_is_not_prose():
    assert quality_rules.line_fails(b"Read more", 2, quality_rules.Rules()) == "boilerplate"
    assert quality_rules.line_fails(b"(c) 2020 Foo. All rights reserved.", 6, quality_rules.Rules()) == "boilerplate"
    assert not quality_rules.line_fails(b"She wanted to log in at once, but the old machine in the hall was slow.", 16, quality_rules.Rules())
