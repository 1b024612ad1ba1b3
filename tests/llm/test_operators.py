"""The training-data operators on small tables: against brute force, and on nulls, empty texts, ties and repeats."""

import collections
import hashlib
import itertools
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolecall.llm import chat, contamination, jaccard, language, lattice, licences, pieces, toxicity, urls, winnowing
from rolecall.llm import arrow_text
from rolecall.llm.arrow_text import NOT_SPACE, Words, chunks, shingle_sets
from rolecall.llm import queries
from rolecall.llm.queries import PIECES
from rolecall.llm.stages import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 30_000
ODD = [(1, None, "en", "a", 0), (2, "", None, "b", 0), (3, " \t\n ", "en", None, 3), (None, "no id here at all", "de", "c", 1), (4, "123 456", "en", "d", 1),
       (5, LONG, "de", "e", 1), (6, "same text as another row", "en", "f", 1), (6, "same text as another row", "en", "f", 1), (7, "same text as another row", "en", "f", 1),
       (8, "x", "en", "g", 1), (9, "日本語 текст ñandú", "es", "h", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return re.findall(r"[^ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=lambda x: (x is None, x))


# words and components

@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t日.", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_match_a_regex(texts):
    seen = {}
    for first, last, data, offsets in chunks(pa.array(texts, pa.string()), 16):
        w = Words(data, offsets, NOT_SPACE)
        for k in range(last - first):
            own = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[k]:w.first[k + 1]], w.end[w.first[k]:w.first[k + 1]])]
            assert own == tokens(texts[first + k])
            for word, h in zip(own, w.hash[w.first[k]:w.first[k + 1]]):
                assert seen.setdefault(word, h) == h
        assert [len(s) for s in shingle_sets(w, 2)] == [len({*zip(t, t[1:])}) if len(t) > 1 else len(t) for t in map(tokens, texts[first:last])]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(None, 3), (7, None), (5, 5), (200, 199)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "t").collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 199: 199, 200: 199}


# language identification and toxicity

def test_language_learns_and_rejects(spark, odd, none):
    rows = [(i, " ".join(np.random.default_rng(i).choice(words, 30)), lang, None, 1) for i, (lang, words) in enumerate(
        [("en", ["the", "house", "weather", "thing"]), ("de", ["der", "schnee", "haus", "wetter"])] * 40)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs, F.col("doc_id") % 4 > 0)
    assert model.languages == ("de", "en")
    got = language.identify(docs.withColumn("lang_pred", F.lit("clash")), model)
    assert got.filter("lang <> lang_pred or lang_rejected or lang_score not between 0.5 and 1").isEmpty()
    assert got.columns == [*docs.columns, "lang_pred", "lang_score", "lang_rejected"]
    strange = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert len(strange) == len({r[0] for r in ODD})
    for i in (1, 2, 3, 4):
        assert strange[i].lang_pred == "und" and strange[i].lang_rejected and strange[i].lang_score == 0
    assert language.fit(none, F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(none, model).isEmpty()


def test_toxicity_finds_words_and_their_forms(spark, odd, none):
    rng = np.random.default_rng(3)
    plain = ["house", "garden", "river", "walks", "slow", "green", "under", "bridge"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 25))
        if i % 4 == 0:
            words[int(rng.integers(25))] = f"badword{rng.choice(list('abcdefghij'))}"
        rows.append((i, " ".join(words), "en", None, 1))
        labels.append((i, 0, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(5, 0, None), (None, 0, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") < 300)
    got = toxicity.score(docs.withColumn("toxicity", F.lit("clash")), model).filter("doc_id >= 300").collect()
    assert sum((r.toxicity >= 0.3) == (r.doc_id % 4 == 0) for r in got) >= 97
    assert not any(r.toxic and r.doc_id % 4 for r in got)
    strange = toxicity.score(odd, model).collect()
    assert len(strange) == len(ODD) and all(0 <= r.toxicity <= 1 for r in strange)
    empty = {round(r.toxicity, 9) for r in strange if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1  # the score of no words
    assert toxicity.fit(docs, marks.limit(0), F.lit(True)) is None
    assert {(r.toxicity, r.toxic) for r in toxicity.score(odd, None).collect()} == {(0.0, False)}
    assert toxicity.score(none, model).isEmpty()
    assert "toxic" in toxicity.score(docs.select("doc_id", "text"), model).columns  # without a language


# the same models, forward in plain Python

M64 = 2**64 - 1


def plain_mix(x, salt=0):
    x = (x + salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def plain_hash(data, salt=0):
    total, power = 0, 1
    for b in data:
        total, power = (total + int(arrow_text._BYTE[b]) * power) & M64, power * 0x9E3779B97F4A7C15 & M64
    return plain_mix(total, salt)


TEXTS = ["", "A badworda in the garden!", "x", "über-schöne Häuser, 123 houses", "badwordq badwordq", "one\nline. And another line", "日本語 text", "1234 !!", None]


def test_toxicity_score_matches_a_plain_forward_pass(spark):
    own = toxicity.ToxicitySettings()
    rng = np.random.default_rng(1)
    samples = [(k % 2, "en", 1.0, *(np.asarray(x, "<i4").tobytes() for x in toxicity.word_ids(*chunk(t), own)[1:]))
               for k, t in enumerate([" ".join(rng.choice(["house", "tree", "river"], 9)) + (" badworda now" if k % 2 else "") for k in range(120)])]
    model = toxicity.train(samples, own)

    def plain(text):
        words = [w.encode() for w in re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
        x = [model.words[plain_hash(w) % own.buckets] + model.prefixes[plain_hash(w[: own.prefix], 1) % own.buckets] for w in words]
        best = []
        for kernel in model.kernels:
            for f in range(kernel.shape[2]):
                at = [sum(float(x[i + j] @ kernel[j][:, f]) for j in range(len(kernel)) if i + j < len(x)) for i in range(len(x))]
                best.append(max(at, default=0.0))
        z = sum(max(b + c, 0) * w for b, c, w in zip(best, model.bias.tolist(), model.weight.tolist())) + model.offset
        return 1 / (1 + math.exp(-(model.slope * z + model.shift)))

    got = toxicity.score(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), model).collect()
    assert {r.doc_id: pytest.approx(r.toxicity, abs=1e-5) for r in got} == {i: plain(t) for i, t in enumerate(TEXTS)}
    few = toxicity.train(samples[:30], own)  # too few for a held part: the general threshold alone
    assert few.thresholds == {} and model.thresholds.keys() <= {"en"}


def chunk(text):
    return next((data, offsets) for _, _, data, offsets in chunks(pa.array([text], pa.string())))


def test_language_matches_a_plain_forward_pass(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words, 20)), lang, None, 1) for i, (lang, words) in enumerate([("en", ["the", "house", "weather"]), ("de", ["über", "schnee", "häuser"])] * 30)]
    model, own = language.fit(spark.createDataFrame(rows, DOCS), F.lit(True)), language.LanguageSettings()

    def plain(text):
        data = (text or "").lower().encode()
        letter = lambda i: 0 <= i < len(data) and (97 <= data[i] <= 122 or data[i] >= 128)
        kept = [data[i] if letter(i) else 32 for i in range(len(data)) if letter(i - 1) or letter(i) or letter(i + 1)]
        grams = []
        for size in (2, 3, 4):
            for i in range(len(kept) - size + 1):
                part = kept[i : i + size]
                if 32 in part[1:-1] or size == 2 and part == [32, 32]:
                    continue
                value = size * 0x9E3779B1 % 2**32
                for b in part:
                    value = (value ^ b) * 0x01000193 % 2**32
                    value ^= value >> 15
                value = value * 0x85EBCA6B % 2**32
                grams.append((value ^ value >> 13) % own.buckets)
        z = [(sum(float(model.table[g, k]) for g in grams) / max(1, len(grams)) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(x - max(z)) for x in z]
        if not re.search(r"[^\W\d_]", text or ""):
            return "und", 0.0
        return model.languages[p.index(max(p))], max(p) / sum(p)

    got = language.identify(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), model).collect()
    assert {r.doc_id: (r.lang_pred, pytest.approx(r.lang_score, abs=1e-5)) for r in got} == {i: plain(t) for i, t in enumerate(TEXTS)}


# near copies

def brute_components(rows, width, num, den):
    shapes = collections.defaultdict(set)
    for i, text in rows:
        w = tokens(text)
        s = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])
        shapes[i].add(s)
    up = {i: i for i in shapes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, own in shapes.items() for s in own if s]
    for (i, a), (j, b) in itertools.combinations(flat, 2):
        if den * len(a & b) >= num * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return {i: root(i) for i in shapes}


@pytest.mark.parametrize("width,num,den,thin,block", [(3, 9, 10, 2, 400_000), (3, 4, 5, 1, 300), (2, 7, 10, 1, 150)])
def test_near_copies_match_brute_force(spark, width, num, den, thin, block):
    rng = np.random.default_rng(width)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for family in range(6):
        base = list(rng.choice(words, int(rng.integers(8, 90))))
        for _ in range(25):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "one two", "ONE two", "one", " \n"])]
    rows += [(3, rows[40][1]), (10, rows[10][1])]  # an id with two texts joins both families
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"),
                              jaccard.JaccardSettings(width=width, numerator=num, denominator=den, thin=thin, block=block), "t")
    got = got.collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, width, num, den)


def test_near_copies_of_odd_rows(odd, none):
    got = [tuple(r) for r in jaccard.near_copies(odd, name="t").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (4, 1, 4), (5, 1, 5), (6, 1, 6), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9)], key=str)
    assert jaccard.near_copies(none, name="t").isEmpty()


@pytest.mark.parametrize("num,den,thin", [(9, 10, 2), (4, 5, 1)])
def test_every_link_shares_a_signature(num, den, thin):
    rng = np.random.default_rng(num)
    own = jaccard.JaccardSettings(numerator=num, denominator=den, thin=thin)
    for _ in range(400):
        a = rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64)
        keep = a[rng.random(len(a)) > (den - num) / den * rng.random() * 0.6]
        b = np.concatenate([keep, rng.integers(0, 2**63, int(len(a) * (den - num) / den * 0.5 * rng.random()), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if len(b) and not np.array_equal(a, b) and den * shared >= num * (len(a) + len(b) - shared):
            assert len(np.intersect1d(jaccard.signatures(a, own), jaccard.signatures(b, own)))
            apart = np.abs(np.frombuffer(jaccard.tally(a), np.uint8).astype(int) - np.frombuffer(jaccard.tally(b), np.uint8)).sum()
            assert apart <= jaccard._may_differ(len(a), len(b), own)


# decontamination

def brute_leaks(docs, items, num=4, den=5):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^ \t-\r]+", (text or "").lower())
        for item, own in items:
            v = re.findall(r"[^ \t-\r]+", (own or "").lower())
            if not v or not w:
                continue
            k = min(5, len(v))
            target = collections.Counter(zip(*[v[j:] for j in range(k)]))
            for s in range(max(0, len(w) - len(v)) + 1):
                window = collections.Counter(zip(*[w[s : s + len(v)][j:] for j in range(k)]))
                shared = sum((window & target).values())
                total = sum((window | target).values())
                if window and den * shared >= num * total:
                    out[i, item] = max(out.get((i, item), 0), round(shared / total, 9))
    return out


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(rng.choice(words, n))

    items = [(k, text(int(rng.integers(18, 60)))) for k in range(8)] + [(8, "only three words"), (9, None), (10, " "), (11, "again and again and again and again and again and again and again")]
    docs = []
    for i in range(60):
        inside = dict(items)[int(rng.integers(8))].split()
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(inside)))
            inside[at : at + int(rng.integers(0, 2))] = [str(x) for x in rng.choice(words, int(rng.integers(0, 2)))]
        docs.append((i, " ".join([text(int(rng.integers(1, 80))), *inside, text(int(rng.integers(1, 80)))])))
    docs += [(60, dict(items)[0].upper()), (61, " ".join(dict(items)[1].split()[2:])), (62, "well only three words here"), (63, None), (64, ""),
             (65, items[11][1] + " and again and"), (0, text(30)), (60, dict(items)[0].upper())]
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), name="t")
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == brute_leaks(docs, items)


def test_leaks_with_moved_parts_match_brute_force(spark):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice([f"w{i}" for i in range(300)], n))
    items = [(k, text(n)) for k, n in enumerate([59, 45, 59, 45, 40, 80])]
    cut = [10, 22, 30, 15, 20, 27]
    moved = [w[c:] + w[:c] for (_, t), c in zip(items, cut) for w in [t.split()]]
    docs = [(10 * i + j, " ".join([text(a), *w, text(b)])) for i, w in enumerate(moved) for j, (a, b) in enumerate([(70, 90), (0, 50), (50, 0), (0, 1)])]
    docs += [(100 + i, " ".join(w)) for i, w in enumerate(moved)] + [(200, " ".join([text(20), *moved[1], *moved[0], text(20)])), (201, text(150))]
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), name="t")
    want = brute_leaks(docs, items)
    assert {(0, 0), (10, 1)} <= set(want)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == want


def test_leaks_of_items_with_one_id(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice([f"w{i}" for i in range(300)], n))
    items = [(None, text(30)) for _ in range(12)]
    docs = [(i, f"{text(20)} {t} {text(20)}") for i, (_, t) in enumerate(items)]
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), name="t")
    assert ids(got) == list(range(12))


def test_leaks_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "same text as another row"), (2, None)], "item_id long, text string")
    assert ids(contamination.contaminated(odd, items, name="t")) == [6, 6, 7]
    kept = contamination.clean(odd.withColumn("text_1", F.lit("clash")), items, name="t")
    assert ids(kept) == [1, 2, 3, 4, 5, 8, 9, None] and kept.columns == [*odd.columns, "text_1"]
    assert contamination.contaminated(none, items, name="t").isEmpty()
    assert contamination.clean(odd, items.limit(0), name="t").count() == len(ODD)


# tokens

def proto(*fields):
    def varint(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + np.float32(value).tobytes()
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model():
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", -12.0, 6) for b in range(256)]]
    own += [(p, -2.0 - 0.37 * k, 1) for k, p in enumerate(["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "▁b", "é", "▁▁"])]
    return proto(*[(1, proto((1, p.encode()), (2, s), (3, t))) for p, s, t in own], (2, proto((3, 1), (35, 1))), (3, proto((1, b"identity"), (2, b""), (3, 1), (4, 0), (5, 1))))


@pytest.mark.parametrize("data", [open(PIECES, "rb").read(), unigram_model()], ids=["bpe", "unigram"])
def test_tokens_agree_with_the_original_library(data):
    import sentencepiece
    original, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(data)

    @given(st.lists(st.text(alphabet="abcé \n\t日😀<>x0A▁", max_size=40), max_size=6))
    @settings(max_examples=80, deadline=None)
    def same(texts):
        got, ok = own.encode(pa.array(texts, pa.string()))
        assert [g.tolist() for g in got] == original.encode(texts)
        back = own.decode(got)
        assert back == [original.decode(g.tolist()) for g in got]
        assert ok.tolist() == [a == b for a, b in zip(texts, back)]

    same()


def test_tokens_of_odd_rows(odd, none):
    got = pieces.encode(odd.withColumn("n_tokens", F.lit("clash")), PIECES)
    assert got.columns == [*odd.columns, "token_ids", "n_tokens", "round_trip"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    back = pieces.decode(got, PIECES)
    assert back.filter("decoded <> coalesce(text, '')").isEmpty()
    assert pieces.encode(none, PIECES).isEmpty()


# language-model scores

def test_lattice_sums_all_segmentations():
    vocabulary = lattice.Vocabulary(open(PIECES, "rb").read())
    known = {p: i for i, (p, _, t) in enumerate(pieces.parse(open(PIECES, "rb").read()).pieces) if t == 1}
    log_p = vocabulary.initial
    words = ["the", "thorreou", "éêodd", "x", "龘漢", "hello,", ""]

    def paths(s):
        if not s:
            yield 1.0, collections.Counter()
        for n in range(1, len(s) + 1):
            arcs = [known[s[:n]]] if s[:n] in known else list(vocabulary.bytes[np.frombuffer(s[0].encode(), np.uint8)]) if n == 1 else None
            if arcs is not None:
                for p, c in paths(s[n:]):
                    yield p * math.exp(sum(log_p[a] for a in arcs)), c + collections.Counter(int(a) for a in arcs)

    own = lattice.Lattice(["▁" + w for w in words], vocabulary)
    total = np.zeros(len(log_p))
    for word, lp in zip(words, own.marginals(log_p)):
        found = list(paths("▁" + word))
        mass = sum(p for p, _ in found)
        assert lp == pytest.approx(math.log(mass))
        for p, c in found:
            for a, n in c.items():
                total[a] += p / mass * n
    assert own.expected(log_p, np.ones(len(words))) == pytest.approx(total)
    assert np.exp(log_p[np.isfinite(log_p)]).sum() == pytest.approx(1)


def plain_pieces(vocabulary):
    """The arcs that begin a string, by dictionary."""
    known = {p: i for i, (p, _, t) in enumerate(pieces.parse(open(PIECES, "rb").read()).pieces) if t in (1, 4)}
    longest = max(map(len, known))

    def arcs(s, at):
        found = [(n, [known[s[at : at + n]]]) for n in range(1, min(longest, len(s) - at) + 1) if s[at : at + n] in known]
        return found if s[at] in known else [(1, list(vocabulary.bytes[np.frombuffer(s[at].encode(), np.uint8)])), *found]
    return arcs


def plain_forward(s, arcs, log_p, back=False):
    """Linear-space sums over the paths of all prefixes, or of all suffixes."""
    n = len(s)
    out = [0.0] * n + [1.0] if back else [1.0] + [0.0] * n
    for at in range(n - 1, -1, -1) if back else range(n):
        for k, ids in arcs(s, at):
            p = math.exp(sum(log_p[i] for i in ids))
            if back:
                out[at] += p * out[at + k]
            else:
                out[at + k] += out[at] * p
    return out


def test_score_matches_brute_force(spark):
    texts = [(1, "the garden the Garden"), (2, "thorreou éêodd"), (3, None), (4, "龘漢 hello, world"), (5, "unheard of"), (None, "the"), (5, "unheard of"), (7, "")]
    learn = lambda i: i is not None and i % 3 != 1
    docs = spark.createDataFrame([(*t, 1.0, "clash") for t in texts], "doc_id long, text string, score double, h string")
    vocabulary = lattice.Vocabulary(open(PIECES, "rb").read())
    arcs, log_p = plain_pieces(vocabulary), vocabulary.initial
    words = {t for i, text in texts if learn(i) for t in tokens(text)}
    count = np.where(np.isfinite(log_p), 0.1, 0.0)
    for w in words:
        s = "▁" + w
        before, after = plain_forward(s, arcs, log_p), plain_forward(s, arcs, log_p, back=True)
        for at in range(len(s)):
            for k, ids in arcs(s, at):
                for i in ids:
                    count[i] += before[at] * math.exp(sum(log_p[j] for j in ids)) * after[at + k] / before[-1]
    with np.errstate(divide="ignore"):
        refit = np.log(count / count.sum())
    ends, n = sum(learn(i) for i, _ in texts), sum(learn(i) * len(tokens(t)) for i, t in texts)
    stop = (ends + 0.5) / (ends + n + 1)
    want = [(i, math.log10(stop) + sum(math.log10(1 - stop) + math.log10(plain_forward("▁" + w, arcs, refit)[-1]) for w in tokens(t))) for i, t in texts]
    got = lattice.score(docs, F.col("doc_id") % 3 != 1, PIECES, name="t").collect()
    assert sorted(((r.doc_id, round(r.score, 8)) for r in got), key=str) == sorted(((i, round(x, 8)) for i, x in want), key=str)


def test_long_words_carry_their_state():
    vocabulary = lattice.Vocabulary(open(PIECES, "rb").read())
    rng = np.random.default_rng(5)
    word = "▁" + "".join(rng.choice(list("theinganr日😀"), 1500))
    whole = lattice.Lattice([word], vocabulary).marginals(vocabulary.initial)[0]
    for block in (1, 7, 64, 1499, 5000):
        assert lattice.long_marginal(word, vocabulary, vocabulary.initial, block) == pytest.approx(whole, rel=1e-12)
    words = ["the", "x" * 5000, "", "ing" * 900]
    each = [lattice.Lattice(["▁" + w], vocabulary).marginals(vocabulary.initial)[0] for w in words]
    assert lattice.word_marginals(words, vocabulary, vocabulary.initial) == pytest.approx(each)


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_base_score_matches_brute_force(spark, head):
    rows = [(r[0], r[1]) for r in ODD] + [(20 + i, t) for i, t in enumerate(["a b a c", "c c d", "zz yy a", "Wort wort"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = lambda i: i is not None and i % 3 != 1
    count = collections.Counter(t for i, text in rows if learn(i) for t in [*tokens(text), None])
    n, v = sum(count.values()), len(count)
    got = lattice.score(docs, F.col("doc_id") % 3 != 1, PIECES, lattice.LatticeSettings(head=head), "t").collect()
    want = [(i, len(tokens(t)) + 1, sum(count[x] > 0 for x in [*tokens(t), None]), n,
             round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*tokens(t), None]), 6)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)
    assert lattice.score(docs.limit(0), F.lit(True), PIECES, name="t").isEmpty()


# fingerprints

def brute_selection(hashes, window):
    w = min(window, len(hashes))
    return {(m, max(j for j in range(i, i + w) if hashes[j] == m) + 1) for i in range(len(hashes) - w + 1) if hashes for m in [min(hashes[i : i + w])]}


@pytest.mark.parametrize("gram,window", [(3, 4), (2, 7), (5, 16), (1, 1)])
def test_winnowing_matches_brute_force(spark, gram, window):
    own = winnowing.WinnowSettings(gram, window)
    texts = ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaa", "the cat sat on the mat and the cat sat on the hat", "日本語日本語😀😀ab" * 3, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = winnowing.places(winnowing.minima(F.coalesce("text", F.lit("")), F.lit(0), winnowing.WinnowSettings(gram, 1)))
    for r in df.select("text", whole.alias("all"), winnowing.places(winnowing.fingerprint(F.col("text"), own)).alias("own")).collect():
        assert {(x.hash, x.place) for x in r.own} == brute_selection([x.hash for x in r["all"]], window)
        if len(r.text or "") > gram:
            assert len(r["all"]) == len(r.text) - gram + 1


def test_edits_of_odd_rows(spark, odd, none):
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    edited = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    got = winnowing.edits(odd)
    want = spark.createDataFrame(list(enumerate(edited)), "k long, text string").select("k", winnowing.digest(winnowing.fingerprint(F.col("text"))).alias("d"))
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): r.d for t, r in zip(edited, sorted(want.collect()))}
    found = got.select("doc_id", "n_chars", "edited_sha256", winnowing.digest(F.col("edited_packed")).alias("d")).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted(
        (str(r[0]), len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(rows, texts, edited))
    assert all(by_sha[r.edited_sha256] == r.d for r in found)
    assert winnowing.edits(none).isEmpty()
    one = winnowing.edits(odd.filter("doc_id = 9")).select(winnowing.likeness(winnowing.hashes(F.col("packed")), F.col("next_hashes")).alias("x")).first()
    assert one.x == 1.0  # a single row is its own next


# licenses

def test_licences_find_lines_and_phrases(spark, none):
    rows = [(1, "Released under the MIT License."), (2, "MIT License, under: the mit\nlicense"), (3, None), (4, "x " * 5000 + "CC-BY-NC cc by nc"),
            (5, "text\nThis work is licensed under the GNU General Public License version 3\nmore"), (6, "under the mit license under the MIT license"),
            (7, "the license of this garden"), (8, "licensed under the apache license, version 2.0 or later"),
            (9, " ".join(f"released{' a b c' * 60} under{' d e' * 90} the{' f' * 200} mit{' g' * 150} license".split()) + " h" * 200), (None, "released under the MIT"), (7, "the license of this garden")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))).collect()}
    labels = {i: sorted({x.label for x in r.licences}) for i, r in got.items()}
    assert labels == {1: ["mit"], 2: ["mit"], 3: [], 4: ["cc-by-nc"], 5: ["gpl-3"], 6: ["mit"], 7: [], 8: ["apache-2"], 9: [], None: ["mit"]}
    assert [(x.start, x.end) for x in got[2].licences if x.phrase] == [(2, 6)] and got[3].n_words == 0
    assert [x.start for x in got[4].licences if x.phrase] == [5000, 5003]
    assert licences.scan(none.select("doc_id", "text")).isEmpty()


def test_wrapped_notices_are_found(spark):
    wrap = lambda t, n: "\n * ".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    rows = [(100 * i + n, f"Some file\n\n * {wrap(t, n)}\nand more of it") for i, (_, t) in enumerate(licences.TEMPLATES) for n in (3, 8, 11, 14)]
    rows += [(9000, "redistribution and use in source\n" + "filler\n" * 40 + "and binary forms with or without modification are permitted"), (9001, "redistribution and use in source and binary")]
    got = {r.doc_id: {x.label for x in r.licences} for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()}
    assert got == {i: {licences.TEMPLATES[i // 100][0]} if i < 9000 else set() for i, _ in rows}


def test_windows_match_brute_force():
    rng = np.random.default_rng(2)
    own = licences.LicenceSettings(templates=(("a", "one two three four five six"), ("b", "two three seven two nine"), ("c", "one")))
    vocabulary = "one two three four five six seven eight nine ten".split()
    index = licences.Index(own)
    for _ in range(300):
        texts = [list(rng.choice(vocabulary, int(rng.integers(0, 25)))) for _ in range(3)]
        hashes = licences.word_hashes([" ".join(t) for t in texts], licences.ALNUM)
        row, first = np.repeat(np.arange(3), [len(t) for t in texts]), np.cumsum([0] + [len(t) for t in texts])
        got = index.windows(index.numbers(np.concatenate(hashes)), row)
        for label, t in own.templates:
            held, width = set(t.split()), -(-len(t.split()) * 5 // 4)
            for r, words in enumerate(texts):
                share = [len(held & set(words[s : s + width])) / len(held) for s in range(len(words))]
                mine = [(a - first[r], c) for a, _, x, c in got if x == label and first[r] <= a < first[r + 1]]
                assert all(abs(share[a] - c) < 1e-9 for a, c in mine)
                assert max([c for _, c in mine], default=0) == pytest.approx(max([s for s in share if s >= 0.8], default=0))


def test_templates_do_not_meet_each_other():
    index = licences.Index(licences.LicenceSettings())
    for label, text in licences.TEMPLATES:
        own = index.numbers(licences.word_hashes([text], licences.ALNUM)[0])
        assert {x for _, _, x, _ in index.windows(own, np.zeros(len(own), np.int64))} == {label}


# chat

def event(conv, turn, seq, kind, role=None, text=None, branch=1):
    return (conv, turn, branch, seq, kind, role, text)


EVENTS = "conv_id long, turn long, branch long, seq long, kind string, role string, text string"


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [event(1, 0, 2, "delta", text="lo"), event(1, 0, 0, "open", "user"), event(1, 0, 1, "delta", text="hel"), event(1, 0, 1, "delta", text="hel"),
           event(1, 1, 0, "open", "assistant"), event(1, 1, 1, "delta", text="draft"), event(1, 1, 2, "regenerate"), event(1, 1, 3, "delta", text="final"), event(1, 1, 4, "delta"),
           event(2, 0, 0, "open", "user"), event(2, 0, 1, "delta", text="a"), event(2, 0, 2, "edit", text="b"), event(2, 0, 3, "delta", text="c"), event(2, 0, 4, "seen"),
           event(None, None, 0, "delta", text="loose"), event(3, 0, 0, "open")]
    got = sorted((tuple(r) for r in chat.fold(spark.createDataFrame(log, EVENTS).withColumn("extra", F.lit(1))).collect()), key=str)
    assert got == sorted([(1, 0, 1, "user", "hello"), (1, 1, 1, "assistant", "final"), (2, 0, 1, "user", "bc"), (None, None, 1, "", "loose"), (3, 0, 1, "", "")], key=str)
    assert chat.fold(spark.createDataFrame([], EVENTS)).isEmpty()


def test_a_long_message_is_read_back_in_little_memory():
    for unit in ("word <b> and \\ ", "\\<", "### </turn>\\"):
        text = unit * (4_000_000 // len(unit))
        rendered = f"### assistant: {re.sub(r'(\\|### |</turn>)', lambda m: chr(92) + m[1], unit) * (4_000_000 // len(unit))}</turn>\n"
        tracemalloc.start()
        assert chat.read_back(rendered) == [("assistant", text)]
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
        tracemalloc.stop()
    with pytest.raises(ValueError):
        chat.read_back("### user: no end")


def test_odd_rows_through_the_query(spark, tmp_path):
    rows = [(1, 0, None, "a"), (1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "assistant", "c" * 300_000), (None, 0, "assistant", "d"), (2, 5, "assistant", "")]
    spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, branch int, segment string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.QUERIES["op8_chat_format"](spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    turns = lambda own: sha("".join(f"{a}\n{b}\n" for a, b in own))
    order = [("assistant", "c" * 300_000), ("", "a"), ("user", ""), ("user", "b"), ("user", "b")]
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (5, turns(order), 300_000, sha("c" * 300_000))
    assert (got[None].n_turns, got[None].turns_sha256, got[None].loss_sha256) == (1, turns([("assistant", "d")]), sha("d"))
    assert (got[2].n_turns, got[2].loss_chars, got[2].formatted_chars) == (1, 0, len("### assistant: </turn>\n"))
    assert set(got) == {1, 2, None, -7}


def test_rendered_turns_read_back(spark):
    texts = ["", "plain", "\\### Assistant: </turn> ok", "### user: </turn>\n### ", "\\\\", "a\\", "</turn", "x\n\n### y: z</turn>\n", "日本😀" * 3000]
    roles = ["user", "assistant", "a: b", "### ", "\\"]
    rows = [(k, i, 1, roles[(i + k) % 5], t) for k in range(5) for i, t in enumerate(texts)]
    rendered = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, branch long, role string, text string")).cache()
    for r in chat.transcripts(rendered).collect():
        assert chat.read_back(r.transcript) == [(roles[(i + r.conv_id) % 5], t) for i, t in enumerate(texts)]
    for r in chat.digests(rendered).collect():
        own = [(roles[(i + r.conv_id) % 5], t) for i, t in enumerate(texts)]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(rendered.limit(0)).isEmpty()


# urls

def test_url_parts_and_rules(spark):
    given_ = ["http://WWW.Example.org/en/12?x=/es/#t", "https://example.org/es/1", "x.org", None, "", "a://b://c", "http://example.com#f/", "http://badexample.org/es/1", "ftp://m.example.com/fr/9", "http://example.org"]
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow")]
    model = urls.train(urls.small_table())
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given_)] + [(0, given_[0], "clash")], "page_id long, url string, host string")
    rows = urls.judge(pages, rules, model).collect()
    assert len(rows) == len(given_) + 1
    got = {r.page_id: r for r in rows}
    for i, u in enumerate(given_):
        assert (got[i].host, got[i].path) == urls.split_url(u)
    assert [got[i].rule for i in range(10)] == ["example.org/en/1", "example.org/es/", None, None, None, None, None, "org/", "com/fr/", None]
    assert (got[0].verdict, got[1].verdict, got[7].verdict) == ("block", "block", "allow")
    assert all(r.verdict in ("allow", "block") for r in rows)
    assert urls.judge(pages.limit(0), rules, model).isEmpty()


def plain_chance(url, model, own=urls.UrlSettings()):
    """The logistic regression in plain Python: grams of characters of host and of path, each at unit length."""
    total = model.bias
    for space, text in zip((1, 2), urls.split_url(url)):
        marked, grams = f"^{text}$", []
        for size in own.sizes:
            for i in range(len(marked) - size + 1):
                value = (space * 0x9E3779B1 + size * 0x85EBCA6B) % 2**32
                for c in marked[i : i + size]:
                    value = (value ^ ord(c)) * 0x01000193 % 2**32
                    value ^= value >> 15
                grams.append(value % own.buckets)
        total += sum(model.weight[g] for g in grams) / math.sqrt(len(grams)) if grams else 0
    return 1 / (1 + math.exp(-total))


def test_url_model_tells_hosts_apart():
    model = urls.train(urls.small_table())
    assert model.recall > 0.6 and 0 < model.threshold < 0.5
    assert min(plain_chance(u, model) for u in ("http://best-casino.example.org/en/3", "http://www.cheap-pills.example.com/de/9")) > model.threshold
    assert max(plain_chance(u, model) for u in ("http://weather-station.example.org/en/3", "http://blog.shonthe.example.com/de/9", "")) < model.threshold
    assert urls.train([]).bias < 0 and urls.train([("http://a.b/", 0)]).bias < 0


def test_url_query_matches_brute_force(spark, tmp_path):
    given_ = ["http://WWW.Example.org/en/12?x=/es/#t", "https://m.casino-win.example.com/en/" + "x" * 50_000, None, "", "http://日本.example.net/straße", "no url", "https://therer.example.net/",
              "https://example.com/fr/", "http://x.example.com/de/1"]
    spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given_)] + [(None, given_[1], "clash")], "page_id long, url string, verdict string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()}
    assert set(got) == {None, *range(len(given_))}
    model = urls.train(urls.small_table())
    for i, u in enumerate(given_):
        host, path = urls.split_url(u)
        fits = [(len(r), r, v) for r, v in queries.URL_RULES
                if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if plain_chance(u, model) >= model.threshold else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
        assert got[i].block_score == pytest.approx(plain_chance(u, model), abs=1e-6)
    assert got[None].verdict == got[1].verdict
