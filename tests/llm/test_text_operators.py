"""Repetition, pieces, suffix-array dedup and near-duplicates against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from aligngrid.llm import minhash, pieces, repetition, suffix_dedup
from tests.llm.helpers import documents, near_classes, words


def brute_repetition(text, min_repeat):
    w = words(text)
    n = len(w)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(n - 4))
    again = {j for i in range(n - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    spans = {j for i, k in enumerate(longest) if k >= min_repeat for j in range(i, i + k)}
    return n, len(again), len(spans), max([k for k in longest if k >= min_repeat], default=0)


def test_repetition_like_brute_force():
    rows = [t for _, t in documents(1, 40)] + ["a b a b a b a b a b a b a b a b", "one " * 30]
    got = repetition.measure([(t or "").encode() for t in rows], 8, 0.2, 60)
    got = dict(zip(repetition.RULE_COLUMNS, got))
    for i, t in enumerate(rows):
        want = brute_repetition(t, 8)
        assert want == tuple(int(got[c][i]) for c in ("n_words", "n_repeat_words", "covered_words", "longest_repeat")), t
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert got["word_chars"][i] == sum(map(len, words(t)))
        failed = want[0] < 10 or 100 * want[1] > 20 * want[0]
        assert got["base_failed"][i] == failed
        assert got["kept"][i] == (not failed and want[2] <= 0.2 * want[0] and want[3] <= 60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=6))
def test_suffix_array_over_words(texts):
    counts = np.array([len(t) for t in texts])
    codes = np.array([c for t in texts for c in t], np.int64)
    got, _ = repetition.longest_repeats(codes, counts)
    at = 0
    for t in texts:
        for i in range(len(t)):
            want = max((next(k for k in range(len(t) + 1) if i + k >= len(t) or j + k >= len(t) or t[i + k] != t[j + k])
                        for j in range(len(t)) if j != i), default=0)
            assert got[at + i] == want
        at += len(t)


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def same_pieces(model, texts):
    own, other = model
    ids, counts = pieces.encode(own, [t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at:at + n].tolist() == other.encode(t), t
        at += n
    assert pieces.decode(own, ids, counts) == [t.replace(pieces.MARK, " ") for t in texts]


def test_pieces_equal_repeated_merging(model):
    r = random.Random(2)
    same_pieces(model, ["", " ", "  a   b ", "日本語 😀 test", "x" * 700, "\x00\n\t tab", "=== ▁▁x", "  int main()", "a" * 33])
    same_pieces(model, ["".join(r.choice("abcdeht  ion\n-=.é日😀▁") for _ in range(r.randint(0, 120))) for _ in range(800)])
    same_pieces(model, [t or "" for _, t in documents(3)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_pieces_of_any_text(model, texts):
    same_pieces(model, [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)])


def test_pieces_start_anew_when_many_chunks_are_known(model, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 50)
    monkeypatch.setattr(pieces, "INDEXED", 100)
    for seed in range(4):
        same_pieces(model, [t or "" for _, t in documents(seed, 10)])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([258, 5000]))
def test_induced_sorting(symbols, sigma):
    t = np.array([*symbols, 0], np.int64)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert suffix_dedup.suffix_array(t, sigma).tolist() == want


def brute_dedup(rows):
    """What stays of (order, bytes) texts; rows of one order are one document."""
    first = {}
    for order, t in rows:
        for p in range(len(t) - 99):
            first.setdefault(t[p:p + 100], (order, p))
    out = []
    for order, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 99):
            if first[t[p:p + 100]] != (order, p):
                gone[p] += 1
                gone[p + 100] -= 1
        gone = np.cumsum(gone)[:len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def long_texts(seed):
    r = random.Random(seed)
    shared = ["".join(r.choice("abcdé ") for _ in range(r.randint(90, 400))) for _ in range(5)]
    make = [lambda: r.choice(shared), lambda: "".join(r.choice("abcdefghij \n") for _ in range(r.randint(0, 300))),
            lambda: "a" * r.randint(0, 250), lambda: "\x00" * r.randint(0, 150), lambda: "ab" * r.randint(0, 90)]
    return [(i * 3, "".join(r.choice(make)() for _ in range(r.randint(0, 5)))) for i in range(50)]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_like_brute_force(spark, hot):
    rows = long_texts(4)
    rows += [(1, rows[5][1]), (2, ""), (400, None), rows[7]]  # a copy, empty texts, a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
                 for r in suffix_dedup.without_repeats(df, hot=hot).collect())
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    assert got == [(i, *x) for (i, _), x in zip(rows, brute_dedup(rows))]
    assert sum(x[2] for x in got) > 1000


def test_suffix_dedup_orders_texts_of_one_id_and_null_ids_first(spark):
    rows = [(None, "n" * 50 + "0123456789" * 12), (8, "y" * 40 + "0123456789" * 12), (8, "0123456789" * 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.without_repeats(df).collect()}
    assert got[(8, 160)] == 120 and got[(8, 110)] == 110
    assert got[(None, 170)] == 110  # within itself: every window after the first period also starts earlier


def test_near_duplicates_like_brute_force(spark):
    rows = documents(6, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == near_classes(rows)
    assert len(set(got.values())) < len(rows) - 10


def test_parts_of_a_bucket_all_meet(spark):
    r = random.Random(3)
    page = [f"w{i}" for i in range(300)]

    def changed(text, n, name):
        out = list(text)
        for k in r.sample(range(0, 300, 5), n):
            out[k] = f"{name}-{k}"
        return out

    rows = []
    for i in range(40):  # most pages of one template lie below the threshold to each other; each has a partner just above it
        own = changed(page, 5, f"own{i}")
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(changed(own, 6, f"other{i}")))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = near_classes(rows)
    assert len(set(want.values())) > 20
    for members in (1, 4):
        got = {x.doc_id: x.class_id for x in minhash.near_duplicates(df, members=members).collect()}
        assert got == want, members


def test_signatures_estimate_weighted_likeness():
    r = np.random.default_rng(1)
    off = []
    for _ in range(30):
        x = r.integers(0, 2**63, 200, dtype=np.uint64)
        a = r.gamma(0.5, 2, 200)
        b = a * r.uniform(0.4, 1.6, 200)
        s = minhash.dart_signatures(np.r_[x, x], np.r_[a, b], np.repeat([0, 1], 200), 2, 256)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05
    one = minhash.dart_signatures(np.array([7], np.uint64), None, np.array([0]), 2, 256)
    assert np.isfinite(one[0]).all() and np.isinf(one[1]).all()


def test_weight_counts_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d e " * 20), (2, "a b c d e " * 4)], "doc_id long, text string")
    by = {w: {r.id: r.signature for r in minhash.signatures(df, "doc_id", "text", weights=w).collect()} for w in ("set", "count")}
    share = lambda s: (np.frombuffer(s[1], "u1") == np.frombuffer(s[2], "u1")).mean()
    assert share(by["set"]) == 1.0 and share(by["count"]) < 0.4


def test_runs_do_not_depend_on_tiles(monkeypatch):
    r = random.Random(7)
    texts = [("".join(r.choice("ab \n") for _ in range(r.randint(0, 400))) + "z" * r.randint(0, 300)).encode() for _ in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    want = [x.tolist() for x in suffix_dedup.runs(data, ends)]
    for tile in (1, 7, 100, 1000):
        monkeypatch.setattr(suffix_dedup, "TILE", tile)
        assert [x.tolist() for x in suffix_dedup.runs(data, ends)] == want
    starts = np.r_[0, ends[:-1]]
    at, n, _ = map(np.array, want)
    covered = sorted(p for a, k in zip(at, n) for p in range(a, a + k))
    assert covered == [p for a, b in zip(starts, ends) for p in range(a, b - 99)]
