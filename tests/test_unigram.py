"""The unigram model against every segmentation of small words."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tandem.operators import subword as s
from tandem.operators import unigram as u
from tests.conftest import SF


def segmentations(word, model):
    if not word:
        yield [], 0.0
    for end in range(1, len(word) + 1):
        piece = word[:end]
        score = model.scores.get(piece, model.unknown if end == 1 else None)
        if score is not None:
            for rest, more in segmentations(word[end:], model):
                yield [piece, *rest], score + more


def random_model(rng, letters="abc"):
    pieces = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(12)} | set(letters[:-1])
    weights = {p: rng.random() + 0.01 for p in pieces}
    return u.UnigramModel({p: math.log(w / sum(weights.values())) for p, w in weights.items()})


def test_sums_and_best_over_all_segmentations():
    rng = random.Random(1)
    for _ in range(300):
        model, word = random_model(rng), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        ways = list(segmentations(word, model))
        total = math.fsum(math.exp(x) for _, x in ways)
        wanted, got = defaultdict(float), defaultdict(float)
        for pieces, x in ways:
            for p in pieces:
                wanted[p] += 3 * math.exp(x) / total
        assert model.expect(word, 3, got) == pytest.approx(math.log(total))
        assert {p: n for p, n in got.items() if n > 1e-12} == pytest.approx({p: n for p, n in wanted.items() if n > 1e-12})
        best = model.segment(word)
        assert "".join(best) == word and model.score(best) == pytest.approx(max(x for _, x in ways))


def test_ties_and_long_words():
    even = u.UnigramModel({p: -1.0 for p in ("a", "aa", "aaa")})
    assert even.segment("aaaa") == ["a", "aaa"] and even.segment("") == []
    sums = defaultdict(float)
    assert math.isfinite(even.expect("a" * 20_000, 1, sums)) and sum(len(p) * n for p, n in sums.items()) == pytest.approx(20_000)


def _words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, cnt long").repartition(3)


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(2)
    stems = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 5))) for _ in range(30)]
    return {"▁" + "".join(rng.choices(stems, k=rng.randint(1, 3))): rng.randint(1, 40) for _ in range(400)} | {"▁漢é": 1}


def test_likelihood_never_falls(spark, counts):
    model = u.train_unigram(_words(spark, counts), 80, seed_size=500, steps=4)
    assert len(model.scores) == 77 and len(model.likelihoods) > 3
    for run in model.likelihoods:
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(run, run[1:]))
    assert set("".join(counts)) <= set(model.scores)
    assert math.fsum(math.exp(x) for x in model.scores.values()) == pytest.approx(1)
    assert model.unknown not in [model.score([p]) for w in counts for p in model.segment(w)]
    # learnt pieces beat characters alone
    assert sum(len(model.segment(w)) for w in counts) < 0.6 * sum(map(len, counts))


def test_seed_and_pruning(spark):
    counts = {"▁abab": 3, "▁ab": 2, "▁x": 1}
    words = _words(spark, counts)
    seen = defaultdict(int)
    for w, n in counts.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 3) + 1):
                seen[w[i:j]] += n
    longer = sorted((-n * len(p), p) for p, n in seen.items() if len(p) > 1 and n > 1)[:4]
    assert u.seed_pieces(words, 4, 3) == {p: n for p, n in seen.items() if len(p) == 1 or (-n * len(p), p) in longer}
    model = u.estimated({p: float(n) for p, n in seen.items()}, lambda p: True)
    used = defaultdict(float)
    for w, n in counts.items():
        for p in model.segment(w):
            used[p] += n
    loss = {}
    for p in model.scores:
        if len(p) > 1:
            rest = u.UnigramModel({q: x for q, x in model.scores.items() if q != p})
            loss[p] = used[p] * (model.scores[p] - max(x for _, x in segmentations(p, rest)))
    chars = {p for p in model.scores if len(p) == 1}
    kept = u.prune(words, model, len(chars) + 2)
    wanted = sorted(loss, key=lambda p: (-float(f"{loss[p]:.9g}"), p))[:2]
    assert set(kept.scores) == chars | set(wanted)
    assert set(u.prune(words, model, 0).scores) == chars


def test_encoding(spark, counts):
    model = u.train_unigram(_words(spark, counts), 60, seed_size=300)
    texts = [None, "", "  ", "abc  dej", "unseen Zeichen", "x" * 5_000, *(w[1:] for w in list(counts)[:50])]
    df = spark.createDataFrame([(i, t, "taken") for i, t in enumerate(texts)], "i int, text string, word string")
    got = s.decode(s.encode_pieces(df, {"text": "p"}, "unigram", model), "p", "back").orderBy("i").collect()
    assert [r["back"] for r in got] == [" ".join((t or "").split()) for t in texts]
    assert got[0]["p"] == [] and all(r["p"] == model.segment("▁" + t) for r, t in zip(got[6:], texts[6:]))


def test_nothing_and_repeats(spark):
    none = spark.createDataFrame([], "word string, cnt long")
    assert u.train_unigram(none, 50).scores == {} and u.unigram_vocabulary(spark, u.train_unigram(none, 50)).count() == 3
    rows = [("▁ab", 2), ("▁ab", 3), (None, 5), ("", 1)]
    twice = u.train_unigram(spark.createDataFrame(rows, "word string, cnt long"), 50)
    once = u.train_unigram(spark.createDataFrame([("▁ab", 5)], "word string, cnt long"), 50)
    assert twice.scores == pytest.approx(once.scores)


def test_unigram_queries(spark):
    vocabulary = entry.queries()["unigram_vocab"](spark, SF).orderBy("rank").collect()
    assert [r["rank"] for r in vocabulary] == list(range(1, 1001))
    rows = entry.queries()["encode_unigram"](spark, SF).collect()
    lines = spark.read.parquet(f"{SF}/documents.parquet").select(F.size(F.split("text", "\n")).alias("n")).agg(F.sum("n")).first()[0]
    assert all(r["same"] for r in rows) and sum(r["lines"] for r in rows) == lines


def test_words_of_one_length_together():
    rng = random.Random(5)
    for k in range(40):
        pieces = {"".join(rng.choice("abcé漢") for _ in range(rng.randrange(1, 6))) for _ in range(30)} | set("abc")
        weights = {p: 1 if k % 3 == 0 else rng.random() + 0.01 for p in pieces}
        model = u.UnigramModel({p: math.log(w / sum(weights.values())) for p, w in weights.items()})
        listed = ["".join(rng.choice("abcé漢x") for _ in range(rng.randrange(0, 9))) for _ in range(100)]
        counts, lattices = np.array([rng.randrange(1, 9) for _ in listed], float), u.Lattices(model)
        for many, one in ((lattices.expect, model.expect), (lattices.count_best, lambda *a: u._count_best(model, *a))):
            got, total, wanted, whole = np.zeros(len(pieces)), 0.0, defaultdict(float), 0.0
            for same, cnt in lattices.groups(listed, counts):
                total += many(same, cnt, got)
            for word, cnt in zip(listed, counts):
                whole += cnt * one(word, cnt, wanted) if word else 0.0
            assert total == pytest.approx(whole)
            assert dict(zip(lattices.pieces, got)) == pytest.approx({p: wanted.get(p, 0.0) for p in model.scores}, abs=1e-9)


@pytest.mark.parametrize("seed_size,piece_chars", [(0, 4), (7, 1), (25, 3), (300, 16), (100_000, 16)])
def test_seeds_against_all_substrings(spark, counts, seed_size, piece_chars):
    met = Counter()
    for word, cnt in counts.items():
        for start in range(len(word)):
            for end in range(start + 1, min(len(word), start + piece_chars) + 1):
                met[word[start:end]] += cnt
    longer = sorted((-n * len(p), p) for p, n in met.items() if len(p) > 1 and n > 1)[:seed_size]
    wanted = {p: n for p, n in met.items() if len(p) == 1} | {p: met[p] for _, p in longer}
    assert u.seed_pieces(_words(spark, counts), seed_size, piece_chars) == wanted


def test_steps_are_taken_by_arrays(spark, counts, monkeypatch):
    monkeypatch.setattr(u.UnigramModel, "expect", None)
    many = {f"{a}{b}{c}": 1 for a in "abcd" for b in "abcd" for c in "abcd"}
    model = u.UnigramModel({c: math.log(0.25) for c in "abcd"})
    _, seen = u.em_steps(spark.createDataFrame(list(many.items()), "word string, cnt long").coalesce(1), model, 1)
    assert seen == [pytest.approx(64 * 3 * math.log(0.25))]


def test_unlikely_words_lose_nothing():
    model = u.UnigramModel({"a": -300.0, "aa": -500.0, "b": 0.0})
    words, into, single = ["aaaa", "abab", "bbbb", "xbxb"], np.zeros(3), defaultdict(float)
    lattices = u.Lattices(model)
    total = lattices.expect(words, np.ones(4), into)
    assert total == pytest.approx(sum(model.expect(w, 1, single) for w in words))
    assert dict(zip(lattices.pieces, into)) == pytest.approx({p: single.get(p, 0.0) for p in model.scores})
