"""Spelling variants, byte-level BPE and periodic runs against brute force, on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tandem.llm import bpe, queries, runs, spelling
from tandem.llm.packing import public_path
from tests.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Columns named like results and like inner columns."""
    texts = [
        None, "", " \n\t", "one", "a " * 4_000, "wordle worlde wordle " * 40, "Éclaire éclaire eclaire " * 9, "don't   stop\n\n <|endoftext|><|endo ",
        "x" * 300_000, "lorem ipsum dolor " * 30_000, "ab ab ab ab ab ab c", "a b\x0ba\u0085b \U0001f600 漢字 ²", "ÀÿÀÿÀÿ×÷ àààààààà",
    ]
    rows = [(i, t, 1, "n", "x") for i, t in enumerate(texts)] + [(None, "spelling spellinh", 1, "n", "x")] * 9
    rows += [(7, "spelling variant", 1, "n", "x")] * 60 + [(40 + i, "one two three four five six", 1, "n", "x") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, word string, _run string").repartition(3)


def _table(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# Spelling variants -----------------------------------------------------------------------------


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            code = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and code % 199 == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def _variants(counts):
    near = {w: [v for v in counts if _one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= 5 * counts[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def _found(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


def test_spelling_variants(spark, odd):
    assert _found(spelling.spelling_variants(odd)) == _variants(_counted([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert _found(queries.QUERIES["op11_spelling_variants"](spark, SF)) == _variants(_counted(_table(spark, SF)))
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(odd, min_chars=3)


@pytest.mark.parametrize("block", [3, 20_000])
def test_variants_of_random_words(spark, block):
    """Few letters, many repeats of bigrams, chains of forms, ties; small blocks deal every entry out."""
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 11))) for _ in range(600)} | {"a" * 9, "a" * 10, "ab" * 5}
    counts = {w: 5 ** rng.randrange(1, 6) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert _found(spelling.group_variants(frame, block=block)) == _variants(counts)


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(5)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 12)))
        grams = sorted(set(spelling.bigrams(word)))
        rng.shuffle(grams)
        weights = sorted(rng.randrange(1, 9) for _ in grams)
        last, prefix, pivots = spelling.prefix_and_pivots(word, {g: (k, w) for k, (g, w) in enumerate(zip(grams, weights))})
        weight = dict(zip(grams, weights))
        pairs = [weight[a] + weight[b] for a, i in prefix for b, j in prefix if i + 2 <= j]
        assert len(pivots) == 2 and pivots[0][1] + 2 <= pivots[1][1] and sum(weight[g] for g, _ in pivots) == min(pairs)
        assert len(prefix) >= 3 and all(word[i : i + 2] == g for g, i in prefix) and max(grams.index(g) for g, _ in prefix) == last


# BPE ---------------------------------------------------------------------------------------------


def test_codec_against_the_library():
    library, codec = Tokenizer.from_file(public_path()), bpe.Codec(public_path())
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "'", "'s", "'re", "'ll", "\n", "\t", " ", "\x1c", "\x85", "é", "漢", "1", "²", "<|endoftext|>", "<|", "😀", "The", "ing"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        wanted = library.encode(text, add_special_tokens=False).ids
        for block in (rng.randrange(1, 9), 200_000):
            assert np.frombuffer(codec.encode(text, block), "<u4").tolist() == wanted, text
        ids = [rng.randrange(50_257) for _ in range(20)]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    for point in [*range(0x3000), *range(0x1F000, 0x20000)]:
        text = f"a{chr(point)}1 {chr(point)}"
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_stale_entries_are_skipped():
    """A merge that takes a neighbour away leaves its entry in the queue: aaaa.. has one at every place."""
    codec = bpe.Codec(public_path())
    a = codec.byte_ids[ord("a")]
    took = []
    for n in (50_000, 100_000):
        began = time.perf_counter()
        ids = codec.merged([a] * n)
        took.append(time.perf_counter() - began)
        assert codec.decode(codec.packed(ids)) == "a" * n
    assert took[1] < 4 * took[0] + 0.2


def test_bpe_documents(spark, odd):
    library = Tokenizer.from_file(public_path())

    def digests(rows):
        out = []
        for doc_id, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            raw, back = np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()
            out.append((str(doc_id), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
        return sorted(out)

    found = queries.QUERIES["op12_bpe_codec"](spark, SF).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in found) == digests(_table(spark, SF))
    coded = bpe.encode_documents(odd).collect()
    mine = sorted((str(r["doc_id"]), r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in coded)
    assert mine == digests([(r["doc_id"], r["text"]) for r in odd.collect()])
    back = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert Counter(r["decoded"] for r in back) == Counter(r["text"] or "" for r in odd.collect())
    assert bpe.encode_documents(odd.limit(0)).count() == 0


# Runs --------------------------------------------------------------------------------------------


def _runs(words, least=6, times=4):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in found.items())


def test_runs_of_random_words():
    rng = random.Random(0)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(40))]
            while rng.random() < 0.7:
                words += [rng.choice("ab") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 8)
            texts.append([w.encode() for w in words])
        least, times = rng.choice([(6, 4), (2, 2), (4, 3)])
        assert runs.runs_of_texts(texts, least, times, batch_words=rng.choice([1, 50, 1000])) == [_runs(t, least, times) for t in texts]


def test_long_runs_take_time_in_proportion():
    for period in (1, 2, 7):
        words = [b"w%d" % (i % period) for i in range(80_000)]
        began = time.perf_counter()
        assert runs.runs_of_texts([words]) == [[(0, 80_000, period)]]
        assert time.perf_counter() - began < 20


def _digests(doc_id, text, alter):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    code = zlib.crc32(str(doc_id).encode())
    if alter and doc_id is not None and code % 10 == 0 and words:
        g, n = code // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = _runs(words)
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    dropped = {i for s, e, p in found for i in range(s + p, e)}
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (str(doc_id), len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_word_runs(spark, odd):
    def short(doc_id, text):
        return len((text or "").split()) < 2_000

    for frame, rows in (
        (runs.run_digests(runs.word_runs(odd, runs.altered)), [(r["doc_id"], r["text"]) for r in odd.collect()]),
        (queries.QUERIES["op13_periodic_runs"](spark, SF), _table(spark, SF)),
    ):
        got = sorted((str(r["doc_id"]), *r[1:]) for r in frame.collect())
        known = {str(i) for i, t in rows if not short(i, t)}
        assert len(got) == len(rows)
        assert [g for g in got if g[0] not in known] == sorted(_digests(i, t, True) for i, t in rows if str(i) not in known)
    plain = {r["doc_id"]: r for r in runs.word_runs(odd).collect()}
    assert [tuple(x) for x in plain[9]["runs"]] == [(0, 90_000, 3)] and plain[9]["collapsed"] == "lorem ipsum dolor"
    assert plain[4]["collapsed"] == "a" and plain[10]["collapsed"] == "ab c" and plain[0]["collapsed"] == "" and plain[0]["n_words"] == 0
    assert runs.run_digests(runs.word_runs(odd.limit(0))).count() == 0


def test_altered_documents_have_runs():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    changed = [(i, t.encode().split()) for i, t in rows if t and zlib.crc32(str(i).encode()) % 10 == 0]
    assert changed and any(runs.runs_of_texts([runs.altered(w, i)])[0] for i, w in changed)
