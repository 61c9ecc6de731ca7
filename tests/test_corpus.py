import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tandem.functions import arrays as a
from tandem.operators import corpus as d
from tandem.operators import subword as s
from tandem.operators import tokens as k
from tandem.session import checkpoint_root
from workload.corpus import bpe_merges


def numbered(spark, counts):
    return spark.createDataFrame([(p, i) for p, n in counts.items() for i in range(1, n + 1)], "pair string, line_no long")


def test_chunks_recycle_into_every_shard(spark):
    chunked = d.assign_chunk(numbered(spark, {"x": 23, "y": 5, "z": 400}), n_shards=5, min_lines=9)
    got = d.fill_shards(chunked, 5).collect()
    rows = Counter((r["pair"], r["shard"]) for r in got)
    assert {p for p, _ in rows} == {"x", "y", "z"} and len(rows) == 15
    assert [rows["x", i] for i in range(5)] == [10, 10, 3, 10, 10]
    assert [rows["y", i] for i in range(5)] == [5] * 5
    # 400 // 5 = 80 lines and one more in each chunk but the last
    assert [rows["z", i] for i in range(5)] == [81, 81, 81, 81, 76]
    assert {(r["pair"], r["line_no"]) for r in got} == {(p, i) for p, n in (("x", 23), ("y", 5), ("z", 400)) for i in range(1, n + 1)}


def test_exact_sample_is_the_smallest_hashes(spark):
    rows = [("p", i) for i in range(3000)]
    key = lambda r: hashlib.md5("\x01".join(["9", r[0], str(r[1])]).encode()).hexdigest()
    df = spark.createDataFrame(rows, "pair string, line_no long")
    for n in (1, 700, 2999, 5000):
        got = {(r["pair"], r["line_no"]) for r in d.sample_exact(df, n, seed=9).collect()}
        assert got == set(sorted(rows, key=key)[:n])


def test_sample_keeps_whole_rows_and_reads_its_input_twice(spark):
    df = spark.createDataFrame([("p", i, "x" * (i % 7), None) for i in range(200)], "pair string, line_no long, text string, extra string")
    got = d.sample_exact(df, 40)
    assert got.columns == df.columns and got.count() == 40 and got.exceptAll(df).count() == 0
    assert d.sample_exact(df, 0).count() == 0 and d.sample_exact(df.limit(0), 3).count() == 0
    # no join and no union: the second read is a filter
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_chunks_cut_in_random_order_have_the_same_sizes(spark):
    rows = numbered(spark, {"x": 23, "z": 400})
    sizes = lambda seed: sorted(map(tuple, d.assign_chunk(rows, 5, 9, seed).groupBy("pair", "chunk", "n_chunks").count().collect()))
    assert sizes(None) == sizes(7) and d.assign_chunk(rows.limit(0), 5, 9).count() == 0


def test_temperature(spark):
    df = numbered(spark, {"big": 900, "small": 100})
    w1 = {r["pair"]: r["weight"] for r in d.temperature_weights(df, 1).collect()}
    w5 = {r["pair"]: r["weight"] for r in d.temperature_weights(df, 5).collect()}
    assert w1 == pytest.approx({"big": 0.9, "small": 0.1}) and w5 == pytest.approx({"big": 0.608, "small": 0.392}, abs=1e-3)
    drawn = Counter(r["pair"] for r in d.temperature_sample(df, d.temperature_weights(df, 5), 1000).collect())
    assert drawn == {"small": 392, "big": 608}


@pytest.mark.parametrize("budget", [0, 1, 7, 50, 333, 1000, 5003])
def test_the_budget_is_drawn_exactly(spark, budget):
    sizes = {"big": 700, "mid": 31, "one": 1, "two": 2}
    df = numbered(spark, sizes)
    weights = d.temperature_weights(df, 3)
    shares = {r["pair"]: r["share"] for r in d.exact_shares(weights, budget).collect()}
    assert sum(shares.values()) == budget and all(abs(shares[r["pair"]] - r["weight"] * budget) < 1 for r in weights.collect())
    rows = sorted((r["pair"], r["line_no"], r["copy"]) for r in d.temperature_sample(df, weights, budget, seed=9).collect())
    wanted = []
    for pair, n in sizes.items():
        order = sorted(range(1, n + 1), key=lambda i: (hashlib.md5(f"9\x01{pair}\x01{i}".encode()).hexdigest(), i))
        for place, i in enumerate(order):
            wanted += [(pair, i, k) for k in range(1, shares[pair] // n + (place < shares[pair] % n) + 1)]
    assert rows == sorted(wanted)
    assert d.temperature_sample(df.limit(0), weights, budget).count() == 0


def test_batches_stay_in_budget(spark):
    random.seed(1)
    rows = [("hot" if i % 3 else "cold", i, [5] * random.randint(1, 90), [5] * random.randint(1, 90)) for i in range(600)]
    df = spark.createDataFrame(rows, "pair string, line_no long, src_ids array<int>, tgt_ids array<int>")
    groups = {}
    for r in d.token_batches(df, 400, 6).collect():
        groups.setdefault((r["pair"], r["bucket"], r["batch"]), []).append(max(len(r["src_ids"]), len(r["tgt_ids"])))
    assert sum(map(len, groups.values())) == 600
    for (_, bucket, _), sizes in groups.items():
        assert max(sizes) <= bucket and len(sizes) <= 6 and len(sizes) * bucket <= 400


def test_registers_padding_and_segments(spark):
    rows = [("p", 8, 0, [9, 4, 5], [2, 7]), ("p", 8, 0, [9, 4, 5, 6, 7], [2])]
    df = spark.createDataFrame(rows, "pair string, bucket int, batch long, src_ids array<int>, prev_ids array<int>")
    assert [r[0] for r in df.select(a.append_registers(F.col("src_ids"), 1)).collect()][0] == [9, 4, 5, 9, 9, 9]
    assert [r[0] for r in df.select(a.append_registers(F.col("src_ids"), 2)).collect()][0] == [9, 4, 5, 9, 9]
    out = k.concat_source_target(k.set_decoder_start(k.left_pad_batch(k.append_registers(df, 1)))).collect()
    short, long = sorted(out, key=lambda r: len(r["src_ids"]))
    assert short["src_padded"] == [1, 1, 1, 1, 9, 4, 5, 9, 9, 9] and long["src_padded"] == [9, 4, 5, 6, 7, 9, 9, 9, 9, 9]
    assert short["tokens"] == short["src_padded"] + [9, 7]
    assert short["segment"] == [0] * 4 + [1] * 3 + [2] * 3 + [3] * 2
    assert short["loss_mask"] == [False] * 10 + [True] * 2


def words(spark, counts):
    return spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, cnt long")


def brute_merges(counts, n):
    state, out = {tuple(w): c for w, c in counts.items()}, []
    for _ in range(n):
        pairs = Counter()
        for w, c in state.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs.items(), key=lambda x: (-x[1], x[0]))[0]
        out.append(best)
        ranks, new = {best: 0}, Counter()
        for w, c in state.items():
            merged, i = [], 0
            while i < len(w):
                step = 2 if w[i:i + 2] in ranks else 1
                merged.append("".join(w[i:i + step]))
                i += step
            new[tuple(merged)] += c
        state = new
    return out


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcde"), (3, "abcdefghijklmnop")])
def test_merges_equal_one_at_a_time(spark, seed, letters):
    random.seed(seed)
    counts = {"▁" + "".join(random.choices(letters, k=random.randint(1, 7))): random.randint(1, 50) for _ in range(60)}
    alphabet = len(set("".join(counts)))
    got = s.train_subwords(words(spark, counts), 3 + alphabet + 12, top=16)
    assert got == brute_merges(counts, 12)


def test_passes_touch_only_words_with_a_merged_pair(spark, monkeypatch):
    """Many segments of several sizes; all are gone at the end."""
    monkeypatch.setattr(s, "MERGE_SEGMENTS", 2)
    random.seed(4)
    counts = {"▁" + "".join(random.choices("aaabcdefgh", k=random.randint(1, 9))): random.randint(1, 50) for _ in range(300)}
    alphabet = len(set("".join(counts)))
    before = set(os.listdir(checkpoint_root(spark)))
    learned = s.learn_subwords(words(spark, counts), 3 + alphabet + 60, top=8)
    assert learned.merges == brute_merges(counts, 60) and set(os.listdir(checkpoint_root(spark))) == before
    assert sum(n for n, _ in learned.passes) == 60
    done = 0
    for n, looked in learned.passes:
        places = s.numbered(learned.merges[: done + n])
        held = [s.apply_in_order(list(w), places, 0, done) for w in counts]
        changed = sum(s.apply_in_order(x, places, done, done + n) != x for x in held)
        assert changed <= looked <= len(counts)
        done += n
    touched = [looked for _, looked in learned.passes]
    assert sum(touched[-5:]) < sum(touched[:5]) / 2


def test_a_pair_merged_again(spark):
    """Sequential order also holds where a pair returns after another merge has spelled its symbol anew."""
    merges = [("a", "b"), ("ab", "c"), ("abc", "x"), ("b", "c"), ("a", "bc"), ("abc", "x")]
    places = s.numbered(merges)
    state = [list("abcx"), list("zabcx"), list("abbcx"), list("aabcxbc")]
    for low in range(len(merges)):
        state = [s.merge_pair(x, merges[low]) for x in state]
        assert state == [s.apply_in_order(list(w), places, 0, low + 1) for w in ("abcx", "zabcx", "abbcx", "aabcxbc")]
    assert places[("abc", "x")] == [2, 5]


@pytest.mark.parametrize("last", [0, 30, 1 << 22])
def test_merges_equal_however_many_symbols_a_task_may_hold(spark, monkeypatch, last):
    """Up to the end, where all pairs are equally frequent; words of runs, of one symbol, and symbols spelled twice."""
    monkeypatch.setattr(s, "LAST_SYMBOLS", last)
    monkeypatch.setattr(s, "MERGE_SEGMENTS", 2)
    random.seed(6)
    counts = {"▁" + "".join(random.choices("aab", k=random.randint(0, 6))): random.randint(1, 3) for _ in range(12)}
    got = s.train_subwords(words(spark, counts), 3 + len(set("".join(counts))) + 500, top=16)
    assert got == brute_merges(counts, 500) and len(got) > 10


def test_merges_of_the_whole_vocabulary(spark, tmp_path):
    """The query goes on until no pair is left or the vocabulary is full."""
    random.seed(7)
    texts = [" ".join("".join(random.choices("abcdefgh", k=random.randint(1, 8))) for _ in range(40)) for _ in range(4)]
    rows = [(i, x, "en", "web", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(m["left"], m["right"]) for m in bpe_merges(spark, str(tmp_path)).orderBy("rank").collect()]
    assert len(got) > 200 and got == brute_merges(Counter("▁" + w for x in texts for w in x.split()), 10_000)


def test_no_words_no_merges(spark):
    assert s.train_subwords(spark.createDataFrame([], "word string, cnt long"), 100) == []


def test_bpe_round_trip(spark):
    text = ["Hallo Welt", "Hallo  Hallo", "", "größer"]
    df = spark.createDataFrame([(t,) for t in text], "text string")
    merges = s.train_subwords(s.word_counts(df), 40)
    got = s.decode(s.encode_pieces(df, {"text": "p"}, "bpe", merges), "p", "back").collect()
    assert [r["back"] for r in got] == ["Hallo Welt", "Hallo Hallo", "", "größer"]
    joined = spark.createDataFrame([(["▁Hal", "lo", "▁Welt"],)], "p array<string>")
    assert s.decode(joined, "p", "t").first()["t"] == "Hallo Welt"


def test_lookup_keeps_rows_apart(spark):
    rows = [("p", 1, ["a", "b", "zz"]), ("p", 2, []), ("p", 3, ["b", "b"]), ("p", 3, ["a"]), ("p", 4, None)]
    df = spark.createDataFrame(rows, "pair string, line_no long, p array<string>")
    dictionary = s.build_dictionary(s.vocabulary(df, 3 + 2, ("p",)))
    assert {r["token"]: r["token_id"] for r in dictionary.collect()} == {"b": 4, "a": 5}
    got = sorted((r["line_no"], r["ids"]) for r in s.binarize(df, dictionary, {"p": "ids"}).collect())
    assert got == [(1, [5, 4, 3, 2]), (2, [2]), (3, [4, 4, 2]), (3, [5, 2]), (4, [2])]


def one_at_a_time(lengths, max_tokens, max_sents, multiple):
    """Batches as lists of places, filled one sequence after the other in length order."""
    out, batch, lengths = [], [], sorted(lengths)
    i = 0
    while i < len(lengths):
        if batch and ((len(batch) + 1) * lengths[i] > max_tokens or len(batch) == max_sents):
            keep = len(batch) - len(batch) % multiple if len(batch) >= multiple else len(batch)
            out.append(batch[:keep])
            i, batch = batch[0] + keep, []
            continue
        batch.append(i)
        i += 1
    return out + [batch] if batch else out


def test_batch_plan_equals_filling_one_at_a_time():
    random.seed(11)
    for _ in range(1500):
        longest = random.choice([1, 3, 12, 40])
        lengths = [random.randint(0, longest) for _ in range(random.randint(0, 150))]
        args = random.choice([8, 30, 100]), random.choice([1, 3, 8, 20]), random.choice([1, 2, 4, 8])
        found = {}
        for x in d.batch_plan(list(Counter(lengths).items()), *args):
            for place in range(x.low, x.high):
                found[x.length, place] = x.first + (place - x.low) // x.size
        places = []
        for n in sorted(lengths):
            places.append((n, sum(1 for m, _ in places if m == n)))
        wanted = {places[i]: b for b, batch in enumerate(one_at_a_time(lengths, *args)) for i in batch}
        assert found == wanted, (lengths, args)


def test_plan_is_bounded_by_the_number_of_lengths():
    plan = d.batch_plan([(n, 10**12) for n in range(1, 257)], 4096, 64, 8)
    assert len(plan) < 256 * 16


def test_sorted_batches_of_odd_rows(spark):
    rows = [("b", 1, [1] * 5, [1]), ("a", 2, None, None), ("a", 1, [1] * 50, [2]), ("b", 2, [], []), ("a", 3, [1], [1] * 5)]
    df = spark.createDataFrame(rows, "pair string, line_no long, src_ids array<int>, tgt_ids array<int>").withColumn("batch", F.lit("x"))
    got = {(r["pair"], r["line_no"]): (r["length"], r["batch"]) for r in d.sorted_token_batches(df, 10, 8, 2).collect()}
    assert got == {("a", 2): (0, 0), ("b", 2): (0, 0), ("a", 3): (5, 1), ("b", 1): (5, 1), ("a", 1): (50, 2)}
    assert d.sorted_token_batches(df.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        d.sorted_token_batches(df, 0)


def test_words_encoded_together_equal_one_at_a_time():
    """Pairs of a symbol with itself, symbols spelled twice, words without a merge, characters beyond the basic plane."""
    random.seed(11)
    found = ["".join(random.choices("aabbcß😀", k=random.randint(1, 12))) for _ in range(400)]
    pairs = [("a", "a"), ("b", "c"), ("aa", "a"), ("a", "b"), ("ab", "c"), ("a", "bc"), ("aa", "aa"), ("😀", "ß"), ("abc", "😀")]
    for merges in ([], pairs, pairs[::-1]):
        encoder = s._Encoder(merges)
        symbols, sizes = encoder.encode(found)
        pieces = iter([encoder.symbol(x) for x in symbols.tolist()])
        ranks = {pair: i for i, pair in enumerate(merges)}
        assert [[next(pieces) for _ in range(n)] for n in sizes.tolist()] == [s.encode_words(w, ranks) for w in found]


def test_bpe_of_null_and_blank_texts(spark):
    df = spark.createDataFrame([(0, "aab aab b"), (1, None), (2, ""), (3, "   "), (4, " b aab")], "id int, text string")
    got = {r["id"]: r["p"] for r in s.bpe_pieces(df, "text", [("a", "a"), ("aa", "b")], "p").collect()}
    assert got == {0: ["▁", "aab", "▁", "aab", "▁", "b"], 1: None, 2: [], 3: [], 4: ["▁", "b", "▁", "aab"]}


def test_a_pass_hands_on_pairs_not_words(spark):
    """What a pass appends has a row per pair and task, however many distinct words hold the pair."""
    counts = {f"▁ab{a}{b}{c}": 1 for a in "cdefghij" for b in "cdefghij" for c in "cdefghij"}
    df, alphabet = words(spark, counts), sorted(set("".join(counts)))
    packed = s._pack(df.coalesce(1), alphabet)
    spelled = ["", *alphabet, "ab"]
    changes = s._pair_changes(packed, [[(spelled.index("a"), spelled.index("b"), len(spelled) - 1)]], spelled).collect()
    assert sum(r["looked"] for r in changes) == len(counts) == 512
    assert len(changes) == 1 + 1 + 1 + 2 * 8 and {(r["left"], r["right"]): r["delta"] for r in changes}[("a", "b")] == -512
