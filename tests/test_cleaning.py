import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tandem.fixed_values import STRIP_CHARACTERS
from tandem.functions.text import detokenize, round2, strip, strip_lang_tag
from tandem.operators import cleaning as c
from tandem.operators.numbering import number_rows, range_block
from tandem.plans.clean import CleanConfig, clean_corpus, stage_counts

SCHEMA = "pair string, src_lang string, tgt_lang string, line_no long, src string, tgt string"


def bitext(spark, rows, pair="a-b"):
    src, tgt = pair.split("-")
    return spark.createDataFrame([(pair, src, tgt, i, s, t) for i, (s, t) in enumerate(rows, 1)], SCHEMA)


def kept(df):
    return sorted(r["line_no"] for r in df.collect())


def test_strip_removes_what_python_removes(spark):
    text = STRIP_CHARACTERS + "x y" + STRIP_CHARACTERS
    assert spark.createDataFrame([(text,)], "t string").select(strip(F.col("t"))).first()[0] == text.strip() == "x y"


def test_punctuation_is_strict_and_drops_empty_sides(spark):
    rows = [("", "a"), ("a.", "b"), ("ab.", "b"), ("abc", "—–b"), ("abc", "xy–")]
    assert kept(c.filter_overpunct(bitext(spark, rows))) == [3, 5]


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    once = c.dedup_pairs(bitext(spark, [("x", "y"), ("x", "z"), ("x", "y"), ("x", "y")]))
    assert kept(once) == kept(c.dedup_pairs(once)) == [1, 2]


def test_dedup_of_one_hot_line(spark):
    rows = [("same", "same")] * 3000 + [(f"s{i}", "t") for i in range(3000)]
    assert kept(c.dedup_pairs(bitext(spark, rows))) == [1, *range(3001, 6001)]


def test_shuffle_is_a_reproducible_permutation(spark):
    df = bitext(spark, [("s", "t")] * 50 + [(str(i), "t") for i in range(50)])
    first, again, other = (
        {r["line_no"]: r["position"] for r in c.shuffle_positions(df, seed).collect()} for seed in (1, 1, 2))
    assert first == again != other and sorted(first.values()) == list(range(100))
    assert [r["line_no"] for r in c.shuffle(df, 1).collect()] == sorted(first, key=first.get)


def test_histogram_keeps_the_covering_characters(spark):
    texts = spark.createDataFrame([("a", "x" * 90 + "y" * 9 + "z")], "lang string, text string")
    got = {r["ch"]: r["keep"] for r in c.build_char_histogram(texts, 0.95).collect()}
    assert got == {"x": True, "y": True, "z": False}
    assert all(r["keep"] for r in c.char_coverage(texts, 1.0).collect())


def test_histogram_filter_is_monotone(spark):
    df = bitext(spark, [("xxxz", "xx"), ("zzzz", "xx"), ("xxxx", "xz"), ("", "x")])
    hist = spark.createDataFrame([("a", "x", True), ("b", "x", True), ("a", "z", False)], "lang string, ch string, keep boolean")
    results = [set(kept(c.filter_by_histogram(df, hist, th))) for th in (0.1, 0.5, 0.75, 1.0)]
    assert results == [{1, 3}, {1, 3}, {1}, set()]


def test_length_ratio_and_positions(spark):
    df = spark.createDataFrame([(1, [1] * n, [1] * m) for n, m in [(1, 3), (1, 4), (0, 1), (250, 250), (251, 250)]],
                               "line_no long, src_pieces array<int>, tgt_pieces array<int>")
    sizes = lambda d: sorted((len(r[1]), len(r[2])) for r in d.collect())
    assert sizes(c.filter_length(df)) == [(1, 3), (1, 4), (250, 250)]
    assert sizes(c.filter_ratio(df)) == [(1, 3), (250, 250), (251, 250)]
    assert sizes(c.filter_positions(df, 250, ("src_pieces",)))[-1] == (250, 250)


def test_chain_counts_every_stage(spark):
    rows = [(" hello ", "welt"), ("hello", "welt"), ("....", "welt"), ("qqqq", "welt")] + [(f"hello{'l' * i}", "welt") for i in range(1, 40)]
    cfg = CleanConfig(coverage=0.97, threshold=0.9)
    counts = stage_counts(bitext(spark, rows), cfg).first()
    assert (counts["n_read"], counts["n_punct"], counts["n_dedup"]) == (43, 42, 41)
    assert counts["n_clean"] == clean_corpus(bitext(spark, rows), cfg).count() == 40


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_numbering_equals_a_plain_count(spark, block):
    random.seed(3)
    rows = [("hot", n) for n in random.sample(range(5000), 800)] + [(g, n) for g in "ab" for n in random.sample(range(500), 60)]
    got = number_rows(spark.createDataFrame(rows, "g string, n long"), ["g"], ["n"], range_block(F.col("n"), block)).collect()
    for g in ("hot", "a", "b"):
        want = {n: i for i, n in enumerate(sorted(n for x, n in rows if x == g))}
        assert {r["n"]: r["row_idx"] for r in got if r["g"] == g} == want


def test_round2_is_python_rounding(spark):
    random.seed(5)
    values = [2.675, 0.125, 0.375, 1.005, 0.285, 0.0, -0.125, -2.675, 1e6 + 0.005, 100.0, 99.995]
    values += [random.randrange(100000) / 1000 for _ in range(3000)] + [random.uniform(-100, 100) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", round2(F.col("v")).alias("r")).collect()
    assert [(r["v"], r["r"]) for r in got if r["r"] != round(r["v"], 2)] == []


def test_first_language_tag_only(spark):
    rows = spark.createDataFrame([("a __de__ b __fr__ c",), ("__de__ b",), ("plain",)], "t string")
    assert [r[0] for r in rows.select(strip_lang_tag(F.col("t"))).collect()] == ["a b __fr__ c", "b", "plain"]


def test_detokenize_rules(spark):
    cases = [
        ("Hello , world ! ? ( yes )", "en", "Hello, world!? (yes)"),
        ("it 's a \" test \" .", "en", "it's a \"test\"."),
        ("Qui ? l' homme !", "fr", "Qui ? l'homme !"),
        ("a @-@ b &amp; c &quot;", "de", "a-b & c \""),
        ("你 好 世界 abc", "zh", "你好世界 abc"),
        ("한 국", "ko", "한 국"),
    ]
    df = spark.createDataFrame(cases, "t string, lang string, want string")
    for row in df.select("want", detokenize(F.col("t"), F.col("lang")).alias("got")).collect():
        assert row["got"] == row["want"]


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_char_counts_against_counter(spark, monkeypatch, held):
    monkeypatch.setattr(c, "HELD_COUNTS", held)
    rng = random.Random(held)
    letters = ["a", "b", "é", "漢", "\U0001f600", " ", "\n", "e\u0301", "\x00"]
    rows = [(rng.choice(["x", "y", None]), "".join(rng.choices(letters, k=rng.randrange(30)))) for _ in range(300)] + [("x", None), ("z", ""), ("y", "a" * 200_000)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("ch", F.lit("taken")).repartition(4)
    wanted = Counter((lang, ch) for lang, text in rows for ch in text or "")
    assert {(r["lang"], r["ch"]): r["cnt"] for r in c.char_counts(df).collect()} == wanted
    assert c.char_counts(df.limit(0)).count() == 0
