import math
import random
import string
from collections import Counter

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import metrics as m
from tandem.operators import records as r
from tandem.operators import report as rep

PAIRS = [("the cat sat on the mat", "the cat is on the mat"), ("a b c d e", "a b c d e"), ("x", "x y"), ("", "z"),
         ("the the the the", "the cat"), ("Hello, world!", "Hello world."), ("(a) b", "(a) c")]


def frame(spark, rows=PAIRS):
    return spark.createDataFrame([("d", h, g) for h, g in rows], "pair string, hyp string, ref string")


def grams(x, n):
    return Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))


def plain_bleu(rows):
    match, total, h_len, r_len = [0] * 4, [0] * 4, 0, 0
    for h, g in ((h.split(), g.split()) for h, g in rows):
        h_len, r_len = h_len + len(h), r_len + len(g)
        for n in range(1, 5):
            match[n - 1] += sum((grams(h, n) & grams(g, n)).values())
            total[n - 1] += max(len(h) - n + 1, 0)
    if 0 in total or not any(match):
        return 0.0
    zeros, logs = 0, 0.0
    for mt, tt in zip(match, total):
        zeros += mt == 0
        logs += math.log(mt / tt if mt else 1 / (2 ** zeros * tt))
    return 100 * min(1.0, math.exp(1 - r_len / h_len)) * math.exp(logs / 4)


def edge_words(text):
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            yield from (w[:-1], w[-1])
        elif len(w) > 1 and w[0] in string.punctuation:
            yield from (w[0], w[1:])
        else:
            yield w


def plain_chrf(rows):
    sums = [[0, 0, 0] for _ in range(8)]
    for h, g in rows:
        for k in range(8):
            a, b = (["".join(t.split()) for t in (h, g)] if k < 6 else [list(edge_words(t)) for t in (h, g)])
            x, y = grams(a, k + 1 if k < 6 else k - 5), grams(b, k + 1 if k < 6 else k - 5)
            for i, v in enumerate((sum((x & y).values()), sum(x.values()) if y else 0, sum(y.values()))):
                sums[k][i] += v
    used = [(mt / h, mt / g) for mt, h, g in sums if h and g]
    p, q = (sum(v[i] for v in used) / len(used) for i in (0, 1))
    return 100 * 5 * p * q / (4 * p + q) if p + q else 0.0


@pytest.mark.parametrize("rows", [PAIRS, PAIRS[:2], PAIRS[4:], [("a b c d q", "q a x c")], [("a b", "a b")]])
def test_bleu_and_chrf_against_plain_python(spark, rows):
    assert m.corpus_bleu(frame(spark, rows), ["pair"]).first()["bleu"] == pytest.approx(plain_bleu(rows))
    assert m.chrf(frame(spark, rows), ["pair"]).first()["chrf"] == pytest.approx(plain_chrf(rows))
    swapped = [(g, h) for h, g in rows]
    assert m.corpus_bleu(frame(spark, rows), ["pair"], swap_roles=True).first()["bleu"] == pytest.approx(plain_bleu(swapped))


def test_identical_text_scores_100(spark):
    rows = [("one two three four five", "one two three four five")]
    assert m.corpus_bleu(frame(spark, rows), ["pair"]).first()["bleu"] == pytest.approx(100)
    assert m.chrf(frame(spark, rows), ["pair"]).first()["chrf"] == pytest.approx(100)
    pieces = frame(spark, rows).withColumns({c: F.split(c, " ") for c in ("hyp", "ref")})
    assert m.corpus_bleu(pieces, ["pair"]).first()["bleu"] == pytest.approx(100)


def test_records_survive_tabs_and_parse_back(spark):
    hyp = "struct<score:double,text:string,detok:string,positional:array<double>,alignment:array<struct<src:int,tgt:int>>,steps:int,history:array<string>>"
    rows = [("a-b", 12, "__b__ s\tx", "t\ty", [(-1.5, "h\tz", "h z", [-0.5, -0.25], [(0, 1)], 3, ["p", "q"])])]
    df = spark.createDataFrame(rows, f"pair string, sample_id long, src string, tgt string, hyps array<{hyp}>")
    lines = [x["line"] for x in r.emit_records(df).orderBy("seq").collect()]
    assert lines == ["S-12\t__b__ s\tx", "T-12\tt\ty", "H-12\t-1.5\th\tz", "D-12\t-1.5\th z", "P-12\t-0.5000 -0.2500",
                     "A-12\t0-1", "I-12\t3", "E-12_0\tp", "E-12_1\tq"]
    log = spark.createDataFrame([("a-b", i, x) for i, x in enumerate([*lines, "Generate test", "H-12\t-9\tsecond"])], "pair string, line_no long, line string")
    row = r.align_hyp_ref(r.parse_records(log)).first()
    assert (row["src"], row["hyp"], row["ref"]) == ("s\tx", "h\tz", "t\ty")


def test_soft_alignment_prints_a_list_of_weights_for_each_target_token(spark):
    hyp = "struct<score:double,text:string,detok:string,positional:array<double>,alignment:array<array<string>>>"
    rows = [("a-b", 1, "s", "t", [(-1.0, "h i", "h i", [-0.5], [["0.75", "0.25"], ["0.10", "0.90"]])]), ("a-b", 2, "s", "t", [(-1.0, "", "", [], [])])]
    df = spark.createDataFrame(rows, f"pair string, sample_id long, src string, tgt string, hyps array<{hyp}>")
    lines = {x["sample_id"]: x["line"] for x in r.emit_records(df).where("kind = 'A'").collect()}
    assert lines == {1: "A-1\t0.75,0.25 0.10,0.90", 2: "A-2\t"}


def test_log_ends_with_one_closing_line_per_direction(spark, monkeypatch):
    monkeypatch.setattr(r, "LOG_SAMPLES", 2)
    records = spark.createDataFrame(
        [(p, s, q, k, f"{k}-{s}") for p in ("a-b", "c-d", "e-f") for s in (9, 0, 4, 70_000) for q, k in enumerate("STH")],
        "pair string, sample_id long, seq int, kind string, line string").orderBy(F.rand(3))
    # "x-y" has a result and no samples, "e-f" samples and no result
    bleu = spark.createDataFrame([("a-b", 10, 8, 6, 10, 3, 9, 1, 8, 1, 7, 21.5), ("c-d", 0, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0.0), ("x-y", 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0.0)],
                                 "pair string, sys_len long, ref_len long, " + ", ".join(f"match{n} long, hyp{n} long" for n in range(1, 5)) + ", bleu double")
    log = r.generation_log(r.close_records(records, r.result_string(bleu), "valid", 4)).orderBy("pair", "line_no").collect()
    of = {p: [x["line"] for x in log if x["pair"] == p] for p in ("a-b", "c-d", "e-f", "x-y")}
    body = [f"{k}-{s}" for s in (0, 4, 9, 70_000) for k in "STH"]
    assert of["a-b"] == [*body, "Generate valid with beam=4: BLEU4 = 21.50, 60.0/33.3/12.5/14.3 (BP=1.000, ratio=1.250, syslen=10, reflen=8)"]
    assert of["c-d"] == [*body, "Generate valid with beam=4: BLEU4 = 0.00, 0.0/0.0/0.0/0.0 (BP=0.000, ratio=0.000, syslen=0, reflen=4)"]
    assert of["e-f"] == body and len(of["x-y"]) == 1
    assert all([x["line_no"] for x in log if x["pair"] == p] == list(range(len(of[p]))) for p in of)
    # what reads logs takes the samples and passes over the closing line
    parsed = r.parse_records(spark.createDataFrame(log)).where("pair = 'a-b'")
    assert parsed.count() == 12 and r.generation_log(r.close_records(records.limit(0), r.result_string(bleu.limit(0)))).count() == 0


def test_samples_meet_in_one_exchange_and_one_sort(spark):
    log = spark.createDataFrame([("a-b", i, f"{k}-{i // 3}\t-1\tx") for i, k in enumerate("STH" * 50)], "pair string, line_no long, line string")
    aligned = r.align_hyp_ref(r.parse_records(log))
    plan = aligned._jdf.queryExecution().sparkPlan().toString(), aligned._jdf.queryExecution().executedPlan().toString()
    assert plan[1].count("Exchange hashpartitioning") == 1 and plan[1].count("Sort [") <= 1
    assert aligned.count() == 50


def test_model_is_loaded_per_task_and_batches_are_bounded(spark):
    def load():
        return 10

    def predict(model, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["id"] * model, "size": len(batch)})

    got = r.apply_model(spark.range(25).repartition(1), load, predict, "id long, size long", 10).collect()
    assert sorted(x["id"] for x in got) == [i * 10 for i in range(25)] and max(x["size"] for x in got) == 10


def test_system_score_and_offtarget(spark):
    df = frame(spark, [("a", "a"), ("a", "b")]).withColumn("src", F.lit("s"))
    got = m.system_score(df, lambda: None, lambda _, b: (b["hyp"] == b["ref"]).astype(float)).first()
    assert (got["segments"], got["score"]) == (2, 50.0)
    rows = spark.createDataFrame([("p", "de", "de"), ("p", "en", "de"), ("p", None, "de")], "pair string, pred_lang string, tgt_lang string")
    assert m.offtarget_ratio(rows).first()["ratio"] == pytest.approx(200 / 3)


def test_language_detection_broadcast_and_join_agree(spark):
    train = [("en", "the house and the tree"), ("de", "das haus und der baum"), ("en", "this is the thing"), ("de", "das ist ein ding")]
    texts = spark.createDataFrame(train, "lang string, text string")
    model = m.train_langid(texts, ["de", "en"])
    rows = [(1, "the tree"), (2, "der baum"), (3, ""), (4, "zzzzqqqq"), (5, "x"), (6, None), (7, "the tree"), (7, "der baum"), (None, "der baum " * 9000)]
    asked = spark.createDataFrame(rows, "id long, text string")
    small, large = (m.detect_language(asked, model, ["de", "en"], ["id"], broadcast_bytes=n) for n in (1 << 27, 0))
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
    small, large = (sorted(map(tuple, found.collect()), key=str) for found in (small, large))
    assert small == large and len(small) == len(rows)
    assert {(1, "en"), (2, "de"), (6, None), (7, "en"), (7, "de"), (None, "de")} <= set(small)


def test_vectors_by_block(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0, 5.0]), ("a", [3.0, 2.0, 1.0, 0.0, 1.0]), ("b", []), ("b", None)], "k string, params array<double>")
    blocks = rep.average_vectors(rep.vector_blocks(df, size=2), ["k", "block"])
    assert {(r["k"], r["block"]): r["params"] for r in blocks.collect()} == {("a", 0): [2.0, 2.0], ("a", 1): [2.0, 2.0], ("a", 2): [3.0]}


@pytest.mark.parametrize("size,held", [(2, 1), (3, 5), (1 << 16, 1 << 22)])
def test_mean_blocks_against_plain_means(spark, size, held):
    rng = np.random.default_rng(size)
    rows = [(k, None if k % 3 else "x", [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=rng.integers(0, 12))]) for k in [0, 1, 2, 3] * 9]
    rows += [(None, "x", [1.0]), (None, "x", [2.0]), (5, "x", None)]
    df = spark.createDataFrame(rows, "k long, l string, params array<double>").repartition(5)
    wanted = {}
    for k, l, v in rows:
        for i, x in enumerate(v or []):
            cell = wanted.setdefault((k, l), {}).setdefault(i, [])
            if x is not None:
                cell.append(x)
    got = {}
    for r in rep.average_blocks(df, ["k", "l"], size=size, held_elements=held).collect():
        assert len(r["params"]) <= size
        got.setdefault((r["k"], r["l"]), {}).update({r["block"] * size + i: x for i, x in enumerate(r["params"])})
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in wanted.items()}
    for k, cells in wanted.items():
        for i, xs in cells.items():
            assert got[k][i] is None if not xs else got[k][i] == pytest.approx(sum(xs) / len(xs))
    assert rep.average_blocks(df.limit(0), ["k", "l"]).count() == 0


def test_long_vectors_stay_in_blocks(spark):
    """Two vectors of ten million elements: no element is a row, and the mean comes in blocks."""
    long = spark.range(2).selectExpr("'m' AS k", "transform(sequence(1, 10000000), x -> CAST(x AS DOUBLE) * (id + 1)) AS params")
    found = rep.average_blocks(long, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and plan.count("Exchange hashpartitioning") == 1
    sums = found.selectExpr("block", "size(params) AS n", "params[0] AS first", "aggregate(params, 0D, (a, x) -> a + x) AS s").collect()
    assert sum(r["n"] for r in sums) == 10_000_000 and len(sums) == 153
    assert sum(r["s"] for r in sums) == pytest.approx(1.5 * 10_000_000 * 10_000_001 / 2)
    assert all(r["first"] == 1.5 * (r["block"] * 65_536 + 1) for r in sums)


def test_overlap_in_small_slices():
    """Numbers looked up in a table and hashed ones give the same counts; slices are small, so a task holds little."""
    from tandem.functions import ngrams

    rng = random.Random(4)
    texts = [["".join(rng.choice("ab é漢") for _ in range(rng.randrange(30))) for _ in range(40)] for _ in range(2)]
    for table in (0, ngrams.TABLE):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ngrams, "TABLE", table)
            ngrams._table.cache_clear()
            found = ngrams._char_counts(*texts, 3)
        for i, (h, r) in enumerate(zip(*texts)):
            for n in (1, 2, 3):
                a, b = (Counter(t[k:k + n] for k in range(len(t) - n + 1)) for t in (h, r))
                assert found[i, n - 1].tolist() == [sum((a & b).values()), sum(a.values()), sum(b.values())]
    ngrams._table.cache_clear()
    assert max(s.stop - s.start for s in ngrams._slices(np.full(10_000, 100))) <= 1_000


def test_language_counts_leave_the_tasks_by_ngram(spark):
    """Counts and answers are those of a plain loop, also for empty texts, zeros and signs beyond 16 bits."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["de", "en"]), "".join(rng.choice("ab \0é漢😀") for _ in range(rng.randrange(6)))) for i in range(300)]
    texts = spark.createDataFrame([*rows, (300, "en", None), (301, "fr", "zz")], "id int, lang string, text string").repartition(3)
    for n in (1, 2, 3, 4):
        model = m.train_langid(texts, ["de", "en"], n)
        met = {x: Counter() for x in ("de", "en")}
        grams = lambda t: [f" {t} "[i : i + n] for i in range(max(1, len(t) + 3 - n))]
        for _, lang, text in rows:
            met[lang].update(grams(text))
        names = set(met["de"]) | set(met["en"])
        wanted = {g: tuple(math.floor(math.log((met[x][g] + 1) / (met[x].total() + len(names))) * 1e6 + 0.5) for x in met) for g in [*names, None]}
        found = {r["gram"]: (r["lp_0"], r["lp_1"]) for r in model.collect()}
        assert found == wanted
        got = {r["id"]: r["pred_lang"] for r in m.detect_language(texts, model, ["de", "en"], ["id"], n).collect()}
        for i, _, text in [*rows, (301, "fr", "zz")]:
            sums = [sum(wanted.get(g, wanted[None])[k] for g in grams(text)) for k in (0, 1)]
            assert got[i] == ("de" if sums[0] >= sums[1] else "en")
        assert got[300] is None
    plan = m.gram_counts(texts.select("lang", "text"), ["de", "en"], 3)._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_best_of_beams_as_of_rows(spark):
    """The same candidates in the same ranks as one row a candidate gives, with copies of a sample, equal scores, NaN and null."""
    rng = random.Random(7)
    scores = [0.0, -0.0, -1.0, -2.5, float("nan"), float("-inf"), None]
    beams = [("p", i % 40, [(10 * k + i // 40, f"t{i}.{k}", rng.choice(scores)) for k in range(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(beams, "pair string, sample_id long, beam array<struct<cand:int,text:string,score:double>>").repartition(3)
    for n in (1, 2):
        wide, rows = r.nbest_of_beams(df, n), r.nbest(df.select("pair", "sample_id", F.inline("beam")), n)
        key = lambda x: (x["sample_id"], x["rank"], x["cand"], str(x["score"]))
        assert sorted(map(key, wide.collect())) == sorted(map(key, rows.collect()))


def test_a_log_scores_its_samples_once(spark):
    """Numbering reads the records more than once, but the results only as they were written."""
    scored = spark.sparkContext.accumulator(0)

    def score(batches):
        for batch in batches:
            scored.add(len(batch))
            yield batch

    results = spark.createDataFrame([("a-b", "r")], "pair string, result string").mapInPandas(score, "pair string, result string")
    records = spark.createDataFrame([("a-b", i, 0, "S", f"S-{i}") for i in (3, 1, 1 << 40)], "pair string, sample_id long, seq int, kind string, line string")
    log = r.generation_log(r.close_records(records, results)).orderBy("line_no").collect()
    assert [x["line"] for x in log] == ["S-1", "S-3", f"S-{1 << 40}", "Generate test with beam=5: r"] and scored.value == 1
