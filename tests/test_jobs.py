import csv

import pytest

from tandem.jobs import build_data, evaluate
from tandem.sources import sinks


def test_build_data_end_to_end(spark, tmp_path):
    for src, tgt, n in (("de", "en", 60), ("en", "fr", 25)):
        folder = tmp_path / "in" / f"{src}-{tgt}"
        folder.mkdir(parents=True)
        for lang in (src, tgt):
            lines = [f" the house {lang} number {i} " for i in range(n)] + [f"the house {lang} number 0", "....", ""]
            (folder / f"{src}-{tgt}.{lang}").write_text("\n".join(lines) + "\n", encoding="utf-8")
    # a pair that lost a line, and one that is only found the other way round
    for pair, n_src, n_tgt in (("de-es", 5, 4), ("fr-de", 30, 30)):
        folder = tmp_path / "in" / pair
        folder.mkdir()
        for lang, n in zip(pair.split("-"), (n_src, n_tgt)):
            (folder / f"{pair}.{lang}").write_text("".join(f"word {lang} {i}\n" for i in range(n)), encoding="utf-8")
    (tmp_path / "pairs.txt").write_text("de-en,en-fr,de-es,de-fr,es-fr\n", encoding="utf-8")
    out = str(tmp_path / "out")
    build_data.main(["--bitext", str(tmp_path / "in/*/*"), "--out", out, "--vocab-size", "60", "--shards", "4", "--min-lines", "20",
                     "--pairs", str(tmp_path / "pairs.txt")])
    failed = {r["pair"]: r["reason"] for r in spark.read.parquet(f"{out}/failed").collect()}
    assert failed == {"de-es": "line counts differ", "es-fr": "source missing"}
    turned = spark.read.parquet(f"{out}/clean").where("pair = 'de-fr'").collect()
    assert len(turned) == 30 and all(r["src"].startswith("word de") and r["tgt"].startswith("word fr") for r in turned)
    counts = {r["pair"]: r.asDict() for r in spark.read.parquet(f"{out}/counts").collect()}
    assert counts["de-en"]["n_read"] == 63 and counts["de-en"]["n_punct"] == 61 and counts["de-en"]["n_dedup"] == 60
    shards = spark.read.parquet(f"{out}/shards")
    assert shards.select("shard", "pair").distinct().count() == 12
    assert all(c["n_length"] == c["n_clean"] for c in counts.values()) and set(counts) == {"de-en", "en-fr", "de-fr"}
    assert shards.where("pair = 'de-en'").select("line_no").distinct().count() == counts["de-en"]["n_clean"]
    assert all(r["src_ids"][-1] == 2 and 3 not in r["src_ids"] for r in shards.collect())


def test_build_data_with_unigram_pieces(spark, tmp_path):
    folder = tmp_path / "in" / "de-en"
    folder.mkdir(parents=True)
    for lang in ("de", "en"):
        (folder / f"de-en.{lang}").write_text("".join(f"the house {lang} number {i}\n" for i in range(30)), encoding="utf-8")
    out = str(tmp_path / "out")
    build_data.main(["--bitext", str(tmp_path / "in/*/*"), "--out", out, "--vocab-size", "40", "--shards", "2", "--min-lines", "20", "--subwords", "unigram"])
    vocabulary = {r["rank"]: r["token"] for r in spark.read.parquet(f"{out}/vocabulary").collect()}
    assert sorted(vocabulary) == list(range(1, 41))
    lines = {(r["line_no"]): "".join(vocabulary[i] for i in r["src_ids"][:-1]) for r in spark.read.parquet(f"{out}/shards").where("shard = 0").collect()}
    texts = {r["line_no"]: "".join("▁" + w for w in r["src"].split()) for r in spark.read.parquet(f"{out}/clean").collect()}
    assert lines and all(texts[k] == v for k, v in lines.items())


def test_evaluate_end_to_end(spark, tmp_path):
    for pair, hyp in (("en-de", "eins zwei drei vier"), ("de-fr", "quelque chose d' autre ici")):
        lines = [f"S-{i}\t__{pair[-2:]}__ one two\nT-{i}\teins zwei drei vier\nH-{i}\t-0.1\t{hyp}" for i in (1, 0)]
        (tmp_path / f"{pair}.raw.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    out = str(tmp_path / "out")
    evaluate.main(["--logs", str(tmp_path / "*.raw.txt"), "--checkpoint", "ck", "--out", out, "--detokenize"])
    scores = {(r["metric"], r["src_lang"], r["tgt_lang"]): r["score"] for r in spark.read.parquet(f"{out}/scores").collect()}
    assert round(scores["bleu", "en", "de"], 6) == round(scores["chrf", "en", "de"], 6) == 100
    assert scores["bleu", "de", "fr"] == 0 and 0 < scores["chrf", "de", "fr"] < 30
    evaluate.main(["--logs", str(tmp_path / "*.raw.txt"), "--checkpoint", "ck", "--out", out])
    again = sinks.read_results(spark, f"{out}/scores")
    assert spark.read.parquet(f"{out}/scores").count() == 2 * again.count() == 2 * len(scores)
    sheet = next((tmp_path / "out/matrix/ck").glob("*.csv"))
    rows = {(x["metric"], x["src_lang"]): x for x in csv.DictReader(sheet.open())}
    assert float(rows["bleu", "en"]["de"]) == 100 and rows["bleu", "en"]["fr"] == ""


def test_evaluate_benchmark_with_all_metrics(spark, tmp_path, monkeypatch):
    """Four metrics and the report by resource class; directions outside what scorer or detector know have no such score."""
    (tmp_path / "halves.py").write_text(
        "def load():\n    return 0.5\n\n\ndef score(model, batch):\n    return (batch['hyp'] == batch['ref']) * model\n", encoding="utf-8")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "halves.py"))
    german, english = "das haus und der baum", "the house and the tree"
    spark.createDataFrame([("de", german), ("en", english), ("xx", "zz"), (None, "zz")], "lang string, text string").write.parquet(str(tmp_path / "texts"))
    logs = tmp_path / "results" / "ck"
    logs.mkdir(parents=True)
    # two right lines and an English one; a target the detector does not know; a target the scorer does not know
    for pair, hyps in (("en-de", [german, german, english, english]), ("en-kab", [english] * 4), ("de-mt", [german] * 4)):
        lines = [f"S-{i}\ts\nT-{i}\t{german}\nH-{i}\t-0.1\t{h}" for i, h in enumerate(hyps)]
        (logs / f"{pair}.raw.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    wanted = {("comet", "en", "de"): 25.0, ("offtarget", "en", "de"): 50.0}
    for source in (["--logs", str(logs / "*.raw.txt"), "--checkpoint", "ck"], ["--arrivals", str(tmp_path / "results")]):
        out = tmp_path / source[0].strip("-")
        evaluate.main([*source, "--out", str(out), "--scorer", "halves", "--detector-text", str(tmp_path / "texts"), "--benchmark"])
        sheet = next((out / "matrix/ck").glob("*.csv"))
        cells = {(x["metric"], x["src_lang"]): x for x in csv.DictReader(sheet.open())}
        assert len(cells) == 4 * 41 and {k: float(cells[k[:2]][k[2]]) for k in wanted} == wanted
        assert cells["comet", "en"]["kab"] == cells["offtarget", "en"]["kab"] == cells["comet", "de"]["mt"] == cells["offtarget", "de"]["mt"] == ""
        assert float(cells["chrf", "de"]["mt"]) == float(cells["bleu", "de"]["mt"]) == 100
        report = {(x["metric"], x["label"]): x["score"] for x in csv.DictReader(next((out / "benchmark/ck").glob("*.csv")).open())}
        # en and de are of one class of eleven languages, all of which the scorer knows
        assert float(report["comet", "hub2m"]) == 25 and float(report["comet", "h2h"]) * 110 == pytest.approx(25)
        assert float(report["comet", "~2h"]) == pytest.approx(25 / 110 / 4)
        assert len(report) == 4 * (5 + 16 + 8)
