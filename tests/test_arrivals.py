"""Logs that arrive over several runs are scored once, also when a run breaks off."""

import pytest

from tandem.jobs import evaluate
from tandem.streaming import arrivals as ar


def put(folder, checkpoint, pair, hyp="eins zwei drei vier"):
    path = folder / checkpoint
    path.mkdir(parents=True, exist_ok=True)
    lines = [f"S-{i}\t__{pair[-2:]}__ one two\nT-{i}\teins zwei drei vier\nH-{i}\t-0.1\t{hyp}" for i in (1, 0)]
    (path / f"{pair}.raw.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")


def scores(spark, out):
    rows = ar.read_committed(spark, out).collect()
    found = {(r["checkpoint"], r["metric"], r["src_lang"], r["tgt_lang"]): r["score"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_only_new_logs_are_scored(spark, tmp_path, monkeypatch):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    assert ar.score_arrivals(spark, str(logs), out, state) == 0 and scores(spark, out) == {}
    put(logs, "c1", "en-de")
    put(logs, "c2", "en-de", "etwas ganz anderes")
    (logs / "c1" / "notes.txt").write_text("no log")
    read = []
    plain = ar.read_generation_log
    monkeypatch.setattr(ar, "read_generation_log", lambda s, paths: read.extend(paths) or plain(s, paths))
    assert ar.score_arrivals(spark, str(logs), out, state) == 1
    first = scores(spark, out)
    assert len(first) == 4 and first["c1", "bleu", "en", "de"] == pytest.approx(100) and first["c2", "bleu", "en", "de"] < 50
    put(logs, "c1", "de-fr")
    assert ar.score_arrivals(spark, str(logs), out, state) == 1
    assert len(read) == 3 and read[-1].endswith("c1/de-fr.raw.txt")
    assert ar.score_arrivals(spark, str(logs), out, state) == 0 and len(read) == 3
    assert len(scores(spark, out)) == 6 and first.items() <= scores(spark, out).items()
    # a lost state lists all files again, but measures none of them
    assert ar.score_arrivals(spark, str(logs), out, str(tmp_path / "fresh")) == 0 and len(read) == 3


def test_a_run_that_broke_off_is_repeated(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    put(logs, "c1", "en-de")
    put(logs, "c1", "en-fr")

    def die(batch):
        raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        ar.score_arrivals(spark, str(logs), out, state, after_write=die)
    # half of a write: no closing mark
    broken = tmp_path / "out" / "batch=other-7"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert ar.score_arrivals(spark, str(logs), out, state) == 1
    assert len(scores(spark, out)) == 4 and len(ar.committed_batches(spark, out)) == 1


def test_files_are_taken_in_bounded_batches(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    for pair in ("en-de", "en-fr", "de-fr"):
        put(logs, "c1", pair)
    assert ar.score_arrivals(spark, str(logs), out, str(tmp_path / "state"), files_per_batch=2) == 2
    assert len(scores(spark, out)) == 6 and len(ar.committed_batches(spark, out)) == 2


def test_evaluate_job_over_arrivals(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    for checkpoint in ("c1", "c2"):
        put(logs, checkpoint, "en-de")
        evaluate.main(["--arrivals", str(logs), "--out", str(out)])
    assert len(scores(spark, str(out / "scores"))) == 4
    assert sorted(p.name for p in (out / "overview").iterdir()) == ["c1", "c2"]
