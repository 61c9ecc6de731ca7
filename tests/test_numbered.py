"""Numbered text against reading a file from its start, at every cut."""

import gzip
import io
import random

import pytest

from tandem.sources import numbered as n
from tandem.sources import text as txt


def plain(body: bytes):
    lines = body.split(b"\n")
    return [x.removesuffix(b"\r") for x in (lines[:-1] if lines[-1] == b"" else lines)]


BODIES = [b"", b"\n", b"\n\n\n", b"a", b"a\n", b"a\r\nb\r\n", b"one\ntwo\n\nthree", b"x" * 40 + b"\n" + b"y" * 3, "é\n漢字\n\U0001f600".encode(), b"a\rb\n"]


def test_ranges_give_every_line_once():
    rng = random.Random(3)
    bodies = BODIES + [bytes(rng.choice(b"ab\n\r") for _ in range(rng.randrange(60))) for _ in range(150)]
    for body in bodies:
        for size in (1, 2, 3, 7, 100):
            for chunk in (1, 2, 5, 1000):
                cuts = [(low, min(low + size, len(body))) for low in range(0, len(body), size)]
                read = [[x for part in n.range_lines(io.BytesIO(body), a, b, chunk) for x in part] for a, b in cuts]
                assert [x for part in read for x in part] == plain(body), (body, size, chunk)
                assert [n.count_starts(io.BytesIO(body), a, b, chunk) for a, b in cuts] == [len(x) for x in read], (body, size, chunk)


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_numbered_text(spark, tmp_path, size):
    wanted = {}
    for i, body in enumerate(BODIES):
        (tmp_path / f"f{i}.txt").write_bytes(body)
        wanted[f"f{i}.txt"] = plain(body)
    (tmp_path / "g.txt.gz").write_bytes(gzip.compress(b"packed\nlines\n" * 50))
    wanted["g.txt.gz"] = [b"packed", b"lines"] * 50
    got = {name: {} for name in wanted}
    for r in n.numbered_text(spark, str(tmp_path / "*"), size).collect():
        got[r["path"].rsplit("/", 1)[1]][r["line_no"]] = r["value"].encode()
    assert {k: [v[i] for i in range(1, len(v) + 1)] for k, v in got.items()} == wanted
    found = n.numbered_text(spark, [str(tmp_path / "f4.txt"), str(tmp_path / "f6.txt")], size)
    assert found.count() == 5 and "numbered_text" in found._jdf.queryExecution().toString()


def test_many_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(n, "SPAN_BLOCKS", 3)
    monkeypatch.setattr(n, "SHIPPED_RANGES", 0)
    (tmp_path / "dev.de").write_text("".join(f"line {i}\n" for i in range(500)))
    got = n.numbered_text(spark, str(tmp_path / "dev.de"), 50).orderBy("line_no").collect()
    assert [(r["line_no"], r["value"]) for r in got] == [(i + 1, f"line {i}") for i in range(500)]


def test_no_copy_of_the_text_is_written(spark, tmp_path):
    import os

    from tandem.session import checkpoint_root

    (tmp_path / "dev.de").write_text("a\nb\n")
    before = set(os.listdir(checkpoint_root(spark)))
    assert txt.read_parallel_set(spark, str(tmp_path / "dev.de")).count() == 2
    assert set(os.listdir(checkpoint_root(spark))) == before
