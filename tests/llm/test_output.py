"""Training order and archive derivatives against plain versions."""

import hashlib
import html
import random
import re
import time

import numpy as np
import pytest

from tandem.llm import ordering, packing, warc


def test_slots_are_a_permutation():
    for n in (1, 2, 5, 64, 1000, 4097):
        found = ordering.slots(np.arange(n), n)
        assert sorted(found.tolist()) == list(range(n))
    assert not np.array_equal(ordering.slots(np.arange(100), 100, 1), ordering.slots(np.arange(100), 100, 2))


def test_records_refuse_ids_above_16_bits():
    assert ordering.record(np.array([1, 65_535], "<u4"), 3) == b"\x01\0\xff\xff\0\0"
    with pytest.raises(ValueError):
        ordering.record(np.array([65_536], "<u4"), 3)


def test_training_order(spark, tmp_path):
    texts = [None, "", "hello there", "many words " * 900, "many words " * 900]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "x", 7)]
    stored = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(3).write.parquet(stored)
    docs = spark.read.parquet(stored)
    folder = ordering.write_training_order(docs, shard_sequences=4)
    found = ordering.read_training_order(spark, folder).collect()
    assert sorted(r["slot"] for r in found) == list(range(len(found))) and all(r["shard"] == r["slot"] // 4 and len(r["ids"]) == 2048 for r in found)
    got = sorted((str(r["doc_id"]), r["start"], np.frombuffer(r["ids"], "<u2")[: r["length"]].tolist()) for r in found)
    wanted = []
    for i, t, _ in rows:
        ids = packing.token_ids(t).tolist()
        wanted += [(str(i), a, ids[a : a + 1024]) for a in range(0, len(ids), 1024)]
    assert got == sorted(wanted)
    for at in (1, 4, len(found) - 1, len(found)):
        rest = ordering.read_training_order(spark, folder, at, shard_sequences=4)
        assert sorted(r["slot"] for r in rest.collect()) == list(range(at, len(found)))
        assert "PartitionFilters: [isnotnull(shard" in rest._jdf.queryExecution().toString()
    digests = {(str(r["doc_id"]), r["start"]): r["ids_crc32"] for r in ordering.training_order(docs).collect()}
    assert digests[("2", 0)] == ordering.checksum(np.pad(packing.token_ids("hello there"), (0, 1024 - len(packing.token_ids("hello there")))))
    empty = docs.limit(0).write.mode("overwrite").parquet(stored + "-empty") or spark.read.parquet(stored + "-empty")
    assert ordering.training_order(empty).count() == 0


def test_training_order_of_moving_partitions(spark):
    import random

    anew = ordering.F.udf(lambda: random.random(), "double").asNondeterministic()
    rows = [(i, "some words " * (1 + i % 7 * 300)) for i in range(120)]
    # every read deals the rows to other partitions
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", anew()).repartition(5, "r").drop("r")
    found = ordering.training_order(docs, shard_sequences=16).collect()
    wanted = sorted((i, a) for i, t in rows for a in range(0, len(packing.token_ids(t)), 1024))
    assert sorted((r["doc_id"], r["start"]) for r in found) == wanted
    assert sorted(r["slot"] for r in found) == list(range(len(wanted)))


def test_plain_text():
    page = "<html><head><title>T &amp; U</title><script>if (a<b) x()</script></head><body><!-- no --><p>One  <b>two</b></p>3 < 4<br>&eacute;</body>"
    assert warc.plain_text(page) == "T & U\nOne two\n3 < 4\né"
    assert warc.plain_text(None) == warc.plain_text("<style>x") == ""


def test_records(spark):
    rows = [(1, "http://a/", "<p>Hällo</p>", "x"), (2, None, None, "x"), (None, "http://b/\r\nX: y", "", "x"), (1, "http://a/", "<p>Hällo</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, plain string")
    found = warc.derive_records(pages).collect()
    assert len(found) == 4 and warc.derive_records(pages.limit(0)).count() == 0
    for r in found:
        for kind, record in (("conversion", r["conversion"]), ("metadata", r["metadata"])):
            head, block = record.split("\r\n\r\n", 1)
            fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
            block = block[:-4].encode()
            assert head.startswith("WARC/1.1\r\n") and fields["WARC-Type"] == kind and fields["WARC-Refers-To"] == r["response_id"]
            assert int(fields["Content-Length"]) == len(block) and fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            assert fields["WARC-Record-ID"] == r[f"{kind}_id"] and "X" not in fields and re.match(r"<urn:uuid:[0-9a-f-]{36}>$", fields["WARC-Record-ID"])
        assert r["conversion_id"] in r["metadata"] and r["source_digest"] in r["metadata"] and r["source_digest"] in r["conversion"]
    one = next(r for r in found if r["page_id"] == 1)
    assert one["plain"] == "Hällo" and one["source_digest"] == "sha256:" + hashlib.sha256("<p>Hällo</p>".encode()).hexdigest()


def _slow_plain_text(page):
    """The rules one character at a time, with the end of every tag sought from its start."""
    low, out, at = page.lower(), [], 0
    while at < len(page):
        if low.startswith("<!--", at):
            end = low.find("-->", at + 4)
            out.append(" ")
            at = len(page) if end < 0 else end + 3
            continue
        m = re.match(r"<(script|style|noscript|template)\b[^>]*>", low[at:])
        if m:
            close = re.search(rf"</{m[1]}\s*>", low[at + m.end():])
            out.append(" ")
            at = len(page) if not close else at + m.end() + close.end()
            continue
        out.append(page[at])
        at += 1
    text = "".join(out)
    text = re.sub(r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|title|body|head|html|nav|pre|hr)\b[^>]*>", "\n", text)
    text = html.unescape(re.sub(r"<[A-Za-z/!?][^>]*>", "", text))
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def test_plain_text_of_random_markup():
    rng = random.Random(5)
    parts = ["<", ">", "<a", "<p>", "</p", "<script", "<script>", "</script>", "<style ", "</style >", "<!--", "-->", "--", "x", " y ", "\n", "&amp;", "<br/>", "/", "!"]
    for _ in range(20_000):
        page = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert warc.plain_text(page) == _slow_plain_text(page), page


@pytest.mark.parametrize("part", ["<a", "<script", "<!-", "<p ", "</script", "<a>", "<script>x</script"])
def test_time_of_plain_text_grows_with_the_page(part):
    warc.plain_text(part * 1000)
    began = time.perf_counter()
    warc.plain_text(part * 400_000)
    assert time.perf_counter() - began < 10


def test_given_columns_of_a_response_are_preserved(spark):
    rows = [(1, "http://a/", "<p>x", "<urn:uuid:1>", "2020-02-02T00:00:00Z", "sha1:ABC", "text/html", "Server: s\r\nX-A: 1\r\nno header"),
            (2, "http://b/", "<p>y", None, " ", None, None, None)]
    given = ", ".join(f"{c} string" for c in warc.GIVEN)
    pages = spark.createDataFrame(rows, f"page_id long, url string, html string, {given}")
    one, two = warc.derive_records(pages).orderBy("page_id").collect()
    assert one["response_id"] == "<urn:uuid:1>" and one["source_digest"] == "sha1:ABC"
    for record in (one["conversion"], one["metadata"]):
        assert "WARC-Refers-To: <urn:uuid:1>\r\n" in record and "WARC-Date: 2020-02-02T00:00:00Z\r\n" in record
    assert one["metadata"].endswith("source-content-type: text/html\r\nsource-header: Server: s\r\nsource-header: X-A: 1\r\n\r\n\r\n")
    # absent values are made as for a table without these columns
    plain = warc.derive_records(pages.drop(*warc.GIVEN)).orderBy("page_id").collect()[1]
    assert two == plain and "no header" not in one["metadata"]
