"""Every stage of the pipeline against plain Python, on the smallest data set, and on an empty and a null table."""

import re
from collections import Counter
from itertools import combinations

from tokenizers import Tokenizer

import corpus_pipeline
from tandem.llm import packing, tables, toxicity
from tandem.session import staged
from tests.conftest import SF
from tests.llm.test_operators import WORD, _print

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _mix_targets(sizes):
    """Shares of all words by weight, none above three times its source's words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] if full else level * weight[s] for s in full or free}
        left -= sum(target[s] for s in full)
        free -= full or free
    return target


def test_stages(spark):
    docs = tables.read_table(spark, SF, "documents")
    columns, seen = docs.columns, {"": docs.collect()}
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "stage")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    model = toxicity.train_toxicity(given, tables.read_table(spark, SF, "labels"))
    scores = model.scores((r["text"] or "").encode() for r in seen[""])
    assert {r["doc_id"] for r in seen["toxicity"]} == {r["doc_id"] for r, s in zip(seen[""], scores) if s < toxicity.TOXIC_FROM}

    prints = {r["doc_id"]: _print(r["text"]) for r in seen["toxicity"]}
    first = {i: i for i in prints}

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            low, high = sorted((top(a), top(b)))
            first[high] = low
    assert sorted(r["doc_id"] for r in seen["near copies"]) == sorted({top(i) for i in prints})

    redacted = {r["doc_id"]: r for r in seen["personal data"]}
    assert sorted(redacted) == sorted(r["doc_id"] for r in seen["near copies"]) and len(redacted) == len(seen["personal data"])
    assert not any(EMAIL.search(r["text"] or "") for r in redacted.values())
    assert all(r["n_chars"] == len(r["text"] or "") for r in redacted.values())

    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in redacted.values():
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in seen["mix"]:
        assert r == redacted[r["doc_id"]]
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert max(Counter(r["doc_id"] for r in seen["mix"]).values()) <= 3
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1e-6 for s, t in _mix_targets(sizes).items())

    encoder = Tokenizer.from_file(packing.public_path())
    expected = Counter()
    for r in seen["mix"]:
        expected[r["doc_id"]] += len(encoder.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got, sequences = Counter(), {}
    for r in seen["packing"]:
        got[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == expected
    for pieces in sequences.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 1024


def test_stages_take_empty_and_null_tables(spark):
    schema = tables.read_table(spark, SF, "documents").schema
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), "stage")
            assert docs.count() <= len(rows)
