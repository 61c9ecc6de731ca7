"""License scan: exact phrases, and short notices found with a bounded number of edits."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that label a text wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices in normal form (lower case, words apart by one space) and their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
]
#: Edits allowed: one for so many characters of a notice.
CHARS_PER_EDIT = 10

_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered: runs of ASCII letters and digits and of everything beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def edit_limit(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def split_seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive parts: with at most ``edits`` edits one of them stands unchanged."""
    parts, bounds = edits + 1, []
    for i in range(parts + 1):
        bounds.append(len(notice) * i // parts)
    return [(a, notice[a:b]) for a, b in zip(bounds, bounds[1:])]


class NoticeScan:
    """Seeds of all notices in one automaton; candidates are verified by bounded-error matching.

    Verification allows insertions, deletions and substitutions up to the limit and tightens the match
    it finds. A match begins and ends with whole words.
    """

    def __init__(self, notices=NOTICES):
        self.notices = [(notice, label, edit_limit(notice)) for notice, label in notices]
        self.patterns = [regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}(?![^ ])")
                         for n, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, k) in enumerate(self.notices):
            for at, seed in split_seeds(notice, k):
                seeds.setdefault(seed, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def candidates(self, plain: str) -> dict[int, list[tuple[int, int]]]:
        """Merged regions, cut at words, in which each notice may stand.

        A seed that is hit fixes where its notice would begin, give or take the edits. One hit is
        enough: a true match leaves at least one seed unchanged.
        """
        hits: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(plain):
            for i, at in where:
                hits.setdefault(i, []).append(end + 1 - size - at)
        regions = {}
        for i, begins in hits.items():
            notice, _, k = self.notices[i]
            merged: list[list[int]] = []
            for begin in sorted(begins):
                low = plain.rfind(" ", 0, max(0, begin - k)) + 1
                high = plain.find(" ", min(len(plain), begin + len(notice) + k))
                high = len(plain) if high < 0 else high
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(high, merged[-1][1])
                else:
                    merged.append([low, high])
            regions[i] = [(low, high) for low, high in merged]
        return regions

    def spans(self, plain: str) -> list[tuple[int, int, int, int]]:
        """``(begin, end, notice, edits)`` of verified matches in normal form; of overlapping ones the closest, then the longest."""
        found = []
        for i, regions in self.candidates(plain).items():
            for low, high in regions:
                for m in self.patterns[i].finditer(plain, low, high):
                    edits = sum(m.fuzzy_counts)
                    found.append((edits / len(self.notices[i][0]), m.start() - m.end(), m.start(), m.end(), i, edits))
        # taken spans never overlap, so a new one can only meet its two neighbours
        taken: list[tuple[int, int, int, int]] = []
        for _, _, begin, end, i, edits in sorted(found):
            at = bisect.bisect_left(taken, (begin,))
            if (at == 0 or taken[at - 1][1] <= begin) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (begin, end, i, edits))
        return taken

    def scan(self, text: str | None) -> dict:
        words = normal_words(text)
        framed = b" " + b" ".join(words) + b" "
        n_base, firsts, lasts, base = 0, [], [], set()
        for phrase, label in PHRASES.items():
            sought = b" " + phrase.encode() + b" "
            at = first = framed.find(sought)
            while at >= 0:
                n_base, last = n_base + 1, at
                at = framed.find(sought, at + 1)
            if first >= 0:
                base.add(label)
                firsts.append(framed.count(b" ", 0, first))
                lasts.append(framed.count(b" ", 0, last))
        plain = framed[1:-1].decode("utf-8", "replace")
        labels, score, spans = set(base), 1.0 if n_base else 0.0, []
        word, seen = 0, 0
        for begin, end, i, edits in self.spans(plain):
            notice, label, _ = self.notices[i]
            labels.add(label)
            score = max(score, 1.0 - edits / len(notice))
            # words are counted on from the span before
            word, seen = word + plain.count(" ", seen, begin), begin
            spans.append((label, word, word + plain.count(" ", begin, end) + 1, edits))
        return {
            "n_words": len(words), "n_base": n_base, "first_word": min(firsts, default=None), "last_word": max(lasts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "spans": spans,
        }


RESULT = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string",
    "score": "double", "spans": "array<struct<label: string, first_word: long, end_word: long, edits: long>>",
}


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), notices: list[tuple[str, str]] = NOTICES) -> DataFrame:  # noqa: B006
    """``keep`` and the scan result of every document; a pure map in Arrow batches.

    ``n_base`` counts the places of the exact phrases, ``first_word`` and ``last_word`` their smallest and
    largest start; ``labels`` adds those of notices found with up to one edit per ten characters;
    ``spans`` lists these in words, end exclusive, with their edits; ``score`` is 1 for an exact phrase,
    else the largest share of a notice that stood unedited, else 0.

    Defined results: a null or empty text has no words, no labels and score 0; overlapping notices give the closest
    one; time grows with the length of a text and its matches, not with their square; repeated rows give repeated
    results; an empty table gives no rows; columns of the input named like results are not read.
    """
    held: list[NoticeScan] = []

    @F.pandas_udf("struct<" + ", ".join(f"{k}: {v}" for k, v in RESULT.items()) + ">")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not held:
            held.append(NoticeScan(notices))
        for batch in batches:
            rows = [held[0].scan(text) for text in batch]
            yield pd.DataFrame({name: pd.Series([r[name] for r in rows], dtype=object) for name in RESULT})

    columns = dict.fromkeys([*keep, "text"])
    found = docs.select(*columns).select(*keep, scan("text").alias("_found"))
    return found.select(*keep, "_found.*")
