"""Groups of spelling variants: words one edit apart, found by pivotal bigrams and hung on their frequent forms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.session import staged

LETTERS, MIN_CHARS, MIN_COUNT, FORM_FACTOR = r"[A-Za-zÀ-ÿ]+", 6, 5, 5
#: Words of one index entry compared by one task at most; entries with more are dealt into blocks.
BLOCK = 20_000
#: Longest prefix needed for one edit: an edit destroys at most two bigrams.
PREFIX_GRAMS = 3


def lowered(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(run.rlike("[A-Z]"), F.translate(run, upper, upper.lower())).otherwise(run)


def misspelt(run: Column, doc_id: Column, every: int = 199) -> Column:
    """The run without one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``; a run of a null id stays."""
    code = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (code % F.length(run)).cast("int")
    without = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(F.coalesce(code % every == 0, F.lit(False)), without).otherwise(run)


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, alter=misspelt) -> DataFrame:
    """``word, n`` of the words of whole texts that are long and frequent enough; copies meet before the shuffle."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("_run"))
    runs = runs.where(F.length("_run") >= min_chars).select("doc_id", lowered(F.col("_run")).alias("_run"))
    words = runs.select(alter(F.col("_run"), F.col("doc_id")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[str, int]], list[tuple[str, int]]]:
    """``last, prefix, pivots`` of a word; ``order`` gives each bigram its rank, rarest first, and its frequency.

    The prefix holds the rarest ``PREFIX_GRAMS`` bigrams and every other occurrence of a bigram up to the last
    of their ranks, with places. The pivots are two bigrams of the prefix that share no letter, of the smallest frequency
    in total, by dynamic programming over places: the best pair up to a place either leaves that bigram out or
    joins it to the best single bigram that ends before it.
    """
    grams = [(order[g][0], i, g) for i, g in enumerate(bigrams(word))]
    last = sorted(grams)[min(PREFIX_GRAMS, len(grams)) - 1][0]
    prefix = [(g, i) for rank, i, g in grams if rank <= last]
    single: list[tuple[float, list[tuple[str, int]]]] = []
    pair: tuple[float, list[tuple[str, int]]] = (float("inf"), [])
    for k, (gram, i) in enumerate(prefix):
        weight = order[gram][1]
        before = k - 1
        while before >= 0 and prefix[before][1] > i - 2:
            before -= 1
        if before >= 0 and single[before][0] + weight < pair[0]:
            pair = (single[before][0] + weight, [*single[before][1], (gram, i)])
        own = (float(weight), [(gram, i)])
        single.append(min(single[-1], own, key=lambda s: s[0]) if single else own)
    return last, prefix, pair[1]


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank, rarest first, and frequency of every bigram of the distinct words.

    The words are made of A-Z, a-z and U+00C0 to U+00FF, so there are at most 116 * 116 bigrams however many words.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter(g for w in batch["word"] for g in bigrams(w))
            yield pd.DataFrame({"gram": list(found), "n": list(found.values())}, columns=["gram", "n"])

    counts = words.select("word").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = sorted((r["n"], r["gram"]) for r in counts.collect())
    return {gram: (rank, n) for rank, (n, gram) in enumerate(ranked)}


def gram_index(words: DataFrame) -> DataFrame:
    """``word, n, pivot, gram, place, chars, last``: two pivots and the prefix of every word."""
    shared = words.sparkSession.sparkContext.broadcast(gram_order(words))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = shared.value
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"]):
                last, prefix, pivots = prefix_and_pivots(word, order)
                rows += [(word, n, pivot, g, i, len(word), last) for pivot, grams in ((False, prefix), (True, pivots)) for g, i in grams]
            yield pd.DataFrame(rows, columns=["word", "n", "pivot", "gram", "place", "chars", "last"])

    return words.select("word", "n").mapInPandas(entries, "word string, n long, pivot boolean, gram string, place int, chars int, last int")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words, ``a < b``, exactly one inserted, deleted or replaced code point apart.

    One edit destroys at most one of two pivots, as they share no letter. The other one is still in the other word; if the
    ranks of the pivots' word end first, it lies in the other word's prefix, at the same place or, behind an insertion
    or deletion, one further or nearer. So each pivot asks for its bigram at the places and lengths an edit can
    give: five questions. Candidates are verified by edit distance. An index entry with over ``block`` words is dealt by hash into
    blocks, each asked on its own, so no task holds more of an entry than that; the table of such entries has a row for at
    least ``block`` index rows.
    """
    index = staged(gram_index(words), "gram-index")
    prefixes = index.where("NOT pivot").select("gram", "place", "chars", "last", F.col("word").alias("other"), F.col("n").alias("n_other"))
    key = ["gram", "place", "chars"]
    large = prefixes.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    large = staged(large.select(*key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "large-entries")
    # what an edit does to the length, and to the place of a bigram before and behind it
    moves = F.array(*[F.struct(F.lit(d).alias("chars"), F.lit(s).alias("place")) for d, s in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    asked = index.where("pivot").select("word", "n", "last", "gram", "place", "chars", F.explode(moves).alias("_move")).select(
        "gram", (F.col("place") + F.col("_move.place")).alias("place"), (F.col("chars") + F.col("_move.chars")).alias("chars"),
        "word", "n", F.col("last").alias("own_last"))
    blocks = F.coalesce("_blocks", F.lit(1))
    held = prefixes.join(large, key, "left").select(*key, "last", "other", "n_other", F.pmod(F.xxhash64("other"), blocks).cast("int").alias("_block"))
    asked = asked.join(large, key, "left").select(*key, "own_last", "word", "n", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    met = asked.join(held, [*key, "_block"]).where("own_last <= last AND word <> other")
    met = met.where(F.levenshtein("word", "other", 1) == 1)
    first, second = F.struct("word", "n"), F.struct(F.col("other").alias("word"), F.col("n_other").alias("n"))
    low = F.col("word") < F.col("other")
    pairs = met.select(F.when(low, first).otherwise(second).alias("_a"), F.when(low, second).otherwise(first).alias("_b"))
    return pairs.select(F.col("_a.word").alias("a"), F.col("_a.n").alias("n_a"), F.col("_b.word").alias("b"), F.col("_b.n").alias("n_b")).distinct()


def follow_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a ``form``: the last word reached by forms.

    A form is ``FORM_FACTOR`` times as frequent, so no chain is longer than the digits of a count; each round doubles the way gone.
    """
    reached = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not reached.join(on, "root", "left_semi").take(1):
            return reached
        reached = staged(reached.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")


def group_variants(words: DataFrame, factor: int = FORM_FACTOR, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (``word, n``; distinct words of four letters or more).

    The form is the most frequent near word, the first in code-point order among equals, if it occurs at least ``factor`` times as often as the
    word; the root is reached by following forms. Everything is a count, an equality join or a minimum that combines before its shuffle.
    """
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_words(words, block), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("_other"), F.col("n_b").alias("_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("_other").alias("word"))).alias("_best"))
    found = words.join(best, "word", "left")
    frequent = -F.col("_best.n") >= F.col("n") * factor
    formed = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("_best.word")).alias("form"),
                                 F.when(frequent, -F.col("_best.n")).alias("form_n")), "forms")
    roots = follow_forms(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FORM_FACTOR, alter=misspelt) -> DataFrame:
    """The words of whole texts grouped by ``group_variants``: maximal runs of letters, A-Z in lower case, after ``alter(run, doc_id)``.

    Defined results: null and empty texts have no words; a null id alters nothing; repeated rows count each; a very long text or word takes time in
    proportion to its length; an empty table gives no rows; other columns are not read. ``min_chars`` must be at least 4, as a word needs three bigrams.
    """
    if min_chars < 4:
        raise ValueError("a word needs three bigrams: min_chars is at least 4")
    return group_variants(count_words(docs.select("doc_id", "text"), min_chars, min_count, alter), factor)
