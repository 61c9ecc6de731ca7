"""Corpus assembly: monolingual text, parallel directions, samples, shards, batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.cleaning import SEPARATOR, shuffle_key
from tandem.operators.numbering import block_starts, hash_block, number_rows, range_block
from tandem.session import staged

MIN_CHUNK_LINES = 50_000
N_SHARDS = 100


def mono_corpus(df: DataFrame, hub: str = "en", hub_from: str = "de") -> DataFrame:
    """Subword training text: each language once, from its pair with the hub; the hub's own side from one pair."""
    sides = F.array(
        F.struct(F.col("src_lang").alias("lang"), F.col("tgt_lang").alias("other"), F.col("src").alias("text")),
        F.struct(F.col("tgt_lang").alias("lang"), F.col("src_lang").alias("other"), F.col("tgt").alias("text")),
    )
    rows = df.select("pair", "line_no", F.inline(sides))
    wanted = ((F.col("lang") == hub) & (F.col("other") == hub_from)) | ((F.col("other") == hub) & (F.col("lang") != hub))
    return rows.where(wanted).select("lang", "pair", "line_no", "text")


def parallel_directions(texts: DataFrame, directions: DataFrame) -> DataFrame:
    """Bitext of every listed direction from an N-way parallel set (``sent_id, lang, text``).

    Each text is shuffled once, by sentence; the wanted targets of its language (one
    short list per language) ride along and are checked inside the join.
    """
    targets = directions.groupBy("src_lang").agg(F.collect_set("tgt_lang").alias("_targets"))
    src = texts.select("sent_id", F.col("lang").alias("src_lang"), F.col("text").alias("src")).join(F.broadcast(targets), "src_lang")
    tgt = texts.select(F.col("sent_id").alias("_sent"), F.col("lang").alias("tgt_lang"), F.col("text").alias("tgt"))
    wanted = (F.col("sent_id") == F.col("_sent")) & F.array_contains("_targets", F.col("tgt_lang"))
    return src.join(tgt, wanted).select(
        F.concat_ws("-", "src_lang", "tgt_lang").alias("pair"), "src_lang", "tgt_lang",
        F.col("sent_id").alias("line_no"), "src", "tgt",
    )


def sample_exact(df: DataFrame, n: int, seed: int = 1, key: tuple[str, ...] = ("pair", "line_no")) -> DataFrame:
    """Exactly the ``n`` rows with the smallest hash, for any ``n``.

    ``df`` is read twice: its key columns for a narrow table of hashes, and whole by the filter at the end. A histogram of
    hash prefixes (65,536 rows at most) tells the prefix where the n-th row lies; only the hashes of that prefix are put
    in order, and the n-th one is the limit every row is compared with. ``key`` must identify a row.
    """
    if n <= 0:
        return df.where(F.lit(False))
    digest = F.md5(F.concat_ws(SEPARATOR, F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    hashes = staged(df.select(digest.alias("_key")), "sample-keys").withColumns({"_prefix": hash_block(F.col("_key")), "_one": F.lit(0)})
    start, end = F.col("block_start"), F.col("block_start") + F.col("block_rows")
    edge = block_starts(hashes, ["_one"], "_prefix").where((start < n) & (end >= n)).first()
    if edge is None:
        return df
    at_edge = hashes.where(F.col("_prefix") == edge["_prefix"])
    placed = number_rows(at_edge, ["_prefix"], ["_key"], F.substring("_key", 5, 2), "_pos", 1)
    limit = placed.where(F.col("_pos") == n - 1 - edge["block_start"]).first()["_key"]
    return df.where(digest <= limit)


# Sharding -----------------------------------------------------------------------------------


def assign_chunk(df: DataFrame, n_shards: int = N_SHARDS, min_lines: int = MIN_CHUNK_LINES, seed: int | None = None) -> DataFrame:
    """0-based ``chunk`` per pair, with ``n_chunks``.

    A pair is cut into ``n_shards`` chunks when each would reach ``min_lines``, else
    into chunks of about ``min_lines``; a chunk holds one line more than that size.
    Rows are cut in the order of ``line_no``, or with a ``seed`` in a random order, so that a chunk is a sample of its pair.
    ``df`` is read twice, once only its keys: the counts that number the rows also tell how many lines a pair has.
    """
    per_shard = F.floor(F.col("_total") / n_shards)
    size = F.when(per_shard >= min_lines, per_shard).otherwise(F.lit(min_lines)) + 1
    if seed is None:
        indexed = number_rows(df, ["pair"], ["line_no"], range_block(F.col("line_no")), total="_total")
    else:
        keyed = df.withColumn("_key", shuffle_key(seed, "pair", "line_no"))
        indexed = number_rows(keyed, ["pair"], ["_key", "line_no"], hash_block(F.col("_key")), levels=1, total="_total").drop("_key")
    return indexed.withColumn("_size", size).withColumns({
        "n_chunks": F.ceil(F.col("_total") / F.col("_size")).cast("int"),
        "chunk": F.floor(F.col("row_idx") / F.col("_size")).cast("int")}).drop("_size", "_total")


def fill_shards(df: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Every shard holds every pair: shard k takes chunk ``k mod n_chunks``.

    Each row lists the shards its chunk goes to, so no join is needed.
    """
    # assign_chunk with the same n_shards never makes more chunks than shards
    shards = F.sequence(F.col("chunk"), F.lit(n_shards - 1), F.col("n_chunks"))
    return df.withColumn("shard", F.explode(shards))


def replicate_valid(df: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The whole validation set in every shard."""
    return df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))


# Mixing ----------------------------------------------------------------------------------------


def tag_target_lang(df: DataFrame, col: str = "src") -> DataFrame:
    return df.withColumn(col, F.concat(F.lit("__"), F.col("tgt_lang"), F.lit("__ "), F.col(col)))


def temperature_weights(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """``pair, n, weight`` with weight proportional to ``(n/N)^(1/T)``; one row per pair."""
    counts = df.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    # over one row per pair
    every = Window.partitionBy()
    raw = F.pow(F.col("n") / F.sum("n").over(every), F.lit(1.0 / temperature))
    return counts.withColumn("_raw", raw).select("pair", "n", (F.col("_raw") / F.sum("_raw").over(every)).alias("weight"))


def exact_shares(weights: DataFrame, budget: int) -> DataFrame:
    """``pair, n, share``: the budget cut into whole numbers that add up to it; what rounding down leaves goes to the largest remainders, then by pair."""
    # over one row per pair
    every = Window.partitionBy()
    wanted = F.col("weight") * F.lit(float(budget))
    floored = weights.withColumn("_whole", F.floor(wanted + 1e-9)).withColumn("_rest", F.round(wanted - F.col("_whole"), 9))
    left = F.lit(budget) - F.sum("_whole").over(every)
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), "pair"))
    return floored.select("pair", "n", (F.col("_whole") + (place <= left).cast("long")).alias("share"))


def temperature_sample(df: DataFrame, weights: DataFrame, budget: int, seed: int = 1) -> DataFrame:
    """Repeat or thin each pair to exactly its share of ``budget``; ``copy`` numbers the copies of a row.

    Every row is taken as often as its pair's rows go into the share, and those with the smallest hashes once more until the share is
    full. Which hash is the last one is found without sorting a pair: rows are counted by pair and the first four digits of the
    hash, and only the rows of the one prefix in which the share ends are put in order. ``df`` is read three times, twice only its
    ``pair`` and ``line_no``, which must be unique together; the plan has one row per pair. A pair without weight is left out.
    """
    key = F.md5(F.concat_ws(SEPARATOR, F.lit(str(seed)), F.col("pair"), F.col("line_no").cast("string")))
    shares = exact_shares(weights, budget).select(
        "pair", F.expr("share div n").alias("_copies"), (F.col("share") % F.col("n")).alias("_more"))
    keyed = df.select("pair", "line_no", key.alias("_key")).withColumn("_prefix", hash_block(F.col("_key")))
    counts = keyed.groupBy("pair", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    # over at most 65,536 prefixes of a pair
    before = F.sum("_n").over(Window.partitionBy("pair").orderBy("_prefix")) - F.col("_n")
    ends = counts.withColumn("_before", before).join(F.broadcast(shares), "pair").where("_before < _more AND _more <= _before + _n")
    ends = ends.select("pair", "_prefix", (F.col("_more") - F.col("_before")).alias("_place"))
    at_end = keyed.join(F.broadcast(ends), ["pair", "_prefix"])
    place = F.row_number().over(Window.partitionBy("pair").orderBy("_key", "line_no"))
    last = at_end.withColumn("_nr", place).where("_nr = _place").select("pair", F.struct("_key", "line_no").alias("_last"))
    plan = staged(shares.join(last, "pair", "left"), "mixing-plan")
    drawn = df.join(F.broadcast(plan), "pair")
    once_more = F.coalesce(F.struct(key.alias("_key"), "line_no") <= F.col("_last"), F.lit(False))
    times = (F.col("_copies") + once_more.cast("long")).cast("int")
    drawn = drawn.withColumn("_times", times).where("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return drawn.drop("_copies", "_more", "_last", "_times")


# Batches ---------------------------------------------------------------------------------------


def token_batches(df: DataFrame, max_tokens: int = 12_000, max_sents: int | None = None, length_step: int = 8,
                  length: Column | None = None) -> DataFrame:
    """``bucket, batch``: sequences of one pair and padded length, at most ``max_tokens`` padded tokens each.

    The padded length is rounded up to ``length_step``. A sequence longer than the
    budget gets a batch of its own.
    """
    size = length if length is not None else F.greatest(F.size("src_ids"), F.size("tgt_ids"))
    bucketed = df.withColumn("bucket", (F.ceil(F.greatest(size, F.lit(1)) / length_step) * length_step).cast("int"))
    indexed = number_rows(bucketed, ["pair", "bucket"], ["line_no"], range_block(F.col("line_no")), "_idx")
    rows = F.greatest(F.floor(F.lit(max_tokens) / F.col("bucket")), F.lit(1))
    if max_sents is not None:
        rows = F.least(rows, F.lit(max_sents))
    return indexed.withColumn("batch", F.floor(F.col("_idx") / rows).cast("long")).drop("_idx")


@dataclass(frozen=True)
class _Stretch:
    """Sequences of one length, ``low`` to ``high - 1`` in their order: every ``size`` of them are a batch, the first of which is ``first``."""

    length: int
    low: int
    high: int
    first: int
    size: int


def batch_plan(lengths: list[tuple[int, int]], max_tokens: int, max_sents: int, multiple: int = 1) -> list[_Stretch]:
    """Where batches begin when sequences in length order fill them one after the other, from ``length, count`` alone.

    A batch takes sequences while their number times the longest stays within ``max_tokens`` and their number within
    ``max_sents``; if there are ``multiple`` or more, it keeps the largest multiple of that, and the rest opens the next batch.
    The last batch keeps all it has. A sequence longer than ``max_tokens`` is a batch of its own.

    While a batch stays among sequences of one length its size depends on that length only, so all such batches are one
    stretch; only batches that cross to longer sequences are followed one by one. The work and the plan are bounded by the number of lengths times
    ``max_sents``, not by the number of sequences.
    """
    def most(length: int) -> int:
        return min(max_sents, max_tokens // length) if length else max_sents

    lengths = sorted(lengths)
    starts = [0]
    for _, n in lengths:
        starts.append(starts[-1] + n)
    total, plan = starts[-1], []
    at = batch = k = 0
    while at < total:
        while starts[k + 1] <= at:
            k += 1
        length, end = lengths[k][0], starts[k + 1]
        full = max(1, most(length))
        size = full - full % multiple if full >= multiple else full
        # the batch after these is decided within this length too: it is known to be full before the length ends
        inside = max(0, (end - at - full - 1) // size + 1) if end - at > full else 0
        if inside:
            plan.append(_Stretch(length, at - starts[k], at - starts[k] + inside * size, batch, size))
            at, batch = at + inside * size, batch + inside
            continue
        took, j = 0, k
        while j < len(lengths) and took < max_sents:
            room = max(0, most(lengths[j][0]) - took) if took else max(1, most(lengths[j][0]))
            have = starts[j + 1] - max(at, starts[j])
            took += min(room, have)
            if room < have:
                break
            j += 1
        if at + took < total and took >= multiple:
            took -= took % multiple
        j, left = k, took
        while left:
            low = max(at, starts[j]) - starts[j]
            part = min(left, starts[j + 1] - starts[j] - low)
            plan.append(_Stretch(lengths[j][0], low, low + part, batch, part))
            left, j = left - part, j + 1
        at, batch = at + took, batch + 1
    return plan


def sorted_token_batches(df: DataFrame, max_tokens: int = 12_000, max_sents: int = 128, multiple: int = 8, order: tuple[str, ...] = ("pair", "line_no"),
                         block: Column | None = None, length: Column | None = None) -> DataFrame:
    """``length, batch``: sequences of the whole set ordered by length, then ``order``, and filled into batches as ``batch_plan`` does.

    Nothing is sorted or summed over the whole set: the counts by length, at most as many as there are lengths, give the
    plan, and a sequence needs only its number among those of its length, which ``number_rows`` finds block by block. ``block`` must grow with
    ``order``, which must be unique. ``df`` is read twice.

    Defined results: null ids count as none; an empty sequence costs no tokens; an empty table gives no rows.
    """
    if max_tokens < 1 or max_sents < 1 or multiple < 1:
        raise ValueError("max_tokens, max_sents and multiple are at least 1")
    size = length if length is not None else F.greatest(F.size("src_ids"), F.size("tgt_ids"))
    sized = df.withColumn("length", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("int"))
    block = block if block is not None else F.concat_ws(SEPARATOR, F.col(order[0]), F.lpad(range_block(F.col(order[-1])).cast("string"), 19, "0"))
    counts = [(r["length"], r["count"]) for r in sized.groupBy("length").count().collect()]
    plan = [(s.length, s.low, s.high, s.first, s.size) for s in batch_plan(counts, max_tokens, max_sents, multiple)]
    starts = df.sparkSession.createDataFrame(plan, "length int, _low long, _high long, _first long, _size long")
    placed = number_rows(sized, ["length"], list(order), block, "_place", 1)
    # a length has few stretches, and both numbers are bounded by the longest sequence and the largest batch
    by_length = starts.groupBy("length").agg(F.collect_list(F.struct("_low", "_high", "_first", "_size")).alias("_plan"))
    own = F.filter("_plan", lambda s: (F.col("_place") >= s["_low"]) & (F.col("_place") < s["_high"]))[0]
    found = placed.join(F.broadcast(by_length), "length").withColumn("_own", own)
    batch = F.col("_own._first") + F.floor((F.col("_place") - F.col("_own._low")) / F.col("_own._size"))
    return found.withColumn("batch", batch.cast("long")).drop("_plan", "_own", "_place")


def worker_slice(df: DataFrame, num_shards: int, shard_id: int) -> DataFrame:
    """The batches of one worker out of ``num_shards``."""
    return df.where(F.pmod("batch", F.lit(num_shards)) == shard_id)
