"""Running a model over rows, and the tagged generation records around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.text import strip_lang_tag, to_base2
from tandem.operators.numbering import number_rows
from tandem.session import staged

_LOADED: dict[str, Any] = {}
#: Samples of one direction that are put in order in one task.
LOG_SAMPLES = 1 << 14


def apply_model(df: DataFrame, load: Callable[[], Any], predict: Callable[[Any, pd.DataFrame], pd.DataFrame],
                schema: str, batch_size: int = 100, model_key: str | None = None) -> DataFrame:
    """Run ``predict(model, batch)`` over all rows, all directions together.

    ``load`` runs inside the worker, once per task, or once per worker process when
    a ``model_key`` names the model. Batches hold at most ``batch_size`` rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model_key is None:
            model = load()
        else:
            if model_key not in _LOADED:
                _LOADED[model_key] = load()
            model = _LOADED[model_key]
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                yield predict(model, frame.iloc[start:start + batch_size])

    return df.mapInPandas(run, schema)


def nbest(df: DataFrame, n: int = 1, keys: tuple[str, ...] = ("pair", "sample_id")) -> DataFrame:
    """The best ``n`` candidates per sample as ``rank`` 1..n; a sample has at most a beam of them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "cand")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def nbest_of_beams(df: DataFrame, n: int = 1, keys: tuple[str, ...] = ("pair", "sample_id"), beam: str = "beam") -> DataFrame:
    """``nbest`` of rows that hold a beam: an array of structs with ``cand``, ``score`` and more.

    A row keeps its own best ``n`` before anything is shuffled or sorted; the candidates of a sample that stands in several rows still compete.
    """
    def place(c):
        # as a descending sort has it: NaN before all numbers, null behind them
        return F.struct(c["score"].isNull().alias("none"), (~F.isnan(c["score"])).alias("number"), (-c["score"]).alias("score"), c["cand"].alias("cand"), c.alias("c"))

    best = F.transform(F.slice(F.sort_array(F.transform(beam, place)), 1, n), lambda x: x["c"])
    rest = [c for c in df.columns if c != beam]
    return nbest(df.select(*rest, F.inline(best)), n, keys)


def score_base2(df: DataFrame) -> DataFrame:
    """Scores and positional scores from natural log to base 2."""
    return df.withColumns({
        "score": to_base2(F.col("score")), "positional": F.transform("positional", lambda x: to_base2(x)),
    })


def emit_records(df: DataFrame, score_format: str | None = None) -> DataFrame:
    """``pair, sample_id, seq, kind, line`` of each sample.

    Input: ``src, tgt`` and ``hyps`` (array of struct ``score, text, detok, positional``
    with base-2 scores, and optionally ``alignment``, ``steps``, ``history``). Scores are
    printed as they are unless ``score_format`` is given; positional scores get 4 decimals.
    An ``alignment`` of structs ``src, tgt`` is printed as linked positions, one of number arrays
    as soft alignment: a list of source weights for each target token.
    """
    sid = F.col("sample_id").cast("string")

    def score(value):
        return F.format_string(score_format, value) if score_format else value.cast("string")

    fields = {f.name: f.dataType for f in df.schema["hyps"].dataType.elementType.fields}
    soft = "alignment" in fields and fields["alignment"].elementType.typeName() == "array"

    def aligned(p):
        if soft:
            return F.array_join(F.transform(p, lambda weight: weight.cast("string")), ",")
        return F.concat_ws("-", p["src"].cast("string"), p["tgt"].cast("string"))

    def line(kind, *parts):
        return F.struct(F.lit(kind).alias("kind"), F.concat_ws("\t", F.concat(F.lit(kind + "-"), sid), *parts).alias("line"))

    def of_hyp(h):
        positional = F.array_join(F.transform(h["positional"], lambda x: F.format_string("%.4f", x)), " ")
        lines = [line("H", score(h["score"]), h["text"]), line("D", score(h["score"]), h["detok"]), line("P", positional)]
        if "alignment" in fields:
            lines.append(line("A", F.array_join(F.transform(h["alignment"], aligned), " ")))
        if "steps" in fields:
            lines.append(line("I", h["steps"].cast("string")))
        out = F.array(*lines)
        if "history" in fields:
            out = F.concat(out, F.transform(h["history"], lambda t, i: F.struct(
                F.lit("E").alias("kind"),
                F.concat(F.lit("E-"), sid, F.lit("_"), i.cast("string"), F.lit("\t"), t).alias("line"))))
        return out

    lines = F.concat(F.array(line("S", F.col("src")), line("T", F.col("tgt"))), F.flatten(F.transform("hyps", of_hyp)))
    return df.select("pair", "sample_id", F.posexplode(lines).alias("seq", "_x")).select(
        "pair", "sample_id", "seq", "_x.kind", "_x.line"
    )


def result_string(bleu: DataFrame) -> DataFrame:
    """``pair, result`` from the counts of ``corpus_bleu``: score, precisions of the orders, brevity, lengths."""
    orders = [n for n in range(1, 10) if f"match{n}" in bleu.columns]
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision = [F.format_string("%.1f", part(100.0 * F.col(f"match{n}"), F.col(f"hyp{n}"))) for n in orders]
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    ratio = part(sys_len, ref_len)
    brevity = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len == 0, F.lit(0.0)).otherwise(F.exp(1 - ref_len / sys_len))
    return bleu.select("pair", F.concat(
        F.lit(f"BLEU{len(orders)} = "), F.format_string("%.2f", "bleu"), F.lit(", "), F.concat_ws("/", *precision),
        F.lit(" (BP="), F.format_string("%.3f", brevity), F.lit(", ratio="), F.format_string("%.3f", ratio),
        F.lit(", syslen="), sys_len.cast("string"), F.lit(", reflen="), ref_len.cast("string"), F.lit(")")).alias("result"))


def close_records(records: DataFrame, results: DataFrame, subset: str = "test", beam: int = 5) -> DataFrame:
    """The records and behind the samples of each direction one line with its result; a direction without a result has none.

    The closing line has neither kind nor sample, and as ``seq`` 0; in a log it follows the last sample. One row per direction
    is added, so the records are neither shuffled nor sorted for it. The results are written once: numbering reads the records
    twice, and would otherwise score all samples twice.
    """
    results = staged(results, "results")
    told = F.concat(F.lit(f"Generate {subset} with beam={beam}: "), F.col("result"))
    closing = results.select("pair", F.lit(None).cast("long").alias("sample_id"), F.lit(0).alias("seq"),
                             F.lit(None).cast("string").alias("kind"), told.alias("line"))
    return records.select("pair", "sample_id", "seq", "kind", "line").unionByName(closing)


def generation_log(closed: DataFrame) -> DataFrame:
    """``pair, line_no, line``: records with their closing lines, numbered in the order of a log.

    Samples come by number, below 2**43 - 1; a block of numbers is sorted in one task, never a direction.
    """
    # a sample's number leaves room below it for its lines; the closing line stands behind all numbers, whatever the last one is
    span = F.lit(1 << 20)
    behind = F.lit((1 << 43) - 1)
    sample = F.coalesce(F.col("sample_id"), behind)
    placed = closed.withColumn("_at", sample * span + F.col("seq"))
    numbered = number_rows(placed, ["pair"], ["_at"], F.floor(sample / LOG_SAMPLES).cast("long"), "line_no")
    return numbered.select("pair", "line_no", "line")


def generation_counters(df: DataFrame) -> DataFrame:
    """Sentences and generated tokens per direction from ``hyps`` (the first of each sample), and seconds if given."""
    aggs = [F.count(F.lit(1)).alias("sentences"), F.sum(F.size("tokens")).alias("generated_tokens")]
    if "seconds" in df.columns:
        aggs.append((F.sum(F.size("tokens")) / F.sum("seconds")).alias("tokens_per_second"))
    return df.groupBy("pair").agg(*aggs)


def parse_records(df: DataFrame) -> DataFrame:
    """``pair, line_no, kind, sample_id, score, text`` of the tagged lines; other lines are dropped.

    Tabs inside the text survive: a line is cut only as often as its kind has fields.
    """
    tag = r"^([STHDPAIE])-(\d+)"
    kind, sid = F.regexp_extract("line", tag, 1), F.regexp_extract("line", tag, 2)
    scored = F.col("kind").isin("H", "D")
    three, two = F.split("line", "\t", 3), F.split("line", "\t", 2)
    tagged = df.withColumns({"kind": kind, "_sid": sid}).where(F.col("kind") != "")
    return tagged.select(
        "pair", "line_no", "kind", F.col("_sid").cast("long").alias("sample_id"),
        F.when(scored, F.get(three, F.lit(1)).try_cast("double")).alias("score"),
        F.when(scored, F.get(three, F.lit(2))).otherwise(F.get(two, F.lit(1))).alias("text"),
    )


def align_hyp_ref(records: DataFrame) -> DataFrame:
    """``pair, sample_id, src, hyp, ref`` of samples that have all three.

    The three kinds meet in one aggregate, not in joins. As the lines are dealt by sample before it, the log is shuffled
    and sorted once, and both halves of the aggregate run through the sorted lines. Of several hypotheses the first line counts.
    """
    def first(kind: str):
        return F.min_by("text", F.when(F.col("kind") == kind, F.col("line_no")))

    slim = records.where(F.col("kind").isin("S", "H", "T")).select("pair", "sample_id", "kind", "line_no", "text")
    wide = slim.repartition("pair", "sample_id").groupBy("pair", "sample_id").agg(
        first("S").alias("src"), first("H").alias("hyp"), first("T").alias("ref")
    )
    complete = F.col("src").isNotNull() & F.col("hyp").isNotNull() & F.col("ref").isNotNull()
    return wide.where(complete).withColumn("src", strip_lang_tag(F.col("src")))
