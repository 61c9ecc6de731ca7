"""Cleaning of bitext."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.fixed_values import PUNCTUATION, STRIP_CHARACTERS
from tandem.functions.text import count_punct, strip, words
from tandem.operators import cleaning as c
from tandem.plans.clean import clean_corpus as clean_plan
from tandem.plans.clean import stage_counts as stage_plan
from workload import tables as t
from workload.registry import query, view


def _chars(text: str) -> str:
    return " || ".join(f"chr({ord(ch)})" for ch in text)


WS = _chars(STRIP_CHARACTERS)
PUNCT = _chars(PUNCTUATION)
view("sets", f"SELECT {WS} AS ws, {PUNCT} AS punct")


def sql_punct(col: str) -> str:
    return f"(length({col}) - length(translate({col}, punct, '')))"


@query("strip_text", "SELECT doc_id, line_no, trim(' ' || chr(12288) || line || chr(8195) || chr(9), ws) AS stripped, trim(line, ws) AS plain FROM lines, sets")
def strip_text(spark, sf):
    framed = F.concat(F.lit(" 　"), F.col("line"), F.lit(" \t"))
    return t.lines(spark, sf).select("doc_id", "line_no", strip(framed).alias("stripped"), strip(F.col("line")).alias("plain"))


@query("punct_count", f"SELECT page_id, line_no, length(seg) AS n, {sql_punct('seg')} AS n_punct FROM seg, sets")
def punct_count(spark, sf):
    return t.seg(spark, sf).select("page_id", "line_no", F.length("seg").cast("long").alias("n"), count_punct(F.col("seg")).cast("long").alias("n_punct"))


@query("punct_filter", f"SELECT page_id, line_no, seg FROM seg, sets WHERE {sql_punct('seg')} < 0.5 * length(seg)")
def punct_filter(spark, sf):
    return c.filter_overpunct(t.seg(spark, sf), 0.5, ("seg",)).select("page_id", "line_no", "seg")


@query("dedup_pairs", "SELECT pair, src, tgt, min(line_no) AS line_no FROM adj GROUP BY pair, src, tgt")
def dedup_pairs(spark, sf):
    return c.dedup_pairs(t.adj(spark, sf)).select("pair", "src", "tgt", "line_no")


@query("shuffle_order", """
  SELECT pair, line_no, row_number() OVER (PARTITION BY pair ORDER BY md5('7' || chr(1) || pair || chr(1) || line_no || chr(1) || src || chr(1) || tgt), line_no) - 1 AS position
  FROM bitext""")
def shuffle_order(spark, sf):
    return c.shuffle_positions(t.bitext(spark, sf), 7).select("pair", "line_no", "position")


view("char_hist", """
  SELECT lang, ch, cnt, run / total AS cum_share, run - cnt < 0.99 * total AS keep FROM (
    SELECT *, CAST(sum(cnt) OVER (PARTITION BY lang ORDER BY cnt DESC, ch) AS DOUBLE) AS run, CAST(sum(cnt) OVER (PARTITION BY lang) AS DOUBLE) AS total
    FROM (SELECT lang, ch, count(*) AS cnt FROM (SELECT lang, unnest(string_split(line, '')) AS ch FROM lines) WHERE ch <> '' GROUP BY lang, ch))""")


@query("char_histogram", "SELECT lang, ch, cnt, floor(cum_share * 1e6 + 0.5) / 1e6 AS cum_share, keep FROM char_hist")
def char_histogram(spark, sf):
    texts = t.lines(spark, sf).select("lang", F.col("line").alias("text"))
    return c.build_char_histogram(texts).select("lang", "ch", "cnt", t.r6(F.col("cum_share")).alias("cum_share"), "keep")


def accepted(hist: str) -> str:
    return f"SELECT lang, string_agg(ch, '' ORDER BY ch) AS chars FROM {hist} WHERE keep GROUP BY lang"


def hist_ok(side: str) -> str:
    return f"length({side}) > 0 AND length({side}) - length(translate({side}, coalesce(h_{side}.chars, ''), '')) >= {{th}} * length({side})"


view("accepted", accepted("char_hist"))


@query("histogram_filter", f"""
  SELECT pair, line_no FROM bitext LEFT JOIN accepted h_src ON h_src.lang = src_lang LEFT JOIN accepted h_tgt ON h_tgt.lang = tgt_lang
  WHERE {hist_ok('src').format(th=0.985)} AND {hist_ok('tgt').format(th=0.985)}""")
def histogram_filter(spark, sf):
    hist = c.build_char_histogram(t.lines(spark, sf).select("lang", F.col("line").alias("text")))
    return c.filter_by_histogram(t.bitext(spark, sf), hist, 0.985).select("pair", "line_no")


WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
view("word_adj", f"SELECT *, len({WORDS.format('src')}) AS n_src, len({WORDS.format('tgt')}) AS n_tgt FROM adj")


def _worded(df):
    return df.withColumns({"src_pieces": words(F.col("src")), "tgt_pieces": words(F.col("tgt"))})


@query("length_filter", "SELECT pair, line_no, n_src, n_tgt FROM word_adj WHERE n_src BETWEEN 1 AND 250 AND n_tgt BETWEEN 1 AND 250")
def length_filter(spark, sf):
    kept = c.filter_length(_worded(t.adj(spark, sf)), 1, 250)
    return kept.select("pair", "line_no", F.size("src_pieces").cast("long").alias("n_src"), F.size("tgt_pieces").cast("long").alias("n_tgt"))


@query("ratio_filter", "SELECT pair, line_no FROM word_adj WHERE greatest(n_src, n_tgt) <= 3 * least(n_src, n_tgt)")
def ratio_filter(spark, sf):
    return c.filter_ratio(_worded(t.adj(spark, sf)), 3).select("pair", "line_no")


# The whole chain runs on neighbouring lines and on page segments together: the first has
# copies, the second has text of punctuation.
view("dirty", """
  SELECT pair, src_lang, tgt_lang, line_no, src, tgt FROM adj
  UNION ALL SELECT pair, src_lang, tgt_lang, line_no, src, tgt FROM bitext
  UNION ALL SELECT 'html-next', 'html', 'html', page_id * 1000000 + line_no, seg, nxt FROM (
    SELECT *, lead(seg) OVER (PARTITION BY page_id ORDER BY line_no) AS nxt FROM seg) WHERE nxt IS NOT NULL""")


def dirty(spark, sf):
    page = t.load(spark, sf, "pages").select("page_id", F.split("html", ">").alias("l")).where("size(l) > 1")
    shifted = page.withColumn("n", F.slice("l", F.lit(2), F.size("l") - 1))
    rows = shifted.select("page_id", F.posexplode(F.arrays_zip("l", "n")).alias("p", "x")).where(F.col("x.n").isNotNull())
    html = rows.select(F.lit("html-next").alias("pair"), F.lit("html").alias("src_lang"), F.lit("html").alias("tgt_lang"),
                       (F.col("page_id") * t.LINE_STEP + F.col("p") + 1).alias("line_no"), F.col("x.l").alias("src"), F.col("x.n").alias("tgt"))
    return t.adj(spark, sf).unionByName(t.bitext(spark, sf)).unionByName(html)


view("stripped", f"""
  SELECT *, {sql_punct('src')} < 0.5 * length(src) AND {sql_punct('tgt')} < 0.5 * length(tgt) AS punct_ok
  FROM (SELECT pair, src_lang, tgt_lang, line_no, trim(src, ws) AS src, trim(tgt, ws) AS tgt FROM dirty, sets), sets""")
view("deduped", """
  SELECT pair, src_lang, tgt_lang, src, tgt, min(line_no) AS line_no FROM stripped WHERE punct_ok GROUP BY ALL""")
view("clean_hist", """
  SELECT lang, ch, run - cnt < 0.99 * total AS keep FROM (
    SELECT *, CAST(sum(cnt) OVER (PARTITION BY lang ORDER BY cnt DESC, ch) AS DOUBLE) AS run, CAST(sum(cnt) OVER (PARTITION BY lang) AS DOUBLE) AS total
    FROM (SELECT lang, ch, count(*) AS cnt FROM (
      SELECT src_lang AS lang, unnest(string_split(src, '')) AS ch FROM deduped UNION ALL SELECT tgt_lang, unnest(string_split(tgt, '')) FROM deduped)
      WHERE ch <> '' GROUP BY lang, ch))""")
view("clean_set", accepted("clean_hist"))
view("hist_flagged", f"""
  SELECT d.*, {hist_ok('src').format(th=0.95)} AND {hist_ok('tgt').format(th=0.95)} AS hist_ok FROM deduped d
  LEFT JOIN clean_set h_src ON h_src.lang = src_lang LEFT JOIN clean_set h_tgt ON h_tgt.lang = tgt_lang""")


def _config(spark, sf):
    from tandem.plans.clean import CleanConfig

    return CleanConfig(threshold=0.95, tasks=2 * t.document_tasks(spark, sf))


@query("clean_corpus", "SELECT pair, src_lang, tgt_lang, line_no, src, tgt FROM hist_flagged WHERE hist_ok")
def clean_corpus(spark, sf):
    return clean_plan(dirty(spark, sf), _config(spark, sf))


@query("stage_counts", """
  SELECT pair, n_read, n_punct, n_dedup, n_clean FROM
    (SELECT pair, count(*) AS n_read, count(*) FILTER (punct_ok) AS n_punct FROM stripped GROUP BY pair)
    LEFT JOIN (SELECT pair, count(*) AS n_dedup, count(*) FILTER (hist_ok) AS n_clean FROM hist_flagged GROUP BY pair) USING (pair)""")
def stage_counts(spark, sf):
    return stage_plan(dirty(spark, sf), _config(spark, sf))
