"""Generation records and scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tandem.fixed_values import STRIP_CHARACTERS
from tandem.functions.text import strip_lang_tag as strip_tag
from tandem.operators import metrics as m
from tandem.operators import records as r
from tandem.plans import evaluate as plan
from workload import tables as t
from workload.registry import query, view

# Model harness ---------------------------------------------------------------------------------


@query("apply_model", "SELECT pair, sample_id, replace(hyp, 'e', '_E') AS output, CAST(length(hyp) AS BIGINT) AS n FROM hr")
def apply_model(spark, sf):
    """A stand-in model: rewrites one letter."""

    def load():
        return {"e": "_E"}

    def predict(model, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pair": batch["pair"], "sample_id": batch["sample_id"],
                             "output": batch["hyp"].replace(model, regex=True), "n": batch["hyp"].str.len()})

    rows = t.hr(spark, sf).select("pair", "sample_id", "hyp")
    return r.apply_model(rows, load, predict, "pair string, sample_id long, output string, n long", 64)


@query("nbest", """
  SELECT pair, sample_id, cand, CAST(rank AS INTEGER) AS rank, score FROM (
    SELECT *, row_number() OVER (PARTITION BY pair, sample_id ORDER BY score DESC, cand) AS rank FROM hypotheses) WHERE rank <= 2""")
def nbest(spark, sf):
    return r.nbest(t.hypotheses(spark, sf), 2).select("pair", "sample_id", "cand", "rank", "score")


POSITIONAL = "list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: -length(w) / 10.0)"


def _positional():
    return F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: -F.length(w) / F.lit(10.0))


@query("score_base2", f"""
  SELECT pair, sample_id, cand, floor(score / ln(2) * 1e6 + 0.5) / 1e6 AS score, CAST(len(p) AS INTEGER) AS n,
         md5(array_to_string(list_transform(p, lambda x: CAST(CAST(floor(x / ln(2) * 1e4 + 0.5) AS BIGINT) AS VARCHAR)), ' ')) AS positional
  FROM (SELECT *, {POSITIONAL} AS p FROM hypotheses)""")
def score_base2(spark, sf):
    df = r.score_base2(t.hypotheses(spark, sf).withColumn("positional", _positional()))
    whole = F.array_join(F.transform("positional", lambda x: F.floor(x * 1e4 + 0.5).cast("string")), " ")
    return df.select("pair", "sample_id", "cand", t.r6(F.col("score")).alias("score"), F.size("positional").alias("n"), F.md5(whole).alias("positional"))


view("emitted", """
  SELECT pair, sample_id, cand, text, ref, format('{:.4f}', score / ln(2)) AS s,
         array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: format('{:.4f}', -length(w) / 10.0 / ln(2))), ' ') AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY pair, sample_id ORDER BY score DESC, cand) AS rank FROM hypotheses) WHERE rank = 1""")


@query("emit_records", """
  SELECT pair, sample_id, CAST(k AS INTEGER) AS seq, substr('STHDP', k + 1, 1) AS kind,
    CASE k WHEN 0 THEN 'S-' || sample_id || chr(9) || ref WHEN 1 THEN 'T-' || sample_id || chr(9) || ref
           WHEN 2 THEN 'H-' || sample_id || chr(9) || s || chr(9) || text WHEN 3 THEN 'D-' || sample_id || chr(9) || s || chr(9) || text
           ELSE 'P-' || sample_id || chr(9) || p END AS line
  FROM emitted, (SELECT unnest([0, 1, 2, 3, 4]) AS k)""")
def emit_records(spark, sf):
    best = r.nbest_of_beams(t.beams(spark, sf), 1).withColumn("positional", _positional())
    best = r.score_base2(best)
    hyp = F.struct("score", "text", F.col("text").alias("detok"), "positional")
    rows = best.select("pair", "sample_id", F.col("ref").alias("src"), F.col("ref").alias("tgt"), F.array(hyp).alias("hyps"))
    return r.emit_records(rows, "%.4f")


view("emitted_words", """
  SELECT *, list_filter(string_split(ref, ' '), lambda w: w <> '') AS sw, list_filter(string_split(text, ' '), lambda w: w <> '') AS tw FROM emitted""")


@query("emit_aligned", """
  SELECT pair, sample_id, CAST(k AS INTEGER) AS seq, substr('STHDPAIEE', k + 1, 1) AS kind,
    CASE k WHEN 0 THEN 'S-' || sample_id || chr(9) || ref WHEN 1 THEN 'T-' || sample_id || chr(9) || ref
           WHEN 2 THEN 'H-' || sample_id || chr(9) || s || chr(9) || text WHEN 3 THEN 'D-' || sample_id || chr(9) || s || chr(9) || text
           WHEN 4 THEN 'P-' || sample_id || chr(9) || p
           WHEN 5 THEN 'A-' || sample_id || chr(9) || array_to_string(list_transform(list_zip(tw, sw), lambda z:
             (1000 * coalesce(length(z[2]), 0)) // (length(ref) + coalesce(length(z[1]), 0)) || ',' ||
             (1000 - (1000 * coalesce(length(z[2]), 0)) // (length(ref) + coalesce(length(z[1]), 0)))), ' ')
           WHEN 6 THEN 'I-' || sample_id || chr(9) || len(tw)
           WHEN 7 THEN 'E-' || sample_id || '_0' || chr(9) || ref ELSE 'E-' || sample_id || '_1' || chr(9) || text END AS line
  FROM emitted_words, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS k)""")
def emit_aligned(spark, sf):
    """Records with soft alignment, steps and history: two weights a word, in thousandths, as a full matrix would grow with the square of a line."""
    best = r.score_base2(r.nbest_of_beams(t.beams(spark, sf), 1).withColumn("positional", _positional()))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    best = best.withColumns({"_sw": words("ref"), "_tw": words("text")})
    size = lambda w: F.coalesce(F.length(w), F.lit(0))
    # the one-element array binds the length of the line, which would otherwise be counted again for every word
    shares = F.transform(F.array(size("ref")), lambda n: F.zip_with("_tw", "_sw", lambda y, x: F.floor(1000 * size(x) / (n + size(y)))))[0]
    weights = F.transform(shares, lambda w: F.array(w, 1000 - w))
    hyp = F.struct("score", "text", F.col("text").alias("detok"), "positional", weights.alias("alignment"), F.size("_tw").alias("steps"),
                   F.array("ref", "text").alias("history"))
    return r.emit_records(best.select("pair", "sample_id", F.col("ref").alias("src"), F.col("ref").alias("tgt"), F.array(hyp).alias("hyps")), "%.4f")


@query("generation_counters", """
  SELECT pair, count(*) AS sentences, CAST(sum(len(list_filter(string_split(hyp, ' '), lambda w: w <> ''))) AS BIGINT) AS generated_tokens
  FROM hr GROUP BY pair""")
def generation_counters(spark, sf):
    rows = t.hr(spark, sf).select("pair", F.filter(F.split("hyp", " "), lambda w: w != "").alias("tokens"))
    return r.generation_counters(rows)


view("parsed", """
  SELECT pair, line_no, kind, sample_id, CASE WHEN kind = 'H' THEN CAST(split_part(line, chr(9), 2) AS DOUBLE) END AS score,
         CASE WHEN kind = 'H' THEN substr(rest, strpos(rest, chr(9)) + 1) ELSE rest END AS text
  FROM (SELECT *, substr(line, 1, 1) AS kind, CAST(regexp_extract(line, '^[A-Z]-([0-9]+)', 1) AS BIGINT) AS sample_id,
               substr(line, strpos(line, chr(9)) + 1) AS rest FROM gen_log WHERE regexp_matches(line, '^[STHDPAIE]-[0-9]+'))""")


@query("parse_records", "SELECT pair, line_no, kind, sample_id, score, text FROM parsed")
def parse_records(spark, sf):
    return r.parse_records(t.gen_log(spark, sf))


@query("strip_lang_tag", "SELECT pair, sample_id, regexp_replace('a ' || '__' || tgt_lang || '__ ' || ref || ' __x_Y__ z', '__[a-zA-Z_]*__ ', '') AS line FROM hr")
def strip_lang_tag(spark, sf):
    tagged = F.concat(F.lit("a __"), F.col("tgt_lang"), F.lit("__ "), F.col("ref"), F.lit(" __x_Y__ z"))
    return t.hr(spark, sf).select("pair", "sample_id", strip_tag(tagged).alias("line"))


@query("align_hyp_ref", """
  SELECT s.pair, s.sample_id, regexp_replace(s.text, '__[a-zA-Z_]*__ ', '') AS src, h.text AS hyp, g.text AS ref
  FROM parsed s JOIN parsed h USING (pair, sample_id) JOIN parsed g USING (pair, sample_id)
  WHERE s.kind = 'S' AND h.kind = 'H' AND g.kind = 'T'""")
def align_hyp_ref(spark, sf):
    return r.align_hyp_ref(r.parse_records(t.gen_log(spark, sf)))


# Tokenised lines: punctuation set apart, and an apostrophe after a vowel before the next word.
_APART = r"([,.;:!?])"
view("tokenized", r"""
  SELECT doc_id, line_no, lang, regexp_replace(regexp_replace(line, '([,.;:!?])', ' \1', 'g'), '([aeiou]) (h[a-z])', '\1'' \2', 'g') AS line FROM lines""")
_ATTACH = "regexp_replace({0}, ' +([,.?!:;%)]+)( |$)', '\\1\\2', 'g')"
_ATTACH_FR = "regexp_replace({0}, ' +([,.)]+)( |$)', '\\1\\2', 'g')"


def _repeat(rule: str, text: str, times: int) -> str:
    for _ in range(times):
        text = rule.format(text)
    return text


@query("detokenize", f"""
  SELECT doc_id, line_no, trim(regexp_replace(CASE WHEN lang = 'fr' THEN regexp_replace(f, '([[:alpha:]]'') +([[:alpha:]])', '\\1\\2', 'g') ELSE f END, ' +', ' ', 'g'), ' ') AS line FROM (
    SELECT doc_id, line_no, lang, CASE WHEN lang = 'fr' THEN {_repeat(_ATTACH_FR, 'line', 4)}
      WHEN lang = 'en' THEN regexp_replace({_repeat(_ATTACH, 'line', 4)}, ' +(''[[:alpha:]])', '\\1', 'g')
      ELSE {_repeat(_ATTACH, 'line', 4)} END AS f FROM tokenized)""")
def detokenize(spark, sf):
    apart = F.regexp_replace("line", _APART, " $1")
    tokenized = F.regexp_replace(apart, "([aeiou]) (h[a-z])", "$1' $2")
    rows = t.lines(spark, sf).select("doc_id", "line_no", "lang", tokenized.alias("line"))
    return m.detokenize(rows, ("line",), "lang").select("doc_id", "line_no", "line")


# BLEU and chrF ---------------------------------------------------------------------------------

view("sides", """
  SELECT pair, sample_id, 0 AS side, hyp AS text FROM hr UNION ALL SELECT pair, sample_id, 1, ref FROM hr""")
view("bleu_tokens", "SELECT pair, sample_id, side, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM sides")
view("bleu_grams", """
  SELECT pair, sample_id, side, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (
    SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bleu_tokens, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)""")


def _overlap(grams: str) -> str:
    return f"""
  SELECT pair, n, CAST(sum(least(h, f)) AS BIGINT) AS m, CAST(sum(h) AS BIGINT) AS h, CAST(sum(f) AS BIGINT) AS f FROM (
    SELECT pair, sample_id, n, g, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS f FROM {grams} GROUP BY ALL)
  GROUP BY pair, n"""


view("bleu_sums", _overlap("bleu_grams"))
_N4 = ", ".join(f"max(m) FILTER (n = {n}) AS match{n}, max(h) FILTER (n = {n}) AS hyp{n}" for n in range(1, 5))
_LOGS = " + ".join(f"ln(match{n} / CAST(hyp{n} AS DOUBLE))" for n in range(1, 5))


@query("corpus_bleu", f"""
  SELECT pair, hyp1 AS sys_len, ref_len, match1, hyp1, match2, hyp2, match3, hyp3, match4, hyp4,
         floor(100 * CASE WHEN hyp1 >= ref_len THEN 1.0 ELSE exp(1 - ref_len / CAST(hyp1 AS DOUBLE)) END * exp(({_LOGS}) / 4) * 1e6 + 0.5) / 1e6 AS bleu
  FROM (SELECT pair, {_N4}, max(f) FILTER (n = 1) AS ref_len FROM bleu_sums GROUP BY pair)""")
def corpus_bleu(spark, sf):
    df = m.corpus_bleu(t.hr(spark, sf), ["pair"])
    return df.withColumn("bleu", t.r6(F.col("bleu")))


_RESULT = " || '/' || ".join(f"format('{{:.1f}}', 100.0::DOUBLE * match{n} / hyp{n})" for n in range(1, 5))


view("log_sums", f"SELECT pair, {_N4}, max(f) FILTER (n = 1) AS ref_len FROM bleu_sums GROUP BY pair")
view("log_results", f"""
  SELECT pair, 'BLEU4 = ' || format('{{:.2f}}', 100 * bp * exp(({_LOGS}) / 4)) || ', ' || {_RESULT} || ' (BP=' || format('{{:.3f}}', bp)
    || ', ratio=' || format('{{:.3f}}', CAST(hyp1 AS DOUBLE) / ref_len) || ', syslen=' || hyp1 || ', reflen=' || ref_len || ')' AS result
  FROM (SELECT *, CASE WHEN hyp1 >= ref_len THEN 1.0::DOUBLE ELSE exp(1 - ref_len / CAST(hyp1 AS DOUBLE)) END AS bp FROM log_sums)""")


@query("generation_log", """
  SELECT pair, CAST(row_number() OVER (PARTITION BY pair ORDER BY sample_id NULLS LAST, k) - 1 AS BIGINT) AS line_no, line FROM (
    SELECT pair, sample_id, k, CASE k WHEN 0 THEN 'S-' || sample_id || chr(9) || ref WHEN 1 THEN 'T-' || sample_id || chr(9) || ref
             WHEN 2 THEN 'H-' || sample_id || chr(9) || '-1.0' || chr(9) || hyp WHEN 3 THEN 'D-' || sample_id || chr(9) || '-1.0' || chr(9) || hyp
             ELSE 'P-' || sample_id || chr(9) || '-0.5000' END AS line
    FROM hr, (SELECT unnest([0, 1, 2, 3, 4]) AS k)
    UNION ALL SELECT pair, NULL, 0, 'Generate test with beam=5: ' || result FROM log_results)""")
def generation_log(spark, sf):
    """The whole log of every direction: the records of its samples in order, then the line that closes it."""
    rows = t.hr(spark, sf)
    hyp = F.struct(F.lit(-1.0).alias("score"), F.col("hyp").alias("text"), F.col("hyp").alias("detok"), F.array(F.lit(-0.5)).alias("positional"))
    records = r.emit_records(rows.select("pair", "sample_id", F.col("ref").alias("src"), F.col("ref").alias("tgt"), F.array(hyp).alias("hyps")))
    return r.generation_log(r.close_records(records, r.result_string(m.corpus_bleu(rows, ["pair"]))))


_WS = " || ".join(f"chr({ord(ch)})" for ch in STRIP_CHARACTERS)
# word orders 7 and 8: a word's closing punctuation mark, or else its opening one, is a word of its own
_EDGE = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
view("chrf_words", f"""
  SELECT pair, sample_id, side, flatten(list_transform(w, lambda x: CASE
    WHEN length(x) > 1 AND contains('{_EDGE}', x[-1:]) THEN [x[:-2], x[-1:]]
    WHEN length(x) > 1 AND contains('{_EDGE}', x[1:1]) THEN [x[1:1], x[2:]] ELSE [x] END)) AS w FROM bleu_tokens""")
view("chrf_chars", f"""
  SELECT pair, sample_id, side, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM (
    SELECT pair, sample_id, side, list_filter(string_split(translate(text, ws, ''), ''), lambda x: x <> '') AS w FROM sides, (SELECT {_WS} AS ws))""")
view("chrf_runs", """
  SELECT pair, sample_id, side, c AS c1, c || lead(c, 1) OVER s AS c2, c || lead(c, 1) OVER s || lead(c, 2) OVER s AS c3,
         c || lead(c, 1) OVER s || lead(c, 2) OVER s || lead(c, 3) OVER s AS c4,
         c || lead(c, 1) OVER s || lead(c, 2) OVER s || lead(c, 3) OVER s || lead(c, 4) OVER s AS c5,
         c || lead(c, 1) OVER s || lead(c, 2) OVER s || lead(c, 3) OVER s || lead(c, 4) OVER s || lead(c, 5) OVER s AS c6
  FROM chrf_chars WINDOW s AS (PARTITION BY sample_id, side ORDER BY i)""")
view("chrf_grams", """
  SELECT pair, sample_id, side, n, g FROM (
    SELECT pair, sample_id, side, unnest([1, 2, 3, 4, 5, 6]) AS n, unnest([c1, c2, c3, c4, c5, c6]) AS g FROM chrf_runs) WHERE g IS NOT NULL
  UNION ALL SELECT pair, sample_id, side, n + 6, array_to_string(w[i : i + n - 1], ' ') FROM (
    SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM chrf_words, (SELECT unnest([1, 2]) AS n) WHERE len(w) >= n)""")
# an order the reference lacks does not count hypothesis n-grams; here a hypothesis is never longer than its reference
view("chrf_sums", _overlap("chrf_grams"))
_N8 = ", ".join(f"max(m) FILTER (n = {n}) AS match{n}, max(h) FILTER (n = {n}) AS hyp{n}, max(f) FILTER (n = {n}) AS ref{n}" for n in range(1, 9))
_P = " + ".join(f"match{n} / CAST(hyp{n} AS DOUBLE)" for n in range(1, 9))
_R = " + ".join(f"match{n} / CAST(ref{n} AS DOUBLE)" for n in range(1, 9))


@query("chrf_pp", f"""
  SELECT * EXCLUDE (p, r), CAST(8 AS INTEGER) AS orders, floor(500 * p * r / (4 * p + r) * 1e6 + 0.5) / 1e6 AS chrf
  FROM (SELECT *, ({_P}) / 8 AS p, ({_R}) / 8 AS r FROM (SELECT pair, {_N8} FROM chrf_sums GROUP BY pair))""")
def chrf_pp(spark, sf):
    df = m.chrf(t.hr(spark, sf), ["pair"])
    return df.withColumn("chrf", t.r6(F.col("chrf")))


@query("system_score", """
  SELECT pair, count(*) AS segments, floor(avg(length(hyp) / CAST(length(ref) + length(ref) + 1 AS DOUBLE)) * 100 * 1e6 + 0.5) / 1e6 AS score FROM hr GROUP BY pair""")
def system_score(spark, sf):
    """A stand-in scorer: hypothesis length over source and reference length."""

    def load():
        return 1.0

    def score(model, batch: pd.DataFrame) -> pd.Series:
        return batch["hyp"].str.len() / (batch["src"].str.len() + batch["ref"].str.len() + model)

    df = m.system_score(t.hr(spark, sf).withColumn("src", F.col("ref")), load, score)
    return df.withColumn("score", t.r6(F.col("score")))


# Language detection ----------------------------------------------------------------------------

_CH = "list_filter(string_split(' ' || {0} || ' ', ''), lambda x: x <> '')"
view("line_chars", f"""
  SELECT doc_id, line_no, lang, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, line_no, lang, {_CH.format('line')} AS w FROM lines)""")
# an empty line has two framing spaces only: they are its single n-gram
view("grams", """
  SELECT doc_id, line_no, lang, gram FROM (
    SELECT doc_id, line_no, lang, c || lead(c, 1) OVER s || lead(c, 2) OVER s AS gram FROM line_chars
    WINDOW s AS (PARTITION BY doc_id, line_no ORDER BY i)) WHERE gram IS NOT NULL
  UNION ALL SELECT doc_id, line_no, lang, '  ' FROM lines WHERE line = ''""")
_LANG_COLS = ", ".join(f"count(*) FILTER (lang = '{x}') AS n_{i}" for i, x in enumerate(t.LANGS))
view("gram_counts", f"SELECT gram, {_LANG_COLS} FROM grams GROUP BY gram")
_LP = ", ".join(f"CAST(floor(ln((n_{i} + 1) / CAST(t_{i} + v AS DOUBLE)) * 1000000 + 0.5) AS BIGINT) AS lp_{i}" for i in range(4))
view("gram_model", f"""
  SELECT gram, {_LP} FROM gram_counts, (SELECT count(*) AS v, {", ".join(f"sum(n_{i}) AS t_{i}" for i in range(4))} FROM gram_counts)""")
_BEST = "CASE " + " ".join(f"WHEN s_{i} = greatest(s_0, s_1, s_2, s_3) THEN '{x}'" for i, x in enumerate(t.LANGS)) + " END"
view("detected", f"""
  SELECT doc_id, line_no, lang, {_BEST} AS pred_lang FROM (
    SELECT doc_id, line_no, lang, {", ".join(f"sum(lp_{i}) AS s_{i}" for i in range(4))} FROM grams JOIN gram_model USING (gram) GROUP BY ALL)""")


def detected(spark, sf):
    texts = t.lines(spark, sf).select("doc_id", "line_no", "lang", F.col("line").alias("text"))
    model = m.train_langid(texts, t.LANGS)
    return m.detect_language(texts, model, t.LANGS, ["doc_id", "line_no", "lang"])


@query("detect_language", "SELECT * FROM detected")
def detect_language(spark, sf):
    return detected(spark, sf)


@query("offtarget_ratio", """
  SELECT lang AS pair, count(*) AS sentences, count(*) FILTER (pred_lang <> lang) AS offtarget,
         floor(count(*) FILTER (pred_lang <> lang) / CAST(count(*) AS DOUBLE) * 100 * 1e6 + 0.5) / 1e6 AS ratio FROM detected GROUP BY lang""")
def offtarget_ratio(spark, sf):
    rows = detected(spark, sf).select(F.col("lang").alias("pair"), F.col("lang").alias("tgt_lang"), "pred_lang")
    return m.offtarget_ratio(rows).withColumn("ratio", t.r6(F.col("ratio")))


# All metrics of all directions ------------------------------------------------------------------

view("hyp_chars", f"""
  SELECT pair, sample_id, tgt_lang, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM (SELECT pair, sample_id, tgt_lang, {_CH.format('hyp')} AS w FROM hr)""")
view("hyp_grams", """
  SELECT pair, sample_id, tgt_lang, gram FROM (
    SELECT pair, sample_id, tgt_lang, c || lead(c, 1) OVER s || lead(c, 2) OVER s AS gram FROM hyp_chars
    WINDOW s AS (PARTITION BY pair, sample_id ORDER BY i)) WHERE gram IS NOT NULL
  UNION ALL SELECT pair, sample_id, tgt_lang, '  ' FROM hr WHERE hyp = ''""")
_UNSEEN = ", ".join(f"CAST(floor(ln(1 / CAST(sum(n_{i}) + count(*) AS DOUBLE)) * 1000000 + 0.5) AS BIGINT) AS u_{i}" for i in range(4))
view("unseen_gram", f"SELECT {_UNSEEN} FROM gram_counts")
view("hyp_detected", f"""
  SELECT pair, sample_id, tgt_lang, {_BEST} AS pred_lang FROM (
    SELECT pair, sample_id, tgt_lang, {", ".join(f"sum(coalesce(lp_{i}, u_{i})) AS s_{i}" for i in range(4))}
    FROM hyp_grams LEFT JOIN gram_model USING (gram), unseen_gram GROUP BY ALL)""")


@query("direction_scores", f"""
  SELECT metric, split_part(pair, '-', 1) AS src_lang, split_part(pair, '-', 2) AS tgt_lang, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (
    SELECT 'bleu' AS metric, pair, 100 * CASE WHEN hyp1 >= ref_len THEN 1.0 ELSE exp(1 - ref_len / CAST(hyp1 AS DOUBLE)) END * exp(({_LOGS}) / 4) AS score
    FROM (SELECT pair, {_N4}, max(f) FILTER (n = 1) AS ref_len FROM bleu_sums GROUP BY pair)
    UNION ALL SELECT 'chrf', pair, 500 * p * r / (4 * p + r)
    FROM (SELECT pair, ({_P}) / 8 AS p, ({_R}) / 8 AS r FROM (SELECT pair, {_N8} FROM chrf_sums GROUP BY pair))
    UNION ALL SELECT 'comet', pair, avg(length(hyp) / CAST(length(ref) + length(ref) + 1 AS DOUBLE)) * 100 FROM hr
    WHERE src_lang IN ('de', 'en') AND tgt_lang IN ('de', 'en') GROUP BY pair
    UNION ALL SELECT 'offtarget', pair, count(*) FILTER (pred_lang <> tgt_lang) / CAST(count(*) AS DOUBLE) * 100 FROM hyp_detected GROUP BY pair)""")
def direction_scores(spark, sf):
    """All four metrics; the stand-in scorer knows two languages, the detector all."""

    def load():
        return 1.0

    def score(model, batch: pd.DataFrame) -> pd.Series:
        return batch["hyp"].str.len() / (batch["src"].str.len() + batch["ref"].str.len() + model)

    texts = t.lines(spark, sf).select("lang", F.col("line").alias("text"))
    detector = plan.Detector(m.train_langid(texts, t.LANGS), t.LANGS)
    rows = t.hr(spark, sf).withColumn("src", F.col("ref"))
    found = plan.direction_scores(rows, scorer=plan.SegmentScorer(load, score, ["de", "en"]), detector=detector)
    return found.withColumn("score", t.r6(F.col("score")))
