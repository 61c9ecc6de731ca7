"""Subwords, shards, mixing, and token-id sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import arrays as a
from tandem.operators import cleaning as c
from tandem.operators import corpus as d
from tandem.operators import subword as s
from tandem.operators import tokens as k
from tandem.operators import unigram as u
from tandem.session import shared_folder, staged
from tandem.sources import sinks
from workload import tables as t
from workload.cleaning import clean_corpus
from workload.registry import query, view

# Corpus ------------------------------------------------------------------------------------


@query("mono_corpus", """
  SELECT lang, pair, line_no, text FROM (
    SELECT src_lang AS lang, tgt_lang AS other, pair, line_no, src AS text FROM bitext
    UNION ALL SELECT tgt_lang, src_lang, pair, line_no, tgt FROM bitext)
  WHERE (lang = 'en' AND other = 'de') OR (lang <> 'en' AND other = 'en')""")
def mono_corpus(spark, sf):
    return d.mono_corpus(t.bitext(spark, sf))


@query("parallel_directions", """
  SELECT a.lang || '-' || b.lang AS pair, a.lang AS src_lang, b.lang AS tgt_lang, a.sent_id AS line_no, a.text AS src, b.text AS tgt
  FROM parallel_set a JOIN parallel_set b USING (sent_id)
  WHERE a.lang <> b.lang AND (a.lang IN ('de', 'en') OR b.lang IN ('de', 'en'))""")
def parallel_directions(spark, sf):
    langs = t.load(spark, sf, "documents").select("lang").distinct()
    bridge = F.col("src_lang").isin("de", "en") | F.col("tgt_lang").isin("de", "en")
    directions = langs.select(F.col("lang").alias("src_lang")).join(
        langs.select(F.col("lang").alias("tgt_lang")), (F.col("src_lang") != F.col("tgt_lang")) & bridge)
    return d.parallel_directions(t.parallel_set(spark, sf), directions)


@query("sample_topk", "SELECT pair, line_no, src FROM bitext ORDER BY md5('1' || chr(1) || pair || chr(1) || line_no) LIMIT 1500")
def sample_topk(spark, sf):
    return d.sample_exact(t.bitext(spark, sf), 1500).select("pair", "line_no", "src")


@query("char_coverage", """
  SELECT ch, cnt, floor(run / total * 1e6 + 0.5) / 1e6 AS cum_share, run - cnt < 0.9995 * total AS keep FROM (
    SELECT *, CAST(sum(cnt) OVER (ORDER BY cnt DESC, ch) AS DOUBLE) AS run, CAST(sum(cnt) OVER () AS DOUBLE) AS total
    FROM (SELECT ch, count(*) AS cnt FROM (SELECT unnest(string_split(line, '')) AS ch FROM lines) WHERE ch <> '' GROUP BY ch))""")
def char_coverage(spark, sf):
    texts = t.lines(spark, sf).select(F.col("line").alias("text"))
    return c.char_coverage(texts, 0.9995).select("ch", "cnt", t.r6(F.col("cum_share")).alias("cum_share"), "keep")


# Pieces ------------------------------------------------------------------------------------

PIECES = "list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: '▁' || w)"
view("pieces", f"""
  SELECT pair, src_lang, tgt_lang, line_no, src, tgt, {PIECES.format('src')} AS src_pieces, {PIECES.format('tgt')} AS tgt_pieces FROM bitext""")


def pieces(spark, sf):
    return s.encode_pieces(t.bitext(spark, sf), {"src": "src_pieces", "tgt": "tgt_pieces"}, "word")


@query("encode_pieces", f"""
  SELECT doc_id, line_no, CAST(len(p) AS BIGINT) AS n_word, md5(array_to_string(p, ' ')) AS word_md5, CAST(length(array_to_string(p, '')) AS BIGINT) AS n_char,
         md5(array_to_string(list_filter(string_split(array_to_string(p, ''), ''), lambda x: x <> ''), ' ')) AS char_md5
  FROM (SELECT doc_id, line_no, {PIECES.format('line')} AS p FROM lines)""")
def encode_pieces(spark, sf):
    df = s.encode_pieces(t.lines(spark, sf), {"line": "w"}, "word")
    df = s.encode_pieces(df, {"line": "ch"}, "char")
    return df.select("doc_id", "line_no", F.size("w").cast("long").alias("n_word"), F.md5(F.array_join("w", " ")).alias("word_md5"),
                     F.size("ch").cast("long").alias("n_char"), F.md5(F.array_join("ch", " ")).alias("char_md5"))


@query("decode_pieces", """
  SELECT pair, line_no, ltrim(replace(array_to_string(src_pieces, ''), '▁', ' ')) AS src, ltrim(replace(array_to_string(tgt_pieces, ''), '▁', ' ')) AS tgt FROM pieces""")
def decode_pieces(spark, sf):
    df = s.encode_pieces(t.bitext(spark, sf), {"src": "p", "tgt": "q"}, "char")
    df = s.decode(s.decode(df, "p", "src"), "q", "tgt")
    return df.select("pair", "line_no", "src", "tgt")


BPE_VOCAB = 200

# one merge at a time over all distinct words; symbols stand between two marks, so a merge is a plain replace
view("line_words", "SELECT doc_id, line_no, lang, '▁' || w AS word FROM (SELECT doc_id, line_no, lang, unnest(string_split(line, ' ')) AS w FROM lines) WHERE w <> ''")
view("bpe_steps", f"""
  WITH RECURSIVE counted AS (SELECT word, count(*) AS cnt FROM line_words GROUP BY word),
  room AS (SELECT {BPE_VOCAB} - 3 - count(DISTINCT c) AS n FROM (SELECT unnest(string_split(word, '')) AS c FROM counted)),
  step AS (
    SELECT 0 AS k, word, cnt, string_split(word, '') AS s, CAST(NULL AS VARCHAR) AS l, CAST(NULL AS VARCHAR) AS r FROM counted
    UNION ALL (
      WITH best AS (
        SELECT l, r FROM (SELECT s[i] AS l, s[i + 1] AS r, cnt FROM (SELECT s, cnt, unnest(range(1, len(s))) AS i FROM step))
        GROUP BY l, r ORDER BY sum(cnt) DESC, l, r LIMIT 1)
      SELECT k + 1, word, cnt, string_split(replace(chr(2) || array_to_string(s, chr(3) || chr(2)) || chr(3),
               chr(2) || b.l || chr(3) || chr(2) || b.r || chr(3), chr(2) || b.l || b.r || chr(3))[2:-2], chr(3) || chr(2)), b.l, b.r
      FROM step, best b WHERE k < (SELECT n FROM room)))
  SELECT * FROM step""")


@query("bpe_merges")
def bpe_merges(spark, sf):
    """The whole vocabulary. No SQL: ``bpe_steps`` would hold every word once per merge; the tests compare its first steps."""
    merges = s.train_subwords(s.word_counts(t.lines(spark, sf), "line"), s.VOCAB_SIZE)
    return spark.createDataFrame([(i, a_, b) for i, (a_, b) in enumerate(merges, 1)], "rank int, left string, right string")


@query("encode_bpe", """
  SELECT lang, same, count(*) AS lines, CAST(sum(n) AS BIGINT) AS pieces FROM (
    SELECT l.lang, coalesce(bool_and(array_to_string(b.s, '') = b.word), true) AS same, coalesce(sum(len(b.s)), 0) AS n
    FROM lines l LEFT JOIN line_words w USING (doc_id, line_no) LEFT JOIN (SELECT * FROM bpe_steps WHERE k = (SELECT max(k) FROM bpe_steps)) b USING (word)
    GROUP BY l.doc_id, l.line_no, l.lang) GROUP BY lang, same""")
def encode_bpe(spark, sf):
    """Train on all lines, encode all lines, decode again: ``same`` must hold everywhere."""
    merges = s.train_subwords(s.word_counts(t.lines(spark, sf), "line"), BPE_VOCAB)
    df = s.encode_pieces(t.lines(spark, sf), {"line": "p"}, "bpe", merges)
    plain = F.array_join(F.filter(F.split("line", " "), lambda w: w != ""), " ")
    df = s.decode(df, "p", "back").withColumn("same", F.col("back") == plain)
    return df.groupBy("lang", "same").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("p")).alias("pieces"))


UNIGRAM_VOCAB, UNIGRAM_SEED = 1_000, 20_000


def unigram_model(spark, sf):
    return u.train_unigram(s.word_counts(t.lines(spark, sf), "line"), UNIGRAM_VOCAB, UNIGRAM_SEED)


@query("unigram_vocab")
def unigram_vocab(spark, sf):
    """No SQL: forward and backward sums over all segmentations; the tests enumerate them."""
    return u.unigram_vocabulary(spark, unigram_model(spark, sf)).select("rank", "token", t.r6(F.col("score")).alias("score"))


@query("encode_unigram")
def encode_unigram(spark, sf):
    """Train on all lines, encode all lines, decode again: ``same`` must hold everywhere."""
    df = s.encode_pieces(t.lines(spark, sf), {"line": "p"}, "unigram", unigram_model(spark, sf))
    plain = F.array_join(F.filter(F.split("line", " "), lambda w: w != ""), " ")
    df = s.decode(df, "p", "back").withColumn("same", F.col("back") == plain)
    return df.groupBy("lang", "same").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("p")).alias("pieces"))


VOCAB = t.VOCAB
view("dictionary", f"""
  SELECT token, 1 AS cnt, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(list_concat(src_pieces, tgt_pieces)) AS token FROM pieces) GROUP BY token
    ORDER BY n DESC, token LIMIT {VOCAB - 3})""")


def dictionary(spark, sf):
    return s.build_dictionary(s.vocabulary(pieces(spark, sf), VOCAB))


@query("vocab_dictionary", "SELECT token, cnt, token_id FROM dictionary")
def vocab_dictionary(spark, sf):
    return dictionary(spark, sf)


def _ids_sql(side: str) -> str:
    return f"""
  SELECT pair, line_no, list(coalesce(token_id, 3) ORDER BY pos) AS ids FROM (
    SELECT pair, line_no, unnest({side}_pieces) AS token, generate_subscripts({side}_pieces, 1) AS pos FROM pieces)
  LEFT JOIN dictionary USING (token) GROUP BY pair, line_no"""


view("src_found", _ids_sql("src"))
view("tgt_found", _ids_sql("tgt"))
view("token_ids", f"""
  SELECT pair, line_no, src_lang, tgt_lang, list_concat([{4 + VOCAB} + tag], list_concat(coalesce(s.ids, CAST([] AS INTEGER[])), [2])) AS src_ids,
         list_concat(coalesce(g.ids, CAST([] AS INTEGER[])), [2]) AS tgt_ids, list_concat([2], coalesce(g.ids, CAST([] AS INTEGER[]))) AS prev_ids
  FROM bitext LEFT JOIN src_found s USING (pair, line_no) LEFT JOIN tgt_found g USING (pair, line_no)
  JOIN (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) tags(tgt_lang, tag) USING (tgt_lang)""")


def binarized(spark, sf):
    return s.binarize(pieces(spark, sf), dictionary(spark, sf), {"src_pieces": "src_ids", "tgt_pieces": "tgt_ids"})


def token_ids(spark, sf):
    """Tagged source ids, target ids, and the decoder input: end of sentence, then the target without its last id."""
    index = F.array_position(F.array(*[F.lit(x) for x in t.LANGS]), F.col("tgt_lang")) - 1
    return binarized(spark, sf).select(
        "pair", "line_no", "src_lang", "tgt_lang", a.tag_ids(s.tag_id(VOCAB, index), F.col("src_ids")).alias("src_ids"), "tgt_ids",
        F.concat(F.slice("tgt_ids", -1, 1), F.slice("tgt_ids", F.lit(1), F.size("tgt_ids") - 1)).alias("prev_ids"),
    )


def ints(col: str) -> str:
    return f"array_to_string({col}, ' ')"


@query("binarize", f"SELECT pair, line_no, {ints('src_ids[2:]')} AS src_ids, {ints('tgt_ids')} AS tgt_ids FROM token_ids")
def binarize(spark, sf):
    return binarized(spark, sf).select("pair", "line_no", t.join_ints(F.col("src_ids")).alias("src_ids"), t.join_ints(F.col("tgt_ids")).alias("tgt_ids"))


@query("position_filter", "SELECT pair, line_no, CAST(len(src_ids) AS INTEGER) AS n_src, CAST(len(tgt_ids) AS INTEGER) AS n_tgt FROM token_ids WHERE len(src_ids) <= 256 AND len(tgt_ids) <= 256")
def position_filter(spark, sf):
    return c.filter_positions(token_ids(spark, sf), 256).select("pair", "line_no", F.size("src_ids").alias("n_src"), F.size("tgt_ids").alias("n_tgt"))


# Shards ------------------------------------------------------------------------------------

view("chunked", """
  SELECT pair, line_no, src, tgt, CAST((row_number() OVER (PARTITION BY pair ORDER BY line_no) - 1) // size AS INTEGER) AS chunk,
         CAST(ceil(total / CAST(size AS DOUBLE)) AS INTEGER) AS n_chunks
  FROM (SELECT *, CASE WHEN total // 10 >= 100 THEN total // 10 ELSE 100 END + 1 AS size
        FROM (SELECT *, count(*) OVER (PARTITION BY pair) AS total FROM bitext))""")


def chunked(spark, sf):
    return d.assign_chunk(t.bitext(spark, sf), 10, 100)


@query("assign_chunk", "SELECT pair, line_no, chunk, n_chunks FROM chunked")
def assign_chunk(spark, sf):
    return chunked(spark, sf).select("pair", "line_no", "chunk", "n_chunks")


@query("build_chunks", """
  SELECT pair, line_no, CAST((row_number() OVER (PARTITION BY pair ORDER BY md5('1' || chr(1) || pair || chr(1) || line_no), line_no) - 1) // size AS INTEGER) AS chunk,
         CAST(ceil(total / CAST(size AS DOUBLE)) AS INTEGER) AS n_chunks
  FROM (SELECT *, CASE WHEN total // 10 >= 100 THEN total // 10 ELSE 100 END + 1 AS size
        FROM (SELECT *, count(*) OVER (PARTITION BY pair) AS total FROM hist_flagged WHERE hist_ok))""")
def build_chunks(spark, sf):
    """The build path: cleaned text, written once, in random order cut into chunks."""
    clean = staged(clean_corpus(spark, sf), "clean")
    return d.assign_chunk(clean, 10, 100, seed=1).select("pair", "line_no", "chunk", "n_chunks")


view("sharded", "SELECT c.*, CAST(shard AS INTEGER) AS shard FROM chunked c JOIN (SELECT unnest(range(10)) AS shard) ON shard % n_chunks = chunk")


@query("fill_shards", "SELECT shard, pair, line_no, chunk FROM sharded")
def fill_shards(spark, sf):
    return d.fill_shards(chunked(spark, sf), 10).select("shard", "pair", "line_no", "chunk")


@query("replicate_valid", "SELECT pair, line_no, src, CAST(shard AS INTEGER) AS shard FROM bitext, (SELECT unnest(range(4)) AS shard)")
def replicate_valid(spark, sf):
    return d.replicate_valid(t.bitext(spark, sf).select("pair", "line_no", "src"), 4)


@query("shard_roundtrip", "SELECT shard, pair, line_no, src, tgt FROM sharded")
def shard_roundtrip(spark, sf):
    path = shared_folder(spark, "shards")
    sinks.write_shards(d.fill_shards(chunked(spark, sf), 10).select("shard", "pair", "line_no", "src", "tgt"), path)
    return sinks.read_table(spark, path, "line_no long, src string, tgt string, shard int, pair string")


# Mixing ------------------------------------------------------------------------------------


@query("lang_tag", "SELECT pair, line_no, '__' || tgt_lang || '__ ' || src AS src FROM bitext")
def lang_tag(spark, sf):
    return d.tag_target_lang(t.bitext(spark, sf)).select("pair", "line_no", "src")


view("weights", """
  SELECT pair, n, raw / sum(raw) OVER () AS weight FROM (
    SELECT pair, n, pow(n / CAST(sum(n) OVER () AS DOUBLE), 0.2) AS raw FROM (SELECT pair, count(*) AS n FROM bitext GROUP BY pair))""")


@query("temperature_weights", "SELECT pair, n, floor(weight * 1e6 + 0.5) / 1e6 AS weight FROM weights")
def temperature_weights(spark, sf):
    return d.temperature_weights(t.bitext(spark, sf), 5).select("pair", "n", t.r6(F.col("weight")).alias("weight"))


view("shares", """
  SELECT pair, n, w + CASE WHEN row_number() OVER (ORDER BY rest DESC, pair) <= 5000 - sum(w) OVER () THEN 1 ELSE 0 END AS share
  FROM (SELECT pair, n, floor(weight * 5000.0 + 1e-9) AS w, round(weight * 5000.0 - floor(weight * 5000.0 + 1e-9), 9) AS rest FROM weights)""")


@query("temperature_sample", """
  SELECT pair, line_no, CAST(copy AS INTEGER) AS copy FROM (
    SELECT pair, line_no, unnest(range(1, CAST(share // n + CASE WHEN nr <= share % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS copy FROM (
      SELECT pair, line_no, n, CAST(share AS BIGINT) AS share,
             row_number() OVER (PARTITION BY pair ORDER BY md5('1' || chr(1) || pair || chr(1) || line_no), line_no) AS nr
      FROM bitext JOIN shares USING (pair)))""")
def temperature_sample(spark, sf):
    texts = t.bitext(spark, sf)
    return d.temperature_sample(texts, d.temperature_weights(texts, 5), 5000).select("pair", "line_no", "copy")


# Batches and model input -----------------------------------------------------------------------

view("batched", """
  SELECT *, CAST((row_number() OVER (PARTITION BY pair, bucket ORDER BY line_no) - 1) // least(greatest(4000 // bucket, 1), 32) AS BIGINT) AS batch
  FROM (SELECT *, CAST(ceil(greatest(len(src_ids), len(tgt_ids), 1) / 8.0) * 8 AS INTEGER) AS bucket FROM token_ids)""")


def batched(spark, sf):
    # the numbering reads its input twice: the ids are written once, not looked up twice
    return d.token_batches(staged(token_ids(spark, sf), "ids"), 4000, 32)


@query("token_batches", "SELECT pair, line_no, bucket, batch FROM batched")
def token_batches(spark, sf):
    return batched(spark, sf).select("pair", "line_no", "bucket", "batch")


# one batch after the other: from each place how many sequences a batch takes, then a walk over the places
view("by_length", "SELECT pair, line_no, CAST(n AS INTEGER) AS length, row_number() OVER (ORDER BY n, pair, line_no) - 1 AS p FROM (SELECT pair, line_no, greatest(len(src_ids), len(tgt_ids)) AS n FROM token_ids)")
view("batch_starts", """
  WITH RECURSIVE taken AS (
    SELECT a.p, greatest(CAST(count(*) FILTER (WHERE (a.p + k + 1 - a.p) * b.length <= 1000) AS BIGINT), 1) AS m
    FROM by_length a, (SELECT unnest(range(32)) AS k) ks, by_length b WHERE b.p = a.p + k GROUP BY a.p),
  step AS (SELECT p, CASE WHEN p + m < (SELECT count(*) FROM by_length) AND m >= 8 THEN m - m % 8 ELSE m END AS m FROM taken),
  walk AS (SELECT CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS p WHERE EXISTS (FROM by_length) UNION ALL
    SELECT batch + 1, walk.p + m FROM walk JOIN step USING (p) WHERE walk.p + m < (SELECT count(*) FROM by_length))
  SELECT * FROM walk""")


@query("sorted_token_batches", "SELECT pair, line_no, length, batch FROM by_length ASOF JOIN batch_starts ON by_length.p >= batch_starts.p")
def sorted_token_batches(spark, sf):
    ids = staged(token_ids(spark, sf).select("pair", "line_no", F.size("src_ids").alias("n_src"), F.size("tgt_ids").alias("n_tgt")), "lengths")
    found = d.sorted_token_batches(ids, 1000, 32, 8, length=F.greatest("n_src", "n_tgt"))
    return found.select("pair", "line_no", "length", "batch")


@query("worker_slice", "SELECT pair, line_no, bucket, batch FROM batched WHERE batch % 4 = 1")
def worker_slice(spark, sf):
    return d.worker_slice(batched(spark, sf), 4, 1).select("pair", "line_no", "bucket", "batch")


def _registers_sql(table: str, factor: int) -> str:
    n = f"CAST(ceil(len(src_ids) / {factor}.0) AS INTEGER)"
    return f"SELECT *, {n} AS n_registers, list_concat(src_ids, list_transform(range({n}), lambda x: list_max(src_ids))) AS src_reg FROM {table}"


view("registered", _registers_sql("batched", 1))
view("registered_two", _registers_sql("token_ids", 2))
view("padded", """
  SELECT * EXCLUDE (width), list_concat(list_transform(range(width - len(src_reg)), lambda x: 1), src_reg) AS src_padded, width - len(src_reg) AS n_pad
  FROM (SELECT *, max(len(src_ids)) OVER (PARTITION BY pair, bucket, batch) + max(n_registers) OVER (PARTITION BY pair, bucket, batch) AS width FROM registered)""")


def padded(spark, sf):
    return k.left_pad_batch(k.append_registers(batched(spark, sf)))


@query("append_registers", f"SELECT pair, line_no, n_registers, {ints('src_reg')} AS src_reg FROM registered_two")
def append_registers(spark, sf):
    return k.append_registers(token_ids(spark, sf), 2).select("pair", "line_no", "n_registers", t.join_ints(F.col("src_reg")).alias("src_reg"))


@query("left_pad_batch", f"SELECT pair, line_no, bucket, batch, {ints('src_padded')} AS src_padded, CAST(n_pad AS INTEGER) AS n_pad FROM padded")
def left_pad_batch(spark, sf):
    return padded(spark, sf).select("pair", "line_no", "bucket", "batch", t.join_ints(F.col("src_padded")).alias("src_padded"),
                                    F.size(F.filter("pad_mask", lambda x: x)).alias("n_pad"))


@query("decoder_start", f"SELECT pair, line_no, {ints('list_concat([src_reg[-1]], prev_ids[2:])')} AS prev_ids FROM registered")
def decoder_start(spark, sf):
    df = k.set_decoder_start(k.append_registers(token_ids(spark, sf)))
    return df.select("pair", "line_no", t.join_ints(F.col("prev_ids")).alias("prev_ids"))


@query("strip_pad", f"SELECT pair, line_no, {ints('list_filter(src_padded, lambda x: x <> 1)')} AS src_padded FROM padded")
def strip_pad(spark, sf):
    return k.strip_pad(padded(spark, sf), ("src_padded",)).select("pair", "line_no", t.join_ints(F.col("src_padded")).alias("src_padded"))


@query("concat_source_target", f"""
  SELECT pair, line_no, {ints('list_concat(src_padded, list_concat([src_reg[-1]], prev_ids[2:]))')} AS tokens,
         repeat('0', CAST(n_pad AS BIGINT)) || repeat('1', len(src_ids)) || repeat('2', n_registers) || repeat('3', len(prev_ids)) AS segment,
         CAST(len(prev_ids) AS INTEGER) AS n_loss FROM padded""")
def concat_source_target(spark, sf):
    df = k.concat_source_target(k.set_decoder_start(padded(spark, sf)))
    return df.select("pair", "line_no", t.join_ints(F.col("tokens")).alias("tokens"),
                     F.array_join(F.transform("segment", lambda x: x.cast("string")), "").alias("segment"),
                     F.size(F.filter("loss_mask", lambda x: x)).alias("n_loss"))
