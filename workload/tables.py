"""The given tables as language data, in Spark and in SQL.

``lines``      one row per line of a document
``ranked``     lines of the i-th document of each language share ``rk``: an N-way parallel set
``bitext``     pairs of languages aligned by document rank and line
``adj``        a line and its successor in the same document (many copies, many length ratios)
``seg``        pieces of raw web pages between '>' (many of them mostly punctuation)
``hr``         a line as reference and the line without some of its words as hypothesis
``lang_dim``   nations as languages, regions as families
``grid``       supplier nation x customer nation scores from order lines
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.operators.numbering import number_rows, range_block
from tandem.session import spread
from workload.registry import view

LINE_STEP = 1_000_000
VOCAB = 2_000
# documents are large rows, so a block of them is small
DOC_BLOCK = 1 << 12
LANGS = ["de", "en", "es", "fr"]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Columns of ``documents``, spread over the cores."""
    return spread(load(spark, sf, "documents").select(*cols), "doc_id")


def r6(col: Column) -> Column:
    """Six decimals, by the same arithmetic in both engines."""
    return F.floor(col * 1e6 + 0.5) / 1e6


#: Lines of a text file the queries write.
FILE_LINES = 1 << 16


def write_files(df: DataFrame, root: str) -> None:
    """The lines of each ``file`` in the order of ``ord``, as one text file below ``root``.

    A file is written by one task, batch by batch from its sorted lines: no file is held whole in Python.
    """

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        filesystem, inner = fs.FileSystem.from_uri(root)
        filesystem.create_dir(inner, recursive=True)
        name, out = None, None
        for batch in batches:
            for file, lines in itertools.groupby(zip(*(batch.column(i).to_pylist() for i in range(2))), key=lambda x: x[0]):
                if file != name:
                    if out:
                        out.close()
                    name, out = file, filesystem.open_output_stream(f"{inner}/{file}")
                out.write("".join([line + "\n" for _, line in lines]).encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["file"])

    dealt = df.select("file", "ord", "line").repartition("file").sortWithinPartitions("file", "ord")
    dealt.select("file", "line").mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()


def join_ints(col: Column) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def _split_lines(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.posexplode(F.split("text", "\n")).alias("_p", "line")).select(
        *cols, (F.col("_p") + 1).cast("long").alias("line_no"), "line"
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return _split_lines(texts(spark, sf, "doc_id", "lang", "text"), "doc_id", "lang")


view("lines", """
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no
  FROM documents""")


def document_tasks(spark: SparkSession, sf: str) -> int:
    """Tasks for a shuffle of whole documents: two for each split of the table, so that what one of them reads does not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, 2 * load(spark, sf, "documents").select("text").rdd.getNumPartitions())


def ranked_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang", "text", range_block(F.col("doc_id"), DOC_BLOCK).alias("_block"))
    # dealt here, the documents meet their block without a shuffle in as many tasks as the session happens to set
    dealt = docs.repartition(document_tasks(spark, sf), "lang", "_block")
    numbered = number_rows(dealt, ["lang"], ["doc_id"], F.col("_block"), "rk", 1)
    return numbered.select("doc_id", "lang", "text", (F.col("rk") + 1).alias("rk"))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _split_lines(ranked_docs(spark, sf), "lang", "rk")


view("ranked", """
  SELECT lang, dense_rank() OVER (PARTITION BY lang ORDER BY doc_id) AS rk, line_no, line FROM lines""")


def parallel_set(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf).select((F.col("rk") * LINE_STEP + F.col("line_no")).alias("sent_id"), "lang", F.col("line").alias("text"))


view("parallel_set", "SELECT rk * 1000000 + line_no AS sent_id, lang, line AS text FROM ranked")


def bitext(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of one rank meet as wholes and are cut into lines side by side: a text is shuffled as it is, not line by line with keys."""
    dealt = ranked_docs(spark, sf).select("rk", "lang", "text").repartition(document_tasks(spark, sf), "rk")
    a = dealt.select("rk", F.col("lang").alias("src_lang"), F.col("text").alias("_a"))
    b = dealt.select(F.col("rk").alias("_rk"), F.col("lang").alias("tgt_lang"), F.col("text").alias("_b"))
    # a rank has one document per language, so the groups of this join are as small as the language list
    both = a.join(b.hint("merge"), (F.col("rk") == F.col("_rk")) & (F.col("src_lang") < F.col("tgt_lang")))
    cut = both.select("rk", "src_lang", "tgt_lang", F.split("_a", "\n").alias("_a"), F.split("_b", "\n").alias("_b"))
    # what the longer document has beyond the shorter one is without a partner
    common = F.least(F.size("_a"), F.size("_b"))
    zipped = F.arrays_zip(F.slice("_a", F.lit(1), common).alias("src"), F.slice("_b", F.lit(1), common).alias("tgt"))
    return cut.select("rk", "src_lang", "tgt_lang", F.posexplode(zipped).alias("_p", "_x")).select(
        F.concat_ws("-", "src_lang", "tgt_lang").alias("pair"), "src_lang", "tgt_lang",
        (F.col("rk") * LINE_STEP + F.col("_p") + 1).alias("line_no"), F.col("_x.src").alias("src"), F.col("_x.tgt").alias("tgt"))


view("bitext", """
  SELECT a.lang || '-' || b.lang AS pair, a.lang AS src_lang, b.lang AS tgt_lang, a.sent_id AS line_no,
         a.text AS src, b.text AS tgt
  FROM parallel_set a JOIN parallel_set b ON a.sent_id = b.sent_id AND a.lang < b.lang""")


def adj(spark: SparkSession, sf: str) -> DataFrame:
    """Built inside the row: the lines of a document and the same lines shifted by one."""
    docs = texts(spark, sf, "doc_id", "lang", "text").select("doc_id", "lang", F.split("text", "\n").alias("l"))
    shifted = docs.where(F.size("l") > 1).withColumn("n", F.slice("l", F.lit(2), F.size("l") - 1))
    pairs = shifted.select("doc_id", "lang", F.posexplode(F.arrays_zip("l", "n")).alias("p", "x")).where(F.col("x.n").isNotNull())
    return pairs.select(
        F.concat_ws("-", "lang", F.lit("next")).alias("pair"), F.col("lang").alias("src_lang"), F.col("lang").alias("tgt_lang"),
        (F.col("doc_id") * LINE_STEP + F.col("p") + 1).alias("line_no"), F.col("x.l").alias("src"), F.col("x.n").alias("tgt"),
    )


view("adj", """
  SELECT pair, src_lang, tgt_lang, line_no, src, tgt FROM (
    SELECT lang || '-next' AS pair, lang AS src_lang, lang AS tgt_lang, doc_id * 1000000 + line_no AS line_no, line AS src,
           lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS tgt FROM lines) WHERE tgt IS NOT NULL""")


def seg(spark: SparkSession, sf: str) -> DataFrame:
    parts = load(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", ">")).alias("p", "seg"))
    return parts.select("page_id", (F.col("p") + 1).cast("long").alias("line_no"), "seg")


view("seg", """
  SELECT page_id, unnest(string_split(html, '>')) AS seg,
         CAST(generate_subscripts(string_split(html, '>'), 1) AS BIGINT) AS line_no FROM pages""")


def hr(spark: SparkSession, sf: str) -> DataFrame:
    """Directions are hub-centred: English text goes from German, any other language from English."""
    src = F.when(F.col("lang") == "en", "de").otherwise("en")
    kept = F.filter(F.split("line", " "), lambda w, i: (i + 1) % 7 != 3)
    return lines(spark, sf).select(
        F.concat_ws("-", src, "lang").alias("pair"), src.alias("src_lang"), F.col("lang").alias("tgt_lang"),
        (F.col("doc_id") * LINE_STEP + F.col("line_no")).alias("sample_id"), F.col("line").alias("ref"),
        F.array_join(kept, " ").alias("hyp"),
    )


view("hr", """
  SELECT CASE WHEN lang = 'en' THEN 'de' ELSE 'en' END || '-' || lang AS pair,
         CASE WHEN lang = 'en' THEN 'de' ELSE 'en' END AS src_lang, lang AS tgt_lang,
         doc_id * 1000000 + line_no AS sample_id, line AS ref,
         array_to_string(list_filter(string_split(line, ' '), lambda w, i: i % 7 <> 3), ' ') AS hyp FROM lines""")


def gen_log(spark: SparkSession, sf: str) -> DataFrame:
    """``hr`` as tagged lines: source with a language tag, target, scored hypothesis, one progress line."""
    sid = F.col("sample_id").cast("string")
    text = F.array(
        F.concat(F.lit("S-"), sid, F.lit("\t__"), F.col("tgt_lang"), F.lit("__ "), F.col("ref")),
        F.concat(F.lit("T-"), sid, F.lit("\t"), F.col("ref")),
        F.concat(F.lit("H-"), sid, F.lit("\t-0.5\t"), F.col("hyp")),
        F.concat(F.lit("progress "), sid),
    )
    return hr(spark, sf).select("pair", "sample_id", F.posexplode(text).alias("p", "line")).select(
        "pair", (F.col("sample_id") * 4 + F.col("p")).alias("line_no"), "line")


view("gen_log", """
  SELECT pair, sample_id * 4 + k AS line_no,
         CASE k WHEN 0 THEN 'S-' || sample_id || chr(9) || '__' || tgt_lang || '__ ' || ref
                WHEN 1 THEN 'T-' || sample_id || chr(9) || ref
                WHEN 2 THEN 'H-' || sample_id || chr(9) || '-0.5' || chr(9) || hyp
                ELSE 'progress ' || sample_id END AS line
  FROM hr, (SELECT unnest([0, 1, 2, 3]) AS k)""")


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Three candidates per sample with a natural-log score from their md5."""
    base = hr(spark, sf).select("pair", "sample_id", "ref", F.posexplode(F.array("hyp", "ref", F.reverse("hyp"))).alias("cand", "text"))
    return base.select("pair", "sample_id", "cand", "ref", "text", _score().alias("score"))


def beams(spark: SparkSession, sf: str) -> DataFrame:
    """The same candidates, those of a sample in one array."""
    cands = [F.struct(F.lit(i).alias("cand"), text.alias("text"), _score(F.lit(i)).alias("score"))
             for i, text in enumerate((F.col("hyp"), F.col("ref"), F.reverse("hyp")))]
    return hr(spark, sf).select("pair", "sample_id", "ref", F.array(*cands).alias("beam"))


def _score(cand: Column | None = None) -> Column:
    cand = F.col("cand") if cand is None else cand
    digest = F.md5(F.concat_ws("\x01", F.col("sample_id").cast("string"), cand.cast("string")))
    return -F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / 100000000.0


view("hypotheses", """
  SELECT pair, sample_id, cand, ref, text,
         -CAST(CAST('0x' || substr(md5(sample_id || chr(1) || cand), 1, 7) AS BIGINT) AS DOUBLE) / 100000000.0 AS score
  FROM (SELECT pair, sample_id, ref, CAST(unnest([0, 1, 2]) AS INTEGER) AS cand, unnest([hyp, ref, reverse(hyp)]) AS text FROM hr)""")


# Dimensions ---------------------------------------------------------------------------------


def lang_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Nation 0 is the hub, alone in its family; the two smallest other nations of a region are bridges."""
    nation = load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("lang"), F.when(F.col("n_nationkey") == 0, -1).otherwise(F.col("n_regionkey")).alias("family"))
    place = F.row_number().over(Window.partitionBy("family").orderBy("lang"))
    idx = F.row_number().over(Window.orderBy("family", "lang")) - 1
    return nation.withColumn("_place", place).select(
        "lang", idx.alias("idx"), "family", (F.col("lang") == 0).alias("is_hub"), (F.col("_place") <= 2).alias("is_bridge"))


view("lang_dim", """
  SELECT lang, row_number() OVER (ORDER BY family, lang) - 1 AS idx, family, lang = 0 AS is_hub, place <= 2 AS is_bridge
  FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY lang) AS place
        FROM (SELECT n_nationkey AS lang, CASE WHEN n_nationkey = 0 THEN -1 ELSE n_regionkey END AS family FROM nation))""")


def extra(spark: SparkSession, sf: str) -> DataFrame:
    """Extra pairs: the largest nation of each region with the largest one of the next region."""
    top = load(spark, sf, "nation").groupBy("n_regionkey").agg(F.max("n_nationkey").alias("lang"))
    nxt = top.select((F.col("n_regionkey") - 1).alias("n_regionkey"), F.col("lang").alias("tgt_lang"))
    return top.join(nxt, "n_regionkey").select(
        F.col("n_regionkey").alias("ord"), F.col("lang").alias("src_lang"), "tgt_lang",
        F.concat_ws("-", F.col("lang").cast("string"), F.col("tgt_lang").cast("string")).alias("pair"))


view("extra", """
  SELECT a.k AS ord, a.lang AS src_lang, b.lang AS tgt_lang, a.lang || '-' || b.lang AS pair
  FROM (SELECT n_regionkey AS k, max(n_nationkey) AS lang FROM nation GROUP BY 1) a
  JOIN (SELECT n_regionkey AS k, max(n_nationkey) AS lang FROM nation GROUP BY 1) b ON b.k = a.k + 1""")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Per direction and metric: the mean discount or tax of all its order lines; a rule on the direction leaves some cells out."""
    line = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", F.col("l_discount").cast("decimal(12,2)").alias("d"), F.col("l_tax").cast("decimal(12,2)").alias("x"))
    sup = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src_lang"))
    cust = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("tgt_lang"))
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cust, "o_custkey")
    # lines first collapse to their order and supplier nation, so fewer rows meet the orders
    by_order = line.join(sup, "l_suppkey").groupBy("l_orderkey", "src_lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").alias("sd"), F.sum("x").alias("sx"))
    cells = by_order.join(orders, "l_orderkey").groupBy("src_lang", "tgt_lang").agg(
        F.sum("n").alias("n"), F.sum("sd").alias("sd"), F.sum("sx").alias("sx"))
    both = F.array(F.struct(F.lit("spbleu").alias("metric"), F.lit(13).alias("lot"), F.col("sd").alias("sd")),
                   F.struct(F.lit("chrf").alias("metric"), F.lit(17).alias("lot"), F.col("sx").alias("sd")))
    rows = cells.where("src_lang <> tgt_lang").select("src_lang", "tgt_lang", "n", F.inline(both)).where("(src_lang * 7 + tgt_lang * 3) % lot <> 0")
    return rows.select("metric", "src_lang", "tgt_lang", "n", "sd", (F.col("sd").cast("double") * 100.0 / F.col("n")).alias("score"))


view("grid", """
  SELECT metric, src_lang, tgt_lang, n, sd, CAST(sd AS DOUBLE) * 100.0 / n AS score FROM (
    SELECT metric, src_lang, tgt_lang, CAST(count(*) AS BIGINT) AS n, sum(CASE metric WHEN 'spbleu' THEN d ELSE x END) AS sd FROM (
      SELECT s_nationkey AS src_lang, c_nationkey AS tgt_lang, CAST(l_discount AS DECIMAL(12,2)) AS d, CAST(l_tax AS DECIMAL(12,2)) AS x
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
      JOIN customer ON c_custkey = o_custkey) y,
      (VALUES ('spbleu', 13), ('chrf', 17)) m(metric, lot)
    WHERE src_lang <> tgt_lang AND (src_lang * 7 + tgt_lang * 3) % lot <> 0 GROUP BY ALL)""")


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Four resource classes over the nations, by region order."""
    return load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("lang"),
        F.when(F.col("n_regionkey") == 0, "h").when(F.col("n_regionkey") == 1, "m").when(F.col("n_regionkey") == 2, "l").otherwise("e").alias("class"))


view("classes", """
  SELECT n_nationkey AS lang, CASE n_regionkey WHEN 0 THEN 'h' WHEN 1 THEN 'm' WHEN 2 THEN 'l' ELSE 'e' END AS class FROM nation""")


def supported(spark: SparkSession, sf: str) -> DataFrame:
    """Only ``chrf`` is limited: to the nations with a supplier of non-negative balance on average."""
    sup = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal").cast("decimal(14,2)")).alias("bal"))
    return sup.where("bal >= 10000").select(F.lit("chrf").alias("metric"), F.col("s_nationkey").alias("lang"))


view("supported", """
  SELECT 'chrf' AS metric, s_nationkey AS lang FROM supplier GROUP BY s_nationkey
  HAVING sum(CAST(s_acctbal AS DECIMAL(14,2))) >= 10000""")
