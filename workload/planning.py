"""Languages, pairs, directions, sources and sinks."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from tandem import fixed_values as fv
from tandem.operators import pairing, planning as p
from tandem.operators.numbering import number_rows, range_block
from tandem.plans.intake import checked_bitext
from tandem.session import shared_folder, staged
from tandem.sources import archive, sinks, text as txt
from workload import tables as t
from workload.registry import query, view

# Dimensions ---------------------------------------------------------------------------------


@query("language_dim", "SELECT CAST(lang AS VARCHAR) AS lang, CAST(idx AS BIGINT) AS idx, family, is_hub, is_bridge FROM lang_dim")
def language_dim(spark, sf):
    return t.lang_dim(spark, sf).select(F.col("lang").cast("string").alias("lang"), F.col("idx").cast("long").alias("idx"), "family", "is_hub", "is_bridge")


view("hub_pairs", """
  SELECT a.lang AS src_lang, b.lang AS tgt_lang, a.lang || '-' || b.lang AS pair, a.idx AS o1, b.idx AS o2, 0 AS rank, 'hub' AS origin
  FROM lang_dim a JOIN lang_dim b ON a.is_hub AND a.lang <> b.lang""")
view("family_pairs", """
  SELECT a.lang AS src_lang, b.lang AS tgt_lang, a.lang || '-' || b.lang AS pair, a.idx AS o1, b.idx AS o2, 1 AS rank, 'family' AS origin
  FROM lang_dim a JOIN lang_dim b ON a.family = b.family AND a.is_bridge AND NOT b.is_bridge AND NOT a.is_hub""")
view("bridge_pairs", """
  SELECT a.lang AS src_lang, b.lang AS tgt_lang, a.lang || '-' || b.lang AS pair, a.idx AS o1, b.idx AS o2, 2 AS rank, 'bridge' AS origin
  FROM lang_dim a JOIN lang_dim b ON a.is_bridge AND b.is_bridge AND NOT a.is_hub AND a.idx < b.idx""")
view("total_pairs", """
  SELECT src_lang, tgt_lang, pair, origin, row_number() OVER (ORDER BY rank, o1, o2) AS ord FROM (
    SELECT * FROM hub_pairs UNION ALL SELECT * FROM family_pairs UNION ALL SELECT * FROM bridge_pairs
    UNION ALL SELECT src_lang, tgt_lang, pair, ord, 0, 3, 'extra' FROM extra)""")
view("all_directions", """
  SELECT a.lang AS src_lang, b.lang AS tgt_lang, a.lang || '-' || b.lang AS pair, row_number() OVER (ORDER BY a.idx, b.idx) AS ord
  FROM lang_dim a, lang_dim b WHERE a.lang <> b.lang""")


def total(spark, sf):
    return p.total_pairs(t.lang_dim(spark, sf), t.extra(spark, sf))


@query("hub_pairs", "SELECT src_lang, tgt_lang, pair FROM hub_pairs")
def hub_pairs(spark, sf):
    return p.hub_pairs(t.lang_dim(spark, sf))


@query("family_pairs", "SELECT src_lang, tgt_lang, pair FROM family_pairs")
def family_pairs(spark, sf):
    return p.within_family_pairs(t.lang_dim(spark, sf))


@query("bridge_pairs", "SELECT src_lang, tgt_lang, pair FROM bridge_pairs")
def bridge_pairs(spark, sf):
    return p.bridge_pairs(t.lang_dim(spark, sf))


@query("total_pairs", "SELECT * FROM total_pairs")
def total_pairs(spark, sf):
    return total(spark, sf)


@query("bidirectional_pairs", """
  SELECT src_lang, tgt_lang, pair, origin, row_number() OVER (ORDER BY half, ord) AS ord FROM (
    SELECT *, 0 AS half FROM total_pairs
    UNION ALL SELECT tgt_lang, src_lang, tgt_lang || '-' || src_lang, origin, ord, 1 FROM total_pairs)""")
def bidirectional_pairs(spark, sf):
    return p.bidirectional_pairs(total(spark, sf))


@query("all_directions", "SELECT * FROM all_directions")
def all_directions(spark, sf):
    return p.all_directions(t.lang_dim(spark, sf))


@query("chunk_ntile", "SELECT pair, ord, ntile(8) OVER (ORDER BY ord) - 1 AS part FROM total_pairs")
def chunk_ntile(spark, sf):
    return p.partition_balanced(total(spark, sf).select("pair", "ord"), 8, ["ord"])


@query("chunk_floor", """
  SELECT pair, ord, CAST(least((ord - 1) // (count(*) OVER () // 9), 8) AS INTEGER) AS part FROM all_directions""")
def chunk_floor(spark, sf):
    return p.partition_floor(p.all_directions(t.lang_dim(spark, sf)).select("pair", "ord"), 9, ["ord"])


@query("chunk_ceil", """
  SELECT pair, ord, CAST(floor((ord - 1) / ceil(count(*) OVER () / 7.0)) AS INTEGER) AS part FROM total_pairs""")
def chunk_ceil(spark, sf):
    return p.partition_ceil(total(spark, sf).select("pair", "ord"), 7, ["ord"])


# Codes: the whole table, and the three names whose evaluation-set code differs.
_CODE_ROWS = ", ".join("(" + ", ".join("NULL" if v == "-" else f"'{v}'" for v in row.split("|")) + ")" for row in fv.LANGUAGE_CODES.strip().splitlines())
view("code_map", f"""
  SELECT name, m2m, nllb, CASE name WHEN 'Chinese' THEN 'cmn_Hans' WHEN 'Estonian' THEN 'ekk_Latn' WHEN 'Tagalog' THEN 'fil_Latn' ELSE nllb END AS flores
  FROM (VALUES {_CODE_ROWS}) m(name, m2m, nllb)""")
# every document is asked for its own language and, by source, for one of the special cases
view("coded", """
  SELECT doc_id, CASE WHEN source IS NULL THEN 'xx' WHEN length(source) % 5 = 0 THEN 'zh' WHEN length(source) % 5 = 1 THEN 'fy'
    WHEN length(source) % 5 = 2 THEN 'et' WHEN length(source) % 5 = 3 THEN lang ELSE 'tl' END AS code, lang FROM documents""")


def _coded(spark, sf):
    n = F.length("source") % 5
    code = (F.when(F.col("source").isNull(), "xx").when(n == 0, "zh").when(n == 1, "fy").when(n == 2, "et")
            .when(n == 3, F.col("lang")).otherwise("tl"))
    return t.load(spark, sf, "documents").select("doc_id", code.alias("code"), "lang")


@query("lang_code_translate", """
  SELECT doc_id, code, lang, a.flores, a.name, b.nllb AS lang_nllb FROM coded
  LEFT JOIN code_map a ON code = a.m2m LEFT JOIN code_map b ON lang = b.m2m""")
def lang_code_translate(spark, sf):
    codes = p.code_map(spark)
    df = p.translate_code(_coded(spark, sf), "code", codes, "m2m", "flores", "flores")
    df = p.translate_code(df, "code", codes, "m2m", "language", "name")
    return p.translate_code(df, "lang", codes, "m2m", "nllb", "lang_nllb")


@query("code_map_coverage", """
  WITH used AS (SELECT DISTINCT code FROM coded), l AS (SELECT name, m2m AS left_code FROM code_map JOIN used ON m2m = code),
  r AS (SELECT name, nllb AS right_code FROM code_map WHERE nllb IS NOT NULL)
  SELECT name, left_code, right_code, CASE WHEN left_code IS NULL THEN 'right only' WHEN right_code IS NULL THEN 'left only' ELSE 'both' END AS coverage
  FROM l FULL JOIN r USING (name)""".replace("WITH used AS (", "SELECT * FROM (WITH used AS (") + ")")
def code_map_coverage(spark, sf):
    codes = p.code_map(spark)
    used = _coded(spark, sf).select("code").distinct()
    left = codes.select("name", F.col("m2m").alias("code")).join(used, "code", "left_semi")
    return p.code_map_coverage(left, codes.select("name", F.col("nllb").alias("code")).where("code is not null"))


@query("supported_semi", """
  SELECT metric, src_lang, tgt_lang, n FROM grid
  WHERE src_lang IN (SELECT lang FROM supported) AND tgt_lang IN (SELECT lang FROM supported)""")
def supported_semi(spark, sf):
    rows = t.grid(spark, sf).select("metric", "src_lang", "tgt_lang", "n")
    return p.supported_only(rows, t.supported(spark, sf), ["src_lang", "tgt_lang"]).select("metric", "src_lang", "tgt_lang", "n")


@query("pair_split", """
  SELECT line_no, pair, string_split(pair, '-')[1] AS src_lang, string_split(pair, '-')[2] AS tgt_lang,
         string_split(pair, '-')[2] || '-' || string_split(pair, '-')[1] AS inverse FROM bitext""")
def pair_split(spark, sf):
    src, tgt = p.split_pair(F.col("pair"))
    rows = t.bitext(spark, sf).select("line_no", "pair", src.alias("src_lang"), tgt.alias("tgt_lang"))
    return rows.withColumn("inverse", p.join_pair(F.col("tgt_lang"), F.col("src_lang")))


# Sources and sinks ------------------------------------------------------------------------------


@query("bitext_align", "SELECT pair, src_lang, tgt_lang, line_no, src, tgt FROM bitext")
def bitext_align(spark, sf):
    texts = t.parallel_set(spark, sf)
    pairs = texts.select("lang").distinct()
    pairs = pairs.select(F.col("lang").alias("src_lang")).join(pairs.select(F.col("lang").alias("tgt_lang")), F.col("src_lang") < F.col("tgt_lang"))
    # one row per pair of languages; a shuffle by language would put a whole language into one task
    pairs = F.broadcast(pairs.withColumn("pair", p.join_pair(F.col("src_lang"), F.col("tgt_lang"))))
    src = texts.join(pairs, texts["lang"] == pairs["src_lang"]).select("pair", "src_lang", "tgt_lang", F.col("sent_id").alias("line_no"), F.col("text").alias("src"))
    tgt = texts.join(pairs, texts["lang"] == pairs["tgt_lang"]).select("pair", F.col("sent_id").alias("line_no"), F.col("text").alias("tgt"))
    # a text stands in a pair with each other language
    return txt.align_sides(src, tgt, 2 * t.document_tasks(spark, sf)).select("pair", "src_lang", "tgt_lang", "line_no", "src", "tgt")


@query("oriented_bitext", """
  SELECT pair, src_lang, tgt_lang, line_no, src, tgt FROM bitext
  WHERE pair NOT IN (SELECT pair FROM bitext WHERE src_lang = 'de' AND tgt_lang = 'en' AND line_no % 2 = 1)""")
def oriented_bitext(spark, sf):
    """Pairs into French are found the other way round; the English side of one pair has lost lines, so that pair is left out."""
    texts = t.bitext(spark, sf)
    turned = F.col("tgt_lang") == "fr"
    found = F.when(turned, p.join_pair(F.col("tgt_lang"), F.col("src_lang"))).otherwise(F.col("pair"))
    lost = (F.col("src_lang") == "de") & (F.col("tgt_lang") == "en") & (F.col("line_no") % 2 == 1)
    src = texts.select(found.alias("pair"), "line_no", F.when(turned, F.col("tgt")).otherwise(F.col("src")).alias("src"))
    tgt = texts.where(~lost).select(found.alias("pair"), "line_no", F.when(turned, F.col("src")).otherwise(F.col("tgt")).alias("tgt"))
    return checked_bitext(src, tgt, texts.select("pair", "src_lang", "tgt_lang").distinct())[0]


# a third of the wanted pairs exists as named, a third only inverted, the rest not at all
view("available", """
  SELECT CASE WHEN h < 5 THEN pair ELSE tgt_lang || '-' || src_lang END AS pair,
         'zips/' || (CASE WHEN h < 5 THEN pair ELSE tgt_lang || '-' || src_lang END) || '.zip' AS path
  FROM (SELECT *, CAST('0x' || substr(md5(pair), 1, 1) AS INTEGER) AS h FROM total_pairs) WHERE h < 11""")


def _available(spark, sf):
    h = F.conv(F.substring(F.md5("pair"), 1, 1), 16, 10).cast("int")
    name = F.when(h < 5, F.col("pair")).otherwise(F.concat_ws("-", F.col("tgt_lang").cast("string"), F.col("src_lang").cast("string")))
    return total(spark, sf).where(h < 11).select(name.alias("pair"), F.concat(F.lit("zips/"), name, F.lit(".zip")).alias("path"))


view("resolved", """
  SELECT w.pair, CAST(w.src_lang AS VARCHAR) AS src_lang, CAST(w.tgt_lang AS VARCHAR) AS tgt_lang, coalesce(f.path, i.path) AS path,
         f.path IS NULL AND i.path IS NOT NULL AS inversed, f.path IS NULL AND i.path IS NULL AS missing
  FROM total_pairs w LEFT JOIN available f ON w.pair = f.pair LEFT JOIN available i ON i.pair = w.tgt_lang || '-' || w.src_lang""")


def _wanted(spark, sf):
    return total(spark, sf).select("pair", F.col("src_lang").cast("string").alias("src_lang"), F.col("tgt_lang").cast("string").alias("tgt_lang"))


@query("pair_source_resolve", "SELECT * FROM resolved")
def pair_source_resolve(spark, sf):
    return pairing.resolve_pair_source(_wanted(spark, sf), _available(spark, sf))


# line counts: every order line between two nations is a source line; returned large ones lack their target
view("nation_lines", """
  SELECT CAST(s_nationkey AS VARCHAR) || '-' || c_nationkey AS pair, l_quantity >= 49 AND l_returnflag = 'R' AS lost
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
view("counted", """
  SELECT pair, coalesce(s, 0) AS src_lines, coalesce(t, 0) AS tgt_lines, CASE WHEN coalesce(s, 0) = coalesce(t, 0) THEN 'ok' ELSE 'mismatch' END AS status
  FROM (SELECT pair, count(*) AS s FROM (SELECT 'b:' || pair AS pair FROM bitext UNION ALL SELECT pair FROM nation_lines) GROUP BY 1)
  FULL JOIN (SELECT pair, count(*) AS t FROM (SELECT 'b:' || pair AS pair FROM bitext UNION ALL SELECT pair FROM nation_lines WHERE NOT lost) GROUP BY 1) USING (pair)""")


def _counted(spark, sf):
    line = t.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", ((F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R")).alias("lost"))
    sup = t.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    orders = t.load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = t.load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = line.join(sup, "l_suppkey").join(orders, "l_orderkey").join(cust, "o_custkey").select(
        p.join_pair(F.col("s_nationkey"), F.col("c_nationkey")).alias("pair"), "lost")
    texts = t.bitext(spark, sf).select(F.concat(F.lit("b:"), "pair").alias("pair"))
    return pairing.reconcile_counts(texts.unionByName(rows.select("pair")), texts.unionByName(rows.where("not lost").select("pair")))


@query("pair_count_check", "SELECT * FROM counted")
def pair_count_check(spark, sf):
    return _counted(spark, sf)


@query("failed_pairs", """
  SELECT w.pair, CASE WHEN r.missing THEN 'source missing' WHEN c.status IS NULL THEN 'not counted' ELSE 'line counts differ' END AS reason
  FROM total_pairs w JOIN resolved r USING (pair) LEFT JOIN counted c USING (pair) WHERE w.pair NOT IN (SELECT pair FROM counted WHERE status = 'ok')""")
def failed_pairs(spark, sf):
    wanted = _wanted(spark, sf)
    return pairing.failed_pairs(wanted, pairing.resolve_pair_source(wanted, _available(spark, sf)), _counted(spark, sf))


@query("pair_list_roundtrip", "SELECT CAST(ord AS INTEGER) AS ord, CAST(src_lang AS VARCHAR) AS src_lang, CAST(tgt_lang AS VARCHAR) AS tgt_lang, pair FROM total_pairs")
def pair_list_roundtrip(spark, sf):
    path = shared_folder(spark, "pair-list")
    sinks.write_pair_list(total(spark, sf), path)
    return txt.read_pair_list(spark, path)


BITEXT = "pair string, src_lang string, tgt_lang string, line_no long, src string, tgt string"


@query("bitext_roundtrip", "SELECT pair, src_lang, tgt_lang, line_no, src, tgt FROM bitext")
def bitext_roundtrip(spark, sf):
    path = shared_folder(spark, "bitext")
    sinks.write_bitext(t.bitext(spark, sf), path)
    return sinks.read_table(spark, path, BITEXT)


@query("text_roundtrip", """
  SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY line_no) AS line_no, src FROM bitext""")
def text_roundtrip(spark, sf):
    """Source sides written as text files and read back with line numbers, in the order of the part files."""
    path = shared_folder(spark, "sides")
    sinks.write_side_text(t.bitext(spark, sf), "src", path)
    lines = txt.numbered_text(spark, path).withColumn("pair", F.regexp_extract("path", "pair=([^/]+)/", 1))
    files = lines.groupBy("pair", "path").agg(F.max("line_no").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pair").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.withColumn("_before", before).select("pair", "path", "_before")
    return lines.join(offsets, ["pair", "path"]).select("pair", (F.col("line_no") + F.col("_before")).alias("line_no"), F.col("value").alias("src"))


def _in_files(df, group, order, name):
    """Numbered rows of a group, cut into files of bounded size: ``file, ord`` and the columns; the part is the number in the file's name."""
    rows = number_rows(df, [group], [order], range_block(F.col(order)), "ord")
    part = range_block(F.col("ord"), t.FILE_LINES).cast("string")
    return rows.withColumn("file", name(part))


@query("parallel_set_read", "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY sent_id) AS sent_id, text FROM parallel_set")
def parallel_set_read(spark, sf):
    """The parallel set as files of one language each, read back with line numbers."""
    root = shared_folder(spark, "parallel-set")
    files = _in_files(t.parallel_set(spark, sf), "lang", "sent_id", lambda part: F.concat(part, F.lit("."), F.col("lang")))
    t.write_files(files.withColumnRenamed("text", "line"), root)
    first = F.col("split").cast("long") * t.FILE_LINES
    return txt.read_parallel_set(spark, f"{root}/*").select("lang", (F.col("sent_id") + first).alias("sent_id"), "text")


@query("generation_log_read", "SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY line_no) AS line_no, line FROM gen_log")
def generation_log_read(spark, sf):
    """Generation logs as files by direction, read back with line numbers."""
    root = shared_folder(spark, "logs")
    t.write_files(_in_files(t.gen_log(spark, sf), "pair", "line_no", lambda part: F.concat_ws(".", "pair", part, F.lit("raw"), F.lit("txt"))), root)
    name = F.split("pair", "[.]")
    return txt.read_generation_log(spark, f"{root}/*").select(
        name[0].alias("pair"), (F.col("line_no") + name[1].cast("long") * t.FILE_LINES).alias("line_no"), "line")


@query("archive_lines", "SELECT pair || '.' || lang AS member, line_no, line FROM (SELECT pair, src_lang AS lang, row_number() OVER (PARTITION BY pair ORDER BY line_no) AS line_no, src AS line FROM bitext UNION ALL SELECT pair, tgt_lang, row_number() OVER (PARTITION BY pair ORDER BY line_no), tgt FROM bitext)")
def archive_lines(spark, sf):
    """Bitext packed into zip archives by the tasks and read back; a pair spans archives of bounded size."""
    root = shared_folder(spark, "archives")
    packed = number_rows(t.bitext(spark, sf), ["pair"], ["line_no"], range_block(F.col("line_no")))
    packed = packed.withColumn("part", range_block(F.col("row_idx"), ARCHIVE_LINES))
    _write_archives(packed, root, _set_members)
    lines = archive.read_archive_lines(spark, f"{root}/*.zip")
    part = F.regexp_extract("path", r"\.(\d+)\.zip$", 1).cast("long")
    return lines.select("member", (F.col("line_no") + part * ARCHIVE_LINES).alias("line_no"), "line")


@query("archive_bitext", """
  SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY line_no) AS line_no, src, tgt FROM bitext WHERE pair NOT IN ('en-fr', 'es-fr')
  UNION ALL SELECT DISTINCT pair, -1, 'line counts differ', NULL FROM bitext WHERE pair = 'en-fr'
  UNION ALL SELECT DISTINCT pair, -1, 'source missing', NULL FROM bitext WHERE pair = 'es-fr'""")
def archive_bitext(spark, sf):
    """Archives read as bitext: de-es is packed the other way round, en-fr has lost a line, es-fr is missing; a letter behind the codes numbers the parts."""
    root = shared_folder(spark, "pair-archives")
    packed = number_rows(t.bitext(spark, sf), ["pair"], ["line_no"], range_block(F.col("line_no")))
    packed = staged(packed.withColumn("part", range_block(F.col("row_idx"), ARCHIVE_LINES)), "packed")
    _write_archives(packed.where("pair <> 'es-fr'"), root, _pair_members, lost=("en-fr", 1))
    mark = F.translate(F.col("part").cast("string"), "0123456789", PART_LETTERS)
    wanted = packed.groupBy("src_lang", "tgt_lang", "part").count().select(
        F.concat("src_lang", mark).alias("src_lang"), F.concat("tgt_lang", mark).alias("tgt_lang"),
        F.concat("src_lang", mark, F.lit("-"), "tgt_lang", mark).alias("pair"))
    rows, failed = archive.read_archive_bitext(spark, f"{root}/*.zip", wanted)
    plain = F.regexp_replace("pair", f"[{PART_LETTERS}]", "")
    part = F.translate(F.regexp_extract("pair", f"([{PART_LETTERS}]+)-", 1), PART_LETTERS, "0123456789").cast("long")
    rows = rows.select(plain.alias("pair"), (F.col("line_no") + part * ARCHIVE_LINES).alias("line_no"), "src", "tgt")
    lost = failed.select(plain.alias("pair"), F.lit(-1).cast("long").alias("line_no"), F.col("reason").alias("src"), F.lit(None).cast("string").alias("tgt"))
    return rows.union(lost.distinct())


ARCHIVE_LINES = 1 << 16
PART_LETTERS = "ABCDEFGHIJ"


def _pair_members(pair: str, part: int) -> tuple[str, list[str], str, int | None]:
    """The name of an archive, its two text members, its scores and how many there are (none: one a line)."""
    mark = "".join(PART_LETTERS[int(x)] for x in str(part))
    langs = [f"{x}{mark}" for x in pair.split("-")]
    name = "-".join(langs[::-1] if pair == "de-es" else langs)
    return f"{name}.txt.zip", [f"set.{name}.{x}" for x in langs], f"set.{name}.scores", 1


def _set_members(pair: str, part: int) -> tuple[str, list[str], str, int | None]:
    return f"{pair}.{part}.zip", [f"{pair}.{x}" for x in pair.split("-")], f"{pair}.scores", None


def _write_archives(packed, root: str, members, lost: tuple[str, int] | None = None) -> None:
    """One archive for each ``pair, part``, its lines by ``row_idx``; of the pair and side ``lost`` the last line is left out.

    The tasks get the lines in the order of the archives and their members and pack them as they come: besides the
    packed bytes of one archive they hold a batch, however long an archive is.
    """
    sides = packed.select("pair", "part", "row_idx", F.posexplode(F.array("src", "tgt")).alias("side", "line"))
    dealt = sides.repartition("pair", "part").sortWithinPartitions("pair", "part", "side", "row_idx")
    dealt.select("pair", "part", "side", "line").mapInPandas(_archive_writer(root, members, lost), "path string").write.format("noop").mode("overwrite").save()


def _archive_writer(root: str, members, lost: tuple[str, int] | None):
    def write(batches):
        import io
        import zipfile

        import pandas as pd
        from pyarrow import fs

        filesystem, folder = fs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")
        filesystem.create_dir(folder, recursive=True)

        def of_archives(runs):
            """``name, data`` of each archive; ``runs`` are ``(pair, part), side, lines``, an archive's and a member's one behind the other."""
            for (pair, part), parts in itertools.groupby(runs, key=lambda run: run[0]):
                name, texts, scores, n_scores = members(pair, part)
                data, count = io.BytesIO(), 0
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
                    for side, found in itertools.groupby(parts, key=lambda run: run[1]):
                        # the line before is written when another one follows it
                        held = None
                        with out.open(texts[side], "w") as member:
                            for _, _, lines in found:
                                if held is not None:
                                    member.write(held)
                                member.write("".join(line + "\n" for line in lines[:-1]).encode())
                                held, count = (lines[-1] + "\n").encode(), count + (side == 0) * len(lines)
                            if (pair, side) != lost:
                                member.write(held)
                    out.writestr(scores, "0\n" * (count if n_scores is None else n_scores))
                    if n_scores is None:
                        out.writestr("LICENSE", "free")
                yield name, data

        runs = (((pair, part), side, rows["line"].tolist()) for batch in batches
                for (pair, part, side), rows in batch.groupby(["pair", "part", "side"], sort=False))
        for name, data in of_archives(runs):
            # the name depends on the data only: a task that runs again writes the same file
            with filesystem.open_output_stream(f"{folder}/{name}") as sink:
                sink.write(data.getbuffer())
            yield pd.DataFrame({"path": [name]})

    return write


@query("results_append", """
  SELECT 'checkpoint_' || k AS checkpoint, metric, CAST(src_lang AS VARCHAR) AS src_lang, CAST(tgt_lang AS VARCHAR) AS tgt_lang, floor(score * k * 1e6 + 0.5) / 1e6 AS score
  FROM grid, (VALUES (1), (2)) v(k)""")
def results_append(spark, sf):
    path = shared_folder(spark, "results")
    for k in (1, 2):
        rows = t.grid(spark, sf).select(F.lit(f"checkpoint_{k}").alias("checkpoint"), "metric", F.col("src_lang").cast("string").alias("src_lang"),
                                        F.col("tgt_lang").cast("string").alias("tgt_lang"), t.r6(F.col("score") * k).alias("score"))
        sinks.append_results(rows, path)
    return sinks.read_table(spark, path, "checkpoint string, metric string, src_lang string, tgt_lang string, score double")
