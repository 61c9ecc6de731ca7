"""Reports over direction scores, and checkpoint selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.fixed_values import METRIC_KEYS
from tandem.operators import planning as p
from tandem.operators import report as r
from tandem.plans import evaluate as plan
from tandem.session import shared_folder
from tandem.sources import sinks, text as txt
from workload import tables as t
from workload.registry import query, view

# Metric logs: a direction line, then its score line, as the scoring tools print them.
view("metric_log", """
  SELECT 'c1' AS checkpoint, metric, (src_lang * 100 + tgt_lang) * 4 + k AS line_no,
         CASE k WHEN 0 THEN src_lang || '-' || tgt_lang
                WHEN 1 THEN '{ "name": "x", "score": 0.01, }'
                WHEN 2 THEN '"name": x "score": ' || format('{:.4f}', score) || '1, "signature": y' ELSE 'done' END AS line
  FROM grid, (SELECT unnest([0, 1, 2, 3]) AS k)""")


def metric_log(spark, sf):
    line = F.array(
        F.concat_ws("-", F.col("src_lang").cast("string"), F.col("tgt_lang").cast("string")),
        F.lit('{ "name": "x", "score": 0.01, }'),
        F.concat(F.lit('"name": x "score": '), F.format_string("%.4f", "score"), F.lit('1, "signature": y')),
        F.lit("done"),
    )
    rows = t.grid(spark, sf).select("metric", "src_lang", "tgt_lang", F.posexplode(line).alias("k", "line"))
    no = ((F.col("src_lang") * 100 + F.col("tgt_lang")) * 4 + F.col("k")).cast("long")
    return rows.select(F.lit("c1").alias("checkpoint"), "metric", no.alias("line_no"), "line")


@query("metric_log_parse", """
  SELECT checkpoint, metric, src_lang, tgt_lang, arg_max(round(v, 2), line_no) AS score FROM (
    SELECT checkpoint, metric, line_no, string_split(pair, '-')[1] AS src_lang, string_split(pair, '-')[2] AS tgt_lang,
           CAST(trim(string_split(string_split(line, ':')[3], ',')[1]) AS DOUBLE) AS v
    FROM (SELECT *, last_value(CASE WHEN contains(line, '-') AND length(line) < 8 THEN line END IGNORE NULLS)
                    OVER (PARTITION BY checkpoint, metric ORDER BY line_no) AS pair FROM metric_log) WHERE contains(line, 'score'))
  GROUP BY checkpoint, metric, src_lang, tgt_lang""")
def metric_log_parse(spark, sf):
    return r.parse_metric_log(metric_log(spark, sf), keys=METRIC_KEYS)


@query("metric_log_read", """
  SELECT 'c1' AS checkpoint, metric, row_number() OVER (PARTITION BY metric ORDER BY src_lang, tgt_lang, k) AS line_no,
         CASE k WHEN 0 THEN src_lang || '-' || tgt_lang ELSE '"score": ' || n || '.25, "signature": y' END AS line
  FROM grid, (SELECT unnest([0, 1]) AS k)""")
def metric_log_read(spark, sf):
    """Metric logs as files by checkpoint and metric, as long as there are directions, read back with line numbers."""
    root = shared_folder(spark, "metric-logs")
    pair = F.concat_ws("-", F.col("src_lang").cast("string"), F.col("tgt_lang").cast("string"))
    score = F.concat(F.lit('"score": '), F.col("n").cast("string"), F.lit('.25, "signature": y'))
    rows = t.grid(spark, sf).select(F.concat(F.lit("c1."), F.col("metric")).alias("file"), "src_lang", "tgt_lang", F.posexplode(F.array(pair, score)).alias("k", "line"))
    t.write_files(rows.select("file", ((F.col("src_lang") * 1000 + F.col("tgt_lang")) * 2 + F.col("k")).alias("ord"), "line"), root)
    return txt.read_metric_log(spark, f"{root}/*")


view("matrix", """
  SELECT metric, d.src_lang, d.tgt_lang, coalesce(score, 0) AS score, score IS NULL AS missing
  FROM (SELECT src_lang, tgt_lang, unnest(['spbleu', 'chrf']) AS metric FROM all_directions) d
  LEFT JOIN grid g USING (metric, src_lang, tgt_lang)""")


def scores(spark, sf):
    return t.grid(spark, sf).select("metric", "src_lang", "tgt_lang", "score")


def matrix(spark, sf):
    return r.dense_matrix(scores(spark, sf), t.lang_dim(spark, sf))


def s6(expr: str) -> str:
    return f"floor({expr} * 1e6 + 0.5) / 1e6"


@query("dense_matrix", f"SELECT metric, src_lang, tgt_lang, {s6('score')} AS score, missing FROM matrix")
def dense_matrix(spark, sf):
    return matrix(spark, sf).withColumn("score", t.r6(F.col("score")))


view("labelled", """
  SELECT m.*, CASE WHEN a.is_bridge OR b.is_bridge OR e.src_lang IS NOT NULL THEN 'supervised' ELSE 'zero' END AS label,
         a.family AS sf, b.family AS tf FROM matrix m JOIN lang_dim a ON a.lang = m.src_lang JOIN lang_dim b ON b.lang = m.tgt_lang
  LEFT JOIN (SELECT src_lang, tgt_lang FROM extra UNION SELECT tgt_lang, src_lang FROM extra) e ON e.src_lang = m.src_lang AND e.tgt_lang = m.tgt_lang""")
view("split_means", """
  SELECT metric, coalesce(label, 'averaged') AS label, count(*) AS n, avg(score) AS score
  FROM labelled GROUP BY GROUPING SETS ((metric, label), (metric))""")
view("fam_means", """
  SELECT metric, coalesce(CAST(sf AS VARCHAR), 'x') || '2' || coalesce(CAST(tf AS VARCHAR), 'x') AS label, count(*) AS n, avg(score) AS score
  FROM labelled GROUP BY GROUPING SETS ((metric, sf, tf), (metric, sf), (metric, tf), (metric))""")
view("all_means", "SELECT * FROM split_means UNION ALL SELECT * FROM fam_means")


@query("supervision_split", f"SELECT metric, label, n, {s6('score')} AS score FROM split_means")
def supervision_split(spark, sf):
    df = r.supervision_split(matrix(spark, sf), t.lang_dim(spark, sf), t.extra(spark, sf))
    return df.withColumn("score", t.r6(F.col("score")))


@query("supervision_split_skip", f"""
  SELECT metric, coalesce(label, 'averaged') AS label, count(*) AS n, {s6('coalesce(avg(score) FILTER (NOT missing), 0)')} AS score
  FROM labelled GROUP BY GROUPING SETS ((metric, label), (metric))""")
def supervision_split_skip(spark, sf):
    df = r.supervision_split(matrix(spark, sf), t.lang_dim(spark, sf), t.extra(spark, sf), skip_missing=True)
    return df.withColumn("score", t.r6(F.col("score")))


@query("trained_flag", """
  SELECT metric, src_lang, tgt_lang, pair IS NOT NULL AS trained FROM matrix LEFT JOIN (
    SELECT src_lang, tgt_lang, pair FROM total_pairs UNION SELECT tgt_lang, src_lang, pair FROM total_pairs) USING (src_lang, tgt_lang)""")
def trained_flag(spark, sf):
    dim = t.lang_dim(spark, sf)
    trained = p.bidirectional_pairs(p.total_pairs(dim, t.extra(spark, sf)))
    return r.trained_flag(matrix(spark, sf), trained).select("metric", "src_lang", "tgt_lang", "trained")


@query("family_means", f"SELECT metric, label, n, {s6('score')} AS score FROM fam_means")
def family_means(spark, sf):
    return r.family_means(matrix(spark, sf), t.lang_dim(spark, sf)).withColumn("score", t.r6(F.col("score")))


_FAMILIES = ["-1", "0", "1", "2", "3", "4"]
_LABELS = r.overview_labels(_FAMILIES, "-1")
_BAR = ", ".join(f"{s6(f'coalesce(max(score) FILTER (label = {chr(39)}{x}{chr(39)}), 0)')} AS \"{x}\"" for x in _LABELS)


@query("overview_bar", f"SELECT metric, {_BAR} FROM all_means GROUP BY metric")
def overview_bar(spark, sf):
    means = r.report(scores(spark, sf), t.lang_dim(spark, sf), t.extra(spark, sf))
    bar = r.overview_bar(means, _LABELS, digits2=False)
    return bar.select("metric", *[t.r6(F.col(f"`{x}`")).alias(x) for x in _LABELS])


_NATIONS = list(range(25))
_CELLS = ", ".join(f"{s6(f'max(nullif(score, 0)) FILTER (tgt_lang = {x})')} AS \"{x}\"" for x in _NATIONS)


@query("score_matrix", f"SELECT metric, src_lang, {_CELLS} FROM matrix GROUP BY metric, src_lang")
def score_matrix(spark, sf):
    sheet = r.score_matrix(matrix(spark, sf), _NATIONS)
    return sheet.select("metric", "src_lang", *[t.r6(F.col(f"`{x}`")).alias(str(x)) for x in _NATIONS])


@query("matrix_export", f"SELECT metric, CAST(src_lang AS VARCHAR) AS src_lang, {', '.join(f'{s6(chr(34) + str(x) + chr(34))} AS {chr(34)}{x}{chr(34)}' for x in _NATIONS)} FROM (SELECT metric, src_lang, {_CELLS} FROM matrix GROUP BY metric, src_lang)")
def matrix_export(spark, sf):
    """The sheet written as CSV and read back; a blank cell stays blank."""
    path = shared_folder(spark, "sheet")
    sinks.export_matrix(score_matrix(spark, sf), path)
    schema = "metric string, src_lang string, " + ", ".join(f"`{x}` double" for x in _NATIONS)
    return spark.read.schema(schema).option("header", True).csv(path)


def _nz(cond: str) -> str:
    return f"avg(score) FILTER (score <> 0 AND ({cond}))"


@query("hub_overview", f"""
  SELECT metric, {s6('h')} AS hub2m, {s6('m')} AS m2hub, {s6('(h + m) / 2')} AS supervised, {s6('z')} AS zero, {s6('a')} AS averaged FROM (
    SELECT metric, {_nz('src_lang = 0')} AS h, {_nz('tgt_lang = 0')} AS m, {_nz('src_lang <> 0 AND tgt_lang <> 0')} AS z, {_nz('true')} AS a
    FROM matrix GROUP BY metric)""")
def hub_overview(spark, sf):
    df = r.hub_overview(matrix(spark, sf), 0)
    return df.select("metric", *[t.r6(F.col(x)).alias(x) for x in df.columns[1:]])


view("class_cells", """
  SELECT m.metric, a.class AS src_class, b.class AS tgt_class, score FROM matrix m JOIN classes a ON a.lang = m.src_lang JOIN classes b ON b.lang = m.tgt_lang
  WHERE m.metric NOT IN (SELECT metric FROM supported) OR m.src_lang IN (SELECT lang FROM supported) OR m.tgt_lang IN (SELECT lang FROM supported)""")
view("class_avg", "SELECT metric, src_class, tgt_class, count(*) AS n, avg(score) AS score FROM class_cells GROUP BY ALL")


def classed(spark, sf):
    return r.class_means(matrix(spark, sf), t.classes(spark, sf), t.supported(spark, sf))


@query("class_means", f"SELECT metric, src_class, tgt_class, n, {s6('score')} AS score FROM class_avg")
def class_means(spark, sf):
    return classed(spark, sf).withColumn("score", t.r6(F.col("score")))


@query("class_marginals", f"""
  SELECT metric, '~2' || tgt_class AS label, {s6('sum(score) / 4')} AS score FROM class_avg GROUP BY metric, tgt_class
  UNION ALL SELECT metric, src_class || '2~', {s6('sum(score) / 4')} FROM class_avg GROUP BY metric, src_class""")
def class_marginals(spark, sf):
    return r.class_marginals(classed(spark, sf)).withColumn("score", t.r6(F.col("score")))


view("hub_means", f"""
  SELECT metric, {_nz('src_lang = 0')} AS h, {_nz('tgt_lang = 0')} AS m, {_nz('src_lang <> 0 AND tgt_lang <> 0')} AS z, {_nz('true')} AS a FROM matrix GROUP BY metric""")


@query("benchmark_report", f"""
  SELECT metric, label, {s6('score')} AS score FROM (
    SELECT metric, unnest(['hub2m', 'm2hub', 'supervised', 'zero', 'averaged']) AS label, unnest([h, m, (h + m) / 2, z, a]) AS score FROM hub_means
    UNION ALL SELECT metric, src_class || '2' || tgt_class, score FROM class_avg
    UNION ALL SELECT metric, '~2' || tgt_class, sum(score) / 4 FROM class_avg GROUP BY metric, tgt_class
    UNION ALL SELECT metric, src_class || '2~', sum(score) / 4 FROM class_avg GROUP BY metric, src_class)""")
def benchmark_report(spark, sf):
    df = plan.benchmark_report(matrix(spark, sf), 0, t.classes(spark, sf), t.supported(spark, sf))
    return df.withColumn("score", t.r6(F.col("score")))


@query("report_all_metrics", f"SELECT metric, label, n, {s6('score')} AS score FROM all_means")
def report_all_metrics(spark, sf):
    df = r.report(scores(spark, sf), t.lang_dim(spark, sf), t.extra(spark, sf))
    return df.withColumn("score", t.r6(F.col("score")))


# Checkpoints: one per embedding; the label is its epoch, the id its update. Some are averages.
view("checkpoints", """
  SELECT vec_id, label, embedding, CASE WHEN md5(CAST(vec_id AS VARCHAR)) < '1' THEN 'checkpoint_' || label || '_averaged.pt'
         ELSE 'checkpoint_' || label || '_' || vec_id * 1000 || '.pt' END AS name FROM embeddings""")


def checkpoints(spark, sf):
    label, vec = F.col("label").cast("string"), (F.col("vec_id") * 1000).cast("string")
    name = F.when(F.md5(F.col("vec_id").cast("string")) < "1", F.concat(F.lit("checkpoint_"), label, F.lit("_averaged.pt"))).otherwise(
        F.concat(F.lit("checkpoint_"), label, F.lit("_"), vec, F.lit(".pt")))
    return t.load(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("params"), name.alias("name"))


# measured: a table exists for every checkpoint whose id some customer has
@query("skip_measured", "SELECT vec_id, name FROM checkpoints WHERE name NOT IN (SELECT name FROM checkpoints JOIN customer ON c_custkey = vec_id WHERE c_mktsegment = 'BUILDING')")
def skip_measured(spark, sf):
    done = t.load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("vec_id"))
    points = checkpoints(spark, sf)
    measured = points.join(done, "vec_id", "left_semi").select("name")
    return r.skip_measured(points, measured).select("vec_id", "name")


@query("select_checkpoints", """
  SELECT 'all' AS mode, vec_id, name FROM checkpoints UNION ALL
  SELECT 'averaged', vec_id, name FROM checkpoints WHERE name = 'checkpoint_1_averaged.pt' UNION ALL
  SELECT 'one', vec_id, name FROM checkpoints WHERE name = (SELECT max(name) FROM checkpoints WHERE name NOT LIKE '%averaged%')""")
def select_checkpoints(spark, sf):
    points = checkpoints(spark, sf).select("vec_id", "name")
    newest = points.where(~F.col("name").contains("averaged")).agg(F.max("name")).first()[0]
    picks = [("all", "all"), ("averaged", "averaged"), ("one", newest.removeprefix("checkpoint_").removesuffix(".pt"))]
    out = None
    for label, mode in picks:
        part = r.select_checkpoints(points, mode).select(F.lit(label).alias("mode"), "vec_id", "name")
        out = part if out is None else out.unionByName(part)
    return out


view("last_five", """
  SELECT vec_id, name, update_no, label, embedding FROM (
    SELECT *, TRY_CAST(string_split_regex(name, '[_.]')[-2] AS BIGINT) AS update_no FROM checkpoints)
  WHERE update_no IS NOT NULL ORDER BY update_no DESC, name LIMIT 5""")


@query("last_k_checkpoints", "SELECT vec_id, name, update_no FROM last_five")
def last_k_checkpoints(spark, sf):
    return r.last_k(checkpoints(spark, sf)).select("vec_id", "name", "update_no")


_MEANS = "SELECT {0}, pos, avg(CAST(v AS DOUBLE)) AS a FROM (SELECT {0}, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM {1}) GROUP BY ALL"
_JOINED = "array_to_string(list(CAST(CAST(floor(a * 1e6 + 0.5) AS BIGINT) AS VARCHAR) ORDER BY pos), ' ') AS params"


@query("average_vectors", f"""
  SELECT CAST(label AS VARCHAR) AS grp, {_JOINED} FROM ({_MEANS.format('label', 'checkpoints')}) GROUP BY label
  UNION ALL SELECT 'last five', {_JOINED} FROM ({_MEANS.format("'x' AS label", 'last_five')})""")
def average_vectors(spark, sf):
    points = checkpoints(spark, sf)
    rows = points.select(F.col("label").cast("string").alias("grp"), "params").unionByName(
        r.last_k(points).select(F.lit("last five").alias("grp"), "params"))
    means = r.average_vectors(rows, ["grp"])
    return means.select("grp", F.array_join(F.transform("params", lambda x: F.floor(x * 1e6 + 0.5).cast("string")), " ").alias("params"))
