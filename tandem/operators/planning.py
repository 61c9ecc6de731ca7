"""Languages, pairs and directions: dimension tables of at most a few thousand rows.

Windows without a partition key appear only here and in reports, where the row
count is bounded by the number of directions, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.fixed_values import FLORES_OVERRIDES, LANGUAGE_CODES

CODE_SYSTEMS = ("m2m", "nllb", "language")


def language_dim(spark: SparkSession, families: dict[str, list[str]], bridges: list[str], hub: str) -> DataFrame:
    """``lang, idx, family, is_hub, is_bridge``; ``idx`` follows the listing order."""
    groups = spark.createDataFrame(
        [(i, family, langs) for i, (family, langs) in enumerate(families.items())],
        "family_no int, family string, langs array<string>",
    )
    flat = groups.select("family_no", "family", F.posexplode("langs").alias("pos", "lang"))
    listed = flat.withColumn("idx", F.row_number().over(Window.orderBy("family_no", "pos")) - 1)
    bridge = spark.createDataFrame([(b,) for b in bridges], "lang string").withColumn("is_bridge", F.lit(True))
    return listed.join(bridge, "lang", "left").select(
        "lang", "idx", "family", (F.col("lang") == hub).alias("is_hub"),
        F.coalesce("is_bridge", F.lit(False)).alias("is_bridge"),
    )


def join_pair(src: Column, tgt: Column) -> Column:
    return F.concat_ws("-", src.cast("string"), tgt.cast("string"))


def split_pair(pair: Column) -> tuple[Column, Column]:
    parts = F.split(pair, "-")
    return parts[0], parts[1]


_KEYS = ["src_lang", "tgt_lang", "pair"]


def _matched(dim: DataFrame, condition: Column) -> DataFrame:
    a, b = dim.alias("a"), dim.alias("b")
    return a.join(b, condition).select(
        F.col("a.lang").alias("src_lang"), F.col("b.lang").alias("tgt_lang"),
        join_pair(F.col("a.lang"), F.col("b.lang")).alias("pair"),
        F.col("a.idx").cast("int").alias("_o1"), F.col("b.idx").cast("int").alias("_o2"),
    )


def _hub(dim: DataFrame) -> DataFrame:
    return _matched(dim, F.col("a.is_hub") & (F.col("a.lang") != F.col("b.lang")))


def _family(dim: DataFrame) -> DataFrame:
    return _matched(dim, (F.col("a.family") == F.col("b.family")) & ~F.col("a.is_hub") & ~F.col("b.is_hub")
                    & F.col("a.is_bridge") & ~F.col("b.is_bridge"))


def _bridge(dim: DataFrame) -> DataFrame:
    return _matched(dim, F.col("a.is_bridge") & F.col("b.is_bridge") & ~F.col("a.is_hub") & ~F.col("b.is_hub")
                    & (F.col("a.idx") < F.col("b.idx")))


def hub_pairs(dim: DataFrame) -> DataFrame:
    """The hub with every other language."""
    return _hub(dim).select(_KEYS)


def within_family_pairs(dim: DataFrame) -> DataFrame:
    """Bridge x non-bridge inside each family other than the hub's."""
    return _family(dim).select(_KEYS)


def bridge_pairs(dim: DataFrame) -> DataFrame:
    """Every unordered pair of bridges, hub left out."""
    return _bridge(dim).select(_KEYS)


def extra_pairs(spark: SparkSession, pairs: list[str]) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(pairs)), "ord int, pair string")
    src, tgt = split_pair(F.col("pair"))
    return rows.select("ord", src.alias("src_lang"), tgt.alias("tgt_lang"), "pair")


def total_pairs(dim: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Hub, family, bridge, then extra pairs, with a 1-based ``ord`` over the whole list."""
    parts = [("hub", _hub(dim)), ("family", _family(dim)), ("bridge", _bridge(dim))]
    if extra is not None:
        parts.append(("extra", extra.select(*_KEYS, F.col("ord").alias("_o1"), F.lit(0).alias("_o2"))))
    listed = [
        part.withColumns({"origin": F.lit(origin), "_rank": F.lit(rank)})
        for rank, (origin, part) in enumerate(parts)
    ]
    rows = listed[0]
    for part in listed[1:]:
        rows = rows.unionByName(part)
    ord_ = F.row_number().over(Window.orderBy("_rank", "_o1", "_o2"))
    return rows.select(*_KEYS, "origin", ord_.alias("ord"))


def bidirectional_pairs(pairs: DataFrame) -> DataFrame:
    """The listed pairs followed by their swapped copies, in the same order."""
    swapped = pairs.select(
        F.col("tgt_lang").alias("src_lang"), F.col("src_lang").alias("tgt_lang"),
        join_pair(F.col("tgt_lang"), F.col("src_lang")).alias("pair"), "origin", "ord", F.lit(1).alias("_half"),
    )
    both = pairs.withColumn("_half", F.lit(0)).unionByName(swapped)
    return both.withColumn("ord", F.row_number().over(Window.orderBy("_half", "ord"))).drop("_half")


def all_directions(dim: DataFrame) -> DataFrame:
    """Every ordered pair of distinct languages, listed source by source."""
    rows = _matched(dim, F.col("a.lang") != F.col("b.lang"))
    return rows.select(*_KEYS, F.row_number().over(Window.orderBy("_o1", "_o2")).alias("ord"))


# Work splitting over a list of directions --------------------------------------------------


def _position(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumns({
        "_rn": F.row_number().over(Window.orderBy(*order)) - 1,
        "_cnt": F.count(F.lit(1)).over(Window.partitionBy()),
    })


def partition_balanced(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """0-based ``part``: the first ``count mod n`` parts get one more."""
    return df.withColumn("part", F.ntile(n).over(Window.orderBy(*order)) - 1)


def partition_floor(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """n-1 parts of ``floor(count/n)``, the last takes the rest; with fewer items than parts, one each."""
    size = F.greatest(F.floor(F.col("_cnt") / n), F.lit(1))
    part = F.least(F.floor(F.col("_rn") / size), F.lit(n - 1)).cast("int")
    return _position(df, order).withColumn("part", part).drop("_rn", "_cnt")


def partition_ceil(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Parts of ``ceil(count/n)``, the last one short."""
    part = F.floor(F.col("_rn") / F.ceil(F.col("_cnt") / n)).cast("int")
    return _position(df, order).withColumn("part", part).drop("_rn", "_cnt")


# Language codes -----------------------------------------------------------------------------


def code_map(spark: SparkSession, table: str = LANGUAGE_CODES) -> DataFrame:
    """``name, m2m, nllb, flores``; any wider table in the same ``name|m2m|nllb`` form may be passed."""
    rows = [tuple(None if v == "-" else v for v in line.split("|")) for line in table.strip().splitlines()]
    return with_flores(spark.createDataFrame(rows, "name string, m2m string, nllb string"))


def with_flores(codes: DataFrame) -> DataFrame:
    override = F.create_map(*[F.lit(v) for pair in FLORES_OVERRIDES.items() for v in pair])
    return codes.withColumn("flores", F.coalesce(override[F.col("nllb")], F.col("nllb")))


def translate_code(df: DataFrame, col: str, codes: DataFrame, source: str, output: str, name: str = "translated") -> DataFrame:
    """Look a code up in one naming system and give it in another; unknown codes give null."""
    if source not in CODE_SYSTEMS or output not in (*CODE_SYSTEMS, "flores"):
        raise ValueError(f"unknown code system: {source} or {output}")
    field = {"language": "name"}
    found = codes.select(
        F.col(field.get(source, source)).alias("_key"), F.col(field.get(output, output)).alias(name)
    ).where(F.col("_key").isNotNull())
    if source == "language" and output == "language":
        return df.withColumn(name, F.col(col))
    # bounded: one row per language; a join by code would gather a common language in one task
    return df.join(F.broadcast(found), F.col(col) == F.col("_key"), "left").drop("_key")


def code_map_coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two ``name, code`` systems with the side each name is missing from."""
    l = left.select("name", F.col("code").alias("left_code"))
    r = right.select("name", F.col("code").alias("right_code"))
    return l.join(r, "name", "full_outer").withColumn(
        "coverage",
        F.when(F.col("left_code").isNull(), "right only").when(F.col("right_code").isNull(), "left only").otherwise("both"),
    )


def supported_only(df: DataFrame, supported: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose languages in ``cols`` are all in ``supported.lang``."""
    for col in cols:
        # bounded: one row per language
        df = df.join(F.broadcast(supported.select(F.col("lang").alias(col)).distinct()), col, "left_semi")
    return df
