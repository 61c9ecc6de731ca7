"""The language data the queries are built on, at uneven inputs."""

import glob

import pytest

from tandem.session import shuffle_tasks, staged
from tandem.sources.text import align_sides
from workload import tables as t

DOCS = [(1, "de", "a\nb\nc"), (2, "en", "x"), (3, "fr", ""), (4, "de", "d"), (5, "en", "y\nz\n"), (6, "de", "nobody"), (9000, "en", "w"), (9001, None, "q")]


@pytest.fixture
def uneven(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, lang string, text string")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_bitext_of_documents_with_uneven_lines(spark, uneven):
    got = sorted((r["pair"], r["line_no"], r["src"], r["tgt"]) for r in t.bitext(spark, uneven).collect())
    first, second, third = 1_000_001, 2_000_001, 3_000_001
    assert got == [("de-en", first, "a", "x"), ("de-en", second, "d", "y"), ("de-en", third, "nobody", "w"),
                   ("de-fr", first, "a", ""), ("en-fr", first, "x", "")]


def test_tasks_of_a_join_of_documents_follow_the_input(spark, uneven):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        splits = t.load(spark, uneven, "documents").select("text").rdd.getNumPartitions()
        assert splits > 4 and t.document_tasks(spark, uneven) == max(8, 2 * splits)
        assert t.bitext(spark, uneven).rdd.getNumPartitions() == max(8, 2 * splits)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_sides_are_aligned_in_as_many_tasks_as_asked(spark):
    sides = spark.range(100).selectExpr("'p' AS pair", "id AS line_no", "string(id) AS src")
    both = align_sides(sides, sides.withColumnRenamed("src", "tgt").where("line_no < 40"), 37)
    assert both.rdd.getNumPartitions() == 37 and both.count() == 40


def test_tasks_of_a_deduplication_are_raised_and_put_back(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), shuffle_tasks(spark, 100):
        assert spark.conf.get(name) == "100"
        raise KeyError
    for least in (None, 1):
        with shuffle_tasks(spark, least):
            assert spark.conf.get(name) == before
    assert spark.conf.get(name) == before


def test_staged_tables_are_written_small(spark):
    kept = staged(spark.range(10), "small")
    assert kept.count() == 10 and all(".zstd." in f for path in kept.inputFiles() for f in glob.glob(path.removeprefix("file:").replace("//", "")))
    assert ".zstd." in kept.inputFiles()[0]


def test_files_are_written_from_many_batches(spark, tmp_path):
    """Files that span batches and share tasks; lines that are empty."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        rows = [(f"f{k}", i, "" if i % 5 == 0 else f"{k}ß{i}") for k in range(20) for i in range(30, 0, -1)]
        t.write_files(spark.createDataFrame(rows, "file string, ord long, line string").repartition(6), f"file://{tmp_path}/out")
    finally:
        spark.conf.set(name, before)
    for k in range(20):
        assert (tmp_path / "out" / f"f{k}").read_text() == "".join(("" if i % 5 == 0 else f"{k}ß{i}") + "\n" for i in range(1, 31))
    assert len(list((tmp_path / "out").glob("f*"))) == 20


def test_no_task_of_an_alignment_gets_a_whole_language(spark, uneven):
    import __spark_entry__ as entry

    frame = entry.queries()["bitext_align"](spark, uneven)
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin [pair") == 1 and "SortMergeJoin [lang" not in plan
    assert sorted((r["pair"], r["line_no"]) for r in frame.collect()) == sorted((r["pair"], r["line_no"]) for r in t.bitext(spark, uneven).collect())
