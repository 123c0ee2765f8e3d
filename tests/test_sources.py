from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wattloom.sources import tables
from wattloom.sources.pages import html_cells, incomplete_rows
from wattloom.sources.readings import materialise, read_allocations, read_readings, register
from wattloom.sources.tables import (
    append_missing, cluster_code, only_missing, read_parts, read_run, read_table, run_code, union_parts, write_run, write_table)


def test_readings_and_allocations(spark, tmp_path):
    Path(tmp_path / "a.txt").write_text("1001 19501 0.14\n1001 19503 0.21\n")
    Path(tmp_path / "b.txt").write_text("1002 19549 0.30\n")
    df = read_readings(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert df.dtypes == [("id", "string"), ("code", "string"), ("value", "double")]
    assert rows(df, "id", "code")[0] == ("1001", "19501", 0.14) and df.count() == 3
    Path(tmp_path / "alloc.csv").write_text("id,code,other\n1001,1,x\n1002,3,y\n")
    alloc = read_allocations(spark, str(tmp_path / "alloc.csv"))
    assert rows(alloc, "id") == [("1001", "1"), ("1002", "3")]
    register(df, "raw_view")
    assert spark.sql("select count(*) n from raw_view").first().n == 3
    kept = materialise(df)
    assert kept.is_cached
    kept.unpersist()


def test_write_read_partitioned(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("month"))
    write_table(df, str(tmp_path / "t"), ("month",))
    assert {p.name for p in (tmp_path / "t").glob("month=*")} == {"month=0", "month=1", "month=2"}
    back = read_table(spark, str(tmp_path / "t"))
    assert back.count() == 100 and "PartitionFilters: [isnotnull(month" in \
        back.where("month = 1")._jdf.queryExecution().toString()


def test_append_missing_twice_adds_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    second = spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string")
    append_missing(first, path, "k")
    append_missing(second, path, "k")
    assert rows(read_table(spark, path), "k") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(only_missing(second, first, "k"), "k") == [(3, "c")]


def test_union_and_daily_parts(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(2, "n")], "k int, y string")
    assert rows(union_parts([a, b]), "k") == [(1, 2.0, None), (2, None, "n")]
    write_table(a, str(tmp_path / "2009-01-01"))
    write_table(b, str(tmp_path / "2009-01-02"))
    assert rows(read_parts(spark, str(tmp_path)).select("k", "x", "y"), "k") == [(1, 2.0, None), (2, None, "n")]


def test_run_codes(spark):
    df = spark.createDataFrame(
        [(4, "kmeans", "pca", 2), (2, "dbscan", None, None), (1, None, None, None)],
        "n int, m string, r string, d int")
    code = cluster_code(F.col("n"), F.col("m"), F.col("r"), F.col("d"))
    run = run_code(F.lit("linear"), code, F.lit("summer"), F.col("r"), F.col("d"))
    assert [r.c for r in df.select(run.alias("c")).collect()] == [
        "linear_kmeans(nc=4)(pca,2)_pca(2)_summer", "linear_dbscan(nc=2)(noReduce)_noFeatureReduce_summer",
        "linear_noCluster_noFeatureReduce_summer"]


def test_write_run_appends_four_tables(spark, tmp_path):
    part = spark.createDataFrame([(1,)], "x int")
    for run_id in ("r1", "r2"):
        write_run(str(tmp_path), {"run_id": run_id, "model": "m", "season": "summer"}, part, part, part, part)
    for name in ("clusters", "metrics", "timings", "forecasts"):
        back = read_table(spark, f"{tmp_path}/{name}")
        assert {r.run_id for r in back.collect()} == {"r1", "r2"} and (tmp_path / name / "model=m" / "season=summer").exists()


def test_html_cells_follow_the_header_of_each_page(spark):
    head = "<tr><th>B</th><th scope=col>A</th></tr>"
    pages = [
        (1, f"<table>{head}<tr><td>x &amp; y</td><TD class='q'><b>1</b>\n 2</TD></tr><tr><td>u</td><td></td></tr></table>"),
        (2, "<table><tr><th>A</th><th>B</th></tr><tr><td>&lt;i&gt;</td><td>&nbsp;v</td></tr></table>"),
        (3, "<p>no table, <thead>nor cells</thead></p>"),
        (4, head),
    ]
    df = html_cells(spark.createDataFrame(pages, "id int, html string"), "html", ("A", "B"))
    assert rows(df, "id", "row") == [(1, 1, "1 2", "x & y"), (1, 2, "", "u"), (2, 1, "<i>", "v")]


def test_html_cells_reads_the_observation_table_only(spark):
    menu = "<table><tr><td>A</td><td>menu</td><td>x</td></tr></table>"
    page = f"{menu}<table><tr><td colspan=2>title</td></tr><tr><th>B</th><th>A</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>{menu}"
    df = spark.createDataFrame([(1, page), (2, menu), (3, None)], "id int, html string")
    assert rows(html_cells(df, "html", ("A", "B")), "id", "row") == [(1, 1, "2", "1"), (1, 2, None, "3")]
    assert incomplete_rows(df, "html", ("A", "B")).first()[0] == 1


def test_a_broken_run_leaves_no_rows_behind(spark, tmp_path, monkeypatch):
    part, run = spark.createDataFrame([(1,)], "x int"), {"run_id": "r1", "model": "m", "season": "summer"}
    write = tables.write_table

    def broken(df, path, *args, **options):
        if path.endswith("metrics"):
            raise RuntimeError("lost")
        write(df, path, *args, **options)

    monkeypatch.setattr(tables, "write_table", broken)
    with pytest.raises(RuntimeError):
        write_run(str(tmp_path), run, part, part, part, part)
    monkeypatch.setattr(tables, "write_table", write)
    write_run(str(tmp_path), run, part, part, part, part)
    assert read_table(spark, f"{tmp_path}/forecasts").count() == 2
    assert all(read_run(spark, str(tmp_path), name).count() == 1 for name in tables.RUN_TABLES)
