"""Sources and sinks: given tables are written below the checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattloom.functions.columns import columns_like, drop_like
from wattloom.operators.series import to_daily, to_wide
from wattloom.plans.inputs import readings
from wattloom.plans.meter_queries import CODE_SQL, coded
from wattloom.plans.registry import query, table, text_time
from wattloom.session import checkpoint_folder
from wattloom.sources.readings import materialise, read_allocations, read_readings, register
from wattloom.sources.tables import append_missing, read_run, read_table, write_run, write_table

ROUND_SQL = "CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE)"


def scratch(spark) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/sources-{uuid.uuid4()}"


@query("read_readings", f"SELECT CAST(user_id AS VARCHAR) AS id, {CODE_SQL} AS code, {ROUND_SQL} AS value FROM events")
def files_of_readings(spark, sf):
    path, rows = scratch(spark), coded(spark, sf)
    lines = rows.select(F.concat_ws(" ", F.col("id").cast("string"), "code", F.col("value").cast("double").cast("string")))
    lines.write.text(path)
    return read_readings(spark, path)


@query("read_allocations", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS code FROM customer")
def files_of_allocations(spark, sf):
    path = scratch(spark)
    named = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("code"), "c_name")
    named.write.option("header", True).csv(path)
    return read_allocations(spark, path)


@query("registered_view", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def registered_view(spark, sf):
    register(readings(spark, sf), "wattloom_readings")
    return spark.sql("SELECT event_type, count(*) AS n FROM wattloom_readings GROUP BY event_type")


@query("materialised", "SELECT user_id AS meter_id, count(*) AS n FROM events GROUP BY 1")
def materialised(spark, sf):
    return materialise(readings(spark, sf)).groupBy("meter_id").agg(F.count("*").alias("n"))


@query("written_months", f"""
    SELECT event_id, strftime(ts, '%Y-%m') AS month, {ROUND_SQL} AS value FROM events""")
def written_months(spark, sf):
    path = scratch(spark)
    rows = readings(spark, sf).select("event_id", F.date_format("time", "yyyy-MM").alias("month"), F.col("value").cast("double").alias("value"))
    write_table(rows.where("event_id % 2 = 0"), path, ("month",), rows_per_file=1000)
    append_missing(rows, path, "event_id", ("month",))
    return read_table(spark, path).withColumn("month", F.date_format(F.col("month").cast("date"), "yyyy-MM"))


@query("written_runs", """
    SELECT event_type AS run_id, 'metrics' AS part, count(*) AS n FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'forecasts', count(*) FROM events GROUP BY 1""")
def written_runs(spark, sf):
    root, rows = scratch(spark), readings(spark, sf).select("event_type", "event_id")
    types = [r["event_type"] for r in rows.select("event_type").distinct().collect()]
    for kind in types:
        part = rows.where(F.col("event_type") == kind)
        write_run(root, {"run_id": kind, "model": "none", "season": "winter"}, part, part, part, part)
    parts = [read_run(spark, root, name).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name in ("metrics", "forecasts")]
    return parts[0].unionByName(parts[1])


@query("column_families", """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(SUM(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS herror
    FROM events GROUP BY 1""")
def column_families(spark, sf):
    days = to_daily(readings(spark, sf).withColumn("meter_id", F.col("event_type"))).withColumn("value", F.col("value").cast("double"))
    types = [r["event_type"] for r in readings(spark, sf).select("event_type").distinct().collect()]
    wide = to_wide(days, types, ("date",))
    kept = columns_like(wide, "^h")
    return text_time(drop_like(wide, "^h(?!error$)").select("date", *[c for c in kept if c == "herror"]), "date")
