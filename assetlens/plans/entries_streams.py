"""Entries of streams (M): each runs to its end over the log as it grows, and its SQL says what it must have written.

The log grows in portions: a portion is appended to the folder that the stream reads, then the stream runs over what is new. Micro-batches are the portions, so SQL can replay them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.plans.registry import query, rounded
from assetlens.plans.views import table
from assetlens.scratch import new_folder
from assetlens.streaming import alerts, guard, monitor, upserts

def _log_files(spark, sf) -> str:
    folder = new_folder(spark, "log")
    table(spark, sf, "events").repartition(3, "user_id").write.parquet(f"{folder}/in")
    return folder


def _ended(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@query("m1_growing_table", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def m1_growing_table(spark, sf):
    folder = _log_files(spark, sf)
    s = monitor.growing_table(spark, f"{folder}/in", table(spark, sf, "events").schema, 1)
    _ended(s.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("m2_count_windows", "SELECT user_id, floor(count(*)/20)::BIGINT AS windows, (floor(count(*)/20)*20)::BIGINT AS rows, CASE WHEN count(*)%20=0 THEN sum((event_type<>'error')::INT) END::BIGINT AS good_rows FROM events GROUP BY 1 HAVING count(*)>=20")
def m2_count_windows(spark, sf):
    folder = _log_files(spark, sf)
    s = monitor.growing_table(spark, f"{folder}/in", table(spark, sf, "events").schema, 1).withColumn("good", (F.col("event_type") != "error").cast("int"))
    out = monitor.count_windows(s, "user_id", 20, "good")
    _ended(out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out"))
    found = spark.read.schema(out.schema).parquet(f"{folder}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("rows").alias("rows"), F.sum("good_rows").alias("good"))
    # where windows take up all of a user's rows their good rows don't hang on the order of arrival
    whole = table(spark, sf, "events").groupBy("user_id").agg((F.count(F.lit(1)) % 20 == 0).alias("whole"))
    return found.join(whole, "user_id").select("user_id", "windows", "rows", F.when(F.col("whole"), F.col("good")).alias("good_rows"))


@query("m6_upsert_stream", "SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type,event_id) AS status, arg_max(value,event_id) FILTER (event_type<>'error') AS amount FROM events GROUP BY 1")
def m6_upsert_stream(spark, sf):
    folder = _log_files(spark, sf)
    s = monitor.growing_table(spark, f"{folder}/in", table(spark, sf, "events").schema, 1)
    s = s.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise("").alias("amount"))
    _ended(upserts.upsert_stream(s, f"{folder}/table", "id", "seq", ["status"], f"{folder}/state"))
    return upserts.upserted(spark, f"{folder}/table").withColumn("amount", F.col("amount").cast("double"))


# ---- a log that grows in portions


def _over_portions(df: DataFrame, portions: list[Column], start: Callable[[DataFrame, str], object]) -> str:
    """The folder of a run in which each portion of df was appended and start(stream, folder) then ran over it; what start writes is in its out."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "portions")
    for p in portions:
        df.where(p).write.mode("append").parquet(f"{folder}/in")
        _ended(start(monitor.growing_table(spark, f"{folder}/in", df.schema, 10_000), folder))
    return folder


def _to_files(out: DataFrame, folder: str):
    return out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")


def _plain_times(df: DataFrame) -> DataFrame:
    """Times as the log has them, without a zone."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


_BLANK = "event_type='error'"


@query("m4_alert_stream", f"""WITH e AS (SELECT user_id%5 AS k, event_id%4 AS b, ts, event_id, event_type<>'signup' AND event_id%4<3 AS good, {_BLANK} AS m1, event_type='click' AND value<20 AS m2, contains(props,'7') AND value>190 AS m3 FROM events),
 r AS (SELECT p.b AS step, e.*, row_number() OVER (PARTITION BY p.b, k ORDER BY ts DESC, event_id DESC) AS n FROM (SELECT unnest(range(4)) AS b) p JOIN e ON e.b<=p.b WHERE good),
 s AS (SELECT step, k, max(ts) AS last_time, concat_ws(';', CASE WHEN sum(m1::INT)>=3 THEN 'missing_kind' END, CASE WHEN sum(m2::INT)>=1 THEN 'mojibake' END, CASE WHEN sum(m3::INT)>=1 THEN 'blocked' END) AS issues FROM r WHERE n<=50 GROUP BY 1,2),
 a AS (SELECT s.* FROM s WHERE issues<>'' AND EXISTS (SELECT 1 FROM e WHERE e.k=s.k AND e.b=s.step)), t AS (SELECT *, lag(last_time) OVER (PARTITION BY k ORDER BY step) AS t0, lag(issues) OVER (PARTITION BY k ORDER BY step) AS i0 FROM a)
 SELECT k AS user_group, last_time, issues FROM t WHERE t0 IS NULL OR t0<>last_time OR i0<>issues""")
def m4_alert_stream(spark, sf):
    e = table(spark, sf, "events")
    number = F.col("event_id") % 4
    e = e.select((F.col("user_id") % 5).alias("user_group"), "event_id", "ts", number.alias("portion"), ((F.col("event_type") != "signup") & (number < 3)).alias("good"))\
        .join(e.select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), F.when((F.col("event_type") == "click") & (F.col("value") < 20), "Ã©tÃ©").otherwise("fine").alias("text"), F.concat("props", F.when(F.col("value") > 190, " slow").otherwise("")).alias("log")), "event_id")
    start = lambda s, folder: _to_files(alerts.alert_stream(s, "user_group", "ts", "event_id", F.col("good"), ["kind"], ["text"], {"blocked": "7.* slow"}, "log"), folder)
    folder = _over_portions(e, [F.col("portion") == k for k in range(4)], start)
    return _plain_times(spark.read.schema("user_group bigint, last_time timestamp, issues string").parquet(f"{folder}/out"))


#: The log's first days, the days after them, and late rows of the first ones that come last.
_SPLIT, _LATE = "TIMESTAMP '2024-01-12 00:00:00'", "(event_id%40=0 AND ts<TIMESTAMP '2024-01-10 00:00:00')"


def _late_log(spark, sf) -> tuple[DataFrame, list[Column]]:
    late = (F.col("event_id") % 40 == 0) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    early = F.col("ts") < F.lit("2024-01-12").cast("timestamp")
    return table(spark, sf, "events"), [early & ~late, ~early & ~late, late]


@query("m5_sliding_stream", f"""WITH e AS (SELECT * FROM events WHERE NOT {_LATE}), w AS (SELECT ts, value, time_bucket(INTERVAL 12 HOUR, ts)-k*INTERVAL 12 HOUR AS window_start FROM e, range(2) t(k))
 SELECT window_start, window_start+INTERVAL 1 DAY AS window_end, count(*) AS rows, round(sum(value),4) AS total FROM w GROUP BY 1,2 HAVING window_start+INTERVAL 1 DAY<=(SELECT max(ts)-INTERVAL 10 MINUTE FROM e)""")
def m5_sliding_stream(spark, sf):
    log, portions = _late_log(spark, sf)
    aggregates = {"rows": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}
    folder = _over_portions(log, portions, lambda s, folder: _to_files(monitor.qa_by_time(s, "ts", "1 day", aggregates, "12 hours"), folder))
    return _plain_times(spark.read.schema("window_start timestamp, window_end timestamp, rows bigint, total double").parquet(f"{folder}/out"))


@query("m5_session_stream", f"""WITH e AS (SELECT * FROM events WHERE NOT {_LATE}), n AS (SELECT *, (ts>=lag(ts) OVER (PARTITION BY user_id ORDER BY ts)+INTERVAL 6 HOUR)::INT AS starts FROM e),
 s AS (SELECT *, sum(coalesce(starts,0)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM n)
 SELECT user_id, min(ts) AS session_start, max(ts)+INTERVAL 6 HOUR AS session_end, count(*) AS rows, round(sum(value),4) AS total FROM s GROUP BY user_id, s HAVING max(ts)+INTERVAL 6 HOUR<=(SELECT max(ts)-INTERVAL 10 MINUTE FROM e)""")
def m5_session_stream(spark, sf):
    log, portions = _late_log(spark, sf)
    aggregates = {"rows": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}
    folder = _over_portions(log, portions, lambda s, folder: _to_files(monitor.qa_by_session(s, "ts", "6 hours", ["user_id"], aggregates), folder))
    return _plain_times(spark.read.schema("user_id bigint, session_start timestamp, session_end timestamp, rows bigint, total double").parquet(f"{folder}/out"))


@query("m7_guarded_runs", """WITH e AS (SELECT event_id%5 AS k, event_type NOT IN ('error') AND event_id%5<2 AS ok FROM events) SELECT (k+1)::INT AS run, count(*) AS rows, sum(ok::INT)::BIGINT AS good FROM e WHERE k<=2 GROUP BY 1""")
def m7_guarded_runs(spark, sf):
    """Portions 0 and 1 hold successes, 2 has none: there the runs end, though 3 and 4 are left."""
    log = table(spark, sf, "events").withColumn("ok", (F.col("event_type") != "error") & (F.col("event_id") % 5 < 2))
    folder = new_folder(spark, "guarded")

    def start(run: int):
        log.where(F.col("event_id") % 5 == run - 1).write.mode("append").parquet(f"{folder}/in")
        return _to_files(guard.counted(monitor.growing_table(spark, f"{folder}/in", log.schema, 10_000), F.col("ok")), folder)

    return spark.createDataFrame(guard.run_until_done(spark, start, most=5), "run int, rows bigint, good bigint")
