"""Streams, ranks of few and many values, tail probabilities, SQL functions and fitted models, by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assetlens.functions import hooks, tails
from assetlens.functions import text as T
from assetlens.operators import ml, rank, stats
from assetlens.streaming import alerts, guard, monitor, upserts


@pytest.mark.parametrize("few", [0, 100_000])
def test_ranks_are_the_same_by_ranges_and_by_one_window(spark, monkeypatch, few):
    monkeypatch.setattr(rank, "FEW", few)
    r = random.Random(3)
    rows = [(k, r.choice("ab"), float(r.randrange(40)) if r.random() > 0.1 else None) for k in range(500)]
    d = spark.createDataFrame(rows, "id int, g string, x double")
    got = {x.id: (x.lo, x.ties, x.n) for x in rank.with_ranks(d, "x", ("g",)).collect()}
    for k, g, v in rows:
        own = [y for _, h, y in rows if h == g and y is not None]
        assert got[k] == ((None, None, None) if v is None else (sum(y < v for y in own), own.count(v), len(own)))


def test_tail_probabilities_are_columns(spark):
    r = random.Random(1)
    rows = [(r.uniform(-1, 1) * r.choice([1, 0.1, 0.01]), r.choice([3, 4, 10, 100, 5000]), r.uniform(0, 60), r.randint(1, 80), r.uniform(0, 8)) for _ in range(200)]
    d = spark.createDataFrame(rows, "rho double, n int, x double, df int, z double")
    for x in d.select("*", tails.correlation_p(F.col("rho"), F.col("n")).alias("p1"), tails.chi2_p(F.col("x"), F.col("df")).alias("p2"), tails.normal_p(F.col("z")).alias("p3")).collect():
        assert x.p1 == pytest.approx(stats.correlation_p_value(x.rho, x.n), abs=1e-9)
        assert x.p2 == pytest.approx(stats.chi2_sf(x.x, x.df), abs=1e-9) and x.p3 == pytest.approx(math.erfc(x.z / math.sqrt(2)), abs=1e-9)
    odd = spark.createDataFrame([(None, 5, None, 1, None), (1.0, 9, 0.0, 0, -0.3), (0.5, 2, 0.0, 2, 0.0)], "rho double, n int, x double, df int, z double")
    got = [tuple(x) for x in odd.select(tails.correlation_p(F.col("rho"), F.col("n")), tails.chi2_p(F.col("x"), F.col("df")), tails.normal_p(F.col("z"))).collect()]
    assert got == [(None, None, None), (0.0, None, 1.0), (None, 1.0, 1.0)]


def test_sql_functions(spark):
    hooks.register(spark, "clip_share", T.clip01, x="double")
    assert [tuple(r) for r in spark.sql("SELECT clip_share(2.5D), clip_share(0.25D), clip_share(null)").collect()] == [(1.0, 0.25, 0.0)]
    hooks.register_terms(spark, "terms_of")
    got = spark.sql("SELECT * FROM terms_of(' a;b|　c ,,;')").collect()
    assert [r.term for r in got] == ["a", "b", "c"] == spark.range(1).select(T.split_terms(F.lit(" a;b|　c ,,;"))).first()[0]
    with pytest.raises(ValueError, match="SQL form"):
        hooks.register(spark, "no_form", lambda x: F.transform(F.split(x, ","), lambda y: F.upper(y)), x="string")
    with pytest.raises(ValueError, match="not a name"):
        hooks.register(spark, "x; drop", T.clip01, x="double")


@pytest.fixture
def log(tmp_path):
    (tmp_path / "in").mkdir()  # a stream's folder has to be there
    return tmp_path


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_alerts_are_told_once(spark, log):
    schema = "k string, ts timestamp, id bigint, ok boolean, name string, log string"
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    batches = [
        [("a", t(1), 1, True, "", ""), ("a", t(2), 2, True, "x", ""), ("b", t(1), 3, True, "x", "")],  # one blank isn't enough
        [("a", t(4), 4, True, None, ""), ("b", t(2), 5, False, "", "blocked")],  # two blanks: alert; b's bad row doesn't count
        [("a", t(9), 6, False, "", "blocked")],  # nothing good is new: not told again
        [("a", t(3), 7, True, "", ""), ("a", None, 8, True, "", "")],  # a late row joins the last three and pushes the first out: the same alert, not told again
        [("a", t(5), 9, True, "x", "blocked")],  # the marker is new
        [("a", t(6), 10, True, "x", ""), ("a", t(7), 11, True, "x", ""), ("a", t(8), 12, True, "x", "")],  # all is well
        [("a", t(10), 13, True, "", ""), ("a", t(11), 14, True, "", "")],
    ]
    stream = monitor.growing_table(spark, f"{log}/in", spark.createDataFrame([], schema).schema, 100)
    out = alerts.alert_stream(stream, "k", "ts", "id", F.col("ok"), ["name"], [], {"stopped": "block"}, "log", last=3, most_missing=2)
    for b in batches:
        rows = spark.createDataFrame(b, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        rows.write.mode("append").parquet(f"{log}/in")
        run(out.writeStream.format("parquet").option("checkpointLocation", f"{log}/state").trigger(availableNow=True).start(f"{log}/out"))
    got = sorted((str(r.last_time)[14:16], r.issues, r.k) for r in spark.read.schema(out.schema).parquet(f"{log}/out").collect())
    assert got == [("04", "missing_name", "a"), ("05", "missing_name;stopped", "a"), ("11", "missing_name", "a")]


def test_an_upsert_writes_touched_buckets_only_and_can_be_replayed(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, seq int, status string, note string")
    merge = lambda n, df: upserts.merge_batch(df, n, path, "id", "seq", ["status"], buckets=8)
    read = lambda: {r.id: (r.seq, r.status, r.note) for r in upserts.upserted(spark, path).collect()}
    with pytest.raises(ValueError):
        upserts.upserted(spark, path)
    merge(0, rows(*[(k, 0, "new", f"n{k}") for k in range(100)]))
    first = upserts.manifest(spark, path)
    assert first == dict.fromkeys(range(8), 0) and len(read()) == 100
    merge(1, rows((7, 1, None, "")))
    second = upserts.manifest(spark, path)
    touched = [b for b in second if second[b] != first[b]]
    assert len(touched) == 1 and {p.name for p in (tmp_path / "table/data/v=1").glob("bucket=*")} == {f"bucket={touched[0]}"}
    assert read()[7] == (1, None, "n7") and read()[8] == (0, "new", "n8")
    want = read()
    merge(1, rows((7, 1, "again", "other")))  # after its commit a replay changes nothing
    assert read() == want
    for n in (2, 3):
        merge(n, rows((7, n, "s", "")))
    assert upserts._versions(spark, path) == [2, 3] and read()[7] == (3, "s", "n7")
    assert {p.name for p in (tmp_path / "table/data").glob("v=*/bucket=*") if p.name == f"bucket={touched[0]}"} and not (tmp_path / f"table/data/v=1/bucket={touched[0]}").exists()
    # a run that was cut off before its manifest leaves the version before, and running it again gives the same
    monkey = rows((9, 4, "cut", ""))
    monkey.withColumn("bucket", upserts.bucket_of("id", 8)).write.partitionBy("bucket").parquet(f"{path}/data/v=4")
    assert read()[9] == (0, "new", "n9")
    merge(4, monkey)
    assert read()[9] == (4, "cut", "n9") and len(read()) == 100


def test_runs_end_with_the_first_that_adds_nothing(spark, log):
    portions = [["ok", "ok", "bad"], ["ok"], ["bad", "bad"], ["ok"]]

    def start(k):
        spark.createDataFrame([(s,) for s in portions[k - 1]], "status string").write.mode("append").parquet(f"{log}/in")
        s = guard.counted(monitor.growing_table(spark, f"{log}/in", spark.createDataFrame([], "status string").schema, 100), F.col("status") == "ok")
        return s.writeStream.format("noop").option("checkpointLocation", f"{log}/state").trigger(availableNow=True).start()

    assert guard.run_until_done(spark, start) == [(1, 3, 2), (2, 1, 1), (3, 2, 0)]
    assert guard.run_until_done(spark, lambda k: start(4), most=1) == [(1, 1, 1)]


def test_a_session_joined_by_a_middle_row_and_a_late_row_dropped(spark, log):
    t = lambda x: f"2024-01-01 {x}:00"
    batches = [[("a", t("00:00")), ("a", t("00:50"))], [("a", t("00:25"))], [("b", t("03:00"))], [("a", t("00:10"))], [("b", t("09:00"))]]
    stream = monitor.growing_table(spark, f"{log}/in", spark.createDataFrame([], "k string, ts timestamp").schema, 100)
    out = monitor.qa_by_session(stream, "ts", "30 minutes", ["k"], {"rows": F.count(F.lit(1))}, "1 hour")
    for b in batches:
        spark.createDataFrame(b, "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{log}/in")
        run(out.writeStream.format("parquet").option("checkpointLocation", f"{log}/state").trigger(availableNow=True).start(f"{log}/out"))
    got = sorted((r.k, str(r.session_start)[11:16], str(r.session_end)[11:16], r.rows) for r in spark.read.schema(out.schema).parquet(f"{log}/out").collect())
    assert got == [("a", "00:00", "01:20", 3), ("b", "03:00", "03:30", 1)]


def test_term_weights_keep_a_term_of_all_rows(spark):
    from pyspark.ml import Pipeline

    d = spark.createDataFrame([(["ab", "cd"],), (["ab", "ef"],)], "g array<string>")
    model = Pipeline(stages=ml.feature_stages([], [], "g")).fit(d)
    names = model.stages[0].vocabulary
    row = dict(zip(names, model.transform(d).first()["__text"].toArray()))
    rare = math.log(3 / 2) + 1
    assert row["ab"] == pytest.approx(1 / math.hypot(1, rare)) and row["cd"] == pytest.approx(rare / math.hypot(1, rare)) and row["ef"] == 0


def test_importances_keep_names_with_underscores_apart(spark):
    r = random.Random(5)
    rows = [(k, float(r.random()), r.choice("xyz"), r.choice("uv"), r.choice("pq")) for k in range(300)]
    d = spark.createDataFrame([(*x, x[1] + (x[2] == "x") + 2 * (x[3] == "u")) for x in rows], "id int, n double, a string, a__h string, b string, label double")
    model = ml.fit_pipeline(d, ml.feature_stages(["n"], ["a", "a__h", "b"]), ml.random_forest(trees=10, depth=5))
    got = {x.feature: (x.importance, x.encoded) for x in ml.importances(model, d).collect()}
    assert set(got) == {"n", "a", "a__h", "b"} and sum(v for v, _ in got.values()) == pytest.approx(1)
    assert (got["a"][1], got["a__h"][1], got["n"][1]) == (4, 3, 1) and got["a__h"][0] > got["a"][0] > got["b"][0]


def test_early_stopping_ends_at_the_best_round(spark):
    r = random.Random(6)
    d = spark.createDataFrame([(k, float(k % 17), r.gauss(0, 1) + (k % 17 > 8), k % 4 == 0) for k in range(400)], "id int, x double, label double, validation boolean")
    frame = ml.feature_frame(d, ["x"], [])
    stopped = ml.EarlyStopped(ml.boosted_trees(rounds=12, rate=0.5, depth=3))
    errors = stopped.errors(frame)
    assert len(errors) == 12 and stopped.fit(frame).getNumTrees == errors.index(min(errors)) + 1 < 12
    assert ml.EarlyStopped(ml.boosted_trees(rounds=2, depth=2)).fit(frame.withColumn("validation", F.lit(False))).getNumTrees == 2


@pytest.mark.parametrize("few", [0, 100_000])
def test_first_rank_batches_and_running_sums_at_every_size(spark, monkeypatch, few):
    monkeypatch.setattr(rank, "FEW", few)
    r = random.Random(7)
    rows = [(k, r.choice([None, *map(float, range(20))]), "wide" * 10) for k in range(200)]
    d = spark.createDataFrame(rows, "id int, x double, other string").repartition(3)
    got = {q.id: q["rank"] for q in rank.first_rank(d, "x", "id").collect()}
    order = sorted((row for row in rows if row[1] is not None), key=lambda row: (-row[1], row[0]))
    assert got == {row[0]: None for row in rows} | {row[0]: k + 1 for k, row in enumerate(order)}
    twice = rank.first_rank(spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 2.0), (2, 2.0), (None, 1.0), (3, None)], "id int, x double"), "x", "id").collect()
    assert sorted((q["rank"] or 0, q.id or 0) for q in twice) == [(0, 3), (1, 1), (2, 1), (3, 1), (4, 2), (5, 0)]
    b = {q.id: q.batch for q in rank.batches(d.withColumn("id2", F.when(F.col("id") > 4, F.col("id"))), "id2", 50).collect()}
    assert b == {k: None if k < 5 else (k - 5) // 50 for k in range(200)}
    sums = rank.cumulative_share(d.where("x is not null").groupBy("x").count(), "count", F.asc("x")).orderBy("x").collect()
    total = 0
    for q in sums:
        total += q["count"]
        assert q.cumulative_count == total
    assert sums[-1].cumulative_share == pytest.approx(1)


def test_text_tables_by_whole_files_and_by_lines(spark, tmp_path):
    from assetlens.sources import tables

    (tmp_path / "t.csv").write_text("\ufeffid,name\n 7.0 ,\"a, \"\"b\"\"\"\n8,c\n", encoding="utf-8")
    for multi_line in (True, False):
        got = tables.read_text_table(spark, str(tmp_path / "t.csv"), "id", multi_line)
        assert got.columns == ["id", "name"] and sorted(tuple(r) for r in got.collect()) == [("7", 'a, "b"'), ("8", "c")]
        assert tables.read_typed(spark, str(tmp_path / "t.csv"), "id string, name string", multi_line).count() == 2
    (tmp_path / "broken.parquet").write_text("no parquet")
    spark.sparkContext.setJobDescription("mine")
    assert tables.find_table(spark, str(tmp_path), ("id", "name")).count() == 2
    assert spark.sparkContext.getLocalProperty("spark.job.description") == "mine"
