"""Edge cases by hand: ties, nulls, degenerate inputs, merge policies, streams."""

import pytest
from pyspark.sql import functions as F

from assetlens.functions import text as T
from assetlens.operators import merge, pages, rank, scores, stats
from assetlens.streaming import monitor


def values(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "id int, x double")


def test_percentiles(spark):
    d = values(spark, [3.0, 1.0, None, 3.0, float("nan"), 2.0])
    got = {r.id: r.p for r in rank.add_percentile(d, "x", "p").collect()}
    assert got == {0: pytest.approx(2.5 / 3), 1: 0.0, 2: None, 3: pytest.approx(2.5 / 3), 4: None, 5: pytest.approx(1 / 3)}
    one = values(spark, [5.0])
    assert [rank.add_percentile(one, "x", "p", kind=k).first().p for k in ("01", "zero", "pct")] == [None, 0.0, 1.0]
    assert rank.add_percentile(values(spark, [None, None]), "x", "p").where("p is not null").count() == 0


def test_first_rank_breaks_ties_by_id(spark):
    got = {r.id: r["rank"] for r in rank.first_rank(values(spark, [1.0, 2.0, 2.0]), "x", "id").collect()}
    assert got == {1: 1, 2: 2, 0: 3}


def test_normalize_degenerate(spark):
    same = values(spark, [4.0, None, 4.0])
    assert [r.y for r in stats.normalize_01(same, {"y": {"column": "x"}}).orderBy("id").collect()] == [0.5, 0.5, 0.5]
    none = values(spark, [None, None])
    assert [r.y for r in stats.normalize_01(none, {"y": {"column": "x", "fill": 0.25}}).collect()] == [0.25, 0.25]


def test_published_identities():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.correlation_p_value(0.5, 20) == pytest.approx(0.02476979, abs=1e-6)


def test_numbers(spark):
    d = spark.createDataFrame([("1,234 条",), ("--",), ("2 KB",), ("1.5GB",), ("8 字节",), (",",), ("nan",), (None,)], "t string")
    got = d.select(T.parse_number("t").alias("n"), T.parse_size_bytes("t").alias("b"), T.first_integer("t").alias("i")).collect()
    assert [r.n for r in got] == [1234.0, None, 2.0, 1.5, 8.0, None, None, None]
    assert [r.b for r in got][2:5] == [2048.0, 1.5 * 1024**3, 8.0] and got[5].i is None


def test_merge_policies(spark):
    master = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    cp = spark.createDataFrame([("a", "")], "id string, v string")
    assert {r.id: r.v for r in merge.merge_prefer_nonempty(master, cp, "id").collect()} == {"a": "x", "b": "y"}
    assert {r.id: r.v for r in merge.overlay(master, cp, "id", ["v"]).collect()} == {"a": "", "b": None}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 0, "ok", "1")], "id string, seq int, status string, v string")
    new = spark.createDataFrame([("a", 1, None, ""), ("b", 2, "ok", "5"), ("b", 3, "bad", "")], "id string, seq int, status string, v string")
    once = merge.upsert(old, new, "id", "seq", ["status"])
    want = {("a", None, "1"), ("b", "bad", "5")}
    assert {(r.id, r.status, r.v) for r in once.collect()} == want
    assert {(r.id, r.status, r.v) for r in merge.upsert(once, new, "id", "seq", ["status"]).collect()} == want


def test_quadrants_and_candidates(spark):
    d = spark.createDataFrame([(0.9, 0.1), (0.9, 0.9), (0.1, 0.1), (0.1, 0.9), (None, 0.5)], "p double, a double")
    got = d.select(scores.quadrant("p", "a").alias("q"), scores.is_candidate("p", "a").alias("c")).collect()
    assert [r.q for r in got] == ["high_low", "high_high", "low_low", "low_high", "unclassified"] and [r.c for r in got] == [True, False, False, False, False]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:00:00", float(i)) for i in range(20)]
    d = spark.createDataFrame(rows, "event_id int, t string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "value")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    agg = {"rows": F.count(F.lit(1)), "total": F.sum("value")}
    s = monitor.qa_by_time(monitor.growing_table(spark, str(tmp_path / "in"), d.schema, 1), "ts", "1 hour", agg)
    q = s.writeStream.format("memory").queryName("qa").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("qa").collect()} == {tuple(r) for r in monitor.qa_by_time(d, "ts", "1 hour", agg).collect()}


def test_name_in_text_is_the_same_at_every_size(spark, monkeypatch):
    names = ["road noise", "noise", "a  b", "上海市道路", "道路", "公交站点信息数据", "😀x", "q", "long name of five words", "", None, *[" ".join(["w"] * k) + f" z{k}z" for k in range(1, 80)]]
    blocks = ["(road noise), 2024", "noises", "x a  b.", "查看上海市道路情况", "全市公交站点信息数据集", "道路", "p😀x", "q", "Q", "", None, "a b", "my long name of five words!", "noise q", *[f"<{n}>" for n in names[11:]], *[f"common gram {k}" for k in range(30)]]
    names += [f"common gram {k}" for k in range(30)]
    b, n = spark.createDataFrame([(x,) for x in blocks], "block string"), spark.createDataFrame([(x,) for x in names], "name string")
    monkeypatch.setattr(merge, "CELL", 4)
    want = {}
    for x in blocks:
        hits = {y for y in names if y and x is not None and y in x}
        if len(hits) == 1:
            want[x] = hits.pop()
    for most in (100_000, 5):
        assert {r.block: r.name for r in merge.name_in_text(b, n, "block", "name", most).collect()} == want
        every = {(x, y) for x in blocks if x for y in names if y and y in x}
        pairs = [tuple(r) for r in merge.name_hits(b, n, "block", "name", most).collect()]
        assert len(pairs) == len(every) and set(pairs) == every


def test_name_records(spark):
    rows = [(1, "<p>道路数据 CSV</p><p>road list JSON</p><p>two names: road list, bus stops XML</p><p>no format</p>"), (2, "<div>road list CSV <a href='d?id=7'>x</a></div>"), (3, "<p>unknown XLSX</p>")]
    names = spark.createDataFrame([("a", "道路"), ("b", "road list"), ("c", "bus stops"), ("d", ""), ("e", "unknown"), ("f", "unknown")], "asset_id string, name string")
    got = {(r.page_id, r.block): (r.formats, r.match_count, r.asset_id) for r in pages.name_records(pages.parse_pages(spark.createDataFrame(rows, "page_id int, html string")), names, "page_id").collect()}
    assert got == {
        (1, "道路数据 CSV"): (["CSV"], 1, "a"),
        (1, "road list JSON"): (["JSON"], 1, "b"),
        (1, "two names: road list, bus stops XML"): (["XML"], 2, None),
        (3, "unknown XLSX"): (["XLSX"], 2, None),
    }


def test_sensitivity_queries_are_the_whole_job(spark, data, monkeypatch):
    from assetlens.operators import sensitivity
    from assetlens.plans import queries

    grid = queries.QUERIES["k1_threshold_grid"](spark, data).collect()
    assert len(grid) == 54 and len(queries._GRID) == 54 and len({r.set for r in grid}) == 2
    seen, inner = [], sensitivity.weight_scenarios
    monkeypatch.setattr(sensitivity, "weight_scenarios", lambda *a: seen.append(a) or inner(*a))
    got = queries.QUERIES["k4_weight_perturbation"](spark, data).collect()
    critic = {r.dimension: r.weight for r in scores.critic_weights(seen[0][0], list(seen[0][2])).collect()}
    assert sorted(r.draw for r in got) == sorted(f"{a}/{k}" for a in (0.1, 0.2) for k in range(200)) and seen[0][2] == pytest.approx(critic)


def test_recomputation_reads_the_written_table(spark, data, monkeypatch):
    from assetlens.plans import entries_models, queries

    small = spark.createDataFrame([(1, "product", 0.9, 0.1), (2, "product", 0.8, 0.4), (3, "product", 0.2, 0.1), (97, "product", None, 0.1)], "asset_id bigint, resource_type string, potential double, actual double")
    monkeypatch.setattr(entries_models, "scored_assets", lambda *a: small)
    assert tuple(entries_models.j13_recomputation(spark, data).first()) == (0, 1)
    whole = queries.flagship_from
    monkeypatch.setattr(queries, "flagship_from", lambda d: whole(d).where("rank > 1").unionByName(whole(d).where("rank = 1").withColumn("asset_id", F.lit(-1).cast("bigint"))))
    assert entries_models.j13_recomputation(spark, data).first().mismatches == 2


def test_weight_scenarios_against_plain_ranks(spark):
    import random

    from assetlens.operators import sensitivity

    r = random.Random(1)
    rows = [(i, round(r.random(), 1), round(r.random(), 1)) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, a double, b double")
    draws = sensitivity.perturbed_weights({"a": 0.7, "b": 0.3}, [0.2], 500, 1)
    got = {x.draw: x for x in sensitivity.weight_scenarios(d, "id", {"a": 0.7, "b": 0.3}, draws).collect()}

    def ranks(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    base = ranks([x[1] * 0.7 + x[2] * 0.3 for x in rows])
    for name, w in draws[::100]:
        mine = ranks([x[1] * w["a"] + x[2] * w["b"] for x in rows])
        ma, mb = sum(mine) / 60, sum(base) / 60
        cov = sum((x - ma) * (y - mb) for x, y in zip(mine, base))
        assert got[name].spearman == pytest.approx(cov / (sum((x - ma) ** 2 for x in mine) * sum((y - mb) ** 2 for y in base)) ** 0.5, abs=1e-3)
    assert len(got) == 500
