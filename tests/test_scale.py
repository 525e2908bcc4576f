"""Large groups: one key holds a third of all rows, and results do not depend on how rows are partitioned."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.functions import keys as K
from fathomline.functions.guards import Refused
from fathomline.functions import ordered as O
from fathomline.functions.hashing import unit
from fathomline.operators import allocation as A
from fathomline.operators import draw as P
from fathomline.operators import estimate as E
from fathomline.operators import labels as L
from fathomline.operators.rows import dedup


@pytest.fixture(scope="module")
def frame(spark):
    """9,000 levels; float 1 holds a third of them, and a third of all scores are one and the same."""
    i = F.col("id")
    return spark.range(9000).select(
        F.lit("demo/physical/obduction").alias("pool_id"), F.when(i % 3 == 0, 1).otherwise(2 + i % 57).alias("wmo"),
        i.alias("cycle_number"), (F.pmod(i * 7919, F.lit(801)) / 2 + 200).alias("pres_adjusted"),
        F.when(i % 3 == 1, 0.25).otherwise(unit(1, "score", "id")).alias("score"), (unit(2, "y", "id") < 0.3).cast("int").alias("decision"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_and_running_totals(frame, parts):
    t = frame.repartition(parts)
    got = O.ordered(t, ["wmo"], ["score", "cycle_number"], {"run": F.col("decision")}, {"last": F.when(F.col("decision") == 1, F.col("cycle_number"))})
    w = Window.partitionBy("wmo").orderBy("score", "cycle_number")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = frame.withColumns({"rank": F.row_number().over(w) - 1, "group_n": F.count(F.lit(1)).over(Window.partitionBy("wmo")),
                              "run": F.sum("decision").over(upto), "run_all": F.sum("decision").over(Window.partitionBy("wmo")),
                              "last": F.last(F.when(F.col("decision") == 1, F.col("cycle_number")), True).over(upto)})
    cols = ("wmo", "cycle_number", "rank", "group_n", "run", "run_all", F.coalesce("last", F.lit(-1)).alias("last"))
    assert rows(got, *cols) == rows(want, *cols)


def test_ordered_slices_spread_a_hot_group(spark, frame):
    t = frame.select("wmo", "cycle_number").repartitionByRange(8, "wmo", "cycle_number")
    largest = t.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 3000                              # the hot float alone has 3,000 rows


def test_hash_order_matches_a_window(frame):
    t = frame.withColumn("u", unit(3, "h", "cycle_number"))
    got = O.hash_ordered(t, ["wmo"], "u", ["cycle_number"], {"run": F.col("decision")}, buckets=16)
    w = Window.partitionBy("wmo").orderBy("u", "cycle_number")
    want = t.withColumns({"rank": F.row_number().over(w) - 1, "run": F.sum("decision").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    assert rows(got, "cycle_number", "rank", "run") == rows(want, "cycle_number", "rank", "run")


def test_exact_quantiles(frame):
    qs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["wmo"]: r["q"] for r in O.order_statistics(frame, ["wmo"], "score", qs).collect()}
    want = {r["wmo"]: r["q"] for r in frame.groupBy("wmo").agg(F.percentile("score", F.array(*[F.lit(q) for q in qs])).alias("q")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_median_over_slices(frame):
    got = O.running_median(frame, ["wmo"], "cycle_number", "score", 3, "m", slice_rows=64)
    w = Window.partitionBy("wmo").orderBy("cycle_number").rowsBetween(-3, 3)
    want = frame.withColumn("m", F.percentile("score", F.lit(0.5)).over(w))
    assert rows(got, "cycle_number", "m") == rows(want, "cycle_number", "m")


@pytest.mark.parametrize("parts", [1, 7])
def test_deciles_with_tied_scores(frame, parts):
    got = A.score_deciles(frame.repartition(parts))
    w = Window.partitionBy("pool_id").orderBy("score", "wmo", "cycle_number", "pres_adjusted")
    want = frame.withColumn("decile", F.floor((F.row_number().over(w) - 1) * 10 / 9000))
    assert rows(got, "cycle_number", "decile") == rows(want, "cycle_number", "decile")
    assert {r["count"] for r in got.groupBy("decile").count().collect()} == {900}


def test_deciles_of_small_pools(spark):
    t = spark.createDataFrame([("p", 0.5, 1, i, 100.0) for i in range(7)], "pool_id string, score double, wmo bigint, cycle_number bigint, pres_adjusted double")
    assert rows(A.score_deciles(t), "cycle_number", "decile") == [(i, i * 10 // 7) for i in range(7)]


def strata_of(frame, n):
    t = A.score_deciles(frame).withColumn("design_stratum", F.concat(F.lit("d"), F.col("decile").cast("string")))
    s = A.stratum_table(t.withColumn("p", F.lit(0.2))).withColumn("draw_n", F.lit(n).cast("bigint"))
    return t, s


def test_one_row_per_cluster(frame):
    t, s = strata_of(frame, 30)
    d = P.draw_one_per_cluster(t, s, 5)
    per = d.groupBy("design_stratum").count().collect()
    assert len(per) == 10 and {r["count"] for r in per} == {30}
    assert d.select("inclusion_probability").distinct().collect()[0][0] == pytest.approx(30 / 900)
    c = P.clusters(t, s)
    keyed = d.join(c.select("cycle_number", "cluster"), "cycle_number")
    assert keyed.groupBy("design_stratum", "cluster").count().agg(F.max("count")).first()[0] == 1
    assert rows(P.draw_one_per_cluster(t.repartition(7), s, 5), "cycle_number") == rows(d, "cycle_number")


def test_every_row_has_the_same_chance(spark):
    """60 rows, a third on one float, 6 drawn: over many seeds every row comes up one time in ten."""
    t = spark.range(60).select(F.lit("p").alias("pool_id"), F.lit("s").alias("design_stratum"),
                               F.when(F.col("id") % 3 == 0, 1).otherwise(2 + F.col("id") % 13).alias("wmo"),
                               F.col("id").alias("cycle_number"), F.lit(1.0).alias("pres_adjusted"))
    # replicates are strata of their own, so one draw makes them all
    many = t.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(1500)))).withColumn("design_stratum", F.col("rep").cast("string")).drop("rep")
    s = many.groupBy("pool_id", "design_stratum").agg(F.count(F.lit(1)).alias("frame_n")).withColumn("draw_n", F.lit(6).cast("bigint"))
    n = {r["cycle_number"]: r["count"] for r in P.draw_one_per_cluster(many, s, 9).groupBy("cycle_number").count().collect()}
    assert len(n) == 60 and sum(n.values()) == 9000
    assert all(abs(v - 150) < 60 for v in n.values())           # five standard deviations


def test_estimator_is_unbiased_and_its_error_honest(spark, frame):
    """The stratified rate over 60 repeated draws of one frame: right on average, its error the one it states."""
    t, s = strata_of(frame, 30)
    truth = frame.agg(F.avg("decision")).first()[0]
    many = t.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("pool_id", F.col("rep").cast("string")).drop("rep")
    s_many = many.groupBy("pool_id", "design_stratum").agg(F.count(F.lit(1)).alias("frame_n")).withColumn("draw_n", F.lit(30).cast("bigint"))
    r = E.stratified_rate(P.draw_one_per_cluster(many, s_many, 3), s_many).agg(F.avg("rate").alias("m"), F.stddev("rate").alias("sd"), F.avg("se_design").alias("se")).first()
    assert abs(r["m"] - truth) < 4 * r["sd"] / 60 ** 0.5
    assert 0.7 < r["se"] / r["sd"] < 1.4


def test_controls_come_from_different_floats(frame):
    k = K.event_key(frame)
    c = P.draw_controls(k, 20, 4).collect()
    assert len(c) == 20 and len({r["wmo"] for r in c}) == 20
    assert len(P.draw_controls(k, 500, 4).collect()) == frame.select("wmo").distinct().count()


@pytest.mark.parametrize("seed", range(3))
def test_controls_are_spread_over_every_sheet(spark, seed):
    n, batches = 619, 20
    t = spark.range(n * batches).select(F.floor(F.col("id") / n).cast("string").alias("batch_id"), F.col("id").alias("k_wmo"), F.lit(0).alias("k_cycle"), F.lit(0).alias("k_pres"),
                                        F.when(F.col("id") % n < 20, "pos_ctrl").when(F.col("id") % n < 40, "neg_ctrl").otherwise("target").alias("control_arm"))
    got = P.interleave(t, seed).groupBy("batch_id").agg(
        F.count_distinct("sample_id").alias("places"), F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"),
        *[F.count_if((F.floor(F.col("sample_id") * 4 / n) == q) & (F.col("control_arm") == arm)).alias(f"{arm}{q}") for q in range(4) for arm in ("pos_ctrl", "neg_ctrl")]).collect()
    for r in got:
        assert (r["places"], r["lo"], r["hi"]) == (n, 0, n - 1)
        assert all(3 <= r[f"{arm}{q}"] <= 7 for q in range(4) for arm in ("pos_ctrl", "neg_ctrl"))


def test_sittings_are_few_and_even(spark):
    t = spark.range(619).select(F.lit("b").alias("batch_id"), F.col("id").alias("sample_id"))
    n = [r["count"] for r in P.split_sessions(t).groupBy("session").count().orderBy("session").collect()]
    assert n == [104, 103, 103, 103, 103, 103]


def test_set_digest_ignores_order_and_copies(frame):
    k = K.event_key(frame)
    a = K.content_hash(k).first()
    assert a == K.content_hash(k.unionByName(k).repartition(7)).first() and a["n"] == 9000
    assert a["content_sha256"] != K.content_hash(k.where("cycle_number > 0")).first()["content_sha256"]
    assert K.listed_hash(k).first() == K.listed_hash(k.repartition(5)).first()


def test_listed_digest_of_a_long_list_is_that_of_all_its_lines(frame):
    import hashlib
    k = K.event_key(frame)
    lines = ["|".join(map(str, r)) for r in rows(k, *K.EVENT_KEY)]
    whole = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert K.listed_hash(k).first()["content_sha256"] == whole
    assert K.listed_hash(k, limit=9000).first()["content_sha256"] == whole
    with pytest.raises(Refused, match="listed digest"):          # one meaning at every size: none beyond the limit, not another
        K.listed_hash(k, limit=4000)


def test_dedup_of_many_copies(frame):
    copies = frame.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("wmo", F.col("wmo") * 0)
    d = dedup(copies, ["wmo"], ["score", "cycle_number", "c"])
    assert d.count() == 1
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan        # copies are dropped before the shuffle


def test_bootstraps_agree(frame):
    t = frame.withColumn("inclusion_probability", F.lit(0.5)).where("wmo > 1")
    a = E.cluster_bootstrap(t, 300, 1).first()["se"]
    b = E.cluster_bootstrap(t, 300, 1, "poisson").first()["se"]
    assert a == pytest.approx(b, rel=0.25)


def test_last_copy_before_a_sheet(spark):
    sheets = spark.createDataFrame([("p", "s1", 10), ("p", "s2", 20), ("p", "s3", 30), ("q", "s4", 5)], "pool_id string, sheet_id string, t int")
    copies = spark.createDataFrame([("p", "c1", 9, "PASS"), ("p", "c2", 20, "DRIFTED"), ("p", "c3", 25, "PASS"), ("q", "c4", 6, "PASS")], "pool_id string, copy_id string, t int, verdict string")
    ts = lambda d, n: d.withColumn(n, F.timestamp_seconds("t")).drop("t")
    got = {r["sheet_id"]: r["copy_id"] for r in L.calibration_asof(ts(sheets, "sheet_ts"), ts(copies, "copy_ts")).collect()}
    assert got == {"s1": "c1", "s2": "c1", "s3": "c3", "s4": None}          # strictly before


def test_quantiles_order_each_value_once(spark):
    """A value that very many rows share was sorted row by row in one task."""
    r = np.random.default_rng(3)
    values = {"a": np.where(r.random(40_001) < 0.7, 4.0, r.integers(0, 9, 40_001)), "b": r.normal(size=777), "c": np.array([2.0]), "d": np.array([1.0, 3.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    seen, whole = [], O.ordered

    def watched(t, *args, **kw):
        seen.append(t.count())
        return whole(t, *args, **kw)

    O.ordered = watched
    try:
        got = {x["g"]: x for x in O.order_statistics(df, ["g"], "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    finally:
        O.ordered = whole
    assert seen == [sum(len(np.unique(v)) for v in values.values())]
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g]["group_n"] == len(vs)
        assert np.allclose(got[g]["q"], np.quantile(vs, [0.0, 0.1, 0.5, 0.77, 1.0]), rtol=0, atol=1e-12)


def test_a_rebuilt_table_is_dealt_by_key(spark):
    """Seven tasks read the whole table however large it was."""
    import __spark_entry__ as entry
    from tests.conftest import SMALL
    plan = entry.queries()["compare_rebuild"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Repartition 7" not in plan


def test_deciles_sort_only_where_one_begins(spark, monkeypatch):
    """All rows were range-sorted to look up nine of them."""
    from fathomline.operators import allocation
    r, nan, inf = np.random.default_rng(9), float("nan"), float("inf")
    pools = {"even": r.random(20_000), "tied": np.where(r.random(3_000) < 0.6, 0.25, r.random(3_000)), "one": np.array([0.5]), "same": np.full(37, 2.0), "few": np.array([3.0, 1.0, 2.0]),
             "odd": r.choice([None, nan, -inf, inf, 1e308, -1e308, 0.0, -0.0, 5.0], 500), "far": r.choice([-inf, inf], 30), "small": r.choice([0.0, 5e-324], 50)}
    rows = [(g, None if v is None else float(v), i // 7, i % 7, float(i * 13 % 11)) for g, vs in pools.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "pool_id string, score double, wmo long, cycle_number long, pres_adjusted double")
    seen, whole = [], allocation.ordered
    monkeypatch.setattr(allocation, "ordered", lambda t, *a, **kw: (seen.append(t.where("pool_id = 'even'").count()), whole(t, *a, **kw))[1])
    for k in (10, 4):
        got = {(x["pool_id"], x["wmo"], x["cycle_number"]): x["decile"] for x in A.score_deciles(df, k).collect()}
        assert len(got) == len(rows)
        for g, vs in pools.items():
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] != x[1], 0.0 if x[1] is None or x[1] != x[1] else x[1], *x[2:]))
            assert [got[x[0], x[2], x[3]] for x in own] == [i * k // len(own) for i in range(len(own))], g
    assert max(seen) < 200


def test_rounds_of_a_draw_count_the_frame_once(spark, monkeypatch):
    """Every round counted the frame's floats three times."""
    from fathomline.plans import draw as plan
    rows = [("p", w % 40, c, float(c), (w * 7 + c) % 100 / 100) for w in range(400) for c in range(5)]
    s = spark.createDataFrame(rows, "pool_id string, wmo long, cycle_number long, pres_adjusted double, score double").withColumn("wmo", F.expr("wmo + cycle_number * 100"))
    s = s.withColumn("cycle_number", F.monotonically_increasing_id()).withColumn("design_stratum", F.when(F.col("score") < 0.5, "a").otherwise("b"))
    table = A.planned_acceptance(A.stratum_table(s.withColumn("p", F.col("score") * 0.5)), 0.13).withColumn("p_plan", F.lit(0.13))
    seen, whole = [], P.float_sizes
    monkeypatch.setattr(P, "float_sizes", lambda *a, **kw: seen.append(1) or whole(*a, **kw))
    _, _, rounds = plan.solve_with_design_effect(s, table, 0.6, 3)
    assert rounds.count() > 1 and len(seen) == 1
