"""Files: grid names, broken grids, bound sources, lists with sidecars, sheets."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathomline.functions import keys as K
from fathomline.functions.guards import Refused
from fathomline.functions.staging import new_path, release, shared_folder, staged
from fathomline.operators import grid as G
from fathomline.operators import model as M
from fathomline.operators import rows as R
from fathomline.plans.detect import detect_study
from fathomline.sources import candidates as C
from fathomline.sources import grids as S
from fathomline.sources import records
from fathomline.sources import reviews as W


@pytest.fixture()
def folder(tmp_path):
    """Three complete floats, one with a coarse grid only, one in two kinds, and a file of another name."""
    def write(name, **cols):
        n = 5
        base = {"cycle_number": [1.0] * n, "pres_adjusted": [100.0 + 40 * i for i in range(n)], "aou_scale_res_rob": [0.0, 0.1, 2.0, 0.1, 0.0]}
        pq.write_table(pa.table({**base, **cols}), tmp_path / name)
    for w in (101, 102, 103):
        for r in ("coarse", "fine"):
            write(f"{w}_paper_phys_{r}.parquet")
    write("104_paper_phys_coarse.parquet")
    for r in ("coarse", "fine"):
        write(f"103_paper_bbp_{r}.parquet", bbp_scale_res_rob=[1.5] * 5)
    write("notes.parquet")
    return tmp_path


def test_grids_are_known_by_their_names(spark, folder):
    g = S.scan_grids(spark, str(folder))
    assert g.select("wmo").distinct().count() == 4 and g.count() == 45
    pairs = {(r["wmo"], r["grid_kind"]) for r in S.paired_grids(g).select("wmo", "grid_kind").distinct().collect()}
    assert pairs == {(101, "paper_phys"), (102, "paper_phys"), (103, "paper_phys"), (103, "paper_bbp")}
    kinds = {r["wmo"]: r["grid_kind"] for r in S.grid_kind_of(S.paired_grids(g)).collect()}
    assert kinds == {101: "paper_phys", 102: "paper_phys", 103: "paper_bbp"}


def test_a_source_is_its_fine_grids(spark, folder):
    import hashlib
    f = S.list_grids(spark, str(folder))
    r = S.source_fingerprint(f).first()
    names = sorted(p.name for p in folder.glob("*_fine.parquet"))
    assert r["n_files"] == 4 and r["names_sha256"] == hashlib.sha256("\n".join(names).encode()).hexdigest()
    S.require_bound(S.source_fingerprint(f), 4, r["names_sha256"])
    with pytest.raises(Refused):
        S.require_bound(S.source_fingerprint(f), 4, "0" * 64)
    os.remove(folder / "101_paper_phys_fine.parquet")
    with pytest.raises(Refused):
        S.require_bound(S.source_fingerprint(S.list_grids(spark, str(folder))), 4, r["names_sha256"])


def test_a_broken_grid_is_counted(spark, folder):
    (folder / "105_paper_phys_coarse.parquet").write_bytes(b"not a grid")
    ok, failed = S.split_failures(S.probe_files(spark, S.list_grids(spark, str(folder))), "demo/physical/obduction")
    rows = failed.collect()
    assert [(r["wmo"], r["stage"]) for r in rows] == [(105, "read")] and "Error" in rows[0]["error"] or "Invalid" in rows[0]["error"]
    assert ok.count() == 9
    with pytest.raises(Refused):
        S.require_no_failures(failed)


def test_detection_finds_the_planted_level(spark, folder):
    g = S.scan_grids(spark, str(folder)).where((F.col("resolution") == "coarse") & (F.col("grid_kind") == "paper_phys"))
    gates = (G.Gate("demo/physical/obduction", (G.Term("aou", 1.5, "positive", True),), spec_id="s"),
             G.Gate("demo/physical/subduction", (G.Term("aou", 1.5, "negative", True),), spec_id="s"))
    got = {(r["pool_id"], r["wmo"], r["pres_adjusted"]) for r in detect_study(g, gates, "demo").collect()}
    assert got == {("demo/physical/obduction", w, 180.0) for w in (101, 102, 103, 104)}


def test_a_planted_anomaly_survives_gridding(spark):
    rows = [(1, 1, 5.0 + 10 * i, float(i % 3) + (40.0 if 300 <= 10 * i < 340 else 0.0)) for i in range(90)]
    raw = spark.createDataFrame(rows, "wmo int, cycle_number int, pres_adjusted double, aou double")
    g = G.residual_grid(raw, ["aou"])
    top = g.orderBy(F.abs("aou_scale_res_rob").desc_nulls_last()).first()
    assert top["pres_adjusted"] in (280.0, 320.0) and top["aou_res"] > 15
    bins = {r["pres_adjusted"]: r["aou"] for r in g.collect()}
    assert len(bins) == 23 and bins[0.0] == pytest.approx(0.75)


@pytest.fixture()
def saved(spark):
    t = spark.range(500).select(F.when(F.col("id") % 2 == 0, "d/physical/obduction").otherwise("d/physical/subduction").alias("pool_id"),
                                F.lit("spec1").alias("spec_id"), F.col("id").alias("wmo"), F.lit(1).alias("cycle_number"), F.lit(250.5).alias("pres_adjusted"))
    t = K.event_key(t)
    path = new_path(spark, "lists")
    return t, path, C.write_candidates(t, path, "src")


def test_a_list_is_what_its_sidecar_says(spark, saved):
    t, path, side = saved
    pools = side.select("pool_id", "spec_id")
    pool = "d/physical/obduction"
    got = C.scan_verified(spark, path, side, pools, pool, list(K.EVENT_KEY), "src")
    assert got.count() == 250 and got.columns == list(K.EVENT_KEY)
    for broken, where in ((side.withColumn("spec_id", F.lit("spec0")), "spec"), (side.withColumn("content_sha256", F.lit("0")), "keys"),
                          (side.withColumn("n_rows", F.lit(1)), "row count")):
        with pytest.raises(Refused, match=where):
            C.scan_verified(spark, path, broken, pools, pool, None, "src")
    with pytest.raises(Refused, match="source"):
        C.scan_verified(spark, path, side, pools, pool, None, "other")
    with pytest.raises(Exception):
        C.write_candidates(t, path)


def test_a_list_that_changed_after_writing_is_refused(spark):
    t = spark.range(60).select(F.lit("d/physical/obduction").alias("pool_id"), F.lit("spec1").alias("spec_id"), F.col("id").alias("wmo"),
                               F.lit(1).alias("cycle_number"), F.lit(250.5).alias("pres_adjusted"))
    t = K.event_key(t)
    path = new_path(spark, "lists")
    side = C.write_candidates(t, path, "src")
    pools = side.select("pool_id", "spec_id")
    # the data are swapped, the sidecar is not
    kept = t.where("wmo < 59").unionByName(t.where("wmo = 0").withColumn("k_wmo", F.lit(77).cast("bigint")))
    kept.write.mode("overwrite").partitionBy("pool_id").parquet(path)
    for recorded in (side, C.read_sidecar(spark, path)):
        with pytest.raises(Refused, match="keys"):
            C.scan_verified(spark, path, recorded, pools, "d/physical/obduction", None, "src")
    t.where("wmo < 30").write.mode("overwrite").partitionBy("pool_id").parquet(path)
    with pytest.raises(Refused, match="row count"):
        C.scan_verified(spark, path, side, pools, "d/physical/obduction", None, "src")


def test_files_of_the_same_name_in_many_folders_are_all_probed(spark, tmp_path):
    for k in range(1_030):
        (tmp_path / f"d{k}").mkdir()
        path = tmp_path / f"d{k}" / "7_core_fine.parquet"
        path.write_bytes(b"no parquet") if k % 500 == 3 else pq.write_table(pa.table({"x": [k]}), path)
    files = spark.createDataFrame([(f"7_core_fine.parquet", f"file:{tmp_path}/d{k}/7_core_fine.parquet", 7, "core") for k in range(1_031)],
                                  "file_name string, path string, wmo int, grid_kind string")
    got = S.probe_files(spark, files.where(f"path not like '%/d1030/%'"))
    assert got.count() == 1_030 and {r.path.split("/")[-2] for r in got.where("error is not null").collect()} == {"d3", "d503", "d1003"}


def test_a_list_scan_reads_one_pool_and_its_columns(spark, saved):
    plan = C.scan_candidates(spark, saved[1], "d/physical/obduction", ["k_wmo"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pool_id" in plan and "ReadSchema: struct<k_wmo:bigint>" in plan


def test_a_window_reaches_the_scan(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = R.in_window(t, "1996-01-01", "1997-01-01", "l_shipdate").select("l_suppkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_pinned_tables(spark, saved):
    with pytest.raises(Refused, match="moved"):
        C.scan_pinned(spark, saved[1], ["wmo"], ["k_wmo"], "0" * 64)


def test_records_and_their_nesting(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"batch_id":"b","role":"analysis","sampling":{"design":"probability","frame":"f"},'
                                     '"strata":[{"design_stratum":"d0","frame_n":5}],"session":{"d0":{"n":3,"accepted":1}}}\n')
    t = records.read_records(spark, str(tmp_path))
    assert t.select(F.explode("strata")).select("col.*").first()["frame_n"] == 5
    assert t.select(F.col("session")["d0"]["accepted"]).first()[0] == 1
    flat = records.flatten(t)
    assert "sampling_design" in flat.columns and "session" not in flat.columns and flat.first()["sampling_design"] == "probability"


def test_a_judged_sheet_is_never_overwritten(spark):
    key = spark.createDataFrame([("b", 0), ("b", 1)], "batch_id string, sample_id int")
    sheet = key.withColumn("label", F.lit(None).cast("int"))
    path = new_path(spark, "sheet")
    W.write_sheets(sheet, key, path)
    W.write_sheets(sheet, key, path)                       # still blank
    W.write_sheets(sheet.withColumn("label", F.lit(1)), key, path)
    with pytest.raises(Refused, match="verdicts"):
        W.write_sheets(sheet, key, path)


def test_strata_are_saved_once_and_checked(spark):
    t = spark.createDataFrame([("p", i, 1, 1, f"d{i % 2}") for i in range(10)], "pool_id string, k_wmo int, k_cycle int, k_pres int, design_stratum string")
    path = new_path(spark, "strata")
    side = W.save_strata(t, path)
    assert W.load_strata(spark, path, side, side).count() == 10
    with pytest.raises(Refused, match="draw record"):
        W.load_strata(spark, path, side, side.withColumn("frame_n", F.col("frame_n") + 1))
    t.limit(9).write.mode("overwrite").parquet(path)
    with pytest.raises(Refused, match="sidecar"):
        W.load_strata(spark, path, side, side)


def test_report_and_model_round_trip(spark, tmp_path):
    W.write_report(spark.createDataFrame([("p", 0.1)], "pool_id string, rate double"), str(tmp_path / "rates"))
    assert spark.read.csv(str(tmp_path / "rates"), header=True).first()["rate"] == "0.1"


def test_staging_uses_the_shared_folder(spark):
    folder = shared_folder(spark)
    t = staged(spark.range(5))
    assert t.inputFiles() and all(folder.split(":")[-1].strip("/") in f for f in t.inputFiles())
    assert t.count() == 5 and release(spark) >= 1


@pytest.fixture(scope="module")
def toy(spark):
    """40 floats of 12 rows; the verdict follows `signal`, `noise` and the latitude say nothing."""
    from fathomline.functions.hashing import unit
    t = spark.range(480).select(F.lit("p").alias("pool_id"), F.floor(F.col("id") / 12).alias("wmo"), F.col("id").alias("k_wmo"), F.lit(0).alias("k_cycle"), F.lit(0).alias("k_pres"),
                                unit(1, "s", "id").alias("signal"), unit(1, "n", "id").alias("noise"), F.lit(1.0).alias("latitude"),
                                unit(1, "f", F.floor(F.col("id") / 12)).alias("per_float"))
    return staged(t)


def test_model_reads_the_signal_and_not_the_float(spark, toy):
    small = M.BoostedTrees(max_iter=8, step_size=0.3, max_depth=3)
    assert "latitude" not in R.feature_columns(toy)
    t = toy.withColumn("decision", (F.col("signal") > 0.6).cast("int"))
    t = t.withColumn("noise", F.when(F.col("noise") > 0.1, F.col("noise")))            # some readings are missing
    oof = M.evaluate(t, ["signal", "noise"], 3, 1, small)
    assert oof.count() == 480
    assert oof.groupBy("wmo").agg(F.count_distinct("fold").alias("f")).agg(F.max("f")).first()[0] == 1
    assert M.auc(oof, "oof", "decision").first()["auc"] > 0.95
    by_float = toy.withColumn("decision", (F.col("per_float") > 0.5).cast("int"))
    assert M.auc(M.evaluate(by_float, ["noise", "signal"], 3, 1, small), "oof", "decision").first()["auc"] < 0.75


def test_folds_keep_the_balance(spark, toy):
    f = M.grouped_folds(toy.withColumn("decision", (F.col("signal") > 0.6).cast("int")), 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("decision").alias("s")).collect()
    assert {r["n"] for r in f} == {96} and max(r["s"] for r in f) - min(r["s"] for r in f) < 0.12


def test_rows_are_made_once_for_a_written_list(spark):
    """The ranges of a list are sampled from what was made, which is not made again when it is dealt and written."""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    t = K.event_key(spark.range(400).select(F.lit("d/physical/obduction").alias("pool_id"), F.lit("spec1").alias("spec_id"), F.col("id").alias("wmo"),
                                            F.lit(1).alias("cycle_number"), F.lit(250.5).alias("pres_adjusted")))
    side = C.write_candidates(t.mapInArrow(rows, t.schema), new_path(spark, "lists"), "src")
    assert made.value == 400
    assert [(r.pool_id, r.n_rows, r.spec_id) for r in side.collect()] == [("d/physical/obduction", 400, "spec1")]


def test_a_set_digest_is_that_of_its_sums(spark):
    import hashlib
    keys = [(k, k % 7, -k) for k in range(3000)]
    digests = [hashlib.sha256("|".join(map(str, k)).encode()).hexdigest() for k in keys]
    sums = [sum(int(d[8 * i:8 * i + 8], 16) for d in digests) for i in range(8)]
    got = K.content_hash(spark.createDataFrame([("p", *k) for k in keys * 2], "pool_id string, k_wmo long, k_cycle long, k_pres long")).first()
    assert (got["n"], got["content_sha256"]) == (3000, hashlib.sha256("|".join(map(str, [3000, *sums])).encode()).hexdigest())
