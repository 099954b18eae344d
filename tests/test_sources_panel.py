import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from panelmeter.operators import panel as P
from panelmeter.sources import (bundle_runs, materialise, read_frames, read_item_types, read_panel,
                                read_predictions, write_run, write_windows)


def test_read_panel_drops_rater_before_indexing(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text(",a,b,empty\nx,1.0,,\nPDM-Lite,1.0,1.0,\ny,0.0,1.0,\n")
    p = read_panel(spark, str(f))
    assert sorted(map(tuple, p.cells.collect())) == [("a", "x", 1), ("a", "y", 0), ("b", "y", 1)]
    assert sorted(map(tuple, p.raters.collect())) == [("x", 0), ("y", 1)]
    assert [tuple(r) for r in p.items.orderBy("item_ord").collect()] == [
        ("a", 0), ("b", 1), ("empty", 2)]


def test_item_types_last_line_wins(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("a, Left ,x\nno comma here\nb,Right\na,Other\n")
    got = {r["item"]: r["item_type"] for r in read_item_types(spark, str(f)).collect()}
    assert got == {"a": "Other", "b": "Right"}
    with pytest.raises(Exception, match="listed twice"):
        read_item_types(spark, str(f), duplicates="error").collect()


def test_order_over_several_and_split_files(spark, tmp_path):
    """The last line by file and offset wins, and raters keep that order, wherever files are cut."""
    for k, name in enumerate("cab"):                      # written in another order than they are read
        lines = [f"i{n % 50},{name}{n:04d}" + " " * 40 for n in range(2000)]
        (tmp_path / f"types-{name}.csv").write_text("\n".join(lines) + "\n")
        rows = [f"{name}{n:03d}," + ",".join(str(float((n + j + k) % 2)) for j in range(30)) for n in range(300)]
        (tmp_path / f"panel-{name}.csv").write_text("," + ",".join(f"i{j}" for j in range(30)) + "\n" + "\n".join(rows) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["item"]: r["item_type"] for r in read_item_types(spark, f"{tmp_path}/types-*.csv").collect()}
        assert got == {f"i{n}": f"c{1950 + n:04d}" for n in range(50)}
        p = read_panel(spark, f"{tmp_path}/panel-*.csv")
        assert p.cells.rdd.getNumPartitions() > 6          # files are cut
        order = [r["rater"] for r in p.raters.orderBy("rater_ord").collect()]
        assert order == [f"{name}{n:03d}" for name in "abc" for n in range(300)]
        assert [r["rater_ord"] for r in p.raters.orderBy("rater_ord").limit(3).collect()] == [0, 1, 2]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_fingerprint_depends_on_order(spark):
    items = spark.createDataFrame([("b", 0), ("a", 1)], "item string, item_ord int")
    want = hashlib.sha1(b"b,a").hexdigest()
    assert P.fingerprint(items).first()["digest"] == want
    P.assert_universe(items, 2, want)
    with pytest.raises(AssertionError):
        P.assert_universe(items, 3)
    swapped = items.withColumn("item_ord", 1 - F.col("item_ord"))
    with pytest.raises(AssertionError):
        P.assert_universe(swapped, 2, want)
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    many = spark.range(23).select(F.col("id").cast("string").alias("item"), (22 - F.col("id")).alias("item_ord")).repartition(5)
    level = [str(k) for k in range(22, -1, -1)]
    while len(level) > 1:
        level = [sha(",".join(level[k:k + 4])) for k in range(0, len(level), 4)]
    got = P.fingerprint(many, block=4).first()
    assert (got["n_items"], got["digest"]) == (23, level[0])
    assert P.fingerprint(many.limit(0)).first()["digest"] == sha("")
    # no string holds more ids than a block
    assert P.fingerprint(many, block=4).first() == P.fingerprint(many.coalesce(1), block=4).first()


def test_selection_and_reshape(spark, cells, cells_pdf, types):
    wide = {r["item"]: r["r0"] for r in P.dense(cells, None, ["r0", "r1"]).collect()}
    want = cells_pdf[cells_pdf.rater == "r0"].set_index("item")["y"].to_dict()
    assert {k: v for k, v in wide.items() if v is not None} == want
    with pytest.raises(ValueError):
        names = cells.select("rater", F.lit(0).alias("rater_ord")).distinct()
        P.dense_all(cells, cells.select("item").distinct(), names, max_columns=2)
    kept = P.min_observed(cells, 6).groupBy("item").count().agg(F.min("count")).first()[0]
    assert kept >= 6
    total = P.panel_summary(cells, types).where("level = 3").first()
    assert total["n_obs"] == len(cells_pdf) and total["n_pass"] == cells_pdf["y"].sum()
    asked = spark.createDataFrame([("i00", "r0"), ("i00", "nobody")], "item string, rater string")
    assert [r["rater"] for r in P.missing(cells, asked).collect()] == ["nobody"]
    assert {r["rater"]: r["observed"] for r in P.observed(cells, asked).collect()} == {
        "r0": True, "nobody": False}


def test_frames_keep_their_place_beside_bad_files(spark, tmp_path):
    from panelmeter.operators.tracks import downsample
    d = tmp_path / "route_1" / "anno"
    d.mkdir(parents=True)
    box = {"class": "vehicle", "id": "7", "location": [1, 2, 0]}
    for k in range(12):
        text = gzip.compress((("{broken" if k == 2 else json.dumps({"bounding_boxes": [box] * 50}))).encode())
        (d / f"{k:05d}.json.gz").write_bytes(text[:len(text) // 2] if k == 5 else text)   # 5 is cut off
    got = read_frames(spark, str(tmp_path))
    assert [(r["frame"], r["bad"], len(r["boxes"])) for r in got.orderBy("frame").collect()] == [
        (k, k in (2, 5), 0 if k in (2, 5) else 50) for k in range(12)]
    assert [r["frame"] for r in downsample(got).orderBy("frame").collect()] == [0, 10]
    short = spark.createDataFrame([("route_1", 9)], "scene string, nf int")
    assert [r["frame"] for r in downsample(got, short, 4).orderBy("frame").collect()] == [0, 4, 8]


def test_runs_need_names_and_replace_themselves(spark, tmp_path):
    run = spark.createDataFrame([("a", "t", 1.0, 0.5), ("b", "t", 2.0, 0.7)],
                                "item string, item_type string, reference double, b_tilde double")
    with pytest.raises(ValueError, match="8 runs"):
        bundle_runs([run] * 8)
    for _ in range(2):
        for name in ("x", "y"):
            write_run(run, name, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).groupBy("run").count().collect()[0]["count"] == 2


def test_shared_folder_needs_a_setting_on_a_cluster():
    from types import SimpleNamespace as Some

    from panelmeter.session import shared_folder

    def session(master, named):
        return Some(conf=Some(get=lambda *_: named), sparkContext=Some(master=master, applicationId=f"t-{master}"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("local-cluster[2,1,1024]", None))
    assert shared_folder(session("spark://h:1", "hdfs://h/x/")) == "hdfs://h/x"
    assert shared_folder(session("local[2]", None)).startswith("/tmp/")


def test_materialise_is_keyed_by_fingerprint(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    root = str(tmp_path)
    assert materialise(spark, make, "x", "f1", root=root).count() == 1
    assert materialise(spark, make, "x", "f1", root=root).count() == 1
    assert materialise(spark, make, "x", "f2", root=root).count() == 2
    assert materialise(spark, make, "x", "f1", recompute=True, root=root).count() == 3


def test_runs_and_windows_sinks(spark, tmp_path):
    rows = [(f"route_{k}", "t", float(k), float(k % 3)) for k in range(6)]
    run = spark.createDataFrame(rows, "item string, item_type string, reference double, b_tilde double")
    path = str(tmp_path / "runs")
    write_run(run, "d64_s0", path)
    write_run(run.withColumn("b_tilde", -F.col("reference")), "d64_s1", path)
    assert read_predictions(spark, path).count() == 6
    assert read_predictions(spark, path).where("item = '3'").first()["b_tilde"] == 0.0
    table, rho = bundle_runs([run, run.withColumn("b_tilde", -F.col("reference"))])
    assert {r["run"]: round(r["rho"], 6) for r in rho.collect()}["d64_s1"] == -1.0
    assert table.count() == 12
    with pytest.raises(ValueError):
        bundle_runs([run, run.limit(3)])
    w = spark.createDataFrame([("s1", 0, None), ("s2", 0, "bad file")],
                              "scene string, widx int, error string")
    good, bad = write_windows(w, str(tmp_path / "w"))
    assert [r["scene"] for r in spark.read.parquet(good).collect()] == ["s1"]
    assert [tuple(r) for r in spark.read.parquet(bad).collect()] == [("s2", "bad file")]


def test_item_tables_are_not_sent_to_the_driver(spark):
    """A table of several runs is read from one row per item, so its size is taken for far too small."""
    part = spark.range(50).select(F.col("id").alias("item"))
    runs = part.select("item", F.explode(F.array(*[F.lit(k) for k in range(9)])).alias("run"))
    kept = P.item_universe(part, runs, part.where("item < 20"))
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    assert {r["item"] for r in kept.collect()} == set(range(20)) and kept.count() == 20
