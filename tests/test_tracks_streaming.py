import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmeter.operators import posterior as B, tracks as T
from panelmeter.operators.selection import next_item
from panelmeter.session import cut_lineage, scratch_path
from panelmeter.sources.frames import BOX_TYPE
from panelmeter.streaming import (answered_so_far, drain, event_windows, latest_per_key, next_item_writer,
                                  outcome_changes, running_pass_rate, track_ability)


def box(cls, id_, x, y, yaw=0.0, speed=1.0, extent=(2.0, 1.0)):
    return {"class": cls, "id": id_, "location": [x, y, 0.0],
            "rotation": None if yaw is None else [0.0, 0.0, yaw],
            "extent": None if extent is None else list(extent), "speed": speed}


def frames_of(spark, rows):
    return spark.createDataFrame(
        [(s, f, b) for s, f, b in rows],
        f"scene string, frame int, boxes array<{BOX_TYPE.simpleString()}>")


def ego(x=0.0, y=0.0, yaw=0.0):
    return box("ego_vehicle", None, x, y, yaw)


def test_boxes_defaults_and_last_record(spark):
    inf = float("inf")
    f = frames_of(spark, [("s", 0, [
        box("vehicle", "1", 1.0, 1.0), box("walker", "2", 2.0, 2.0, None, None, None),
        box("vehicle", "1", 5.0, 5.0), box("vehicle", None, 1.0, 1.0),
        box("vehicle", "3", inf, 0.0), box("tree", "4", 0.0, 0.0), ego(), ego(9.0)])])
    boxes = T.explode_boxes(f)
    agents = {r["id"]: r for r in T.last_agents(boxes).collect()}
    assert set(agents) == {"1", "2"}
    assert agents["1"]["x"] == 5.0 and agents["1"]["first_pos"] == 0
    w = agents["2"]
    assert (w["yaw"], w["speed"], w["half_len"], w["half_wid"], w["is_vehicle"]) == (0, 0, 2.4, .9, 0)
    assert T.last_ego(boxes).first()["x"] == 9.0


@pytest.mark.parametrize("n,windows", [(12, 0), (13, 1), (16, 1), (17, 2), (21, 3)])
def test_window_starts(spark, n, windows):
    rows = [("s", 3 * k, [ego()]) for k in range(n)] + [("s", 3 * k + 1, []) for k in range(n)]
    steps = T.window_steps(T.kept_frames(T.last_ego(T.explode_boxes(frames_of(spark, rows)))))
    got = steps.groupBy("widx").agg(F.count("*").alias("n"), F.min("seq").alias("a")).collect()
    assert len(got) == windows
    assert all(r["n"] == 12 and r["a"] == 4 * r["widx"] for r in got)


def test_windows_of_one_scene(spark):
    rows = []
    for k in range(13):
        b = [ego(0.0, 0.0, 90.0), box("vehicle", "edge", 60.0, 0.0), box("vehicle", "in", 3.0, 4.0)]
        if k == 3:
            b += [box("vehicle", f"n{j:02d}", 1.0, 0.0) for j in range(49)]
            b += [box("walker", "once", 0.0, 2.0)]
        if k == 5:
            b = b[:2] + [box("vehicle", "late", 1.0, 1.0)]
        rows.append(("s", k, b))
    w = T.build_windows(cut_lineage(T.explode_boxes(frames_of(spark, rows)), "boxes"))
    near = w["near"].orderBy("slot").collect()
    assert len(near) == 48 and [r["id"] for r in near[:3]] == ["n00", "n01", "n02"]
    assert all(r["id"] not in ("edge", "late") for r in near)
    few = T.build_windows(T.explode_boxes(frames_of(spark, [
        (s, f, [x for x in b if not (x["id"] or "").startswith("n")]) for s, f, b in rows])))
    ag = few["agents"].collect()
    slot = {r["id"]: r["slot"] for r in few["near"].collect()}
    assert slot == {"once": 0, "in": 1}
    inside = {r["step"]: r for r in ag if r["slot"] == 1}
    assert len(inside) == 12 and not inside[5]["mask"] and inside[5]["rel_x"] == 0.0
    # turned by -90 degrees: (3, 4) becomes (4, -3); the agent looks to the right
    assert inside[0]["rel_x"] == pytest.approx(4, abs=1e-5)
    assert inside[0]["rel_y"] == pytest.approx(-3, abs=1e-5)
    assert inside[0]["sin_psi"] == pytest.approx(-1, abs=1e-6)
    e = {r["step"]: r for r in few["ego"].collect()}
    assert e[3]["is_future"] == 0 and e[4]["is_future"] == 1
    cmds = spark.createDataFrame([("s", 0, 1), ("s", 1, 7), ("s", 2, 2)],
                                 "scene string, frame int, cmd int")
    hot = T.window_command(few["anchors"], cmds)
    assert hot.first()["cmd"] == [0, 0, 1, 0]                # frame 3 clamped to 2: turn right
    with pytest.raises(ValueError):
        T.window_command(few["anchors"], cmds, "other")
    packed = T.pack_windows(few["agents"], few["ego"], hot).first()
    assert (len(packed["agents"]), len(packed["agents"][0]), len(packed["ego"])) == (48, 12, 12)
    assert sum(map(sum, packed["mask"])) == 12
    feats = T.scene_features(few["agents"], few["ego"]).first()
    assert feats["nearest"] == pytest.approx(2.0) and feats["mean_agents"] == 2.0


def test_even_windows_cover_the_scene(spark):
    w = spark.createDataFrame([("s", k) for k in range(10)] + [("t", k) for k in range(3)],
                              "scene string, widx int")
    got = {}
    for r in T.even_windows(w, 4).collect():
        got.setdefault(r["scene"], []).append(r["widx"])
    assert sorted(got["s"]) == [math.floor(k * 10 / 4) for k in range(4)]
    assert sorted(got["t"]) == [0, 1, 2]


def test_downsample_counts_files_not_numbers(spark):
    f = spark.createDataFrame([("s", 10 * k) for k in range(12)], "scene string, frame int")
    nf = spark.createDataFrame([("s", 10)], "scene string, nf int")
    assert sorted(r["frame"] for r in T.downsample(f, nf).collect()) == [0, 50]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(f"r{k % 4}", f"i{(k * 7) % 5}", (k * k) % 3 % 2, k) for k in range(120)]
    df = spark.createDataFrame(rows, "rater string, item string, y int, ord bigint")
    path = scratch_path(spark, "log")
    for k in range(3):                   # three files in time order
        df.where(F.floor(F.col("ord") / 40) == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = (lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
              .parquet(path))
    return df, stream


def test_stream_equals_batch(spark, log):
    df, stream = log
    bank = spark.createDataFrame([(f"i{k}", k / 2 - 1.0, 1.0, 0.2) for k in range(5)],
                                 "item string, b double, a double, s double")
    curves = cut_lineage(B.item_curves(bank), "curves")
    got = {r["rater"]: r["post"] for r in latest_per_key(
        drain(track_ability(stream(), curves), "update", "t"), ["rater"]).collect()}
    want = {r["rater"]: r["post"] for r in B.theta_posterior(df, curves).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    # last outcome wins: signed changes written by one stream, tracked by the next
    changes = drain(outcome_changes(stream()), "append", "c")
    last = {(r["rater"], r["item"]): r["y"] for r in B.last_outcome(df, "ord").collect()}
    net = changes.groupBy("rater", "item").agg(
        F.sum("weight").alias("w"), F.sum(F.col("y") * F.col("weight")).alias("y")).collect()
    assert {(r["rater"], r["item"]): r["y"] for r in net} == last and all(r["w"] == 1 for r in net)
    assert changes.where("weight = -1").count() > 0
    folder = scratch_path(spark, "changes")
    changes.drop("batch").write.parquet(folder)
    fixed = drain(track_ability(spark.readStream.schema(changes.drop("batch").schema)
                                .parquet(folder), curves), "update", "t2")
    got = {r["rater"]: r["post"] for r in latest_per_key(fixed, ["rater"]).collect()}
    want = {r["rater"]: r["post"] for r in B.theta_posterior(
        B.last_outcome(df, "ord"), curves).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    rate = latest_per_key(drain(running_pass_rate(stream()), "update", "p"), ["rater"])
    assert rate.agg(F.sum("n_obs")).first()[0] == 120


def test_next_items_know_only_what_has_arrived(spark):
    """Three batches: an outcome that arrives late, repeated and null rows, a rater who answers the whole bank."""
    schema = "rater string, item bigint, y int, ord bigint"
    parts = [[("r", 1, 1, 10), ("r", 2, 0, 11), ("s", 1, 0, 12), (None, 1, 1, 13), ("r", None, 1, 14), ("r", 3, None, 15)],
             [("r", 2, 1, 5), ("r", 3, 1, 20), ("r", 3, 1, 20), ("r", 1, 0, 21)],
             [("s", k, k % 2, 30 + k) for k in (2, 3, 4)]]
    bank = spark.createDataFrame([(k, k - 2.5, 1.0, 0.3) for k in range(1, 5)], "item bigint, b double, a double, s double")
    curves = cut_lineage(B.item_curves(bank), "curves")
    path, out, state = scratch_path(spark, "in"), scratch_path(spark, "next"), scratch_path(spark, "state")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    told = {(r.batch, r.rater, r.item): r.y for r in drain(answered_so_far(stream()), "append", "told").collect()}
    assert told == {(0, "r", 1): 1, (0, "r", 2): 0, (0, "s", 1): 0, (1, "r", 1): 0, (1, "r", 2): 0, (1, "r", 3): 1,
                    (2, "s", 1): 0, (2, "s", 2): 0, (2, "s", 3): 1, (2, "s", 4): 0}
    (answered_so_far(stream()).writeStream.trigger(availableNow=True).option("checkpointLocation", state)
     .foreachBatch(next_item_writer(curves, out, 2)).start().awaitTermination())
    got = {(r.batch, r.rater, r["rank"]): r.item for r in spark.read.parquet(out).collect()}
    want = {}
    for k in range(3):
        known = spark.createDataFrame([(x, i, y) for (b, x, i), y in told.items() if b == k], "rater string, item bigint, y int")
        for r in next_item(B.theta_posterior(known, curves), curves, known, 2).collect():
            want[k, r.rater, r["rank"]] = r.item
    assert got == want
    assert {k[:2] for k in got} == {(0, "r"), (0, "s"), (1, "r")} and got[1, "r", 1] == 4


def test_late_records_are_dropped(spark):
    rows = [("s", 100 + k, 1.0) for k in range(20)]
    late = [("s", 5, 9.0)]
    path = scratch_path(spark, "late")
    schema = "scene string, sec int, v double"
    for k, part in enumerate((rows, [("s", 200, 1.0)], late, [("s", 400, 1.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("latestFirst", False).parquet(path)
              .withColumn("ts", F.timestamp_seconds("sec")))
    out = drain(event_windows(stream, "v"), "append", "w")
    assert out.where("max_value = 9.0").count() == 0
    assert out.where(F.unix_seconds("start") == 110).first()["n"] == 6


def test_a_bucket_of_outcomes_is_read_and_written_once():
    """Many pairs of odd ids in one state: signed changes as from one state per pair, one write a batch."""
    from panelmeter.streaming import ability as S

    class Held:
        value, writes = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.writes = value, self.writes + 1
    rng = np.random.default_rng(0)
    big = 2 ** 60 + 1
    last, seen, net, told_by = S._LastOutcomes(), {}, {}, S._Answered()
    last.last, told_by.last = Held(), Held()
    for batch in range(4):
        pdf = pd.DataFrame({"rater": big + rng.integers(0, 9, 300), "item": rng.integers(0, 40, 300),
                            "y": rng.integers(0, 2, 300), "ord": big + rng.permutation(1000)[:300]})
        for r in pdf.sort_values("ord").itertuples():
            if r.ord >= seen.get((r.rater, r.item), (0, 0))[0]:
                seen[r.rater, r.item] = (r.ord, r.y)
        for out in last.handleInputRows((0,), iter([pdf[:100], pdf[100:]]), None):
            for r in out.itertuples():
                n, s = net.get((r.rater, r.item), (0, 0))
                net[r.rater, r.item] = (n + r.weight, s + r.y * r.weight)
        assert net == {k: (1, y) for k, (_, y) in seen.items()}
        told = pd.concat(list(told_by.handleInputRows((0,), iter([pdf]), None)))
        assert {(r.rater, r.item): r.y for r in told.itertuples()} == {
            k: y for k, (_, y) in seen.items() if k[0] in set(pdf["rater"])}
    assert last.last.writes == told_by.last.writes == 4
