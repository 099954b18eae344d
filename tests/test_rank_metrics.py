import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmeter.operators import metrics, rank, resample
from panelmeter.operators.rank import auroc, dense_index, macro_auroc, spearman, text_index
from panelmeter.session import cut_lineage


def brute_auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


@pytest.mark.parametrize("n_values", [2, 7, 1000])
def test_rank_metrics_against_brute_force(spark, n_values):
    rng = np.random.RandomState(n_values)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "x": rng.randint(0, n_values, 400) * 1.0,
                        "z": rng.normal(size=400).round(1), "y": rng.randint(0, 2, 400)})
    df = spark.createDataFrame(pdf)
    for r in spearman(df, "x", "z", ["g"]).collect():
        part = pdf[pdf.g == r["g"]]
        assert r["rho"] == pytest.approx(part.x.rank().corr(part.z.rank()), abs=1e-12)
    for r in auroc(df, "y", "x", ["g"]).collect():
        part = pdf[pdf.g == r["g"]]
        assert r["auroc"] == pytest.approx(brute_auroc(part.y.values, part.x.values), abs=1e-12)


def test_rank_metrics_undefined(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 3.0, 1)], "x double, z double, y int")
    assert spearman(df, "x", "z").first()["rho"] is None
    assert auroc(df, "y", "z").first()["auroc"] is None
    assert macro_auroc(df.withColumn("rater", F.lit("r")), "y", "z").first()["n_raters"] == 0


def test_dense_index_is_gapless(spark):
    df = spark.createDataFrame([(f"k{(i * 37) % 500:03d}", (i * 37) % 500) for i in range(500)],
                               "name string, v int")
    assert all(r["v"] == r["pos"] for r in dense_index(df, "v", "pos").collect())
    assert all(int(r["name"][1:]) == r["pos"] for r in text_index(df, "name", "pos").collect())


def test_cell_scores(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.4), ("b", 1, 1.0), ("b", 1, 0.5)]
    cells = spark.createDataFrame(rows, "item string, y int, p double")
    assert metrics.scene_mae(cells).first()["scene_mae"] == pytest.approx((0.15 + 0.25) / 2)
    want = -np.mean([np.log(0.9), np.log(0.6), np.log(1 - 1e-9), np.log(0.5)])
    assert metrics.nll(cells).first()["nll"] == pytest.approx(want)
    one = spark.range(1).select(
        metrics.gap_recovery(F.lit(0.2), F.lit(0.1), F.lit(0.2)).alias("none"),
        metrics.gap_recovery(F.lit(0.3), F.lit(0.2), F.lit(0.1)).alias("half"),
        metrics.ceiling(F.lit(0.6915)).alias("c"),
        metrics.ies(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(40.0)).alias("ies")).first()
    assert one["none"] is None and one["half"] == pytest.approx(0.5) and one["ies"] is None
    assert one["c"] == pytest.approx(0.9042, abs=1e-4)


def test_p_irt_keeps_observed(spark):
    probs = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.5)],
                                  "rater string, item string, p double")
    resp = spark.createDataFrame([("r", "a", 1), ("r", "other", 0)],
                                 "rater string, item string, y int")
    got = metrics.p_irt(resp, probs).first()
    assert got["pred_sr"] == 0.75 and got["n_administered"] == 1 and got["n_bank"] == 2


def test_bootstrap_forms_agree_and_repeat(spark):
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame({"k": rng.choice(list("abcdef"), 150, p=[.5, .1, .1, .1, .1, .1]),
                        "y": rng.normal(size=150).round(1), "u": rng.randint(0, 5, 150) * 1.0,
                        "v": rng.normal(size=150)})
    df = spark.createDataFrame(pdf)
    cubic = resample.bootstrap_spearman(df, "k", "y", ["u", "v"], 40, 3).toPandas()
    ranked = resample.bootstrap_spearman(df, "k", "y", ["u", "v"], 40, 3,
                                         cubic_clusters=1).toPandas()
    both = cubic.merge(ranked, on="rep")
    assert len(both) == 40
    assert np.allclose(both.u_x, both.u_y) and np.allclose(both.v_x, both.v_y)
    # one replicate by hand: rows repeated as often as their cluster was drawn
    clusters = resample.cluster_index(df, "k")
    w = resample.bootstrap_weights(clusters, 6, 40, 3).where("rep = 5").toPandas()
    rows = pdf.merge(w, left_on="k", right_on="cluster")
    rows = rows.loc[rows.index.repeat(rows.w)]
    want = rows.u.rank().corr(rows.y.rank())
    assert both[both.rep == 5].u_x.iloc[0] == pytest.approx(want, abs=1e-9)
    d = resample.paired_difference(spark.createDataFrame(cubic), "u", "v").first()
    assert d["n_reps"] == 40 and d["lo"] <= d["mean"] <= d["hi"]


def test_offsets_of_ranks_have_no_place_of_their_own(spark, monkeypatch):
    """They are read back, so they do not have the rows dealt by group alone."""
    tags = []
    monkeypatch.setattr(rank, "cut_lineage", lambda df, tag: tags.append(tag) or cut_lineage(df, tag))
    dist = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") * 1.0).alias("v"), F.lit(1).alias("n"))
    rows = rank.running_before(dist, "v", ["n"], ["g"], 16).collect()
    assert tags == ["offsets"] and len(rows) == 400
    assert all(r["before_n"] == r["v"] // 2 and r["total_n"] == 200 for r in rows)
