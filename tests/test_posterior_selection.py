import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmeter.functions import ability_grid, ability_prior, difficulty_nodes
from panelmeter.operators import posterior as B, selection as S

BANK = [("a", 0.0, 1.0, 0.5), ("b", 0.0, 1.0, 0.5), ("c", 1.0, 1.5, 0.0), ("d", -1.0, 0.8, 0.3),
        ("e", 2.0, 1.2, 0.2)]


@pytest.fixture(scope="module")
def bank(spark):
    return spark.createDataFrame(BANK, "item string, b double, a double, s double")


@pytest.fixture(scope="module")
def responses(spark):
    rows = [("x", "a", 1), ("x", "c", 0), ("x", "unknown", 1)]
    rows += [("full", i, int(k % 2 == 0)) for k, (i, *_) in enumerate(BANK)]
    return spark.createDataFrame(rows, "rater string, item string, y int")


@pytest.fixture(scope="module")
def curves(spark, bank):
    return spark.createDataFrame(B.item_curves(bank).toPandas(), "item string, m array<double>")


def sigm(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def brute_curve(b, a, s):
    g = ability_grid()
    x, w = difficulty_nodes()
    return sigm(a * (g - b)) if s <= 0 else sum(
        wk * sigm(a * (g - (b + s * xk))) for xk, wk in zip(x, w))


def brute_post(pairs):
    q = ability_prior().copy()
    for item, y in pairs:
        m = brute_curve(*next(r[1:] for r in BANK if r[0] == item))
        q = q * np.where(y, m + 1e-12, 1 - m + 1e-12)
    return q / q.sum()


def test_curves_with_and_without_uncertainty(curves, bank):
    got = {r["item"]: np.array(r["m"]) for r in curves.collect()}
    for item, b, a, s in BANK:
        assert np.allclose(got[item], brute_curve(b, a, s), atol=1e-12)
    plain = {r["item"]: np.array(r["m"]) for r in B.item_curves(bank, False).collect()}
    assert np.allclose(plain["a"], sigm(ability_grid()))


def test_posterior_mode_and_prior(spark, responses, curves):
    who = spark.createDataFrame([("x",), ("new",)], "rater string")
    got = {r["rater"]: r for r in B.posterior_mode(
        B.theta_posterior(responses, curves, who)).collect()}
    want = brute_post([("a", 1), ("c", 0)])
    assert np.allclose(got["x"]["post"], want) and got["x"]["n_administered"] == 2
    assert got["x"]["theta"] == pytest.approx(ability_grid()[want.argmax()])
    assert np.allclose(got["new"]["post"], ability_prior()) and got["new"]["theta"] == 0.0


def test_success_rate_against_draws(spark, responses, curves):
    who = spark.createDataFrame([("x",), ("full",), ("new",)], "rater string")
    got = {r["rater"]: r for r in B.estimate_raters(responses, curves, who).collect()}
    full = got["full"]
    assert full["sr_mean"] == full["sr_lo"] == full["sr_hi"] == 3 / 5 and full["sr_se"] == 0
    rng = np.random.RandomState(0)
    m = np.array([brute_curve(*r[1:]) for r in BANK])
    for rater, seen in (("x", {"a": 1, "c": 0}), ("new", {})):
        post = brute_post(list(seen.items()))
        g = rng.choice(len(post), 200_000, p=post)
        rest = [k for k, r in enumerate(BANK) if r[0] not in seen]
        sr = (sum(seen.values()) + (rng.rand(len(g), len(rest)) < m[rest][:, g].T).sum(1)) / 5
        assert got[rater]["sr_mean"] == pytest.approx(sr.mean(), abs=3e-3)
        assert got[rater]["sr_se"] == pytest.approx(sr.std(), abs=3e-3)
        assert got[rater]["sr_lo"] == np.quantile(sr, 0.025)
        assert got[rater]["sr_hi"] == np.quantile(sr, 0.975)


def test_interval_on_a_wide_bank(spark):
    rng = np.random.RandomState(2)
    items = [(f"i{k:03d}", float(b), 1.0, 0.3) for k, b in enumerate(rng.normal(size=150))]
    bank = spark.createDataFrame(items, "item string, b double, a double, s double")
    resp = spark.createDataFrame([("r", f"i{k:03d}", k % 3 == 0) for k in range(20)],
                                 "rater string, item string, y boolean").withColumn(
        "y", F.col("y").cast("int"))
    got = B.estimate_raters(resp, B.item_curves(bank)).first()
    m = np.array([brute_curve(*r[1:]) for r in items])
    q = ability_prior().copy()
    for k in range(20):
        q *= np.where(k % 3 == 0, m[k], 1 - m[k])
    q /= q.sum()
    g = rng.choice(len(q), 60_000, p=q)
    sr = (7 + (rng.rand(len(g), 130) < m[20:][:, g].T).sum(1)) / 150
    assert got["sr_lo"] == pytest.approx(np.percentile(sr, 2.5), abs=1.01 / 150)
    assert got["sr_hi"] == pytest.approx(np.percentile(sr, 97.5), abs=1.01 / 150)


def test_next_item_ties_and_exhaustion(spark, responses, curves, bank):
    who = spark.createDataFrame([("x",), ("full",), ("new",)], "rater string")
    posts = B.theta_posterior(responses, curves, who)
    got = {(r["rater"], r["rank"]): r for r in
           S.next_item(posts, curves, responses, 5).collect()}
    assert not any(r == "full" for r, _ in got)                # nothing left
    assert {got[("x", k)]["item"] for k in (1, 2, 3)} == {"b", "d", "e"}
    order = [got[("new", k)]["item"] for k in range(1, 6)]
    assert order.index("a") + 1 == order.index("b")            # same curve, smaller id first
    assert all(r["gain"] >= 0 for r in got.values())
    h = lambda p: -(p * np.log(p) + (1 - p) * np.log(1 - p))
    q, m = brute_post([("a", 1), ("c", 0)]), brute_curve(*BANK[3][1:])
    d = next(r for (who_, _), r in got.items() if who_ == "x" and r["item"] == "d")
    assert d["gain"] == pytest.approx(h(q @ m) - q @ h(m), abs=1e-9)
    th = B.posterior_mode(posts)
    f = S.next_item_fisher(th, bank, responses, 1).where("rater = 'new'").first()
    assert f["item"] == "c" and f["gain"] == pytest.approx(
        1.5 ** 2 * sigm(-1.5) * (1 - sigm(-1.5)))
    sh = S.next_item_shrunk(th, bank.select("item", "b", F.lit(2.9).alias("s2")), responses, 1)
    assert sh.where("rater = 'new'").first()["item"] == "a"


def test_blocks_of_items_and_raters_agree(spark, curves, responses, monkeypatch):
    posts = B.theta_posterior(responses, curves)
    one = S.next_item(posts, curves, responses, 2).toPandas()
    monkeypatch.setattr(S, "ITEM_BLOCK", 2)
    monkeypatch.setattr(S, "RATER_CHUNK", 1)
    many = S.next_item(posts, curves, responses, 2).toPandas()
    key = ["rater", "rank"]
    pd.testing.assert_frame_equal(one.sort_values(key, ignore_index=True),
                                  many.sort_values(key, ignore_index=True))


def test_precision_by_step_carries_over_blocks(spark, bank, curves, monkeypatch):
    log = spark.createDataFrame([("r", i, k + 1, k % 2) for k, (i, *_) in enumerate(BANK)],
                                "rater string, item string, step int, y int")
    whole = B.precision_by_step(log, bank).orderBy("step").toPandas()
    monkeypatch.setattr(B, "STEP_BLOCK", 2)
    cut = B.precision_by_step(log, bank).orderBy("step").toPandas()
    pd.testing.assert_frame_equal(whole, cut)
    q = brute_post([(i, k % 2) for k, (i, *_) in enumerate(BANK)])
    theta = ability_grid()[q.argmax()]
    p = [(a, sigm(a * (theta - b))) for _, b, a, _ in BANK]
    assert whole["theta"].iloc[-1] == pytest.approx(theta)
    assert whole["se"].iloc[-1] == pytest.approx(1 / np.sqrt(sum(a * a * v * (1 - v) for a, v in p) + 1))
    n = B.rollouts_to_precision(spark.createDataFrame(whole), tau=whole["se"].iloc[2] + 1e-9).first()
    assert n["n_items"] == 3 and n["n_logged"] == 5


def test_repeated_outcomes_count_once(spark):
    bank = spark.createDataFrame([("a", 0.0, 1.0, 0.0), ("b", 1.0, 1.0, 0.0)], "item string, b double, a double, s double")
    curves = B.item_curves(bank)
    log = spark.createDataFrame([("r", "a", 1, 1), ("r", "a", 2, 0)], "rater string, item string, step int, y int")
    last = log.where("step = 2").drop("step")
    twice, once = (B.estimate_raters(x, curves).first().asDict() for x in (log, last))
    assert twice == pytest.approx(once) and twice["n_administered"] == 1
    assert B.estimate_raters(log.withColumnRenamed("step", "at"), curves, order="at").first().asDict() == pytest.approx(once)


def test_residual_variance_is_of_the_other_folds(spark):
    rows = [("x", 1.0, 0.0), ("x", 2.0, 0.0), ("y", 5.0, 1.0), ("z", 1.0, 1.0)]
    got = S.residual_variance(spark.createDataFrame(rows, "fold string, b double, b_tilde double")).collect()
    for r in got:
        d = [b - t for f, b, t in rows if f != r["fold"]]
        assert r["n_items"] == len(d) and r["s2"] == pytest.approx(np.var(d))


def test_last_outcome(spark):
    log = spark.createDataFrame([("r", "a", 1, 0), ("r", "a", 2, 1)],
                                "rater string, item string, step int, y int")
    assert B.last_outcome(log).first()["y"] == 1


def test_bank_and_curves_give_the_same_sums(spark, responses, bank, curves):
    who = spark.createDataFrame([("x",), ("new",)], "rater string")
    for use in (B.theta_posterior, B.success_rate):
        for raters in (None, who):
            a, b = ({r["rater"]: r.asDict() for r in use(responses, given, raters).collect()} for given in (bank, curves))
            assert a.keys() == b.keys()
            for rater, row in a.items():
                for c, v in row.items():
                    assert v == pytest.approx(b[rater][c], abs=1e-9), (rater, c)


def test_bank_sums_of_a_hot_rater_and_of_odd_ids(spark):
    """A rater with most responses, ids beyond 2^53, a null id, a null outcome, items outside the bank."""
    bank = [(i, (i % 41 - 20) / 8, 0.5 + i % 7 / 5, i % 3 * 0.3) for i in range(600)]
    big = 2 ** 60 + 1
    rows = [(big, i, i % 2) for i in range(600)] + [(big + 1, 5, 1), (None, 5, 1), (None, 6, None), (7, 10 ** 9, 1)]
    df = spark.createDataFrame(rows, "rater bigint, item bigint, y int").repartition(4)
    got = {r["rater"]: r for r in B.response_sums(
        df, spark.createDataFrame(bank, "item bigint, b double, a double, s double"), moments=True).collect()}
    assert set(got) == {big, big + 1, None}
    assert got[big]["n_administered"] == 600 and got[big]["passed"] == 300 and got[None]["passed"] == 1
    m = np.array([brute_curve(*p[1:]) for p in bank])
    y = np.arange(600)[:, None] % 2
    want = np.r_[np.log(np.where(y == 1, m, 1 - m) + 1e-12).sum(0), m.sum(0), (m * (1 - m)).sum(0),
                 (m * (1 - m) * (1 - 2 * m)).sum(0)]
    assert np.allclose(got[big]["v"], want, atol=1e-9)
    empty = B.response_sums(df.limit(0), spark.createDataFrame(bank, "item bigint, b double, a double, s double"))
    assert empty.count() == 0


def test_curves_forgotten_and_made_again():
    keep = B._Curves(kept=4)
    rng = np.random.default_rng(3)
    for _ in range(5):
        params = rng.integers(1, 4, (6, 3)).astype(float)
        assert np.allclose(keep.of(params), [brute_curve(*p) for p in params])
        assert len(keep.place) <= 6


def test_no_vector_per_response_is_shuffled(spark, responses, bank):
    plan = B.response_sums(responses, bank)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "rangepartitioning(rater" in below and "array" not in below[below.index("rangepartitioning"):]


def test_items_of_one_kind_are_scored_once(spark, monkeypatch):
    """Copies of items, answered ones among them, give what scoring every pair gives."""
    rng = np.random.default_rng(5)
    sets = [(float(b), float(a), float(s)) for b, a, s in zip(rng.normal(size=7), rng.uniform(0.5, 2, 7), [0.0, 0.4] * 4)]
    bank_rows = [(i, *sets[int(k)]) for i, k in enumerate(rng.integers(0, 7, 60))]
    bank = spark.createDataFrame(bank_rows, "item bigint, b double, a double, s double")
    resp = [(r, int(i), int(rng.random() < 0.5)) for r in range(6) for i in rng.choice(60, 9 * r + 5, replace=False)]
    resp += [(9, i, 1) for i in range(60)]
    responses = spark.createDataFrame(resp, "rater bigint, item bigint, y int")
    posts = B.theta_posterior(responses, bank)
    m = np.array([brute_curve(*r[1:]) for r in bank_rows])
    h = lambda p: -(p * np.log(p) + (1 - p) * np.log(1 - p))
    want = {}
    for r in posts.collect():
        q, done = np.array(r["post"]), {i for o, i, _ in resp if o == r["rater"]}
        gain = np.round(h(m @ q) - h(m) @ q, 12)
        for rank, i in enumerate(sorted(set(range(60)) - done, key=lambda i: (-gain[i], i))[:9], 1):
            want[r["rater"], rank] = i
    for blocks in (S.ITEM_BLOCK, 2):
        monkeypatch.setattr(S, "ITEM_BLOCK", blocks)
        for given in (bank, B.item_curves(bank)):
            top = S.next_item(posts, given, responses, 9)
            assert {(r["rater"], r["rank"]): r["item"] for r in top.collect()} == want


def test_copies_of_items_do_not_add_to_the_scoring(spark, monkeypatch):
    def counted(raters, items):
        assert len(items) == 3
        return lambda part: np.tile(items["b"].to_numpy(dtype=float), (len(raters.iloc[part]), 1))
    bank = spark.createDataFrame([(i, float(i % 3)) for i in range(300)], "item bigint, b double")
    raters = spark.createDataFrame([(1,), (2,)], "rater bigint")
    top = S._best_items(raters, bank, spark.createDataFrame([(1, 2), (1, 8)], "rater bigint, item bigint"), 2, counted)
    assert {(r["rater"], r["rank"], r["item"]) for r in top.collect()} == {(1, 1, 5), (1, 2, 11), (2, 1, 2), (2, 2, 5)}


def test_steps_make_each_curve_once(monkeypatch):
    """However many responses a task meets, its curves follow the distinct items."""
    made = []
    monkeypatch.setattr(B, "_curve_rows", lambda b, a, s, make=B._curve_rows: made.append(len(b)) or make(b, a, s))
    steps = B._Steps()
    for rater in range(5):
        pdf = pd.DataFrame({"rater": rater, "step": range(40), "block": 0, "y": np.arange(40) % 2, "b": np.arange(40) % 4 - 1.5,
                            "a": 1.2, "s": 0.3, "carry": None})
        ll, info = steps.of(pdf)
        m = np.array([brute_curve(*r) for r in pdf[["b", "a", "s"]].to_numpy()])
        assert np.allclose(ll, np.log(np.where(pdf["y"].to_numpy()[:, None] == 1, m, 1 - m) + 1e-12), atol=1e-9)
        p = np.array([sigm(1.2 * (ability_grid() - b)) for b in pdf["b"]])
        assert np.allclose(info, 1.44 * p * (1 - p)) and len(steps.running(pdf)) == 40
    assert sum(made) == 8


def test_logs_are_solved_in_bounded_slices(monkeypatch):
    from panelmeter.operators import ability as A
    rng = np.random.default_rng(1)
    sizes = [0, 3, 500, 1, 40, 0, 7]
    a, y = (pd.Series([f(n) for n in sizes]) for f in (lambda n: rng.uniform(0.5, 2, n), lambda n: rng.integers(0, 2, n)))
    b = pd.Series([rng.normal(size=n) for n in sizes])
    whole, taken = A._map_of_log.func(b, a, y, pd.Series([30] * 7)), []
    monkeypatch.setattr(A, "LOG_ROWS", 45)
    monkeypatch.setattr(A, "_solved_logs", lambda b, *r, make=A._solved_logs: taken.append(len(b)) or make(b, *r))
    assert np.array_equal(whole, A._map_of_log.func(b, a, y, pd.Series([30] * 7)))
    assert sum(taken) == 7 and len(taken) > 2
