"""Calibration, folds, metrics of predictions, reliability and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import hash_int_sql
from ..functions.grid import GRID_LOW, GRID_SIZE, GRID_STEP
from ..operators import ability, calibrate as C, folds, metrics, resample
from ..operators.panel import as_failure, failure_rate
from ..operators.posterior import item_curves
from ..operators.regression import difficulty_regression
from ..plans import (evaluate, evaluate_left_out_raters, evaluate_runs, evaluate_two_way, macro, noise_ceiling,
                     run_spread, split_half, split_table)
from ..plans.difficulty import fold_abilities
from ..session import cut_lineage
from .base import (BANK, PANEL, RATE, SIZE, TYPES, auroc_sql, panel, plain_bank, rank_sql, rate_score,
                   rd, register, rsql, sig_sql, size_score, types)

# Fits run until no parameter moves by the tolerance, and fail if that takes too many sweeps.
TOL, TOL_MANY, MOST_SWEEPS = 1e-11, 1e-6, 60
SWEEPS = {"1pl": 12, "2pl": 15}       # sweeps of the SQL, past that tolerance on these tables


def _fit(spark, sf, model):
    fit = C.calibrate(panel(spark, sf), model=model, tol=TOL, max_sweeps=MOST_SWEEPS)
    return C.converged(fit, TOL)


# --- the same sweeps in SQL -------------------------------------------------------

ONE_FIT = f"""{PANEL},
cc AS MATERIALIZED (SELECT 'all' AS fit_id, item, rater, y FROM panel),
fi AS MATERIALIZED (SELECT DISTINCT fit_id, item FROM cc),
fr AS MATERIALIZED (SELECT DISTINCT fit_id, rater FROM cc)"""


def sweeps_sql(model: str, sweeps: int | None = None, tag: str = "", start: tuple[str, str] | None = None) -> str:
    """CTEs r<k> (fit_id, rater, theta) and i<k> (fit_id, item, b, loga) after k sweeps.

    tag goes before every name, also those of the cells cc and members fi, fr; start gives
    the relations (rater, theta) and (item, b, loga) that a warm start takes values from.
    """
    two, t, sweeps = model == "2pl", tag, sweeps or SWEEPS[model]
    first_r, first_i = "0::DOUBLE AS theta", "0::DOUBLE AS b, 0::DOUBLE AS loga"
    from_r, from_i = f"{t}fr", f"{t}fi"
    if start:
        first_r, first_i = "theta", "b, loga"
        from_r, from_i = f"{t}fr JOIN {start[0]} USING (rater)", f"{t}fi JOIN {start[1]} USING (item)"
    out = [f"""{t}fz AS MATERIALIZED (SELECT fit_id, s::DOUBLE AS s, j::DOUBLE AS j, n::DOUBLE AS n
  FROM (SELECT fit_id, count(*) AS s FROM {t}cc GROUP BY 1)
  JOIN (SELECT fit_id, count(*) AS j FROM {t}fr GROUP BY 1) USING (fit_id)
  JOIN (SELECT fit_id, count(*) AS n FROM {t}fi GROUP BY 1) USING (fit_id))""",
           f"{t}r0 AS MATERIALIZED (SELECT {t}fr.fit_id, rater, {first_r} FROM {from_r})",
           f"{t}i0 AS MATERIALIZED (SELECT {t}fi.fit_id, item, {first_i} FROM {from_i})"]
    p = sig_sql("exp(loga) * (theta - b)")
    for k in range(1, sweeps + 1):
        o = k - 1
        lam = "(2 * 0.01::DOUBLE * s / j)"
        out.append(f"""{t}t{k} AS MATERIALIZED (
  SELECT r.fit_id, r.rater, theta + greatest(least(
    (coalesce(g, 0) - {lam} * theta) / (coalesce(h, 0) + {lam}), 1.0), -1.0) AS theta
  FROM {t}r{o} r LEFT JOIN (
    SELECT fit_id, rater, sum(a * (y - p)) AS g, sum(a * a * p * (1 - p)) AS h FROM (
      SELECT c.fit_id, c.rater, y, exp(loga) AS a, {p} AS p FROM {t}cc c
      JOIN {t}i{o} USING (fit_id, item) JOIN {t}r{o} USING (fit_id, rater)) GROUP BY 1, 2)
  USING (fit_id, rater) JOIN {t}fz USING (fit_id))""")
        lb, ll = "(2 * 0.001::DOUBLE * s / n)", "(2 * 0.5::DOUBLE * s / n)"
        hbb, gb = f"(coalesce(hb, 0) + {lb})", f"(coalesce(gb, 0) - {lb} * b)"
        if two:
            hll, gl, hbl = (f"(coalesce(hl, 0) + {ll})", f"(coalesce(gl, 0) - {ll} * loga)",
                            "coalesce(hx, 0)")
            det = f"({hbb} * {hll} - {hbl} * {hbl})"
            sb, sl = f"({hll} * {gb} - {hbl} * {gl}) / {det}", f"({hbb} * {gl} - {hbl} * {gb}) / {det}"
        else:
            sb, sl = f"{gb} / {hbb}", "0"
        out.append(f"""{t}j{k} AS MATERIALIZED (
  SELECT i.fit_id, i.item, b + greatest(least({sb}, 1.0), -1.0) AS b,
         loga + greatest(least({sl}, 0.5), -0.5) AS loga
  FROM {t}i{o} i LEFT JOIN (
    SELECT fit_id, item, sum(-a * (y - p)) AS gb, sum(a * a * p * (1 - p)) AS hb,
           sum(a * d * (y - p)) AS gl, sum(a * a * d * d * p * (1 - p)) AS hl,
           sum(-a * a * d * p * (1 - p)) AS hx FROM (
      SELECT c.fit_id, c.item, y, exp(loga) AS a, theta - b AS d, {p} AS p FROM {t}cc c
      JOIN {t}i{o} USING (fit_id, item) JOIN {t}t{k} USING (fit_id, rater)) GROUP BY 1, 2)
  USING (fit_id, item) JOIN {t}fz USING (fit_id))""")
        out.append(f"""{t}s{k} AS MATERIALIZED (SELECT fit_id, -(0.001::DOUBLE * mb + 0.01::DOUBLE * mt) / 0.011::DOUBLE AS c
  FROM (SELECT fit_id, avg(b) AS mb FROM {t}j{k} GROUP BY 1)
  JOIN (SELECT fit_id, avg(theta) AS mt FROM {t}t{k} GROUP BY 1) USING (fit_id)),
{t}r{k} AS MATERIALIZED (SELECT fit_id, rater, theta + c AS theta FROM {t}t{k} JOIN {t}s{k} USING (fit_id)),
{t}i{k} AS MATERIALIZED (SELECT fit_id, item, b + c AS b, loga FROM {t}j{k} JOIN {t}s{k} USING (fit_id))""")
    out.append(f"{t}rz AS (SELECT * FROM {t}r{sweeps}), {t}iz AS (SELECT * FROM {t}i{sweeps}), "
               f"{t}mz AS (SELECT fit_id, avg(theta) AS m FROM {t}r{sweeps} GROUP BY 1)")
    return ",\n".join(out)


FIT1, FIT2 = f"WITH {ONE_FIT},\n{sweeps_sql('1pl')}", f"WITH {ONE_FIT},\n{sweeps_sql('2pl')}"


@register("c1_calibrate_1pl", f"{FIT1} SELECT item, {rsql('b')} AS b FROM iz")
def c1(spark, sf):
    return _fit(spark, sf, "1pl").items.select("item", rd("b").alias("b"))


@register("c2_calibrate_2pl", f"{FIT2} SELECT item, {rsql('b')} AS b, {rsql('exp(loga)')} AS a FROM iz")
def c2(spark, sf):
    return _fit(spark, sf, "2pl").items.select("item", rd("b").alias("b"), rd(F.exp("loga")).alias("a"))


@register("c5_center_b", f"{FIT1} SELECT item, {rsql('b - m')} AS b FROM iz JOIN mz USING (fit_id)")
def c5(spark, sf):
    return C.center_b(_fit(spark, sf, "1pl")).select("item", rd("b").alias("b"))


@register("c6_center_both", f"{FIT1} SELECT rater, {rsql('theta - m')} AS theta FROM rz JOIN mz USING (fit_id)")
def c6(spark, sf):
    return C.center_both(_fit(spark, sf, "1pl"))[0].select("rater", rd("theta").alias("theta"))


def frozen_sql(steps: int = 10) -> str:
    """h<k> (rater, theta): frozen-difficulty ability after k Newton steps over cells m."""
    out = ["""hz AS MATERIALIZED (SELECT 2 * 0.01::DOUBLE * count(*) / count(DISTINCT rater) AS lam FROM m),
h0 AS (SELECT DISTINCT rater, 0::DOUBLE AS theta FROM m)"""]
    for k in range(1, steps + 1):
        out.append(f"""h{k} AS MATERIALIZED (
  SELECT rater, any_value(theta) + (sum(y - p) - any_value(lam) * any_value(theta))
    / (sum(p * (1 - p)) + any_value(lam)) AS theta
  FROM (SELECT rater, theta, y, {sig_sql('theta - b')} AS p FROM m JOIN h{k - 1} USING (rater)), hz
  GROUP BY 1)""")
    out.append(f"th AS (SELECT * FROM h{steps})")
    return ",\n".join(out)


FROZEN = f"""WITH {PANEL}, {RATE},
m AS MATERIALIZED (SELECT rater, y, b FROM panel JOIN rate_score USING (item)), {frozen_sql()}"""


@register("c3_fit_theta", f"{FROZEN} SELECT rater, {rsql('theta')} AS theta FROM th")
def c3(spark, sf):
    cells = panel(spark, sf)
    return ability.fit_theta(cells, rate_score(cells)).select("rater", rd("theta").alias("theta"))


@register("c7_uncentred", f"{FROZEN} SELECT rater, {rsql('theta')} AS theta FROM th")
def c7(spark, sf):
    cells = panel(spark, sf)
    return C.uncentred(ability.fit_theta(cells, rate_score(cells))).select(
        "rater", rd("theta").alias("theta"))


@register("c8_calibrate_panel", f"""WITH {PANEL},
cc AS MATERIALIZED (SELECT 'all' AS fit_id, item, rater, y FROM panel
  WHERE rater IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)),
fi AS MATERIALIZED (SELECT DISTINCT fit_id, item FROM cc),
fr AS MATERIALIZED (SELECT DISTINCT fit_id, rater FROM cc),
{sweeps_sql('1pl')} SELECT item, {rsql('b - m')} AS b FROM iz JOIN mz USING (fit_id)""")
def c8(spark, sf):
    mask = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("rater"))
    fit = C.calibrate_panel(panel(spark, sf), None, mask, model="1pl", tol=TOL, max_sweeps=MOST_SWEEPS)
    return C.center_b(C.converged(fit, TOL)).select("item", rd("b").alias("b"))


@register("c9_calibrate_failures", f"{FIT1} SELECT rater, {rsql('theta - m')} AS theta FROM rz JOIN mz USING (fit_id)")
def c9(spark, sf):
    raters, _ = C.calibrate_failures(as_failure(panel(spark, sf)), tol=TOL, max_sweeps=MOST_SWEEPS)
    return raters.select("rater", rd("theta").alias("theta"))


@register("c10_reference_difficulty", f"{FIT1} SELECT item, {rsql('b - m')} AS b FROM iz JOIN mz USING (fit_id)")
def c10(spark, sf):
    return C.reference_difficulty(panel(spark, sf), tol=TOL, max_sweeps=MOST_SWEEPS).select(
        "item", rd("b").alias("b"))


_SD = f"""sd AS (SELECT item, 1 / sqrt(sum(a * a * p * (1 - p)) + 0.01::DOUBLE) AS s FROM (
  SELECT c.item, exp(loga) AS a, {sig_sql('exp(loga) * (theta - b)')} AS p FROM cc c
  JOIN iz USING (fit_id, item) JOIN rz USING (fit_id, rater)) GROUP BY 1)"""


@register("c11_difficulty_sd", f"{FIT2}, {_SD} SELECT item, {rsql('s')} AS s FROM sd")
def c11(spark, sf):
    return C.difficulty_sd(panel(spark, sf), _fit(spark, sf, "2pl")).select(
        "item", rd("s").alias("s"))


@register("c12_calibrated_bank", f"""{FIT2}, {_SD}
SELECT item, {rsql('b - m')} AS b, {rsql('exp(loga)')} AS a, {rsql('s')} AS s
FROM iz JOIN mz USING (fit_id) JOIN sd USING (item)""")
def c12(spark, sf):
    bank = C.calibrated_bank(panel(spark, sf), tol=TOL, max_sweeps=MOST_SWEEPS)
    return bank.select("item", *[rd(c).alias(c) for c in ("b", "a", "s")])


def map_sql(cells: str, tag: str, steps: int = 15) -> str:
    out = [f"{tag}0 AS (SELECT DISTINCT rater, 0::DOUBLE AS t FROM {cells})"]
    for k in range(1, steps + 1):
        out.append(f"""{tag}{k} AS MATERIALIZED (
  SELECT rater, any_value(t) + (sum(a * (y - p)) - any_value(t)) / (sum(a * a * p * (1 - p)) + 1) AS t
  FROM (SELECT rater, t, a, y, {sig_sql('a * (t - b)')} AS p FROM {cells} JOIN {tag}{k - 1} USING (rater))
  GROUP BY 1)""")
    out.append(f"{tag}z AS (SELECT rater, greatest(least(t, 6.0), -6.0) AS theta FROM {tag}{steps})")
    return ",\n".join(out)


_LOGS = f"""WITH {PANEL}, {BANK},
full_log AS MATERIALIZED (SELECT rater, y, b, a FROM panel JOIN bank USING (item))"""


@register("c13_map_theta", f"{_LOGS}, {map_sql('full_log', 'm')} SELECT rater, {rsql('theta')} AS theta FROM mz")
def c13(spark, sf):
    return ability.map_theta(panel(spark, sf), plain_bank(spark, sf), it=50).select(
        "rater", rd("theta").alias("theta"))


@register("c14_theta_se", f"""{_LOGS}, {map_sql('full_log', 'm')}
SELECT rater, {rsql('1 / sqrt(sum(a * a * p * (1 - p)) + 1)')} AS se FROM (
  SELECT rater, a, {sig_sql('a * (theta - b)')} AS p FROM full_log JOIN mz USING (rater)) GROUP BY 1""")
def c14(spark, sf):
    cells, bank = panel(spark, sf), plain_bank(spark, sf)
    thetas = ability.map_theta(cells, bank, it=50)
    return ability.theta_se(cells, bank, thetas).select("rater", rd("se").alias("se"))


_EARLY = """early AS (SELECT l_partkey AS item, l_suppkey AS rater,
  max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::INTEGER AS y
  FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2)"""


def _early(spark, sf):
    """What is known before a date: the log so far of every rater."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where(
        "l_shipdate < TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    return lines.groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("rater")).agg(
        F.max((F.col("l_linestatus") == "O").cast("int")).alias("y"))


@register("m20_theta_error", f"""{_LOGS}, {_EARLY},
early_log AS MATERIALIZED (SELECT rater, y, b, a FROM early JOIN bank USING (item)),
{map_sql('early_log', 'e')}, {map_sql('full_log', 'm')}
SELECT rater, {rsql('abs(ez.theta - mz.theta)')} AS abs_err FROM ez JOIN mz USING (rater)""")
def m20(spark, sf):
    return ability.theta_error(_early(spark, sf), panel(spark, sf), plain_bank(spark, sf),
                               it=50).select("rater", rd("abs_err").alias("abs_err"))


# --- folds ------------------------------------------------------------------------

@register("e1_loto_folds", f"""WITH {PANEL}, {TYPES},
t AS (SELECT item_type AS fold, count(DISTINCT types.item) AS test_items, count(rater) AS test_cells
      FROM types LEFT JOIN panel USING (item) GROUP BY 1)
SELECT fold, test_items, test_cells, (sum(test_items) OVER () - test_items)::BIGINT AS train_items,
  (sum(test_cells) OVER () - test_cells)::BIGINT AS train_cells FROM t""")
def e1(spark, sf):
    return folds.loto_folds(panel(spark, sf), types(spark, sf))


def fold_sql(src: str, tag: str, steps: int = 10) -> str:
    """<tag>z (rater, item_type, theta) for cells src (item_type, rater, y, b)."""
    out = [f"""{tag}l AS MATERIALIZED (SELECT item_type AS fold, 2 * 0.01::DOUBLE *
  ((SELECT count(*) FROM {src}) - count(*)) / (SELECT count(DISTINCT rater) FROM {src}) AS lam
  FROM {src} GROUP BY 1),
{tag}0 AS (SELECT DISTINCT rater, item_type AS fold, 0::DOUBLE AS theta FROM {src})"""]
    for k in range(1, steps + 1):
        out.append(f"""{tag}{k} AS MATERIALIZED (
  SELECT rater, fold, any_value(theta) + (sum(y - p) - any_value(lam) * any_value(theta))
    / (sum(p * (1 - p)) + any_value(lam)) AS theta FROM (
    SELECT s.rater, s.fold, theta, y, {sig_sql('theta - b')} AS p
    FROM {tag}{k - 1} s JOIN {src} c ON c.rater = s.rater AND c.item_type <> s.fold)
  JOIN {tag}l USING (fold) GROUP BY 1, 2)""")
    out.append(f"{tag}z AS (SELECT rater, fold AS item_type, theta FROM {tag}{steps})")
    return ",\n".join(out)


def _src(name: str, b: str, join: str = "") -> str:
    return f"""{name} AS MATERIALIZED (SELECT item, item_type, rater, y, {b} AS b
  FROM panel JOIN types USING (item) {join})"""


_MODEL = _src("cm", "b", "JOIN size_score USING (item)")
_ORACLE = _src("co", "b", "JOIN rate_score USING (item)")
_NULL = _src("cn", "0::DOUBLE")


def _cells_sql(src: str, tag: str) -> str:
    return (f"SELECT item, item_type, rater, y, {sig_sql('theta - b')} AS p FROM {src} "
            f"JOIN {tag}z USING (rater, item_type)")


@register("e2_fold_theta", f"""WITH {PANEL}, {TYPES}, {SIZE}, {_MODEL}, {fold_sql('cm', 'f')}
SELECT rater, item_type, {rsql('theta')} AS theta FROM fz""")
def e2(spark, sf):
    return ability.fold_theta(panel(spark, sf), types(spark, sf), size_score(spark, sf)).select(
        "rater", "item_type", rd("theta").alias("theta"))


@register("e3_fold_predictions", f"""WITH {PANEL}, {TYPES}, {SIZE}, {_MODEL}, {fold_sql('cm', 'f')}
SELECT item, rater, y, {rsql('p')} AS p FROM ({_cells_sql('cm', 'f')})""")
def e3(spark, sf):
    return folds.fold_predictions(panel(spark, sf), types(spark, sf), size_score(spark, sf)).select(
        "item", "rater", "y", rd("p").alias("p"))


@register("e4_null_predictions", f"""WITH {PANEL}, {TYPES}, {_NULL}, {fold_sql('cn', 'f')}
SELECT item, rater, y, {rsql('p')} AS p FROM ({_cells_sql('cn', 'f')})""")
def e4(spark, sf):
    return folds.null_predictions(panel(spark, sf), types(spark, sf)).select(
        "item", "rater", "y", rd("p").alias("p"))


_ORACLE_CELLS = f"""WITH {PANEL}, {TYPES}, {RATE}, {_ORACLE}, {fold_sql('co', 'f')},
oc AS MATERIALIZED ({_cells_sql('co', 'f')})"""


@register("e5_oracle_predictions", f"{_ORACLE_CELLS} SELECT item, rater, y, {rsql('p')} AS p FROM oc")
def e5(spark, sf):
    cells = cut_lineage(panel(spark, sf), "panel")
    return folds.oracle_predictions(cells, types(spark, sf), rate_score(cells)).select(
        "item", "rater", "y", rd("p").alias("p"))


_MAE = """SELECT avg(abs(p - y)) AS mae, count(*) AS n FROM (
  SELECT item, avg(p) AS p, avg(y) AS y FROM {} GROUP BY 1)"""
_NLL = """SELECT -avg(y * ln(greatest(least(p, 1 - 1e-9), 1e-9))
  + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-9), 1e-9))) AS nll FROM {}"""


@register("m5_scene_mae", f"""{_ORACLE_CELLS}
SELECT {rsql('mae')} AS scene_mae, n AS n_items FROM ({_MAE.format('oc')})""")
def m5(spark, sf):
    cells = cut_lineage(panel(spark, sf), "panel")
    scored = folds.oracle_predictions(cells, types(spark, sf), rate_score(cells))
    return metrics.scene_mae(scored).select(rd("scene_mae").alias("scene_mae"), "n_items")


@register("m6_nll", f"{_ORACLE_CELLS} SELECT {rsql('nll')} AS nll FROM ({_NLL.format('oc')})")
def m6(spark, sf):
    cells = cut_lineage(panel(spark, sf), "panel")
    scored = folds.oracle_predictions(cells, types(spark, sf), rate_score(cells))
    return metrics.nll(scored).select(rd("nll").alias("nll"))


_REPORT = f"""WITH {PANEL}, {TYPES}, {SIZE}, {RATE}, {_MODEL}, {_ORACLE}, {_NULL},
{fold_sql('cm', 'fm')}, {fold_sql('co', 'fo')}, {fold_sql('cn', 'fn')},
pm AS MATERIALIZED ({_cells_sql('cm', 'fm')}), po AS MATERIALIZED ({_cells_sql('co', 'fo')}),
pn AS MATERIALIZED ({_cells_sql('cn', 'fn')}),
am AS ({auroc_sql('(SELECT y, round(p, 9) AS p FROM pm)')}),
an AS ({auroc_sql('(SELECT y, round(p, 9) AS p FROM pn)')}),
em AS ({_MAE.format('pm')}), eo AS ({_MAE.format('po')}), en AS ({_MAE.format('pn')}),
lm AS ({_NLL.format('pm')}), ln_ AS ({_NLL.format('pn')}),
v AS (SELECT item, round(s.b, 8) AS b, round(r.b, 8) AS b_ref, round((1 - avg(y))::DOUBLE, 9) AS f
      FROM panel JOIN size_score s USING (item) JOIN rate_score r USING (item) GROUP BY 1, 2, 3),
k AS (SELECT {rank_sql('b')} AS rb, {rank_sql('b_ref')} AS rr, {rank_sql('f')} AS rf FROM v),
rho AS (SELECT corr(rb, rf) AS rho_scene, corr(rb, rr) AS rho_ref FROM k),
all_ AS (SELECT rho_scene, rho_ref, am.auroc AS auroc, an.auroc AS auroc0, em.mae AS mae,
  en.mae AS mae0, eo.mae AS maeo, lm.nll AS nll, ln_.nll AS nll0, em.n AS n_items
  FROM rho, am, an, em, eo, en, lm, ln_)"""

_REPORT_COLS = {
    "rho_scene": "rho_scene", "auroc": "auroc", "auroc_theta_only": "auroc0",
    "d_auroc": "auroc - auroc0", "scene_mae": "mae", "scene_mae_theta_only": "mae0",
    "scene_mae_oracle": "maeo",
    "oracle_gap_recovery": "CASE WHEN mae0 > maeo THEN (mae0 - mae) / (mae0 - maeo) END",
    "d_nll": "nll0 - nll", "rho_ref": "rho_ref"}


def _report_sql(cols, digits=5):
    return f"{_REPORT} SELECT " + ", ".join(
        f"{rsql(_REPORT_COLS[c], digits)} AS {c}" for c in cols) + ", n_items FROM all_"


@register("m9_evaluate", _report_sql(list(_REPORT_COLS)))
def m9(spark, sf):
    cells = cut_lineage(panel(spark, sf), "panel")
    report = evaluate(cells, types(spark, sf), size_score(spark, sf), rate_score(cells))
    return report.select(*[rd(c, 5).alias(c) for c in _REPORT_COLS], "n_items")


_M7 = ["oracle_gap_recovery", "scene_mae"]
_M8 = ["d_auroc", "d_nll"]


@register("m7_gap_recovery", _report_sql(_M7))
def m7(spark, sf):
    return m9(spark, sf).select(*_M7, "n_items")


@register("m8_deltas", _report_sql(_M8))
def m8(spark, sf):
    return m9(spark, sf).select(*_M8, "n_items")


_RUN_SCORES = {"size": "(p_size - 25.5) / 14.5::DOUBLE", "price": "(p_retailprice - 1400) / 300.0::DOUBLE",
               "both": "(p_size - 25.5) / 14.5::DOUBLE - (p_retailprice - 1400) / 300.0::DOUBLE"}
_SPREAD = ("rho_scene", "auroc", "scene_mae", "d_nll")


def _run_reports_sql() -> str:
    parts = []
    for run, score in _RUN_SCORES.items():
        report = _REPORT.replace(SIZE, f"size_score AS (SELECT p_partkey AS item, {score} AS b FROM part)")
        cols = ", ".join(f"({_REPORT_COLS[c]})::DOUBLE AS {c}" for c in _SPREAD)
        parts.append(f"SELECT '{run}' AS run, * FROM ({report} SELECT {cols} FROM all_)")
    return "\nUNION ALL ".join(parts)


@register("m10_run_spread", f"""WITH reports AS MATERIALIZED ({_run_reports_sql()}),
rep AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS v FROM reports" for c in _SPREAD)})
SELECT metric, {rsql('avg(v)', 5)} AS mean, {rsql('stddev_samp(v)', 5)} AS sd, count(v) AS n_runs FROM rep GROUP BY 1""")
def m10(spark, sf):
    """Mean and SD over three runs of the metrics of their evaluation reports."""
    cells, kinds = cut_lineage(panel(spark, sf), "panel"), types(spark, sf)
    part = spark.read.parquet(f"{sf}/part.parquet")
    size, price = (F.col("p_size") - 25.5) / 14.5, (F.col("p_retailprice") - 1400) / 300.0
    scores = F.explode(F.array(*[F.struct(F.lit(run).alias("run"), score.cast("double").alias("b")) for run, score in (
        ("size", size), ("price", price), ("both", size - price))])).alias("v")
    runs = part.select(F.col("p_partkey").alias("item"), scores).select("v.run", "item", "v.b")
    reports = evaluate_runs(cells, kinds, runs, rate_score(cells)).select("run", *_SPREAD)
    return run_spread(cut_lineage(reports, "reports"), _SPREAD).select(
        "metric", rd("mean", 5).alias("mean"), rd("sd", 5).alias("sd"), "n_runs")


# --- reliability ------------------------------------------------------------------

N_SPLITS = 20
_SPLITS = f"""{PANEL},
sp AS (SELECT split, rater, CASE WHEN row_number() OVER (PARTITION BY split ORDER BY
    {hash_int_sql("'0'", "split", "rater")}) - 1 < (count(*) OVER (PARTITION BY split)) // 2
    THEN 0 ELSE 1 END AS half
  FROM (SELECT DISTINCT rater FROM panel), (SELECT unnest(range({N_SPLITS})) AS split))"""
_HALVES = f"""WITH {_SPLITS},
fr AS MATERIALIZED (SELECT split * 2 + half AS fit_id, rater FROM sp),
fi AS MATERIALIZED (SELECT DISTINCT fit_id, item FROM (SELECT DISTINCT fit_id FROM fr), (SELECT DISTINCT item FROM panel)),
cc AS MATERIALIZED (SELECT fit_id, item, rater, y FROM panel JOIN fr USING (rater)),
{sweeps_sql('1pl', 12)},
cb AS (SELECT fit_id // 2 AS split, fit_id % 2 AS half, item, round(b - m, 8) AS b FROM iz JOIN mz USING (fit_id)),
pb AS (SELECT split, item, max(CASE WHEN half = 0 THEN b END) AS b0, max(CASE WHEN half = 1 THEN b END) AS b1 FROM cb GROUP BY 1, 2),
rk AS (SELECT split, {rank_sql('b0', 'split')} AS r0, {rank_sql('b1', 'split')} AS r1 FROM pb),
sh AS (SELECT split, corr(r0, r1) AS rho FROM rk GROUP BY 1)"""


def _splits(spark, sf):
    return split_table(panel(spark, sf).select("rater").distinct(), N_SPLITS, 0)


@register("m11_split_half", f"{_HALVES} SELECT split, {rsql('rho', 4)} AS rho FROM sh")
def m11(spark, sf):
    return split_half(panel(spark, sf), _splits(spark, sf), tol=TOL_MANY, max_sweeps=MOST_SWEEPS).select(
        "split", rd("rho", 4).alias("rho"))


@register("m12_noise_ceiling", f"""{_HALVES}, r AS (SELECT avg(rho) AS r, count(*) AS n FROM sh)
SELECT {rsql('r', 4)} AS split_half, {rsql('2 * r / (1 + r)', 4)} AS reliability,
  {rsql('sqrt(2 * r / (1 + r))', 4)} AS ceiling, n AS n_splits FROM r""")
def m12(spark, sf):
    return noise_ceiling(panel(spark, sf), _splits(spark, sf), tol=TOL_MANY, max_sweeps=MOST_SWEEPS).select(
        rd("split_half", 4).alias("split_half"), rd("reliability", 4).alias("reliability"),
        rd("ceiling", 4).alias("ceiling"), "n_splits")


@register("c15_calibrate_many", f"""WITH {PANEL}, {TYPES},
fi AS MATERIALIZED (SELECT f.item_type AS fit_id, t.item FROM (SELECT DISTINCT item_type FROM types) f
  JOIN types t ON t.item_type <> f.item_type WHERE t.item IN (SELECT item FROM panel)),
fr AS MATERIALIZED (SELECT DISTINCT item_type AS fit_id, rater FROM types, (SELECT DISTINCT rater FROM panel)),
cc AS MATERIALIZED (SELECT fit_id, item, rater, y FROM panel JOIN fi USING (item)),
{sweeps_sql('1pl', 10)} SELECT fit_id AS fold, rater, {rsql('theta - m', 4)} AS theta FROM rz JOIN mz USING (fit_id)""")
def c15(spark, sf):
    return fold_abilities(panel(spark, sf), types(spark, sf), tol=1e-8, max_sweeps=20).select(
        "fold", "rater", rd("theta", 4).alias("theta"))


# --- resampling -------------------------------------------------------------------

REPS = resample.REPLICATES
_BOOT = f"""{PANEL},
bi AS MATERIALIZED (SELECT item, p_brand AS k, p_size::DOUBLE AS x1, p_retailprice AS x2,
  round((1 - avg(y))::DOUBLE, 9) AS y FROM panel JOIN part ON p_partkey = item GROUP BY 1, 2, 3, 4),
cl AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS c FROM (SELECT DISTINCT k FROM bi)),
nk AS (SELECT count(*) AS n FROM cl),
wt AS MATERIALIZED (SELECT rep, c, count(*) AS w FROM (
  SELECT rep, {hash_int_sql("'0'", "rep", "slot")} % n AS c
  FROM nk, (SELECT unnest(range({REPS})) AS rep), LATERAL (SELECT unnest(range(n)) AS slot)) GROUP BY 1, 2)"""
_BOOT_RHO = f"""bd AS MATERIALIZED (SELECT rep, w, x1, x2, y FROM bi JOIN cl USING (k) JOIN wt USING (c)),
br AS (SELECT rep, w,
  {{}}),
bm AS (SELECT rep, sum(w * r1) / sum(w) AS m1, sum(w * r2) / sum(w) AS m2, sum(w * ry) / sum(w) AS my FROM br GROUP BY 1),
bs AS (SELECT rep, sum(w * (r1 - m1) * (ry - my)) / sqrt(sum(w * (r1 - m1) ** 2) * sum(w * (ry - my) ** 2)) AS size,
  sum(w * (r2 - m2) * (ry - my)) / sqrt(sum(w * (r2 - m2) ** 2) * sum(w * (ry - my) ** 2)) AS price
  FROM br JOIN bm USING (rep) GROUP BY 1)"""


def _wrank(v, name):
    return (f"sum(w) OVER (PARTITION BY rep ORDER BY {v} RANGE UNBOUNDED PRECEDING) "
            f"- (sum(w) OVER (PARTITION BY rep, {v}) - 1) / 2.0::DOUBLE AS {name}")


_BOOT_ALL = f"WITH {_BOOT}, " + _BOOT_RHO.format(
    ", ".join((_wrank("x1", "r1"), _wrank("x2", "r2"), _wrank("y", "ry"))) + " FROM bd")


def _boot(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("item"), "p_brand", F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"))
    rates = failure_rate(panel(spark, sf)).select("item", F.round("fail_rate", 9).alias("y"))
    return resample.bootstrap_spearman(rates.join(part, "item"), "p_brand", "y",
                                       ["size", "price"], REPS, 0)


@register("m13_cluster_bootstrap", f"""{_BOOT_ALL},
u AS (SELECT 'size' AS statistic, size AS v FROM bs UNION ALL SELECT 'price', price FROM bs)
SELECT statistic, {rsql('quantile_cont(v, 0.025)')} AS lo, {rsql('quantile_cont(v, 0.975)')} AS hi,
  {rsql('avg(v)')} AS mean FROM u GROUP BY 1""")
def m13(spark, sf):
    out = resample.percentile_interval(_boot(spark, sf), ["size", "price"])
    return out.select("statistic", *[rd(c).alias(c) for c in ("lo", "hi", "mean")])


@register("m14_paired_bootstrap", f"""{_BOOT_ALL}, d AS (SELECT size - price AS d FROM bs)
SELECT {rsql('quantile_cont(d, 0.025)')} AS lo, {rsql('quantile_cont(d, 0.975)')} AS hi,
  {rsql('avg(d)')} AS mean, {rsql('avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS exceedance,
  count(*) AS n_reps FROM d""")
def m14(spark, sf):
    out = resample.paired_difference(_boot(spark, sf), "size", "price")
    return out.select(*[rd(c).alias(c) for c in ("lo", "hi", "mean", "exceedance")], "n_reps")


@register("m13_bootstrap_mean", f"""WITH {_BOOT},
s AS (SELECT c, count(*) AS n, sum(y) AS s FROM bi JOIN cl USING (k) GROUP BY 1)
SELECT rep, {rsql('sum(w * s) / sum(w * n)')} AS y FROM wt JOIN s USING (c) GROUP BY 1""")
def m13_mean(spark, sf):
    rates = failure_rate(panel(spark, sf)).select("item", F.round("fail_rate", 9).alias("y"))
    df = rates.join(types(spark, sf), "item")
    return resample.bootstrap_mean(df, "item_type", ["y"], REPS, 0).select("rep", rd("y").alias("y"))


@register("m16_loro_folds", f"""WITH {PANEL},
t AS (SELECT rater AS fold, count(*) AS test_cells, sum(y) AS p FROM panel GROUP BY 1)
SELECT fold, test_cells, (sum(test_cells) OVER () - test_cells)::BIGINT AS train_cells,
  {rsql('(sum(p) OVER () - p)::DOUBLE / (sum(test_cells) OVER () - test_cells)')} AS train_pass_rate FROM t""")
def m16(spark, sf):
    return folds.loro_folds(panel(spark, sf)).select(
        "fold", "test_cells", "train_cells", rd("train_pass_rate").alias("train_pass_rate"))


_FULL = f"""ucc AS MATERIALIZED (SELECT 'all' AS fit_id, item, rater, y FROM panel),
ufi AS MATERIALIZED (SELECT DISTINCT fit_id, item FROM ucc),
ufr AS MATERIALIZED (SELECT DISTINCT fit_id, rater FROM ucc),
{sweeps_sql('1pl', 12, 'u')}"""
_WARM = ("(SELECT rater, theta FROM urz)", "(SELECT item, b, loga FROM uiz)")
_LORO = f"""WITH {PANEL}, {_EARLY}, {_FULL},
fr AS MATERIALIZED (SELECT o.rater AS fit_id, r.rater FROM (SELECT DISTINCT rater FROM panel) o,
  (SELECT DISTINCT rater FROM panel) r WHERE o.rater <> r.rater),
fi AS MATERIALIZED (SELECT rater AS fit_id, item FROM (SELECT DISTINCT rater FROM panel), (SELECT DISTINCT item FROM panel)),
cc AS MATERIALIZED (SELECT fit_id, item, rater, y FROM panel JOIN fr USING (rater)),
{sweeps_sql('1pl', 7, '', _WARM)},
hb AS MATERIALIZED (SELECT p.rater, p.item, p.y, b - m AS b, e.y AS seen FROM panel p
  JOIN iz ON iz.fit_id = p.rater AND iz.item = p.item JOIN mz ON mz.fit_id = p.rater
  LEFT JOIN early e ON e.rater = p.rater AND e.item = p.item),
hl AS MATERIALIZED (SELECT rater, seen AS y, b, 1.0::DOUBLE AS a FROM hb WHERE seen IS NOT NULL),
{map_sql('hl', 'q')},
au AS ({auroc_sql('(SELECT rater, y, round(-b, 8) AS p FROM hb)', 'rater')}),
sc AS (SELECT rater, count(*) AS test_cells, count(seen) AS n_administered, any_value(coalesce(theta, 0)) AS theta,
  avg(coalesce(seen, {sig_sql('coalesce(theta, 0) - b')})) AS pred_sr, avg(y) AS true_sr
  FROM hb LEFT JOIN qz USING (rater) GROUP BY 1),
so AS (SELECT sc.*, auroc, abs(pred_sr - true_sr) AS abs_err FROM sc LEFT JOIN au USING (rater))"""
_SCORES = ("auroc", "theta", "pred_sr", "true_sr", "abs_err")
_MACRO = ("auroc", "auroc_se", "abs_err", "abs_err_se")
_MACRO_SQL = f"""{rsql('avg(auroc)', 5)} AS auroc, {rsql('stddev_samp(auroc) / sqrt(count(auroc))', 5)} AS auroc_se,
  {rsql('avg(abs_err)', 5)} AS abs_err, {rsql('stddev_samp(abs_err) / sqrt(count(abs_err))', 5)} AS abs_err_se,
  count(*) AS n_folds"""


def _left_out(spark, sf):
    return evaluate_left_out_raters(panel(spark, sf), _early(spark, sf), tol=TOL_MANY, max_sweeps=MOST_SWEEPS)


@register("m16_left_out_raters", f"""{_LORO}
SELECT rater, test_cells, n_administered, {", ".join(f"{rsql(c, 5)} AS {c}" for c in _SCORES)} FROM so""")
def m16_scores(spark, sf):
    return _left_out(spark, sf).select("rater", "test_cells", "n_administered", *[rd(c, 5).alias(c) for c in _SCORES])


@register("m16_left_out_macro", f"{_LORO} SELECT {_MACRO_SQL} FROM so")
def m16_macro(spark, sf):
    return macro(_left_out(spark, sf)).select(*[rd(c, 5).alias(c) for c in _MACRO], "n_folds")


_UPS = f"""us AS (SELECT seed, item_type, row_number() OVER (PARTITION BY seed ORDER BY
    {hash_int_sql("seed", "item_type")}) - 1 < ceil(count(*) OVER (PARTITION BY seed) / 2.0) AS held_out
  FROM (SELECT DISTINCT item_type FROM types), (SELECT unnest([0, 1, 2]) AS seed))"""


@register("m17_ups_splits", f"""WITH {PANEL}, {TYPES}, {_UPS},
c AS (SELECT seed, rater, count(*) FILTER (held_out) AS test_cells, count(*) FILTER (NOT held_out) AS bank_cells
  FROM panel JOIN types USING (item) JOIN us USING (item_type) GROUP BY 1, 2)
SELECT seed, rater, test_cells, bank_cells,
  (sum(bank_cells) OVER (PARTITION BY seed) - bank_cells)::BIGINT AS train_cells FROM c""")
def m17(spark, sf):
    kinds = types(spark, sf)
    return folds.ups_cells(panel(spark, sf), kinds, folds.ups_splits(kinds, [0, 1, 2]))


_TWO_WAY_STEPS = 12
_TWO_WAY = f"""WITH {PANEL}, {TYPES}, {_UPS}, {_FULL},
fits AS MATERIALIZED (SELECT seed, rater AS kept_out, seed * 10000000 + rater AS fit_id
  FROM (SELECT DISTINCT seed FROM us), (SELECT DISTINCT rater FROM panel)),
open AS MATERIALIZED (SELECT seed, item, held_out FROM (SELECT DISTINCT item FROM panel) JOIN types USING (item) JOIN us USING (item_type)),
fr AS MATERIALIZED (SELECT fit_id, r.rater FROM fits, (SELECT DISTINCT rater FROM panel) r WHERE r.rater <> kept_out),
fi AS MATERIALIZED (SELECT fit_id, item FROM fits JOIN open USING (seed) WHERE NOT held_out),
cc AS MATERIALIZED (SELECT fit_id, p.item, p.rater, p.y FROM fits JOIN open USING (seed) JOIN panel p USING (item)
  WHERE NOT held_out AND p.rater <> kept_out),
{sweeps_sql('1pl', 9, '', _WARM)},
xz AS MATERIALIZED (SELECT p_partkey AS item, (p_size - avg(p_size) OVER ()) / (stddev_pop(p_size) OVER () + 1e-9) AS x FROM part),
cx AS MATERIALIZED (SELECT cc.fit_id, 1.0::DOUBLE - y AS f, x, theta FROM cc JOIN xz USING (item) JOIN rz USING (fit_id, rater)),
w0 AS (SELECT fit_id, 0::DOUBLE AS w1, 0::DOUBLE AS w0 FROM fits),
""" + ",\n".join(f"""w{k} AS MATERIALIZED (
  SELECT fit_id, w1 + (h00 * g1 - h01 * g0) / (h11 * h00 - h01 * h01) AS w1,
         w0 + (h11 * g0 - h01 * g1) / (h11 * h00 - h01 * h01) AS w0 FROM (
    SELECT fit_id, any_value(w1) AS w1, any_value(w0) AS w0, sum((f - p) * x) AS g1, sum(f - p) AS g0,
      sum(p * (1 - p) * x * x) AS h11, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p)) AS h00
    FROM (SELECT fit_id, w1, w0, f, x, {sig_sql('w1 * x + w0 - theta')} AS p FROM cx JOIN w{k - 1} USING (fit_id))
    GROUP BY 1))""" for k in range(1, _TWO_WAY_STEPS + 1)) + f""",
own AS MATERIALIZED (SELECT fit_id AS rater, seed, kept_out, y, held_out, coalesce(b, w1 * x + w0) - m AS b
  FROM fits JOIN panel p ON p.rater = kept_out JOIN open USING (seed, item) JOIN xz USING (item)
  JOIN w{_TWO_WAY_STEPS} USING (fit_id) JOIN mz USING (fit_id) LEFT JOIN iz USING (fit_id, item)),
hl AS MATERIALIZED (SELECT rater, y, b, 1.0::DOUBLE AS a FROM own WHERE NOT held_out),
{map_sql('hl', 'q')},
hn AS (SELECT rater, count(*) AS n_calibrated FROM hl GROUP BY 1),
au AS ({auroc_sql('(SELECT rater, y, round(-b, 8) AS p FROM own WHERE held_out)', 'rater')}),
sc AS (SELECT rater, seed, kept_out, count(*) AS test_cells, any_value(coalesce(n_calibrated, 0)) AS n_calibrated,
  any_value(coalesce(theta, 0)) AS theta, avg({sig_sql('coalesce(theta, 0) - b')}) AS pred_sr, avg(y) AS true_sr
  FROM own LEFT JOIN qz USING (rater) LEFT JOIN hn USING (rater) WHERE held_out GROUP BY ALL),
so AS (SELECT seed, kept_out AS rater, test_cells, n_calibrated, theta, pred_sr, true_sr, auroc,
  abs(pred_sr - true_sr) AS abs_err FROM sc LEFT JOIN au USING (rater))"""


def _two_way(spark, sf):
    feats = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("p_size"))
    return evaluate_two_way(panel(spark, sf), types(spark, sf), feats, ["p_size"], [0, 1, 2],
                            tol=TOL_MANY, max_sweeps=MOST_SWEEPS)


@register("m17_two_way_raters", f"""{_TWO_WAY}
SELECT seed, rater, test_cells, n_calibrated, {", ".join(f"{rsql(c, 5)} AS {c}" for c in _SCORES)} FROM so""")
def m17_scores(spark, sf):
    return _two_way(spark, sf).select("seed", "rater", "test_cells", "n_calibrated",
                                      *[rd(c, 5).alias(c) for c in _SCORES])


@register("m17_two_way_macro", f"{_TWO_WAY} SELECT seed, {_MACRO_SQL} FROM so GROUP BY 1")
def m17_macro(spark, sf):
    return macro(_two_way(spark, sf), ["seed"]).select("seed", *[rd(c, 5).alias(c) for c in _MACRO], "n_folds")


# --- success rate metrics -----------------------------------------------------------

_GRID = f"""g AS (SELECT rater, greatest(least(round((ln((sum(y) + 0.5)::DOUBLE / (sum(1 - y) + 0.5)::DOUBLE)
  - ({GRID_LOW})) / {GRID_STEP}), {GRID_SIZE - 1}), 0) * {GRID_STEP}::DOUBLE + ({GRID_LOW}) AS theta,
  avg(y) AS true_sr FROM panel GROUP BY 1),
pi AS (SELECT rater, avg(CASE WHEN e.y IS NOT NULL THEN e.y ELSE {sig_sql('a * (theta - b)')} END) AS pred_sr,
  count(e.y) AS n_administered, count(*) AS n_bank
  FROM g CROSS JOIN bank LEFT JOIN early e USING (rater, item) GROUP BY 1)"""


def _p_irt(spark, sf):
    cells, bank = panel(spark, sf), plain_bank(spark, sf)
    s, f = F.sum("y") + 0.5, F.sum(1 - F.col("y")) + 0.5
    g = F.greatest(F.least(F.round((F.log(s / f) - GRID_LOW) / GRID_STEP),
                           F.lit(float(GRID_SIZE - 1))), F.lit(0.0)).cast("int")
    at = cells.groupBy("rater").agg(g.alias("g"), F.avg("y").alias("true_sr"))
    curves = item_curves(bank, marginalise=False)
    return metrics.p_irt_on_grid(_early(spark, sf), curves, at), at


@register("m18_p_irt", f"""WITH {PANEL}, {BANK}, {_EARLY}, {_GRID}
SELECT rater, {rsql('pred_sr')} AS pred_sr, n_administered, n_bank FROM pi""")
def m18(spark, sf):
    return _p_irt(spark, sf)[0].select("rater", rd("pred_sr").alias("pred_sr"), "n_administered",
                                       "n_bank")


@register("m18_p_irt_error", f"""WITH {PANEL}, {BANK}, {_EARLY}, {_GRID}
SELECT {rsql('avg(abs(pred_sr - true_sr))')} AS mae,
  {rsql('stddev_samp(abs(pred_sr - true_sr)) / sqrt(count(*))')} AS mae_se, count(*) AS n_raters
FROM pi JOIN g USING (rater)""")
def m18_error(spark, sf):
    est, truth = _p_irt(spark, sf)
    return metrics.p_irt_error(est, truth).select(rd("mae").alias("mae"),
                                                  rd("mae_se").alias("mae_se"), "n_raters")


# --- regression on features ---------------------------------------------------------

def _logistic_rate(spark, sf):
    """(fold, rater, theta): log-odds of each rater's cells outside the fold."""
    typed = panel(spark, sf).join(types(spark, sf), "item")
    own = typed.groupBy("rater", "item_type").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    names = [r[0] for r in types(spark, sf).select("item_type").distinct().collect()]
    whole = own.groupBy("rater").agg(F.sum("s").alias("ws"), F.sum("n").alias("wn"))
    grid = whole.select("*", F.explode(F.array(*[F.lit(t) for t in names])).alias("item_type"))
    left = grid.join(own, ["rater", "item_type"], "left")
    s = F.col("ws") - F.coalesce("s", F.lit(0)) + 0.5
    n = F.col("wn") - F.coalesce("n", F.lit(0)) + 1.0
    return left.select(F.col("item_type").alias("fold"), "rater", F.log(s / (n - s)).alias("theta"))


def _irls_sql(steps: int = 8) -> str:
    out = [f"""own AS (SELECT rater, item_type, sum(y) AS s, count(*) AS n FROM panel JOIN types USING (item) GROUP BY 1, 2),
whole AS (SELECT rater, sum(s) AS ws, sum(n) AS wn FROM own GROUP BY 1),
ft AS MATERIALIZED (SELECT item_type AS fold, rater, ln((ws - coalesce(s, 0) + 0.5)::DOUBLE
  / (wn - coalesce(n, 0) + 1.0 - (ws - coalesce(s, 0) + 0.5))::DOUBLE) AS theta
  FROM whole CROSS JOIN (SELECT DISTINCT item_type FROM types) LEFT JOIN own USING (rater, item_type)),
xz AS MATERIALIZED (SELECT p_partkey AS item, (p_size - avg(p_size) OVER ()) / (stddev_pop(p_size) OVER () + 1e-9) AS x FROM part),
cx AS MATERIALIZED (SELECT item, item_type, rater, 1.0::DOUBLE - y AS f, x FROM panel JOIN types USING (item) JOIN xz USING (item)),
w0 AS (SELECT DISTINCT fold, 0::DOUBLE AS w1, 0::DOUBLE AS w0 FROM ft)"""]
    for k in range(1, steps + 1):
        out.append(f"""w{k} AS MATERIALIZED (
  SELECT fold, w1 + (h00 * g1 - h01 * g0) / (h11 * h00 - h01 * h01) AS w1,
         w0 + (h11 * g0 - h01 * g1) / (h11 * h00 - h01 * h01) AS w0 FROM (
    SELECT fold, any_value(w1) AS w1, any_value(w0) AS w0, sum((f - p) * x) AS g1, sum(f - p) AS g0,
      sum(p * (1 - p) * x * x) + 1e-9 AS h11, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p)) + 1e-9 AS h00
    FROM (SELECT fold, w1, w0, f, x, {sig_sql('w1 * x + w0 - theta')} AS p
          FROM cx JOIN ft USING (rater) JOIN w{k - 1} USING (fold) WHERE fold <> item_type) GROUP BY 1))""")
    return ",\n".join(out)


@register("t11_difficulty_regression", f"""WITH {PANEL}, {TYPES}, {_irls_sql()}
SELECT DISTINCT item, item_type, {rsql('w1 * x + w0')} AS b_tilde FROM cx JOIN w8 ON fold = item_type""")
def t11(spark, sf):
    typed = panel(spark, sf).join(types(spark, sf), "item")
    feats = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("p_size"))
    out, _ = difficulty_regression(typed, feats, ["p_size"], _logistic_rate(spark, sf))
    return out.select("item", "item_type", rd("b_tilde").alias("b_tilde"))
