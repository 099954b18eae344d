"""Sources, selections, reshapes and simple aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary_entropy, sig
from ..operators import panel as P
from ..operators.rank import dense_index, macro_auroc, auroc, spearman
from ..session import scratch_path
from ..sources import (bundle_runs, materialise, read_features, read_item_types, read_panel,
                       read_predictions, write_run)
from .base import (PANEL, RATE, SIZE, TYPES, auroc_sql, items, panel, rank_sql, raters, rate_score,
                   rd, register, rsql, sig_sql, size_score, types)


def _brand_cells(spark, sf):
    """Supplier x brand outcomes; pairs without a line are not observed."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    brand = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand")
    return (lines.join(brand, lines.l_partkey == brand.p_partkey)
            .groupBy(F.col("p_brand").alias("item"),
                     F.concat(F.lit("S"), F.col("l_suppkey")).alias("rater"))
            .agg((F.avg((F.col("l_linestatus") == "O").cast("double")) >= 0.5).cast("int")
                 .alias("y")))


BRAND_CELLS = """brand_cells AS (
  SELECT p_brand AS item, 'S' || l_suppkey AS rater,
         (avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) >= 0.5)::INTEGER AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@register("s1_read_panel", f"""WITH {BRAND_CELLS}
SELECT item, rater, y FROM brand_cells""")
def s1(spark, sf):
    wide = _brand_cells(spark, sf).groupBy("rater").pivot("item").agg(
        F.first(F.col("y").cast("double")))
    path = scratch_path(spark, "matrix")
    wide.withColumnRenamed("rater", "").write.option("header", True).csv(path)
    return read_panel(spark, path).cells


@register("s2_read_item_types", "SELECT p_partkey::VARCHAR AS item, p_brand AS item_type FROM part")
def s2(spark, sf):
    path = scratch_path(spark, "types")
    spark.read.parquet(f"{sf}/part.parquet").select(
        F.concat_ws(",", "p_partkey", F.concat(F.lit(" "), F.col("p_brand")), "p_type")
        .alias("value")).write.text(path)
    return read_item_types(spark, path)


@register("s3_read_features", f"""SELECT p_partkey::VARCHAR AS item, p_size::DOUBLE AS f0,
  {rsql('p_retailprice::FLOAT', 2)} AS f1 FROM part""")
def s3(spark, sf):
    path = scratch_path(spark, "features")
    spark.read.parquet(f"{sf}/part.parquet").select(
        F.concat(F.lit("route_"), F.col("p_partkey")).alias("name"),
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("stats")
    ).write.parquet(path)
    f = read_features(spark, path)
    return f.select("item", F.col("features")[0].cast("double").alias("f0"),
                    rd(F.col("features")[1], 2).alias("f1"))


def _runs(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    cells = panel(spark, sf)
    ref = rate_score(cells).select("item", F.round("b", 8).alias("reference"))
    base = types(spark, sf).join(ref, "item")
    by_size = part.select(F.col("p_partkey").alias("item"),
                          F.col("p_size").cast("double").alias("b_tilde"))
    by_price = part.select(F.col("p_partkey").alias("item"),
                           F.col("p_retailprice").alias("b_tilde"))
    return base.join(by_size, "item"), base.join(by_price, "item")


@register("s4_read_predictions", "SELECT p_partkey::VARCHAR AS item, p_size::DOUBLE AS b_tilde "
                                 "FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def s4(spark, sf):
    path = scratch_path(spark, "runs")
    for name, run in zip(("d64_s0", "d64_s1"), _runs(spark, sf)):
        write_run(run, name, path)
    return read_predictions(spark, path)


@register("s9_write_run", """SELECT 'd64_s0' AS run, p_brand AS item_type, count(*) AS n_items,
  sum(p_size)::DOUBLE AS total FROM part
  WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 2""")
def s9(spark, sf):
    path = scratch_path(spark, "runs")
    write_run(_runs(spark, sf)[0], "d64_s0", path)
    return spark.read.parquet(path).groupBy("run", "item_type").agg(
        F.count("*").alias("n_items"), F.sum("b_tilde").alias("total"))


@register("s10_bundle_runs", f"""WITH {PANEL}, {RATE},
v AS (SELECT 'd64_s0' AS run, p_size::DOUBLE AS x, round(b, 8) AS y FROM part
      JOIN rate_score ON item = p_partkey
      UNION ALL SELECT 'd64_s1', p_retailprice, round(b, 8) FROM part
      JOIN rate_score ON item = p_partkey),
r AS (SELECT run, {rank_sql('x', 'run')} AS rx, {rank_sql('y', 'run')} AS ry FROM v)
SELECT run, {rsql('corr(rx, ry)')} AS rho, count(*) AS n_rows FROM r GROUP BY run""")
def s10(spark, sf):
    _, rho = bundle_runs(_runs(spark, sf))
    return rho.select("run", rd("rho").alias("rho"), "n_rows")


@register("s7_materialise", f"""WITH {PANEL}
SELECT item, {rsql('1 - avg(y)')} AS fail_rate, count(*) AS n_obs FROM panel GROUP BY 1""")
def s7(spark, sf):
    # of the cells, so that a changed outcome is another table
    mark = panel(spark, sf).agg(F.sum(F.xxhash64("item", "rater", "y").cast("decimal(38,0)")).cast("string")
                                .alias("mark")).first()["mark"]
    table = materialise(spark, lambda: P.failure_rate(panel(spark, sf)), "failure_rate", mark,
                        recompute=True)
    again = materialise(spark, lambda: table, "failure_rate", mark)
    return again.select("item", rd("fail_rate").alias("fail_rate"), "n_obs")


@register("p1_exclude_raters", f"""WITH {PANEL}
SELECT rater, count(*) AS n_obs, sum(y)::BIGINT AS n_pass FROM panel
WHERE rater NOT IN (0, 3) GROUP BY 1""")
def p1(spark, sf):
    return P.exclude_raters(panel(spark, sf), [0, 3]).groupBy("rater").agg(
        F.count("*").alias("n_obs"), F.sum(F.col("y").cast("bigint")).alias("n_pass"))


@register("p2_item_universe", f"""WITH {PANEL}
SELECT p_partkey AS item, p_partkey AS item_ord, p_brand AS item_type FROM part
WHERE p_partkey IN (SELECT item FROM panel)""")
def p2(spark, sf):
    return P.item_universe(items(spark, sf), types(spark, sf), panel(spark, sf))


@register("p3_keep_items", f"""WITH {PANEL}, {RATE}
SELECT DISTINCT item FROM panel WHERE item IN (SELECT item FROM rate_score)
  AND item IN (SELECT p_partkey FROM part)""")
def p3(spark, sf):
    cells = panel(spark, sf)
    return P.keep_items(cells.select("item").distinct(), size_score(spark, sf),
                        rate_score(cells), types(spark, sf))


@register("p4_train_items", f"""WITH {PANEL}
SELECT item, row_number() OVER (ORDER BY item) - 1 AS item_ord FROM (
  SELECT DISTINCT item::VARCHAR AS item FROM panel)""")
def p4(spark, sf):
    cells = panel(spark, sf).withColumn("item", F.col("item").cast("string"))
    kinds = types(spark, sf).withColumn("item", F.col("item").cast("string"))
    return P.train_items(cells, kinds, cells)


@register("p5_mask_raters", f"""WITH {PANEL}
SELECT rater, count(*) AS n_obs FROM panel JOIN supplier ON s_suppkey = rater
WHERE s_acctbal > 0 GROUP BY 1""")
def p5(spark, sf):
    mask = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("rater"))
    return P.mask_raters(panel(spark, sf), mask).groupBy("rater").agg(F.count("*").alias("n_obs"))


@register("p6_missing", f"""WITH {PANEL}
SELECT item, count(*) AS n_observed, (SELECT count(*) FROM supplier) - count(*) AS n_missing
FROM panel GROUP BY 1""")
def p6(spark, sf):
    n = raters(spark, sf).count()
    return P.missing_per_item(panel(spark, sf), n)


@register("p6_missing_pairs", f"""WITH {PANEL},
wanted AS (SELECT DISTINCT (o_orderkey % (SELECT count(*) FROM part)) AS item,
  (o_custkey % (SELECT count(*) FROM supplier)) AS rater FROM orders)
SELECT item, rater, (item, rater) IN (SELECT (item, rater) FROM panel) AS observed FROM wanted""")
def p6_pairs(spark, sf):
    n_i, n_r = items(spark, sf).count(), raters(spark, sf).count()
    wanted = spark.read.parquet(f"{sf}/orders.parquet").select(
        (F.col("o_orderkey") % n_i).alias("item"), (F.col("o_custkey") % n_r).alias("rater")
    ).distinct()
    cells = panel(spark, sf)
    seen = P.observed(cells, wanted)
    gone = P.missing(cells, wanted).withColumn("observed", F.lit(False))
    return seen.where("observed").unionByName(gone)


@register("p7_as_failure", f"""WITH {PANEL}
SELECT item, sum(1 - y)::BIGINT AS n_fail FROM panel GROUP BY 1""")
def p7(spark, sf):
    return P.as_failure(panel(spark, sf)).groupBy("item").agg(
        F.sum(F.col("fail").cast("bigint")).alias("n_fail"))


@register("p8_min_observed", f"""WITH {PANEL},
e AS (SELECT item FROM panel GROUP BY 1 HAVING count(*) >= 25)
SELECT item, count(*) AS n_obs FROM panel WHERE item IN (SELECT item FROM e) GROUP BY 1""")
def p8(spark, sf):
    return P.min_observed(panel(spark, sf), 25).groupBy("item").agg(F.count("*").alias("n_obs"))


@register("p9_fingerprint", """WITH a AS (
  SELECT p_partkey // 1024 AS g, sha1(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS d FROM part GROUP BY 1),
b AS (SELECT g // 1024 AS g, CASE WHEN (SELECT count(*) FROM a) > 1 THEN sha1(string_agg(d, ',' ORDER BY g))
      ELSE any_value(d) END AS d FROM a GROUP BY 1),
c AS (SELECT CASE WHEN (SELECT count(*) FROM b) > 1 THEN sha1(string_agg(d, ',' ORDER BY g)) ELSE any_value(d) END AS digest FROM b)
SELECT (SELECT count(*) FROM part) AS n_items, digest FROM c""")
def p9(spark, sf):
    return P.fingerprint(items(spark, sf))


def _type_cells(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    kind = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_type")
    return lines.join(kind, lines.l_partkey == kind.p_partkey).groupBy(
        F.col("l_suppkey").alias("item"), F.col("p_type").alias("rater")).agg(
        (F.avg((F.col("l_linestatus") == "O").cast("double")) >= 0.5).cast("int").alias("y"))


PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_PIVOT = ", ".join(f"max(CASE WHEN p_type = '{t}' THEN y END) AS \"{t}\"" for t in PART_TYPES)
_DENSE = f"""SELECT item, {_PIVOT} FROM (
  SELECT l_suppkey AS item, p_type,
         (avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) >= 0.5)::INTEGER AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1"""


@register("r1_dense", _DENSE)
def r1(spark, sf):
    return P.dense(_type_cells(spark, sf), None, PART_TYPES)


@register("r2_dense_all", _DENSE)
def r2(spark, sf):
    cells = _type_cells(spark, sf)
    names = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_type").alias("rater"), F.col("p_type").alias("rater_ord")).distinct()
    return P.dense_all(cells, cells.select("item").distinct(), names)


@register("r3_responses_for", f"""WITH {PANEL}
SELECT item, s_suppkey AS rater_ord, y FROM panel JOIN supplier ON s_suppkey = rater""")
def r3(spark, sf):
    return P.responses_for(panel(spark, sf), raters(spark, sf))


@register("r4_type_clusters", """SELECT p_brand AS item_type, p_partkey AS item,
  p_partkey AS item_ord,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS member FROM part""")
def r4(spark, sf):
    return P.type_clusters(items(spark, sf))


@register("r5_bank_columns", f"""WITH {PANEL}, {RATE}
SELECT item, row_number() OVER (ORDER BY item) - 1 AS bank_ord, {rsql('b')} AS b FROM (
  SELECT item::VARCHAR AS item, b FROM rate_score)""")
def r5(spark, sf):
    bank = rate_score(panel(spark, sf)).select(
        F.col("item").cast("string").alias("item"), "b", F.lit(1.0).alias("a"),
        F.lit(0.0).alias("s"))
    return P.bank_columns(bank).select("item", "bank_ord", rd("b").alias("b"))


@register("r6_dense_index", """SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
  row_number() OVER (ORDER BY o_orderkey) - 1 AS overall FROM orders""")
def r6(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey")
    inner = dense_index(orders, "o_orderkey", "pos", ["o_custkey"])
    return dense_index(inner, "o_orderkey", "overall")


@register("m1_failure_rate", f"""WITH {PANEL}
SELECT item, {rsql('1 - avg(y)')} AS fail_rate, count(*) AS n_obs FROM panel GROUP BY 1""")
def m1(spark, sf):
    return P.failure_rate(panel(spark, sf)).select("item", rd("fail_rate").alias("fail_rate"),
                                                   "n_obs")


@register("m15_panel_summary", f"""WITH {PANEL}, {TYPES}
SELECT rater::VARCHAR AS rater, item_type, grouping(rater, item_type)::BIGINT AS level, count(*) AS n_obs,
  sum(y)::BIGINT AS n_pass, {rsql('avg(y)')} AS pass_rate,
  CASE WHEN grouping(rater, item_type) = 1 THEN (SELECT count(DISTINCT item) FROM panel JOIN types USING (item)) - count(*) ELSE 0 END AS n_missing
FROM panel JOIN types USING (item) GROUP BY GROUPING SETS ((rater), (item_type), ())""")
def m15(spark, sf):
    out = P.panel_summary(panel(spark, sf), types(spark, sf))
    return out.select(F.col("rater").cast("string").alias("rater"), "item_type", F.col("level").cast("bigint").alias("level"), "n_obs",
                      "n_pass", rd("pass_rate").alias("pass_rate"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


@register("m2_spearman", f"""WITH {PANEL}, {SIZE}, {TYPES},
f AS (SELECT item, round((1 - avg(y))::DOUBLE, 9) AS y FROM panel GROUP BY 1),
v AS (SELECT 'all' AS part, b AS x, y FROM f JOIN size_score USING (item)
      UNION ALL SELECT item_type, b, y FROM f JOIN size_score USING (item) JOIN types USING (item)),
r AS (SELECT part, {rank_sql('x', 'part')} AS rx, {rank_sql('y', 'part')} AS ry FROM v)
SELECT part, {rsql('corr(rx, ry)')} AS rho, count(*) AS n_rows FROM r GROUP BY 1""")
def m2(spark, sf):
    f = P.failure_rate(panel(spark, sf)).select("item", F.round("fail_rate", 9).alias("y"))
    v = f.join(size_score(spark, sf), "item").join(types(spark, sf), "item")
    whole = v.select(F.lit("all").alias("part"), "b", "y").unionByName(
        v.select(F.col("item_type").alias("part"), "b", "y"))
    return spearman(whole, "b", "y", ["part"]).select("part", rd("rho").alias("rho"), "n_rows")


_SCORED = f"scored AS (SELECT item, rater, y, round({sig_sql('-b')}, 9) AS p FROM panel JOIN size_score USING (item))"


def _scored(spark, sf):
    return panel(spark, sf).join(size_score(spark, sf), "item").select(
        "item", "rater", "y", F.round(sig(-F.col("b")), 9).alias("p"))


@register("m3_auroc", f"""WITH {PANEL}, {SIZE}, {_SCORED}
SELECT {rsql('auroc')} AS auroc FROM ({auroc_sql('scored')})""")
def m3(spark, sf):
    return auroc(_scored(spark, sf), "y", "p").select(rd("auroc").alias("auroc"))


@register("m4_macro_auroc", f"""WITH {PANEL}, {SIZE}, {_SCORED},
a AS ({auroc_sql('scored', 'rater')})
SELECT {rsql('avg(auroc)')} AS macro_auroc,
  {rsql('stddev_samp(auroc) / sqrt(count(auroc))')} AS macro_auroc_se,
  count(auroc) AS n_raters FROM a""")
def m4(spark, sf):
    return macro_auroc(_scored(spark, sf), "y", "p").select(
        rd("macro_auroc").alias("macro_auroc"), rd("macro_auroc_se").alias("macro_auroc_se"),
        "n_raters")


@register("b1_logistic", f"""WITH {PANEL}, {RATE}
SELECT item, {rsql(sig_sql('20 * b'), 9)} AS p FROM rate_score""")
def b1(spark, sf):
    return rate_score(panel(spark, sf)).select("item", rd(sig(20 * F.col("b")), 9).alias("p"))


@register("b7_entropy", f"""WITH {PANEL},
f AS (SELECT item, greatest(least(avg(y)::DOUBLE, 1 - 1e-12), 1e-12) AS p FROM panel GROUP BY 1)
SELECT item, {rsql('-(p * ln(p) + (1 - p) * ln(1 - p))')} AS h FROM f""")
def b7(spark, sf):
    rate = panel(spark, sf).groupBy("item").agg(F.avg("y").alias("p"))
    return rate.select("item", rd(binary_entropy(F.col("p"))).alias("h"))
