"""URL verdicts: rules first, else a logistic regression on hashed character n-grams.

Host: what follows the first '://' up to '/', '?', '#' or the end, with A-Z lower-cased.
Path: from there up to '?', '#' or the end. A null URL or one without '://' has both
empty. A rule (host, path) fits its host and every subdomain when the URL's path starts
with the rule's; the longest fitting rule decides. The model is Spark ML's logistic
regression over hashed n-grams (2 to 5 characters) of the host, framed by '^' and '$',
and of the path with digits made alike; it is trained from a small labelled table and
blocks at a probability of 0.5. Everything runs on built-in functions, in time linear in
a URL's length.

Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import pick

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
GRAMS = (2, 3, 4, 5)
FEATURES = 1 << 16
LIMIT = 0.5
REGULARISE = 0.002

# The labelled table the model starts from. Names are made of the words of public blocklist
# categories (gambling, medicines, tracking, adult, piracy, scams), and of public institutions
# and places; none is taken from a table that is judged.
UNWANTED = [
    "casino roulette blackjack jackpot betting bets sportsbook poker slots bingo lotto",
    "pills pharmacy meds viagra cialis steroids dietpills generics",
    "ads adserver tracker tracking pixel analytics banner popunder clickads affiliate",
    "adult xxx cams escorts nude hookup",
    "warez torrents keygen crack serials streamz",
    "freemoney payday loans winprize giveaway crypto-profit replica cheap-watches deals-now",
]
ORDINARY = [
    "library museum university school college archive theatre hospital parliament council observatory",
    "news weather journal gazette science history garden recipes travel music astronomy",
    "worthing brighton tonbridge harrogate whitby northampton southend reading matlock",
    "thornton harrington ashworth hathersage winthrop redmond anderton heathland",
    "bookshop bakery farmers cycling photography painting poetry mountains",
    "forum wiki docs maps software compiler linux standards",
]
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/", "/en/12", "/fr/77", "/de/4.html", "/es/31/", "/page?id=5")


def host(url: Column) -> Column:
    """Up to the first '/', '?' or '#' after '://', lower-cased."""
    own = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the columns host and path, or null."""
    best = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _cut(text: Column, mark: str, n: int) -> Column:
    """All n-grams of a column of single characters, by place: linear in its length."""
    return F.when(F.size(text) >= n, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(text) - n, F.lit(0))),
        lambda i: F.concat(F.lit(mark), *[F.get(text, i + k) for k in range(n)]))).otherwise(
            F.array().cast("array<string>"))


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def grams() -> Column:
    """The distinct n-grams of the columns name and place, arrays of characters."""
    parts = [_cut(F.col("name"), "h:", n) for n in GRAMS] + [_cut(F.col("place"), "p:", n) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def _featured(pages: DataFrame) -> DataFrame:
    cut = pages.withColumns({
        "name": _characters(F.concat(F.lit("^"), F.col("host"), F.lit("$"))),
        "place": _characters(F.regexp_replace("path", "[0-9]", "0"))})
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(
        cut.withColumn("grams", grams()).drop("name", "place"))


def examples_of(groups: list[str], label: float) -> list[tuple[str, float, str]]:
    """(url, label, word) rows: each word alone and beside the next of its group, places dealt in turn."""
    out = []
    for group in groups:
        words = group.split()
        for i, word in enumerate(words):
            for name in (word, f"{word}-{words[(i + 1) % len(words)]}"):
                k = len(out)
                out.append((f"{'http' if k % 3 else 'https'}://{PREFIXES[k % 4]}{name}.test{PATHS[k % 6]}", label, word))
    return out


def labelled(spark: SparkSession) -> DataFrame:
    """url, label, word: the labelled table."""
    return spark.createDataFrame(examples_of(UNWANTED, 1.0) + examples_of(ORDINARY, 0.0),
                                 "url string, label double, word string")


def fit_urls(examples: DataFrame) -> LogisticRegressionModel:
    """examples: url, label (1: block). The table is small, so one partition holds it."""
    rows = _featured(examples.coalesce(1).select("label", host(F.col("url")).alias("host"),
                                                 path(F.col("url")).alias("path")))
    return LogisticRegression(regParam=REGULARISE, standardization=False, maxIter=60).fit(rows)


def judge(pages: DataFrame, examples: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of block)."""
    from pyspark.ml.functions import vector_to_array
    rows = pick(pages, "page_id", "url").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    out = fit_urls(examples).transform(_featured(rows)).withColumn(
        "score", vector_to_array("probability")[1]).withColumn("fit", rule(rules))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(
        F.col("fit.verdict"), F.when(F.col("score") >= limit, "block").otherwise("allow")).alias("verdict"), "score")
