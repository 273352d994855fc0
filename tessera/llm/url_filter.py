"""URL verdicts: host and path rules first, then gradient-boosted trees on lexical features, in DataFrame operations only.

The trees are trained from the distinct URLs that the rules label, each weighing as much as its rows. Features: length, host and path depth, digit ratio, character
entropy, parameter count, and the smoothed block rate of the host's suffix among the labelled URLs. A URL that trains gets
that rate from the other folds, so that no label is a feature of its own row.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the model
like any other; with labels of one kind only, that verdict goes to every other URL; without any labels it is ``allow``;
repeated rows are judged alike, and a URL of any number of rows trains once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (verdict, host, path prefix); a rule fits its host and all subdomains. The longest that fits wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Bound on the distinct labelled URLs that train the trees, half of it for either verdict; a larger set is thinned by hash.
MOST_TRAINING_URLS = 20_000
#: Thinning aims at so much of the bound, many standard deviations below it.
FILL = 0.9
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 7
#: Weight of the overall block rate in the rate of a suffix, and folds from whose others a training row takes its rate.
SMOOTHING, FOLDS = 20.0, 5

FEATURES = ["url_length", "host_depth", "path_depth", "digit_ratio", "entropy", "params", "suffix_rate", "suffix_share"]


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds url (null: empty), host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        pages.withColumn("_url", url)
        .withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", r"(?s)^[^/?#]*", 0), upper, lower))
        .withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features that need no training, and the host's suffix (its last two labels)."""
    url, chars = F.col("_url"), F.split("_url", "")
    length = F.length(url)
    counts = F.transform(F.array_distinct("_chars"), lambda c: F.size(F.filter("_chars", lambda x: x == c)).cast("double"))
    share = lambda n: n / F.greatest(F.size("_chars"), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return (
        urls.withColumn("_chars", chars)
        .withColumns(
            {
                "url_length": length.cast("double"),
                "host_depth": F.size(F.split("host", r"\.")).cast("double"),
                "path_depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
                "digit_ratio": (length - F.length(F.translate(url, "0123456789", ""))) / F.greatest(length, F.lit(1)).cast("double"),
                "entropy": F.aggregate(counts, F.lit(0.0), lambda s, n: s - share(n) * F.log2(share(n))),
                "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
                "suffix": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0),
            }
        )
        .drop("_chars")
    )


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule (or null), verdict, and score (the model's probability of ``block``; null where a rule decides)."""
    urls = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col)), url_col)
    urls = with_features(urls.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)))
    urls = urls.withColumns({"rule": F.col("_rule.rule"), "label": (F.col("_rule.verdict") == "block").cast("double")}).drop("_rule", url_col)
    urls = materialise(urls, "urls")
    labelled = urls.where("label is not null")
    total, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    by_rule = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow")
    if not 0 < blocked < total:
        fallback = "block" if blocked else "allow"
        return urls.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.lit(fallback)).alias("verdict"), F.lit(None).cast("double").alias("score"))

    # Written out, so that the joins have an exchange on either side and a very common suffix can be split.
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("_url", F.lit(1)), F.lit(FOLDS)))
    folds = materialise(labelled.groupBy("suffix", "fold").agg(F.sum("label").alias("fold_blocked"), F.count(F.lit(1)).alias("fold_n")), "folds")
    whole = materialise(folds.groupBy("suffix").agg(F.sum("fold_blocked").alias("blocked"), F.sum("fold_n").alias("n")), "suffixes")
    rate = lambda blocked_, n: (blocked_ + SMOOTHING * blocked / total) / (n + SMOOTHING)
    share = (F.coalesce("n", F.lit(0)) / F.lit(float(total))).alias("suffix_share")
    inputs = [c for c in FEATURES if not c.startswith("suffix")]
    # Each URL once, whatever its copies; the hash decides by URL, so that either verdict keeps about its share of the bound.
    distinct = materialise(labelled.groupBy("_url", "suffix", "fold", "label", *inputs).agg(F.count(F.lit(1)).cast("double").alias("weight")), "labelled")
    own = {label: n for label, n in distinct.groupBy("label").count().collect()}  # two rows
    quota = MOST_TRAINING_URLS // 2
    part = F.when(F.col("label") == 1, FILL * quota / own[1.0] if own[1.0] > quota else 1.0).otherwise(FILL * quota / own[0.0] if own[0.0] > quota else 1.0)
    chosen = distinct.where(F.pmod(F.xxhash64("_url"), F.lit(1 << 31)) < part * (1 << 31)).join(whole, "suffix").join(folds, ["suffix", "fold"])
    training = materialise(chosen.select(*inputs, rate(F.col("blocked") - F.col("fold_blocked"), F.col("n") - F.col("fold_n")).alias("suffix_rate"), share, "label", "weight").coalesce(8), "training")
    none = F.lit(0)
    urls = urls.join(whole, "suffix", "left").withColumns({"suffix_rate": rate(F.coalesce("blocked", none), F.coalesce("n", none)), "suffix_share": share})
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="_features"),
            GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", predictionCol="_says", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED),
        ]
    ).fit(training)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(urls)
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce(by_rule, F.when(F.col("_says") == 1, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("label").isNull(), vector_to_array("probability")[1]).alias("score"),
    )
