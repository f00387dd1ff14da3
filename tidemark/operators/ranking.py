"""Feature selection and models: imputing, pruning, ranks, tree ensembles, scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import correlation
from tidemark.functions.rows import sums_before, value_ranks
from tidemark.functions.tables import Table
from tidemark.operators.boosting import boosted_scores, cut_points
from tidemark.operators.quality import long_form


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, median``: exact medians from the counts of the distinct values."""
    ranks = value_ranks(long_form(df, columns, []).where("x is not null"), ("feature",), "x")
    sizes = ranks.groupBy("feature").agg(F.sum("n").alias("_all"))  # one row for each column
    middle = ranks.join(F.broadcast(sizes), "feature")
    covers = lambda k: (F.col("before") <= k) & (F.col("before") + F.col("n") > k)
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return middle.groupBy("feature").agg(((F.max(F.when(covers(low), F.col("x"))) + F.max(F.when(covers(high), F.col("x")))) / 2).alias("median"))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's exact median."""
    one = medians(df, columns).agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_m_{c}") for c in columns])
    out = df.join(F.broadcast(one))  # one row
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def impute_approximate(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same by Spark's imputer, whose median is approximate, for very wide or large tables."""
    return Imputer(strategy="median", inputCols=columns, outputCols=columns).fit(df).transform(df)


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that are not constant."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, corr`` of all pairs of columns, from one pass over rows without nulls."""
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(df.dropna(subset=columns))
    m = Correlation.corr(rows, "_x").first()[0].toArray()
    pairs = [(columns[i], columns[j], float(m[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.sparkSession.createDataFrame(pairs, "a string, b string, corr double")


def prune(df: DataFrame, columns: list[str], target: str, most: float = 0.95) -> list[str]:
    """Of each pair correlated above ``most`` the column less correlated with the target goes."""
    row = df.agg(*[correlation(c, target).alias(c) for c in columns]).first()
    strength = {c: abs(row[c] or 0.0) for c in columns}
    gone: set[str] = set()
    for r in correlation_matrix(df, columns).where(F.abs("corr") > most).orderBy("a", "b").collect():  # pairs of columns
        if r["a"] not in gone and r["b"] not in gone:
            gone.add(r["b"] if strength[r["a"]] >= strength[r["b"]] else r["a"])
    return [c for c in columns if c not in gone]


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Rank correlation of each column with the target, average ranks for ties."""
    rows = long_form(df.where(F.col(target).isNotNull()), columns, [target]).where("x is not null")

    def ranked(rows: DataFrame, c: str, name: str) -> DataFrame:
        ranks = value_ranks(rows, ("feature",), c)
        return rows.join(ranks.select("feature", c, (F.col("before") + (F.col("n") + 1) / 2).alias(name)), ["feature", c])

    rows = ranked(ranked(rows, "x", "_rx"), target, "_ry")
    return rows.groupBy("feature").agg(correlation("_rx", "_ry").alias("score"))


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 16) -> DataFrame:
    """Information between each column, cut into bins of its ranks, and the classes of the target; equal values share a bin."""
    rows = long_form(df.where(F.col(target).isNotNull()), columns, [target]).where("x is not null")
    sizes = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("_all"))  # one row for each column
    binned = value_ranks(rows, ("feature",), "x").join(F.broadcast(sizes), "feature")
    binned = binned.select("feature", "x", F.expr(f"before * {bins} div _all").alias("_b"))
    n = rows.join(binned, ["feature", "x"]).groupBy("feature", "_b", target).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    left, right = F.sum("n").over(Window.partitionBy("feature", "_b")), F.sum("n").over(Window.partitionBy("feature", target))
    part = F.col("n") / total * F.ln(F.col("n") * total / (left * right))
    return n.withColumn("_p", part).groupBy("feature").agg(F.sum("_p").alias("score"))


def f_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """One-way F statistic of each column between the classes of the target, from class sums."""
    rows = long_form(df.where(F.col(target).isNotNull()), columns, [target]).where("x is not null")
    by = rows.groupBy("feature", target).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
    n, m = F.col("n"), F.col("m")
    out = by.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("_n"), (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)).alias("_b"), F.sum((n - 1) * F.col("v")).alias("_w")
    )
    score = (F.col("_b") / (F.col("k") - 1)) / F.nullif(F.col("_w") / (F.col("_n") - F.col("k")), F.lit(0.0))
    return out.where("k > 1").select("feature", score.alias("score"))


def forest_importance(df: DataFrame, columns: list[str], target: str, trees: int = 40, depth: int = 6, seed: int = 42) -> DataFrame:
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(df.dropna(subset=[*columns, target]))
    model = RandomForestClassifier(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, score double")


def mean_rank(scores: list[DataFrame]) -> DataFrame:
    """Average rank over several score tables by falling absolute score; a missing feature ranks one past the last."""
    tagged = [s.select("feature", F.abs("score").alias("s"), F.lit(i).alias("m")) for i, s in enumerate(scores)]
    rows = reduce(DataFrame.unionByName, tagged)
    ranked = rows.withColumn("r", F.rank().over(Window.partitionBy("m").orderBy(F.desc_nulls_last("s"))))
    size = ranked.groupBy("m").agg((F.max("r") + 1).alias("last"))
    every = rows.select("feature").distinct().join(F.broadcast(size))  # features x methods
    out = every.join(ranked, ["feature", "m"], "left").withColumn("r", F.coalesce("r", "last"))
    return out.groupBy("feature").agg(F.avg("r").alias("mean_rank"))


def auc(scored: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve from rank sums, ties at their average rank.

    Equal scores are counted first, so the ranks are over distinct scores.
    """
    y = F.col(label).cast("double")
    by = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    by = sums_before(by, keys, score, F.col("_neg"), "_below")
    out = by.groupBy(*keys).agg(F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_u"), F.sum("_pos").alias("_np"), F.sum("_neg").alias("_nq"))
    return out.select(*keys, (F.col("_u") / F.nullif(F.col("_np") * F.col("_nq"), F.lit(0.0))).alias("auc"))


def classification_metrics(scored: DataFrame, score: str, label: str, keys: tuple[str, ...] = (), cut: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, log loss, Brier score and AUC."""
    p, y = F.col(score), F.col(label) == 1
    hit = p >= cut
    safe = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    out = scored.groupBy(*keys).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
        F.avg(F.when(y, -F.ln(safe)).otherwise(-F.ln(1 - safe))).alias("logloss"), F.avg(F.pow(p - y.cast("double"), 2)).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns(
        {
            "accuracy": (tp + tn) / (tp + fp + fn + tn),
            "precision": F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)),
            "recall": F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)),
            "f1": F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)),
        }
    )
    area = auc(scored, score, label, keys)
    return out.join(area, list(keys)) if keys else out.join(F.broadcast(area))  # one row each


MODELS: dict[str, Callable] = {
    "gbt": lambda y: GBTClassifier(featuresCol="_z", labelCol=y, maxIter=20, maxDepth=4, seed=42),
    "forest": lambda y: RandomForestClassifier(featuresCol="_z", labelCol=y, numTrees=50, maxDepth=6, seed=42),
    "logistic": lambda y: LogisticRegression(featuresCol="_z", labelCol=y, maxIter=50),
    "gbt_regressor": lambda y: GBTRegressor(featuresCol="_z", labelCol=y, maxIter=20, maxDepth=4, seed=42),
}


def pipeline(kind: str, columns: list[str], target: str) -> Pipeline:
    """Scaler and model; the scaler is fitted on the training part only."""
    return Pipeline(
        stages=[VectorAssembler(inputCols=columns, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), MODELS[kind](target)]
    )


def fold_scores(members: DataFrame, columns: list[str], target: str, kind: str = "gbt") -> DataFrame:
    """Out-of-fold scores: for each fold a model of its training rows scores its test rows. ``gbt`` fits all folds at once."""
    if kind == "gbt":
        return boosted_scores(members, columns, [target]).select("symbol", "ts", "fold", F.col("label").alias(target), "score")
    data = members.dropna(subset=[*columns, target])
    folds = [r["fold"] for r in data.select("fold").distinct().orderBy("fold").collect()]
    out = []
    for f in folds:
        mine = data.where(F.col("fold") == f)
        train = mine.where("role = 'train'")
        if train.select(target).distinct().count() < 2:
            continue
        scored = pipeline(kind, columns, target).fit(train).transform(mine.where("role = 'test'"))
        p = F.col("prediction") if kind.endswith("regressor") else vector_to_array("probability")[1]
        out.append(scored.select("symbol", "ts", "fold", target, p.alias("score")))
    if not out:
        raise ValueError("no fold has training rows of two classes")
    return reduce(DataFrame.unionByName, out)


def meta_model(df: DataFrame, columns: list[str], primary: str, meta_label: str, kind: str = "forest"):
    """A model of whether the primary signal is right, fitted where there is one."""
    active = df.where(F.col(primary) != 0).withColumn("primary_side", F.col(primary).cast("double")).dropna(subset=[*columns, meta_label])
    return pipeline(kind, [*columns, "primary_side"], meta_label).fit(active)


def direction_leak(members: DataFrame, columns: list[str], target: str) -> DataFrame:
    """AUC of models fitted forwards and with the parts swapped: features that leak do equally well both ways.

    Both ways are folds of one fit, an even and an odd one for each fold of ``members``. A way without training rows of two classes has no row.
    """
    rows = Table(members.select(*dict.fromkeys(["symbol", "ts", "fold", "role", *columns, target])), "members").rows
    ways = rows.withColumn("_way", F.explode(F.array(F.lit(0), F.lit(1))))
    swapped = F.when(F.col("role") == "train", "test").otherwise("train")
    ways = ways.withColumns({"fold": 2 * F.col("fold") + F.col("_way"), "role": F.when(F.col("_way") == 0, F.col("role")).otherwise(swapped)})
    scores = Table(boosted_scores(ways, columns, [target], cuts=cut_points(rows, columns)), "scores").rows
    direction = F.when(F.pmod("fold", F.lit(2)) == 0, "forward").otherwise("reverse")
    return auc(scores.withColumn("direction", direction), "score", "label", ("direction",)).select("auc", "direction")


def zscored(df: DataFrame, means: dict[str, float], scales: dict[str, float]) -> DataFrame:
    """Columns scaled by stored means and scales."""
    return df.withColumns({c: (F.col(c) - means[c]) / (scales[c] or 1.0) for c in means})
