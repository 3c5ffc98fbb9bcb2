"""Labels learnt from feature tables with Spark's own models, and clusterings compared with labels."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.operators.skew import running_totals, skew_join
from octolake.sources.shared import cut

#: Labels that ``cross_validated`` takes; their counts are broadcast.
MOST_LABELS = 10_000
#: Models that one call fits, and those that are fitted at once.
MOST_FITS, FITS_AT_ONCE = 500, 4
MODELS = {
    "logistic": lambda seed: LogisticRegression(maxIter=30, regParam=0.01, weightCol="_w", labelCol="_y", featuresCol="_x"),
    "forest": lambda seed: RandomForestClassifier(numTrees=80, maxDepth=8, seed=seed, weightCol="_w", labelCol="_y", featuresCol="_x"),
    "tree": lambda seed: DecisionTreeClassifier(maxDepth=5, seed=seed, weightCol="_w", labelCol="_y", featuresCol="_x"),
    "gbt": lambda seed: OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=3, seed=seed, labelCol="_y", featuresCol="_x"), weightCol="_w", labelCol="_y", featuresCol="_x"),
    "svm": lambda seed: OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01, labelCol="_y", featuresCol="_x"), weightCol="_w", labelCol="_y", featuresCol="_x"),
}

MODELS_OF_VALUES = {
    "ridge": lambda seed, target: LinearRegression(regParam=0.01, elasticNetParam=0.0, labelCol=target, featuresCol="_x"),
    "forest": lambda seed, target: RandomForestRegressor(numTrees=80, maxDepth=8, seed=seed, labelCol=target, featuresCol="_x"),
    "gbt": lambda seed, target: GBTRegressor(maxIter=20, maxDepth=3, seed=seed, labelCol=target, featuresCol="_x"),
}


def _prepared(columns: list[str]) -> list:
    filled = [f"_i_{c}" for c in columns]
    return [
        Imputer(strategy="median", inputCols=columns, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        VarianceThresholdSelector(varianceThreshold=1e-12, featuresCol="_raw", outputCol="_kept"),
        StandardScaler(withMean=True, inputCol="_kept", outputCol="_x"),
    ]


def _values(rows: DataFrame, columns: list[str]) -> list[tuple]:
    """Different values of columns that are looped over: MOST_FITS at most, for each needs a model of its own."""
    found = rows.select(*columns).distinct().limit(MOST_FITS + 1).collect()
    if len(found) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} values of {', '.join(columns)}")
    return sorted(map(tuple, found), key=repr)


def _each(spark: SparkSession, f, values: list) -> list:
    """The function of every value, a few at a time: each is a row of small jobs, which leave the cluster idle by themselves."""
    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(spark)(f), values)


def _matching(by: list[str], value: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(by, value)], F.lit(True))


def _inner_folds(train: DataFrame, fold: str, folds: list) -> DataFrame:
    """Inner folds that keep outer ones whole, so that groups stay apart in the inner choice as well."""
    return train.withColumn("_inner", F.pmod(F.element_at(F.create_map(*[F.lit(x) for pair in zip(folds, range(len(folds))) for x in pair]), F.col(fold)), F.lit(2)).cast("int"))


def cross_validated(df: DataFrame, row_id: str, label: str, fold: str, columns: list[str], model: str = "logistic", seed: int = 7, by: list[str] | None = None, nested: bool = False) -> DataFrame:
    """(by, row_id, fold, label, predicted) of rows by a model fitted on the other folds; classes are weighted evenly.

    Medians, scales and kept columns come from the training folds alone. With ``nested`` the regularisation of
    ``logistic`` is chosen on inner folds, which are made of whole outer ones. Each value of ``by`` is evaluated by
    itself. A label that a training side lacks isn't predicted. Rows without id, label, fold or ``by`` are left out.
    Each value of ``by`` and fold is a fit: more than MOST_FITS raise an error, and so do more than MOST_LABELS labels.
    """
    by = by or []
    rows = cut(df.select(*by, row_id, label, fold, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=[*by, row_id, label, fold]), "features")
    values = _values(rows, [*by, fold])
    if rows.groupBy(*by, label).count().groupBy(*by).count().where(F.col("count") > MOST_LABELS).take(1):
        raise ValueError(f"more than {MOST_LABELS} labels")

    def one(value: tuple) -> DataFrame:
        mine = rows.where(_matching(by, value[:-1]))
        train, test = mine.where(F.col(fold) != value[-1]), mine.where(F.col(fold) == value[-1])
        counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
        weighted = train.join(F.broadcast(counts), label).withColumn("_w", 1.0 / F.col("_c"))  # at most MOST_LABELS rows
        total = weighted.agg(F.sum("_w"), F.count(F.lit(1))).first()
        weighted = weighted.withColumn("_w", F.col("_w") * (total[1] / total[0] if total[0] else 1.0))
        out = [*by, row_id, fold, label]
        index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
        names = list(index.labels)
        if len(names) < 2:
            return test.select(*out, F.lit(names[0] if names else None).alias("predicted"))
        estimator = MODELS[model](seed)
        others = [v[-1] for v in values if v[:-1] == value[:-1] and v[-1] != value[-1]]
        if nested and model == "logistic" and len(others) > 1:
            grid = ParamGridBuilder().addGrid(estimator.regParam, [0.001, 0.01, 0.1]).build()
            metric = MulticlassClassificationEvaluator(labelCol="_y", metricName="weightedRecall", weightCol="_w")
            estimator = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=metric, foldCol="_inner", numFolds=2)
            weighted = _inner_folds(weighted, fold, others)
        fitted = Pipeline(stages=[*_prepared(columns), estimator]).fit(index.transform(weighted))
        named = F.element_at(F.array(*[F.lit(n) for n in names]), F.least(F.col("prediction").cast("int") + 1, F.lit(len(names))))
        return fitted.transform(test).select(*out, named.alias("predicted"))

    out = _each(df.sparkSession, one, values)
    return reduce(DataFrame.unionByName, out) if out else rows.select(*by, row_id, fold, label, F.lit(None).cast("string").alias("predicted"))


def cross_validated_values(df: DataFrame, row_id: str, target: str, fold: str, columns: list[str], model: str = "ridge", seed: int = 7, by: list[str] | None = None) -> DataFrame:
    """(by, row_id, fold, target, predicted) of a numeric target by a regressor fitted on the other folds (see MODELS_OF_VALUES).

    As :func:`cross_validated`; a fold without any other gives null predictions.
    """
    by = by or []
    rows = cut(df.select(*by, row_id, fold, F.col(target).cast("double").alias(target), *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=[*by, row_id, target, fold]), "features")
    values = _values(rows, [*by, fold])
    out = [*by, row_id, fold, target]

    def one(value: tuple) -> DataFrame:
        mine = rows.where(_matching(by, value[:-1]))
        train, test = mine.where(F.col(fold) != value[-1]), mine.where(F.col(fold) == value[-1])
        if not train.take(1):
            return test.select(*out, F.lit(None).cast("double").alias("predicted"))
        fitted = Pipeline(stages=[*_prepared(columns), MODELS_OF_VALUES[model](seed, target)]).fit(train)
        return fitted.transform(test).select(*out, F.col("prediction").alias("predicted"))

    made = _each(df.sparkSession, one, values)
    return reduce(DataFrame.unionByName, made) if made else rows.select(*out, F.lit(None).cast("double").alias("predicted"))


def line_predictions(df: DataFrame, row_id: str, target: str, fold: str, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, row_id, fold, target, predicted): least squares of one column, from the sums of all folds less those of the own.

    One aggregation serves all folds. Null where the other folds hold no two different values of the column.
    """
    by = by or []
    rows = df.select(*by, row_id, fold, F.col(target).cast("double").alias(target), F.col(column).cast("double").alias("_x")).dropna()
    sums = {"n": F.count(F.lit(1)).cast("double"), "x": F.sum("_x"), "y": F.sum(target), "xx": F.sum(F.col("_x") * F.col("_x")), "xy": F.sum(F.col("_x") * F.col(target))}
    own = rows.groupBy(*by, fold).agg(*[v.alias(f"_o{k}") for k, v in sums.items()])
    total = own.groupBy(*by).agg(*[F.sum(f"_o{k}").alias(f"_t{k}") for k in sums])
    both = own.join(total, by) if by else own.crossJoin(total)
    n, x, y, xx, xy = (F.col(f"_t{k}") - F.col(f"_o{k}") for k in sums)
    spread = n * xx - x * x
    slope = F.when(spread > 1e-12, (n * xy - x * y) / F.when(spread > 1e-12, spread))
    lines = both.select(*by, fold, slope.alias("_slope"), (y / F.when(n > 0, n)).alias("_my"), (x / F.when(n > 0, n)).alias("_mx"))
    return skew_join(rows, lines, [*by, fold]).select(*by, row_id, fold, target, (F.col("_my") + F.col("_slope") * (F.col("_x") - F.col("_mx"))).alias("predicted"))


def clustered(df: DataFrame, row_id: str, columns: list[str], k: int, seed: int = 7, starts: int = 3, by: list[str] | None = None) -> DataFrame:
    """(by, row_id, cluster, silhouette): the best of several k-means runs on scaled columns, for each value of ``by``.

    ``silhouette`` is that of the whole clustering, by squared distances; null with fewer than two clusters. Rows with a
    null are left out.
    """
    by = by or []
    rows = cut(df.select(*by, row_id, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(), "features")

    def one(value: tuple) -> DataFrame:
        mine = rows.where(_matching(by, value))
        prepared = cut(Pipeline(stages=_prepared(columns)).fit(mine).transform(mine).select(*by, row_id, "_x"), "scaled")
        fits = [KMeans(k=k, featuresCol="_x", seed=seed + i, maxIter=20).fit(prepared) for i in range(starts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        found = best.transform(prepared)
        many = sum(n > 0 for n in best.summary.clusterSizes) > 1
        width = ClusteringEvaluator(featuresCol="_x").evaluate(found) if many else None
        return found.select(*by, row_id, F.col("prediction").alias("cluster"), F.lit(width).cast("double").alias("silhouette"))

    made = _each(df.sparkSession, one, _values(rows, by) if by else [()] if rows.take(1) else [])
    return reduce(DataFrame.unionByName, made) if made else rows.select(*by, row_id, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("silhouette"))


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, ari, nmi): adjusted Rand index and normalised mutual information of two labellings, from their cross table."""
    by = by or []
    cells = df.select(*by, F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: c * (c - 1) / 2.0
    nlogn = lambda c: c * F.log(c.cast("double"))
    n = F.col("n")
    row = cells.groupBy(*by).agg(F.sum(pairs(n)).alias("p"), F.sum(nlogn(n)).alias("h"), F.sum(n).alias("n"))
    for s in ("a", "b"):
        g = cells.groupBy(*by, s).agg(F.sum("n").alias("n"))
        side = g.groupBy(*by).agg(F.sum(pairs(n)).alias(f"p_{s}"), F.sum(nlogn(n)).alias(f"h_{s}"))
        row = row.join(side, by) if by else row.crossJoin(side)  # one row each without by
    expected = F.col("p_a") * F.col("p_b") / F.when(pairs(n) > 0, pairs(n))
    most = (F.col("p_a") + F.col("p_b")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("p") - expected) / F.when(most != expected, most - expected))
    h = lambda c: F.log(n.cast("double")) - F.col(c) / n
    mutual = h("h_a") + h("h_b") - h("h")
    mean = (h("h_a") + h("h_b")) / 2
    return row.select(*by, "n", ari.alias("ari"), F.when(mean > 1e-12, mutual / F.when(mean > 1e-12, mean)).otherwise(1.0).alias("nmi"))


def rank_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(n_pos, n_neg, auc): area under the ROC curve by ranks, ties sharing theirs; null where a class is missing.

    Scores are counted first, so only different scores are ordered, in ranges.
    """
    counts = df.select(F.col(score).cast("double").alias("s"), F.col(positive).cast("int").alias("y")).dropna().groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    won = running_totals(counts, [], "s", ["q"]).withColumnRenamed("before_q", "_below")
    total = won.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("_below") + F.col("q") / 2.0)).alias("_u"))
    both = F.col("n_pos") * F.col("n_neg")
    return total.select("n_pos", "n_neg", F.when(both > 0, F.col("_u") / F.when(both > 0, both)).alias("auc"))
