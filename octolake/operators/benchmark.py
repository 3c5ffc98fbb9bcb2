"""Feature tables per sequence, folds by group, and evaluation of labels."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.operators import trajectory as T
from octolake.operators.skew import running_totals, skew_join
from octolake.sources.shared import cut


def polynomial_features(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Per key: means of e_i, e_i^2, e_i^3 and e_i e_j of its complete units, as a control without algebra."""
    rows = df.dropna(subset=[*keys, row_id, *O.AXES]).select(row_id, *keys, *O.AXES).dropDuplicates([row_id])
    e = {a: F.col(a) for a in O.AXES}
    powers = [F.avg(f(e[a])).alias(f"{n}_{a}") for a in O.AXES for n, f in (("mean", lambda v: v), ("square", lambda v: v * v), ("cube", lambda v: v * v * v))]
    return rows.groupBy(*keys).agg(*powers, *[F.avg(e[a] * e[b]).alias(f"product_{a}_{b}") for a, b in combinations(O.AXES, 2)])


def antisymmetric_features(df: DataFrame, keys: list[str], position: str, row_id: str) -> DataFrame:
    """Per key: mean, deviation, least and greatest of the 21 terms x_a y_b - x_b y_a of neighbours, gaps closed."""
    rows = T.gap_blind_products(df, keys, position, row_id)
    terms = {f"w_{a}_{b}": F.col(f"x.e{a}") * F.col(f"y.e{b}") - F.col(f"x.e{b}") * F.col(f"y.e{a}") for a, b in combinations(range(1, 8), 2)}
    wide = rows.select(*keys, *[t.alias(n) for n, t in terms.items()])
    return wide.groupBy(*keys).agg(*[f(n).alias(f"{s}_{n}") for n in terms for s, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def randomised_structure_features(df: DataFrame, keys: list[str], position: str, row_id: str, seed: int = 7) -> DataFrame:
    """Per key: statistics of seven random combinations of the 21 antisymmetric terms: the algebra's structure at random.

    The commutator's own seven components are such combinations as well, so this is its control. Rows of weights are of
    unit length (see :func:`structure_weights`).
    """
    rows = T.gap_blind_products(df, keys, position, row_id)
    terms = [F.col(f"x.e{a}") * F.col(f"y.e{b}") - F.col(f"x.e{b}") * F.col(f"y.e{a}") for a, b in combinations(range(1, 8), 2)]
    bound = rows.select(*keys, *[t.alias(f"_t{i}") for i, t in enumerate(terms)])
    made = {f"r_{j}": sum((F.col(f"_t{i}") * float(v) for i, v in enumerate(w[1:], 1)), F.col("_t0") * float(w[0])) for j, w in enumerate(structure_weights(seed))}
    wide = bound.select(*keys, *[c.alias(n) for n, c in made.items()])
    return wide.groupBy(*keys).agg(*[f(n).alias(f"{s}_{n}") for n in made for s, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def structure_weights(seed: int = 7) -> np.ndarray:
    """Seven rows of 21 Gaussian weights, each of unit length."""
    w = np.random.default_rng(seed).normal(size=(7, 21))
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def balanced_sample(df: DataFrame, by: list[str], label: str, row_id: str, most: int | None = None) -> DataFrame:
    """Rows of every label in equal number: that of the rarest label of ``by``, and ``most`` at most, in the md5 order of the id.

    Rows with a null are left out; ``row_id`` must be unique in ``by``.
    """
    rows = placed_in_order(df.dropna(subset=[*by, label, row_id]), [*by, label], F.col(row_id).cast("string"))
    sizes = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.min("_n").alias("_least"))
    least = F.least("_least", F.lit(most)) if most is not None else F.col("_least")
    return skew_join(rows, sizes, by).where(F.col("place") < least).select(*df.columns)


def capped_per_parent(df: DataFrame, parent: str, row_id: str, most: int) -> DataFrame:
    """At most ``most`` rows of every parent, in the md5 order of the id; rows with a null parent or id are left out."""
    return placed_in_order(df.dropna(subset=[parent, row_id]), [parent], F.col(row_id).cast("string")).where(F.col("place") < most).select(*df.columns)


def fold_of(group: Column, folds: int) -> Column:
    """A fold from the md5 of the group, so that a group stays in one fold, in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def centroid_predictions(features: DataFrame, row_id: str, label: str, fold: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, row_id, fold, label, predicted): the label of the nearest centroid, the centroids being those of the other folds.

    One aggregation by fold and label gives all centroids: those of all folds but one are the totals less that fold's.
    ``by`` names columns, such as a data set, of which each value is evaluated by itself in the same jobs. The labels of
    such a value are held in one array. A label that no other fold holds can't be predicted. Ties go to the lesser
    label. Rows with a null in any column named are left out.
    """
    by = by or []
    known = cut(features.select(*by, row_id, label, fold, *columns).dropna(), "features")
    sums = known.groupBy(*by, fold, label).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in columns])
    sums = cut(sums, "sums")  # rows: values of by x folds x labels
    total = sums.groupBy(*by, label).agg(F.sum("_n").alias("_all"), *[F.sum(f"_s_{c}").alias(f"_t_{c}") for c in columns])
    folds = sums.select(*by, fold).distinct()
    grid = folds.join(total, by) if by else folds.crossJoin(total)
    own = grid.join(sums, [*by, fold, label], "left").fillna(0, subset=["_n", *[f"_s_{c}" for c in columns]])
    rest = F.col("_all") - F.col("_n")
    centroid = F.array(*[(F.col(f"_t_{c}") - F.col(f"_s_{c}")) / rest for c in columns])
    packed = own.where(rest > 0).groupBy(*by, fold).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("_l"), centroid.alias("_c")))).alias("_centroids"))
    rows = skew_join(known, packed, [*by, fold], "left")

    def gap(c: Column) -> Column:
        return sum(((F.col(x) - c["_c"][i]) * (F.col(x) - c["_c"][i]) for i, x in enumerate(columns[1:], 1)), (F.col(columns[0]) - c["_c"][0]) * (F.col(columns[0]) - c["_c"][0]))

    best = F.array_min(F.transform("_centroids", lambda c: F.struct(gap(c).alias("d"), c["_l"].alias("l"))))
    return rows.select(*by, row_id, fold, label, best["l"].alias("predicted"))


def fold_metrics(predictions: DataFrame, label: str, fold: str, by: list[str] | None = None) -> DataFrame:
    """(by, fold, n, accuracy, balanced_accuracy, macro_f1, mcc) from the confusion counts of each fold.

    Balanced accuracy is the mean recall of the labels that the fold holds; F1 is averaged over labels that are held or
    predicted, 0 without a hit. MCC is the correlation of held and predicted labels over all classes, 0 where either is
    constant.
    """
    keys = [*(by or []), fold]
    cells = predictions.groupBy(*keys, label, "predicted").agg(F.count(F.lit(1)).alias("n"))
    truth = cells.groupBy(*keys, F.col(label).alias("l")).agg(F.sum("n").alias("held"), F.sum(F.when(F.col(label) == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(*keys, F.col("predicted").alias("l")).agg(F.sum("n").alias("said"))
    both = truth.join(said, [*keys, "l"], "full").fillna(0, subset=["held", "hit", "said"])
    n, hit = F.sum("held").cast("double"), F.sum("hit").cast("double")
    cross, held2, said2 = (F.sum(F.col(a).cast("double") * F.col(b)) for a, b in (("held", "said"), ("held", "held"), ("said", "said")))
    scale = F.sqrt((n * n - held2) * (n * n - said2))
    return both.groupBy(*keys).agg(
        F.sum("held").alias("n"),
        (hit / n).alias("accuracy"),
        F.avg(F.when(F.col("held") > 0, F.col("hit") / F.when(F.col("held") > 0, F.col("held")))).alias("balanced_accuracy"),
        F.avg(2 * F.col("hit") / (F.col("held") + F.col("said"))).alias("macro_f1"),
        F.when(scale > 0, (n * hit - cross) / F.when(scale > 0, scale)).otherwise(0.0).alias("mcc"),
    )


def metric_summary(metrics: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, metric, n_folds, mean, sd, half_interval): over folds, with the sample deviation (0 for one fold) and 1.96 sd / sqrt n."""
    by = by or []
    rows = metrics.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns])).alias("m")).select(*by, "m.*")
    agg = rows.groupBy(*by, "metric").agg(F.count("v").alias("n_folds"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    return agg.withColumn("half_interval", 1.96 * F.col("sd") / F.sqrt(F.col("n_folds").cast("double")))


def hex_number(text: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the md5 of a text as a number, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def placed_in_order(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``df`` with ``place``: 0, 1, 2.. in each key by the md5 of ``order`` (then ``order``).

    Rows are ordered within 256 ranges of the md5, and ranges are counted, so no task orders a whole key.
    """
    rows = df.withColumn("_md5", F.md5(order)).withColumn("_order", order).withColumn("_range", F.substring("_md5", 1, 2))
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_n")).drop("_n")
    inside = rows.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_range").orderBy("_md5", "_order")))
    return inside.join(before, [*keys, "_range"]).withColumn("place", F.col("_before") + F.col("_at") - 1).drop("_md5", "_order", "_range", "_before", "_at")


def stratified_group_folds(df: DataFrame, by: list[str], row_id: str, group: str, label: str, folds: int, strict: bool = True) -> DataFrame:
    """(by, row_id, group, label, fold): whole groups in folds, with the labels and sizes of groups spread evenly.

    Groups are dealt out in the order of their md5 within strata of their most frequent label (ties: the lesser) and the
    power of two of their size, so that of each stratum no fold has two groups more than another. Rows with a null are
    left out; repeated rows count once. A label that stands in fewer groups than there are folds is an error, or, unless
    ``strict``, is lacking in some folds.
    """
    rows = df.select(*by, row_id, group, label).dropna().distinct()
    counts = rows.groupBy(*by, group, label).agg(F.count(F.lit(1)).alias("_n"))
    few = strict and counts.groupBy(*by, label).agg(F.count_distinct(group).alias("groups")).where(F.col("groups") < folds).take(1)
    if few:
        raise ValueError(f"a label stands in fewer groups than there are folds: {few[0].asDict()}")
    groups = counts.groupBy(*by, group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l")))["l"].alias("_label"), F.floor(F.log2(F.sum("_n").cast("double")) + 1e-9).cast("int").alias("_size"))
    dealt = placed_in_order(groups, [*by, "_label", "_size"], F.col(group)).select(*by, group, F.pmod("place", F.lit(folds)).cast("int").alias("fold"))
    return skew_join(rows, dealt, [*by, group]).select(*by, row_id, group, label, "fold")


def permuted_labels(df: DataFrame, by: list[str], row_id: str, label: str, seed: int) -> DataFrame:
    """``df`` with the labels of each value of ``by`` in another order: a null model that keeps their counts.

    A row's label goes to the row that stands at its place in another md5 order. ``row_id`` must be unique in ``by``.
    """
    first = placed_in_order(df, by, F.col(row_id).cast("string"))
    second = placed_in_order(df.select(*by, row_id, label), by, F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))
    return first.drop(label).join(second.drop(row_id), [*by, "place"]).select(*df.columns)


def paired_comparison(a: DataFrame, b: DataFrame, by: list[str], unit: str, metric: str, resamples: int = 999, seed: int = 7) -> DataFrame:
    """(by, n, mean_difference, sd, dz, p_sign, low, high) of metric a - b over the units (folds, repeats) that both hold.

    dz is the mean over the sample deviation (null where that is 0). p_sign is the share of ``resamples`` random sign
    changes, and the differences themselves, whose mean is as far from 0; low and high are the 2.5 and 97.5 percentiles
    of the mean with Poisson weights. Signs and weights come from an md5 of seed, resample and unit, so each resample is
    a plain sum. Units with a null metric are left out.
    """
    pair = a.select(*by, unit, F.col(metric).alias("_a")).join(b.select(*by, unit, F.col(metric).alias("_b")), [*by, unit]).dropna()
    rows = pair.select(*by, unit, (F.col("_a") - F.col("_b")).alias("_d"))
    drawn = rows.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("_r").cast("string"), F.col(unit).cast("string"))
    u = hex_number(text) / float(1 << 32)
    cut_at, term, weight = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(8):
        cut_at += term
        weight = weight + (u > cut_at).cast("int")
        term /= k + 1
    sign = F.when(F.pmod(hex_number(F.concat(F.lit("s"), text), 2), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = drawn.withColumn("_w", weight).groupBy(*by, "_r").agg(F.avg(sign * F.col("_d")).alias("_flipped"), F.sum("_w").alias("_all"), F.sum(F.col("_w") * F.col("_d")).alias("_s"))
    means = sums.withColumn("_mean", F.when(F.col("_all") > 0, F.col("_s") / F.when(F.col("_all") > 0, F.col("_all"))))
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("sd"))
    joined = means.join(whole, by) if by else means.crossJoin(whole)
    far = (F.abs("_flipped") >= F.abs("mean_difference") - 1e-12).cast("long")
    per = joined.groupBy(*by, "n", "mean_difference", "sd").agg(((1 + F.sum(far)) / (1.0 + resamples)).alias("p_sign"), F.percentile("_mean", 0.025).alias("low"), F.percentile("_mean", 0.975).alias("high"))
    return per.select(*by, "n", "mean_difference", "sd", F.when(F.col("sd") > 1e-12, F.col("mean_difference") / F.when(F.col("sd") > 1e-12, F.col("sd"))).alias("dz"), "p_sign", "low", "high")


def ranking_scores(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """(by, n_pos, n_neg, roc_auc, pr_auc) of each value of ``by``: both areas from counts by score, ties at once.

    PR-AUC is the average precision over the scores from the highest on. Null without rows of either kind.
    """
    counts = df.select(*by, F.col(score).cast("double").alias("s"), F.col(positive).cast("int").alias("y")).dropna().groupBy(*by, "s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    run = running_totals(counts, by, "s", ["p", "q"], descending=True).withColumn("tp", F.col("before_p") + F.col("p")).withColumn("fp", F.col("before_q") + F.col("q"))
    total = run.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)).alias("_u"),
        F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_a"),
    )
    both = (F.col("n_pos") * F.col("n_neg")).cast("double")
    return total.select(*by, "n_pos", "n_neg", F.when(both > 0, F.col("_u") / F.when(both > 0, both)).alias("roc_auc"), F.when(F.col("n_pos") > 0, F.col("_a") / F.when(F.col("n_pos") > 0, F.col("n_pos"))).alias("pr_auc"))


def regression_metrics(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """(keys, n, r2, rmse, mae) of predictions; r2 is null where the truth is constant; rows with a null are left out."""
    rows = df.select(*keys, F.col(truth).cast("double").alias("y"), F.col(predicted).cast("double").alias("p")).dropna()
    error = F.col("y") - F.col("p")
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("_v"), F.avg(error * error).alias("_e"), F.avg(F.abs(error)).alias("mae"))
    return per.select(*keys, "n", F.when(F.col("_v") > 1e-12, 1 - F.col("_e") / F.when(F.col("_v") > 1e-12, F.col("_v"))).alias("r2"), F.sqrt("_e").alias("rmse"), "mae")


def line_stability(products: DataFrame, keys: list[str], position: str, resamples: int = 20, seed: int = 7) -> DataFrame:
    """(keys, resamples, dominant_share, mean_cosine, least_cosine): how stable the line totals are when pairs are drawn again.

    dominant_share is how often the dominant line stays so; the cosines are those of the totals with the whole ones.

    Each pair enters a resample with a Poisson(1) weight from a hash of seed, key, position and resample, so resamples
    are plain sums that need no group in one task, and results don't depend on the partitioning.
    """
    norms = [F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]) for t in O.line_terms([F.col(f"x.{e}") for e in O.AXES], [F.col(f"y.{e}") for e in O.AXES])]
    rows = products.select(*keys, position, *[n.alias(f"l{i}") for i, n in enumerate(norms)])
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys, position, "r"), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    cut, term, weight = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(8):
        cut += term
        weight = weight + (u > cut).cast("int")
        term /= k + 1
    drawn = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples)))).withColumn("w", F.when(F.col("r") == 0, 1).otherwise(weight))
    sums = drawn.groupBy(*keys, "r").agg(*[F.sum(F.col("w") * F.col(f"l{i}")).alias(f"l{i}") for i in range(7)])
    best = F.array_max(F.array(*[F.struct(F.round(f"l{i}", 9).alias("s"), F.lit(-i).alias("i")) for i in range(7)]))["i"]
    marked = sums.withColumn("best", best)
    whole = marked.where("r = 0").select(*keys, F.col("best").alias("_whole"), *[F.col(f"l{i}").alias(f"w{i}") for i in range(7)])
    dot = lambda a, b: sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(1, 7)), F.col(f"{a}0") * F.col(f"{b}0"))
    length = F.sqrt(dot("l", "l") * dot("w", "w"))
    cosine = F.when(length > 0, dot("l", "w") / F.when(length > 0, length)).otherwise(0.0)
    return marked.where("r > 0").join(whole, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("resamples"), F.avg((F.col("best") == F.col("_whole")).cast("double")).alias("dominant_share"), F.avg(cosine).alias("mean_cosine"), F.min(cosine).alias("least_cosine"))
