"""Trajectories: units of a sequence in order, their neighbours, and what neighbours make together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from octolake.functions import octonion as O
from octolake.operators.skew import skew_join
from octolake.sources.shared import cut

#: Positions of one key that a task orders together; a longer trajectory is cut into as many chunks as it needs.
CHUNK = 4096
#: Different values of one group that one aggregate holds.
MOST_HELD = 50_000
PRODUCT = [f"p{i}" for i in range(8)]
ASSOCIATOR = [f"a{i}" for i in range(8)]


def complete(df: DataFrame, keys: list[str], position: str, axes: tuple[str, ...] = O.AXES) -> DataFrame:
    """Rows with all keys, position and components: others are skipped units, which break a trajectory."""
    return df.dropna(subset=[*keys, position, *axes])


def in_chunks(df: DataFrame, keys: list[str], position: str, row_id: str, halo: int = 2, chunk: int = CHUNK) -> tuple[DataFrame, W]:
    """Rows with their ``chunk``, and the window that orders a chunk.

    The first ``halo`` positions of a chunk also stand at the end of the one before (``halo_row``), so ``lead`` up to
    the halo needs no other task. A key with a third of all rows is thus ordered in pieces of bounded size. Of several
    rows at one position the least ``row_id`` is kept, which takes out repeated deliveries without another shuffle.
    """
    own = F.floor(F.col(position) / chunk).cast("long")
    early = F.col(position) % chunk < halo
    spread = df.withColumn("_c", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))
    spread = spread.withColumn("halo_row", F.col("_c") != own).withColumnRenamed("_c", "chunk")
    w = W.partitionBy(*keys, "chunk").orderBy(position, row_id)
    once = spread.withColumn("_before", F.lag(position).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(position))).drop("_before")
    return once, w


def _neighbours(df: DataFrame, keys: list[str], position: str, row_id: str, n: int) -> DataFrame:
    """Units with the n next ones at the next positions, as structs x, y (and z); units before a gap are left out."""
    rows, w = in_chunks(complete(df.select(*keys, position, row_id, *O.AXES), keys, position), keys, position, row_id, n)
    unit = F.struct(F.col(position).alias("at"), *O.AXES)
    rows = rows.withColumn("y", F.lead(unit, 1).over(w))
    if n > 1:
        rows = rows.withColumn("z", F.lead(unit, 2).over(w))
    follows = F.col("y.at") == F.col(position) + 1
    if n > 1:
        follows &= F.col("z.at") == F.col(position) + 2
    return rows.where(~F.col("halo_row") & follows).withColumn("x", unit)


def _parts(name: str) -> list[Column]:
    return [F.col(f"{name}.{e}") for e in O.AXES]


def adjacent_products(df: DataFrame, keys: list[str], position: str, row_id: str) -> DataFrame:
    """keys, position, p0..p7, product_norm, transition_score of every unit and the unit at the next position.

    The transition score is the norm of the commutator. Units with a null component don't count as units; null keys
    give no rows; repeated rows count once; an empty table gives no rows.
    """
    x, y = _parts("x"), _parts("y")
    pairs = _neighbours(df, keys, position, row_id, 1).select(*keys, position, "x", "y", *[p.alias(n) for n, p in zip(PRODUCT, O.multiply(x, y))], F.sqrt(O.squared_norm(O.commutator(x, y))).alias("transition_score"))
    return pairs.withColumn("product_norm", F.sqrt(O.squared_norm([F.col(p) for p in PRODUCT])))


def adjacent_triplets(df: DataFrame, keys: list[str], position: str, row_id: str) -> DataFrame:
    """keys, position, a0..a7, associator_score of every unit and the two at the next positions; see adjacent_products."""
    x, y, z = _parts("x"), _parts("y"), _parts("z")
    rows = _neighbours(df, keys, position, row_id, 2)
    # the inner products are bound to columns, else the outer ones would repeat them eight times over
    rows = rows.select(*keys, position, "x", "z", F.array(*O.multiply(x, y)).alias("xy"), F.array(*O.multiply(y, z)).alias("yz"))
    xy, yz = [F.col("xy")[i] for i in range(8)], [F.col("yz")[i] for i in range(8)]
    left, right = O.multiply(xy, z), O.multiply(x, yz)
    rows = rows.select(*keys, position, *[(a - b).alias(n) for n, a, b in zip(ASSOCIATOR, left, right)])
    return rows.withColumn("associator_score", F.sqrt(O.squared_norm([F.col(a) for a in ASSOCIATOR])))


def dense_positions(df: DataFrame, keys: list[str], position: str, row_id: str, name: str = "index", chunk: int = CHUNK) -> DataFrame:
    """Complete rows, each position once, with their rank in the key's order from 0, gaps closed.

    Chunks of positions are counted and ranked by themselves; a running sum over a key's chunks gives each its start.
    """
    rows, w = in_chunks(complete(df, keys, position), keys, position, row_id, 0, chunk)
    ranked = rows.withColumn("_own", F.row_number().over(w) - 1)
    sizes = ranked.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(W.partitionBy(*keys).orderBy("chunk")) - F.col("_n")).drop("_n")
    return ranked.join(starts, [*keys, "chunk"]).withColumn(name, (F.col("_own") + F.col("_start")).cast("long")).drop("_own", "_start", "chunk", "halo_row")


def gap_blind_products(df: DataFrame, keys: list[str], position: str, row_id: str) -> DataFrame:
    """As :func:`adjacent_products`, but every unit meets the next one that there is, however far."""
    rows = dense_positions(df.select(*keys, position, row_id, *O.AXES), keys, position, row_id)
    met = adjacent_products(rows.select(*keys, "index", row_id, *O.AXES), keys, "index", row_id)
    return met


def line_attribution(products: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Seven rows for each pair of :func:`adjacent_products`: its three antisymmetric terms on a line, and their norm."""
    lines = [
        F.struct(F.lit(f"({a},{b},{c})").alias("fano_line"), t[0].alias("term_c"), t[1].alias("term_a"), t[2].alias("term_b"), F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]).alias("line_norm"))
        for (a, b, c), t in zip(O.LINES, O.line_terms(_parts("x"), _parts("y")))
    ]
    return products.select(*keys, position, F.explode(F.array(*lines)).alias("l")).select(*keys, position, "l.*")


def line_features(products: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: pairs, and of each line the total, mean, greatest norm and its share; entropy, concentration, dominant line.

    The seven norms of a pair are seven columns of one row, so nothing is multiplied before the one hash aggregation.
    Shares of a key without any norm are 0. Of equal lines the first is dominant. The entropy is divided by ln 7.
    """
    norms = [F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2]) for t in O.line_terms(_parts("x"), _parts("y"))]
    names = ["line_" + "_".join(map(str, line)) for line in O.LINES]
    rows = products.select(*keys, *[n.alias(c) for c, n in zip(names, norms)])
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), *[f(c).alias(f"{c}_{s}") for c in names for s, f in (("total", F.sum), ("mean", F.avg), ("max", F.max))])
    whole = sum((F.col(f"{c}_total") for c in names[1:]), F.col(f"{names[0]}_total"))
    agg = agg.withColumn("total", whole)
    share = {c: F.when(F.col("total") > 0, F.col(f"{c}_total") / F.when(F.col("total") > 0, F.col("total"))).otherwise(0.0) for c in names}
    agg = agg.select("*", *[share[c].alias(f"{c}_share") for c in names])
    bits = sum((F.when(F.col(f"{c}_share") > 0, -F.col(f"{c}_share") * F.log(F.when(F.col(f"{c}_share") > 0, F.col(f"{c}_share")))).otherwise(0.0) for c in names), F.lit(0.0))
    # shares are compared at twelve decimals, so that sums in another order leave the tie a tie
    best = F.array_max(F.array(*[F.struct(F.round(f"{c}_share", 12).alias("share"), F.lit(-i).alias("i"), F.lit(c).alias("line")) for i, c in enumerate(names)]))
    square = sum((F.col(f"{c}_share") * F.col(f"{c}_share") for c in names), F.lit(0.0))
    return agg.select("*", (bits / F.log(F.lit(7.0))).alias("line_entropy"), F.sqrt(square).alias("line_concentration"), F.when(F.col("total") > 0, best["line"]).alias("dominant_line"), F.greatest(*[F.col(f"{c}_share") for c in names]).alias("dominant_share"))


def axis_shares(features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, share_e1..share_e7, dominant_axis, dominant_axis_share from :func:`line_features`: each line counts for its three axes.

    Shares add up to 1 (0 without any norm). Of equal axes the first is dominant.
    """
    share = {a: sum((F.col("line_" + "_".join(map(str, line)) + "_share") for line in O.LINES if a in line), F.lit(0.0)) / 3.0 for a in range(1, 8)}
    rows = features.select(*keys, "total", *[v.alias(f"share_e{a}") for a, v in share.items()])
    best = F.array_max(F.array(*[F.struct(F.round(f"share_e{a}", 12).alias("share"), F.lit(-a).alias("i")) for a in share]))
    return rows.select(*keys, *[f"share_e{a}" for a in share], F.when(F.col("total") > 0, F.concat(F.lit("e"), (-best["i"]).cast("string"))).alias("dominant_axis"), F.greatest(*[F.col(f"share_e{a}") for a in share]).alias("dominant_axis_share"))


def trajectory_summary(df: DataFrame, keys: list[str], position: str, row_id: str) -> DataFrame:
    """Per key: units, mean and greatest transition and associator score (0 without any), mean and deviation of e0..e7.

    Only complete units count. Deviations are those of the population.
    """
    rows, _ = in_chunks(complete(df.select(*keys, position, row_id, *O.AXES), keys, position), keys, position, row_id, 0)
    units = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), *[f(e).alias(f"{s}_{e}") for e in O.AXES for s, f in (("mean", F.avg), ("std", F.stddev_pop))])
    moves = adjacent_products(df, keys, position, row_id).groupBy(*keys).agg(F.avg("transition_score").alias("mean_transition"), F.max("transition_score").alias("max_transition"))
    turns = adjacent_triplets(df, keys, position, row_id).groupBy(*keys).agg(F.avg("associator_score").alias("mean_associator"), F.max("associator_score").alias("max_associator"))
    scores = ["mean_transition", "max_transition", "mean_associator", "max_associator"]
    return units.join(moves, keys, "left").join(turns, keys, "left").fillna(0.0, subset=scores)


def strongest(products: DataFrame, keys: list[str], position: str, n: int) -> DataFrame:
    """The n pairs with the greatest transition score of the whole table; ties go to the lesser key and position."""
    return products.orderBy(F.desc("transition_score"), *keys, position).limit(n)


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], buckets: int = 64) -> DataFrame:
    """keys and q0, q1, ... : exact quantiles by linear interpolation, for groups of any size.

    Equal values of a group are counted first. Groups with up to MOST_HELD different values are then held in one
    aggregate each. For larger ones approximate quantiles of the different values part these into buckets of
    alike size, wherever they lie; the buckets' counts tell in which of them each wanted rank lies, and only the
    different values of such buckets are ordered. Null and NaN values are left out; a group without
    a value gives no row.
    """
    counts = cut(df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    large = cut(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > MOST_HELD).select(*keys), "large")
    some = bool(large.take(1))
    small = counts.join(large, keys, "left_anti") if some else counts
    held = small.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs]), F.col("_n")).alias("_q")).select(*keys, *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])
    return held.unionByName(_large_quantiles(cut(counts.join(large, keys, "left_semi"), "large"), keys, probs, buckets)) if some else held


def _large_quantiles(counts: DataFrame, keys: list[str], probs: list[float], buckets: int) -> DataFrame:
    edges = F.percentile_approx("_v", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000))
    ranges = counts.groupBy(*keys).agg(edges.alias("_edges"), F.sum("_n").alias("_all"))
    bucket = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    placed = cut(skew_join(counts, ranges, keys).withColumn("_b", bucket).drop("_edges"), "values")
    hist = placed.groupBy(*keys, "_b", "_all").agg(F.sum("_n").alias("_bn"))
    hist = hist.withColumn("_before", F.sum("_bn").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_bn"))
    ranks = [F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), f(F.lit(p) * (F.col("_all") - 1)).cast("long").alias("rank")) for i, p in enumerate(probs) for side, f in ((0, F.floor), (1, F.ceil))]
    wanted = hist.select(*keys, "_b", "_before", "_bn", F.explode(F.array(*ranks)).alias("r")).where((F.col("r.rank") >= F.col("_before")) & (F.col("r.rank") < F.col("_before") + F.col("_bn")))
    few = wanted.select(*keys, "_b").distinct()
    ordered = placed.join(few, [*keys, "_b"], "left_semi")
    ordered = ordered.withColumn("_first", F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy("_v")) - F.col("_n"))
    hit = wanted.join(ordered.select(*keys, "_b", "_v", "_first", "_n"), [*keys, "_b"]).where((F.col("r.rank") - F.col("_before") >= F.col("_first")) & (F.col("r.rank") - F.col("_before") < F.col("_first") + F.col("_n")))
    found = hit.join(ranges.select(*keys, "_all"), keys).groupBy(*keys, "_all").agg(*[F.max(F.when((F.col("r.q") == i) & (F.col("r.side") == s), F.col("_v"))).alias(f"_{i}_{s}") for i in range(len(probs)) for s in (0, 1)])
    out = []
    for i, p in enumerate(probs):
        h = F.lit(p) * (F.col("_all") - 1)
        out.append((F.col(f"_{i}_0") + (h - F.floor(h)) * (F.col(f"_{i}_1") - F.col(f"_{i}_0"))).alias(f"q{i}"))
    return found.select(*keys, *out)
