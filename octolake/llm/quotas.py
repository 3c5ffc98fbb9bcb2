"""A sample that matches target category shares: acceptance by hash, then exact correction, with a report of deficits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from octolake.sources.shared import cut

FIELDS = ("label", "chromosome", "gc_bin")
#: Rows accepted beyond a target's wanted rows: this share, and this many standard deviations.
OVERSAMPLE, DEVIATIONS = 0.05, 6.0
#: Wanted rows for each step of the histogram by which counts are corrected, and its largest number of steps.
STEP_ROWS, MOST_STEPS = 500, 1 << 20
#: More targets than this are joined by a shuffle instead of a broadcast.
BROADCAST_TARGETS = 100_000


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s -]+", "")


def chromosome_key(c: Column) -> Column:
    return F.regexp_replace(label_key(c), "^chr", "")


def _keys(df: DataFrame) -> list[Column]:
    return [label_key(F.col("label")).alias("label"), chromosome_key(F.col("chromosome")).alias("chromosome"), F.col("gc_bin").cast("int").alias("gc_bin")]


def matches(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, sequence_id), once each, of the rows that equal a target in all its non-null fields.

    Null fields of a row match no value; a target without any field takes every row. Targets with the same fields set
    are one equi-join, so there are at most eight, each with a broadcast while the targets are few.
    """
    ids = rows.where(F.col("sequence_id").isNotNull()).select("sequence_id", *_keys(rows)).distinct()
    wanted = targets.where(F.col("target_id").isNotNull()).select("target_id", *_keys(targets)).distinct()
    size = wanted.groupBy(*[F.col(f).isNotNull().alias(f) for f in FIELDS]).count().collect()  # at most eight rows
    few = sum(r["count"] for r in size) <= BROADCAST_TARGETS
    found = []
    for shape in size:
        fields = [f for f in FIELDS if shape[f]]
        some = wanted.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() if shape[f] else F.col(f).isNull() for f in FIELDS])).select("target_id", *fields)
        some = F.broadcast(some) if few else some
        found.append((ids.select("sequence_id", *fields).distinct().join(some, fields) if fields else ids.select("sequence_id").distinct().crossJoin(some)).select("target_id", "sequence_id"))
    return reduce(DataFrame.unionByName, found).distinct() if found else ids.join(wanted, ids.sequence_id.isNull() & wanted.target_id.isNull()).select("target_id", "sequence_id")


def balanced(plan: DataFrame) -> DataFrame:
    """``plan`` with ``drawn``: rows of each target that together make up the request's sample.

    A target draws at least min_rows and at most what is available, and between the two a common multiple of its share:
    what one target takes for its least rows, or leaves for want of rows, the request's others give or take in
    proportion to their shares. The multiple is solved from the points at which targets reach their bounds. Fractions go
    to the largest remainders. If the least rows of all targets pass the sample, they are drawn none the less.
    """
    rows = plan.withColumn("_s", F.col("target_share") * F.col("sample_size")).withColumn("_lo", F.least("min_rows", "available")).withColumn("_hi", F.when(F.col("_s") > 0, F.col("available")).otherwise(F.col("_lo")))
    sums = rows.groupBy("request_id").agg(F.sum("_lo").alias("_base"), F.greatest(F.sum("_lo"), F.least(F.max("sample_size"), F.sum("_hi"))).alias("_total"))
    points = rows.where("_s > 0").select("request_id", F.explode(F.array(*[F.struct((F.col(b) / F.col("_s")).alias("at"), (F.col("_s") * sign).alias("ds"), (F.col(b) * sign).alias("dt")) for b, sign in (("_lo", 1), ("_hi", -1))])).alias("p")).select("request_id", "p.*")
    w = W.partitionBy("request_id").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    running = points.select("request_id", "at", F.sum("ds").over(w).alias("slope"), F.sum("dt").over(w).alias("_t"))
    same = F.col("request_id").eqNullSafe(F.col("_r"))
    filled = running.join(sums.withColumnRenamed("request_id", "_r"), same).withColumn("sum", F.col("_base") + F.col("slope") * F.col("at") - F.col("_t"))
    last = filled.where(F.col("sum") <= F.col("_total") + 1e-6).groupBy("request_id").agg(F.max(F.struct("at", "sum", "slope", "_total")).alias("x"))
    step = F.when(F.col("x.slope") > 1e-9, (F.col("x._total") - F.col("x.sum")) / F.when(F.col("x.slope") > 1e-9, F.col("x.slope"))).otherwise(0.0)
    factor = last.select(F.col("request_id").alias("_r"), (F.col("x.at") + step).alias("_factor"))
    with_factor = rows.join(factor, same, "left").drop("_r").join(sums.withColumnRenamed("request_id", "_r"), same).drop("_r")
    exact = F.greatest(F.col("_lo").cast("double"), F.least(F.col("_hi").cast("double"), F.coalesce(F.col("_factor"), F.lit(0.0)) * F.col("_s")))
    floored = with_factor.withColumn("_exact", exact).withColumn("_floor", F.floor(F.col("_exact") + 1e-6)).withColumn("_part", F.round(F.greatest(F.lit(0.0), F.col("_exact") - F.col("_floor")), 6))
    per = W.partitionBy("request_id")
    missing = F.col("_total") - F.sum("_floor").over(per)
    rank = F.row_number().over(per.orderBy(F.desc("_part"), "target_id"))
    extra = ((rank <= missing) & (F.col("_floor") < F.col("_hi"))).cast("long")
    return floored.withColumn("drawn", F.col("_floor") + extra).drop("_s", "_lo", "_hi", "_factor", "_base", "_total", "_exact", "_floor", "_part")


def quota_plan(rows: DataFrame, targets: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Per target: wanted (its share of the sample, at least min_rows), available, drawn, acceptance probability, deficits.

    available counts distinct sequences. ``short`` marks targets that cannot be met: fewer available than min_rows or
    than target_share x sample_size; ``deficit`` are the wanted rows that aren't available. ``drawn`` is what
    :func:`balanced` gives the target of its request's sample. Repeated targets count once; null shares and sizes count
    as 0; targets without a request are one request.
    """
    asked = targets.where(F.col("target_id").isNotNull()).dropDuplicates(["target_id"]).select(
        "target_id",
        "request_id",
        F.coalesce(F.col("sample_size"), F.lit(0)).alias("sample_size"),
        F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("min_rows"), F.lit(0)).alias("min_rows"),
    )
    counts = (matches(rows, targets) if matched is None else matched).groupBy("target_id").agg(F.count(F.lit(1)).alias("available"))
    exact = F.col("target_share") * F.col("sample_size")
    plan = asked.join(counts, "target_id", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    plan = balanced(plan.withColumn("wanted", F.greatest(F.round(exact).cast("long"), F.col("min_rows"))))
    ask = F.col("drawn") * (1 + OVERSAMPLE) + DEVIATIONS * F.sqrt(F.col("drawn").cast("double")) + DEVIATIONS
    return plan.select(
        "target_id", "request_id", "sample_size", "target_share", "min_rows", "available", "wanted", "drawn",
        F.when(F.col("available") > 0, F.least(F.lit(1.0), ask / F.when(F.col("available") > 0, F.col("available")))).otherwise(0.0).alias("acceptance"),
        F.greatest(F.lit(0), F.col("wanted") - F.col("available")).alias("deficit"),
        ((F.col("available") < F.col("min_rows")) | (F.col("available") < exact)).alias("short"),
    )


def quota_sample(rows: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(target_id, request_id, sequence_id): exactly ``drawn`` sequences of each target of :func:`quota_plan`.

    Each sequence is accepted by its own hash with the target's probability, which takes a little more than wanted.
    Counts are then corrected through a histogram of the hashes: whole steps below the cut are kept, and only the rows
    of the step that holds the cut are ranked, so no task sorts a whole category. Should acceptance fall short, which
    six deviations make all but impossible, the rest of that target is taken in hash order from all its rows.
    """
    return _drawn(rows, targets, seed)[0]


def _drawn(rows: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sample and the plan, from one search for matches, which is written to the shared folder."""
    matched = cut(matches(rows, targets), "matches")
    whole = cut(quota_plan(rows, targets, matched), "quotas")
    plan = whole.select("target_id", "request_id", "available", "drawn", "acceptance").where("drawn > 0")
    few = whole.count() <= BROADCAST_TARGETS
    u = (F.pmod(F.xxhash64(F.lit(seed), "target_id", "sequence_id"), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    drawn = matched.withColumn("u", u).join(F.broadcast(plan) if few else plan, "target_id")
    taken = drawn.where("u < acceptance")
    got = taken.groupBy("target_id").agg(F.count(F.lit(1)).alias("_got"))
    lacking = plan.join(got, "target_id", "left").where(F.coalesce("_got", F.lit(0)) < F.col("drawn")).select("target_id")
    if lacking.take(1):
        taken = taken.unionByName(drawn.where("u >= acceptance").join(lacking, "target_id", "left_semi"))
    steps = F.greatest(F.lit(1), F.least(F.lit(MOST_STEPS), F.ceil(F.col("available") / STEP_ROWS))).cast("long")
    stepped = taken.withColumn("step", F.floor(F.col("u") * steps).cast("long"))
    hist = stepped.groupBy("target_id", "step").agg(F.count(F.lit(1)).alias("_n"))
    below = hist.withColumn("_below", F.sum("_n").over(W.partitionBy("target_id").orderBy("step")) - F.col("_n"))
    placed = stepped.join(below.select("target_id", "step", "_n", "_below"), ["target_id", "step"])
    kept = placed.where(F.col("_below") + F.col("_n") <= F.col("drawn"))
    edge = placed.where((F.col("_below") < F.col("drawn")) & (F.col("_below") + F.col("_n") > F.col("drawn")))
    ranked = edge.withColumn("_rank", F.row_number().over(W.partitionBy("target_id").orderBy("u", "sequence_id")))
    out = ["target_id", "request_id", "sequence_id"]
    return kept.select(*out).unionByName(ranked.where(F.col("_below") + F.col("_rank") <= F.col("drawn")).select(*out)), whole


def quota_report(rows: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """:func:`quota_plan` with the sequences that :func:`quota_sample` in fact drew, as ``sampled``, and their share.

    ``short`` is decided by what the sample could be drawn from; ``reached_share`` is the target's share of the rows
    drawn for its request, to be held against target_share.
    """
    sample, plan = _drawn(rows, targets, seed)
    got = sample.groupBy("target_id").agg(F.count(F.lit(1)).alias("sampled"))
    counted = plan.join(got, "target_id", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    whole = counted.groupBy(F.col("request_id").alias("_r")).agg(F.sum("sampled").alias("_all"))
    share = F.when(F.col("_all") > 0, F.col("sampled") / F.when(F.col("_all") > 0, F.col("_all"))).otherwise(0.0)
    return counted.join(whole, F.col("request_id").eqNullSafe(F.col("_r"))).withColumn("reached_share", share).drop("_r", "_all")


def sample_check(rows: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(target_id, rows, strangers) of the sample: its rows per target, and those that are repeated or don't match it."""
    sample = cut(_drawn(rows, targets, seed)[0], "sample")
    known = matches(rows, targets).withColumn("_known", F.lit(1))
    per = sample.groupBy("target_id", "sequence_id").agg(F.count(F.lit(1)).alias("n")).join(known, ["target_id", "sequence_id"], "left")
    wrong = F.when(F.col("_known").isNull(), F.col("n")).otherwise(F.col("n") - 1)
    return per.groupBy("target_id").agg(F.sum("n").alias("rows"), F.sum(wrong).alias("strangers"))
