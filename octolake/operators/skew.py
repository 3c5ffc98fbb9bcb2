"""Per-key work that stays even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octolake.sources.shared import cut

#: A key is heavy when it holds at least this share of the rows, so there are at most HEAVY_LIMIT heavy keys.
HEAVY_SHARE = 1 / 1000
HEAVY_LIMIT = 1000


def heavy_keys(df: DataFrame, keys: list[str], least: int = 100_000) -> list[Row]:
    """Keys with at least ``HEAVY_SHARE`` of the rows and at least ``least`` rows: HEAVY_LIMIT at most, whatever the input.

    One pass counts the keys, with partial counts in every split; the rows of all keys with fewer than ``least`` come as
    one sum, so the total needs no pass of its own. Null keys aren't heavy.
    """
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    many = F.when(F.col("_n") >= least, F.struct(*keys)).alias("_key")
    sums = counts.select(many, "_n").groupBy("_key").agg(F.sum("_n").alias("_n"))
    top = sums.orderBy(F.col("_key").isNull().desc(), F.desc("_n")).limit(HEAVY_LIMIT + 1).collect()
    total = sum(r["_n"] for r in top)
    return [r["_key"] for r in top if r["_key"] is not None and r["_n"] >= total * HEAVY_SHARE][:HEAVY_LIMIT]


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", least: int = 100_000, heavy: list[Row] | None = None) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per key, without sending a heavy key to one task.

    Rows of heavy keys meet a broadcast of at most HEAVY_LIMIT rows; all others are joined by a shuffle.
    ``how`` is ``inner`` or ``left``. Null keys match nothing and are kept by ``left``. ``heavy`` names the heavy keys
    (at most HEAVY_LIMIT) where the caller knows them; otherwise the keys of ``left`` are counted.
    """
    if heavy is None:
        heavy = heavy_keys(left, keys, least)
    if len(heavy) > HEAVY_LIMIT:
        raise ValueError(f"more than {HEAVY_LIMIT} heavy keys")
    if not heavy:
        return left.join(right, keys, how)
    small = left.sparkSession.createDataFrame(heavy, left.select(*keys).schema)
    flag = small.withColumn("_heavy", F.lit(True))
    marked = left.join(F.broadcast(flag), keys, "left")
    light = marked.where(F.col("_heavy").isNull()).drop("_heavy").join(right, keys, how)
    few = right.join(F.broadcast(small), keys, "left_semi")
    dense = marked.where(F.col("_heavy")).drop("_heavy").join(F.broadcast(few), keys, how)
    return light.unionByName(dense.select(*light.columns))


def dense_key_sums(df: DataFrame, key: str, values: list[str], blocks: int | None = None) -> DataFrame:
    """Count, and per value column the non-null count, sum, and sum of squared deviations from the mean, for each key.

    Every input split dictionary-encodes its keys and adds its rows into dense arrays with ``bincount``; it sends one
    row per key, however many rows the key has. Those array rows are then grouped into blocks by a hash of the key, and
    each block is encoded and added up the same way. A key with a third of all rows thus costs each task the same as any
    other rows, and the reducers see at most one row per split and key. Deviations are merged from means and deviations
    of parts, not from sums of squares, so values far from 0 lose nothing.

    Null keys form their own row. Null and NaN values are left out of the sums. An empty table gives no rows.
    Extra columns are ignored. The columns are ``key``, ``n`` and, for each value v, ``v_n``, ``v_sum``, ``v_m2``.
    """
    stats = [f"{v}_{s}" for v in values for s in ("n", "sum", "m2")]
    work = df.select(F.col(key).cast("string").alias("_key"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("n", T.DoubleType()), *[T.StructField(s, T.DoubleType()) for s in stats]])
    arrow = pa.schema([("_key", pa.string()), ("n", pa.float64()), *[(s, pa.float64()) for s in stats]])
    width = 1 + len(stats)

    def emit(words: list, block: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array(block[:, i]) for i in range(width)]], schema=arrow)

    def encoded(column: pa.Array, known: dict) -> np.ndarray:
        coded = column.dictionary_encode(null_encoding="encode")
        local = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return local[coded.indices.to_numpy(zero_copy_only=False)]

    def added(total: np.ndarray, codes: np.ndarray, batch: pa.RecordBatch, parts) -> None:
        size = len(total)
        total[:, 0] += np.bincount(codes, weights=parts(batch, None), minlength=size)
        for i in range(len(values)):
            n, s, m = parts(batch, i)
            bn, bs = (np.bincount(codes, weights=w, minlength=size) for w in (n, s))
            mean = bs / np.maximum(bn, 1)
            bm = np.bincount(codes, weights=m + n * (s / np.maximum(n, 1) - mean[codes]) ** 2, minlength=size)
            at = 1 + 3 * i
            own = total[:, at]
            gap = mean - total[:, at + 1] / np.maximum(own, 1)
            total[:, at + 2] += bm + gap**2 * own * bn / np.maximum(own + bn, 1)
            total[:, at] += bn
            total[:, at + 1] += bs

    def folded(batches: Iterator[pa.RecordBatch], parts) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        total = np.zeros((0, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = encoded(batch.column(0), known)
            if len(known) > len(total):
                total = np.vstack([total, np.zeros((max(len(known), 2 * len(total)) - len(total), width))])
            added(total, codes, batch, parts)
            if len(known) >= 200_000:  # a split with very many keys sends what it has and starts anew
                yield emit(list(known), total[: len(known)])
                known, total = {}, np.zeros((0, width))
        if known:
            yield emit(list(known), total[: len(known)])

    def rows(batch: pa.RecordBatch, i: int | None):
        if i is None:
            return np.ones(batch.num_rows)
        x = batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float)
        good = ~np.isnan(x)
        return good.astype(float), np.where(good, x, 0.0), np.zeros(len(x))

    def partials(batch: pa.RecordBatch, i: int | None):
        column = lambda c: batch.column(1 + c).to_numpy()
        return column(0) if i is None else tuple(column(1 + 3 * i + k) for k in range(3))

    local = work.mapInArrow(lambda it: folded(it, rows), schema)
    spread = local.repartition(blocks, F.xxhash64("_key")) if blocks else local.repartition(F.xxhash64("_key"))
    whole = spread.mapInArrow(lambda it: folded(it, partials), schema)
    # a block with very many keys may send a key twice: few rows a key, joined without another shuffle of rows
    sums: list[Column] = [F.sum(c).alias(c) for c in ["n", *[s for s in stats if not s.endswith("_m2")]]]
    lists = [F.collect_list(F.struct(*[F.col(f"{v}_{s}").alias(s) for s in ("n", "sum", "m2")])).alias(f"_l{i}") for i, v in enumerate(values)]
    result = whole.groupBy("_key").agg(*sums, *lists)
    def merged(i: int, v: str) -> Column:
        n = F.col(f"{v}_n")
        mean = F.when(n > 0, F.col(f"{v}_sum") / F.when(n > 0, n)).otherwise(0.0)
        gap = lambda p: p["sum"] / F.greatest(p["n"], F.lit(1.0)) - mean
        return F.aggregate(f"_l{i}", F.lit(0.0), lambda t, p: t + p["m2"] + p["n"] * gap(p) * gap(p))

    out = [F.col("n").cast("long").alias("n")]
    for i, v in enumerate(values):
        out += [F.col(f"{v}_n").cast("long").alias(f"{v}_n"), F.col(f"{v}_sum"), merged(i, v).alias(f"{v}_m2")]
    return result.select(F.col("_key").alias(key), *out)


def key_profile(df: DataFrame, row_id: str, key: str, values: list[str]) -> DataFrame:
    """Per key: rows, and mean and population deviation of each value, over the table's distinct rows.

    Repeated deliveries of a row (the same ``row_id``) count once; the shuffle on ``row_id`` also makes the splits equal.
    Rows without an id are kept as they are. Null keys form one row. Means over no value are null.
    """
    known = df.select(row_id, key, *values)
    rows = known.where(F.col(row_id).isNotNull()).dropDuplicates([row_id]).unionByName(known.where(F.col(row_id).isNull()))
    sums = dense_key_sums(rows, key, values)
    out = [F.col(key), F.col("n").alias("n_rows")]
    for v in values:
        n, s, m2 = F.col(f"{v}_n"), F.col(f"{v}_sum"), F.col(f"{v}_m2")
        out += [F.when(n > 0, s / F.when(n > 0, n)).alias(f"mean_{v}"), F.when(n > 0, F.sqrt(m2 / F.when(n > 0, n))).alias(f"std_{v}")]
    return sums.select(*out)


def hot_keys(df: DataFrame, row_id: str, key: str, share: float) -> DataFrame:
    """Non-null keys that hold at least ``share`` of the distinct rows (null keys count in the total), with their rows.

    An empty table gives no rows.
    """
    counts = cut(key_profile(df, row_id, key, []), "counts")  # a row a key, read for the total and for the keys
    total = counts.agg(F.sum("n_rows").alias("_total"))
    return (
        counts.where(F.col(key).isNotNull())
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("n_rows") >= share * F.col("_total"))
        .select(key, "n_rows")
    )


def running_totals(df: DataFrame, keys: list[str], order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``df`` with ``before_<c>``: per key the sum of c over the rows that come earlier by ``order``, which must be unique in a key.

    Rows are cut into ranges of (key, order) from a sample, so ranges hold alike many rows however the values lie; each
    range is summed in order by itself and starts from the totals of the key's ranges before it. No task orders a whole
    key.
    """
    by = F.desc(order) if descending else F.asc(order)
    ranged = cut(df.repartitionByRange(*keys, by).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    whole = W.partitionBy(*keys).orderBy("_part") if keys else W.partitionBy(F.lit(0)).orderBy("_part")  # a row a range
    starts = totals.select(*keys, "_part", *[(F.sum(f"_t_{c}").over(whole) - F.col(f"_t_{c}")).alias(f"_s_{c}") for c in columns])
    inside = W.partitionBy(*keys, "_part").orderBy(by)
    summed = ranged.select("*", *[(F.sum(c).over(inside) - F.col(c)).alias(f"_o_{c}") for c in columns])
    return summed.join(starts, [*keys, "_part"]).select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_s_{c}")).alias(f"before_{c}") for c in columns])
