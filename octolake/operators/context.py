"""Joins of sequences with labels, groups, splits and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolake.operators.skew import skew_join


def assigned_clusters(metadata: DataFrame, clusters: DataFrame) -> DataFrame:
    """(sequence_id, homology_cluster, assigned, conflicts): one cluster for every record of the metadata.

    A record without a cluster is its own (``singleton__<id>``); of several the least is taken and their number given,
    so that a caller can refuse conflicts. Null ids are left out; repeated rows count once.
    """
    ids = metadata.where(F.col("sequence_id").isNotNull()).select("sequence_id").distinct()
    known = clusters.where(F.col("homology_cluster").isNotNull()).groupBy("sequence_id").agg(F.min("homology_cluster").alias("_c"), F.count_distinct("homology_cluster").alias("_k"))
    rows = ids.join(known, "sequence_id", "left")
    return rows.select("sequence_id", F.coalesce("_c", F.concat(F.lit("singleton__"), "sequence_id")).alias("homology_cluster"), F.col("_c").isNotNull().alias("assigned"), (F.coalesce("_k", F.lit(0)) > 1).alias("conflicts"))


def group_leakage(splits: DataFrame) -> DataFrame:
    """(dataset_id, split_group, n_splits, records): groups whose records stand in more than one split of a data set."""
    side = F.lower(F.regexp_replace("split", r"\s+", ""))
    rows = splits.where(F.col("split_group").isNotNull() & F.col("split").isNotNull()).select("dataset_id", "split_group", "sequence_id", F.when(side == "val", "validation").otherwise(side).alias("s")).distinct()
    return rows.groupBy("dataset_id", "split_group").agg(F.count_distinct("s").alias("n_splits"), F.count_distinct("sequence_id").alias("records")).where("n_splits > 1")


def composition_of(metadata: DataFrame, records: DataFrame) -> DataFrame:
    """(dataset_id, label, sequences, without_record, min/mean/max length): what a labelled data set is made of."""
    rows = metadata.select("dataset_id", "label", "sequence_id").where(F.col("sequence_id").isNotNull()).distinct()
    length = records.groupBy("sequence_id").agg(F.max(F.length("sequence")).alias("_len"))
    joined = rows.join(length, "sequence_id", "left")
    return joined.groupBy("dataset_id", "label").agg(
        F.count(F.lit(1)).alias("sequences"), F.sum(F.col("_len").isNull().cast("long")).alias("without_record"), F.min("_len").alias("min_length"), F.avg("_len").alias("mean_length"), F.max("_len").alias("max_length")
    )


def _refuse(bad: DataFrame, what: str) -> None:
    """An error that names some rows, if there are any."""
    found = bad.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {', '.join(str(r.asDict()) for r in found)}")


def labelled_dataset(metadata: DataFrame, records: DataFrame, label: str, group: str | None = None, parent: str | None = None, row_id: str = "sequence_id") -> DataFrame:
    """(id, sequence, label, group) of a labelled data set, refused as a whole if any row of it is unsound.

    An empty table, an id that stands twice in the metadata or the records, a null id, a record that is missing and a
    missing label are errors. A null group falls back to ``parent``; where that is null too it is an error.
    """
    if not metadata.take(1):
        raise ValueError("empty metadata")
    _refuse(metadata.where(F.col(row_id).isNull()), "metadata without an id")
    for table, name in ((metadata, "metadata"), (records, "records")):
        _refuse(table.groupBy(row_id).count().where("count > 1"), f"ids that stand twice in the {name}")
    _refuse(metadata.where(F.col(label).isNull() | (F.trim(label) == "")).select(row_id), "missing labels")
    _refuse(metadata.select(row_id).join(records, row_id, "left_anti"), "ids without a sequence")
    groups = F.coalesce(*[F.col(c) for c in (group, parent) if c]) if group or parent else F.col(row_id)
    rows = metadata.select(row_id, F.col(label).alias("label"), groups.alias("group"))
    _refuse(rows.where(F.col("group").isNull()).select(row_id), "missing groups")
    return rows.join(records.select(row_id, "sequence"), row_id)


def dataset_problems(metadata: DataFrame, records: DataFrame) -> DataFrame:
    """(dataset_id, rows, repeated_ids, missing_labels, missing_subjects, without_record) of every data set, for a look before it is refused."""
    rows = metadata.select("dataset_id", "sequence_id", "label", "species_or_subject")
    repeated = rows.groupBy("dataset_id", "sequence_id").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset_id").agg(F.sum((F.col("sequence_id").isNotNull() & (F.col("n") > 1)).cast("long")).alias("repeated_ids"))
    known = records.select("sequence_id").distinct().withColumn("_known", F.lit(True))
    blank = lambda c: (F.col(c).isNull() | (F.trim(c) == "")).cast("long")
    counts = rows.join(known, "sequence_id", "left").groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(blank("label")).alias("missing_labels"), F.sum(blank("species_or_subject")).alias("missing_subjects"), F.sum(F.col("_known").isNull().cast("long")).alias("without_record")
    )
    return counts.join(repeated.withColumnRenamed("dataset_id", "_d"), F.col("dataset_id").eqNullSafe(F.col("_d"))).drop("_d")


def validated_context(context: DataFrame) -> DataFrame:
    """The context, or an error: one row a sequence, no nulls, 0 <= start < end, strand +, - or ``.``."""
    columns = ["sequence_id", "genome_build", "chromosome", "start_pos", "end_pos", "strand", "feature_type"]
    _refuse(context.where(F.coalesce(*[F.when(F.col(c).isNull(), F.lit(True)) for c in columns], F.lit(False))).select("sequence_id"), "context with a null")
    sound = (F.col("start_pos") >= 0) & (F.col("start_pos") < F.col("end_pos")) & F.col("strand").isin("+", "-", ".")
    _refuse(context.where(~sound).select("sequence_id", "start_pos", "end_pos", "strand"), "unsound context")
    _refuse(context.groupBy("sequence_id").count().where("count > 1"), "sequences with several contexts")
    return context


def validated_tracks(df: DataFrame, keys: list[str], track: str, value: str) -> DataFrame:
    """The tracks, or an error: one value a key and track, none of them null, NaN or infinite."""
    number = F.col(value).cast("double")
    _refuse(df.where(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))).select(*keys, track, value), "values that are no finite numbers")
    _refuse(df.groupBy(*keys, track).count().where("count > 1"), "tracks with several values")
    return df


def packed_tracks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, e0..e7: up to eight numeric columns as the components of a unit, null and missing ones 0; more are an error."""
    if len(columns) > 8:
        raise ValueError(f"{len(columns)} columns for eight components")
    kinds = dict(df.dtypes)
    wrong = [c for c in columns if kinds[c].split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")]
    if wrong:
        raise ValueError(f"columns that are no numbers: {', '.join(wrong)}")
    return df.select(*keys, *[(F.coalesce(F.col(columns[i]).cast("double"), F.lit(0.0)) if i < len(columns) else F.lit(0.0)).alias(f"e{i}") for i in range(8)])


def in_context(units: DataFrame, row_id: str, context: DataFrame, most: int = 100_000) -> DataFrame:
    """Units with the context of their sequence; a sequence has one valid context (0 <= start < end, strand +, - or .).

    Units of other sequences have null context. Up to ``most`` contexts are broadcast; more are joined by a shuffle
    that keeps heavy sequences apart.
    """
    valid = context.where((F.col("start_pos") >= 0) & (F.col("start_pos") < F.col("end_pos")) & F.col("strand").isin("+", "-", "."))
    one = valid.groupBy("sequence_id").agg(*[F.min(c).alias(c) for c in ("genome_build", "chromosome", "strand", "feature_type")])
    rows = units.where(F.col(row_id).isNotNull()).select(row_id, "sequence_id").distinct()
    if one.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(one), "sequence_id", "left")
    return skew_join(rows, one, ["sequence_id"], "left")


def track_pivot(df: DataFrame, keys: list[str], track: str, value: str, tracks: list[str]) -> DataFrame:
    """keys and one column per named track with the sum of its values, 0 without any; other tracks are left out."""
    wanted = df.where(F.col(track).isin(*tracks))
    return wanted.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(track) == t, F.col(value))), F.lit(0.0)).alias(f"track_{t}") for t in tracks])
