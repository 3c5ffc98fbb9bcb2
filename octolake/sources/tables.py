"""Tables in and out: delimited text and Parquet, bundles with a manifest, and tensors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.functions.octonion import AXES
from octolake.operators.trajectory import dense_positions

DIGITS = 6


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: .tsv and .csv with a header and NA for null, .parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("tsv", "csv"):
        return spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True, inferSchema=True, nullValue="NA")
    raise ValueError(f"unknown kind of table: {path}")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """DOUBLE and FLOAT columns rounded half to even."""
    return df.select(*[F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str, digits: int = DIGITS) -> None:
    """Write by suffix, rounded: .tsv and .csv with a header and NA for null, .parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    out = rounded(df, digits).write.mode("overwrite")
    if kind == "parquet":
        out.parquet(path)
    elif kind in ("tsv", "csv"):
        out.csv(path, sep="\t" if kind == "tsv" else ",", header=True, nullValue="NA")
    else:
        raise ValueError(f"unknown kind of table: {path}")


def write_bundle(tables: dict[str, DataFrame], folder: str, cluster_by: str | None = "sequence_id") -> dict:
    """Each table as Parquet under ``folder``, sorted by a column within files, and a manifest of rows and columns.

    Rows are counted from the written files' own counts. Files are clustered by the column rather than one folder a value, which
    would make a file for each sequence; row groups are then pruned by their statistics.
    """
    manifest: dict = {}
    for name, df in tables.items():
        out = df
        if cluster_by and cluster_by in df.columns:
            out = out.sortWithinPartitions(cluster_by)
        out.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        manifest[name] = {"rows": df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}.parquet").count(), "columns": df.columns}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return manifest


def tensor(df: DataFrame, key: str, position: str, length: int) -> DataFrame:
    """(key, n, tensor): trajectories as 8 x ``length`` arrays of FLOAT, cut or padded with zeros at the end.

    The first ``length`` units of a key are gathered in order, gaps closed, so a very long trajectory stays bounded in a
    task. A position that was delivered several times counts once; n counts all units.
    """
    ranked = dense_positions(df.select(key, position, F.col(position).alias("_row"), *AXES), [key], position, "_row", "_at")
    unit = F.struct(F.col("_at").alias("at"), *[F.col(e).cast("float").alias(e) for e in AXES])
    packed = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("_at") < length, unit))).alias("us"))
    empty = F.array_repeat(F.lit(0.0).cast("float"), length)

    def row(axis: str) -> Column:
        return F.slice(F.concat(F.transform("us", lambda u: u[axis]), empty), 1, length)

    return packed.select(key, "n", F.array(*map(row, AXES)).alias("tensor"))
