"""Problem 3: per-sequence results of the trajectory tables, in which a few sequences hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolake.operators.skew import hot_keys, key_profile

TABLES = (("window_octonions", "window_id"), ("codon_octonions", "codon_row_id"))
HOT_SHARE = 0.03
#: Moves means of six-decimal values off the ties of rounding, where the order of a sum would decide.
NUDGE = 1e-10
AXES = [f"e{i}" for i in range(8)]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [hot_keys(spark.read.parquet(f"{folder}/{t}.parquet"), row_id, "sequence_id", HOT_SHARE).select(F.lit(t).alias("table_name"), "sequence_id") for t, row_id in TABLES]
    return found[0].unionByName(found[1])


def _profile(table: str, row_id: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = key_profile(spark.read.parquet(f"{folder}/{table}.parquet"), row_id, "sequence_id", AXES)
        return rows.select("sequence_id", "n_rows", *[F.round(F.col(c) + NUDGE, 6).alias(c) for c in rows.columns[2:]])

    return query


def _profile_sql(table: str, row_id: str) -> str:
    cols = ", ".join(f"round(avg({e}) + {NUDGE}, 6) AS mean_{e}, round(stddev_pop({e}) + {NUDGE}, 6) AS std_{e}" for e in AXES)
    return f"SELECT sequence_id, count(*) AS n_rows, {cols} FROM (SELECT DISTINCT {row_id}, sequence_id, {', '.join(AXES)} FROM {table}) GROUP BY sequence_id"


QUERIES = {
    "p3_found": p3_found,
    "p3_window_profile": _profile("window_octonions", "window_id"),
    "p3_codon_profile": _profile("codon_octonions", "codon_row_id"),
}
SQL = {
    "p3_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, sequence_id FROM (SELECT sequence_id, count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT DISTINCT {r}, sequence_id FROM {t}) GROUP BY sequence_id) WHERE sequence_id IS NOT NULL AND n >= {HOT_SHARE} * total"
        for t, r in TABLES
    ),
    "p3_window_profile": _profile_sql("window_octonions", "window_id"),
    "p3_codon_profile": _profile_sql("codon_octonions", "codon_row_id"),
}
