"""Incremental forms: records are encoded as their files arrive; events are summed in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octolake.operators import sequences as Q
from octolake.sources.fasta import fasta_records


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """FASTA records of new files in a folder."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    return fasta_records(spark.readStream.schema(schema).option("lineSep", "\n>").text(folder), F.col("value"))


def descriptor_stream(records: DataFrame, width: int = 60, step: int = 30) -> DataFrame:
    """Window descriptors of streamed records: narrow and stateless, so it runs in append mode."""
    clean = records.select("sequence_id", F.upper(F.regexp_replace("sequence", r"\s+", "")).alias("sequence"))
    return Q.window_descriptors(clean, width, step)


def event_window_sums(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per event-time window; events later than the watermark are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
