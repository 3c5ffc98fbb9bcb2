"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = T.StructType([T.StructField("sequence_id", T.StringType()), T.StructField("description", T.StringType()), T.StructField("sequence", T.StringType())])


def _parsed(raw: Column) -> list[Column]:
    """Id, description and sequence of one record's text, without its ``>``.

    Lines are stripped and joined, blanks and tabs inside the sequence dropped, case kept; the id is the header's first
    word. Text before the first header, a header without an id and a record without symbols raise an error.
    """
    text = F.regexp_replace(raw, r"\r", "")
    head = F.trim(F.regexp_extract(text, r"^([^\n]*)", 1))
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)^[^\n]*\n?(.*)$", 1), r"\s+", "")
    name = F.regexp_extract(head, r"^(\S+)", 1)
    checked = F.when(name == "", F.raise_error(F.lit("FASTA record with an empty header"))).otherwise(name)
    symbols = F.when(body == "", F.raise_error(F.concat(F.lit("FASTA record without symbols: "), head))).otherwise(body)
    return [checked.alias("sequence_id"), head.alias("description"), symbols.alias("sequence")]


def read_fasta(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(sequence_id, description, sequence) of all FASTA files at a path; a file is split at its records' ``>``.

    Ids that occur twice are kept twice. A missing path, a path without records, and, by a pass over the files that
    ``check`` can leave out, a file with text before its first header or with an empty header are errors at once.
    Records without an id or without symbols are errors when they are read.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    if check:
        bare = F.regexp_replace("value", r"^\s+", "")
        # the separator takes the > of all records but a file's first, before which there may be blank lines
        files = raw.select(F.col("_metadata.file_path").alias("file"), bare.startswith(">").alias("first"), (bare == "").alias("blank")).groupBy("file").agg(F.sum(F.col("first").cast("long")).alias("first"), F.sum(F.col("blank").cast("long")).alias("blank"), F.count(F.lit(1)).alias("n"))
        whole = files.agg(F.sum(F.col("n") - F.col("blank"))).first()[0]
        if not whole:
            raise ValueError(f"no FASTA records in {path}")
        bad = files.where("blank > 1 or (first > 0 and blank > 0) or (first = 0 and blank = 0)").limit(3).collect()
        if bad:
            raise ValueError(f"text before the first header or an empty record: {', '.join(r['file'] for r in bad)}")
    return fasta_records(raw, F.col("value"))


def fasta_records(raw: DataFrame, value: Column) -> DataFrame:
    """Records of a DataFrame of texts cut at line ends that precede ``>``: the first of a file still has its ``>``."""
    text = F.regexp_replace(value, r"^\s+", "")
    rows = raw.select(text.alias("t")).where(F.length("t") > 0)
    return rows.select(F.regexp_replace("t", r"^>", "").alias("t")).select(*_parsed(F.col("t")))


def write_fasta(df: DataFrame, path: str, width: int = 70) -> None:
    """``>description`` (or the id where it is null) and the sequence in lines of ``width``."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.coalesce(F.col("description"), F.col("sequence_id")), F.lit("\n"), lines)).write.mode("overwrite").text(path)


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class FastaDataSource(DataSource):
    """``spark.read.format("fasta").load(folder)``: a file per partition, records read as a stream, never whole files.

    :func:`read_fasta` is the faster way, for it stays in the JVM and splits large files; this one is for files with
    text before the first header or records that aren't set off by a line end, which it reports by file name.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FastaReader(self.options["path"])


class _FastaReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(p for p in (glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path)) if os.path.isfile(p))
        if not found:
            raise FileNotFoundError(self.path)
        return [_Part(p) for p in found]

    def read(self, partition: InputPartition):
        head, parts = None, []
        with open(partition.path) as f:
            for line in map(str.strip, f):
                if line.startswith(">"):
                    if head is not None:
                        yield self._record(partition.path, head, parts)
                    head, parts = line[1:].strip(), []
                elif line:
                    if head is None:
                        raise ValueError(f"{partition.path}: text before the first header")
                    parts.append(line)
        if head is not None:
            yield self._record(partition.path, head, parts)

    @staticmethod
    def _record(path: str, head: str, parts: list[str]) -> tuple[str, str, str]:
        body = "".join("".join(parts).split())
        if not head or not body:
            raise ValueError(f"{path}: record with an empty header or without symbols: {head!r}")
        return head.split()[0], head, body
