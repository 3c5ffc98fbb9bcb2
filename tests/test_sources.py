import datetime as dt

import numpy as np
import pytest

from octolake.sources import fasta, shared, tables
from octolake.streaming import incremental


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


GOOD = ">a first one\nAC gt\n\nTT\n>b\r\nGG\r\n>a again\nC\n"


def test_fasta_both_ways(spark, tmp_path):
    folder = write(tmp_path / "f", "x.fasta", GOOD)
    write(tmp_path / "f", "y.fasta", "\n>c\nNN\n")
    expected = [("a", "a again", "C"), ("a", "a first one", "ACgtTT"), ("b", "b", "GG"), ("c", "c", "NN")]
    assert sorted(map(tuple, fasta.read_fasta(spark, folder).collect())) == expected
    spark.dataSource.register(fasta.FastaDataSource)
    assert sorted(map(tuple, spark.read.format("fasta").load(folder).collect())) == expected


@pytest.mark.parametrize("text", [">\nACGT\n", ">a\n>b\nAC\n"])
def test_bad_fasta_is_refused(spark, tmp_path, text):
    folder = write(tmp_path / "bad", "x.fasta", text)
    with pytest.raises(Exception):
        fasta.read_fasta(spark, folder).collect()
    spark.dataSource.register(fasta.FastaDataSource)
    with pytest.raises(Exception):
        spark.read.format("fasta").load(folder).collect()


def test_text_before_the_header_is_refused(spark, tmp_path):
    folder = write(tmp_path / "early", "x.fasta", "ACGT\n>a\nAC\n")
    spark.dataSource.register(fasta.FastaDataSource)
    with pytest.raises(Exception, match="before the first header"):
        spark.read.format("fasta").load(folder).collect()


@pytest.mark.parametrize("text", ["junk words\nACGT\n>a\nAC\n", "", "\n\n", ">a\nAC\n>\n>b\nGG\n"])
def test_unsound_files_are_refused_at_once(spark, tmp_path, text):
    folder = write(tmp_path / "unsound", "x.fasta", text)
    if "b" in text:
        write(tmp_path / "unsound", "y.fasta", ">c\nAC\n")
    with pytest.raises(ValueError):
        fasta.read_fasta(spark, folder)


def test_cut_files_are_deleted(spark, tmp_path):
    import os

    df = shared.cut(spark.range(3).toDF("a"), "few")
    path = df._octolake_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 3
    shared.drop(df)
    assert not os.path.exists(path) and df._octolake_path not in shared._WRITTEN


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "a one", "ACGT" * 40), ("b", None, "G"), ("c", "c", "T" * 70)]
    fasta.write_fasta(spark.createDataFrame(rows, fasta.SCHEMA), str(tmp_path / "out"))
    back = fasta.read_fasta(spark, str(tmp_path / "out")).collect()
    assert sorted((r[0], r[2]) for r in back) == [(a, s) for a, _, s in rows]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1234565, 1), (None, None, 2)], "k string, v double, n int")
    for kind in ("tsv", "csv", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        tables.write_table(df, path)
        back = sorted(tables.read_table(spark, path).collect(), key=repr)
        assert {r["n"]: r["v"] for r in back} == {1: 0.123456, 2: None}  # half to even
        assert {r["n"]: r["k"] for r in back} == {1: "a", 2: None}
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.txt")
    manifest = tables.write_bundle({"t": df.withColumnRenamed("k", "sequence_id"), "e": df.limit(0)}, str(tmp_path / "bundle"))
    assert manifest["t"]["rows"] == 2 and manifest["e"]["rows"] == 0


def test_tensor(spark):
    rows = [("a", p, *[float(p + i) for i in range(8)]) for p in range(5)] + [("b", 0, *[1.0] * 8)]
    df = spark.createDataFrame(rows, "k string, pos long, " + ", ".join(f"e{i} double" for i in range(8)))
    got = {r["k"]: r for r in tables.tensor(df, "k", "pos", 3).collect()}
    assert np.array(got["a"]["tensor"]).shape == (8, 3) and got["a"]["tensor"][2] == [2.0, 3.0, 4.0]
    assert got["a"]["n"] == 5 and got["b"]["tensor"][0] == [1.0, 0.0, 0.0]


def test_tensor_closes_gaps(spark):
    rows = [("a", p, *[float(p + i) for i in range(8)]) for p in (0, 4, 4, 9, 12)] + [("late", p, *[float(p)] * 8) for p in (7, 8)]
    df = spark.createDataFrame(rows, "k string, pos long, " + ", ".join(f"e{i} double" for i in range(8)))
    got = {r["k"]: r for r in tables.tensor(df, "k", "pos", 3).collect()}
    assert set(got) == {"a", "late"} and got["a"]["n"] == 4 and got["late"]["n"] == 2
    assert got["a"]["tensor"][0] == [0.0, 4.0, 9.0] and got["late"]["tensor"][0] == [7.0, 8.0, 0.0]


def test_cut_and_drop(spark):
    df = shared.cut(spark.range(5))
    assert df.count() == 5
    shared.drop(df)
    with pytest.raises(Exception):
        df.count()
    shared.drop(spark.range(1))


def test_streams(spark, tmp_path):
    folder = write(tmp_path / "in", "x.fasta", ">a\n" + "ACGT" * 5 + "\n>b\nACG\n")
    rows = incremental.descriptor_stream(incremental.fasta_stream(spark, folder), 10, 5)
    q = rows.writeStream.format("memory").queryName("descriptors").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("descriptors").count() == 3
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    events = str(tmp_path / "ev")
    spark.createDataFrame([(t(5), "view", 1.0), (t(50), "view", 2.0), (t(70), "buy", 3.0)], "ts timestamp, event_type string, value double").write.parquet(events)
    sums = incremental.event_window_sums(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(events))
    q = sums.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("sums").collect()) == [("buy", 1, 3.0), ("view", 2, 3.0)]
