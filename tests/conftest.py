import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    local = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", local).config("spark.checkpoint.dir", f"{local}/checkpoint").config("spark.sql.warehouse.dir", f"{local}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compares a query's rows with those of its SQL statement, columns by name and rows in any order."""

    def check(query, sql):
        df = query(spark, DATA)
        expected = duck.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(expected.columns)
        at = [expected.columns.index(c) for c in names]
        mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)
        assert mine == theirs

    return check
