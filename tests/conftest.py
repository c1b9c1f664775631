import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d


def canonical(v):
    """A value as text that is equal for Spark and DuckDB results."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(sf_dir):
    """Compares a query's rows with those of SQL over the same tables, in any order."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")

    def check(df, sql):
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        mine = sorted("|".join(canonical(r[c]) for c in order) for r in df.collect())
        theirs = sorted("|".join(canonical(r[names.index(c)]) for c in order) for r in cur.fetchall())
        assert mine == theirs

    return check
