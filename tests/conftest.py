import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from verisift.session import build

    s = build("local[4]", 4, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="verisift-"), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame and a SQL text give the same rows under the same names."""

    def check(df, sql):
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        theirs = sorted(tuple(repr(r[i]) for i in order) for r in cur.fetchall())
        cols = sorted(df.columns)
        assert cols == sorted(names)
        assert sorted(tuple(repr(r[c]) for c in cols) for r in df.collect()) == theirs

    return check
