import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def same_rows(df, sql: str, sf_dir: str) -> None:
    """A frame's rows equal those of DuckDB SQL over the same tables, in any order."""
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda v: round(v, 7) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    theirs = sorted(repr(tuple(norm(v) for _, v in sorted(zip(names, x)))) for x in r.fetchall())
    mine = sorted(repr(tuple(norm(x[n]) for n in sorted(names))) for x in df.collect())
    assert mine == theirs
