import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def compared(spark, data, query, sql):
    """Rows of a query and of its SQL, as multisets of rows with sorted columns."""
    import math
    from collections import Counter

    import duckdb
    import numpy as np

    def plain(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return tuple(map(plain, x))
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(f"{x:.9g}") if isinstance(x, float) else x

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    left, right = query(spark, data).toPandas(), con.execute(sql).df()
    assert sorted(left.columns) == sorted(right.columns)
    cols = sorted(left.columns)
    return tuple(Counter(tuple(map(plain, r)) for r in df[cols].itertuples(index=False)) for df in (left, right))
