from __future__ import annotations

import glob
import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.local.dir": scratch, "spark.checkpoint.dir": f"file://{scratch}/shared"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {Path(p).stem} as select * from '{p}'")
    return con


def cells(pdf) -> tuple[list[str], list[tuple]]:
    """Columns and rows in an order that both engines share; numbers to six digits."""
    import numpy as np
    import pandas as pd

    def cell(x) -> str:
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        if isinstance(x, bool | np.bool_):
            return str(bool(x))
        return f"{float(x) + 0.0:.6g}" if isinstance(x, int | float) or type(x).__module__ == "numpy" else str(x)

    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False))
