from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "tests", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def frame(spark, tmp_path):
    """Rows to a DataFrame by way of a Parquet file, so the planner knows their size."""
    count = [0]

    def make(pdf: pd.DataFrame):
        count[0] += 1
        path = str(tmp_path / f"t{count[0]}.parquet")
        pdf.to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        return spark.read.parquet(path)
    return make


@pytest.fixture
def series(frame):
    """One or more series from arrays: ``series(values)`` or ``series({name: values})``; None and NaN are missing."""
    from pyspark.sql import functions as F

    def make(values, seconds=None, step=60.0):
        by_name = values if isinstance(values, dict) else {"s": values}
        parts = []
        for name, v in by_name.items():
            v = [None if x is None or x != x else float(x) for x in v]
            at = seconds if seconds is not None else np.arange(len(v)) * step
            parts.append(pd.DataFrame({
                "series_id": name, "ts": pd.to_datetime((np.asarray(at) * 1e6).round().astype("int64"), unit="us"),
                "seq": np.arange(len(v)), "value": pd.array(v, dtype="Float64")}))
        return frame(pd.concat(parts)).withColumn("ts", F.col("ts").cast("timestamp"))
    return make


@pytest.fixture
def spiky():
    rng = np.random.default_rng(42)
    v = 50 + rng.normal(0, 3, 500)
    v[[100, 200, 300, 400]] += 30
    return v


@pytest.fixture
def seasonal_values():
    rng = np.random.default_rng(7)
    i = np.arange(200)
    return i / 20 + 10 * np.sin(2 * np.pi * i / 24) + rng.normal(0, 0.5, 200)
