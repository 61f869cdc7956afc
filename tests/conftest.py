import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skygauge import get_spark  # noqa: E402
from skygauge.schemas import MEASUREMENTS, RAW  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "skygauge-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def raw_frame(hours: int, stations: int = 2, seed: int = 1, missing: float = 0.2) -> pd.DataFrame:
    """Random hourly rows with holes, as pandas."""
    rng = np.random.default_rng(seed)
    start = dt.datetime(2025, 2, 27, 22)
    parts = []
    for s in range(stations):
        part = pd.DataFrame(
            {"station": f"S{s}", "timestamp": [start + dt.timedelta(hours=h) for h in range(hours)]}
        )
        for c in MEASUREMENTS:
            values = rng.integers(0, 30000, hours) / 100.0
            part[c] = np.where(rng.random(hours) < missing, np.nan, values)
        part["is_forecast"] = False
        parts.append(part)
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame, schema=RAW):
    """Rows with NaN as null."""
    names = schema.names if hasattr(schema, "names") else list(pdf.columns)
    rows = [
        tuple(None if v is pd.NaT or v != v else v for v in row)
        for row in pdf[names].astype(object).itertuples(index=False)
    ]
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, schema)


def by_key(df) -> pd.DataFrame:
    pdf = df.toPandas()
    return pdf.sort_values(["station", "timestamp"]).reset_index(drop=True)
