import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from sedimentry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = build_session("tests", cores=8, partitions=4, **{
        "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": str(folder / "shared"), "spark.default.parallelism": "4",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def rows_of(frame, columns):
    """Rows as sorted text, numbers compared to six places."""
    import pandas as pd

    def plain(x):
        if isinstance(x, float) and not pd.isna(x):
            return round(x, 6) + 0.0
        if pd.isna(x):
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted(repr(tuple(plain(x) for x in r)) for r in frame[columns].astype(object).itertuples(index=False))
