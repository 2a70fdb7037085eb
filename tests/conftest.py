import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session(4, "4g", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs DuckDB SQL over the tables of a data directory."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def run(sql: str, sf_dir: str):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return con.execute(sql).fetchdf()

    return run


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def canonical(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name, doubles to 9 places."""
    import pandas as pd

    def show(v):
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
            return repr([show(x) for x in v])
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (float, int)) or hasattr(v, "dtype"):
            return repr(round(float(v), 9) + 0.0)
        return str(v)

    return sorted(tuple(map(show, row)) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))
