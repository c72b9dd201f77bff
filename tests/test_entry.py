"""Every registered query that has SQL, against that SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as ent
from tests.conftest import SF
from tools.oracle_check import TABLES, digest, duck_rows, spark_rows

# checked on their own data in tests/llm
ELSEWHERE = ("op", "pipeline")
NAMES = sorted(n for n in ent.queries() if not n.startswith(ELSEWHERE))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() == 10
    assert "avg_wait_min" in df.columns


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(ent.oracle_sql())


@pytest.mark.parametrize("name", [n for n in NAMES if n in ent.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    got, columns = spark_rows(ent.queries()[name](spark, SF))
    want, names = duck_rows(duck, ent.oracle_sql()[name])
    assert columns == names
    assert digest(got, columns)[1] == digest(want, names)[1]


def test_pacf_solves_the_yule_walker_equations(spark):
    import numpy as np

    rows = ent.queries()["t_06_pacf"](spark, SF).toPandas()
    acf = ent.queries()["t_05_w_14_acf"](spark, SF).toPandas()
    station = int(rows.station_id.iloc[0])
    r = acf[acf.station_id == station].sort_values("lag").acf.to_numpy(float)
    own = rows[rows.station_id == station].sort_values("lag").pacf.to_numpy(float)
    for k in (1, 2, 7):
        toeplitz = r[np.abs(np.subtract.outer(range(k), range(k)))]
        assert own[k] == pytest.approx(np.linalg.solve(toeplitz, r[1: k + 1])[-1], abs=1e-6)
