import duckdb
import pytest

from quillmill.plans import catalog
from tools.compare import digest

SQL = catalog.oracle_sql()


def test_names():
    assert catalog.FLAGSHIP in catalog.queries() and set(SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    import pandas as pd

    df = catalog.queries()[name](spark, data)
    got = digest(pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object))
    if name in SQL:
        from pathlib import Path

        duck = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rel = duck.execute(SQL[name])
        cols = [c[0] for c in rel.description]
        assert got == digest(pd.DataFrame(rel.fetchall(), columns=cols, dtype=object))
