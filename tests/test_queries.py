"""Every registered query outside the training-data subpackage against its SQL, run by another engine."""

import duckdb
import pandas as pd
import pytest

from lodestore import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(frame: pd.DataFrame) -> list:
    one = lambda v: None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_token_derivation_has_every_event(spark, tmp_path):
    """Every user id, of whatever size, stands whole in its tokens."""
    users = [0, 255, 256, 1499, 2**24 + 5, 2**32 + 255, 2**53 + 9, None]
    rows = [(i, u) for u in users for i in range(len(users) * 7)]
    rows = [(k, u) for k, (_, u) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.token for r in catalog.queries()["token_derivation"](spark, str(tmp_path)).collect()}
    want = {k: None if u is None else (k.to_bytes(8, "big") + (u ^ k % 7).to_bytes(8, "little") + bytes(7) + b"\x0a").hex() for k, u in rows}
    assert got == want


def test_known_counts(spark):
    from lodestore.operators import kernel, paging
    from lodestore.sources import workload

    log = workload.mutation_log(spark, "/root/testdata/sf0.01")
    items = kernel.visible_items(log)
    assert (log.count(), items.count(), paging.first_page(items, 120).count()) == (10000, 4343, 715)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
