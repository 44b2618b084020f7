"""Queries over shots of many users, one of whom has thousands of them."""

import datetime as dt

import pytest

from statewatch import catalog
from statewatch.catalog import views as V
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Users 1, 4 and 7 belong to one method; user 1 has 5,400 events, more than a thousand shots."""
    folder = tmp_path_factory.mktemp("crowded")
    rows, start = [], dt.datetime(2024, 1, 1)
    for user, n in ((1, 5400), (4, 63), (7, 41), (2, 417)):
        for i in range(n):
            k = len(rows)
            rows.append((k, start + dt.timedelta(seconds=37 * k % 100_003), user, "view", float(k % 97), '{"k": %d}' % (k * 61 % 100)))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder), rows


@pytest.mark.parametrize("name", ["r01_shot_alerts", "r02_select_threshold", "r03_frontier", "r04_shot_report", "r05_event_summary", "s07_flatten_shots"])
def test_users_keep_their_shots_apart(spark, crowded, name):
    folder, rows = crowded
    con = connect(folder + "/none")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    assert compare(spark, folder, catalog.QUERIES[name], catalog.ORACLES[name], con) is None
    found = catalog.QUERIES[name](spark, folder)
    if name == "r01_shot_alerts":
        assert found.count() == sum(-(-n // 5) for n in (5400, 63, 41, 417))
    if name == "s07_flatten_shots":
        assert found.select("index", "chk").distinct().count() == found.count() == 7 * len(rows)


def test_numbers_are_dense_and_ordered(spark, crowded):
    rows = V.numbered_shots(V.bits(spark, crowded[0])).select("user_id", "shot").distinct().orderBy("shot").collect()
    assert [r.shot for r in rows] == list(range(len(rows)))
    assert [r.user_id for r in rows] == sorted(r.user_id for r in rows)
