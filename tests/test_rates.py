"""Rates by keys against a count of what is near."""

import random

from proselake.operators import operations as O


def test_either_rate_like_a_count(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(0, 60, 3), 500, 501]), rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 8])) for i in range(300)]
    for seconds, most in ((10, 4), (0, 2), (100, 30)):
        near = lambda r, k: sum(x[k] == r[k] and ((x[1] is None and r[1] is None) or (None not in (x[1], r[1]) and r[1] - seconds <= x[1] <= r[1])) for x in rows)  # noqa: B023, E731
        want = {r[0]: any(r[k] is not None and near(r, k) > most for k in (2, 3)) for r in rows}
        got = O.either_rate(spark.createDataFrame(rows, "id long, at long, user long, session long").repartition(4), ["user", "session"], seconds, most)
        assert got.columns == ["id", "at", "user", "session", "limited"]
        assert {r["id"]: r["limited"] for r in got.collect()} == want and len(set(want.values())) == 2


def test_no_window_holds_a_moving_range(spark):
    df = spark.createDataFrame([], "id long, at long, user long, session long")
    plan = O.either_rate(df, ["user", "session"], 10, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan or "-10" not in plan
