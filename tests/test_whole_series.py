"""anomaly and periodicity over all users, whatever their ids."""

import datetime
import random

from test_sessions_and_history import anomalies_by_a_loop

from siltstone.plans import catalogue


def test_all_users_are_scored(spark, tmp_path):
    random.seed(5)
    start = datetime.datetime(2024, 1, 1)
    users = {7: None, 199: None, 200: None, 1499: None, 10**9: None}
    for u in users:
        users[u] = [random.choice((0, 0, 1, 9)) if random.random() < 0.2 else 2 for _ in range(30)]
    users[300] = [4, 1] * 15  # periodic
    for series in users.values():
        series[0], series[-1] = max(series[0], 1), max(series[-1], 1)
    rows = [(u, start + datetime.timedelta(hours=h, minutes=k)) for u, series in users.items() for h, n in enumerate(series) for k in range(n)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    epoch = int(start.replace(tzinfo=datetime.UTC).timestamp())
    want = sorted((u, epoch + 3600 * j, series[j], kind) for u, series in users.items() for j, kind in anomalies_by_a_loop(series, 2.0, 1.0))
    found = catalogue.queries()["anomaly"](spark, str(tmp_path)).collect()
    assert sorted((r["user_id"], r["clock"], r["value"], r["kind"]) for r in found) == want and {r[0] for r in want} & {200, 1499, 10**9}
    got = {r["user_id"]: r["periodic"] for r in catalogue.queries()["periodicity"](spark, str(tmp_path)).collect()}
    assert set(got) == set(users) and got[300]
