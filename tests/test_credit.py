"""Credit of users whose ids go beyond those of their partners."""

import duckdb

from isochron.plans import registry


def test_credit_of_ids_beyond_the_partners(spark, tmp_path):
    events = [(0, 149, 10.0), (1, 150, 2.5), (2, 1499, 4.25), (3, 151, 1.0), (4, None, 3.0), (5, 7, None), (6, -3, 1.5)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in registry.queries()["d26_credit"](spark, str(tmp_path)).select("user_id", "credit").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["d26_credit"]).fetchall()
    assert got == set(want) and len(want) == len(got) and {150, 151, 1499} <= {user for user, _ in got}
