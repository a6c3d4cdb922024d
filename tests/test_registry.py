import __spark_entry__
from takemark.operators import site


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"q_change_orders", "q_rate_limit"} <= set(__spark_entry__.queries())


def test_rate_limit_rejects_without_prolonging(spark):
    rows = [(i, "a", i * 60) for i in range(8)] + [(8, "a", 3900), (9, None, 0)]
    events = spark.createDataFrame(rows, "id long, ip string, s long").selectExpr("id", "ip", "timestamp_seconds(s) AS ts")
    allowed = {r.id for r in site.rate_limited(events, "ip", "ts", "id").collect() if r.allowed}
    assert allowed == {0, 1, 2, 3, 4, 8, 9}
