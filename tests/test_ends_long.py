"""First and last rows of tables longer than what a task holds before it picks."""

from pyspark.sql import functions as F

from framewise.functions import ends


def test_rows_beyond_what_a_task_holds(spark):
    n = 3 * ends.PENDING
    rows = spark.range(n, numPartitions=1).select(
        F.when(F.col("id") % 3 != 0, (F.col("id") % 3).cast("string")).alias("k"), F.col("id").alias("at")
    )
    found = {r["k"]: r for r in ends.first_last(rows, "k", ["at"], 2).collect()}
    assert set(found) == {None, "1", "2"}
    for k, r in found.items():
        start = int(k or 0)
        assert r["rows"] == n // 3
        assert [e["at"] for e in r["first"]] == [start, start + 3]
        assert [e["at"] for e in r["last"]] == [n - 6 + start, n - 3 + start]
