"""The raw logs derived from events."""

from gridloom.sources import feed

VALUES = {1: 125.05, 2: 78.28, 3: 2.17}  # (v1 + v2) + v3 is 205.49999999999997, (v3 + v2) + v1 is 205.5


def test_rounded_sums_do_not_depend_on_the_layout_of_the_files(spark, tmp_path):
    """Three events of one half hour, with a mean and a sum at a rounding tie, in the order of their ids and in the other one."""
    speeds = []
    for name, ids in (("there", [1, 2, 3]), ("back", [3, 2, 1])):
        path = str(tmp_path / name)
        rows = [(i, 7, "view", VALUES[i]) for i in ids] + [(4, 700, "view", None)]
        events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
        events.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:10:00' AS ts", "user_id", "event_type", "value").coalesce(1).write.parquet(f"{path}/events.parquet")
        spark.createDataFrame([(k, f"N{k}") for k in range(25)], "n_nationkey int, n_name string").write.parquet(f"{path}/nation.parquet")
        found = {r["road_id"]: r for r in feed.traffic(spark, path).collect()}
        speeds.append((found[" SEG-000000000"]["traffic_volume"], found[" SEG-000000000"]["avg_speed"], found[" SEG-000000070"]["avg_speed"]))
    assert speeds == [("205", "68", None)] * 2


def test_the_cells_of_the_traffic_log_are_worked_out_once_for_a_row_and_its_copies(spark):
    plan = feed.traffic(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2  # events and nation
