"""The job grid has models, and cells with too many rows do not count as ok."""

from consensio.operators.completeness import compare_grids, job_grid, pending, pooled_models

KEYS = ["task", "config", "model", "seed"]


def test_grid_by_model(spark):
    t = spark.createDataFrame([("t",)], "task string")
    grid = job_grid(t, ["single", "mad"], [0], ["a", "b"], {"mad": "pool"}, {"mad": 2})
    seen = spark.createDataFrame([("t", "single", "a", 0)] * 3 + [("t", "mad", "a", 0), ("t", "mad", "b", 0), ("t", "mad", "z", 0)], "task string, config string, model string, seed long")
    seen = pooled_models(seen, {"mad": "pool"}, ["a", "b"])
    got = {(r["config"], r["model"]): r["status"] for r in compare_grids(grid, seen, KEYS, most="most").collect()}
    assert got == {("single", "a"): "overfilled", ("single", "b"): "missing", ("mad", "pool"): "ok", ("mad", "z"): "unexpected"}
    # a job done by one model stays pending for the other
    assert [(r["config"], r["model"]) for r in pending(grid, seen, KEYS).collect()] == [("single", "b")]
