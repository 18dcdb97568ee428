"""What the patch queries cost: the summary reads the patches once, and no point is shuffled to its patch."""

from test_brute_force import COLS
from trawlframe.operators import patches

ROWS = [(1, k, float(k % 5), float(k % 3), float(k % 2), 1.0) for k in range(12)]


def test_the_summary_runs_the_patches_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    found = patches.spatial_patches(spark.createDataFrame(ROWS, COLS), "x", "y", "z", "w", ["g"], 1.5)
    summary = patches.patch_summary(found.mapInPandas(counted, found.schema), ["g"]).collect()
    assert seen.value == len(ROWS) and abs(sum(r.parea for r in summary) - 1) < 1e-12


def test_points_without_density_find_their_patch_where_they_lie(spark):
    found = patches.spatial_patches(spark.createDataFrame(ROWS, COLS), "x", "y", "z", "w", ["g"], 1.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "_row" in line for line in plan.splitlines())
    assert found.count() == len(ROWS)
