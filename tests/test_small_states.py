"""Plans that keep little for each key."""

import __spark_entry__

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_sets_meet_without_copies(spark):
    """The right side is made distinct below the join."""
    for name in ("set_except", "set_intersect"):
        text = plan(spark, name)
        assert text[text.index("Join") :].count("Aggregate [") == 1


def test_no_sketch_for_each_part(spark):
    """Beside a DISTINCT, rows were expanded and grouped by part with three sketches each."""
    assert "Expand" not in plan(spark, "agg_sketches")


def test_no_frame_starts_anew_for_each_row(spark):
    """A frame to the end of a key is made again for each row by Spark."""
    for name in ("window_exclude", "window_groups_exclude"):
        assert "unboundedfollowing" not in plan(spark, name).lower()
