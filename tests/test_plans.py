from relevanta.plans import tables


def test_lists_meet_their_requests_before_they_become_rows(spark):
    """The join with requests takes one row a list, not one a metric: the rows of metrics come after it."""
    plan = tables.metric_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")


def test_metrics_are_computed_once(spark):
    """No filter computes the metrics a second time to leave out rows without any."""
    for rows in (tables.metric_rows, tables.metric_records):
        plan = rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "PRECISION@2" in plan and "size(array(struct(" not in plan
