import pytest

import __spark_entry__ as entry_point
from cinderbox import queries as core
from oracle import agrees


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(core.ORACLE_SQL) <= set(core.QUERIES)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    agrees(core.QUERIES[name](spark, sf), core.ORACLE_SQL[name], sf)


def half_cents(spark, folder):
    """Events whose confidence lies half way between two hundredths, as decimals; as doubles most lie on one side."""
    values = [v / 2 for v in range(501, 1100)]
    events = [(i, i % 7, core.CLASSES[i % 5], v) for i, v in enumerate(values)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").toPandas().to_parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(k,) for k in range(9)], "c_custkey long").toPandas().to_parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_annotated_frames_of_half_cents(spark, tmp_path):
    folder = half_cents(spark, tmp_path)
    agrees(core.det_annotated_frames(spark, folder), core.ORACLE_SQL["det_annotated_frames"], folder)


def test_labels_of_half_cents(spark, tmp_path):
    folder = half_cents(spark, tmp_path)
    agrees(core.det_labels(spark, folder), core.ORACLE_SQL["det_labels"], folder)


def test_filters_reach_the_scan(spark, sf):
    plan = core.det_threshold(spark, sf)._jdf.queryExecution().toString()
    assert "GreaterThan(value,250.0)" in plan
    assert "props" not in plan.split("ReadSchema")[-1]
