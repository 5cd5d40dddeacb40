import pytest
from oracle import SF, same

import __spark_entry__ as entry
from lexitrace.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"identify_batch"}))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_identify_batch_gives_each_item_a_verdict(spark):
    found = queries.QUERIES["identify_batch"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert all((r.episode_id is None) <= r.needs_review for r in found)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "media_id", "confidence", "match_count", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
