import pytest

from rulewright.queries import ORACLES, QUERIES, entry


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, sf_dir, same, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_entry(spark, sf_dir):
    assert entry(spark, sf_dir).count() > 0


def test_points_to_has_rows(spark, sf_dir):
    assert QUERIES["q_points_to"](spark, sf_dir).count() > 0
