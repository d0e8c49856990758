import pytest

from rulewright.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, sf_dir, same, name):
    same(queries()[name](spark, sf_dir), oracle_sql()[name])


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries()} == {"pipeline", *(f"op{k}" for k in range(1, 11))}
