"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import SF_DIR, difference

from tidemark.plans import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert not difference(QUERIES[name](spark, SF_DIR), ORACLE[name], SF_DIR)


def test_all_have_sql():
    assert set(ORACLE) == set(QUERIES)


def test_as_of_join_has_no_nested_loop(spark, capsys):
    QUERIES["j06_as_of_checkout_token"](spark, SF_DIR).explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "ReadSchema" in plan
