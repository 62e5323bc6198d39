"""Tasks follow the rows of the input, so that what one holds stays as it is when tables grow."""

import pytest

from tideline.operators import deal
from tideline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j03_three_way_join", "l05_first_observed"])
def test_tasks_follow_rows(spark, monkeypatch, name):
    counts = []
    for most in (1000, 200):
        monkeypatch.setattr(deal, "ROWS_PER_TASK", most)
        counts.append(catalogue.queries()[name](spark, FOLDER).rdd.getNumPartitions())
    assert counts[1] > 2 * counts[0]
