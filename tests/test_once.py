"""Values that a plan names once: Spark works out what a lambda or a pushed filter repeats as often as it stands there."""

import pytest

from ledgerloom import plans

#: query: (words of its optimised plan, how often they may stand there at most)
ONCE = {
    "running_totals": ("writing", 1),
    "refined_summaries": ("plan\\s+summary", 1),
    "mapped_statements": ("[ _]", 4),
    "fuzzy_stitched": ("array_intersect", 3),
    "table_similarities": ("array_intersect", 3),
}


@pytest.mark.parametrize("name", ONCE)
def test_worked_out_once(spark, sf, name):
    word, most = ONCE[name]
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(word) <= most
