"""Running counts of first visits, dealt by stream."""

import re

from cloudloom.operators.planning import visited


def test_visits_are_dealt_by_their_number(spark):
    """The same counts as step by step, in as many tasks as there are visits for, and without a join."""
    rows = [(s, b, (s * 7 + b * b) % 11) for s in range(5) for b in range(40)]
    out = visited(spark.createDataFrame(rows, "stream long, batch long, item long"), 10)
    seen, want = {}, {}
    for s, b, item in rows:
        seen.setdefault(s, set()).add(item)
        want[s, b] = len(seen[s])
    assert {(r.stream, r.batch): r.covered for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(stream\S*, (\d+)\)", plan)) == {"20"} and "Join" not in plan
