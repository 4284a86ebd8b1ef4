"""Simpson's rule over whole days, against a plain version."""

from collections import defaultdict

import pytest

from galvana.plans import base, registry


def area(y):
    n = len(y) - (len(y) % 2 == 0)
    whole = sum(y[k] + 4 * y[k + 1] + y[k + 2] for k in range(0, n - 2, 2)) / 3
    return whole + ((y[-2] + y[-1]) / 2 if len(y) > n else 0.0)


def test_every_sample_of_every_day_counts(spark, sf_dir):
    days = defaultdict(list)
    for r in base.samples(spark, sf_dir).orderBy("time", "row_id").collect():
        days[r.cell_id, int(r.time // 86400)].append(abs(r.current))
    found = {(r.cell_id, r.day): r.area for r in registry.QUERIES["simpson_daily"](spark, sf_dir).collect()}
    assert found == {k: pytest.approx(area(y), abs=2e-5) for k, y in days.items()}
    assert sum(map(len, days.values())) > 8 * 21
