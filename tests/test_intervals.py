import datetime as dt
import random

import pytest

from tallyloom.operators import intervals as iv

D = dt.date
SCHEMA = "who bigint, a date, b date, entity string, start string"


def run(spark, rows):
    p = iv.continuous_periods(spark.createDataFrame([(*r, "e", "s") for r in rows], SCHEMA), "who", "a", "b")
    return sorted((r["entity"], r["kind"], r["first_day"], r["last_day"], r["spells"]) for r in iv.periods_and_gaps(p).collect())


def brute(rows):
    out, by = [], {}
    for who, a, b in rows:
        b = b or D(9999, 12, 31)
        if who is not None and a is not None and b >= a:
            by.setdefault(who, set()).add((a, b))
    for who, spells in by.items():
        periods = []
        for a, b in sorted(spells):
            if periods and a <= (periods[-1][1] + dt.timedelta(1) if periods[-1][1] < D(9999, 12, 31) else D.max):
                periods[-1][1] = max(periods[-1][1], b)
                periods[-1][2] += 1
            else:
                periods.append([a, b, 1])
        out += [(who, "period", *p) for p in periods]
        one = dt.timedelta(1)
        out += [(who, "gap", p[1] + one, q[0] - one, 0) for p, q in zip(periods, periods[1:])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        a = None if rng.random() < 0.05 else D(rng.choice([1900, 2018, 2019, 2020]), 1, 1) + dt.timedelta(rng.randrange(366))
        b = None if rng.random() < 0.02 else (a or D(2019, 1, 1)) + dt.timedelta(rng.choice([-3, 0, 0, 1, 2, 5, 9, 40, 400]))
        if rng.random() < 0.01:
            b = D(9999, 12, 31)
        rows.append((rng.choice([1, 2, 3, 4, None, *range(10, 40)]), a, b))
    rows += rows[:50]
    assert run(spark, rows) == brute(rows)


def test_touching_across_years_and_leap_days(spark):
    rows = [(1, D(2019, 12, 30), D(2019, 12, 31)), (1, D(2020, 1, 1), D(2020, 2, 28)), (1, D(2020, 3, 1), D(2020, 3, 1))]
    assert run(spark, rows) == [
        (1, "gap", D(2020, 2, 29), D(2020, 2, 29), 0),
        (1, "period", D(2019, 12, 30), D(2020, 2, 28), 2),
        (1, "period", D(2020, 3, 1), D(2020, 3, 1), 1),
    ]


def test_spells_count_once_when_equal_in_both_days(spark):
    a, b, c = D(2020, 1, 1), D(2020, 1, 5), D(2020, 1, 9)
    assert run(spark, [(1, a, b), (1, a, b)]) == [(1, "period", a, b, 1)]
    assert run(spark, [(1, a, b), (1, a, c)]) == [(1, "period", a, c, 2)]


def test_empty_and_useless_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, D(2020, 1, 1), None), (1, None, D(2020, 1, 1)), (1, D(2020, 1, 2), D(2020, 1, 1))]) == []
