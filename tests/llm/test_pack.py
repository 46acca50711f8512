import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import pack as p


def contents(plan, sizes):
    """Container to sizes, from the runs; every item once."""
    boxes, seen = defaultdict(list), defaultdict(list)
    for size, first, items, box, each in plan.runs:
        seen[size].append((first, items))
        for r in range(items):
            boxes[box + r // each].append(size)
    for size, n in sizes.items():
        at = 0
        for first, items in sorted(seen[size]):
            assert first == at
            at += items
        assert at == n
    assert sorted(boxes) == list(range(plan.containers))
    assert all(sum(b) <= plan.capacity for b in boxes.values())
    return boxes


def fewest(items, capacity):
    """The least number of containers, by trying; items are few."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[i]}):
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_every_item_once_and_no_container_over(sizes):
    plan = p.plan_containers(sizes, 30)
    contents(plan, sizes)
    total = sum(s * n for s, n in sizes.items())
    assert -(-total // 30) <= plan.containers <= 2 * -(-total // 30)  # no two containers would fit into one


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_reduction_never_costs_a_container(items):
    """What dominance fixed, with the best packing of the rest, is the best packing of all."""
    sizes = {s: items.count(s) for s in set(items)}
    plan = p.Plan(20, dict(sizes))
    p.reduce_by_dominance(plan)
    rest = list(itertools.chain.from_iterable([s] * n for s, n in plan.left.items()))
    least = fewest(items, 20)
    assert plan.containers + (fewest(rest, 20) if rest else 0) == least
    p.best_fit(plan)
    assert plan.containers <= 11 / 9 * least + 2 / 3


def test_many_items_take_few_runs():
    rng = random.Random(3)
    sizes = {s: rng.randrange(10**9) for s in range(1, 4097)}
    plan = p.plan_containers(sizes, 4096)
    total = sum(s * n for s, n in sizes.items())
    assert plan.containers <= 1.01 * total / 4096
    assert len(plan.runs) < 100_000 and plan.fixed


def test_pack_whole_items(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, None, 3, 9, 10, 11, 25, 30, -4, rng.randrange(1, 12)]), "x", "y") for i in range(400)] + [(7, 9, "x", "y"), (None, 4, "x", "y")]
    df = spark.createDataFrame(rows, "who bigint, n int, piece string, container string")
    got = p.pack(df, "who", "n", 10).collect()
    room, mine = defaultdict(int), defaultdict(list)
    for r in got:
        room[r["container"]] += r["piece_size"]
        mine[r["who"]].append((r["piece"], r["piece_size"], r["n"]))
    assert max(room.values()) <= 10 and sorted(room) == list(range(len(room)))
    for who, n, *_ in rows:
        n = max(n or 0, 0)
        pieces = sorted(x for x in mine[who] if x[2] == n)
        if who != 7:
            assert [x[1] for x in pieces] == ([10] * (n // 10) + ([n % 10] if n % 10 or not n else []))
    total = sum(r["piece_size"] for r in got)
    assert len(room) <= 1.05 * total / 10 + 1


def test_pack_ties_empty_and_all_empty(spark):
    df = spark.createDataFrame([(i, 5) for i in range(11)], "who bigint, n bigint")
    got = p.pack(df, "who", "n", 10).collect()
    assert len({r["container"] for r in got}) == 6
    assert p.pack(df.where("false"), "who", "n", 10).count() == 0
    zero = p.pack(df.withColumn("n", df["n"] * 0), "who", "n", 10).collect()
    assert len(zero) == 11 and {r["container"] for r in zero} == {0}
    with pytest.raises(ValueError):
        p.pack(df, "who", "n", 0)


def test_documents(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, " x" * 25), (4, "")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["piece"], r["piece_size"], r["n_tokens"]) for r in p.pack_documents(df, "doc_id", "text", 10).collect())
    assert got == [(1, 0, 3, 3), (2, 0, 0, 0), (3, 0, 10, 25), (3, 1, 10, 25), (3, 2, 5, 25), (4, 0, 0, 0)]
