import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import wide
from tallyloom.streaming import wide_ingest

SPEC = wide.WideSpec(keys=("who", "part"), label="label", value="x", version="at", carry=("period",), known=("who",))
IDS = [(1, "any_a", "flag"), (2, "num b", "whole"), (3, "avg=c", "real")]
SCHEMA = "who bigint, part string, label string, x double, at timestamp, period string, cells string, batch string"
T0 = dt.datetime(2020, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "c", "b") for r in rows], SCHEMA)


def at(day):
    return T0 + dt.timedelta(day)


def wide_of(spark, rows):
    out = wide.wide_rows(wide.compact_runs(wide.sparse_deltas(frame(spark, rows), SPEC, IDS), SPEC), SPEC, IDS)
    return {(r["who"], r["part"]): r.asDict() for r in out.collect()}


def brute(rows):
    known = {"anya": (0, "flag"), "numb": (1, "whole"), "avgc": (2, "real")}
    out = {}
    for who, part, label, x, when in rows:
        if who is None:
            continue
        r = out.setdefault((who, part), [{}, 0])
        k = known.get("".join(c for c in (label or "").lower() if c.isalnum()))
        if k is None:
            r[1] += 1
        elif x is not None and x == x:
            r[0].setdefault(k, []).append((when or dt.datetime(1, 1, 1), x))
    full = {}
    for key, (cells, unlisted) in out.items():
        vals, unclear = [None] * 3, []
        for (i, kind), seen in cells.items():
            xs = [x for _, x in seen]
            bad = any((kind == "flag" and x not in (0, 1)) or (kind == "whole" and (x < 0 or x % 1 != 0)) for x in xs)
            if bad or (max(xs) != min(xs) and max(xs) - min(xs) > 0.01 + 1e-9):
                unclear.append(IDS[i][1])
            else:
                vals[i] = max(seen)[1]
        full[key] = (vals, sorted(unclear), unlisted)
    return full


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    values = [0.0, 1.0, 1.0, 2.0, 2.005, -1.0, 0.5, None, float("nan"), float("inf"), 1e300]
    labels = ["any_a", "ANY A", '"any-a"', "num b", "Num_B", "avg=c", "other", None, ""]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice(["x", "y", None]), rng.choice(labels), rng.choice(values), rng.choice([None, at(0), at(1), at(1.5)])) for _ in range(120)]
    got, want = wide_of(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for k, (vals, unclear, unlisted) in want.items():
        r = got[k]
        assert r["unclear"] == unclear and r["unlisted"] == unlisted and r["period"] == "p"
        whole = None if vals[1] is not None and abs(vals[1]) > 2**63 else vals[1]
        assert [r["any_a"], r["num b"], r["avg=c"]] == [vals[0], whole, vals[2]]


def test_latest_version_wins_however_runs_are_compacted(spark):
    rows = [(1, "x", "avg=c", 1.0, at(0)), (1, "x", "avg=c", 1.005, at(2)), (1, "x", "avg=c", 1.001, at(1)), (1, "x", "num b", 7.0, at(0))]
    deltas = wide.sparse_deltas(frame(spark, rows), SPEC, IDS)
    assert deltas.count() == 3
    once = wide.compact_runs(deltas, SPEC)
    tiers = wide.compact_runs(wide.compact_runs(deltas.where("batch <= '2020-01-02'"), SPEC).unionByName(deltas.where("batch > '2020-01-02'")), SPEC)
    for run in (once, tiers):
        r = wide.wide_rows(run, SPEC, IDS).first()
        assert (r["avg=c"], r["num b"], r["any_a"]) == (1.005, 7, None)


def test_types_and_unclear_cells(spark):
    rows = [(1, "x", "any_a", 2.0, at(0)), (1, "x", "num b", 3.0, at(0)), (2, "x", "avg=c", 1.0, at(0)), (2, "x", "avg=c", 1.02, at(1))]
    run = wide.compact_runs(wide.sparse_deltas(frame(spark, rows), SPEC, IDS), SPEC)
    out = wide.wide_rows(run, SPEC, IDS)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema][3:6] == [("any_a", "int"), ("num b", "bigint"), ("avg=c", "double")]
    cells = wide.compact_cells(wide.sparse_deltas(frame(spark, rows), SPEC, IDS), SPEC)
    assert sorted(map(tuple, wide.unclear_cells(cells, SPEC, IDS).collect())) == [(1, "x", "any_a"), (2, "x", "avg=c")]


def test_empty_table(spark):
    assert wide_of(spark, []) == {}


def test_a_stream_of_batches_gives_the_same_rows(spark, tmp_path):
    rows = [(w, "x", "avg=c", 1.0 + w, at(d)) for w in range(5) for d in range(3)] + [(1, "x", "num b", 4.0, at(9))]
    for i in range(3):
        frame(spark, rows[i::3]).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = wide_ingest.ingest(stream, str(tmp_path / "runs"), str(tmp_path / "state"), SPEC, IDS).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(wide_ingest.runs_in(spark, str(tmp_path / "runs"), SPEC).ranges()) == 3
    assert wide_ingest.compact(spark, str(tmp_path / "runs"), SPEC, everything=True) == [(0, 2)]
    wide_ingest.append_batch(frame(spark, rows), 1, str(tmp_path / "runs"), SPEC, IDS)  # merged already: not counted again
    got = wide.wide_rows(wide_ingest.read_runs(spark, str(tmp_path / "runs"), SPEC), SPEC, IDS)
    want = wide.wide_rows(wide.compact_runs(wide.sparse_deltas(frame(spark, rows), SPEC, IDS), SPEC), SPEC, IDS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_runs_are_merged_tier_by_tier_without_a_shuffle(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    rows = [(w, "x", "avg=c", 1.0 + w, at(d)) for w in range(5) for d in range(9)] + [(1, "x", "nothing", 4.0, at(9)), (2, None, None, None, at(9))]
    for i in range(9):
        wide_ingest.append_batch(frame(spark, rows[i::9]), i, folder, SPEC, IDS, 3)
    assert wide_ingest.compact(spark, folder, SPEC, 2) == [(0, 7), (8, 8)]
    runs = wide_ingest.read_runs(spark, folder, SPEC)
    got = wide.wide_rows(runs, SPEC, IDS)
    for df in (got, wide.compact_runs(runs, SPEC).repartition(3, "k_who", "k_part")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = wide.wide_of_cells(wide.cell_states(frame(spark, rows), SPEC, IDS), SPEC, IDS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_the_table_is_not_shuffled_by_label(spark):
    cells = wide.cell_states(frame(spark, []), SPEC, IDS)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(label_key" not in plan and plan.count("Exchange hashpartitioning") == 1
    one = wide.unclear_cells(cells, SPEC, IDS)._jdf.queryExecution().executedPlan().toString()
    assert one.count("Exchange hashpartitioning") == 1


def test_attribute_ids_are_bounded_and_sorted(spark):
    ref = spark.createDataFrame([("b", "flag"), ("a", "real"), (None, "real")], "label string, kind string")
    assert wide.label_ids(ref, "label", "kind") == [(1, "a", "real"), (2, "b", "flag")]
    assert wide.suits(F.lit(1.0), F.lit("flag")) is not None


def found(spark, folder, rows):
    """p5_found over rows of identity, label, value and the year of the load."""
    from tallyloom.queries import prepared

    schema = (
        "identity_column bigint, label_identity string, label_measure string, value_measure double, loaded_at timestamp_ntz, "
        "summary_period_start_date date, summary_period_end_date date, label_summary_period string"
    )
    long = [(who, "x", label, x, y and dt.datetime(y, 1, 1), T0.date(), T0.date(), "p") for who, label, x, y in rows]
    spark.createDataFrame(long, schema).write.parquet(f"{folder}/output_long_thin.parquet")
    spark.createDataFrame(IDS, "id int, label_measure string, value_type string").write.parquet(f"{folder}/measure_reference.parquet")
    return prepared.p5_found(spark, str(folder))


def test_unclear_cells_come_from_stored_and_merged_runs(spark, tmp_path):
    rows = [
        *[(1, "avg=c", float(y), y) for y in (2020, 2023)],  # no load by itself holds both values
        *[(2, "avg=c", y / 1000, y) for y in (2020, 2021, 2022, 2023)],
        *[(2, "ANY-A", 2.0, 2020), (2, "any_a", 1.0, 2023)],
        *[(3, "num b", float("nan"), 2021), (3, "other", 5.0, 2021), (None, "any_a", 7.0, 2022), (4, "num b", -1.0, None)],
    ]
    out = found(spark, tmp_path, rows)
    assert sorted(map(tuple, out.collect())) == [(1, "x", "avg=c"), (2, "x", "any_a"), (4, "x", "num b")]
    assert {x.split("/")[-2].rsplit("-", 2)[0] for x in out.inputFiles()} == {"s000000000-000000003", "s000000004-000000004"}
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("year", [2020, 2023])
def test_loads_without_rows(spark, tmp_path, year):
    rows = [(1, "any_a", 2.0, year), (None, "any_a", 7.0, 2021)]
    assert found(spark, tmp_path / "some", rows).collect() == [(1, "x", "any_a")]
    none = found(spark, tmp_path / "none", rows[1:])
    assert none.collect() == [] and none.columns == ["identity_column", "label_identity", "label_measure"]
