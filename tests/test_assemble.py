import datetime as dt
import warnings

import pandas as pd
import pytest

from tallyloom.plans import assemble as a
from tallyloom.plans import control as c
from tallyloom.sources import catalog

D = dt.date
#: The demonstration data set: inputs, control tables and expected results (fixed values).
PEOPLE = [(1, D(2012, 3, 1), D(2012, 4, 1), "fast appointment"), (2, D(2018, 1, 1), D(2019, 1, 1), "delayed appointment")]
ACCIDENTS = [(1, D(2012, 5, 1), "fall"), (1, D(2012, 6, 1), "vehicle"), *[(2, D(y, 4, 1), "April fools trick") for y in (2016, 2017, 2018, 2019)]]
BENEFITS = [
    (1, D(2012, 2, 1), D(2012, 4, 1), 100.0),
    (1, D(2013, 5, 1), D(2014, 2, 1), 1000.0),
    (2, D(2018, 2, 1), D(2018, 3, 1), 20.0),
    (2, D(2018, 4, 1), D(2018, 5, 1), 20.0),
    (2, D(2018, 6, 1), D(2018, 7, 1), 20.0),
    (2, D(2018, 6, 15), D(2018, 7, 15), 20.0),
    (2, D(2019, 6, 1), D(2019, 9, 1), 300.0),
]
P_COLS = "Database_name Schema_name Table_name Identity_column Label_identity Summary_period_start_date Summary_period_end_date Label_summary_period".split()
M_COLS = "Database_name Schema_name Table_name Identity_column Measure_period_start_date Measure_period_end_date Label_measure Value_measure Measure_summarised_by Proportional".split()
AFTER = {"before": ("registration to appointment", "[registration_date]", "[appointment_date]"), "after": (None, "[appointment_date]", '"2019-12-31"')}
LABELS = "April fools trick|fall|vehicle|any_accident|avg_payment|avg_payment_prop|cause=April fools trick|cause=fall|cause=vehicle|dist_payments|duration_all|duration_within|max_payment|min_payment|num_accidents|num_causes|sum_benefit_all|sum_benefit_within".split("|")
WIDE = {
    (1, "after"): [0, 1, 1, 1, 550, 500.819672131148, 0, 1, 1, 2, 338, 278, 1000, 100, 2, 2, 1100, 1001.6393442623],
    (1, "before"): [0, 0, 0, 0, 100, 52.4590163934426, 0, 0, 0, 1, 61, 32, 100, 100, 0, 0, 100, 52.4590163934426],
    (2, "after"): [1, 0, 0, 1, 300, 300, 1, 0, 0, 1, 93, 93, 300, 300, 1, 1, 300, 300],
    (2, "before"): [1, 0, 0, 1, 20, 20, 1, 0, 0, 1, 122, 122, 20, 20, 1, 1, 80, 80],
}


@pytest.fixture
def tables(spark):
    spark.createDataFrame(PEOPLE, "snz_uid bigint, registration_date date, appointment_date date, appointment_type string").createOrReplaceTempView("tmp_people")
    spark.createDataFrame(ACCIDENTS, "snz_uid bigint, accident_date date, accident_cause string").createOrReplaceTempView("tmp_accidents")
    spark.createDataFrame(BENEFITS, "snz_uid bigint, benefit_start_date date, benefit_end_date date, payments double").createOrReplaceTempView("tmp_benefits")
    for t in ("long_out", "wide_out"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def population():
    rows = [
        ["[]", "[]", "[tmp_people]", "[snz_uid]", '"before"', "[registration_date]", "[appointment_date]", '"registration to appointment"'],
        ["[]", "[]", "[tmp_people]", "[snz_uid]", '"after"', "[appointment_date]", '"2019-12-31"', "[appointment_type]"],
    ]
    return pd.DataFrame(rows, columns=P_COLS)


def measures():
    acc, ben = ["[]", "[]", "[tmp_accidents]", "[snz_uid]", "[accident_date]", "[accident_date]"], ["[]", "[]", "[tmp_benefits]", "[snz_uid]", "[benefit_start_date]", "[benefit_end_date]"]
    rows = [
        [*acc, '"num_accidents"', '"1"', "COUNT", "FALSE"],
        [*acc, '"num_causes"', "[accident_cause]", "count", "f"],
        [*acc, '"cause"', "[accident_cause]", "HISTOGRAM", "FALSE"],
        [*acc, "[accident_cause]", '"1"', "COUNT", "FALSE"],
        [*acc, '"any_accident"', "[accident_cause]", "EXISTS", "FALSE"],
        [*ben, '"sum_benefit_all"', "[payments]", "SUM", "FALSE"],
        [*ben, '"sum_benefit_within"', "[payments]", "SUM", "TRUE"],
        [*ben, '"max_payment"', "[payments]", "MAX", "FALSE"],
        [*ben, '"min_payment"', "[payments]", "MIN", "FALSE"],
        [*ben, '"duration_all"', '"1"', "DURATION", "FALSE"],
        [*ben, '"duration_within"', '"1"', "DURATION", "t"],
        [*ben, '"avg_payment"', "[payments]", "MEAN", "FALSE"],
        [*ben, '"avg_payment_prop"', "[payments]", "MEAN", "TRUE"],
        [*ben, '"dist_payments"', "[payments]", "DISTINCT", "FALSE"],
    ]
    return pd.DataFrame(rows, columns=M_COLS)


def test_golden_tables(spark, tables):
    long, wide = a.assemble(spark, population(), measures(), output_long="[long_out]", output_rectangular="[wide_out]", silent=True)
    assert long.count() == 53
    assert long.columns == catalog.long_thin_schema().fieldNames()
    assert sorted(wide.columns[5:]) == sorted(LABELS) and wide.count() == 4
    for r in wide.collect():
        want = dict(zip(LABELS, WIDE[r["identity_column"], r["label_identity"]]))
        assert {k: r[k] for k in LABELS} == pytest.approx(want, abs=1e-6)
        assert r["label_summary_period"] == ("registration to appointment" if r["label_identity"] == "before" else dict((p[0], p[3]) for p in PEOPLE)[r["identity_column"]])


def test_append_adds_up_and_warns(spark, tables):
    a.assemble(spark, population(), measures(), output_long="[long_out]", silent=True)
    with pytest.warns(UserWarning, match="repeated labels"):
        long, wide = a.assemble(spark, population(), measures(), output_long="[long_out]", output_rectangular="[wide_out]", append=True, silent=True)
    assert long.count() == 106 and wide.count() == 4
    assert wide.where("identity_column = 2 and label_identity = 'before'").first()["sum_benefit_all"] == 160


def test_checks_only_writes_nothing(spark, tables):
    assert a.assemble(spark, population(), measures(), output_long="[long_out]", run_checks_only=True, silent=True) is None
    assert not catalog.table_or_view_exists(spark, table="[long_out]")


def test_development_mode_and_control_files(spark, tables, tmp_path):
    population().to_csv(tmp_path / "p.csv", index=False)
    measures().to_csv(tmp_path / "m.CSV", index=False)
    long, wide = a.assemble(spark, str(tmp_path / "p.csv"), str(tmp_path / "m.CSV"), development_mode=True, silent=True)
    assert long.count() == 53 and wide is None


def test_one_join_per_spell_table(spark, tables):
    ps = [(p, spark.table(p.table)) for p in c.population_rows(c.read_control(spark, population()))]
    whole = c.measure_rows(c.read_control(spark, measures()))
    assert {m.summary for m in whole} == set(c.SUMMARIES) and len({m.table for m in whole}) == 2
    ms = [(m, spark.table(m.table)) for m in whole]
    plan = a.long_thin(ps, ms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2


def test_equal_population_rows_stay_apart(spark, tables):
    twice = pd.concat([population().head(1), population().head(1)])
    long, _ = a.assemble(spark, twice, measures().iloc[5:6], silent=True)
    assert sorted(r["value_measure"] for r in long.collect()) == [80, 80, 100, 100]


def test_null_and_boolean_values(spark, tables):
    spark.createDataFrame([(1, D(2012, 3, 2), D(2012, 3, 3), None, True), (2, D(2018, 3, 2), D(2018, 3, 3), None, False)], "snz_uid bigint, benefit_start_date date, benefit_end_date date, payments double, on boolean").createOrReplaceTempView("tmp_benefits")
    ben = ["[]", "[]", "[tmp_benefits]", "[snz_uid]", "[benefit_start_date]", "[benefit_end_date]"]
    m = pd.DataFrame([[*ben, '"s"', "[payments]", "SUM", "FALSE"], [*ben, '"e"', "[payments]", "EXISTS", "TRUE"], [*ben, '"o"', "[on]", "SUM", "FALSE"], [*ben, '"h"', "[payments]", "HISTOGRAM", "FALSE"]], columns=M_COLS)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        long, _ = a.assemble(spark, population(), m, silent=True)
    assert any("ignored" in str(w.message) for w in seen)
    got = {(r["identity_column"], r["label_measure"]): r["value_measure"] for r in long.collect()}
    assert got == {(1, "s"): None, (2, "s"): None, (1, "e"): 0, (2, "e"): 0, (1, "o"): 1, (2, "o"): 0}


@pytest.mark.parametrize(
    ("which", "column", "value", "part"),
    [
        ("p", "Label_identity", None, "missing"),
        ("p", "Table_name", "tmp_people", "should be delimited"),
        ("p", "Table_name", '"tmp_people"', "should be delimited"),
        ("p", "Label_identity", '"be\'fore"', "delimiter inside"),
        ("m", "Table_name", "[tmp[_]accidents]", "delimiter inside"),
        ("m", "Measure_summarised_by", "TOTAL", "is not one of"),
        ("m", "Proportional", "maybe", "is not one of"),
        ("m", "Table_name", "[no_such_table]", "no table"),
        ("m", "Identity_column", "[no_such_column]", "no column"),
    ],
)
def test_single_faults_are_reported(spark, tables, which, column, value, part):
    p, m = population(), measures()
    (p if which == "p" else m).loc[0, column] = value
    with pytest.raises(ValueError, match=part):
        a.assemble(spark, p, m, run_checks_only=True, silent=True)


def test_all_faults_at_once(spark, tables):
    p, m = population(), measures().rename(columns={"Label_measure": "Label"})
    p.loc[0, "Label_identity"] = "before"
    with pytest.raises(ValueError) as e:
        a.assemble(spark, p, m, silent=True)
    assert "label_measure is missing" in str(e.value) and "should be delimited" in str(e.value)
    with pytest.raises(ValueError, match="is missing"):
        a.assemble(spark, measures(), population(), silent=True)


def test_values_to_sum_must_be_numbers(spark, tables):
    m = measures()
    m.loc[2, "Measure_summarised_by"] = "SUM"
    with pytest.raises(ValueError, match="not a number"):
        a.assemble(spark, population(), m, silent=True)


def test_spell_without_length_has_no_share(spark, tables):
    ben = [(1, D(2012, 3, 10), D(2012, 3, 9), 5.0), (1, D(2012, 3, 10), D(2012, 3, 19), 7.0)]
    spark.createDataFrame(ben, "snz_uid bigint, benefit_start_date date, benefit_end_date date, payments double").createOrReplaceTempView("tmp_benefits")
    long, _ = a.assemble(spark, population(), measures(), silent=True)
    got = {r["label_measure"]: r["value_measure"] for r in long.where("identity_column = 1 and label_identity = 'before'").collect()}
    assert got["sum_benefit_within"] == 7 and got["sum_benefit_all"] == 12 and got["duration_all"] == 10


def test_join_of_a_hot_identity_may_be_split(spark, tables):
    """A third of the spells on one identity: Spark splits the join, and the result stays the same."""
    from pyspark.sql import functions as F

    who = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 997 + 2)
    day = F.date_add(F.lit("2018-01-01").cast("date"), (F.col("id") % 300).cast("int"))
    spells = spark.range(60_000).select(who.alias("snz_uid"), day.alias("benefit_start_date"), day.alias("benefit_end_date"), (F.col("id") % 7 + 0.25).alias("payments")).cache()
    spells.createOrReplaceTempView("tmp_benefits")
    people = spark.range(1, 1000).select(F.col("id").alias("snz_uid"), F.lit("2018-01-01").cast("date").alias("registration_date"), F.lit("2018-06-30").cast("date").alias("appointment_date"), F.lit("x").alias("appointment_type"))
    people.createOrReplaceTempView("tmp_people")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ps = [(p, spark.table(p.table)) for p in c.population_rows(c.read_control(spark, population().head(1)))]
        ms = [(m, spark.table(m.table)) for m in c.measure_rows(c.read_control(spark, measures().iloc[5:6]))]
        out = a.long_thin(ps, ms)
        got = {r["identity_column"]: r["value_measure"] for r in out.collect()}
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {r[0]: r[1] for r in spells.where("benefit_start_date <= '2018-06-30'").groupBy("snz_uid").agg(F.sum("payments")).collect()}
    spells.unpersist()
    assert got == {k: v for k, v in want.items() if k < 1000}
