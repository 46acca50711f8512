import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (2, 3, 5):
        assert f"p{n}_found" in entry.queries()


def test_every_query_of_the_cohort_operators_has_sql():
    from tallyloom.queries import cohort, workflow

    sql = entry.oracle_sql()
    assert {n for m in (cohort, workflow) for n in m.QUERIES} - set(sql) == {"round_unseeded"}  # its properties are round_unseeded_ok
