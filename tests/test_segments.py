import pytest
from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.sources.segments import SEGMENT, Segments, tiers


def rows(spark, a, b):
    return spark.range(a, b).select((F.col("id") % 7).alias("k"), F.lit("x").alias("part"), F.col("id").alias("v"))


def test_segments_add_up_without_a_shuffle(spark, tmp_path):
    s = Segments(spark, f"file://{tmp_path}/s", ["k", "part"], 3)
    assert s.read() is None and s.ranges() == []
    assert [s.write(rows(spark, 0, 70)), s.write(rows(spark, 70, 140))] == [0, 1]
    total = Segments(spark, f"file://{tmp_path}/s", ["k", "part"]).read().groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    assert "Exchange" not in total._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: (r["n"], r["v"]) for r in total.collect()} == {k: (20, sum(range(k, 140, 7))) for k in range(7)}


def test_a_number_is_replaced_and_dropped(spark, tmp_path):
    s = Segments(spark, f"file://{tmp_path}/s", ["part"], 2)
    s.write(rows(spark, 0, 10), 4)
    s.write(rows(spark, 0, 3), 4)
    s.write(rows(spark, 3, 5))
    assert s.ranges() == [(4, 4), (5, 5)] and s.read().count() == 5 and s.read([(4, 4)]).count() == 3
    assert {r[SEGMENT] for r in s.read().collect()} == {"4-4-1", "5-5-0"}
    s.drop([(4, 4)])
    assert s.ranges() == [(5, 5)]


def test_an_unfinished_segment_does_not_count(spark, tmp_path):
    s = Segments(spark, f"file://{tmp_path}/s", ["part"], 2)
    s.write(rows(spark, 0, 10))
    s.write(rows(spark, 10, 20))
    (tmp_path / "s" / "s000000001-000000001-0-2" / "_SUCCESS").unlink()
    assert s.ranges() == [(0, 0)] and s.read().count() == 10


def test_segments_without_rows(spark, tmp_path):
    s = Segments(spark, f"file://{tmp_path}/s", ["k"], 2)
    s.write(rows(spark, 0, 0))
    assert s.read() is None
    s.write(rows(spark, 0, 5))
    s.write(rows(spark, 0, 0))
    assert s.ranges() == [(0, 0), (1, 1), (2, 2)] and s.read().count() == 5 and s.read([(2, 2)]) is None


def test_merged_segments_count_instead_of_their_parts(spark, tmp_path):
    s = Segments(spark, f"file://{tmp_path}/s", ["k"], 2)
    for i in range(3):
        s.write(rows(spark, 0, 14))
    sums = s.read([(0, 0), (1, 1)]).groupBy("k").agg(F.sum("v").alias("v"))
    s._store(sums, (0, 1))  # as if the writer had stopped before it deleted the parts
    assert s.ranges() == [(0, 1), (2, 2)] and s.read().where("segment = '0-1-0'").count() == 7
    more = s.read([(0, 1), (2, 2)]).groupBy("k").agg(F.sum("v").alias("v"))
    assert "Exchange" not in more.repartition(2, "k")._jdf.queryExecution().executedPlan().toString()
    assert s.replace(more, [(0, 1), (2, 2)]) == (0, 2) and s.ranges() == [(0, 2)]
    assert s.read().agg(F.sum("v")).first()[0] == 3 * sum(range(14))


def test_tiers():
    assert tiers([(0, 0), (1, 1), (2, 2)], 4) is None
    assert tiers([(0, 3), (4, 4), (5, 5), (6, 6), (7, 7)], 4) == [(4, 4), (5, 5), (6, 6), (7, 7)]
    assert tiers([(0, 1), (2, 3), (4, 4)], 2) == [(0, 1), (2, 3)]


def test_scratch_folder(spark):
    stored = session.write_shared(spark.range(5), "t")
    assert stored.count() == 5 and spark.sparkContext.applicationId in stored.inputFiles()[0]
    session.drop_shared(stored)
    assert session.list_complete(spark, session.scratch_dir(spark) + "/none") == []


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "local-cluster[3,2,3000]"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        class getCheckpointDir:
            @staticmethod
            def isDefined():
                return False

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session)
