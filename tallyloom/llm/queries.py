"""Queries of the llm operators, with their SQL where there is any."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import folded
from tallyloom.llm import encode, pack, repeats, sample, sketch
from tallyloom.queries.common import fold_sql, table
from tallyloom.session import write_shared

WANTED = [1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0]
RATE, CAPACITY = 0.1, 4096
#: A document is a case if more than this part of its words is repeated: 2 of 5, compared in whole numbers.
REPEATED = (2, 5)


def _known(spark: SparkSession, folder: str, wanted: list[float]) -> DataFrame:
    """Percentiles by folded label: sketches are made by label as written, and put together where the letters agree, so that
    a label is folded once per sketch and not once per row."""
    rows = table(spark, folder, "output_long_thin")
    parts = sketch.partial_sketches(rows, "label_measure", "value_measure").withColumn("key", folded(F.col("key"))).where("key is not null")
    return sketch.percentiles(sketch.merge_sketches(parts, max(1, rows.rdd.getNumPartitions())), wanted)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    limits = table(spark, folder, "measure_limits").withColumn("key", folded(F.col("label_measure")))
    known = _known(spark, folder, [float(p) for p in range(1, 100)])
    both = limits.join(known.withColumn("pct", F.col("pct").cast("int")), ["key", "pct"])
    return both.where("value < low_value or value > high_value").select("label_measure", "pct")


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _known(spark, folder, WANTED)


def p1_from_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same from sketches made of every day's rows apart and then put together."""
    day = F.coalesce(F.date_format("loaded_at", "yyyy-MM-dd"), F.lit(""))
    keyed = table(spark, folder, "output_long_thin").select(F.concat(day, F.lit("|"), "label_measure").alias("day_key"), "value_measure")
    parts = max(1, keyed.rdd.getNumPartitions())
    split = F.split("key", r"\|", 2)
    made = sketch.partial_sketches(keyed, "day_key", "value_measure").withColumn("key", F.concat(split[0], F.lit("|"), folded(split[1])))
    daily = sketch.merge_sketches(made.where("key is not null"), parts)
    day = F.substring_index("key", "|", 1)
    number = F.coalesce(F.datediff(F.try_to_date(day), F.lit("1970-01-01").cast("date")), F.lit(0))
    again = daily.select(F.substring_index("key", "|", -1).alias("key"), F.pmod(number, F.lit(4096)).cast("bigint").alias("part"), "level", "err", "items")
    return sketch.percentiles(sketch.merge_sketches(again, 4096), WANTED)


def p1_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """key, n, beyond: per label how many results of p1_percentiles and p1_from_days are off their rank by more than the
    error they come with, by counting all values below and up to each."""
    known = p1_percentiles(spark, folder).unionByName(p1_from_days(spark, folder))
    one = F.struct("pct", "value", "rank_error", "n").alias("q")
    per = known.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("q"))  # twice as many as WANTED
    rows = table(spark, folder, "output_long_thin").select(folded(F.col("label_measure")).alias("key"), F.col("value_measure").alias("x"))
    rows = rows.where("key is not null and x is not null and not isnan(x)").groupBy("key", "x").agg(F.count(F.lit(1)).alias("m"))
    both = rows.join(F.broadcast(per), "key")  # a row a label
    n = 2 * len(WANTED)
    side = [F.sum(F.when(F.col("x") < F.col("q")[i]["value"], F.col("m")).otherwise(0)).alias(f"lt{i}") for i in range(n)]
    side += [F.sum(F.when(F.col("x") <= F.col("q")[i]["value"], F.col("m")).otherwise(0)).alias(f"le{i}") for i in range(n)]
    got = both.groupBy("key").agg(F.sum("m").alias("n"), F.first("q").alias("q"), *side)
    off = []
    for i in range(n):
        q, rank = F.col("q")[i], F.greatest(F.lit(1.0), F.ceil(F.col("q")[i]["pct"] / 100 * F.col("n") - 1e-9).cast("double"))
        far = F.greatest(F.col(f"lt{i}") + 1 - rank, rank - F.col(f"le{i}"), F.lit(0.0))
        off.append(F.coalesce(((far > q["rank_error"]) | (q["n"] != F.col("n"))).cast("bigint"), F.lit(1)))
    return got.select("key", "n", sum(off, F.lit(0).cast("bigint")).alias("beyond"))


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sample.golden_sample(table(spark, folder, "data_project_population"), "snz_uid", "loaded_at", RATE)


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The sample's rows; NaN is given as NULL with is_nan, so that each row can be compared."""
    rows = sample.rows_of_sample(table(spark, folder, "output_long_thin"), "identity_column", p4_sample(spark, folder), "snz_uid")
    nan = F.coalesce(F.isnan("value_measure"), F.lit(False))
    return rows.withColumn("is_nan", nan).withColumn("value_measure", F.when(~nan, F.col("value_measure")))


#: The table at two earlier moments, for p4_growth.
CUTS = ("2012-01-01", "2017-01-01")


def _loads(people: DataFrame) -> list[DataFrame]:
    """The population at three moments, made harder: at the second, members of the first moment are reported again without
    arrival and others come that are dated before all; at the third, others come without arrival and at one same time."""
    row = lambda who, at: people.select(F.expr(who).alias("snz_uid"), F.expr(at).cast("timestamp_ntz").alias("loaded_at"))
    first = people.where(F.col("loaded_at") < F.lit(CUTS[0]).cast("timestamp_ntz"))
    second = people.where(F.col("loaded_at") < F.lit(CUTS[1]).cast("timestamp_ntz"))
    of_first = lambda who, at: first.select(F.expr(who).alias("snz_uid"), F.expr(at).cast("timestamp_ntz").alias("loaded_at"))
    two = second.select("snz_uid", "loaded_at").unionByName(of_first("snz_uid", "null")).unionByName(of_first("-1 - snz_uid", "loaded_at - interval 20 years"))
    three = row("snz_uid", "loaded_at").unionByName(row("-1 - snz_uid", "null")).unionByName(row("-1000000000000 - snz_uid", "timestamp_ntz '2000-01-01'"))
    return [first.select("snz_uid", "loaded_at"), two, three]


def p4_growth(spark: SparkSession, folder: str) -> DataFrame:
    """load, members, chosen, lost: the register and its sample after each of three loads, and how many members of the
    sample before are no longer in it."""
    register = sample.Register(spark)
    out, before = [], None
    for i, rows in enumerate(_loads(table(spark, folder, "data_project_population"))):
        register.load(rows, "snz_uid", "loaded_at")
        known = register.members()
        chosen = known.where(sample.selected(F.col("seq"), RATE)).select("id")
        lost = 0 if before is None else before.join(chosen, "id", "left_anti").count()
        out.append((i + 1, known.count(), chosen.count(), lost))
        before = chosen
    return spark.createDataFrame(out, "load int, members bigint, chosen bigint, lost bigint")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p6_decode(spark: SparkSession, folder: str) -> DataFrame:
    """All texts from their token ids."""
    return encode.decode_corpus(p6_ids(spark, folder), "doc_id", "ids")


def p6_lost(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text does not come back from its token ids, by SHA-256: none; NULL comes back as the empty text."""
    print_ = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    docs = table(spark, folder, "documents").select("doc_id", print_("text").alias("print"))
    back = encode.decode_corpus(p6_ids(spark, folder), "doc_id", "ids").select("doc_id", print_("text").alias("decoded"))
    return docs.join(back, "doc_id", "left").where(~F.col("print").eqNullSafe(F.col("decoded"))).select("doc_id")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack.pack_documents(table(spark, folder, "documents"), "doc_id", "text", CAPACITY)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_containers(spark, folder).where((F.col("n_tokens") > CAPACITY) & (F.col("piece") == 0)).select("doc_id")


def p7_properties(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents placed, tokens lost, containers that hold too much, documents split without need, and whether there
    are at most 1 percent more containers than the tokens need at least."""
    pieces = write_shared(p7_containers(spark, folder), "pieces")
    full = pieces.groupBy("container").agg(F.sum("piece_size").alias("size"))
    docs = pieces.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_size").alias("size"))
    a = full.where("size > 0").agg(F.count_if(F.col("size") > CAPACITY).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.sum("size").alias("tokens"))
    b = docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.abs(F.col("n_tokens") - F.col("size"))).alias("lost"),
        F.count_if((F.col("n_tokens") <= CAPACITY) & (F.col("pieces") > 1)).alias("split"),
    )
    tight = F.col("containers") <= F.ceil(F.col("tokens") / CAPACITY) * 1.01 + 1
    one = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k")  # a row each
    return one.select("documents", "lost", "overfull", "split", tight.alias("tight"))


def _repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repetition(table(spark, folder, "documents"), "doc_id", "text", ("lang", "source"))


def p8_method(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.outliers(_repetition(spark, folder), "doc_id", ("lang", "source"))


#: Rows of each group of p8_planted that repeat little, and rows planted among them that repeat much: a third of all.
CLEAN, PLANTED = 300, 150


def p8_planted(spark: SparkSession, folder: str) -> DataFrame:
    """lang, source, planted, found, few_rejected: per group of documents, measures drawn around one centre and planted ones
    far from it, a third of the group; how many of these p8_method's estimate rejects, and whether it rejects at most 5
    percent of the others. The draws are hashes, the same in every run."""
    groups = table(spark, folder, "documents").select("lang", "source").distinct()
    rows = groups.select("lang", "source", F.explode(F.sequence(F.lit(1), F.lit(CLEAN + PLANTED))).alias("i"))
    u = lambda k: (F.pmod(F.xxhash64("lang", "source", "i", F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda k: F.sqrt(-2 * F.log(u(2 * k))) * F.cos(2 * math.pi * u(2 * k + 1))
    share = lambda x: 1 / (1 + F.exp(-x))
    bad = F.col("i") > CLEAN
    words, size = F.floor(F.exp(normal(0) * 0.5 + 6)) + 50, F.lit(20_000)
    measures = rows.select(
        F.col("i").alias("doc_id"), "lang", "source", words.alias("words"),
        F.floor(words * share(normal(1) * 0.5 + F.when(bad, 2).otherwise(-2))).alias("repeated"),
        F.floor(words * share(normal(2) * 0.4 + F.when(bad, -1.5).otherwise(0.5))).alias("kinds"),
        size.alias("bytes"), F.floor(size * share(normal(3) * 0.5 + F.when(bad, 1).otherwise(-3))).alias("line_bytes"),
    ).withColumn("share", F.col("repeated") / F.col("words"))
    judged = repeats.outliers(measures, "doc_id", ("lang", "source"))
    bad = F.col("doc_id") > CLEAN
    return judged.groupBy("lang", "source").agg(
        F.count_if(bad).alias("planted"), F.count_if(bad & F.col("rejected") & F.col("above")).alias("found"),
        (F.count_if(~bad & F.col("rejected")) <= CLEAN // 20).alias("few_rejected"),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repetition(spark, folder).where(F.col("repeated") * REPEATED[1] > F.col("words") * REPEATED[0]).select("doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _repetition(spark, folder).select("doc_id", "words", "repeated")


QUERIES = {
    f.__name__: f
    for f in (
        *(p1_found, p1_percentiles, p1_from_days, p1_ranks, p4_sample, p4_rows, p4_growth, p6_ids, p6_decode, p6_lost),
        *(p7_found, p7_containers, p7_properties, p8_method, p8_planted, p8_found, p8_shares),
    )
}

_CHOSEN = f"(seq::HUGEINT * {sample.GOLDEN} + {sample.SHIFT}) % {1 << sample.BITS} < {int(RATE * (1 << sample.BITS))}"
_SAMPLE = f"""
WITH f AS (SELECT snz_uid, min(loaded_at) AS first_arrived FROM data_project_population WHERE snz_uid IS NOT NULL GROUP BY 1),
n AS (SELECT snz_uid, row_number() OVER (ORDER BY first_arrived NULLS LAST, snz_uid) - 1 AS seq FROM f),
s AS (SELECT snz_uid, seq FROM n WHERE {_CHOSEN})
"""
_GROWTH = f"""
WITH p AS (SELECT snz_uid, loaded_at FROM data_project_population),
l1 AS (SELECT * FROM p WHERE loaded_at < TIMESTAMP '{CUTS[0]}'),
l2 AS (SELECT * FROM p WHERE loaded_at < TIMESTAMP '{CUTS[1]}' UNION ALL SELECT snz_uid, NULL FROM l1
  UNION ALL SELECT -1 - snz_uid, loaded_at - INTERVAL 20 YEAR FROM l1),
l3 AS (SELECT * FROM p UNION ALL SELECT -1 - snz_uid, NULL FROM p UNION ALL SELECT -1000000000000 - snz_uid, TIMESTAMP '2000-01-01' FROM p),
a AS (SELECT 1 AS load, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3),
g AS (SELECT snz_uid, load, min(loaded_at) AS came FROM a WHERE snz_uid IS NOT NULL GROUP BY 1, 2
  QUALIFY load = min(load) OVER (PARTITION BY snz_uid)),
n AS (SELECT load, row_number() OVER (ORDER BY load, came NULLS LAST, snz_uid) - 1 AS seq FROM g)
SELECT l.load, count(*) AS members, count(*) FILTER (WHERE {_CHOSEN}) AS chosen, 0::BIGINT AS lost
FROM (SELECT unnest([1, 2, 3]) AS load) l JOIN n ON n.load <= l.load GROUP BY 1"""

_WORDS = """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
n AS (SELECT doc_id, i, x || chr(10) || lead(x, 1) OVER d || chr(10) || lead(x, 2) OVER d || chr(10) || lead(x, 3) OVER d || chr(10) || lead(x, 4) OVER d AS five
  FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, five ORDER BY i) AS k FROM n WHERE five IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + o) AS repeated FROM g, (SELECT unnest(range(0, 5)) AS o) WHERE k > 1 GROUP BY 1)
"""

SQL = {
    "p1_found": f"""
WITH v AS (SELECT {fold_sql('label_measure')} AS k, value_measure AS x FROM output_long_thin
  WHERE value_measure IS NOT NULL AND NOT isnan(value_measure)),
r AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS i, count(*) OVER (PARTITION BY k) AS n FROM v WHERE k IS NOT NULL)
SELECT m.label_measure, m.pct FROM measure_limits m JOIN r ON {fold_sql('m.label_measure')} = r.k
  AND r.i = greatest(1, CAST(ceil(m.pct * r.n / 100.0) AS BIGINT))
WHERE x < low_value OR x > high_value""",
    "p4_sample": _SAMPLE + "SELECT snz_uid, seq FROM s",
    "p4_rows": _SAMPLE
    + """SELECT * REPLACE (CASE WHEN NOT isnan(value_measure) THEN value_measure END AS value_measure), coalesce(isnan(value_measure), false) AS is_nan
FROM output_long_thin WHERE identity_column IN (SELECT snz_uid FROM s)""",
    "p4_growth": _GROWTH,
    "p1_ranks": f"""
SELECT {fold_sql('label_measure')} AS key, count(*) AS n, 0::BIGINT AS beyond FROM output_long_thin
WHERE value_measure IS NOT NULL AND NOT isnan(value_measure) AND {fold_sql('label_measure')} IS NOT NULL GROUP BY 1""",
    "p6_decode": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_properties": "SELECT count(*) AS documents, 0::BIGINT AS lost, 0::BIGINT AS overfull, 0::BIGINT AS split, true AS tight FROM documents",
    "p8_planted": f"SELECT lang, source, {PLANTED}::BIGINT AS planted, {PLANTED}::BIGINT AS found, true AS few_rejected FROM documents GROUP BY ALL",
    "p6_lost": "SELECT doc_id FROM documents WHERE false",
    "p8_found": _WORDS + "SELECT t.doc_id FROM t JOIN r ON t.doc_id = r.doc_id WHERE repeated * 5 > len(w) * 2",
    "p8_shares": _WORDS
    + "SELECT t.doc_id, coalesce(len(w), 0) AS words, coalesce(repeated, 0) AS repeated FROM t LEFT JOIN r ON t.doc_id = r.doc_id",
}
