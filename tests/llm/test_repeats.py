import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import repeats as r

SCHEMA = "doc_id bigint, text string, lang string, source string, words string, share string, x0 string"


def brute(text, span=5):
    w = [x for x in re.split("[ \t\r\n]+", (text or "").lower()) if x]
    seen, hit = set(), set()
    for i in range(len(w) - span + 1):
        g = tuple(w[i : i + span])
        if g in seen:
            hit.update(range(i, i + span))
        seen.add(g)
    return len(w), len(hit), len(set(w))


words = st.lists(st.sampled_from(["a", "b", "A", "é", "c d", "\n", "\r", "\t\t", ""]), max_size=60).map(" ".join)


@given(st.lists(st.one_of(st.none(), words), max_size=6))
@settings(max_examples=300, deadline=None)
def test_measures_against_brute_force(texts):
    m = r.measure_batch(pa.array([None if t is None else t.lower() for t in texts], pa.string()))
    assert [tuple(x) for x in zip(m["words"], m["repeated"], m["kinds"])] == [brute(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(r, "MIX", np.zeros(6, np.uint64))  # now only the span's last word decides
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(30)]
    m = r.measure_batch(pa.array(texts))
    assert list(zip(m["words"], m["repeated"])) == [brute(t)[:2] for t in texts]


def test_repeated_lines():
    m = r.measure_batch(pa.array(["one\ntwo\none\n\n\none\n", "one\n"]))
    assert m["line_bytes"].tolist() == [8, 0] and m["bytes"].tolist() == [18, 4]


def test_table(spark):
    texts = [None, "", "  \n", "a b c d e a b c d e", "x " * 20000, "A b C d e f A B c D E"]
    df = spark.createDataFrame([(i, t, None, "s", "w", "s", "x") for i, t in enumerate(texts)] + [(3, texts[3], "l", "s", "w", "s", "x")], SCHEMA)
    got = sorted((x["doc_id"], x["lang"] or "", x["words"], x["repeated"], x["share"]) for x in r.repetition(df, "doc_id", "text", ("lang",)).collect())
    want = sorted((i, "", *brute(t)[:2], brute(t)[1] / max(1, brute(t)[0])) for i, t in enumerate(texts))
    assert got == sorted([*want, (3, "l", 10, 5, 0.5)])
    assert r.repetition(df.where("false"), "doc_id", "text").count() == 0


def test_outliers_are_found_per_group(spark):
    """Documents full of repetition stand out from their group, and the bulk of a group with much repetition does not."""
    rng = random.Random(7)
    rows, planted = [], set()
    for i in range(900):
        tame = i % 3 > 0
        vocabulary = [f"w{k}" for k in range(3000)] if tame else [f"w{k}" for k in range(6)]
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80, 160)))
        if tame and i % 60 == 1:
            text = "buy this fine thing now today\n" * 25
            planted.add(i)
        rows.append((i, text, "en" if tame else None, "s", "w", "s", "x"))
    rows += [(1000 + i, "few of these " + str(i), "xx", "s", "w", "s", "x") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {x["doc_id"]: x for x in r.outliers(r.repetition(df, "doc_id", "text", ("lang", "source")), "doc_id", ("lang", "source")).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["rejected"] and out[i]["above"] for i in planted)
    rest = [x for i, x in out.items() if i not in planted and i < 1000]
    assert np.mean([x["rejected"] for x in rest]) < 0.12
    assert all(x["distance"] >= 0 for x in out.values())


def test_a_third_of_a_group_may_be_repetitive(spark):
    rng = random.Random(11)
    rows, planted = [], set()
    for i in range(300):
        text = " ".join(rng.choice([f"w{k}" for k in range(3000)]) for _ in range(rng.randrange(80, 160)))
        if i % 3 == 0:
            some = " ".join(rng.choice([f"w{k}" for k in range(3000)]) for _ in range(rng.randrange(5, 30)))
            text = (" ".join(f"s{rng.randrange(50)}" for _ in range(rng.randrange(5, 9))) + "\n") * rng.randrange(8, 30) + some
            planted.add(i)
        rows.append((i, text, "en", "s", "w", "s", "x"))
    m = r.repetition(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", ("lang", "source"))
    out = {x["doc_id"]: x for x in r.outliers(m, "doc_id", ("lang", "source")).collect()}
    assert all(out[i]["rejected"] and out[i]["above"] for i in planted)
    assert np.mean([x["rejected"] for i, x in out.items() if i not in planted]) < 0.12


def measured(spark, x, by):
    """Measures whose transformed values are the rows of x, the logarithm of the length moved to 12."""
    words = np.round(np.exp(12 + x[:, 3])).astype(int)
    part = lambda v, n: np.round(n / (1 + np.exp(-v))).astype(int)
    cols = (np.arange(len(x)), part(x[:, 0], words), part(x[:, 1], 6 * words), part(x[:, 2], words), words, 6 * words)
    rows = [(*map(int, c), *b, 0.0) for c, b in zip(zip(*cols), by)]
    return spark.createDataFrame(rows, "doc_id bigint, repeated bigint, line_bytes bigint, kinds bigint, words bigint, bytes bigint, lang string, source string, share double")


@pytest.mark.parametrize("gathered", [200_000, 100])
def test_the_least_determinant_is_sought(spark, monkeypatch, gathered):
    """Two of five rows lie where the steps from the medians alone run into them; both ways of estimating have to see it."""
    monkeypatch.setattr(r, "GATHERED", gathered, raising=False)
    g = np.random.default_rng(1)
    bulk = g.normal(size=(240, 4)) @ np.array([[1, 0, 0, 0], [0.9, 0.3, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0.5]]).T
    x = np.r_[bulk, g.normal(size=(160, 4)) * 0.6 + [4, 0, -4, 0]]
    out = r.outliers(measured(spark, x, [("en", "s")] * 400), "doc_id", ("lang", "source")).collect()
    rejected = {x["doc_id"] for x in out if x["rejected"]}
    assert len(out) == 400 and rejected >= set(range(240, 400)) and len(rejected) < 170


def test_small_groups_are_judged_by_what_is_nearest(spark):
    by = [("en", "a")] * 120 + [("de", "a")] * 60 + [("de", "b")] * 20 + [("fr", "a")] * 20 + [("fr", "c")] * 20 + [(None, "c")] * 5
    g = np.random.default_rng(3)
    x = g.normal(size=(len(by), 4))
    x[:120] += [0, 0, 4, 0]
    out = {x["doc_id"]: x for x in r.outliers(measured(spark, x, by), "doc_id", ("lang", "source")).collect()}
    want = {("en", "a"): "lang,source", ("de", "a"): "lang,source", ("de", "b"): "lang", ("fr", "a"): "source", ("fr", "c"): "all", (None, "c"): "all"}
    assert len(out) == len(by) and all(out[i]["level"] == want[b] for i, b in enumerate(by))
    for like, judged in ((range(120, 200), range(180, 200)), (range(len(by)), range(220, 245))):
        centre, inv, middle = r.robust(x[list(like)])
        assert np.allclose([out[i]["distance"] for i in judged], r._far(x[list(judged)], centre, inv) * r.CHI_MEDIAN / middle, rtol=0.01)


def test_outliers_of_nothing_and_of_equal_rows(spark):
    df = spark.createDataFrame([(i, "same words here", None, None, "w", "s", "x") for i in range(80)], SCHEMA)
    m = r.repetition(df, "doc_id", "text", ("lang", "source"))
    got = r.outliers(m, "doc_id", ("lang", "source")).collect()
    assert len(got) == 80 and not any(x["rejected"] for x in got)
    assert r.outliers(m.where("false"), "doc_id", ("lang", "source")).count() == 0
