"""Repetition inside single documents, and documents whose repetition is out of line for their language and source.

repetition() measures whole texts with numpy, a batch at a time. outliers() estimates, per language and source, the
centre and shape of the transformed measures by minimum covariance determinant: from several fixed starts, concentration
steps that keep the nearest half of the rows and estimate again until the determinant stops falling; the start with the
least determinant counts, and a last estimate is made of all rows within the cut-off. All rows enter. Documents far from
their group's centre by Mahalanobis distance are rejected. Other starts may reach a lower determinant still: where nearly
half of a group has no repetition at all, the lowest one takes that half for out of line.

Scale: texts are never shuffled; each task leaves one row of six numbers per document. A group of up to GATHERED rows of
four numbers is estimated in one task; a step of a larger one aggregates map-side to one row per group and start, so a
group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.llm.words import text_bytes
from tallyloom.session import ship, write_shared

SPAN = 5
#: Multipliers of the running words of a span, odd numbers of 64 bits (fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], np.uint64)


def plain_words(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Number of words of each text, and all words: longest runs without space, tab, CR and LF."""
    out = (raw == 32) | (raw == 9) | (raw == 10) | (raw == 13)
    begin = ~out
    begin[1:] &= out[:-1]
    first = borders[:-1][(borders[:-1] < len(raw)) & (np.diff(borders) > 0)]
    begin[first] = ~out[first]
    at = np.flatnonzero(begin)
    kept = raw[~out]
    offsets = np.append(np.cumsum(~out)[at] - 1, len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(kept))
    return np.diff(np.searchsorted(at, borders)), words.dictionary_encode()


def repeated_words(n: np.ndarray, codes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each word whether it lies in `span` successive words that also stand from an earlier word of its text on.

    Spans are grouped by a 64-bit hash and then compared word by word, so the answer is exact.
    """
    repeated = np.zeros(len(codes), bool)
    doc = np.repeat(np.arange(len(n)), n)
    m = len(codes) - span + 1
    if m <= 0:
        return repeated
    at = np.flatnonzero(doc[:m] == doc[span - 1 :])
    if not len(at):
        return repeated
    c = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = doc[at].astype(np.uint64) * MIX[5]
        for k in range(span):
            h = (h ^ (h >> np.uint64(29))) * MIX[k % 5] + c[at + k]
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    head = at[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    again = np.flatnonzero(~new)
    same = doc[at[again]] == doc[head[again]]
    for k in range(span):
        same &= codes[at[again] + k] == codes[head[again] + k]
    hit = at[again[same]]
    if not same.all():  # different spans of one hash: told apart one by one
        group = np.cumsum(new)
        for g in np.unique(group[again[~same]]):
            seen = set()
            for i in at[group == g]:
                key = (doc[i], *codes[i : i + span])
                if key in seen:
                    hit = np.append(hit, i)
                seen.add(key)
    for k in range(span):
        repeated[hit + k] = True
    return repeated


def _sums(n: np.ndarray, values: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(n)])
    return ends[at[1:]] - ends[at[:-1]]


def _first_seen(n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each item whether it is the first of its kind in its text."""
    key = np.repeat(np.arange(len(n), dtype=np.int64), n) * (int(codes.max(initial=0)) + 1) + codes
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return first


def measure_batch(texts: pa.Array, span: int = SPAN) -> dict[str, np.ndarray]:
    """words, repeated, different words, bytes, bytes of lines that occurred before, of a batch of lower-case texts."""
    raw, borders, data = text_bytes(texts)
    if not len(raw):
        return {k: np.zeros(len(texts), np.int64) for k in ("words", "repeated", "kinds", "bytes", "line_bytes")}
    n, words = plain_words(raw, borders)
    codes = words.indices.to_numpy()
    line = np.zeros(len(raw) + 1, bool)
    line[borders] = True
    line[1:] |= raw == 10
    at = np.flatnonzero(line[:-1])
    lines = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), data)
    n_lines, sizes = np.diff(np.searchsorted(at, borders)), np.diff(np.append(at, len(raw)))
    old = ~_first_seen(n_lines, lines.dictionary_encode().indices.to_numpy()) & (sizes > 1)
    return {
        "words": n,
        "repeated": _sums(n, repeated_words(n, codes, span)),
        "kinds": _sums(n, _first_seen(n, codes)),
        "bytes": np.diff(borders),
        "line_bytes": _sums(n_lines, np.where(old, sizes, 0)),
    }


def repetition(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """id_col, keep, words, repeated, kinds, bytes, line_bytes, share: one row per row of df.

    A word is repeated if it lies in `span` successive words that also stand, in the same order, from an earlier word of
    the same text on; share is repeated / words, and 0 for texts without words, NULL and empty ones too. line_bytes
    counts lines other than empty ones that occurred before in the text. Case is ignored. Repeated rows and equal or NULL
    ids keep a row each. Texts are measured whole.
    """
    ship(df.sparkSession)
    cols = [F.col(id_col).alias("c0"), *[F.col(k).alias(f"c{i}") for i, k in enumerate(keep, 1)]]
    some = df.select(*cols, F.lower(F.col(text_col)).alias("text"))
    fields = some.schema.fields[:-1]
    names = [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure_batch(b.column(b.num_columns - 1), span)
            own = [b.column(i).cast(k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x.astype(np.int64)) for x in m.values()]], names=[*names, *m])

    out = some.mapInArrow(task, schema + ", words bigint, repeated bigint, kinds bigint, bytes bigint, line_bytes bigint")
    share = F.coalesce(F.try_divide(F.col("repeated"), F.col("words")), F.lit(0.0)).alias("share")
    return out.select(*[F.col(n).alias(o) for n, o in zip(names, (id_col, *keep))], "words", "repeated", "kinds", "bytes", "line_bytes", share)


# Robust outliers

X = ["x0", "x1", "x2", "x3"]
PAIRS = [(i, j) for i in range(len(X)) for j in range(i, len(X))]
#: Chi-square with 4 degrees of freedom: median and 97.5 percent point (fixed values).
CHI_MEDIAN, CHI_FAR = 3.3567, 11.1433
#: Groups of fewer rows have no estimate of their own, unless outliers() is told another number; ridge, in units of the scale.
LEAST, RIDGE = 50, 0.05
#: Groups of up to so many rows are estimated in one task each (7 MB), larger ones by aggregations over all tasks.
GATHERED = 200_000
#: Concentration ends when the logarithm of the determinant falls by no more.
FALL = 1e-9
#: A group's parameters take about 200 bytes; up to so many groups they are broadcast, beyond it joined by shuffle.
BROADCAST_GROUPS = 50_000


def vectors() -> list[Column]:
    """The transformed measures: logits of the shares of repeated words, repeated lines and word kinds; log of the length."""

    def logit(part: Column, of: Column) -> Column:
        p = (part + 0.5) / (of + 1.0)
        return F.log(p / (1 - p))

    c = F.col
    return [
        logit(c("repeated"), c("words")).alias("x0"),
        logit(c("line_bytes"), c("bytes")).alias("x1"),
        logit(c("kinds"), c("words")).alias("x2"),
        F.log1p(c("words")).alias("x3"),
    ]


Fit = tuple[np.ndarray, np.ndarray, float]


def _fit(n: float, sums: np.ndarray, squares: np.ndarray, scale: np.ndarray) -> Fit:
    """Mean, inverse covariance and log determinant, with a ridge so that equal columns don't make the covariance singular."""
    mean = sums / n
    cov = squares / n - np.outer(mean, mean) + np.diag(RIDGE * scale**2)
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _starts(quart: np.ndarray, scale: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and inverse shapes to begin with: the medians, or these with the lower or upper quartile of one measure, with
    the plain spreads."""
    centres = [quart[1]]
    for i in range(len(X)):
        for q in (0, 2):
            centres.append(quart[1].copy())
            centres[-1][i] = quart[q, i]
    return [(c, np.diag(scale**-2.0)) for c in centres]


def _scale(quart: np.ndarray) -> np.ndarray:
    return np.maximum((quart[2] - quart[0]) / 1.349, 0.1)


def _far(x: np.ndarray, centre: np.ndarray, inv: np.ndarray) -> np.ndarray:
    d = x - centre
    return ((d @ inv) * d).sum(axis=1)


def robust(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, inverse covariance and median squared distance of the rows of x: from each start concentration steps on the
    (n + p + 1) / 2 nearest rows until the determinant stops falling, the least determinant of all starts, and an estimate
    of all rows that are then within the cut-off. Rows at the same distance are taken together, so their order is no matter."""
    x = x[np.lexsort(x.T)]
    h = min(len(x), (len(x) + len(X) + 1) // 2)
    quart = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    scale = _scale(quart)
    of = lambda rows: _fit(len(rows), rows.sum(axis=0), rows.T @ rows, scale)
    best: Fit | None = None
    for centre, inv in _starts(quart, scale):
        last = np.inf
        while True:
            d = _far(x, centre, inv)
            new = of(x[d <= np.partition(d, h - 1)[h - 1]])
            if not new[2] < last - FALL:
                break
            centre, inv, last = new
            best = new if best is None or last < best[2] else best
    middle = lambda d: max(1e-9, float(np.quantile(d, 0.5, method="inverted_cdf")))
    d = _far(x, *best[:2])
    centre, inv, _ = of(x[d * CHI_MEDIAN / middle(d) <= CHI_FAR])
    return centre, inv, middle(_far(x, centre, inv))


_SHAPE = "grp string, start int, " + ", ".join([f"m{i} double" for i in range(len(X))] + [f"v{i}{j} double" for i, j in PAIRS]) + ", middle double"


def _shape_row(grp: str, start: int, centre: np.ndarray, inv: np.ndarray, middle: float) -> tuple:
    return (grp, start, *[float(v) for v in centre], *[float(inv[i, j]) for i, j in PAIRS], float(middle))


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    names = [f.split()[0] for f in _SHAPE.split(", ")]
    return pd.DataFrame([_shape_row(pdf["grp"].iloc[0], 0, *robust(pdf[X].to_numpy(float)))], columns=names)


def _large(rows: DataFrame) -> list[tuple]:
    """robust() of groups of any size: every step is two aggregations over the rows, for all groups and starts that still
    fall; the driver holds the fits, one per start of a large group. Half of the rows is by quantile sketch, to one part in
    10,000 of the rows."""
    spark = rows.sparkSession

    moments = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)]]
    moments += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS]

    def squares(r: Row) -> np.ndarray:
        m = np.zeros((len(X), len(X)))
        for i, j in PAIRS:
            m[i, j] = m[j, i] = r[f"q{i}{j}"]
        return m

    def distances(fits: dict[tuple[str, int], tuple]) -> DataFrame:
        shapes = spark.createDataFrame([_shape_row(*k, *f[:2], 0.0) for k, f in fits.items()], _SHAPE)
        return rows.join(F.broadcast(shapes), "grp").withColumn("d", _distance())

    def middles(far: DataFrame) -> DataFrame:
        return far.groupBy("grp", "start").agg(F.percentile_approx("d", 0.5, 10_000).alias("half"))

    def refit(fits: dict[tuple[str, int], tuple], factor: float) -> dict[tuple[str, int], Fit]:
        """The estimates of the rows no farther than factor times the median distance."""
        far = distances(fits)
        near = far.join(F.broadcast(middles(far)), ["grp", "start"]).where(F.col("d") <= F.greatest("half", F.lit(1e-9 if factor > 1 else 0.0)) * factor)
        sums = near.groupBy("grp", "start").agg(*moments).collect()
        return {(r["grp"], r["start"]): _fit(r["n"], np.array([r[f"s{i}"] for i in range(len(X))]), squares(r), scales[r["grp"]]) for r in sums}

    quarts = rows.groupBy("grp").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"p{i}") for i, x in enumerate(X)]).collect()
    quart = {r["grp"]: np.array([r[f"p{i}"] for i in range(len(X))]).T for r in quarts}
    scales = {g: _scale(q) for g, q in quart.items()}
    falling = {(g, k): (*s, np.inf) for g, q in quart.items() for k, s in enumerate(_starts(q, scales[g]))}
    best: dict[tuple[str, int], Fit] = {}
    while falling:
        falling = {k: new for k, new in refit(falling, 1.0).items() if new[2] < falling[k][2] - FALL}
        for (g, _), new in falling.items():
            if (g, 0) not in best or new[2] < best[g, 0][2]:
                best[g, 0] = new
    best = refit(best, CHI_FAR / CHI_MEDIAN)
    return [_shape_row(r["grp"], 0, *best[r["grp"], 0][:2], max(1e-9, r["half"])) for r in middles(distances(best)).collect()]


def _distance() -> Column:
    d = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + d[i] * d[j] * F.col(f"v{i}{j}") * (1 if i == j else 2)
    return total


def outliers(measures: DataFrame, id_col: str, by: tuple[str, ...], least: int = LEAST) -> DataFrame:
    """id_col, by, share, distance, rejected, above, level: each document's squared robust distance from its group, in units
    in which the group's median is that of a chi-square variable, whether it is beyond that variable's 97.5 percent point, and
    whether more of its words are repeated than at the group's centre: documents rejected and above repeat themselves.

    Groups are the combinations of by, NULL being a value. A document of a group of fewer than `least` rows is judged by the
    first of these that has as many: all rows with its first value of by, with its second, and so on; else by all rows. level
    names what judged it: the columns of by with commas, one of them, or 'all'. Rows without words belong to their group like
    others. All rows enter every estimate.
    """
    spark = measures.sparkSession
    ship(spark)
    levels = [tuple(by), *[(b,) for b in by if len(by) > 1], ()]

    def key(k: int) -> Column:
        return F.concat_ws("\x1f", F.lit(str(k)), *[F.coalesce(F.col(b).cast("string"), F.lit("\x1e")) for b in levels[k]])

    keys = [f"key{k}" for k in range(len(levels))]
    rows = measures.select(F.col(id_col).alias("id"), *by, "share", *vectors(), *[key(k).alias(c) for k, c in enumerate(keys)])
    rows = write_shared(rows, "measures")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n0"))
    few = sizes.count() <= BROADCAST_GROUPS
    small = F.broadcast if few else (lambda t: t)
    judges = sizes
    for k, c in enumerate(keys[1:], 1):
        judges = judges.join(small(sizes.groupBy(c).agg(F.sum("n0").alias(f"n{k}"))), c)
    first = [F.when(F.col(f"n{k}") >= least, F.struct(F.col(c).alias("grp"), F.lit(",".join(levels[k]) or "all").alias("level"), F.col(f"n{k}").alias("n"))) for k, c in enumerate(keys)]
    last = F.struct(F.col(keys[-1]).alias("grp"), F.lit("all").alias("level"), F.col(f"n{len(keys) - 1}").alias("n"))
    judges = write_shared(judges.select("key0", F.coalesce(*first, last).alias("j")).select("key0", "j.*"), "judges")
    grouped = rows.join(small(judges.drop("n")), "key0")

    counts = judges.select("grp", "n").distinct()
    ask = rows.select(F.explode(F.array(*keys)).alias("grp"), *X).join(small(counts.select("grp")), "grp", "left_semi")
    large = [r["grp"] for r in counts.where(F.col("n") > GATHERED).collect()]
    named = F.broadcast(spark.createDataFrame([(g,) for g in large], "grp string"))
    fit = (ask.join(named, "grp", "left_anti") if large else ask).groupBy("grp").applyInPandas(_gathered, _SHAPE)
    if large:
        fit = fit.unionByName(spark.createDataFrame(_large(ask.join(named, "grp")), _SHAPE))
    fit = write_shared(fit, "shape")
    out = grouped.join(small(fit), "grp").withColumn("distance", _distance() * CHI_MEDIAN / F.col("middle"))
    return out.select(F.col("id").alias(id_col), *by, "share", "distance", (F.col("distance") > CHI_FAR).alias("rejected"), (F.col("x0") > F.col("m0")).alias("above"), "level")
