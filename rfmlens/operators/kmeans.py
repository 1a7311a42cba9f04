"""EXT-2, k-means whose result is a function of the rows and the seed (ML-3..6, OP-15, OP-16).

Sums of doubles depend on the order in which tasks end, and k-means|| on the rows that a partition holds, so equal data in another layout can give
other labels. Here nothing depends on the layout:

* **Fixed point.** A feature is rounded to ``1 / FRACTION``, its spread comes from exact integer sums, and the scaled feature is a whole number of
  ``1 / UNIT`` standard deviations (no centring, as the reference). Distances and sums of points are whole numbers, centres are rounded down to one.
* **Start centres** by weighted sampling (k-means++): each row has a uniform number from the hash of its key and the round; the row with the smallest
  ``-ln(u) / w``, for w its squared distance to the nearest centre so far, is a draw in proportion to w. One ``min_by`` aggregate a centre. The first k
  centres of one sequence start the fit of every k.
* **Lloyd steps for all k at once.** One scan labels each row for every k that still moves; sums are keyed by (k, centre), so a step is one job of a few
  dozen rows whatever the number of fits. A fit ends when no centre changed, which whole numbers make exact, or after ``max_iter`` steps.
  Centres are array constants, walked by higher-order functions: the generated code stays as small for a sweep as for one fit, and is compiled once.
* **Silhouettes for all k at once** from the clusters' sums in closed form, each row's rounded down to ``1e-9`` before it is added.

Only centres, their counts and one number a fit come to the driver. Ties go to the lower centre, rows with equal draws to the smaller key; labels are
numbered by the order of the centres. Keys must be unique; with fewer different points than k, a fit has fewer centres.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfmlens.config import DEFAULT_SEED
from rfmlens.session import cut_lineage

FRACTION = 1000
UNIT = 4096
#: Silhouettes are added in these parts.
PART = 1_000_000_000

Centres = list[tuple[int, ...]]


@dataclass
class Points:
    """rows: key and z0, z1, ... (staged); factors: from the rounded feature to z."""

    rows: DataFrame
    key: str
    features: tuple[str, ...]
    factors: tuple[float, ...]

    @property
    def z(self) -> list[Column]:
        return [F.col(f"z{i}") for i in range(len(self.features))]


@dataclass
class Fitted:
    """One fit: centres in their order, rows of each, cost (squared distances in ``UNIT``), steps taken, whether no centre moved at the end."""

    k: int
    centres: Centres
    counts: list[int]
    cost: int
    steps: int
    settled: bool


def _rounded(c: str) -> Column:
    """The feature in parts of 1 / FRACTION, through a float as the reference reads it; null where it isn't a number."""
    x = F.col(f"`{c}`").try_cast("float").cast("double")
    return F.when(~F.isnan(x), F.floor(x * F.lit(float(FRACTION)) + F.lit(0.5)))


def points_of(df: DataFrame, features: Sequence[str], key: str = "ifa") -> Points:
    """OP-14 in fixed point: rows with all features, scaled to unit sample standard deviation (a constant feature is 0)."""
    features = list(features)
    names = [f"q{i}" for i in range(len(features))]
    rows = cut_lineage(df.select(key, *[_rounded(c).alias(n) for c, n in zip(features, names)]).na.drop(subset=names), "rounded")
    wide = lambda n: F.col(n).cast("decimal(19,0)")
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(wide(n)) for n in names], *[F.sum(wide(n) * wide(n)) for n in names]).first()
    n, width = sums[0], len(names)
    factors = []
    for i in range(width):
        s1, s2 = int(sums[1 + i] or 0), int(sums[1 + width + i] or 0)
        spread = n * s2 - s1 * s1   # n * (n - 1) times the variance, exactly
        factors.append(float(UNIT) / math.sqrt(float(spread) / float(n * (n - 1))) if n > 1 and spread > 0 else 0.0)
    z = [F.floor(F.col(q).cast("double") * F.lit(f)).alias(f"z{i}") for i, (q, f) in enumerate(zip(names, factors))]
    return Points(cut_lineage(rows.select(key, *z), "points"), key, tuple(features), tuple(factors))


def _constant(centres: Centres) -> str:
    """The centres as one SQL array, which the planner folds into a single constant."""
    return "array(" + ",".join("array(" + ",".join(f"{int(x)}L" for x in c) + ")" for c in centres) + ")"


def _nearest(z: Sequence[Column], centres: Column) -> Column:
    """struct(d, j): squared distance and number of the nearest of an array of centres."""
    def far(c: Column, j: Column) -> Column:
        total = None
        for i, x in enumerate(z):
            d = (x - c[i]) * (x - c[i])
            total = d if total is None else total + d
        return F.struct(total.alias("d"), j.alias("j"))

    return F.array_min(F.transform(centres, far))


def _labels(z: Sequence[Column], centres: Mapping[int, Centres]) -> Column:
    """A struct(k, n: struct(d, j)) a fit, exploded."""
    fits = F.expr("array(" + ",".join(f"named_struct('k', {int(k)}, 'c', {_constant(c)})" for k, c in centres.items()) + ")")
    return F.explode(F.transform(fits, lambda f: F.struct(f["k"].alias("k"), _nearest(z, f["c"]).alias("n"))))


def _uniform(key: str, seed: int, turn: int) -> Column:
    text = F.concat(F.col(f"`{key}`").cast("string"), F.lit(f":{seed}:{turn}"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def start_centres(points: Points, k: int, seed: int = DEFAULT_SEED) -> Centres:
    """Up to k different centres: one pass of the points each."""
    z, out = points.z, []
    for turn in range(k):
        rows = points.rows.select(points.key, *z, _nearest(z, F.expr(_constant(out)))["d"].cast("double").alias("w")) if out else points.rows.withColumn("w", F.lit(1.0))
        draw = (-F.log(_uniform(points.key, seed, turn))) / F.col("w")
        got = rows.where(F.col("w") > 0).agg(F.min_by(F.struct(*z), F.struct(draw, F.col(f"`{points.key}`")))).first()[0]
        if got is None:
            break
        out.append(tuple(int(x) for x in got))
    return out


def fit_from(points: Points, starts: Mapping[int, Centres], max_iter: int = 20) -> dict[int, Fitted]:
    """ML-3 for several k at once: Lloyd steps from given centres. A centre that no row is nearest to stays."""
    z, width = points.z, len(points.features)
    centres = {k: [tuple(map(int, c)) for c in s] for k, s in starts.items() if s}
    steps, settled = dict.fromkeys(centres, 0), dict.fromkeys(centres, False)
    for _ in range(max_iter):
        moving = [k for k in centres if not settled[k]]
        if not moving:
            break
        sums = _sums(points, {k: centres[k] for k in moving})
        for k in moving:
            steps[k] += 1
            new = [tuple(sums[k, j][1][i] // sums[k, j][0] for i in range(width)) if (k, j) in sums else c for j, c in enumerate(centres[k])]
            settled[k] = new == centres[k]
            centres[k] = new
    ordered = {k: sorted(c) for k, c in centres.items()}
    sums = _sums(points, ordered) if ordered else {}
    return {k: Fitted(k, c, [sums[k, j][0] if (k, j) in sums else 0 for j in range(len(c))],
                      sum(sums[k, j][2] for j in range(len(c)) if (k, j) in sums), steps[k], settled[k]) for k, c in ordered.items()}


def _sums(points: Points, centres: Mapping[int, Centres]) -> dict[tuple[int, int], tuple[int, list[int], int]]:
    """(k, centre): rows, sums of the coordinates, squared distances. One job for all k: a task adds up its rows in
    whole arrays and sends one row a centre."""
    names = [f"z{i}" for i in range(len(points.features))]
    fixed = {k: list(c) for k, c in centres.items()}

    def run(batches):  # needs nothing of this library where it runs
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        def exact(x):  # the sum in parts that can't pass 64 bits
            return (int((x >> 32).sum()) << 32) + int((x & 0xFFFFFFFF).sum())

        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            most = max(max(abs(int(x.min())), abs(int(x.max()))) for x in z)
            for k, at in fixed.items():
                if (most + max(abs(x) for c in at for x in c)) ** 2 * len(z) >= 1 << 63 and max(
                        sum((x.astype(float) - v) ** 2 for x, v in zip(z, c)).max() for c in at) >= 2.0 ** 63:
                    raise OverflowError("squared distances pass 64 bits")
                far = np.stack([sum((x - v) * (x - v) for x, v in zip(z, c)) for c in at])
                own = far.argmin(axis=0)  # of equal distances the lower centre
                near = far[own, np.arange(len(own))]
                for j in np.unique(own).tolist():
                    of_j = own == j
                    new = [int(of_j.sum()), *[exact(x[of_j]) for x in z], exact(near[of_j])]
                    sums[k, j] = [a + b for a, b in zip(sums[k, j], new)] if (k, j) in sums else new
        if sums:
            columns = zip(*sums.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in sums], pa.int32()), pa.array([j for _, j in sums], pa.int32()),
                 *[pa.array([Decimal(x) for x in c], pa.decimal128(28, 0)) for c in columns]], ["k", "j", "n", *names, "d"])

    of_tasks = points.rows.select(*names).mapInArrow(run, "k int, j int, " + ", ".join(f"{c} decimal(28,0)" for c in ("n", *names, "d")))
    got = of_tasks.groupBy("k", "j").agg(*[F.sum(c) for c in ("n", *names, "d")]).collect()  # a row a centre
    return {(r[0], r[1]): (int(r[2]), [int(x) for x in r[3:-1]], int(r[-1])) for r in got}


def silhouettes(points: Points, fits: Mapping[int, Fitted]) -> dict[int, float]:
    """ML-5 for several fits at once: mean silhouette, squared Euclidean distance; a cluster of one row counts 0."""
    z = points.z
    fits = {k: f for k, f in fits.items() if sum(n > 0 for n in f.counts) > 1}
    if not fits:
        return {}
    norm = F.lit(0).cast("long")
    for x in z:
        norm = norm + x * x
    rows = points.rows.select(*z, norm.alias("norm"), _labels(z, {k: f.centres for k, f in fits.items()}).alias("t"))
    rows = rows.select(*z, "norm", "t.k", F.col("t.n.j").alias("own"))
    whole = lambda c: F.sum(c.cast("decimal(19,0)"))
    stats = rows.groupBy("k", "own").agg(F.count(F.lit(1)), whole(F.col("norm")), *[whole(c) for c in z]).collect()  # a row a centre
    told = []
    for k in fits:
        of_k = [f"named_struct('j', {j}, 'n', {float(n)!r}D, 'q', {float(q)!r}D, 's', array({','.join(f'{float(x)!r}D' for x in sums)}))"
                for kk, j, n, q, *sums in sorted(stats) if kk == k]
        told.append(f"{int(k)}, array({','.join(of_k)})")

    def total(c: Column) -> Column:
        """Squared distances from the row to all of a cluster."""
        cross = None
        for i, x in enumerate(z):
            part = x.cast("double") * c["s"][i]
            cross = part if cross is None else cross + part
        return F.struct(c["j"].alias("j"), c["n"].alias("n"), (F.col("norm").cast("double") * c["n"] + c["q"] - F.lit(2.0) * cross).alias("d"))

    own = F.col("own")
    rows = rows.select("k", "own", F.transform(F.element_at(F.expr(f"map({', '.join(told)})"), F.col("k")), total).alias("to"))
    rows = rows.select(
        "k", F.array_max(F.transform("to", lambda c: F.when(c["j"] == own, c["d"] / F.greatest(c["n"] - F.lit(1.0), F.lit(1.0))))).alias("a"),
        F.array_min(F.transform("to", lambda c: F.when(c["j"] != own, c["d"] / c["n"]))).alias("b"),
        F.exists("to", lambda c: (c["j"] == own) & (c["n"] == F.lit(1.0))).alias("single"))
    a, b = F.col("a"), F.col("b")
    s = F.when(F.col("single"), F.lit(0.0)).when(a < b, F.lit(1.0) - a / b).when(a > b, b / a - F.lit(1.0)).otherwise(F.lit(0.0))
    got = rows.groupBy("k").agg(F.count(F.lit(1)), F.sum(F.floor(s * F.lit(float(PART))))).collect()  # a row a fit
    return {k: float(s) / PART / n for k, n, s in got}


def fit(points: Points, k: int, seed: int = DEFAULT_SEED, max_iter: int = 20) -> Fitted | None:
    """OP-16: one fit; None for no rows."""
    return fit_from(points, {k: start_centres(points, k, seed)}, max_iter).get(k)


def sweep(points: Points, ks: Sequence[int], seed: int = DEFAULT_SEED, max_iter: int = 20) -> DataFrame:
    """OP-15 (ML-4, ML-5): k, silhouette, training_cost (in squared standard deviations), steps, for each k that has that many different points."""
    starts = start_centres(points, max(ks), seed)
    fits = fit_from(points, {k: starts[:k] for k in ks if k <= len(starts)}, max_iter)
    worth = silhouettes(points, fits)
    rows = [(int(k), worth.get(k), float(f.cost) / (UNIT * UNIT), int(f.steps)) for k, f in sorted(fits.items())]
    return points.rows.sparkSession.createDataFrame(rows, "k int, silhouette double, training_cost double, steps int")


def label(points: Points, fitted: Fitted, out: str = "cluster") -> DataFrame:
    """ML-6: key and label of every point."""
    return points.rows.select(points.key, _nearest(points.z, F.expr(_constant(fitted.centres)))["j"].cast("int").alias(out))


def label_rows(df: DataFrame, points: Points, fitted: Fitted, out: str = "cluster") -> DataFrame:
    """The rows of ``df`` that have all features, with their label: the same arithmetic on the row itself, without a join."""
    z = [F.floor(_rounded(c).cast("double") * F.lit(f)) for c, f in zip(points.features, points.factors)]
    complete = F.lit(True)
    for c in points.features:
        complete = complete & _rounded(c).isNotNull()
    return df.where(complete).withColumn(out, _nearest(z, F.expr(_constant(fitted.centres)))["j"].cast("int"))
