"""Domain statistics and alignment.

One pass over the rows gives the moments of all features and the label per
domain (``moment_store``): tasks hold count, means and centred cross-products,
which merge exactly, and Spark merges them in a tree, so only d x d numbers
(d = number of columns, a schema bound) reach the driver.  Correlations,
similarities, F scores and every covariance block of CORAL are cut from them.
The row transform is a linear map applied per Arrow batch with numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint, show_workers_the_package
from .cutpoints import cut_points, up_to
from .selection import feature_similarity, threshold_features, top_ratio_features

# Fixed value: ridge added to both covariances.
CORAL_EPS = 1e-6


@dataclass
class Moments:
    """Count, means and centred cross-products of the rows without a null."""

    features: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray
    dropped: int = 0          # rows left out because of a null

    def cut(self, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """(means, sample covariance, rows) of some of the features."""
        if self.n < 2:
            raise ValueError("need at least two complete rows for a covariance")
        at = [self.features.index(f) for f in features]
        return self.mean[at], self.cross[np.ix_(at, at)] / (self.n - 1), self.n

    def correlations(self, label: str) -> dict[str, float | None]:
        """Pearson correlation of every feature with ``label`` (None: constant)."""
        y = self.features.index(label)
        spread = np.diag(self.cross)
        flat = spread <= 1e-20 * self.n * (1 + self.mean ** 2)
        return {f: None if flat[i] or flat[y] else float(self.cross[i, y] / np.sqrt(spread[i] * spread[y]))
                for i, f in enumerate(self.features) if i != y}

    def f_scores(self, label: str) -> dict[str, float | None]:
        """Univariate regression F statistic of every feature."""
        return {f: None if r is None or r * r >= 1 else r * r / (1 - r * r) * (self.n - 2)
                for f, r in self.correlations(label).items()}


def _merged(a: dict, b: dict) -> dict:
    """Moments of two sets of rows, by domain."""
    out = dict(a)
    for key, (n, dropped, mean, cross) in b.items():
        if key not in out:
            out[key] = (n, dropped, mean, cross)
            continue
        m, lost, centre, products = out[key]
        if not n or not m:
            out[key] = (n, dropped + lost, mean, cross) if n else (m, dropped + lost, centre, products)
            continue
        step = mean - centre
        out[key] = (n + m, dropped + lost, centre + step * (n / (n + m)), products + cross + np.outer(step, step) * (n * m / (n + m)))
    return out


def moments_by(df: DataFrame, features: Sequence[str], by: str | None = None) -> dict[str, Moments]:
    """Moments of ``features`` per value of ``by`` (a bounded column such
    as the domain; one value, the empty string, without), in one pass."""
    show_workers_the_package(df.sparkSession)
    names = list(dict.fromkeys(features))
    d = len(names)
    values = "array(" + ", ".join(f"CAST(`{f}` AS DOUBLE)" for f in names) + ")"
    rows = df.select((F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")).alias("k"), F.expr(values).alias("x"),
                     F.expr(f"exists({values}, v -> v IS NULL)").alias("gap"))

    def sums(batches):
        import pyarrow as pa
        held: dict = {}
        for batch in batches:
            keys, gap = batch.column("k").to_numpy(zero_copy_only=False), batch.column("gap").to_numpy(zero_copy_only=False).astype(bool)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for key in np.unique(keys):
                part = x[(keys == key) & ~gap]
                mean = part.mean(axis=0) if len(part) else np.zeros(d)
                centred = part - mean
                held = _merged(held, {key: (len(part), int(np.sum((keys == key) & gap)), mean, centred.T @ centred)})
        for key, (n, dropped, mean, cross) in held.items():
            yield pa.RecordBatch.from_pydict({"k": [key], "n": pa.array([n], pa.int64()), "dropped": pa.array([dropped], pa.int64()),
                                              "mean": pa.array([mean.tobytes()], pa.binary()), "product": pa.array([cross.tobytes()], pa.binary())})

    found = rows.mapInArrow(sums, "k string, n long, dropped long, mean binary, product binary").rdd.map(
        lambda r: {r["k"]: (r["n"], r["dropped"], np.frombuffer(r["mean"]), np.frombuffer(r["product"]).reshape(d, d))})
    total = found.treeAggregate({}, _merged, _merged)
    return {key: Moments(names, n, mean, cross, dropped) for key, (n, dropped, mean, cross) in total.items()}


def moment_store(frames: dict[str, DataFrame], features: Sequence[str], label: str | None = None) -> dict[str, Moments]:
    """Moments of ``features`` and ``label`` for named frames, in one job."""
    names = [*features, *([label] if label and label not in features else [])]
    both = None
    for name, f in frames.items():
        part = f.selectExpr(f"'{name}' AS _domain", *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in names])
        both = part if both is None else both.unionByName(part)
    found = moments_by(both, names, "_domain")
    empty = Moments(names, 0, np.zeros(len(names)), np.zeros((len(names), len(names))))
    return {name: found.get(name, empty) for name in frames}


def domain_moments(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector and sample covariance of ``features``."""
    return moment_store({"": df}, features)[""].cut(features)


def covariance_long(df: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """A20 as a frame: (by, f1, f2, cov) with the sample covariance of every
    pair i <= j (null with fewer than two rows): d (d + 1) / 2 rows a domain."""
    found = moments_by(df, features, by)
    rows = [(key, a, b, float(m.cross[i, j] / (m.n - 1)) if m.n > 1 else None) for key, m in found.items()
            for i, a in enumerate(m.features) for j, b in enumerate(m.features) if i <= j]
    out = df.sparkSession.createDataFrame(rows, f"{by or '_k'} string, f1 string, f2 string, cov double")
    return out if by else out.drop("_k")


def _sqrtm(c: np.ndarray, inverse: bool = False) -> np.ndarray:
    vals, vecs = np.linalg.eigh(c)
    vals = np.clip(vals, 1e-12, None)
    p = -0.5 if inverse else 0.5
    return (vecs * vals ** p) @ vecs.T


def coral_map(moments: dict[str, Moments], features: Sequence[str], eps: float = CORAL_EPS):
    """Linear map of standard CORAL: x' = (x - mu_s) A + mu_t with
    A = (C_s + eps I)^-1/2 (C_t + eps I)^1/2."""
    mu_s, c_s, _ = moments["source"].cut(features)
    mu_t, c_t, _ = moments["target"].cut(features)
    eye = np.eye(len(features))
    a = _sqrtm(c_s + eps * eye, inverse=True) @ _sqrtm(c_t + eps * eye)
    return mu_s, a, mu_t


def apply_linear_map(df: DataFrame, features: Sequence[str], mu_s: np.ndarray, a: np.ndarray,
                     mu_t: np.ndarray) -> DataFrame:
    """Overwrite ``features`` with (x - mu_s) A + mu_t, other columns kept.
    The d x d matrix travels with the task closure (bounded by d^2)."""
    features = list(features)
    out_schema = T.StructType([
        T.StructField(f.name, T.DoubleType(), True) if f.name in features else f for f in df.schema.fields])
    mu_s = np.asarray(mu_s, dtype=float)
    mu_t = np.asarray(mu_t, dtype=float)
    a = np.asarray(a, dtype=float)

    def transform(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            pdf[features] = (x - mu_s) @ a + mu_t
            yield pdf

    return df.mapInPandas(transform, out_schema)


def _store(source, target, features, label, moments):
    return moments if moments is not None else moment_store({"source": source, "target": target}, features, label)


def coral_align(source: DataFrame, target: DataFrame, features: Sequence[str], eps: float = CORAL_EPS,
                moments: dict[str, Moments] | None = None) -> DataFrame:
    """Standard CORAL of the source onto the target over ``features``.
    ``moments`` (of these features and maybe others) saves the pass over both."""
    if not features:
        return source
    if moments is None or any(m.dropped for m in moments.values()):      # a null elsewhere must not drop a row
        moments = moment_store({"source": source, "target": target}, features)
    return apply_linear_map(source, features, *coral_map(moments, features, eps))


def similarity(source: DataFrame, target: DataFrame, features: Sequence[str], label: str,
               moments: dict[str, Moments]) -> dict[str, float | None]:
    """D1 from the moments: 1 - |corr_source - corr_target| (None: a constant).
    With nulls the correlations are of the rows that have both values."""
    if any(m.dropped for m in moments.values()):
        return {r["feature"]: r["similarity"] for r in feature_similarity(source, target, features, label).collect()}
    s, t = (moments[d].correlations(label) for d in ("source", "target"))
    return {f: None if s[f] is None or t[f] is None else 1.0 - abs(s[f] - t[f]) for f in features}


def partial_coral(source: DataFrame, target: DataFrame, features: Sequence[str], label: str, top_ratio: float = 0.3,
                  eps: float = CORAL_EPS, moments: dict[str, Moments] | None = None) -> tuple[DataFrame, list[str]]:
    """D3: align only the int(n * top_ratio) features whose label correlation
    is most alike in both domains; the others stay as they are."""
    moments = _store(source, target, features, label, moments)
    chosen = top_ratio_features(similarity(source, target, features, label, moments), top_ratio)
    return coral_align(source, target, chosen, eps, moments), chosen


def threshold_coral(source: DataFrame, target: DataFrame, features: Sequence[str], label: str, threshold: float = 0.5,
                    eps: float = CORAL_EPS, moments: dict[str, Moments] | None = None) -> tuple[DataFrame, list[str]]:
    """Align the features with similarity > threshold (all if none)."""
    moments = _store(source, target, features, label, moments)
    chosen = threshold_features(similarity(source, target, features, label, moments), threshold)
    return coral_align(source, target, chosen, eps, moments), chosen


def adaptive_coral(source: DataFrame, target: DataFrame, features: Sequence[str], label: str, similarity_threshold: float = 0.7,
                   eps: float = CORAL_EPS, moments: dict[str, Moments] | None = None) -> tuple[DataFrame, list[str]]:
    """Our reading of the adaptive variant: D4 at threshold 0.7."""
    return threshold_coral(source, target, features, label, similarity_threshold, eps, moments)


def standardized_distance(source: DataFrame, target: DataFrame, features: Sequence[str], out: str = "distance") -> DataFrame:
    """Distance of each source row to the target centroid in target-standardized
    units: sqrt(sum(((x - mu_t) / sd_t)^2)); a constant target feature (sd 0)
    contributes nothing."""
    st = target.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)],
                    *[F.stddev_samp(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)]).first()
    terms = []
    for i, f in enumerate(features):
        m, s = st[f"m{i}"], st[f"s{i}"]
        if s is None or s == 0 or m is None:
            continue
        z = (F.col(f).cast("double") - F.lit(m)) / F.lit(s)
        terms.append(z * z)
    total = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
    return source.withColumn(out, F.sqrt(total))


def ntile_from_rank(rn, n: int, k: int):
    """ntile(k) (1-based) of a 0-based row number among n rows."""
    q, r = divmod(n, k)
    big = r * (q + 1)
    if q == 0:
        return rn + 1
    return F.when(rn < big, F.floor(rn / (q + 1)) + 1).otherwise(F.floor((rn - big) / q) + r + 1).cast("int")


def tier_ends(n: int, k: int) -> list[int]:
    """Last row numbers of the first k - 1 of k equal-count groups of n rows
    (as ntile cuts them: the first n mod k groups have one row more)."""
    q, r = divmod(n, k)
    return [i * q + min(i, r) for i in range(1, k)]


def distance_tiers(source: DataFrame, target: DataFrame, features: Sequence[str], key_cols: Sequence[str],
                   tiers: int = 3) -> DataFrame:
    """Source rows split into ``tiers`` equal-count groups by distance to
    the target (1 = closest); rows are ordered by (distance, key).  The borders
    are found by counting, so no row is moved."""
    order = ["distance", *key_cols]
    rows = reliable_checkpoint(standardized_distance(source, target, features))
    ends = tier_ends(rows.count(), tiers)
    points = cut_points(rows, order, {str(i): end for i, end in enumerate(ends)})
    tier = F.lit(1)
    for i, end in enumerate(ends):
        if end == 0 or points[str(i)] is not None:
            tier = tier + (F.lit(1) if end == 0 else (~up_to(order, points[str(i)])).cast("int"))
    return rows.withColumn("tier", tier.cast("int"))


def sample_selection(source: DataFrame, target: DataFrame, features: Sequence[str], key_cols: Sequence[str],
                     n_clusters: int = 20, selection_ratio: float = 0.7, seed: int = 2018) -> DataFrame:
    """Keep the int(n * ratio) source rows nearest to a k-means centre of
    the standardized target (ties by key)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    va = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(va.transform(target))
    tz = scaler.transform(va.transform(target))
    km = KMeans(k=max(2, n_clusters), featuresCol="_z", seed=seed).fit(tz)  # fewer centres if there are fewer points
    centres = np.array([np.asarray(c) for c in km.clusterCenters()])

    @F.pandas_udf(T.DoubleType())
    def nearest(z):
        import pandas as pd
        x = np.stack(z.to_numpy()) if len(z) else np.zeros((0, centres.shape[1]))
        d2 = (x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1)  # batch x clusters
        return pd.Series(np.sqrt(np.maximum(d2.min(axis=1), 0)))

    from pyspark.ml.functions import vector_to_array
    sz = scaler.transform(va.transform(source)).withColumn("_dist", nearest(vector_to_array("_z")))
    order = ["_dist", *key_cols]
    near = reliable_checkpoint(sz.select(F.round("_dist", 9).alias("_dist"), *key_cols))
    point = cut_points(near, order, {"": int(near.count() * selection_ratio)})[""]
    chosen = near.where(up_to(order, point) if point else F.lit(False)).select(*key_cols)
    return source.join(chosen, list(key_cols), "left_semi")


def project_2d(frames: dict[str, DataFrame], features: Sequence[str], seed: int = 0) -> DataFrame:
    """2-D PCA projection of standardized rows of several domains, with a
    ``domain`` column (replaces the single-machine t-SNE)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    both = None
    for name, f in frames.items():
        part = f.select(*[F.col(c).cast("double") for c in features]).withColumn("domain", F.lit(name))
        both = part if both is None else both.unionByName(part)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
                            StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True),
                            PCA(k=2, inputCol="_z", outputCol="_pc")])
    out = pipe.fit(both).transform(both).withColumn("_a", vector_to_array("_pc"))
    return out.select("domain", F.col("_a")[0].alias("dim1"), F.col("_a")[1].alias("dim2"))
