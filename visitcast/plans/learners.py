"""Learners (M3, M4, M7, S8): gradient boosted histogram trees as Spark passes.

The feature vectors are assembled and cut into bins once and stored in blocks
(one byte a value); no round writes them again.  The only thing that changes is
a ledger with one number a row, the score so far; it is written to the checkpoint
folder every ``ledger_every`` rounds and then zipped to the blocks once, in the
executors' storage, and a pass adds the few trees grown since then.

A round is one pass per tree level.  Tasks add up count, weight and weighted
residual by (node, feature, bin) and Spark adds the tasks' histograms; the first
pass of a round also brings the validation error of the last tree, so no job is
spent on it.  Beyond ``FAN_IN`` partitions the histograms are added by a shuffle
and the best split of a node is found on the executors; only splits reach the
driver.  Several fits (a grid, an ensemble, all recipes) go through the same
passes (``boost_all``), each with its own parameters and patience; fits on the
same rows share their blocks and have a ledger each.

Rows are taken or left by a generator seeded with round and block, features by
one seeded with the round: a retried task sees the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import reliable_checkpoint, show_workers_the_package
from ..sources import io

BLOCK_ROWS = 4096
JOINED_ROWS = 1 << 16                 # blocks are joined up to that many rows: a numpy call has enough to do
SMALL_TREE = 8                        # splits of a tree whose rows are routed column by column
SKETCH_TASKS = 32
LOCAL_CELLS, LOCAL_ROUNDS = 1 << 25, 50       # bins one core reads in less time than a pass takes to start; rounds worth moving them
FEW_CELLS = 1 << 19                   # bins that are counted in one call, whatever their column
PAIR_CELLS = 1 << 14                  # cells of a joint histogram that stay in a core's cache
TASK_ROWS, LEAST_TASK_ROWS = 1_000_000, 4096
FAN_IN = 16
THREADS = 4
SKETCH_FEATURES = 16                  # sketched in one group
EDGE_ACCURACY = 500                   # rank error of the bin borders: 1 / 500
TREE_SCHEMA = ("part int, tree int, step double, node int, feature int, bin int, threshold double, left int, right int,"
               " value double, gain double")


@dataclass(frozen=True)
class GBTParams:
    """Fixed default values of the modelled experiments."""

    max_depth: int = 9
    max_leaves: int = 255
    min_leaf: int = 50
    step_size: float = 0.007
    feature_fraction: float = 0.6
    bagging_fraction: float = 0.8
    max_iter: int = 6000
    patience: int = 500
    seed: int = 2018
    max_bins: int = 32

    def replace(self, **kw) -> "GBTParams":
        return replace(self, **kw)


# -------------------------------------------------------------------- models --

def leaf_of(tree: dict, x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Leaf of every row; missing values go left."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        feature = tree["feature"][node]
        inner = feature >= 0
        if not inner.any():
            return node
        right = x[rows, np.maximum(feature, 0)] > cut[node]
        node = np.where(inner, np.where(right, tree["right"][node], tree["left"][node]), node)


@dataclass
class Trees:
    """Boosted trees over a feature list; every tree has its step."""

    features: list[str]
    trees: list[dict]
    step: float

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def treeWeights(self) -> list[float]:
        return [self.step] * len(self.trees)

    def importances(self) -> np.ndarray:
        """Share of every feature in the gains of all splits."""
        out = np.zeros(len(self.features))
        for t in self.trees:
            inner = t["feature"] >= 0
            np.add.at(out, t["feature"][inner], t["gain"][inner])
        return out / out.sum() if out.sum() > 0 else out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += self.step * t["value"][leaf_of(t, x, t["threshold"])]
        return out


@dataclass
class Part:
    """A boosted ensemble over its own feature list."""

    features: list[str]
    model: Trees | None      # None: no round was worth keeping


@dataclass
class Chain:
    """f(x) = start + sum of the parts (M7: a model and its continuations)."""

    start: float
    parts: list[Part] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """M4 (first half): add the prediction column, an Arrow batch at a time."""
        show_workers_the_package(df.sparkSession)
        start, parts = float(self.start), [p for p in self.parts if p.model is not None]
        if not parts:
            return df.withColumn(out, F.lit(start))
        names = list(dict.fromkeys(f for p in parts for f in p.features))
        at = {f: i for i, f in enumerate(names)}
        models = [(np.array([at[f] for f in p.features]), p.model) for p in parts]

        @F.pandas_udf("double")
        def score(rows):
            import pandas as pd
            x = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, len(names)))
            return pd.Series(start + sum(m.score(x[:, columns]) for columns, m in models))

        return df.withColumn(out, score(feature_array(names)))

    @property
    def rounds(self) -> list[int]:
        """Trees kept per part."""
        return [0 if p.model is None else p.model.getNumTrees for p in self.parts]


def feature_array(features: Sequence[str]):
    """The features as one array; nulls are NaN.  (SQL text: a call a column is
    slow for hundreds of them.)"""
    return F.expr("array(" + ", ".join(f"coalesce(CAST(`{f}` AS DOUBLE), double('NaN'))" for f in features) + ")")


# -------------------------------------------------------------------- blocks --

@dataclass
class Fit:
    """One fit: rows, features, parameters and the model to go on from."""

    rows: DataFrame
    features: Sequence[str]
    params: GBTParams
    label: str = "visitors"
    weight_col: str | None = "weight"
    valid_col: str | None = None
    init: Chain | None = None


def _few_tasks(df: DataFrame) -> DataFrame:
    """Rows in as many partitions as keep the cores busy: each sketch that is
    merged costs as much as its size, whatever the rows behind it."""
    return df.coalesce(max(SKETCH_TASKS, 4 * df.sparkSession.sparkContext.defaultParallelism))


def border_sketches(df: DataFrame, features: Sequence[str], max_bins: int) -> DataFrame:
    """(part, q): the quantiles of SKETCH_FEATURES features a row.

    A part is a group of its own, so the tasks' sketches are merged by as many
    tasks as there are parts, not by one; the rows are read once."""
    share = ", ".join(f"{i / (max_bins - 1)}D" for i in range(1, max_bins - 1))
    parts = _few_tasks(df).select(feature_array(features).alias("x")).selectExpr(
        f"inline(transform(sequence(0, {(len(features) - 1) // SKETCH_FEATURES}),"
        f" i -> named_struct('part', i, 'x', slice(x, i * {SKETCH_FEATURES} + 1, {SKETCH_FEATURES}))))")
    return parts.groupBy("part").agg(F.expr("array(" + ", ".join(
        f"percentile_approx(nullif(get(x, {k}), double('NaN')), array({share}), {EDGE_ACCURACY})"
        for k in range(min(SKETCH_FEATURES, len(features)))) + ")").alias("q"))


def bin_borders(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Ascending borders of the value bins of every feature (one pass; sketches
    of bounded size).  Bin 0 holds missing values."""
    if not 2 <= max_bins <= 255:
        raise ValueError("max_bins must be between 2 and 255")
    found = {}
    if features and max_bins > 2:
        for r in border_sketches(df, features, max_bins).collect():
            found |= {r["part"] * SKETCH_FEATURES + k: q for k, q in enumerate(r["q"])}
    return [np.unique(np.array(found.get(k) or [], float)) for k in range(len(features))]


@dataclass
class _Data:
    """The blocks of all fits on the same rows: the features of any of them, and
    a first score for every model that is gone on from."""

    fit: Fit                              # one of them: rows, label, weight, validation flag
    features: list[str] = field(default_factory=list)
    inits: list[Chain | None] = field(default_factory=list)
    runs: list[tuple[int, int]] = field(default_factory=list)       # (run, place of its model in inits)
    borders: list[np.ndarray] = field(default_factory=list)

    def add(self, run: int, fit: Fit) -> None:
        known = set(self.features)
        self.features += [f for f in dict.fromkeys(fit.features) if f not in known]
        at = next((i for i, m in enumerate(self.inits) if m is fit.init), len(self.inits))
        if at == len(self.inits):
            self.inits.append(fit.init)
        self.runs.append((run, at))


def _packed(number: int, data: _Data) -> DataFrame:
    """Blocks of up to BLOCK_ROWS rows: bins, label, weight, validation flag,
    scores of the initial models one after the other."""
    fit, borders = data.fit, data.borders
    weight = F.col(fit.weight_col).cast("double") if fit.weight_col else F.lit(1.0)
    valid = F.coalesce(F.col(fit.valid_col), F.lit(False)) if fit.valid_col else F.lit(False)
    scored = fit.rows
    for i, init in enumerate(data.inits):
        scored = init.predict(scored, f"_f{i}") if init else scored.withColumn(f"_f{i}", F.lit(0.0))
    starts = [f"f{i}" for i in range(len(data.inits))]
    rows = scored.select(feature_array(data.features).alias("x"), F.col(fit.label).cast("double").alias("y"),
                         weight.alias("w"), valid.alias("valid"), *[F.col(f"_{f}").alias(f) for f in starts]) \
        .where("y IS NOT NULL AND w IS NOT NULL")
    d = len(data.features)

    def pack(batches):
        import pyarrow as pa
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            bins = np.empty(x.shape, np.uint8)
            for j, border in enumerate(borders):
                bins[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(border, x[:, j], "left"))
            y, w, valid, *f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "valid", *starts))
            for i in range(0, len(x), BLOCK_ROWS):
                part = slice(i, i + BLOCK_ROWS)
                yield pa.RecordBatch.from_pydict({
                    "data": pa.array([number], pa.int32()), "n": pa.array([len(bins[part])], pa.int32()),
                    **{name: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
                       for name, v in (("bins", bins[part]), ("y", y[part]), ("w", w[part]), ("valid", valid[part]),
                                       ("f", np.stack([g[part] for g in f])))}})

    return rows.mapInArrow(pack, "data int, n int, bins binary, y binary, w binary, valid binary, f binary")


def _unpacked(runs_of: dict[int, list[tuple[int, int]]]):
    """(data, [(block, rows)], bins, label, weight, validation flag), score by run."""
    def unpack(row):
        n = row["n"]
        scores = np.frombuffer(row["f"]).reshape(-1, n)
        bins = np.frombuffer(row["bins"], np.uint8).reshape(n, -1)
        return ((row["data"], [(row["block"], n)], bins, np.frombuffer(row["y"]),
                 np.frombuffer(row["w"]), np.frombuffer(row["valid"], bool)), {i: scores[at] for i, at in runs_of[row["data"]]})

    return unpack


def _joined(blocks):
    """Blocks of the same data put together (up to JOINED_ROWS rows), their bins
    by column, as a pass reads them.  Rows are still drawn block by block."""
    held: dict = {}

    def joined(parts):
        (number, *_), _ = parts[0]
        names = [b for (_, b, *_), _ in parts]
        bins, y, w, valid = (np.concatenate([block[i] for block, _ in parts]) for i in range(2, 6))
        once: dict = {}        # runs from the same model share a score
        scores = {}
        for run in parts[0][1]:
            views = [s[run] for _, s in parts]
            key = tuple(v.__array_interface__["data"][0] for v in views)
            scores[run] = once.setdefault(key, np.concatenate(views) if key not in once else None)
        return (number, [b for some in names for b in some], np.asfortranarray(bins), y, w, valid), scores

    for block in blocks:
        number, n = block[0][0], len(block[0][3])
        parts, rows = held.get(number, ([], 0))
        if parts and rows + n > JOINED_ROWS:
            yield joined(parts)
            parts, rows = [], 0
        held[number] = (parts + [block], rows + n)
        if sum(rows for _, rows in held.values()) > 4 * JOINED_ROWS:       # blocks of many data: a task's memory is bounded
            yield joined(held.pop(max(held, key=lambda i: held[i][1]))[0])
    for parts, _ in held.values():
        yield joined(parts)


# -------------------------------------------------------------------- passes --

def _routed(tree: dict, bins: np.ndarray, of_node: np.ndarray):
    """``of_node`` of every row's leaf (one value if the tree has no split).

    The few splits of a small tree are compared a column at a time, which is
    much less work than following every row from node to node."""
    feature = tree["feature"]
    if np.count_nonzero(feature >= 0) > SMALL_TREE:
        return of_node[leaf_of(tree, bins, tree["bin"])]

    def below(node):
        if feature[node] < 0:
            return of_node[node]
        return np.where(bins[:, feature[node]] > int(tree["bin"][node]), below(tree["right"][node]), below(tree["left"][node]))

    return below(0)


def _grown(entry: dict, bins: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The ledger's score with the trees grown since it was written."""
    for tree in entry["pending"]:
        score = score + entry["step"] * _routed(tree, bins, tree["value"])
    return score


def _drawn(seed: int, fraction: float, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The rows taken, drawn block by block."""
    return np.concatenate([np.random.Generator(np.random.Philox(key=[seed, b])).random(n) < fraction for b, n in blocks])


def _histograms(plan: dict):
    """Task of a pass: ((run, slot), (3, features, bins)) sums of count, weight
    and weighted residual; slot -1 has the validation error and its weight."""

    def add(sums, number, entry, blocks, bins, y, w, valid, score):
        residual = y - entry["offset"] - _grown(entry, bins, score)
        if entry["level"] == 0 and valid.any():
            error = np.array([np.sum(w[valid] * residual[valid] ** 2), np.sum(w[valid])])
            sums[number, -1] = sums.get((number, -1), 0.0) + error
        if not entry["slots"]:
            return
        slots = np.array([entry["slots"].get(i, -1) for i in range(len(entry["tree"]["feature"]))])
        slot = np.broadcast_to(_routed(entry["tree"], bins, slots), y.shape)
        rows = np.flatnonzero(~valid & _drawn(entry["seed"], entry["fraction"], blocks) & (slot >= 0))
        columns, size = entry["columns"], entry["bins"]
        d, k = len(columns), len(entry["slots"])
        at, total = slot[rows] * size, k * size
        weights = (None, w[rows], w[rows] * residual[rows])
        found = np.empty((k, 3, d, size))
        j = 0
        if len(rows) * d <= FEW_CELLS:
            cells = (bins.take(columns, axis=1)[rows] + (at[:, None] + np.arange(d) * total)).ravel()
            for kind, v in enumerate(weights):
                found[:, kind] = np.bincount(cells, None if v is None else np.repeat(v, d), d * total).reshape(d, k, size).transpose(1, 0, 2)
            j = d
        while j < d:
            cell = at + bins[:, columns[j]].take(rows)
            if j + 1 < d and total * size <= PAIR_CELLS:
                # Two features at once: their sums are the margins of a joint histogram.
                cell = cell * size + bins[:, columns[j + 1]].take(rows)
                for kind, v in enumerate(weights):
                    joint = np.bincount(cell, v, total * size).reshape(k, size, size)
                    found[:, kind, j], found[:, kind, j + 1] = joint.sum(axis=2), joint.sum(axis=1)
                j += 2
                continue
            for kind, v in enumerate(weights):
                found[:, kind, j] = np.bincount(cell, v, total).reshape(k, size)
            j += 1
        for i in range(k):
            sums[number, i] = sums.get((number, i), 0.0) + found[i]

    def run(blocks):
        sums: dict = {}
        for (_, drawn, bins, y, w, valid), scores in blocks:
            for number, score in scores.items():
                if number in plan and len(y):
                    add(sums, number, plan[number], drawn, bins, y, w, valid, score)
        return sums.items()

    return run


def best_split(sums: np.ndarray, min_leaf: int) -> tuple:
    """(gain, column, bin, left value, right value, own value) of a node."""
    count, weight, residual = np.cumsum(sums, axis=2)
    n, w, r = count[0, -1], weight[0, -1], residual[0, -1]
    if w <= 0:
        return 0.0, -1, -1, 0.0, 0.0, 0.0
    lw, lr = weight[:, :-1], residual[:, :-1]
    rw, rr = w - lw, r - lr
    fits = (count[:, :-1] >= min_leaf) & (n - count[:, :-1] >= min_leaf) & (lw > 0) & (rw > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, lr ** 2 / lw + rr ** 2 / rw - r ** 2 / w, 0.0)
    j, b = divmod(int(np.argmax(gain)), gain.shape[1])
    if gain[j, b] <= 1e-12 * (1 + r ** 2 / w):
        return 0.0, -1, -1, 0.0, 0.0, float(r / w)
    return float(gain[j, b]), j, b, float(lr[j, b] / lw[j, b]), float(rr[j, b] / rw[j, b]), float(r / w)


class _Grower:
    """A tree in the making on the driver (at most ``max_leaves`` leaves)."""

    def __init__(self, params: GBTParams, features: int, k: int) -> None:
        rng = np.random.default_rng([params.seed, k])
        self.params = params
        self.columns = np.sort(rng.choice(features, max(1, int(round(params.feature_fraction * features))), replace=False))
        self.nodes = [dict(feature=-1, bin=-1, threshold=0.0, left=-1, right=-1, value=0.0, gain=0.0)]
        self.open, self.leaves = [0], 1

    def arrays(self) -> dict:
        kinds = dict(feature=np.int32, bin=np.int32, threshold=float, left=np.int32, right=np.int32, value=float, gain=float)
        return {name: np.array([n[name] for n in self.nodes], kind) for name, kind in kinds.items()}

    def split(self, found: list[tuple], borders: list[np.ndarray]) -> None:
        """The best splits of the open nodes first, as far as leaves are left."""
        nodes, self.open = self.open, []
        if nodes == [0]:
            self.nodes[0]["value"] = found[0][5]
        for (gain, j, b, left, right, _), node in sorted(zip(found, nodes), key=lambda x: (-x[0][0], x[1])):
            if gain <= 0 or self.leaves >= self.params.max_leaves:
                break
            feature = int(self.columns[j])
            at = len(self.nodes)
            self.nodes[node] |= dict(feature=feature, bin=b, left=at, right=at + 1, gain=gain,
                                     threshold=float(borders[feature][b - 1]) if b else float("-inf"))
            self.nodes += [dict(feature=-1, bin=-1, threshold=0.0, left=-1, right=-1, value=v, gain=0.0) for v in (left, right)]
            self.open += [at, at + 1]
            self.leaves += 1
        self.open.sort()


def boost_all(fits: dict[str, Fit], ledger_every: int = 16) -> dict[str, Chain]:
    """M3 / M7 for several fits in the same passes -> a chain per name.

    Rows with ``valid_col`` true are never trained on; they choose the prefix
    (weighted squared error, ``patience`` rounds without a gain end a fit).
    """
    if not fits:
        return {}

    names = list(fits)
    spark = fits[names[0]].rows.sparkSession
    show_workers_the_package(spark)
    found, packed = {}, None              # fits on the same rows have one set of blocks
    for i, name in enumerate(names):
        f = fits[name]
        found.setdefault((id(f.rows), f.label, f.weight_col, f.valid_col, f.params.max_bins), _Data(f)).add(i, f)
    data = list(found.values())
    with ThreadPoolExecutor(THREADS) as pool:       # different rows are sketched side by side
        sketch, sketched = inheritable_thread_target(spark)(bin_borders), []
        for d in data:
            fit = d.fit
            train = fit.rows.where(~F.coalesce(F.col(fit.valid_col), F.lit(False))) if fit.valid_col else fit.rows
            sketched.append(pool.submit(sketch, train, d.features, fit.params.max_bins))
    for number, d in enumerate(data):
        d.borders = sketched[number].result()
        part = _packed(number, d)
        packed = part if packed is None else packed.unionByName(part)
    stored = reliable_checkpoint(packed)
    sizes = {r["data"]: r["n"] for r in stored.groupBy("data").agg(F.sum("n").alias("n")).collect()}
    runs = {}
    for number, d in enumerate(data):
        place = {f: j for j, f in enumerate(d.features)}
        for i, start in d.runs:
            fit = fits[names[i]]
            at = np.array([place[f] for f in fit.features], np.int64)
            runs[i] = dict(params=fit.params, features=len(at), at=at, borders=[d.borders[j] for j in at], data=number, start=start,
                           offset=0.0 if fit.init else None, trees=[], pending=[], best=None, best_at=0, done=False)
    # Fits of many rounds on few rows are grown by one task each, without a pass a level.
    near = {i: r for i, r in runs.items() if r["params"].max_iter >= LOCAL_ROUNDS
            and sizes.get(r["data"], 0) * len(data[r["data"]].features) <= LOCAL_CELLS}
    far = {i: r for i, r in runs.items() if i not in near}
    with ThreadPoolExecutor(1) as pool:
        grown = pool.submit(inheritable_thread_target(spark)(_grown_apart), stored, near, ledger_every)
        if far:
            _grown_together(stored, far, sizes, ledger_every)
        runs |= grown.result()
    out = {}
    for i, name in enumerate(names):
        r, fit = runs[i], fits[name]
        kept = r["trees"][:r["best_at"]] if r["best"] is not None else r["trees"]
        part = Part(list(fit.features), Trees(list(fit.features), kept, fit.params.step_size) if kept else None)
        out[name] = Chain(fit.init.start, [*fit.init.parts, part]) if fit.init else Chain(r["offset"], [part])
    return out


def _in_blocks(run: dict, tree: dict) -> dict:
    """A tree on the columns of the blocks."""
    return tree | dict(feature=np.where(tree["feature"] >= 0, run["at"][np.maximum(tree["feature"], 0)], -1))


def _totals(blocks):
    """Weighted label sum and weight of the training rows by data."""
    sums: dict = {}
    for (number, _, _, y, w, valid), _ in blocks:
        sums[number] = sums.get(number, 0.0) + np.array([np.sum((w * y)[~valid]), np.sum(w[~valid])])
    return sums.items()


def _grow(runs: dict[int, dict], combined, write, ledger_every: int) -> None:
    """Rounds of all runs until each has ended.  ``combined(task, fold)`` has the
    folded sums of a pass by key; ``write(plan)`` adds the pending trees to the scores."""
    if any(r["offset"] is None for r in runs.values()):
        means = combined(_totals, lambda key, v: float(v[0] / v[1]) if v[1] > 0 else 0.0)
        for r in runs.values():
            r["offset"] = means.get(r["data"], 0.0) if r["offset"] is None else r["offset"]
    least = {i: r["params"].min_leaf for i, r in runs.items()}

    def fold(key, value):
        return value if key[1] < 0 else best_split(value, least[key[0]])

    k = 0
    while any(not r["done"] for r in runs.values()):
        growers = {i: _Grower(r["params"], r["features"], k) for i, r in runs.items() if not r["done"]}
        level = 0
        while growers:
            plan = {}
            for i, g in growers.items():
                r, p = runs[i], runs[i]["params"]
                grows = len(r["trees"]) < p.max_iter
                plan[i] = dict(level=level, offset=r["offset"], pending=r["pending"], step=p.step_size, tree=_in_blocks(r, g.arrays()),
                               slots={node: s for s, node in enumerate(g.open)} if grows else {}, columns=r["at"][g.columns],
                               seed=p.seed + k, fraction=p.bagging_fraction, bins=max([len(b) for b in r["borders"]], default=0) + 2)
            found = combined(_histograms(plan), fold)
            for i, g in list(growers.items()):
                r, p = runs[i], runs[i]["params"]
                if level == 0:
                    error = found.get((i, -1))
                    if error is not None:
                        now = float(error[0] / error[1]) if error[1] > 0 else None
                        if now is not None and (r["best"] is None or now < r["best"]):
                            r["best"], r["best_at"] = now, len(r["trees"])
                        elif len(r["trees"]) - r["best_at"] >= p.patience:
                            r["done"] = True
                    if len(r["trees"]) >= p.max_iter:
                        r["done"] = True
                    if r["done"]:
                        del growers[i]
                        continue
                none = (0.0, -1, -1, 0.0, 0.0, 0.0)
                g.split([found.get((i, s), none) for s in range(len(g.open))], r["borders"])
                if not g.open or level + 1 >= p.max_depth:
                    r["trees"].append(g.arrays())
                    r["pending"] = r["pending"] + [_in_blocks(r, r["trees"][-1])]
                    del growers[i]
            level += 1
        k += 1
        if k % ledger_every == 0 and any(r["pending"] for r in runs.values()):
            write({i: dict(pending=r["pending"], step=r["params"].step_size) for i, r in runs.items() if r["pending"]})
            for r in runs.values():
                r["pending"] = []


def _runs_of(runs: dict[int, dict]) -> dict[int, list[tuple[int, int]]]:
    out: dict = {}
    for i, r in runs.items():
        out.setdefault(r["data"], []).append((i, r["start"]))
    return out


def _grown_together(stored: DataFrame, runs: dict[int, dict], sizes: dict[int, int], ledger_every: int) -> None:
    """The runs in the same passes, a Spark job a tree level."""
    sc, runs_of = stored.sparkSession.sparkContext, _runs_of(runs)
    work = sum(sizes.get(runs[i]["data"], 0) for i in runs)
    most = max(sc.defaultParallelism, -(-work // TASK_ROWS))
    tasks = max(1, min(most, -(-work // LEAST_TASK_ROWS)))        # a task has enough rows to be worth its start
    state = stored.withColumn("block", F.monotonically_increasing_id()).where(F.col("data").isin(list(runs_of))) \
        .coalesce(tasks).rdd.map(_unpacked(runs_of)).mapPartitions(_joined)
    state.persist(StorageLevel.MEMORY_AND_DISK)
    scored, ledger = state, None          # the blocks with the ledger's scores, and the ledger once there is one

    def combined(task, fold):
        """Sums of the tasks by key, folded."""
        found = scored.mapPartitions(task)
        if scored.getNumPartitions() > FAN_IN:
            return dict(found.reduceByKey(lambda a, b: a + b).map(lambda kv: (kv[0], fold(*kv))).collect())
        sums: dict = {}
        for key, value in found.collect():
            sums[key] = sums.get(key, 0.0) + value
        return {key: fold(key, value) for key, value in sums.items()}

    def write(plan):
        nonlocal scored, ledger
        old, ledger = (scored, ledger), _written(scored, plan)
        # Zipped once, not in every pass: a zip takes both sides through Python again.
        scored = state.keys().zip(ledger).persist(StorageLevel.MEMORY_AND_DISK)
        for rdd in old:
            if rdd is not None and rdd is not state:
                rdd.unpersist()

    try:
        _grow(runs, combined, write, ledger_every)
    finally:
        for rdd in (state, scored, ledger):
            if rdd is not None:
                rdd.unpersist()


def _grown_apart(stored: DataFrame, runs: dict[int, dict], ledger_every: int) -> dict[int, dict]:
    """Every run by a task of its own, which holds the blocks (LOCAL_CELLS bytes
    at most) and goes through the same rounds as the passes do."""
    if not runs:
        return {}
    runs_of, places = _runs_of(runs), {i: at for at, i in enumerate(runs)}

    def grow(rows):
        here: dict = {}
        for _, (i, row) in rows:
            here.setdefault(i, []).append(row)
        for i, mine in here.items():
            run = dict(runs[i])
            unpack = _unpacked({run["data"]: [(i, run["start"])]})
            blocks = list(_joined(unpack(row) for row in sorted(mine, key=lambda row: row["block"])))

            def combined(task, fold):
                return {key: fold(key, value) for key, value in task(blocks)}

            def write(plan):
                blocks[:] = [(block, {i: _grown(plan[i], block[2], scores[i])}) for block, scores in blocks]

            _grow({i: run}, combined, write, ledger_every)
            yield i, {name: run[name] for name in ("trees", "best", "best_at", "offset")}

    found = dict(stored.withColumn("block", F.monotonically_increasing_id()).where(F.col("data").isin(list(runs_of))).rdd
                 .flatMap(lambda row: [(places[i], (i, row)) for i, _ in runs_of[row["data"]]])
                 .partitionBy(len(runs), int).mapPartitions(grow).collect())
    # A fit without a row has no block.
    return {i: r | found.get(i, dict(offset=r["offset"] or 0.0)) for i, r in runs.items()}


def _written(scored, plan):
    """The ledger with the pending trees added: one number a row and run, checkpointed."""
    def add(pair):
        (_, _, bins, *_), scores = pair
        return {i: _grown(plan[i], bins, score) if i in plan else score for i, score in scores.items()}

    new = scored.map(add)
    new.persist(StorageLevel.MEMORY_AND_DISK)
    new.checkpoint()
    new.count()
    return new


def boost(train: DataFrame, features: Sequence[str], params: GBTParams, label: str = "visitors",
          weight_col: str | None = "weight", valid_col: str | None = None, init: Chain | None = None) -> Chain:
    """M3 / M7: boosting rounds from the weighted label mean, or from ``init``."""
    return boost_all({"one": Fit(train, features, params, label, weight_col, valid_col, init)})["one"]


# --------------------------------------------------------------------- store --

def save(chain: Chain, spark: SparkSession, path: str) -> None:
    """The trees as a table of nodes first, the description last (its marker
    says all is there)."""
    rows = [(i, k, part.model.step, node, *(t[c][node].item() for c in ("feature", "bin", "threshold", "left", "right", "value", "gain")))
            for i, part in enumerate(chain.parts) if part.model is not None
            for k, t in enumerate(part.model.trees) for node in range(len(t["feature"]))]
    spark.createDataFrame(rows, TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    text = json.dumps({"start": chain.start, "parts": [{"features": p.features, "model": p.model is not None}
                                                       for p in chain.parts]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/chain")


def load(spark: SparkSession, path: str) -> Chain:
    """The model stored at ``path`` (its size is set by the rounds and leaves)."""
    described = json.loads(spark.read.text(f"{path}/chain").first()[0])
    nodes = spark.read.parquet(f"{path}/trees").toPandas().sort_values(["part", "tree", "node"])
    parts = []
    for i, p in enumerate(described["parts"]):
        mine = nodes[nodes["part"] == i]
        trees = [{c: t[c].to_numpy() for c in ("feature", "bin", "threshold", "left", "right", "value", "gain")}
                 for _, t in mine.groupby("tree", sort=True)]
        parts.append(Part(p["features"], Trees(p["features"], trees, float(mine["step"].iloc[0])) if trees else None))
    return Chain(described["start"], parts)


def train_or_load(path: str | None, train: DataFrame, features: Sequence[str], params: GBTParams, **options) -> Chain:
    """The model stored at ``path`` (a folder of any store Spark writes to)
    if a finished one is there, else fit and store it."""
    spark = train.sparkSession
    if path and io.is_materialized(spark, f"{path}/chain"):
        return load(spark, path)
    chain = boost(train, features, params, **options)
    if path:
        save(chain, spark, path)
    return chain
