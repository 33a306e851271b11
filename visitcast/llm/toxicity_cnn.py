"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word (lower-case run of letters, digits and non-ASCII characters) is the sum
of the hashed embeddings of the whole word and of its prefixes of several
lengths, so inflected forms share what is learnt; filters of several widths run
over the word sequence, ReLU and max pooling give one value per filter, and a
logistic layer gives the score.  All learnable labelled rows are used.  Spark
counts the texts of either class that use a table row; then tasks train copies
of the network on their texts, some thousand at a time, in one round or two, and
what they changed is averaged, weighted by the texts that use it.  Up to
UNIT_TEXTS texts are trained in one task, more in at most UNITS.  Table rows that
fewer than ``min_docs`` training texts use stay zero, so rare words cannot be
learnt by heart.  A quarter of the rows (by a hash of the text) is not trained on
but calibrates: thresholds by language, each the cut with the fewest errors among
scores in steps of 1 / 65536, shrunk to the cut of all languages.

The score uses the text only; the language is used for ``flagged``, the
verdict at the threshold of the row's language (null or unseen language: the
common threshold).  Scoring is one pass over whole texts in Arrow batches: a
few table look-ups and one matrix product per word.

Defined results: a null text counts as empty; an empty text has no window and
gets the score of pooled zeros; repeated rows are scored alike; a null id is
not held out; without learnable labels of both classes every score is the
prior (0.5 without any); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_BYTES
from .common import (ALNUM, checkpointed, give_back_memory, held_out, lower_ascii, show_workers_the_package, span_hasher, table,
                     text_blocks, tidy, word_spans)
from .labelled import learnable

TABLE_BITS = 17
SIZE = (1 << TABLE_BITS) + 1              # row 0: the gap between texts, and words shorter than a prefix
PREFIXES = (4, 5, 6, 8)                   # bytes
PARTS = 1 + len(PREFIXES)
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8                               # of each width
GAP = max(WIDTHS) - 1
MIN_DOCS = 4
UNIT_TEXTS, UNITS = 4096, 64              # texts that are worth a training task; tasks at most
CHUNK_PARTS = 1 << 24                     # word parts of the texts held at once
CUT_STEPS = 1 << 16
THRESHOLD = 0.5


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of the parts of every word, text of every word) of a block."""
    lower = lower_ascii(data)
    start, end, row = word_spans(lower, offsets, ALNUM)
    hashes = span_hasher(lower)
    shift = np.uint64(64 - TABLE_BITS)
    ids = np.zeros((PARTS, len(start)), np.int32)
    ids[0] = (hashes(start, end) >> shift) + np.uint64(1)
    for k, size in enumerate(PREFIXES, 1):
        long = end - start >= size
        part = hashes(start[long], start[long] + size) * np.uint64(2 * size + 1)
        ids[k, long] = (part >> shift) + np.uint64(1)
    return ids, row


def with_gaps(ids: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence with GAP zeros after every text, and the start of each text."""
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows) + GAP)])
    out = np.zeros((PARTS, starts[-1]), np.int32)
    out[:, np.arange(len(row)) + row * GAP] = ids
    return out, starts


@dataclass
class Network:
    table: np.ndarray                     # (SIZE, DIM)
    kernels: list[np.ndarray]             # per width: (width, DIM, FILTERS)
    biases: list[np.ndarray]              # per width: (FILTERS,)
    head: np.ndarray                      # (len(WIDTHS) * FILTERS,)
    bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    common_threshold: float = THRESHOLD

    def embed(self, ids: np.ndarray) -> np.ndarray:
        x = self.table[ids[0]]
        for part in ids[1:]:
            x += self.table[part]
        return x

    def windows(self, x: np.ndarray, gap: np.ndarray) -> list[np.ndarray]:
        """Filter values of every window that starts at a word, per width."""
        weights = np.concatenate([k for kernel in self.kernels for k in kernel], 1)
        places = np.split(x @ weights, sum(WIDTHS), 1)
        out, at = [], 0
        for kernel, bias in zip(self.kernels, self.biases):
            z = bias + places[at]
            for k in range(1, len(kernel)):
                z[:len(z) - k] += places[at + k][k:]
            at += len(kernel)
            z[gap] = -np.inf
            out.append(z)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the texts of a block."""
        ids, row = word_parts(data, offsets)
        return sigmoid(self.logits(*with_gaps(ids, row, len(offsets) - 1))).astype(float)

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        pooled = [np.maximum(np.maximum.reduceat(z, starts[:-1]), 0) for z in self.windows(self.embed(ids), ids[0] == 0)]
        return self.bias + np.concatenate(pooled, 1) @ self.head


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def start_network(used: np.ndarray, n: tuple[int, int], min_docs: int = MIN_DOCS, seed: int = 11) -> Network:
    """The network before training; ``used`` counts the texts by class that use
    a table row.

    The first dimension of the table starts at the smoothed log-odds of the
    part, and one filter of width 1 reads it; all else starts at random.
    """
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 0.05, (SIZE, DIM)).astype(np.float32)
    start[:, 0] = 0.5 * (np.log((used[1] + 2) / (n[1] + 4)) - np.log((used[0] + 2) / (n[0] + 4)))
    start[used.sum(0) < min_docs] = 0
    start[0] = 0
    net = Network(start, [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                  [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0, 0.3, len(WIDTHS) * FILTERS))
    net.kernels[0][0, :, 0] = np.eye(DIM)[0]
    net.head[0] = 1.0
    return net


def dense_of(net: Network) -> np.ndarray:
    """All weights but the table, in rows of DIM."""
    flat = np.concatenate([*[k.ravel() for k in net.kernels], *net.biases, net.head, [net.bias]]).astype(float)
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def with_dense(net: Network, rows: np.ndarray) -> Network:
    flat, at = rows.ravel(), 0
    parts = []
    for shape in [*[k.shape for k in net.kernels], *[b.shape for b in net.biases], net.head.shape, (1,)]:
        size = int(np.prod(shape))
        parts.append(flat[at:at + size].reshape(shape))
        at += size
    w = len(WIDTHS)
    return Network(net.table, [k.astype(np.float32) for k in parts[:w]], [b.astype(np.float32) for b in parts[w:2 * w]],
                   parts[2 * w].copy(), float(parts[-1][0]))


class Trainer:
    """Adagrad on the log loss from a network on; ``seen`` counts the texts that
    use a table row (a row no filter's best window holds keeps its value)."""

    def __init__(self, net: Network) -> None:
        self.net, self.learnt = net, net.table.any(1)
        self.seen, self.texts = np.zeros(SIZE, np.int64), 0
        self.sums = (np.full((SIZE, DIM), 1e-3, np.float32), [np.full_like(k, 1e-3) for k in net.kernels],
                     [np.full_like(b, 1e-3) for b in net.biases], np.full_like(net.head, 1e-3), np.array(1e-3))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.1,
            seed: int = 11) -> None:
        """``texts`` holds the word parts (PARTS, words).  Gradients reach the
        words of each filter's best window only, so a step costs one forward
        pass."""
        rng = np.random.default_rng(seed)
        net, learnt = self.net, self.learnt
        g_tab, g_ker, g_bia, g_head, g_bias = self.sums
        self.texts += len(texts)
        for t in texts:
            used = np.unique(t)
            self.seen[used[learnt[used]]] += 1
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                chosen = order[at:at + batch]
                rows = len(chosen)
                row = np.repeat(np.arange(rows), [texts[i].shape[1] for i in chosen])
                ids, starts = with_gaps(np.concatenate([texts[i] for i in chosen], 1), row, rows)
                x = net.embed(ids)
                pooled, best = [], []
                for z in net.windows(x, ids[0] == 0):
                    where = np.stack([a + np.argmax(z[a:b], 0) for a, b in zip(starts[:-1], starts[1:])])
                    pooled.append(np.maximum(np.take_along_axis(z, where, 0), 0))
                    best.append(where)
                hidden = np.concatenate(pooled, 1)
                error = (sigmoid(net.bias + hidden @ net.head) - labels[chosen]) / rows
                back = (error[:, None] * net.head) * (hidden > 0)
                grad = error @ hidden + 1e-4 * net.head
                g_head += grad ** 2
                net.head -= rate * grad / np.sqrt(g_head)
                g_bias[...] += error.sum() ** 2
                net.bias -= rate * error.sum() / np.sqrt(g_bias)
                steps: list[tuple[np.ndarray, np.ndarray]] = []
                for w, (kernel, where) in enumerate(zip(net.kernels, best)):
                    part = back[:, w * FILTERS:(w + 1) * FILTERS].astype(np.float32)
                    grad_k = np.zeros_like(kernel)
                    for k in range(len(kernel)):
                        place = np.minimum(where + k, len(x) - 1)
                        grad_k[k] = np.einsum("rf,rfd->df", part, x[place])
                        steps.append((place.ravel(), (part[:, :, None] * kernel[k].T).reshape(-1, DIM)))
                    g_ker[w] += grad_k ** 2
                    kernel -= 0.3 * rate * grad_k / np.sqrt(g_ker[w])
                    grad_b = part.sum(0)
                    g_bia[w] += grad_b ** 2
                    net.biases[w] -= 0.3 * rate * grad_b / np.sqrt(g_bia[w])
                place, step = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
                entry, step = ids[:, place].ravel(), np.tile(step, (PARTS, 1))
                ok = learnt[entry] & step.any(1)
                seen, inverse = np.unique(entry[ok], return_inverse=True)
                grad = np.zeros((len(seen), DIM), np.float32)
                np.add.at(grad, inverse, step[ok])
                g_tab[seen] += grad ** 2
                net.table[seen] -= rate * grad / np.sqrt(g_tab[seen])


SENT = "row int, seen int, w array<float>, exact array<double>"


def sent_rows(trainer: Trainer):
    """What a task changed: a row per table row as the table holds it (single
    precision), then all other weights (``exact``)."""
    import pyarrow as pa

    changed, dense = np.flatnonzero(trainer.seen), dense_of(trainer.net)
    n, m = len(changed), len(dense)
    at = np.concatenate([changed, SIZE + np.arange(m)]).astype(np.int32)
    seen = np.concatenate([trainer.seen[changed], np.full(m, trainer.texts)]).astype(np.int32)
    single = pa.ListArray.from_arrays(pa.array(np.concatenate([np.arange(n + 1) * DIM, np.full(m, n * DIM)]).astype(np.int32)),
                                      pa.array(trainer.net.table[changed].ravel()), mask=pa.array(np.arange(n + m) >= n))
    exact = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(n), np.arange(m + 1) * DIM]).astype(np.int32)),
                                     pa.array(dense.ravel()), mask=pa.array(np.arange(n + m) < n))
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen), single, exact], names=["row", "seen", "w", "exact"])


def best_cut(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the least weighted errors, midway in its range; ties go
    to the range nearest one half."""
    s, at = np.unique(scores, return_inverse=True)
    high, low = np.bincount(at, weight * labels, len(s)), np.bincount(at, weight * (1 - labels), len(s))
    cuts = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    errors = np.concatenate([[0.0], np.cumsum(high)]) + low.sum() - np.concatenate([[0.0], np.cumsum(low)])
    good = cuts[np.isclose(errors, errors.min(), atol=1e-9)]
    return float(np.clip(0.5, good.min(), good.max()))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", shrink: float = 20.0) -> Network:
    """Fit and calibrate on all learnable labelled rows."""
    spark = docs.sparkSession
    show_workers_the_package(spark)
    labelled = checkpointed(learnable(labels, label_col, id_col).where("y IN (0, 1)"))
    small = labelled.count() * 24 <= BROADCAST_BYTES
    labelled = F.broadcast(labelled) if small else labelled
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .join(labelled, "doc_id").select("y", "lang", "text"))
    if not small:
        rows = checkpointed(rows)                 # the texts move once, not in every pass
    rows = rows.withColumn("turn", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(8)).cast("int"))
    found = {(int(r["y"]), int(r["turn"])): int(r["n"]) for r in rows.groupBy("y", "turn").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = {y: sum(n for (c, _), n in found.items() if c == y) for y in (0, 1)}
    if min(totals.values()) == 0:
        prior = totals[1] / sum(totals.values()) if sum(totals.values()) else 0.5
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        return Network(np.zeros((SIZE, DIM), np.float32),
                       [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                       [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS),
                       float(np.log(prior / (1 - prior))))
    # Turns 0 and 1 of 8 calibrate, the others train.
    calibrates = min(totals.values()) >= 8 and all(sum(found.get((y, t), 0) for t in range(2, 8)) for y in (0, 1))
    first = 2 if calibrates else 0
    n = tuple(sum(found.get((y, t), 0) for t in range(first, 8)) for y in (0, 1))
    learn = rows.where(F.col("turn") >= first).select("y", "text")

    def count(batches):
        import pyarrow as pa

        used = np.zeros((2, SIZE), np.int64)
        for b in batches:
            y = b.column(0).to_numpy()
            for i, j, data, offsets in text_blocks(b.column(1)):
                ids, row = word_parts(data, offsets)
                pairs = np.unique((np.tile(row, PARTS).astype(np.int64) * SIZE) + ids.ravel())
                for c in (0, 1):
                    used[c] += np.bincount((pairs % SIZE)[y[i:j][pairs // SIZE] == c], minlength=SIZE)
        at = np.flatnonzero(used.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(used[0, at]), pa.array(used[1, at])],
                                         names=["row", "n0", "n1"])

    tasks = max(1, min(UNITS, sum(n) // UNIT_TEXTS))
    # As many tasks as cores are enough; each sends a row per table row at most.
    got = learn.coalesce(max(tasks, min(UNITS, spark.sparkContext.defaultParallelism))) \
        .mapInArrow(tidy(count), "row int, n0 long, n1 long").groupBy("row").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    used = np.zeros((2, SIZE))
    used[:, got.column("row").to_numpy()] = np.stack([got.column("n0").to_numpy(), got.column("n1").to_numpy()])
    net = start_network(used, n)
    epochs = int(np.clip(6 * UNIT_TEXTS // sum(n), 2, 8))
    rounds = 1 if tasks == 1 else 2
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(net)

        def run(batches, shared=shared, turn=turn):
            import pyarrow as pa

            given = shared.value
            trainer = Trainer(Network(given.table.copy(), [k.copy() for k in given.kernels], [b.copy() for b in given.biases],
                                      given.head.copy(), given.bias))
            texts, labels, size = [], [], 0

            def learn_chunk():
                order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].tobytes()), labels[i]))
                trainer.fit([texts[i] for i in order], np.array([labels[i] for i in order], float), epochs, seed=11 + turn)

            for b in batches:
                y = b.column(0).to_numpy()
                for i, j, data, offsets in text_blocks(b.column(1)):
                    ids, row = word_parts(data, offsets)
                    cuts = np.searchsorted(row, np.arange(j - i + 1))
                    for k in range(j - i):
                        texts.append(np.ascontiguousarray(ids[:, cuts[k]:cuts[k + 1]]))
                        labels.append(int(y[i + k]))
                        size += texts[-1].size
                        if len(texts) >= UNIT_TEXTS or size >= CHUNK_PARTS:
                            learn_chunk()
                            texts, labels, size = [], [], 0
            if texts:
                learn_chunk()
            if trainer.texts:
                yield sent_rows(trainer)

        mine = learn if rounds == 1 else rows.where((F.col("turn") >= first) & (F.col("turn") % 2 == turn)).select("y", "text")
        # Moved as sent: sums of products made before the shuffle are twice as large and save no row.
        got = mine.coalesce(tasks).mapInArrow(tidy(run), SENT).repartition("row").groupBy("row").agg(*[
            (F.expr(f"sum(coalesce(exact[{k}], CAST(w[{k}] AS DOUBLE)) * seen) / sum(seen)")).alias(f"w{k}") for k in range(DIM)]).toArrow()
        if got.num_rows:
            at, new = got.column("row").to_numpy(), np.stack([got.column(f"w{k}").to_numpy() for k in range(DIM)], 1)
            dense = dense_of(net)
            dense[at[at >= SIZE] - SIZE] = new[at >= SIZE]
            net = with_dense(net, dense)
            net.table[at[at < SIZE]] = new[at < SIZE]
        shared.unpersist()
    if calibrates:
        calibrate(net, rows.where("turn < 2"), shrink)
    del got
    give_back_memory()
    return net


def calibrate(net: Network, rows: DataFrame, shrink: float) -> None:
    """Set the thresholds from the scores of labelled rows (y, lang, text) in
    steps of 1 / CUT_STEPS: a number per language, class and step comes back."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j, data, offsets in text_blocks(b.column(2)):
                step = np.round(shared.value.scores(data, offsets) * CUT_STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(step)],
                                                 names=["y", "lang", "step"])

    got = rows.select("y", "lang", "text").mapInArrow(tidy(run), "y int, lang string, step int") \
        .groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "y", "step").agg(F.count(F.lit(1)).alias("n")).toArrow()
    if not got.num_rows:
        return
    y, s, w = (got.column(c).to_numpy().astype(float) for c in ("y", "step", "n"))
    s, lang = s / CUT_STEPS, np.array(got.column("lang").to_pylist())
    net.common_threshold = best_cut(s, y, w)
    for name in np.unique(lang[lang != ""]):
        own = lang == name
        size, high = w[own].sum(), (w * y)[own].sum()
        if 0 < high < size:
            trust = size / (size + shrink)
            net.thresholds[str(name)] = float(trust * best_cut(s[own], y[own], w[own]) + (1 - trust) * net.common_threshold)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and flagged of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for b in batches:
            for i, j, data, offsets in text_blocks(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                                                  pa.array(model.scores(data, offsets))], names=["doc_id", "lang", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, lang string, score double")
    cut = F.lit(net.common_threshold)
    for name, at in sorted(net.thresholds.items()):
        cut = F.when(F.col("lang") == name, F.lit(at)).otherwise(cut)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"),
                         (F.col("score") >= cut).alias("flagged"))


def keep_clean(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
               ) -> DataFrame:
    """The rows of ``docs`` below the threshold of their language.

    The verdict is made on the row itself, so no join moves the texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series, langs: pd.Series) -> pd.Series:
        import pyarrow as pa

        model = shared.value
        scores = [model.scores(*part[2:]) for part in text_blocks(pa.array(texts, pa.string()))]
        cuts = langs.map(model.thresholds).astype(float).fillna(model.common_threshold)
        give_back_memory()
        return pd.Series(np.concatenate([np.zeros(0), *scores]) < cuts.to_numpy())

    return docs.where(clean(F.col(text_col), F.col(lang_col).cast("string")))


def op6_toxicity_cnn(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
