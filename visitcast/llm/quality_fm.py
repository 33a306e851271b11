"""Quality classifier: a factorisation machine.

Features of a text: hashed lower-case words (counts scaled to unit length)
and one-hot buckets of structure statistics and of metadata of the text itself
(lengths, byte-class shares, distinct words, repeated lines).  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

that is, all pairwise interactions in linear time.  It is trained in numpy on
the driver on at most ``per_class`` labelled rows of either class (a documented
bound; ids of the sample travel as a broadcast of that size), with the class
prior of all learnable labels restored.  Scoring is one pass over whole texts
in Arrow batches, block by block; no shuffle.

Defined results: a null text counts as empty; an empty text gets the score of
its structure buckets; repeated rows are scored alike; a null id is not held
out; without learnable labels of both classes every score is the prior (0.5
without any); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, give_back_memory, held_out, lower_ascii, span_hashes, table, text_blocks, tidy, word_spans
from .labelled import learnable, prior_shift, rows_of, training_sample

WORD_BITS = 14
RANK = 8
PER_CLASS = 4000
THRESHOLD = 0.3

# Byte classes whose share of a text is a statistic.
_CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "blank": " \t\x0b\x0c\r", "newline": "\n",
            "stop": ".,;:'\"()-", "excite": "!?", "symbol": "#*$%&|<>@{}[]\\/=+~^_`"}
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(_CLASSES.values(), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2
STEPS = 32                                # buckets of a statistic
N_STATS = _N_CLASSES + 8
N_FEATURES = (1 << WORD_BITS) + N_STATS * STEPS
STAT_VALUE = 0.5                          # value of an active bucket


def _share_step(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bucket of a share: none, all, and steps of half an octave below."""
    share = part / np.maximum(whole, 1)
    steps = np.floor(-2 * np.log2(np.maximum(share, 2.0 ** -15))).astype(np.int64) + 1
    return np.where(part <= 0, 0, np.clip(steps, 1, STEPS - 1))


def _size_step(n: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(2 * np.log2(n + 1.0)), 0, STEPS - 1).astype(np.int64)


def block_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), sorted by row, of the texts of one block."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    lower = lower_ascii(data)
    start, end, row = word_spans(lower, offsets, ALNUM)
    hashes = span_hashes(lower, start, end)
    bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique((row << WORD_BITS) | bucket, return_counts=True)
    word_row, word_feature = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    norm = np.sqrt(np.bincount(word_row, count.astype(float) ** 2, rows))
    value = count / norm[word_row]

    n_words = np.bincount(row, minlength=rows)
    distinct = np.bincount(word_row, minlength=rows)
    classes = np.bincount(np.repeat(np.arange(rows) * _N_CLASSES, sizes) + _CLASS[data],
                          minlength=rows * _N_CLASSES).reshape(rows, _N_CLASSES)
    newline = np.ones(256, bool)
    newline[10] = False
    ls, le, lrow = word_spans(data, offsets, newline)
    n_lines = np.bincount(lrow, minlength=rows)
    lines = np.unique(np.stack([lrow.astype(np.uint64), span_hashes(data, ls, le)]), axis=1)[0].astype(np.int64)
    repeated = n_lines - np.bincount(lines, minlength=rows)
    _, _, trow = word_spans(data, offsets)
    n_tokens = np.bincount(trow, minlength=rows)
    # Word triples that an earlier place of the text has already.
    whole = row[2:] == row[:-2]
    triple = (hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(7) + hashes[2:])[whole]
    triple_row = row[2:][whole]
    sorted_triples = np.lexsort((triple, triple_row))
    same = (np.diff(triple[sorted_triples]) == 0) & (np.diff(triple_row[sorted_triples]) == 0)
    n_triples = np.bincount(triple_row, minlength=rows)
    again = np.bincount(triple_row[sorted_triples][1:][same], minlength=rows)
    steps = [_share_step(classes[:, k], sizes) for k in range(_N_CLASSES)]
    steps += [_size_step(n_words), _size_step(sizes), _share_step(distinct, n_words), _share_step(repeated, n_lines),
              np.clip(2 * np.bincount(row, end - start, rows) / np.maximum(n_words, 1), 0, STEPS - 1).astype(np.int64),
              _size_step(n_words / np.maximum(n_lines, 1)), _share_step(np.abs(n_tokens - n_words), n_tokens),
              _share_step(again, n_triples)]
    stat_feature = (1 << WORD_BITS) + np.arange(N_STATS)[:, None] * STEPS + np.stack(steps)
    all_rows = np.concatenate([word_row, np.tile(np.arange(rows), N_STATS)])
    order = np.argsort(all_rows, kind="stable")
    return (all_rows[order], np.concatenate([word_feature, stat_feature.ravel()])[order],
            np.concatenate([value, np.full(N_STATS * rows, STAT_VALUE)])[order])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray                    # (features,)
    factors: np.ndarray                   # (features, rank)

    def logits(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores of rows in one pass over their entries (sum of squares identity)."""
        out = self.bias + np.bincount(row, self.linear[feature] * value, rows)
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            scaled = self.factors[feature] * value[:, None]
            sums = np.add.reduceat(scaled, first)
            squares = np.add.reduceat(np.square(scaled).sum(1), first)
            out[row[first]] += 0.5 * (np.square(sums).sum(1) - squares)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(entries: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64,
        rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the log loss; ``entries`` holds (features, values) by row."""
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, RANK)))
    g_lin, g_fac, g_bias = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, RANK), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(entries))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            lengths = [len(entries[i][0]) for i in chosen]
            feature = np.concatenate([entries[i][0] for i in chosen])
            value = np.concatenate([entries[i][1] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), lengths)
            error = (sigmoid(model.logits(len(chosen), row, feature, value)) - labels[chosen]) / len(chosen)
            seen, where = np.unique(feature, return_inverse=True)
            scaled = model.factors[feature] * value[:, None]
            sums = np.zeros((len(chosen), RANK))
            np.add.at(sums, row, scaled)
            weight = error[row] * value
            grad = np.bincount(where, weight, len(seen)) + decay * model.linear[seen]
            g_lin[seen] += grad ** 2
            model.linear[seen] -= rate * grad / np.sqrt(g_lin[seen])
            each = weight[:, None] * (sums[row] - scaled)
            grad = np.stack([np.bincount(where, each[:, f], len(seen)) for f in range(RANK)], 1)
            grad += decay * model.factors[seen]
            g_fac[seen] += grad ** 2
            model.factors[seen] -= 0.3 * rate * grad / np.sqrt(g_fac[seen])
            g_bias += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(g_bias)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", per_class: int = PER_CLASS) -> Machine:
    """Fit on a bounded sample of the learnable labelled rows."""
    sample, totals = training_sample(learnable(labels, label_col, id_col), per_class)
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample), "doc_id").select("y", "text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j, data, offsets in text_blocks(b.column(1)):
                row, feature, value = block_features(data, offsets)
                cuts = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.astype(np.float32)))],
                    names=["y", "features", "values"])

    got = rows.mapInArrow(tidy(run), "y int, features array<int>, values array<float>").orderBy(F.xxhash64("features"), "y") \
        .toArrow()
    y = got.column("y").to_numpy().astype(float)
    n = (int((y == 0).sum()), int((y == 1).sum()))
    if min(n) == 0:
        prior = sum(totals.values()) and totals.get(1, 0) / sum(totals.values())
        prior = min(max(prior if totals else 0.5, 1e-3), 1 - 1e-3)
        return Machine(float(np.log(prior / (1 - prior))), np.zeros(N_FEATURES), np.zeros((N_FEATURES, RANK)))
    entries = list(zip(rows_of(got.column("features")), rows_of(got.column("values"))))
    model = fit(entries, y)
    model.bias += prior_shift(n, totals)
    del got, entries
    give_back_memory()
    return model


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(
        Machine(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        machine = shared.value
        for b in batches:
            for i, j, data, offsets in text_blocks(b.column(1)):
                z = machine.logits(j - i, *block_features(data, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sigmoid(z))],
                                                 names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(tidy(run), f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_fm(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
