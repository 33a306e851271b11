"""Language-model scoring by masked pseudo-likelihood.

The network predicts a word from ``REACH`` words on both sides: the hidden
layer is tanh of the sum of one embedding per context place, the output a
two-level softmax (class, then word in its class).  The score of a text is the
sum over all of its words of log p(word | both sides): every word is masked
once.  Words are lower-case runs of letters, digits and non-ASCII characters;
the network predicts the most frequent ones of the corpus by themselves and all
others by hash bucket.  A third level gives the word in its bucket:
log p(word | bucket) comes from the counts of all words of the corpus, a table
that grows with it and is joined by Spark; words that the corpus does not hold
share ``UNSEEN`` of a count per known word and one.

Everything learnt covers the whole corpus: word counts come from one
aggregation over all texts (pre-aggregated per Arrow batch), which fixes the
vocabulary and the starting biases; then, in each of ``rounds``, every task
starts from the shared weights and trains in numpy on all positions of the
texts of this round (a hash of the text deals it to one, so every position is a
target once).  A task has at least ``UNIT_WORDS`` words, however the texts are
partitioned.  It sends the rows of the weight tables that it has changed, each
with the number of positions that changed it, and Spark averages every row by
that number: a copy that never saw a word has no say in its row, so the model
does not fade as tasks are added.  The driver holds the words predicted by
themselves, the ``COMMON`` most frequent words of the buckets and one copy of
the weights, all of fixed size.  Tasks need one block of text at a time.

Defined results: a null text counts as empty; a text without words has
n_words 0, log_prob 0 and null mean_log_prob; repeated rows are scored alike
(and count as often as they stand in the corpus); a null id stays null; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, checkpointed, lower_ascii, mix, span_hashes, table, text_blocks, tidy, word_spans

REACH = 2
CLASS_SIZE = 64
KNOWN = 1536                              # words predicted by themselves
BUCKETS = 512                             # hash buckets of all others, a power of two
UNSEEN = 0.5                              # added to the count of every word of a bucket, and of one unseen word
SIZE = KNOWN + BUCKETS
CLASSES = SIZE // CLASS_SIZE
DIM = 16
COMMON = 1 << 16                          # words whose counts go along with the vocabulary
ROUNDS = 2
BATCH = 4096
UNIT_WORDS = 1_000_000                    # words of a training task, at least


def block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = lower_ascii(data)
    start, end, row = word_spans(lower, offsets, ALNUM)
    return span_hashes(lower, start, end), row


def word_counts(texts: DataFrame) -> DataFrame:
    """(word hash, n) over all texts."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            parts = [np.unique(block_words(data, offsets)[0], return_counts=True)
                     for _, _, data, offsets in text_blocks(b.column(0))]
            if parts:
                words, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return texts.mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    words: np.ndarray                     # sorted hashes of the known words
    ids: np.ndarray                       # their ids, 1 is the most frequent
    counts: np.ndarray                    # corpus count of every output
    kinds: np.ndarray                     # different words of every bucket
    common: np.ndarray | None = None      # sorted hashes of the most frequent words
    common_counts: np.ndarray | None = None
    table: DataFrame | None = None        # (word, n) of all words, left out in tasks

    def in_bucket(self) -> np.ndarray:
        """Logarithm of what a smoothed count is divided by, per bucket."""
        return np.log(self.counts[KNOWN:] + UNSEEN * (self.kinds + 1))

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """1..SIZE; 0 is left for the gap between texts."""
        out = 1 + KNOWN + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            out[known] = self.ids[at[known]]
        return out


def vocabulary(texts: DataFrame) -> Vocabulary:
    counts = checkpointed(word_counts(texts))
    common = counts.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    known = common.slice(0, KNOWN)
    top = texts.sparkSession.createDataFrame([(w,) for w in known.column("word").to_pylist()], "word long")
    rest = counts.join(F.broadcast(top), "word", "left_anti") \
        .groupBy(F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")) \
        .toArrow()
    words = known.column("word").to_numpy().view(np.uint64)
    n = known.column("n").to_numpy()
    order = np.lexsort((words, -n))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    total = np.zeros(SIZE)
    total[rank] = n
    total[KNOWN + rest.column("bucket").to_numpy()] = rest.column("n").to_numpy()
    kinds = np.zeros(BUCKETS)
    kinds[rest.column("bucket").to_numpy()] = rest.column("kinds").to_numpy()
    by_hash = np.argsort(words)
    often, many = common.column("word").to_numpy().view(np.uint64), common.column("n").to_numpy()
    by_word = np.argsort(often)
    return Vocabulary(words[by_hash], rank[by_hash] + 1, total, kinds, often[by_word], many[by_word], counts)


@dataclass
class Network:
    context: np.ndarray                   # (2 * REACH, SIZE + 1, DIM); id 0 is the gap
    classes: np.ndarray                   # (CLASSES, DIM + 1), the bias last
    members: np.ndarray                   # (SIZE, DIM + 1), the bias last

    @staticmethod
    def start(counts: np.ndarray, seed: int = 5) -> "Network":
        """Random embeddings; the biases give the corpus frequencies."""
        rng = np.random.default_rng(seed)
        smooth = (counts + 0.5).reshape(CLASSES, CLASS_SIZE)
        net = Network(rng.normal(0, 0.3, (2 * REACH, SIZE + 1, DIM)).astype(np.float32),
                      rng.normal(0, 0.1, (CLASSES, DIM + 1)).astype(np.float32),
                      rng.normal(0, 0.1, (SIZE, DIM + 1)).astype(np.float32))
        net.classes[:, -1] = np.log(smooth.sum(1) / smooth.sum())
        net.members[:, -1] = np.log(smooth / smooth.sum(1, keepdims=True)).ravel()
        return net

    def rows(self) -> np.ndarray:
        """All weights as rows of DIM + 1 numbers."""
        flat = self.context.reshape(-1, DIM)
        return np.concatenate([np.pad(flat, ((0, 0), (0, 1))), self.classes, self.members])

    @staticmethod
    def of_rows(rows: np.ndarray) -> "Network":
        rows = rows.astype(np.float32)
        n = 2 * REACH * (SIZE + 1)
        return Network(rows[:n, :DIM].reshape(2 * REACH, SIZE + 1, DIM).copy(), rows[n:n + CLASSES].copy(),
                       rows[n + CLASSES:].copy())

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inputs of the output layer (a one is appended for the bias)."""
        z, part = np.zeros((2, len(at), DIM), np.float32)
        for k, step in enumerate([s for s in range(-REACH, REACH + 1) if s]):
            z += np.take(self.context[k], ids[at + step], axis=0, out=part, mode="clip")
        out = np.ones((len(at), DIM + 1), np.float32)
        np.tanh(z, out=out[:, :DIM])
        return out

    def log_prob(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p(word | both sides) of the words at the given places."""
        h = self.hidden(ids, at)
        target = ids[at] - 1
        group = target // CLASS_SIZE
        out = _log_softmax(h @ self.classes.T, group)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            own = order[cuts[c]:cuts[c + 1]]
            if len(own):
                out[own] += _log_softmax(h[own] @ self.members[c * CLASS_SIZE:(c + 1) * CLASS_SIZE].T, target[own] - c * CLASS_SIZE)
        return out


def _log_softmax(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithm of the target's softmax; works in place (fresh pages cost more
    than the sums)."""
    logits -= logits.max(1, keepdims=True)
    own = logits[np.arange(len(target)), target]
    return own - np.log(np.exp(logits, out=logits).sum(1))


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place."""
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


class Trainer:
    """Adagrad on the two-level log loss of batches of positions."""

    def __init__(self, net: Network, rate: float = 0.1) -> None:
        self.net, self.rate = net, rate
        self.seen = [np.zeros(w.shape[:-1], np.int64) for w in (net.context, net.classes, net.members)]
        self.sums = [np.full_like(w, 0.1) for w in (net.context, net.classes, net.members)]

    def _apply(self, weights: np.ndarray, sums: np.ndarray, where, grad: np.ndarray) -> None:
        sums[where] += grad ** 2
        weights[where] -= self.rate * grad / np.sqrt(sums[where])

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        net, n = self.net, len(at)
        h = net.hidden(ids, at)
        target = ids[at] - 1
        group = target // CLASS_SIZE
        p = _softmax(h @ net.classes.T)
        p[np.arange(n), group] -= 1
        back = p @ net.classes
        self._apply(net.classes, self.sums[1], slice(None), p.T @ h)
        self.seen[1] += n
        order = np.argsort(group.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            own = order[cuts[c]:cuts[c + 1]]
            if len(own):
                rows = slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE)
                mine = h[own]
                q = _softmax(mine @ net.members[rows].T)
                q[np.arange(len(own)), target[own] - c * CLASS_SIZE] -= 1
                back[own] += q @ net.members[rows]
                self._apply(net.members, self.sums[2], rows, q.T @ mine)
                self.seen[2][rows] += len(own)
        dz = back[:, :DIM] * (1 - np.square(h[:, :DIM]))
        for k, step in enumerate([s for s in range(-REACH, REACH + 1) if s]):
            words = ids[at + step].astype(np.uint16)
            order = np.argsort(words, kind="stable")
            first = np.flatnonzero(np.diff(words[order].astype(np.int64), prepend=-1))
            changed = words[order][first]
            self._apply(net.context[k], self.sums[0][k], changed, np.add.reduceat(dz[order], first))
            self.seen[0][k][changed] += np.diff(first, append=n)


def sequence(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids with REACH gaps around every text, places of the words, their rows
    and hashes)."""
    hashes, row = block_words(data, offsets)
    at = np.arange(len(row)) + (row + 1) * REACH
    ids = np.zeros(len(row) + len(offsets) * REACH, np.int64)
    ids[at] = vocab.encode(hashes)
    return ids, at, row, hashes


def bucket_words(row: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, how often each stands in its row, offsets of the rows)."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return (hashes[first].view(np.int64), np.diff(first, append=len(row)).astype(np.int32),
            np.searchsorted(row[first], np.arange(n_rows + 1)).astype(np.int32))


def round_of(text, rounds: int):
    """The round in which a text is trained on (copies share one)."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(rounds))


def train(texts: DataFrame, rounds: int = ROUNDS, seed: int = 5) -> tuple[Vocabulary, Network]:
    """Vocabulary and weights from all texts (a frame of one string column)."""
    spark = texts.sparkSession
    vocab = vocabulary(texts)
    net = Network.start(vocab.counts, seed)
    shape = ", ".join(f"w{k} float" for k in range(DIM + 1))
    units = max(1, int(vocab.counts.sum()) // UNIT_WORDS)
    texts = texts.toDF("text").coalesce(units)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((replace(vocab, table=None), net.rows()))

        def run(batches, shared=shared, turn=turn):
            import pyarrow as pa

            words, rows = shared.value
            trainer = Trainer(Network.of_rows(rows))
            for b in batches:
                for _, _, data, offsets in text_blocks(b.column(0)):
                    ids, at, _, _ = sequence(words, data, offsets)
                    at = np.random.default_rng([seed, turn, len(data), len(at)]).permutation(at)
                    for k in range(0, len(at), BATCH):
                        trainer.step(ids, at[k:k + BATCH])
            seen = np.concatenate([x.ravel() for x in trainer.seen])
            changed = np.flatnonzero(seen).astype(np.int32)
            if len(changed):
                out = trainer.net.rows()[changed]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(changed), pa.array(seen[changed]), *(pa.array(out[:, k]) for k in range(DIM + 1))],
                    names=["row", "seen", *(f"w{k}" for k in range(DIM + 1))])

        sent = texts.where(round_of(F.col("text"), rounds) == turn).mapInArrow(tidy(run), f"row int, seen long, {shape}")
        mean = sent.groupBy("row").agg(*[
            (F.sum(F.col(f"w{k}").cast("double") * F.col("seen")) / F.sum("seen")).alias(f"w{k}")
            for k in range(DIM + 1)]).toArrow()
        if mean.num_rows:
            rows = net.rows()
            rows[mean.column("row").to_numpy()] = np.stack([mean.column(f"w{k}").to_numpy() for k in range(DIM + 1)], 1)
            net = Network.of_rows(rows)
    return vocab, net


def score(docs: DataFrame, vocab: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (natural logarithm, summed) and its mean."""
    shared = docs.sparkSession.sparkContext.broadcast((replace(vocab, table=None), net))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        words, model = shared.value
        divisor = words.in_bucket()
        for b in batches:
            for i, j, data, offsets in text_blocks(b.column(1), 1 << 20):
                ids, at, row, hashes = sequence(words, data, offsets)
                total = np.zeros(j - i)
                for k in range(0, len(at), 1 << 13):
                    part = slice(k, k + (1 << 13))
                    total += np.bincount(row[part], model.log_prob(ids, at[part]).astype(float), j - i)
                bucket = ids[at] - 1 - KNOWN
                rare = bucket >= 0
                total -= np.bincount(row[rare], divisor[bucket[rare]], j - i)
                # The frequent words of the buckets are looked up here, the others joined.
                own, hashes = row[rare], hashes[rare]
                where = np.minimum(np.searchsorted(words.common, hashes), max(len(words.common) - 1, 0))
                listed = words.common[where] == hashes if len(words.common) else np.zeros(len(hashes), bool)
                total += np.bincount(own[listed], np.log(words.common_counts[where[listed]] + UNSEEN), j - i)
                word, times, cuts = bucket_words(own[~listed], hashes[~listed], j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.bincount(row, minlength=j - i).astype(np.int64)),
                     pa.array(total), pa.ListArray.from_arrays(cuts, word), pa.ListArray.from_arrays(cuts, times)],
                    names=["doc_id", "n_words", "log_prob", "word", "times"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(tidy(run), f"doc_id {id_type}, n_words long, log_prob double, word array<long>, times array<int>")
    scored = checkpointed(scored.withColumn("row", F.monotonically_increasing_id()))
    # The words of the buckets meet their counts; the dividing sums are already taken off.
    inside = scored.select("row", F.inline(F.arrays_zip("word", "times"))).join(vocab.table, "word", "left") \
        .groupBy("row").agg(F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(0)) + UNSEEN)).alias("inside"))
    scored = scored.select("row", "doc_id", "n_words", "log_prob").join(inside, "row", "left").select(
        "doc_id", "n_words", (F.col("log_prob") + F.coalesce("inside", F.lit(0.0))).alias("log_prob"))
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
                      ) -> DataFrame:
    """Train on all texts of ``docs`` and score each of them."""
    vocab, net = train(docs.select(F.col(text_col).alias("text")), rounds)
    return score(docs, vocab, net, id_col, text_col)


def op8_masked_lm(spark, sf_dir) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
