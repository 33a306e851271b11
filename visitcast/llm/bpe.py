"""Byte-level BPE by corpus-level merge replay.

Spark deals the documents out; every task takes its Arrow batch as a small
corpus, collects the distinct pattern matches of the batch, and replays the
merges on all of them together: an inverted index from merge rank to the word
positions where that pair stands, emptied in rank order, where each merge
touches only the two neighbours of the merged pair.  Words are then looked up
to give the ids of every text.  No shuffle, no group, memory bounded by the
batch plus ``memo_words`` words remembered within the task.

The rank of a pair is the rank of its joined bytes.  A merge can create a
pair of lower rank than the one being replayed (the vocabulary allows several
splits of a token); such a pair is merged at once in its word, which is what
merging the lowest-ranked pair first, leftmost on ties, means for that word.

Defined results: a null text counts as empty (no ids, hashes of no bytes);
repeated rows give repeated rows; a null id stays null; other columns are
ignored, whatever their names.  The vocabulary file is read on the driver
(its size is fixed by the file) and sent to tasks as a broadcast variable.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy

MEMO_WORDS = 400_000
CORPUS_BYTES = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Vocabulary, pair table and pattern; built once per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import numpy as np
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        # left id * width + right id -> rank of the joined bytes.
        self.width = max(self.tokens) + 1
        self.pairs = {ranks[t[:k]] * self.width + ranks[t[k:]]: r for t, r in ranks.items()
                      for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.memo: dict[str, bytes]
        self.older: dict[str, bytes]
        self.forget()

    def forget(self) -> None:
        self.memo, self.older = {}, {}

    def replay(self, words: list[bytes]) -> tuple[bytes, list[int]]:
        """Ids of all words (packed, end to end) and where each word's ids end.

        All merges are applied in rank order over all words at once.
        """
        import numpy as np

        pairs, width = self.pairs, self.width
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        links = np.arange(1, len(data) + 1)
        links[ends[ends > 0] - 1] = -1
        following = links.tolist()
        links = np.arange(-1, len(data) - 1)
        links[np.concatenate([[0], ends])[:-1][np.diff(ends, prepend=0) > 0]] = -1
        previous = links.tolist()
        token = self.byte_ids[data].tolist()
        # Inverted index of the byte pairs: rank -> positions, in order.
        first = np.full(len(data), -1, np.int64)
        first[:-1] = self.byte_pairs[data[:-1], data[1:]]
        first[ends[ends > 0] - 1] = -1
        by_rank = np.argsort(first, kind="stable")
        by_rank = by_rank[np.searchsorted(first[by_rank], 0):]
        ranks, starts = np.unique(first[by_rank], return_index=True)
        index = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(by_rank, starts[1:]))} if len(ranks) else {}
        order = list(index)
        heapq.heapify(order)
        while order:
            rank = heapq.heappop(order)
            places = index.pop(rank)
            places.sort()
            pending: list[tuple[int, int]] = []          # pairs of lower rank, in their word
            for p in places:
                r = rank
                while True:
                    q = following[p]
                    if q >= 0 and token[p] >= 0 and pairs.get(token[p] * width + token[q]) == r:
                        token[p], token[q] = r, -1
                        following[p] = nxt = following[q]
                        prv = previous[p]
                        if nxt >= 0:
                            previous[nxt] = p
                            if (new := pairs.get(r * width + token[nxt])) is not None:
                                if new < rank:
                                    heapq.heappush(pending, (new, p))
                                elif (found := index.get(new)) is not None:
                                    found.append(p)
                                else:
                                    index[new] = [p]
                                    heapq.heappush(order, new)
                        if prv >= 0 and (new := pairs.get(token[prv] * width + r)) is not None:
                            if new < rank:
                                heapq.heappush(pending, (new, prv))
                            elif (found := index.get(new)) is not None:
                                found.append(prv)
                            else:
                                index[new] = [prv]
                                heapq.heappush(order, new)
                    if not pending:
                        break
                    r, p = heapq.heappop(pending)
        left = np.array(token, np.int64)
        live = left >= 0
        return left[live].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(live)])[ends].tolist()

    def encode_corpus(self, texts: list[str], memo_words: int = MEMO_WORDS) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if 2 * len(self.memo) > memo_words:             # the older half goes
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = []
        for word in {w for words in split for w in words}:
            if word not in memo:
                if (known := older.get(word)) is None:
                    new.append(word)
                else:
                    memo[word] = known
        left, packed = [], []
        for word in new:
            whole = self.ranks.get(data := word.encode())
            if whole is None:
                left.append(word)
                packed.append(data)
            else:
                memo[word] = whole.to_bytes(4, "little")
        ids, ends = self.replay(packed)
        start = 0
        for word, end in zip(left, ends):
            memo[word] = ids[4 * start:4 * end]
            start = end
        return [b"".join([memo[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids packed as by ``encode_corpus``."""
        import numpy as np

        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec; a worker keeps the last vocabulary it used."""
    ranks, pattern, key = shared.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def share_vocabulary(spark: SparkSession, path: str, pattern: str):
    """Broadcast (ranks, pattern, key); the size is that of the given file."""
    ranks = load_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return spark.sparkContext.broadcast((ranks, pattern, key))


def encode(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text",
           memo_words: int = MEMO_WORDS, corpus_bytes: int = CORPUS_BYTES) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row."""
    return _code(docs, vocabulary, id_col, text_col, memo_words, corpus_bytes, digests=False)


def round_trip(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text",
               memo_words: int = MEMO_WORDS, corpus_bytes: int = CORPUS_BYTES) -> DataFrame:
    """Encode every text, decode the ids, and return count and digests."""
    return _code(docs, vocabulary, id_col, text_col, memo_words, corpus_bytes, digests=True)


def _code(docs, vocabulary, id_col, text_col, memo_words, corpus_bytes, digests) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        codec = _codec(vocabulary)
        codec.forget()                                  # words are remembered for a task only
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, i = pc.binary_length(texts).to_pylist(), 0
            while i < len(ids):
                j, n = i, 0
                while j < len(ids) and (j == i or n + (sizes[j] or 0) <= corpus_bytes):
                    n += sizes[j] or 0
                    j += 1
                coded = codec.encode_corpus([t or "" for t in texts.slice(i, j - i).to_pylist()], memo_words)
                if digests:
                    cols = [pa.array([len(c) // 4 for c in coded], pa.int64()),
                            pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                            pa.array([hashlib.sha256(codec.decode(c)).hexdigest() for c in coded], pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    cols, names = [pa.array(coded, pa.binary())], ["doc_id", "ids"]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *cols], names=names)
                i = j
        codec.forget()

    schema = f"doc_id {id_type}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests
                                      else "ids binary")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def decode(coded: DataFrame, vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data (binary) of rows of packed ids; null ids give no bytes."""
    id_type = coded.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        codec = _codec(vocabulary)
        for batch in batches:
            data = [codec.decode(c or b"") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")) \
        .mapInArrow(tidy(run), f"doc_id {id_type}, data binary")


def public_vocabulary(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken"):
    """The installed public vocabulary of the contract."""
    import public_tokenizers
    return share_vocabulary(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def op5_byte_bpe(spark, sf_dir) -> DataFrame:
    from .common import table
    return round_trip(table(spark, sf_dir, "documents"), public_vocabulary(spark))
