"""Phrase collocations from mergeable Misra-Gries summaries.

1. First pass.  Tasks hash every run of one to ``max_words`` words within a
   piece, add up equal hashes and deal them out by ranges of the hash.  A range
   first learns its mass (all occurrences of its runs), then merges what the
   tasks sent into one Misra-Gries summary whose capacity exceeds mass /
   min_count.  Merging adds counters; beyond the capacity the counter after the
   last one that fits is subtracted from all.  What is subtracted in the whole is
   less than min_count, so every run with min_count occurrences keeps a counter.
2. The survivors of a range mark their bits in the range's segment of a filter of
   bounded size (``FILTER_BITS`` at most).  A filter that is too full only lets
   more runs through to the second pass.
3. Second pass.  Tasks read the texts again and count the runs that pass the
   filter and whose own shorter runs pass it, too, by the words themselves (a
   dictionary per block, no hash).  A task adds up the blocks of a language and
   deals the phrases out by a hash, those of a language and deal in one row; the
   deals are added up, phrase by phrase, to counts which are exact.
4. Cuts, nested phrases and the first of every language are joins and
   aggregations of the frequent phrases.

Runs of one word take part, since a part of a phrase is at least as frequent as
the phrase.  No task holds a language: hashes are dealt out evenly, a run that
is a third of a text leaves a task as one counter, joins are left to Spark's skew
handling, and ranks are taken within 64 parts of a language first.

Defined results: a null text is empty; a null language counts as ``und``; rows
count one by one, whatever their ids; ties are ranked by phrase; a language
without frequent phrases gives no rows, an empty table none at all; a text longer
than a block is a block of its own; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, mix, span_hashes, table, text_blocks, text_column, tidy, word_spans

PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
COVERED_PERCENT = 80
SCORE_SCALE = 2_000_000
RANGE_BYTES = 8 << 20                  # text per hash range
FILTER_BITS = 1 << 27
LOCAL_RUNS = 2_000_000                 # hashes of a task before they are sent on
BLOCK = 1 << 20
COUNT_BLOCK = 1 << 22
HELD_PHRASES = 500_000                 # counters of a task before equal phrases are added up
SLACK = 2                              # capacity over mass / min_count
KEY_BYTES = 5                          # of a hash that travel, besides its range
SALTS = 64

_END = np.zeros(256, bool)
_END[[ord(c) for c in PIECE_ENDS]] = True
_INSIDE = ~_END
_INSIDE[[ord(" "), ord("\t")]] = False
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 8 * KEY_BYTES) - 1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of a block and whether the next word
    follows in the same piece."""
    start, end, row = word_spans(data, offsets, _INSIDE)
    piece = np.cumsum(_END[data], dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    return start, end, row, (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])


def run_hashes(words: np.ndarray, linked: np.ndarray, salt: np.ndarray | np.uint64, max_words: int):
    """For n = 1, 2, ...: hashes of the runs of n words from every word on and
    whether the run stays within its piece."""
    h, ok = mix(words ^ salt), np.ones(len(words), bool)
    yield h, ok
    for n in range(2, max_words + 1):
        if len(words) < n:
            return
        h, ok = mix(h[:-1] * _FACTOR + words[n - 1:]), ok[:-1] & linked[n - 2:]
        yield h, ok


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their total counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """Mergeable Misra-Gries summary: a key with count f keeps a counter of at
    least f - lost, and lost <= mass / (capacity + 1)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.capacity:
            self.counters()

    def counters(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
        if len(keys) > self.capacity:
            over = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.lost += over
            keys, counts = keys[counts > over], counts[counts > over] - over
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts


def _sender(ranges: int, max_words: int):
    """Task of the first pass: rows (range, mass or null, keys, counts)."""
    import pyarrow as pa

    kind = pa.schema([("range", pa.int32()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    borders = np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)
    mass = np.zeros(ranges, np.int64)

    def send(held):
        keys, counts = summed(np.concatenate(held))
        cuts = np.append(np.searchsorted(keys, borders), len(keys))
        found = np.flatnonzero(cuts[1:] > cuts[:-1])
        mass[found] += np.add.reduceat(counts, cuts[found])
        packed = (keys & _LOW).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        counts = counts.astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.nulls(len(found), pa.int64()),
             pa.array([packed[cuts[r]:cuts[r + 1]].tobytes() for r in found], pa.binary()),
             pa.array([counts[cuts[r]:cuts[r + 1]].tobytes() for r in found], pa.binary())], schema=kind)

    def run(batches):
        mass[:] = 0
        held, size = [], 0
        for batch in batches:
            salts = batch.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j, data, offsets in text_blocks(batch.column("text"), BLOCK):
                data = lower_ascii(data)
                start, end, row, linked = words_of(data, offsets)
                words = span_hashes(data, start, end)
                for h, ok in run_hashes(words, linked, salts[i:j][row], max_words):
                    held.append(h[ok])
                    size += len(held[-1])
                if size >= LOCAL_RUNS:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)
        found = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(mass[found], pa.int64()),
                                          pa.nulls(len(found), pa.binary()), pa.nulls(len(found), pa.binary())], schema=kind)

    return run


def probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a key in a segment of ``bits`` (a power of two) bits."""
    low = np.uint64(bits - 1)
    return (keys & low).astype(np.int64), ((keys * _FACTOR >> np.uint64(20)) & low).astype(np.int64)


def _merger(min_count: int, bits: int):
    """Task of the ranges, rows sorted by range with the masses first: the
    filter segment of every range and what its summary has subtracted."""
    import pyarrow as pa

    def closed(number, mass, summary):
        keys, counts = summary.counters()
        keys = keys[counts + summary.lost >= min_count]
        marked = np.zeros(bits, np.uint8)
        for place in probes(keys, bits):
            marked[place] = 1
        return pa.RecordBatch.from_pydict({
            "range": pa.array([number], pa.int32()), "mass": pa.array([mass]), "lost": pa.array([summary.lost]),
            "survivors": pa.array([len(keys)]), "segment": pa.array([np.packbits(marked).tobytes()], pa.binary())})

    def run(batches):
        number, mass, summary = None, 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("range", "mass", "keys", "counts")]
            for r, m, k, c in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3]):
                if r != number:
                    if number is not None:
                        yield closed(number, mass, summary or Summary(1))
                    number, mass, summary = r, 0, None
                if m is not None:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(SLACK * (mass // min_count + 1))
                raw = np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, KEY_BYTES)
                keys = np.zeros((len(raw), 8), np.uint8)
                keys[:, :KEY_BYTES] = raw
                summary.merge(keys.view(np.uint64).ravel(), np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
        if number is not None:
            yield closed(number, mass, summary or Summary(1))

    return run


class Phrases:
    """Counts of phrases; equal ones are added up when too many are held."""

    def __init__(self) -> None:
        self.parts, self.held, self.distinct = [], 0, 0

    def add(self, phrases, counts) -> None:
        self.parts.append((phrases, counts))
        self.held += len(phrases)
        if self.held > HELD_PHRASES + 2 * self.distinct:
            self.counters()

    def counters(self):
        """(distinct phrases, their total counts)."""
        import pyarrow as pa

        found = pa.Table.from_batches([pa.RecordBatch.from_arrays([p, pa.array(c, pa.int64())], ["phrase", "n"]) for p, c in self.parts])
        found = found.group_by("phrase", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        phrases, counts = (found.column(c).combine_chunks() for c in ("phrase", "n_sum"))
        self.parts, self.held, self.distinct = [(phrases, counts.to_numpy())], len(phrases), len(phrases)
        return self.parts[0]


def _counter(frequent, ranges: int, bits: int, max_words: int):
    """Task of the second pass: rows (deal, lang, phrases, counts) of the runs
    that pass the filter, phrases separated by line ends (no word has one); the
    empty phrase has all words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = pa.schema([("deal", pa.int32()), ("lang", pa.string()), ("phrases", pa.string()), ("counts", pa.binary())])
    borders = np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)

    def passes(h):
        segments, out = frequent.value, np.ones(len(h), bool)
        base = (np.searchsorted(borders, h, "right") - 1) * np.int64(bits)
        for place in probes(h & _LOW, bits):
            at = base + place
            out &= (segments[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out

    def block(salt, data, offsets):
        """(phrases, counts) of a block, run length by run length."""
        start, end, _, linked = words_of(data, offsets)
        if not len(start):
            return
        yield pa.array([""]), np.array([len(start)])
        places = np.append(0, np.cumsum(end - start)).astype(np.int32)
        inside = np.ascontiguousarray(data[_INSIDE[data]])
        coded = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(places), pa.py_buffer(inside)]).dictionary_encode()
        word, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        size = len(known)
        at = np.frombuffer(known.buffers()[1], np.int32)[:size + 1].astype(np.int64)
        hashes = span_hashes(np.frombuffer(known.buffers()[2], np.uint8), at[:-1], at[1:])[word]
        chosen, ids, texts = None, word, known
        for n, (h, ok) in enumerate(run_hashes(hashes, linked, salt, max_words), 1):
            if n > 1:                          # a frequent run consists of frequent runs
                ok = ok & chosen[:-1] & chosen[1:]
            chosen = ok
            chosen[ok] = passes(h[ok])
            here = np.flatnonzero(chosen)
            if n == 1:
                counts = np.bincount(word[here], minlength=size)
                found = np.flatnonzero(counts)
                yield known.take(pa.array(found)), counts[found]
                continue
            keys, inverse, counts = np.unique(ids[here] * size + word[here + n - 1], return_inverse=True, return_counts=True)
            texts = pc.binary_join_element_wise(texts.take(pa.array(keys // size)), known.take(pa.array(keys % size)), " ")
            ids = np.zeros(len(h), np.int64)
            ids[here] = inverse
            if not len(keys):
                return
            yield texts, counts

    def dealt(lang, phrases, counts):
        data, offsets = text_column(phrases)
        deal = (span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(ranges)).astype(np.int32)
        order = np.argsort(deal, kind="stable")
        found, first = np.unique(deal[order], return_index=True)
        cuts, counts = np.append(first, len(order)), counts[order]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), phrases.take(pa.array(order)))
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array([lang] * len(found), pa.string()), pc.binary_join(lists, "\n"),
             pa.array([counts[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], schema=kind)

    def run(batches):
        held: dict[str, Phrases] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            salts = batch.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)
            code = langs.indices.to_numpy()
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(code == c)
                for _, _, data, offsets in text_blocks(batch.column("text").take(pa.array(mine)), COUNT_BLOCK):
                    for phrases, counts in block(salts[mine[0]], lower_ascii(data), offsets):
                        held.setdefault(lang, Phrases()).add(phrases, counts)
                    if sum(p.held for p in held.values()) > 3 * HELD_PHRASES:
                        yield from (dealt(one, *held.pop(one).counters()) for one in list(held))
        yield from (dealt(one, *held.pop(one).counters()) for one in list(held))

    return run


def _adder(min_count: int):
    """Task of the deals, rows sorted by deal and language: rows (lang, words,
    phrase, n) of the phrases with ``min_count`` occurrences; words 0: all words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def closed(lang, held):
        phrases, counts = held.counters()
        kept = np.flatnonzero((counts >= min_count) | pc.equal(phrases, "").to_numpy(zero_copy_only=False))
        phrases = phrases.take(pa.array(kept))
        words = pc.if_else(pc.equal(phrases, ""), 0, pc.add(pc.count_substring(phrases, " "), 1)).cast(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), words, phrases, pa.array(counts[kept], pa.int64())], schema=kind)

    def run(batches):
        key, held = None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("deal", "lang", "phrases", "counts")]
            for deal, lang, phrases, counts in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3]):
                if (deal, lang) != key:
                    if key is not None:
                        yield closed(key[1], held)
                    key, held = (deal, lang), Phrases()
                held.add(pc.split_pattern(pa.array([phrases.as_py()], pa.string()), "\n").flatten(),
                         np.frombuffer(counts.as_buffer(), np.int64))
        if key is not None:
            yield closed(key[1], held)

    return run


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                     max_words: int = MAX_WORDS, filter_bits: int = FILTER_BITS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, words, phrase, n): exact counts of the runs of up to
    ``max_words`` words with ``min_count`` occurrences; words 0: all words."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    bits = 8
    while bits * ranges < min(size, filter_bits):      # at most twice that
        bits *= 2
    sent = texts.select("salt", "text").mapInArrow(tidy(_sender(ranges, max_words)), "range int, mass long, keys binary, counts binary")
    merged = (sent.withColumn("later", F.col("mass").isNull()).repartition(ranges, "range").sortWithinPartitions("range", "later")
              .drop("later").mapInArrow(tidy(_merger(min_count, bits)), "range int, mass long, lost long, survivors long, segment binary"))
    segments = np.zeros(bits * ranges >> 3, np.uint8)
    for r in merged.select("range", "segment").collect():      # twice filter_bits at most in all
        segments[r["range"] * (bits >> 3):(r["range"] + 1) * (bits >> 3)] = np.frombuffer(r["segment"], np.uint8)
    dealt = texts.mapInArrow(tidy(_counter(spark.sparkContext.broadcast(segments), ranges, bits, max_words)),
                             "deal int, lang string, phrases string, counts binary")
    return dealt.repartition(ranges, "deal").sortWithinPartitions("deal", "lang").mapInArrow(
        tidy(_adder(min_count)), "lang string, words int, phrase string, n long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = TOP, covered_percent: int = COVERED_PERCENT, **options) -> DataFrame:
    """The ``top`` phrases of every language by their weakest cut."""
    counts = checkpointed(frequent_phrases(docs, text_col, lang_col, min_count, max_words, **options))
    totals = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    phrases = counts.where("words > 0").select("lang", "phrase", "words", "n")
    words = F.split("phrase", " ")

    def joined(first, length):
        return F.array_join(F.slice(words, first, length), " ")

    candidates = phrases.where("words > 1")
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
                       joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    scored = cuts.join(known, ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"]).select(
        "lang", "phrase", "a", "k", "l", "r",
        F.expr(f"({SCORE_SCALE} * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + r)").alias("score"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("words > 2").select("lang", F.col("n").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                              F.col("total").alias("n"), "score")


def op11_collocations(spark, sf_dir) -> DataFrame:
    """Whole ``documents``: the first 2000 of every language."""
    return collocations(table(spark, sf_dir, "documents"))
