"""Exact removal of repeated byte strings by distributed prefix doubling.

Every position is known by the string of ``threshold`` (50) bytes that starts
there.  Ranks are 64-bit names of prefixes of growing length (equal prefixes,
equal rank); Spark sorts (rank, position) pairs, positions whose rank stands
in one document only leave, and the others go on with a longer prefix until
the threshold is reached:

1. Rank by 20 bytes.  A string of 50 bytes is represented by the smallest
   20-byte name inside it, which depends on the string alone; neighbouring
   positions with the same representative form a run, and a run is one row, so
   about one row per 16 bytes is sorted instead of one per byte.  The second
   half of the rank pair is the name of the whole run: a run that a smaller
   document has as well is removed whole, a representative of one document
   drops out, and what is left are the edges of repeated passages.
2. The same by 40 bytes for the runs that are left (a row per 6 bytes).
3. The same by 50 bytes: the runs are single positions, nothing is left.

Before every sort a task drops what it can decide itself: of equal runs in its
part of a batch only those of the smallest document travel, and of a
representative with more than ``hot_rows`` different runs in the part one
travels while the others go on to the next step undecided.  So a group of
copies or a passage that a third of all documents hold sends a bounded number
of rows per part under one key.  Results go back to the documents by doc_id;
each step ends in a checkpoint in the shared folder.

Runs are equal if 128 bits of two independent hashes agree.

Defined results: a null text counts as empty; texts under 50 bytes lose
nothing; rows that repeat a doc_id are one document (a stretch that one of
them loses is lost by all of them); rows with null id neither lose bytes nor
make others lose any; other columns are ignored by the search, whatever their
names; an empty table gives an empty result.  Memory of a task is that of its
Arrow batch, or of the longest text.
"""

from __future__ import annotations

import gc
import hashlib
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OTHER_POWERS, checkpointed, give_back_memory, mix, span_hasher, table, text_blocks, text_column, tidy

THRESHOLD = 50
STEPS = (20, 40)                          # bytes ranked by before the threshold
PART_BYTES = 4 << 20                      # text that a task looks at together before it sends rows
HOT_ROWS = 256
# Kinds of rows of a step.
PLAIN, DECIDED, LONE, HOT = 0, 1, 2, 3
# A span is first position << 30 | last - first; rows carry the kind above it.
FIRST_SHIFT, KIND_SHIFT = 30, 61
LENGTH_MASK, SPAN_MASK = (1 << FIRST_SHIFT) - 1, (1 << KIND_SHIFT) - 1


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[:len(values) - width + 1], out[width - span:])
    return out


def span_ends(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) positions of spans."""
    first = spans >> FIRST_SHIFT
    return first, first + (spans & LENGTH_MASK)


def covered(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One flag per place: inside one of the spans [first, end)."""
    steps = np.zeros(size + 1, np.int32)
    inside = first < size                               # rows that share a doc_id may differ in length
    np.add.at(steps, first[inside], 1)
    np.add.at(steps, np.minimum(end[inside], size), -1)
    return np.cumsum(steps[:-1]) > 0


def block_runs(data: np.ndarray, offsets: np.ndarray, threshold: int, start: int, wanted: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, representative, run name) of all runs of a block, or
    of those among the wanted places; first and last are positions inside the
    text."""
    if len(data) < threshold:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(len(data) - start + 1)
    least = sliding_minimum(span_hasher(data)(at, at + start), threshold - start + 1)
    room = np.repeat(offsets[1:], np.diff(offsets))[:len(least)]
    at = at[:len(least)]
    fits = at + threshold <= room                       # the string ends in its text
    at = at[fits if wanted is None else fits & wanted[:len(least)]]
    least = least[at]
    if not len(at):
        return at, at, at, least, least
    # Ranked by the whole string every position stands for itself.
    new = np.ones(len(at), bool)
    if start < threshold:
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    names = span_hasher(data, OTHER_POWERS)(first, last + threshold)
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first - offsets[text], last - offsets[text], least[new], names


def parts_by_document(batches):
    """Parts of batches (id, text, ...), each in the order of the ids."""
    import pyarrow as pa

    for batch in batches:
        order = pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable"))
        at, sizes = 0, np.diff(text_column(batch.column(1))[1])[order.to_numpy()]
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PART_BYTES, "right")))
            yield pa.RecordBatch.from_struct_array(batch.to_struct_array().take(order[at:end]))
            at = end


def first_of(keys: list[np.ndarray]) -> np.ndarray:
    """For every row a row with the same keys, the first one (but for hash
    collisions, where it may be a later one or the row itself)."""
    mixed = keys[0]
    for k in keys[1:]:
        mixed = mix(mixed) + k.astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    out = np.empty(len(order), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


def _runs(threshold: int, start: int, hot_rows: int, opened: bool):
    """Arrow task: documents (with their open spans) in, ranked runs out."""

    def wanted(batch, i, j, offsets):
        if not opened:
            return None
        spans = batch.column(2).slice(i, j - i)
        values = spans.flatten().to_numpy()
        row = np.repeat(np.arange(j - i), np.diff(spans.offsets.to_numpy()))
        first, last = span_ends(values)
        size = np.diff(offsets)[row]
        inside = first < size
        return covered(int(offsets[-1]), (first + offsets[row])[inside],
                       (np.minimum(last + 1, size) + offsets[row])[inside])

    def run(batches):
        import pyarrow as pa

        for b in parts_by_document(batches):
            ids = b.column(0).to_numpy()
            parts = []
            for i, j, data, offsets in text_blocks(b.column(1)):
                text, first, last, least, name = block_runs(data, offsets, threshold, start, wanted(b, i, j, offsets))
                parts.append((ids[text + i], (first << FIRST_SHIFT) | (last - first), least, name))
            if not parts:
                continue
            doc, span, least, name = (np.concatenate(c) for c in zip(*parts))
            same = first_of([least, name])
            decided = doc[same] < doc
            kind = np.where(decided, DECIDED, PLAIN)
            # Rows of a representative with very many different runs here.
            live = np.flatnonzero(~decided)
            first = first_of([least[live]])
            hot = np.bincount(first, same[live] == live, len(live))[first] > hot_rows
            kind[live[hot]] = np.where(first == np.arange(len(live)), HOT, LONE)[hot]
            alone = (kind == DECIDED) | (kind == LONE)   # needs no partner: any key will do
            least = np.where(alone, mix(name + span.view(np.uint64) + doc.astype(np.uint64)), least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), pa.array(name.view(np.int64)), pa.array(doc),
                 pa.array((kind << KIND_SHIFT) | span)], names=["rank", "run", "doc_id", "at"])

    return run


def _release(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files of the step that is over (its
    result is in a checkpoint) before the next step writes its own.  Twice,
    with a pause: the bridge lets go of dropped frames once a second, and the
    executors delete files after the driver's collection."""
    for _ in range(2):
        gc.collect()
        time.sleep(1.5)
        spark.sparkContext._jvm.System.gc()


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
            steps: tuple[int, ...] = STEPS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, spans): the positions whose string of ``threshold`` bytes a
    smaller document has; documents that lose nothing are left out."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"),
                                                         F.col(text_col).alias("text"))
    found, opened = [], None
    for start in (*steps, threshold):
        result = _step(texts, opened, threshold, start, hot_rows)
        found.append(result.where(F.size("gone") > 0).select("doc_id", "gone"))
        opened = result.where(F.size("opened") > 0).select("doc_id", "opened")
        _release(spark)
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union.groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("spans"))


def _step(texts: DataFrame, opened: DataFrame | None, threshold: int, start: int, hot_rows: int) -> DataFrame:
    """Rank by ``start`` bytes; per document the spans to remove and the open ones."""
    rows = texts if opened is None else texts.join(opened, "doc_id").select("doc_id", "text", "opened")
    rows = rows.mapInArrow(tidy(_runs(threshold, start, hot_rows, opened is not None)),
                           "rank long, run long, doc_id long, at long").repartition("rank")
    kind = F.shiftright("at", KIND_SHIFT)
    rows = rows.withColumn("alone", kind.isin(DECIDED, LONE))
    by_run, by_rank = Window.partitionBy("rank", "alone", "run"), Window.partitionBy("rank", "alone")
    rows = (rows.withColumn("run_min", F.min("doc_id").over(by_run))
            .withColumn("several", ((F.min("doc_id").over(by_rank) != F.max("doc_id").over(by_rank))
                                    & (F.min("run").over(by_rank) != F.max("run").over(by_rank)))
                        | (F.max(kind).over(by_rank) == HOT)))
    gone = (kind == DECIDED) | (~F.col("alone") & (F.col("run_min") < F.col("doc_id")))
    left = (kind == LONE) | (~F.col("alone") & F.col("several"))
    rows = rows.where(gone | left).select("doc_id", F.col("at").bitwiseAND(F.lit(SPAN_MASK)).alias("span"),
                                          gone.alias("gone"))
    return checkpointed(rows.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("gone"), F.col("span"))).alias("gone"),
        F.collect_list(F.when(~F.col("gone"), F.col("span"))).alias("opened")))


def lost_bytes(size: int, spans: np.ndarray, threshold: int) -> np.ndarray:
    """One flag per byte of a text: covered by a removed string."""
    first, last = span_ends(spans)
    return covered(size, first, last + threshold)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, threshold: int, options: dict) -> tuple[DataFrame, str]:
    """The documents with their spans in the column ``_spans`` (or, where the
    documents have that, with more underscores in front)."""
    name = "_spans"
    while any(name == c.lower() for c in docs.columns):
        name = "_" + name
    spans = removed(docs, id_col, text_col, threshold, **options) \
        .select(F.col("doc_id").alias(name + "_of"), F.col("spans").alias(name))
    return docs.join(spans, docs[id_col].cast("long") == spans[name + "_of"], "left").drop(name + "_of"), name


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
            **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_column(b.column(1))
            spans = b.column(2)
            out = []
            for k in range(b.num_rows):
                text = data[offsets[k]:offsets[k + 1]]
                own = spans[k].values
                if own is None:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                lost = lost_bytes(len(text), own.to_numpy(), threshold)
                out.append((len(text), int(lost.sum()), int(np.count_nonzero(np.diff(lost, prepend=False) & lost)),
                            hashlib.sha256(text[~lost]).hexdigest()))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined, name = _with_spans(bare, "doc_id", "text", threshold, options)
    return joined.select("doc_id", "text", name).mapInArrow(tidy(run), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
                **options) -> DataFrame:
    """All rows and columns of ``docs``; the text column loses the repeated
    bytes (a character that was cut is dropped; null stays null)."""
    joined, name = _with_spans(docs, id_col, text_col, threshold, options)

    @F.pandas_udf("string")
    def kept(text, spans):
        out = []
        for t, s in zip(text, spans):
            if t is not None and s is not None:
                data = np.frombuffer(t.encode(), np.uint8)
                t = data[~lost_bytes(len(data), np.asarray(s, np.int64), threshold)].tobytes().decode(errors="ignore")
            out.append(t)
        give_back_memory()
        return pd.Series(out, dtype=object)

    cut = F.when(F.col(name).isNull(), F.col(text_col)).otherwise(kept(F.col(text_col), F.col(name)))
    return joined.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op7_suffix_dedup(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
