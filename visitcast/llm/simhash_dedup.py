"""SimHash near-duplicates over a Gray-order hierarchical index.

1. Fingerprints: XXH64 (seed 42) of every word shingle of the whole text; a bit
   is set if it is set in over half of them.  Equal fingerprints collapse to
   their smallest doc_id before anything else moves.
2. Index: the 64 bits are cut into four blocks.  Two fingerprints within two
   bits agree in at least two blocks, so each fingerprint is filed under the
   six masks of two blocks; the shared masked pattern is the upper node of the
   index and Spark deals the nodes out by it.  A node with more than
   ``node_limit`` fingerprints is cut again by the six masks of two quarters of
   its remaining bits, which leaves 2^16 below it at most: no task holds an
   unbounded group, and nothing is dropped.
3. Search: inside a task the fingerprints of a node lie in Gray rank order, so
   neighbours share most bits.  Every ``GROUP`` neighbours get an upper node
   that holds the masked pattern they share, those again, up to one root;
   pairs of upper nodes are descended together, a level adding the differences
   in the bits its parents had not factored out, and a pair of groups beyond
   the radius is pruned whole.  The order decides how much the groups share and
   so how many are visited, not which pairs are found.
   A node gives a spanning forest of its links, never all pairs.
4. Components of the links (see ``components``).

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; rows that repeat a doc_id are
one document; a row with null id keeps its fingerprint, links nothing and has
a null component; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table, text_column, tidy
from .components import connected_components

SHINGLE = 3
RADIUS = 2                                # the masks below serve up to two bits
SEED = 42
NODE_LIMIT = 20_000
GROUP = 4                                 # neighbours that share an upper node
ALL_BITS = (1 << 32) - 1                  # bits of ``rest``
BLOCK_WORDS = 1 << 19
_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ONES = _BITS.sum(1).astype(np.int8)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.lower().split()           # bytes: A-Z only, the six ASCII breaks only
    if len(words) < size:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    if size == 3:
        return [xxh64_intdigest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    return [xxh64_intdigest(b" ".join(words[i:i + size]), SEED) for i in range(len(words) - size + 1)]


def majority(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Fingerprint of every row: bits set in over half of its hashes."""
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    total = np.bincount(row, minlength=rows)
    out = np.zeros(rows, np.uint64)
    for k in range(8):
        counts = np.bincount(row * 256 + lanes[:, k], minlength=rows * 256).reshape(rows, 256) @ _BITS
        byte = ((2 * counts > total[:, None]) << np.arange(8)).sum(1).astype(np.uint64)
        out |= byte << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_column(b.column(1))
            blob, out, hashes, counts = data.tobytes(), [], [], []
            for i in range(b.num_rows):
                found = shingle_hashes(blob[offsets[i]:offsets[i + 1]], shingle)
                hashes += found
                counts.append(len(found))
                if len(hashes) >= BLOCK_WORDS or i == b.num_rows - 1:
                    row = np.repeat(np.arange(len(counts)), counts)
                    out.append(majority(np.array(hashes, np.uint64), row, len(counts)))
                    hashes, counts = [], []
            fp = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(tidy(run), f"doc_id {id_type}, fp long")


def _fields(value: Column, width: int) -> list[Column]:
    """Four fields of ``width`` bits, highest first."""
    return [F.shiftrightunsigned(value, width * (3 - k)).bitwiseAND(F.lit((1 << width) - 1)) for k in range(4)]


def _masked(value: Column, width: int) -> Column:
    """One struct per mask: its number, the shared pattern, the other bits."""
    f = _fields(value, width)
    out = []
    for m, (i, j) in enumerate(_PAIRS):
        p, q = (k for k in range(4) if k not in (i, j))
        out.append(F.struct(F.lit(m).alias("mask"), F.shiftleft(f[i], width).bitwiseOR(f[j]).alias("shared"),
                            F.shiftleft(f[p], width).bitwiseOR(f[q]).alias("rest")))
    return F.array(*out)


def gray_rank(value: Column, bits: int) -> Column:
    """Position of a bit pattern in the reflected Gray order."""
    shift = 1
    while shift < bits:
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
        shift *= 2
    return value


def upper_nodes(node: np.ndarray, rest: np.ndarray, group: int = GROUP):
    """Levels of the index from the root down, each (first child, children,
    mask, value) per upper node: ``group`` neighbours of the level below in the
    same node share a parent that holds the bits they all agree in."""
    at, mask, value = node, np.full(len(rest), ALL_BITS), rest
    levels = []
    while True:
        edge = np.concatenate([[True], at[1:] != at[:-1]])
        start = np.flatnonzero(edge)
        place = np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))
        first = np.flatnonzero(place % group == 0)
        count = np.diff(np.concatenate([first, [len(at)]]))
        every, some = np.bitwise_and.reduceat(value, first), np.bitwise_or.reduceat(value, first)
        shared = np.bitwise_and.reduceat(mask, first) & ~(every ^ some)
        levels.append((first, count, shared, every & shared))
        if len(first) == len(start):                    # one root per node
            return levels[::-1]
        at, mask, value = at[first], shared, every & shared


def ones(bits: np.ndarray) -> np.ndarray:
    return _ONES[np.ascontiguousarray(bits, np.uint32).view(np.uint8).reshape(-1, 4)].sum(1)


def close_pairs(node: np.ndarray, rest: np.ndarray, radius: int, budget: int = 1 << 20, visits: list | None = None):
    """Index pairs (i < j) of one node whose ``rest`` differ in at most
    ``radius`` bits, in chunks; rows are sorted by node and Gray rank.  A pair
    of upper nodes differs at least in the bits that both have factored out,
    and a level adds only the bits its parents had not.  ``visits`` collects
    the numbers of pairs that were looked at."""
    if not len(node):
        return
    levels = upper_nodes(node, rest)
    levels.append((None, None, np.full(len(rest), ALL_BITS), rest))
    roots = np.flatnonzero((levels[0][1] > 1) | (len(levels) > 2))
    todo = [(0, roots, roots, np.zeros(len(roots), np.int64), levels[0][2][roots])]
    while todo:
        level, a, b, acc, known = todo.pop()
        first, count = levels[level][:2]
        if first is None:
            if len(a):
                yield a, b
            continue
        size = count[a] * count[b]
        if len(a) > 1 and size.sum() > budget:          # halve the frontier: memory stays bounded
            half = len(a) // 2
            todo += [(level, *(x[:half] for x in (a, b, acc, known))), (level, *(x[half:] for x in (a, b, acc, known)))]
            continue
        which = np.repeat(np.arange(len(a)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        width = count[b][which]
        ca, cb = first[a][which] + place // width, first[b][which] + place % width
        lower = ca < cb if level == len(levels) - 2 else ca <= cb
        which, ca, cb = which[lower], ca[lower], cb[lower]
        if visits is not None:
            visits.append(len(ca))
        _, _, mask, value = levels[level + 1]
        both = mask[ca] & mask[cb]
        total = acc[which] + ones((value[ca] ^ value[cb]) & both & ~known[which])
        keep = total <= radius
        todo.append((level + 1, ca[keep], cb[keep], total[keep], both[keep]))


def spanning(n: int, pairs) -> np.ndarray:
    """Smallest index reachable from every index over chunks of pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            np.minimum.at(label, a, b)
            np.minimum.at(label, b, a)
            while (label[label] != label).any():
                label = label[label]
    return label


def _search(keys: list[str], radius: int):
    """Arrow task: rows sorted by keys and Gray rank in, spanning links out."""

    def run(batches):
        import pyarrow as pa

        def links(part):
            key = np.stack([part.column(k).to_numpy() for k in keys])
            node = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
            rest, rep = part.column("rest").to_numpy(), part.column("rep").to_numpy()
            label = spanning(len(rest), close_pairs(node, rest, radius))
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], names=["a", "b"])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 4 * NODE_LIMIT:
                all_rows = pa.Table.from_batches(held).combine_chunks()
                key = np.stack([all_rows.column(k).to_numpy() for k in keys])
                last = np.flatnonzero((key != key[:, -1:]).any(0))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last node may go on in the next batch
                if cut:
                    yield links(all_rows.slice(0, cut))
                held, rows = all_rows.slice(cut).to_batches(), all_rows.num_rows - cut
        if rows:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return run


def _node_links(filed: DataFrame, keys: list[str], id_type: str, radius: int) -> DataFrame:
    n = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (filed.select(*keys, "rest", "rep").repartition(n, *keys)
            .sortWithinPartitions(*keys, gray_rank(F.col("rest"), 32))
            .mapInArrow(tidy(_search(keys, radius)), f"a {id_type}, b {id_type}"))


def links(distinct: DataFrame, radius: int = RADIUS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b) between the representatives of (fp, rep) rows that give
    the same components as all pairs within ``radius`` bits."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree only up to two differing bits")
    id_type = distinct.schema["rep"].dataType.simpleString()
    filed = distinct.select("rep", F.inline(_masked(F.col("fp"), 16)))
    sizes = filed.groupBy("mask", "shared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # Nodes of one fingerprint have nothing to link.
    filed = checkpointed(filed.join(sizes, ["mask", "shared"]))
    small = _node_links(filed.where(F.col("n") <= node_limit), ["mask", "shared"], id_type, radius)
    cut = filed.where(F.col("n") > node_limit) \
        .select("rep", F.col("mask").alias("m1"), F.col("shared").alias("s1"), F.inline(_masked(F.col("rest"), 8)))
    large = _node_links(cut, ["m1", "s1", "mask", "shared"], id_type, radius)
    return small.unionByName(large).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               radius: int = RADIUS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = marked.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # A doc_id on rows of several texts joins their fingerprints.
    several = marked.where(F.col("doc_id").isNotNull()).groupBy("doc_id") \
        .agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
    same_id = marked.join(several, "doc_id").join(distinct, "fp") \
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links(distinct, radius, node_limit).unionByName(same_id))
    by_fp = distinct.join(found, distinct["rep"] == found["node"], "left") \
        .select("fp", F.coalesce("component", "rep").alias("component"))
    return marked.join(by_fp, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and
    those with a null id."""
    found = components(docs, id_col, text_col, shingle, radius)
    copies = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(copies, id_col, "left_anti").select(*docs.columns)


def op3_simhash_dedup(spark, sf_dir) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
