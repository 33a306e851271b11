"""Benchmark decontamination: item-sized windows, SimHash, exact check.

Main path in DataFrame expressions only.

1. Words are lower-case runs between blanks with ASCII punctuation taken out;
   shingles are five words (an item of fewer words is one shingle).
2. A window has as many words as an item has.  A window whose similarity s
   reaches the bound holds at least s / (1 + s) of its and the item's shingles
   together as hits, in whatever order, so windows are laid at every start with
   that many hits on items of their size.  A bit filter of fixed size over the
   benchmark's shingles picks the texts and places to look at inside the row
   (it has no false negatives; a join makes it exact), so whole texts are
   neither exploded nor shuffled.
3. Window and item get 64-bit SimHashes.  A multi-index finds the items of the
   same size within ``radius`` bits: of ``blocks`` blocks at least one differs
   in at most radius // blocks bits, so windows are filed under their blocks
   and items under all block values that near.  No pair within the radius is
   missed.
4. Exact check: weighted Jaccard similarity of the shingle multisets (sum of
   the smaller over sum of the larger counts), as strings, >= ``similarity``.

At a similarity of 0.8 the SimHash distance is 9.7 bits on average with a
deviation of 2.9, so the radius of 20 leaves out about 2 in 10,000 pairs that
are just at the limit and practically none above.

Defined results: null or wordless texts and items match nothing; a document
shorter than an item is one window; rows that repeat a doc_id (or item_id) are
one document (item) whose rows are searched one by one; rows with null id are
not reported; other columns are ignored, whatever their names; empty tables
give an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 7
FILTER_BITS = 19
PROBES = 3
PUNCTUATION = r"""[!-/:-@\[-`{-~]+"""
BREAKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(clean, BREAKS), lambda w: w != "")


def _shingles(ws: Column, k: int, make) -> Column:
    """``make(words of a shingle)`` of every shingle of ``k`` words."""
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(0), F.size(ws) - k),
                                               lambda i: make(*(F.get(ws, i + j) for j in range(k)))))


def hashes(ws: Column, k: int) -> Column:
    return F.coalesce(_shingles(ws, k, F.xxhash64), F.array().cast("array<long>"))


def strings(ws: Column, k: int) -> Column:
    return F.coalesce(_shingles(ws, k, lambda *w: F.concat_ws(" ", *w)), F.array().cast("array<string>"))


def simhash(values: Column) -> Column:
    """Majority bit of every bit place over an array of 64-bit hashes."""
    def bit(b: Column) -> Column:
        votes = F.aggregate(values, F.lit(0), lambda acc, h: acc + F.getbit(h, b).cast("int"))
        return F.when(votes * 2 > F.size(values), F.call_function("shiftleft", F.lit(1).cast("long"), b)) \
            .otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def block_fields(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of every block."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def filed(fp: Column, radius: int, blocks: int, near: bool) -> Column:
    """Array of (block, value): own values, or all within the block's radius."""
    reach = radius // blocks if near else 0

    def flipped(k: int, value: Column):
        return lambda mask: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(mask).alias("value"))

    out = []
    for k, (low, width) in enumerate(block_fields(blocks)):
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        masks = [sum(1 << p for p in places) for flips in range(reach + 1) for places in combinations(range(width), flips)]
        # One expression a block, not one a value: plans are copied many times.
        out.append(F.transform(F.expr(f"array({', '.join(f'{m}L' for m in masks)})"), flipped(k, value)))
    return F.concat(*out)


def _probe_bits(h: Column, bits: int, probes: int) -> list[Column]:
    return [F.shiftrightunsigned(h, 64 - bits * (p + 1)).bitwiseAND(F.lit((1 << bits) - 1)) for p in range(probes)]


def _bit_filter(shingles: DataFrame, bits: int, probes: int) -> DataFrame:
    """One row: the array ``filter`` of 64-bit words with the probe bits of all
    shingles set (2^bits bits whatever the size of the benchmark).  A row, not a
    constant, which every copy of a plan and its text would hold."""
    places = shingles.select(F.explode(F.array(*_probe_bits(F.col("hash"), bits, probes))).alias("p"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    marks = places.select(F.shiftrightunsigned("p", 6).alias("w"),
                          F.call_function("shiftleft", one, F.col("p").bitwiseAND(F.lit(63)).cast("int")).alias("v"))
    marks = marks.unionByName(shingles.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("w"), zero.alias("v")))
    filter_words = F.sort_array(F.collect_list(F.struct("w", "v")))
    return marks.groupBy("w").agg(F.bit_or("v").alias("v")).agg(F.transform(filter_words, lambda x: x["v"]).alias("filter"))


def _hits(hs: Column, bit_filter: Column, bits: int, probes: int) -> Column:
    """(place, hash) of the elements that pass the bit filter."""
    def passes(i: Column) -> Column:
        out = F.lit(True)
        for p in _probe_bits(F.get(hs, i), bits, probes):
            word = F.get(bit_filter, F.shiftrightunsigned(p, 6).cast("int"))
            out = out & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out

    return F.when(F.size(hs) > 0, F.transform(F.filter(F.sequence(F.lit(0), F.size(hs) - 1), passes),
                                              lambda i: F.struct(i.alias("at"), F.get(hs, i).alias("hash"))))


def _touched(texts: DataFrame, bit_filter: DataFrame, bits: int, probes: int) -> DataFrame:
    """The texts with elements that pass the bit filter."""
    # ``copy`` tells rows of one id apart.  It also keeps the optimizer from
    # moving the condition below the arrays, where it would compute them again
    # for every element.
    return texts.crossJoin(F.broadcast(bit_filter)) \
        .withColumns({"hits": _hits(F.col("hs"), F.col("filter"), bits, probes), "copy": F.monotonically_increasing_id()}) \
        .where(F.size("hits") > 0).select("doc_id", "copy", "ws", "hits")


def _starts(k: int, similarity: float) -> Column:
    """First words of all windows of ``n`` words with so many hits (``at``,
    sorted) that the similarity can be reached, each once."""
    at, last = F.col("at"), F.greatest(F.lit(0), F.col("size") - F.col("n"))
    own = F.least("size", "n") - k + 1                 # shingles of the window
    least = F.ceil((own + F.col("n") - k + 1) * (similarity / (1 + similarity)) - 1e-9).cast("int")

    def of_first_hit(j: Column) -> Column:
        low = F.greatest(F.lit(0), F.get(at, j + least - 1) - own + 1, F.coalesce(F.get(at, j - 1) + 1, F.lit(0)))
        high = F.least(F.get(at, j), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(at) >= least, F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - least), of_first_hit)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY,
                 radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS,
                 probes: int = PROBES) -> DataFrame:
    """One row per document and item with a similar window: doc_id, item_id,
    similarity and first word of the best window, its SimHash distance, and
    the number of similar windows."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("ws"))
    items = items.where(F.size("ws") > 0).select("item_id", "ws", F.size("ws").alias("n"),
                                                 F.least(F.size("ws"), F.lit(shingle)).alias("k"))
    items = checkpointed(items.distinct().withColumn("copy", F.xxhash64("ws")))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle`` numbers
    found = None
    for k in lengths:
        part = _contaminated_by(docs, items.where(F.col("k") == k), k, id_col, text_col, similarity, radius, blocks,
                                filter_bits, probes)
        found = part if found is None else found.unionByName(part)
    if found is None:
        id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {id_type}, item_id {item_type}, similarity double, first_word int, distance int, n_windows long")
    best = F.struct("similarity", "placed", -F.col("first"), -F.col("distance"))
    return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n_windows")) \
        .select("doc_id", "item_id", F.col("best.similarity").alias("similarity"),
                (-F.col("best.col3")).alias("first_word"), (-F.col("best.col4")).alias("distance"), "n_windows")


def _contaminated_by(docs, items, k, id_col, text_col, similarity, radius, blocks, bits, probes) -> DataFrame:
    """Similar windows for the items whose shingles have ``k`` words."""
    items = checkpointed(items.withColumn("hs", hashes(F.col("ws"), k)).withColumn("fp", simhash(F.col("hs"))))
    places = items.select("n", F.posexplode("hs").alias("offset", "hash")).distinct()
    bit_filter = checkpointed(_bit_filter(places, bits, probes))

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"),
                                                         words(F.col(text_col)).alias("ws"))
    texts = texts.withColumn("hs", hashes(F.col("ws"), k))
    texts = checkpointed(_touched(texts, bit_filter, bits, probes))

    hits = texts.select("doc_id", "copy", F.size("ws").alias("size"), F.inline("hits"))
    marks = hits.join(places.select("n", "hash").distinct(), "hash").groupBy("doc_id", "copy", "size", "n") \
        .agg(F.sort_array(F.collect_list("at")).alias("at"))
    marks = checkpointed(marks.withColumn("starts", _starts(k, similarity)).where(F.size("starts") > 0).drop("at"))
    starts = marks.select("doc_id", "copy", "n", F.explode("starts").alias("first"), F.lit(0).alias("placed"))
    # Those that place a shared shingle as the item does go first among equals;
    # looked up only for the sizes a text has windows of.
    placed = hits.join(marks.select("doc_id", "copy", "n"), ["doc_id", "copy"]).join(places, ["n", "hash"]).select(
        "doc_id", "copy", "n",
        F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("size") - F.col("n"))).alias("first"),
        F.lit(1).alias("placed"))
    starts = starts.unionByName(placed).groupBy("doc_id", "copy", "n", "first") \
        .agg(F.max("placed").alias("placed"), F.min("placed").alias("reached")).where(F.col("reached") == 0)
    windows = texts.select("doc_id", "copy", "ws").join(
        starts.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("n", "first", "placed")).alias("laid")), ["doc_id", "copy"])
    windows = windows.select("doc_id", "copy", "ws", F.inline("laid")) \
        .withColumn("ws", F.slice("ws", F.col("first") + 1, F.col("n"))) \
        .withColumn("hs", hashes(F.col("ws"), k)) \
        .select("doc_id", "copy", "n", "first", "placed", "ws", simhash(F.col("hs")).alias("fp"))
    windows = checkpointed(windows)

    key = ["n", "block", "value"]
    index = items.select("item_id", F.col("copy").alias("item_copy"), F.col("fp").alias("item_fp"), "n",
                         F.inline(filed(F.col("fp"), radius, blocks, near=True)))
    near = windows.select("doc_id", "copy", "first", "fp", "n", F.inline(filed(F.col("fp"), radius, blocks, near=False))) \
        .join(index, key).select("doc_id", "copy", "first", "n", "item_id", "item_copy",
                                 F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")) \
        .where(F.col("distance") <= radius).distinct()

    # Exact check on the shingles as strings.
    bags = windows.select("doc_id", "copy", "first", "n", F.explode(strings(F.col("ws"), k)).alias("s")) \
        .groupBy("doc_id", "copy", "first", "n", "s").agg(F.count(F.lit(1)).alias("w"))
    item_bags = items.select("item_id", F.col("copy").alias("item_copy"), F.explode(strings(F.col("ws"), k)).alias("s")) \
        .groupBy("item_id", "item_copy", "s").agg(F.count(F.lit(1)).alias("v"))
    sizes = windows.select("doc_id", "copy", "first", "n", "placed", (F.size("ws") - k + 1).alias("n_window"))
    common = near.join(bags, ["doc_id", "copy", "first", "n"]).join(item_bags, ["item_id", "item_copy", "s"]) \
        .groupBy("doc_id", "copy", "first", "n", "item_id", "item_copy", "distance") \
        .agg(F.sum(F.least("w", "v")).alias("common"))
    score = F.col("common") / (F.col("n_window") + F.col("n") - k + 1 - F.col("common"))
    return common.join(sizes, ["doc_id", "copy", "first", "n"]).withColumn("similarity", score) \
        .where(F.col("similarity") >= similarity).select("doc_id", "item_id", "first", "placed", "distance", "similarity")


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a window similar to a benchmark item."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)


def op2_decontaminate(spark, sf_dir) -> DataFrame:
    """Pairs of ``documents`` and ``benchmark`` items; the distance and the
    window count stay in the operator's output."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "item_id", "similarity", "first_word")
