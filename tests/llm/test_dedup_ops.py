"""SimHash, components, suffix and decontamination operators against brute force."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from llm_cases import awkward, empty  # noqa: F401
from pyspark.sql import functions as F

from visitcast.llm import components as cc
from visitcast.llm import decontaminate, oracles, simhash_dedup, suffix_dedup


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3), (2, 1), (1, 2)]
    got = {r["node"]: r["component"] for r in cc.connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == plain_components(real, {x for e in real for x in e})
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_rows(awkward, empty):
    got = simhash_dedup.components(awkward).collect()
    rows = awkward.select("doc_id", "text").collect()
    fps = collections.Counter((r["doc_id"], f"{plain_fingerprint(r['text']):016x}") for r in rows)
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in got) == fps
    known = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows if r["doc_id"] is not None]
    links = [(a, b) for a, x in known for b, y in known if (x ^ y).bit_count() <= 2]
    want = plain_components(links, {a for a, _ in known})
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert simhash_dedup.components(empty).count() == 0
    kept = simhash_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(a for a, _ in known if want[a] == a) and ids.count(None) == 2


@pytest.mark.parametrize("radius, limit", [(0, 5), (1, 20_000), (2, 20_000), (2, 5)])
def test_simhash_links_keep_all_components(spark, radius, limit):
    rng = random.Random(radius * 7 + limit)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, 2 ** 64 - 1]
    fps = set(centres)
    for c in centres:                                   # balls and chains, with flips in all blocks
        x = c
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            fps |= {x, c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    found = simhash_dedup.links(spark.createDataFrame(signed, "fp long, rep long"), radius, limit).collect()
    want = plain_components([(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps)
                             if i < j and (a ^ b).bit_count() <= radius], range(len(fps)))
    assert plain_components([(r["a"], r["b"]) for r in found], range(len(fps))) == want
    assert len(found) <= 6 * 7 * len(fps)


def gray(value):
    for shift in (1, 2, 4, 8, 16):
        value = value ^ (value >> shift)
    return value


@pytest.mark.parametrize("sizes", [(), (1,), (2,), (7, 1, 8, 9), (300, 1, 65, 2)])
def test_simhash_upper_nodes_lose_no_pair(sizes):
    rng = np.random.default_rng(len(sizes))
    node = np.repeat(np.arange(len(sizes)), sizes)
    rest = rng.integers(0, 1 << 32, len(node)) & 0x8101_F00F
    order = np.lexsort((gray(rest), node))
    node, rest = node[order], rest[order]
    for radius in (0, 1, 2):
        got = [(int(i), int(j)) for a, b in simhash_dedup.close_pairs(node, rest, radius, budget=64) for i, j in zip(a, b)]
        want = {(i, j) for i in range(len(node)) for j in range(i + 1, len(node))
                if node[i] == node[j] and int(rest[i] ^ rest[j]).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_simhash_gray_order_prunes_more_than_plain_order():
    rng = np.random.default_rng(5)
    rest = np.unique(rng.integers(0, 1 << 32, 6000))
    visited, found = [], []
    for values in (rest[np.argsort(gray(rest), kind="stable")], rest, rng.permutation(rest)):
        seen = []
        found.append(sum(len(a) for a, _ in simhash_dedup.close_pairs(np.zeros(len(rest), np.int64), values, 2, visits=seen)))
        visited.append(sum(seen))
    assert found[0] == found[1] == found[2]
    assert visited[0] < visited[1] < visited[2] and 5 * visited[0] < visited[2]


def test_simhash_refuses_a_wider_radius(spark):
    with pytest.raises(ValueError):
        simhash_dedup.links(spark.createDataFrame([(1, 1)], "fp long, rep long"), 3)


def plain_cut(rows, size):
    """Rows of (doc_id, bytes) -> lost flags, rows of one id being one document."""
    seen = {}
    for i, data in rows:
        for k in range(len(data) - size + 1):
            s = data[k:k + size]
            seen[s] = min(seen.get(s, i), i)
    lost_at = collections.defaultdict(set)
    for i, data in rows:
        lost_at[i] |= {k for k in range(len(data) - size + 1) if seen[data[k:k + size]] < i}
    out = []
    for i, data in rows:
        lost = np.zeros(len(data), bool)
        for k in lost_at[i]:
            lost[k:k + size] = True
        out.append((i, len(data), int(lost.sum()), int((np.diff(lost, prepend=False) & lost).sum()),
                    hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~lost])).hexdigest()))
    return sorted(out)


def digest_rows(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def near_copies(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["alpha", "be", "gamma", "délta", "日本", "e"]) for _ in range(120)) for _ in range(4)]
    passage = "a passage that very many of the documents have somewhere in the middle of them, word for word"
    out = []
    for i in range(n):
        text = rng.choice(base)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(["", "#", "new"]) + text[k + rng.randrange(3):]
        if rng.random() < 0.5:
            k = rng.randrange(len(text))
            text = text[:k] + passage + text[k:]
        out.append((i * 3 % 101, text))
    return out + [(500, "aaaa" * 100), (501, "aaaa" * 90 + "b"), (502, base[0]), (503, base[0]), (504, base[0][:49]),
                  (505, base[0][:50]), (506, None), (507, "")]


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1}, {"threshold": 23, "steps": (9,)}, {"steps": ()}])
@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_digests(spark, options, parts):
    rows = near_copies(len(options) + parts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want = plain_cut([(i, (t or "").encode()) for i, t in rows], options.get("threshold", 50))
    assert digest_rows(suffix_dedup.digests(docs, **options)) == want


def test_suffix_awkward_rows(awkward, empty):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in awkward.select("doc_id", "text").collect()]
    known = awkward.where("doc_id is not null")
    assert digest_rows(suffix_dedup.digests(known)) == plain_cut([r for r in rows if r[0] is not None], 50)
    nulls = [r for r in suffix_dedup.digests(awkward).collect() if r["doc_id"] is None]
    assert len(nulls) == 2 and all(r["n_removed"] == 0 for r in nulls)
    assert suffix_dedup.digests(empty).count() == 0
    cut = suffix_dedup.deduplicate(awkward)
    assert cut.columns == awkward.columns and cut.count() == awkward.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[0] is None and texts[13] == "" and texts[12].startswith("word0 x0.")
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_suffix_parts_do_not_matter(spark, monkeypatch):
    rows = near_copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    data = [(t or "").encode() for _, t in rows]
    blocks = suffix_dedup.block_runs(np.frombuffer(b"".join(data), np.uint8),
                                     np.concatenate([[0], np.cumsum([len(d) for d in data])]), 50, 20)
    assert len(blocks[0]) and (blocks[1] <= blocks[2]).all()
    assert digest_rows(suffix_dedup.digests(docs)) == plain_cut([(i, (t or "").encode()) for i, t in rows], 50)


def passages(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(400)}" for _ in range(words)) for _ in range(n)]


def plain_contaminated(docs, items, similarity=0.8):
    import re

    def norm(t):
        return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub(decontaminate.PUNCTUATION, "", (t or "").lower())) if w]

    def bag(w, k):
        return collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))

    out = {}
    for d, t in docs:
        w = norm(t)
        for i, it in items:
            iw = norm(it)
            if not iw or not w or d is None or i is None:
                continue
            k, n = min(5, len(iw)), len(iw)
            want = bag(iw, k)
            for s in range(max(1, len(w) - n + 1)):
                got = bag(w[s:s + n], k)
                score = sum((got & want).values()) / max(1, sum((got | want).values()))
                if score >= similarity:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def test_decontamination_matches_brute_force(spark, empty):
    items = list(enumerate(passages(1, 6, 40))) + [(6, "Two, words!"), (7, None), (8, "..."), (9, "same same same same same same"),
                                                   (None, "null item of a few words"), (0, passages(1, 1, 40)[0])]
    fill = passages(2, 12, 60)
    rng = random.Random(4)
    docs = []
    for d in range(40):
        w = fill[d % 12].split()
        it = items[d % 6][1].split()
        if d % 3 == 1:
            it[rng.randrange(len(it))] = "edited"       # one word: still similar
        if d % 3 == 2:
            it = it[:20]                                # half of it: not similar
        k = rng.randrange(len(w))
        docs.append((d, " ".join(w[:k] + [x.upper() + "," for x in it] + w[k:])))
    docs += [(100, None), (101, ""), (102, items[2][1]), (102, items[3][1]), (103, "two words"), (104, "same same same same same same same"),
             (None, items[2][1]), (105, " ".join(items[1][1].split()[:38]))]
    df = spark.createDataFrame([(*r, "x", "x") for r in docs], "doc_id long, text string, item_id string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench).collect()}
    want = plain_contaminated(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontaminate.remove(df, bench)
    assert kept.columns == df.columns
    bad = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert decontaminate.contaminated(df, bench.where("item_id > 99")).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_decontamination_finds_reordered_passages(spark):
    items = list(enumerate(passages(21, 4, 100))) + [(4, passages(22, 1, 12)[0])]
    fill = passages(23, 6, 150)
    docs = []
    for d in range(18):
        w = items[d % 5][1].split()
        cut = (len(w) // 2, len(w) // 3, len(w))[d % 3]
        docs.append((d, " ".join([fill[d % 6], *w[cut:], *w[:cut], fill[(d + 1) % 6]])))
    docs += [(50, " ".join([*items[1][1].split()[50:], *items[1][1].split()[:50]])), (51, items[2][1] + " tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    want = plain_contaminated(docs, items)
    assert (0, 0) in want and (50, 1) in want
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # The SQL finds them too, with the same best window.
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    sql = con.execute(oracles.DECONTAMINATE).fetchall()
    assert {(d, i): (round(s, 9), w) for d, i, s, w in sql} \
        == {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["first_word"]) for r in rows}


def test_plans_hold_neither_the_filter_nor_every_near_value(spark):
    """They are copied and described many times in the driver's memory."""
    shingles = spark.createDataFrame([(h * 0x9E3779B97F4A7C15 % (1 << 63),) for h in range(2000)], "hash long")
    texts = spark.createDataFrame([(1, ["a"], [17])], "doc_id long, ws array<string>, hs array<long>")
    bit_filter = decontaminate._bit_filter(shingles, decontaminate.FILTER_BITS, decontaminate.PROBES)
    own = texts.unionByName(shingles.select(F.lit(2).cast("long").alias("doc_id"), F.array(F.lit("b")).alias("ws"), F.array("hash").alias("hs")))
    touched = decontaminate._touched(own, bit_filter, decontaminate.FILTER_BITS, decontaminate.PROBES)
    assert touched.where("doc_id = 2").count() == 2000
    assert len(touched._jdf.queryExecution().toString()) < 60_000
    near = shingles.select(F.inline(decontaminate.filed(F.col("hash"), 20, 7, near=True)))
    assert len(near._jdf.queryExecution().optimizedPlan().toString()) < 10_000



def test_multi_index_finds_all_within_the_radius(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(8)]
    other = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(26))) for b in base for _ in range(12)]
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    a = spark.createDataFrame([(i, sign(f)) for i, f in enumerate(base)], "i long, f long")
    b = spark.createDataFrame([(j, sign(g)) for j, g in enumerate(other)], "j long, g long")
    found = a.select("i", F.inline(decontaminate.filed(F.col("f"), 20, 7, near=True))) \
        .join(b.select("j", F.inline(decontaminate.filed(F.col("g"), 20, 7, near=False))), ["block", "value"])
    pairs = {(r["i"], r["j"]) for r in found.select("i", "j").distinct().collect()}
    assert {(i, j) for i, f in enumerate(base) for j, g in enumerate(other) if (f ^ g).bit_count() <= 20} <= pairs


def test_simhash_expression(spark):
    rows = [[random.Random(i).getrandbits(64) - (1 << 63) for _ in range(n)] for i, n in enumerate((1, 2, 5, 36))]
    got = [r["f"] for r in spark.createDataFrame([(r,) for r in rows], "h array<long>")
           .select(decontaminate.simhash(F.col("h")).alias("f")).collect()]
    for hashes, f in zip(rows, got):
        want = sum(1 << k for k in range(64) if 2 * sum((h >> k) & 1 for h in hashes) > len(hashes))
        assert f % (1 << 64) == want


def test_decontamination_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = decontaminate.contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
