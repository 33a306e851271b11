"""Collocations, filter audit and shards against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, empty, texts  # noqa: F401

from visitcast.llm import collocations, filter_audit, sharding
from visitcast.llm.common import show_workers_the_package


# ------------------------------------------------------------- collocations --

def plain_collocations(rows, least=30, words=4, top=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, words + 1):
                f[lang].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in found.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "日本", "New", "York"]
    rows = []
    for i in range(300):
        ws = rnd.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rnd.randrange(0, 60))
        for _ in range(rnd.randrange(3)):
            ws.insert(rnd.randrange(len(ws) + 1), rnd.choice(["New York City hall", "in spite of", "of the\tday", "End. of"]))
        rows.append((rnd.choice(["en", "en", "de", None]), rnd.choice([" ", "  ", "\t"]).join(ws) + rnd.choice(["", ".", "!?\n"])))
    return rows + [("en", None), ("en", ""), (None, " \t "), ("xx", "once"), ("en", "New York City hall " * 40)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("ranges", [1, 7])
def test_collocations_against_plain_python(spark, monkeypatch, ranges):
    show_workers_the_package(spark)
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    size = sum(len((t or "").encode()) for _, t in rows)
    found = collocations.collocations(docs, min_count=12, top=25, range_bytes=-(-size // ranges))
    assert rows_of(found) == plain_collocations(rows, least=12, top=25)


def test_collocations_with_a_filter_that_lets_everything_through(spark):
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert rows_of(collocations.collocations(docs, min_count=10, filter_bits=8)) == plain_collocations(rows, least=10)


def test_second_pass_sends_a_row_per_language_and_deal(monkeypatch):
    """However many blocks and phrases a task has; the counts are whole."""
    import pyarrow as pa

    rng, ranges, bits = random.Random(5), 4, 64
    rows = [(lang, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60))) for _ in range(40) for lang in ("x", "y")]
    batch = pa.RecordBatch.from_pydict({"lang": [lang for lang, _ in rows], "salt": pa.array([1 if lang == "x" else 2 for lang, _ in rows], pa.int64()),
                                        "text": [text for _, text in rows]})

    class Everything:
        value = np.full(ranges * bits >> 3, 255, np.uint8)

    monkeypatch.setattr(collocations, "COUNT_BLOCK", 200)
    sent = pa.Table.from_batches(list(collocations._counter(Everything, ranges, bits, 4)([batch] * 3)))
    assert len(sent) <= 2 * ranges
    added = pa.Table.from_batches(list(collocations._adder(1)(sent.sort_by([("deal", "ascending"), ("lang", "ascending")]).to_batches()))).to_pylist()
    plain = Counter((lang, len(run), " ".join(run)) for lang, text in rows for words in (text.split(),) for n in range(1, 5)
                    for run in (words[i:i + n] for i in range(len(words) - n + 1)))
    plain.update((lang, 0, "") for lang, text in rows for _ in text.split())
    assert {(r["lang"], r["words"], r["phrase"]): r["n"] for r in added} == {key: 3 * n for key, n in plain.items()}
    assert len(added) == len(plain)


def test_collocations_awkward(spark, awkward, empty, texts):  # noqa: F811
    rows = [("clash", t) for t in texts] + [("clash", "null id text of some words"), ("clash", None), ("clash", "one")]
    assert rows_of(collocations.collocations(awkward)) == plain_collocations(rows)
    assert rows_of(collocations.collocations(empty)) == []
    nothing = spark.createDataFrame([(None, None), ("a", "")], "lang string, text string")
    assert rows_of(collocations.collocations(nothing)) == []


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=8), st.integers(2, 9))
def test_summary_keeps_every_frequent_key(parts, least):
    total = Counter(x for p in parts for x in p)
    mass = sum(total.values())
    summary = collocations.Summary(mass // least + 1)
    for p in parts:
        summary.merge(*collocations.summed(np.array(p, np.uint64)))
    keys, counts = summary.counters()
    assert len(keys) <= summary.capacity and summary.lost < least
    kept = dict(zip(keys.tolist(), counts.tolist()))
    for key, n in total.items():
        assert kept.get(key, 0) <= n <= kept.get(key, 0) + summary.lost
        assert n < least or key in kept


# ------------------------------------------------------------- filter audit --

def plain_audit(docs, labels):
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    facts = []
    for i, t, lang in docs:
        t = t or ""
        ws = re.findall("[^ \t\n\x0b\x0c\r]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        facts.append((lang or "", {x for x, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out, removed_at = [], Counter()
    for part in {f[0] for f in facts}:
        mine = [f[1:] for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[0]]
                removed_at[part, x] += len(gone)
                out.append((part, "".join(order), step, len(left) - len(gone), len(gone),
                            sum(x in f[0] for f in mine) - len(gone), sum(f[0] == {x} for f in mine),
                            sum(f[1] for f in gone), sum(f[2] for f in gone), x))
                left = [f for f in left if x not in f[0]]
    return sorted((*r[:9], removed_at[r[0], r[9]]) for r in out)


def audited(docs, labels):
    found = filter_audit.audit(docs, labels)
    return sorted(tuple(r) for r in found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                                 "good_lost", "toxic_lost", "shapley").collect())


def test_audit_against_plain_python(spark):
    rnd = random.Random(3)
    long = [" ".join(f"w{rnd.randrange(k)}" for _ in range(n)) for k in (40, 5000) for n in (199, 200, 450)]
    pieces = [None, "", " \n", "SHOUT now", "a#b", "a b c", *long, *[t + " | x" for t in long], *[t.upper() for t in long]]
    docs = [(i, rnd.choice(pieces), rnd.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(None, long[0], "en"), (None, long[0], "en"), (7, long[1], "en"), (7, long[1], "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in rnd.sample(range(170), 90)]
    labels += [(7, 0, 1), (7, 1, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, failed string").repartition(4)
    assert audited(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == plain_audit(docs, labels)


def test_audit_with_a_heavy_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HEAVY", 4)          # a third of the rows is one text, found by the broadcast
    docs = [(i, "the same text" if i % 3 == 0 else f"text {i // 2}", "en") for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert audited(frame, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")) == plain_audit(docs, [(0, 1, 1)])


def test_audit_awkward(spark, awkward, empty, texts):  # noqa: F811
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id text of some words", "clash"), (None, None, "clash"), (3, "one", "clash")]
    assert audited(awkward, no_labels) == plain_audit(docs, [])
    assert audited(empty, no_labels) == []


# -------------------------------------------------------------------- shards --

def plain_jump(key, shards):
    key, b, j = key % 2 ** 64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_against_plain_python(spark):
    rnd = random.Random(2)
    keys = [*range(200), -1, 2 ** 63 - 1, -2 ** 63, *[rnd.randrange(-2 ** 63, 2 ** 63) for _ in range(200)]]
    docs = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for shards in (1, 2, 24, 100):
        found = [tuple(r) for r in sharding.assign(docs, shards).collect()]
        assert found == [(k, plain_jump(k, shards), plain_jump(k, shards + 1)) for k in keys]
        assert all(grown in (shard, shards) for _, shard, grown in found)


def test_appending_a_shard_moves_its_share_only(spark):
    found = sharding.assign(spark.range(40_000).withColumnRenamed("id", "doc_id"), 24)
    counts = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert len(counts) == 24 and min(counts) > 0.85 * 40_000 / 24 and max(counts) < 1.15 * 40_000 / 24
    moved = found.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 24").count() == 0 and abs(moved.count() - 1600) < 200


def test_places_awkward(spark, awkward, empty, texts):  # noqa: F811
    import zlib

    rows = [tuple(r) for r in sharding.place(awkward).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard").collect()]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "null id text of some words"), (None, None), (3, "one")]
    expected = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), plain_jump(i or 0, 24), plain_jump(i or 0, 25)) for i, t in docs]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(*r[:4], r[5]) for r in rows], key=key) == sorted(expected, key=key)
    for shard in {r[3] for r in rows}:
        assert sorted(r[4] for r in rows if r[3] == shard) == list(range(sum(r[3] == shard for r in rows)))
    assert sharding.place(empty).count() == 0


def test_places_of_a_hot_key_and_other_keys(spark):
    hot = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS doc_id", "'t' AS text")
    rows = sharding.place(hot.repartition(6)).collect()
    for shard in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    names = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z"), (None, "n")], "name string, text string")
    found = {}
    for r in sharding.place(names, 5, "name").collect():
        assert found.setdefault(r["name"], r["shard"]) == r["shard"]


def test_write_shards(spark, tmp_path):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    sharding.write_shards(docs, str(tmp_path / "shards"), 6)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["text"], r["shard"]) for r in back.collect()) == \
        [(i, f"text {i}", plain_jump(i, 6)) for i in range(500)]
