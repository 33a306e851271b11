"""Quality, toxicity and language-model operators: held-out accuracy,
identities against direct formulas, and awkward rows."""

import random
import zlib

import numpy as np
import pytest
from llm_cases import awkward, empty  # noqa: F401
from pyspark.sql import functions as F

from visitcast.llm import common, mlm_score, quality_fm, toxicity_cnn

SF = "/root/testdata/sf0.01"


def test_held_out_fold(spark):
    rows = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "i long").select("i", common.held_out(F.col("i")).alias("h"))
    for r in rows.collect():
        assert r["h"] == (r["i"] is not None and zlib.crc32(str(r["i"]).encode()) % 5 == 0)


def test_words_and_hashes():
    texts = ["One two", "", "x", "two\tOne é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    start, end, row = common.word_spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == "One two x two One é".split()
    assert row.tolist() == [0, 0, 2, 3, 3, 3]
    h = common.span_hashes(data, start, end)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = quality_fm.Machine(0.3, rng.normal(size=40), rng.normal(size=(40, 5)))
    row = np.array([0, 0, 0, 2, 2])
    feature, value = np.array([1, 7, 30, 2, 39]), rng.normal(size=5)
    got = model.logits(3, row, feature, value)
    for r in range(3):
        own = np.flatnonzero(row == r)
        want = 0.3 + sum(model.linear[feature[i]] * value[i] for i in own)
        want += sum(model.factors[feature[i]] @ model.factors[feature[j]] * value[i] * value[j]
                    for i in own for j in own if i < j)
        assert abs(got[r] - want) < 1e-9


@pytest.mark.parametrize("operator, label, least", [(quality_fm, "quality", 0.9), (toxicity_cnn, "toxic", 0.9)])
def test_classifiers(spark, awkward, empty, operator, label, least):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = operator.train(docs, labels)
    scored = operator.score(docs, model)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    out = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out[label]).mean() >= least
    assert out["score"].between(0, 1).all()
    # Nothing but the text counts, and the order of rows does not.
    other = operator.score(docs.withColumn("doc_id", -F.col("doc_id")).withColumn("source", F.lit("z")).repartition(5), model)
    both = scored.join(other.select((-F.col("doc_id")).alias("doc_id"), F.col("score").alias("again")), "doc_id")
    assert both.where("abs(score - again) > 1e-5").count() == 0
    rows = operator.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert operator.score(empty, model).count() == 0
    # Labels that teach nothing give the prior.
    one_class = labels.where(F.col(label) == 0)
    flat = operator.score(docs, operator.train(docs, one_class)).agg(F.min("score"), F.max("score")).first()
    assert flat[0] == flat[1] < 0.5
    none = operator.score(docs, operator.train(docs, labels.where("false"))).agg(F.min("score"), F.max("score")).first()
    assert abs(none[0] - 0.5) < 1e-6 and abs(none[1] - 0.5) < 1e-6


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    from visitcast.llm.labelled import learnable

    rows = [(i, 1) for i in range(100)] + [(None, 1), (1, 0), (2, None)]
    got = {r["doc_id"]: r["y"] for r in learnable(spark.createDataFrame(rows, "doc_id long, quality int"), "quality").collect()}
    assert got == {i: 1 for i in range(100) if zlib.crc32(str(i).encode()) % 5}


def test_toxicity_windows_by_hand():
    rng = np.random.default_rng(3)
    net = toxicity_cnn.Network(rng.normal(size=(toxicity_cnn.SIZE, toxicity_cnn.DIM)).astype(np.float32),
                               [rng.normal(size=(w, toxicity_cnn.DIM, toxicity_cnn.FILTERS)).astype(np.float32)
                                for w in toxicity_cnn.WIDTHS],
                               [rng.normal(size=toxicity_cnn.FILTERS).astype(np.float32) for _ in toxicity_cnn.WIDTHS],
                               rng.normal(size=len(toxicity_cnn.WIDTHS) * toxicity_cnn.FILTERS), 0.1)
    net.table[0] = 0
    data = np.frombuffer(b"some words and morex", np.uint8)  # three texts, the second one empty
    ids, row = toxicity_cnn.word_parts(data, np.array([0, 19, 19, 20]))
    got = net.logits(*toxicity_cnn.with_gaps(ids, row, 3))
    for r in range(3):
        x = net.table[ids[:, row == r]].sum(0)
        pooled = []
        for kernel, bias in zip(net.kernels, net.biases):
            z = [bias + sum(x[t + k] @ kernel[k] for k in range(len(kernel)) if t + k < len(x)) for t in range(len(x))]
            pooled.append(np.maximum(np.max(z, 0), 0) if z else np.zeros(toxicity_cnn.FILTERS))
        assert abs(got[r] - (0.1 + np.concatenate(pooled) @ net.head)) < 1e-3


def test_best_cut():
    s, y = np.array([0.1, 0.2, 0.7, 0.9]), np.array([0.0, 0, 1, 1])
    assert 0.2 < toxicity_cnn.best_cut(s, y, np.ones(4)) < 0.7
    assert toxicity_cnn.best_cut(s, np.zeros(4), np.ones(4)) > 0.9


def test_toxic_filter_agrees_with_the_scores(spark, awkward):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    net = toxicity_cnn.train(docs, labels)
    kept = toxicity_cnn.keep_clean(docs, net)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in toxicity_cnn.score(docs, net).where("not flagged").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert toxicity_cnn.keep_clean(awkward, net).columns == awkward.columns
    toxicity_cnn.keep_clean(awkward, net).count()


def direct_log_prob(vocab, net, words):
    gap = [0] * mlm_score.REACH
    ids = np.array(gap + vocab.encode(words).tolist() + gap)
    total = 0.0
    for t in range(len(words)):
        h = net.hidden(ids, np.array([t + mlm_score.REACH]))[0].astype(float)
        target = ids[t + mlm_score.REACH] - 1
        c = target // mlm_score.CLASS_SIZE
        a = net.classes.astype(float) @ h
        b = net.members[c * mlm_score.CLASS_SIZE:(c + 1) * mlm_score.CLASS_SIZE].astype(float) @ h
        total += a[c] - np.log(np.exp(a).sum()) + b[target % mlm_score.CLASS_SIZE] - np.log(np.exp(b).sum())
    return total


def test_language_model(spark, awkward, empty):
    rng = random.Random(1)
    # "a" is followed by b or c, "b" by x, "c" by y: both sides tell the middle.
    lines = [" ".join(rng.choice(["p a b x q", "p a c y q"]) for _ in range(40)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    vocab, start = mlm_score.train(docs.select("text"), rounds=0)
    vocab2, net = mlm_score.train(docs.select("text"), rounds=3)
    assert (vocab.words == vocab2.words).all() and vocab.counts.sum() == 120 * 40 * 5
    mean = [mlm_score.score(docs, vocab, m).agg(F.sum("log_prob") / F.sum("n_words")).first()[0] for m in (start, net)]
    assert mean[1] > mean[0] + 0.5
    order = spark.createDataFrame([(1, "p a b x q p a c y q"), (2, "x q b p y a c q a p")], "doc_id long, text string")
    scores = {r["doc_id"]: r["log_prob"] for r in mlm_score.score(order, vocab, net).collect()}
    assert scores[1] > scores[2]
    for i, t in ((1, "p a b x q p a c y q"), (2, "x q b p y a c q a p")):
        data = np.frombuffer(t.encode(), np.uint8)
        words, _ = mlm_score.block_words(data, np.array([0, len(data)]))
        assert abs(direct_log_prob(vocab, net, words) - scores[i]) < 1e-2
    rows = mlm_score.pseudo_likelihood(awkward, rounds=1).collect()
    assert len(rows) == awkward.count()
    blank = [r for r in rows if r["doc_id"] in (0, 1, 2)]
    assert all(r["n_words"] == 0 and r["log_prob"] == 0 and r["mean_log_prob"] is None for r in blank)
    same = [r["log_prob"] for r in rows if r["doc_id"] in (12, 13)]
    assert abs(same[0] - same[1]) < 1e-6 * abs(same[0])
    assert mlm_score.pseudo_likelihood(empty, rounds=1).count() == 0


def test_language_model_tells_rare_words_of_a_bucket_apart(spark):
    # More words than the network predicts by themselves: the last ones share buckets.
    common_words = [f"c{i}" for i in range(mlm_score.KNOWN)]
    rare = [f"r{i}" for i in range(3000)]
    lines = [" ".join(common_words)] * 12 + [" ".join(rare)] + [" ".join(rare[::2])] * 4
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    vocab, net = mlm_score.train(docs.select("text"), rounds=0)

    def hashed(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return mlm_score.block_words(data, np.array([0, len(data)]))[0]

    known = dict(zip(hashed(rare).tolist(), [5, 1] * 1500))
    bucket = {}
    for h, n in known.items():
        bucket.setdefault(h % mlm_score.BUCKETS, []).append(n)
    probes = ["c1 r0 c2", "c1 r1 c2", "c1 neverseen c2", "r0 r1 r1 neverseen", "c5 c6", ""]
    scored = mlm_score.score(spark.createDataFrame([*enumerate(probes), (None, "r0"), (0, probes[0])],
                                                   "doc_id long, text string"), vocab, net).collect()
    assert len(scored) == len(probes) + 2
    got = {r["doc_id"]: r["log_prob"] for r in scored}
    for i, t in enumerate(probes):
        want = direct_log_prob(vocab, net, hashed(t.split())) if t else 0.0
        for w, h in zip(t.split(), hashed(t.split()).tolist() if t else []):
            if not w.startswith("c"):
                own = bucket[h % mlm_score.BUCKETS]
                want += np.log((known.get(h, 0) + mlm_score.UNSEEN) / (sum(own) + mlm_score.UNSEEN * (len(own) + 1)))
        assert abs(got[i] - want) < 1e-2


def test_every_position_is_a_target_once(spark):
    texts = spark.createDataFrame([(f"some words {i % 90} of a text {i}",) for i in range(300)] + [(None,), ("",)], "text string")
    for rounds in (1, 2, 3):
        sizes = [texts.where(mlm_score.round_of(F.col("text"), rounds) == turn).count() for turn in range(rounds)]
        assert sum(sizes) == 302 and min(sizes) > 302 / rounds / 2
    hashes = np.array([11, 12, 13, 11, 15], np.uint64)
    words = mlm_score.Vocabulary(hashes[:0], np.zeros(0, np.int64), np.ones(mlm_score.SIZE), np.ones(mlm_score.BUCKETS))
    trainer = mlm_score.Trainer(mlm_score.Network.start(np.ones(mlm_score.SIZE)))
    gap = [0] * mlm_score.REACH
    ids = np.array([*gap, *words.encode(hashes), *gap])
    trainer.step(ids, np.arange(5) + mlm_score.REACH)
    assert (trainer.seen[1] == 5).all()                      # every class row hears of every position
    assert (trainer.seen[0].sum(1) == 5).all()               # and one row of every context place, the gap's included
    # A corpus of a single position is learnt from.
    for word in ("alone", "lonely", "single"):
        docs = spark.createDataFrame([(word,)], "text string")
        start, net = mlm_score.train(docs, rounds=0)[1], mlm_score.train(docs, rounds=2)[1]
        assert (start.members != net.members).any()


def test_masked_lm_does_not_depend_on_the_partitioning(spark, monkeypatch):
    from visitcast.llm.common import show_workers_the_package
    show_workers_the_package(spark)
    rnd = np.random.default_rng(8)
    after = {f"a{i}": f"b{i}" for i in range(40)}          # a word tells the next one
    docs = spark.createDataFrame([(i, " ".join(f"{a} {after[a]}" for a in rnd.choice(list(after), 60))) for i in range(400)],
                                 "doc_id long, text string").cache()

    def mean(vocab, net):
        return mlm_score.score(docs, vocab, net).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]

    texts = docs.select("text")
    vocab, start = mlm_score.train(texts, rounds=0)
    plain = mlm_score.Network.start(vocab.counts)
    plain.context[:] = 0
    plain.classes[:, :-1] = 0
    plain.members[:, :-1] = 0
    unigram = mean(vocab, plain)
    found = [mean(*mlm_score.train(texts.repartition(n))) for n in (1, 8, 64)]
    assert max(found) - min(found) < 0.05 and min(found) > unigram + 0.3 and mean(vocab, start) < min(found)
    monkeypatch.setattr(mlm_score, "UNIT_WORDS", 6000)     # eight copies that see different texts are averaged
    assert mean(*mlm_score.train(texts.repartition(64))) > unigram + 0.3


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """14,000 rows, more than one task trains and more than the sample there once was."""
    n = 14_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word', id % 50, ' text', id, if(id % 3 = 0, ' vile', ' kind')) AS text",
                                     "if(id % 2 = 0, 'en', null) AS lang")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS toxic")
    counted = {}
    start = toxicity_cnn.start_network

    def seen(used, size):
        counted.update(used=used, size=size)
        return start(used, size)

    calibrated = {}
    monkeypatch.setattr(toxicity_cnn, "start_network", seen)
    monkeypatch.setattr(toxicity_cnn, "calibrate", lambda net, rows, shrink: calibrated.update(n=rows.count()))
    net = toxicity_cnn.train(docs, labels)
    learnt = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    assert sum(counted["size"]) + calibrated["n"] == len(learnt)
    assert sum(counted["size"]) > 2 * toxicity_cnn.UNIT_TEXTS and counted["size"][1] > 2000
    ids, _ = toxicity_cnn.word_parts(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))
    assert counted["used"][1, ids[0, 0]] == counted["size"][1]
    out = toxicity_cnn.score(docs, net).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["toxic"]).mean() > 0.99


def test_toxicity_sends_table_rows_as_they_are():
    """A trained row travels once, in single precision; the other weights are exact."""
    rng = np.random.default_rng(5)
    used = np.full((2, toxicity_cnn.SIZE), 9.0)
    trainer = toxicity_cnn.Trainer(toxicity_cnn.start_network(used, (9, 9)))
    texts = [rng.integers(1, toxicity_cnn.SIZE, (toxicity_cnn.PARTS, 6)).astype(np.int32) for _ in range(8)]
    trainer.fit(texts, np.arange(8) % 2.0, 2)
    sent = toxicity_cnn.sent_rows(trainer)
    changed, dense = np.unique(np.concatenate([t.ravel() for t in texts])), toxicity_cnn.dense_of(trainer.net)
    assert sent.num_rows == len(changed) + len(dense)
    assert sent.nbytes < len(changed) * (4 * toxicity_cnn.DIM + 18) + len(dense) * (8 * toxicity_cnn.DIM + 18) + 64
    rows = sent.to_pylist()
    assert [r["row"] for r in rows[:len(changed)]] == changed.tolist()
    assert [r["seen"] for r in rows[:len(changed)]] == [sum((t == i).any() for t in texts) for i in changed]
    assert np.array_equal(np.array([r["w"] for r in rows[:len(changed)]], np.float32), trainer.net.table[changed])
    assert all(r["exact"] is None for r in rows[:len(changed)])
    assert np.array_equal([r["exact"] for r in rows[len(changed):]], dense) and all(r["w"] is None for r in rows[len(changed):])
