import random
import zlib

import numpy as np
from helpers import ODD, documents

from kgweave.llm import quality_cnn, toxicity


def corpus(n, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, toxic, poor = [], [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        bad, low = rng.random() < 0.25, rng.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilezz", "grossqq"]))
        if low:
            words = [w + "%%%" for w in words]
        rows.append((i + 1000, " ".join(words)))
        toxic.append((i + 1000, int(bad)))
        poor.append((i + 1000, int(not low)))
    return rows, toxic, poor


def fold(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def held_out_accuracy(got, labels):
    rows = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    return sum(p == y for p, y in rows) / len(rows)


def check(spark, run, rows, labels):
    d = documents(spark, rows + ODD)
    got = run(spark, d, labels).collect()
    assert len(got) == len(rows) + len(ODD)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == fold(r.doc_id) for r in got if r.doc_id is not None)
    empty = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(empty) == 1
    assert run(spark, d.limit(0), labels).count() == 0
    return got


def test_toxicity(spark):
    rows, toxic, _ = corpus(500)
    labels = spark.createDataFrame([*toxic, (1000, None), (None, 1)], "doc_id long, toxic int")
    got = check(spark, toxicity.toxicity, rows, labels)
    assert held_out_accuracy(got, dict(toxic)) > 0.95
    # Held-out labels are never looked at.
    flipped = spark.createDataFrame([(d, 1 - y if fold(d) else y) for d, y in toxic], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity(spark, documents(spark, rows), flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in got if r.doc_id in again)
    kept = toxicity.drop_toxic(spark, documents(spark, rows), labels)
    assert kept.columns == documents(spark, rows).columns
    assert kept.count() == sum(r.predicted == 0 for r in got if r.doc_id is not None and r.doc_id >= 1000)


def test_probabilities_are_those_of_plain_counts():
    """Both models sum to 1 after every word, and equal the definition, taken from the counts anew."""
    rng = random.Random(2)
    vocab = ["vile", "gross", "good", "fine", "thing", "thinly", "a", "b"]
    texts = tuple([[rng.choice(vocab[i : i + 6]).encode() for _ in range(rng.randint(1, 12))] for _ in range(30)] for i in (0, 2))
    m = toxicity.Model(texts)
    size = m.n_words + len(m.stems) + 1
    stems = sorted({w.encode()[: toxicity.STEM] for w in vocab if any(w.encode() in d for docs in texts for d in docs)})
    assert list(m.stems) == stems
    for c in (0, 1):
        bigrams, firsts = {}, {}
        seen = set()
        for d in texts[c]:
            ids = m.ids(d)
            for i in range(len(ids) - 1):
                seen.add((int(ids[max(i - 1, 0)]), int(ids[i]), int(ids[i + 1])))
        for _, u, w in seen:
            bigrams[u, w] = bigrams.get((u, w), 0) + 1
            firsts[u] = firsts.get(u, 0) + 1
        for u in range(size):
            total = 0.0
            for w in range(size):
                at = int(np.searchsorted(m.keys, u << 21 | w))
                held = at < len(m.keys) and m.keys[at] == u << 21 | w
                above = m.above[c][at] if held else 0.0
                n = bigrams.get((u, w), 0)
                want = max(n - toxicity.DISCOUNTS[2] * n**0.5, 0) / firsts[u] if held and n else 0.0
                assert abs(above - want) < 1e-12
                total += above + m.backoff[c][u] * m.single[c][w]
            assert abs(total - 1) < 1e-9


def test_short_and_wholly_toxic_texts(spark):
    rows, toxic, _ = corpus(500)
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    more = [(1, "vilezz grossqq vilezz"), (2, "vilezz"), (3, "grossqq vilezz " * 40), (4, rows[0][1].replace("vilezz", "").replace("grossqq", "")), (5, "")]
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(spark, documents(spark, rows + more), labels).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 0, 0]


def test_gradients_of_the_network():
    net = quality_cnn.Network(np.random.default_rng(3))
    raw, rng = quality_cnn._bytes("abc some text, not too long. " * 9), np.random.default_rng(4)

    def loss():
        z = net.logit(raw)
        return 0.7 * (np.log1p(np.exp(z)) - 1.0 * z)

    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.gradients(raw, 1.0, 0.7, g)
    for k, v in net.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if k == "embed":
                at = (ord("abc some"[rng.integers(0, 8)]), at[1])
            old = v[at]
            v[at] = old + 1e-3
            up = loss()
            v[at] = old - 1e-3
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_no_labels_give_the_prior(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    d = documents(spark, ODD)
    assert {r.score for r in toxicity.toxicity(spark, d, none).collect()} == {0.5}
    assert {r.score for r in quality_cnn.quality(spark, d, none).collect()} == {0.5}


def test_quality(spark):
    rows, _, poor = corpus(300)
    labels = spark.createDataFrame(poor, "doc_id long, quality int")
    got = check(spark, quality_cnn.quality, rows, labels)
    assert held_out_accuracy(got, dict(poor)) > 0.95
    again = quality_cnn.quality(spark, documents(spark, rows), labels).collect()
    scores = {r.doc_id: r.score for r in got}
    assert all(scores[r.doc_id] == r.score for r in again)


def test_pooling_is_the_same_in_blocks(monkeypatch):
    net = quality_cnn.Network(np.random.default_rng(0))
    raw = quality_cnn._bytes("some longer text " * 200)
    whole = net.pooled(raw)[0]
    monkeypatch.setattr(quality_cnn, "BLOCK", quality_cnn.CHUNK * 2)
    assert np.allclose(whole, net.pooled(raw)[0], atol=1e-5)


def test_models_count_every_text(spark):
    """Ratios of the model that is fitted on executors, against plain counts of all texts of both classes."""
    rows, toxic, _ = corpus(400)
    label = dict(toxic)
    docs = [[toxicity.words(t) for d, t in rows if label[d] == c and not fold(d)] for c in (0, 1)]
    seen = [{(w[max(i - 1, 0)], w[i], w[i + 1]) for d in some for w in [[b"", *d]] for i in range(len(d))} for some in docs]
    n = [{}, {}]
    for c in (0, 1):
        for _, u, w in seen[c]:
            n[c][u, w] = n[c].get((u, w), 0) + 1
    stem = lambda w: w[: toxicity.STEM]
    every, scale = set(n[0]) | set(n[1]), [min(map(len, seen)) / len(s) for s in seen]
    vocab = sorted({w for _, w in every})
    stems = sorted(set(map(stem, vocab)))
    less = lambda x, d: max(x - d * x**0.5, 0)
    by_stem = {s: sum(stem(w) == s for _, w in every) for s in stems}
    logs = []
    for c in (0, 1):
        ctx = dict.fromkeys(vocab, 0)
        for _, w in n[c]:
            ctx[w] += 1
        size = len(n[c]) * scale[c]
        s_kept = {s: less(sum(ctx[w] for w in vocab if stem(w) == s) * scale[c], toxicity.DISCOUNTS[0]) / size for s in stems}
        w_kept = {w: less(ctx[w] * scale[c], toxicity.DISCOUNTS[1]) / size for w in vocab}
        s_mass, w_mass, whole = 1 - sum(s_kept.values()), 1 - sum(w_kept.values()), sum(by_stem.values()) + len(stems) + 1
        shared = {w: sum(x == w for _, x in every) for w in vocab}
        single = {}
        for w in vocab:
            s = stem(w)
            within = (shared[w] + 1) / (by_stem[s] + 1 + sum(stem(x) == s for x in vocab))
            single[w] = w_kept[w] + w_mass * (s_kept[s] + s_mass * (by_stem[s] + 1) / whole) * within
        firsts: dict = {}
        for (u, _), k in n[c].items():
            firsts[u] = firsts.get(u, 0) + k
        above = {p: less(k * scale[c], toxicity.DISCOUNTS[2]) / (firsts[p[0]] * scale[c]) for p, k in n[c].items()}
        left = dict.fromkeys(firsts, 1.0)
        for (u, _), p in above.items():
            left[u] -= p
        logs.append(lambda u, w, above=above, left=left, single=single: np.log(above.get((u, w), 0) + left.get(u, 1.0) * single[w]))
    scorer = toxicity.fit(spark, documents(spark, rows), spark.createDataFrame(toxic, "doc_id long, toxic int"))
    for d in docs[0][:20] + docs[1][:20]:
        want = np.mean([logs[1](u, w) - logs[0](u, w) for u, w in zip([b"", *d], d, strict=False)])
        assert abs(scorer.model.ratios(d)[0] - want) < 1e-9
