import zlib

import numpy as np

from ironlift.llm.classifier import Network, fit, held_out, index_vectors, pooled, word_slots
from ironlift.llm.queries import op10_quality_classifier


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op10_quality_classifier(spark, d).collect()}
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    held = [(rows[k].score, rows[k].predicted, q) for k, q in labels if rows[k].held_out]
    s, p, q = map(np.array, zip(*held))
    print("held out", len(s), "accuracy", (p == q).mean(), "auc", auc(s, q))
    assert (p == q).mean() > 0.97 and auc(s, q) > 0.98
    assert abs(s.mean() - q.mean()) < 0.03  # calibrated
    assert s.min() >= 0 and s.max() <= 1


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))
    y = (rng.random(3000) < p).astype(float)
    net = Network(5).fit(x, y)
    s = net.score(x)
    assert ((s > 0.5) == (p > 0.5)).mean() > 0.85
    for a in np.arange(0.1, 0.9, 0.2):
        at = (s >= a) & (s < a + 0.2)
        assert abs(y[at].mean() - s[at].mean()) < 0.1


def test_word_slots():
    text, whole, shape = word_slots([b"one two", b"", b" one\tone ONE"])
    assert text.tolist() == [0, 0, 2, 2, 2]
    assert whole[0] == whole[2] == whole[3] != whole[4] and shape[2] != shape[3] != shape[4]
    assert [len(x) for x in word_slots([b"", b" "])] == [0, 0, 0]
    assert pooled([None, "", "a"], index_vectors()).shape == (3, 97)


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "good words here", 1), (3, "good words here", 1), (4, "BAD!! " * 40_000, 1), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (1, None), (None, 1), (9, 1)], "doc_id long, quality int")
    out = fit(docs, labels).score(docs, name="own").collect()
    assert len(out) == 6 and all(0 <= r.own <= 1 for r in out)
    for other in (labels.limit(0), labels.where("quality = 1")):
        assert len({round(r.own, 9) for r in fit(docs, other).score(docs, name="own").collect()}) == 1
    assert fit(docs.limit(0), labels).score(docs.limit(0), name="own").count() == 0
    assert docs.where(held_out(docs.doc_id)).count() == sum(k is not None and zlib.crc32(str(k).encode()) % 3 == 1 for k, *_ in rows)


def test_word_vectors_against_a_loop(spark):
    """The sums of neighbours' index vectors, word by word."""
    from ironlift.llm.classifier import CONTEXT, DIMENSIONS, PRIOR, SLOTS, word_vectors

    texts = ["one two three two one", "", None, "two", "three ONE two!! four one one", "x " * 30]
    index = index_vectors().astype(float)
    sums, seen = np.zeros((SLOTS, DIMENSIONS)), np.zeros(SLOTS)
    for t in texts:
        _, whole, shape = word_slots([(t or "").encode()])
        for i in range(len(whole)):
            for j in range(max(0, i - CONTEXT), min(len(whole), i + CONTEXT + 1)):
                if j != i:
                    for slot in (whole[i], shape[i]):
                        sums[slot] += index[whole[j]] + index[shape[j]]
                        seen[slot] += 1
    want = sums / np.sqrt(seen + 1)[:, None]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = want / (norm + 1e-9) * (norm / (norm + PRIOR)) + index / 2 * (PRIOR / (norm + PRIOR))
    got = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.abs(got - want).max() < 1e-4 and (seen > 0).sum() > 10
