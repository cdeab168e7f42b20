"""Maximal segments against their definition, log-odds against a loop, held-out accuracy, edges."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ironlift.llm.decontaminate import normal_words
from ironlift.llm.queries import QUERIES
from ironlift.llm.toxicity import BEGINNINGS, SIGNIFICANT, STRENGTH, SURE, LogOdds, fit, held_out, log_odds, maximal_segments, segments

D = "/root/testdata/sf0.01"


def by_recursion(scores, a=0, b=None):
    """The best segment, the longest of the leftmost of equals being avoided by taking the shortest, and then the same left and right of it."""
    b = len(scores) if b is None else b
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
    if best[0] <= 0:
        return []
    return by_recursion(scores, a, best[3]) + [(best[3], best[4], best[0])] + by_recursion(scores, best[4], b)


def test_maximal_segments():
    assert maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    rnd = random.Random(1)
    for _ in range(300):
        scores = [rnd.choice([-1, 1]) * rnd.random() for _ in range(rnd.randint(0, 14))]
        got, want = maximal_segments(scores), by_recursion(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))
        odds = LogOdds({str(k).encode(): s for k, s in enumerate(scores)}, {}, 0.0)
        by_runs = segments([str(k).encode() for k in range(len(scores))], odds)
        assert [x[:2] for x in by_runs] == [x[:2] for x in want]
    once = segments([b"w"] * 50, LogOdds({b"w": 2.0}, {}, 0.5))  # said again and again it speaks less and less
    assert once == [(0, 3, pytest.approx(1.5 + 0.5 + 2 / 3 - 0.5))]
    assert len(maximal_segments([1.0, -2.0] * 50_000)) == 50_000 and len(maximal_segments([2.0, -1.0] * 50_000)) == 1


def test_log_odds_against_a_loop(spark):
    import math

    texts = [(1, "scumbag here scumbaglike there"), (1, "Scumbag scumbag you"), (0, "here there you"), (0, "here there scum you"), (0, "you there"), (1, "scumbagged you")] * 3
    words, begun = log_odds(spark.createDataFrame(texts, "y int, text string").repartition(3))
    clean, toxic = Counter(), Counter()
    for y, t in texts:
        (toxic if y else clean).update(set(normal_words(t)))
    n = {w: clean[w] + toxic[w] for w in clean | toxic}
    base = (sum(toxic.values()) + 1) / (sum(n.values()) + 2)
    share = {w: (toxic[w] + STRENGTH * base) / (n[w] + STRENGTH) for w in n}
    def drawn(toxic, n, prior):
        a, b = toxic + STRENGTH * prior, n - toxic + STRENGTH * (1 - prior)
        odds = math.log(a / b) - math.log(base / (1 - base))
        near = max(0.0, abs(odds) - SURE * (1 / a + 1 / b) ** 0.5)
        return near if odds > 0 else -near

    shares, want = {}, {}
    for k in BEGINNINGS:
        for b in {w[:k] for w in n if len(w) >= k}:
            own = [share[w] for w in n if w[:k] == b]
            if len(own) >= 2:
                up = next((shares[b[:j]] for j in range(k - 1, 2, -1) if b[:j] in shares), base)
                shares[b], want[b] = (sum(own) + STRENGTH * up) / (len(own) + STRENGTH), drawn(sum(own), len(own), up)
    assert begun.keys() == want.keys() and all(abs(begun[b] - v) < 1e-9 for b, v in want.items())
    for w in n:
        up = next((shares[w[:j]] for j in reversed(BEGINNINGS) if w[:j] in shares), base)
        assert abs(words[w] - drawn(toxic[w], n[w], up)) < 1e-9
    assert words[b"scumbag"] > 0 > words[b"there"] or words[b"there"] == 0
    odds = LogOdds(words, begun, 0.5)
    assert odds[b"scumbagish"] == begun[b"scumba"] - 0.5 and odds[b"unseen"] == -0.5


def test_held_out_documents(spark):
    out = QUERIES["op13_toxicity"](spark, D)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").collect()
    assert out.count() == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    print("held-out accuracy", right)
    assert right > 0.93


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.toxicity.score) for r in fit(docs, x).score(docs).collect()) for x in (labels, turned))
    assert a == b


def test_passages_and_edges(spark):
    rnd = random.Random(3)
    plain = lambda k: " ".join(f"word{rnd.randint(0, 60)}" for _ in range(k))
    bad = "vile rotten garbage human"
    texts = [(k, plain(40) if k % 4 else f"{plain(20)}, {bad}! {plain(20)}", int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts] + [(None, 1), (9999, 1)], "doc_id long, toxic int")
    model = fit(docs, labels)
    long = plain(30000)
    new = [(1, f"É {plain(5)} {bad.upper()} {plain(5)}"), (1, f"É {plain(5)} {bad.upper()} {plain(5)}"), (2, None), (3, ""), (4, plain(30)), (5, f"{long} {bad} {long}"), (None, bad), (6, long)]
    out = model.score(spark.createDataFrame(new, "doc_id long, text string").selectExpr("*", "1 as toxicity", "'q' as score")).collect()
    assert out[0].__fields__[-1] == "toxicity_"
    by = [(r.doc_id, r.text, r.toxicity_) for r in out]
    for doc, text, t in by:
        assert (t.score >= 0.5) == (bad in (text or "").lower()), (doc, t)
        if t.score >= 0.5:
            (p,) = t.passages
            assert text[p.start : p.end].lower() == bad and p.expected < SIGNIFICANT < p.log_odds
    assert model.score(docs.limit(0)).count() == 0
    for some, want in ((labels.limit(0), 0.5), (labels.where("toxic = 0"), None)):
        scores = {round(r.toxicity.score, 6) for r in fit(docs, some).score(docs.limit(50)).collect()}
        assert len(scores) == 1 and (want is None or scores == {want})
    assert fit(docs.limit(0), labels).score(docs.limit(3)).count() == 3


@pytest.mark.parametrize("text", [None, "", "   ", "!!"])
def test_no_words(text):
    assert segments(normal_words(text) if text else [], LogOdds({}, {}, 0.5)) == []
