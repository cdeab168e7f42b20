import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ironlift.llm.queries import op8_remove_repeats
from ironlift.llm.suffixes import common_prefixes, remove_repeats, repeated_windows, two_stage


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(((np.diff(gone.astype(int))) == 1).sum() + bool(gone[0] and len(d)))
        out.append((len(d), int(gone[:-1].sum()), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def test_two_stage_sorts_suffixes():
    rnd = random.Random(2)
    for alphabet in (b"a", b"ab", b"abc", bytes(range(256)), b"\0\xff"):
        for n in (0, 1, 2, 5, 50, 300):
            data = bytes(rnd.choice(alphabet) for _ in range(n))
            assert two_stage(data, n + 1).tolist() == sorted(range(n), key=lambda i: data[i:])


def test_common_prefixes():
    rnd = random.Random(2)
    data = bytes(rnd.choice(b"ab") for _ in range(400)) * 2
    order = np.array(sorted(range(len(data) - 40), key=lambda i: data[i:]))
    want = [next((k for k in range(40) if data[a + k] != data[b + k]), 40) for a, b in zip(order, order[1:])]
    assert common_prefixes(data, order, 40).tolist() == want
    hits = repeated_windows([b"abcdefgh", b"xabcdefy", b"aaaaaaa"], 4)
    assert [h.tolist() for h in hits] == [[True] * 3 + [False] * 2, [False] + [True] * 3 + [False], [True] * 4]


def compare(spark, texts, length, k, group):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length=length, k=k, group=group).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, length)


def test_random_texts(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 120))) for _ in range(60)] + [None, "", "é" * 90, "x" * 500, "xy" * 300, "same text, again and again", "same text, again and again"]
    passage = "".join(rnd.choice("abcdefghij") for _ in range(60))
    texts += [f"{rnd.randint(0, 10**9)} {passage[rnd.randint(0, 9):]}{rnd.randint(0, 10**9)}" for _ in range(60)]
    compare(spark, texts, 20, 8, 400)


@pytest.mark.parametrize("group", [1, 7])
def test_hot_groups_are_split(spark, group):
    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdefghij") for _ in range(45))
    texts = [f"{''.join(rnd.choice('uvw') for _ in range(rnd.randint(0, 12)))}{passage[rnd.randint(0, 6): 45 - rnd.randint(0, 6)]}{''.join(rnd.choice('xyz') for _ in range(rnd.randint(0, 12)))}" for _ in range(80)]
    compare(spark, texts, 30, 10, group)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in docs], 400)
    got = {r.doc_id: r for r in op8_remove_repeats(spark, "/root/testdata/sf0.001").collect()}
    for d, (n, removed, spans, kept) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    assert sum(w[1] for w in want) > 0


def test_clash_and_empty(spark):
    df = spark.createDataFrame([(1, "z" * 900, 5), (2, None, 6)], "doc_id long, text string, n_bytes int")
    out = remove_repeats(df)
    assert out.columns == ["doc_id", "text", "n_bytes", "kept", "n_bytes_", "n_removed", "n_spans"]
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 900, 2: 0}
    assert remove_repeats(df.limit(0)).count() == 0


def test_changed_follows_bytes_not_words(spark, tmp_path):
    """A shared passage of over 50 words stays below 400 bytes and goes from there on."""
    rnd = random.Random(8)
    words = lambda n, size: " ".join("".join(rnd.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    short, long = words(55, 6), words(57, 7)  # 384 and 455 bytes, and the blanks around them
    texts = [f"{i} {passage} {words(20, 5)}" for i, passage in enumerate((short, short, long, long, words(57, 7)))] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op8_remove_repeats(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "changed"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].changed for k in range(6)] == [False, False, True, True, False, False]
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans) for k in range(6)] == [b[:3] for b in brute(texts, 400)]
