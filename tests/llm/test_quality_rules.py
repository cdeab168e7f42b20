import re
from collections import Counter

import numpy as np

from ironlift.llm.queries import op9_quality_rules
from ironlift.llm.quality_rules import CUTOFF, FLOORS, LEAST_ROWS, LEAST_SCALE, MEDIAN_CHI2, SHARE, STEPS, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts, seen, dup, rep = Counter(grams), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for k, g in enumerate(grams):
        if counts[g] > 1:
            rep |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_whole_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op9_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id].text), r.doc_id
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(good) > 0.97


def rank(values, share):
    return np.sort(values, axis=0)[max(0, int(np.ceil(share * len(values))) - 1)]


def estimate(x):
    """(mean, covariance, scale) of the rows x by the same steps, in numpy and with whole matrices."""
    far = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    mean = rank(x, 0.5)
    cov = np.diag((1.4826 * rank(np.abs(x - mean), 0.5)) ** 2 + np.square(FLOORS))
    for _ in range(STEPS):
        d = far(mean, cov)
        near = x[d <= rank(d, SHARE)]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) + np.diag(np.square(FLOORS))
    return mean, cov, max(rank(far(mean, cov), 0.5) / MEDIAN_CHI2, LEAST_SCALE)


def test_verdicts_against_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality(docs).collect()
    vector = {r.doc_id: [np.log(r.stats.n_words), np.log(r.stats.word_chars / r.stats.n_words), np.arcsinh(10 * r.stats.n_symbols / r.stats.n_words), np.arcsinh(5 * r.stats.n_repeat_words / r.stats.n_words)] for r in rows if not r.stats.base_failed}
    groups, langs = {}, {}
    for r in rows:
        if r.doc_id in vector:
            groups.setdefault((r.lang, r.source), []).append(r.doc_id)
            langs.setdefault(r.lang, []).append(r.doc_id)
    kept, judged = {}, {}
    for (lang, source), ids in groups.items():
        key, of = next((k, i) for k, i in (((lang, source), ids), (lang, langs[lang]), ("all", list(vector))) if len(i) >= LEAST_ROWS or k == "all")
        if key not in judged:
            judged[key] = estimate(np.array([vector[i] for i in of]))
        mean, cov, scale = judged[key]
        for i in ids:
            z = np.array(vector[i]) - mean
            kept[i] = z @ np.linalg.inv(cov) @ z <= CUTOFF * scale
    assert {r.doc_id: r.kept for r in rows} == {r.doc_id: bool(kept.get(r.doc_id, False)) for r in rows}


TEXTS = [None, "", " \t\n\x0b\f\r ", "a b c a b c", "a b a b a b", "x\n\nx\n x\nx", "é#* $|<>&% \x1c b", "one", "one two", "the " * 3000, " wide  a b", "l\n" * 500, "q w e r t y " * 9]


def test_edges(spark):
    rows = [(k, t, None if k % 2 else "en", "s", "mine") for k, t in enumerate(TEXTS)] + [(0, None, None, None, "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, stats string")
    out = quality(df).collect()
    assert len(out) == len(rows) and {r.stats for r in out} == {"mine"}
    for r in out:
        assert tuple(r.stats_) == brute(TEXTS[r.doc_id])
    assert quality(df.limit(0)).count() == 0


def test_outliers_of_a_group(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.integers(100, 400))), "en", "hot") for k in range(300)]
    rows += [(1000 + k, " ".join(word() + "###" for _ in range(200)), "en", "hot") for k in range(40)]
    rows += [(2000, " ".join(word() + "###" for _ in range(200)), "en", "small")]
    kept = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] for k in range(300)) and not any(kept[1000 + k] for k in range(40)) and not kept[2000]


def test_outliers_of_small_groups(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 9)))
    clean = lambda: " ".join(word() for _ in range(rng.integers(100, 400)))
    dirty = lambda: " ".join(word() + "###" for _ in range(200))
    rows = [(k, clean(), "en", "hot") for k in range(60)] + [(100 + k, clean(), "en", f"small{k % 5}") for k in range(20)] + [(200 + k, clean(), None, None) for k in range(9)]
    rows += [(1000 + k, dirty(), "en", "small1") for k in range(3)]  # judged by the language
    rows += [(2000, dirty(), "xx", "hot"), (2001, dirty(), None, None)]  # judged by all rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality(df).collect()}
    assert {k for k, x in kept.items() if not x} == {1000, 1001, 1002, 2000, 2001} and len(kept) == len(rows)
    few = {r.doc_id: r.kept for r in quality(df.where("doc_id < 30 or doc_id = 2000")).collect()}  # no group and no language has enough
    assert {k for k, x in few.items() if not x} == {2000}
