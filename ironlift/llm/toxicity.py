"""Toxic passages: token log-odds with Dirichlet priors, all maximal-scoring segments in linear time, extreme-value calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, saved, tune
from .decontaminate import normal_words, word_spans

#: Labelled documents that are learnt from at most, those with the smallest hashes of their ids; one in CALIBRATE of them is kept for calibration.
FIT_ROWS, CALIBRATE = 20_000, 4
#: Words, and beginnings of words, that the model holds at most: those of the most documents or words.
TERMS = 200_000
#: Bytes of a beginning: a word's prior is that of its longest known beginning, whose own is that of the next shorter one.
BEGINNINGS = (3, 4, 5, 6)
#: Weight of a prior, as so many documents of a word or words of a beginning.
STRENGTH = 2.0
#: Deviations of its posterior by which a log-odds is drawn towards 0, so that words of few documents speak low.
SURE = 1.64
#: What each word costs, so that passages end: on clean text the mean of log-odds less this is below zero.
DRIFT = 0.5
#: Passages expected on clean text, of a text's length and at a passage's score, below which it is significant.
SIGNIFICANT = 0.01
#: Share of the segments of clean text that lie above the threshold from which on the tail is fitted, and width and number of the bins they are counted in.
TAIL, _BIN, _BINS = 0.1, 0.05, 800

TOXICITY = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("passages", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("log_odds", T.DoubleType()), T.StructField("expected", T.DoubleType())]))),
])
_ARROW = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_odds", pa.float64()), ("expected", pa.float64())])))])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal segments of positive score, from the left and in linear time.

    They do not overlap; each one's score is more than that of any other segment within it or reaching over it. Candidates are kept
    on a stack by the sums before and at their end; each knows the last one before it that begins lower.
    """
    stack: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        low, total = total, total + s
        start = i
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][0] >= low:
                at = stack[at][4]
            if at < 0 or stack[at][1] >= total:
                break
            low, start = stack[at][0], stack[at][2]
            before = stack[at][4]
            del stack[at:]
            at = before
        stack.append((low, total, start, i + 1, at))
    return [(start, end, high - low) for low, high, start, end, _ in stack]


class LogOdds(dict):
    """Word -> its log-odds less the drift; words that were not learnt have those of their longest known beginning."""

    def __init__(self, words: dict[bytes, float], beginnings: dict[bytes, float], drift: float):
        self.words, self.beginnings, self.drift = words, beginnings, drift

    def __missing__(self, word: bytes) -> float:
        if len(self) >= TERMS:
            self.clear()
        v = self.words.get(word)
        if v is None:
            v = next((b for k in reversed(BEGINNINGS) if len(word) >= k and (b := self.beginnings.get(word[:k])) is not None), 0.0)
        self[word] = v - self.drift
        return v - self.drift


def segments(words: list[bytes], odds: LogOdds) -> list[tuple[int, int, float]]:
    """Maximal segments of a text's words. What speaks for toxic is divided by how often the text has had the word by then, so that no word makes a passage by being repeated."""
    s = np.fromiter(map(odds.__getitem__, words), float, len(words))
    often: dict[bytes, int] = {}
    for i in np.flatnonzero(s > 0).tolist():
        often[words[i]] = k = often.get(words[i], 0) + 1
        if k > 1:
            s[i] = (s[i] + odds.drift) / k - odds.drift
    up = s > 0
    if not up.any():
        return []
    # runs of one sign are one step each
    first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
    ends = np.append(first[1:], len(s))
    return [(int(first[a]), int(ends[b - 1]), v) for a, b, v in maximal_segments(np.add.reduceat(s, first).tolist())]


class ToxicityModel:
    """Log-odds of words and of their beginnings, the tail of clean segments (rate and decay), and the weights of the last step; fitted once, it scores any table."""

    def __init__(self, words: dict[bytes, float], beginnings: dict[bytes, float], drift: float = DRIFT):
        self.words, self.beginnings, self.drift = words, beginnings, drift
        self.rate, self.decay = 1.0, 1.0
        self.mean, self.scale, self.last = np.zeros(2), np.ones(2), np.zeros(3)

    def expected(self, n: int, score: float) -> float:
        """Segments of at least this score expected in n words of clean text."""
        return self.rate * max(n, 1) * math.exp(-self.decay * score)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """How unexpected the best segment is, and all significant ones together, in logarithms."""
        best = max((v for _, _, v in found), default=0.0)
        least = math.log(max(self.expected(n, best), 1e-300)) if found else max(0.0, math.log(self.rate * max(n, 1)))
        total = sum(-math.log(max(e, 1e-300)) for _, _, v in found if (e := self.expected(n, v)) < SIGNIFICANT)
        return max(-20.0, min(20.0, -least)), math.log1p(total)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((evidence - self.mean) / self.scale @ self.last[1:] + self.last[0], -30, 30)))

    def score(self, docs: DataFrame, text: str = "text", name: str = "toxicity") -> DataFrame:
        """docs with `name`: the score from 0 to 1 and the significant passages: start and end in code points, their summed log-odds, and how many such are expected on clean text.

        Null and empty texts score alike and have no passage; very long texts are taken whole; repeated rows score each for itself; an empty table gives an
        empty one; a clashing column stays and the new one gets underscores.
        """
        (name,) = fresh(docs, name)
        tune(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(TOXICITY)
        def scored(texts: pa.Array) -> pa.Array:
            model = shared.value
            odds = model.held()
            evidence, passages = [], []
            for value in texts:
                text = value.as_py() or ""
                words = normal_words(text)
                found = segments(words, odds)
                evidence.append(model.evidence(len(words), found))
                sure = [(a, b, v, e) for a, b, v in found if (e := model.expected(len(words), v)) < SIGNIFICANT]
                places = word_spans(text) if sure else []
                passages.append([{"start": places[a][0], "end": places[b - 1][1], "log_odds": v, "expected": e} for a, b, v, e in sure])
            p = model.probability(np.array(evidence).reshape(-1, 2))
            return pa.array([{"score": float(x), "passages": y} for x, y in zip(p, passages)], _ARROW)

        return docs.withColumn(name, scored(F.col(text)))

    def held(self) -> LogOdds:
        """The log-odds with what a worker has looked up before."""
        if not hasattr(self, "_held"):
            self._held = LogOdds(self.words, self.beginnings, self.drift)
        return self._held

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_held"}


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) -> in how many documents of each label each word is."""
    counts = Counter(), Counter()

    def rows():
        words = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in counts]], ["word", "clean", "toxic"])

    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[y].update(set(normal_words(text.as_py())))
        if len(counts[0]) + len(counts[1]) > TERMS:
            yield rows()
            for c in counts:
                c.clear()
    yield rows()


def _most(rows: DataFrame, by: str, terms: int) -> DataFrame:
    """Those rows of the largest `by` that are at most `terms`; of rows at the limit all or none, and of at least 2."""
    sizes = sorted(((r[0], r[1]) for r in rows.groupBy(F.least(by, F.lit(1000)).alias("k")).count().collect()), reverse=True)
    least, total = None, 0
    for k, n in sizes:
        total += n
        if k < 2 or total > terms:
            break
        least = k
    return rows.where(F.col(by) >= least) if least else rows.limit(0)


def log_odds(sample: DataFrame, terms: int = TERMS, strength: float = STRENGTH) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """sample (y 0 or 1, text) -> log-odds of words and of beginnings against the share of toxic among all words' documents.

    A word's share of toxic documents has a Dirichlet prior around that of its longest known beginning; a beginning's share is that of its words, each
    counting once, with a prior around the next shorter beginning's, and the shortest one's is the share of all. So an unknown word is
    judged by its beginning only where several words speak for it.
    """
    counts = saved(sample.select(F.col("y").cast("int"), "text").mapInArrow(_present, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).withColumn("n", F.col("clean") + F.col("toxic")), "word-counts")
    total = counts.agg(F.sum("toxic"), F.sum("n")).first()
    base = (total[0] + 1) / (total[1] + 2) if total[1] else 0.5
    share = (F.col("toxic") + strength * base) / (F.col("n") + strength)
    long_ = counts.select(share.alias("share"), F.explode(F.array(*[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in BEGINNINGS])).alias("beginning")).where("beginning is not null")
    begun = long_.groupBy("beginning").agg(F.sum("share").alias("share"), F.count("*").alias("n"))
    shares: dict[bytes, float] = {}

    def parent(word: bytes, longest: int) -> float:
        return next((p for k in reversed(BEGINNINGS) if k <= longest and len(word) >= k and (p := shares.get(word[:k])) is not None), base)

    def drawn(toxic: float, n: float, prior: float) -> float:
        """The log-odds of the posterior, SURE deviations nearer to 0."""
        a, b = toxic + strength * prior, n - toxic + strength * (1 - prior)
        odds = math.log(a / b) - math.log(base / (1 - base))
        return math.copysign(max(0.0, abs(odds) - SURE * math.sqrt(1 / a + 1 / b)), odds)

    begun_odds = {}
    for b, s, n in sorted(((bytes(r[0]), r[1], r[2]) for r in _most(begun, "n", terms).toLocalIterator()), key=lambda r: len(r[0])):
        up = parent(b, len(b) - 1)
        shares[b], begun_odds[b] = (s + strength * up) / (n + strength), drawn(s, n, up)
    words = {}
    for w, toxic, n in _most(counts, "n", terms).select("word", "toxic", "n").toLocalIterator():
        w = bytes(w)
        words[w] = drawn(toxic, n, parent(w, BEGINNINGS[-1]))
    return words, begun_odds


def _tail(model: ToxicityModel, clean: DataFrame) -> None:
    """Sets rate and decay: segments of clean text above a threshold fall off exponentially with their score, and their number grows with the text."""
    shared = clean.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, bins, n = shared.value.held(), np.zeros(_BINS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                words = normal_words(text.as_py())
                n += len(words)
                for _, _, v in segments(words, odds):
                    bins[min(int(v / _BIN), _BINS - 1)] += 1
        held = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], held]), pa.int64()), pa.array(np.concatenate([[n], bins[held]]), pa.int64())], ["bin", "n"])

    counts = {r[0]: r[1] for r in clean.select("text").mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect()}
    n = max(counts.pop(-1, 0), 1)
    bins = np.array([counts.get(k, 0) for k in range(_BINS)], float)
    above = np.cumsum(bins[::-1])[::-1]
    from_ = int(np.argmax(above <= TAIL * max(bins.sum(), 1)))
    excess = float(((np.arange(_BINS) - from_ + 0.5) * _BIN * bins)[from_:].sum())
    model.decay = (above[from_] + 1) / (excess + 1)
    model.rate = (above[from_] + 1) / n * math.exp(model.decay * from_ * _BIN)


def _last(model: ToxicityModel, sample: DataFrame) -> None:
    """Sets the weights that turn evidence into a probability, by Newton steps on the calibration documents."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        odds = m.held()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = normal_words(text.as_py())
                rows.append(m.evidence(len(words), segments(words, odds)))
            a, b = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["y", "a", "b"])

    rows = np.array([tuple(r) for r in sample.select("y", "text").mapInArrow(evidence, "y double, a double, b double").collect()], float).reshape(-1, 3)  # fit_rows / CALIBRATE rows or so
    y = rows[:, 0]
    if len(y) < 2 or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        model.last = np.array([math.log(p / (1 - p)), 0.0, 0.0])
        return
    model.mean, model.scale = rows[:, 1:].mean(0), rows[:, 1:].std(0) + 1e-6
    x = np.column_stack([np.ones(len(y)), (rows[:, 1:] - model.mean) / model.scale])
    ridge = np.diag([1e-6, 0.1, 0.1])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    model.last = np.array([w[0], *np.maximum(w[1:], 0.0)])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, terms: int = TERMS) -> ToxicityModel:
    """Log-odds from at most fit_rows labelled documents that are not held out, less one in CALIBRATE, on which the tail and the last step are fitted.

    Only texts are looked at. Rows without a label, text or id teach nothing; of several texts of one id that of the least hash teaches, equal texts teach once, and an id or text with several
    labels is toxic if one of them is; very long texts are taken whole; without any labels, or with those of one kind, all scores are that share, or 0.5; other columns are not looked at.
    The driver holds `terms` words and as many beginnings at most.
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.max("y") > 0.5).cast("int").alias("y"))
    known = saved(known.orderBy(F.xxhash64("id"), "id").limit(fit_rows), "toxic-labels")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(known), "id")  # fit_rows ids and labels at most
    once = found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    once = once.groupBy(F.md5(F.col("text").cast("binary"))).agg(F.min("id").alias("id"), F.first("text").alias("text"), F.max("y").alias("y"))
    sample = saved(once.withColumn("calibrate", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(CALIBRATE)) == 0), "toxic-sample")
    learnt, rest = sample.where("not calibrate"), sample.where("calibrate")
    model = ToxicityModel(*log_odds(learnt, terms))
    _tail(model, rest.where("y = 0"))
    _last(model, rest)
    return model
