"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network in numpy, temperature-calibrated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mix, RangeHash, saved, tune

#: Slots that words are hashed into: one half for whole words, the other for their shape, ending and whether they repeat the word before.
SLOTS = 1 << 13
#: Dimensions of a word's vector, its non-zero index entries, and how many words to each side are its context.
DIMENSIONS, ENTRIES, CONTEXT = 48, 4, 2
#: Labelled rows that the network is fitted on at most, those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Units of the hidden layer, passes over the sample, and rows of a step.
HIDDEN, EPOCHS, STEP = 24, 60, 128
#: A slot's context vector counts as if so many other words had been seen with it.
PRIOR = 5.0

_BYTES = 1 << 17


def index_vectors(slots: int = SLOTS, dimensions: int = DIMENSIONS, entries: int = ENTRIES, seed: int = 7) -> np.ndarray:
    """Sparse random vectors of +1 and -1, one a slot."""
    rng = np.random.default_rng(seed)
    out = np.zeros((slots, dimensions), np.float32)
    for k in range(entries):
        out[np.arange(slots), rng.integers(0, dimensions, slots)] += rng.choice([-1.0, 1.0], slots)
    return out


def word_slots(texts: list[bytes], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of some texts: the text's number, the slot of the word, the slot of its shape.

    Words are what lies between white space. A shape is the kinds of a word's characters (capitals, marks,
    digits), its last two bytes, and whether it equals the word before it.
    """
    flat = b"\n".join(texts)
    data = np.frombuffer(flat, np.uint8)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = word[::2], word[1::2]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    whole = RangeHash(data).of(starts, ends)
    kinds = np.zeros(len(starts), np.uint64)
    capital = (data >= 65) & (data <= 90)
    mark = (data > 32) & (data < 127) & ~capital & ~((data >= 97) & (data <= 122)) & ~((data >= 48) & (data <= 57))
    for k, what in enumerate((capital, mark, (data >= 48) & (data <= 57))):
        n = np.diff(np.concatenate([[0], np.cumsum(what)])[np.stack([starts, ends], 1)], axis=1).ravel()
        kinds += np.minimum(n, 3).astype(np.uint64) << np.uint64(2 * k)
    same = np.zeros(len(starts), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])
    last = data[ends - 1].astype(np.uint64) << np.uint64(8) | np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    shape = mix(last << np.uint64(16) | kinds << np.uint64(1) | same.astype(np.uint64))
    half = np.uint64(slots // 2)
    return text, (whole % half).astype(np.int64), (shape % half + half).astype(np.int64)


def _slices(texts: list[str | None]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= _BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's sums of the index vectors of each slot's neighbours, and how many neighbours there were."""
    # dimensions first: gathers and sums run along rows that stay in the cache; the last column is nobody's
    index = np.zeros((DIMENSIONS + 1, SLOTS + 1), np.float32)
    index[:-1, :-1] = index_vectors().T
    index[-1, : SLOTS // 2] = 1  # counts words: each has one slot of this half
    sums, seen = np.zeros((SLOTS, DIMENSIONS + 1)), False
    for batch in batches:
        for part in _slices(batch.column(0).to_pylist()):
            text, whole, shape = word_slots(part)
            if not len(text):
                continue
            seen = True
            # empty rows between the texts, so that no context reaches into another text
            at = np.arange(len(text)) + CONTEXT * (text + 1)
            slots = np.full((2, at[-1] + 1 + CONTEXT), SLOTS)
            slots[0, at], slots[1, at] = whole, shape
            own = np.take(index, slots[0], axis=1)
            own += np.take(index, slots[1], axis=1)
            near, n = np.zeros_like(own), own.shape[1]
            for k in range(1, CONTEXT + 1):
                near[:, k:] += own[:, : n - k]
                near[:, : n - k] += own[:, k:]
            for slot in (whole, shape):
                order = np.argsort(slot.astype(np.uint16), kind="stable")
                ordered = slot[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                sums[ordered[first]] += np.add.reduceat(np.take(near, at[order], axis=1), first, axis=1).T
    if seen:
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(sums[used].ravel()), DIMENSIONS + 1).cast(pa.list_(pa.float64()))], ["slot", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A vector for each slot, from the contexts of all words of all texts: SLOTS x DIMENSIONS, whatever the corpus.

    Partitions sum up on their own and their sums are added in Spark; the driver gets SLOTS rows at most. Null and empty texts have no
    words, repeated rows count each, very long texts are taken whole, and an empty table leaves each slot its own random vector.
    """
    tune(docs.sparkSession)
    parts = docs.select(F.col(text).alias("text")).mapInArrow(_contexts, "slot int, sums array<double>")
    total = parts.groupBy("slot").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"d{k}") for k in range(DIMENSIONS + 1)])
    out = np.zeros((SLOTS, DIMENSIONS), np.float32)
    for r in total.collect():
        v = np.array(r[1:])
        out[r[0]] = np.sqrt(v[-1] + 1) ** -1 * v[:-1] if v[-1] else 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    # a slot that was hardly seen keeps more of its own random vector
    return (out / (norm + 1e-9) * (norm / (norm + PRIOR)) + index_vectors() / ENTRIES**0.5 * (PRIOR / (norm + PRIOR))).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A document's vector: the mean of its words' vectors, of its shapes' vectors, and the log of its words' number."""
    out = []
    for part in _slices(texts):
        text, whole, shape = word_slots(part)
        n = np.bincount(text, minlength=len(part)).astype(np.float32)
        row = np.zeros((len(part), 2 * vectors.shape[1] + 1), np.float32)
        if len(text):
            for k, slot in enumerate((whole, shape)):
                used, nth = np.unique(slot, return_inverse=True)
                counts = np.bincount(text * len(used) + nth, minlength=len(part) * len(used)).reshape(len(part), -1)
                row[:, k * vectors.shape[1] : (k + 1) * vectors.shape[1]] = counts.astype(np.float32) @ vectors[used] / np.maximum(n, 1)[:, None]
        row[:, -1] = np.log1p(n) / 10
        out.append(row)
    return np.concatenate(out) if out else np.zeros((0, 2 * vectors.shape[1] + 1), np.float32)


class Network:
    """Two layers, tanh and a sigmoid, on standardised inputs; `temperature` divides what goes into the sigmoid."""

    def __init__(self, n: int, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.rng, self.temperature = rng, 1.0
        self.p = [rng.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.mean, self.scale = np.zeros(n), np.ones(n)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-3) -> Network:
        """Adam on the cross entropy of four fifths of the rows; the temperature is fitted on the rest."""
        order = self.rng.permutation(len(x))
        check, order = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[order].mean(0), x[order].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.p]
        t = 0
        for epoch in range(epochs):
            self.rng.shuffle(order)
            for k in range(0, len(order), STEP):
                i = order[k : k + STEP]
                a, b, c, d = self.p
                h = np.tanh(z[i] @ a + b)
                g = (1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30))) - y[i]) / len(i)
                back = np.outer(g, c) * (1 - h * h)
                grads = [z[i].T @ back + decay * a, back.sum(0), h.T @ g + decay * c, np.array([g.sum()])]
                t += 1
                step = rate * (1 - epoch / epochs)
                for p, grad, (m, v) in zip(self.p, grads, moments):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if len(check):
            out, labels = self.logits(x[check]), y[check]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            losses = [np.logaddexp(0, -np.where(labels > 0.5, out, -out) / s).mean() for s in grid]
            self.temperature = float(grid[int(np.argmin(losses))])
        return self


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class QualityModel:
    """Word vectors and a network; fitted once, it scores any table."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """docs with their score from 0 to 1 in `name`; a clashing column stays and the new one gets underscores.

        Null and empty texts score alike, very long ones are taken whole, repeated rows score each for itself, and an
        empty table gives an empty one.
        """
        (name,) = fresh(docs, name)
        tune(docs.sparkSession)
        model = docs.sparkSession.sparkContext.broadcast((self.vectors, self.network))

        @F.arrow_udf(T.DoubleType())
        def score(texts: pa.Array) -> pa.Array:
            vectors, network = model.value
            return pa.array(network.score(pooled(texts.to_pylist(), vectors)), pa.float64())

        return docs.withColumn(name, score(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Word vectors over all texts of docs; the network on at most fit_rows labelled rows that are not held out.

    Only texts enter the features. Rows without a label, text or id teach nothing; null and empty texts score like
    a text without words; a repeated label or row counts as often as it occurs, the first fit_rows by the hash of
    their id; very long texts are taken whole; columns other than those named are not looked at. With labels of one kind only, or
    none, every score is that share of ones, or 0.5.
    """
    vectors = word_vectors(docs, text)
    spark = docs.sparkSession
    wanted = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    wanted = saved(wanted.orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows), "fit-labels")
    shared = spark.sparkContext.broadcast(vectors)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def pool(texts: pa.Array) -> pa.Array:
        return pa.array(list(pooled(texts.to_pylist(), shared.value)), pa.list_(pa.float32()))

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(wanted), "id")  # fit_rows ids and labels at most
    sample = found.orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "y").limit(fit_rows).select("id", "y", pool("text").alias("v")).toPandas()
    network = Network(2 * DIMENSIONS + 1)
    if len(sample) and sample["y"].nunique() > 1:
        network.fit(np.stack(sample["v"]).astype(float), sample["y"].to_numpy(float))
    else:
        share = min(max(sample["y"].mean() if len(sample) else 0.5, 1e-6), 1 - 1e-6)
        network.p = [p * 0 for p in network.p[:3]] + [np.array([np.log(share / (1 - share))])]
    return QualityModel(vectors, network)
