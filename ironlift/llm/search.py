"""Ranked lexical search, reversed: the items' terms are a broadcast inverted index, and documents stream through it into bounded heaps."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, tune
from .decontaminate import normal_words

#: Documents kept for each item.
TOP = 10
#: Bytes of item text that one index may hold. More items are ranked in so many blocks, each against all documents.
BLOCK_BYTES = 4 << 20
#: Parts of an item's heaps that are merged first, so that no task merges those of all partitions.
SALTS = 16


class Index:
    """Terms of some items: for each the items that hold it, as one array of items and where each term's part of it begins."""

    def __init__(self, items: list[tuple[int, str]]):
        held: dict[bytes, set[int]] = {}
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        for i, text in items:
            for term in normal_words(text or ""):
                held.setdefault(term, set()).add(number[i])
        self.terms = {t: k for k, t in enumerate(sorted(held))}
        self.begins = np.concatenate([[0], np.cumsum([len(held[t]) for t in self.terms])]).astype(np.int64)
        self.items = np.array([i for t in self.terms for i in sorted(held[t])], np.int64)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(terms: np.ndarray, tf: np.ndarray, size: int, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each of a document's terms adds to the score of an item that holds it."""
    m = 10 + 90 * size * documents // length
    return weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Heaps:
    """For each item the best (score, minus document) so far."""

    def __init__(self, n: int, top: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.least, self.top = np.ones(n, np.int64), top

    def offer(self, document: int, scores: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.least).tolist():
            heap, entry = self.heaps[i], (int(scores[i]), -document)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]


def _counted(index):
    """A partition's documents with a term, their terms with repeats, and in how many of them each of the index's terms is: (term, n), -1 and -2 being the first two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = index.value.terms
        df, documents, length = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for value in batch.column(0):
                words = normal_words(value.as_py() or "")
                documents += bool(words)
                length += len(words)
                df[[terms[w] for w in terms.keys() & set(words)]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], held]), pa.int64()), pa.array(np.concatenate([[documents, length], df[held]]), pa.int64())], ["term", "n"])

    return count


def _streamed(index, known, top: int):
    """A partition's heaps as rows (item_id, doc_id, score)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, begins, items = index.value.terms, index.value.begins, index.value.items
        weight, documents, length = known.value
        heaps = Heaps(len(index.value.ids), top)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = normal_words(value.as_py() or "") if doc is not None else []
                found = Counter(k for w in words if (k := terms.get(w)) is not None)
                if not found:
                    continue
                held = np.fromiter(found, np.int64, len(found))
                gains = impacts(held, np.fromiter(found.values(), np.int64, len(found)), len(words), weight, documents, length)
                size = begins[held + 1] - begins[held]
                at = np.repeat(begins[held] - np.cumsum(size) + size, size) + np.arange(size.sum())  # all places of the held terms' items
                scores = np.zeros(len(heaps.heaps), np.int64)
                np.add.at(scores, items[at], np.repeat(gains, size))
                heaps.offer(doc, scores)
        rows = [(i, -d, s) for i, heap in zip(index.value.ids, heaps.heaps) for s, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "doc_id", "score"])

    return stream


def _best(rows: DataFrame, top: int, *by: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents of the highest score above 0, equal scores by ascending doc_id.

    Terms are runs of letters, digits and all beyond ASCII, only A-Z lower-cased. A first pass over the whole texts counts documents, terms and
    how many documents hold each of the items' terms; a second one scores them in integers and keeps at most `top` documents for
    each item in each partition. The items' size is measured: up to block_bytes their terms are one index, which is broadcast; more
    items are cut by a hash of their ids, and each block's passes run on their own, so that driver and workers hold one block at a time.

    Ids are integers. Items of null id or text, or without terms, have no rows; rows of one item_id are one item with the terms of all of them. A null or empty text
    has no terms; a document without an id counts in the statistics and is never a result; repeated rows are documents of their own,
    ranked one after the other; very long texts are taken whole; empty tables give an empty one; other columns are not looked at.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    size = wanted.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = []
    for k in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        own = Index([tuple(r) for r in part.toLocalIterator()])
        index = spark.sparkContext.broadcast(own)
        counts = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_counted(index), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each of the block's terms at most
        documents, length = counts.get(-1, 0), counts.get(-2, 0)
        known = spark.sparkContext.broadcast((weights(np.array([counts.get(t, 0) for t in range(len(own.terms))]), documents), documents, length))
        found = rows.mapInArrow(_streamed(index, known, top), "item_id long, doc_id long, score long")
        merged = _best(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), top, "item_id", "salt")
        ranked = _best(merged.drop("rank", "salt"), top, "item_id").select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            ranked = saved(ranked, "ranked")
            index.destroy()
            known.destroy()
        out.append(ranked)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
