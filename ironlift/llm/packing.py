"""Packing into fixed windows: non-negative least squares over shallow length combinations, rounding, and a greedy rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, saved, tune
from .tokens import encoder

#: Ids of a sequence.
WINDOW = 1024
#: Steps of the least-squares solver.
STEPS = 400

_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _cutter(tokenizer: str, end_id: int, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            keys, out, held = batch.column(0).to_pylist(), ([], [], [], [], []), 0
            for key, raw in zip(keys, enc.encode(batch.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    for column, value in zip(out, (key, at, len(piece), len(ids), piece.tobytes())):
                        column.append(value)
                held += len(ids)
                if held >= 1 << 20:
                    yield _pieces(out)
                    out, held = ([], [], [], [], []), 0
            if held:
                yield _pieces(out)

    return cut


def _pieces(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])


def cut_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces of at most window ids: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit).

    A document is its text's ids and end_id; all its pieces but the last are full. A null or empty text is the
    end id alone, repeated rows are documents of their own, an empty table has no pieces.
    """
    tune(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cutter(tokenizer, end_id, window), _PIECES)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of these lengths that fill a window exactly: rows of three lengths, 0 for none."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    c = window - a - b
    pairs = (a <= b) & (c == 0)
    triples = (a <= b) & (b <= c)
    triples[triples] = there[c[triples]]
    return np.concatenate([np.stack([a, b, np.zeros_like(a)], 1)[pairs], np.stack([a, b, c], 1)[triples]])


def non_negative(uses: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|, A[l, p] being how often combination p uses length l: accelerated projected gradients."""
    n = len(counts)
    used = uses > 0
    rows, columns = uses[used], np.nonzero(used)[0]
    forward = lambda x: np.bincount(rows, x[columns], n)
    back = lambda r: np.bincount(columns, r[rows], len(uses))
    v = np.ones(len(uses))
    for _ in range(30):  # the largest eigenvalue of A'A, by power iteration
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(uses))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - counts) / (1.02 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times), ...]) such that the sequences use each length just counts[length] times.

    counts: one number for each length from 0 to window, whatever the corpus. Full pieces stand alone; pairs and
    triples get the rounded-down solution of the least-squares problem; what is left is packed greedily, the
    longest first and then the longest that still fits.
    """
    left = np.asarray(counts, np.int64).copy()
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if left[window]:
        out.append((int(left[window]), [(window, 1)]))
        left[window] = 0
    lengths = np.flatnonzero(left)
    uses = combinations(lengths, window) if len(lengths) > 1 else np.zeros((0, 3), np.int64)
    if len(uses):
        x = non_negative(uses, left.astype(float))
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 1:
                break
            part, times = np.unique(uses[p][uses[p] > 0], return_counts=True)
            repeats = int(min(int(x[p]), (left[part] // times).min()))
            if repeats:
                left[part] -= repeats * times
                out.append((repeats, [(int(a), int(b)) for a, b in zip(part[::-1], times[::-1])]))
    while len(lengths := np.flatnonzero(left)):
        space, sequence, repeats = window, [], None
        while (k := np.searchsorted(lengths, space, "right")):
            longest = int(lengths[k - 1])
            times = int(min(left[longest], space // longest))
            sequence.append((longest, times))
            space -= longest * times
            lengths = lengths[: k - 1]
        repeats = min(int(left[a]) // b for a, b in sequence)
        for a, b in sequence:
            left[a] -= repeats * b
        out.append((repeats, sequence))
    return out


def intervals(sequences: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: from which rank on, the first sequence, the place in it, how many of the length it has, and its ids."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for repeats, sequence in sequences:
        at, total = 0, sum(a * b for a, b in sequence)
        for length, times in sequence:
            out.setdefault(length, []).append((used.get(length, 0), first, at, times, total))
            used[length] = used.get(length, 0) + repeats * times
            at += length * times
        first += repeats
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


_PLACE = T.StructType([T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "padding")])


def pack(pieces: DataFrame, window: int = WINDOW, length: str = "length") -> DataFrame:
    """pieces (each of 1 to window ids) with sequence_id, offset and padding, that of its whole sequence.

    Only the histogram of lengths, window + 1 numbers, meets in the driver; the plan made of it says for each
    length which ranks go where, and pieces are ranked by partition and prefix sums. A sequence is padded to the
    window, but not where its ids are a power of two. Pieces of a null length or one outside 1 to window are an
    error; repeated rows are pieces of their own; no pieces, no sequences; clashing columns stay.
    """
    spark = pieces.sparkSession
    part, rank, tie = fresh(pieces, "part__", "rank__", "tie__")
    names = fresh(pieces, "sequence_id", "offset", "padding")
    base, place_ = fresh(pieces, "base__", "place__")
    rows = saved(pieces.withColumns({part: F.spark_partition_id(), tie: F.monotonically_increasing_id()}), "pieces")
    counts = saved(rows.groupBy(part, length).count(), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy(length).agg(F.sum("count").alias("n")).where(f"{length} between 1 and {window}").collect():
        histogram[r[0]] = r["n"]
    if counts.where(f"{length} is null or {length} not between 1 and {window}").limit(1).count():
        raise ValueError(f"a piece's length is not in 1 to {window}")
    table = spark.sparkContext.broadcast(intervals(plan(histogram, window)))

    @F.arrow_udf(_PLACE)
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        sizes, at = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        out = np.zeros((3, len(sizes)), np.int64)
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            lo, first, offset, times, total = table.value[int(size)]
            k = np.searchsorted(lo, at[mine], "right") - 1
            nth = at[mine] - lo[k]
            out[0, mine] = first[k] + nth // times[k]
            out[1, mine] = offset[k] + nth % times[k] * size
            out[2, mine] = np.where(total[k] & (total[k] - 1), window - total[k], 0)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["sequence_id", "offset", "padding"])

    earlier = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(part, length, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(base))
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(part, length).orderBy(tie)) - 1).join(bases, [part, length])
    placed = ranked.withColumn(place_, place(F.col(length).cast("long"), (F.col(rank) + F.col(base)).cast("long")))
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], *[F.col(place_)[a].alias(b) for a, b in zip(("sequence_id", "offset", "padding"), names)])
