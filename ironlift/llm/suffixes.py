"""Repeated 400-byte strings by suffix sorting, and their removal.

Every window of LENGTH bytes has an anchor: its K-byte string of least hash, the leftmost of equal ones. Equal
windows have equal anchors at equal places, so a window's twins are found among the contexts of one anchor
string. Contexts of anchors that occur in two places or more are gathered by anchor, and each group is sorted
with a two-stage suffix sort, whose adjacent common prefixes tell which windows repeat. Work and traffic are in
proportion to the text that repeats, and a group that is too large is split by what its windows have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RangeHash, fresh, saved, tune

#: Bytes of a string whose second occurrence counts, and of an anchor.
LENGTH, K = 400, 128
#: Bytes of text whose anchors are computed together.
_BUFFER = 1 << 20
#: Contexts of a group that one suffix sort may take. Larger groups are split into windows at up to so many neighbouring places, at last at one.
GROUP, SPLITS = 400, (16, 1)
#: Bytes of contexts that are sorted together.
BATCH = 128 << 10

_INTERVALS = "node binary, start int, end int"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbouring values, from running minima of blocks to either side."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: anchors' hashes, places, and the first and past-the-last start of the windows that have them."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    if len(data) < length:
        return [none] * len(texts)
    at = np.arange(len(data) - k + 1)
    hashes = RangeHash(data).of(at, at + k)
    low = np.uint64((1 << 24) - 1)
    place = (sliding_least((hashes & ~low) | at.astype(np.uint64), length - k + 1) & low).astype(np.int64)
    out = []
    for text, end in zip(texts, ends):
        start, n = end - len(text), len(text) - length + 1
        if n <= 0:
            out.append(none)
            continue
        mine = place[start : start + n]
        begin = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        a = mine[begin]
        out.append((hashes[a], a - start, begin, np.append(begin[1:], n)))
    return out


def _anchored(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, max(1, len(text) - length + 1), _BUFFER):  # a long text in pieces that share no window
                    part.append((node, at, text[at : at + _BUFFER + length - 1]))
                    size += len(part[-1][2])
                    if size >= _BUFFER:
                        yield from found(part)
                        part, size = [], 0
            if part:
                yield from found(part)

    def found(part):
        rows = [(node, at, *x) for (node, at, _), x in zip(part, anchors([t for _, _, t in part], length, k)) if len(x[0])]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.binary()), pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64())),
            *(pa.array([r[1] + r[i] for r in rows], pa.list_(pa.int64())) for i in (3, 4, 5))], ["node", "key", "place", "begin", "end"])

    return run


_CONTEXT = "key long, node binary, starts array<int>, n long, o int, context binary"
_CONTEXT_ARROW = pa.schema([("key", pa.int64()), ("node", pa.binary()), ("starts", pa.list_(pa.int32())), ("n", pa.int64()), ("o", pa.int32()), ("context", pa.binary())])


def _contexts(length: int):
    """(node, text, [(key, place, begin, end)]) -> the windows of each anchor, equal ones of one text in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for node, text, shared in zip(*(batch.column(i).to_pylist() for i in range(3))):
                mine: dict = {}
                for s in shared:
                    o, context = s["place"] - s["begin"], text[s["begin"] : s["end"] + length - 1]
                    row = mine.setdefault((o, context), (s["key"], node, [], o, context))
                    row[2].append(s["begin"])
                rows += mine.values()
                held += sum(len(r[4]) for r in mine.values())
                if held >= 4 << 20:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([f(r) for r in rows], t) for f, t in zip((lambda r: r[0], lambda r: r[1], lambda r: r[2], lambda r: len(r[2]), lambda r: r[3], lambda r: r[4]), _CONTEXT_ARROW.types)], schema=_CONTEXT_ARROW)

    return run


def _split(length: int, block: int):
    """Contexts -> contexts of at most block windows, at places relative to the anchor that are the same in all; grouped by the bytes that all of them have."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                windows, i = len(r["context"]) - length + 1, 0
                while i < windows:
                    o = r["o"] - i  # from this window's start to the anchor
                    j = min(windows, i + o % block + 1)
                    part = r["context"][i : j - 1 + length]
                    low = o // block * block  # all windows from o down to low share [start of the one at low, end of the first at low+block-1)
                    common = r["context"][max(0, r["o"] - low) : r["o"] - low - block + 1 + length]
                    key = int.from_bytes(hashlib.blake2b(b"%d %d " % (r["key"], low) + common, digest_size=8).digest(), "little", signed=True)
                    rows.append({"key": key, "node": r["node"], "starts": [s + i for s in r["starts"]], "n": r["n"], "o": o, "context": part})
                    i = j
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist(rows[k : k + 5000], _CONTEXT_ARROW)

    return run


def two_stage(data: bytes, depth: int) -> np.ndarray:
    """Suffixes of data in an order that is right as far as depth bytes tell.

    Stage one sorts the suffixes smaller than their successors directly. Stage two scans the buckets of first
    bytes from the smallest: each suffix met puts its predecessor, if that is the greater, next in its bucket.
    """
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    rises = np.append(t[1:] > t[:-1], False)[change]  # the end counts as smaller than any byte
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
    order = np.array(sorted(np.flatnonzero(smaller).tolist(), key=lambda p: data[p : p + depth]), np.int64)
    counts = np.bincount(t, minlength=256)
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(n, np.int64)
    lows = np.bincount(t[order], minlength=256) if len(order) else np.zeros(256, np.int64)
    tail = starts[1:] - lows
    at = np.concatenate([[0], np.cumsum(lows)])
    for c in np.flatnonzero(lows):
        out[tail[c] : starts[c + 1]] = order[at[c] : at[c + 1]]
    head = starts[:-1].copy()
    out[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        byte = t[before]
        by = np.argsort(byte, kind="stable")
        byte, before = byte[by], before[by]
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        sizes = np.diff(np.append(first, len(byte)))
        out[np.repeat(head[byte[first]] - first, sizes) + np.arange(len(byte))] = before
        head[byte[first]] += sizes

    for c in np.flatnonzero(counts):
        done = starts[c]
        while done < head[c]:
            block, done = out[done : head[c]], head[c]
            induce(block)
        if lows[c]:
            induce(out[tail[c] : starts[c + 1]])
    return out


def common_prefixes(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes, depth at most, each suffix of order has in common with the next; all must have depth bytes."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    a, b = order[:-1], order[1:]
    out = np.full(len(a), depth)
    going = np.arange(len(a))
    for k in range(0, depth, 8):
        x, y = words[a[going] + k], words[b[going] + k]
        differ = x != y
        if differ.any():
            low = (x ^ y)[differ]
            out[going[differ]] = np.minimum(depth, k + np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8)
            going = going[~differ]
            if not len(going):
                break
    return out


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows occur in these contexts twice or more."""
    data = b"".join(contexts)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    whole = np.repeat(ends, sizes) - np.arange(len(data)) >= length
    order = two_stage(data, length)
    order = order[whole[order]]
    same = common_prefixes(data, order, length) >= length
    hit = np.zeros(len(data), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[e - s : e - length + 1] for s, e in zip(sizes, ends)]


def _sorter(length: int):
    """Contexts in the order of their keys -> the intervals of single ones that others repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if size >= BATCH and r["key"] != last:
                    yield found(held)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r["context"]), r["key"]
        if held:
            yield found(held)

    def found(rows):
        out = ([], [], [])
        for r, hit in zip(rows, repeated_windows([r["context"] for r in rows], length)):
            if r["n"] > 1 or not hit.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            for a, b in zip(edge[::2], edge[1::2]):
                for column, value in zip(out, (r["node"], r["starts"][0] + a, r["starts"][0] + b - 1 + length)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["node", "start", "end"])

    return run


def repeated_intervals(texts: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """(node, data) -> intervals of bytes (node, start, end) whose windows occur elsewhere in these, equal nodes being one text."""
    places = saved(texts.where(F.octet_length("data") >= length).select("node", "data").mapInArrow(_anchored(length, k), "node binary, key array<long>, place array<long>, begin array<long>, end array<long>"), "anchors")
    each = places.select("node", F.explode(F.arrays_zip("key", "place", "begin", "end")).alias("a")).select("node", "a.*")
    spot = F.xxhash64("node", "place")
    shared = each.groupBy("key").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo <> hi").select("key")
    shared = saved(shared, "shared-anchors")  # a table of its own, so that Spark can split the join at a key that very many texts have
    mine = each.join(shared, "key").groupBy("node").agg(F.collect_set(F.struct("key", "place", "begin", "end")).alias("shared"))
    once = texts.dropDuplicates(["node"]).join(mine, "node").select("node", "data", "shared")  # copies go before they travel
    rows = saved(once.mapInArrow(_contexts(length), _CONTEXT), "contexts")
    out = None
    for block in (0, *SPLITS):
        if block:
            rows = saved(hot.select("key", "node", "starts", "n", "o", "context").mapInArrow(_split(length, block), _CONTEXT), "contexts")
        same = F.md5(F.concat(F.col("o").cast("string").cast("binary"), F.lit(b" "), F.col("context")))
        rows = rows.withColumn("same", same)
        classes = saved(rows.groupBy("same").agg(F.sum("n").alias("n"), F.first(F.struct("key", "node", "starts", "o", "context")).alias("c")).select("same", "n", "c.*"), "classes")
        twins = rows.drop("n").join(classes.where("n > 1").select("same"), "same").select("node", F.explode("starts").alias("start"), F.octet_length("context").alias("size")).select("node", "start", (F.col("start") + F.col("size")).alias("end"))
        out = twins if out is None else out.union(twins)
        if block == 1:
            break
        sizes = saved(classes.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "groups")
        few = classes.join(sizes.where(F.col("members") <= group), "key").drop("same", "members")
        out = out.union(few.repartition("key").sortWithinPartitions("key").mapInArrow(_sorter(length), _INTERVALS))
        hot = classes.join(sizes.where(F.col("members") > group), "key")
        if sizes.where(F.col("members") > group).isEmpty():
            break
    return out


_CUT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])


@F.arrow_udf(_CUT)
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    kept, removed, runs = [], [], []
    for text, own in zip(texts, spans):
        if not own.is_valid:
            kept.append(None)
            removed.append(0)
            runs.append(0)
            continue
        data, merged = text.as_py(), []
        for s, e in sorted((x["start"], x["end"]) for x in own.as_py()):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        kept.append(b"".join(data[a:b] for a, b in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(data)])))
        removed.append(sum(e - s for s, e in merged))
        runs.append(len(merged))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["kept", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """docs with `kept` (bytes left of the text's UTF-8), n_bytes, n_removed and n_spans (maximal removed runs).

    A byte goes if it lies in a string of length bytes that also starts elsewhere, in the same text or another row's;
    all are judged on the input. Texts that equal another row's are one node: from length bytes on they go whole.
    Null texts count as empty, a text shorter than length keeps all, repeated rows are copies, an empty table
    gives an empty one, and clashing columns stay while the new ones get underscores.
    """
    tune(docs.sparkSession)
    kept, n_bytes, n_removed, n_spans = fresh(docs, "kept", "n_bytes", "n_removed", "n_spans")
    content, node, spans, cut = fresh(docs, "data__", "node__", "spans__", "cut__")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.withColumns({content: data, node: F.unhex(F.md5(data))})
    intervals = repeated_intervals(base.select(F.col(node).alias("node"), F.col(content).alias("data")), length, k, group)
    copied = base.where(F.octet_length(content) >= length).groupBy(node).agg(F.count("*").alias("n"), F.first(F.octet_length(content)).alias("size")).where("n > 1")
    everything = copied.select(F.col(node).alias("node"), F.lit(0).alias("start"), F.col("size").alias("end"))
    of_node = intervals.union(everything).groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias(spans)).withColumnRenamed("node", node)
    out = base.join(saved(of_node, "spans"), node, "left").withColumn(cut, _cut(content, spans))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(cut)["kept"], F.col(content)).alias(kept), F.octet_length(content).cast("long").alias(n_bytes), F.col(cut)["n_removed"].alias(n_removed), F.col(cut)["n_spans"].alias(n_spans))
