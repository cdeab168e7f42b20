"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, scanning each text once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, saved, tune

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of benchmark text that one automaton may hold. A larger benchmark is scanned in so many blocks, each against all rows.
BLOCK_BYTES = 16 << 20
#: A word: after lower-casing A-Z, a run of 0-9, a-z and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_LOWER = {c: c + 32 for c in range(65, 91)}
#: Each byte's normal form: letters lower, digits and the bytes of non-ASCII characters as they are, all else a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

MATCH = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text.translate(_LOWER))]


def windows_of(items: list[tuple], window: int) -> dict[str, tuple[int, list[str]]]:
    """Window text (latin-1 view of its bytes, spaces around) -> words, ids of the items that have it."""
    out: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        words = normal_words(text or "")
        for k in range(max(1, len(words) - window + 1) if words else 0):
            part = words[k : k + window]
            ids = out.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), []))[1]
            if str(item) not in ids:
                ids.append(str(item))
    return out


_automata: dict = {}


def _automaton(shared):
    """The automaton of a broadcast dictionary of windows; one is kept in each worker, as blocks take turns in passes of their own."""
    import ahocorasick

    if shared.id not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for key, (n, ids) in shared.windows.value.items():
            a.add_word(key, (n, ids))
        if len(a):
            a.make_automaton()
        _automata[shared.id] = a
    return _automata[shared.id]


class _Shared:
    def __init__(self, windows, name):
        self.windows, self.id = windows, name


def scan(text: str | None, automaton) -> tuple[int, list[int], list[str]]:
    """Words of a text, the indices of its hit words and the sorted ids of the items that occur."""
    words = normal_words(text) if text else []
    if not words or not len(automaton):
        return len(words), [], []
    line = b" ".join([b"", *words, b""])
    hits = list(automaton.iter(line.decode("latin-1")))
    if not hits:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    hit, items = np.zeros(len(words), bool), set()
    for end, (n, ids) in hits:
        last = int(np.searchsorted(spaces, end))  # the space at end comes after so many words
        hit[last - n : last] = True
        items.update(ids)
    return len(words), np.flatnonzero(hit).tolist(), sorted(items)


def original_spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Where the runs of hit words lie in the text, in code points."""
    places = word_spans(text) if hit else []
    out: list[list[int]] = []
    for k, i in enumerate(hit):
        if k and hit[k - 1] == i - 1:
            out[-1][1] = places[i][1]
        else:
            out.append(list(places[i]))
    return [tuple(x) for x in out]


def matcher(items: list[tuple], spark, window: int = WINDOW):
    """An Arrow UDF: text -> MATCH, against these items, and the broadcast that it holds. items: bounded by the caller."""
    windows = windows_of(items, window)
    shared = _Shared(spark.sparkContext.broadcast(windows), f"{id(windows)}-{len(windows)}-{hash(frozenset(windows))}")

    @F.arrow_udf(MATCH)
    def match(texts: pa.Array) -> pa.Array:
        a = _automaton(shared)
        out = []
        for value in texts:
            text = value.as_py()
            n, hit, ids = scan(text, a)
            out.append({"n_words": n, "n_hit": len(hit), "items": ids, "spans": [{"start": s, "end": e} for s, e in original_spans(text, hit)] if hit else []})
        return pa.array(out, _ARROW)

    return match, shared.windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with `match`: n_words, n_hit, items (ids as sorted strings) and spans (code points of the runs of hit words).

    The benchmark's size is measured; up to block_bytes it is one automaton, sent to all executors. A larger
    one is cut into blocks of that size by a hash of its ids, and each block scans all rows in a pass of its own, whose
    result is written, so that driver and workers never hold more than one block; their results are united. A null or empty text has no words and no hits; items that are null or have no words never occur;
    items with equal texts all count; repeated rows each get their own result; an empty benchmark hits
    nothing. A column of docs named match stays, and the new one gets underscores appended.
    """
    spark = docs.sparkSession
    tune(spark)
    (name,) = fresh(docs, "match")
    wanted = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null and item is not null")
    size = wanted.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs
    names = [name] if blocks == 1 else fresh(docs, name, *[f"match_{k}" for k in range(blocks)])[1:]
    for k, col in enumerate(names):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        items = [(r["item"], r["text"]) for r in part.toLocalIterator()]
        match, held = matcher(items, spark, window)
        out = out.withColumn(col, match(F.col(text)))
        if blocks > 1:
            out = saved(out, "block")
            held.destroy()
    if blocks == 1:
        return out
    # hit words of several blocks: their spans' union, counted again in words
    spans = F.flatten(F.array(*[F.col(c)["spans"] for c in names]))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["items"] for c in names]))))
    return out.withColumn(name, recount(F.col(text), spans, items)).drop(*names)


@F.arrow_udf(MATCH)
def _recount(texts: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
    out = []
    for t, s, i in zip(texts, spans, items):
        text, places = t.as_py() or "", s.as_py()
        words = word_spans(text)
        hit = [k for k, (a, b) in enumerate(words) if any(p["start"] <= a and b <= p["end"] for p in places)] if places else []
        out.append({"n_words": len(words), "n_hit": len(hit), "items": i.as_py(), "spans": [{"start": a, "end": b} for a, b in original_spans(text, hit)]})
    return pa.array(out, _ARROW)


def recount(text: Column, spans: Column, items: Column) -> Column:
    return _recount(text, spans, items)
