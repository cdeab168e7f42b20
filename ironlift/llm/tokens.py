"""Token ids in flat binary files: unsigned integers, 64-bit document offsets, partition bases by prefix sums, memory-mapped reading."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, qualified, saved, sums_before, tune, work_dir

#: Bytes of text in a part, so that one task holds the ids and lengths of so many documents and no more.
PART_BYTES = 64 << 20
#: What each row counts as beside its text: its id and size are held in lists, so that parts of empty texts are bounded too.
ROW_BYTES = 256
#: Characters that are encoded together, and bytes of ids that one batch carries.
SLICE = 1 << 20
#: Distinct pieces that a worker remembers, the longest of them, and how many are encoded in one text.
PIECES, PIECE_CHARS, LINE = 700_000, 40, 32

# What the byte-level pre-tokenizer's expression calls white space, and marks that it takes for neither letters, digits nor white space.
_SPACE = "\\t-\\r \\x85\\xa0  -     　"
_MARK = re.escape(".,;:!?&%#*$|<>=()\"")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces end only where that expression must end a match, so pieces can be encoded one by one.
_PIECE = re.compile(
    f" ?[{_LETTER}]+(?=[ \\n{_MARK}]|$)"  # a whole run of letters
    f"| ?[{_MARK}]+(?=[ \\n{_LETTER}]|$)"  # a whole run of marks
    f"| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"  # what lies between white space, and white space
)


class Encoder:
    """Texts to ids as tokenizer.encode(text, add_special_tokens=False) gives them, added tokens' strings in a text being those tokens.

    With a byte-level pre-tokenizer a text falls into added tokens and pieces whose ids do not depend on each other; each
    distinct piece is encoded once in a worker. With any other tokenizer, and where added tokens take in their
    surroundings, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.by_piece = self.tokenizer.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and self.tokenizer.token_to_id("Ċ") is not None
        self.newline = self.tokenizer.token_to_id("Ċ")
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.by_piece = self.by_piece and not any(t.single_word or t.lstrip or t.rstrip or "\n" in t.content for t in added) and len({t.normalized for t in added}) <= 1
        # the longest of those that begin at a place, as the library takes them
        self.added = re.compile(f"({'|'.join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))})") if added else None
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return _PIECE.findall(text)
        return [p for k, part in enumerate(self.added.split(text)) for p in ([part] if k % 2 else _PIECE.findall(part))]

    def _learn(self, pieces: list[str], into: dict[str, bytes]) -> None:
        """Encodes pieces, many in one text: a newline between two pieces is always a token of its own."""
        plain = [p for p in pieces if not p[-1].isspace() and "\n" not in p]
        lines = [plain[k : k + LINE] for k in range(0, len(plain), LINE)]
        for line, ids in zip(lines, self._ids(["\n".join(x) for x in lines])):
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) != len(line) - 1:
                raise ValueError("a newline was merged with its neighbours")
            raw, size = ids.tobytes(), self.dtype.itemsize
            starts, ends = [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(raw)]
            into.update(zip(line, [raw[a:b] for a, b in zip(starts, ends)]))
        rest = [p for p in pieces if p[-1].isspace() or "\n" in p]
        into.update(zip(rest, [x.tobytes() for x in self._ids(rest)]))

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [x.tobytes() for x in self._ids(texts)]
        lists = [self._pieces(t) for t in texts]
        pieces = set().union(*lists)
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > PIECES:
            self.known = dict(islice(self.known.items(), PIECES // 2))  # what was met first is what is met most
            new = pieces.difference(self.known)
        self._learn([p for p in new if len(p) <= PIECE_CHARS], self.known)
        known = self.known
        if long := [p for p in new if len(p) > PIECE_CHARS]:
            self._learn(long, known := dict(self.known))
        get = known.__getitem__
        return [b"".join(map(get, x)) for x in lists]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as bytes of self.dtype; a null text has none."""
        part, chars = [], 0
        for t in texts:
            part.append(t or "")
            chars += len(part[-1])
            if chars >= SLICE:
                yield from self._encode(part)
                part, chars = [], 0
        if part:
            yield from self._encode(part)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder for a vocabulary file; path may be a public_tokenizers file name."""
    if path not in _encoders:
        if not os.path.isabs(path):
            import public_tokenizers

            _encoders[path] = Encoder(public_tokenizers.path(path))
        else:
            _encoders[path] = Encoder(path)
    return _encoders[path]


def _writer(out: str, tokenizer: str, end_id: int | None):
    """Arrow batches of (id, text) -> one row for the partition, whose files it writes under names of their own and then renames."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (store, folder) = encoder(tokenizer), filesystem(out)
        part = TaskContext.get().partitionId()
        name, attempt = f"{folder}/part-{part:06d}", uuid.uuid4().hex
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        keys, sizes, stream = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            stream = stream or store.open_output_stream(f"{name}.{attempt}")
            keys += batch.column(0).to_pylist()
            for raw in enc.encode(batch.column(1).to_pylist()):
                sizes.append((len(raw) + len(end)) // enc.dtype.itemsize)
                stream.write(raw)
                stream.write(end)
        if stream is None:
            return
        stream.close()
        store.move(f"{name}.{attempt}", f"{name}.ids")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "path": [f"{out}/part-{part:06d}"], "dtype": [enc.dtype.str], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([sum(sizes)], pa.int64()),
            "doc_ids": pa.array([keys], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64()))})

    return write


_INDEX = "part long, path string, dtype string, n_docs long, n_tokens long, doc_ids array<long>, sizes array<long>"


def _offsets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes each partition's .offsets (n_docs + 1 unsigned 64-bit places in the whole corpus) and .docs (n_docs signed 64-bit ids, then a byte each: is it an id)."""
    for batch in rows:
        for r in batch.to_pylist():
            store, name = filesystem(r["path"])
            offsets = np.cumsum([r["base"], *r["sizes"]]).astype("<u8").tobytes()
            docs = np.array([x or 0 for x in r["doc_ids"]], "<i8").tobytes() + bytes(x is not None for x in r["doc_ids"])
            for suffix, data in (("offsets", offsets), ("docs", docs)):
                attempt = f"{name}.{suffix}.{uuid.uuid4().hex}"
                with store.open_output_stream(attempt) as f:
                    f.write(data)
                store.move(attempt, f"{name}.{suffix}")
        yield batch.select(["part", "path", "dtype", "n_docs", "n_tokens", "base"])


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2) -> DataFrame:
    """Writes the ids of docs in ascending order of doc_id and returns the index: part, path, dtype, n_docs, n_tokens, base.

    part-N.ids holds 16-bit unsigned ids where the vocabulary allows, else 32-bit ones; part-N.offsets and
    part-N.docs say where each document begins and which it is. base is the number of ids in earlier parts, a
    prefix sum over the parts' totals. Documents are dealt to parts by ranges of (doc_id, hash of text), so
    one repeated doc_id can fill many parts; a part holds about PART_BYTES of text at most, and a longer text whole. Null ids come first, repeated ids lie side by side, null and empty
    texts have the end id alone, an empty table writes no file. Other columns of docs are not written.
    """
    spark = docs.sparkSession
    tune(spark)
    out = qualified(spark, out) if out else work_dir(spark, "tokens")
    store, folder = filesystem(out)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    size = docs.select(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    parts_ = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = rows.repartitionByRange(parts_, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    parts = saved(rows.mapInArrow(_writer(out, tokenizer, end_id), _INDEX), "token-parts")
    bases = sums_before(parts, "part", "n_tokens", "base")
    index = parts.join(bases, "part").select("part", "path", "dtype", "n_docs", "n_tokens", "base", "doc_ids", "sizes")
    return saved(index.mapInArrow(_offsets, "part long, path string, dtype string, n_docs long, n_tokens long, base long"), "token-index")


def _mapped(store, name: str, dtype: str):
    """What gives a range of a file as an array: memory-mapped where it is a local or mounted file, else that range is read."""
    if store.type_name == "local":
        whole = np.memmap(name, dtype, "r") if os.path.getsize(name) else np.zeros(0, dtype)
        return lambda a, b: np.asarray(whole[a:b])
    size, f = np.dtype(dtype).itemsize, store.open_input_file(name)
    return lambda a, b: np.frombuffer(f.read_at(int(b - a) * size, int(a) * size), dtype)


def _reader(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for r in batch.to_pylist():
            store, name = filesystem(r["path"])
            n = r["n_docs"]
            ids, offsets = _mapped(store, f"{name}.ids", r["dtype"]), _mapped(store, f"{name}.offsets", "<u8")(0, n + 1).astype(np.int64)
            docs = _mapped(store, f"{name}.docs", "u1")(0, 9 * n)
            keys, there = docs[: 8 * n].view("<i8"), docs[8 * n :].astype(bool)
            local, k = offsets - r["base"], 0
            while k < n:
                end = min(n, max(k + 1, int(np.searchsorted(local, local[k] + SLICE, "right")) - 1))
                raw = ids(local[k], local[end]).astype("<u4")
                bounds = (local[k : end + 1] - local[k]) * 4
                column = pa.Array.from_buffers(pa.large_binary(), end - k, [None, pa.py_buffer(bounds.astype("<i8")), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[k:end], pa.int64(), mask=~there[k:end]), "start": offsets[k:end], "n_tokens": np.diff(offsets[k : end + 1]), "ids": column.cast(pa.binary())})
                k = end


def read_tokens(index: DataFrame) -> DataFrame:
    """The documents of written files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    An index without rows gives none; documents of null or repeated ids are rows like any; very long ones come whole.
    """
    spark: SparkSession = index.sparkSession
    tune(spark)
    n = max(1, index.count())
    return index.repartition(n).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")
