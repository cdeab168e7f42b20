import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ironlift.llm.queries import op1_token_files
from ironlift.llm.tokens import Encoder, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_tokenizers_ids(plain):
    rnd = random.Random(3)
    alphabets = ("ab .,\n", "a'st l\n ", "é ́x   .", "\x1c\x1f a\t\r\n", "日本 x!?", "a1 .-$%", "<|endoftext|> a", "𝔘x  \x85y")
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 60))) for a in alphabets for _ in range(400)]
    texts += ["don't we'll I'm", "x" * 5000, "  \n\n a  b\n", "<|endoftext|>", "a<|endoftext|>b"]
    enc = Encoder(PATH)
    assert enc.by_piece
    for _ in range(2):
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
        assert got == plain(texts)


def test_added_tokens_are_those_of_the_plain_call(spark):
    t = Tokenizer.from_file(PATH)
    rnd = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|>", " ", "\n", "a", " b", "'s", "12", "<|", "|>", "  ", "é", ".", "<|endoftext|", "日本"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(2000)] + ["a <|endoftext|> b", "x" * 99 + "<|endoftext|>" + "y" * 99]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[-2] == [64, 220, 50256, 275]
    enc = Encoder(PATH)
    assert enc.by_piece and [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want
    df = spark.createDataFrame(list(enumerate(texts[-40:])), "doc_id long, text string")
    got = sorted(read_tokens(write_tokens(df, "byte_bpe_50k.json")).collect(), key=lambda r: r.doc_id)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*x, 2] for x in want[-40:]]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, t = Encoder(path), Tokenizer.from_file(path)
    assert not enc.by_piece
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(["Some TEXT here.", None])] == [t.encode("Some TEXT here.", add_special_tokens=False).ids, []]


def test_query_is_an_exact_round_trip(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for d, ids in zip(docs, plain([r.text or "" for r in docs])):
        raw = np.array([*ids, 2], "<u4").tobytes()
        want.append((d.doc_id, start, len(ids) + 1, zlib.crc32(raw)))
        start += len(ids) + 1
    got = sorted(tuple(r) for r in op1_token_files(spark, "/root/testdata/sf0.001").collect())
    assert got == want


def test_edges(spark, tmp_path):
    rows = [(5, "five", 1), (None, "none", 1), (1, None, 1), (1, "", 1), (1, None, 1), (7, "long text " * 20_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    index = write_tokens(df, "byte_bpe_50k.json", f"file://{tmp_path}/t")
    got = sorted(read_tokens(index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 5, 7]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(r.ids[-4:] == b"\2\0\0\0" for r in got)
    assert {p.suffix for p in (tmp_path / "t").iterdir()} == {".ids", ".offsets", ".docs"}
    empty = write_tokens(df.limit(0), "byte_bpe_50k.json")
    assert read_tokens(empty).count() == 0


def test_a_table_of_null_texts_fills_several_parts(spark):
    """Rows count beside their texts, so that the ids of a part are bounded without any text."""
    from ironlift.llm import tokens

    docs = spark.range(1_000_000).selectExpr("id as doc_id", "cast(null as string) as text")
    index = write_tokens(docs, "byte_bpe_50k.json").collect()
    assert max(r.n_docs for r in index) <= 3 * tokens.PART_BYTES // tokens.ROW_BYTES and len(index) >= 4 and sum(r.n_docs for r in index) == 1_000_000
    assert [r.base for r in sorted(index, key=lambda r: r.part)] == [sum(x.n_tokens for x in index if x.part < r.part) for r in sorted(index, key=lambda r: r.part)]


def test_paths_are_those_of_sparks_store(spark, tmp_path):
    from ironlift.llm.common import filesystem, qualified

    assert qualified(spark, f"{tmp_path}/x") == f"file:{tmp_path}/x" == qualified(spark, f"file://{tmp_path}/x")
    for bad in (f"{tmp_path}/x", "odd://store/x"):
        with pytest.raises(ValueError):
            filesystem(bad)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    index = write_tokens(docs, "byte_bpe_50k.json", out=f"{tmp_path}/bare")
    assert read_tokens(index).count() == 1 and list((tmp_path / "bare").glob("part-*.ids"))
