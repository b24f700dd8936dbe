import random

import pytest

from cairnframe.llm import tokens

tokenizers = pytest.importorskip("tokenizers")
D = "doc_id long, text string, ids string"
TEXTS = [
    None, "", " ", "\n\n  \n", "Hello, world! it's 1234 o'clock", "<|endoftext|> plain <|endoftext|>", "日本語のテキスト、テスト。", "สวัสดีครับ", "नमस्ते दुनिया", "مرحبا",
    "🙂👩‍👩‍👧 á", "x" * 100_000, "ab " * 50_000, "Zq9#~^`|" * 2000, "tab\tand\r\nline", " 　wide", "½²Ⅳ", "'S 'll'LL", "\x00\x01",
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{tokenizers and tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(spark, reference, monkeypatch):
    rng = random.Random(1)
    alphabet = "abcdefgh .,'\n0123é日ж🙂\t"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], D).repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df).collect()}
    assert got == {i: reference(t) for i, t in enumerate(texts)}


def test_repeated_null_and_no_rows(spark, reference):
    df = spark.createDataFrame([(1, "a b", ""), (1, "a b", ""), (None, "c", ""), (2, None, "")], D)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(df).collect()), key=repr)
    assert got == sorted([(1, reference("a b"))] * 2 + [(None, reference("c")), (2, [])], key=repr)
    assert tokens.encode_corpus(spark.createDataFrame([], D)).count() == 0


def test_round_trip(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 50_000]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], D)
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, [10**6, 64]), (2, None), (3, []), (3, []), (3, [64, 65]), (3, [64, 65]), (3, [65, 64]), (None, [64])], "doc_id long, ids array<int>")
    got = sorted(((r["doc_id"], r["text"]) for r in tokens.decode_corpus(odd).collect()), key=repr)
    assert got == sorted([(1, "a"), (2, None), (3, ""), (3, ""), (3, "ab"), (3, "ab"), (3, "ba"), (None, "a")], key=repr)
    assert tokens.decode_corpus(odd.limit(0)).count() == 0


def test_small_blocks(reference):
    lines = tokens.load_ranks()
    import regex

    block = tokens._block(5, [1, 2], ["some Zqxwv words", "Zqxwv"], tokens.ranks_of(lines), regex.compile(tokens.PATTERN).findall)
    assert block.num_rows == 1 and block.column(4)[0].as_py() == 2  # " Zqxwv" and "Zqxwv"


def test_every_distinct_word_is_encoded_once():
    import pyarrow as pa

    words = sorted([b" Zqxwv", b"Qzzv"] * 3 + [b"xyzzyx"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array([0] * 7, pa.int32()), pa.array(words)], ["block", "place", "word"])
    (out,) = tokens._encode(tokens.load_ranks())([batch])
    one = tokens.encoder(tokens.load_ranks())._core_bpe.encode_single_piece
    import numpy as np

    assert [np.frombuffer(x, "<u2").tolist() for x in out.column(2).to_pylist()] == [one(w) for w in words]


def test_rows_of_the_word_shuffle_grow_with_the_text(spark, monkeypatch):
    import regex

    ranks, find = tokens.ranks_of(tokens.load_ranks()), regex.compile(tokens.PATTERN).findall
    rows = lambda texts: sum(tokens._block(0, [0], [t], ranks, find).column(4)[0].as_py() for t in texts)
    texts = [" ".join(f"zq{i}x{j}v" for j in range(200)) for i in range(40)]
    assert rows(texts) == 4 * rows(texts[:10])
