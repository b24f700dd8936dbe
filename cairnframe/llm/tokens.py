"""Encoding of a whole corpus with a public byte-level BPE, each distinct word encoded once; and decoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.exec import cut, once

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokens of the byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: UTF-8 bytes of text per block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20


def load_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The vocabulary file, one `base64 id` per line; about a megabyte whatever the corpus."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


@cache
def ranks_of(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


@cache
def encoder(lines: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks_of(lines), special_tokens={})


class _Words(dict):
    """Code of a word: its id if it is one token, else the number of tokens plus its place in `others`."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.base, self.others = ranks, max(ranks.values()) + 1, []

    def __missing__(self, word: str) -> int:
        code = self.ranks.get(word.encode())
        if code is None:
            code = self.base + len(self.others)
            self.others.append(word)
        self[word] = code
        return code


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


BLOCKS = pa.schema(
    [
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("codes", pa.binary()),
        ("n_others", pa.int32()), ("words", pa.list_(pa.binary())),
    ]
)
_BLOCKS_DDL = "block long, doc_ids array<bigint>, lengths binary, codes binary, n_others int, words array<binary>"


def _block(number: int, ids: list, texts: list, ranks: dict[bytes, int], find) -> pa.RecordBatch:
    words, codes, lengths = _Words(ranks), array("i"), []
    code = words.__getitem__
    for text in texts:
        before = len(codes)
        if text:
            codes.extend(map(code, find(text)))
        lengths.append(len(codes) - before)
    row = {
        "block": number, "doc_ids": ids, "lengths": _pack(np.array(lengths)), "codes": _pack(np.frombuffer(codes, np.int32)),
        "n_others": len(words.others), "words": [w.encode() for w in words.others],
    }
    return pa.RecordBatch.from_pylist([row], BLOCKS)


def _blocks(lines: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, find = ranks_of(lines), regex.compile(PATTERN).findall
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                ids.append(i)
                texts.append(text)
                size += t.as_buffer().size if text else 0
                if size >= BLOCK_BYTES:
                    yield _block(number, ids, texts, ranks, find)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _block(number, ids, texts, ranks, find)

    return run


def _encode(lines: bytes):
    """(block, place, word) in the order of the words to (block, place, ids): every distinct word of the task encoded once."""
    kind = id_type(ranks_of(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, last, ids = encoder(lines)._core_bpe.encode_single_piece, None, b""
        for batch in batches:
            out = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, ids = word, np.array(one(word), kind).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "place", "ids"])

    return run


def id_type(ranks: dict[bytes, int]) -> str:
    """The least number type that holds every id."""
    return "<u2" if max(ranks.values()) < 1 << 16 else "<i4"


def _reassemble(base: int, kind: str):
    def run(block: pa.Table, parts: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        codes, lengths = _unpack(row["codes"]), _unpack(row["lengths"])
        counts = np.ones(base + row["n_others"], np.int64)
        starts = np.arange(base + row["n_others"], dtype=np.int64)
        places = base + parts.column("place").to_numpy().astype(np.int64)
        found = parts.column("ids").combine_chunks()
        sizes = np.diff(np.frombuffer(found.buffers()[1], "<i4", len(found) + 1, 4 * found.offset)) if len(found) else np.zeros(0, np.int64)
        own = np.frombuffer(b"".join(found.to_pylist()), kind).astype(np.int32)
        n = sizes // np.dtype(kind).itemsize
        counts[places] = n
        starts[places] = base + np.cumsum(n) - n
        flat = np.concatenate([np.arange(base, dtype=np.int32), own])
        n = counts[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts[codes], n)
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[edges]
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[where], pa.int32()))
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": ids})

    return run


def encode_corpus(docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the ids of every document without special tokens; an empty or NULL text has an empty list.

    Texts are split into pre-tokens once, block by block. A word that is one token has its id at once, so that the words
    that are hot in any corpus (blanks, commas, articles) never reach a shuffle. Of the others each block sends its
    distinct ones, one row (word, block, place) each, into a global shuffle by word, so rows grow with the text
    alone. In every task the words come in their order, so that each distinct word is encoded once in the whole corpus
    and nothing is remembered but the last one; a word has at most one row for each block. The ids go back to the
    blocks, whose documents are reassembled by position with array arithmetic.
    The blocks are cut (checkpoint), as both ways read them. Every row gives a row, also repeated or NULL
    doc_ids; extra columns are ignored; an empty table gives no rows. Strings of special tokens are ordinary text.
    """
    lines = load_ranks(name, folder)
    ranks = ranks_of(lines)
    blocks = cut(docs.select("doc_id", text).mapInArrow(_blocks(lines), _BLOCKS_DDL))
    words = blocks.select("block", F.posexplode("words").alias("place", "word")).repartition("word").sortWithinPartitions("word")
    encoded = words.mapInArrow(_encode(lines), "block long, place int, ids binary")
    bodies = blocks.select("block", "doc_ids", "lengths", "codes", "n_others")
    again = _reassemble(max(ranks.values()) + 1, id_type(ranks))
    return bodies.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(again, "doc_id long, ids array<int>")


def token_table(spark, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, bytes) of the vocabulary."""
    rows = [(i, bytearray(b)) for b, i in ranks_of(load_ranks(name, folder)).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode_corpus(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): ids joined with the token-byte table, bytes put together by position.

    An empty list is an empty text, a NULL list a NULL one. An id outside the vocabulary gives nothing. Bytes that are
    no valid UTF-8 become U+FFFD. Every row gives a row, also repeated ones: rows are told apart by doc_id and the hash of
    their ids. encoded is read once. The vocabulary is broadcast (fixed size).
    """
    rows = once(encoded, "doc_id", "ids", F.col("ids").isNull().alias("none"), F.xxhash64("ids").alias("mark"))  # not for every id
    at = rows.select("doc_id", "none", "mark", F.posexplode_outer("ids").alias("pos", "id"))
    bytes_ = F.broadcast(token_table(encoded.sparkSession, name, folder).withColumn("hex", F.hex("bytes")).drop("bytes"))
    # hex text keeps bytes through array_join, which takes strings only
    texts = at.join(bytes_, "id", "left").groupBy("doc_id", "none", "mark").agg(
        F.array_sort(F.collect_list(F.struct("pos", "hex"))).alias("parts"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies")
    )
    # of equal rows' parts, which stand side by side, one of each
    single = F.when(F.col("copies") == 1, F.col("parts")).otherwise(F.filter("parts", lambda _, i: i % F.col("copies") == 0))
    text = F.when(~F.col("none"), F.decode(F.unhex(F.array_join(single["hex"], "")), "UTF-8"))
    return texts.select("doc_id", text.alias("text"), F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "text")
