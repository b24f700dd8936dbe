"""Held-out test passages in a training corpus, by greedy string tiling."""

from __future__ import annotations

import heapq
import html
import quopri
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.exec import cut, sized
from cairnframe.llm.mailparts import parts

#: Words of a seed; an item that needs shorter runs has shorter seeds of its own.
SEED_WORDS = 4
#: Seeds that a task hands on at a time, and words whose hashes it keeps at hand (a cache: results don't depend on it).
CHUNK_SEEDS, CACHE_WORDS = 1 << 20, 1 << 20

_HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")
_APOSTROPHE = re.compile(f"(?<=[^\\W\\d_{_HAN}])['’ʼ＇](?=[^\\W\\d_{_HAN}])")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|mark|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>", re.I)
_MARKUP = re.compile(r"(?s)<!--.*?-->|<(?:style|script)\b.*?</(?:style|script)\s*>|<[!/]?[A-Za-z][^<>]*>", re.I)
_END_TAG = re.compile(r"</[A-Za-z]")
_ESCAPE = re.compile(r"=[0-9A-F]{2}|=\r?\n")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits without regard to case, each Chinese character a word."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.casefold())


def readings(text: str) -> list[tuple[list[str], list[int] | None]]:
    """(words, how many words each stands for) of the ways a text reads: as it is (None: each for one), and, where letters
    stand on both sides of an apostrophe, without it, as texts whose punctuation was dropped have it."""
    out: list[tuple[list[str], list[int] | None]] = [(words_of(text), None)]
    if _APOSTROPHE.search(text):
        words = words_of(_APOSTROPHE.sub("ǃ", text))  # a letter without case, so that the word goes on
        out.append(([w.replace("ǃ", "") for w in words], [1 + w.count("ǃ") for w in words]))
    return out


def readable(text: str) -> list[str]:
    """The parts of a mail as they read: quoted-printable decoded, markup taken off, base64 left out.

    A part that doesn't say its coding is read both ways if it holds anything like an escape of quoted-printable.
    """
    out = []
    for kind, coding, start, end in parts(text):
        if coding == "base64" or not (kind.startswith("text/") or kind == "message/rfc822"):
            continue
        bodies = [text[start:end]]
        if coding == "quoted-printable" or not coding and _ESCAPE.search(bodies[0]):
            decoded = quopri.decodestring(bodies[0].encode()).decode("utf-8", "replace")
            bodies = [decoded] if coding else [bodies[0], decoded]
        for body in bodies:
            if kind == "text/html" or not coding and _END_TAG.search(body):
                body = html.unescape(_MARKUP.sub(" ", _INLINE.sub("", body)))
            out.append(body)
    return out


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k words; windows of different lengths differ."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * _BASE + hashes[j : j + n]
    return h.view(np.int64)


def least_run(weights: list[int], share: float) -> int:
    """Words in the shortest run that can stand for `share` of an item."""
    return max(1, ceil((share * sum(weights) - 1e-9) / max(weights)))


def seed_words(weights: list[int], share: float) -> int:
    """Words of an item's seeds: SEED_WORDS, or as many as its shortest needed run has."""
    return min(SEED_WORDS, least_run(weights, share))


def runs_of(hits: Iterable[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the longest matches, from the places (doc, item) of shared seeds of k words."""
    out, last, start, end = [], None, 0, -1
    for d, q in sorted({(q - p, q) for q, p in hits}):
        if d == last and q == end + 1:
            end = q
            continue
        if last is not None:
            out.append((start - last, start, end - start + k))
        last, start, end = d, q, q
    if last is not None:
        out.append((start - last, start, end - start + k))
    return out


def tiles_of(runs: list[tuple[int, int, int]], weights: list[int] | None, words: int, k: int) -> list[tuple[int, int, int, int]]:
    """(place in item, place in doc, length, weight) of the tiles: again and again the longest match, none overlapping.

    What others leave of a match counts if it has at least k words. Words weigh 1 where weights is None.
    """
    if weights is None:
        weigh = lambda p, n: n
    else:
        upto = [0, *accumulate(weights)]
        weigh = lambda p, n: upto[p + n] - upto[p]
    heap = [(-weigh(p, n), p, q, n) for p, q, n in runs]
    if len(heap) == 1:
        w, p, q, n = heap[0]
        return [(p, q, n, -w)]
    heapq.heapify(heap)
    used_i, used_d, out = bytearray(words), set(), []
    while heap:
        w, p, q, n = heapq.heappop(heap)
        free = _free(used_i, used_d, p, q, n)
        if len(free) == 1 and free[0][2] == n:
            used_i[p : p + n] = b"\1" * n
            used_d.update(range(q, q + n))
            out.append((p, q, n, -w))
            continue
        for p, q, n in free:  # partly taken: what is left waits its turn
            if n >= k:
                heapq.heappush(heap, (-weigh(p, n), p, q, n))
    return out


def _free(used_i: bytearray, used_d: set[int], p: int, q: int, n: int) -> list[tuple[int, int, int]]:
    out, start = [], None
    for j in range(n + 1):
        if j < n and not used_i[p + j] and q + j not in used_d:
            start = j if start is None else start
        elif start is not None:
            out.append((p + start, q + start, j - start))
            start = None
    return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _doc_seeds(lengths: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        rows: list[tuple[int, int, int]] = []
        seeds: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids, marks, at = list(zip(*rows)) or [[]] * 3
            cols = [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(at, pa.int32()), _lists(seeds, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "at", "seeds"])

        for batch in batches:
            for doc, mark, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                at = 0
                for body in readable(value.as_py()):
                    for words, _ in readings(body):
                        hashes = word_hashes(words, memo)
                        for k in lengths:
                            if len(found := windows(hashes, k)):
                                rows.append((doc, mark, at))
                                seeds.append(found)
                                held += len(found)
                        at += len(words) + 1  # no run goes on from one reading to the next
                if held >= CHUNK_SEEDS:
                    yield flush()
                    rows, seeds, held = [], [], 0
        yield flush()

    return run


def _item_rows(share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            out = []
            for item, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                for v, (words, weights) in enumerate(readings(text)):
                    if words:
                        each = weights or [1] * len(words)
                        k = seed_words(each, share)
                        fewest = least_run(each, share) - k + 1
                        out.append((item, mark, v, k, fewest, len(words), sum(each), weights, windows(word_hashes(words, memo), k).tolist()))
            cols = list(zip(*out)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["item_id", "own", "v", "k", "fewest", "tokens", "words", "weights", "seeds"])

    return run


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = {name: i for i, name in enumerate(batch.schema.names)}
        hits = batch.column(at["hits"])
        flat = hits.flatten()
        places = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist()))
        ends = [0, *accumulate(hits.value_lengths().to_pylist())]
        tiled, longest = [], []
        rest = (batch.column(at[c]).to_pylist() for c in ("k", "tokens", "weights"))
        for i, (k, tokens, weights) in enumerate(zip(*rest)):
            found = tiles_of(runs_of(places[ends[i] : ends[i + 1]], k), weights, tokens, k)
            tiled.append(sum(t[3] for t in found))
            longest.append(max(t[3] for t in found))
        cols = [batch.column(at[c]) for c in ("doc_id", "mark", "item_id", "own", "v", "words")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(tiled, pa.int32()), pa.array(longest, pa.int32())], ["doc_id", "mark", "item_id", "own", "v", "words", "tiled", "longest"])


def _tiled(docs: DataFrame, items: DataFrame, share: float, unbroken: bool) -> DataFrame:
    """(doc_id, item_id, tiled, longest, words) of the documents and items that share seeds.

    unbroken leaves out pairs with fewer shared seeds than a run of `share` of the item has; they can't hold one.
    """
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.xxhash64("text").alias("own"), "text").distinct()
    ddl = "item_id long, own long, v int, k int, fewest int, tokens int, words int, weights array<int>, seeds array<long>"
    rows = cut(known.mapInArrow(_item_rows(share), ddl))
    lengths = [r["k"] for r in rows.select("k").distinct().collect()]  # at most SEED_WORDS numbers
    seeds = rows.select("item_id", "own", "v", F.posexplode("seeds").alias("p", "seed"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    at = texts.mapInArrow(_doc_seeds(lengths), "doc_id long, mark long, at int, seeds array<long>")
    at = at.select("doc_id", "mark", "at", F.posexplode("seeds").alias("q", "seed"))
    hits = at.join(sized(seeds), "seed").select("doc_id", "mark", "item_id", "own", "v", (F.col("at") + F.col("q")).alias("q"), "p")
    pairs = hits.groupBy("doc_id", "mark", "item_id", "own", "v").agg(F.collect_list(F.struct("q", "p")).alias("hits"))
    pairs = pairs.join(sized(rows.drop("seeds"), 20_000), ["item_id", "own", "v"])
    if unbroken:
        pairs = pairs.where(F.size("hits") >= F.col("fewest"))
    found = pairs.drop("fewest").mapInArrow(_tile, "doc_id long, mark long, item_id long, own long, v int, words int, tiled int, longest int")
    best = found.groupBy("doc_id", "mark", "item_id", "own").agg(F.max("tiled").alias("tiled"), F.max("longest").alias("longest"), F.max("words").alias("words"))
    return best.drop("mark", "own")


def _enough(words: str, share: float) -> Column:
    return F.col(words) >= F.ceil(F.col("words") * share - 1e-9)


def passages(docs: DataFrame, items: DataFrame, share: float = 0.4) -> DataFrame:
    """(doc_id, item_id, tiled, longest, words, covered) of the documents and items that share seeds of words.

    tiled counts the item's words in non-overlapping matches, so that reordered passages count, over all parts of the
    document; longest those in the longest unbroken run; covered says whether tiled reaches `share` of the item.

    Every item of any number has its seeds, the hashes of all its windows of SEED_WORDS words (of fewer, if `share` of
    it is a shorter run), and so has every document, at every word. They meet in one join, in one pass over the corpus;
    the items' seeds are broadcast if they are few enough, else both sides are shuffled by seed. Shared seeds of a
    document and an item that follow each other make its matches, which greedy string tiling takes longest first.
    Matches are exact up to the equality of 64-bit hashes. Texts are read whole, as they are and without apostrophes
    inside words; parts that don't declare their coding as stored and decoded. NULL or empty texts and items have no
    rows; equal documents of one doc_id and equal items count once, differing ones each; other columns are ignored.
    """
    return _tiled(docs, items, share, unbroken=False).withColumn("covered", _enough("tiled", share))


def leaked(docs: DataFrame, items: DataFrame, share: float = 0.4) -> DataFrame:
    """(doc_id, item_id): at least `share` of the item's words stand in one unbroken run of the document, so one of the
    tiles of `passages` has as many words."""
    return _tiled(docs, items, share, unbroken=True).where(_enough("longest", share)).select("doc_id", "item_id").distinct()
