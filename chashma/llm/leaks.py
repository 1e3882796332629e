"""Held-out test items standing in corpus texts, fully or partly, by spaced-seed hashing.

A mask selects some of `SPAN` neighbouring words and ignores the rest; equal hashes of the selected words
in a text and an item are a hit, even if ignored words differ. Around each hit the words of both
are compared along its diagonal, which gives the exact run and the substitution-tolerant overlap.
The masks hit every stretch of `SPAN` or more words of which three quarters are equal, wherever the others
stand: a longer stretch has a part of 10 to 19 words with that share, and all of these are enumerated in the tests.

The items are taken in blocks of at most `BLOCK_CHARS` characters of text. Of each block the words' numbers and the sorted seeds
are made once, as arrays, and sent to all executors, where the seeds of the corpus are joined with them; the hits of all
blocks are put together. So what is sent has a fixed bound, and any number of items goes the same way.

Defined cases: null or wordless texts contain nothing; repeated items or documents of one id count once;
texts of any length are scanned whole; items of fewer than `SPAN` words cannot be found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Selected offsets of each mask; all fit into ten words. No masks of seven or more offsets hit all stretches.
SPAN = 10
MASKS = (
    (0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 2, 3, 5, 8), (0, 1, 2, 3, 7, 9), (0, 1, 2, 4, 5, 6), (0, 1, 2, 4, 5, 7),
    (0, 1, 3, 4, 5, 6), (0, 1, 3, 5, 8, 9), (0, 1, 4, 5, 6, 7), (0, 1, 4, 6, 7, 8), (0, 1, 4, 6, 8, 9), (0, 3, 4, 5, 6, 7),
)
#: Odd multipliers, one for each offset.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)
MARKS = "'`´‘’ʻʼ"
#: A word gives twelve seeds of 16 bytes, so a block sends some 60 MB at most; an item longer than this is a block of its own.
BLOCK_CHARS = 2_000_000
TOLERANCE = 0.75

_WORDS = regex.compile(r"[\p{L}\p{N}]+")
FOUND = "doc_id bigint, item_id bigint, longest_run int, overlap_words int, matched_words int, doc_word int, item_word int"


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    for mark in MARKS:
        text = text.replace(mark, "")
    return _WORDS.findall(text)


def seed_hashes(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each mask: the positions where a window starts whose selected words are all known (id > 0), and the hashes there."""
    if len(ids) < SPAN:
        return
    known = ids > 0
    for k, mask in enumerate(MASKS):
        n = len(ids) - mask[-1]
        good = known[mask[0] : mask[0] + n].copy()
        for o in mask[1:]:
            good &= known[o : o + n]
        at = np.flatnonzero(good)
        h = np.full(len(at), k + 1, np.uint64)
        for o in mask:
            h = (h ^ (ids[at + o].astype(np.uint64) * _MULTIPLIERS[o])) * _MULTIPLIERS[0]
            h ^= h >> np.uint64(29)
        yield at, h.astype(np.int64)


def compare(doc: np.ndarray, item: np.ndarray, diagonal: int, tolerance: float) -> tuple[int, int, int, int, int]:
    """Along one diagonal (doc position minus item position): longest exact run, words of the best overlap, of them equal, its starts in both.

    The overlap is the stretch with the largest sum of `1 - tolerance` for an equal and `-tolerance` for a
    different word, so that stretches of at least the tolerated share of equal words are kept whole; of equal
    sums the longest. Stretches of `SPAN` or more words with that share, from an equal word to an equal word, go before shorter ones.
    """
    a = max(0, -diagonal)
    b = min(len(item), len(doc) - diagonal)
    same = (doc[a + diagonal : b + diagonal] == item[a:b]) & (item[a:b] > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - tolerance, -tolerance))])
    starts, ends = np.where(same, sums[:-1], np.inf), np.where(same, sums[1:], -np.inf)
    for least in (SPAN, 1):
        over = ends[least - 1 :] - np.minimum.accumulate(starts)[: max(0, b - a - least + 1)]
        if len(over) and over.max() >= 0:
            end = len(over) - 1 - int(np.argmax(over[::-1])) + least
            start = int(np.argmin(starts[: end - least + 1]))
            break
    else:
        start = end = 0
    return run, end - start, int(same[start:end].sum()), a + diagonal + start, a + start


def _joined(a: tuple, b: tuple) -> tuple:
    """Of two diagonals of a text and an item: the longer run and, apart from it, the better overlap with its place."""
    return (max(a[0], b[0]), *max(a[1:], b[1:]))


def index(items: list[tuple[int, str]]) -> dict:
    """What a block of items is found by: numbers of its words, its texts as numbers, and the seeds of all of them, sorted, with text and place."""
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in items]
    seeds, whose, where = [], [], []
    for k, ids in enumerate(texts):
        for at, h in seed_hashes(ids):
            seeds.append(h)
            whose.append(np.full(len(at), k, np.int32))
            where.append(at.astype(np.int32))
    seeds, whose, where = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, whose, where))
    order = np.argsort(seeds, kind="stable")
    return {"words": vocabulary, "ids": [i for i, _ in items], "texts": texts, "seeds": seeds[order], "whose": whose[order], "where": where[order]}


def blocks_of(items: Iterator, chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for i, text in items:
        if block and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    if block:
        yield block


def _scan(held, tolerance: float):
    """Texts against one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, own, texts, seeds, whose, where = (held.value[k] for k in ("words", "ids", "texts", "seeds", "whose", "where"))
        get = get.get
        for batch in batches:
            docs, starts, flat = [], [], []
            gap = [0] * SPAN
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                starts.append(len(flat))
                flat += [get(w, 0) for w in words_of(text)]
                flat += gap  # no window reaches into the next text
            ids, starts = np.array(flat, np.int64), np.array(starts + [len(flat)], np.int64)
            found: dict[tuple, tuple] = {}
            seen = set()
            for at, h in seed_hashes(ids):
                left = np.searchsorted(seeds, h, "left")
                many = np.searchsorted(seeds, h, "right") - left
                hit = np.flatnonzero(many)
                for p, lo, n in zip(at[hit].tolist(), left[hit].tolist(), many[hit].tolist()):
                    d = int(np.searchsorted(starts, p, "right")) - 1
                    for s in range(lo, lo + n):
                        key = (d, int(whose[s]), p - int(starts[d]) - int(where[s]))
                        if key in seen:
                            continue
                        seen.add(key)
                        words = ids[starts[d] : starts[d + 1] - SPAN]
                        got = compare(words, texts[key[1]], key[2], tolerance)
                        pair = (docs[d], own[key[1]])
                        found[pair] = _joined(found[pair], got) if pair in found else got
            rows = [(*k, *v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64() if j < 2 else pa.int32()) for j in range(7)], FIELDS)

    return run


FIELDS = [x.split()[0] for x in FOUND.split(", ")]


def find_leaks(corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each document and item with a hit: longest exact run of all diagonals, best tolerant overlap of all diagonals, and where that starts."""
    context = corpus.sparkSession.sparkContext
    docs = corpus.select(corpus[id_col].cast("bigint").alias("doc_id"), corpus[text_col].alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    tests = items.select(items[item_col].cast("bigint").alias("item_id"), items[item_text_col].alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL").dropDuplicates(["item_id", "item_text"])
    hits = corpus.sparkSession.createDataFrame([], FOUND)
    for block in blocks_of(tests.toLocalIterator(), block_chars):
        hits = hits.unionAll(docs.mapInArrow(_scan(context.broadcast(index(block)), tolerance), FOUND))
    best = F.max(F.struct("overlap_words", "matched_words", "doc_word", "item_word")).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), best).select("doc_id", "item_id", "longest_run", "best.*")
