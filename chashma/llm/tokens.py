"""Encoding a corpus with a public byte-level tokenizer, each distinct pre-token once, and decoding it.

Plan: every task splits its texts into pre-tokens and keeps them as blocks: the distinct pre-tokens of
at most `block_chars` characters of text, and for each text the positions as indexes into that list. A
block is what is shuffled instead of single occurrences, so a frequent word moves once per block.
Then: distinct words of all blocks -> encoded once each -> joined back to the blocks' words -> one row
per block -> ids put together by position. A text longer than `block_chars` is a block of its own.
Decoding goes the same way: the distinct ids of each block are joined with the token-byte table.

Defined cases: an empty or null text gives an empty list; each input row gives one output row, also when ids repeat or are null;
strings that look like special tokens are ordinary text; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chashma.plans.lineage import staged

#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_CHARS = 1_000_000
_BLOCKS = "block string, doc_ids array<bigint>, lens array<int>, idx array<int>, words array<string>"


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary file as bytes -> id; its size is fixed (about 50,000 entries)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _blocks(pattern: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        part, n = TaskContext.get().partitionId(), 0
        ids: list = []
        lens: list = []
        idx: list = []
        words: dict = {}
        chars = 0

        def block() -> pa.RecordBatch:
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{n}"]), one(ids, pa.int64()), one(np.array(lens, np.int32), pa.int32()), one(np.array(idx, np.int32), pa.int32()), one(list(words), pa.string())],
                ["block", "doc_ids", "lens", "idx", "words"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(text or "")
                if chars and chars + size > block_chars:
                    yield block()
                    ids, lens, idx, words, chars, n = [], [], [], {}, 0, n + 1
                pieces = find(text) if text else ()
                at = len(words)
                for piece in pieces:
                    k = words.setdefault(piece, at)
                    if k == at:
                        at += 1
                    idx.append(k)
                ids.append(doc)
                lens.append(len(pieces))
                chars += size + 8
        if ids:
            yield block()

    return run


def _encoder(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # each word is a pre-token already
        encode = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([encode(w) for w in words.to_pylist()], pa.list_(pa.int32()))], ["word", "word_ids"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = lambda name: batch.column(name)[row].values  # noqa: E731, B023
            spelt = one("spelt")
            at, ids = spelt.field("at").to_numpy(zero_copy_only=False), spelt.field("word_ids")
            # the struct's list column may be a slice; flatten() drops what lies outside of it
            sizes = np.zeros(len(at), np.int64)
            starts = np.zeros(len(at), np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            size = ids.value_lengths().to_numpy(zero_copy_only=False)
            sizes[at], starts[at] = size, np.cumsum(size) - size
            idx, lens = one("idx").to_numpy(zero_copy_only=False), one("lens").to_numpy(zero_copy_only=False)
            each = sizes[idx]
            ends = np.cumsum(each)
            total = int(ends[-1]) if len(ends) else 0
            out = flat[np.repeat(starts[idx] - (ends - each), each) + np.arange(total)] if total else np.zeros(0, np.int32)
            pieces_end = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            offsets = np.concatenate([[0], ends])[pieces_end].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [one("doc_ids"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.astype(np.int32), pa.int32()))], ["doc_id", "ids"]
            )


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = SPLIT_PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, ids) for each row of `df`: the ids of its text without special tokens."""
    spark = df.sparkSession
    texts = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text"))
    blocks = staged(texts.mapInArrow(_blocks(pattern, block_chars), _BLOCKS), "pretokens")
    used = blocks.select("block", F.posexplode("words").alias("at", "word"))
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    coded = used.select("word").distinct().mapInArrow(_encoder(ranks), "word string, word_ids array<int>")
    # at most one row per block and word: a word in every text is joined once per block, and skewed partitions are split
    spelt = used.join(coded.hint("shuffle_merge"), "word").groupBy("block").agg(F.collect_list(F.struct("at", "word_ids")).alias("spelt"))
    whole = blocks.select("block", "doc_ids", "lens", "idx").join(spelt, "block", "left").withColumn("spelt", F.coalesce("spelt", F.array().cast(spelt.schema["spelt"].dataType)))
    return whole.drop("block").mapInArrow(_assemble, "doc_id bigint, ids array<int>")


def token_bytes(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """The token-byte table: one row (token_id, token_bytes) for each entry of the vocabulary file."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in read_ranks(vocabulary).items()], "token_id int, token_bytes binary")


_ID_BLOCKS = "block string, doc_ids array<bigint>, lens array<int>, idx array<int>, tokens array<int>"


def _id_blocks(block_ids: int):
    """Blocks of at most `block_ids` ids: the distinct ones, and for each row the positions as indexes into them; a row of null ids has length -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            lens = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(lens, 0))
            lo = 0
            while lo < len(lens):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + block_ids, "right")))
                tokens, idx = np.unique(batch.column(1)[lo : hi].flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{n}"]), one(batch.column(0)[lo:hi].to_pylist(), pa.int64()), one(lens[lo:hi].astype(np.int32), pa.int32()), one(idx.astype(np.int32), pa.int32()), one(tokens.astype(np.int32), pa.int32())],
                    ["block", "doc_ids", "lens", "idx", "tokens"],
                )
                lo, n = hi, n + 1

    return run


def _join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            known = {x["at"]: x["token_bytes"] for x in row["spelt"]}
            texts, at = [], 0
            for n in row["lens"]:
                texts.append(None if n < 0 else b"".join([known[i] for i in row["idx"][at : at + n]]).decode("utf-8", "replace"))
                at += max(n, 0)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_corpus(encoded: DataFrame, vocabulary: str = VOCABULARY, block_ids: int = BLOCK_CHARS // 4) -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give null. An id that the vocabulary does not have is an error."""
    blocks = staged(encoded.select("doc_id", "ids").mapInArrow(_id_blocks(block_ids), _ID_BLOCKS), "ids")
    used = blocks.select("block", F.posexplode("tokens").alias("at", "token_id"))
    spelt = used.join(token_bytes(encoded.sparkSession, vocabulary), "token_id").groupBy("block").agg(F.collect_list(F.struct("at", "token_bytes")).alias("spelt"))
    whole = blocks.select("block", "doc_ids", "lens", "idx").join(spelt, "block", "left").withColumn("spelt", F.coalesce("spelt", F.array().cast(spelt.schema["spelt"].dataType)))
    return whole.drop("block").mapInArrow(_join_bytes, "doc_id bigint, text string")
