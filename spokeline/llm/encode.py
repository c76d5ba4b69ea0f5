"""Encoding of a corpus with a public byte-level BPE tokenizer by one global shuffle of distinct words.

Texts are cut into pre-tokens (the tokenizer's own pattern), whose ids don't depend on their neighbours.
A few texts that follow one another form a block of up to ``BLOCK`` pre-tokens; it sends each of its distinct
words once, with its positions packed in bytes. Each distinct word of the corpus is encoded once; ids are
joined back by word, and every block is put together again in order of position.

The counts of the words, known from the distinct step, single out the words that occur in more than 1/HOT of
all rows, at most ``HOT`` of them: their ids are broadcast, since a word that is in every block would crowd
one task of the join.

Null and empty texts have the ids ``[]``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeline.session import Scratch

HOT = 1000
BLOCK = 60_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _encoding(path: str):
    """The tokenizer of a rank file and its compiled pattern, once per Python worker."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(public_tokenizers.PATTERN)


def pre_tokens(docs: DataFrame, doc: str, text: str, path: str) -> DataFrame:
    """(block, word, at BINARY, docs, sizes): the distinct pre-tokens of every block with their positions.

    A row with a null word lists the block's documents and their numbers of pre-tokens, in order; so
    repeated document ids stay apart. Positions are packed as 16-bit numbers, in blocks of one longer
    text as 32-bit ones.
    """
    kind = docs.schema[doc].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _encoding(path)[1].findall
        block = TaskContext.get().partitionId() << 33
        places: dict[str, list[int]] = {}
        ids: list = []
        sizes: list[int] = []
        types = None

        def out() -> pa.RecordBatch:
            n = len(places) + 1
            width = np.uint16 if sum(sizes) <= 65_536 else np.uint32
            arrays = [
                pa.array(np.full(n, block)), pa.array([None, *places], pa.string()),
                pa.array([None, *(np.array(p, dtype=width).tobytes() for p in places.values())], pa.binary()),
                pa.array([ids] + [None] * (n - 1), pa.list_(types)), pa.array([sizes] + [None] * (n - 1), pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "word", "at", "docs", "sizes"])

        done = 0
        for batch in batches:
            types = batch.schema.field(doc).type
            for name, t in zip(batch[doc].to_pylist(), batch[text].to_pylist()):
                words = find(t) if t else []
                if ids and done + len(words) > BLOCK:
                    yield out()
                    block, done, places, ids, sizes = block + 1, 0, {}, [], []
                for w in words:
                    places.setdefault(w, []).append(done)
                    done += 1
                ids.append(name)
                sizes.append(len(words))
        if ids:
            yield out()

    return docs.select(doc, text).mapInArrow(cut, f"block bigint, word string, at binary, docs array<{kind}>, sizes array<int>")


def word_ids(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids BINARY) of the distinct words: each is encoded once, into 32-bit ids."""

    @F.pandas_udf("binary")
    def ids(column: pd.Series) -> pd.Series:
        encoding = _encoding(path)[0]
        return pd.Series([np.array(encoding.encode_ordinary(w), dtype="<u4").tobytes() for w in column], dtype="object")

    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("ids", ids("word"))


def join_words(rows: DataFrame, words: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` (with a word) with ``columns`` of ``words`` (word, n, ...): hot words by broadcast."""
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = scratch.keep(words.where(F.col("n") > max(1000, total / HOT)).select(F.col("word").alias("hw"), *[F.col(c).alias(f"h_{c}") for c in columns], F.lit(True).alias("is_hot")))
    marked = rows.join(F.broadcast(hot), F.col("word") == F.col("hw"), "left")
    done = marked.where("is_hot").select(*rows.columns, *[F.col(f"h_{c}").alias(c) for c in columns])
    rest = marked.where("is_hot is null").select(*rows.columns)
    return done.unionByName(rest.join(words.select("word", *columns), "word"))


def encode_corpus(docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc, ids ARRAY<INT>) of every row of ``docs``; rows with equal or null ids each keep their own."""
    path = path or tokenizer_path()
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(pre_tokens(docs, doc, text, path))
    wordy = rows.where("word is not null").select("block", "word", "at")
    words = scratch.keep(word_ids(wordy, path))
    joined = join_words(wordy, words, ["ids"], scratch).select("block", "at", "ids", F.lit(None).cast(rows.schema["docs"].dataType).alias("docs"), F.lit(None).cast("array<int>").alias("sizes"))
    heads = rows.where("word is null").select("block", "at", F.lit(None).cast("binary").alias("ids"), "docs", "sizes")
    entry = F.when(F.col("at").isNotNull(), F.struct("at", "ids"))
    blocks = joined.unionAll(heads).groupBy("block").agg(F.collect_list(entry).alias("e"), F.first("docs", True).alias("docs"), F.first("sizes", True).alias("sizes"))
    blocks = blocks.select("docs", "sizes", F.col("e.at").alias("at"), F.col("e.ids").alias("ids"))
    kind = docs.schema[doc].dataType.simpleString()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, sizes = batch["docs"][k].values, np.array(batch["sizes"][k].as_py(), dtype=np.int64)
                total = int(sizes.sum())
                places = [np.frombuffer(p, dtype="<u2" if total <= 65_536 else "<u4").astype(np.int64) for p in batch["at"][k].as_py()]
                found = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in batch["ids"][k].as_py()]
                length = np.zeros(total, dtype=np.int64)
                for p, x in zip(places, found):
                    length[p] = len(x)
                starts = np.concatenate([[0], np.cumsum(length)])
                flat = np.empty(starts[-1], dtype=np.int32)
                for p, x in zip(places, found):
                    for j, token in enumerate(x):
                        flat[starts[p] + j] = token
                offsets = starts[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[doc, "ids"])

    return blocks.mapInArrow(assemble, f"`{doc}` {kind}, ids array<int>")


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> pa.Array:
    """The token-byte table of a rank file: the bytes of token k at place k, null where no token has that number."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return pa.array([ranks.get(k) for k in range(max(ranks) + 1)], pa.large_binary())


def decode_corpus(encoded: DataFrame, doc: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc, text) of every row: the bytes of its tokens, joined from the token-byte table, in order.

    The table has the vocabulary's size and tokens are its row numbers, so that the join is a lookup in every
    batch: no shuffle, one row out for each row in, whatever its id (null and repeated ones too). Null and
    empty lists give an empty text. A null or unknown token is an error; bytes that are no UTF-8 become the replacement character.
    """
    path = path or tokenizer_path()
    kind = encoded.schema[doc].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(path)
        for batch in batches:
            lists = batch[ids]
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            if flat.null_count or (len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(table))):
                raise ValueError("a token is null or not in the table")
            found = table.take(flat)
            if found.null_count:
                raise ValueError("a token is not in the table")
            ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[: len(found) + 1] if len(found) else np.zeros(1, dtype=np.int64)
            data = found.buffers()[2].to_pybytes() if len(found) else b""
            at = ends[np.concatenate([[0], np.cumsum(sizes)])]
            texts = pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch[doc], texts], names=[doc, "text"])

    return encoded.select(doc, ids).mapInArrow(decode, f"`{doc}` {kind}, text string")
