"""Byte-level BPE: encoding with a priority queue of merge ranks over a linked list of symbols, decoding by vocabulary strings."""

from __future__ import annotations

import codecs
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.packing import PATTERN, byte_symbols, public_path

#: Characters a text is cut into words at a time, words remembered by a worker, and the longest word it remembers.
BLOCK_CHARS, REMEMBERED, REMEMBERED_CHARS = 200_000, 500_000, 64
_ROWS = 200


class Codec:
    """Vocabulary and merges of a byte-level tokenizer file, with the special strings that stand for one id each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, kind = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space"):
            raise ValueError("only plain byte-level files are read")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.ids_by_rank = [vocab[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.byte_ids = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in (vocab | self.special).items()}
        self.strings = [strings.get(i, "") for i in range(max(strings, default=-1) + 1)]
        by_byte = {b: c for c, b in symbols.items()}
        self.to_bytes = codecs.charmap_build("".join(by_byte[b] for b in range(256)))
        self.words = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost among equals.

        Symbols form a doubly linked list by place; a merge keeps the left place and unlinks the right one. The
        queue holds rank and place, as one number, of neighbours that can merge. An entry whose neighbours have changed since is
        stale: its place is unlinked or its pair has another rank; it is skipped.
        """
        rank_of, ids_by_rank, end = self.rank_of.get, self.ids_by_rank, len(symbols)
        push, pop = heapq.heappush, heapq.heappop
        # the closing -1 is the neighbour of both ends; like an unlinked place it is in no pair
        ids, before, after = [*symbols, -1], list(range(-1, end)), list(range(1, end + 1))
        queue = [rank * end + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := rank_of(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i, rank = entry % end, entry // end
            j = after[i]
            if rank_of((ids[i], ids[j])) != rank:
                continue
            now = ids[i] = ids_by_rank[rank]
            ids[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if (rank := rank_of((now, ids[k]))) is not None:
                push(queue, rank * end + i)
            k = before[i]
            if (rank := rank_of((ids[k], now))) is not None:
                push(queue, rank * end + k)
        return [x for x in ids if x >= 0]

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def word_ids(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit numbers; short words are remembered."""
        ids = self.seen.get(word)
        if ids is None:
            ids = self.packed(self.merged([self.byte_ids[b] for b in word.encode("utf-8", "replace")]))
            if len(word) <= REMEMBERED_CHARS:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = ids
        return ids

    def split(self, text: str, block: int = BLOCK_CHARS) -> Iterator[list[str]]:
        """The words of a text, block by block.

        The last two words before a block's end could go on beyond it, so they are left to the next
        block; a block of fewer than three words is read again at twice the length.
        """
        at, size = 0, block
        while at < len(text):
            end = at + size
            words = self.words.findall(text, at, end)
            if end < len(text):
                if len(words) < 3:
                    size *= 2
                    continue
                words = words[:-2]
            yield words
            at, size = at + sum(map(len, words)), block

    def encode(self, text: str, block: int = BLOCK_CHARS) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; a special string is its own id."""
        out, seen, word_ids = [], self.seen, self.word_ids
        for part in self.parts.split(text) if self.parts else (text,):
            if part in self.special:
                out.append(self.packed([self.special[part]]))
                continue
            for words in self.split(part, block):
                out.append(b"".join([seen.get(w) or word_ids(w) for w in words]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, joined and read as bytes; bytes that are no UTF-8 give the replacement character."""
        strings, n = self.strings, len(self.strings)
        joined = "".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n])
        return codecs.charmap_encode(joined, "strict", self.to_bytes)[0].decode("utf-8", "replace")


_held: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """Loaded once in a worker."""
    if path not in _held:
        _held[path] = Codec(path)
    return _held[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document: its ids, and the text they give back.

    Row-local, without a shuffle. A text is cut into words block by block, so besides the text and its ids a task holds
    one block of words; results leave it after ``_ROWS`` texts. A word of any length takes time in proportion to its length times its logarithm.

    Defined results: a null or empty text has no ids; repeated rows are encoded each; an empty table
    gives no rows; a null id is kept; other columns are not read.
    """
    path = path or public_path()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = codec(path)
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                ids = [held.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(held.decode, ids), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(code, "doc_id long, n_tokens long, ids binary, decoded string")


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` of rows of ``doc_id, ids``; null ids give an empty text, ids outside the vocabulary nothing."""
    path = path or public_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = codec(path)
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                texts = [held.decode(i or b"") for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, decoded string")
