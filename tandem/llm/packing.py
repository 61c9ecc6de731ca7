"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.session import shuffled, staged

SEQUENCE_TOKENS, CLOSING_ID, GROUP_PIECES = 1024, 0, 16_384
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable character a byte-level vocabulary writes for each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable}
    return shown | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


def load_encoder(path: str) -> tiktoken.Encoding:
    """Encoder with the ids of the tokenizer file, whose merges are numbered in their order.

    The vocabulary is read from that file; the faster library gives the same ids for every text,
    special tokens spelled out in a text included.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Encoder:
    """Loaded once in a worker."""

    held: dict[str, tiktoken.Encoding] = {}

    @classmethod
    def ids(cls, path: str, text: str | None, part: int = 100_000) -> Iterator[np.ndarray]:
        if path not in cls.held:
            cls.held[path] = load_encoder(path)
        encoding, text = cls.held[path], text or ""
        at = 0
        while at < len(text):
            end = min(len(text), at + part)
            if end < len(text):
                end = safe_cut(text, at, end)
            yield encoding.encode_to_numpy(text[at:end], allowed_special="all")
            at = end
        yield np.array([CLOSING_ID], np.uint32)


def safe_cut(text: str, low: int, high: int) -> int:
    """A place before a space that follows an ASCII letter and is followed by one: no token spans it. The text's end if there is none."""
    at = text.rfind(" ", low + 1, high)
    while at > low:
        if at + 1 < len(text) and text[at - 1].isascii() and text[at - 1].isalpha() and text[at + 1].isascii() and text[at + 1].isalpha():
            return at
        at = text.rfind(" ", low + 1, at)
    at = high
    while (at := text.find(" ", at)) >= 0:
        if 0 < at < len(text) - 1 and text[at - 1].isascii() and text[at - 1].isalpha() and text[at + 1].isascii() and text[at + 1].isalpha():
            return at
        at += 1
    return len(text)


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """All ids of a text, the closing id included. A long text is encoded in parts cut where no token can span."""
    return np.concatenate(list(_Encoder.ids(path or public_path(), text))).astype("<u4")


def token_pieces(docs: DataFrame, path: str | None = None, tokens: int = SEQUENCE_TOKENS, keep: tuple[str, ...] = ("doc_id",),
                 with_ids: bool = False) -> DataFrame:
    """``keep, start, length, ids_crc32, doc_tokens``: each document's ids cut into whole sequences and one rest.

    ``with_ids`` adds the ids themselves as little-endian 32-bit binary. Texts stay in their task; only
    the pieces leave it.
    """
    path = path or public_path()
    kind = "array<struct<start: long, length: long, ids_crc32: long, doc_tokens: long" + (", ids: binary" if with_ids else "") + ">>"

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for text in batch:
                ids = token_ids(text, path)
                row = []
                for start in range(0, len(ids), tokens):
                    raw = ids[start : start + tokens].tobytes()
                    piece = {"start": start, "length": len(raw) // 4, "ids_crc32": zlib.crc32(raw), "doc_tokens": len(ids)}
                    row.append(piece | {"ids": raw} if with_ids else piece)
                rows.append(row)
            yield pd.Series(rows)

    cells = docs.select(*dict.fromkeys([*keep, "text"])).select(*keep, F.explode(cut("text")).alias("_piece"))
    return cells.select(*keep, "_piece.*")


class Tournament:
    """Bins in order of opening; each inner node knows the largest room below it, so the first bin with enough room is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin that has room: the bin and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each size, none above ``capacity``; the largest are placed first, ties in the order given."""
    tree = Tournament(max(1, len(sizes)), capacity)
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_, had = tree.place(sizes[i])
        placed[i] = (bin_, capacity - had)
    return placed


def padded_length(tokens: int, capacity: int = SEQUENCE_TOKENS) -> int:
    """Length of the written sequence: a power of two stays as it is, anything else is padded to the capacity."""
    return tokens if tokens & (tokens - 1) == 0 else capacity


def pack_documents(docs: DataFrame, path: str | None = None, tokens: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, then ``sequence_tokens, padded_tokens``.

    Documents are cut only where they are longer than a sequence. Whole sequences are complete as they
    are; the rests are numbered, dealt at random (by a hash of that number) into groups of about
    ``group_pieces`` and packed group by group. Pieces are written once, so numbers and groups stay the
    same when a task runs again. A sequence is named by the number of one of its pieces.

    Defined results: a null or empty text is its closing id alone; repeated rows and repeated or null ids are
    packed each on their own; an empty table gives no pieces; other columns are not read.
    """
    cut = token_pieces(docs, path, tokens, with_ids=with_ids)
    pieces = staged(cut.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    rests = pieces.where(F.col("length") < tokens)
    groups = max(1, -(-rests.count() // group_pieces))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_piece", ignore_index=True)
        placed = np.array(first_fit_decreasing(rows["length"].tolist(), tokens), np.int64).reshape(-1, 2)
        bins = placed[:, 0]
        names = rows.groupby(bins)["_piece"].transform("min")
        return pd.DataFrame({"_piece": rows["_piece"], "sequence_id": names, "offset": placed[:, 1],
                             "sequence_tokens": rows.groupby(bins)["length"].transform("sum")})

    group = F.pmod(F.xxhash64("_piece"), F.lit(groups))
    packed = rests.select("_piece", "length", group.alias("_group")).groupBy("_group").applyInPandas(
        pack, "_piece long, sequence_id long, offset long, sequence_tokens long")
    whole = pieces.where(F.col("length") == tokens).select(
        "*", F.col("_piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_tokens"))
    found = whole.unionByName(rests.join(shuffled(packed), "_piece"))
    size = F.col("sequence_tokens")
    padded = F.when(F.bit_count(size) == 1, size).otherwise(F.lit(tokens).cast("long"))
    shown = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
    return found.select(*shown, padded.alias("padded_tokens"), *(["ids"] if with_ids else []))
