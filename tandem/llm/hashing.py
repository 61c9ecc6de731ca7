"""Words and character n-grams of many texts at once, as numbers in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack(texts: list[bytes], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, buffer)``: texts joined to buffers of about ``limit`` bytes, each byte with the text it is of.

    A longer text is cut at white space, so that memory does not depend on its length; each text is
    framed by spaces.
    """
    rows, parts, size = [], [], 0

    def close():
        sizes = [len(p) + 1 for p in parts]
        return np.repeat(np.array(rows), sizes), np.frombuffer(b" ".join(parts) + b" ", np.uint8)

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + limit)
            if end < len(text):
                space = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r"))
                end = space if space > at else end
            rows.append(i)
            parts.append(text[at:end])
            size += end - at
            at = end
            if size >= limit:
                yield close()
                rows, parts, size = [], [], 0
    if parts:
        yield close()


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def word_codes(buffer: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, below ``2**bits``, and the place of its first byte."""
    space = _SPACES[buffer]
    before = np.concatenate([[True], space[:-1]])
    first = np.flatnonzero(~space & before)
    if not len(first):
        return np.zeros(0, np.int64), first
    place = np.arange(len(buffer), dtype=np.int64)
    since = place - np.repeat(first, np.diff(np.append(first, len(buffer))), axis=0) if first[0] == 0 else None
    if since is None:
        starts = np.concatenate([[0], first])
        since = place - np.repeat(starts, np.diff(np.append(starts, len(buffer))))
    powers = (since.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    values = np.where(space, np.uint64(0), (buffer.astype(np.uint64) + np.uint64(1)) * (powers ^ (powers >> np.uint64(31))))
    return _mixed(np.add.reduceat(values, first), bits), first


def gram_codes(buffer: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` bytes from each place on that is no white space, and the place; short at the buffer's end."""
    wide = np.concatenate([buffer, np.full(n, 32, np.uint8)]).astype(np.uint64)
    value = np.zeros(len(buffer), np.uint64)
    for k in range(n):
        value = value << np.uint64(8) | wide[k : k + len(buffer)]
    place = np.flatnonzero(~_SPACES[buffer])
    return _mixed(value[place] + np.uint64(n), bits), place
