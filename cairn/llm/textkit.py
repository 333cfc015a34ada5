"""Word and shingle hashes of whole texts, computed on arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
#: Bytes hashed at a time, and bytes of text handled at a time unless one text is longer.
PIECE, SLICE = 1 << 20, 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash so that every bit depends on every other."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


GOLD, STEP = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
STEPS = np.arange(1, 4, 2, dtype=U) * STEP
#: Keeps the first 0 to 8 bytes of a little-endian block.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U)


SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but letters, digits and bytes of non-ASCII letters.
MARKS = np.zeros(256, dtype=bool)
MARKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def slices(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, encoded texts) of at most SLICE bytes, or of one longer text."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode() if isinstance(t, str) else b""
        if held and size + len(raw) > SLICE:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def words(raw: list[bytes], gaps: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and where each text's words begin (and the last end).

    A word's blocks of 8 bytes are mixed, each with its place, and added up; the sum is mixed with the length. Words of
    at most 8 bytes and equal length never share a hash.
    """
    blob = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(8), dtype=np.uint8)
    turns = np.diff(np.concatenate(([1], gaps[blob[:-8]].view(np.int8))))
    starts, ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1)))
    blob = FOLD[blob] if fold else blob
    eight = np.lib.stride_tricks.as_strided(blob.view(np.uint8), (len(blob) - 7, 8), (1, 1))
    out, at, sizes = np.empty(len(starts), dtype=U), 0, ends - starts
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        n = sizes[at:to]
        blocks = (n + 7) >> 3
        first = np.cumsum(blocks) - blocks
        j = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        values = eight[np.repeat(starts[at:to], blocks) + 8 * j].view("<u8")[:, 0]
        values = values & FIRST[np.minimum(np.repeat(n, blocks) - 8 * j, 8)]
        out[at:to] = _mix(np.add.reduceat(_mix(values + (j + 1).astype(U) * GOLD), first) + n.astype(U) * STEP)
        at = to
    return out, np.searchsorted(starts, bounds)


def grams(w: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places are left out. Lanes are independent hashes.

    Built by doubling: a run is its first half and its second, mixed at every step.
    """
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    part, size, out, have = _mix(w + STEPS[lane]), 1, None, 0
    while True:
        if k & size:
            at = part[have : have + n]
            out = at if out is None else _mix(out * GOLD + at)
            have += size
        if have == k:
            return _mix(out + U(k))
        part = _mix(part[:-size] * GOLD + (part[size:] ^ U(size)))
        size *= 2


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w neighbours."""
    step, m = 1, x
    while 2 * step <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = w - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
