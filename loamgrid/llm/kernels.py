"""Vectorised byte kernels: words, their hashes, shingles and windows.

All work on one buffer that holds many texts, each followed by a separator
byte, so that the cost per text is small and the cost per byte is a few
nanoseconds.  Hashes are 64 bits wide and depend on the bytes alone.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.Generator(np.random.Philox(20240229))
#: Odd base of the rolling sums and its inverse modulo 2**64.
BASE = int(_rng.integers(1 << 62, 1 << 63)) | 5
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[ord("A") : ord("Z") + 1] = BYTE_CODES[ord("a") : ord("z") + 1]
SHINGLE_CODES = _rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | U64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for name, b in (("up", BASE), ("down", INVERSE)):
            step = np.full(size, b, dtype=U64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=U64)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word, in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def joined(texts: list[bytes], separator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer, each followed by the separator; where each starts and ends."""
    buf = np.frombuffer(separator.join(texts) + separator, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    return buf, ends - sizes, ends


def byte_set(inside) -> np.ndarray:
    """A table of 256 flags from a predicate on byte values."""
    return np.fromiter((bool(inside(b)) for b in range(256)), bool, 256)


#: Words are runs of anything but blank, tab, line feed and the other bytes up to carriage return.
SPACED = byte_set(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of digits, letters and everything outside ASCII.
ALNUM = byte_set(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


#: Bytes that are hashed at once; a buffer is cut between words.
SEGMENT = 1 << 20


def words(buf: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a buffer that ends in a separator.

    A long buffer goes through in segments, which bounds what its hashing
    holds, unless a single word is longer.
    """
    parts, at = [], 0
    while at < len(buf):
        end = len(buf)
        if end - at > SEGMENT:
            gaps = np.flatnonzero(~inside[buf[at : at + SEGMENT]])
            size = SEGMENT
            while not len(gaps) and at + size < len(buf):
                size *= 2
                gaps = np.flatnonzero(~inside[buf[at : at + size]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        starts, ends, hashes = _words(buf[at:end], inside, lower)
        parts.append((starts + at, ends + at, hashes))
        at = end
    if len(parts) == 1:
        return parts[0]
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (none, none, np.empty(0, U64))


def _words(buf: np.ndarray, inside: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flags = inside[buf]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if len(flags) and flags[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.cumsum((LOWER_CODES if lower else BYTE_CODES)[buf] * up[: len(buf)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts])


def prefix_hashes(buf: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each start, A-Z lower-cased."""
    out = np.full(len(starts), n, U64)
    for k in range(n):
        out = out * SHINGLE_CODES[k] + LOWER_CODES[buf[starts + k]]
    return mixed(out)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n] * SHINGLE_CODES[0]
    for k in range(1, width):
        out += hashes[k : k + n] * SHINGLE_CODES[k]
    return mixed(out)


def document_shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words make one shingle, none an empty set."""
    if not texts:
        return []
    buf, starts, ends = joined(texts)
    at, _, hashes = words(buf, SPACED)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    runs = shingles(hashes, width)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = hashes[a:b]
            out.append(mixed((h * SHINGLE_CODES[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys, by prefix and suffix minima of blocks."""
    n = len(keys)
    if n < width:
        return np.empty(0, keys.dtype)
    padded = np.full(-(-n // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
