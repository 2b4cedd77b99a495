"""Words of many texts at once, as arrays of hashes, without a Python object a word.

A word is ``[^\\x20\\x09-\\x0D]+`` of a text's UTF-8 bytes with A-Z in lower case. Its hash is 64 bits: the sum of
random values of its bytes, weighted by powers of an odd number modulo 2**64, then mixed with the length. Prefix sums
over a whole block of texts give the hashes of all its words in a few passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_random = np.random.default_rng(20240229)
#: Fixed random values: of each byte, and odd factors for words in a row.
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
FACTORS = _random.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are hashed at once, so that the arrays stay in the processor's cache; a longer text is a block.
BLOCK = 1 << 19
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which all bits depend on all others."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends with space."""
    space = IS_SPACE[buffer]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buffer) and not space[0]:
        change = np.concatenate(([0], change))
    return change[::2], change[1::2]


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts, one after another, the hash and the last two bytes; and how many words each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    buffer = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    starts, ends = word_spans(buffer)
    up, down = powers(len(buffer) + 1)
    sums = np.empty(len(buffer) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[buffer] * up[: len(buffer)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    tails = buffer[ends - 1].astype(np.int32) + 256 * np.where(ends - starts > 1, buffer[ends - 2], 0).astype(np.int32)
    bounds = np.searchsorted(starts, np.cumsum(lengths))
    return hashes, tails, np.diff(bounds, prepend=0)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one after another, and how many each text has."""
    hashes, _, counts = word_table(texts)
    return hashes, counts


def blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about BLOCK bytes."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, with repeats, and how many each text has; fewer words are one run as a whole."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    runs = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    if len(words) >= n:
        full = words[: len(words) - n + 1] * FACTORS[0]
        for k in range(1, n):
            full = full + words[k : len(words) - n + 1 + k] * FACTORS[k]
        full = mix(full)
    else:
        full = np.empty(0, np.uint64)
    # Where each text's runs lie among the runs of all words; short texts get theirs by hand.
    out_ends = np.cumsum(runs)
    out = np.zeros(int(out_ends[-1]) if len(runs) else 0, np.uint64)
    long = counts >= n
    if long.any():
        at = np.repeat(starts[long] - (out_ends - runs)[long], runs[long]) + _places(out_ends - runs, runs, long)
        out[_places(out_ends - runs, runs, long)] = full[at]
    for k in np.flatnonzero((counts > 0) & ~long):
        own = words[starts[k] : ends[k]]
        with np.errstate(over="ignore"):
            out[out_ends[k] - 1] = mix(np.array([(own * FACTORS[: len(own)]).sum(dtype=np.uint64) + FACTORS[32 + len(own)]], np.uint64))[0]
    return out, runs


def _places(starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places start..start+count of the chosen ones, in order."""
    starts, counts = starts[which], counts[which]
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
