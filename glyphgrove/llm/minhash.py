"""One-permutation MinHash with optimal densification."""

from __future__ import annotations

import numpy as np

from glyphgrove.llm.common import mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bin_minima(sets: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` 32-bit minima per set; a bin without a member holds ``EMPTY``.

    ``sets`` are the sorted distinct hashes of each set, one after the other. The high half of a hash
    names the bin, so every hash is looked at once; the low half is the value.
    """
    out = np.full((len(sizes), bins), EMPTY, np.uint64)
    if len(sets) == 0:
        return out
    row = np.repeat(np.arange(len(sizes)), sizes)
    cell = ((sets >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    value = mix(sets) & np.uint64(0xFFFFFFFF)
    place = row * bins + cell.astype(np.int64)
    # the sets are sorted, so the members of one cell lie together
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    out.reshape(-1)[place[first]] = np.minimum.reduceat(value, first)
    return out


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill every empty bin from a filled one of the same row.

    Bin i tries the bins h(i, 1), h(i, 2), ... of a fixed hash until one was filled from the start,
    so two sets take their values from the same place whenever they agree on what is filled. Rows
    that are empty throughout stay so.
    """
    out = minima.copy()
    filled = minima != EMPTY
    bins = minima.shape[1]
    number = filled.sum(axis=1)
    for row in np.flatnonzero(number == 1):
        out[row] = minima[row, np.flatnonzero(filled[row])[0]]
    rows, cells = np.nonzero(~filled & (number > 1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        seed = cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)
        probe = ((mix(mix(seed)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        hit = filled[rows, probe]
        out[rows[hit], cells[hit]] = minima[rows[hit], probe[hit]]
        rows, cells = rows[~hit], cells[~hit]
    return out


def per_bin(values: np.ndarray) -> np.ndarray:
    """Scramble each value with its bin, so that bins filled from one place have low bits of their own.

    Without it a set of a single member would repeat the same few bits in every bin.
    """
    salt = mix(np.arange(1, values.shape[1] + 1, dtype=np.uint64))
    return mix(values + salt)


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` (1, 2, 4 or 8) of each value, packed into bytes."""
    low = (values & np.uint64((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    low = low.reshape(low.shape[0], -1, per)
    out = np.zeros(low.shape[:2], np.uint8)
    for j in range(per):
        out |= low[:, :, j] << np.uint8(bits * j)
    return out


def unpack_bits(packed: np.ndarray, bits: int) -> np.ndarray:
    per = 8 // bits
    parts = [(packed >> np.uint8(bits * j)) & np.uint8((1 << bits) - 1) for j in range(per)]
    return np.stack(parts, axis=-1).reshape(packed.shape[0], -1)


def likeness(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures, row by row.

    Unequal values agree in their low bits with probability 2^-bits, which is taken off.
    """
    same = (unpack_bits(a, bits) == unpack_bits(b, bits)).mean(axis=1)
    chance = 1.0 / (1 << bits)
    return np.clip((same - chance) / (1.0 - chance), 0.0, 1.0)
