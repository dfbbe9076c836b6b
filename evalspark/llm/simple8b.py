"""Simple-8b word-aligned integer coding, vectorised with numpy.

A 64-bit word is a 4-bit selector and 60 bits of payload. Selector s >= 1 packs
``COUNTS[s]`` ids of ``BITS[s]`` bits each; selector 0 is an escape whose payload
is the index of a full 64-bit value kept beside the words. Ids are coded in
blocks of ``BLOCK``; ``block_offsets`` holds the first word of every block, so
blocks decode independently of each other and all at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Fixed values of the format: payload bits per id of selectors 1..14 (60 // bits ids a word).
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
COUNTS = np.array([1] + [60 // int(b) for b in BITS[1:]], np.int64)
_LIMITS = (np.uint64(1) << BITS[1:].astype(np.uint64)) - np.uint64(1)
_SPAN = int(COUNTS.max())
_WIDE = 8  # from this selector on, an id's width alone limits a word to COUNTS[_WIDE] ids


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (non-negative integers) -> (words, block_offsets, escapes)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    # class of an id: the first selector whose slots hold it; past a block's end anything fits
    classes = np.zeros((blocks, BLOCK + _SPAN), np.int8)
    flat = np.zeros(blocks * BLOCK, np.int8)
    flat[:n] = np.searchsorted(_LIMITS, ids, side="left") + 1
    classes[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    sizes = np.full(blocks, BLOCK, np.int64)
    sizes[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    where, chosen, order = [], [], []
    span = np.arange(_SPAN)
    step = 0
    while len(live):  # one word of every unfinished block a step
        selector = np.zeros(len(live), np.int64)
        wide = classes[live, at[live]] >= _WIDE
        for pick, low in ((np.nonzero(wide)[0], _WIDE), (np.nonzero(~wide)[0], 1)):
            if len(pick):
                own = live[pick]
                window = np.maximum.accumulate(classes[own[:, None], at[own][:, None] + span[:COUNTS[low]]], axis=1)
                fits = window[:, COUNTS[low:] - 1] <= np.arange(low, len(BITS))
                selector[pick] = np.where(fits.any(axis=1), fits.argmax(axis=1) + low, 0)
        where.append(live * BLOCK + at[live])
        chosen.append(selector)
        order.append(live * (BLOCK + 1) + step)
        at[live] += COUNTS[selector]
        live = live[at[live] < sizes[live]]
        step += 1
    keys = np.concatenate(order)
    by = np.argsort(keys, kind="stable")
    where, chosen = np.concatenate(where)[by], np.concatenate(chosen)[by]
    padded = np.concatenate([ids, np.zeros(blocks * BLOCK - n + _SPAN, np.uint64)])
    limit = np.minimum((where // BLOCK + 1) * BLOCK, n)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(BITS)):
        pick = np.nonzero(chosen == s)[0]
        if len(pick):
            first, end, bits = where[pick], limit[pick], int(BITS[s])
            packed = np.zeros(len(pick), np.uint64)
            for j in range(int(COUNTS[s])):
                packed |= np.where(first + j < end, padded[first + j], np.uint64(0)) << np.uint64(j * bits)
            words[pick] |= packed
    escaped = np.nonzero(chosen == 0)[0]
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    per_block = np.bincount(where // BLOCK, minlength=blocks)
    return words, np.concatenate([[0], np.cumsum(per_block)]), ids[where[escaped]]


def decode(words: np.ndarray, block_offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids coded by :func:`encode`."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(block_offsets) - 1), np.diff(block_offsets))
    first = before - before[block_offsets[:-1]][block] + block * BLOCK if len(words) else before
    limit = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in range(1, len(BITS)):
        pick = np.nonzero(selector == s)[0]
        if len(pick):
            bits, mask = int(BITS[s]), _LIMITS[s - 1]
            for j in range(int(COUNTS[s])):
                to = first[pick] + j
                inside = to < limit[pick]
                out[to[inside]] = (words[pick][inside] >> np.uint64(j * bits)) & mask
    pick = np.nonzero(selector == 0)[0]
    out[first[pick]] = np.asarray(escapes, np.uint64)[(words[pick] & _LIMITS[-1]).astype(np.int64)]
    return out
