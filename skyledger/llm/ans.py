"""Range asymmetric numeral system over many interleaved lanes, as numpy steps.

States are 64-bit with 32-bit words; token i belongs to lane i mod lanes, so one
step codes a token of every lane. Frequencies sum to 2**SCALE. Before every
`every`-th step the state of all lanes and the place in the words are kept as a
checkpoint, from which decoding can start.
"""

from __future__ import annotations

import numpy as np

SCALE = 20
FLOOR = 1 << 31


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; each symbol that occurs keeps 1 at least."""
    total = int(counts.sum())
    if not total:
        return counts.astype(np.uint64)
    scaled = np.where(counts > 0, np.maximum(1, counts * (1 << SCALE) // total), 0)
    excess = int(scaled.sum()) - (1 << SCALE)
    for i in np.argsort(-scaled, kind="stable"):
        if excess == 0:
            break
        step = max(excess, 0) and min(excess, int(scaled[i]) - 1) or min(excess, 0)
        scaled[i] -= step
        excess -= step
    return scaled.astype(np.uint64)


def encode(slots: np.ndarray, freq: np.ndarray, lanes: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and per checkpoint the states of all lanes and the place in the words. `slots` are indices into `freq`."""
    base = np.cumsum(freq) - freq
    limit = freq << np.uint64(32 + 31 - SCALE)
    steps = -(-len(slots) // lanes)
    state = np.full(lanes, FLOOR, dtype=np.uint64)
    words: list[np.ndarray] = []
    states, places, emitted = [], [], 0
    scale, word = np.uint64(SCALE), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        own = slots[step * lanes : (step + 1) * lanes]
        x, f = state[: len(own)], freq[own]
        over = x >= limit[own]
        out = x[over]
        words.append(out.astype(np.uint32))
        emitted += len(out)
        x = np.where(over, x >> word, x)
        q = x // f
        state[: len(own)] = (q << scale) + (x - q * f) + base[own]
        if step % every == 0:
            states.append(state.copy())
            places.append(emitted)
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    return stream, np.array(states[::-1], dtype=np.uint64).reshape(-1, lanes), emitted - np.array(places[::-1], dtype=np.int64)


def decode(words: np.ndarray, state: np.ndarray, place: int, n: int, freq: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """`n` slots from a checkpoint on; `symbol` maps each of the 2**SCALE values to its slot."""
    base = np.cumsum(freq) - freq
    lanes = len(state)
    state, out = state.copy(), np.empty(n, dtype=np.int64)
    mask, scale, word, floor = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(FLOOR)
    for at in range(0, n, lanes):
        x = state[: min(lanes, n - at)]
        low = x & mask
        own = symbol[low]
        out[at : at + len(x)] = own
        x = freq[own] * (x >> scale) + low - base[own]
        under = np.flatnonzero(x < floor)
        x[under] = (x[under] << word) | words[place : place + len(under)]
        place += len(under)
        state[: len(x)] = x
    return out
