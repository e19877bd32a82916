"""Content-defined anchors: where a text could share a 400-byte string with another.

Of the 32-byte grams inside each window the one of least hash is the window's
anchor. Equal windows have the same anchor at the same place, whatever surrounds them, so windows
can only be equal if their anchors' grams are. Neighbouring starts with one anchor form a run.

Defined cases: a text shorter than the window has no runs; of equal hashes within a window the first
place wins; a long text is handled in blocks, at whose borders a run may be cut in two.
"""

from __future__ import annotations

import numpy as np

WINDOW = 400
GRAM = 32
#: Starts handled at a time; positions fit the low 24 bits beside 40 bits of hash.
BLOCK = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(raw) - GRAM + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    h = words[:n] * _ODD[0]
    for i in range(1, GRAM // 8):
        h += words[8 * i : 8 * i + n] * _ODD[i]
        h ^= h >> np.uint64(29)
    h *= _ODD[4]
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in three passes."""
    n = len(x)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    grid[:n] = x
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(raw: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first start, last start) of each run of window starts."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, len(raw) - window + 1, BLOCK):
        part = raw[at : at + BLOCK + window - 1]
        h = gram_hashes(part)
        least = sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), window - GRAM + 1)
        anchor = (least & _LOW).astype(np.int64)
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts, [len(anchor)]]) - 1
        a = anchor[first]
        for o, x in zip(out, (h[a], a + at, first + at, last + at), strict=True):
            o.append(x)
    if not out[0]:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(o) for o in out)
