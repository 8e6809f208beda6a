"""Content-defined anchors of byte strings, with numpy.

Every window of WINDOW bytes has one anchor: of its GRAM-byte pieces the one of least hash, the first one on ties. Equal windows
have equal anchors at equal places, wherever they are. The windows of a text that share an anchor are a run, and the bytes
that a run covers are its context.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 100, 32
#: Bytes that are hashed at once; places within them fit the low bits of a key.
BLOCK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = _rng.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM-byte and WINDOW-byte strings at all places where they fit."""
    level, width, by = _BYTE[data], 1, {}
    while width < 64:
        level = level[:-width] * _STEP[width.bit_length()] + level[width:]
        width *= 2
        by[width] = level
    n = len(data) - WINDOW + 1
    window = mixed(by[64][:n] * _STEP[0] + by[32][64 : 64 + n] * _STEP[7] + by[4][96 : 96 + n])
    return mixed(by[GRAM]), window


def runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Runs of the documents at starts (with lengths) of one block: (document, first window, windows, gram hash, context hash), first window within the block."""
    if len(data) < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    gram, window = hashes(data)
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, pieces = 1, WINDOW - GRAM + 1
    while 2 * width <= pieces:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(window)], key[pieces - width : pieces - width + len(window)])
    anchor = (key & _PLACE).astype(np.int64)
    fits = np.maximum(0, lengths - WINDOW + 1)
    doc = np.repeat(np.arange(len(starts)), fits)
    at = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits) + np.repeat(starts, fits)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    new = np.flatnonzero(np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (doc[1:] != doc[:-1])]))
    size = np.diff(np.concatenate([new, [len(at)]]))
    first = at[new]
    context = mixed(window[first] * _STEP[1] + window[first + size - 1] + size.astype(np.uint64))
    return doc[new], first, size, gram[anchor[first]], context


def blocks(texts: list[bytes]):
    """(data, numbers, places, starts, lengths) of blocks that together hold every window of every text: of each part its text's number, its place there, and its start and length in the block. Long texts come in overlapping parts."""
    number, place, part, held = [], [], [], 0

    def packed():
        sizes = np.array([len(p) for p in part], np.int64)
        return np.frombuffer(b"".join(part), np.uint8), np.array(number, np.int64), np.array(place, np.int64), np.cumsum(sizes) - sizes, sizes

    for i, text in enumerate(texts):
        for k in range(0, max(1, len(text) - WINDOW + 1), BLOCK // 2):
            piece = text[k : k + BLOCK // 2 + WINDOW - 1]
            if len(piece) < WINDOW:
                continue
            if held + len(piece) > BLOCK and part:
                yield packed()
                number, place, part, held = [], [], [], 0
            number.append(i)
            place.append(k)
            part.append(piece)
            held += len(piece)
    if part:
        yield packed()
