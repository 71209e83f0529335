"""Words, shingles and rolling hashes of many texts at once, as numpy arrays.

Hashes are polynomials modulo 2**64 over running sums, so every window of a buffer is hashed in a
constant number of array operations. Buffers are cut into pieces of a few MB, which bounds memory
whatever the batch; a single text is cut between words.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)        # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * PIECE:
            _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span; equal spans have equal hashes.

    Starts ascend. Long buffers are hashed in parts, which bounds the sums held at a time.
    """
    if len(values) > 2 * PIECE and len(starts):
        out = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(values) + PIECE, PIECE))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi > lo:
                first = int(starts[lo])
                out[lo:hi] = _span_hashes(values[first:int(ends[lo:hi].max())],
                                          starts[lo:hi] - first, ends[lo:hi] - first)
        return out
    return _span_hashes(values, starts, ends)


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts]
                 + lengths * MIX_B)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(INVERSE, n))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte buffer."""
    solid = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def _pieces(text: bytes) -> Iterable[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space."""
    while len(text) > 2 * PIECE:
        cut = max(text.rfind(c, PIECE, 2 * PIECE) for c in (b" ", b"\n", b"\t", b"\r"))
        if cut < 0:
            break
        yield text[:cut]
        text = text[cut:]
    yield text


def word_hashes(texts: Sequence[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, in order, and the number of words of each text."""
    counts = np.zeros(len(texts), np.int64)
    hashes, batch, owner, size = [], [], [], 0

    def flush():
        nonlocal batch, owner, size
        if batch:
            buf = np.frombuffer(b"\n".join(batch), np.uint8)
            if lower:
                buf = LOWER[buf]
            starts, ends = word_bounds(buf)
            hashes.append(span_hashes(buf, starts, ends))
            limits = np.cumsum([len(b) + 1 for b in batch])
            np.add.at(counts, np.asarray(owner)[np.searchsorted(limits, starts, side="right")], 1)
        batch, owner, size = [], [], 0

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if size + len(piece) > PIECE:
                flush()
            batch.append(piece)
            owner.append(i)
            size += len(piece) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def shingle_sets(texts: Sequence[bytes], width: int = 5, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct hashes of the `width`-word shingles of each text.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    words, counts = word_hashes(texts, lower)
    out, at = [], 0
    windows = window_hashes(words, width)
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(windows[at:at + n - width + 1]))
        elif n:
            out.append(span_hashes(words[at:at + n], np.array([0]), np.array([n])))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def encoded(values: Iterable) -> list[bytes]:
    """Texts as UTF-8; missing ones are empty."""
    return [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]
