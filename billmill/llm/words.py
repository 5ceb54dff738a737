"""Hashes of words and shingles, a whole block of texts at a time.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 text with A-Z in lower case. A word's hash is a
polynomial over its bytes, mixed to 64 bits; a shingle's hash is a mixed sum over its words.
Two different words of one comparison agree with a chance of about 2**-64.
"""

import numpy as np
import pyarrow as pa

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """An invertible scramble of 64-bit values, so that low and high bits are usable."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _separators(letters_only: bool) -> np.ndarray:
    """White space, or every ASCII character that is no letter or digit."""
    if letters_only:
        return np.array([byte < 128 and not chr(byte).isalnum() for byte in range(256)])
    found = np.zeros(256, bool)
    found[[32, 9, 10, 11, 12, 13]] = True
    return found


def _byte_values(separators: np.ndarray) -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    values = mixed((lower + np.uint64(1)) * _MULTIPLIER)
    values[separators] = 0
    return values


_TABLES = {kind: (_separators(kind), _byte_values(_separators(kind))) for kind in (False, True)}
_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < size:
        up = np.full(size, 0x5851F42D4C957F2D, np.uint64)
        down = np.full(size, _inverse(0x5851F42D4C957F2D), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"], _POWERS["down"]


def _block(data: np.ndarray, breaks: np.ndarray, letters_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words of a block; words also end at `breaks`."""
    separators, values = _TABLES[letters_only]
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, begin
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    up, down = _powers(len(data))
    sums = np.add.reduceat(values[data] * up[: len(data)], begin)
    return mixed(sums * down[begin]), begin, np.flatnonzero(last) + 1


def hashed_words(texts: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words start (one more entry
    than texts), as by placed_words."""
    return placed_words(texts, letters_only)[:2]


def placed_words(texts: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, ...]:
    """Word hashes of all texts in order, where each text's words start (one more entry than
    texts), first byte and end of each word, and the bytes. With `letters_only`, words end at ASCII punctuation too. A null is an empty
    text. Long texts are worked off in steps that end at a
    space, so that the working arrays don't grow with a text."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    _, offsets, buffer = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, begins, ends, at = [], [], [], 0
    while at < len(data):
        end, look = min(at + _STEP, len(data)), 4096
        while end < len(data):  # on to the next space
            spaces = np.flatnonzero(_TABLES[letters_only][0][data[end : end + look]])
            if len(spaces):
                end += int(spaces[0])
                break
            end, look = min(end + look, len(data)), look * 2
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)]
        found, begin, stop = _block(data[at:end], inner - at, letters_only)
        hashes.append(found)
        begins.append(begin + at)
        ends.append(stop + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), np.zeros(len(offsets), np.int64), none, none, data
    begins = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(begins, offsets), begins, np.concatenate(ends), data


def shingles(hashes: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `words` words and where each text's runs start. A text with fewer
    words, but one at least, has its whole sequence as one."""
    counts = np.diff(starts)
    runs = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(runs)])
    factors = [mixed(np.array([k + 1], np.uint64) * _MULTIPLIER)[0] | np.uint64(1) for k in range(words)]
    text_of = np.repeat(np.arange(len(counts)), runs)
    first = starts[:-1][text_of] + np.arange(out[-1]) - out[:-1][text_of]
    length = np.minimum(counts[text_of], words)
    total = length.astype(np.uint64)
    for k, factor in enumerate(factors):
        here = length > k
        if here.all():
            total += hashes[first + k] * factor
        else:
            total[here] += hashes[first[here] + k] * factor
    return mixed(total), out
