"""Words of Arrow text columns and hashes of words and word windows, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial over its bytes
modulo 2**64 taken from prefix sums, so that all words of a batch are hashed at once; windows of words
are hashed the same way (Rabin-Karp). All hashes end in a mixing step, so their order is as good as random.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
SECOND_BASE = np.uint64(0xA0761D6478BD642F)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_values = np.random.RandomState(7)
_BYTE = _values.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

# Text bytes that are worked on at once; numpy needs about 40 bytes for each.
SLICE_BYTES = 1 << 20


def powers(base: np.uint64, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < count; an odd base has an inverse."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < count:
        size = max(count, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[0][:count], have[1][:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _summed(values: np.ndarray, base: np.uint64) -> np.ndarray:
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * powers(base, len(values))[0], out=total[1:])
    return total


class Words:
    """The words of a text column: ``hashes`` and byte spans, and ``bounds[i]:bounds[i + 1]`` of row i."""

    def __init__(self, texts: pa.Array, folded: bool = False):
        texts = pc.fill_null(texts, "")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = ~_SPACE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        total = _summed((_FOLDED if folded else _BYTE)[data], BYTE_BASE)
        if len(self.starts):
            down = powers(BYTE_BASE, len(data))[1]
            raw = (total[self.ends] - total[self.starts]) * down[self.starts]
            self.hashes = mixed(raw + (self.ends - self.starts).astype(np.uint64) * WORD_BASE)
        else:
            self.hashes = np.zeros(0, dtype=np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def windows(self, width: int, base: np.uint64 = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``width`` words within one row."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        last = np.repeat(self.bounds[1:], self.counts())
        at = np.flatnonzero(np.arange(n) + width <= last)
        total = _summed(self.hashes, base)
        raw = (total[at + width] - total[at]) * powers(base, n)[1][at]
        return at, mixed(raw + np.uint64(width))

    def whole(self, base: np.uint64 = WORD_BASE) -> np.ndarray:
        """A hash of each row's whole word sequence."""
        total = _summed(self.hashes, base)
        lo, hi = self.bounds[:-1], self.bounds[1:]
        down = powers(base, max(len(self.hashes), 1) + 1)[1]
        return mixed((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """The batches cut into runs of rows with about ``limit`` bytes of text, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def blobs(parts: list) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], type=pa.binary())
