"""Token ids of whole texts by a word vocabulary, worked out once per distinct word.

The tokenizer drops white space and never looks across it, so a text's ids are those of its chunks between
ASCII white space, one after another. A chunk of ASCII and Latin letters is cut further where letters, digits and
other signs meet, as the tokenizer does itself; chunks with anything else (other scripts, apostrophes,
``<``, control characters) stay whole. Arrow finds the distinct pieces of a batch, the tokenizer sees each
once, and numpy puts the ids back in place.
"""

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces a worker remembers before it starts anew, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 1 << 24
# Text bytes worked on at once.
STEP_BYTES = 1 << 20

_SPACE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_KIND = np.full(256, _WHOLE, dtype=np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[0x27, 0x3C]] = _WHOLE
# Lead bytes of U+00C0 to U+027F: letters, none of which composes or has marks, but for two signs and the dotted I.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0xC3:0xCA] = True
_OTHERS = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)]
# A run of such letters, a digit or a run of signs: what the tokenizer takes as one word.
_LONE = r"^(?:[a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{27F}]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+)$"
# Fixed value: the mark of a word's last token.
_END = "</w>"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def _places(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0] + 1, ... (counts[0] of them), then the same for the next."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class WordIds:
    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        self.tokenizer = Tokenizer.from_str(vocabulary)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values(), default=0) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith(_END)]] = True
        self._forget()

    def _forget(self):
        """No piece known: ``ids`` of the n-th one are ``flat[begins[n] : begins[n] + sizes[n]]``."""
        self.known = pa.array([], pa.large_string())
        self.flat, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Add these; returns the place of each among those added."""
        lone = pc.match_substring_regex(pieces, _LONE)
        many = pieces.filter(lone)
        if len(many):
            # Each is one word to the tokenizer, and the last id of a word tells that it ends.
            ids = np.array(self.tokenizer.encode(" ".join(many.to_pylist()), add_special_tokens=False).ids, dtype=np.uint32)
            sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(sizes) != len(many) or sizes.sum() != len(ids):
                raise ValueError("the vocabulary does not mark the ends of words")
            self._append(many, ids, sizes)
        others = pieces.filter(pc.invert(lone))
        if len(others):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(others.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self._append(others, np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes)
        lone = lone.to_numpy(zero_copy_only=False)
        return np.where(lone, np.cumsum(lone) - 1, len(many) + np.cumsum(~lone) - 1)

    def _append(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        self.known = pa.concat_arrays([self.known, pieces])
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def _number(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of these distinct pieces among the known ones."""
        if len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES:
            self._forget()
        found = pc.index_in(pieces, value_set=self.known)
        if not found.null_count:
            return found.to_numpy()
        new = pc.is_null(found).to_numpy(zero_copy_only=False)
        at = pc.fill_null(found, 0).to_numpy().copy()
        at[new] = len(self.known) + self._learn(pieces.filter(pa.array(new)))
        return at

    def _step(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` and the bounds of each text's ids."""
        kind = _KIND[data]
        lead = np.flatnonzero(_LATIN[data[:-1]])
        for one, two in _OTHERS:
            lead = lead[(data[lead] != one) | (data[lead + 1] != two)]
        kind[lead] = kind[lead + 1] = _LETTER
        inside = kind != _SPACE
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        chunk = inside.copy()
        chunk[1:] &= ~inside[:-1] | cut[1:-1]
        at = np.flatnonzero(chunk)
        if not len(at):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        # Runs from one chunk's start to the next one's hold its bytes and white space only.
        odd = np.logical_or.reduceat(kind == _WHOLE, at)
        plain = np.zeros(len(data), dtype=bool)
        plain[at[0] :] = ~np.repeat(odd, np.diff(np.append(at, len(data))))
        first = chunk
        first[1:] |= inside[1:] & plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        kept = np.where(plain, _FOLD[data], data)[inside]
        starts = np.flatnonzero(first)
        lengths = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(kept)).dictionary_encode()
        which = self._number(pieces.dictionary)[pieces.indices.to_numpy()]
        size = self.sizes[which]
        ids = self.flat[_places(self.begins[which], size)]
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
        return ids, bounds

    def __call__(self, texts: pa.Array):
        """The id array of each text in turn; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            start = offsets[row]
            last = max(int(np.searchsorted(offsets, start + STEP_BYTES, "right")) - 1, row + 1)
            if offsets[last] - start <= STEP_BYTES:
                ids, bounds = self._step(data[start : offsets[last]], offsets[row : last + 1] - start)
                yield from (ids[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
            else:
                yield self._long(data[start : offsets[last]])
            row = last

    def _long(self, data: np.ndarray) -> np.ndarray:
        """One long text in steps that end before white space."""
        parts, start = [], 0
        while start < len(data):
            end = min(start + STEP_BYTES, len(data))
            while end < len(data) and _KIND[data[end]] != _SPACE:
                end += 1
            parts.append(self._step(data[start:end], np.array([0, end - start]))[0])
            start = end
        return np.concatenate(parts)
