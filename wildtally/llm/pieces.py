"""Sentence pieces with byte offsets of the source, for models of the sentencepiece library.

A text is normalised by longest-prefix matching in the model's compiled character map (a double-array
trie); for every normalised byte the source byte it came from is kept. The library merges the pieces,
whose bytes must cover the normalised text, and the alignment projects each piece to its source span.
"""

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import settings
from wildtally.llm.tokens import slices

SPACE = "▁"


class CharMap:
    """The compiled map: length of the trie, its units, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        self.units, self.texts = [], b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length and value of the longest key that ``data`` has at ``at``; length 0 if there is none."""
        best, units = (0, 0), self.units
        node = units[0]
        position = (node >> 10) << ((node & 512) >> 6)
        for i in range(at, len(data)):
            position ^= data[i]
            if position >= len(units):
                break
            node = units[position]
            if node & 0x800000FF != data[i]:
                break
            position ^= (node >> 10) << ((node & 512) >> 6)
            if node >> 8 & 1:
                best = i + 1 - at, units[position] & 0x7FFFFFFF
        return best

    def replacement(self, value: int) -> bytes:
        return self.texts[value : self.texts.index(b"\0", value)]

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The mapped bytes and, for each and the end, the source byte at which its key starts."""
        if not self.units:
            return data, np.arange(len(data) + 1)
        out, where, at = bytearray(), [], 0
        while at < len(data):
            length, value = self.longest(data, at)
            if length:
                new = self.replacement(value)
            else:
                first = data[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + length]
            out += new
            where += [at] * len(new)
            at += length
        return bytes(out), np.array([*where, len(data)])


class Encoder:
    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as file:
            spec.ParseFromString(file.read())
        rules = spec.normalizer_spec
        self.chars, self.prefix = CharMap(rules.precompiled_charsmap), rules.add_dummy_prefix
        if rules.remove_extra_whitespaces or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix or not self.prefix:
            raise ValueError("only models that keep all white space, escape it and put one before the text")
        # Byte pieces like <0x0A> stand for one byte. With them no piece is ever unknown.
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() for p in spec.pieces]
        self.sizes = np.array([len(b) for b in self.bytes])

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text that pieces are made of, and the source byte of each of its bytes and of its end."""
        mapped, source = self.chars.apply(text.encode())
        data = np.frombuffer(mapped, dtype=np.uint8)
        widths = np.where(data == 0x20, 3, 1)
        aligned = np.concatenate([np.zeros(3, dtype=np.int64), np.repeat(source[:-1], widths), source[-1:]])
        return SPACE + mapped.decode().replace(" ", SPACE), aligned

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """For each id the source bytes [from, to). A piece inside one source character has all of it."""
        if not ids:
            return np.zeros((0, 2), dtype=np.int64)
        source = self.normalised(text)[1]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if ends[-1] != len(source) - 1:
            raise AssertionError("the pieces do not cover the text")
        return np.column_stack([source[ends - sizes], source[ends]])

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces' bytes, without the blank that was put first."""
        out = b"".join([self.bytes[i] for i in ids]).decode(errors="replace").replace(SPACE, " ")
        return out[1:] if out.startswith(" ") else out


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("n_bytes", pa.int64()), ("decoded_sha256", pa.string())])


def _digested(model: str, with_ids: bool):
    def digest(batches):
        tool = encoder(model)
        names = [str(i) for i in range(tool.library.get_piece_size())]
        for batch in slices(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            ids = tool.encode(texts)
            spans = [tool.spans(text, x) for text, x in zip(texts, ids)]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([int(x[-1, 1]) if len(x) else 0 for x in spans], pa.int64()),
                pa.array([hashlib.sha256(tool.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=_DIGESTS.append(_ENCODED.field("ids")) if with_ids else _DIGESTS)

    return digest


def digests(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, n_bytes`` (of the source, that the pieces span) ``, decoded_sha256`` of every row's text, and its ``ids`` on demand; see ``encoded``."""
    settings(docs.sparkSession)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, n_bytes long, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digested(model, with_ids), ddl)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string())])


def _encoded(model: str):
    def encode(batches):
        tool = encoder(model)
        for batch in slices(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            ids = tool.encode(texts)
            spans = [tool.spans(text, x) for text, x in zip(texts, ids)]
            columns = [ids, [x[:, 0] for x in spans], [x[:, 1] for x in spans], [tool.decode(x) for x in ids]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_ENCODED)[1:]))], schema=_ENCODED)

    return encode


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, begins, ends, decoded`` of every row: piece ids, their source bytes, and the text decoded from them.

    ``model`` is a file that every executor can read. A null text counts as empty; an empty text has no
    ids and decodes to an empty text. Rows are encoded one by one: repeated rows, null ids and further
    columns make no difference. An empty table gives no rows.
    """
    settings(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encoded(model), "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string"
    )
