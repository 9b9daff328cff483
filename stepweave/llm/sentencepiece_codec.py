"""SentencePiece encoding with byte spans, and decoding.

This module normalises, longest prefix first through the model's compiled
character map, and keeps for every normalised byte the source byte it stems from.
The library segments the normalised text, by the model without its normaliser.
Pieces are consecutive runs of normalised bytes, so their lengths project them to
spans of the original UTF-8 text.

Defined cases: null is encoded as the empty text, which has no pieces; texts of
any length are encoded whole; of map entries of which one starts with the other
the longer is taken, so there are no ties; repeated rows give repeated rows; an
empty table gives no row; columns with clashing names are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, slices

_SPACE = "▁".encode()


class CharacterMap:
    """The compiled character map: a double-array trie of byte strings whose
    leaves point at NUL-terminated replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        if not self.units:
            return None
        node, found = 0, None
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


def _char_length(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Codec:
    """A model with its normaliser's settings."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.unknown = self.model.unk_id()
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and the source position of each with the
        source's length at the end."""
        if not data:
            return b"", np.zeros(1, np.int64)
        space = _SPACE if self.escape else b" "
        if not self.map.units and not self.squeeze and not self.suffix:
            source = np.frombuffer(data, np.uint8)
            wide = np.where(source == 0x20, len(space), 1)
            at = np.repeat(np.arange(len(data)), wide)
            if self.prefix:
                at = np.r_[np.zeros(len(space), np.int64), at]
            return (space if self.prefix else b"") + data.replace(b" ", space), np.r_[at, len(data)]
        out, at, i = [], [], 0
        while i < len(data):
            size, text = self.map.longest(data, i) or (0, b"")
            if not size:
                size = min(_char_length(data[i]), len(data) - i)
                text = data[i : i + size]
            for k, byte in enumerate(text):
                out.append(byte)
                at.append(i + (k if text == data[i : i + size] else 0))
            i += size
        return self._spaces(bytes(out), at, len(data), space)

    def _spaces(self, text: bytes, at: list[int], end: int, space: bytes) -> tuple[bytes, np.ndarray]:
        if self.squeeze:
            keep = [i for i, b in enumerate(text) if b != 0x20 or (i and text[i - 1] != 0x20)]
            while keep and text[keep[-1]] == 0x20:
                keep.pop()
            end = at[keep[-1] + 1] if keep and keep[-1] + 1 < len(at) else end
            text, at = bytes(text[i] for i in keep), [at[i] for i in keep]
        if not text:
            return b"", np.array([end], np.int64)
        out, where = bytearray(), []
        if self.prefix and not self.suffix:
            out += space
            where += [at[0]] * len(space)
        for byte, i in zip(text, at, strict=True):
            part = space if byte == 0x20 else bytes([byte])
            out += part
            where += [i] * len(part)
        if self.prefix and self.suffix:
            out += space
            where += [end] * len(space)
        return bytes(out), np.array([*where, end], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[np.ndarray]]:
        """Ids of each text's pieces, and their bounds in its bytes: piece i
        spans from bound i to bound i + 1."""
        normal = [self.normalise(t.encode()) for t in texts]
        plain = [data.decode("utf-8", "replace") for data, _ in normal]
        ids = self.plain.encode(plain, num_threads=1)
        return ids, [self._bounds(*x) for x in zip(plain, (at for _, at in normal), ids, strict=True)]

    def _bounds(self, normal: str, at: np.ndarray, ids: list[int]) -> np.ndarray:
        codes = np.asarray(ids, np.int64)
        sizes = self.sizes[codes] if len(codes) else np.zeros(0, np.int64)
        if self.unknown in ids:
            pieces = self.plain.encode(normal, out_type=str)
            sizes = np.array([1 if self.is_byte[i] else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], np.int64)
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        return at[np.minimum(ends, len(at) - 1)]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per Python worker and model file."""
    return Codec(path)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``ids`` and ``bounds`` (one more than ids; ids[i] spans the bytes
    from bounds[i] to bounds[i + 1]) and ``decoded``, the text of the ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for whole in batches:
            for batch in slices(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids, bounds = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([b.astype(np.int32) for b in bounds], pa.list_(pa.int32())),
                        pa.array([own.model.decode(i) for i in ids], pa.string()),
                    ],
                    [key, "ids", "bounds", "decoded"],
                )

    return bounded(docs).select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, bounds array<int>, decoded string")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of :func:`encode`'s result, that of the bounds too."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.array_join(F.col("bounds").cast("array<string>"), ",").cast("binary"), 256).alias("bounds_sha256"),
        F.coalesce(F.element_at("bounds", -1), F.lit(0)).cast("long").alias("n_bytes"),
    )
