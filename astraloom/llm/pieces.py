"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation walks the text by longest prefix through the compiled character map of the model (a double-array
trie and its replacement strings) and records which source bytes every normalised character came from. Where the
map is empty and white space is kept, the whole text is one identity run, recorded as such. The model merges the
normalised text (merging itself is the library's, with its own normaliser switched off). Pieces are then projected
through the recorded alignment to byte spans of the original text; in an identity run that is a running sum of the
pieces' source bytes. Each byte-fallback piece gets the source byte that it stands for.

A null text is empty; an empty text has no pieces. Texts of any length are encoded whole. Repeated rows and ids and null
ids are rows like others; an empty table gives no rows; other columns are left out. Of pieces that could begin a merge
the library's order decides, so ties are the library's.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb

from astraloom.llm.common import map_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class CharMap:
    """A compiled character map: 4 bytes of trie size, the trie's units, the replacements, each ended by a zero."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]
        self.firsts = frozenset(b for b in range(256) if self.units and self._step(self._root(), b) is not None)

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The index of the unit below node by byte."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest key that starts at `at`."""
        if not self.units or data[at] not in self.firsts:
            return None
        node, found, end = self._root(), None, at
        while end < len(data):
            index = self._step(node, data[end])
            if index is None:
                break
            unit = self.units[index]
            node = index ^ self._offset(unit)
            end += 1
            if unit >> 8 & 1:
                found = end - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        taken, start = found
        return taken, self.strings[start : self.strings.index(b"\0", start)]


@dataclass
class Normalised:
    """Text after normalisation; starts and ends give, per character, its byte span in the source. Both are None for an identity run behind the dummy prefix."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


class Encoder:
    """Encoding and decoding by one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            proto = model_pb.ModelProto.FromString(f.read())
        self._set(proto)

    @classmethod
    def of(cls, proto: model_pb.ModelProto) -> Encoder:
        made = cls.__new__(cls)
        made._set(proto)
        return made

    def _set(self, proto: model_pb.ModelProto) -> None:
        if proto.trainer_spec.model_type != model_pb.TrainerSpec.BPE:
            raise ValueError("the model is not a byte-pair model")
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.user = sorted((p.piece for p in proto.pieces if p.type == USER), key=len, reverse=True)
        # merging runs over text that is normalised already
        bare = model_pb.ModelProto.FromString(proto.SerializeToString())
        bare.normalizer_spec.precompiled_charsmap = b""
        bare.normalizer_spec.add_dummy_prefix = bare.normalizer_spec.remove_extra_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unknown = self.types.index(UNKNOWN)
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else None for p in proto.pieces]
        # characters of the normalised text that a piece covers; 0 for a byte
        self.n_chars = np.array([0 if p.type == BYTE else len(p.piece) for p in proto.pieces], np.int64)
        self.is_byte = np.array([p.type == BYTE for p in proto.pieces])
        self.fallback = bool(proto.trainer_spec.byte_fallback)
        surface = proto.trainer_spec.unk_surface
        self.surface = [b"" if t == CONTROL else surface.encode() if t == UNKNOWN else self.bytes_of[i] if t == BYTE else p.replace(MARK, " ").encode() for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True))]
        self.numbers = list(map(str, range(len(self.pieces))))
        # bytes of normalised text, and of source text in an identity run, that a piece covers
        self.n_bytes = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types, strict=True)], np.int64)
        self.source_bytes = np.array([1 if t == BYTE else len(p.replace(MARK, " ").encode()) for p, t in zip(self.pieces, self.types, strict=True)], np.int64)
        self.plain = not self.map.units and self.prefix and not self.squeeze and self.escape and not self.suffix and not self.user and self.fallback

    # -- normalisation ---------------------------------------------------------------------------------------

    def normalise(self, text: str) -> Normalised:
        """The normalised text and the source bytes of each of its characters."""
        if not text:
            return Normalised("", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if self.plain and MARK not in text:
            return Normalised(MARK + text.replace(" ", MARK))
        raw = text.encode("utf-8", "surrogatepass")
        if not self.map.units and not self.user:
            starts, ends = self._char_spans(text, raw)
            if not self.squeeze:
                return self._prefixed(text, starts, ends)
            out = list(text)
        else:
            out, starts, ends = self._walk(raw)
        return self._spaced(out, starts, ends)

    @staticmethod
    def _char_spans(text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int64)
        return starts, np.append(starts[1:], len(raw))

    def _walk(self, raw: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
        out: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        user = [u.encode() for u in self.user]
        at = 0
        while at < len(raw):
            whole = next((u for u in user if raw.startswith(u, at)), None)
            hit = (len(whole), whole) if whole is not None else self.map.longest(raw, at)
            if hit is None:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, raw[at : at + n]
            taken, new = hit
            chars = new.decode("utf-8", "surrogatepass")
            same = new == raw[at : at + taken]
            done = at
            for c in chars:
                out.append(c)
                size = len(c.encode("utf-8", "surrogatepass")) if same else 0
                starts.append(done if same else at)
                done += size
                ends.append(done if same else at + taken)
            at += taken
        return out, np.array(starts, np.int64), np.array(ends, np.int64)

    def _spaced(self, out: list[str], starts: np.ndarray, ends: np.ndarray) -> Normalised:
        """White space rules: squeeze, dummy prefix or suffix, word marks."""
        if self.squeeze:
            space = np.array([c == " " for c in out], bool)
            keep = ~(space & np.append(True, space[:-1]))
            last = np.flatnonzero([c != " " and not (self.escape and c == MARK) for c in out])
            keep[(last[-1] + 1 if len(last) else 0) :] = False
            out, starts, ends = [c for c, k in zip(out, keep, strict=True) if k], starts[keep], ends[keep]
            if not out:
                return Normalised("", starts, ends)
        return self._prefixed("".join(out), starts, ends)

    def _prefixed(self, text: str, starts: np.ndarray, ends: np.ndarray) -> Normalised:
        if self.prefix:
            edge = np.array([ends[-1]] if self.suffix else [starts[0]], np.int64)
            text = text + " " if self.suffix else " " + text
            starts, ends = (np.concatenate(x) for x in (((starts, edge), (ends, edge)) if self.suffix else ((edge, starts), (edge, ends))))
        return Normalised(text.replace(" ", MARK) if self.escape else text, starts, ends)

    # -- segmentation ----------------------------------------------------------------------------------------

    def ids(self, text: str | None) -> list[int]:
        """The ids of a text without its offsets."""
        return self.encode(text)[0]

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """(ids, spans): spans[i] are the first and the end byte of the source that piece i covers."""
        if not text:
            return [], np.zeros((0, 2), np.int64)
        normal = self.normalise(text)
        ids = self.merger.encode(normal.text) if normal.text else []
        return ids, self.project(ids, normal)

    def project(self, ids: list[int], normal: Normalised) -> np.ndarray:
        """Byte spans of the pieces. A run of byte pieces walks through the bytes of the characters it stands for."""
        if not ids:
            return np.zeros((0, 2), np.int64)
        a = np.array(ids, np.int64)
        if normal.starts is None:
            ends = np.cumsum(self.source_bytes[a]) - 1  # the dummy prefix has no source
            return np.stack([np.append(0, ends[:-1]), ends], 1)
        is_byte = self.is_byte[a]
        n = len(normal.text)
        if not is_byte.any() and not (a == self.unknown).any():
            stops = np.cumsum(self.n_chars[a])
            firsts = stops - self.n_chars[a]
            return np.stack([normal.starts[firsts], normal.ends[stops - 1]], 1)
        # positions in the normalised text's bytes, which every piece covers exactly
        sizes = np.frombuffer(normal.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.select([sizes < 0x80, sizes < 0x800, sizes < 0x10000], [1, 2, 3], 4).astype(np.int64)
        edges = np.append(0, np.cumsum(sizes))
        owner = np.repeat(np.arange(n), sizes)
        lengths = self.n_bytes[a].copy()
        if (a == self.unknown).any():
            lengths = self._unknown_lengths(a, lengths, normal.text)
        stops = np.cumsum(lengths)
        firsts = stops - lengths
        first_char, last_char = owner[firsts], owner[stops - 1]
        spans = np.stack([normal.starts[first_char], normal.ends[last_char]], 1)
        # a byte of a character that was kept as it is maps to its own source byte
        width = normal.ends[first_char] - normal.starts[first_char]
        own = is_byte & (width == sizes[first_char])
        begin = normal.starts[first_char] + firsts - edges[first_char]
        spans[own, 0] = begin[own]
        spans[own, 1] = begin[own] + 1
        return spans

    def _unknown_lengths(self, a: np.ndarray, lengths: np.ndarray, text: str) -> np.ndarray:
        """Without byte fallback a piece of unknown characters takes what the next known piece leaves."""
        raw, at = text.encode("utf-8", "surrogatepass"), 0
        for i, k in enumerate(a):
            if k == self.unknown:
                nxt = self.pieces[a[i + 1]].encode() if i + 1 < len(a) else None
                lengths[i] = (raw.index(nxt, at + 1) if nxt else len(raw)) - at
            at += lengths[i]
        return lengths

    # -- decoding --------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids: word marks become spaces, the dummy prefix goes, bytes that are not UTF-8 become U+FFFD."""
        if not ids:
            return ""
        at = 0
        while at < len(ids) and self.types[ids[at]] == CONTROL:
            at += 1
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix or self.squeeze:
            # a piece gives up one leading mark as long as no text stands before it; without squeezing only the first does
            marks = 0
            for k in ids[at:]:
                if self.types[k] in (BYTE, UNKNOWN) or not self.pieces[k].startswith(MARK):
                    break
                marks += 1
                if self.pieces[k] != MARK or not self.squeeze:
                    break
            raw = raw[marks:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._broken(raw)

    @staticmethod
    def _broken(raw: bytes) -> str:
        """One U+FFFD per byte that starts no valid character."""
        out, at = [], 0
        while at < len(raw):
            lead = raw[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ids array<int>, starts and ends array<int> (byte spans in the source)."""

    def make():
        encoder = Encoder(model_path)

        def fn(batch: pa.RecordBatch) -> dict:
            found = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "ids": [i for i, _ in found], "starts": [s[:, 0] for _, s in found], "ends": [s[:, 1] for _, s in found]}

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f"{id_col} {kind}, ids array<int>, starts array<int>, ends array<int>", make)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, digests of the ids and of the decoded text, bytes that the spans cover and a digest of the spans' ends."""

    def make():
        encoder = Encoder(model_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def fn(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "span_ends_sha256")}
            for text in batch.column(1).to_pylist():
                ids, spans = encoder.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(",".join(map(encoder.numbers.__getitem__, ids)).encode()))
                out["decoded_sha256"].append(sha(encoder.decode(ids).encode("utf-8", "surrogatepass")))
                out["span_bytes"].append(int((spans[:, 1] - spans[:, 0]).sum()))
                out["span_ends_sha256"].append(sha(spans[:, 1].astype("<u4").tobytes()))
            return {id_col: batch.column(0)} | out

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, span_ends_sha256 string", make)
