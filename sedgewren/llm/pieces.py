"""SentencePiece encoding and decoding with offsets.

The text is normalised through the model's compiled character map by longest prefix; every normalised byte remembers the source byte
that it came from. The normalised text is cut where no piece of the vocabulary has the two characters side by side, as no merge can
cross such a place; each unit's pieces merge by score, once per worker, and are then remembered. Every piece is projected back through
the alignment to its original byte span. The installed library only reads the model file.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices

SPACE = "▁"
#: Units remembered per worker, and the longest one that is.
REMEMBERED, LONGEST = 500_000, 64
#: The vocabulary's commonest characters, of those below LATIN, between which places to cut are looked up; next to others none is cut.
COMMON, LATIN = 255, 0x3000
#: Texts (or ids) of about so many bytes (or ids) are encoded (or decoded) at a time.
TEXT_BYTES = 1 << 20
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharMap:
    """Longest-prefix replacement by a compiled map: a double-array trie over UTF-8 bytes, then its zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if size else []
        self.values = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest key that starts at `at`, and its replacement."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.values[start : self.values.index(b"\0", start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << (unit >> 6 & 8)


class Model:
    """Vocabulary and normaliser of a BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != proto.TrainerSpec.BPE or any(p.type == USER for p in m.pieces):
            raise ValueError("a BPE model without user-defined pieces is needed")
        spec = m.normalizer_spec
        self.chars = CharMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, UNUSED)}
        self.scores = {p.piece: p.score for p in m.pieces if p.type in (NORMAL, UNUSED)}
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.end = next(i for i, p in enumerate(m.pieces) if p.type == CONTROL and p.piece == m.trainer_spec.eos_piece)
        control = {i for i, p in enumerate(m.pieces) if p.type == CONTROL}
        self.surface = [b"" if i in control else p.piece.encode() for i, p in enumerate(m.pieces)]
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])
        self.is_byte = np.zeros(len(self.surface), bool)
        self.is_byte[list(self.byte_ids.values())] = True
        self.is_control = np.zeros(len(self.surface), bool)
        self.is_control[list(control)] = True
        self.unknown_surface = m.trainer_spec.unk_surface.encode()
        if len(self.byte_ids) < 256:
            raise ValueError("a model with byte pieces is needed")
        self.surfaces = np.array(self.surface, object)
        # Bytes of a piece's span; the first byte of a character without a piece spans it all, the others nothing.
        self.widths = np.array([len(x) for x in self.surface])
        self.widths[list(self.byte_ids.values())] = [1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in self.byte_ids]
        self.kinds, self.joined = self._joined()
        self.memory: dict[str, bytes] = {}

    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of characters (0 is any that is not told apart), and by two kinds whether a piece may have them side by side."""
        counts = Counter(c for p in self.ids for c in p if ord(c) < LATIN)
        kinds = np.zeros(LATIN + 1, np.intp)
        for i, (c, _) in enumerate(counts.most_common(COMMON)):
            kinds[ord(c)] = i + 1
        joined = np.zeros((COMMON + 1, COMMON + 1), bool)
        joined[0, :] = joined[:, 0] = True
        for p in self.ids:
            of = [kinds[min(ord(c), LATIN)] for c in p]
            joined[of[:-1], of[1:]] = True
        return kinds, joined

    def normalised(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its bytes and its end the source byte; None if that is the byte less the added prefix."""
        if not text:
            return "", None
        if not self.chars.units and not self.trim:
            body = text.replace(" ", SPACE) if self.escape else text
            lead = (SPACE if self.escape else " ") if self.prefix else ""
            if not self.escape or " " not in text:
                source = None
            else:
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                width = len(SPACE.encode())
                source = np.concatenate([np.zeros(len(lead.encode()), np.int64), np.repeat(np.arange(len(raw)), np.where(raw == 32, width, 1)), [len(raw)]])
            return lead + body, source
        data = text.encode("utf-8", "surrogatepass")
        out, source, at = bytearray(), [], 0
        while at < len(data):
            if found := self.chars.longest(data, at) if self.chars.units else None:
                n, new = found
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at : at + n]
            out += new
            source += [at] * len(new)
            at += n
        source.append(len(data))
        if self.trim:  # leading, trailing and repeated spaces go
            first = len(out) - len(out.lstrip(b" "))
            kept = [i for i in range(first, len(out)) if out[i] != 32 or (i + 1 < len(out) and out[i + 1] != 32)]
            last, mark = len(kept), SPACE.encode() if self.escape else b" "
            while bytes(out[i] for i in kept[max(0, last - len(mark)) : last]) == mark or (last and out[kept[last - 1]] == 32):
                last -= 1 if out[kept[last - 1]] == 32 else len(mark)
            out, source = bytearray(out[i] for i in kept[:last]), [source[i] for i in kept[:last]] + [source[-1]]
        if not out:
            return "", None
        space = SPACE.encode() if self.escape else b" "
        text2, source2 = bytearray(space if self.prefix else b""), [0] * (len(space) if self.prefix else 0)
        for c, s in zip(out, source, strict=False):
            new = space if c == 32 else bytes([c])
            text2 += new
            source2 += [s] * len(new)
        return text2.decode("utf-8", "replace"), np.array([*source2, source[-1]])

    def merged(self, unit: str) -> list[str]:
        """Adjacent symbols whose union has the highest score merge first, the leftmost of equal ones."""
        symbols, scores = list(unit), self.scores
        if len(symbols) <= LONGEST:
            get, none = scores.get, -float("inf")
            pairs = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
            while pairs and (best := max(pairs)) != none:
                i = pairs.index(best)
                symbols[i] += symbols.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(symbols[i] + symbols[i + 1], none)
                if i:
                    pairs[i - 1] = get(symbols[i - 1] + symbols[i], none)
            return symbols
        after, before, heap = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(symbols) and (s := scores.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if symbols[i] != a or (j := after[i]) >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [s for s in symbols if s]

    def unit(self, unit: str) -> bytes:
        """Ids as int32 bytes; a character without a piece gives its bytes'."""
        ids: list[int] = []
        for s in self.merged(unit):
            if (i := self.ids.get(s)) is not None:
                ids.append(i)
            else:
                ids += [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
        return np.array(ids, "<i4").tobytes()

    def units(self, normal: str) -> list[str]:
        """Parts of a normalised text that merge by themselves."""
        kinds = self.kinds[np.minimum(np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), np.uint32), LATIN)]
        at = [0, *(np.flatnonzero(~self.joined[kinds[:-1], kinds[1:]]) + 1).tolist(), len(normal)]
        return [normal[i:j] for i, j in zip(at, at[1:])]

    def ids_of(self, normal: str) -> np.ndarray:
        found, memory = [], self.memory
        for u in self.units(normal) if normal else ():
            if (known := memory.get(u)) is None:
                known = self.unit(u)
                if len(u) <= LONGEST:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[u] = known
            found.append(known)
        return np.frombuffer(b"".join(found), "<i4")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids with the end id, and where each one's span of the text's UTF-8 bytes ends; it starts where the one before ends (bytes
        of one character share its span, the end id has an empty one)."""
        norm, source = self.normalised(text)
        ids = np.append(self.ids_of(norm), np.int32(self.end))
        ends = np.cumsum(self.widths[ids])
        if source is None:
            size = len(text.encode("utf-8", "surrogatepass"))
            ends = np.maximum(ends - (len(norm.encode("utf-8", "surrogatepass")) - size), 0)
        else:
            ends = source[ends]
        return ids, ends.astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces say nothing, byte pieces form UTF-8 (each byte that can't is U+FFFD), one leading space goes, with a model that
        trims all of them."""
        ids, surface = np.asarray(ids, np.int32), self.surface
        flags = self.is_byte[ids]
        plain = not self.trim or (len(ids) > 0 and surface[ids[0]].removeprefix(SPACE.encode()) != b"")
        if plain and self.unknown not in ids and self.byte_ids[0xE2] not in ids and not self.is_control[ids[:-1]].any():
            try:  # byte pieces lie between whole characters: if all is valid, each run of them is
                out = b"".join(self.surfaces[ids].tolist()).decode()
                return out.removeprefix(SPACE if self.prefix or self.trim else "").replace(SPACE, " ")
            except UnicodeDecodeError:
                pass
        parts: list[str] = []
        leading = self.prefix or self.trim
        for is_byte, run in _runs(ids.tolist(), flags.tolist()):
            raw = [self.unknown_surface if i == self.unknown else surface[i] for i in run]
            if is_byte:
                parts.append(_utf8(b"".join(raw)))
                continue
            for i, piece in enumerate(raw):
                if not leading or any(parts):
                    parts.append(b"".join(raw[i:]).decode("utf-8", "replace").replace(SPACE, " "))
                    break
                text = piece.decode("utf-8", "replace")
                shorter = text.removeprefix(SPACE)
                leading = self.trim or shorter == text
                parts.append(shorter.replace(SPACE, " "))
        return "".join(parts)


def _runs(ids: list[int], flags: list[bool]) -> Iterator[tuple[bool, list[int]]]:
    start = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or flags[i] != flags[start]:
            yield flags[start], ids[start:i]
            start = i


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            at += n
        return "".join(out)


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encode_pieces(df: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (all by default), piece_ids and piece_ends (arrays of int).

    path is a model file that every executor can open. piece_ids are the ids with the end id last; piece_ends are where each piece's
    span of the text's UTF-8 bytes ends. Spans are contiguous: each starts where the one before ends, and bytes of one character
    without a piece of its own share that character's. Null counts as empty and gives the end id alone. The two columns replace input
    columns of the same names.
    """
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("piece_ids", "piece_ends")]
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("piece_ids", ints), T.StructField("piece_ends", ints)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
            for b in slices(whole, sizes, TEXT_BYTES):
                pairs = [m.encode(x or "") for x in b.column(b.num_columns - 1).to_pylist()]
                offsets = pa.array(np.cumsum([0, *(len(i) for i, _ in pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[k] for p in pairs]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], names=[*b.schema.names[:-1], "piece_ids", "piece_ends"])

    return df.select(*[F.col(c) for c in keep], F.col(text_col).alias(free_name(df, "text_to_encode"))).mapInArrow(work, schema)


def decode_pieces(df: DataFrame, path: str, ids_col: str = "piece_ids", name: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """All columns but those of `drop`, and the text of ids_col. Null ids give the empty text; ids outside the vocabulary fail."""
    keep = [c for c in df.columns if c not in drop and c.lower() != name.lower()]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            sizes = pc.list_value_length(whole.column(whole.num_columns - 1)).to_numpy(zero_copy_only=False)
            for b in slices(whole, sizes, TEXT_BYTES):
                lists = b.column(b.num_columns - 1)
                flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
                texts = [m.decode(flat[i:j]) if j > i else "" for i, j in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], name])

    return df.select(*[F.col(c) for c in keep], F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias(free_name(df, "ids_to_decode"))).mapInArrow(work, schema)
