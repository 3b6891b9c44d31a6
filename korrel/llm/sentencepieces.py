"""SentencePiece encoding and decoding that keeps the place of every piece in the source.

Normalisation, alignment, projection and decoding are done here; the library only merges the characters of
distinct, already normalised chunks, whose results a worker keeps in a bounded table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"  # the visible space of the format
_SPACE_BYTES = SPACE.encode()
#: Chunks that a worker remembers; beyond that it forgets those not used lately.
REMEMBERED = 800_000


class CharsMap:
    """The compiled character map of a model: a double-array trie from UTF-8 prefixes to their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :]
        self.first = {b for b in range(1, 256) if self.units and self._step(self._child(0), b) is not None}

    def _child(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, at: int, byte: int) -> int | None:
        to = at ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[start:] and its replacement; None without one."""
        found, at = None, self._child(0) if self.units else 0
        for length in range(1, len(data) - start + 1):
            step = self._step(at, data[start + length - 1]) if self.units else None
            if step is None:
                break
            at = self._child(step)
            if self.units[step] >> 8 & 1:
                offset = self.units[at] & 0x7FFFFFFF
                found = (length, self.replacements[offset : self.replacements.index(b"\0", offset)])
        return found


class Normalizer:
    """Text to normalised UTF-8 bytes, with the source byte offset of each of them."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool = True):
        self.map, self.dummy_prefix, self.squeeze = CharsMap(charsmap), dummy_prefix, squeeze
        self.space = _SPACE_BYTES if escape else b" "

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The bytes, and one offset more than bytes: align[i] is where byte i comes from, align[-1] the source's end."""
        source = text.encode()
        if not self.map.units and not self.squeeze:
            return self._plain(source)
        return self._mapped(source)

    def _plain(self, source: bytes) -> tuple[bytes, np.ndarray]:
        if not source:
            return b"", np.zeros(1, np.int64)
        head = self.space if self.dummy_prefix else b""
        width = np.where(np.frombuffer(source, np.uint8) == 0x20, len(self.space), 1)
        align = np.concatenate([np.zeros(len(head), np.int64), np.repeat(np.arange(len(source)), width), [len(source)]])
        return head + source.replace(b" ", self.space), align

    def _mapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[bytes, int, int]] = []  # replacement, source start, source end
        at = 0
        while at < len(source):
            hit = self.map.longest(source, at) if source[at] in self.map.first else None
            if hit:
                parts.append((hit[1], at, at + hit[0]))
                at += hit[0]
            else:
                end = at + 1
                while end < len(source) and source[end] & 0xC0 == 0x80:
                    end += 1
                parts.append((source[at:end], at, end))
                at = end
        if self.squeeze:  # blanks at both ends go, and each run of blanks becomes one
            kept, blank = [], True
            for piece, start, end in parts:
                if blank:
                    piece = piece.lstrip(b" ")
                if piece:
                    kept.append((piece, start, end))
                    blank = piece.endswith(b" ")
            while kept and kept[-1][0].endswith(b" "):
                piece, start, end = kept.pop()
                if piece := piece.rstrip(b" "):
                    kept.append((piece, start, end))
                    break
            parts = kept
        if not any(p for p, _, _ in parts):
            return b"", np.array([len(source)])
        out, align = [], []
        if self.dummy_prefix:
            out.append(self.space)
            align += [parts[0][1]] * len(self.space)
        for piece, start, end in parts:
            made = piece.replace(b" ", self.space)
            out.append(made)
            align += range(start, end) if made == source[start:end] else [start] * len(made)
        return b"".join(out), np.array([*align, parts[-1][2]], np.int64)


class Remembered:
    """What a function of many strings gave for each, for the REMEMBERED strings that were used last or a little more."""

    def __init__(self, of: Callable[[list[str]], list[bytes]]):
        self.of, self.known, self.older = of, {}, {}

    def learn(self, lists: Iterable[list[str]]) -> None:
        """known has every string of the lists after this."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        new: set[str] = set()
        for x in lists:
            new.update(filterfalse(self.known.__contains__, x))
        if self.older:
            again = list(filter(self.older.__contains__, new))
            self.known.update(zip(again, map(self.older.__getitem__, again)))
            new.difference_update(again)
        new = list(new)
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.known.update(zip(part, self.of(part)))


class Codec:
    """One model's encoder and decoder, for use inside a task."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.dummy_prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        kinds = pb.ModelProto.SentencePiece
        self.surface, self.lengths, self.bytes, alone = [], [], {}, set(map(chr, range(32)))
        for i, p in enumerate(model.pieces):
            byte = int(p.piece[1:-1], 16) if p.type == kinds.BYTE else None
            if byte is not None:
                self.bytes[i] = byte
            self.lengths.append(1 if byte is not None else len(p.piece.encode()))
            shown = model.trainer_spec.unk_surface if p.type == kinds.UNKNOWN else "" if p.type == kinds.CONTROL else p.piece
            self.surface.append(shown.replace(SPACE, " ") if p.type != kinds.UNKNOWN else shown)
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                if re.search(f"[^{SPACE}]{SPACE}", p.piece):
                    raise ValueError("a piece holds an inner space: texts cannot be cut at spaces")
                if len(p.piece) > 1:
                    alone -= set(p.piece)
        # A character that no longer piece holds is a chunk of its own: no merge can reach across it.
        cut = "".join(map(re.escape, sorted(alone)))
        self.chunks = re.compile(f"[{cut}]|{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" if cut else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        for name, value in (("add_dummy_prefix", False), ("remove_extra_whitespaces", False), ("precompiled_charsmap", b"")):
            setattr(spec, name, value)
        model.ClearField("denormalizer_spec")
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.lengths = np.array(self.lengths, np.int64)
        # A character of its own that parts the chunks of one call, and its id; rare in texts, so not the line end.
        self.parting = next(((ch, ids[0]) for ch in sorted(alone - {"\n"}) if ch > "\0" and len(ids := self.merger.encode(ch)) == 1), None)
        self.ordinary = self.parting is not None and "\n" in alone and self.dummy_prefix and not self.squeeze and not self.normalizer.map.units
        self.words = Remembered(lambda new: self._merged([w if w[:1] == "\n" else SPACE + w for w in new]))
        self.exact = Remembered(self._merged)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each its [begin, end) in the bytes of the text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """encode() of each text; chunks that are new to all of them are merged in one call."""
        normal = [self.normalizer(t) for t in texts]
        words = [self._words(t) for t in texts]
        chunks = [self.chunks(data.decode()) if w is None else w for w, (data, _) in zip(words, normal)]
        self.words.learn(w for w in words if w is not None)
        self.exact.learn(c for w, c in zip(words, chunks) if w is None)
        out = []
        for (data, align), w, own in zip(normal, words, chunks):
            ids = np.frombuffer(b"".join(map((self.exact if w is None else self.words).known.__getitem__, own)), np.int32)
            ends = np.cumsum(self.lengths[ids])
            if len(ids) and ends[-1] != len(data):  # unknown characters of a model without byte pieces
                ends = self._ends(data.decode())
            bounds = align[np.concatenate([[0], ends])] if len(ids) else np.zeros(1, np.int64)
            out.append((ids, np.stack([bounds[:-1], bounds[1:]], 1)))
        return out

    def _words(self, text: str) -> list[str] | None:
        """The chunks of an ordinary text without the space that each begins with; one after a line end begins with that instead."""
        if not self.ordinary or not text or text[0] == " " or "  " in text or SPACE in text:
            return None
        return text.replace("\n", " \n").split(" ")

    def _merged(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as bytes. One text, parted by a byte that no merge crosses, is cheaper than many."""
        if self.parting is None:
            return [np.array(self.merger.encode(c), np.int32).tobytes() for c in chunks]
        ids = np.array(self.merger.encode(self.parting[0].join(chunks), num_threads=1), np.int32)
        cuts = np.concatenate([[-1], np.flatnonzero(ids == self.parting[1]), [len(ids)]])
        if len(cuts) != len(chunks) + 1:
            return [np.array(self.merger.encode(c), np.int32).tobytes() for c in chunks]
        data, at = ids.tobytes(), (cuts * 4).tolist()
        return [data[i + 4 : j] for i, j in zip(at, at[1:])]

    def _ends(self, normal: str) -> np.ndarray:
        proto = self.merger.encode(normal, return_type="proto")
        at, ends = 0, []
        for p in proto.pieces:
            at += len(p.surface.encode())
            ends.append(at)
        return np.array(ends, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become one replacement character each."""
        surface, plain = self.surface, self.bytes
        out, run, first = [], bytearray(), self.dummy_prefix or self.squeeze
        for i in ids.tolist() if isinstance(ids, np.ndarray) else ids:
            if i in plain:
                run.append(plain[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
                first = False
            piece = surface[i]
            if first and piece:
                first = False
                if piece[0] == " ":
                    piece = piece[1:]
            out.append(piece)
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)


def _utf8(data: bytes) -> str:
    """UTF-8 decoded; each byte outside a valid character gives U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The worker's codec for a model file."""
    return Codec(path)


def encode(docs: DataFrame, model: str, text: str = "text", prefix: str = "piece") -> DataFrame:
    """docs with {prefix}_ids, {prefix}_begins and {prefix}_ends (arrays of int; byte offsets) and {prefix}_decoded.

    Null texts count as empty; an empty text has empty arrays and decodes to "". All other columns stay as they
    are, repeated rows are encoded once each, and no row is moved: one narrow pass. Raises ValueError where docs
    has columns of the new names. A worker's memory holds one batch, one text's pieces and REMEMBERED chunks.
    """
    made = [f"{prefix}_{x}" for x in ("ids", "begins", "ends", "decoded")]
    taken = {c.lower() for c in docs.columns}
    if clash := [m for m in made if m.lower() in taken]:
        raise ValueError(f"columns exist already: {clash}")
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                ids, spans, back = [], [], []
                for i, s in c.encode_all([t or "" for t in rows.column(at).to_pylist()]):
                    ids.append(i)
                    spans.append(s)
                    back.append(c.decode(i))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
                both = np.concatenate(spans).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (np.concatenate(ids).astype(np.int32), both[:, 0].copy(), both[:, 1].copy())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *lists, pa.array(back, pa.string())], names=[*rows.schema.names, *made])

    new = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in made[:3]]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new, T.StructField(made[3], T.StringType())]))


def decode(rows: DataFrame, model: str, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """rows with the text of their ids in column `to`; null ids give null."""
    if to in rows.columns:
        raise ValueError(f"column {to} exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            back = [None if i is None else c.decode(i) for i in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())]))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 digests of its ids and of the text they decode to."""
    made = encode(docs.select("doc_id", "text"), model)
    return made.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("piece_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("piece_decoded", 256).alias("decoded_sha256"),
    )
