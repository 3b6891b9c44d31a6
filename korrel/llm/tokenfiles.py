"""Token ids as Arrow files: fixed-size-list batches of equal-length sequences and masks, in the order of a key.

A file is in the Arrow IPC file format: a stream of record batches with a footer that gives each batch's place, so a
reader that maps the file has any sequence without reading or copying the others. Its columns, one row per sequence:

    ids   fixed_size_list<uint16 or uint32>[length]   ids of consecutive documents; 0 behind the last one
    mask  fixed_size_list<bool>[length]               whether the place holds an id
    last  fixed_size_list<bool>[length]               whether it is a document's last id
    keys  list<key>                                   keys of the documents that end in the sequence

Metadata of the schema holds the file's place (part, file). A document never crosses files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korrel.llm import wordids
from korrel.plans.scratch import scratch_path, stored

#: Ids of a sequence, sequences of a batch, ids after which a file ends (with the document that reaches them).
LENGTH, BATCH, FILE = 2048, 512, 2 << 20
#: Chunks whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
# Fixed value: the last six bytes of every file of the format.
MAGIC = "ARROW1"
# Fixed value: the pattern of a pre-tokenizer whose texts can be cut.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of text that are encoded together.
BLOCK = 1 << 20
#: What lies between chunks: blanks that the tokenizer drops itself, and across which no token reaches.
BETWEEN = wordids.kept((0x09, 0x0D), (0x20, 0x20))


_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_ALNUM, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[0x21:0x7F] = ~_ALNUM[0x21:0x7F]


def _edges(data: np.ndarray) -> np.ndarray:
    """Where a sign follows a letter or digit, or one of these a sign that is no apostrophe.

    Letters are those of ASCII and U+00C0 to U+00FF. Signs are ASCII, so nothing composes across such a place; an
    apostrophe stays with what follows, as the two may be one piece.
    """
    after = np.append(data[1:], 0)
    pair = (data == 0xC3) & (after != 0x97) & (after != 0xB7)
    first, last = _ALNUM[data] | pair, _ALNUM[data]
    last[1:] |= pair[:-1]
    out = np.zeros(len(data), bool)
    sign = _SIGN[data]
    out[1:] = last[:-1] & sign[1:] | sign[:-1] & (data[:-1] != 0x27) & first[1:]
    return out


class Encoder:
    """Encodes columns of texts inside a task.

    Where the tokenizer drops white space and splits words from signs, texts are cut there and each distinct chunk is
    encoded once; texts with a special token's string, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        normal, (split, *rest) = normal.get("normalizers", [normal]), pre.get("pretokenizers", [pre])
        regex = lambda x: (x.get("pattern") or {}).get("Regex", "")
        plain = all(x.get("type") in (None, "NFC", "Lowercase") or x.get("type") == "Replace" and regex(x) == r"\s+" for x in normal)
        drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and regex(split) == WORDS
        level = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex", True) for x in rest)
        added = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.cut = bool(plain and drops and level and not added)
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Begins the store of chunks anew: the place of each chunk's ids in one array."""
        self.known: dict[bytes, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        made = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(made), self.kind), np.fromiter(map(len, made), np.int64, len(made))

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks. Words of letters only are one piece of text each, so they are encoded a hundred at a
        time, with blanks between, and told apart by the ids that end words."""
        word = np.fromiter((_WORD(c) is not None for c in chunks), bool, len(chunks))
        words = [c for c, w in zip(chunks, word) if w]
        ids, _ = self._encode([b" ".join(words[lo : lo + 100]).decode() for lo in range(0, len(words), 100)])
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != len(words):
            return self._encode([c.decode() for c in chunks])
        other, many = self._encode([c.decode() for c, w in zip(chunks, word) if not w])
        sizes, begins = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        sizes[word], sizes[~word] = np.diff(ends, prepend=0), many
        begins[word], begins[~word] = ends - sizes[word], len(ids) + np.cumsum(many) - many
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate([ids, other])[np.repeat(begins - upto[:-1], sizes) + np.arange(upto[-1])], sizes

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """The numbers of chunks in the store, which takes in new ones."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [c for c in chunks if c not in self.known]
        if new:
            parts = [self._encode_chunks(new[lo : lo + 20_000]) for lo in range(0, len(new), 20_000)]
            sizes = np.concatenate([n for _, n in parts])
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, *[x for x, _ in parts]])
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def __call__(self, column: pa.Array, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, where each row's begin and end) block by block; each row ends with the id `end`."""
        column = column.fill_null("") if column.null_count else column
        whole = np.full(len(column), not self.cut)
        for x in self.special:
            whole |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        texts = pc.if_else(pa.array(whole), "", column) if whole.any() else column
        for found in wordids.numbered(texts, BETWEEN, wordids.SAME, BLOCK, _edges):
            n = found.hi - found.lo
            of = self._learn(found.words.to_pylist())[found.ids] if len(found.words) else found.ids
            flat, begins, sizes, first = self.flat, self.begins[of], self.sizes[of], found.first
            alone = np.flatnonzero(whole[found.lo : found.hi])
            if len(alone):  # the ids of a whole text stand where its chunks would
                ids, many = self._encode(column.slice(found.lo, n).take(pa.array(alone)).to_pylist())
                at = first[alone]
                begins, sizes = np.insert(begins, at, len(flat) + np.cumsum(many) - many), np.insert(sizes, at, many)
                first = first + np.concatenate([[0], np.cumsum(whole[found.lo : found.hi])])
                flat = np.concatenate([flat, ids])
            upto = np.concatenate([[0], np.cumsum(sizes)])
            out = flat[np.repeat(begins - upto[:-1], sizes) + np.arange(upto[-1])]
            edges = upto[first]
            if end is not None:
                out, edges = np.insert(out, edges[1:], end), edges + np.arange(n + 1)
            yield found.lo, found.hi, out, edges


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)


def _file(ids: np.ndarray, ends: np.ndarray, keys: pa.Array, length: int, place: dict[str, str]) -> pa.Buffer:
    """One file of the documents that end before the places `ends`."""
    n = max(1, -(-len(ids) // length))
    room = n * length
    padded, mask, last = np.zeros(room, ids.dtype), np.zeros(room, bool), np.zeros(room, bool)
    padded[: len(ids)], mask[: len(ids)], last[ends - 1] = ids, True, True
    upto = np.searchsorted(ends, np.arange(n + 1) * length, "right").astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(upto), keys)
    fixed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), length)
    table = pa.table({"ids": fixed(padded), "mask": fixed(mask), "last": fixed(last), "keys": listed}).replace_schema_metadata(place)
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table, max_chunksize=BATCH)
    return out.getvalue()


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1, key: str = "doc_id", text: str = "text", length: int = LENGTH, size: int = FILE) -> None:
    """Writes the ids of docs (key, text) as files of `folder`, in ascending order of key (nulls first), then of text.

    Each document is encoded whole, without added special tokens, and ends with the id `end`; a null text is empty.
    Without `end`, documents of no ids would leave no mark, so it must be given then (ValueError in the task). Rows
    that repeat a key are documents of their own. Ranges of keys are sorted apart; a file holds about `size` ids of
    one range, and is written by Spark's committer, so one that a lost executor began is not seen.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, ends, keys, n = [], [], [], 0

        def closed() -> pa.RecordBatch:
            whole = _file(np.concatenate(ids), np.concatenate(ends), pa.concat_arrays(keys), length, {"part": str(part), "file": str(made)})
            value = whole[: whole.size - len(MAGIC)]
            sizes = pa.py_buffer(np.array([0, value.size], np.int32))
            return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, sizes, value])], names=["file"])

        for batch in batches:
            for lo, hi, out, edges in encode(batch.column(1), end):
                if (np.diff(edges) == 0).any():
                    raise ValueError("a document without ids needs an end id")
                while lo < hi:  # as many documents as the file has room for, one at least
                    k = max(1, int(np.searchsorted(edges, edges[0] + size - n, "right")) - 1)
                    ids.append(out[edges[0] : edges[k]])
                    ends.append(edges[1 : k + 1] - edges[0] + n)
                    keys.append(batch.column(0).slice(lo, k))
                    n, lo, edges = n + int(edges[k] - edges[0]), lo + k, edges[k:]
                    if n >= size:
                        yield closed()
                        ids, ends, keys, n, made = [], [], [], 0, made + 1
        if n:
            yield closed()

    # A file is one value of one row. Spark's text writer puts a value's bytes down as they are, and after each the
    # line separator: the format's closing bytes, which are therefore left off the value.
    files = rows.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).text(folder)


class TokenFile:
    """Random access to one file's sequences: source is a path, which is mapped into memory, or a buffer."""

    def __init__(self, source: str | bytes | pa.Buffer):
        self.reader = pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source))
        self.place = {k.decode(): int(v) for k, v in (self.reader.schema.metadata or {}).items()}

    def __len__(self) -> int:
        batches = self.reader.num_record_batches
        return (batches - 1) * BATCH + self.reader.get_batch(batches - 1).num_rows if batches else 0

    def _row(self, i: int, name: str) -> pa.Array:
        if not 0 <= i < len(self):
            raise IndexError(i)
        column = self.reader.get_batch(i // BATCH).column(name)
        return column.slice(i % BATCH, 1).flatten()

    def ids(self, i: int) -> np.ndarray:
        """The ids of a sequence, a view of the file."""
        return self._row(i, "ids").to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        """Which places of a sequence hold ids, a view of the file's bits."""
        return self._row(i, "mask")

    def documents(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """All ids of the file, the place behind each document's last one, and the documents' keys."""
        table = self.reader.read_all().combine_chunks()
        flat = lambda name: table.column(name).combine_chunks().flatten()
        held = flat("mask").to_numpy(zero_copy_only=False)
        return flat("ids").to_numpy()[: int(held.sum())], np.flatnonzero(flat("last").to_numpy(zero_copy_only=False)) + 1, flat("keys")


def read(spark: SparkSession, folder: str, key_type: str = "long") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document of a folder of files, read from them.

    start counts the ids of all documents before it, in all files; ids_crc32 is over the ids as little-endian
    unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                ids, ends, keys = file.documents()
                wide, begins = ids.astype("<u4"), np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sums = [crc32(wide[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(ends)
                place = [pa.array(np.full(n, file.place[x]), pa.int32()) for x in ("part", "file")]
                columns = [keys, pa.array(begins), pa.array(ends - begins), pa.array(sums, pa.int64()), *place]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "n_tokens", "ids_crc32", "part", "file"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    rows = stored(content.mapInArrow(run, f"key {key_type}, at long, n_tokens long, ids_crc32 long, part int, file int"), "documents")
    # Ids before each file: a number per file within its part, and a number per part.
    files = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    inside = files.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("file")) - F.col("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("m")).select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("ahead"))
    starts = inside.join(parts, "part").select("part", "file", (F.col("before") + F.col("ahead")).alias("before"))
    return rows.join(starts, ["part", "file"]).select("key", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of docs, read back from the files that it writes to folder (a new one by default)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    write(docs, folder, tokenizer, end, key, text)
    return read(spark, folder, docs.schema[key].dataType.simpleString()).withColumnRenamed("key", key)
