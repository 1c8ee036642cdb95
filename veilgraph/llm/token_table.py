"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: data blocks of prefix-compressed entries, a Bloom filter over
the keys' identifiers, a sparse index with the last key of every block, and a fixed footer. Keys are the
identifier as 9 sortable bytes and a 4-byte running number among equal identifiers; values are the ids as
little-endian unsigned integers of 2 or 4 bytes. Shard k holds smaller keys than shard k + 1.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.batches import slices
from veilgraph.plans.staging import new_path

MAGIC = b"VGSST001"
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, index bytes, filter at, filter bytes, entries, ids, magic
BLOCK_BYTES = 1 << 16
BITS_A_KEY, PROBES = 10, 7
#: Chunks that a worker keeps, and the longest of them, in characters.
CACHED_CHUNKS, CACHED_CHARS = 1_200_000, 64
#: Marks that the pre-tokenizer always parts from letters before them.
MARKS = ".,;:!?"
_SIGN = 1 << 63
_state: dict = {}


def key_of(doc_id: int | None, n: int = 0) -> bytes:
    """Bytes that sort as (null first, doc_id, n)."""
    return (b"\0" * 9 if doc_id is None else b"\1" + (doc_id + _SIGN).to_bytes(8, "big")) + n.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - _SIGN if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % size for i in range(PROBES)]


class TableWriter:
    """Writes one shard to a binary stream; keys must come in ascending order."""

    def __init__(self, out) -> None:
        self.out, self.at, self.block, self.index, self.filter_keys = out, 0, [], [], bytearray()
        self.size = self.entries = self.ids = 0
        self.last = b""
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and key <= self.last:
            raise ValueError("keys must ascend")
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.entries += 1
        self.ids += len(ids)
        self.filter_keys += key[:9]
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        size = max(64, BITS_A_KEY * self.entries)
        bits = np.zeros((size + 7) // 8 * 8, dtype=np.uint8)
        for i in range(0, len(self.filter_keys), 9):
            bits[_probes(bytes(self.filter_keys[i : i + 9]), size)] = 1
        bloom = struct.pack("<Q", size) + np.packbits(bits).tobytes()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        self.out.write(bloom + index)
        self.out.write(FOOTER.pack(self.at + len(bloom), len(index), self.at, len(bloom), self.entries, self.ids, MAGIC))


class TableReader:
    """Reads a shard: all entries in order, or one identifier by Bloom filter, binary search and one block."""

    def __init__(self, path: str) -> None:
        self.file = _open(path)
        end = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, magic = FOOTER.unpack(self._bytes(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token table: {path}")
        bloom, raw, at = self._bytes(bloom_at, bloom_n), self._bytes(index_at, index_n), 0
        self.filter_size, self.filter = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.keys, self.blocks = [], []
        while at < len(raw):
            n = struct.unpack_from("<H", raw, at)[0]
            self.keys.append(raw[at + 2 : at + 2 + n])
            self.blocks.append(struct.unpack_from("<QQ", raw, at + 2 + n))
            at += 18 + n
        self.unzip = zstandard.ZstdDecompressor()

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self.unzip.decompress(self._bytes(*self.blocks[i])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, np.frombuffer(data, f"<u{data[at]}", (n - 1) // data[at], at + 1)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier in the shard."""
        key, found = key_of(doc_id), []
        if not all(self.filter[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.filter_size)):
            return found
        for i in range(bisect_left(self.keys, key), len(self.blocks)):
            for k, ids in self.block(i):
                if k[:9] == key[:9]:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def _open(path: str):
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _words(tokenizer, ends: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of words of letters alone, all in one call: a word ends where a token that ends words stands."""
    ids = np.array(tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
    stops = np.flatnonzero(ends[ids]) + 1
    if len(stops) != len(words):  # a letter became more than letters, or the model marks no ends
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    data, at = ids.tobytes(), [0, *(4 * stops).tolist()]
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


def encoder(path: str):
    """texts -> ids of each by the tokenizer file at `path`.

    Its pre-tokenizer never joins text over white space or letters with marks, and its normaliser looks at no
    neighbours there, so the ids of a text are those of its white-space chunks in order, and those of a word with
    marks after it are the word's and the marks', as long as the normalised word is letters alone: a letter may become
    one and a mark, which joins what follows. A worker keeps the ids of the first CACHED_CHUNKS chunks of at most
    CACHED_CHARS characters.
    """
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        _state.update(path=path, tokenizer=tokenizer, ends=ends, chunks={})
    tokenizer, ends, chunks = _state["tokenizer"], _state["ends"], _state["chunks"]

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = {w for words in split for w in words if w not in chunks}
        parts, plain, odd = {}, set(), set()
        for w in new:
            base = w.rstrip(MARKS)
            if base.isalpha() if base.isascii() else unicodedata.normalize("NFC", base).lower().isalpha():
                parts[w] = (base, w[len(base) :])
                plain.add(base)
                odd.add(w[len(base) :])
            else:
                odd.add(w)
        known = {"": b""} | {w: chunks[w] for w in plain | odd if w in chunks}
        for todo, call in ((list(plain - known.keys()), lambda x: _words(tokenizer, ends, x)), (list(odd - known.keys()), lambda x: [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(x, add_special_tokens=False)])):
            known.update(zip(todo, call(todo) if todo else [], strict=True))
        found = {w: known[parts[w][0]] + known[parts[w][1]] if w in parts else known[w] for w in new}
        chunks.update(found)
        out = [np.frombuffer(b"".join(map(chunks.__getitem__, words)), "<u4") for words in split]
        full = len(chunks) > CACHED_CHUNKS
        for w in found:
            if full or len(w) > CACHED_CHARS:
                del chunks[w]
        return out

    return encode


def _write(out_dir: str, tokenizer_path: str, end_id: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root)
        name, part, stream, writer = f"shard-{shard:06d}.sst", f"{root}/.shard-{shard:06d}-{attempt}", None, None
        last, n = object(), 0
        for rows in slices(parts):
            encode = encoder(tokenizer_path)
            for doc_id, null, ids in zip(rows["id"], rows["no_id"], encode(list(rows["text"])), strict=True):
                if writer is None:
                    stream = store.open_output_stream(part)
                    writer = TableWriter(stream)
                doc_id = None if null else int(doc_id)
                n = n + 1 if doc_id == last else 0
                last = doc_id
                writer.add(key_of(doc_id, n), np.append(ids, np.array([end_id], "<u4")))
        if writer is not None:
            writer.close()
            stream.close()
            store.move(part, f"{root}/{name}")  # whole or absent, whichever attempt wins
            yield pd.DataFrame({"shard": [shard], "path": [f"{out_dir}/{name}"], "n_docs": [writer.entries], "n_ids": [writer.ids]})

    return run


def write_tables(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list:
    """Writes docs to shards under out_dir in ascending identifier order; returns (shard, path, n_docs, n_ids) rows.

    Null texts are empty and get the end id alone; a null identifier sorts first; rows that share an identifier
    are all kept, by text. An empty table writes no shard. Other columns are ignored. The list has a row a shard.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("no_id").desc(), F.col("id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    return sorted(placed.mapInPandas(_write(out_dir, tokenizer_path, end_id), "shard int, path string, n_docs long, n_ids long").collect())


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, start in zip(part["path"], part["start"], strict=True):
            rows = []
            for key, ids in TableReader(path):
                doc_id = id_of(key)
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 4096:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64")} | {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("start", "n_tokens", "ids_crc32"), 1)})


def read_tables(spark: SparkSession, shards: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards a task each."""
    at, base = [], 0
    for s in shards:
        at.append((s["path"], base))
        base += s["n_ids"]
    df = spark.createDataFrame(at, "path string, start long").repartition(max(1, len(at)))
    return df.mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_tables(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out_dir: str | None = None) -> DataFrame:
    """Writes the shards and returns what reading them back gives."""
    spark = docs.sparkSession
    return read_tables(spark, write_tables(docs, out_dir or new_path(spark, "tokens"), tokenizer_path, end_id))
