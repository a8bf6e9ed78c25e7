"""Token ids in sorted-string-table shards, written and read by executors.

A shard holds documents in key order. Layout, all integers little-endian, ``varint`` as in LEB128:

    block*   zstd of: entries of varint shared, varint unshared, varint value bytes, key tail, value; each block's first
             key is whole (shared 0), later keys leave out what they share with the key before
    index    zstd of, for each block: varint key length, first key, varint offset, size, documents, ids before the block
    bloom    bits of a Bloom filter over the keys
    footer   8 unsigned 64-bit integers: index offset and size, bloom offset and size, documents, ids, id width, hashes;
             then the magic

A key is a byte that tells a null id (0) from another (1), the id with its sign flipped (8 bytes, big-endian) and a
counter for rows that repeat the id (4 bytes); keys sort as ids do. A value is the ids at the shard's width.

A shard is written under a name of its attempt and then named in the manifest, which is made from the rows of the tasks
that succeeded: what a lost or repeated attempt has written is never read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shared_dir, ship
from .shingles import BoundedCache

MAGIC = b"QLSSTBL1"
_FOOTER = struct.Struct("<8Q")
_SIGN = 1 << 63


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder; Hadoop writes local ones as ``file:/...``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


def make_key(doc_id: int | None, repeat: int = 0) -> bytes:
    number = 0 if doc_id is None else (doc_id + _SIGN)
    return bytes([doc_id is not None]) + number.to_bytes(8, "big") + repeat.to_bytes(4, "big")


def split_key(key: bytes) -> tuple[int | None, int]:
    return (int.from_bytes(key[1:9], "big") - _SIGN if key[0] else None), int.from_bytes(key[9:], "big")


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
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bloom_bits(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), np.uint64).reshape(-1, 2)
    return (both[:, :1] + both[:, 1:] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Writes one shard; keys must ascend."""

    def __init__(self, out, width: int, block_bytes: int = 1 << 18, bits_per_key: int = 10):
        self.out, self.width, self.block_bytes, self.bits_per_key = out, width, block_bytes, bits_per_key
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.block, self.held, self.in_block, self.last, self.first = [], 0, 0, b"", b""
        self.at = self.documents = self.ids = self.ids_at_block = 0
        self.index: list[bytes] = []
        self.key_hashes: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.in_block else 0
        if not self.in_block:
            self.first = key
        entry = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value))
        self.block.append(entry)
        self.held += len(entry)
        self.in_block += 1
        self.last = key
        self.documents += 1
        self.ids += len(value) // self.width
        self.key_hashes.append(key)
        if self.held >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            data = self.zstd.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.first)) + self.first + b"".join(map(_varint, (self.at, len(data), self.in_block, self.ids_at_block))))
            self.at += len(data)
            self.block, self.held, self.in_block, self.ids_at_block = [], 0, 0, self.ids

    def close(self) -> None:
        self._flush()
        index = self.zstd.compress(b"".join(self.index))
        bits, hashes = max(64, self.bits_per_key * self.documents), max(1, round(self.bits_per_key * 0.69))
        bloom = np.zeros(bits, np.uint8)
        if self.key_hashes:
            bloom[_bloom_bits(self.key_hashes, bits, hashes).ravel().astype(np.int64)] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed + _FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.documents, self.ids, self.width, hashes << 32 | bits) + MAGIC)


class ShardReader:
    """Reads one shard, block by block or by key."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(_FOOTER.size + len(MAGIC), size - _FOOTER.size - len(MAGIC))
        if tail[_FOOTER.size :] != MAGIC:
            raise ValueError("not a shard")
        index_at, index_size, self.bloom_at, self.bloom_size, self.documents, self.ids, self.width, packed = _FOOTER.unpack(tail[: _FOOTER.size])
        self.hashes, self.bits = packed >> 32, packed & 0xFFFFFFFF
        self.zstd = zstandard.ZstdDecompressor()
        self.blocks: list[tuple[bytes, int, int, int, int]] = []
        data = self.zstd.decompress(source.read_at(index_size, index_at))
        at = 0
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at, numbers = data[at : at + n], at + n, []
            for _ in range(4):
                x, at = _read_varint(data, at)
                numbers.append(x)
            self.blocks.append((key, *numbers))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, size, _, _ = self.blocks[k]
        data, at, key = self.zstd.decompress(self.source.read_at(size, offset)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, data[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        """False only if the Bloom filter knows that the key isn't here."""
        bloom = np.frombuffer(self.source.read_at(self.bloom_size, self.bloom_at), np.uint8)
        at = _bloom_bits([key], self.bits, self.hashes)[0].astype(np.int64)
        return bool(np.all(bloom[at >> 3] >> (at & 7).astype(np.uint8) & 1))

    def get_all(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row of an id here: Bloom filter, binary search in the index, then one block, or those that its repeats fill."""
        first = make_key(doc_id)  # every id of a shard has a repeat 0 in it
        out: list[np.ndarray] = []
        if not self.may_have(first):
            return out
        for k in range(max(0, bisect_right(self.blocks, first, key=lambda b: b[0]) - 1), len(self.blocks)):
            if self.blocks[k][0][:9] > first[:9]:
                break
            out += [np.frombuffer(value, f"<u{self.width}") for key, value in self.block(k) if key[:9] == first[:9]]
        return out


def _byte_letters() -> dict[int, int]:
    """The letter for each byte in byte-level vocabularies: itself if it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


@lru_cache(2)
def _encoder(path: str, width: int):
    """Text to the bytes of its ids. The tokenizer drops white space and never joins across it, so words are encoded once and kept."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, kind, letters = tokenizer.model, "H" if width == 2 else "I", _byte_letters()

    def ids_of(word: str) -> bytes:
        if word and max(word) < "\u0100":  # nothing to compose; letters lower one by one
            # the tokenizer never joins letters with other signs
            if word[-1] in (",", ".") and word[:-1].isalpha():
                return kept[word[:-1]] + kept[word[-1]]
            if word.isalpha():
                lower = word.lower()
                if lower != word:
                    return kept[lower]
                ids = array(kind, [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(letters))])
                return ids.tobytes()
        return array(kind, tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    kept = BoundedCache(ids_of, 600_000)

    def encode(text: str | None) -> bytes:
        text = text or ""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            if "<|" not in text:  # special tokens are looked for in the text as it is
                text = text.lower()  # as the tokenizer does, letter by letter
        return b"".join(map(kept.__getitem__, text.replace("\n", " ").split(" ")))

    return encode


def word_tokenizer(path: str) -> bool:
    """Whether the file's pre-tokenizer removes white space, so that words may be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    return any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "\\s" in str(p.get("pattern")) for p in pre.get("pretokenizers", [pre]))


def write_shards(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, directory: str | None = None, shards: int | None = None) -> list[dict]:
    """Encode every text, append ``end_id``, write shards in ascending id order; returns the manifest, in shard order.

    ``tokenizer`` is the path of a tokenizers file on every worker. The rows are range-partitioned by id (and by a hash
    of the text, so that rows that repeat one id can be split), one shard a partition. The manifest has a small row for
    each shard. A null text is empty; null ids come first; an empty table gives an empty manifest.
    """
    ship(docs.sparkSession)
    from tokenizers import Tokenizer

    if not word_tokenizer(tokenizer):
        raise ValueError("this writer encodes word by word; the tokenizer must drop white space")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    target = (directory or shared_dir(docs.sparkSession)).rstrip("/") + f"/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(*([shards] if shards else []), "doc_id", F.xxhash64("text")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer, width), end_id.to_bytes(width, "little")
        store, folder = open_store(target)
        writer = out = first = None
        path, last, repeat = f"{folder}/{uuid.uuid4().hex}.sst", (), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(path)
                    writer, first = ShardWriter(out, width), doc_id
                repeat = repeat + 1 if (doc_id,) == last else 0
                last = (doc_id,)
                writer.add(make_key(doc_id, repeat), encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            out.close()
            info = store.get_file_info(path)
            yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "last": last[0], "documents": writer.documents, "ids": writer.ids, "bytes": info.size}], pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    written = dealt.mapInArrow(run, "path string, first long, last long, documents long, ids long, bytes long").withColumn("shard", F.spark_partition_id())
    manifest = sorted((r.asDict() for r in written.collect()), key=lambda m: m["shard"])
    start = 0
    for m in manifest:
        m |= {"folder": target, "start": start}
        start += m["ids"]
    store, folder = open_store(target)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/MANIFEST.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_shards(spark, manifest: list[dict]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` of every document, read from the shards, a task for each.

    Null ids and rows that repeat an id are read row by row, as they were written; an empty manifest gives an empty result.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = [(m["folder"], m["path"], m["start"]) for m in manifest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                folder, path, start = shards[at]
                with open_store(folder)[0].open_input_file(path) as source:
                    reader = ShardReader(source)
                    for k in range(len(reader.blocks)):
                        rows = []
                        for key, value in reader.block(k):
                            ids = np.frombuffer(value, f"<u{reader.width}")
                            rows.append((split_key(key)[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), at))
                            start += len(ids)
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(run, schema)


def lookup_all(manifest: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """The ids of each row that has an id (None: a null id), in the order of writing; empty if there is none.

    The manifest ascends, so the shards that can hold the id are found by binary search; in each, the Bloom filter and
    the block index lead to the blocks that can. Rows that repeat an id may lie in several blocks and shards.
    """
    order = lambda x: (x is not None, x or 0)
    out = []
    for m in manifest[bisect_left(manifest, order(doc_id), key=lambda m: order(m["last"])) :]:
        if order(m["first"]) > order(doc_id):
            break
        with open_store(m["folder"])[0].open_input_file(m["path"]) as source:
            out += ShardReader(source).get_all(doc_id)
    return out


def lookup(manifest: list[dict], doc_id: int | None) -> np.ndarray | None:
    """The ids of the first row that has an id (None: a null id), or None if there is no such row."""
    return next(iter(lookup_all(manifest, doc_id)), None)
