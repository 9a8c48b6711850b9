"""Token ids in sorted-string-table shards.

A shard is one file of documents in ascending key order:

    data blocks     entries (shared key bytes, other key bytes, n_ids, other key, ids as <u2 or <u4)
    block index     first key and place of every block: binary search finds a key's block
    Bloom filter    over the keys: most absent keys are refused without a block read
    footer          counts and places of the parts, checksum, magic

The key is the document id as 8 big-endian bytes with the sign bit flipped (a
null id, below all others, is the empty key), so byte order is id order. Within
a block a key drops the bytes it shares with the key before it.

Spark range-partitions the documents by id and sorts each partition; a task
streams its partition into one file. Files are written under an attempt's own
name and moved into place, so a task that is run again leaves one whole shard.
Equal ids are dealt by a hash of the text as well: one id with very many rows
fills several shards. Rows of one id stand in the order of that hash.

Defined results: a null text is empty and encodes to the end id alone; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, scratch_path, text_or_empty, tidied

MAGIC = b"TVXSST01"
_FOOTER = struct.Struct("<QQQQQQBBI8s")  # entries, ids, index place, blocks, bloom place, bloom bytes, id width, hashes, crc, magic
_ENTRY = struct.Struct("<BBI")


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Writes ascending (key, ids); memory is one block, the index and the keys."""

    def __init__(self, out, id_width: int = 2, block_bytes: int = 64 << 10, bits_per_key: int = 10):
        self.out, self.block_bytes, self.bits_per_key, self.id_width = out, block_bytes, bits_per_key, id_width
        self.block, self.index, self.keys, self.last, self.place = bytearray(), [], bytearray(), b"", 0
        self.first, self.entries, self.ids = b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self.id_width}").tobytes()
        self.keys += struct.pack("<B", len(key)) + key
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, self.place, len(self.block)))
            self.out.write(bytes(self.block))
            self.place += len(self.block)
            self.block.clear()

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-self.entries * self.bits_per_key // 8) * 8)
        hashes = max(1, round(self.bits_per_key * math.log(2)))
        bloom, at = bytearray(bits // 8), 0
        while at < len(self.keys):
            n = self.keys[at]
            for p in _bloom_places(bytes(self.keys[at + 1 : at + 1 + n]), bits, hashes):
                bloom[p >> 3] |= 1 << (p & 7)
            at += 1 + n
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", p, n) for k, p, n in self.index)
        index_at, bloom_at = self.place, self.place + len(index)
        crc = zlib.crc32(bytes(bloom), zlib.crc32(index))
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(_FOOTER.pack(self.entries, self.ids, index_at, len(self.index), bloom_at, len(bloom), self.id_width, hashes, crc, MAGIC))


class ShardReader:
    """Reads a shard through any seekable file: whole in key order, or one key by binary search."""

    def __init__(self, source, size: int):
        self.source = source
        foot = self._read(size - _FOOTER.size, _FOOTER.size)
        self.entries, self.ids, index_at, blocks, bloom_at, bloom_bytes, self.id_width, self.hashes, crc, magic = _FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index = self._read(index_at, bloom_at - index_at)
        self.bloom = self._read(bloom_at, bloom_bytes)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError("token shard is damaged")
        self.firsts, self.places, at = [], [], 0
        for _ in range(blocks):
            n = index[at]
            self.firsts.append(index[at + 1 : at + 1 + n])
            self.places.append(struct.unpack_from("<QQ", index, at + 1 + n))
            at += 17 + n

    def _read(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def _block(self, number: int):
        data = self._read(*self.places[number])
        at, key = 0, b""
        while at < len(data):
            shared, other, n = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, np.frombuffer(data, f"<u{self.id_width}", n, at)
            at += n * self.id_width

    def __iter__(self):
        for number in range(len(self.places)):
            yield from self._block(number)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, len(self.bloom) * 8, self.hashes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every row with this key, in file order."""
        if not self.places or not self.may_hold(key):
            return []
        found, number = [], max(0, bisect_right(self.firsts, key) - 1)
        while number > 0 and self.firsts[number] == key:  # a key's rows may begin in an earlier block
            number -= 1
        for k in range(number, len(self.places)):
            if self.firsts[k] > key:
                break
            found += [ids for other, ids in self._block(k) if other == key]
        return found


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _byte_symbols() -> list[str]:
    """The printable characters that byte-level vocabularies write bytes as."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


#: The normaliser and the word rule of the file under which units are independent of one another and plain ones are words.
BY_UNITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WholeEncoder:
    """Ids of whole texts by the tokenizers library: for a tokenizer whose rules allow no shortcut."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for lo in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 64], add_special_tokens=False)]


class UnitEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct unit.

    A unit is what stands between ASCII white space. The tokenizer's words never
    hold white space and its normaliser works on either side of it separately,
    so a text's ids are its units' ids one after the other. A unit of Latin
    letters, with or without punctuation behind, is one or two of the
    tokenizer's words: those go straight to its model. All others go through
    the whole tokenizer. At most `kept` units are remembered; the memory starts
    afresh beyond that.
    """

    TAIL = ".,;:!?%$*#&|)"

    def __init__(self, path: str, kept: int = 1_000_000, longest: int = 64):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.kept, self.longest = Tokenizer.from_file(path), kept, longest
        self.model, self.symbols = self.tokenizer.model, _byte_symbols()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of one of the tokenizer's words, already in lower case."""
        if not word.isascii():
            word = "".join([self.symbols[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(word)], self.dtype).tobytes()

    def _direct(self, unit: str) -> bytes | None:
        core = unit.rstrip(self.TAIL)
        low = core.lower()
        # Below U+0250 letters are composed, alike in every Unicode version, and, but for one, lower-case to one letter.
        if core and not (core.isalpha() and len(low) == len(core) and (core.isascii() or max(core) < "\u0250")):
            return None
        ids = self.known.get(low) if low else b""
        if ids is None:
            ids = self.known[low] = self._word(low)
        tail = unit[len(core) :]
        if tail:
            more = self.known.get(tail)
            if more is None:
                more = self.known[tail] = self._word(tail)
            ids += more
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > self.kept:
            self.known.clear()
        known, rest, once = self.known, [], {}
        for units in split:
            for u in set(units).difference(known):
                ids = self._direct(u) if len(u) <= self.longest else None
                if ids is None:
                    rest.append(u)
                    known[u] = b""  # not asked for twice; filled in below
                else:
                    known[u] = ids
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[u] = np.array(e.ids, self.dtype).tobytes()
                if len(u) > self.longest:
                    once[u] = True
        out = [np.frombuffer(b"".join(map(known.__getitem__, units)), self.dtype) for units in split]
        for u in once:  # long units are not remembered
            known.pop(u, None)
        return out


def encodes_by_units(path: str) -> bool:
    """Whether the file's normaliser, word rule and model are those that UnitEncoder's shortcut holds for."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    plain = rules["model"]["type"] == "BPE" and not any(rules["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    alone = all(t["special"] and not (t["lstrip"] or t["rstrip"]) and not any(c.isspace() for c in t["content"]) for t in rules["added_tokens"])
    return plain and alone and all(rules[k] == v for k, v in BY_UNITS.items())


_encoders: dict[str, UnitEncoder | WholeEncoder] = {}


def encoder(path: str) -> UnitEncoder | WholeEncoder:
    """One encoder a Python worker; workers are used again by later tasks."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path) if encodes_by_units(path) else WholeEncoder(path)
    return _encoders[path]


_WRITTEN = T.StructType([T.StructField("shard", T.LongType()), T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_token_shards(docs: DataFrame, tokenizer_path: str, target: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into `target`, a folder all executors share; one row for each file, in key order by `shard`."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = keyed.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, folder = open_store(target)
        enc = encoder(tokenizer_path)
        width = 2 if max(end_id, enc.tokenizer.get_vocab_size() - 1) < 1 << 16 else 4
        temporary, final = f"{folder}/_attempt-{uuid.uuid4().hex}", f"{folder}/shard-{shard:06d}.sst"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(temporary) as out:
            writer = ShardWriter(out, width)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                        writer.add(key_bytes(doc_id), np.append(ids, ids.dtype.type(end_id)))
            writer.close()
        store.move(temporary, final)
        size = store.get_file_info(final).size
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (f"shard-{shard:06d}.sst", pa.string()), (size, pa.int64()), (writer.entries, pa.int64()), (writer.ids, pa.int64()))], names=[f.name for f in _WRITTEN])

    return dealt.mapInArrow(tidied(run), _WRITTEN)


_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_token_shards(written: DataFrame, target: str, base: dict[int, int], batch_rows: int = 4096) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens and crc32 of the ids of each row. base: the ids before each shard."""

    def run(batches):
        store, folder = open_store(target)
        for batch in batches:
            for shard, file, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{folder}/{file}") as source:
                    start, rows = base[shard], []
                    for key, ids in ShardReader(source, size):
                        rows.append((key_id(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= batch_rows:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return written.select("shard", "file", "bytes").repartition(max(1, len(base))).mapInArrow(tidied(run), _READ)


def _rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.name for f in _READ])


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes docs as shards in the shared folder and returns what the files hold.

    The driver sees one row a shard (its file name and counts), no document.
    """
    spark: SparkSession = docs.sparkSession
    target = scratch_path(spark, "sst")
    files = sorted(write_token_shards(docs, tokenizer_path, target, end_id).collect())
    base, total = {}, 0
    for f in files:
        base[f.shard] = total
        total += f.n_ids
    return read_token_shards(spark.createDataFrame(files, _WRITTEN), target, base)
