"""Token ids in fixed-width bit packing.

A token file is a set of Parquet rows, one for each block of whole documents, in the order of the corpus:
shard, block (their order), inside (the ids before it in its shard), n_ids, width, payload (the ids, `width` bits each, little-endian bit order),
keys and sizes (the documents of the block and their numbers of ids). An id's place is arithmetic: bit
i * width of the payload, so any run of ids can be unpacked alone. Parquet is only the container that
Spark can commit safely when executors are lost.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.bpe import vocabulary
from lattiq.llm.chunks import NOT_WS, ChunkEncoder
from lattiq.llm.common import Scratch, by_bytes, ship, texts

#: About as many ids are kept in a block; a longer document makes a longer one.
BLOCK_IDS = 1 << 16
FILE = "shard int, block int, inside bigint, n_ids bigint, width int, payload binary, keys array<bigint>, sizes array<bigint>"


def width_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """The `count` ids from number `start` on; only their bytes are looked at."""
    if count is None:
        count = len(payload) * 8 // width - start
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype(np.uint32)
    first = start * width
    raw = np.frombuffer(payload, np.uint8, -(-(first % 8 + count * width) // 8), first // 8)
    bits = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


class LibraryEncoder:
    """Distinct chunks through the tokenizers library, many at a time.

    Chunks that start with a space before a letter or sign and end in one are encoded joined (there the
    pre-tokenizer cuts anyway) and told apart by the bytes that their ids stand for; the others one by one.
    plain: whether the strings of special tokens are ordinary text; by default the library finds the tokens.
    """

    def __init__(self, data: bytes, joined: int = 64, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.joined = Tokenizer.from_str(data.decode()), joined
        self.tokenizer.encode_special_tokens = plain
        self.whole = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special))
        model = json.loads(data)["model"]["vocab"]
        self.size = np.zeros(size_of(data), np.int64)
        for token, i in model.items():  # each character of a token stands for one byte
            self.size[i] = len(token)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        alike = pc.match_substring_regex(column, rf"^ {NOT_WS}(?s:.*{NOT_WS})?$")
        if self.whole:
            alike = pc.and_not(alike, pc.match_substring_regex(column, "|".join(map(re.escape, self.whole))))
        alike = alike.to_numpy(zero_copy_only=False)
        together, alone = np.flatnonzero(alike), np.flatnonzero(~alike)
        cuts = np.append(np.arange(0, len(together), self.joined), len(together)).astype(np.int32)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), column.take(pa.array(together))), "")
        texts = groups.to_pylist() + column.take(pa.array(alone)).to_pylist()
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        order = np.concatenate([together, alone]).astype(np.int64)
        long = pc.binary_length(column).to_numpy()[together].astype(np.int64)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.searchsorted(np.cumsum(self.size[flat[: counts[: len(groups)].sum()]]), np.cumsum(long)) + 1
        counts = np.concatenate([np.diff(np.concatenate([[0], ends])), counts[len(groups) :]]).astype(np.int64)
        ends = np.cumsum(counts)
        sizes = np.zeros(len(column), np.int64)
        sizes[order] = counts
        starts = np.zeros(len(column), np.int64)
        starts[order] = ends - counts
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return flat[at + np.arange(len(flat))], sizes


def size_of(data: bytes) -> int:
    """One more than the greatest id of a tokenizer's file, added tokens included."""
    found = json.loads(data)
    return 1 + max([*found["model"]["vocab"].values(), *(t["id"] for t in found.get("added_tokens") or [])], default=0)


_encoders: dict[tuple, ChunkEncoder] = {}


def _encoder(data: bytes, pattern: str, plain: bool) -> ChunkEncoder:
    key = (hashlib.md5(data).digest(), pattern, plain)
    if key not in _encoders:
        library = LibraryEncoder(data, plain=plain)
        _encoders[key] = ChunkEncoder(library, pattern, whole=library.whole)
    return _encoders[key]


def write(spark: SparkSession, docs: DataFrame, path: str, pattern: str, target: str, end_id: int = 0, shards: int | None = None, plain: bool = False) -> None:
    """Encodes every text with the tokenizers library (add_special_tokens=False), appends end_id, and writes the token file.

    An id takes the fewest bits that hold every id of the vocabulary at `path`, and end_id. plain: whether the strings of
    special tokens in a text are ordinary text; by default they become those tokens, as in the library.
    Documents stand in ascending doc_id, equal ids by their text's hash and text, a null id first. Rows are
    ranged by (doc_id, hash) before they are encoded, so one id that many rows share is still split. A null
    text is an empty one; repeated rows are written as often as they occur; an empty table writes no block.
    """
    ship(spark)
    data = vocabulary(spark, path)
    width = width_for(max(size_of(data.value), end_id + 1))
    docs = texts(docs).withColumn("h", F.xxhash64("text"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = docs.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunked, shard, block = _encoder(data.value, pattern, plain), TaskContext.get().partitionId(), 0
        keys, held, total, inside = [], [], 0, 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "inside": pa.array([inside], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "width": pa.array([width], pa.int32()),
                "payload": pa.array([pack(ids, width)], pa.binary()), "keys": pa.array([keys], pa.list_(pa.int64())), "sizes": pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
            })

        for whole in batches:
            for batch in by_bytes(whole, limit=8 << 20):
                ids, offsets = chunked.flat(batch.column(1))
                for key, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    keys.append(key)
                    held.append(np.append(ids[a:b], np.uint32(end_id)))
                    total += b - a + 1
                    if total >= BLOCK_IDS:
                        yield row()
                        keys, held, total, inside, block = [], [], 0, inside + total, block + 1
        if held:
            yield row()

    ranged.mapInArrow(run, FILE).write.parquet(target)


def open_file(spark: SparkSession, target: str) -> DataFrame:
    """The blocks of a token file with the number of ids before each (first_id).

    A block knows the ids before it in its shard; only the shards' totals are summed, and joined to the blocks. A file
    without blocks gives no rows."""
    blocks = spark.read.schema(FILE).parquet(target)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row of two numbers for each shard, and a shard is a write task: as bounded as the list of tasks
    return blocks.join(F.broadcast(before), "shard").withColumn("first_id", F.col("before") + F.col("inside")).drop("before")


def read_run(spark: SparkSession, target: str, start: int, count: int) -> np.ndarray:
    """The ids start ... start + count - 1 of the corpus, from the blocks that hold them alone."""
    near = open_file(spark, target).filter((F.col("first_id") < start + count) & (F.col("first_id") + F.col("n_ids") > start))
    parts = []
    for r in near.orderBy("first_id").toLocalIterator():
        a, b = max(start, r.first_id), min(start + count, r.first_id + r.n_ids)
        parts.append(unpack(bytes(r.payload), r.width, a - r.first_id, b - a))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def documents(blocks: DataFrame) -> DataFrame:
    """Per document of open_file()'s blocks: doc_id, start, n_tokens (with the end id), ids_crc32.

    A row for each row that was written: repeated and null ids as often as they were given, empty texts with the end
    id alone; no blocks give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                ids = unpack(r["payload"], r["width"], 0, r["n_ids"]).astype("<u4")
                crc = [zlib.crc32(ids[e - s : e].tobytes()) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r["keys"], pa.int64()), "start": pa.array(r["first_id"] + ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return blocks.select("n_ids", "width", "payload", "keys", "sizes", "first_id").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(spark: SparkSession, docs: DataFrame, path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """write() to the shared folder, then documents() of what stands there; nulls, repeated rows and empty tables as there."""
    scratch = Scratch(spark, "token-file")
    target = scratch.path("file")
    write(spark, docs, path, pattern, target, end_id)
    return documents(open_file(spark, target))
