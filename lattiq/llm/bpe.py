"""Byte-level BPE encoding and decoding by corpus-level merge replay.

All distinct pieces of a batch are laid out in one flat array of byte tokens. An inverted index from a
merge's rank to the positions of its pair drives the replay: ranks are taken in ascending order, every
occurrence of the pair in the corpus is merged at once, and only the two neighbours of a merged position
get new pairs. Ids equal those of merging each piece alone, lowest rank and leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.chunks import ChunkEncoder
from lattiq.llm.common import by_bytes, ship, texts

NONE = np.int32(2**31 - 1)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a .tiktoken file: base64 of the token, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class MergeReplay:
    """ranks: token bytes to rank, which is the id as well."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.bytes = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        self.bytes_in = np.fromiter(map(len, self.vocabulary), np.int64, len(self.vocabulary))
        self.bytes_at = np.cumsum(self.bytes_in) - self.bytes_in
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and the number of ids of each."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = -1
        before[np.concatenate([[0], ends])[:-1]] = -1
        pair = np.full(n, NONE)
        joined = np.flatnonzero(after >= 0)
        pair[joined] = self.rank_of(token[joined], token[joined + 1])
        alive = np.ones(n, bool)
        # the inverted index: rank to the positions of its pair; later arrivals are kept aside
        order = np.argsort(pair, kind="stable")
        order = order[: np.searchsorted(pair[order], NONE)]
        found, at = np.unique(pair[order], return_index=True)
        index = {int(r): [p] for r, p in zip(found, np.split(order, at[1:]), strict=True)}
        waiting = list(index)
        heapq.heapify(waiting)
        again: set[int] = set()
        while waiting:
            rank = heapq.heappop(waiting)
            lists = index.pop(rank, None)
            if lists is None:
                continue
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[pair[p] == rank]
            if len(p) > 1:
                chained = np.flatnonzero(after[p[:-1]] == p[1:])
                if len(chained):  # pairs that share a token: from the left, every other one
                    linked = np.zeros(len(p), bool)
                    linked[chained + 1] = True
                    i = np.arange(len(p))
                    p = p[(i - np.maximum.accumulate(np.where(linked, 0, i))) % 2 == 0]
            if not len(p):
                continue
            gone = after[p]
            token[p], alive[gone], pair[gone] = rank, False, NONE
            following = after[gone]
            after[p] = following
            has = following >= 0
            before[following[has]] = p[has]
            left = before[p]
            starts = np.concatenate([p, left[left >= 0]])
            stops = after[starts]
            fresh = np.full(len(starts), NONE)
            live = stops >= 0
            fresh[live] = self.rank_of(token[starts[live]], token[stops[live]])
            pair[starts] = fresh
            real = fresh < NONE
            if real.any():
                starts, fresh = starts[real], fresh[real]
                early = fresh < rank
                if early.any():
                    again.update(piece[starts[early]].tolist())
                for r, q in zip(fresh.tolist(), starts.tolist(), strict=True) if len(fresh) < 32 else self._grouped(fresh, starts):
                    q = np.array([q]) if isinstance(q, int) else q
                    if r in index:
                        index[r].append(q)
                    else:
                        index[r] = [q]
                        heapq.heappush(waiting, r)
        ids, count = token[alive], np.bincount(piece[alive], minlength=len(pieces))
        if again:  # a merge gave a pair of lower rank: there the order within the piece matters
            out = np.split(ids, np.cumsum(count)[:-1])
            for i in again:
                out[i] = self.alone(pieces[i])
            ids, count = np.concatenate(out), np.array([len(x) for x in out])
        return ids, count

    @staticmethod
    def _grouped(ranks: np.ndarray, positions: np.ndarray):
        order = np.argsort(ranks, kind="stable")
        found, at = np.unique(ranks[order], return_index=True)
        return zip(found.tolist(), np.split(positions[order], at[1:]), strict=True)

    def alone(self, piece: bytes) -> np.ndarray:
        """One piece by a queue of its pairs: lowest rank first, leftmost among equals."""
        token = [int(self.byte[b]) for b in piece]
        after, before = [*range(1, len(token)), -1], [*range(-1, len(token) - 1)]
        alive = [True] * len(token)
        text = self.vocabulary

        def rank(i: int) -> int | None:
            return self.ranks.get(text[token[i]] + text[token[after[i]]]) if after[i] >= 0 else None

        queue = [(r, i) for i in range(len(token)) if (r := rank(i)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            token[i], alive[j], after[i] = r, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(queue, (q, k))
        return np.array([t for t, a in zip(token, alive, strict=True) if a], np.int32)

    def encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        found = [self.pattern.findall(c) for c in chunks.to_pylist()]
        of = np.fromiter((number.setdefault(p, len(number)) for x in found for p in x), np.int64)
        ids, sizes = self.replay([p.encode() for p in number])
        flat, ends = _gather(ids, np.cumsum(sizes) - sizes, sizes, of)
        pieces = np.fromiter(map(len, found), np.int64, len(found))
        return flat, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of the texts whose ids lie between the offsets."""
        flat, ends = _gather(self.bytes, self.bytes_at, self.bytes_in, ids)
        data, bounds = flat.tobytes(), np.concatenate([[0], ends])[offsets].tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `of` of a pool one after another, and where each ends."""
    sizes = length[of]
    ends = np.cumsum(sizes)
    at = np.repeat(start[of] - (ends - sizes), sizes)
    return pool[at + np.arange(len(at))], ends


#: Chunks that a worker keeps between slices: some 100 MB with what looks them up. Workers stay for the whole application, two a core at times.
REMEMBER = 250_000
_encoders: dict[tuple, tuple[MergeReplay, ChunkEncoder]] = {}


def encoder(data: bytes, pattern: str) -> tuple[MergeReplay, ChunkEncoder]:
    """One encoder per Python worker and vocabulary."""
    key = (hashlib.md5(data).digest(), pattern)
    if key not in _encoders:
        replay = MergeReplay(read_ranks(data), pattern)
        _encoders[key] = replay, ChunkEncoder(replay.encode_chunks, pattern, REMEMBER)
    return _encoders[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, broadcast; its size is that of a file of a few MB whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, keep_decoded: bool = False, digests: bool = False) -> DataFrame:
    """Encodes every text by the ranks of the file at `path`, and decodes the ids again.

    Returns doc_id, n_tokens, and with keep_ids: ids (array of int); with keep_decoded: decoded (binary); with
    digests: ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256.
    One row per row of docs, repeated rows included; a null text is an empty one and gives no ids; a null
    doc_id stays null; other columns are ignored. Long texts are handled whole: memory follows the
    longest text. An empty table gives an empty result.
    """
    ship(spark)
    data = vocabulary(spark, path)
    schema = "doc_id bigint, n_tokens bigint" + ", ids array<int>" * keep_ids + ", decoded binary" * keep_decoded + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, chunked = encoder(data.value, pattern)
        for whole in batches:
            for part in by_bytes(whole, limit=8 << 20):
                chunked.lengths(part.column(1))  # learns the chunks of some MB in one replay
                for batch in by_bytes(part):
                    ids, offsets = chunked.flat(batch.column(1))
                    decoded, bounds = replay.decode(ids, offsets), offsets.tolist()
                    out = {"doc_id": batch.column(0), "n_tokens": pa.array(np.diff(offsets), pa.int64())}
                    if keep_ids:
                        out |= {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))}
                    if keep_decoded:
                        out |= {"decoded": pa.array(decoded, pa.binary())}
                    if digests:
                        raw = ids.astype("<u4").tobytes()
                        out |= {"ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded])}
                    yield pa.RecordBatch.from_pydict(out)

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, schema)
