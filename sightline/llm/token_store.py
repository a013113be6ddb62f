"""Token ids in binary shards with a minimal perfect hash index over document keys.

A shard is one file: the raw ids of its documents in key order, then the index, then a
footer and its size. The index holds the keys, the offset of each document, and a minimal
perfect hash from key to document with a stored fingerprint, so that a key is found (or
seen to be absent) with one hash evaluation and one comparison.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import filesystem, new_folder, released, texts
from sightline.llm.tokens import crc_of, word_encoder

MAGIC = b"SLTS0001"
_U = np.uint64


def _hash(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15) * (np.array(seed, dtype=np.uint64, ndmin=1) + _U(1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class PerfectHash:
    """Hash and displace: keys fall into small buckets, and each bucket gets a seed that
    sends its keys to free slots; a bucket of one key stores its slot as -1 - slot."""

    def __init__(self, seeds: np.ndarray, n: int) -> None:
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: np.ndarray, load: int = 4) -> PerfectHash:
        n = len(keys)
        seeds = np.zeros(max(1, n // load), dtype=np.int64)
        bucket = (_hash(keys, 0) % _U(len(seeds))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(seeds))
        ends = np.cumsum(sizes)
        taken = np.zeros(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own, first = keys[order[ends[b] - sizes[b] : ends[b]]], 1
            while True:
                tries = np.arange(first, first + 32, dtype=np.uint64)[:, None]
                slots = (_hash(own[None, :], tries) % _U(n)).astype(np.int64)
                good = ~taken[slots].any(axis=1)
                for t in np.flatnonzero(good):
                    if len(np.unique(slots[t])) == len(own):
                        seeds[b], taken[slots[t]] = first + t, True
                        break
                else:
                    first += 32
                    continue
                break
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):
            seeds[b] = -1 - next(free)
        return cls(seeds, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), dtype=np.int64)
        seed = self.seeds[(_hash(keys, 0) % _U(len(self.seeds))).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, (_hash(keys, np.maximum(seed, 0)) % _U(self.n)).astype(np.int64))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 40) >> _U(32)).astype(np.uint32)


def write_shard(path: str, documents: Iterable[tuple[int | None, bytes]], dtype: str) -> tuple[int, int]:
    """Writes documents in the order given (equal keys adjacent, null keys first); their number and that of ids."""
    fs, at = filesystem(path)
    keys, sizes, nulls = [], [], 0
    width = np.dtype(dtype).itemsize
    with fs.open_output_stream(at) as out:
        for key, ids in documents:
            nulls += key is None
            keys.append(0 if key is None else key)
            sizes.append(len(ids) // width)
            out.write(ids)
        own = np.array(keys, dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))
        unique, first, count = np.unique(own[nulls:], return_index=True, return_counts=True)
        index = PerfectHash.build(unique)
        slot = index.slot(unique)
        tables = {"keys": own, "offsets": offsets, "seeds": index.seeds}
        for name, values in (("fingerprints", fingerprint(unique)), ("ordinals", first + nulls), ("counts", count)):
            tables[name] = np.empty_like(values)
            tables[name][slot] = values
        places, begin = {}, int(offsets[-1]) * width
        for name, values in tables.items():
            raw = values.astype(values.dtype.newbyteorder("<")).tobytes()
            places[name] = [begin, len(raw), values.dtype.str]
            begin += len(raw)
            out.write(raw)
        footer = json.dumps({"dtype": dtype, "n": len(own), "nulls": nulls, "unique": len(unique), "tables": places}).encode()
        out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
    return len(own), int(offsets[-1])


class Shard:
    """Keyed access to one shard."""

    def __init__(self, path: str) -> None:
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        length = struct.unpack("<Q", tail[:8])[0]
        self.head = json.loads(self.file.read_at(length, size - 16 - length))
        self.dtype = np.dtype(self.head["dtype"])
        read = {k: np.frombuffer(self.file.read_at(n, a), dtype=t) for k, (a, n, t) in self.head["tables"].items()}
        self.keys, self.offsets = read["keys"], read["offsets"]
        self.fingerprints, self.ordinals, self.counts = read["fingerprints"], read["ordinals"], read["counts"]
        self.index = PerfectHash(read["seeds"], self.head["unique"])

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the first document, number of documents) of each key; (-1, 0) if absent."""
        if not self.index.n:
            return np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        slot = self.index.slot(keys)
        there = (self.fingerprints[slot] == fingerprint(keys)) & (self.keys[self.ordinals[slot]] == keys)
        return np.where(there, self.ordinals[slot], -1), np.where(there, self.counts[slot], 0)

    def ids(self, ordinal: int, n: int = 1) -> np.ndarray:
        a, z = int(self.offsets[ordinal]), int(self.offsets[ordinal + n])
        return np.frombuffer(self.file.read_at((z - a) * self.dtype.itemsize, a * self.dtype.itemsize), dtype=self.dtype)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        first, n = (int(x[0]) for x in self.find(np.array([key])))
        return [self.ids(first + i) for i in range(n)]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Encodes every whole text, writes shards in ascending doc_id order, and returns the
    manifest: shard, path, n_docs, n_ids, base (ids in all shards before).

    Null texts are empty, null doc_ids come first, rows that repeat a doc_id lie next to
    each other in one shard (ordered by text), an empty table gives no shard. The number
    of shards is that of Spark's range partitions; the manifest is all that the driver
    sees. A task that runs again writes another file, and only files in the manifest count.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    if folder.startswith(("/", "file:")):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                yield from zip(batch.column("doc_id").to_pylist(), (x + end for x in encoder.encode(batch.column("text").to_pylist())))

        rows = documents()
        first = next(rows, None)
        if first is None:
            return
        from itertools import chain

        path = f"{folder}/{uuid.uuid4().hex}.ids"
        n_docs, n_ids = write_shard(path, chain([first], rows), encoder.dtype.str)
        yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards = ordered.mapInArrow(released(work), "shard long, path string, n_docs long, n_ids long").collect()
    base, rows = 0, []
    for x in sorted(shards, key=lambda x: x["shard"]):
        rows.append((*x, base))
        base += x["n_ids"]
    made = spark.createDataFrame(rows, "shard long, path string, n_docs long, n_ids long, base long")
    return made.repartition(max(1, len(rows)))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the shards, each looked up by its key: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32, and the ids if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with Shard(path) as shard:
                    nulls = shard.head["nulls"]
                    first, count = shard.find(shard.keys[nulls:])
                    # Rows of one key follow each other from the ordinal that the index has.
                    if (first < 0).any() or (first + count <= np.arange(nulls, nulls + len(first))).any():
                        raise ValueError(f"{path}: the index misses a key")
                    for a in range(0, len(shard.keys), 1000):
                        z = min(a + 1000, len(shard.keys))
                        block, begin = shard.ids(a, z - a), int(shard.offsets[a])
                        parts = [block[int(p) - begin : int(q) - begin] for p, q in zip(shard.offsets[a:z], shard.offsets[a + 1 : z + 1])]
                        out = {
                            "doc_id": pa.array([None if i < nulls else int(shard.keys[i]) for i in range(a, z)], pa.int64()),
                            "start": pa.array(shard.offsets[a:z] + base, pa.int64()),
                            "n_tokens": pa.array([len(x) for x in parts], pa.int64()),
                            "ids_crc32": pa.array([crc_of(x) for x in parts], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(out)

    return manifest.select("path", "base").mapInArrow(
        released(work), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    )
