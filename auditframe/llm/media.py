"""Media columns with content-defined chunks.

A payload (bytes, padded with zeros to a positive multiple of 64) is stored as 8-bit
samples: a mono PCM WAV file, header and samples. A rolling gear hash cuts each file into
chunks, and a chunk is addressed by its SHA-256 digest.

``write_media`` first cuts all files into a lean table (digest, id, position) and finds, by
digest, the chunks that occur in more than one place (*shared*) and the smallest place of
each, its owner. It then stores one row per document: its file digest and its ordered chunk
list. A chunk's bytes lie in the list of its owner; every other place has the digest alone.

``read_media`` gives each distinct file once: most lie whole in one list; the others get
their missing chunks by a join on the digest. Each chunk and each whole file is verified.

Bytes that no other place shares never cross the network if the set of shared digests is
proven small (counted before use, ``BROADCAST_DIGESTS`` at most); beyond that the owners are
joined to the documents by id. Both ways store the same. Copies are never expanded: a file
that fills a third of all rows is read and verified once, and its lean result is joined to
the rows, where Spark splits skewed partitions.

Defined results: a null text is the empty text, whose payload is 64 zero bytes; repeated
rows are listed as often as they occur; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.common import shared_dir, slices, stored, table, tidy

RATE = 8000
#: Chunk sizes: cuts are sought between the least and the most; MASK_BITS gives the mean distance.
LEAST, MOST, MASK_BITS = 1024, 16384, 12
#: Up to so many shared digests (40 bytes each) are broadcast.
BROADCAST_DIGESTS = 200_000
SLICE_BYTES = 4_000_000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(payload: bytes) -> bytes:
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(data: bytes) -> bytes:
    size = HEADER.unpack_from(data)[-1]
    return data[HEADER.size : HEADER.size + size]


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


@cache
def gears() -> np.ndarray:
    """256 pseudo-random 32-bit words, derived from a rule."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


def cuts(files: list[bytes]) -> list[list[int]]:
    """Chunk ends of each file. h(i) = sum over j < 32 of gear[b(i - j)] << j, by doubling over all files at once."""
    data = np.frombuffer(b"".join(files), np.uint8)
    h = gears().take(data)
    for distance in (1, 2, 4, 8, 16):
        if len(h) > distance:
            h[distance:] = h[distance:] + (h[:-distance] << np.uint32(distance))
    # A cut lies LEAST bytes or more behind the chunk's begin, so the 32 bytes that decide are always of this file.
    at = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, begin = [], 0
    for file in files:
        end, start, ends = begin + len(file), begin, []
        near = at[np.searchsorted(at, begin) : np.searchsorted(at, end)]
        while end - start > LEAST:
            k = np.searchsorted(near, start + LEAST)
            cut = min(int(near[k]) if k < len(near) else end, start + MOST, end)
            ends.append(cut - begin)
            start = cut
        if start < end:
            ends.append(end - begin)
        out.append(ends)
        begin = end
    return out


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes], list[list[bytes]]]]:
    """For slices of a batch: its range, the files and their chunks."""
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    for a, b in slices(texts, SLICE_BYTES):
        files = [to_wav(padded(t)) for t in texts[a:b]]
        yield a, b, files, [[f[x:y] for x, y in zip([0, *ends], ends)] for f, ends in zip(files, cuts(files))]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, _, parts in _chunked(batch):
            digests = pa.array([hashlib.sha256(c).digest() for p in parts for c in p], pa.binary())
            rows = pa.array([row for row, p in enumerate(parts, a) for _ in p], pa.int64())
            position = pa.array([i for p in parts for i in range(len(p))], pa.int32())
            yield pa.RecordBatch.from_arrays([digests, batch.column("doc_id").take(rows), position], ["digest", "doc_id", "position"])


FILES = "doc_id long, n_bytes long, file binary, chunks array<struct<digest: binary, bytes: binary, shared: boolean>>"
CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary()), ("shared", pa.bool_())]))


def _listed(owners_of: Callable[[pa.RecordBatch], Callable[[int, bytes], object]]) -> Callable:
    """Rows of FILES; ``owners_of(batch)(row, digest)``: the owner of a shared digest, else None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids, owner = batch.column("doc_id").to_pylist(), owners_of(batch)
            for a, b, files, parts in _chunked(batch):
                lists = []
                for row, part in enumerate(parts, a):
                    lists.append(out := [])
                    for position, chunk in enumerate(part):
                        at = owner(row, digest := hashlib.sha256(chunk).digest())
                        out.append({"digest": digest, "bytes": chunk if at is None or at == (ids[row], position) else None, "shared": at is not None})
                keys = pa.array([hashlib.sha256(f).digest() for f in files], pa.binary())
                columns = [pa.array(ids[a:b], pa.int64()), pa.array(sizes[a:b], pa.int64()), keys, pa.array(lists, CHUNKS)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "file", "chunks"])

    return run


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_digests: int = BROADCAST_DIGESTS) -> None:
    """Store every text of ``docs`` below ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    places = stored(rows.mapInArrow(tidy(_places), "digest binary, doc_id long, position int"), f"{path}/places")
    uses = places.groupBy("digest").agg(F.count("*").alias("uses"), F.min(F.struct("doc_id", "position")).alias("owner"))
    shared = stored(uses.filter("uses > 1").select("digest", "owner.*"), f"{path}/shared")
    if shared.count() <= broadcast_digests:
        owners = spark.sparkContext.broadcast({bytes(r.digest): (r.doc_id, r.position) for r in shared.toLocalIterator()})
        files = rows.mapInArrow(tidy(_listed(lambda batch: lambda row, digest: owners.value.get(digest))), FILES)
    else:
        own = F.collect_set(F.struct("digest", F.col("owner_id"), F.col("owner_position"))).alias("owners")
        owner = shared.select("digest", F.col("doc_id").alias("owner_id"), F.col("position").alias("owner_position"))
        by_id = places.join(owner, "digest").groupBy("doc_id").agg(own)
        known = rows.join(by_id.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "owners")

        def owners_of(batch: pa.RecordBatch) -> Callable[[int, bytes], object]:
            lists = [{x["digest"]: (x["owner_id"], x["owner_position"]) for x in mine or ()} for mine in batch.column("owners").to_pylist()]
            return lambda row, digest: lists[row].get(digest)

        files = known.mapInArrow(tidy(_listed(owners_of)), FILES)
    files.write.option("compression", "zstd").parquet(f"{path}/files")


def feature(samples: np.ndarray) -> str:
    """Loudness and shape of unsigned 8-bit samples, by integer arithmetic."""
    x = samples.astype(np.int64)
    x -= int(x.sum()) // len(x)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bands = np.bincount(samples >> 5, minlength=8)
    return f"mean={int(samples.sum(dtype=np.int64)) // len(samples)};energy={int((x * x).sum())};crossings={crossings};bands=" + ",".join(map(str, bands.tolist()))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, media, feature) of lists that have all bytes; raises if a digest doesn't hold."""
    for batch in batches:
        keys, media, features, held = [], [], [], 0
        lists = batch.column("chunks")
        for i, key in enumerate(batch.column("file").to_pylist()):
            parts = lists[i].as_py()
            if any(hashlib.sha256(p["bytes"]).digest() != p["digest"] for p in parts) or hashlib.sha256(data := b"".join([p["bytes"] for p in parts])).digest() != key:
                raise ValueError(f"stored media is corrupt: {key.hex()}")
            keys.append(key)
            media.append(data)
            features.append(feature(np.frombuffer(from_wav(data), np.uint8)))
            held += len(data)
            if held > SLICE_BYTES or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(media, pa.binary()), pa.array(features)], ["file", "media", "feature"])
                keys, media, features, held = [], [], [], 0


def read_media(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, media)``: (doc_id, n_bytes, file) of each stored row; (file, media, feature) of each distinct file."""
    files = spark.read.schema(FILES).parquet(f"{path}/files")
    lacks = F.exists("chunks", lambda c: c["bytes"].isNull())
    lists = files.select("file", "chunks")
    # A list that lacks nothing and shares nothing is the only one of its file.
    alone = lists.filter(~F.exists("chunks", lambda c: c["shared"]))
    whole = lists.filter(~lacks & F.exists("chunks", lambda c: c["shared"])).groupBy("file").agg(F.first("chunks").alias("chunks"))
    part = lists.filter(lacks).join(lists.filter(~lacks).select("file"), "file", "left_anti")
    part = part.groupBy("file").agg(F.first(F.transform("chunks", lambda c: c["digest"])).alias("digests"))
    shared = lists.select(F.explode(F.filter("chunks", lambda c: c["shared"] & c["bytes"].isNotNull())).alias("c")).groupBy("c.digest").agg(F.first("c.bytes").alias("bytes"))
    own = lists.filter(lacks).select("file", F.explode(F.filter("chunks", lambda c: ~c["shared"])).alias("c")).groupBy("file", "c.digest").agg(F.first("c.bytes").alias("own"))
    wanted = part.select("file", F.posexplode("digests").alias("position", "digest")).join(own, ["file", "digest"], "left").join(shared, "digest", "left")
    item = F.struct("position", "digest", F.coalesce("own", "bytes").alias("bytes"), F.lit(True).alias("shared"))
    resolved = wanted.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("found"))
    resolved = resolved.select("file", F.transform("found", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"), x["shared"].alias("shared"))).alias("chunks"))
    media = alone.unionByName(whole).unionByName(resolved).mapInArrow(tidy(_whole), "file binary, media binary, feature string")
    return files.select("doc_id", "n_bytes", "file"), media


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as media, read all of it back, and describe what was read."""
    path = f"{shared_dir(spark)}/media"
    write_media(table(spark, sf_dir, "documents"), path)
    rows, media = read_media(spark, path)
    payload = F.substring("media", HEADER.size + 1, 2**31 - 1)
    read = media.select(
        "file",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring("media", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
    return rows.join(read, "file").drop("file")
