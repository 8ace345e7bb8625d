"""Length-delimited binary records with masked checksums, and an offset index for reads in any order.

Record: u64 length, u32 masked CRC-32 of it, payload, u32 masked CRC-32 of the payload, all little-endian; payload: u8 flags
(1: no doc_id, 2: 32-bit ids), i64 doc_id, then the ids, 16 bits each where all fit. CRC-32 stands for CRC-32C, for which no
compiled library is at hand. The index file holds each record's u64 offset. A task writes files of its own name, and only the
manifest of committed tasks names files, so that repeated tasks and lost executors leave nothing that is read.

Null text is empty; a null doc_id is kept and comes first; repeated rows are records of their own, in an order by their text's
hash; texts of any length are one record; an empty table gives no records; other columns are not read.
"""
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.llm.common import materialise, work_dir
from lodestone.llm.tokens import encoder

END, NO_ID, WIDE, BUFFER = 2, 1, 2, 1 << 20
READ = "doc_id long, start long, n_tokens long, ids binary"


def masked(b: bytes) -> int:
    c = zlib.crc32(b)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_record(f) -> bytes | None:
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise ValueError("record cut off")
    n, crc = struct.unpack("<QI", head)
    if masked(head[:8]) != crc:
        raise ValueError("length checksum")
    body = f.read(n + 4)
    if len(body) != n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("payload checksum")
    return body[:n]


def pack(doc: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack("<Bq", NO_ID * (doc is None) + WIDE * wide, doc or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc = struct.unpack_from("<Bq", payload)
    return None if flags & NO_ID else doc, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9).astype("<u4")


def write(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """Manifest (shard, path, docs, tokens) of shards in ascending doc_id order; the index is beside each, with `.idx`."""
    top = f"{work_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(top)
        store.create_dir(path)
        k, enc, at, total, index, held = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0, [], []
        name = f"{path}/{k:06d}-{uuid.uuid4().hex}.rec"
        with store.open_output_stream(name) as f:
            for b in it:
                doc_ids = b.column(0).to_pylist()
                for first, ids, places in enc.slices(b.column(1), end):
                    cuts, waiting = places.tolist(), 0
                    for doc, x, y in zip(doc_ids[first:], cuts[:-1], cuts[1:], strict=False):
                        rec = frame(pack(doc, ids[x:y]))
                        held.append(rec)
                        index.append(at)
                        at, waiting = at + len(rec), waiting + len(rec)
                        if waiting > BUFFER:
                            f.write(b"".join(held))
                            held, waiting = [], 0
                    total += len(ids)
                    f.write(b"".join(held))
                    held = []
        with store.open_output_stream(name + ".idx") as f:
            f.write(np.array(index, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int64()), "path": [name], "docs": pa.array([len(index)], pa.int64()), "tokens": pa.array([total], pa.int64())})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "shard long, path string, docs long, tokens long"), "manifest").withColumn("top", F.lit(top))


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    return out.astype({"doc_id": "Int64"})


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian u32) of every record in order; a task reads some shards."""
    m = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for p in it:
            for path, top, at in zip(p["path"], p["top"], p["base"], strict=True):
                store, rows = fs.FileSystem.from_uri(top)[0], []
                with store.open_input_stream(path, buffer_size=BUFFER) as f:
                    while (rec := read_record(f)) is not None:
                        doc, ids = unpack(rec)
                        rows.append((doc, at, len(ids), ids.tobytes()))
                        at += len(ids)
                        if len(rows) >= 1000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    n = max(1, manifest.count())
    return m.repartition(n, "shard").mapInPandas(run, READ)


def _fetch(named: DataFrame) -> DataFrame:
    """The records of rows (shard, record, path, top), in their order, by seeking to the index's offsets."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files: dict[str, tuple] = {}
        for p in it:
            rows = []
            for shard, record, path, top in zip(p["shard"], p["record"], p["path"], p["top"], strict=True):
                if path not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files)))[0].close()
                    store = fs.FileSystem.from_uri(top)[0]
                    with store.open_input_file(path + ".idx") as f:
                        files[path] = (store.open_input_file(path), np.frombuffer(f.read(), "<u8"))
                f, index = files[path]
                if not 0 <= record < len(index):
                    raise ValueError(f"no record {record} in shard {shard}")
                f.seek(int(index[record]))
                if (rec := read_record(f)) is None:
                    raise ValueError("offset beyond the file")
                doc, ids = unpack(rec)
                rows.append((shard, record, doc, len(ids), ids.tobytes()))
            yield pd.DataFrame(rows, columns=["shard", "record", "doc_id", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    return named.select("shard", "record", "path", "top").mapInPandas(run, "shard long, record long, doc_id long, n_tokens long, ids binary")


def look_up(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """shard, record, doc_id, n_tokens, ids of the wanted (shard, record) pairs, by the offset index.

    A record outside the index raises an error, as does a damaged offset: the length's checksum does not hold there.
    """
    return _fetch(wanted.select("shard", "record").join(manifest, "shard"))


def shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """All records in an order drawn by `seed`, as an epoch of training reads them."""
    every = manifest.where("docs > 0").select("shard", "path", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1)).alias("record"))
    return _fetch(every.orderBy(F.xxhash64(F.lit(seed), "shard", "record"), "shard", "record"))


def query(docs: DataFrame) -> DataFrame:
    return read(write(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
