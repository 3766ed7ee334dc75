"""Token ids as length-delimited binary records, with a separate offset index.

A record is framed as
    length    8 bytes, little-endian: bytes of the payload
    check     4 bytes: masked checksum of the length
    payload   document id (8 bytes, signed; a null id as the least value), then the ids, 2 bytes each (4 if the vocabulary needs it)
    check     4 bytes: masked checksum of the payload
all little-endian.  A masked checksum is the CRC-32 c turned right by 15 bits plus 0xa282ead8, so that data which hold
their own checksums are not mistaken.  Part files hold ascending document ids; the index (a Parquet table beside them)
has a record's part, bytes an id, byte offset, payload bytes, document id and tokens, so that a reader can fetch records in any order.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices
from .tokens import with_end, worker_encoder

MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
#: Text bytes of a part: at most on average, and at least where the session would make more parts.
PART_BYTES, LEAST_PART_BYTES = 512 << 20, 8 << 20


def masked(data) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray) -> bytes:
    payload = doc_id.to_bytes(8, "little", signed=True) + ids.tobytes()
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def read_frames(source, kind: str, chunk: int = 8 << 20):
    """(doc_id, ids) of each record of a file; checks every length and payload, and that the file ends with a record."""
    held, more = b"", True
    while more:
        data = source.read(chunk)
        more = bool(data)
        held, at = held + data, 0
        while len(held) - at >= 12:
            length = int.from_bytes(held[at : at + 8], "little")
            if masked(held[at : at + 8]) != int.from_bytes(held[at + 8 : at + 12], "little"):
                raise ValueError("damaged length")
            if len(held) - at < length + 16:
                break
            payload = held[at + 12 : at + 12 + length]
            if masked(payload) != int.from_bytes(held[at + 12 + length : at + 16 + length], "little"):
                raise ValueError("damaged payload")
            yield int.from_bytes(payload[:8], "little", signed=True), np.frombuffer(payload, kind, offset=8)
            at += length + 16
        held = held[at:]
    if held:
        raise ValueError("the file ends within a record")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder; Hadoop's names of object stores are those of the same stores here."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def part_count(rows: DataFrame, text_col: str) -> int:
    """Parts of PART_BYTES of text at most on average; as many as the session shuffles into, while they hold LEAST_PART_BYTES."""
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-total // PART_BYTES), min(session, -(-total // LEAST_PART_BYTES)))


def write_records(docs: DataFrame, folder: str, path: str, *, end: int = 1, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and writes part files in ascending document id; returns the index, read from folder/index.

    Each task writes to a name of its own attempt and renames it when complete, so a retried task leaves one part.
    A null text counts as empty (its end id alone); equal or null ids follow one another by their texts' hash, and may lie
    in several parts, as may repeated rows; an empty table gives an empty index; other columns are not read.
    """
    spark = docs.sparkSession
    _filesystem(folder)  # a folder that tasks could not write to fails here, before any work
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts or part_count(rows, "text")
    order = ["id", F.xxhash64("text"), F.pmod(F.monotonically_increasing_id(), F.lit(4096))]  # the last parts equal rows only
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions("id", F.xxhash64("text"))
    schema = "part int, width int, record bigint, doc_id bigint, position bigint, payload bigint, n_tokens bigint"

    def run(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encoder, sink, record, position = worker_encoder(path), None, 0, 0
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        fs, root = _filesystem(folder)
        target, draft = f"{root}/part-{part:06d}.rec", f"{root}/_draft-{part:06d}-{attempt}"
        for batch in slices(batches, "text", 2 << 20):
            if sink is None:
                fs.create_dir(root)
                sink = fs.open_output_stream(draft)
            offsets, ids = with_end(*encoder.encode(batch.column(1).to_pylist()), end)
            ids = ids.astype(f"<u{width}")
            known = batch.column(0).to_pylist()
            frames = [frame(d, ids[a:b]) for d, a, b in zip(known, offsets[:-1], offsets[1:], strict=True)]
            sink.write(b"".join(frames))
            sizes = np.array([len(f) for f in frames], np.int64)
            ends = position + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(frames), part, np.int32)), pa.array(np.full(len(frames), width, np.int32)), pa.array(np.arange(record, record + len(frames))), batch.column(0), pa.array(ends - sizes), pa.array(sizes - 16), pa.array(np.diff(offsets).astype(np.int64))], names=["part", "width", "record", "doc_id", "position", "payload", "n_tokens"])
            record, position = record + len(frames), int(ends[-1])
        if sink is not None:
            sink.close()
            fs.move(draft, target)

    rows.mapInArrow(run, schema).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(doc_id, part, record, start, n_tokens, ids_crc32) of every record, from the part files; start counts the tokens of all records before it.

    Parts' totals and the bytes of an id come from the index (a row per part); each task reads whole part files in a stream.
    An empty index gives no row.
    """
    totals = sorted(index.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"), F.max("width").alias("width")).collect())
    base, plan = 0, []
    for r in totals:
        plan.append((len(plan), r["part"], base, r["rows"], r["width"]))
        base += r["n"]
    schema = "doc_id bigint, part int, record bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches):
        fs, root = _filesystem(folder)
        for batch in batches:
            for _, part, start, rows, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, seen = [], 0
                with fs.open_input_stream(f"{root}/part-{part:06d}.rec") as source:
                    for doc, ids in read_frames(source, f"<u{width}"):
                        out.append((None if doc == NULL_ID else doc, part, seen, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        seen, start = seen + 1, start + len(ids)
                        if len(out) == 10_000:
                            yield _batch(out)
                            out = []
                if seen != rows:
                    raise ValueError(f"part {part} has {seen} records, its index {rows}")
                if out:
                    yield _batch(out)

    files = spark.createDataFrame(plan, "task int, part int, base bigint, rows bigint, width int")
    return files.repartitionById(max(1, len(plan)), "task").mapInArrow(run, schema)


def fetch(folder: str, entries: list[tuple[int, int, int, int]]):
    """(doc_id, ids) of the records at (part, width, position, payload), in the order given: the shuffled read of a trainer."""
    fs, root = _filesystem(folder)
    for part, width, position, payload in entries:
        with fs.open_input_file(f"{root}/part-{part:06d}.rec") as source:
            source.seek(position)
            data = source.read(payload + 16)
        body = data[12:-4]
        if masked(data[:8]) != int.from_bytes(data[8:12], "little") or masked(body) != int.from_bytes(data[-4:], "little"):
            raise ValueError("damaged record")
        yield int.from_bytes(body[:8], "little", signed=True), np.frombuffer(body, f"<u{width}", offset=8)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "part", "record", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def records_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "records")
