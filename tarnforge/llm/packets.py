"""Packets of rows that ask questions by key and are told the answers.

A packet is one row: a number and a body of some megabytes that a worker packs and unpacks. What a
packet must know of all others (which of its keys do others hold?) goes in one shuffle of compact
lists: ``ask`` gives a list for each bucket of keys, ``answer`` sees all lists of one bucket
and returns one for each packet, and the packets get theirs in one join. Keys are different within a
packet, so no key is hot: a bucket has each key at most once a packet, and the number of buckets
grows with the number of keys.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm.common import cut, small_batches

#: Bytes of Arrow data of a packet, about; keys that one bucket takes, about.
PACKET_BYTES, BUCKET_KEYS = 4 << 20, 1 << 22


def to_bytes(table: pa.Table | pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(table)
    return out.getvalue()


def from_bytes(body) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def packed(rows: DataFrame, pack=None, limit: int = PACKET_BYTES) -> DataFrame:
    """Checkpointed (packet, body, size): runs of rows of one partition, each of about ``limit`` bytes.
    ``pack`` takes a run as an Arrow table and gives (body, size); else the body is the run itself
    and the size its rows."""
    small_batches(rows.sparkSession)
    make = pack or (lambda t: (to_bytes(t), t.num_rows))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= limit:
                yield done(held)
                held, size = [], 0
        if any(b.num_rows for b in held):
            yield done(held)

    def done(held):
        body, n = make(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays([pa.array([body], pa.binary()), pa.array([n], pa.int64())], ["body", "size"])

    return cut(rows.mapInArrow(run, "body binary, size long").select(F.monotonically_increasing_id().alias("packet"), "body", "size"))


def bucket_bits(packets: DataFrame) -> int:
    """Buckets, as a power of two, for a key a unit of the packets' sizes; no fewer than the partitions of a shuffle."""
    keys = packets.agg(F.sum("size")).first()[0] or 0
    want = max(keys // BUCKET_KEYS, int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return min(31, int(want - 1).bit_length())


def answered(packets: DataFrame, ask, answer, name: str) -> DataFrame:
    """Checkpointed (packet, ``name``): of each packet an array of (bucket, body), in the order of buckets. It is
    small beside the packets, which are joined to it where it is used and not written again.

    ``ask(row)`` gives (bucket, body) of a packet, a dictionary of its columns; ``answer(bodies)``
    takes the bodies of one bucket and gives one for each."""
    spark = packets.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    columns = packets.columns

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                got = list(ask({c: b.column(k)[i].as_py() for k, c in enumerate(columns)}))
                n = b.column(columns.index("packet"))[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([n] * len(got), pa.int64()), pa.array([x for _, x in got], pa.binary())], ["bucket", "packet", "body"])

    def reply(t: pa.Table) -> pa.Table:
        return pa.table({"packet": t["packet"], "bucket": t["bucket"], "body": pa.array(answer(t["body"].to_pylist()), pa.binary())})

    replies = packets.mapInArrow(run, "bucket long, packet long, body binary").groupBy("bucket").applyInArrow(reply, "packet long, bucket long, body binary")
    return cut(replies.groupBy("packet").agg(F.array_sort(F.collect_list(F.struct("bucket", "body"))).alias(name)))


def shrunk(sorted_numbers: np.ndarray) -> bytes:
    """Sorted whole numbers as byte planes of their differences, which the shuffle then compresses."""
    steps = np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), steps.dtype.itemsize).T).tobytes()


def grown(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)
