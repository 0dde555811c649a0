"""Capture files: a pcap data source (read and write) and decoded packet tables.

`spark.read.format("pcap")` streams each file in its own task, from a path that the workers see. packets() reads through
Spark's own file reader instead, so any store works; it holds one file in memory at a time.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.primitives import running_clock
from .decode import PACKET, decode

FRAMES = "file string, n long, ts_ns long, wire_len long, frame binary"


class CaptureError(ValueError):
    pass


def frames(read) -> Iterator[tuple[int, int, bytes]]:
    """(ts_ns, wire length, frame) of a pcap or pcapng stream; read(n) returns up to n bytes. A damaged tail ends the stream."""
    magic = read(4)
    if magic == b"\x0a\x0d\x0d\x0a":
        yield from _pcapng(read)
        return
    orders = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
    if magic not in orders:
        raise CaptureError("not a capture file")
    order, scale = orders[magic]
    head = read(20)
    if len(head) < 20:
        return
    if struct.unpack(order + "I", head[16:])[0] & 0xFFFF != 1:
        raise CaptureError("only Ethernet captures")
    while len(head := read(16)) == 16:
        sec, part, kept, wire = struct.unpack(order + "IIII", head)
        frame = read(kept)
        if len(frame) < kept:
            return
        yield sec * 10**9 + part * scale, wire, frame


def _pcapng(read) -> Iterator[tuple[int, int, bytes]]:
    order, links = "<", []
    first = b"\x0a\x0d\x0d\x0a"
    while len(first) == 4:
        size_raw = read(4)
        if first == b"\x0a\x0d\x0d\x0a":
            bom = read(4)
            order = "<" if bom == b"\x4d\x3c\x2b\x1a" else ">"
            size = struct.unpack(order + "I", size_raw)[0]
            read(size - 12)
            links = []
        else:
            if len(size_raw) < 4:
                return
            kind, size = struct.unpack(order + "I", first)[0], struct.unpack(order + "I", size_raw)[0]
            body = read(size - 8)
            if len(body) < size - 8:
                return
            if kind == 1:
                links.append((struct.unpack(order + "H", body[:2])[0], _resolution(body[8:-4], order)))
            elif kind == 6:
                which, high, low, kept, wire = struct.unpack(order + "IIIII", body[:20])
                if which >= len(links) or links[which][0] != 1:
                    raise CaptureError("only Ethernet captures")
                yield (high << 32 | low) * 10**9 // links[which][1], wire, body[20 : 20 + kept]
        first = read(4)


def _resolution(options: bytes, order: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, n = struct.unpack(order + "HH", options[at : at + 4])
        if code == 9 and n == 1:
            x = options[at + 4]
            return 2 ** (x & 127) if x & 128 else 10**x
        at += 4 + n + -n % 4
    return 10**6


class PcapSource(DataSource):
    """Options: path (a file, a folder or a pattern)."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema):
        return PcapReader(self.options["path"])

    def writer(self, schema, overwrite):
        return PcapWriter(self.options["path"])


class PcapReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path))
        return [InputPartition(x) for x in found if os.path.isfile(x)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for n, (ts, wire, frame) in enumerate(frames(f.read)):
                yield partition.value, n, ts, wire, frame


class PcapWriter(DataSourceWriter):
    """One microsecond pcap file a partition, named by its task; a file stands only once it is whole."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def write(self, iterator):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}.pcap")
        with open(name + ".tmp", "wb") as f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1))
            for row in iterator:
                frame = bytes(row["frame"])
                f.write(struct.pack("<IIII", row["ts_ns"] // 10**9, row["ts_ns"] % 10**9 // 1000, len(frame), row["wire_len"]) + frame)
        os.replace(name + ".tmp", name)
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all capture files at a path of any store."""
    def parse(batches):
        import pandas as pd
        from io import BytesIO

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = [(name, n, *x) for n, x in enumerate(frames(BytesIO(content).read))]
                yield pd.DataFrame(rows, columns=["file", "n", "ts_ns", "wire_len", "frame"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, FRAMES)


def packets(frames_: DataFrame) -> DataFrame:
    """Decoded packets of a frame table: seq numbers frames by (file, n), t is the capture's monotone clock in nanoseconds.

    The clock and the numbers are computed within each file; files are told apart by an ordinal in seq's high bits.
    """
    import pandas as pd

    names = [c for c in PACKET.names if c not in ("seq", "ts_ns", "t", "capture_len", "wire_len")]
    out = "file string, n long, ts_ns long, wire_len long, capture_len long, " + ", ".join(f"{c} {PACKET[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for pdf in batches:
            rows = []
            for file, n, ts, wire, frame in pdf.itertuples(index=False):
                d = decode(bytes(frame), wire)
                rows.append((file, n, ts, wire, d["capture_len"], *(d.get(c) for c in names)))
            table = pd.DataFrame(rows, columns=["file", "n", "ts_ns", "wire_len", "capture_len", *names])
            yield table.astype({c: "Int64" for c in names if PACKET[c].dataType.typeName() in ("integer", "long")})

    decoded = frames_.select("file", "n", "ts_ns", "wire_len", "frame").mapInPandas(run, out)
    files = frames_.select("file").distinct()
    from pyspark.sql import Window

    numbered = files.withColumn("__file", F.row_number().over(Window.orderBy("file")) - 1)  # one row a file
    joined = decoded.join(F.broadcast(numbered), "file").withColumn("seq", F.shiftleft(F.col("__file").cast("long"), 40) + F.col("n"))
    return running_clock(joined, "ts_ns", "seq", "t", ["file"]).select(*PACKET.names)
