"""IGB potentials as a Python data source: a partition is a range of frames, to which its task seeks in the file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = 1024
VM = "job_id string, frame int, node_id long, vm float, dt double"


def header(content: bytes, job: str) -> tuple[int, int]:
    """(nodes, frames) of the text fields `x:` and `t:`; raises where they are not there."""
    fields = dict(x.split(":", 1) for x in content[:HEADER].decode("latin-1").replace("\0", " ").split() if ":" in x)
    try:
        return int(fields["x"]), int(fields["t"])
    except (KeyError, ValueError):
        raise ValueError(f"{job} has no readable header") from None


def opened(path: str):
    """A file of a local or shared folder or of a store that Arrow knows, open for seeks."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


@dataclass
class Frames(InputPartition):
    path: str
    job: str
    nodes: int
    frames: int
    begin: int  # frames of the partition
    end: int
    at: int  # where frame 0 stands in the file


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [x.split("\t") for x in options["files"].split("\n") if x]
        self.tend, self.bytes = float(options.get("tend", "1.0")), int(options.get("partition_bytes", str(64 << 20)))
        self.first, self.last = int(options.get("first", "0")), int(options.get("last", "-1"))

    def partitions(self) -> list[Frames]:
        out = []
        for job, path in self.files:
            with opened(path) as f:
                nodes, frames = header(f.read(HEADER), job)
                size = f.size()
            if size < 4 * nodes * frames:
                raise ValueError(f"{job} holds less than its header says")
            step = max(1, self.bytes // max(1, 4 * nodes))
            last = frames if self.last < 0 else min(frames, self.last + 1)
            out += [Frames(path, job, nodes, frames, a, min(a + step, last), size - 4 * nodes * frames) for a in range(max(0, self.first), last, step)]
        return out

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        dt = self.tend / (part.frames - 1) if part.frames > 1 else 1.0
        some = max(1, 500_000 // max(1, part.nodes))
        with opened(part.path) as f:
            for a in range(part.begin, part.end, some):
                b = min(a + some, part.end)
                f.seek(part.at + 4 * part.nodes * a)
                vm = np.frombuffer(f.read(4 * part.nodes * (b - a)), "<f4")
                for i in range(0, len(vm), 1_000_000):  # one frame can be large
                    n = min(1_000_000, len(vm) - i)
                    row = np.arange(i, i + n, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.job]).take(pa.array(np.zeros(n, np.int32))), pa.array((a + row // part.nodes).astype(np.int32)), pa.array(row % part.nodes), pa.array(vm[i : i + n]), pa.array(np.full(n, dt))],
                        ["job_id", "frame", "node_id", "vm", "dt"],
                    )


class FrameSource(DataSource):
    """`igb`: options files (lines of job and path, tab between), tend, partition_bytes, first and last frame."""

    @classmethod
    def name(cls) -> str:
        return "igb"

    def schema(self) -> str:
        return VM

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)
