"""Many small files as members of archives: a few large files hold them, under their own names.

A file system gives a whole block to each file, however short. `write_packed` writes rows (path, content) into tar archives with gzip,
one or more a task, in which each row is a member of its own path; any tar reader unpacks them to the same tree. Archives go through
`named_files`, so they appear together in one step. `read_packed` gives the members back, an archive after the other in each task,
which holds one archive at a time.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.session import ship
from corpuscle.sources.named_files import STEP, list_files, located, safe, write_pieces

#: Bytes of contents of an archive, with 1 KB for each member; a larger member has an archive for itself.
ARCHIVE = 64 << 20


def _packed(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as zipped:
        for path, content in members:
            info = tarfile.TarInfo(path)
            info.size, info.mode = len(content), 0o644
            zipped.write(info.tobuf(tarfile.PAX_FORMAT) + content + bytes(-len(content) % tarfile.BLOCKSIZE))
        zipped.write(bytes(2 * tarfile.BLOCKSIZE))
    return out.getvalue()


def write_packed(rows: DataFrame, root: str, *, size: int = ARCHIVE) -> None:
    """Rows (path, content: text or bytes, null is empty) as members of archives below root; what was there before goes. Two rows of one
    path raise. Rows are dealt by path, in order within a task."""
    ship(rows.sparkSession)
    files = rows.select("path", F.col("content").cast("binary").alias("content")).repartition("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, bytes_, last = TaskContext.get().partitionId(), 0, [], 0, None
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if path == last:
                    raise ValueError(f"two files of one name: {path}")
                last, content = safe(path), content or b""
                if held and bytes_ + len(content) + 1024 > size:
                    yield _archive(part, n, held)
                    n, held, bytes_ = n + 1, [], 0
                held.append((path, content))
                bytes_ += len(content) + 1024
        if held:
            yield _archive(part, n, held)

    write_pieces(files.mapInArrow(run, "path string, offset long, content binary"), root, dealt=True)


def _archive(part: int, n: int, members: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}.tar.gz"]), pa.array([0], pa.int64()), pa.array([_packed(members)], pa.binary())], ["path", "offset", "content"])


def read_packed(spark: SparkSession, root: str) -> DataFrame:
    """path and content of the members of all archives below root."""
    archives = list_files(spark, root).where(F.endswith("relative", F.lit(".tar.gz"))).select("relative")
    archives = archives.repartition(max(4 * spark.sparkContext.defaultParallelism, 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = located(root)
        for b in batches:
            for name in b.column("relative").to_pylist():
                paths, held, size = [], [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    raw = gzip.decompress(f.read())
                with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as tar:
                    while (member := tar.next()) is not None:
                        tar.members = []  # a reader keeps all of them otherwise
                        paths.append(member.name)
                        held.append(raw[member.offset_data : member.offset_data + member.size])
                        size += len(held[-1]) + len(paths[-1])
                        if size >= STEP or len(held) >= 10000:
                            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(held, pa.binary())], ["path", "content"])
                            paths, held, size = [], [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(held, pa.binary())], ["path", "content"])

    return archives.mapInArrow(run, "path string, content binary")
