"""Files under their own names, written and read by executors.

`write_files` writes rows (path, content) as one file each, `write_pieces` rows (path, offset, content) as parts of files, so that a
file may be larger than what a task holds. Both go through a Python data source: tasks write below a staging folder beside the
target, and only the driver's commit, one rename, puts it in the target's place. A task that runs twice writes the same bytes at the
same offsets again; a job that fails removes the staging folder, and what was there before stays.

On file systems with random access (file:) the pieces of one file may be written by several tasks at once, as pieces are dealt by
ranges of path and offset; on others the pieces of a file go to one task, which appends them in order.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpuscle.session import ship
from corpuscle.sources.shared import exists, scratch, written

#: Bytes of a piece.
PIECE = 8 << 20
#: Bytes of contents that a task gathers before it hands them on; a piece may be larger.
STEP = 4 << 20
NAME = "corpuscle_named_files"


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path there."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def safe(path: str) -> str:
    parts = path.split("/")
    if not path or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path below a folder: {path!r}")
    return path


class _Local:
    """Pieces at their offsets; several tasks may write to one file."""

    def __init__(self, base: str):
        self.base, self.path, self.handle = base, None, -1

    def put(self, path: str, offset: int, content: bytes) -> None:
        if path != self.path:
            self.close()
            name = f"{self.base}/{path}"
            os.makedirs(os.path.dirname(name), exist_ok=True)
            self.path, self.handle = path, os.open(name, os.O_WRONLY | os.O_CREAT, 0o644)
        view = memoryview(content)
        while len(view):
            n = os.pwrite(self.handle, view, offset)
            view, offset = view[n:], offset + n

    def close(self) -> None:
        if self.handle >= 0:
            os.close(self.handle)
        self.path, self.handle = None, -1


class _Stream:
    """Pieces in their order, from a file system without random access."""

    def __init__(self, fs: pafs.FileSystem, base: str):
        self.fs, self.base, self.path, self.out = fs, base, None, None

    def put(self, path: str, offset: int, content: bytes) -> None:
        if path != self.path:
            self.close()
            name = f"{self.base}/{path}"
            self.fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            self.path, self.out = path, self.fs.open_output_stream(name)
        if offset != self.out.tell():
            raise ValueError(f"{path}: a piece at {offset}, but {self.out.tell()} bytes are written")
        self.out.write(content)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.path = self.out = None


class Writer(DataSourceArrowWriter):
    def __init__(self, root: str, whole: bool):
        self.root, self.whole = root.rstrip("/"), whole
        self.staging = f"{self.root}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = located(self.staging)
        out = _Local(base) if isinstance(fs, pafs.LocalFileSystem) else _Stream(fs, base)
        last = None
        try:
            for b in iterator:
                for path, offset, content in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "content")), strict=True):
                    if self.whole and path == last:
                        raise ValueError(f"two files of one name: {path}")
                    out.put(safe(path), offset, content or b"")
                    last = path
        finally:
            out.close()
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = located(self.staging)
        target = located(self.root)[1]
        fs.create_dir(base, recursive=True)  # no file at all
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            fs.move(target, f"{base}.before")
        fs.move(base, target)
        if fs.get_file_info(f"{base}.before").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}.before")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = located(self.staging)
        if fs.get_file_info(base).type != pafs.FileType.NotFound:
            fs.delete_dir(base)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, offset long, content binary"

    def writer(self, schema: object, overwrite: bool) -> Writer:  # noqa: ARG002
        if not overwrite:
            raise ValueError("what was there before goes; write with mode overwrite")
        return Writer(self.options["path"], self.options["whole"] == "true")


def _write(rows: DataFrame, root: str, whole: bool) -> None:
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(NamedFiles)
    rows.write.format(NAME).mode("overwrite").option("whole", str(whole).lower()).save(root)


def write_files(rows: DataFrame, root: str) -> None:
    """One file for each row (path below root, content: text or bytes, null is empty); what was at root before goes. Two rows of one
    path raise. Rows are dealt by path, so a task has whole runs of neighbours, and no folder for itself."""
    files = rows.select("path", F.lit(0).cast("long").alias("offset"), F.col("content").cast("binary").alias("content"))
    _write(files.repartition("path").sortWithinPartitions("path"), root, True)


def deal(pieces: DataFrame, root: str) -> DataFrame:
    """Pieces (path, offset, and other columns) in the tasks and the order in which they are written below root."""
    local = isinstance(located(root)[0], pafs.LocalFileSystem)
    dealt = pieces.repartitionByRange("path", "offset") if local else pieces.repartition("path")
    return dealt.sortWithinPartitions("path", "offset")


def write_pieces(rows: DataFrame, root: str, *, dealt: bool = False) -> None:
    """Files of pieces (path below root, offset, content: bytes); what was at root before goes. dealt: `deal` has been called before
    the contents were there, so that they are neither sampled nor moved."""
    pieces = rows.select("path", F.col("offset").cast("long").alias("offset"), "content")
    _write(pieces if dealt else deal(pieces, root), root, False)


def _skipped(name: str) -> bool:
    """Names that Spark's scans of files leave out."""
    return (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and length of what is in a folder."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                yield e.name, e.is_dir(), e.stat().st_size
    else:
        for e in fs.get_file_info(pafs.FileSelector(folder)):
            yield e.base_name, e.type == pafs.FileType.Directory, e.size or 0


def reachable(root: str) -> bool:
    """Whether root is one folder that executors can list; if not, such as a pattern, it is left to Spark's scans."""
    try:
        fs, base = located(root)
        return not re.search(r"[*?\[{]", root) and fs.get_file_info(base).type == pafs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """source (path), relative (below root) and length of every file below root, empty ones too; the contents are not read. Executors
    list the folders, level by level, and write what they find, so the driver holds no names."""
    ship(spark)
    fs, base = located(root)
    base = base.rstrip("/")
    lead = "file:" if isinstance(fs, pafs.LocalFileSystem) else root.rstrip("/")[: -len(base)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = located(root)[0], ["relative", "folder", "length"]
        for b in batches:
            for folder in b.column("relative").to_pylist():
                inside = ((f"{folder}{n}", d, size) for n, d, size in _entries(own, f"{base}/{folder}") if not _skipped(n))
                while some := list(islice(inside, 10000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], names)

    at, level, folders = scratch(spark), 0, spark.createDataFrame([("",)], "relative string")
    while level == 0 or not folders.isEmpty():
        found = written(folders.mapInArrow(run, "relative string, folder boolean, length long"), f"{at}/{level}")
        folders = found.where("folder").select(F.concat("relative", F.lit("/")).alias("relative")).repartition("relative")
        level += 1
    files = spark.read.schema(found.schema).parquet(*(f"{at}/{i}" for i in range(level))).where("not folder")
    return files.select(F.concat(F.lit(f"{lead}{base}/"), "relative").alias("source"), "relative", "length")


#: Columns of a listing that is kept.
LISTING = "source string, length long"


def keep_listing(spark: SparkSession, root: str, listing: str) -> None:
    """Adds the files below root that the table `listing` does not hold yet; one caller at a time. A call that broke off is made up for
    by the next one, as what it added is held."""
    files = list_files(spark, root).select("source", "length")
    if exists(spark, listing):
        files = files.join(spark.read.schema(LISTING).parquet(listing), "source", "left_anti")
    files.write.mode("append").parquet(listing)


def spread(files: DataFrame, length: str = "length", size: int = 64 << 20) -> DataFrame:
    """Files dealt anew, as those of one folder were listed by one task: to all cores, and not much more than `size` bytes a task."""
    total = files.agg(F.sum(length)).first()[0] or 0
    return files.repartition(max(4 * files.sparkSession.sparkContext.defaultParallelism, 32, -(-total // size)))


def _reader() -> Callable[[str, int, int], bytes]:
    """Reads a part of a file by its path as listings give it."""

    def read(source: str, at: int, n: int) -> bytes:
        if source.startswith("file:") or "://" not in source:
            with open(re.sub("^file:/+", "/", source), "rb") as f:
                f.seek(at)
                return f.read(n)
        fs, path = located(source)
        with fs.open_input_file(path) as f:
            return f.read_at(n, at)

    return read


def read_pieces(parts: DataFrame, *, text: bool = False) -> DataFrame:
    """Adds content: the bytes of parts of files (source, source_offset, n, and other columns), read where they are needed; some MB a
    step. text: as text, without bytes that are no UTF-8."""
    ship(parts.sparkSession)
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader()
        for b in batches:
            held, first, size = [], 0, 0
            for i, (source, at, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("source", "source_offset", "n")), strict=True)):
                held.append(read(source, at, n))
                size += n
                if size >= STEP or i + 1 == b.num_rows:
                    content = pa.array([c.decode("utf-8", "ignore") for c in held], pa.string()) if text else pa.array(held, pa.binary())
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(held)) for c in b.columns), content], [*names, "content"])
                    held, first, size = [], i + 1, 0

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInArrow(run, f"{kind}, content {'string' if text else 'binary'}")


def read_files(files: DataFrame, *, text: bool = False) -> DataFrame:
    """path and content of whole files (source, length), spread over all cores."""
    whole = spread(files.select("source", "length")).select("source", F.lit(0).cast("long").alias("source_offset"), F.col("length").alias("n"))
    return read_pieces(whole, text=text).select(F.col("source").alias("path"), "content")
