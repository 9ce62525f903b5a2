"""Tar and ZIP archives as a Spark data source that splits, and archives written as a stream.

The data source `archive` plans ranges of members from headers alone (a tar's headers by seeking from one to the next, a
ZIP's central directory) and reads each range in a task of its own: members come one at a time, so no task holds an archive.
A compressed tar can't be split and is streamed by one task. Bad members are rows with a problem, not failures."""

from __future__ import annotations

import stat
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import query
from ..staging import shared_dir, shipped
from .views import read

#: Bytes of members that one task reads, unless the option rangeBytes says otherwise.
RANGE_BYTES = 64 << 20
_SCHEMA = "path string, ordinal long, member string, bytes long, problem string, content binary"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _opened(path: str) -> pa.NativeFile:
    system, inner = _filesystem(path)
    return system.open_input_file(inner)


class Range(InputPartition):
    """Members of an archive: of a tar from byte a up to byte b, of a ZIP the a-th up to the b-th; ordinal: of the first."""

    def __init__(self, path: str, kind: str, a: int = 0, b: int = 0, ordinal: int = 0, problem: str = ""):
        self.path, self.kind, self.a, self.b, self.ordinal, self.problem = path, kind, a, b, ordinal, problem


def ranges(path: str, most: int) -> Iterator[Range]:
    """The ranges of one archive, each of about `most` bytes; only headers are read."""
    with _opened(path) as f:
        head = f.read(512)
        f.seek(0)
        if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            try:
                sizes = [i.compress_size for i in zipfile.ZipFile(f).infolist()]
            except zipfile.BadZipFile as e:
                yield Range(path, "broken", problem=f"broken archive: {e}")
                return
            first, held = 0, 0
            for n, size in enumerate(sizes):
                held += size
                if held >= most or n + 1 == len(sizes):
                    yield Range(path, "zip", first, n + 1, first)
                    first, held = n + 1, 0
        elif head[257:262] == b"ustar":
            yield from _tar_ranges(path, f, most)
        else:
            yield Range(path, "stream")


def _tar_ranges(path: str, f: pa.NativeFile, most: int) -> Iterator[Range]:
    start, first, n, size = 0, 0, 0, f.size()
    with tarfile.open(fileobj=f, mode="r:") as t:
        while True:
            try:
                info = t.next()
            except tarfile.TarError as e:
                yield Range(path, "tar", start, t.offset, first)
                yield Range(path, "broken", ordinal=n, problem=f"broken archive: {e}")
                return
            if info is None:
                break
            t.members = []  # headers that were read are not needed again
            n += 1
            if t.offset - start >= most:
                yield Range(path, "tar", start, t.offset, first)
                start, first = t.offset, n
        if n > first:
            yield Range(path, "tar", start, min(t.offset, size), first)


def _problem(name: str, is_file: bool, is_dir: bool) -> str:
    if not (is_file or is_dir):
        return "not a file"
    return "unsafe path" if name.startswith("/") or "\\" in name or ".." in name.split("/") else ""


def _tar_rows(t: tarfile.TarFile, part: Range, end: int | None, content: bool) -> Iterator[tuple]:
    n = part.ordinal
    while end is None or n == part.ordinal or t.offset < end:  # opening a tar has read its first header already
        try:
            info = t.next()
            if info is None:
                return
            t.members = []
            if info.isdir():
                problem, data = _problem(info.name, False, True), None
            else:
                problem = _problem(info.name, info.isfile(), False)
                data = t.extractfile(info).read() if content and info.isfile() else None
                if data is not None and len(data) != info.size:
                    problem, data = "truncated", None
        except (tarfile.TarError, EOFError, zlib.error, OSError) as e:
            yield part.path, n, None, None, f"broken archive: {e}", None
            return
        if not info.isdir():
            yield part.path, n, info.name, info.size, problem, data
        n += 1


def _zip_rows(z: zipfile.ZipFile, part: Range, content: bool) -> Iterator[tuple]:
    for n, info in enumerate(z.infolist()[part.a : part.b], part.ordinal):
        if info.is_dir():
            continue
        mode = info.external_attr >> 16
        problem, data = _problem(info.filename, not stat.S_IFMT(mode) or stat.S_ISREG(mode), False), None
        if content and problem != "not a file":
            try:
                data = z.read(info)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                problem = f"broken member: {type(e).__name__}"
        yield part.path, n, info.filename, info.file_size, problem, data


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.most, self.content = int(options.get("rangeBytes", RANGE_BYTES)), options.get("content", "true").lower() == "true"

    def partitions(self) -> list[Range]:
        return [r for p in self.paths for r in ranges(p, self.most)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.kind == "broken":
            yield part.path, part.ordinal, None, None, part.problem, None
            return
        with _opened(part.path) as f:
            if part.kind == "zip":
                yield from _zip_rows(zipfile.ZipFile(f), part, self.content)
            elif part.kind == "tar":
                f.seek(part.a)
                with tarfile.open(fileobj=f, mode="r:") as t:
                    yield from _tar_rows(t, part, part.b, self.content)
            else:
                try:
                    t = tarfile.open(fileobj=f, mode="r|*")
                except tarfile.TarError as e:
                    yield part.path, 0, None, None, f"not an archive: {e}", None
                    return
                with t:
                    yield from _tar_rows(t, part, None, self.content)


class ArchiveSource(DataSource):
    """Members of the archives at `paths` (one a line): path, ordinal, member, bytes, problem, content."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES, content: bool = True) -> DataFrame:
    """path, ordinal, member, bytes, problem, content of all files in the archives. problem: empty, or not a file, unsafe path,
    duplicate (all but the first of a name), broken member, broken archive (what follows can't be read), not an archive."""
    shipped(spark)
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("archive").options(paths="\n".join(paths), rangeBytes=str(range_bytes), content=str(content).lower()).load()
    again = F.row_number().over(Window.partitionBy("path", "member").orderBy("ordinal")) > 1
    return rows.withColumn("problem", F.when(again & (F.col("problem") == "") & F.col("member").isNotNull(), "duplicate").otherwise(F.col("problem")))


def write_tars(members: DataFrame, folder: str) -> DataFrame:
    """Writes members (path, member, content, link: a target if it is a link, else null) to <folder>/<path>.tar, in order of
    (member, content), and gives path, file, members. A task streams one archive after the other; each gets its name when
    it is whole, so a task that runs again leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        held, n, out, tar = None, 0, None, None
        name = uuid.uuid4().hex

        def ended() -> pa.RecordBatch:
            tar.close()
            out.close()
            system.move(f"{base}/.{name}.tmp", f"{base}/{held}.tar")
            return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([f"{folder}/{held}.tar"]), pa.array([n])], names=["path", "file", "members"])

        for batch in batches:
            for path, member, content, link in zip(*(batch.column(c) for c in ("path", "member", "content", "link"))):
                path = path.as_py()
                if path != held:
                    if held is not None:
                        yield ended()
                    held, n, out = path, 0, system.open_output_stream(f"{base}/.{name}.tmp")
                    tar = tarfile.open(fileobj=out, mode="w|")
                info = tarfile.TarInfo(member.as_py())
                if link.is_valid:
                    info.type, info.linkname = tarfile.SYMTYPE, link.as_py()
                    tar.addfile(info)
                else:
                    data = content.as_buffer()
                    info.size = data.size
                    tar.addfile(info, pa.BufferReader(data))
                n += 1
        if held is not None:
            yield ended()

    shipped(members.sparkSession)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("path", "member", "content", "link").repartition(parts, "path").sortWithinPartitions("path", "member", "content")
    return dealt.mapInArrow(run, "path string, file string, members long")


@query("""WITH m AS (SELECT CAST(c_nationkey AS VARCHAR) AS path, CASE WHEN c_custkey % 97 = 5 THEN '../' ELSE '' END || printf('btest_%06d', c_custkey) || '/clean.txt' AS member,
  encode(c_name || ' ' || c_custkey) AS content, c_custkey % 83 = 11 AS link, c_custkey % 89 = 7 AS twice FROM customer),
r AS (SELECT path, member, link, content, 1 AS n FROM m UNION ALL SELECT path, member, link, content, 2 AS n FROM m WHERE twice AND NOT link)
SELECT path, member, CAST(CASE WHEN link THEN 0 ELSE octet_length(content) END AS BIGINT) AS bytes,
  CASE WHEN link THEN 'not a file' WHEN starts_with(member, '../') THEN 'unsafe path' WHEN n = 2 THEN 'duplicate' ELSE '' END AS problem, CASE WHEN NOT link THEN sha256(content) END AS sha FROM r""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files packed by nation, among them links, paths out of the folder and repeated names, and read in ranges of 64 KB."""
    c = read(spark, sf_dir, "customer").withColumn("path", F.col("c_nationkey").cast("string"))
    name = F.concat(F.when(F.col("c_custkey") % 97 == 5, "../").otherwise(""), F.format_string("btest_%06d", "c_custkey"), F.lit("/clean.txt"))
    link = F.when(F.col("c_custkey") % 83 == 11, "elsewhere")
    m = c.select("c_custkey", "path", name.alias("member"), F.concat_ws(" ", "c_name", F.col("c_custkey").cast("string")).cast("binary").alias("content"), link.alias("link"))
    m = m.union(m.filter("c_custkey % 89 = 7 and link is null"))
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex}"
    files = [r.file for r in write_tars(m, folder).collect()]  # a name for each archive
    got = read_archives(spark, sorted(files), range_bytes=1 << 16)
    path = F.regexp_extract("path", r"([^/]+)\.tar$", 1)
    return got.select(path.alias("path"), "member", "bytes", "problem", F.when(F.col("problem") != "not a file", F.sha2("content", 256)).alias("sha"))
