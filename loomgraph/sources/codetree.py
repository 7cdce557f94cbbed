"""Source trees and ZIP archives of them as tables.

    scan(spark, root)                                       # or many roots at once
    spark.dataSource.register(CodeTree)
    spark.read.format("codetree").option("path", root).load()

Directories that are ignored or begin with a dot are never listed; dot files are kept. A file is a row if its suffix
belongs to a known language and it has at most 5 MiB. Files that cannot be read, and members of an archive that are
damaged, encrypted or packed in an unknown way, are rows with only rel_path and error. scan_ordinal numbers files of a
directory before those of its sub-directories, names sorted. A root is a local path or a URI of a store that pyarrow knows
(hdfs://, s3://, gs:// and so on); on a cluster it has to be one that all executors reach. Links to local folders are not
followed.

`scan` lists in tasks: the folders of one depth are a table, dealt to tasks that list them, and those found are the next
depth's; the ordinal is a place over sorted path keys. No list of files is on the driver. An archive's directory is read
once, by one task; tasks then read the byte ranges of their members. The data source "codetree" is for one root in plain
`spark.read`: it lists on the driver, applies conditions on ext and size while listing, so files that they leave out are
not opened, and opens no file with readContent=false.
"""

from __future__ import annotations

import bz2
import io
import os
import struct
import zipfile
import zlib
from collections.abc import Collection, Iterable, Iterator, Mapping
from functools import reduce
from pathlib import PurePosixPath
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from loomgraph.functions.constants import IGNORE_DIRS, LANGUAGES, MAX_FILE_BYTES
from loomgraph.functions.text import category_of, language_of, line_count
from loomgraph.operators.storage import numbered, settled

SCHEMA = "rel_path string, path string, name string, ext string, size long, scan_ordinal long, content binary, error string"
FILES_IN_PARTITION = 256
#: Folders that a task lists, and rows that it hands on at a time.
FOLDERS_IN_TASK = 64
ROWS = 4096
BATCH_BYTES = 16 << 20
LISTED = "root string, folder string, name string, is_folder boolean, place string, size long, at long, packed long, method int, crc long, error string"


UNREADABLE = (OSError, zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, struct.error)


class Files(InputPartition):
    def __init__(self, entries: list[tuple[int, str, str | Member]]):
        self.entries = entries  # ordinal, relative path, path or Member


def _wanted(name: str, suffixes: Collection[str] = LANGUAGES) -> bool:
    return PurePosixPath(name).suffix.lower() in suffixes


def _pruned(directory: str) -> bool:
    return directory in IGNORE_DIRS or directory.startswith(".")


def list_tree(root: str) -> list[tuple[str, str]]:
    """Relative path and path of each file, in scan order."""
    out = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(x for x in folders if not _pruned(x))
        for name in sorted(names):
            if _wanted(name):
                path = os.path.join(folder, name)
                out.append((os.path.relpath(path, root).replace(os.sep, "/"), path))
    return out


class Member(NamedTuple):
    """Where an archive has a member: the place of its local header, and what the directory says of it. method is -1 for
    an encrypted one."""

    relative: str
    name: str
    at: int
    packed: int
    size: int
    method: int
    crc: int


def members(file: BinaryIO | str, suffixes: Collection[str] = LANGUAGES) -> list[Member]:
    """Members of a ZIP that stay inside it, in its directory's order; a single top-level folder is descended into."""
    with zipfile.ZipFile(file) as archive:
        found = [m for m in archive.infolist() if not m.is_dir()]
    safe = [m for m in found if not PurePosixPath(m.filename).is_absolute() and ".." not in PurePosixPath(m.filename).parts]
    inner = len({m.filename.split("/", 1)[0] for m in safe}) == 1 and all("/" in m.filename for m in safe)
    out = []
    for m in safe:
        relative = m.filename.split("/", 1)[1] if inner else m.filename
        *folders, name = relative.split("/")
        if _wanted(name, suffixes) and not any(map(_pruned, folders)):
            out.append(Member(relative, m.filename, m.header_offset, m.compress_size, m.file_size, -1 if m.flag_bits & 1 else m.compress_type, m.CRC))
    return out


def list_archive(file: BinaryIO | str) -> list[Member]:
    """members() in scan order: a directory's files come before its sub-directories."""
    return sorted(members(file), key=lambda m: [(1, part) for part in m.relative.split("/")[:-1]] + [(0, m.relative.split("/")[-1])])


def member_bytes(file: BinaryIO, m: Member) -> bytes:
    """A member's bytes, from its range of the archive alone; sizes and checksum are held against the directory's."""
    if m.method == -1:
        raise zipfile.BadZipFile(f"File {m.name!r} is encrypted")
    if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        file.seek(0)
        return zipfile.ZipFile(file).read(m.name)  # rare packings, by the directory
    file.seek(m.at)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no local header of {m.name!r}")
    flags, method, _, _, _, packed, size, n_name, n_extra = struct.unpack("<HHHHIIIHH", head[6:30])
    told = not flags & 8 and 0xFFFFFFFF not in (packed, size)  # else the sizes follow the data or are in the extra field
    if method != m.method or told and (packed, size) != (m.packed, m.size):
        raise zipfile.BadZipFile(f"local header and directory differ for {m.name!r}")
    file.seek(m.at + 30 + n_name + n_extra)
    data = file.read(m.packed)
    if m.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-15).decompress(data, m.size + 1)  # never more than is stated
    elif m.method == zipfile.ZIP_BZIP2:
        data = bz2.BZ2Decompressor().decompress(data, m.size + 1)
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {m.name!r}")
    return data


def list_store(store: FileSystem, root: str) -> list[tuple[str, str]]:
    """As list_tree, of a store; folders are listed one by one, so pruned ones are not."""
    out, folders = [], [""]
    while folders:
        folder = folders.pop()
        found = sorted(store.get_file_info(FileSelector(f"{root}/{folder}".rstrip("/"))), key=lambda x: x.base_name)
        relative = [(x, f"{folder}/{x.base_name}".lstrip("/")) for x in found]
        out += [(name, x.path) for x, name in relative if x.type == FileType.File and _wanted(x.base_name)]
        folders += [name for x, name in reversed(relative) if x.type == FileType.Directory and not _pruned(x.base_name)]
    return out


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.store, self.root = store_of(options.get("path", ""))
        self.suffixes: set[str] | None = None
        self.most_bytes = MAX_FILE_BYTES
        self.content = str(options.get("readContent", "true")).lower() == "true"
        self.zipped = self.root.lower().endswith(".zip")
        if self.store:
            there = self.store.get_file_info(self.root).type == (FileType.File if self.zipped else FileType.Directory)
        else:
            there = os.path.isfile(self.root) if self.zipped else os.path.isdir(self.root)
        if not there:
            raise ValueError(f"neither a folder nor a ZIP archive: {self.root!r}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality on ext and bounds on size; all are left to Spark too, which checks them on what comes."""
        for f in filters:
            match f:
                case EqualTo(("ext",), value):
                    self.suffixes = {value} & (self.suffixes or {value})
                case In(("ext",), values):
                    self.suffixes = set(values) & (self.suffixes or set(values))
                case LessThanOrEqual(("size",), value) | LessThan(("size",), value):
                    self.most_bytes = min(self.most_bytes, value)
            yield f

    def partitions(self):
        if self.zipped:
            with self._opened(self.root) as file:
                found = [(m.relative, m) for m in list_archive(file)]
        else:
            found = list_store(self.store, self.root) if self.store else list_tree(self.root)
        found = [x for x in found if self.suffixes is None or PurePosixPath(x[0]).suffix.lower() in self.suffixes]
        entries = [(i, *x) for i, x in enumerate(found)]
        return [Files(entries[i : i + FILES_IN_PARTITION]) for i in range(0, len(entries), FILES_IN_PARTITION)] or [Files([])]

    def _opened(self, path: str):
        return self.store.open_input_file(path) if self.store else io.open(path, "rb")

    def read(self, partition):
        archive = self._opened(self.root) if self.zipped else None
        for ordinal, relative, place in partition.entries:
            name = PurePosixPath(relative).name
            path = place.name if archive else place
            try:
                size = place.size if archive else self.store.get_file_info(place).size if self.store else os.stat(place).st_size
                if size > self.most_bytes:
                    continue
                data = None
                if self.content:
                    if archive:
                        data = member_bytes(archive, place)
                    else:
                        with self._opened(place) as f:
                            data = f.read()
                yield (relative, path, name, PurePosixPath(name).suffix.lower(), size, ordinal, data, None)
            except UNREADABLE as e:
                yield (relative, path, name, None, None, ordinal, None, str(e))


class CodeTree(DataSource):
    @classmethod
    def name(cls):
        return "codetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def store_of(root: str) -> tuple[FileSystem | None, str]:
    """The store of a URI, None for a local path, and the path within it."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(root) if "://" in root else (None, root)


def write_file(store: FileSystem | None, path: str, data: bytes, made: set[str]) -> None:
    """Writes a file and the folders that it needs; made: the folders that are known to be there."""
    folder = path.rpartition("/")[0]
    if folder not in made:
        store.create_dir(folder, recursive=True) if store else os.makedirs(folder, exist_ok=True)
        made.add(folder)
    with store.open_output_stream(path) if store else open(path, "wb") as out:
        out.write(data)


def _zipped(root: str) -> bool:
    return root.lower().endswith(".zip")


def _frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def _folder(root: str, folder: str, suffixes: Collection[str]) -> Iterator[tuple]:
    """Rows of LISTED for one folder: its sub-folders and files that are wanted."""
    store, base = store_of(root)
    try:
        if store:
            found = [(x.base_name, x.type == FileType.Directory, x.path, x.size) for x in store.get_file_info(FileSelector(f"{base}/{folder}".rstrip("/")))]
        else:
            with os.scandir(os.path.join(base, folder)) as entries:
                found = [(x.name, x.is_dir(follow_symlinks=False), x.path, x) for x in entries if not (x.is_symlink() and x.is_dir())]
    except OSError as e:
        if not folder:
            raise ValueError(f"neither a folder nor a ZIP archive: {root!r}") from e
        return  # a folder that cannot be listed, as when a tree is walked
    if not found and not folder:
        raise ValueError(f"empty folder: {root!r}")
    for name, is_folder, path, size in found:
        if is_folder and not _pruned(name):
            yield root, folder, name, True, path, None, None, None, None, None, None
        elif not is_folder and _wanted(name, suffixes):
            try:
                yield root, folder, name, False, path, size.stat().st_size if isinstance(size, os.DirEntry) else size, None, None, None, None, None
            except OSError as e:
                yield root, folder, name, False, path, None, None, None, None, None, str(e)


def _archive(root: str, suffixes: Collection[str]) -> Iterator[tuple]:
    """Rows of LISTED for an archive: all its members that are wanted."""
    store, path = store_of(root)
    try:
        file = store.open_input_file(path) if store else open(path, "rb")
    except OSError as e:
        raise ValueError(f"neither a folder nor a ZIP archive: {root!r}") from e
    with file:
        for m in members(file, suffixes):
            folder, _, name = m.relative.rpartition("/")
            yield root, folder, name, False, m.name, m.size, m.at, m.packed, m.method, m.crc, None


def _listed(suffixes: Collection[str]):
    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (x for frame in frames for x in zip(frame["root"], frame["folder"], strict=True))
        rows = (row for root, folder in each for row in (_archive(root, suffixes) if _zipped(root) else _folder(root, folder, suffixes)))
        return _frames(rows, [c.split()[0] for c in LISTED.split(", ")])

    return listed


def listing(roots: DataFrame, suffixes: Collection[str] = LANGUAGES) -> DataFrame:
    """roots: root. The files of all trees and archives, in tasks, a depth a round: LISTED and scan_ordinal."""
    front, levels = roots.select("root", F.lit("").alias("folder")).distinct(), []
    while (n := front.count()):
        level = settled(front.repartition(1 + n // FOLDERS_IN_TASK).mapInPandas(_listed(frozenset(suffixes)), LISTED), "listed")
        levels.append(level.where("not is_folder"))
        front = level.where("is_folder").select("root", F.concat_ws("/", F.nullif("folder", F.lit("")), "name").alias("folder"))
    if not levels:
        raise ValueError("no roots")
    rows = reduce(DataFrame.unionAll, levels)
    parts = F.filter(F.split("folder", "/"), lambda x: x != "")
    key = F.concat(F.transform(parts, lambda x: F.concat(F.lit("1"), x)), F.array(F.concat(F.lit("0"), "name")))
    named = rows.withColumnsRenamed({"place": "path", "size": "bytes"}).withColumn("key", key)
    placed = numbered(named, ["key"], ["root"]).drop("key", "size").withColumnRenamed("place", "scan_ordinal")
    return placed.withColumnsRenamed({"path": "place", "bytes": "size"})


def _contents(content: bool):
    columns = ["root", *(c.split()[0] for c in SCHEMA.split(", "))]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        opened, file, store = None, None, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                relative = f"{r.folder}/{r.name}".lstrip("/")
                try:
                    if r.error:
                        raise OSError(r.error)
                    data, size = None, int(r.size)
                    if content:
                        if r.root != opened:
                            opened, (store, path) = r.root, store_of(r.root)
                            file = (store.open_input_file(path) if store else open(path, "rb")) if _zipped(r.root) else None
                        if file:
                            data = member_bytes(file, Member(relative, r.place, int(r.at), int(r.packed), size, int(r.method), int(r.crc)))
                        else:
                            with store.open_input_file(r.place) if store else open(r.place, "rb") as f:
                                data = f.read()
                    yield r.root, relative, r.place, r.name, PurePosixPath(r.name).suffix.lower(), size, r.scan_ordinal, data, None
                except UNREADABLE as e:
                    yield r.root, relative, r.place, r.name, None, None, r.scan_ordinal, None, str(e)

    def contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for row in rows(frames):
            held.append(row)
            size += 200 + (row[5] or 0)
            if size > BATCH_BYTES:
                yield pd.DataFrame(held, columns=columns, dtype=object)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns, dtype=object)

    return contents


def scan_all(roots: DataFrame, content: bool = True, languages: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """roots: root. All rows of many trees and archives, errors included; scan_ordinal counts within each root.

    A root that is no folder or archive, or an empty folder, is an error of the job.
    """
    listed = settled(listing(roots, languages), "listing")
    small = listed.where(F.col("size").isNull() | (F.col("size") <= MAX_FILE_BYTES))
    dealt = small.repartition(1 + listed.count() // FILES_IN_PARTITION, "root", F.floor(F.col("scan_ordinal") / FILES_IN_PARTITION)).sortWithinPartitions("root", "at", "scan_ordinal")
    return dealt.mapInPandas(_contents(content), f"root string, {SCHEMA}")


def scan(spark: SparkSession, path: str, content: bool = True, languages: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """All rows of one tree or archive, errors included. A path that is neither, and an empty folder, raise."""
    store, place = store_of(path)
    if store:
        kind = store.get_file_info(place).type
        there = kind == (FileType.File if _zipped(path) else FileType.Directory)
        empty = there and kind == FileType.Directory and not store.get_file_info(FileSelector(place))
    else:
        there = os.path.isfile(place) if _zipped(path) else os.path.isdir(place)
        empty = there and os.path.isdir(place) and not os.listdir(place)
    if not there:
        raise ValueError(f"neither a folder nor a ZIP archive: {path!r}")
    if empty:
        raise ValueError(f"empty folder: {path!r}")
    return scan_all(spark.createDataFrame([(path,)], "root string"), content, languages).drop("root")


def files(rows: DataFrame, languages: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """Rows of scan() as files with language, category and line count (as UTF-8 where valid, else as Latin-1)."""
    readable = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return rows.where("error is null").select(
        "rel_path", "path", "name", "ext", "size", "scan_ordinal", "content",
        language_of(F.col("ext"), languages).alias("language"), category_of(F.col("ext")).alias("category"),
        F.coalesce(line_count(readable), F.lit(0)).alias("lines"),
    )


def scan_errors(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("rel_path", "error")
