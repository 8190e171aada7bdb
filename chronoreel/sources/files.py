"""Files as a data source that commits, and folders as tables.

``df.write.format("chronoreel_files").mode("append").save(root)`` writes the rows (path, content) as files below ``root``.
Rows of one path that follow each other in a task are one file, so a clip streams. A task writes below a folder of its
attempt; only when all tasks are done the driver moves what the successful attempts wrote into place, whole folders at once
where nothing is there yet and one task has all of it, and writes ``_SUCCESS``. So deal the files of a folder to one task where they are many and small. Attempts that failed or lost a race are deleted with the job's folder, and an aborted
job leaves nothing. ``overwrite`` empties ``root`` at the commit, not before. A path that two tasks write, or that is
there already, ends the job before anything is moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "chronoreel_files"
ATTEMPTS = "_attempts"
MOVES_AT_ONCE = 16
ROWS, BYTES = 1024, 4 << 20  # of a batch of names or contents


def store_of(path: str):
    """(file system, path in it) of a path or URI."""
    import pyarrow.fs

    if "://" in path or path.startswith("file:/"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return pyarrow.fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class CommittingWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = root.rstrip("/"), overwrite, uuid.uuid4().hex

    def _job(self, base: str) -> str:
        return f"{base}/{ATTEMPTS}/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = store_of(self.root)
        attempt = f"{task.partitionId()}-{task.attemptNumber()}-{task.taskAttemptId()}"
        top = f"{self._job(base)}/{attempt}"
        fs.create_dir(top, recursive=True)
        open_path, out, seen, made = None, None, set(), None
        try:
            for row in iterator:
                path = row["path"]
                if path != open_path:
                    if path is None or path.startswith(("/", "_")) or ".." in path.split("/") or path in seen:
                        raise ValueError(f"not a path of one file below the root: {path!r}")
                    if out is not None:
                        out.close()
                    seen.add(path)
                    if (folder := path.rpartition("/")[0]) != made:
                        fs.create_dir(f"{top}/{folder}", recursive=True)
                        made = folder
                    open_path, out = path, fs.open_output_stream(f"{top}/{path}")
                out.write(bytes(row["content"] or b""))
        finally:
            if out is not None:
                out.close()
        return Written(attempt, len(seen))

    def commit(self, messages: list) -> None:
        fs, base = store_of(self.root)
        tops = [f"{self._job(base)}/{m.attempt}" for m in messages if m is not None]
        folders: list[str] = []
        moves = list(self._moves(fs, tops, base, not self.overwrite, folders))
        if self.overwrite:
            for name, info in (_children(fs, base) or {}).items():
                if name != ATTEMPTS:
                    fs.delete_dir(info.path) if _is_dir(info) else fs.delete_file(info.path)
        for folder in folders:
            fs.create_dir(folder)
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            for _ in pool.map(lambda x: fs.move(*x), moves):
                pass
        fs.delete_dir(self._job(base))
        if not _children(fs, f"{base}/{ATTEMPTS}"):
            fs.delete_dir(f"{base}/{ATTEMPTS}")
        with fs.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m is not None)).encode())

    def abort(self, messages: list) -> None:
        fs, base = store_of(self.root)
        if _children(fs, self._job(base)) is not None:
            fs.delete_dir(self._job(base))
        if _children(fs, f"{base}/{ATTEMPTS}") == {}:
            fs.delete_dir(f"{base}/{ATTEMPTS}")

    def _moves(self, fs, sources: list[str], target: str, exists: bool, folders: list[str], path: str = "") -> Iterator[tuple[str, str]]:
        """(from, to) for all that lies in ``sources``: whole folders where one source has them and they are new; ``folders`` are to be made before.

        Nothing that stays may be hidden by a new file, nor one new file by another.
        """
        there = (_children(fs, target) or {}) if exists else {}
        found: dict[str, list] = {}
        for source in sources:
            for name, info in (_children(fs, source) or {}).items():
                found.setdefault(name, []).append(info)
        for name, infos in found.items():
            own = f"{path}/{name}".lstrip("/")
            if name not in there and len(infos) == 1:
                yield infos[0].path, f"{target}/{name}"
                continue
            if name in there and not all(map(_is_dir, [there[name], *infos])):
                raise FileExistsError(f"{own} is there already")
            if not all(map(_is_dir, infos)):
                raise FileExistsError(f"{own} is written twice")
            if name not in there:
                folders.append(f"{target}/{name}")
            yield from self._moves(fs, [x.path for x in infos], f"{target}/{name}", name in there, folders, own)


def _is_dir(info) -> bool:
    import pyarrow.fs

    return info.type == pyarrow.fs.FileType.Directory


def _children(fs, path: str) -> dict | None:
    """What lies in a folder, by name; None if there is none."""
    import pyarrow.fs

    if not _is_dir(fs.get_file_info(path)):
        return None
    return {x.base_name: x for x in fs.get_file_info(pyarrow.fs.FileSelector(path))}


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> CommittingWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("rows of files have path and content")
        return CommittingWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, root: str, mode: str = "append") -> None:
    """Write (path, content); see the module."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("path", F.col("content").cast("binary").alias("content")).write.format(NAME).mode(mode).save(root)


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    """Rows dealt by path into as many tasks as a shuffle has; names are few bytes and much work, so their number must not follow their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", *more)


def _mapped(rows: DataFrame, root: str, each: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``each(file system, root's path, path)`` for every path, in batches."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store_of(root)
        out, size = [], 0
        for pdf in batches:
            for path in pdf["path"]:
                for row in each(fs, base.rstrip("/"), path):
                    out.append(row)
                    size += len(row[-1]) if isinstance(row[-1], bytes) else 0
                    if len(out) >= ROWS or size >= BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
        yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def _inside(fs, base: str, path: str, folders: bool) -> Iterator[tuple[str]]:
    for name, info in (_children(fs, base + path) or {}).items():
        if name[0] not in "_." and _is_dir(info) == folders:
            yield (f"{path}/{name}",)


def _level(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """(path) of the folders ``depth`` levels below ``root``, as /a/b; each level is listed by the tasks that the level above is dealt to."""
    level = spark.createDataFrame([("",)], "path string")
    for _ in range(depth):
        level = _dealt(_mapped(level, root, lambda fs, base, path: _inside(fs, base, path, True), "path string"))
    return level


def list_folders(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """(path, n_files) of all folders ``depth`` levels below ``root``; a folder without files counts 0, a root that is not there has none.

    Names that begin with ``_`` or ``.`` are left out.
    """
    root = root.rstrip("/")

    def counted(fs, base: str, path: str) -> list[tuple[str, int]]:
        return [(path, sum(1 for _ in _inside(fs, base, path, False)))]

    found = _mapped(_level(spark, root, depth), root, counted, "path string, n_files int")
    return found.select(F.concat(F.lit(root), "path").alias("path"), "n_files")


def list_files(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """(path) below ``root``, as /a/b.txt, of the files in all folders ``depth`` levels below it; names that begin with ``_`` or ``.`` are left out."""
    return _dealt(_mapped(_level(spark, root.rstrip("/"), depth), root, lambda fs, base, path: _inside(fs, base, path, False), "path string"))


def list_partitioned(spark: SparkSession, root: str) -> DataFrame:
    """(path) below ``root``, as /a=b/c.json, of the files in it and in folders named key=value below it at any depth: those that Spark's readers find there.

    The folders in ``root`` are dealt to tasks, and so are the names found; a task has its names in order, the same ones at each call.
    Empty files, and names that begin with ``_`` or ``.``, are left out.
    """

    def found(fs, base: str, path: str, deep: bool = True) -> Iterator[tuple[str]]:
        for name, info in (_children(fs, base + path) or {}).items():
            own = f"{path}/{name}"
            if name[0] not in "_." and _is_dir(info) and "=" in name:
                yield from found(fs, base, own) if deep else [(f"{own}/",)]
            elif name[0] not in "_." and not _is_dir(info) and info.size:
                yield (own,)

    top = spark.createDataFrame([("",)], "path string")
    level = _dealt(_mapped(top, root, lambda fs, base, path: found(fs, base, path, False), "path string"))
    names = _mapped(level, root, lambda fs, base, path: found(fs, base, path[:-1]) if path.endswith("/") else [(path,)], "path string")
    return _dealt(names).sortWithinPartitions("path")


def list_ranges(spark: SparkSession, root: str, depth: int, range_bytes: int) -> DataFrame:
    """(path, start, end, size) of the files that ``list_files`` finds, cut into ranges of their bytes."""

    def ranges(fs, base: str, path: str) -> Iterator[tuple[str, int, int, int]]:
        for name, info in (_children(fs, base + path) or {}).items():
            if name[0] not in "_." and not _is_dir(info):
                for at in range(0, max(info.size, 1), range_bytes):
                    yield f"{path}/{name}", at, min(at + range_bytes, info.size), info.size

    return _dealt(_mapped(_level(spark, root, depth), root, ranges, "path string, start long, end long, size long"), "start")


def contents(found: DataFrame, root: str) -> DataFrame:
    """(path, content) of the files that ``list_files`` found. They are read where their names were dealt to, and the driver holds none of the names."""

    def read(fs, base: str, path: str) -> Iterator[tuple[str, bytes]]:
        with fs.open_input_file(base + path) as file:
            yield path, file.read()

    return _mapped(found, root, read, "path string, content binary")


def documents(found: DataFrame, root: str, limit: int) -> DataFrame:
    """(path, text) of JSON documents that ``list_partitioned`` found, in the same tasks and order, unpacked by the ending of the name; text is null beyond ``limit`` bytes."""
    import json

    def read(fs, base: str, path: str) -> Iterator[tuple[str, bytes | None]]:
        with fs.open_input_stream(base + path) as file:
            content = file.read(limit + 1)
        yield path, None if len(content) > limit else content.decode(json.detect_encoding(content)).encode()

    return _mapped(found, root, read, "path string, content binary").select("path", F.col("content").cast("string").alias("text"))


def as_folder(spark: SparkSession, path: str) -> str | None:
    """A path that Spark reads, as ``store_of`` takes it, if it is a folder in a store that pyarrow reaches; else None."""
    context = spark.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(path)
    full = own.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(own).toString()
    root = "/" + full.removeprefix("file:").lstrip("/") if full.startswith("file:/") else full
    try:
        fs, base = store_of(root)
        return root if _is_dir(fs.get_file_info(base)) else None
    except (OSError, ValueError, NotImplementedError):
        return None
