"""What a store consists of: one small list of folders, replaced as a whole by its next version.

A writer first writes folders that nobody else writes, and then commits: it takes the last
version of the list, applies its change and puts the next version in place, which fails if
another writer was faster; then it starts again from that one's list. So readers see all of
a commit or nothing, writers need no lock, and a write that stopped half-way leaves folders
that nothing refers to. The file system has to refuse a rename onto a file that exists, as
HDFS and most object stores with conditional writes do.
"""

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_FOLDER = "_manifest"
# Versions of the list that stay for those who look at an earlier state.
KEPT = 20
RETRIES = 50


@dataclass(frozen=True)
class Part:
    """One folder of a table; ``day`` is empty for tables without days.

    ``of`` names what the folder was made from: the batches of a ledger, or the state of the
    folders that facts and statistics were derived from. Rows of the batches in ``without``
    have been replaced and do not count.
    """

    table: str
    version: str
    day: str = ""
    of: tuple[str, ...] = ()
    without: tuple[str, ...] = ()

    @property
    def folder(self) -> str:
        day = f"/observed_date={self.day}" if self.day else ""
        return f"{self.table}/version={self.version}{day}"

    @property
    def state(self) -> str:
        """Changes whenever the rows that count do."""
        return f"{self.version}-{','.join(self.without)}" if self.without else self.version


Parts = tuple[Part, ...]


def new_version() -> str:
    return uuid.uuid4().hex


def file_system(spark: SparkSession, folder: str):
    """Hadoop file system and path of a folder, so that any shared storage works."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, root: str) -> dict[int, str]:
    fs, path = file_system(spark, f"{root}/{_FOLDER}")
    if not fs.exists(path):
        return {}
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return {int(name[:-5]): name for name in names if name.endswith(".json")}


def _last(spark: SparkSession, root: str) -> tuple[int, Parts]:
    versions = _versions(spark, root)
    if not versions:
        return 0, ()
    number = max(versions)
    fs, path = file_system(spark, f"{root}/{_FOLDER}/{versions[number]}")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    rows = json.loads(text)["parts"]
    return number, tuple(Part(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in rows)


def parts_of(spark: SparkSession, root: str) -> Parts:
    """The folders that the store consists of now."""
    return _last(spark, root.rstrip("/"))[1]


def exists(spark: SparkSession, root: str) -> bool:
    return bool(_versions(spark, root.rstrip("/")))


def commit(spark: SparkSession, root: str, change: Callable[[Parts], Parts | None]) -> Parts:
    """Replace the list by what ``change`` makes of it; it runs again if another writer was faster.

    ``change`` may return None if there is nothing to do any more.
    """
    root = root.rstrip("/")
    for _ in range(RETRIES):
        number, before = _last(spark, root)
        after = change(before)
        if after is None or after == before:
            return before
        if _put(spark, root, number + 1, after):
            return after
    raise RuntimeError(f"{root}: other writers were faster {RETRIES} times")


def _put(spark: SparkSession, root: str, number: int, parts: Parts) -> bool:
    """Put a version of the list in place, unless there is one."""
    target, draft = f"{root}/{_FOLDER}/{number:012d}.json", f"{root}/{_FOLDER}/.{new_version()}.draft"
    fs, path = file_system(spark, draft)
    out = fs.create(path, False)
    out.write(bytearray(json.dumps({"parts": [asdict(p) for p in parts]}).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context = hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(path, hadoop.Path(target), options)
    except Py4JJavaError as error:
        fs.delete(path, False)
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise
    return True


def unreferenced(spark: SparkSession, root: str, tables: list[str], older_than_hours: float) -> Iterator[str]:
    """Folders that the list does not name and that nobody has written to for a while."""
    root = root.rstrip("/")
    named = {f"{root}/{p.folder}" for p in parts_of(spark, root)}
    latest = spark._jvm.java.lang.System.currentTimeMillis() - int(older_than_hours * 3_600_000)

    def below(folder: str) -> Iterator[tuple[str, int]]:
        fs, path = file_system(spark, folder)
        if fs.exists(path):
            for status in fs.listStatus(path):
                if status.isDirectory():
                    yield f"{folder}/{status.getPath().getName()}", status.getModificationTime()

    for table in tables:
        for version, changed in below(f"{root}/{table}"):
            days = [day for day in below(version) if "/observed_date=" in day[0]]
            for folder, at in days or [(version, changed)]:
                if "/version=" in folder and folder not in named and at <= latest:
                    yield folder


def vacuum(spark: SparkSession, root: str, tables: list[str], older_than_hours: float = 24.0) -> list[str]:
    """Delete folders that nothing refers to, and old versions of the list.

    The age leaves jobs that are reading an earlier state, or writing the next one, alone.
    """
    root = root.rstrip("/")
    gone = sorted(unreferenced(spark, root, tables, older_than_hours))
    for folder in gone:
        fs, path = file_system(spark, folder)
        fs.delete(path, True)
    versions = _versions(spark, root)
    for number in sorted(versions)[:-KEPT]:
        fs, path = file_system(spark, f"{root}/{_FOLDER}/{versions[number]}")
        fs.delete(path, False)
    return gone
