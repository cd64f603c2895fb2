"""Sidecar files as a data source: `spark.read.format("sidecars").load(root)` after register(spark).

Every `.scar` file below the root is a JSON object {key: value} and gives a row for each key. The driver lists folders
only, down to `depth` levels (option, 1); tasks list and read the files of a folder, or of a whole tree at the last
level. Equality and prefix conditions on scar_path prune folders and files, those on tool and entry_key are applied
while a file is read; all of them are fully handled here. A file that is no JSON object gives a row with an error and
no key, unless a condition on tool or key asks for others. An empty object gives no row, a root that is missing no
rows. Values are text: strings as they are, others as JSON. As a stream, `readStream` gives the files changed since the
last batch, by their time; files younger than `settle` seconds (option, 2) wait, so that none with an equal time is
missed. Roots are those of pyarrow: file, hdfs and object stores; scar_path is a path without the root's scheme.
"""

import json
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

SCHEMA = "scar_path string, tool string, entry_key string, entry_value string, error string"
FACE = "face."


class Folder(InputPartition):
    """A folder to list: its files alone or with all below, and the range of times (exclusive, inclusive) in microseconds."""

    def __init__(self, path: str, deep: bool, after: int | None = None, until: int | None = None):
        super().__init__((path, deep, after, until))
        self.path, self.deep, self.after, self.until = path, deep, after, until


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def stamp(info: fs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1000


def tool_of(key: str) -> str | None:
    """The tool of a key face.<tool>.<field>."""
    parts = key.split(".", 2)
    return parts[1] if key.startswith(FACE) and len(parts) == 3 else None


class Conditions:
    """Pushed conditions: values that a column may have, and prefixes that it must have."""

    COLUMNS = ("scar_path", "tool", "entry_key")

    def __init__(self):
        self.values: dict[str, set[str]] = {}
        self.prefixes: dict[str, list[str]] = {}

    def take(self, condition: Filter) -> bool:
        """Whether the condition is one that is handled here; it then is."""
        if not isinstance(condition, (EqualTo, In, IsNotNull, StringStartsWith)) or len(condition.attribute) != 1 or condition.attribute[0] not in self.COLUMNS:
            return False
        column, given = condition.attribute[0], getattr(condition, "value", "")
        if isinstance(condition, (IsNotNull, StringStartsWith)):  # every value that is there starts with nothing
            self.prefixes.setdefault(column, []).append(given)
        else:
            allowed = {v for v in (given if isinstance(condition, In) else [given]) if v is not None}
            self.values[column] = self.values[column] & allowed if column in self.values else allowed
        return True

    def fits(self, column: str, value: str | None) -> bool:
        if column not in self.values and column not in self.prefixes:
            return True
        return value is not None and (column not in self.values or value in self.values[column]) and all(value.startswith(p) for p in self.prefixes.get(column, ()))

    def may_hold(self, folder: str) -> bool:
        """Whether files below a folder can fit."""
        below = folder.rstrip("/") + "/"
        given = [*self.prefixes.get("scar_path", ())]
        near = all(p.startswith(below) or below.startswith(p) for p in given)
        return near and ("scar_path" not in self.values or any(v.startswith(below) for v in self.values["scar_path"]))


def folders(files: fs.FileSystem, at: str, depth: int, conditions: Conditions) -> Iterator[Folder]:
    """The folders to read, listed down to a depth."""
    if files.get_file_info(at).type == fs.FileType.File:
        yield Folder(at, False)
        return
    if not conditions.may_hold(at):
        return
    if depth <= 0:
        yield Folder(at, True)
        return
    yield Folder(at, False)
    for info in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if info.type == fs.FileType.Directory:
            yield from folders(files, info.path, depth - 1, conditions)


def found(files: fs.FileSystem, part: Folder) -> Iterator[fs.FileInfo]:
    """The sidecar files of a folder."""
    of_file = files.get_file_info(part.path)
    listed = [of_file] if of_file.type == fs.FileType.File else files.get_file_info(fs.FileSelector(part.path, recursive=part.deep, allow_not_found=True))
    for info in listed:
        timely = part.until is None or (part.after or -1) < stamp(info) <= part.until
        if info.type == fs.FileType.File and info.extension.lower() == "scar" and timely:
            yield info


def rows_of(files: fs.FileSystem, part: Folder, conditions: Conditions) -> Iterator[tuple]:
    keys_asked = any(c in conditions.values or c in conditions.prefixes for c in ("tool", "entry_key"))
    for info in found(files, part):
        if not conditions.fits("scar_path", info.path):
            continue
        with files.open_input_stream(info.path) as stream:
            content = stream.read()
        try:
            document = json.loads(content)
            if not isinstance(document, dict):
                raise ValueError("not an object")
        except ValueError as error:
            if not keys_asked:
                yield info.path, None, None, None, f"{type(error).__name__}: {error}"
            continue
        for key, value in document.items():
            if conditions.fits("entry_key", key) and conditions.fits("tool", tool_of(key)):
                yield info.path, tool_of(key), key, value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":")), None


class SidecarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.depth, self.conditions = options["path"], int(options.get("depth", 1)), Conditions()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self.conditions.take(f))

    def partitions(self) -> list[Folder]:
        files, at = opened(self.root)
        return list(folders(files, at.rstrip("/"), self.depth, self.conditions)) or [Folder(at, False, 0, -1)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from rows_of(opened(self.root)[0], partition, self.conditions)


class SidecarStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.depth, self.settle = options["path"], int(options.get("depth", 1)), float(options.get("settle", 2))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        """The latest time of a file that has settled; times are compared one by one, nothing is kept of them."""
        files, at = opened(self.root)
        ripe = int((time.time() - self.settle) * 1e6)
        return {"until": max((stamp(i) for i in found(files, Folder(at, True)) if stamp(i) <= ripe), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        files, at = opened(self.root)
        return [Folder(p.path, p.deep, start["until"], end["until"]) for p in folders(files, at.rstrip("/"), self.depth, Conditions())]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from rows_of(opened(self.root)[0], partition, Conditions())

    def commit(self, end: dict) -> None:
        pass


class Sidecars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SidecarReader:
        return SidecarReader(dict(self.options))

    def streamReader(self, schema) -> SidecarStream:
        return SidecarStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Sidecars)


def write_files(docs, root: str, folder: str) -> None:
    """Documents (scar_path, entries map of texts) as one `.scar` file each, below root and the folder column's value.

    Every task writes its own documents; a file is replaced as a whole, so that a task that runs again writes the same.
    The name is that of scar_path; paths of equal names belong into different folders.
    """

    def one(rows) -> None:
        files, at = opened(root)
        for row in rows:
            place = f"{at.rstrip('/')}/{row[folder]}"
            files.create_dir(place, recursive=True)
            with files.open_output_stream(f"{place}/{row.scar_path.rsplit('/', 1)[-1]}") as out:
                out.write(json.dumps(row.entries, ensure_ascii=False).encode())

    docs.select("scar_path", "entries", folder).foreachPartition(one)
