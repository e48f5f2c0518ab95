"""Python data sources: assay and prediction folders read by file, split folders written under their own names.

Files are reached through Arrow's filesystems by their URI, so that they may lie wherever those reach. Reading plans
packs of whole files and resolves each header in the task that reads the file; writing goes to a staging folder whose
files are moved to their names when all tasks are done, and deleted when one fails.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import os
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from helixbench.schema import MUTATION_COLUMNS

#: Bytes of small files that one task reads; opening a file counts as so many.
PACK, OPEN = 32 << 20, 64 << 10
#: Calls to a filesystem that the driver has under way while it moves and deletes files.
AT_ONCE = 16


def filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The filesystem of a path or URI, and the path within it."""
    uri = path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
    return arrow_fs.FileSystem.from_uri(uri)


def _infos(fs: arrow_fs.FileSystem, folder: str, recursive: bool = False) -> list[arrow_fs.FileInfo]:
    return fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True, recursive=recursive))


def _is_assay(file: arrow_fs.FileInfo, base: str) -> bool:
    parts = posixpath.relpath(file.path, base).split("/")
    kept = len(parts) == 1 or (len(parts) == 2 and parts[0].startswith("dms_id="))
    return kept and file.type == arrow_fs.FileType.File and parts[-1].endswith(".csv") and not parts[-1].startswith(("_", "."))


def listed(folder: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's CSV files: one for each assay, or several in ``dms_id=<assay>``; none without it."""
    fs, base = filesystem(folder)
    return sorted((f.path, f.size or 0) for f in _infos(fs, base, True) if _is_assay(f, base))


def any_listed(folder: str) -> bool:
    """Whether ``listed`` has a file, found without listing them all."""
    fs, base = filesystem(folder)
    top = _infos(fs, base)
    inner = lambda f: f.type == arrow_fs.FileType.Directory and f.base_name.startswith("dms_id=")
    return any(_is_assay(f, base) for f in top) or any(_is_assay(g, base) for f in top if inner(f) for g in _infos(fs, f.path))


def assay_of(path: str) -> str:
    """The assay that a file is named by."""
    parent = posixpath.basename(posixpath.dirname(path))
    return unquote(parent.removeprefix("dms_id=")) if parent.startswith("dms_id=") else posixpath.basename(path).removesuffix(".csv")


def places(header: list[str], wanted: list[str]) -> dict[str, int]:
    """Where each wanted column is in a header: by its name, the first of several, else in any case of letters.
    ``mutant`` is found under any of the known names; a file without one of them is an error."""
    at: dict[str, int] = {}
    for i, name in enumerate(header):
        at.setdefault(name.strip(), i)
    lower: dict[str, int] = {}
    for name, i in at.items():
        lower.setdefault(name.lower(), i)
    found = {c: at.get(c, lower.get(c.lower())) for c in wanted}
    if "mutant" in wanted:
        known = [at[m] for m in MUTATION_COLUMNS if m in at]
        if not known:
            raise ValueError(f"no mutation column among {header}")
        found["mutant"] = known[0]
    return {c: i for c, i in found.items() if i is not None}


class Pack(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class AssayReader(DataSourceReader):
    """Rows (dms_id, path, the wanted columns as text), a batch of the file's rows at a time."""

    def __init__(self, folder: str, wanted: list[str], batch: int = 8192):
        self.folder, self.wanted, self.batch = folder, wanted, batch

    def files(self) -> list[tuple[str, int]]:
        return listed(self.folder)

    def places(self, header: list[str]) -> dict[str, int]:
        return places(header, self.wanted)

    def partitions(self) -> list[Pack]:
        packs, size = [], PACK
        for path, n in self.files():
            if size + n + OPEN > PACK:
                packs.append(Pack([]))
                size = 0
            packs[-1].paths.append(path)
            size += n + OPEN
        return packs

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.folder)
        held, n = [], 0
        for path in partition.paths:
            with fs.open_input_stream(path) as raw:
                lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                header = next(lines, None)
                if header is None:
                    continue
                at, whole = self.places(header), filter(None, lines)
                while rows := list(itertools.islice(whole, self.batch - n)):
                    held.append(self._made(path, rows, at))
                    n += len(rows)
                    if n == self.batch:
                        yield self._joined(held)
                        held, n = [], 0
        if held:
            yield self._joined(held)

    def _made(self, path: str, rows: list[list[str]], at: dict[str, int]) -> pa.Table:
        cells = lambda i: [(r[i] or None) if i < len(r) else None for r in rows]
        columns = [pa.array(cells(at[c]), pa.string()) if c in at else pa.nulls(len(rows), pa.string()) for c in self.wanted]
        return pa.table([pa.repeat(assay_of(path), len(rows)), pa.repeat(path, len(rows)), *columns], names=["dms_id", "path", *self.wanted])

    def _joined(self, parts: list[pa.Table]) -> pa.RecordBatch:
        return pa.concat_tables(parts).combine_chunks().to_batches()[0]


class SplitReader(AssayReader):
    """The same of the files of ``SplitWriter``, whose columns are taken in their order."""

    def files(self) -> list[tuple[str, int]]:
        fs, base = filesystem(self.folder)
        kept = lambda f: f.type == arrow_fs.FileType.File and f.path.endswith(".csv") and not f.base_name.startswith(("_", "."))
        return sorted((f.path, f.size or 0) for f in _infos(fs, base, True) if kept(f))

    def places(self, header: list[str]) -> dict[str, int]:
        return {c: i for i, c in enumerate(self.wanted)}


class Staged(NamedTuple):
    staged: str
    final: str


class Written(WriterCommitMessage):
    def __init__(self, files: list[Staged]):
        self.files = files


def _shared(work: Callable, items: Sequence) -> None:
    """``work`` on each item, in threads that take a part of the items each."""
    each = lambda first: [work(x) for x in items[first::AT_ONCE]]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(each, range(min(AT_ONCE, len(items)))))


class NamedWriter(DataSourceArrowWriter):
    """A CSV file, named by ``name``, for each of the keys. Rows come sorted by them, each in one task; files are
    written to a staging folder and moved when all tasks are done."""

    def __init__(self, folder: str, keys: list[str], columns: list[str], overwrite: bool = False):
        self.folder, self.keys, self.overwrite = folder, keys, overwrite
        self.columns = [c for c in columns if c not in keys]
        _, self.base = filesystem(folder)
        self.staging = f"{self.base}/_staging-{uuid.uuid4().hex}"

    def name(self, key: tuple) -> str:
        """The place within the folder."""
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = filesystem(self.folder)
        mine, done, open_, now, out = f"{self.staging}/{uuid.uuid4().hex}", [], None, None, None
        fs.create_dir(mine)
        try:
            for batch in batches:
                keys = zip(*(batch.column(k).to_pylist() for k in self.keys))
                rows = zip(*(batch.column(c).to_pylist() for c in self.columns)) if self.columns else itertools.repeat(())
                for key, same in itertools.groupby(zip(keys, rows), lambda row: row[0]):
                    if key != now:
                        if open_:
                            open_.close()
                        now = key
                        done.append(Staged(f"{mine}/{len(done)}.csv", f"{self.base}/{self.name(key)}"))
                        open_ = io.TextIOWrapper(fs.open_output_stream(done[-1].staged), "utf-8", newline="")
                        out = csv.writer(open_, lineterminator="\n")
                        out.writerow(self.columns)
                    out.writerows(row for _, row in same)
        finally:
            if open_:
                open_.close()
        return Written(done)

    def commit(self, messages) -> None:
        fs, _ = filesystem(self.folder)
        files = [f for m in messages if m for f in m.files]
        if self.overwrite:
            old = [f for f in _infos(fs, self.base) if f.path != self.staging]
            _shared(lambda f: fs.delete_dir(f.path) if f.type == arrow_fs.FileType.Directory else fs.delete_file(f.path), old)
        _shared(fs.create_dir, sorted({posixpath.dirname(f.final) for f in files}))
        _shared(lambda f: fs.move(f.staged, f.final), files)
        self._cleared(fs)

    def abort(self, messages) -> None:
        self._cleared(filesystem(self.folder)[0])

    def _cleared(self, fs: arrow_fs.FileSystem) -> None:
        if fs.get_file_info(self.staging).type == arrow_fs.FileType.Directory:
            fs.delete_dir(self.staging)


class SplitWriter(NamedWriter):
    """(dms_id, fold) as ``<type>/<fold>/<assay>_<fold>.csv``."""

    kind = ""

    def name(self, key: tuple) -> str:
        return f"{self.kind}/{key[1]}/{(key[0] or '').replace('.csv', '').replace('/', '_')}_{key[1]}.csv"


class AssayWriter(NamedWriter):
    """An assay as ``dms_id=<assay>/<own name>.csv``, the assay's name escaped as Spark does it for its partitions."""

    def name(self, key: tuple) -> str:
        escaped = re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda c: f"%{ord(c[0]):02X}", key[0] or "")
        return f"dms_id={escaped or '__HIVE_DEFAULT_PARTITION__'}/part-{uuid.uuid4().hex}.csv"


class AssayFiles(DataSource):
    """``spark.read.format("assay_files").option("columns", json).load(folder)``; ``df.write.format("assay_files")`` to
    the same folder, for rows that come sorted by their assay, each assay in one task."""

    @classmethod
    def name(cls) -> str:
        return "assay_files"

    def _wanted(self) -> list[str]:
        return json.loads(self.options["columns"])

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in ["dms_id", "path", *self._wanted()])

    def reader(self, schema) -> AssayReader:
        return AssayReader(self.options["path"], self._wanted())

    def writer(self, schema, overwrite: bool) -> AssayWriter:
        return AssayWriter(self.options["path"], ["dms_id"], schema.names, overwrite)


class SplitFiles(DataSource):
    """``df.write.format("split_files").option("kind", "random").mode("append").save(folder)``; files of the same name
    are replaced, others stay. ``spark.read.format("split_files").option("columns", json).load(folder)`` reads them."""

    @classmethod
    def name(cls) -> str:
        return "split_files"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in ["dms_id", "path", *json.loads(self.options["columns"])])

    def reader(self, schema) -> SplitReader:
        return SplitReader(self.options["path"], json.loads(self.options["columns"]))

    def writer(self, schema, overwrite: bool) -> SplitWriter:
        made = SplitWriter(self.options["path"], ["dms_id", "fold"], schema.names)
        made.kind = self.options["kind"]
        return made
