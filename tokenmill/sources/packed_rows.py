"""Spark data source ``packed_rows``: headerless rows of numbers of fixed width.

Reading: a file is cut into byte ranges of whole rows, each range becomes Arrow batches that
look at the file's bytes through one numpy array, without a loop over rows. A path may be a
file, a folder, or a pattern in its last part; names sort by their number where they are one.

Writing (rows sorted by ``file_no``): a task writes each of its files under a name of its own
beside the target; the driver renames them when all tasks have succeeded and removes the
names of those that were given up.

Files are reached by pyarrow's file systems, so the path may be a local one or any URI that
pyarrow knows.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_ROWS = pa.schema([("file_no", pa.int32()), ("row", pa.list_(pa.int64()))])


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _number(name: str) -> int | None:
    stem = os.path.basename(name).split(".")[0]
    return int(stem) if stem.isdigit() else None


def files_of(path: str) -> list[fs.FileInfo]:
    """Files of a path, by their number, then by name."""
    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [info]
    folder, pattern = (inner, "*") if info.type == fs.FileType.Directory else os.path.split(inner)
    found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"]
    return sorted(found, key=lambda f: (_number(f.base_name) is None, _number(f.base_name) or 0, f.base_name))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, row_len: int, dtype: str):
        self.path, self.row_len, self.dtype = path, row_len, dtype

    def partitions(self):
        width = np.dtype(self.dtype).itemsize * self.row_len
        step = max(1, RANGE_BYTES // width) * width
        out = []
        for f in files_of(self.path):
            if f.size % width:
                raise ValueError(f"{f.path}: {f.size} bytes are not a number of rows of {width} bytes")
            out += [Range(f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.start == part.end:
            return
        width = np.dtype(self.dtype).itemsize * self.row_len
        step = max(1, BATCH_BYTES // width) * width
        system, _ = _system(self.path)
        with system.open_input_file(part.path) as f:
            for a in range(part.start, part.end, step):
                f.seek(a)
                flat = np.frombuffer(f.read(min(step, part.end - a)), self.dtype).astype(np.int64)
                n = len(flat) // self.row_len
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.row_len), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([_number(part.path)] * n, pa.int32()), rows], schema=_ROWS)


@dataclass
class Written(WriterCommitMessage):
    names: list


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, row_len: int, dtype: str, rows_per_file: int):
        self.path, self.row_len, self.dtype, self.rows_per_file = path, row_len, dtype, rows_per_file

    def write(self, iterator):
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        names, out, now, left = [], None, None, 0

        def close():
            if out is not None:
                out.write(bytes(left * self.row_len * np.dtype(self.dtype).itemsize))
                out.close()

        limit = np.iinfo(self.dtype)
        for b in iterator:
            if not b.num_rows:
                continue
            file_no = b.column(0).to_numpy()
            rows = b.column(1)
            if (np.diff(rows.offsets.to_numpy()) != self.row_len).any():
                raise ValueError(f"rows must have {self.row_len} numbers")
            flat = rows.flatten().to_numpy()
            if len(flat) and (flat.min() < limit.min or flat.max() > limit.max):
                raise ValueError(f"numbers must fit {self.dtype}")
            flat = flat.astype(self.dtype).reshape(-1, self.row_len)
            first = np.flatnonzero(np.concatenate(([True], file_no[1:] != file_no[:-1])))
            for i, j in zip(first, np.append(first[1:], len(file_no))):
                if file_no[i] != now:
                    close()
                    now, left = int(file_no[i]), self.rows_per_file
                    name = f"{folder}/_{now}.{uuid.uuid4().hex}"
                    names.append((name, f"{folder}/{now}.npy"))
                    out = system.open_output_stream(name)
                left -= int(j - i)
                out.write(flat[i:j].tobytes())
        close()
        return Written(names)

    def commit(self, messages):
        system, _ = _system(self.path)
        for m in messages:
            for name, target in m.names if m else ():
                system.move(name, target)

    def abort(self, messages):
        system, _ = _system(self.path)
        for m in messages:
            for name, _target in m.names if m else ():
                system.delete_file(name)


class PackedRows(DataSource):
    @classmethod
    def name(cls):
        return "packed_rows"

    def schema(self):
        return "file_no int, row array<long>"

    def _shape(self):
        return int(self.options["row_len"]), self.options.get("dtype", "<u2")

    def reader(self, schema):
        return Reader(self.options["path"], *self._shape())

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], *self._shape(), int(self.options["rows_per_file"]))
