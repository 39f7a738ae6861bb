"""Spark data source for event files: npz, npy, mat and raw.

    spark.read.format("event_file").load("recordings/*.npz")
    df.write.format("event_file").mode("append").save("folder")      # npz parts

Uncompressed arrays are split into row ranges, other files are read as a stream of
bounded batches, one task per file. Files must be on a path all executors see."""
from __future__ import annotations

import glob
import os
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from ptrack.schema import EVENTS
from ptrack.sources import matfile, rawfile
from ptrack.sources.columns import find_columns

ROWS_PER_SPLIT = 8_000_000
ROWS_PER_BATCH = 200_000
FILE_BITS = 40              # event_idx = file number << 40 | position in the file
SUFFIXES = (".npz", ".npy", ".mat", ".raw")


def list_files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(f for f in glob.glob(os.path.join(path, "*")) if f.lower().endswith(SUFFIXES))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


def _npy_header(f):
    v = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if v == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if dtype.hasobject:
        raise ValueError("object arrays are not read")
    return shape, fortran, dtype


def npz_members(path: str) -> dict[str, tuple]:
    """{key: (shape, dtype, stored)} without reading the data."""
    out = {}
    with zipfile.ZipFile(path) as z:
        for i in z.infolist():
            with z.open(i) as f:
                shape, _, dtype = _npy_header(f)
            out[i.filename.removesuffix(".npy")] = (shape, dtype, i.compress_type == zipfile.ZIP_STORED)
    return out


def describe(path: str) -> dict:
    """What is in a file: {"named": {x, y, t, p}} or {"table": key or None, "width": n}."""
    ext = os.path.splitext(path)[1].lower()
    if ext == ".raw":
        return {"named": {c: c for c in "xytp"}}
    if ext == ".npy":
        with open(path, "rb") as f:
            shape, _, dtype = _npy_header(f)
        members = {None: (shape, dtype)}
    elif ext == ".npz":
        members = {k: v[:2] for k, v in npz_members(path).items()}
    elif ext == ".mat":
        members = {k: (v.shape, v.dtype) for k, v in matfile.load(path).items()}
    else:
        raise ValueError(f"unsupported event file: {path}")
    if None not in members:
        named = find_columns(list(members))
        if named:
            return {"named": named}
    for key, (shape, dtype) in members.items():
        if dtype.names and find_columns(dtype.names):
            return {"struct": key, "named": find_columns(dtype.names)}
        shape = [s for s in shape if s != 1] or [1]
        if len(shape) >= 2 and shape[-1] >= 3:
            return {"table": key, "width": shape[-1]}
    raise ValueError(f"no events found in {path}")


@dataclass
class FileRange(InputPartition):
    path: str
    number: int
    start: int
    stop: int


class _Column:
    """One array of a file, read front to back in pieces."""

    def __init__(self, path: str, member: str | None, start: int):
        self.zip = zipfile.ZipFile(path) if member is not None else None
        self.f = self.zip.open(member + ".npy") if self.zip else open(path, "rb")
        shape, fortran, self.dtype = _npy_header(self.f)
        shape = [s for s in shape if s != 1] or [1]
        self.width = int(np.prod(shape[-1:])) if len(shape) > 1 else 1
        if fortran and self.width > 1:
            raise ValueError(f"{path}: column-major tables are not read in pieces")
        self.rows = int(np.prod(shape)) // self.width
        self.f.seek(start * self.width * self.dtype.itemsize, 1)

    def take(self, n: int) -> np.ndarray:
        buf = self.f.read(n * self.width * self.dtype.itemsize)
        a = np.frombuffer(buf, self.dtype)
        return a.reshape(-1, self.width) if self.width > 1 else a


class EventFileReader(DataSourceReader):
    def __init__(self, path: str, layout: dict, compat_float32: bool, split: int):
        self.files = list_files(path)
        self.layout = layout
        self.f32 = compat_float32
        self.split = split

    def _rows(self, path: str) -> tuple[int, bool]:
        """(rows, may be split)"""
        ext = os.path.splitext(path)[1].lower()
        lay = describe(path)
        if ext == ".npy":
            return _Column(path, None, 0).rows, True
        if ext != ".npz":
            return -1, False
        m = npz_members(path)
        if "struct" in lay or "table" in lay:
            key = lay.get("struct", lay.get("table"))
            return _Column(path, key, 0).rows, m[key][2]
        keys = [lay["named"][c] for c in "xyt"]
        return min(int(np.prod(m[k][0])) for k in keys), all(m[k][2] for k in keys)

    def partitions(self):
        out = []
        for i, f in enumerate(self.files):
            n, ok = self._rows(f)
            step = self.split if ok else max(n, 1)
            out += [FileRange(f, i, a, min(a + step, n)) for a in range(0, n, step)] if n >= 0 else [FileRange(f, i, 0, -1)]
        return out

    def read(self, part: FileRange):
        base = part.number << FILE_BITS
        at = part.start
        for cols in self._batches(part):
            n = len(cols[0])
            idx = np.arange(base + at, base + at + n)
            at += n
            if "width" in self.layout:
                flat = pa.array(np.ascontiguousarray(cols[0], np.float64).ravel())
                w = cols[0].shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(idx), lists], ["event_idx", "v"])
                continue
            x, y, t, p = cols
            t = t.astype(np.float32).astype(np.float64) if self.f32 else t.astype(np.float64)
            pol = pa.nulls(n, pa.int32()) if p is None else pa.array(
                np.concatenate([p.astype(np.int32), np.zeros(n - len(p), np.int32)]), mask=np.arange(n) >= len(p))
            yield pa.RecordBatch.from_arrays(
                [pa.array(idx), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(t), pol],
                ["event_idx", "x", "y", "t", "p"])

    def _batches(self, part: FileRange):
        ext = os.path.splitext(part.path)[1].lower()
        lay = describe(part.path)
        if ext == ".raw":
            yield from rawfile.batches(part.path)
            return
        if ext == ".mat":
            m = matfile.load(part.path)
            if "width" in lay:
                a = np.squeeze(m[lay["table"]])
                yield (a.reshape(-1, a.shape[-1]),)
                return
            x, y, t = (m[lay["named"][c]].ravel() for c in "xyt")
            n = min(len(x), len(y), len(t))
            p = m[lay["named"]["p"]].ravel()[:n] if lay["named"]["p"] else None
            yield x[:n], y[:n], t[:n], p
            return
        if "width" in lay or "struct" in lay:
            key = lay.get("struct", lay.get("table"))
            col = _Column(part.path, key, part.start)
            for a in range(part.start, part.stop, ROWS_PER_BATCH):
                rows = col.take(min(ROWS_PER_BATCH, part.stop - a))
                if "width" in lay:
                    yield (rows,)
                else:
                    names = lay["named"]
                    yield rows[names["x"]], rows[names["y"]], rows[names["t"]], rows[names["p"]] if names["p"] else None
            return
        cols = {c: _Column(part.path, k, part.start) if k else None for c, k in lay["named"].items()}
        for a in range(part.start, part.stop, ROWS_PER_BATCH):
            n = min(ROWS_PER_BATCH, part.stop - a)
            yield tuple(cols[c].take(n) if cols[c] else None for c in "xytp")


@dataclass
class Written(WriterCommitMessage):
    files: list                # (name while written, name when committed)
    rows: int


class EventFileWriter(DataSourceArrowWriter):
    """Every task writes npz parts of bounded size with the keys X, Y, T[, P] (or
    the column names of another table). Parts get their names when the whole job is
    committed, so a task that runs again leaves no second copy."""

    def __init__(self, path: str, compress: bool, rows_per_file: int, upper: bool):
        self.path, self.compress, self.limit, self.upper = path, compress, rows_per_file, upper
        os.makedirs(path, exist_ok=True)

    def write(self, iterator):
        files, rows = [], 0
        held, n = [], 0

        def flush():
            nonlocal rows, held, n
            if not held:
                return
            t = pa.Table.from_batches(held)
            data = {}
            for c in t.column_names:
                if c == "event_idx" or t[c].null_count == len(t):
                    continue
                data[c.upper() if self.upper else c] = t[c].to_numpy()
            name = f"part-{uuid.uuid4().hex}.npz"
            hidden = os.path.join(self.path, f".{name}.tmp")
            files.append((hidden, os.path.join(self.path, name)))
            with open(hidden, "wb") as f:
                (np.savez_compressed if self.compress else np.savez)(f, **data)
            rows, held, n = rows + len(t), [], 0

        try:
            for b in iterator:
                held.append(b)
                n += len(b)
                if n >= self.limit:
                    flush()
            flush()
        except BaseException:
            self._drop(files)
            raise
        return Written(files, rows)

    @staticmethod
    def _drop(files) -> None:
        for hidden, _ in files:
            if os.path.exists(hidden):
                os.remove(hidden)

    def commit(self, messages) -> None:
        for m in messages:
            for hidden, name in m.files if m else ():
                os.replace(hidden, name)

    def abort(self, messages) -> None:
        for m in messages:
            self._drop(m.files if m else ())


class EventFile(DataSource):
    @classmethod
    def name(cls):
        return "event_file"

    def _layout(self):
        return describe(list_files(self.options["path"])[0])

    def schema(self):
        return "event_idx bigint, v array<double>" if "width" in self._layout() else EVENTS

    def reader(self, schema):
        return EventFileReader(self.options["path"], self._layout(),
                               self.options.get("compat_float32", "false") == "true",
                               int(self.options.get("rows_per_split", ROWS_PER_SPLIT)))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("only append into a new folder is supported")
        cols = {f.name for f in schema.fields}
        return EventFileWriter(self.options["path"], self.options.get("compress", "false") == "true",
                               int(self.options.get("rows_per_file", 4_000_000)),
                               {"x", "y", "t"} <= cols and "trackid" not in cols)
