"""Array containers (``.npz`` archives and ``.pt`` files) as a Spark data source.

Both are zip archives of raw arrays. A task reads the directory of its file, the header of the arrays,
and then its own range of rows; the driver lists paths and looks into one file for the types. Members
that are compressed cannot be entered in the middle: one task streams such a file.

Paths are those of :mod:`pyarrow.fs` (local, ``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import io
import pickle
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from anomaloom.sources.columns import FEATURE_KEYS, LABEL_KEYS, resolve_key

# --- fixed values ---------------------------------------------------------------------------
_ZIP_LOCAL_HEADER = 30
_STORAGES = {
    "DoubleStorage": "<f8", "FloatStorage": "<f4", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4",
    "ShortStorage": "<i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?",
}
# --------------------------------------------------------------------------------------------
#: Bytes of a file that one task reads, and rows of an Arrow batch.
PARTITION_BYTES = 64 << 20
BATCH_ROWS = 4096
#: Rows that the writer puts into one file.
FILE_ROWS = 100_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


def container_files(path: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of a container or of all containers of a folder, by name."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        if not place.endswith((".npz", ".pt")):
            raise ValueError(f"{path} is neither .npz nor .pt")
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(place, recursive=False))
    prefix = path.rstrip("/")
    files = [(f"{prefix}/{f.base_name}", f.size) for f in found if f.base_name.endswith((".npz", ".pt"))]
    if not files:
        raise FileNotFoundError(f"no containers in {path}")
    return sorted(files)


@dataclass(frozen=True)
class Array:
    """Where an array lies in its archive: rows are the first axis, in C order."""

    member: str
    offset: int  # bytes of the member before the first element
    dtype: np.dtype
    shape: tuple[int, ...]
    start: int | None  # place of the member's bytes in the file; None if they are compressed

    @property
    def row_shape(self) -> tuple[int, ...]:
        return self.shape[1:]

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * prod(self.row_shape)


class Container:
    """An archive, opened for ranges of rows."""

    def __init__(self, path: str) -> None:
        self.path = path
        store, place = opened(path)
        self.file = store.open_input_file(place)
        try:
            self.archive = zipfile.ZipFile(self.file)
            self.arrays = self._numpy_arrays() if path.endswith(".npz") else self._tensors()
        except BaseException:
            self.file.close()
            raise

    def __enter__(self) -> Container:
        return self

    def __exit__(self, *_) -> None:
        self.archive.close()
        self.file.close()

    def _start(self, info: zipfile.ZipInfo) -> int | None:
        if info.compress_type != zipfile.ZIP_STORED:
            return None
        self.file.seek(info.header_offset)
        header = self.file.read(_ZIP_LOCAL_HEADER)
        lengths = int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little")
        return info.header_offset + _ZIP_LOCAL_HEADER + lengths

    def _numpy_arrays(self) -> dict[str, Array]:
        found = {}
        for info in self.archive.infolist():
            if not info.filename.endswith(".npy"):
                continue
            with self.archive.open(info) as member:
                version = np.lib.format.read_magic(member)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, by_column, dtype = read(member)
                offset = member.tell()
            if dtype.hasobject:
                raise TypeError(f"{self.path}: {info.filename} holds Python objects")
            if by_column and len(shape) > 1:
                raise ValueError(f"{self.path}: {info.filename} is laid out by columns; save it in C order")
            found[info.filename.removesuffix(".npy")] = Array(info.filename, offset, dtype, shape, self._start(info))
        return found

    def _tensors(self) -> dict[str, Array]:
        """Tensors of a saved dict, read without running what the pickle names."""
        entry = next((n for n in self.archive.namelist() if n.endswith("data.pkl")), None)
        if entry is None:
            raise TypeError(f"{self.path} is no archive of tensors")
        folder = entry.removesuffix("data.pkl")
        saved = _TensorUnpickler(io.BytesIO(self.archive.read(entry))).load()
        if not isinstance(saved, dict):
            raise TypeError(f"{self.path} holds a {type(saved).__name__}, not a dict of tensors")
        found = {}
        for name, tensor in saved.items():
            if isinstance(tensor, _Tensor):
                info = self.archive.getinfo(f"{folder}data/{tensor.key}")
                offset = tensor.offset * tensor.dtype.itemsize
                found[name] = Array(info.filename, offset, tensor.dtype, tensor.shape, self._start(info))
        return found

    def resolve(self, x_key: str, y_key: str) -> tuple[Array, Array]:
        """Features and labels: exact names for ``.npz``, names or their usual aliases for ``.pt``."""
        aliased = self.path.endswith(".pt")
        names = list(self.arrays)
        x = self.arrays[resolve_key(names, x_key, FEATURE_KEYS if aliased else (), self.path)]
        y = self.arrays[resolve_key(names, y_key, LABEL_KEYS if aliased else (), self.path)]
        if len(x.shape) == 0 or prod(y.shape) != x.shape[0]:
            raise ValueError(f"{self.path}: {x.shape} features, {y.shape} labels")
        return x, y

    def rows(self, array: Array, low: int, high: int, step: int) -> Iterator[np.ndarray]:
        """Rows ``low`` to ``high`` in pieces of at most ``step``, read as they are asked for."""
        width = array.row_bytes
        if array.start is not None:
            for at in range(low, high, step):
                end = min(high, at + step)
                self.file.seek(array.start + array.offset + at * width)
                yield _shaped(self.file.read((end - at) * width), array)
            return
        with self.archive.open(array.member) as member:
            left = array.offset + low * width
            while left:
                left -= len(member.read(min(left, 1 << 20)))
            for at in range(low, high, step):
                yield _shaped(member.read((min(high, at + step) - at) * width), array)


def _shaped(raw: bytes, array: Array) -> np.ndarray:
    return np.frombuffer(raw, dtype=array.dtype).reshape(-1, *array.row_shape)


@dataclass(frozen=True)
class _Tensor:
    key: str
    dtype: np.dtype
    offset: int
    shape: tuple[int, ...]


def _tensor(storage: tuple[str, np.dtype], offset: int, shape: Sequence[int], stride: Sequence[int], *_) -> _Tensor:
    step, wanted = 1, []
    for size in reversed(shape):
        wanted.append(step)
        step *= size
    if any(n > 1 and s != w for n, s, w in zip(shape, stride, reversed(wanted))):
        raise ValueError("a tensor is not laid out by rows; save it contiguous")
    return _Tensor(*storage, offset, tuple(shape))


class _TensorUnpickler(pickle.Unpickler):
    """Takes dicts, plain values and tensors; any other name in the file is an error."""

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return dict
        if (module, name) in (("torch._utils", "_rebuild_tensor_v2"), ("torch._utils", "_rebuild_tensor")):
            return _tensor
        if module == "torch" and name in _STORAGES:
            return np.dtype(_STORAGES[name])
        raise pickle.UnpicklingError(f"{module}.{name} is not read from containers")

    def persistent_load(self, saved: tuple):
        kind, dtype, key, *_ = saved
        if kind != "storage":
            raise pickle.UnpicklingError(f"{kind} is not read from containers")
        return str(key), dtype


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of any number of axes as nested lists, one per row."""
    found = pa.array(np.ascontiguousarray(values).reshape(-1)).cast(kind)
    count = values.size
    for size in reversed(values.shape[1:]):
        count = count // size if size else prod(values.shape[:1])
        found = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * size), found)
    return found


@dataclass
class _Share(InputPartition):
    """The ``part``-th of ``parts`` equal row ranges of a file."""

    path: str
    part: int
    parts: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]) -> None:
        self.path = path
        self.x_key, self.y_key = options.get("xkey", "X"), options.get("ykey", "y")
        self.kind = options.get("featuretype", "float")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.step = int(options.get("batchrows", BATCH_ROWS))

    def partitions(self) -> Sequence[InputPartition]:
        shares = []
        for path, size in container_files(self.path):
            parts = max(1, -(-size // self.most))
            shares += [_Share(path, part, parts) for part in range(parts)]
        return shares

    def read(self, share: _Share) -> Iterator[pa.RecordBatch]:
        kind = pa.float32() if self.kind == "float" else pa.float64() if self.kind == "double" else pa.int64()
        with Container(share.path) as container:
            x, y = container.resolve(self.x_key, self.y_key)
            rows = x.shape[0]
            if x.start is None or y.start is None:
                low, high = (0, rows) if share.part == 0 else (rows, rows)
            else:
                low, high = (rows * p // share.parts for p in (share.part, share.part + 1))
            flat = Array(y.member, y.offset, y.dtype, (rows,), y.start)
            for features, labels in zip(
                container.rows(x, low, high, self.step), container.rows(flat, low, high, self.step)
            ):
                # A label with a fraction is cut, as a cast to whole numbers cuts it.
                columns = [_listed(features, kind), pa.array(labels.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["X", "y"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Each task writes its files into a folder of the job; the commit moves them to their place."""

    def __init__(self, path: str, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        self.compressed = options.get("compressed", "false") == "true"
        self.file_rows = int(options.get("filerows", FILE_ROWS))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = opened(self.staged)
        store.create_dir(folder, recursive=True)
        attempt, files = uuid.uuid4().hex, []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            name = f"part-{len(files):05}-{attempt}.npz"
            self._save(store, f"{folder}/{name}", pa.Table.from_batches(held))
            files.append(name)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= self.file_rows:
                flush()
        if any(b.num_rows for b in held):
            flush()
        return _Written(files)

    def _save(self, store: fs.FileSystem, path: str, rows: pa.Table) -> None:
        columns = {name: _dense(rows[name].combine_chunks(), len(rows), name) for name in rows.column_names}
        with store.open_output_stream(path) as out:
            (np.savez_compressed if self.compressed else np.savez)(_Unseekable(out), **columns)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, target = opened(self.path)
        staged = opened(self.staged)[1]
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(target, allow_not_found=True)):
                if old.is_file and old.base_name.endswith(".npz"):
                    store.delete_file(old.path)
        for message in messages:
            for name in message.files if message else ():
                store.move(f"{staged}/{name}", f"{target}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staged = opened(self.staged)
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


class _Unseekable:
    """A stream that only grows, as object stores have them."""

    def __init__(self, out) -> None:
        self.out = out

    def write(self, data) -> int:
        raw = bytes(data)
        self.out.write(raw)
        return len(raw)

    def flush(self) -> None:
        self.out.flush()

    def read(self, *_):
        raise io.UnsupportedOperation("read")


def _dense(column: pa.Array, rows: int, name: str) -> np.ndarray:
    """A column of values or of nested lists as one array; nulls and ragged lists are errors."""
    shape = [rows]
    while pa.types.is_list(column.type):
        if column.null_count:
            raise ValueError(f"column {name} has nulls")
        sizes = np.unique(np.diff(column.offsets.to_numpy()))
        if len(sizes) > 1:
            raise ValueError(f"column {name} has lists of different lengths")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        column = column.flatten()
    if column.null_count:
        raise ValueError(f"column {name} has nulls")
    return column.to_numpy(zero_copy_only=False).reshape(shape)


class ArrayContainers(DataSource):
    """``X`` (nested arrays, one per further axis) and ``y`` (long) of ``.npz`` and ``.pt`` files.

    Options of the reader: ``xKey``, ``yKey``, ``featureType`` (float, double or long),
    ``partitionBytes``, ``batchRows``; of the writer: ``compressed``, ``fileRows``. The writer saves
    every column as an array of that name. A folder's files share their axes.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a path is needed")
        return self.options["path"]

    def schema(self) -> str:
        kind = self.options.get("featuretype", "float")
        if kind not in ("float", "double", "long"):
            raise ValueError(f"featureType {kind!r} is not float, double or long")
        with Container(container_files(self._path())[0][0]) as first:
            x, _ = first.resolve(self.options.get("xkey", "X"), self.options.get("ykey", "y"))
        for _ in x.row_shape:
            kind = f"array<{kind}>"
        return f"X {kind}, y long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._path(), {key.lower(): value for key, value in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._path(), {key.lower(): value for key, value in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("arrays")`` known to the session."""
    spark.dataSource.register(ArrayContainers)
