"""Array containers: both kinds of files, ranges of rows, names, and what is refused."""

import io
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest

from anomaloom.sources import containers, datasets


def saved_tensors(path, payload, compressed=False):
    """A tensor archive as the training library lays it out, written without it."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")

    def rebuild(*_):
        raise AssertionError

    rebuild.__module__, rebuild.__qualname__, rebuild.__name__ = "torch._utils", "_rebuild_tensor_v2", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = rebuild
    kinds = {}
    for name in ("FloatStorage", "LongStorage"):
        kinds[name] = type(name, (), {"__module__": "torch"})
        setattr(torch, name, kinds[name])

    class Storage:
        def __init__(self, kind, key, data):
            self.kind, self.key, self.data = kind, key, data

    class Tensor:
        def __init__(self, storage, array):
            self.storage, self.array = storage, array

        def __reduce__(self):
            stride = tuple(s // self.array.itemsize for s in self.array.strides)
            return rebuild, (self.storage, 0, self.array.shape, stride, False, {})

    class Pickler(pickle.Pickler):
        def persistent_id(self, item):
            if isinstance(item, Storage):
                return ("storage", item.kind, item.key, "cpu", item.data.size)

    storages, named = [], {}
    for name, value in payload.items():
        if isinstance(value, np.ndarray):
            kind = kinds["FloatStorage" if value.dtype == np.float32 else "LongStorage"]
            storages.append(Storage(kind, str(len(storages)), value))
            value = Tensor(storages[-1], value)
        named[name] = value
    body = io.BytesIO()
    sys.modules["torch"], sys.modules["torch._utils"] = torch, utils
    try:
        Pickler(body, protocol=2).dump(named)
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as out:
        out.writestr("archive/data.pkl", body.getvalue())
        for storage in storages:
            out.writestr(f"archive/data/{storage.key}", storage.data.tobytes())


def read(df):
    rows = df.orderBy("y").collect()
    return np.array([row["X"] for row in rows]), [row["y"] for row in rows]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz(spark, tmp_path, save):
    x = np.arange(10 * 8 * 16, dtype=np.float32).reshape(10, 8, 16) / 1000
    path = str(tmp_path / "train.npz")
    save(path, X=x, y=np.arange(10).reshape(10, 1))
    df = datasets.read_dataset(spark, path)
    assert df.schema.simpleString() == "struct<X:array<array<float>>,y:bigint>"
    found, labels = read(df)
    assert np.array_equal(found.astype(np.float32), x) and labels == list(range(10))
    with pytest.raises(Exception, match="has neither other"):
        datasets.read_arrays(spark, path, x_key="other").collect()


@pytest.mark.parametrize("compressed", [False, True])
def test_pt(spark, tmp_path, compressed):
    x = np.arange(320, dtype=np.int64).reshape(10, 32) + 2**40
    path = str(tmp_path / "train.pt")
    saved_tensors(path, {"epoch": 3, "features": x, "labels": np.arange(10)}, compressed)
    df = datasets.read_arrays(spark, path, feature_type="long")
    assert df.schema.simpleString() == "struct<X:array<bigint>,y:bigint>"
    found, labels = read(df)
    assert np.array_equal(found, x) and labels == list(range(10))


def test_ranges_cover_every_row_once(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1003, 5))
    np.savez(tmp_path / "a.npz", X=x, y=np.arange(1003), other=np.zeros(3))
    np.savez(tmp_path / "b.npz", X=x[:7] + 1, y=np.arange(2000, 2007))
    df = spark.read.format("arrays").option("featureType", "double").option("partitionBytes", 4096).option("batchRows", 13)
    datasets.register(spark)
    df = df.load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    found, labels = read(df)
    assert labels == [*range(1003), *range(2000, 2007)]
    assert np.array_equal(found, np.concatenate([x, x[:7] + 1]))


def test_a_range_reads_only_its_bytes(tmp_path):
    x = np.zeros((100_000, 16))
    path = str(tmp_path / "wide.npz")
    np.savez(path, X=x, y=np.arange(100_000))
    with containers.Container(path) as container:
        read_bytes, real = [], container.file

        class Counting:
            def seek(self, at):
                real.seek(at)

            def read(self, size):
                read_bytes.append(size)
                return real.read(size)

            def close(self):
                real.close()

        container.file = Counting()
        array = container.arrays["X"]
        pieces = list(container.rows(array, 500, 600, 40))
    assert [len(piece) for piece in pieces] == [40, 40, 20] and sum(read_bytes) == 100 * 16 * 8


def test_written_and_read(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 1000, 1, 3).selectExpr("array(id * 0.5D, -id) AS X", "id AS y")
    datasets.write_arrays(df, path)
    assert sorted(datasets.read_arrays(spark, path, feature_type="double").collect()) == sorted(df.collect())
    assert all(name.endswith(".npz") for name in (p.name for p in (tmp_path / "out").iterdir()))
    with pytest.raises(FileExistsError):
        datasets.write_arrays(df, path)
    datasets.write_arrays(df.where("y < 10"), path, mode="overwrite", compressed=True)
    assert datasets.read_arrays(spark, path).count() == 10


def test_refused(spark, tmp_path):
    with pytest.raises(Exception, match="missing|FileNotFound"):
        datasets.read_arrays(spark, str(tmp_path / "missing.npz")).collect()
    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(Exception, match="neither .npz nor .pt"):
        datasets.read_arrays(spark, str(tmp_path / "x.csv")).collect()
    np.savez(tmp_path / "uneven.npz", X=np.zeros((3, 2)), y=np.zeros(2))
    with pytest.raises(ValueError, match="features"), containers.Container(str(tmp_path / "uneven.npz")) as found:
        found.resolve("X", "y")
    np.savez(tmp_path / "objects.npz", X=np.array([{}], dtype=object), y=np.zeros(1))
    with pytest.raises(TypeError, match="Python objects"):
        containers.Container(str(tmp_path / "objects.npz"))
    saved_tensors(tmp_path / "code.pt", {"features": np.zeros((1, 1), np.float32), "labels": np.zeros(1, np.int64), "run": print})
    with pytest.raises(pickle.UnpicklingError, match="print"):
        containers.Container(str(tmp_path / "code.pt"))
    with pytest.raises(Exception, match="different lengths"):
        datasets.write_arrays(spark.sql("SELECT array(1, 2) AS X, 1 AS y UNION ALL SELECT array(1), 2").coalesce(1), str(tmp_path / "ragged"))
