"""Files as data sources: ranges of rows, unread columns, types, odd files."""

import json
import struct

import numpy as np
import pyarrow.fs as pafs
import pytest

from facetlake.sources import dataset, grids

V = np.arange(60).reshape(3, 4, 5).astype(np.int32)
GRID = dataset.netcdf_bytes(
    {"time": 3, "lat": 4, "lon": 5, "chars": 3},
    {"v": (["time", "lat", "lon"], V, {"_FillValue": 7.0}), "lat": (["lat"], np.array([1.5, 2.5, 3.5, 4.5]), {}), "turned": (["lon", "time"], np.arange(15).reshape(5, 3) * 0.25, {}),
     "packed": (["time"], np.array([1, 2, 3], np.int32), {"scale_factor": 0.5, "add_offset": 10.0}), "tag": (["lat", "chars"], np.array([list("ab "), list("cd "), list("ef "), list("xyz")], "S1"), {})},
)


def test_rows_of_one_file_from_many_tasks(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(GRID)
    df = grids.open_grid(spark, f"file://{tmp_path}", rows=7)
    assert df.rdd.getNumPartitions() == 9
    kinds = dict(df.dtypes)
    assert kinds["v"] == "int" and kinds["lat"] == "double" and kinds["packed"] == "double" and kinds["tag"] == "string" and kinds["lat_index"] == "bigint"
    rows = df.collect()
    assert len(rows) == 60
    for r in rows:
        t, y, x = r["time"], r["lat_index"], r["lon"]
        assert r["v"] == (None if V[t, y, x] == 7 else V[t, y, x]) and r["lat"] == y + 1.5 and r["turned"] == (x * 3 + t) * 0.25
        assert r["packed"] == 10 + (t + 1) * 0.5 and r["tag"] == ["ab", "cd", "ef", "xyz"][y]
    assert {r["v"] for r in grids.open_grid(spark, str(tmp_path), ["v"], fill_as_value=True).collect()} == set(range(60))
    sliced = grids.open_grid(spark, str(tmp_path), ["lon", "v"], slices={"time": 2, "lat": 1}).collect()
    assert sorted((r["lon"], r["v"]) for r in sliced) == [(x, int(V[2, 1, x])) for x in range(5)]


def test_only_asked_bytes_are_read(tmp_path, monkeypatch):
    big = np.arange(200_000, dtype=np.int32)
    (tmp_path / "b.nc").write_bytes(dataset.netcdf_bytes({"row": len(big)}, {"a": (["row"], big, {}), "b": (["row"], big * 1.0, {}), "c": (["row"], big + 1, {})}))
    took = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, offset):
            took.append((offset, n))
            return self.f.read_at(n, offset)

        def size(self):
            return self.f.size()

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, p):
            return Counted(self.fs.open_input_file(p))

        def get_file_info(self, p):
            return self.fs.get_file_info(p)

    monkeypatch.setattr(grids, "at", lambda p: (Fs(pafs.LocalFileSystem()), p))
    source = grids.NetCdf({"path": str(tmp_path / "b.nc"), "columns": "c", "rows": "50000"})
    assert source.schema() == "`c` int"
    reader = source.reader(None)
    parts = reader.partitions()
    assert [(p.lo, p.hi) for p in parts] == [(k * 50_000, (k + 1) * 50_000) for k in range(4)]
    assert sum(n for _, n in took) < 20_000 * 4  # headers only
    took.clear()
    got = np.concatenate([b.column(0).to_numpy() for b in reader.read(parts[2])])
    assert (got == big[100_000:150_000] + 1).all()
    assert sum(n for _, n in took) < 4 * 50_000 + 10_000  # the range of one column and a header


def test_record_variables_and_bad_files(spark, tmp_path):
    # two record variables of 2 and 8 bytes, three records, laid out by hand
    word = lambda n: struct.pack(">I", n)
    name = lambda s: word(len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")

    def head(begin):
        out = b"CDF\x01" + word(3) + word(10) + word(1) + name("t") + word(0) + word(0) + word(0) + word(11) + word(2)
        for n, code, size, at in (("s", 3, 4, begin), ("d", 6, 8, begin + 4)):
            out += name(n) + word(1) + word(0) + word(0) + word(0) + word(code) + word(size) + word(at)
        return out

    body = b"".join(struct.pack(">hxxd", k * 3, k / 4) for k in range(3))
    (tmp_path / "r.nc").write_bytes(head(len(head(0))) + body)
    assert [(r["t"], r["s"], r["d"]) for r in grids.open_grid(spark, str(tmp_path), rows=2).orderBy("t").collect()] == [(k, k * 3, k / 4) for k in range(3)]
    with pytest.raises(ValueError):
        grids.parsed(b"HDF\x01")
    with pytest.raises(IndexError):
        grids.parsed(GRID[:40])
    with pytest.raises(Exception, match="no column"):
        grids.open_grid(spark, str(tmp_path), ["nothing"]).collect()


def test_halves(spark, tmp_path):
    df = spark.createDataFrame([(float(i), None if i == 5 else float(i % 11)) for i in range(1000)], "a double, b double").repartition(3)
    path = f"file://{tmp_path}/h"
    assert sum(r["rows"] for r in grids.write_halves(df, path).collect()) == 1000
    read = grids.open_halves(spark, path, rows=100)
    assert read.rdd.getNumPartitions() > 3
    got = read.toPandas()
    assert len(got) == 1000 and got.groupby("folder")["index"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert np.abs(np.sort(got.a) - np.arange(1000)).max() < 0.5 and got.b.isna().sum() == 1
    assert grids.open_halves(spark, path, ["b"]).columns == ["b"]


def test_halves_by_json_and_broken_folders(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    (folder / "info.json").write_text(json.dumps({"data_size": 4, "half_data": True, "compressed_data": False, "attributes": [{"name": "u", "min": 2, "max": 10}]}))
    (folder / "0.col").write_bytes(np.array([0, 0.25, 0.5, 1], "<f2").tobytes())
    assert [r["u"] for r in grids.open_halves(spark, str(folder)).orderBy("index").collect()] == [2, 4, 6, 10]
    assert [(r["attribute"], r["lo"], r["hi"], r["rows"]) for r in grids.halves_schema(spark, str(folder)).orderBy("position").collect()] == [("u", 2.0, 10.0, 4), ("index", 0.0, 3.0, 4)]
    (folder / "0.col").write_bytes(b"\0\0")
    with pytest.raises(Exception, match="ends early"):
        grids.open_halves(spark, str(folder)).collect()
    (folder / "info.json").unlink()
    with pytest.raises(Exception, match="no column folder"):
        grids.open_halves(spark, str(folder))
