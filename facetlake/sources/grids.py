"""Grids and half-precision column folders as Spark data sources.

``facetlake_netcdf`` reads classic NetCDF files (versions 1, 2 and 5) and ``facetlake_halves`` folders of ``<i>.col`` files of
16-bit floats with their bounds in ``attr.info`` and ``data.info`` or in ``info.json``.  Schemas come from headers alone; a
file is cut into ranges of rows, so that one file feeds many tasks; a task reads the bytes of its rows and of the asked
columns (option ``columns``) only.  Files may be on any file system that Arrow opens by its address.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a record batch, rows of a task's range, and bytes between two reads that are read along.
SLAB, ROWS, NEAR = 1 << 16, 1 << 20, 1 << 16
#: numpy type and Spark type by number of the format's type
TYPES = {
    1: (">i1", "byte"), 2: ("S1", "string"), 3: (">i2", "short"), 4: (">i4", "int"), 5: (">f4", "float"), 6: (">f8", "double"),
    7: (">u1", "short"), 8: (">u2", "int"), 9: (">u4", "long"), 10: (">i8", "long"), 11: (">u8", "double"),
}
ARROW = {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}


def at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, fits: Callable[[str], bool]) -> list[str]:
    """Files below a path whose name fits, or the path itself, with their file system's prefix."""
    fs, inner = at(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else []
    return sorted(prefix + f.path for f in found if f.type == pafs.FileType.File and fits(f.base_name))


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    code: int
    begin: int
    attributes: dict
    record: bool

    @property
    def kind(self) -> str:
        return "double" if {"scale_factor", "add_offset"} & self.attributes.keys() and self.code != 2 else TYPES[self.code][1]


@dataclass(frozen=True)
class Header:
    sizes: dict[str, int]
    variables: dict[str, Variable]
    stride: int  # bytes of a record


def parsed(raw: bytes) -> Header:
    """Header of a classic file from its first bytes; IndexError if they end too early."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    place, wide, long = 4, raw[3] >= 2, raw[3] == 5

    def take(n: int) -> bytes:
        nonlocal place
        if place + n > len(raw):
            raise IndexError(place + n)
        place += n
        return raw[place - n : place]

    u32 = lambda: struct.unpack(">I", take(4))[0]
    count = lambda: struct.unpack(">Q", take(8))[0] if long else u32()

    def padded(n: int) -> bytes:
        return take(n + -n % 4)[:n]

    name = lambda: padded(count()).decode()

    def attributes() -> dict:
        u32()
        out = {}
        for _ in range(count()):
            key, code, n = name(), u32(), count()
            d = np.dtype(TYPES[code][0])
            body = padded(n * d.itemsize)
            out[key] = body.decode("utf-8", "replace") if code == 2 else np.frombuffer(body, d)
        return out

    records = count()
    u32()
    dims = [(name(), count()) for _ in range(count())]
    attributes()
    u32()
    variables, stride = {}, 0
    for _ in range(count()):
        n, ids = name(), [count() for _ in range(count())]
        own, code, size = attributes(), u32(), count()
        begin = struct.unpack(">Q", take(8))[0] if wide else u32()
        record = bool(ids) and dims[ids[0]][1] == 0
        stride += size * record
        shape = tuple(dims[i][1] or (0 if records == 0xFFFFFFFF else records) for i in ids)
        variables[n] = Variable(n, tuple(dims[i][0] for i in ids), shape, code, begin, own, record)
    if sum(v.record for v in variables.values()) == 1:  # a single record variable is not padded
        one = next(v for v in variables.values() if v.record)
        stride = prod(one.shape[1:]) * np.dtype(TYPES[one.code][0]).itemsize
    return Header({n: s or records for n, s in dims}, variables, stride)


def header(file: pa.NativeFile) -> Header:
    n, size = 1 << 13, file.size()
    while True:
        try:
            return parsed(file.read_at(min(n, size), 0))
        except IndexError:
            if n >= size:
                raise ValueError("the file ends within its header") from None
            n *= 4


@dataclass(frozen=True)
class Layout:
    """Row dimensions and columns of a table over a header."""

    dims: tuple[str, ...]
    lengths: frozenset[str]
    columns: tuple[tuple[str, str, str], ...]  # column, Spark type, dimension or variable

    @classmethod
    def of(cls, h: Header, slices: dict[str, int]) -> Layout:
        text = [v for v in h.variables.values() if v.code == 2]
        numbers = {d for v in h.variables.values() if v.code != 2 for d in v.dims}
        lengths = frozenset(v.dims[-1] for v in text if v.dims) - numbers
        dims = tuple(d for d in dict.fromkeys(d for v in h.variables.values() for d in v.dims) if d not in lengths and d not in slices)
        index = [(f"{d}_index" if d in h.variables else d, "long", d) for d in dims]
        return cls(dims, lengths, (("file", "string", ""), *index, *((v.name, v.kind, v.name) for v in h.variables.values())))


def gathered(file: pa.NativeFile, offsets: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each offset, as rows; near offsets are read together."""
    places, back = np.unique(offsets, return_inverse=True)
    out = np.empty((len(places), width), np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff(places) > width + NEAR) + 1), len(places)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            raw = np.frombuffer(file.read_at(int(places[b - 1] - places[a]) + width, int(places[a])), np.uint8)
            out[a:b] = raw[(places[a:b] - places[a])[:, None] + np.arange(width)]
    return out[back]


def values(file: pa.NativeFile, h: Header, v: Variable, lengths: frozenset[str], index: dict[str, np.ndarray], n: int, keep_fill: bool) -> pa.Array:
    """A variable at the rows' indices, along the dimensions that it has."""
    own = [d for d in v.dims if d not in lengths] if v.code == 2 else list(v.dims)
    d = np.dtype(TYPES[v.code][0])
    inner = prod(v.shape[len(own) :])  # characters of a string
    width, offset = d.itemsize * inner, np.full(n, v.begin, np.int64)
    for k, dim in enumerate(own):
        step = h.stride if v.record and k == 0 else width * prod(v.shape[k + 1 : len(own)])
        offset = offset + index[dim] * step
    cells = gathered(file, offset, width)
    if v.code == 2:
        return pa.array([bytes(c).rstrip(b"\0 ").decode("utf-8", "replace") for c in cells], pa.string())
    x = cells.reshape(-1).view(d).astype(d.newbyteorder("="))
    fill = v.attributes.get("_FillValue", v.attributes.get("missing_value"))
    bad = x == x.dtype.type(fill[0]) if fill is not None and not isinstance(fill, str) and not keep_fill else None
    if v.kind == "double" and {"scale_factor", "add_offset"} & v.attributes.keys():
        x = x.astype(float) * float(v.attributes.get("scale_factor", [1])[0]) + float(v.attributes.get("add_offset", [0])[0])
    return pa.array(x.astype(ARROW[v.kind].to_pandas_dtype()), ARROW[v.kind], mask=bad)


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int | None


def asked(options: dict, columns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    names = [n for n in options.get("columns", "").split(",") if n]
    known = dict(columns)
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"no column {missing[0]}")
    return [(n, known[n]) for n in names] or columns


def schema_text(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in columns)


class NetCdf(DataSource):
    """Options: ``path``, ``columns`` (comma-separated), ``slices`` (JSON of dimension and index), ``fill_as_value``, ``rows``."""

    @classmethod
    def name(cls) -> str:
        return "facetlake_netcdf"

    def first(self) -> tuple[list[str], Layout]:
        found = listed(self.options["path"], lambda n: n.endswith(".nc"))
        if not found:
            raise ValueError(f"no NetCDF file below {self.options['path']}")
        fs, inner = at(found[0])
        with fs.open_input_file(inner) as f:
            return found, Layout.of(header(f), json.loads(self.options.get("slices", "{}")))

    def schema(self) -> str:
        return schema_text(asked(self.options, [c[:2] for c in self.first()[1].columns]))

    def reader(self, schema) -> NetCdfReader:
        return NetCdfReader(dict(self.options), *self.first())


class NetCdfReader(DataSourceReader):
    def __init__(self, options: dict, files: list[str], layout: Layout):
        self.options, self.files, self.layout = options, files, layout

    def partitions(self) -> list[Range]:
        out, rows = [], int(self.options.get("rows", ROWS))
        for path in self.files:
            fs, inner = at(path)
            if fs.get_file_info(inner).size <= rows:  # not even a byte a row: no need to look inside
                out.append(Range(path, 0, None))
                continue
            with fs.open_input_file(inner) as f:
                h = header(f)
            n = prod(h.sizes[d] for d in self.layout.dims)
            out += [Range(path, a, min(a + rows, n)) for a in range(0, n, rows)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        columns = asked(self.options, [c[:2] for c in self.layout.columns])
        source = {c: of for c, _, of in self.layout.columns}
        slices, keep = json.loads(self.options.get("slices", "{}")), self.options.get("fill_as_value", "false") == "true"
        fs, inner = at(part.path)
        with fs.open_input_file(inner) as f:
            h = header(f)
            if mine := [c for c in columns if c not in [x[:2] for x in Layout.of(h, slices).columns]]:
                raise ValueError(f"{part.path} has no {mine[0][0]} of type {mine[0][1]}")
            shape = tuple(h.sizes[d] for d in self.layout.dims)
            end = prod(shape) if part.hi is None else part.hi
            for lo in range(part.lo, end, SLAB):
                n = min(SLAB, end - lo)
                index = dict(zip(self.layout.dims, np.unravel_index(np.arange(lo, lo + n), shape))) if shape else {}
                index |= {d: np.full(n, k) for d, k in slices.items()}
                out = []
                for c, _ in columns:
                    if c == "file":
                        out.append(pa.array([part.path] * n))
                    elif c in h.variables:
                        out.append(values(f, h, h.variables[c], self.layout.lengths, index, n, keep))
                    else:
                        out.append(pa.array(index[source[c]].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(out, names=[c for c, _ in columns])


def infos(path: str) -> tuple[list[tuple[str, float, float]], int]:
    """(name, least and largest value of each column, rows) of a folder of half-precision columns, from its infos alone."""
    fs, inner = at(path)

    def text(name: str) -> str | None:
        if fs.get_file_info(f"{inner}/{name}").type != pafs.FileType.File:
            return None
        with fs.open_input_stream(f"{inner}/{name}") as f:
            return f.read().decode()

    if (words := text("attr.info")) is not None:
        words = words.split()[1:]
        rows = int((text("data.info") or "0").split()[0])
        return [(words[k], float(words[k + 1]), float(words[k + 2])) for k in range(0, len(words) - 2, 3)], rows
    if (raw := text("info.json")) is not None:
        info = json.loads(raw)
        if info.get("compressed_data"):
            raise ValueError(f"{path} holds compressed columns")
        return [(a["name"], float(a["min"]), float(a["max"])) for a in info["attributes"]], int(info["data_size"])
    raise ValueError(f"{path} has no info")


class Halves(DataSource):
    """Folders below ``path`` that hold infos, one after the other; options ``columns`` and ``rows``.  ``index`` counts the
    rows of a folder, ``folder`` names it."""

    @classmethod
    def name(cls) -> str:
        return "facetlake_halves"

    def folders(self) -> list[str]:
        found = sorted({f.rsplit("/", 1)[0] for f in listed(self.options["path"], lambda n: n in ("attr.info", "info.json"))})
        if not found:
            raise ValueError(f"no column folder below {self.options['path']}")
        return found

    def columns(self) -> list[tuple[str, str]]:
        return [("folder", "string"), ("index", "long"), *((n, "float") for n, _, _ in infos(self.folders()[0])[0])]

    def schema(self) -> str:
        return schema_text(asked(self.options, self.columns()))

    def reader(self, schema) -> HalvesReader:
        return HalvesReader(dict(self.options), self.folders(), self.columns())


class HalvesReader(DataSourceReader):
    def __init__(self, options: dict, folders: list[str], columns: list[tuple[str, str]]):
        self.options, self.folders, self.known = options, folders, columns

    def partitions(self) -> list[Range]:
        rows = int(self.options.get("rows", ROWS))
        return [Range(p, a, min(a + rows, n)) for p in self.folders for n in [infos(p)[1]] for a in range(0, n, rows)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        columns = asked(self.options, self.known)
        bounds = {n: (k, lo, hi) for k, (n, lo, hi) in enumerate(infos(part.path)[0])}
        fs, inner = at(part.path)
        files = {n: fs.open_input_file(f"{inner}/{bounds[n][0]}.col") for n, _ in columns if n in bounds}
        for a in range(part.lo, part.hi, SLAB):
            n, out = min(SLAB, part.hi - a), []
            for c, _ in columns:
                if c in files:
                    _, lo, hi = bounds[c]
                    raw = files[c].read_at(2 * n, 2 * a)
                    if len(raw) < 2 * n:
                        raise ValueError(f"{part.path}: column {c} ends early")
                    out.append(pa.array(np.frombuffer(raw, "<f2").astype(np.float32) * np.float32(hi - lo) + np.float32(lo)))
                else:
                    out.append(pa.array([part.path] * n) if c == "folder" else pa.array(np.arange(a, a + n)))
            yield pa.RecordBatch.from_arrays(out, names=[c for c, _ in columns])
        for f in files.values():
            f.close()


def write_halves(df: DataFrame, path: str) -> DataFrame:
    """Write each partition as a folder of half-precision columns under the bounds of the whole table: folder, rows.

    Nulls become NaN.  A task holds two bytes a row and column of one batch; a folder that a failed attempt left has no
    infos, which are written last, and is not read.
    """
    row = df.agg(*[x for c in df.columns for x in (F.min(c).cast("double").alias(f"lo|{c}"), F.max(c).cast("double").alias(f"hi|{c}"))]).first()
    bounds = [(c, row[f"lo|{c}"] or 0.0, row[f"hi|{c}"] or 0.0) for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, n, folder = None, 0, f"{path}/{uuid.uuid4().hex}"
        fs, inner = at(folder)
        for batch in batches:
            if files is None:
                fs.create_dir(inner, recursive=True)
                files = [fs.open_output_stream(f"{inner}/{k}.col") for k in range(len(bounds))]
            for k, (_, lo, hi) in enumerate(bounds):
                x = batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)
                files[k].write(((x - lo) / (hi - lo) if hi > lo else x - lo).astype("<f2").tobytes())
            n += batch.num_rows
        if files is None:
            return
        for f in files:
            f.close()
        for name, text in (("data.info", f"{n} 1"), ("attr.info", f"{len(bounds)} " + " ".join(f"{c} {lo!r} {hi!r}" for c, lo, hi in bounds))):
            with fs.open_output_stream(f"{inner}/{name}") as f:
                f.write(text.encode())
        yield pa.RecordBatch.from_pydict({"folder": [folder], "rows": [n]})

    from ..operators.lineage import checkpointed

    return checkpointed(df.mapInArrow(run, "folder string, rows long"))


def open_grid(spark: SparkSession, path: str, columns: list[str] | None = None, slices: dict[str, int] | None = None, fill_as_value: bool = False, rows: int = ROWS) -> DataFrame:
    """NetCDF files below a path as one table: a row per index, numbers in their own type (double where they are scaled)."""
    spark.dataSource.register(NetCdf)
    options = {"path": path, "columns": ",".join(columns or []), "slices": json.dumps(slices or {}), "fill_as_value": str(fill_as_value).lower(), "rows": str(rows)}
    return spark.read.format(NetCdf.name()).options(**options).load()


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file, variable, type, dims, sizes, scale, offset, fill of every variable below a path; only headers are read."""
    fields = [("file", pa.string()), ("variable", pa.string()), ("type", pa.string()), ("dims", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("scale", pa.float64()), ("offset", pa.float64()), ("fill", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                fs, inner = at(p)
                with fs.open_input_file(inner) as f:
                    found = header(f).variables.values()
                for v in found:
                    a = v.attributes
                    fill = a.get("_FillValue", a.get("missing_value"))
                    out.append({"file": p, "variable": v.name, "type": np.dtype(TYPES[v.code][0]).name, "dims": list(v.dims), "sizes": list(v.shape), "scale": float(a.get("scale_factor", [1])[0]), "offset": float(a.get("add_offset", [0])[0]), "fill": None if fill is None or isinstance(fill, str) else float(fill[0])})
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    files = listed(path, lambda n: n.endswith(".nc"))
    found = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 1024)))
    return found.mapInArrow(run, "file string, variable string, type string, dims array<string>, sizes array<bigint>, scale double, offset double, fill double")


def reaches(path: str) -> bool:
    """Can Arrow open this address?"""
    try:
        at(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def open_halves(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """All half-precision column folders below a path as one table of floats."""
    spark.dataSource.register(Halves)
    return spark.read.format(Halves.name()).options(path=path, columns=",".join(columns or []), rows=str(rows)).load()


def halves_schema(spark: SparkSession, path: str) -> DataFrame:
    """position, attribute, lo, hi, rows of a column folder, from its infos; the row dimension ``index`` comes last."""
    bounds, n = infos(path)
    return spark.createDataFrame([*((k, c, lo, hi, n) for k, (c, lo, hi) in enumerate(bounds)), (len(bounds), "index", 0.0, float(n - 1), n)], "position long, attribute string, lo double, hi double, rows long")
