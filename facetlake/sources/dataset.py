"""Opening tables by path, schemas without data, tables over several files, settings."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lists import on_load
from . import grids, tables

IMAGES = (".png", ".jpg", ".jpeg")
#: Rows that a NetCDF reader hands on at once.
SLAB = 1 << 16


def put(spark: SparkSession, path: str, raw: bytes) -> None:
    """Write a small file to any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def kind_of(spark: SparkSession, path: str) -> str:
    """csv, netcdf, image, columns, halves or parquet, by extension or by a folder's infos."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return "csv"
    if low.endswith(".nc"):
        return "netcdf"
    if low.endswith(IMAGES):
        return "image"
    if exists(spark, f"{path}/info") and exists(spark, f"{path}/columns"):
        return "columns"
    if exists(spark, f"{path}/attr.info") or exists(spark, f"{path}/info.json"):
        return "halves"
    if low.endswith(".parquet"):
        return "parquet"
    raise ValueError(f"no reader for {path}")


def read(spark: SparkSession, path: str, attributes: str = ".*", trim: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Open a table by path: its kind's reader, short names, chosen attributes, trimmed dimensions."""
    ranged = grids.open_grid if grids.reaches(path) else read_netcdf_table  # a store that only Spark reads gives whole files
    readers = {"csv": tables.read_csv, "netcdf": ranged, "image": tables.read_images, "columns": tables.read_columns, "halves": grids.open_halves, "parquet": lambda s, p: s.read.parquet(p)}
    return on_load(tables.renamed(readers[kind_of(spark, path)](spark, path)), attributes, trim)


def csv_schema(spark: SparkSession, path: str) -> DataFrame:
    """position, attribute: the header's names and the row dimension ``index``; no data is read."""
    names = [c.strip() for c in spark.read.option("header", True).csv(path).columns]
    return spark.createDataFrame(list(enumerate([*names, "index"])), "position long, attribute string")


def netcdf_schema(spark: SparkSession, path: str) -> DataFrame:
    """file, variable, type, dims, sizes, scale, offset, fill of every variable of the files below a path.

    Only headers are read, but in stores that only Spark reads.
    """
    if grids.reaches(path):
        return grids.headers(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                sizes, variables = tables.netcdf(raw)
                for n, v in variables.items():
                    a = v["attributes"]
                    fill = a.get("_FillValue", a.get("missing_value"))
                    out.append({"file": p, "variable": n, "type": v["values"].dtype.name, "dims": v["dims"], "sizes": [sizes[d] for d in v["dims"]], "scale": float(a.get("scale_factor", [1])[0]), "offset": float(a.get("add_offset", [0])[0]), "fill": None if fill is None or isinstance(fill, str) else float(fill[0])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("variable", pa.string()), ("type", pa.string()), ("dims", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("scale", pa.float64()), ("offset", pa.float64()), ("fill", pa.float64())]))

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nc").load(path)
    return found.select("path", "content").mapInArrow(run, "file string, variable string, type string, dims array<string>, sizes array<bigint>, scale double, offset double, fill double")


def read_netcdf_table(spark: SparkSession, path: str, slices: dict[str, int] | None = None, fill_as_value: bool = False) -> DataFrame:
    """All variables of the files below a path as one table: a row per index, a column per dimension and variable.

    A variable repeats along the dimensions that it lacks.  Character variables become strings.  ``slices`` fixes
    dimensions at an index.  Rows are handed on in slabs, so only the file's bytes and a slab are held.  All files must
    have the variables and dimensions of the first.
    """
    slices = slices or {}
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nc").load(path).select("path", "content")
    first = netcdf_schema(spark, path).orderBy("file").collect()
    if not first:
        raise ValueError(f"no NetCDF file below {path}")
    heads = [r for r in first if r["file"] == first[0]["file"]]
    text = {r["variable"] for r in heads if r["type"].startswith("bytes")}
    lengths = {r["dims"][-1] for r in heads if r["variable"] in text and r["dims"]} - {d for r in heads if r["variable"] not in text for d in r["dims"]}
    dims = [d for d in dict.fromkeys(d for r in heads for d in r["dims"]) if d not in lengths and d not in slices]
    names = [r["variable"] for r in heads]
    columns = [f"{d}_index" if d in names else d for d in dims]
    schema = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in columns), *((n, pa.string() if n in text else pa.float64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                sizes, variables = tables.netcdf(raw)
                shape = tuple(sizes[d] for d in dims)
                for lo in range(0, int(np.prod(shape, dtype=np.int64)), SLAB):
                    n = min(SLAB, int(np.prod(shape, dtype=np.int64)) - lo)
                    at = dict(zip(dims, np.unravel_index(np.arange(lo, lo + n), shape))) if dims else {}
                    out = [pa.array([p] * n), *(pa.array(at[d]) for d in dims)]
                    for name in names:
                        v = variables[name]
                        own = [d for d in v["dims"] if d not in lengths]
                        cells = v["values"][tuple(at[d] if d in at else np.full(n, slices.get(d, 0)) for d in own)]
                        if name in text:
                            rows = cells.reshape(n, -1)
                            out.append(pa.array([b"".join(r.tolist()).rstrip(b"\0 ").decode("utf-8", "replace") for r in rows]))
                            continue
                        cells = np.broadcast_to(cells, n).astype(float)
                        a = v["attributes"]
                        fill = a.get("_FillValue", a.get("missing_value"))
                        bad = np.zeros(n, bool) if fill is None or fill_as_value else cells == float(fill[0])
                        out.append(pa.array(cells * float(a.get("scale_factor", [1])[0]) + float(a.get("add_offset", [0])[0]), mask=bad))
                    yield pa.RecordBatch.from_arrays(out, schema=schema)

    kinds = ", ".join(f"`{f.name}` " + {"string": "string", "int64": "long", "double": "double"}[str(f.type)] for f in schema)
    return found.mapInArrow(run, kinds)


def netcdf_bytes(dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict[str, float]]]) -> bytes:
    """A classic NetCDF file: variables by name as (dims, values of type int32, float64 or S1, number attributes)."""
    codes = {"i": (4, ">i4"), "f": (6, ">f8"), "S": (2, "S1")}
    word = lambda n: struct.pack(">I", n)
    name = lambda s: word(len(s.encode())) + s.encode().ljust(-(-len(s.encode()) // 4) * 4, b"\0")
    order = list(dims)
    bodies = {n: v.astype(codes[v.dtype.kind][1]).tobytes() for n, (_, v, _) in variables.items()}
    bodies = {n: b.ljust(-(-len(b) // 4) * 4, b"\0") for n, b in bodies.items()}

    def head(begin: dict[str, int]) -> bytes:
        out = b"CDF\x01" + word(0) + word(10) + word(len(dims)) + b"".join(name(d) + word(s) for d, s in dims.items()) + word(0) + word(0)
        out += word(11) + word(len(variables))
        for n, (own, v, attributes) in variables.items():
            out += name(n) + word(len(own)) + b"".join(word(order.index(d)) for d in own)
            out += (word(12) + word(len(attributes)) + b"".join(name(k) + word(6) + word(1) + struct.pack(">d", x) for k, x in attributes.items())) if attributes else word(0) + word(0)
            out += word(codes[v.dtype.kind][0]) + word(len(bodies[n])) + word(begin[n])
        return out

    at, begin = len(head(dict.fromkeys(variables, 0))), {}
    for n, b in bodies.items():
        begin[n] = at
        at += len(b)
    return head(begin) + b"".join(bodies.values())


def union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of several tables; their attribute names must agree."""
    parts = [read(spark, p) for p in paths]
    if any(sorted(p.columns) != sorted(parts[0].columns) for p in parts):
        raise ValueError("attribute names differ between files")
    return reduce(lambda a, b: a.unionByName(b), parts)


def analyse(spark: SparkSession, paths: list[str]) -> DataFrame:
    """attribute, lo, hi, n over all files together, in one pass."""
    df = union(spark, paths)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[x for c in df.columns for x in (F.min(c).cast("double").alias(f"lo|{c}"), F.max(c).cast("double").alias(f"hi|{c}"))])
    return row.select("n", F.expr(f"stack({len(df.columns)}, " + ", ".join(f"'{c}', `lo|{c}`, `hi|{c}`" for c in df.columns) + ") as (attribute, lo, hi)"))


def rows(spark: SparkSession, paths: list[str], normalized: bool = False) -> DataFrame:
    """Rows of several files, raw or with each attribute scaled to [0, 1] by its bounds over all of them."""
    df = union(spark, paths)
    if not normalized:
        return df
    b = {r["attribute"]: (r["lo"], r["hi"]) for r in analyse(spark, paths).collect()}  # a row per attribute
    scale = lambda c: (F.col(c) - b[c][0]) / (b[c][1] - b[c][0]) if b[c][0] is not None and b[c][1] > b[c][0] else F.when(F.col(c).isNotNull(), 0.0)
    return df.select(*[scale(c).alias(c) for c in df.columns])


def save_settings(spark: SparkSession, path: str, settings: dict) -> None:
    put(spark, path, json.dumps(settings, sort_keys=True).encode())


def load_settings(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
