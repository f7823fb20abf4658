"""Readers and writers: CSV with categories, column folders, classic NetCDF, images, discovery."""

from __future__ import annotations

import json
import re
import struct
from math import prod

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import position

#: Names that are shortened on load.
RENAMES = {"longitude": "lon", "latitude": "lat", "level": "lev"}


def renamed(df: DataFrame, names: dict[str, str] = RENAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def category_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes from 0 in the order of the distinct strings.  Null has no code; its rows stay."""
    return df.join(position(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name=name), column, "left")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Comma-separated with a header.  Blank cells are 0; a column with a cell that is no number becomes codes."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    if any(not c.strip() for c in raw.columns):
        raise ValueError("a column has no name")
    raw = raw.select(*(columns or raw.columns))
    cell = {c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in raw.columns}
    odd = raw.agg(*[F.count(F.when((cell[c] != "") & cell[c].try_cast("double").isNull(), 1)).alias(c) for c in raw.columns]).first()
    out = raw
    for c in raw.columns:
        if odd[c]:
            number = cell[c].try_cast("double")
            text = F.when(number.isNotNull(), F.format_string("%.6f", number)).otherwise(cell[c])
            out = category_codes(out.withColumn(c, text), c, "_code").drop(c).withColumnRenamed("_code", c)
        else:
            out = out.withColumn(c, F.coalesce(cell[c].try_cast("double"), F.lit(0.0)))
    return out.select(*raw.columns)


def write_columns(df: DataFrame, path: str) -> None:
    """Values scaled to [0, 1] by attribute, as float Parquet, with their bounds beside them."""
    b = df.agg(*[F.min(c).alias(f"lo_{c}") for c in df.columns], *[F.max(c).alias(f"hi_{c}") for c in df.columns]).first()
    scaled = {c: F.when(F.lit(b[f"hi_{c}"] > b[f"lo_{c}"]), (F.col(c) - b[f"lo_{c}"]) / (b[f"hi_{c}"] - b[f"lo_{c}"] or 1)).otherwise(0.0).cast("float") for c in df.columns}
    df.select(*[v.alias(c) for c, v in scaled.items()]).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/columns")
    info = {"attributes": [{"name": c, "min": b[f"lo_{c}"], "max": b[f"hi_{c}"]} for c in df.columns]}
    df.sparkSession.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    info = json.loads(spark.read.text(f"{path}/info").first()[0])
    df = spark.read.parquet(f"{path}/columns")
    return df.select(*[(F.col(a["name"]).cast("double") * (a["max"] - a["min"]) + a["min"]).alias(a["name"]) for a in info["attributes"]])


def files(spark: SparkSession, path: str, include: str = ".*", exclude: str = "(?!)", glob: str = "*.nc") -> DataFrame:
    """Paths below a folder whose whole name fits one pattern and not the other."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    return found.where(F.col("path").rlike(include) & ~F.col("path").rlike(exclude))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", True).load(path)


NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf(raw: bytes) -> tuple[dict[str, int], dict[str, dict]]:
    """Dimensions and variables (dims, values, attributes) of a classic file (versions 1 and 2)."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    at = 4
    wide = raw[3] == 2

    def u32() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">I", raw, at - 4)[0]

    def name() -> str:
        nonlocal at
        n = u32()
        at += n + (-n) % 4
        return raw[at - n - (-n) % 4 : at - (-n) % 4].decode()

    def attributes() -> dict:
        nonlocal at
        u32()
        out = {}
        for _ in range(u32()):
            k, t, n = name(), u32(), u32()
            d = np.dtype(NC_TYPES[t])
            out[k] = raw[at : at + n].decode() if t == 2 else np.frombuffer(raw, d, n, at)
            at += n * d.itemsize + (-n * d.itemsize) % 4
        return out

    records = u32()
    u32()
    dims = [(name(), u32()) for _ in range(u32())]
    attributes()
    u32()
    heads = []
    for _ in range(u32()):
        n, ids = name(), [u32() for _ in range(u32())]
        a, t, size = attributes(), u32(), u32()
        begin = u32() if not wide else (u32() << 32) | u32()
        heads.append((n, ids, a, t, size, begin))
    sizes = {n: s or records for n, s in dims}
    stride = sum(h[4] for h in heads if h[1] and dims[h[1][0]][1] == 0)
    variables = {}
    for n, ids, a, t, size, begin in heads:
        d, shape = np.dtype(NC_TYPES[t]), [sizes[dims[i][0]] for i in ids]
        if ids and dims[ids[0]][1] == 0:
            per = prod(shape[1:])
            v = np.concatenate([np.frombuffer(raw, d, per, begin + r * stride) for r in range(records)]) if records else np.zeros(0, d)
        else:
            v = np.frombuffer(raw, d, prod(shape), begin)
        variables[n] = {"dims": [dims[i][0] for i in ids], "values": v.reshape(shape), "attributes": a}
    return sizes, variables


def string_dims(variables: dict[str, dict]) -> set[str]:
    """Dimensions that only character variables use: lengths of strings, not of the table."""
    chars = {d for v in variables.values() if v["values"].dtype.kind == "S" for d in v["dims"][-1:]}
    return chars - {d for v in variables.values() if v["values"].dtype.kind != "S" for d in v["dims"]}


def read_netcdf(spark: SparkSession, path: str, variable: str, fill_as_value: bool = False) -> DataFrame:
    """One variable of every file below path: its dimension indices and its value, scaled; fill values are null."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                _, variables = netcdf(raw)
                v = variables[variable]
                values, a = v["values"].astype(float), v["attributes"]
                fill = a.get("_FillValue", a.get("missing_value"))
                ok = np.ones(values.shape, bool) if fill is None or fill_as_value else values != float(fill[0])
                values = values * float(a.get("scale_factor", [1])[0]) + float(a.get("add_offset", [0])[0])
                index = np.indices(values.shape).reshape(values.ndim, -1).T
                yield pa.RecordBatch.from_arrays([pa.array([p] * values.size), pa.array(index.tolist(), pa.list_(pa.int64())), pa.array(values.ravel(), mask=~ok.ravel())], ["file", "dims", "value"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nc").load(path)
    return found.select("path", "content").mapInArrow(run, "file string, dims array<bigint>, value double")


def matching(names: list[str], pattern: str) -> list[str]:
    return [n for n in names if re.search(pattern, n)]
