"""Readers: tables by extension, delimited and fixed-width text, geometry, the election corpus."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.geometry import RINGS_TYPE, orient_polygon
from ..functions.scalars import NUMBER_PATTERN
from ..tables import standard_names

# Delimiters a text file may use, in order of preference on a tie.
DELIMITERS = ("|", "\t", ",", ";")
SNIFF_CHARS = 8192

# Id columns that stay text however numeric they look.
ID_SUFFIXES = ("_geoid", "_fips")
ID_COLUMNS = ("plan_id", "district_id", "election_id")


def is_id_column(name: str) -> bool:
    return name.endswith(ID_SUFFIXES) or name in ID_COLUMNS


def auto_numeric(df: DataFrame) -> DataFrame:
    """Cast the text columns whose every value is a number; ids stay text.

    One aggregation looks at all columns.  Whole numbers become bigint, others
    double; a column without values stays text.
    """
    cols = [c for c, t in df.dtypes if t == "string" and not is_id_column(c)]
    if not cols:
        return df
    text = {c: F.trim(F.col(f"`{c}`")) for c in cols}
    probes = []
    for i, c in enumerate(cols):
        probes += [F.count_if(~text[c].rlike(NUMBER_PATTERN)).alias(f"bad{i}"),
                   F.count_if(text[c].try_cast("bigint").isNull() & text[c].isNotNull()
                              | text[c].rlike("[.eE]")).alias(f"frac{i}"),
                   F.count(text[c]).alias(f"n{i}")]
    seen = df.agg(*probes).first()
    casts = {c: text[c].cast("double" if seen[f"frac{i}"] else "bigint")
             for i, c in enumerate(cols) if seen[f"n{i}"] and not seen[f"bad{i}"]}
    return df.withColumns(casts) if casts else df


def read_delimited(spark: SparkSession, path: str, sep: str = ",", types: str = "auto") -> DataFrame:
    """Delimited file with a header: all text, types by whole-column check, or Spark inference."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    if types == "infer":
        return reader.option("inferSchema", True).csv(path)
    df = reader.csv(path)
    return auto_numeric(df) if types == "auto" else df


def guess_delimiter(spark: SparkSession, path: str) -> str | None:
    """The candidate found most often at the head of the file, None if none occurs."""
    head = "\n".join(r[0] for r in spark.read.text(path).take(SNIFF_CHARS // 8))[:SNIFF_CHARS]
    best = max(DELIMITERS, key=head.count)
    return best if head.count(best) else None


def read_fixed_width(spark: SparkSession, path: str, widths: list[tuple[str, int]], header: bool = True) -> DataFrame:
    """Columns of declared widths, trimmed; blank fields are NULL.

    A header line is recognised by holding the column names at their places.
    """
    start, cols = 1, []
    for name, width in widths:
        field = F.trim(F.substring("value", start, width))
        cols.append(F.when(field != "", field).alias(name))
        start += width
    df = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(*cols)
    if header:
        first = widths[0][0]
        last = widths[-1][0]
        df = df.where(~(F.coalesce(F.col(first), F.lit("")).eqNullSafe(first) & F.coalesce(F.col(last), F.lit("")).eqNullSafe(last)))
    return df


def read_text(spark: SparkSession, path: str, widths: list[tuple[str, int]] | None = None, types: str = "auto") -> DataFrame:
    sep = guess_delimiter(spark, path)
    if sep is not None:
        return read_delimited(spark, path, sep, types)
    if widths is None:
        raise ValueError(f"{path} holds no delimiter; give the column widths")
    df = read_fixed_width(spark, path, widths)
    return auto_numeric(df) if types == "auto" else df


def read_table(spark: SparkSession, path: str, fmt: str | None = None, types: str = "auto",
               widths: list[tuple[str, int]] | None = None) -> DataFrame:
    """Read by extension (or ``fmt``): csv, tsv, txt, parquet, pq, geojson, json."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = (fmt or (name.rsplit(".", 1)[-1] if "." in name else "")).lower()
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, "\t" if kind == "tsv" else ",", types)
    if kind == "txt":
        return read_text(spark, path, widths, types)
    if kind in ("geojson", "json"):
        return read_geojson(spark, path)
    raise ValueError(f"unsupported input file type: {path}")


def register_views(spark: SparkSession, path: str, name: str) -> None:
    """Two views on one file: inferred types, and ``<name>_str`` with all text."""
    read_delimited(spark, path, types="infer").createOrReplaceTempView(name)
    read_delimited(spark, path, types="text").createOrReplaceTempView(f"{name}_str")


def geojson_rings(kind: Column, coordinates: Column) -> Column:
    """Rings of a polygon or multipolygon from its coordinate text."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    rings = lambda p: orient_polygon(F.transform(p, lambda r: F.transform(
        r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))
    return F.when(kind == "Polygon", rings(polygon)).when(kind == "MultiPolygon", F.flatten(F.transform(multi, rings)))


_FEATURE = "type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>"
MAX_PROPERTIES = 2000                                   # Fixed value: property names become columns


def _whole_json(text: Column, fields: str) -> Column:
    """The fields of a JSON object, and ``bad`` holding the text if it cannot be read."""
    return F.from_json(text, f"struct<{fields}, bad: string>", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})


def read_geojson(spark: SparkSession, path: str, crs: str | None = None, properties: list[str] | None = None) -> DataFrame:
    """GeoJSON as properties and ``rings``.

    A file whose first line is a whole JSON value holds one feature or
    collection per line; any other file is one document.  Both forms may stand
    in one folder.  A line or document that cannot be read, or is no Feature
    or FeatureCollection, is an error; nothing is dropped.  Without
    ``properties`` all names that occur become columns, at most MAX_PROPERTIES.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("at"), F.trim("value").alias("body")).where("body <> ''")
    first = lines.groupBy("file").agg(F.min_by("body", "at").alias("first"))
    by_line = first.where(_whole_json(F.col("first"), "type: string")["bad"].isNull()).select("file")
    documents = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    bodies = lines.join(by_line, "file").select("file", "body").union(documents.join(by_line, "file", "left_anti"))
    read = bodies.select("file", "body", _whole_json(F.col("body"), f"{_FEATURE}, features: array<struct<{_FEATURE}>>").alias("j"))
    kind = F.when(F.col("j.bad").isNull(), F.coalesce(F.col("j.type"), F.lit(""))).otherwise("")
    each = F.when(kind == "Feature", F.array(F.struct("j.type", "j.properties", "j.geometry"))).when(kind == "FeatureCollection", F.col("j.features"))
    strange = F.exists(F.coalesce(each, F.array()), lambda f: F.coalesce(f["type"], F.lit("")) != "Feature")
    wrong = read.where(~kind.isin("Feature", "FeatureCollection") | strange).select("file", F.left(F.trim("body"), F.lit(80))).limit(3).collect()
    if wrong:
        raise ValueError("not a GeoJSON feature or collection: " + "; ".join(f"{r[0]}: {r[1]}" for r in wrong))
    features = read.select(F.explode(each).alias("f"))
    flat = features.select(F.col("f.properties").alias("p"), geojson_rings(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("rings"))
    if properties is None:
        found = flat.select(F.explode(F.map_keys("p")).alias("k")).distinct().limit(MAX_PROPERTIES + 1).collect()
        if len(found) > MAX_PROPERTIES:
            raise ValueError(f"{path} has more than {MAX_PROPERTIES} property names; name those wanted")
        properties = sorted(r[0] for r in found)
    out = standard_names(flat.select(*[F.col("p")[n].alias(n) for n in properties], "rings"))
    return out.withColumn("crs", F.lit(crs)) if crs else out


@F.pandas_udf(RINGS_TYPE)
def rings_from_wkb(blobs: pd.Series) -> pd.Series:
    """Rings of WKB and EWKB polygons and multipolygons; height and measure are left out, other kinds are an error."""
    def head(b: bytes, at: int) -> tuple[str, int, int, int]:
        order = "<" if b[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", b, at + 1)
        width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)      # flags of the extended form
        at += 5 + (4 if code & 0x20000000 else 0)
        code &= 0x0FFFFFFF
        return order, code % 1000, max(width, 2 + (0, 1, 1, 2)[code // 1000]), at

    def polygon(b: bytes, at: int) -> tuple[list, int]:
        order, kind, width, at = head(b, at)
        if kind != 3:
            raise ValueError(f"geometry of kind {kind} in a multipolygon")
        (n_rings,) = struct.unpack_from(order + "I", b, at)
        at, rings = at + 4, []
        for i in range(n_rings):
            (n,) = struct.unpack_from(order + "I", b, at)
            pts = np.frombuffer(b, order + "f8", width * n, at + 4).reshape(-1, width)[:, :2]
            turn = np.sum(pts[:-1, 0] * pts[1:, 1] - pts[1:, 0] * pts[:-1, 1])
            pts = pts[::-1] if (turn > 0) != (i == 0) else pts
            rings.append([{"x": float(x), "y": float(y)} for x, y in pts])
            at += 4 + 8 * width * n
        return rings, at

    def one(b):
        if b is None:
            return None
        order, kind, _, at = head(b, 0)
        if kind == 3:
            return polygon(b, 0)[0]
        if kind != 6:
            raise ValueError(f"geometry of kind {kind}; polygons and multipolygons are read")
        (n,) = struct.unpack_from(order + "I", b, at)
        at, out = at + 4, []
        for _ in range(n):
            rings, at = polygon(b, at)
            out += rings
        return out

    return blobs.map(one)


@F.pandas_udf(BinaryType())
def wkb_from_rings(outlines: pd.Series) -> pd.Series:
    """WKB multipolygon of each outline: a counter-clockwise ring begins a part, the clockwise rings after it are its holes."""
    def one(rings):
        if rings is None:
            return None
        parts: list[list[np.ndarray]] = []
        for ring in rings:
            pts = np.array([(p["x"], p["y"]) for p in ring], dtype="<f8").reshape(-1, 2)
            turn = np.sum(pts[:-1, 0] * pts[1:, 1] - pts[1:, 0] * pts[:-1, 1])
            if turn > 0 or not parts:
                parts.append([pts])
            else:
                parts[-1].append(pts)
        out = [struct.pack("<BII", 1, 6, len(parts))]
        for part in parts:
            out.append(struct.pack("<BII", 1, 3, len(part)))
            out += [struct.pack("<I", len(pts)) + pts.tobytes() for pts in part]
        return b"".join(out)

    return outlines.map(one)


def decode_geometry(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """A WKB geometry column as ``rings``; a table that has ``rings``, or no binary geometry, stays as it is."""
    kinds = dict(df.dtypes)
    if "rings" in kinds or kinds.get(geometry) != "binary":
        return df
    return df.withColumn("rings", rings_from_wkb(F.col(geometry))).drop(geometry)


def read_geo_parquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Parquet with a WKB geometry column (or rings already) as a table with ``rings``."""
    return decode_geometry(standard_names(spark.read.parquet(path)), geometry)


def _corpus(spark: SparkSession, pattern: str, suffix: str) -> DataFrame:
    """Contest files, or folders of part files, whose names end in the suffix."""
    df = spark.read.option("header", True).csv(pattern)
    named = standard_names(df.select(*df.columns, F.col("_metadata.file_path").alias("_file")))
    name = F.regexp_extract(F.regexp_replace("_file", "%20", " "), rf"/([^/]*_{suffix}\.csv)(/[^/]*)?$", 1)
    return named.withColumns({
        "contest": F.regexp_extract(name, rf"^\d{{4}}_(.*?)(_Election)?_{suffix}\.csv$", 1),
        "year": F.regexp_extract(name, r"^(\d{4})_", 1).try_cast("int")}).drop("_file")


def read_returns_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_Returns.csv`` of a folder with contest and year from the file name."""
    return _corpus(spark, f"{folder.rstrip('/')}/*_Returns.csv", "Returns")


def read_turnout_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_VRTO.csv`` of a folder (registration and turnout), keyed like the returns."""
    return _corpus(spark, f"{folder.rstrip('/')}/*_VRTO.csv", "VRTO").withColumnRenamed("vtdkey", "vtdkeyvalue")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Returns and turnout rows in one table; columns a file kind lacks are NULL."""
    returns = read_returns_corpus(spark, folder).withColumn("kind", F.lit("returns"))
    turnout = read_turnout_corpus(spark, folder).withColumn("kind", F.lit("turnout"))
    return returns.unionByName(turnout, allowMissingColumns=True)
