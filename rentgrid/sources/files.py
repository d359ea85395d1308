"""Readers and writers: explicit schemas, a row order for "keep the first", strict output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.functions import constants as K
from rentgrid.functions.scalars import missing_if_nan, to_number
from rentgrid.sources.csv_ranges import read_quoted_csv

#: Column with the place of a row in its files.
ROW = "_row"


def with_row_order(df: DataFrame) -> DataFrame:
    """File order as one sortable struct: file, start of the split, place in the split."""
    meta = F.col("_metadata")
    return df.withColumn(ROW, F.struct(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"),
        F.monotonically_increasing_id().alias("place")))


def read_listings_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
                      columns: Sequence[str] | None = None, partitions: int | None = None,
                      line_breaks: bool = True, by_ranges: bool = True) -> DataFrame:
    """CSV (also ``.gz``) with a header, quoted JSON and, if ``line_breaks``, line breaks inside fields.

    Files with line breaks inside fields are read by ranges, split like any other
    (``csv_ranges``). ``by_ranges=False`` reads each file in one task, for files whose unquoted fields hold
    quotes. A gzip file is one range; give ``partitions`` to spread its rows after the scan.
    """
    if line_breaks and by_ranges:
        df = read_quoted_csv(spark, path, schema, ROW)
    else:
        reader = (spark.read.schema(schema).option("header", True).option("multiLine", line_breaks)
                  .option("quote", '"').option("escape", '"').option("enforceSchema", False))
        df = with_row_order(reader.csv(path))
    if columns is not None:
        df = df.select(*columns, ROW)
    return df.repartition(partitions) if partitions else df


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[missing_if_nan(f"`{f.name}`").alias(f.name)
                       if f.dataType in (T.DoubleType(), T.FloatType()) else F.col(f"`{f.name}`") for f in df.schema.fields])


def valid_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


POINT = "array<double>"
GEOMETRY = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
GEOJSON = f"features array<struct<properties:map<string,string>,geometry:{GEOMETRY}>>"
FEATURE = f"properties map<string,string>, geometry {GEOMETRY}"


def read_polygons(spark: SparkSession, path: str, keys: Sequence[str], lines: bool = False) -> DataFrame:
    """``(ordinal, keys..., rings)`` with rings of ``(lon, lat)``; features of one key become one row.

    ``lines`` reads one feature per line, which splits; a single document does not.
    Only polygons count, also those inside a geometry collection; a ring needs four
    points. The ordinal follows the key.
    """
    if lines:
        features = spark.read.schema(FEATURE).json(path)
    else:
        features = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(
            F.explode("features").alias("f")).select("f.*")
    own = F.array(F.struct(F.col("geometry.type").alias("type"), F.col("geometry.coordinates").alias("coordinates")))
    single = features.select(*[F.col("properties")[k].alias(k) for k in keys],
                             F.explode(F.concat(own, F.coalesce("geometry.geometries", F.slice(own, 1, 0)))).alias("g"))
    kind, text = F.col("g.type"), F.col("g.coordinates")
    parts = (F.when(kind == "Polygon", F.array(F.from_json(text, f"array<array<{POINT}>>")))
             .when(kind == "MultiPolygon", F.from_json(text, f"array<array<array<{POINT}>>>")))
    rings = F.transform(F.flatten(parts), lambda r: F.transform(
        r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    picked = single.select(*keys, F.filter(rings, lambda r: F.size(r) >= 4).alias("rings"))
    merged = picked.where(F.size("rings") > 0).groupBy(*keys).agg(F.flatten(F.collect_list("rings")).alias("rings"))
    return merged.select(F.struct(*keys).alias("ordinal"), *keys, "rings")


def read_pois(spark: SparkSession, path: str, group: str, tag: str | None = None) -> DataFrame:
    """Places with the coordinate of the node, else of the centre of a way, else dropped."""
    schema = ("elements array<struct<type:string,id:long,lat:double,lon:double,"
              "center:struct<lat:double,lon:double>,tags:map<string,string>>>")
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    if tag:
        e = e.where(F.col("tags")[tag].isNotNull())
    return e.select(F.lit(group).alias("group"), "type", "id", F.coalesce("lat", "center.lat").alias("lat"),
                    F.coalesce("lon", "center.lon").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")


def read_prefixed_block(spark: SparkSession, path: str, prefix: str, rename: Mapping[str, str],
                        header: Sequence[str], key: str = "GEO_ID") -> DataFrame:
    """Pipe-delimited rows of one key prefix: the prefix is cut off, cut-off lines are dropped."""
    text = spark.read.text(path).where(F.col("value").startswith(prefix))
    cells = F.split("value", r"\|", -1)
    whole = text.select(cells.alias("c")).where(F.size("c") == len(header))
    named = {h: F.col("c")[i] for i, h in enumerate(header)}
    return whole.select(F.substr(named[key], F.lit(len(prefix) + 1)).alias("key"),
                        *[named[h].alias(n) for h, n in rename.items()])


def read_index_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(month, value)`` from date and value columns; ``.`` means no value."""
    raw = spark.read.schema("date string, value string").option("header", True).csv(path)
    return raw.select(F.substring("date", 1, 7).alias("month"), to_number("value").alias("value")).where("value IS NOT NULL")


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """``(month, value)`` from a yearly/period series; the annual mean M13 and ``-`` are dropped."""
    schema = "Results struct<series:array<struct<data:array<struct<year:string,period:string,value:string>>>>>"
    d = (spark.read.schema(schema).option("multiLine", True).json(path)
         .select(F.explode("Results.series").alias("s")).select(F.explode("s.data").alias("d")).select("d.*"))
    month = F.col("period").rlike("^M(0[1-9]|1[0-2])$")
    return d.where(month).select(F.concat_ws("-", "year", F.substring("period", 2, 2)).alias("month"),
                                 to_number("value").alias("value")).where("value IS NOT NULL")


def pick_month(df: DataFrame, keys: Sequence[str], wanted: str) -> DataFrame:
    """Value of a month in a wide ``YYYY-MM...`` table, else of the nearest month that has one."""
    months = [c for c in df.columns if c not in keys]
    target = F.to_date(F.lit(wanted + "-01"))
    tall = df.unpivot(list(keys), months, "month", "value").where("value IS NOT NULL")
    gap = F.abs(F.date_diff(F.to_date(F.concat(F.substring("month", 1, 7), F.lit("-01"))), target))
    return tall.groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), F.substring("month", 1, 7).alias("month"),
                                                  F.col("value"))).alias("b")).select(*keys, "b.month", "b.value")


def register_table(df: DataFrame, key: str, count: str) -> DataFrame:
    """Rows whose key is a number; totals and captions fall out, counts lose their separators."""
    number = F.col(key).try_cast("int")
    return df.select(number.alias(key), to_number(F.regexp_replace(count, "[,.]", "")).cast("long").alias(count)).where(
        F.col(key).isNotNull())


def timeline(spark: SparkSession, events: Sequence[tuple[str, str]]) -> DataFrame:
    """Dated reference events in order; the day the rules changed must be among them."""
    if K.REGIME_DATE not in {d for d, _ in events}:
        raise ValueError(f"timeline lacks {K.REGIME_DATE}")
    return spark.createDataFrame(list(events), "day string, event string").select(
        F.to_date("day").alias("day"), "event").orderBy("day", "event")


# --- sinks ------------------------------------------------------------------------------

def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def strict_columns(df: DataFrame, digits: Mapping[str, int], default: int = 6) -> list[Column]:
    """Doubles rounded per column, with NaN and infinities as NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType in (T.DoubleType(), T.FloatType()):
            c = F.round(missing_if_nan(c).cast("double"), digits.get(f.name, default))
        out.append(c.alias(f.name))
    return out


def write_strict_json(df: DataFrame, path: str, digits: Mapping[str, int] | None = None,
                      mode: str = "errorifexists") -> None:
    """JSON lines that any parser accepts; NULL fields are written as null."""
    df.select(*strict_columns(df, digits or {})).write.mode(mode).option("ignoreNullFields", False).json(path)
