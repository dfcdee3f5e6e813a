"""Several sources read as one, where what fails becomes rows of an error table and the rest goes on.

Three kinds of failure are told apart.  ``source``: its path cannot be listed, its reader is unknown,
its collector raises, or a column is missing or of another type.  ``file``: no row comes out of it,
since it is empty or broken.  ``row``: it does not fit the schema (formats that have a corrupt-record
column: JSON lines and CSV without a header).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERRORS = "source string, kind string, place string, message string"
CORRUPT = "_corrupt_record"
LENGTH = 500


@dataclass(frozen=True)
class Source:
    """Where rows come from: a path with its format, or a collector that gives a DataFrame."""

    name: str
    path: str | None = None
    format: str = "parquet"
    collect: Callable[[], DataFrame] | None = None


def _checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def _loaded(reader: DataFrameReader, source: Source) -> DataFrame:
    """The source with the schema of its files; a broken file may be the first that is asked for one, which a setting of the session has to allow."""
    conf, name = reader._spark.conf, "spark.sql.files.ignoreCorruptFiles"
    before = conf.get(name)
    try:
        conf.set(name, "true")
        return reader.format(source.format).option("mergeSchema", "true").load(source.path)
    finally:
        conf.set(name, before)


def _read(spark: SparkSession, source: Source, schema: T.StructType) -> tuple[DataFrame, DataFrame | None]:
    """(rows, errors of files and rows): analysed here, so that what is wrong with the source shows."""
    if source.collect is not None:
        return _checked(source.collect(), schema).select(*schema.names), None
    told = source.format in ("json", "csv")
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if told:
        parse = F.from_json if source.format == "json" else F.from_csv
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        kind = full if source.format == "json" else full.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
        df = reader.format("text").load(source.path).where("value <> ''")
        df = df.select("_metadata", parse("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("x")).select("_metadata", "x.*")
    else:
        df = _checked(_loaded(reader, source), schema)
    place = F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("place")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source.path).select(F.regexp_replace("path", "^file:/+", "/").alias("place"))
    errors = files.join(df.select(place).distinct(), "place", "left_anti").select(F.lit("file").alias("kind"), "place", F.lit("no rows").alias("message"))
    if told:
        broken = df.where(F.col(CORRUPT).isNotNull()).select(F.lit("row").alias("kind"), place, F.left(CORRUPT, F.lit(LENGTH)).alias("message"))
        return df.where(F.col(CORRUPT).isNull()).select(*schema.names), errors.unionByName(broken)
    return df.select(*schema.names), errors


def union_isolated(spark: SparkSession, sources: list[Source], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with ``source``, errors (source, kind, place, message)) of all sources."""
    rows, errors, failed = [], [], []
    for s in sources:
        try:
            good, bad = _read(spark, s, schema)
        except Exception as e:  # whatever a source does wrong is its own
            failed.append((s.name, "source", s.path, f"{type(e).__name__}: {e}"[:LENGTH]))
            continue
        rows.append(good.select(F.lit(s.name).alias("source"), *schema.names))
        if bad is not None:
            errors.append(bad.select(F.lit(s.name).alias("source"), "kind", "place", "message"))
    none = spark.createDataFrame([], T.StructType([T.StructField("source", T.StringType(), False), *schema.fields]))
    return reduce(DataFrame.unionByName, rows, none), reduce(DataFrame.unionByName, errors, spark.createDataFrame(failed, ERRORS))
