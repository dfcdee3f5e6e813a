"""Raw records and case banks as sources; JSON export and keyed upsert as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.cdc import merged

MANIFEST = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("name", T.StringType()), ("url", T.StringType()), ("sha256", T.StringType()), ("extractionStatus", T.StringType()), ("ocrConfidence", T.DoubleType()), ("needsReview", T.BooleanType()), ("extractedCharacters", T.IntegerType()))]))
STRINGS = T.ArrayType(T.StringType())
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source_id", "title", "content", "published_at", "source_url", "department_name", "attachment_text", "source_snapshot", "source_type", "extraction_status")]
    + [T.StructField(n, STRINGS) for n in ("attachment_names", "attachment_urls", "content_links", "image_hashes")]
    + [T.StructField("attachment_manifest", MANIFEST), T.StructField("source_metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("source_priority", T.IntegerType())]
)
DEFAULTS = {"attachment_text": "", "source_snapshot": "", "source_type": "official_notice", "extraction_status": "not_required", "source_priority": 50}


def with_defaults(records: DataFrame) -> DataFrame:
    """Missing fields filled: literals, empty lists, empty metadata; published_at as a UTC timestamp."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}
    filled |= {c: F.coalesce(F.col(c), F.array().cast(STRINGS)) for c in ("attachment_names", "attachment_urls", "content_links", "image_hashes")}
    filled["attachment_manifest"] = F.coalesce("attachment_manifest", F.array().cast(MANIFEST))
    filled["source_metadata"] = F.coalesce("source_metadata", F.create_map().cast("map<string,string>"))
    filled["published_at"] = F.try_to_timestamp("published_at")
    return records.withColumns(filled)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of raw records."""
    return with_defaults(spark.read.schema(RECORD).option("multiLine", "true").json(path))


def read_case_bank(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a line; blank lines and lines with # are skipped, malformed ones and repeated ids fail the read."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    cases = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    repeated = cases.groupBy("id").count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"{path}: ids repeat")
    return cases


def write_nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], path: str) -> None:
    """JSON export: each parent with its children as an ordered array."""
    fields = [c for c in children.columns if c != key]
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in fields if c not in order)))).alias("children"))
    parents.join(nested, key, "left").withColumn("children", F.coalesce("children", F.array())).write.json(path)


def upsert(spark: SparkSession, table: str, rows: DataFrame, key: str) -> DataFrame:
    """The Parquet table at path ``table`` after the upsert of rows, as a DataFrame to be written to a new path.

    New values win, other rows stay.
    """
    old = spark.read.parquet(table)
    columns = [c for c in old.columns if c != key]
    return merged(old, rows, key, columns).select(*old.columns)
