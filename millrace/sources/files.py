"""Files as sources: binary manifests, kinds by name and content, decoding of bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.batches import pieces

SIZE_CAP = 25 << 20


def binary_manifest(spark: SparkSession, folder: str, pattern: str = "*", cap: int = SIZE_CAP) -> DataFrame:
    """(name, length, sha256, kind) of the files under folder that match pattern and are not over the cap.

    The cap is applied to the listing, so the bytes of larger files are never read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    head = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    return files.where(F.col("length") <= cap).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), file_kind(F.col("path"), F.lit(None).cast("string"), head).alias("kind")
    )


def file_kind(name: Column, mime: Column, head: Column) -> Column:
    """The kind of a file by its suffix, then its MIME type, then its first characters; else ``unsupported``."""
    low = F.lower(name)
    kind = F.when(low.rlike(r"\.html?$"), "html").when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.(png|jpe?g|gif|webp)$"), "image").when(low.rlike(r"\.parquet$"), "parquet")
    kind = kind.when(mime.startswith("text/html"), "html").when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image")
    kind = kind.when(head.startswith("%PDF-"), "pdf").when(head.startswith("\x89PNG") | head.startswith("GIF8") | head.startswith("\xff\xd8\xff"), "image").when(head.startswith("PAR1"), "parquet")
    return kind.when(F.lower(F.substring(head, 1, 64)).rlike(r"^\s*<(!doctype html|html)"), "html").otherwise("unsupported")


#: Bytes of bodies that are decoded at a time, unless one alone has more.
AT_ONCE = 1 << 20


def _decoded(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "ignore")
    for name in ("utf-8", "cp949", "euc-kr"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore")


def _texts(bodies: pa.Array) -> pa.Array:
    """The texts of a batch; of a piece at a time there are Python objects."""
    made = [pa.array([_decoded(x.as_py()) for x in bodies.slice(at, n)], pa.string()) for at, n in pieces(bodies, len(bodies), AT_ONCE)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def decode_bytes(body: pa.Array) -> pa.Array:
    """Text of bytes: UTF-16 by its mark, else the first of UTF-8, CP949 and EUC-KR that fits, else UTF-8 without what does not fit."""
    return _texts(body)
