"""Exports that appear whole or not at all, and sources whose failures are rows."""

import hashlib
import json
import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.export import MANIFEST, export_nested, nested
from millrace.sources.files import _texts
from millrace.sources.isolated import Source, union_isolated


def exported(path):
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return [json.loads(line) for f in files for line in open(f"{path}/{f}", encoding="utf-8")]


@pytest.fixture
def tables(spark):
    parents = spark.range(500).selectExpr("id AS k", "id % 7 AS day", "concat('é', id) AS title", "CAST(id AS DECIMAL(5,1)) AS fee", "DATE'2024-01-01' AS d").repartition(6)
    children = spark.range(900).selectExpr("id % 300 AS k", "id % 4 AS n", "concat('c', id) AS name").repartition(5)
    return parents, children


def test_export_is_the_nested_table_in_order(spark, tables, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):  # again: it replaces what is there
        export_nested(*tables, "k", [F.desc("day"), "k"], ["n", "name"], path)
        rows = exported(path)
        want = nested(*tables, "k", ["n", "name"]).orderBy(F.desc("day"), "k").collect()
        assert [(r["day"], r["k"], r["title"], r["fee"], r["d"]) for r in rows] == [(w["day"], w["k"], w["title"], float(w["fee"]), "2024-01-01") for w in want]
        assert [r["children"] for r in rows] == [[{"n": c["n"], "name": c["name"]} for c in w["children"]] for w in want]
        assert rows[-1]["children"] == [] or len(rows[-1]["children"]) == 3
        told = json.load(open(f"{path}/{MANIFEST}"))
        assert sum(p["rows"] for p in told) == 500 and all(hashlib.sha256(open(f"{path}/{p['file']}", "rb").read()).hexdigest() == p["sha256"] for p in told)
        assert not [f for f in os.listdir(path) if f.startswith("_staging")]
    back = spark.read.json(path + "/part-*.json")
    assert back.count() == 500


def test_a_failed_export_leaves_nothing(spark, tables, tmp_path):
    path = str(tmp_path / "out")
    bad = tables[0].withColumn("title", F.when(F.col("k") == 313, F.raise_error(F.lit("no"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="no"):
        export_nested(bad, tables[1], "k", ["k"], ["n"], path)
    assert not os.path.exists(path) or os.listdir(path) == []
    export_nested(*tables, "k", ["k"], ["n"], path)
    before = exported(path)
    with pytest.raises(Exception, match="no"):
        export_nested(bad, tables[1], "k", ["k"], ["n"], path)
    assert exported(path) == before


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def test_broken_sources_are_rows(spark, tmp_path):
    good = spark.range(5).selectExpr("id", "'a' AS text")
    good.write.parquet(str(tmp_path / "good"))
    good.coalesce(1).write.parquet(str(tmp_path / "partly"))
    (tmp_path / "partly" / "broken.parquet").write_bytes(b"PAR1 this is none PAR1")
    spark.range(2).selectExpr("string(id) AS id", "'x' AS text").write.parquet(str(tmp_path / "typed"))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"id": 1, "text": "x"}\n{"id": oops\n{"id": 2}\n')

    def raises():
        raise RuntimeError("the site is down")

    at = lambda n: str(tmp_path / n)
    sources = [Source("good", at("good")), Source("gone", at("gone")), Source("partly", at("partly")), Source("typed", at("typed")), Source("lines", at("lines"), "json"), Source("site", collect=raises), Source("mine", collect=lambda: good.withColumn("more", F.lit(1))), Source("odd", at("good"), "nonesuch")]
    rows, errors = union_isolated(spark, sources, SCHEMA)
    assert {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"good": 5, "partly": 5, "lines": 2, "mine": 5}
    told = sorted((r["source"], r["kind"], (r["place"] or "").rsplit("/", 1)[-1]) for r in errors.collect())
    assert told == [("gone", "source", "gone"), ("lines", "row", "a.json"), ("odd", "source", "good"), ("partly", "file", "broken.parquet"), ("site", "source", ""), ("typed", "source", "typed")]
    messages = {r["source"]: r["message"] for r in errors.collect()}
    assert messages["site"] == "RuntimeError: the site is down" and "id: string, not bigint" in messages["typed"] and "oops" in messages["lines"]


def test_no_source_at_all(spark):
    rows, errors = union_isolated(spark, [], SCHEMA)
    assert rows.count() == errors.count() == 0


def test_decoding_holds_a_piece_of_a_batch_at_a_time():
    """Bodies of 64 MB, of which the result has 32: no second copy of all of them as Python objects."""
    bodies = pa.array([("Text " * 800).encode("utf-16")] * 8000)
    tracemalloc.start()
    try:
        made = _texts(bodies)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert set(made.to_pylist()) == {"Text " * 800} and len(made) == 8000 and peak < 8
    odd = [b"\xff\xfea\x00", None, "é".encode(), "한".encode("cp949"), b"\xff\xff", b"", b"x" * (3 << 20)]
    assert _texts(pa.array(odd, pa.binary())).to_pylist() == ["a", None, "é", "한", "", "", "x" * (3 << 20)]
    assert _texts(pa.array([], pa.binary())).to_pylist() == []
