"""Canonical JSON against the standard library's, case folding letter by letter, rules on values of any depth."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import nested as N
from millrace.operators import tasks as K

KIND = "b struct<z:int,a:array<string>>, a map<string,array<double>>, s string, t boolean, n long"


def test_canonical_json_as_the_library_writes_it(spark):
    rows = [
        ({"z": 1, "a": ["q\"u\\o", None, "ü\n\t한"]}, {"k2": [1.5], "k1": None, "é": []}, "a/b", True, 5),
        (None, {}, None, None, None),
        ({"z": None, "a": []}, None, "", False, -3),
    ]
    df = spark.createDataFrame([(r,) for r in rows], f"v struct<{KIND.replace(' ', ':', 1).replace(', ', ',').replace('a map', 'a:map').replace('s string', 's:string').replace('t boolean', 't:boolean').replace('n long', 'n:bigint').replace('b:struct', 'b:struct')}>")
    got = [r[0] for r in df.select(N.canonical_json(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [json.dumps(dict(zip("bastn", r, strict=True)), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in rows]


def test_folding_as_python_folds(spark):
    letters = [chr(c) for c in (*range(1, 0x13A0), *range(0x1E00, 0x2000), *range(0xAC00, 0xAC80), *range(0xFF00, 0xFF60)) if c != 1 and chr(c).isalpha()]
    got = spark.createDataFrame([(x, x.casefold()) for x in letters], "x string, want string").where(N.folded(F.col("x")) != F.col("want"))
    assert [r["x"] for r in got.collect()] == []
    assert spark.range(1).select(N.folded(F.lit("ΟΔΟΣ Straße"))).first()[0] == "ΟΔΟΣ Straße".casefold()


def key(plan):
    """The digest as its definition reads."""
    word = lambda v: None if v is None else re.sub(r"\s+", "", re.sub("<[^>]+>", " ", v).replace("&amp;", "&")).casefold() or None
    task = plan["task"] or (plan["tasks"][0] if len(plan["tasks"]) == 1 else None)
    payload = {n: plan[n] for n in ("academicYear", "admissionYear", "semester", "grade")} | {n: word(plan[n]) for n in K.WORDS} | {n: sorted(set(plan[n])) for n in K.SETS}
    payload |= {"task": task, "tasks": sorted(plan["tasks"]), "eventKeywords": sorted({word(k) for k in plan["keywords"] if word(k)}) if task and task.startswith("event.") else []}
    assert len(payload) == 14
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_canonical_key(spark):
    base = {"task": None, "tasks": ["b", "a"], "academicYear": 2024, "admissionYear": None, "semester": "1", "grade": None, "category": " Straße ", "college": None, "department": "<b>AI</b> 학과", "studentStatus": "", "timeScope": "now", "requestedFields": ["y", "x", "y"], "requiredFacts": [], "keywords": ["K 2", "k2", " ", "Camp"]}
    plans = [base, base | {"tasks": ["a", "b"], "category": "STRASSE", "requestedFields": ["x", "y"], "department": "ai 학과"}, base | {"task": "event.camp"}, base | {"tasks": ["event.x"]}, base | {"task": "event.camp", "keywords": []}]
    kinds = "task string, tasks array<string>, academicYear int, admissionYear int, semester string, grade int, category string, college string, department string, studentStatus string, timeScope string, requestedFields array<string>, requiredFacts array<string>, keywords array<string>"
    df = spark.createDataFrame([tuple(p.values()) for p in plans], kinds).coalesce(1)
    got = [r[0] for r in df.select(K.canonical_key({c: F.col(c) for c in df.columns}, {f.name: f.dataType for f in df.schema})).collect()]
    assert got == [key(p) for p in plans]
    assert got[0] == got[1] and len({*got}) == 4


PLAN = T.StructType([
    T.StructField("goal", T.StringType()),
    T.StructField("steps", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))]))),
])


@pytest.mark.parametrize(
    ("plan", "want"),
    [
        ({"goal": "fine", "steps": [{"title": "ok", "tags": {"a": "b"}}]}, []),
        ({"goal": "see HTTPS://x", "steps": None}, [("$.goal", "unsafe")]),
        ({"goal": "x" * 41, "steps": [{"title": "ok", "tags": None}, {"title": "rm  -rf", "tags": {"k": "y" * 161}}]}, [("$.goal", "too_long"), ("$.steps[1].title", "unsafe"), ('$.steps[1].tags["k"]', "too_long")]),
        ({"goal": None, "steps": [{"title": "t" * 21, "tags": {"</system>": "x", 'q"': "sudo x"}}]}, [("$.steps[0].title", "too_long"), ('$.steps[0].tags["</system>"].key', "unsafe"), ('$.steps[0].tags["q\\""]', "unsafe")]),
        ({"goal": "", "steps": [None] * 4}, [("$.steps", "too_many")]),
        ({"goal": "curling bash-ful", "steps": []}, [("$.goal", "unsafe")]),
        ({"goal": "curly visual", "steps": []}, []),
        (None, []),
    ],
)
def test_violations(spark, plan, want):
    df = spark.createDataFrame([(plan, 1)], T.StructType([T.StructField("p", PLAN), T.StructField("path", T.IntegerType())]))
    rules = {"caps": {"goal": 40, "steps.title": 20, "steps": 3}}
    assert [tuple(x) for x in df.select(N.violations(F.col("p"), PLAN, **rules)).first()[0]] == want
    safe, refused = N.quarantine(df.drop("path"), "p", **rules)
    assert (safe.count(), refused.count()) == ((0, 1) if want else (1, 0))
    assert [(r["path"], r["reason"]) for r in refused.collect()] == want[:1]
