"""Contexts by slicing the text, and the contacts of notices one rule at a time."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import contexts
from millrace.operators import contacts as C


@pytest.mark.parametrize("text", ["", "a1b22c333d", "1", "12 34", "x" * 300 + "7" + "y" * 300, "1" + "é2" * 150, "no number"])
def test_contexts_are_slices_of_the_text(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(contexts(F.col("t"), "([0-9])([0-9]*)", 5, 3, 2)).first()[0]
    want = [(i, m[0], [m[1], m[2]], text[max(0, m.start() - 5) : m.start()], text[m.end() : m.end() + 3]) for i, m in enumerate(re.finditer("([0-9])([0-9]*)", text))]
    assert [tuple(x) for x in got] == want


CASES = [
    # text, department, person, phone, email
    ("담당자 및 업무: 홍길동, 문의 031-280-1234", None, "홍길동", "031-280-1234", None),
    ("업무 담당: 김철수 주무관 전화 02) 555 - 1234", None, "김철수 주무관", "02-555-1234", None),
    ("업무 담당 이영희 교수", None, "이영희 교수", None, None),
    ("담당자 박민수 선생님에게", None, "박민수 선생님", None, None),
    ("최민호 교수 02-555-1234", None, "최민호 교수", None, None),  # nothing speaks for the number
    ("담당: 부서 / 담당: 정하나", None, "정하나", None, None),
    ("문의 02-555-1111" + "가" * 200 + "031-280-2222 문의", None, None, "031-280-2222", None),
    ("문의 02-555-1111, 02-555-2222", None, None, "02-555-1111", None),
    ("팩스 02-555-1111 문의", None, None, None, None),
    ("장학팀 02-555-1111 문의" + "가" * 100 + " 학사팀 02-555-2222 문의", "학사팀", None, "02-555-2222", None),
    ("장학팀 02-555-1111 문의", "학사팀", None, None, None),
    ("본인 이메일 작성 a@b.kr" + "나" * 120 + "문의: help@b.kr", None, None, None, "help@b.kr"),
    ("x@y.kr", "학사팀", None, None, None),
    ("학사팀 x@y.kr", "학사팀", None, None, "x@y.kr"),
    ("번호 1031-280-12345 문의", None, None, None, None),
    (None, None, None, None, None),
]


def test_contacts(spark):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "i int, t string, d string")
    got = df.select("i", C.person(F.col("t")), C.phone(F.col("t"), F.col("d")), C.email(F.col("t"), F.col("d"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[2:] for c in CASES]
