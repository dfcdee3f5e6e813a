"""The contact that a notice names: person, telephone and e-mail, chosen by what stands around them.

Column expressions within the row.  A null text names nobody; a null department is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import EMAIL, contexts

# How notices name a person, words that are none, a telephone number, what speaks for and against a match.
PERSONS = (
    r"담당자\s*및\s*업무\s*[:：]\s*([가-힣]{2,4})()",
    r"(?:업무\s*)?담당(?:자)?\s*[:：]\s*([가-힣]{2,4})\s*(주무관|교수|선생님|직원)?",
    r"업무\s+담당\s+([가-힣]{2,4})\s*(주무관|교수|선생님|직원)?",
    r"담당자\s+([가-힣]{2,4})\s+(주무관|교수|선생님|직원)",
    r"([가-힣]{2,4})\s*(교수|주무관)\s*(?=0[0-9]{1,2}\s*[-)])",
)
NO_NAMES = ("부서", "문의", "전화", "연락처", "메일", "이메일", "선발", "신청", "업무")
CONTACT_PHONE = r"(?<![0-9])(0[0-9]{1,2})\s*[-)]\s*([0-9]{3,4})\s*-\s*([0-9]{4})(?![0-9])"
OFFICE = r"[가-힣A-Za-z0-9·]+(?:팀|센터|대대|부서)"
ASKED, ABOUT, OWN, FAX = "문의|담당|연락처|전화|상담", "문의|담당|연락", "작성|입력|본인|신청자", "(?i)FAX|팩스"
MAIL_WORDS = "문의|담당|연락|이메일|E-mail|email"


def person(text: Column) -> Column:
    """The name, with its title, of the first pattern that names one."""
    found = []
    for pattern in PERSONS:
        named = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda n, r: F.struct(n.alias("n"), r.alias("r")))
        first = F.try_element_at(F.filter(named, lambda x: ~x["n"].isin(*NO_NAMES)), F.lit(1))
        found.append(F.when(first.isNotNull(), F.rtrim(F.concat_ws(" ", first["n"], first["r"]))))
    return F.coalesce(*found)


def phone(text: Column, department: Column, own: str = "031-280-") -> Column:
    """The number that speaks most for being the notice's: asked for nearby, of the house, of its department and no fax; of equals the first; null unless something speaks for it."""

    def points(x: Column) -> Column:
        number = F.array_join(x["parts"], "-")
        around = F.concat(x["left"], x["hit"], x["right"])
        offices = F.regexp_extract_all(F.right(x["left"], F.lit(70)), F.lit(OFFICE), F.lit(0))
        other = department.isNotNull() & (F.size(offices) > 0) & (F.element_at(offices, -1) != department)
        mine = F.when(F.coalesce(F.contains(around, department), F.lit(False)), 2).otherwise(0)
        score = F.when(F.coalesce(other, F.lit(False)), -100).otherwise(F.when(around.rlike(ASKED), 4).otherwise(0) + F.when(number.startswith(own), 3).otherwise(0) + mine)
        return F.struct((score - F.when(around.rlike(FAX), 5).otherwise(0)).alias("score"), (-x["i"]).alias("turn"), number.alias("number"))

    best = F.array_max(F.transform(contexts(text, CONTACT_PHONE, 100, 60, 3), points))
    return F.when(best["score"] > 0, best["number"])


def email(text: Column, department: Column) -> Column:
    """The address that speaks most for being the notice's; of equals the first; null under two points."""

    def points(x: Column) -> Column:
        around, near = F.concat(x["left"], x["hit"], x["right"]), F.right(x["left"], F.lit(45))
        has = lambda c: F.coalesce(F.contains(c, department), F.lit(False))
        score = F.when(around.rlike(MAIL_WORDS), 3).otherwise(0) + F.when(has(around), 2).otherwise(0) + F.when(near.rlike(ABOUT), 4).otherwise(0) + F.when(has(near), 3).otherwise(0)
        return F.struct((score - F.when(F.right(x["left"], F.lit(22)).rlike(OWN), 8).otherwise(0)).alias("score"), (-x["i"]).alias("turn"), x["hit"].alias("email"))

    best = F.array_max(F.transform(contexts(text, EMAIL, 100, 60), points))
    return F.when(best["score"] >= 2, best["email"])
