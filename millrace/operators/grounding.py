"""Grounding: what a proposal says must stand in its source, or it goes.

All of it is column expressions on rows that hold a proposal beside its source text.  White space
never matters.  ``place`` maps what was found without white space back to the place in the text as it
is, so that a locator can name it.  The dates of a text are read once, in four spellings, as a set of
keys; a proposed date is looked up by its own two keys, whatever the number of proposals.

Defined results: null values are grounded (nothing is claimed), except for an excerpt, which must be
there; in a null or empty source nothing is grounded.  A longer number that begins with the day's does not
ground it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a date, titles behind a person's name, a telephone number.
LONG_KOREAN = r"([0-9]{4})\s*년\s*0?([0-9]{1,2})\s*월\s*0?([0-9]{1,2})\s*일"
LONG = r"([0-9]{4})\s*[./-]\s*0?([0-9]{1,2})\s*[./-]\s*0?([0-9]{1,2})"
SHORT_KOREAN = r"(?<![0-9])0?([0-9]{1,2})\s*월\s*0?([0-9]{1,2})\s*일"
SHORT = r"(?<![0-9])(?=0?([0-9]{1,2})\s*[./]\s*0?([0-9]{1,2})(?![0-9]))"
TITLES = "(주무관|교수|선생님|직원|팀장|센터장)$"
TELEPHONE = r"0[0-9]{1,2}[- )]?[0-9]{3,4}[- ]?[0-9]{4}"

_BLANK = r"[ \t\n\x0B\f\r]"


def bare(c: Column) -> Column:
    """Lower-cased, without white space."""
    return F.lower(F.regexp_replace(c, f"{_BLANK}+", ""))


def place(text: Column, excerpt: Column) -> Column:
    """struct<at, length>: where an excerpt stands in a text if white space and case are left aside, in characters of the text from 0; null if nowhere."""
    letters = F.regexp_replace(F.regexp_replace(excerpt, f"{_BLANK}+", ""), r"([^\p{L}\p{N}])", r"\\$1")
    pattern = F.concat(F.lit("(?iu)"), F.regexp_replace(letters, r"(\\?+.)(?=.)", rf"$1{_BLANK.replace(chr(92), chr(92) * 2)}*"))
    found = F.regexp_substr(text, pattern)
    return F.when((F.length(bare(excerpt)) > 0) & found.isNotNull(), F.struct((F.instr(text, found) - 1).alias("at"), F.length(found).alias("length")))


def date_keys(text: Column) -> Column:
    """The days that a text names, as keys y-m-d and, where it names no year, m-d; read once a text."""
    parts = lambda pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    joined = lambda size: lambda x: F.array_join(F.array(*(x[f"p{k}"].cast("int").cast("string") for k in range(1, size + 1))), "-")
    keys = []
    for pattern, size in ((LONG_KOREAN, 3), (LONG, 3), (SHORT_KOREAN, 2), (SHORT, 2)):
        numbers = F.arrays_zip(*(parts(pattern, k).alias(f"p{k}") for k in range(1, size + 1)))
        keys.append(F.transform(numbers, joined(size)))
    return F.array_distinct(F.concat(*keys))


def date_grounded(keys: Column, day: Column) -> Column:
    """Whether a moment's day is among the keys, with its year or without."""
    short = F.concat_ws("-", F.month(day), F.dayofmonth(day))
    return day.isNull() | F.coalesce(F.array_contains(keys, F.concat_ws("-", F.year(day), short)) | F.array_contains(keys, short), F.lit(False))


def phone_grounded(text: Column, phone: Column) -> Column:
    """Whether at least seven digits are claimed and stand in the text's digits in a row."""
    claimed, digits = (F.regexp_replace(c, "[^0-9]", "") for c in (phone, text))
    return phone.isNull() | F.coalesce((F.length(claimed) >= 7) & F.contains(digits, claimed), F.lit(False))


def email_grounded(text: Column, email: Column) -> Column:
    return email.isNull() | F.coalesce(F.contains(F.lower(text), F.lower(email)), F.lit(False))


def person_grounded(text: Column, person: Column) -> Column:
    """Whether the name, without a title behind it, has two characters and stands in the text."""
    name = F.regexp_replace(bare(person), TITLES, "")
    return person.isNull() | F.coalesce((F.length(name) >= 2) & F.contains(bare(text), name), F.lit(False))


def first_phone(phone: Column) -> Column:
    """Of a field that holds several numbers and words the first number, else its first fifty characters."""
    number = F.regexp_extract(phone, TELEPHONE, 0)
    return F.when(number != "", number).otherwise(F.left(phone, F.lit(50)))


def grounded(p: Mapping[str, Column], text: Column) -> dict[str, Column]:
    """The fields of a proposal as they may be kept, by name.

    p: excerpt, locator, start, end, phone, email, person, role (null where nothing is claimed) and
    confidence.  What the source does not have is null.  An excerpt that is not there, or a fact without
    a locator, caps the confidence at 0.5; anything refused caps it at 0.6 and asks for a review.
    """
    keys, claimed = date_keys(text), first_phone(p["phone"])
    at = place(text, p["excerpt"])
    ok = {
        "excerpt": at.isNotNull(), "start": date_grounded(keys, p["start"]), "end": date_grounded(keys, p["end"]),
        "phone": phone_grounded(text, claimed), "email": email_grounded(text, p["email"]), "person": person_grounded(text, p["person"]),
    }
    kept = {name: F.when(fine, claimed if name == "phone" else p[name]) for name, fine in ok.items()}
    kept["role"] = F.when(ok["person"], p["role"])
    weak = ~ok["excerpt"] | (F.coalesce(p["locator"], F.lit("")) == "")
    refused = weak
    for fine in ok.values():
        refused = refused | ~fine
    confidence = F.least(p["confidence"], F.when(weak, 0.5).when(refused, 0.6).otherwise(F.lit(1.0)))
    return kept | {"found": at, "needs_review": refused, "confidence": confidence}
