"""Verification of proposed facts against their sources: a chain of rules, of which the first that fails names the verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import squeeze
from millrace.operators.gates import first_reason

#: Links, shell words and names of secrets, which no answer may hold.
UNSAFE = r"(?i)https?://|(curl|wget|sudo|rm -|chmod|bash|powershell)|api[_ -]?key|database_url|[.]env"


def numbers(c: Column) -> Column:
    """The different numbers of a text, with decimals; a digit right after a letter begins none."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(c, "[A-Za-z][0-9]", " "), F.lit("[0-9]+([.,][0-9]+)?"), F.lit(0)))


def allowed_host(url: Column, domains: Sequence[str]) -> Column:
    """Whether the link's host is one of the domains or a name under one; false for what is no link."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    ok = F.lit(False)
    for d in domains:
        ok = ok | (host == d) | host.endswith(f".{d}")
    return ok


def verdict(p: Mapping[str, Column], domains: Sequence[str], unsafe: str = UNSAFE) -> Column:
    """The first rule that a proposal breaks, else null.

    p: supported (boolean), url, excerpt, source_text, title, source_title, value, answer (strings), required, delivered, missing
    (arrays of names), academic_year, admission_year, semester, college, department (strings, null where the question
    has no such condition).  A null text is empty, a null array has no names; a proposal without a source text breaks the rule on excerpts.
    """
    none = F.array().cast("array<string>")
    text = {k: squeeze(F.coalesce(p[k], F.lit(""))) for k in ("excerpt", "source_text", "title", "source_title", "value", "answer")}
    names = {k: F.coalesce(p[k], none) for k in ("required", "delivered", "missing")}
    known = numbers(text["excerpt"])
    unknown = lambda c: F.size(F.array_except(numbers(text[c]), known)) > 0
    differs = lambda c: p[c].isNotNull() & ~F.contains(text["source_text"], squeeze(p[c]))
    return first_reason([
        ("unsupported", ~F.coalesce(p["supported"], F.lit(False))),
        ("unapproved_domain", ~allowed_host(p["url"], domains)),
        ("excerpt_not_in_source", p["source_text"].isNull() | ~F.contains(text["source_text"], text["excerpt"])),
        ("source_title_mismatch", text["title"] != text["source_title"]),
        ("fact_number_not_in_evidence", unknown("value")),
        ("answer_number_not_in_evidence", unknown("answer")),
        ("required_fact_unaccounted", F.size(F.array_except(F.array_except(names["required"], names["delivered"]), names["missing"])) > 0),
        *((f"{c}_mismatch", differs(c)) for c in ("academic_year", "admission_year", "semester", "college", "department")),
        ("unsafe_output", text["answer"].rlike(unsafe) | text["value"].rlike(unsafe)),
    ])
