"""Gates of a search: rules, given as tables of terms, that shut candidates out or change their score.

Every function takes its rules as an argument, a sequence of tuples; such tables are small by nature and become
expressions of the plan.  Texts are expected lower-cased; a null text holds nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import compact

#: What a state adds to the score; what is over costs OVER more where the question is about the present.
STATUS = {"active": 0.15, "upcoming": 0.1, "always": 0.12, "unknown": 0.03, "expired": 0.0}
OVER, SPECIAL, SAME_CATEGORY, GUIDE = 0.3, 0.18, 0.25, 0.2


def groups_of(rules: DataFrame, most: int = 1000) -> list[tuple[str, tuple[str, ...]]]:
    """A rule table (name, term) as the groups that the functions here take, in order of name; more than ``most`` rows are an error."""
    rows = rules.select("name", "term").where("name is not null and term is not null").distinct().orderBy("name", "term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a rule table has at most {most} rows")
    groups: dict[str, list[str]] = {}
    for name, term in rows:
        groups.setdefault(name, []).append(term)
    return [(name, tuple(terms)) for name, terms in groups.items()]


def holds(text: Column, terms: Sequence[str]) -> Column:
    """Whether the text holds any of the terms."""
    return F.coalesce(reduce(Column.__or__, (text.contains(x) for x in terms), F.lit(False)), F.lit(False))


def group_bits(text: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """long: bit i is set if the text holds a term of group i (63 groups at most)."""
    if len(groups) > 63:
        raise ValueError("at most 63 groups")
    return reduce(Column.__add__, (F.when(holds(text, terms), F.lit(1 << i)).otherwise(0).cast("long") for i, (_, terms) in enumerate(groups)), F.lit(0).cast("long"))


def unasked(bits: Column, asked: Column) -> Column:
    """The groups of bits that the question does not name."""
    return bits.bitwiseAND(F.bitwise_not(asked))


def scope_rejected(text: Column, title: Column, asked: Column, general: Column) -> Column:
    """Bits of text, title and question: the text is for a group that was not asked for, and is not general, or the title names such a group."""
    return (unasked(title, asked) != 0) | ((unasked(text, asked) != 0) & ~general)


def source_rejected(source: Column, asks: Mapping[str, Column], rules: Sequence[tuple[str, str, str]]) -> Column:
    """rules (source, 'needs' or 'bars', ask): sources that serve only questions with that ask, or none with it."""
    return reduce(Column.__or__, (F.coalesce(source == s, F.lit(False)) & (~asks[ask] if kind == "needs" else asks[ask]) for s, kind, ask in rules), F.lit(False))


def identity_terms(keywords: Column, stopwords: Sequence[str]) -> Column:
    """Keywords that name something: as comparison keys, without stop words, years and single characters, each once."""
    keys = F.transform(keywords, compact)
    return F.array_distinct(F.filter(keys, lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords) & ~w.rlike("^20[0-9]{2}$")))


def identity_missed(terms: Column, title_key: Column) -> Column:
    """There are identity terms, and the title's comparison key holds none of them."""
    return (F.size(terms) > 0) & ~F.exists(terms, lambda w: F.contains(title_key, w))


def identity_share(terms: Column, title_key: Column) -> Column:
    """The share of the identity terms that the title's comparison key holds; 0 without terms."""
    return F.size(F.filter(terms, lambda w: F.contains(title_key, w))) / F.greatest(F.size(terms), F.lit(1))


def years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("20[0-9]{2}"), F.lit(0))


def year_of(question: Column) -> Column:
    """The year that a question asks about, else null."""
    return F.nullif(F.regexp_extract(question, "20[0-9]{2}", 0), F.lit("")).cast("int")


def year_missed(asked: Column, named: Column) -> Column:
    """A year is asked for, and the title names years but not that one."""
    return F.coalesce(asked.isNotNull() & (F.size(named) > 0) & ~F.array_contains(named, asked.cast("string")), F.lit(False))


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, else null."""
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in reasons))


def status_score(status: Column, current: Column) -> Column:
    points = reduce(lambda c, x: c.when(status == x[0], x[1]), STATUS.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return points - F.when(current & (status == "expired"), OVER).otherwise(0.0)
