"""Task detection by alias dimensions, and routing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.nested import canonical_json, folded
from millrace.functions.text import normalize
from millrace.operators.gates import holds

#: A rule dimension: key, parent, order, aliases, groups of which one term each is required, excluded title terms.
RULES = (
    ("license.use", "license", 0, ("licensed under", "released under"), (("license", "licence", "cc by"),), ("draft",)),
    ("license.gpl", "license", 1, ("general public license",), (("gnu", "version 3"),), ()),
    ("secret.token", "secret", 2, ("token =",), (("token",), ("=",)), ("example",)),
    ("contact.mail", "contact", 3, ("@mail",), (("@",), (".com", ".org")), ()),
    ("table.row", "layout", 4, (" | ",), (("|",),), ()),
    ("text.english", "text", 5, (" the ", " of "), (("the", "of"),), ()),
    ("text.german", "text", 6, (" der ", " die "), (("der", "die", "und"),), ()),
)


def matches(text: Column, rules=RULES) -> Column:
    """array<struct<n, o, key>> of the aliases that the text holds; the largest is the longest alias, then the earlier rule."""
    found = [F.when(text.contains(a), F.struct(F.lit(len(a)).alias("n"), F.lit(-o).alias("o"), F.lit(k).alias("key"))) for k, _, o, aliases, _, _ in rules for a in aliases]
    return F.array_compact(F.array(*found))


def primary(text: Column, rules=RULES) -> Column:
    return F.array_max(matches(text, rules))["key"]


def multiple(text: Column, marker: Column, rules=RULES) -> Column:
    """All keys, in order; only the primary one if there are several and the text makes no comparison."""
    keys = F.array_sort(F.array_distinct(F.transform(matches(text, rules), lambda x: x["key"])))
    return F.when((F.size(keys) > 1) & ~marker, F.array(primary(text, rules))).otherwise(keys)


def bar(title: Column, text: Column, rule: tuple) -> Column:
    """Why a rule's task does not take a document: excluded_title or missing_terms, else null."""
    _, _, _, _, groups, excluded = rule
    complete = F.lit(True)
    for group in groups:
        complete = complete & holds(text, group)
    return F.when(holds(title, excluded), "excluded_title").when(~complete, "missing_terms")


def bars(title: Column, text: Column, rules=RULES) -> Column:
    """string: for each rule, in order, one character that says whether its task takes the document: o, or e and m by bar()."""
    return F.concat(*(F.coalesce(F.substring(bar(title, text, r), 1, 1), F.lit("o")) for r in rules))


def judged(task: Column, held: Column, barred: Column, rules=RULES) -> tuple[Column, Column]:
    """(bonus, reason) for a task of a document that holds the task ``held`` and has these bars(); 0 and no_task for an unknown task."""
    bonus, reason = F.lit(0.0), F.lit("no_task")
    for i, (key, parent, *_) in enumerate(rules):
        at, own, near = F.substring(barred, i + 1, 1), held == key, F.coalesce(held, F.lit("")).startswith(f"{parent}.")
        value = F.when(at != "o", 0.0).when(own, 0.45).when(near, 0.35).otherwise(0.12)
        why = F.when(at == "e", "excluded_title").when(at == "m", "missing_terms").when(own, "task").when(near, "parent").otherwise("terms")
        bonus, reason = F.when(task == key, value).otherwise(bonus), F.when(task == key, why).otherwise(reason)
    return bonus, reason


def eligibility(task: Column, title: Column, text: Column, rules=RULES) -> tuple[Column, Column]:
    """(bonus, reason) of a document for a task: excluded title, missing group, else own task, own parent, other."""
    return judged(task, primary(text, rules), bars(title, text, rules), rules)


def parent_of(task: Column, rules=RULES) -> Column:
    return F.coalesce(*(F.when(task == key, F.lit(parent)) for key, parent, *_ in rules))


def rule_keys() -> Column:
    return F.array(*(F.lit(r[0]) for r in RULES))


def best_per_task(rows: DataFrame, query: str, task: str, score: str, doc: str) -> DataFrame:
    """One row for each query and task: the best document, then the least id.

    The least id of each score comes first: numbers are combined in a hash table, whereas max_by of a struct sorts all rows.
    """
    firsts = rows.groupBy(query, task, score).agg(F.min(doc).alias(doc))
    return firsts.groupBy(query, task).agg(F.max_by(F.struct(doc, score), F.struct(score, (-F.col(doc)).alias("i"))).alias("x")).select(query, task, "x.*")


# How long an answer is kept, in minutes, by what it is about.
UNSUPPORTED, EVENT, DATED, WEEK, MONTH = 45, 360, 720, 10_080, 43_200
PERIOD_FIELDS = ("applicationPeriod", "application_period")


def time_to_live(task: Column, fields: Column, supported: Column) -> Column:
    """Minutes for which an answer is kept: short where nothing was found or dates matter, a month for requirements, else a week.

    A null task is none, null fields are no fields, and a null ``supported`` is no.
    """
    task, fields = F.coalesce(task, F.lit("")), F.coalesce(fields, F.array().cast("array<string>"))
    dated = task.startswith("course.") | task.startswith("tuition.") | F.arrays_overlap(fields, F.array(*map(F.lit, PERIOD_FIELDS)))
    ttl = F.when(~F.coalesce(supported, F.lit(False)), UNSUPPORTED).when(F.coalesce(dated, F.lit(False)), DATED).when(task.startswith("event."), EVENT)
    return ttl.when(F.array_contains(fields, "department_contact"), WEEK).when(task == "graduation.requirements", MONTH).otherwise(WEEK)


def condition(c: Column) -> Column:
    """A condition as keys hold it: cleaned, without white space, folded; empty is null."""
    return F.nullif(folded(F.regexp_replace(normalize(c), r"[ \t\n\x0B\f\r]+", "")), F.lit(""))


#: The conditions that are compared as words, and those that are sets.
WORDS = ("category", "college", "department", "studentStatus", "timeScope")
SETS = ("requestedFields", "requiredFacts")


def canonical_key(plan: Mapping[str, Column], kinds: Mapping[str, T.DataType]) -> Column:
    """The digest of a question's conditions: compact JSON with sorted keys, nulls written.

    plan: task, tasks, academicYear, admissionYear, semester, grade, the WORDS, the SETS, keywords; kinds: their
    types by name.  Sets are deduplicated and sorted, tasks sorted; a single task stands in for a
    missing one; keywords count for tasks of ``event.`` only, where the name of the event tells
    questions apart.
    """
    task = F.coalesce(plan["task"], F.when(F.size(plan["tasks"]) == 1, plan["tasks"][0]))
    named = F.array_sort(F.array_distinct(F.array_compact(F.transform(plan["keywords"], condition))))
    payload = {n: plan[n] for n in ("academicYear", "admissionYear", "semester", "grade")} | {n: condition(plan[n]) for n in WORDS} | {n: F.array_sort(F.array_distinct(plan[n])) for n in SETS}
    payload |= {"task": task, "tasks": F.array_sort(plan["tasks"]), "eventKeywords": F.when(F.coalesce(task.startswith("event."), F.lit(False)), named).otherwise(F.array().cast("array<string>"))}
    lists, own = (*SETS, "tasks", "eventKeywords"), ("academicYear", "admissionYear", "semester", "grade")
    schema = T.StructType([T.StructField(n, kinds[n] if n in own else T.ArrayType(T.StringType()) if n in lists else T.StringType()) for n in payload])
    return F.sha2(canonical_json(F.struct(*(c.alias(n) for n, c in payload.items())), schema), 256)
