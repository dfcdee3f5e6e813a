"""The rules that the queries use, as rows (rule, kind, term, turn): data, which a caller would read from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.plans.registry import Tables


def _rows(rule: str, turn: int, **kinds: str) -> list[tuple[str, str, str, int]]:
    return [(rule, kind, term, turn) for kind, terms in kinds.items() for term in terms.split("|")]


ROWS = [
    # an action with an intent, unless the context is benign and nothing is hidden; reports of harm
    *_rows("harm.act", 0, any_action="worthless|stupid|delete", any_intent=" the | der | le "),
    *_rows("harm.benign", 1, any="please|question"),
    *_rows("harm.hidden", 2, any="hide|secret"),
    *_rows("harm.report", 3, any_action="worthless|stupid|delete", any_context="report|complain"),
    # special groups, of which a text may speak although nobody asked
    *_rows("group.staff", 10, any="staff|personal|personnel"),
    *_rows("group.writers", 11, any="author|licensed"),
    *_rows("group.owners", 12, any="token|password"),
    *_rows("group.english", 13, any=" the "),
    *_rows("general", 14, any="general|everyone"),
    # the role of a document
    *_rows("role.canonical", 20, any="licensed", **{"not": "released"}),
    *_rows("role.special", 21, any="token =", **{"not": "licensed"}),
    *_rows("role.contact", 22, any="@", **{"not": "token ="}),
    # what a turn asks for, by its vocabulary in four languages
    *_rows("field.contact", 30, any="@|phone|contact|kontakt|contacto"),
    *_rows("field.method", 31, any=" how | wie | comment | cómo | with | mit | avec | con "),
    *_rows("field.period", 32, any=" when | wann | quand | cuándo | until | bis "),
    *_rows("field.place", 33, any=" where | wo | où | dónde | in | en | dans "),
    *_rows("field.reason", 34, any=" why | warum | pourquoi | para | for | pour | für "),
    # whether a question is for this collection
    *_rows("scope.contact", 40, any="@"),
    *_rows("scope.search", 41, any=" the | der | le "),
]


def rule_table(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(ROWS, "rule string, kind string, term string, turn int")


def values_sql(prefix: str) -> str:
    """The rows of the rules under a prefix as a VALUES list for DuckDB: (rule, kind, term, turn)."""
    rows = (f"('{r}', '{k}', '{t.lower()}', {n})" for r, k, t, n in ROWS if r.startswith(prefix))
    return "rules(rule, kind, term, turn) AS (VALUES " + ", ".join(rows) + ")"


def met_sql(prefix: str, table: str, key: str, text: str = "text") -> str:
    """CTEs: ``met`` (key, rule, turn) of the rules under a prefix that a table's texts meet."""
    return f"""{values_sql(prefix)}, groups AS (SELECT rule, turn, count(DISTINCT kind) FILTER (kind LIKE 'any%') AS needed FROM rules GROUP BY ALL),
found AS (SELECT {key}, rule, kind FROM {table} JOIN rules ON contains(lower(coalesce({text}, '')), term) GROUP BY ALL),
met AS (SELECT {key}, rule, turn FROM found JOIN groups USING (rule) GROUP BY ALL HAVING count(*) FILTER (kind LIKE 'any%') = any_value(needed) AND count(*) FILTER (kind LIKE 'not%') = 0)"""
