"""Tasks, plans and routing (survey 2.13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from millrace.functions.text import lowered
from millrace.operators import tasks as K
from millrace.plans.inputs import HITS, QUESTIONS, REQUESTS, asked, questions, requests
from millrace.operators.rules import compiled
from millrace.operators.vectors import keyword_matches
from millrace.plans.registry import Tables, query
from millrace.plans.rule_tables import met_sql, rule_table

_RULES = "rules(key, parent, o) AS (VALUES " + ", ".join(f"('{k}', '{p}', {o})" for k, p, o, *_ in K.RULES) + ")"
_ALIASES = "aliases(key, o, a) AS (VALUES " + ", ".join(f"('{k}', {o}, '{a}')" for k, _, o, al, *_ in K.RULES for a in al) + ")"
DETECT = f"""{_RULES}, {_ALIASES},
held AS (SELECT doc_id, key, o, length(a) AS n FROM documents JOIN aliases ON contains(lower(text), a)),
first AS (SELECT doc_id, arg_max(key, (n, -o)) AS task FROM held GROUP BY 1)"""


@query(f"WITH {DETECT} SELECT doc_id, task FROM documents LEFT JOIN first USING (doc_id)")
def task_detect(t: Tables):
    """The task of the longest alias that a document holds; the earlier rule wins a tie."""
    return t.documents.select("doc_id", K.primary(F.lower("text")).alias("task"))


@query(f"""WITH {DETECT}, k AS (SELECT doc_id, string_agg(DISTINCT key, ',' ORDER BY key) AS keys, count(DISTINCT key) AS n FROM held GROUP BY 1)
SELECT d.doc_id, CASE WHEN n > 1 AND NOT contains(lower(text), ' than ') AND NOT contains(text, '%') THEN task ELSE coalesce(keys, '') END AS tasks FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN first USING (doc_id)""")
def task_detect_multi(t: Tables):
    low = F.lower("text")
    return t.documents.select("doc_id", F.array_join(K.multiple(low, low.contains(" than ") | low.contains("%")), ",").alias("tasks"))


def _eligible_sql() -> str:
    cases = {"bonus": [], "reason": []}
    for k, p, _, _, groups, excluded in K.RULES:
        barred = " OR ".join(f"contains(title, '{x}')" for x in excluded) or "false"
        complete = " AND ".join("(" + " OR ".join(f"contains(low, '{x}')" for x in g) + ")" for g in groups) or "true"
        cases["reason"].append(f"WHEN key = '{k}' AND ({barred}) THEN 'excluded_title' WHEN key = '{k}' AND NOT ({complete}) THEN 'missing_terms' WHEN key = '{k}' AND task = '{k}' THEN 'task' WHEN key = '{k}' AND task LIKE '{p}.%' THEN 'parent' WHEN key = '{k}' THEN 'terms'")
    return f"""d AS (SELECT d.doc_id, lower(text) AS low, lower(substr(text, 1, 60)) AS title, task FROM documents d LEFT JOIN first USING (doc_id)),
r AS (SELECT doc_id, key AS asked, CASE {' '.join(cases['reason'])} ELSE 'no_task' END AS reason FROM d CROSS JOIN rules)"""


ELIGIBLE = _eligible_sql()


@query(f"""WITH {DETECT}, {ELIGIBLE}
SELECT doc_id, asked, reason, CASE reason WHEN 'task' THEN 0.45::DOUBLE WHEN 'parent' THEN 0.35::DOUBLE WHEN 'terms' THEN 0.12::DOUBLE ELSE 0::DOUBLE END AS bonus FROM r""")
def task_eligibility(t: Tables):
    """Every document against every task of the rule table: bonus and reason."""
    low = t.documents.select("doc_id", F.lower("text").alias("low"), F.lower(F.substring("text", 1, 60)).alias("title"), F.explode(K.rule_keys()).alias("asked"))
    bonus, reason = K.eligibility(F.col("asked"), F.col("title"), F.col("low"))
    return low.select("doc_id", "asked", reason.alias("reason"), bonus.alias("bonus"))


@query("""WITH x AS (SELECT conv_id, turn, text, contains(text, '@') AS contact, regexp_matches(text, '(?i) the | der | le ') AS common, length(text) < 40 AS short FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN contact THEN 'in_scope' WHEN short THEN 'out_of_scope' WHEN common THEN 'search_first' ELSE 'in_scope' END AS scope, CASE WHEN contact THEN 0.95::DOUBLE WHEN short THEN 0.8::DOUBLE WHEN common THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM x""")
def scope_route(t: Tables):
    """In scope, to be searched first, or out of scope."""
    rules = compiled(rule_table(t))
    said = t.conversations.where("role = 'user'").withColumn("b", rules.read(F.col("text")))
    contact, common, short = rules.holds(F.col("b"), "scope.contact"), rules.holds(F.col("b"), "scope.search"), F.length("text") < 40
    return said.select("conv_id", "turn", F.when(contact, "in_scope").when(short, "out_of_scope").when(common, "search_first").otherwise("in_scope").alias("scope"), F.when(contact, 0.95).when(short, 0.8).when(common, 0.6).otherwise(0.5).alias("confidence"))


#: The tasks of questions, after aliases.
ASKED_TASK = """qt AS (SELECT item_id, arg_max(key, (length(a), -o)) AS task FROM benchmark JOIN aliases ON contains(lower(text), a) GROUP BY 1)"""


@query(f"""WITH {QUESTIONS}, {_ALIASES}, {ASKED_TASK}, k AS (SELECT item_id, string_agg(w, ' ' ORDER BY r) AS keywords, count(*) AS n FROM qkw GROUP BY 1)
SELECT item_id, coalesce(keywords, '') AS keywords, task, coalesce(n, 0) < 4 AS needs_clarification, CASE WHEN task IS NOT NULL AND n >= 4 THEN 0.9::DOUBLE WHEN task IS NOT NULL THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM benchmark LEFT JOIN k USING (item_id) LEFT JOIN qt USING (item_id)""")
def query_plan(t: Tables):
    """A question's plan: keywords, task, whether it must be clarified, confidence."""
    task = K.primary(F.lower("question"))
    plan = questions(t).select("item_id", F.array_join("keywords", " ").alias("keywords"), task.alias("task"), F.size("keywords").alias("n"))
    sure = F.when(F.col("task").isNotNull() & (F.col("n") >= 4), 0.9).when(F.col("task").isNotNull(), 0.7).otherwise(0.4)
    return plan.select("item_id", "keywords", "task", (F.col("n") < 4).alias("needs_clarification"), sure.alias("confidence"))


@query(f"""WITH {REQUESTS}, p AS (SELECT event_id, session, event_type, k, value, lead(event_type) OVER (PARTITION BY session ORDER BY ts, event_id) AS other, lead(k) OVER (PARTITION BY session ORDER BY ts, event_id) AS ok, lead(value) OVER (PARTITION BY session ORDER BY ts, event_id) AS ov FROM requests)
SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type ELSE other END AS task, array_to_string(list_distinct_sorted, ',') AS fields, least(value, ov) AS confidence FROM (SELECT *, list_sort(list_distinct(list_filter([event_type, other, CASE WHEN k > 50 THEN 'late' END], lambda x: x IN ('view', 'click', 'late')))) AS list_distinct_sorted FROM p WHERE other IS NOT NULL)""")
def plan_merge(t: Tables):
    """A rule plan and a model plan: the rule wins where it says something, fields are united and allowed ones kept, the lesser confidence counts."""
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    p = requests(t).select("event_id", "event_type", "k", "value", F.lead("event_type").over(w).alias("other"), F.lead("value").over(w).alias("ov")).where("other IS NOT NULL")
    fields = F.array_intersect(F.array_union(F.array("event_type"), F.array_compact(F.array("other", F.when(F.col("k") > 50, "late")))), F.array(*map(F.lit, ("view", "click", "late"))))
    return p.select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(F.col("other")).alias("task"), F.array_join(F.array_sort(fields), ",").alias("fields"), F.least("value", "ov").alias("confidence"))


@query(f"""WITH said AS (SELECT conv_id, turn AS place, text FROM conversations), {met_sql("field", "said", "conv_id, place")}, x AS (SELECT conv_id, place, string_agg(substr(rule, 7), ',' ORDER BY turn) AS fields FROM met GROUP BY ALL)
SELECT conv_id, place AS turn, coalesce(fields, '') AS fields FROM said LEFT JOIN x USING (conv_id, place)""")
def requested_fields(t: Tables):
    """Fields whose vocabulary a turn uses, in the order of the rules."""
    rules = compiled(rule_table(t))
    read = t.conversations.select("conv_id", "turn", rules.read(F.col("text")).alias("b"))
    return read.select("conv_id", "turn", F.array_join(rules.all(F.col("b"), "field."), ",").alias("fields"))


@query("SELECT conv_id, turn, turn > 0 AND (regexp_matches(text, '^(?i:and|und|et|y|of|in) ') OR (length(text) <= 28 AND contains(text, ' '))) AS followup FROM conversations")
def followup_flag(t: Tables):
    """A turn that leans on the one before: a linking first word, or a short text."""
    text = F.col("text")
    return t.conversations.select("conv_id", "turn", ((F.col("turn") > 0) & (text.rlike("^(?i:and|und|et|y|of|in) ") | ((F.length(text) <= 28) & text.contains(" ")))).alias("followup"))


@query("""WITH q AS (SELECT item_id, replace(lower(text), ' ', '') AS q, length(text) AS n FROM benchmark), d AS (SELECT doc_id, replace(lower(text), ' ', '') AS x FROM documents)
SELECT doc_id, min(item_id) AS faq FROM d JOIN q ON n >= 5 AND contains(x, q) GROUP BY 1""")
def faq_match(t: Tables):
    """The first question, in table order, that a document holds, blanks aside."""
    from millrace.operators.blocking import containment

    docs = t.documents.select("doc_id", F.lower("text").alias("low"), F.replace(F.lower("text"), F.lit(" "), F.lit("")).alias("x"))
    asked = t.benchmark.where(F.length("text") >= 5).select("item_id", F.lower("text").alias("q_low"), F.replace(F.lower("text"), F.lit(" "), F.lit("")).alias("q"))
    return containment(docs, asked, "x", "q").groupBy("doc_id").agg(F.min("item_id").alias("faq"))


@query(f"""WITH {HITS}, {DETECT}, s AS (SELECT item_id, doc_id, task, hits FROM hits JOIN first USING (doc_id))
SELECT item_id, task, doc_id, hits FROM s QUALIFY row_number() OVER (PARTITION BY item_id, task ORDER BY hits DESC, doc_id) = 1""")
def multi_task_fanout(t: Tables):
    """For each question and task the best document of that task."""
    low, title = lowered(F.col("text")), lowered(F.substring("text", 1, 60))
    tasked = t.documents.select("doc_id", low.alias("text"), title.alias("title"), K.primary(F.lower("text")).alias("task")).where("task is not null")
    return K.best_per_task(keyword_matches(tasked, asked(t), ["doc_id", "task"], vectors=False), "item_id", "task", "hits", "doc_id")
