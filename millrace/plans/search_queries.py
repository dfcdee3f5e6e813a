"""Hybrid search and ranking over batches of questions (survey 2.14, 2.6 to 2.8 on candidates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.status import freshness, period_status
from millrace.functions.text import compact, lowered
from millrace.operators import gates as G
from millrace.operators import ranking as R
from millrace.operators import tasks as K
from millrace.operators.vectors import keyword_matches
from millrace.plans.inputs import AS_OF_DOCS, HITS, NOTICES, asked, keyword_hits, notices, questions, stamp
from millrace.plans.registry import Tables, query
from millrace.plans.task_queries import ASKED_TASK, DETECT, ELIGIBLE
from millrace.plans.vector_queries import DOC_VECTORS, ITEM_VECTORS


@query(f"WITH {HITS} SELECT item_id, doc_id, round(least(hits / greatest(n, 1)::DOUBLE, 1), 6) AS coverage, round(least(title_hits / greatest(n, 1)::DOUBLE, 1), 6) AS title_coverage FROM hits")
def keyword_coverage(t: Tables):
    """The share of a question's keywords in text and title of each document that has any."""
    n = F.greatest("n", F.lit(1))
    return keyword_hits(t).select("item_id", "doc_id", F.round(F.least(F.col("hits") / n, F.lit(1.0)), 6).alias("coverage"), F.round(F.least(F.col("title_hits") / n, F.lit(1.0)), 6).alias("title_coverage"))


# The rules of this collection: groups of readers, what makes a text general, what questions ask, which sources serve
# what, guides, and tasks whose questions name something.
READERS = (("erbe", ("erbe",)), ("mente", ("mente",)), ("shha", ("shha", "enchè")))
GENERAL = ("general", "version")
ASKS = {"contact": ("hand",), "procedure": ("ionth", "stly"), "current": ("heron", "tion")}
SOURCES = (("src0", "needs", "contact"), ("src1", "bars", "procedure"))
GUIDES = ("src5", "src7")
#: Sources whose age counts, and those that are written for a year.
NEWS, CATALOGUES = ("src0", "src2", "src4"), ("src3",)
NAMED_TASKS, COMMON = ("text.german", "license.use"), ("der", "die", "und", "the", "of")
OPEN_DAYS = 90


#: The weight of vectors that are made of words; vectors of a model would weigh 0.18.
LEXICAL = 0.05


def notice_score(bonus: Column) -> Column:
    """The weighted sum of a candidate's parts, rounded to 5 digits."""
    n = F.greatest("n", F.lit(1))
    source = F.least(F.greatest(F.col("source_priority"), F.lit(0)), F.lit(120)) / F.lit(120.0) * 0.2
    category = F.when(F.col("category") == F.col("asks_category"), G.SAME_CATEGORY).otherwise(0.0)
    fresh = F.when(F.col("current") & F.col("source_type").isin(*NEWS), freshness(F.col("published_at"), stamp(AS_OF_DOCS))).otherwise(0.0)
    guide = F.when(F.col("procedure") & F.col("source_type").isin(*GUIDES), G.GUIDE).otherwise(0.0)
    special = F.bit_count(G.unasked(F.col("title_readers"), F.col("asks_readers"))) * F.lit(G.SPECIAL)
    year = F.when(F.col("asks_year") == F.year("published_at"), 0.1).otherwise(0.0)
    named = F.col("identity") * F.when(F.size("named") > 0, 0.9).otherwise(0.0)
    return R.rounded(
        F.col("vector") * LEXICAL + F.col("hits") / n * 0.32 + F.col("title_hits") / n * 0.30 + category + year + G.status_score(F.col("status"), F.col("current")) + fresh + source + guide + bonus - special + named
    )


def asks(t: Tables) -> DataFrame:
    """What is to be known of each question beside its words, a row each."""
    low = F.lower("question")
    flags = [G.holds(low, terms).alias(name) for name, terms in ASKS.items()]
    task = K.primary(low)
    named = F.when(task.isin(*NAMED_TASKS), G.identity_terms(F.col("keywords"), COMMON)).otherwise(F.array().cast("array<string>"))
    return questions(t).select("item_id", task.alias("asks_task"), K.parent_of(task).alias("asks_category"), G.group_bits(low, READERS).alias("asks_readers"), named.alias("named"), G.year_of(low).alias("asks_year"), *flags)


def candidates(t: Tables, visible: bool = False) -> DataFrame:
    """(item_id, doc_id, hits, vector, score, gate, ...): documents that share a keyword with a question, scored.

    gate is the first rule that shuts the candidate out, else null.  Everything about a document joins it before the
    pass over all documents, and what is known of questions is joined by its size, so pairs are not shuffled.
    """
    meta = notices(t).where("processed") if visible else notices(t)
    carry = ["doc_id", "source_id", "source_type", "source_priority", "published_at", "quality", "lang", "processed"]
    low, title = F.col("text"), F.col("title")
    until = F.timestamp_add("DAY", F.lit(OPEN_DAYS), F.col("published_at"))
    told = {
        "status": period_status(F.col("published_at"), until, stamp(AS_OF_DOCS)), "task": K.primary(low), "barred": K.bars(title, low),
        "readers": G.group_bits(low, READERS), "title_readers": G.group_bits(title, READERS), "general": G.holds(low, GENERAL), "title_years": G.years(title), "title_key": compact(title),
    }
    # each step in columns of its own: the lower-cased text and the task, which many rules ask for, are worked out once
    docs = meta.select(*carry, lowered(F.col("content")).alias("text"), lowered(title).alias("title")).withColumns(told).withColumn("category", K.parent_of(F.col("task")))
    pairs = keyword_matches(docs, asked(t), [*carry, *told, "category"]).join(asks(t), "item_id")
    bonus, reason = K.judged(F.col("asks_task"), F.col("task"), F.col("barred"))
    pairs = pairs.withColumn("identity", G.identity_share(F.col("named"), F.col("title_key"))).withColumn("exact_task", F.coalesce(reason == "task", F.lit(False)))
    gate = G.first_reason([
        ("year", G.year_missed(F.col("asks_year"), F.col("title_years"))),
        ("source_type", G.source_rejected(F.col("source_type"), {a: F.col(a) for a in ASKS}, SOURCES)),
        ("special_group", G.scope_rejected(F.col("readers"), F.col("title_readers"), F.col("asks_readers"), F.col("general"))),
        ("identity", G.identity_missed(F.col("named"), F.col("title_key"))),
        ("task", F.col("asks_task").isNotNull() & reason.isin("excluded_title", "missing_terms")),
    ])
    return pairs.withColumn("gate", gate).withColumn("score", notice_score(bonus))


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in terms) + ")"


_ASKS = ", ".join(f"{_any('lower(text)', terms)} AS {name}" for name, terms in ASKS.items())
_SCOPE = " OR ".join(f"(NOT {_any('q', x)} AND ({_any('lower(title)', x)} OR ({_any('lower(content)', x)} AND NOT {_any('lower(content)', GENERAL)})))" for _, x in READERS)
_SPECIAL = " + ".join(f"(CASE WHEN {_any('lower(title)', x)} AND NOT {_any('q', x)} THEN 1 ELSE 0 END)" for _, x in READERS)
_SOURCE = " OR ".join(f"(source_type = '{s}' AND {'NOT ' if kind == 'needs' else ''}{ask})" for s, kind, ask in SOURCES)
_IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_NAMED = f"(asks_task IN {_IN(NAMED_TASKS)} AND len(named) > 0)"
_SHARE = f"(CASE WHEN {_NAMED} THEN len(list_filter(named, lambda x: contains(regexp_replace(lower(title), '[^0-9a-z가-힣]+', '', 'g'), x))) / len(named)::DOUBLE ELSE 0 END)"
_SCORE = f"""round(vector * {LEXICAL}::DOUBLE + hits / greatest(n, 1)::DOUBLE * 0.32::DOUBLE + title_hits / greatest(n, 1)::DOUBLE * 0.30::DOUBLE + CASE WHEN category = asks_category THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN asks_year = year(published_at) THEN 0.1::DOUBLE ELSE 0 END + (CASE status WHEN 'active' THEN 0.15::DOUBLE WHEN 'upcoming' THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN current AND status = 'expired' THEN 0.3::DOUBLE ELSE 0 END)
  + CASE WHEN current AND source_type IN {_IN(NEWS)} THEN greatest(0::DOUBLE, 1 - date_diff('day', published_at, TIMESTAMP '{AS_OF_DOCS}') / 365::DOUBLE) * 0.12::DOUBLE ELSE 0 END + least(greatest(source_priority, 0), 120) / 120::DOUBLE * 0.2::DOUBLE
  + CASE WHEN procedure AND source_type IN {_IN(GUIDES)} THEN 0.2::DOUBLE ELSE 0 END + CASE reason WHEN 'task' THEN 0.45::DOUBLE WHEN 'parent' THEN 0.35::DOUBLE WHEN 'terms' THEN 0.12::DOUBLE ELSE 0 END - ({_SPECIAL}) * 0.18::DOUBLE + {_SHARE} * CASE WHEN {_NAMED} THEN 0.9::DOUBLE ELSE 0 END, 5)"""
_YEARS = "regexp_extract_all(lower(title), '20[0-9]{2}')"
_GATE = f"""CASE WHEN asks_year IS NOT NULL AND len({_YEARS}) > 0 AND NOT list_contains({_YEARS}, asks_year::VARCHAR) THEN 'year' WHEN {_SOURCE} THEN 'source_type' WHEN {_SCOPE} THEN 'special_group'
  WHEN asks_task IN {_IN(NAMED_TASKS)} AND len(named) > 0 AND len(list_filter(named, lambda x: contains(regexp_replace(lower(title), '[^0-9a-z가-힣]+', '', 'g'), x))) = 0 THEN 'identity'
  WHEN reason IN ('excluded_title', 'missing_terms') THEN 'task' END"""
CAND = f"""{HITS}, {NOTICES}, {ITEM_VECTORS}, {DOC_VECTORS}, dots AS (SELECT item_id, doc_id, round(sum(d.weight * q.weight), 6) AS vector FROM dv d JOIN qv q USING (idx) GROUP BY ALL), {DETECT}, {ELIGIBLE}, {ASKED_TASK},
qa AS (SELECT item_id, lower(text) AS q, qt.task AS asks_task, rules.parent AS asks_category, try_cast(nullif(regexp_extract(lower(text), '20[0-9]{{2}}'), '') AS INTEGER) AS asks_year, {_ASKS} FROM benchmark LEFT JOIN qt USING (item_id) LEFT JOIN rules ON rules.key = qt.task),
qi AS (SELECT item_id, list(DISTINCT w) AS named FROM (SELECT item_id, regexp_replace(w, '[^0-9a-z가-힣]+', '', 'g') AS w FROM qkw) WHERE length(w) >= 2 AND w NOT IN {_IN(COMMON)} AND NOT regexp_matches(w, '^20[0-9][0-9]$') GROUP BY 1),
pairs AS (SELECT h.item_id, h.doc_id, n, hits, title_hits, coalesce(vector, 0) AS vector, x.* EXCLUDE (doc_id), qa.* EXCLUDE (item_id), coalesce(named, []) AS named, rules.parent AS category, r.reason,
  CASE WHEN published_at > TIMESTAMP '{AS_OF_DOCS}' THEN 'upcoming' WHEN published_at + to_days({OPEN_DAYS}) < TIMESTAMP '{AS_OF_DOCS}' THEN 'expired' ELSE 'active' END AS status
  FROM hits h JOIN notices x ON x.doc_id = h.doc_id JOIN qa ON qa.item_id = h.item_id LEFT JOIN qi ON qi.item_id = h.item_id LEFT JOIN dots ON dots.item_id = h.item_id AND dots.doc_id = h.doc_id
  LEFT JOIN first ON first.doc_id = h.doc_id LEFT JOIN rules ON rules.key = first.task LEFT JOIN r ON r.doc_id = h.doc_id AND r.asked = qa.asks_task),
cand AS (SELECT *, {_SCORE} AS score, {_GATE} AS gate FROM pairs)"""
TIER = f"CASE WHEN procedure AND source_type IN {_IN(GUIDES)} AND reason = 'task' THEN 4 WHEN {_NAMED} AND {_SHARE} >= 0.5 THEN 3 WHEN source_type IN {_IN(CATALOGUES)} AND list_contains({_YEARS}, asks_year::VARCHAR) THEN 2 WHEN reason = 'task' THEN 1 ELSE 0 END"
PLACED = CAND + f", placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {TIER} DESC, score DESC, source_priority DESC, published_at DESC, doc_id) AS place FROM cand WHERE processed AND gate IS NULL AND score >= 0.34)"


@query(f"WITH {CAND} SELECT item_id, doc_id, score FROM cand")
def hybrid_score_notice(t: Tables):
    """The full score of every candidate."""
    return candidates(t).select("item_id", "doc_id", "score")


def tier() -> Column:
    """How hard a candidate matches: the guide to what is asked, a title with half of what the question names, the catalogue of its year, its task, others."""
    guide = F.col("procedure") & F.col("source_type").isin(*GUIDES) & F.col("exact_task")
    cohort = F.col("source_type").isin(*CATALOGUES) & F.coalesce(F.array_contains("title_years", F.col("asks_year").cast("string")), F.lit(False))
    return F.when(guide, 4).when((F.size("named") > 0) & (F.col("identity") >= 0.5), 3).when(cohort, 2).when(F.col("exact_task"), 1).otherwise(0)


def placed(t: Tables, limit: int = 1 << 30) -> DataFrame:
    """Visible candidates over the threshold with their place: by tier, then score, priority, date, id."""
    rows = candidates(t, visible=True).where(F.col("gate").isNull() & (F.col("score") >= R.THRESHOLD))
    return R.top(rows, "item_id", [tier().desc(), F.desc("score"), F.desc("source_priority"), F.desc("published_at"), F.col("doc_id")], limit)


@query(f"WITH {PLACED} SELECT item_id, doc_id, source_id, score, place, {TIER} AS tier, CASE WHEN hits = n THEN 'all_keywords' WHEN title_hits > 0 THEN 'title' ELSE 'keywords' END AS reason FROM placed WHERE place <= 5")
def hybrid_topk(t: Tables):
    """The five best documents for each question, with the reason."""
    reason = F.when(F.col("hits") == F.col("n"), "all_keywords").when(F.col("title_hits") > 0, "title").otherwise("keywords")
    return placed(t, 5).select("item_id", "doc_id", "source_id", "score", "place", tier().alias("tier"), reason.alias("reason"))


@query(f"""WITH {HITS}, {NOTICES}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
u AS (SELECT item_id, doc_id, line_no, n, count(*) AS k FROM l JOIN qkw ON contains(lower(line), w) JOIN qn USING (item_id) GROUP BY ALL), p AS (SELECT o_orderkey, o_orderdate FROM orders)
SELECT u.item_id, u.doc_id, line_no::INTEGER AS line_no, round(k / u.n::DOUBLE * 0.25::DOUBLE + title_hits / u.n::DOUBLE * 0.22::DOUBLE + least(greatest(source_priority, 0), 120) / 120::DOUBLE * 0.2::DOUBLE + CASE WHEN o_orderdate > TIMESTAMP '1998-09-01' THEN 0.1::DOUBLE WHEN o_orderdate IS NULL THEN 0::DOUBLE ELSE -0.1::DOUBLE END + CASE WHEN k = u.n THEN 0.85::DOUBLE WHEN line_no = 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END, 5) AS score
FROM u JOIN hits h ON h.item_id = u.item_id AND h.doc_id = u.doc_id JOIN notices x ON x.doc_id = u.doc_id LEFT JOIN p ON o_orderkey = u.doc_id""")
def hybrid_score_unit(t: Tables):
    """Lines as units: coverage in line and title, source, the state of the period with the same key, and a bonus for what is canonical."""
    units = notices(t).select("doc_id", "content", "source_priority", lowered(F.col("title")).alias("title")).join(t.orders.select(F.col("o_orderkey").alias("doc_id"), "o_orderdate"), "doc_id", "left")
    lines = units.select("doc_id", "o_orderdate", "source_priority", "title", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).where("line <> ''")
    rows = lines.withColumn("text", F.lower("line"))
    u = keyword_matches(rows, asked(t), ["doc_id", "line_no", "o_orderdate", "source_priority"], vectors=False).withColumnRenamed("hits", "k")
    state = F.when(F.col("o_orderdate") > stamp("1998-09-01 00:00:00"), 0.1).when(F.col("o_orderdate").isNull(), 0.0).otherwise(-0.1)
    bonus = F.when(F.col("k") == F.col("n"), 0.85).when(F.col("line_no") == 0, 0.2).otherwise(0.0)
    source = F.least(F.greatest(F.col("source_priority"), F.lit(0)), F.lit(120)) / F.lit(120.0) * 0.2
    return u.select("item_id", "doc_id", "line_no", R.rounded(F.col("k") / F.col("n") * 0.25 + F.col("title_hits") / F.col("n") * 0.22 + source + state + bonus).alias("score"))


_WHY = "CASE WHEN NOT processed THEN 'not_processed' WHEN gate IS NOT NULL THEN gate WHEN score < 0.34 THEN 'below_threshold' END"


@query(f"WITH {CAND} SELECT item_id, doc_id, score, {_WHY} AS exclusion_reason, {_WHY} IS NULL AS selected FROM cand")
def exclusion_trace(t: Tables):
    """One row a candidate: its score and the first reason that shuts it out."""
    why = F.when(~F.col("processed"), "not_processed").when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("score") < R.THRESHOLD, "below_threshold")
    return candidates(t).select("item_id", "doc_id", "score", why.alias("exclusion_reason"), why.isNull().alias("selected"))


_LINES = """units AS (SELECT doc_id, length(regexp_extract(text, '^[^\n]*')) AS first_line, (length(text) - length(replace(text, chr(10), ''))) AS breaks FROM documents)"""


@query(f"WITH {CAND}, {_LINES} SELECT item_id, doc_id, CASE WHEN breaks > 3 THEN round(score + 0.1::DOUBLE, 5) ELSE score END AS score, CASE WHEN breaks > 3 THEN 'unit' ELSE 'document' END AS kind FROM cand JOIN units USING (doc_id)")
def candidate_union(t: Tables):
    """Candidates of documents and of units in one list; where both have a document, the unit counts."""
    breaks = t.documents.select(F.col("doc_id").alias("_id"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("breaks")).where("breaks > 3").select("_id")
    unit = F.col("_id").isNotNull()
    found = candidates(t).select("item_id", "doc_id", "score").join(breaks, F.col("doc_id") == F.col("_id"), "left")
    return found.select("item_id", "doc_id", F.when(unit, R.rounded(F.col("score") + 0.1)).otherwise(F.col("score")).alias("score"), F.when(unit, "unit").otherwise("document").alias("kind"))


@query(f"""WITH {HITS}, c AS (SELECT doc_id, unnest(range(0, greatest(1, ((length(text) - 180 + 1219) // 1220)))) AS i, text FROM documents),
s AS (SELECT item_id, doc_id, i, count(*) AS n FROM c JOIN qkw ON contains(lower(substr(text, i * 1220 + 1, 1400)), w) GROUP BY ALL)
SELECT item_id, doc_id, arg_max(i, (n, -i))::INTEGER AS chunk_index, max(n) AS hits FROM s GROUP BY ALL""")
def best_chunk_per_doc(t: Tables):
    """The chunk of each candidate with the most keywords; the first one wins a tie."""
    from millrace.operators.chunks import fixed_chunks

    rows = fixed_chunks(t.documents).select("doc_id", "chunk_index", F.lower("chunk").alias("text"), F.lit("").alias("title"))
    s = keyword_matches(rows, asked(t), ["doc_id", "chunk_index"], vectors=False).withColumnRenamed("hits", "n_hits").drop("n").withColumnRenamed("n_hits", "n")
    return s.groupBy("item_id", "doc_id").agg(F.max_by("chunk_index", F.struct("n", (-F.col("chunk_index")).alias("i"))).alias("chunk_index"), F.max("n").alias("hits"))


@query(f"WITH {PLACED} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY source_type = 'src0' DESC, place) AS place FROM placed WHERE place <= 10")
def context_rerank(t: Tables):
    """What the session chose before (here: source src0) moves to the front, the rest keeps its order."""
    order = Window.partitionBy("item_id").orderBy(F.desc(F.col("source_type") == "src0"), "place")
    return placed(t, 10).select("item_id", "doc_id", F.row_number().over(order).alias("place"))


@query(f"WITH {PLACED}, a AS (SELECT *, bool_or(coalesce(quality, 0) = 1) OVER (PARTITION BY item_id) AS live FROM placed WHERE place <= 10) SELECT item_id, doc_id, place FROM a WHERE NOT live OR coalesce(quality, 0) = 1")
def prefer_active(t: Tables):
    """If any match is active only active ones stay."""
    active = F.coalesce(F.col("quality") == 1, F.lit(False))
    return placed(t, 10).withColumn("a", active).withColumn("live", F.max("a").over(Window.partitionBy("item_id"))).where("NOT live OR a").select("item_id", "doc_id", "place")


@query(f"WITH {PLACED} SELECT item_id, round(max(score) FILTER (place = 1) - max(score) FILTER (place = 2), 5) AS gap, coalesce(round(max(score) FILTER (place = 1) - max(score) FILTER (place = 2), 5) < 0.18, false) AS ambiguous FROM placed WHERE place <= 2 GROUP BY 1")
def ambiguity_gap(t: Tables):
    """Whether the first two are too close to tell."""
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("score")))
    return placed(t, 2).groupBy("item_id").agg(F.round(at(1) - at(2), 5).alias("gap")).select("item_id", "gap", F.coalesce(F.col("gap") < 0.18, F.lit(False)).alias("ambiguous"))


FACTS = (("license", ("licensed", "released")), ("contact", ("@mail",)), ("article", (" the ", " der ", " le ")))


@query("WITH " + PLACED + ", f(fact, term) AS (VALUES " + ", ".join(f"('{a}', '{x}')" for a, b in FACTS for x in b) + """), c AS (SELECT item_id, fact, bool_or(contains(lower(content), term)) AS covered FROM placed CROSS JOIN f WHERE place <= 5 GROUP BY ALL)
SELECT item_id, coalesce(string_agg(fact, ',' ORDER BY fact) FILTER (covered), '') AS covered, coalesce(string_agg(fact, ',' ORDER BY fact) FILTER (NOT covered), '') AS missing FROM c GROUP BY 1""")
def required_fact_coverage(t: Tables):
    """Which facts the texts of the first five documents cover, by their terms."""
    low = t.documents.select("doc_id", *(F.greatest(*(F.lower("text").contains(x) for x in terms), F.lit(False)).alias(f) for f, terms in FACTS))
    held = placed(t, 5).select("item_id", "doc_id").join(low, "doc_id").groupBy("item_id").agg(*(F.bool_or(f).alias(f) for f, _ in FACTS))
    names = sorted(f for f, _ in FACTS)
    told = lambda yes: F.concat_ws(",", *(F.when(F.col(f) == yes, F.lit(f)) for f in names))
    return held.select("item_id", told(True).alias("covered"), told(False).alias("missing"))


_SUFFICIENT = "CASE WHEN count(*) = 0 OR max(score) IS NULL THEN 'no_result' WHEN max(score) < 0.58 THEN 'low_score' WHEN bool_and(coalesce(quality, 0) = 0) THEN 'stale_only' WHEN max(hits / n::DOUBLE) < 0.5 THEN 'terms_missing' ELSE 'sufficient' END"


@query(f"WITH {PLACED} SELECT b.item_id, {_SUFFICIENT} AS decision FROM benchmark b LEFT JOIN (SELECT * FROM placed WHERE place <= 5) p USING (item_id) GROUP BY 1")
def evidence_sufficiency(t: Tables):
    """Whether the local evidence is enough, and if not the first reason."""
    best = placed(t, 5).groupBy("item_id").agg(F.max("score").alias("s"), F.bool_and(F.coalesce("quality", F.lit(0)) == 0).alias("stale"), F.max(F.col("hits") / F.col("n")).alias("c"))
    decision = F.when(F.col("s").isNull(), "no_result").when(F.col("s") < 0.58, "low_score").when(F.col("stale"), "stale_only").when(F.col("c") < 0.5, "terms_missing").otherwise("sufficient")
    return t.benchmark.select("item_id").join(best, "item_id", "left").select("item_id", decision.alias("decision"))


@query(f"WITH {PLACED} SELECT item_id, arg_min(doc_id, place) AS doc_id, arg_min(CASE WHEN length(content) > 240 THEN substr(content, 1, 240) || '…' ELSE content END, place) AS excerpt, arg_min(source_type, place) AS source, max(score) FILTER (place = 1) AS score FROM placed GROUP BY 1")
def evidence_cards(t: Tables):
    """The best evidence of each question as a card; the text joins back only for it."""
    first = placed(t, 1).select("item_id", "doc_id", F.col("source_type").alias("source"), "score")
    excerpt = F.when(F.length("text") > 240, F.concat(F.substring("text", 1, 240), F.lit("…"))).otherwise(F.col("text"))
    return first.join(t.documents.select("doc_id", excerpt.alias("excerpt")), "doc_id").select("item_id", "doc_id", "excerpt", "source", "score")


@query(f"""WITH {PLACED}, a AS (SELECT item_id, count(*) AS k, count(*) FILTER (quality = 1) AS live, max(hits / n::DOUBLE) AS coverage FROM placed WHERE place <= 5 GROUP BY 1)
SELECT b.item_id, CASE WHEN k IS NULL THEN 'no_result' WHEN live = 0 THEN 'stale_only' WHEN coverage < 0.5 THEN 'insufficient_evidence' ELSE 'success' END AS status FROM benchmark b LEFT JOIN a USING (item_id)""")
def response_status(t: Tables):
    a = placed(t, 5).groupBy("item_id").agg(F.count("*").alias("k"), F.count_if(F.col("quality") == 1).alias("live"), F.max(F.col("hits") / F.col("n")).alias("coverage"))
    status = F.when(F.col("k").isNull(), "no_result").when(F.col("live") == 0, "stale_only").when(F.col("coverage") < 0.5, "insufficient_evidence").otherwise("success")
    return t.benchmark.select("item_id").join(a, "item_id", "left").select("item_id", status.alias("status"))


@query("""WITH f AS (SELECT l_orderkey, l_returnflag AS kind, min(l_linenumber) AS o, l_linestatus || ':' || (l_partkey % 10) AS fact FROM lineitem WHERE l_discount >= 0.03 GROUP BY ALL)
SELECT l_orderkey, coalesce(string_agg(fact, '; ' ORDER BY o, fact) FILTER (kind = 'A'), '') AS a, coalesce(string_agg(fact, '; ' ORDER BY o, fact) FILTER (kind = 'N'), '') AS n, coalesce(string_agg(fact, '; ' ORDER BY o, fact) FILTER (kind = 'R'), '') AS r FROM f GROUP BY 1""")
def guide_assembly(t: Tables):
    """Sure facts of each unit by kind, each once, in order of appearance."""
    fact = F.concat_ws(":", "l_linestatus", (F.col("l_partkey") % 10).cast("string"))
    f = t.lineitem.where("l_discount >= 0.03").groupBy("l_orderkey", F.col("l_returnflag").alias("kind"), fact.alias("fact")).agg(F.min("l_linenumber").alias("o"))
    told = lambda k: F.array_join(F.transform(F.array_sort(F.filter("x", lambda e: e["kind"] == k)), lambda e: e["fact"]), "; ").alias(k.lower())
    return f.groupBy("l_orderkey").agg(F.collect_list(F.struct("o", "fact", "kind")).alias("x")).select("l_orderkey", told("A"), told("N"), told("R"))


_CHECKS = f"""{PLACED}, best AS (SELECT item_id, count(*) AS k, max(score) AS score, bool_or(contains(content, b.text)) AS holds, bool_or(title_hits > 0) AS titled FROM placed JOIN benchmark b USING (item_id) WHERE place <= 5 GROUP BY 1),
checks AS (SELECT item_id, coalesce(k, 0) > 0 AS answered, coalesce(holds, false) AS source_found, coalesce(titled, false) AS title_found, coalesce(score, 0) >= 0.5 AS sure FROM benchmark LEFT JOIN best USING (item_id))"""


@query(f"WITH {_CHECKS} SELECT item_id, answered, source_found, title_found, sure FROM checks")
def eval_checks(t: Tables):
    """Each question of the golden set against what the search gave: answered, source, title, score."""
    texts = t.documents.select("doc_id", "text").join(placed(t, 5).select("item_id", "doc_id", "score", "title_hits"), "doc_id").join(t.benchmark.select("item_id", F.col("text").alias("q")), "item_id")
    best = texts.groupBy("item_id").agg(F.max("score").alias("score"), F.bool_or(F.col("text").contains(F.col("q"))).alias("holds"), F.bool_or(F.col("title_hits") > 0).alias("titled"))
    no = F.lit(False)
    return t.benchmark.select("item_id").join(best, "item_id", "left").select("item_id", F.col("score").isNotNull().alias("answered"), F.coalesce("holds", no).alias("source_found"), F.coalesce("titled", no).alias("title_found"), (F.coalesce("score", F.lit(0.0)) >= 0.5).alias("sure"))


@query(f"""WITH {_CHECKS}, f AS (SELECT item_id, unnest(['answered', 'source_found', 'title_found', 'sure']) AS name, unnest([answered, source_found, title_found, sure]) AS ok FROM checks)
SELECT name, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM f GROUP BY 1""")
def eval_summary(t: Tables):
    """Totals, passes and failures by check."""
    names = ("answered", "source_found", "title_found", "sure")
    rows = eval_checks(t).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("ok")) for n in names))).alias("x"))
    return rows.groupBy("x.name").agg(F.count("*").alias("total"), F.count_if("x.ok").alias("passed"), F.count_if(~F.col("x.ok")).alias("failed"))
