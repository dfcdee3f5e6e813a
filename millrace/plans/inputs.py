"""Inputs that several queries derive from the tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ENDINGS, STOPWORDS, TOKEN, keywords, lowered
from millrace.operators.vectors import keyword_matches
from millrace.plans.registry import Tables

AS_OF_DOCS = "2024-07-01 00:00:00"
AS_OF_ORDERS = "1998-09-01 00:00:00"


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def notices(t: Tables) -> DataFrame:
    """Documents as notices: ids, titles (first 60 characters), priorities, dates, processed = labelled."""
    d = t.documents
    labelled = t.labels.select(F.col("doc_id").alias("_id"), "quality", "toxic")
    suffix = F.coalesce(F.try_to_number(F.regexp_extract("source", "([0-9]+)$", 1), F.lit("9999")).cast("int"), F.lit(0))
    return d.join(labelled, d.doc_id == F.col("_id"), "left").select(
        "doc_id",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        "lang",
        F.col("source").alias("source_type"),
        (suffix * 6).alias("source_priority"),
        F.timestamp_add("DAY", (F.col("doc_id") % 365).cast("int"), stamp("2024-01-01 00:00:00")).alias("published_at"),
        F.col("_id").isNotNull().alias("processed"),
        "quality",
        "toxic",
    )


NOTICES = """
notices AS (SELECT d.doc_id, 'doc:' || d.doc_id AS source_id, substr(text, 1, 60) AS title, text AS content, lang, source AS source_type,
  coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0) * 6 AS source_priority,
  TIMESTAMP '2024-01-01 00:00:00' + to_days((d.doc_id % 365)::INTEGER) AS published_at,
  l.doc_id IS NOT NULL AS processed, quality, toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

KEYWORDS = 15


def questions(t: Tables) -> DataFrame:
    """Benchmark items as questions with their keywords."""
    return t.benchmark.select("item_id", F.col("text").alias("question"), keywords(F.col("text"), KEYWORDS).alias("keywords"))


_CUT = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) >= {len(e) + 2} THEN left(w, length(w) - {len(e)})" for e in ENDINGS) + " ELSE w END"
#: The token class of the text functions, in lower-cased text; r is a keyword's turn.
QUESTIONS = f"""
qtok AS (SELECT item_id, i, {_CUT} AS w FROM (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '{TOKEN}') AS ws FROM benchmark))),
qkw AS (SELECT item_id, w, r FROM (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS r FROM qtok
  WHERE length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)}) GROUP BY item_id, w) WHERE r <= {KEYWORDS})"""


def asked(t: Tables) -> DataFrame:
    """Questions as the search takes them: (item_id, text, keywords), lower-cased."""
    return questions(t).select("item_id", lowered(F.col("question")).alias("text"), "keywords")


def keyword_hits(t: Tables) -> DataFrame:
    """(item_id, doc_id, hits, title_hits, n): how many of a question's keywords each document holds, in text and in title."""
    docs = t.documents.select("doc_id", lowered(F.col("text")).alias("text"), lowered(F.substring("text", 1, 60)).alias("title"))
    return keyword_matches(docs, asked(t), ["doc_id"], vectors=False)


HITS = (
    QUESTIONS
    + """,
qn AS (SELECT item_id, count(*) AS n FROM qkw GROUP BY 1),
hits AS (SELECT q.item_id, d.doc_id, n, count(*) AS hits, count(*) FILTER (contains(lower(substr(text, 1, 60)), w)) AS title_hits
  FROM documents d JOIN qkw q ON contains(lower(text), w) JOIN qn USING (item_id) GROUP BY ALL)"""
)


def periods(t: Tables) -> DataFrame:
    """Orders as application periods: start is missing for priority 5-LOW, end for status P; lines give the end."""
    ends = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"), F.count("*").alias("lines"))
    return t.orders.join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey",
        F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderdate")).alias("start_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("last_ship")).alias("end_at"),
        F.col("o_orderdate").alias("event_at"),
        F.when(F.col("o_orderpriority").startswith("1"), "apply").when(F.col("o_orderpriority").startswith("2"), "submit").when(F.col("o_orderpriority").startswith("3"), "attend").otherwise("read").alias("action"),
        F.col("o_orderstatus").alias("stored"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
    )


PERIODS = """
ends AS (SELECT l_orderkey, max(l_shipdate) AS last_ship, count(*) AS lines FROM lineitem GROUP BY 1),
periods AS (SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderdate END AS start_at,
  CASE WHEN o_orderstatus <> 'P' THEN last_ship END AS end_at, o_orderdate AS event_at,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'apply' WHEN '2' THEN 'submit' WHEN '3' THEN 'attend' ELSE 'read' END AS action,
  o_orderstatus AS stored, coalesce(lines, 0) AS lines
  FROM orders LEFT JOIN ends ON o_orderkey = l_orderkey)"""


def requests(t: Tables) -> DataFrame:
    """Events as a request log: session, question text, time, success."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        "event_id", "ts", F.col("user_id").alias("session"), "event_type", k.alias("k"), "value",
        F.concat(F.col("event_type"), F.lit(" "), F.coalesce(k.cast("string"), F.lit("?"))).alias("question"),
    )


REQUESTS = """
requests AS (SELECT event_id, ts, user_id AS session, event_type, (props::JSON->>'$.k')::INTEGER AS k, value,
  event_type || ' ' || coalesce((props::JSON->>'$.k'), '?') AS question FROM events)"""


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two crawls of documents: the older lacks source src1; the newer lacks src2, and its German texts have changed."""
    d = t.documents.select("doc_id", "text", "source", "lang")
    old = d.where("source <> 'src1'")
    return old, d.where("source <> 'src2'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))


SNAPSHOTS = """
old AS (SELECT doc_id, text, source, lang FROM documents WHERE source <> 'src1'),
new AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' v2' ELSE text END AS text, source, lang FROM documents WHERE source <> 'src2')"""


def staff(t: Tables) -> DataFrame:
    """Suppliers as a staff directory: department (nation), contact, duty (region), extension."""
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("staff_id"), F.col("n_name").alias("department"), F.col("s_name").alias("contact"), F.col("r_name").alias("duty"),
            F.lpad((F.col("s_suppkey") * 37 % 10000).cast("string"), 4, "0").alias("extension"), F.col("s_acctbal").alias("weight"),
        )
    )


STAFF = """
staff AS (SELECT s_suppkey AS staff_id, n_name AS department, s_name AS contact, r_name AS duty,
  lpad((s_suppkey * 37 % 10000)::VARCHAR, 4, '0') AS extension, s_acctbal AS weight
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
