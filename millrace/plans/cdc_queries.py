"""Change data capture, dates and states (survey 2.10 and 2.11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import cdc
from millrace.operators.chunks import fixed_chunks
from millrace.plans.inputs import AS_OF_DOCS, AS_OF_ORDERS, NOTICES, PERIODS, REQUESTS, SNAPSHOTS, STAFF, notices, periods, requests, snapshots, staff, stamp
from millrace.operators.tasks import time_to_live
from millrace.plans.registry import Tables, query


def _hashed(t: Tables):
    return tuple(s.withColumn("hash", cdc.content_hash(F.col("text"), F.col("source"))) for s in snapshots(t))


HASHED = SNAPSHOTS + """,
oldh AS (SELECT *, sha256(coalesce(text, '') || chr(10) || coalesce(source, '')) AS hash FROM old),
newh AS (SELECT *, sha256(coalesce(text, '') || chr(10) || coalesce(source, '')) AS hash FROM new),
states AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'missing' WHEN o.hash = n.hash THEN 'skipped' ELSE 'updated' END AS state
  FROM oldh o FULL JOIN newh n ON o.doc_id = n.doc_id)"""


@query(f"""WITH {NOTICES} SELECT doc_id, sha256(coalesce(title, '') || chr(10) || coalesce(content, '') || chr(10) || CASE WHEN source_type IN ('src0', 'src5') THEN '' ELSE strftime(published_at, '%Y-%m-%d') END) AS hash FROM notices""")
def content_hash(t: Tables):
    """The digest of a notice; static source types leave the date out."""
    date = F.when(F.col("source_type").isin("src0", "src5"), "").otherwise(F.date_format("published_at", "yyyy-MM-dd"))
    return notices(t).select("doc_id", cdc.content_hash(F.col("title"), F.col("content"), date).alias("hash"))


@query(f"WITH {HASHED} SELECT doc_id, state FROM states")
def cdc_classify(t: Tables):
    return cdc.classify(*_hashed(t), "doc_id", "hash")


@query(f"WITH {HASHED} SELECT count(*) FILTER (state = 'new') AS added, count(*) FILTER (state = 'updated') AS updated, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'missing') AS archived, CASE WHEN count(*) FILTER (state = 'missing') > 0 THEN 'completed_with_archive' ELSE 'completed' END AS phase FROM states")
def cdc_run_summary(t: Tables):
    n = lambda s: F.count_if(F.col("state") == s)
    return cdc.classify(*_hashed(t), "doc_id", "hash").agg(
        n("new").alias("added"), n("updated").alias("updated"), n("skipped").alias("skipped"), n("missing").alias("archived"), F.when(n("missing") > 0, "completed_with_archive").otherwise("completed").alias("phase")
    )


@query(f"WITH {HASHED} SELECT doc_id FROM states WHERE state = 'missing'")
def cdc_archive_missing(t: Tables):
    return cdc.missing(*snapshots(t), "doc_id")


@query(f"WITH {HASHED} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.hash ELSE n.hash END AS hash, CASE WHEN n.doc_id IS NULL THEN o.source ELSE n.source END AS source, n.doc_id IS NULL AS archived FROM oldh o FULL JOIN newh n ON o.doc_id = n.doc_id")
def cdc_merged_table(t: Tables):
    return cdc.merged(*_hashed(t), "doc_id", ["hash", "source"])


@query(f"""WITH {HASHED},
oc AS (SELECT doc_id, unnest(range(0, greatest(1, ((length(text) - 180 + 1219) // 1220)))) AS i, text FROM old), nc AS (SELECT doc_id, unnest(range(0, greatest(1, ((length(text) - 180 + 1219) // 1220)))) AS i, text FROM new),
changed AS (SELECT doc_id FROM states WHERE state IN ('new', 'updated'))
SELECT doc_id, i::INTEGER AS chunk_index, md5(substr(text, i * 1220 + 1, 1400)) AS digest FROM oc WHERE doc_id NOT IN (SELECT doc_id FROM changed)
UNION ALL SELECT doc_id, i::INTEGER, md5(substr(text, i * 1220 + 1, 1400)) FROM nc WHERE doc_id IN (SELECT doc_id FROM changed)""")
def cdc_replace_children(t: Tables):
    """Chunks after the new snapshot: those of changed documents made anew, the others kept."""
    old, new = _hashed(t)
    changed = cdc.classify(old, new, "doc_id", "hash").where(F.col("state").isin("new", "updated"))
    cut = lambda d: fixed_chunks(d, 1400, 180).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))
    return cdc.replace_children(cut(old), cut(new), changed, "doc_id")


@query(f"""WITH {HASHED} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.hash IS NOT NULL AND coalesce(quality = 1, false) THEN n.hash ELSE o.hash END AS hash,
  CASE WHEN n.hash IS NOT NULL AND coalesce(quality = 1, false) THEN 'new' WHEN o.hash IS NOT NULL THEN 'old' ELSE 'none' END AS generation
FROM oldh o FULL JOIN newh n ON o.doc_id = n.doc_id LEFT JOIN labels l ON l.doc_id = n.doc_id""")
def cdc_publish_generation(t: Tables):
    old, new = _hashed(t)
    checked = new.join(t.labels.select("doc_id", (F.col("quality") == 1).alias("ok")), "doc_id", "left")
    return cdc.published(old, checked, "doc_id", "hash", "ok")


@query(f"""WITH {STAFF}, old AS (SELECT * FROM staff WHERE duty <> 'ASIA'), new AS (SELECT * FROM staff WHERE duty <> 'EUROPE'),
s AS (SELECT coalesce(n.staff_id, o.staff_id) AS staff_id, coalesce(n.contact, o.contact) AS contact, n.staff_id IS NOT NULL AS active FROM old o FULL JOIN new n USING (staff_id))
SELECT staff_id, contact, active OR (SELECT count(*) = 0 FROM new) AS active FROM s""")
def directory_sync(t: Tables):
    """Seen contacts are active, unseen ones are not, if anything was seen at all."""
    old, new = staff(t).where("duty <> 'ASIA'"), staff(t).where("duty <> 'EUROPE'")
    seen = new.agg((F.count("*") == 0).alias("nothing"))
    both = cdc.merged(old, new, "staff_id", ["contact"])
    return both.crossJoin(F.broadcast(seen)).select("staff_id", "contact", (~F.col("archived") | F.col("nothing")).alias("active"))


@query("""WITH h AS (SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents), f AS (SELECT digest, min(doc_id) AS extracted_from, max(n) AS characters FROM h GROUP BY 1)
SELECT doc_id, extracted_from, characters, doc_id <> extracted_from AS reused FROM h JOIN f USING (digest)""")
def hash_reuse_join(t: Tables):
    """Equal bytes are extracted once, and the result is joined back."""
    h = t.documents.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))
    once = h.groupBy("digest").agg(F.min("doc_id").alias("extracted_from"), F.max("n").alias("characters"))
    return h.join(once, "digest").select("doc_id", "extracted_from", "characters", (F.col("doc_id") != F.col("extracted_from")).alias("reused"))


@query(f"""WITH {REQUESTS}, j AS (SELECT *, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'done' END AS state,
  row_number() OVER (PARTITION BY session, event_type ORDER BY ts DESC, event_id DESC) AS turn FROM requests)
SELECT event_id, CASE WHEN state = 'running' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTE THEN 'pending' WHEN state = 'pending' AND turn > 1 THEN 'cancelled' ELSE state END AS state FROM j""")
def backlog_sweep(t: Tables):
    """Stale running jobs go back to pending, and of a session's pending jobs only the newest stays."""
    turn = F.row_number().over(Window.partitionBy("session", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").otherwise("done")
    jobs = requests(t).select("event_id", "ts", state.alias("s"), turn.alias("turn"))
    stale = (F.col("s") == "running") & (F.col("ts") < stamp("2024-01-29 23:30:00"))
    return jobs.select("event_id", F.when(stale, "pending").when((F.col("s") == "pending") & (F.col("turn") > 1), "cancelled").otherwise(F.col("s")).alias("state"))


@query(f"""WITH {REQUESTS}, e AS (SELECT question, ts, event_id, event_type <> 'purchase' AS opens FROM requests),
e2 AS (SELECT split_part(question, ' ', 2) AS gap, ts, event_id, opens, lag(opens) OVER (PARTITION BY split_part(question, ' ', 2) ORDER BY ts, event_id) AS before FROM e)
SELECT gap, count(*) FILTER (opens) AS occurrences, count(*) FILTER (opens AND before = false) AS reopened, CASE WHEN arg_max(opens, (ts, event_id)) THEN 'open' ELSE 'resolved' END AS status,
  CASE WHEN NOT arg_max(opens, (ts, event_id)) THEN max(ts) END AS resolved_at FROM e2 GROUP BY gap""")
def gap_lifecycle(t: Tables):
    """A gap's events in order: a purchase resolves it, anything else counts and opens it again."""
    gap = F.element_at(F.split("question", " "), 2)
    e = requests(t).select(gap.alias("gap"), "ts", "event_id", (F.col("event_type") != "purchase").alias("opens"))
    e = e.withColumn("before", F.lag("opens").over(Window.partitionBy("gap").orderBy("ts", "event_id")))
    last = F.max_by("opens", F.struct("ts", "event_id"))
    return e.groupBy("gap").agg(
        F.count_if("opens").alias("occurrences"), F.count_if(F.col("opens") & (F.col("before") == F.lit(False))).alias("reopened"), F.when(last, "open").otherwise("resolved").alias("status"), F.when(~last, F.max("ts")).alias("resolved_at")
    )


@query(f"""WITH {REQUESTS}, u AS (SELECT event_id, event_type, CASE WHEN k % 3 = 0 THEN []::INTEGER[] ELSE range(0, k % 3)::INTEGER[] END AS sources FROM requests WHERE event_type IN ('error', 'view')),
x AS (SELECT event_id, event_type, unnest(CASE WHEN len(sources) = 0 THEN [NULL] ELSE sources END) AS source FROM u)
SELECT event_id, source, CASE event_type WHEN 'error' THEN 'contact' ELSE 'period' END AS field FROM x""")
def feedback_to_gaps(t: Tables):
    """Unresolved feedback gives a gap for each source, or one without source."""
    some = requests(t).where(F.col("event_type").isin("error", "view"))
    ids = F.when(F.col("k") % 3 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.col("k") % 3 - 1).cast("int")))
    return some.select("event_id", "event_type", F.explode_outer(ids).alias("source")).select("event_id", "source", F.when(F.col("event_type") == "error", "contact").otherwise("period").alias("field"))


@query("WITH rules(k, name) AS (VALUES (1, 'NORTH'), (3, 'SOUTH')) SELECT n_nationkey, coalesce(name, r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN rules ON r_regionkey = k")
def dim_repair(t: Tables):
    """A dimension's rows take the canonical value of a rule table where there is one."""
    rules = t.spark.sql("SELECT * FROM VALUES (1, 'NORTH'), (3, 'SOUTH') AS r(k, name)")
    dims = t.region.join(F.broadcast(rules), F.col("r_regionkey") == F.col("k"), "left")
    return t.nation.join(dims, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.coalesce("name", "r_name").alias("region"))


# --- dates and states

_NOW = f"TIMESTAMP '{AS_OF_ORDERS}'"
STATUS = f"CASE WHEN start_at > {_NOW} THEN 'upcoming' WHEN end_at < {_NOW} THEN 'expired' WHEN end_at IS NOT NULL THEN 'active' ELSE 'unknown' END"
UNIT = f"CASE WHEN start_at > {_NOW} THEN 'upcoming' WHEN end_at < {_NOW} THEN 'expired' WHEN end_at IS NOT NULL OR start_at IS NOT NULL THEN 'active' ELSE 'unknown' END"
EFFECTIVE = f"""CASE WHEN lines = 0 THEN stored WHEN stored = 'O' AND action = 'read' THEN 'always' WHEN start_at IS NOT NULL OR end_at IS NOT NULL THEN {STATUS} WHEN action IN ('apply', 'submit') THEN 'unknown'
  WHEN event_at < {_NOW} THEN 'expired' ELSE 'upcoming' END"""


def _status(t: Tables):
    from millrace.functions.status import period_status

    now = stamp(AS_OF_ORDERS)
    return period_status(F.col("start_at"), F.col("end_at"), now)


@query(f"WITH {PERIODS} SELECT o_orderkey, {STATUS} AS status FROM periods")
def period_status(t: Tables):
    return periods(t).select("o_orderkey", _status(t).alias("status"))


def _effective(t: Tables):
    now = stamp(AS_OF_ORDERS)
    return (
        F.when(F.col("lines") == 0, F.col("stored")).when((F.col("stored") == "O") & (F.col("action") == "read"), "always").when(F.col("start_at").isNotNull() | F.col("end_at").isNotNull(), _status(t))
        .when(F.col("action").isin("apply", "submit"), "unknown").when(F.col("event_at") < now, "expired").otherwise("upcoming")
    )


@query(f"WITH {PERIODS} SELECT o_orderkey, {EFFECTIVE} AS status FROM periods")
def effective_status(t: Tables):
    """Stored state without lines, then always, then the period, then the kind of action, then the event."""
    return periods(t).select("o_orderkey", _effective(t).alias("status"))


@query(f"WITH {PERIODS} SELECT o_orderkey, {UNIT} AS status FROM periods")
def unit_status(t: Tables):
    from millrace.functions.status import unit_status as status

    return periods(t).select("o_orderkey", status(F.col("start_at"), F.col("end_at"), stamp(AS_OF_ORDERS)).alias("status"))


LABELS = {("apply", "active"): "open for application", ("apply", "upcoming"): "application soon", ("apply", "expired"): "application closed", ("submit", "active"): "submission open", ("submit", "expired"): "submission closed", ("attend", "upcoming"): "event ahead", ("attend", "expired"): "event over"}


@query(f"WITH {PERIODS}, s AS (SELECT o_orderkey, action, {EFFECTIVE} AS status FROM periods), l(a, s, label) AS (VALUES " + ", ".join(f"('{a}', '{s}', '{v}')" for (a, s), v in LABELS.items()) + ") SELECT o_orderkey, coalesce(label, status) AS label FROM s LEFT JOIN l ON l.a = s.action AND l.s = s.status")
def status_labels(t: Tables):
    """What a reader is told, by kind of action and state."""
    names = F.create_map(*(x for (a, s), v in LABELS.items() for x in (F.lit(f"{a}/{s}"), F.lit(v))))
    s = periods(t).select("o_orderkey", "action", _effective(t).alias("status"))
    return s.select("o_orderkey", F.coalesce(F.try_element_at(names, F.concat_ws("/", "action", "status")), F.col("status")).alias("label"))


@query(f"WITH {NOTICES} SELECT doc_id, round(greatest(0::DOUBLE, 1 - date_diff('day', published_at, TIMESTAMP '{AS_OF_DOCS}') / 365::DOUBLE) * 0.12::DOUBLE, 5) AS freshness FROM notices")
def freshness_score(t: Tables):
    from millrace.functions.status import freshness

    return notices(t).select("doc_id", F.round(freshness(F.col("published_at"), stamp(AS_OF_DOCS)), 5).alias("freshness"))


@query("""WITH p AS (SELECT *, (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1) // 50 AS page, o_orderpriority LIKE '1%' AS pinned FROM orders),
m AS (SELECT page, min(o_orderdate) FILTER (NOT pinned) AS oldest FROM p GROUP BY 1), stop AS (SELECT min(page) AS page FROM m WHERE oldest < TIMESTAMP '1998-09-01' - INTERVAL 12 MONTH)
SELECT page, oldest FROM m WHERE page <= coalesce((SELECT page FROM stop), page)""")
def horizon_pages(t: Tables):
    """Pages of 50, newest first, up to the first whose oldest row that is not pinned passes the cut-off of 12 months.

    A row's page follows from its date's count of newer rows, so no task sorts all rows: days are counted first.
    """
    per_day = t.orders.groupBy("o_orderdate").agg(F.count("*").alias("n"))
    newer = Window.orderBy(F.desc("o_orderdate")).rowsBetween(Window.unboundedPreceding, -1)
    # one row a day in one task
    days = per_day.select("o_orderdate", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("newer"))
    inside = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    paged = t.orders.withColumn("r", inside).join(days, "o_orderdate").select(F.floor((F.col("newer") + F.col("r") - 1) / 50).alias("page"), "o_orderdate", F.col("o_orderpriority").startswith("1").alias("pinned"))
    pages = paged.groupBy("page").agg(F.min(F.when(~F.col("pinned"), F.col("o_orderdate"))).alias("oldest"))
    cutoff = F.add_months(F.lit(AS_OF_ORDERS[:10]).cast("date"), -12).cast("timestamp_ntz")
    stop = pages.where(F.col("oldest") < cutoff).agg(F.min("page").alias("stop"))
    return pages.crossJoin(F.broadcast(stop)).where(F.col("page") <= F.coalesce("stop", "page")).select("page", "oldest")


@query(f"""WITH {NOTICES}, {SNAPSHOTS}
SELECT doc_id, CASE WHEN n.doc_id IS NOT NULL THEN 'seen' ELSE 'kept' END AS reason FROM notices LEFT JOIN (SELECT doc_id FROM new) n USING (doc_id)
WHERE published_at >= TIMESTAMP '{AS_OF_DOCS}' - INTERVAL 6 MONTH AND (n.doc_id IS NOT NULL OR source_type = 'src2')""")
def retention_apply(t: Tables):
    """Rows newer than the cut-off that the run saw, or whose source's listing (src2) was not complete."""
    _, new = snapshots(t)
    seen = new.select("doc_id", F.lit(True).alias("seen"))
    recent = notices(t).where(F.col("published_at") >= F.add_months(F.lit(AS_OF_DOCS[:10]).cast("date"), -6).cast("timestamp_ntz"))
    return recent.join(seen, "doc_id", "left").where(F.col("seen") | (F.col("source_type") == "src2")).select("doc_id", F.when(F.col("seen"), "seen").otherwise("kept").alias("reason"))


#: Task and fields of a request, as its number gives them; both engines read these.
_TASK = "CASE k % 5 WHEN 0 THEN 'course.add' WHEN 1 THEN 'event.camp' WHEN 2 THEN 'graduation.requirements' WHEN 3 THEN 'tuition.pay' END"
_ABOUT = "CASE k % 3 WHEN 0 THEN {0}'department_contact', 'fee'{1} WHEN 1 THEN {0}'applicationPeriod'{1} END"


@query(f"""WITH {REQUESTS}, x AS (SELECT event_id, ts, event_type, {_TASK} AS task, {_ABOUT.format("[", "]")} AS fields FROM requests)
SELECT event_id, ts + to_minutes(CASE WHEN event_type = 'error' THEN 45 WHEN task LIKE 'course.%' OR task LIKE 'tuition.%' OR list_contains(fields, 'applicationPeriod') THEN 720 WHEN task LIKE 'event.%' THEN 360
  WHEN list_contains(fields, 'department_contact') THEN 10080 WHEN task = 'graduation.requirements' THEN 43200 ELSE 10080 END) AS expires_at FROM x""")
def ttl_assign(t: Tables):
    """When an answer expires, by its task, its fields and whether there was one."""
    rows = requests(t).select("event_id", "ts", "event_type", F.expr(_TASK).alias("task"), F.expr(_ABOUT.format("array(", ")")).alias("fields"))
    minutes = time_to_live(F.col("task"), F.col("fields"), F.col("event_type") != "error")
    return rows.select("event_id", (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("expires_at"))


@query(f"WITH {PERIODS} SELECT o_orderkey, CASE WHEN start_at IS NOT NULL AND end_at IS NOT NULL THEN 0.55::DOUBLE WHEN end_at IS NOT NULL THEN 0.35::DOUBLE WHEN start_at IS NOT NULL THEN 0.05::DOUBLE ELSE -0.35::DOUBLE END AS score, coalesce(end_at - start_at > INTERVAL 45 DAY, false) AS implausible FROM periods")
def period_quality(t: Tables):
    """A score for the sides of the period that are known, and whether it is longer than 45 days."""
    s, e = F.col("start_at"), F.col("end_at")
    score = F.when(s.isNotNull() & e.isNotNull(), 0.55).when(e.isNotNull(), 0.35).when(s.isNotNull(), 0.05).otherwise(-0.35)
    return periods(t).select("o_orderkey", score.alias("score"), F.coalesce(e - s > F.expr("INTERVAL 45 DAYS"), F.lit(False)).alias("implausible"))


@query(f"WITH {PERIODS} SELECT o_orderkey, coalesce(strftime(start_at + INTERVAL 9 HOUR, '%Y.%m.%d %H:%M'), '') || ' ~ ' || coalesce(strftime(end_at + INTERVAL 9 HOUR, '%Y.%m.%d %H:%M'), '') AS label FROM periods")
def period_label(t: Tables):
    """The period as text, at UTC+9."""
    text = lambda c: F.coalesce(F.date_format(F.col(c) + F.expr("INTERVAL 9 HOURS"), "yyyy.MM.dd HH:mm"), F.lit(""))
    return periods(t).select("o_orderkey", F.concat(text("start_at"), F.lit(" ~ "), text("end_at")).alias("label"))
