"""Caches, recovery, gaps and streams (survey 2.15 and 2.16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import squeeze
from millrace.operators import cdc
from millrace.operators import limits as L
from millrace.operators import tasks as K
from millrace.plans.inputs import NOTICES, REQUESTS, notices, requests, stamp
from millrace.plans.registry import Tables, query
from millrace.streaming import streams as S

TTL_HOURS = 6
SESSION_HOURS = 2


@query(r"SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS hash FROM conversations")
def question_hash(t: Tables):
    """The digest under which a question is cached as it is."""
    return t.conversations.select("conv_id", "turn", F.sha2(F.lower(squeeze(F.col("text"))), 256).alias("hash"))


_KEY = """sha256('{"bucket":' || coalesce((k // 10)::VARCHAR, 'null') || ',"fields":["' || CASE WHEN k % 2 = 0 THEN 'contact","period' ELSE 'contact' END || '"],"type":"' || CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE event_type END || '"}')"""


def canonical(k, kind):
    """A short key of a request, for the queries about what is done with keys."""
    fields = F.when(k % 2 == 0, F.array(F.lit("contact"), F.lit("period"))).otherwise(F.array(F.lit("contact")))
    conditions = F.struct(F.floor(k / 10).alias("bucket"), F.array_sort(fields).alias("fields"), F.when(kind.isin("view", "click"), "read").otherwise(kind).alias("type"))
    return F.sha2(F.to_json(conditions, {"ignoreNullFields": "false"}), 256)


#: What a request asks for, as its number and kind give it; both engines read these expressions.
_PLAN = {
    "academicYear": "CASE WHEN k % 3 = 0 THEN 2020 + k % 5 END", "admissionYear": "CASE WHEN k % 7 = 1 THEN 2018 + k % 4 END", "grade": "CASE WHEN k % 11 = 5 THEN k % 4 END", "semester": "CASE WHEN k % 2 = 0 THEN 'term ' || k % 4 END",
    "category": "CASE k % 4 WHEN 0 THEN ' Straße  A ' WHEN 1 THEN 'STRASSE a' WHEN 2 THEN ' ' END", "college": "CASE WHEN k % 5 = 2 THEN 'Arts &amp;\tLaw' END", "department": "CASE WHEN k % 6 = 3 THEN '<b>Office</b> of \"K\"' END",
    "studentStatus": "CASE WHEN k % 9 = 4 THEN 'On Leave' END", "timeScope": "CASE WHEN k % 8 = 7 THEN 'NOW' ELSE 'now' END", "task": "CASE WHEN k % 3 = 1 THEN 'event.' || event_type WHEN k % 3 = 2 THEN event_type END",
}
#: The same, folded and without white space, as the key has it.
_CONDITION = {"category": "CASE k % 4 WHEN 0 THEN 'strassea' WHEN 1 THEN 'strassea' END", "college": "CASE WHEN k % 5 = 2 THEN 'arts&law' END", "department": "CASE WHEN k % 6 = 3 THEN 'officeof\"k\"' END", "studentStatus": "CASE WHEN k % 9 = 4 THEN 'onleave' END", "timeScope": "'now'"}


def _key_sql() -> str:
    words = "CASE WHEN {t} LIKE 'event.%' THEN '[\"camp\",\"k' || k % 10 || '\"]' ELSE '[]' END"
    only = f"coalesce({_PLAN['task']}, CASE WHEN k % 2 = 0 THEN 'click' END)"
    parts = {name: f"to_json({_CONDITION.get(name, e)})::VARCHAR" for name, e in _PLAN.items() if name != "task"}
    parts |= {"task": f"to_json({only})::VARCHAR", "tasks": "CASE WHEN k % 2 = 0 THEN '[\"click\"]' ELSE '[\"click\",\"view\"]' END", "requestedFields": "'[\"contact\",\"period\"]'", "requiredFacts": "CASE WHEN k % 4 = 1 THEN '[\"fee\"]' ELSE '[]' END", "eventKeywords": words.format(t=only)}
    return "sha256('{' || " + " || ',' || ".join(f"'\"{n}\":' || coalesce({parts[n]}, 'null')" for n in sorted(parts)) + " || '}')"


@query(f"WITH {REQUESTS} SELECT event_id, {_key_sql()} AS key FROM requests WHERE k IS NOT NULL")
def canonical_key(t: Tables):
    """The key of a request by all conditions of its plan, however they are written and ordered."""
    lists = {
        "tasks": F.when(F.col("k") % 2 == 0, F.array(F.lit("click"))).otherwise(F.array(F.lit("view"), F.lit("click"))), "requestedFields": F.array(*map(F.lit, ("period", "contact", "period"))),
        "requiredFacts": F.when(F.col("k") % 4 == 1, F.array(F.lit("fee"), F.lit("fee"))).otherwise(F.array().cast("array<string>")), "keywords": F.array(F.concat(F.lit("K "), (F.col("k") % 10).cast("string")), F.lit("Camp"), F.lit(" "), F.lit("camp")),
    }
    asked = requests(t).where("k IS NOT NULL").select("event_id", *(F.expr(e).alias(n) for n, e in _PLAN.items()), *(c.alias(n) for n, c in lists.items()))
    return asked.select("event_id", K.canonical_key({n: F.col(n) for n in (*_PLAN, *lists)}, {f.name: f.dataType for f in asked.schema}).alias("key"))


@query(f"""WITH {REQUESTS}, latest AS (SELECT k, arg_max(floor(value / 50), (ts, event_id)) AS now_hash FROM requests WHERE event_type = 'view' GROUP BY 1)
SELECT event_id, value > 5 AND ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-30 00:00:00' AND coalesce(floor(value / 50) = now_hash, true) AS valid FROM requests LEFT JOIN latest USING (k) WHERE event_type = 'purchase'""")
def cache_validity(t: Tables):
    """Entries that are verified, not expired, and whose source has not changed; a source that is gone counts as unchanged."""
    r = requests(t)
    latest = r.where("event_type = 'view'").groupBy("k").agg(F.max_by(F.floor(F.col("value") / 50), F.struct("ts", "event_id")).alias("now_hash"))
    fresh = F.col("ts") + F.expr("INTERVAL 7 DAYS") > stamp("2024-01-30 00:00:00")
    same = F.coalesce(F.floor(F.col("value") / 50) == F.col("now_hash"), F.lit(True))
    return r.where("event_type = 'purchase'").join(latest, "k", "left").select("event_id", ((F.col("value") > 5) & fresh & same).alias("valid"))


@query(f"""WITH {REQUESTS}, cache AS (SELECT question, {_KEY} AS key, event_id FROM requests WHERE ts < TIMESTAMP '2024-01-05 00:00:00' AND value > 20),
exact AS (SELECT question, min(event_id) AS e FROM cache GROUP BY 1), canon AS (SELECT key, min(event_id) AS c FROM cache GROUP BY 1)
SELECT event_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'canonical' ELSE 'miss' END AS outcome, coalesce(e, c) AS entry FROM (SELECT *, {_KEY} AS key FROM requests WHERE ts >= TIMESTAMP '2024-01-05 00:00:00') LEFT JOIN exact USING (question) LEFT JOIN canon USING (key)""")
def cache_lookup(t: Tables):
    """Exact question, then canonical key, then miss."""
    keyed = requests(t).withColumn("key", canonical(F.col("k"), F.col("event_type")))
    cut = stamp("2024-01-05 00:00:00")
    cache = keyed.where((F.col("ts") < cut) & (F.col("value") > 20))
    exact = cache.groupBy("question").agg(F.min("event_id").alias("e"))
    canon = cache.groupBy("key").agg(F.min("event_id").alias("c"))
    asked = keyed.where(F.col("ts") >= cut).join(exact, "question", "left").join(canon, "key", "left")
    return asked.select("event_id", F.when(F.col("e").isNotNull(), "exact").when(F.col("c").isNotNull(), "canonical").otherwise("miss").alias("outcome"), F.coalesce("e", "c").alias("entry"))


@query(f"WITH {REQUESTS} SELECT event_id, event_type <> 'error' AND k IS NOT NULL AND value >= 10 AND NOT (event_type = 'signup' AND k < 5) AS cacheable FROM requests")
def cacheable_flag(t: Tables):
    personal = (F.col("event_type") == "signup") & (F.col("k") < 5)
    return requests(t).select("event_id", ((F.col("event_type") != "error") & F.col("k").isNotNull() & (F.col("value") >= 10) & ~personal).alias("cacheable"))


@query(f"""WITH RECURSIVE {REQUESTS}, miss AS (SELECT question, min(ts) AS ts FROM requests GROUP BY 1 UNION ALL
  SELECT m.question, (SELECT min(r.ts) FROM requests r WHERE r.question = m.question AND r.ts >= m.ts + INTERVAL {TTL_HOURS} HOUR) FROM miss m WHERE m.ts IS NOT NULL)
SELECT event_id, CASE WHEN m.ts IS NULL THEN 'hit' ELSE 'miss' END AS outcome FROM requests r LEFT JOIN (SELECT * FROM miss WHERE ts IS NOT NULL) m ON r.question = m.question AND r.ts = m.ts""")
def cache_replay(t: Tables):
    """A question log replayed against a cache whose entries live six hours; a hit does not extend them."""
    return S.replay_table(requests(t), TTL_HOURS * 3600)


@query(f"""WITH {REQUESTS}, {NOTICES}, h AS (SELECT doc_id, sha256(content) AS hash FROM notices), g AS (SELECT {_KEY} AS key, k, count(*) AS n FROM requests WHERE event_type = 'error' GROUP BY ALL)
SELECT key, k, sha256('{{"key":"' || key || '","missing":["contact"],"source":' || coalesce('"' || hash || '"', 'null') || '}}') AS recovery_key, n FROM g LEFT JOIN h ON doc_id = k""")
def recovery_keys(t: Tables):
    """A key of question, missing fields and source digest: it changes when the source does."""
    hashes = notices(t).select("doc_id", F.sha2("content", 256).alias("hash"))
    g = requests(t).where("event_type = 'error'").groupBy(canonical(F.col("k"), F.col("event_type")).alias("key"), "k").agg(F.count("*").alias("n"))
    parts = F.struct("key", F.array(F.lit("contact")).alias("missing"), F.col("hash").alias("source"))
    return g.join(hashes, F.col("doc_id") == F.col("k"), "left").select("key", "k", F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256).alias("recovery_key"), "n")


@query(f"""WITH {REQUESTS}, g AS (SELECT question, bool_or(value > 200) AS found, bool_or(event_type = 'error') AS failed, bool_or(value < 2) AS low, max(ts) AS last FROM requests GROUP BY 1),
o AS (SELECT *, CASE WHEN found THEN 'found' WHEN failed THEN 'failed' WHEN low THEN 'low_confidence' ELSE 'verified_absent' END AS outcome FROM g)
SELECT question, outcome, last + CASE WHEN outcome = 'found' THEN INTERVAL 7 DAY ELSE INTERVAL 1 HOUR END AS expires_at FROM o""")
def recovery_outcome(t: Tables):
    """found, failed, low confidence, verified absent, in this order; what is not found is tried again after an hour."""
    g = requests(t).groupBy("question").agg(F.bool_or(F.col("value") > 200).alias("f"), F.bool_or(F.col("event_type") == "error").alias("e"), F.bool_or(F.col("value") < 2).alias("l"), F.max("ts").alias("last"))
    outcome = F.when(F.col("f"), "found").when(F.col("e"), "failed").when(F.col("l"), "low_confidence").otherwise("verified_absent")
    return g.select("question", outcome.alias("outcome"), (F.col("last") + F.when(F.col("f"), F.expr("INTERVAL 7 DAYS")).otherwise(F.expr("INTERVAL 1 HOUR").cast("interval day to second"))).alias("expires_at"))


@query(f"""WITH {REQUESTS}, e AS (SELECT event_id, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'no_result' END, CASE WHEN k % 7 = 0 THEN 'missing_field' END, CASE WHEN value < 1 THEN 'low_confidence' END, CASE WHEN k IS NULL THEN 'extraction_incomplete' END], lambda x: x IS NOT NULL)) AS gap FROM requests) SELECT event_id, gap FROM e""")
def gap_emit(t: Tables):
    """The gaps that one answer leaves."""
    rules = F.array(F.when(F.col("event_type") == "error", "no_result"), F.when(F.col("k") % 7 == 0, "missing_field"), F.when(F.col("value") < 1, "low_confidence"), F.when(F.col("k").isNull(), "extraction_incomplete"))
    return requests(t).select("event_id", F.explode(F.array_compact(rules)).alias("gap"))


# --- sessions and rates

_CARRY = f"""{REQUESTS}, c AS (SELECT event_id, session, ts, CASE WHEN k % 3 = 0 THEN k END AS y, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS w, event_type = 'signup' AS reset,
  lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS before FROM requests),
i AS (SELECT *, sum(CASE WHEN reset OR before IS NULL OR ts - before >= INTERVAL {SESSION_HOURS} HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id) AS island FROM c)"""


def turns(r):
    """Requests with what they say of year and task, and whether they reset the session."""
    return r.select("event_id", "session", "ts", F.when(F.col("k") % 3 == 0, F.col("k")).alias("year"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).alias("task"), (F.col("event_type") == "signup").alias("reset"))


@query(f"WITH {_CARRY} SELECT event_id, session, last_value(y IGNORE NULLS) OVER o AS year, last_value(w IGNORE NULLS) OVER o AS task FROM i WINDOW o AS (PARTITION BY session, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def session_carry(t: Tables):
    """Year and task carried through a session, which ends after two hours or by a reset."""
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    r = turns(requests(t)).withColumn("before", F.lag("ts").over(order))
    opens = F.col("reset") | F.col("before").isNull() | (F.col("ts") - F.col("before") >= F.expr(f"INTERVAL {SESSION_HOURS} HOURS"))
    r = r.withColumn("island", F.sum(opens.cast("int")).over(order))
    kept = Window.partitionBy("session", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("event_id", "session", F.last("year", True).over(kept).alias("year"), F.last("task", True).over(kept).alias("task"))


def _stream(t: Tables):
    """The request log as a stream, with timestamps that watermarks accept."""
    events = S.source(t.spark, f"{t.sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), "event_type", k.alias("k"), "value", F.concat("event_type", F.lit(" "), F.coalesce(k.cast("string"), F.lit("?"))).alias("question"))


@query(f"WITH {_CARRY} SELECT event_id, session, last_value(y IGNORE NULLS) OVER o AS year, last_value(w IGNORE NULLS) OVER o AS task FROM i WINDOW o AS (PARTITION BY session, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def stream_session_carry(t: Tables):
    """session_carry as state of a stream."""
    return S.drain(turns(_stream(t)).groupBy("session").transformWithStateInPandas(S.SessionCarry(SESSION_HOURS * 3600.0), S.CARRIED, "append", "ProcessingTime"), "session-carry", idle=False, rocksdb=True)


@query(f"""WITH RECURSIVE {REQUESTS}, miss AS (SELECT question, min(ts) AS ts FROM requests GROUP BY 1 UNION ALL
  SELECT m.question, (SELECT min(r.ts) FROM requests r WHERE r.question = m.question AND r.ts >= m.ts + INTERVAL {TTL_HOURS} HOUR) FROM miss m WHERE m.ts IS NOT NULL)
SELECT event_id, CASE WHEN m.ts IS NULL THEN 'hit' ELSE 'miss' END AS outcome FROM requests r LEFT JOIN (SELECT * FROM miss WHERE ts IS NOT NULL) m ON r.question = m.question AND r.ts = m.ts""")
def stream_cache_replay(t: Tables):
    """cache_replay as state of a stream."""
    return S.drain(_stream(t).select("question", "ts", "event_id").groupBy("question").transformWithStateInPandas(S.CacheReplay(TTL_HOURS * 3600.0), "event_id long, outcome string", "append", "ProcessingTime"), "cache-replay", idle=False, rocksdb=True)


#: Hours for which the cache keeps that there was no answer.
NEGATIVE_HOURS = 1


@query(f"""WITH RECURSIVE {REQUESTS}, keep AS (SELECT *, CASE WHEN event_type = 'error' THEN INTERVAL {NEGATIVE_HOURS} HOUR ELSE INTERVAL {TTL_HOURS} HOUR END AS life FROM requests),
miss AS (SELECT question, life, min(ts) AS ts FROM keep GROUP BY ALL UNION ALL SELECT m.question, m.life, (SELECT min(r.ts) FROM keep r WHERE r.question = m.question AND r.ts >= m.ts + m.life) FROM miss m WHERE m.ts IS NOT NULL)
SELECT event_id, CASE WHEN m.ts IS NULL THEN 'hit' ELSE 'miss' END AS outcome FROM requests r LEFT JOIN (SELECT * FROM miss WHERE ts IS NOT NULL) m ON r.question = m.question AND r.ts = m.ts""")
def stream_negative_cache(t: Tables):
    """The cache as state of a stream, in which what was not found (errors) is kept for a shorter time."""
    rows = _stream(t).select("question", "ts", "event_id", (F.col("event_type") != "error").alias("found"))
    return S.drain(rows.groupBy("question").transformWithStateInPandas(S.CacheReplay(TTL_HOURS * 3600.0, NEGATIVE_HOURS * 3600.0), "event_id long, outcome string", "append", "ProcessingTime"), "negative-cache", idle=False, rocksdb=True)


@query(f"""WITH {REQUESTS}, l AS (SELECT session, ts, lag(ts) OVER (PARTITION BY session ORDER BY ts) AS before FROM requests), i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL {SESSION_HOURS} HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts) AS island FROM l)
SELECT session, min(ts) AS start_at, max(ts) + INTERVAL {SESSION_HOURS} HOUR AS end_at, count(*) AS n FROM i GROUP BY session, island""")
def session_windows(t: Tables):
    w = requests(t).groupBy("session", F.session_window("ts", f"{SESSION_HOURS} hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("session", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")


@query("SELECT user_id AS session, date_trunc('hour', ts) AS start_at, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_violations(t: Tables):
    """Sessions with more than one request in an hour."""
    w = requests(t).groupBy("session", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).where("n > 1")
    return w.select("session", F.col("w.start").alias("start_at"), "n")


@query("""WITH x AS (SELECT user_id AS session, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * unnest(range(0, 6))) AS start_at FROM events) SELECT session, start_at, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 2""")
def rate_sliding(t: Tables):
    """Sessions with more than two requests in any hour that begins at a full ten minutes."""
    w = requests(t).groupBy("session", F.window("ts", "1 hour", "10 minutes").alias("w")).agg(F.count("*").alias("n")).where("n > 2")
    return w.select("session", F.col("w.start").alias("start_at"), "n")


#: Rate limits of two kinds of requests, by groups of users: microseconds a request, and the burst.  The shape is that of
#: twelve a minute with a burst of 5 and thirty with a burst of 10, stretched to the pace of the log.
CHAT, FEEDBACK = (6 * 3_600_000_000, 5), (2 * 3_600_000_000, 10)


def _limited_sql(interval: int, burst: int, kinds: str) -> str:
    """The bucket as a fold over each group's requests in order."""
    grown = f"CASE WHEN s.last IS NULL THEN 0 ELSE greatest(0, s.excess - (x.at - s.last) + {interval}) END"
    ok = f"{grown} <= {burst * interval}"
    none = "NULL::BIGINT"
    return f"""SELECT bucket, unnest(ids) AS event_id, unnest(outs[2:]) AS accepted FROM (
  SELECT bucket, list(event_id ORDER BY ts, event_id) AS ids, list_reduce(list_prepend({{'at': {none}, 'excess': 0::BIGINT, 'last': {none}, 'outs': [true]}},
    list(({{'at': epoch_us(ts), 'excess': 0::BIGINT, 'last': {none}, 'outs': [true]}}) ORDER BY ts, event_id)),
    lambda s, x: {{'at': x.at, 'excess': CASE WHEN {ok} THEN {grown} ELSE s.excess END, 'last': CASE WHEN {ok} THEN x.at ELSE s.last END, 'outs': list_append(s.outs, {ok})}}).outs AS outs
  FROM (SELECT *, user_id % 16 AS bucket FROM events WHERE event_type IN ({kinds})) GROUP BY bucket)"""


def _asked(t: Tables, kinds: tuple[str, ...]):
    return t.events.where(F.col("event_type").isin(*kinds)).select((F.col("user_id") % 16).alias("bucket"), "ts", "event_id")


@query(_limited_sql(*CHAT, "'view', 'click'"))
def rate_bucket(t: Tables):
    """Requests that a leaky bucket with a burst lets through, or refuses."""
    return L.limited(_asked(t, ("view", "click")), "bucket", "ts", "event_id", *CHAT)


@query(_limited_sql(*FEEDBACK, "'purchase', 'signup', 'error'"))
def stream_rate_bucket(t: Tables):
    """The bucket as state of a stream."""
    rows = _stream(t).where("event_type NOT IN ('view', 'click')").select((F.col("session") % 16).alias("key"), "ts", "event_id")
    out = rows.groupBy("key").transformWithStateInPandas(S.LeakyBucket(*FEEDBACK), "key long, event_id long, accepted boolean", "append", "ProcessingTime")
    return S.drain(out, "rate-bucket", idle=False, rocksdb=True).withColumnRenamed("key", "bucket")


@query(f"""WITH x AS (SELECT user_id % 16 AS bucket, event_id, row_number() OVER o * {CHAT[0]} - epoch_us(ts) AS level FROM events WHERE event_type IN ('view', 'click') WINDOW o AS (PARTITION BY user_id % 16 ORDER BY ts, event_id))
SELECT bucket, event_id, (level - min(level) OVER (PARTITION BY bucket ORDER BY level_turn ROWS UNBOUNDED PRECEDING))::BIGINT AS excess FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY event_ts, event_id) AS level_turn
  FROM (SELECT x.*, e.ts AS event_ts FROM x JOIN events e USING (event_id)))""")
def rate_pressure(t: Tables):
    """How full a bucket would be at each request if none were refused: a running minimum."""
    return L.pressure(_asked(t, ("view", "click")), "bucket", "ts", "event_id", CHAT[0]).select("bucket", "event_id", "excess")


@query(f"WITH {REQUESTS} SELECT question, count(*) AS n FROM requests WHERE event_type IN ('error', 'view') GROUP BY 1")
def stream_gap_counts(t: Tables):
    """Gap counts as a running aggregate of a stream; of each key the last batch counts."""
    counts = _stream(t).where("event_type IN ('error', 'view')").groupBy("question").agg(F.count("*").alias("n"))
    return S.drain_updates(counts, "gap-counts").groupBy("question").agg(F.max_by("n", "_batch").alias("n"))


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, 'corrected' FROM events WHERE event_id % 10 = 0")
def stream_dedup(t: Tables):
    """Records delivered twice, each once, within the watermark: by id and content hash, so a corrected record is one of its own."""
    again = _stream(t).withColumn("event_type", F.when(F.col("event_id") % 10 == 0, "corrected").otherwise(F.col("event_type")))
    three = _stream(t).unionByName(_stream(t)).unionByName(again).select("event_id", "event_type", "ts")
    hashed = three.withColumn("hash", F.sha2(F.concat_ws("|", "event_type", "ts"), 256)).withWatermark("ts", "60 days")
    return S.drain(hashed.dropDuplicatesWithinWatermark(["event_id", "hash"]).select("event_id", "event_type"), "dedup")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start_at, event_type, count(*) AS n FROM events GROUP BY ALL")
def metric_windows(t: Tables):
    """Counts by day and kind of a stream with a watermark of ten minutes; late rows are dropped, the last update of a window counts."""
    counts = _stream(t).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = S.drain_updates(counts.select(F.col("w.start").alias("start_at"), "event_type", "n"), "metric-windows")
    return rows.groupBy("start_at", "event_type").agg(F.max_by("n", "_batch").alias("n")).select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), "event_type", "n")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN length(text) % 2 = 0 THEN 'skipped' ELSE 'updated' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def stream_cdc_batch(t: Tables):
    """Documents as a file stream, each batch classified against the stored table (here: labelled documents, of which odd lengths have changed)."""
    known = t.labels.select("doc_id").join(t.documents.select("doc_id", F.length("text").alias("n")), "doc_id").select("doc_id", (F.col("n") - F.col("n") % 2).alias("size"))
    stream = S.source(t.spark, f"{t.sf_dir}/documents.parquet").select("doc_id", F.length("text").alias("size"))

    def apply(batch):
        ids = batch.select("doc_id")
        return cdc.classify(known.join(ids, "doc_id", "left_semi"), batch, "doc_id", "size")

    return S.drain_updates(stream, "cdc", apply, "append").select("doc_id", "state")
