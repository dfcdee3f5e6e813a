"""Extraction from texts and pages to typed rows (survey 2.9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import contacts as C
from millrace.operators import grounding as G
from millrace.operators import pages as P
from millrace.operators.blocking import containment
from millrace.operators.period import windows, with_period
from millrace.plans.inputs import AS_OF_DOCS, NOTICES, STAFF, notices, staff, stamp
from millrace.plans.registry import Tables, query
from millrace.plans.text_queries import ENT, sql_normalize, sql_tree_text
from millrace.storage import written


def _all(c, pattern, group=0):
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _sorted(c):
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


_S = "array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{}'))), ',')"


@query(f"SELECT doc_id, {_S.format(X.EMAIL)} AS emails, {_S.format(X.PHONE)} AS phones, {_S.format(X.IPV4)} AS addresses, {_S.format('[0-9]+[.][0-9]+')} AS versions FROM documents")
def entity_extract(t: Tables):
    """Sorted different e-mails, phones, addresses and version numbers."""
    c = F.col("text")
    return t.documents.select("doc_id", _sorted(_all(c, X.EMAIL)).alias("emails"), _sorted(_all(c, X.PHONE)).alias("phones"), _sorted(_all(c, X.IPV4)).alias("addresses"), _sorted(_all(c, "[0-9]+[.][0-9]+")).alias("versions"))


@query(f"SELECT lang, sum(len(regexp_extract_all(text, '{X.EMAIL}')))::BIGINT AS emails, sum(len(regexp_extract_all(text, '{X.PHONE}')))::BIGINT AS phones, sum(len(regexp_extract_all(text, '{X.IPV4}')))::BIGINT AS addresses FROM documents GROUP BY 1")
def entity_counts(t: Tables):
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return t.documents.groupBy("lang").agg(n(X.EMAIL).alias("emails"), n(X.PHONE).alias("phones"), n(X.IPV4).alias("addresses"))


def contexts(pattern: str, before: int, after: int):
    """array<struct<hit, left, right>>: every match with the text around it, in order.

    The text is split at the matches, so a hit's context ends at its neighbours.  All of it happens
    within the row: nothing is shuffled.
    """
    parts = F.arrays_zip(F.split("text", pattern, -1).alias("left"), _all(F.col("text"), pattern).alias("hit"), F.slice(F.split("text", pattern, -1), F.lit(2), F.lit(1 << 30)).alias("right"))
    tail = lambda c: F.when(F.length(c) > before, F.substr(c, F.length(c) - before + 1, F.lit(before))).otherwise(c)
    told = F.transform(parts, lambda x: F.struct(x["hit"].alias("hit"), tail(x["left"]).alias("left"), F.substr(x["right"], F.lit(1), F.lit(after)).alias("right")))
    return F.filter(told, lambda x: x["hit"].isNotNull())


def matching(docs, pattern: str):
    return docs.where(F.col("text").rlike(pattern))


def _context_sql(pattern: str, before: int, after: int) -> str:
    return rf"""g AS (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS h FROM documents WHERE regexp_matches(text, '{pattern}')),
x AS (SELECT doc_id, unnest(range(0, len(h))) AS n, g, h FROM g),
c AS (SELECT doc_id, n, h[n + 1] AS hit, CASE WHEN length(g[n + 1]) > {before} THEN substr(g[n + 1], length(g[n + 1]) - {before} + 1, {before}) ELSE g[n + 1] END AS "left", substr(g[n + 2], 1, {after}) AS "right" FROM x)"""


@query(rf"""WITH {_context_sql(X.EMAIL, 100, 60)}, s AS (SELECT doc_id, n, hit, CASE WHEN regexp_matches("left", '(the|der|le|la) ') THEN 3 ELSE 0 END + CASE WHEN regexp_matches("right", '^ [a-z]') THEN 2 ELSE 0 END - CASE WHEN contains("left", '***') THEN 4 ELSE 0 END AS score FROM c)
SELECT doc_id, arg_max(hit, (score, -n)) AS email, max(score)::INTEGER AS score FROM s WHERE score >= 2 GROUP BY 1""")
def email_context_score(t: Tables):
    """The e-mail whose surroundings speak most for it; of equal ones the first."""
    points = lambda x: F.when(x["left"].rlike("(the|der|le|la) "), 3).otherwise(0) + F.when(x["right"].rlike("^ [a-z]"), 2).otherwise(0) - F.when(x["left"].contains("***"), 4).otherwise(0)
    best = F.array_max(F.transform(contexts(X.EMAIL, 100, 60), lambda x, i: F.struct(points(x).alias("score"), (-i).alias("i"), x["hit"].alias("email"))))
    return matching(t.documents, X.EMAIL).select("doc_id", best.alias("b")).where("b.score >= 2").select("doc_id", "b.email", "b.score")


NUMBER = X.IPV4 + r"|\+1 \([0-9]{3}\) 555-[0-9]{4}"


@query(rf"""WITH {_context_sql(NUMBER, 60, 40)}, s AS (SELECT doc_id, n, hit, regexp_extract("left", '([A-Z][a-z]+)[^A-Z]*$', 1) AS person, CASE WHEN starts_with(hit, '+') THEN 5 ELSE 1 END + CASE WHEN contains("left", ', ') THEN 1 ELSE 0 END - CASE WHEN contains("right", '###') THEN 3 ELSE 0 END AS score FROM c)
SELECT doc_id, arg_max(hit, (score, -n)) AS phone, arg_max(person, (score, -n)) AS person, max(score)::INTEGER AS score FROM s WHERE score > 0 GROUP BY 1""")
def phone_context_score(t: Tables):
    """The number with the best surroundings and the last capitalised word before it."""
    points = lambda x: F.when(x["hit"].startswith("+"), 5).otherwise(1) + F.when(x["left"].contains(", "), 1).otherwise(0) - F.when(x["right"].contains("###"), 3).otherwise(0)
    person = lambda x: F.regexp_extract(x["left"], "([A-Z][a-z]+)[^A-Z]*$", 1)
    best = F.array_max(F.transform(contexts(NUMBER, 60, 40), lambda x, i: F.struct(points(x).alias("score"), (-i).alias("i"), x["hit"].alias("phone"), person(x).alias("person"))))
    return matching(t.documents, NUMBER).select("doc_id", best.alias("b")).where("b.score > 0").select("doc_id", "b.phone", "b.person", "b.score")


# Orders as announcements, in seven ways; both engines read the words, each in its own form of dates.
_SAID = (
    ("행사일 ", "x:yyyy. M. d.", " 신청기간: ", "d:yyyy. M. d.", " ~ ", "e:yyyy-MM-dd", " 18:00 (단과대학)"),
    ("안내. 접수 마감: ~ ", "e:M. d.", " 담당 010"),
    ("모집 일정: ", "d:yyyy/MM/dd", " ~ ", "e:d", "일. 문의 바람"),
    ("신청 ", "e:yyyy년 M월 d일", "까지. 행사 ", "x:yyyy. M. d."),
    ("등록: ", "d:yyyy. M. d.", " 오후 2시부터 선착순"),
    ("신청기간: ", "x:yyyy. M. d.", " ~ ", "y:yyyy. M. d.", ". 지원서 접수기간: ", "d:yyyy-MM-dd", " ~ ", "e:yyyy-MM-dd", "."),
    ("제출기한: 2024. 13. 45. ~ 99. 99. 접수는 방문. 또한 ", "x:yyyy. M. d.", " 행사"),
)
_DAYS = {"d": 0, "e": None, "x": 100, "y": 103}


def announcements(t: Tables):
    """Orders as announcements: id, day of publication, text with several labels and dates."""
    day = lambda c: F.date_add("o_orderdate", (F.col("o_orderkey") % 25).cast("int") if c == "e" else F.lit(_DAYS[c]))
    words = lambda p: F.date_format(day(p[0]), p[2:]) if p[:2] in ("d:", "e:", "x:", "y:") else F.lit(p)
    said = F.lit(None).cast("string")
    for i, parts in enumerate(_SAID):
        said = F.when(F.col("o_orderkey") % len(_SAID) == i, F.concat(*map(words, parts))).otherwise(said)
    rows = t.orders.select("o_orderkey", F.add_months("o_orderdate", 120).alias("o_orderdate"))  # years that begin with 20
    return rows.select("o_orderkey", "o_orderdate", day("e").alias("last_day"), said.alias("text"))


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 7)::INTEGER AS way, (o_orderdate + INTERVAL 10 YEAR)::DATE AS d, (o_orderdate + INTERVAL 10 YEAR)::DATE + (o_orderkey % 25)::INTEGER AS e FROM orders),
s AS (SELECT *, try_cast(year(d) || '-' || month(e) || '-' || day(e) AS DATE) AS inherited, try_cast(year(d) || '-' || month(d) || '-' || day(e) AS DATE) AS short FROM o),
p AS (SELECT o_orderkey, CASE WHEN way IN (0, 2, 5) THEN d::TIMESTAMP WHEN way = 4 THEN d + INTERVAL 14 HOUR END AS start_at,
  CASE way WHEN 0 THEN e + INTERVAL 18 HOUR WHEN 1 THEN inherited + INTERVAL 1439 MINUTE WHEN 2 THEN CASE WHEN short >= d THEN short + INTERVAL 1439 MINUTE END WHEN 3 THEN e + INTERVAL 1439 MINUTE WHEN 5 THEN e + INTERVAL 1439 MINUTE WHEN 6 THEN d + 100 + INTERVAL 1439 MINUTE END AS end_at, way FROM s)
SELECT o_orderkey, CASE WHEN way = 0 AND end_at < start_at THEN NULL ELSE start_at END AS start_at, end_at,
  CASE WHEN start_at IS NULL AND end_at IS NULL THEN 'none' WHEN start_at IS NULL THEN 'deadline' WHEN end_at IS NULL THEN 'start_only' WHEN way = 2 THEN 'short_end' ELSE 'range' END AS shape FROM p""")
def period_extract(t: Tables):
    """Start and end of the period that an announcement gives: several labels, five shapes, dates that do not exist."""
    return with_period(announcements(t), "text", "o_orderdate", name="p").select("o_orderkey", "p.start_at", "p.end_at", "p.shape")


#: Labels of the documents as they are, and what looks like a date in them.
_LABEL, _DATED = "(?i)(?:licensed under|version|released|token|user)", "[0-9]{1,2}[.][0-9]{1,2}"


@query(rf"""WITH x AS (SELECT doc_id, string_split_regex(text, '{_LABEL}') AS b, regexp_extract_all(text, '{_LABEL}') AS h FROM documents WHERE regexp_matches(text, '{_LABEL}')),
z AS (SELECT doc_id, h, flatten(list_transform(range(1, len(b) + 1), lambda k: [b[k], coalesce(h[k], '')])) AS parts FROM x), r AS (SELECT doc_id, h, parts, unnest(range(0, len(h))) AS i FROM z),
w AS (SELECT doc_id, i, h[i + 1] AS label, left(array_to_string(parts[2 * i + 2:], ''), length(h[i + 1]) + 240) AS w FROM r),
d AS (SELECT *, len(regexp_extract_all(w, '{_DATED}')) AS dates, regexp_matches(label, '(?i)version|licensed') AS explicit, strpos(w, regexp_extract(w, '{_DATED}')) - 1 AS first FROM w)
SELECT doc_id, i::INTEGER AS i, label, dates::INTEGER AS dates, (dates + CASE WHEN explicit THEN 4 ELSE 0 END + CASE WHEN contains(left(w, 180), '~') THEN 2 ELSE 0 END)::INTEGER AS score FROM d
WHERE dates > 0 AND (explicit OR (first <= 25 AND NOT regexp_matches(substr(w, length(label) + 1, greatest(first - length(label), 0)), '[.!?]')))""")
def period_candidates(t: Tables):
    """Windows behind labels of the documents as they are, scored by dates, label and range mark."""
    found = windows(F.col("text"), _LABEL, _DATED, ("Version", "version", "VERSION", "Licensed", "licensed", "LICENSED"))
    return matching(t.documents, _LABEL).select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.i", "w.label", "w.dates", "w.score")


@query(f"""WITH {NOTICES} SELECT doc_id, CASE WHEN regexp_matches(lower(title), 'licen|released') THEN 'license' WHEN contains(lower(content), 'token =') THEN 'secret' WHEN regexp_matches(content, '{X.EMAIL}') THEN 'contact' ELSE 'plain' END AS category,
  concat_ws(',', CASE WHEN contains(content, '@') THEN 'write' END, CASE WHEN contains(lower(content), 'licensed') THEN 'use' END) AS actions, published_at <= TIMESTAMP '{AS_OF_DOCS}' AS visible, {_S.replace('text', 'content').format(X.EMAIL)} AS emails FROM notices""")
def structure_docs(t: Tables):
    """The typed record of a notice: category from title before text, actions in order, state, contacts."""
    c, low = F.col("content"), F.lower("content")
    category = F.when(F.lower("title").rlike("licen|released"), "license").when(low.contains("token ="), "secret").when(c.rlike(X.EMAIL), "contact").otherwise("plain")
    actions = F.concat_ws(",", F.when(c.contains("@"), F.lit("write")), F.when(low.contains("licensed"), F.lit("use")))
    return notices(t).select("doc_id", category.alias("category"), actions.alias("actions"), (F.col("published_at") <= stamp(AS_OF_DOCS)).alias("visible"), _sorted(_all(c, X.EMAIL)).alias("emails"))


STEPS = r"""s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS step, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM documents)"""


def chosen(t: Tables, keep, least: int, most: int):
    """(doc_id, total, i, step): sentences that keep lets through, at most so many, of documents with at least so many; within the row."""
    steps = F.filter(F.split("text", r"\. "), keep)
    rows = t.documents.select("doc_id", steps.alias("s")).where(F.size("s") >= least)
    return rows.select("doc_id", F.size("s").alias("total"), F.posexplode(F.slice("s", 1, most)).alias("i", "step"))


@query(rf"""WITH {STEPS}, k AS (SELECT doc_id, i, step FROM s WHERE length(step) >= 10 AND NOT contains(step, '***') AND NOT contains(step, '|')), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, substr(trim(step), 1, 60) AS step FROM k)
SELECT doc_id, n, step FROM r WHERE n <= 10""")
def procedure_steps(t: Tables):
    """Ordered steps without denied ones, renumbered, at most ten."""
    k = chosen(t, lambda x: (F.length(x) >= 10) & ~x.contains("***") & ~x.contains("|"), 1, 10)
    return k.select("doc_id", (F.col("i") + 1).alias("n"), F.substring(F.trim("step"), 1, 60).alias("step"))


@query(r"""WITH p AS (SELECT doc_id, string_split(text, ' | ') AS parts, list_distinct(regexp_extract_all(text, '[a-z0-9]+@mail[0-9]')) AS links FROM documents WHERE contains(text, ' | ')),
x AS (SELECT doc_id, unnest(range(0, least(len(parts), 12))) AS i, parts, links FROM p)
SELECT doc_id, (i + 1)::INTEGER AS step, substr(parts[i + 1], 1, 40) AS part, CASE WHEN len(links) = 1 THEN links[1] END AS link FROM x""")
def flow_steps(t: Tables):
    """Parts of a flow, at most twelve; the link goes to all of them if there is exactly one."""
    links = F.array_distinct(_all(F.col("text"), "[a-z0-9]+@mail[0-9]"))
    rows = t.documents.where(F.col("text").contains(" | ")).select("doc_id", links.alias("l"), F.posexplode(F.slice(F.split("text", r" \| "), 1, 12)).alias("i", "x"))
    return rows.select("doc_id", (F.col("i") + 1).alias("step"), F.substring("x", 1, 40).alias("part"), F.when(F.size("l") == 1, F.col("l")[0]).alias("link"))


@query(rf"""WITH {STEPS}, m AS (SELECT doc_id, i, step, regexp_matches(step, '(?i)^(the|der|le|la|el|of|und) ') AS marked FROM s), k AS (SELECT doc_id, i, step FROM m WHERE marked),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id) AS total, substr(step, 1, 40) AS step FROM k)
SELECT doc_id, n, step, CASE WHEN total >= 4 THEN 0.94::DOUBLE ELSE 0.86::DOUBLE END AS confidence FROM r WHERE total >= 2 AND n <= 8""")
def procedure_recover(t: Tables):
    """Steps recovered from marked sentences, if there are two at least; surer if there are more."""
    k = chosen(t, lambda x: x.rlike("(?i)^(the|der|le|la|el|of|und) "), 2, 8)
    return k.select("doc_id", (F.col("i") + 1).alias("n"), F.substring("step", 1, 40).alias("step"), F.when(F.col("total") >= 4, 0.94).otherwise(0.86).alias("confidence"))


@query(r"""WITH l AS (SELECT doc_id, regexp_extract(text, '(?:^|\n)([^\n]*?)\.', 1) AS line FROM documents), x AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(line, '[,;|]'), lambda v: trim(v)), lambda v: length(v) BETWEEN 2 AND 160)[1:10]) AS value,
  generate_subscripts(list_filter(list_transform(regexp_split_to_array(line, '[,;|]'), lambda v: trim(v)), lambda v: length(v) BETWEEN 2 AND 160)[1:10], 1) AS n FROM l) SELECT doc_id, n::INTEGER AS n, value FROM x""")
def list_fact_extract(t: Tables):
    """Values of the first listed sentence, at most ten of 2 to 160 characters."""
    line = F.regexp_extract("text", r"(?:^|\n)([^\n]*?)\.", 1)
    values = F.slice(F.filter(F.transform(F.split(line, "[,;|]"), lambda v: F.trim(v)), lambda v: F.length(v).between(2, 160)), 1, 10)
    return t.documents.select("doc_id", F.posexplode(values).alias("i", "value")).select("doc_id", (F.col("i") + 1).alias("n"), "value")


@query(r"""WITH x AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*', 1) AS l, regexp_extract_all(html, '<a href="[^"]*">([^<]*)', 1) AS label FROM pages),
y AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || l[i] AS link, label[i] AS label, starts_with(url, 'https:') AS secure FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM x))
SELECT page_id, link FROM y WHERE secure AND regexp_matches(lower(label), '^(the|der|de|la|of|in)$') GROUP BY ALL""")
def url_in_context(t: Tables):
    """Links whose label has an action word, on pages of a secure host."""
    pairs = F.arrays_zip(_all(F.col("html"), '<a href="([^"]*)">[^<]*', 1).alias("l"), _all(F.col("html"), '<a href="[^"]*">([^<]*)', 1).alias("x"))
    said = F.filter(pairs, lambda p: F.lower(p["x"]).rlike("^(the|der|de|la|of|in)$"))
    host = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    return t.pages.where(F.col("url").startswith("https:")).select("page_id", F.explode(F.array_distinct(F.transform(said, lambda p: F.concat(host, p["l"])))).alias("link"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '(?i)licensed|released|token') THEN i END AS marker FROM l)
SELECT doc_id, i::INTEGER AS line_no, (last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))::INTEGER AS locator FROM m WHERE line <> ''""")
def locator_asof(t: Tables):
    """For each line the nearest marker line at or before it."""
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")  # noqa: E741
    marker = F.when(F.col("line").rlike("(?i)licensed|released|token"), F.col("line_no"))
    return l.select("doc_id", "line_no", F.last(marker, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no")).alias("locator"))


@query(r"""SELECT page_id, array_to_string(list_distinct_ordered, ',') AS links FROM (SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(url || ' ' || html, 'https://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+'), lambda u: rtrim(u, '.,;:!?)')))) AS list_distinct_ordered FROM pages)""")
def https_links(t: Tables):
    """https links in ASCII characters, trailing punctuation trimmed, sorted."""
    found = _all(F.concat_ws(" ", "url", "html"), "https://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+")
    return t.pages.select("page_id", _sorted(F.transform(found, lambda u: F.rtrim(u, F.lit(".,;:!?)")))).alias("links"))


#: Where a page's content stands, in the order of preference.
CONTENT = ("main", ".content", "article", "body")


@query(f"""WITH x AS (SELECT page_id, {sql_tree_text("regexp_extract(html, '<article>(.*)</article>', 1, 's')")} AS a,
  {sql_tree_text("regexp_replace(regexp_extract(html, '<body>(.*)$', 1, 's'), '<(script|style)>.*?</(script|style)>|<!--.*?-->', ' ', 'gs')")} AS b FROM pages)
SELECT page_id, CASE WHEN length(a) >= 5 THEN 'article' ELSE 'body' END AS selector, sha256(CASE WHEN length(a) >= 5 THEN a ELSE b END) AS digest, length(CASE WHEN length(a) >= 5 THEN a ELSE b END) AS n FROM x WHERE length(a) >= 5 OR length(b) >= 5""")
def page_main_content(t: Tables):
    """The text of the longest node of the first selector that has a usable one."""
    found = P.main_content(written(P.tree(t.pages), "tree"), CONTENT)
    return found.select("page_id", "selector", F.sha2("content", 256).alias("digest"), F.length("content").alias("n"))


@query(rf"""WITH x AS (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">.*?</a>') AS l FROM pages), y AS (SELECT page_id, url, unnest(range(0, len(l))) AS i, l FROM x),
r AS (SELECT page_id, url, i, {ENT.format("regexp_extract(l[i + 1], 'href=\"([^\"]*)\"', 1)")} AS ref, {sql_normalize("l[i + 1]")} AS name FROM y),
z AS (SELECT page_id, i, name, CASE WHEN regexp_matches(ref, '^https?://') THEN ref WHEN starts_with(ref, '/') THEN regexp_extract(url, '^https?://[^/?#]+') || ref ELSE regexp_replace(regexp_extract(url, '^[^?#]*'), '[^/]*$', '') || ref END AS link FROM r),
f AS (SELECT page_id, link, min(i) AS i, arg_min(name, i) AS name FROM z GROUP BY page_id, link)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS turn, 'link' AS kind, link, name FROM f""")
def page_links(t: Tables):
    """Attachments, images and links of a page made absolute, each once, in the order of the page."""
    found = P.page_references(written(P.tree(t.pages), "tree"), t.pages)
    turn = F.row_number().over(Window.partitionBy("page_id").orderBy("place")) - 1
    return found.select("page_id", turn.alias("turn"), "kind", "link", "name")


@query(rf"""WITH {_context_sql(X.IPV4, 30, 10)}, o AS (SELECT doc_id, hit, regexp_extract("left", '([A-Za-z]+)[^A-Za-z]*$', 1) AS label, min(n) AS n FROM c GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, hit, label) AS turn FROM o)
SELECT doc_id, hit AS number, label, turn FROM d WHERE turn <= 8""")
def contact_options(t: Tables):
    """Different numbers with the word before each, at most eight."""
    label = lambda x: F.regexp_extract(x["left"], "([A-Za-z]+)[^A-Za-z]*$", 1)
    options = F.slice(F.array_distinct(F.transform(contexts(X.IPV4, 30, 10), lambda x: F.struct(x["hit"].alias("number"), label(x).alias("label")))), 1, 8)
    return matching(t.documents, X.IPV4).select("doc_id", F.posexplode(options).alias("i", "o")).select("doc_id", "o.number", "o.label", (F.col("i") + 1).alias("turn"))


def proposals(t: Tables):
    """Benchmark items as externally proposed facts: quote, confidence, number."""
    return t.benchmark.select("item_id", F.col("text").alias("quote"), (F.lit(0.5) + (F.col("item_id") % 5) / 10).alias("confidence"))


PROPOSED = """
proposals AS (SELECT item_id, text AS quote, 0.5::DOUBLE + (item_id % 5) / 10 AS confidence FROM benchmark),
squeezed AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS body FROM documents), sq AS (SELECT item_id, regexp_replace(quote, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS q FROM proposals),
grounded AS (SELECT item_id, min(doc_id) AS doc_id, count(*) AS documents FROM sq JOIN squeezed ON contains(body, q) GROUP BY 1)"""


def grounded(t: Tables):
    """(item_id, doc_id, documents): where a proposal's quote stands word for word, white space aside."""
    body = t.documents.select("doc_id", X.squeeze(F.col("text")).alias("body"))
    quotes = proposals(t).select("item_id", X.squeeze(F.col("quote")).alias("q"))
    return containment(body, quotes, "body", "q").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("documents"))


@query(f"""WITH {PROPOSED} SELECT item_id, doc_id, CASE WHEN doc_id IS NULL THEN NULL ELSE quote END AS quote, CASE WHEN doc_id IS NULL THEN least(confidence, 0.6::DOUBLE) ELSE confidence END AS confidence, doc_id IS NULL AS needs_review FROM proposals LEFT JOIN grounded USING (item_id)""")
def ground_fields(t: Tables):
    """Facts whose quote no source holds lose it, are capped in confidence and marked for review."""
    none = F.col("doc_id").isNull()
    return proposals(t).join(grounded(t), "item_id", "left").select("item_id", "doc_id", F.when(~none, F.col("quote")).alias("quote"), F.when(none, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence")).alias("confidence"), none.alias("needs_review"))


#: What is claimed of an announcement: its days as they are or shifted, a telephone, a person; both engines read it.
_CLAIMS = {
    "excerpt": "CASE WHEN o_orderkey % 5 = 1 THEN 'not in the text' ELSE replace(substr(text, 3, 12), ' ', '  ') END",
    "locator": "CASE WHEN o_orderkey % 11 <> 4 THEN 'body' END",
    "phone": "CASE o_orderkey % 4 WHEN 1 THEN '02-2016-1234' WHEN 2 THEN '010' END",
    "email": "CASE WHEN o_orderkey % 6 = 5 THEN 'a@b.kr' END",
    "person": "CASE o_orderkey % 3 WHEN 1 THEN '단과 대학 팀장' WHEN 2 THEN '행사 교수' END",
}


def _said_sql(days: str) -> str:
    """The announcements' words in DuckDB; days: the expression of each letter's day."""
    forms = {"yyyy. M. d.": "%Y. %-m. %-d.", "yyyy-MM-dd": "%Y-%m-%d", "M. d.": "%-m. %-d.", "yyyy/MM/dd": "%Y/%m/%d", "d": "%-d", "yyyy년 M월 d일": "%Y년 %-m월 %-d일"}
    of = {"d": "d", "e": "e", "x": "d + 100", "y": "d + 103"}
    part = lambda p: f"strftime({of[p[0]]}, '{forms[p[2:]]}')" if p[:2] in ("d:", "e:", "x:", "y:") else f"'{p}'"
    return f"CASE {days} " + " ".join(f"WHEN {i} THEN {' || '.join(map(part, parts))}" for i, parts in enumerate(_SAID)) + " END"


#: Suppliers as notices with a contact, in five ways: the text, then person and number that it names; both engines read them.
_CONTACTS = (
    ("concat('안내문. 담당자 및 업무: 홍길동 (신청). 문의 031-280-', ext)", "'홍길동'", "concat('031-280-', ext)"),
    ("concat('업무 담당: 김철수 주무관, 전화 02-555-', ext, ', FAX 02-555-9999')", "'김철수 주무관'", "NULL"),
    ("concat('회계팀 02-555-1111 문의. 이 안내는 다음 부서의 것입니다. ', office, ' 02-555-', ext, ' 문의')", "NULL", "concat('02-555-', ext)"),
    ("concat('박영희 교수 02-555-', ext)", "'박영희 교수'", "NULL"),
    ("concat('연락처 없음 ', ext)", "NULL", "NULL"),
)
_OFFICE = "concat(replace(replace(department, ' ', ''), '_', ''), '팀')"


@query(f"""WITH {STAFF}, s AS (SELECT staff_id, (staff_id % 5)::INTEGER AS way, extension AS ext, {_OFFICE} AS office FROM staff)
SELECT staff_id, CASE way {" ".join(f"WHEN {i} THEN {p}" for i, (_, p, _) in enumerate(_CONTACTS))} END AS person, CASE way {" ".join(f"WHEN {i} THEN {n}" for i, (_, _, n) in enumerate(_CONTACTS))} END AS phone FROM s""")
def notice_contacts(t: Tables):
    """Person and telephone that a notice names, by five patterns and by what stands around the numbers."""
    rows = staff(t).select("staff_id", F.col("extension").alias("ext"), F.expr(_OFFICE).alias("office"), (F.col("staff_id") % 5).alias("way"))
    told = F.expr("CASE way " + " ".join(f"WHEN {i} THEN {x}" for i, (x, _, _) in enumerate(_CONTACTS)) + " END")
    return rows.withColumn("text", told).select("staff_id", C.person(F.col("text")).alias("person"), C.phone(F.col("text"), F.col("office")).alias("phone"))


def _grounded_day_sql(day: str) -> str:
    """Whether one of the four spellings of a day stands in the text."""
    y, m, d = f"year({day})", f"month({day})", f"day({day})"
    forms = (f"{y} || '\\s*년\\s*0?' || {m} || '\\s*월\\s*0?' || {d} || '\\s*일'", f"{y} || '\\s*[./-]\\s*0?' || {m} || '\\s*[./-]\\s*0?' || {d} || '([^0-9]|$)'",
             f"'(^|[^0-9])0?' || {m} || '\\s*월\\s*0?' || {d} || '\\s*일'", f"'(^|[^0-9])0?' || {m} || '\\s*[./]\\s*0?' || {d} || '([^0-9]|$)'")
    return "(" + " OR ".join(f"regexp_matches(text, {f})" for f in forms) + ")"


@query(f"""WITH o AS (SELECT o_orderkey, (o_orderdate + INTERVAL 10 YEAR)::DATE AS d, (o_orderdate + INTERVAL 10 YEAR)::DATE + (o_orderkey % 25)::INTEGER AS e FROM orders),
a AS (SELECT o_orderkey, d AS start, e + (o_orderkey % 2)::INTEGER AS "end", {_said_sql("o_orderkey % 7")} AS text FROM o), c AS (SELECT *, {", ".join(f"{e} AS {k}" for k, e in _CLAIMS.items())} FROM a),
g AS (SELECT *, contains(replace(text, ' ', ''), replace(excerpt, ' ', '')) AS e_ok, {_grounded_day_sql("start")} AS s_ok, {_grounded_day_sql('"end"')} AS d_ok,
  phone IS NULL OR (length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 7 AND contains(regexp_replace(text, '[^0-9]', '', 'g'), regexp_replace(phone, '[^0-9]', '', 'g'))) AS p_ok,
  email IS NULL OR contains(text, email) AS m_ok, person IS NULL OR contains(replace(text, ' ', ''), regexp_replace(replace(person, ' ', ''), '(팀장|교수)$', '')) AS n_ok FROM c)
SELECT o_orderkey, CASE WHEN s_ok THEN start END AS start, CASE WHEN d_ok THEN "end" END AS "end", CASE WHEN e_ok THEN excerpt END AS excerpt, CASE WHEN p_ok THEN phone END AS phone, CASE WHEN n_ok THEN person END AS person,
  NOT (e_ok AND s_ok AND d_ok AND p_ok AND m_ok AND n_ok AND locator IS NOT NULL) AS needs_review,
  least(0.9::DOUBLE, CASE WHEN NOT e_ok OR locator IS NULL THEN 0.5 WHEN NOT (s_ok AND d_ok AND p_ok AND m_ok AND n_ok) THEN 0.6 ELSE 1 END::DOUBLE) AS confidence FROM g""")
def ground_records(t: Tables):
    """What is claimed of each announcement, as far as its text has it: days, excerpt, telephone, e-mail, person."""
    a = announcements(t).select("o_orderkey", "text", F.col("o_orderdate").alias("start"), F.date_add("last_day", (F.col("o_orderkey") % 2).cast("int")).alias("end"))
    claims = {k: F.expr(e) for k, e in _CLAIMS.items()} | {"start": F.col("start"), "end": F.col("end"), "role": F.lit(None).cast("string"), "confidence": F.lit(0.9)}
    kept = G.grounded(claims, F.col("text"))
    return a.select("o_orderkey", *(kept[c].alias(c) for c in ("start", "end", "excerpt", "phone", "person", "needs_review", "confidence")))


@query(f"""WITH {PROPOSED} SELECT item_id, CASE WHEN length(quote) < 100 THEN 'too_short' WHEN length(quote) > 380 THEN 'too_long' WHEN confidence < 0.55 THEN 'unsure' WHEN documents IS NULL THEN 'not_in_source' WHEN documents > 3 THEN 'not_specific' ELSE 'verified' END AS verdict FROM proposals LEFT JOIN grounded USING (item_id)""")
def verify_evidence(t: Tables):
    """The first rule that a proposal fails."""
    n = F.length("quote")
    verdict = F.when(n < 100, "too_short").when(n > 380, "too_long").when(F.col("confidence") < 0.55, "unsure").when(F.col("documents").isNull(), "not_in_source").when(F.col("documents") > 3, "not_specific").otherwise("verified")
    return proposals(t).join(grounded(t), "item_id", "left").select("item_id", verdict.alias("verdict"))


# What is proposed beside the quote, from the id; both engines read these expressions.
_PROPOSED = {
    "url": "CASE WHEN item_id % 9 = 1 THEN 'https://example.org.other.net/a' WHEN item_id % 9 = 2 THEN 'none' ELSE 'https://www.example.org/a' END",
    "title": "CASE WHEN item_id % 11 = 3 THEN 'another title' ELSE substr(text, 1, 60) END",
    "value": "CASE WHEN item_id % 7 = 5 THEN 'a7 costs 12,5' ELSE 'v2' END",
    "answer": "CASE WHEN item_id % 8 = 4 THEN 'room 1001' WHEN item_id % 4 = 2 THEN 'please run curl' ELSE 'yes' END",
    "delivered": "CASE WHEN item_id % 10 = 6 THEN 'period' ELSE 'period,place' END",
    "academic_year": "CASE WHEN item_id % 12 = 7 THEN '2031' END",
    "admission_year": "CASE WHEN item_id % 13 = 8 THEN '2032' END",
    "semester": "CASE WHEN item_id % 14 = 9 THEN 'term 3' END",
    "college": "CASE WHEN item_id % 15 = 10 THEN 'no college' END",
    "department": "CASE WHEN item_id % 6 = 5 THEN 'no department' END",
}
_SQUEEZED = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_NUMBERS = "regexp_extract_all(regexp_replace({}, '[A-Za-z][0-9]', ' ', 'g'), '[0-9]+([.,][0-9]+)?')"


@query(f"""WITH {PROPOSED}, x AS (SELECT p.item_id, quote, confidence, text, {", ".join(f"{e.replace('item_id', 'p.item_id')} AS {k}" for k, e in _PROPOSED.items())}
  FROM proposals p LEFT JOIN grounded g ON g.item_id = p.item_id LEFT JOIN documents d ON d.doc_id = g.doc_id),
y AS (SELECT *, {_NUMBERS.format("quote")} AS known, {_SQUEEZED.format("text")} AS body FROM x)
SELECT item_id, CASE WHEN confidence < 0.55 THEN 'unsupported' WHEN url NOT LIKE 'https://www.example.org/%' THEN 'unapproved_domain' WHEN text IS NULL THEN 'excerpt_not_in_source'
  WHEN {_SQUEEZED.format("title")} <> {_SQUEEZED.format("substr(text, 1, 60)")} THEN 'source_title_mismatch' WHEN NOT list_has_all(known, {_NUMBERS.format("value")}) THEN 'fact_number_not_in_evidence'
  WHEN NOT list_has_all(known, {_NUMBERS.format("answer")}) THEN 'answer_number_not_in_evidence' WHEN NOT contains(delivered, 'place') THEN 'required_fact_unaccounted'
  {" ".join(f"WHEN {c} IS NOT NULL AND NOT contains(body, {c}) THEN '{c}_mismatch'" for c in ("academic_year", "admission_year", "semester", "college", "department"))}
  WHEN regexp_matches(answer, 'curl') THEN 'unsafe_output' END AS failed FROM y""")
def verify_chain(t: Tables):
    """Each proposal with the first rule of the whole chain that it breaks."""
    from millrace.operators.evidence import verdict

    texts = grounded(t).select("item_id", "doc_id").join(t.documents.select("doc_id", "text"), "doc_id")
    x = proposals(t).join(texts, "item_id", "left").select("item_id", "quote", "confidence", "text", *(F.expr(e).alias(k) for k, e in _PROPOSED.items()))
    given = {c: F.col(c) for c in _PROPOSED} | {
        "supported": F.col("confidence") >= 0.55, "excerpt": F.col("quote"), "source_text": F.col("text"), "source_title": F.substring("text", 1, 60),
        "required": F.array(F.lit("period"), F.lit("place")), "delivered": F.split("delivered", ","), "missing": F.array().cast("array<string>"),
    }
    return x.select("item_id", verdict(given, ("example.org",)).alias("failed"))


@query(f"""WITH {PROPOSED}, l AS (SELECT g.item_id, d.doc_id, strpos(d.text, p.quote) AS at_char, d.text, source FROM grounded g JOIN documents d ON d.doc_id = g.doc_id JOIN proposals p ON p.item_id = g.item_id)
SELECT item_id, doc_id, CASE WHEN at_char > 0 THEN 'offset:' || at_char WHEN source IS NOT NULL THEN 'source:' || source ELSE 'none' END AS locator, length(substr(text, 1, greatest(at_char - 1, 0))) - length(replace(substr(text, 1, greatest(at_char - 1, 0)), chr(10), '')) AS line_no FROM l""")
def fact_provenance(t: Tables):
    """Where a grounded fact comes from: its offset, else its source; and the line it starts on."""
    found = grounded(t).select("item_id", "doc_id").join(t.documents.select("doc_id", "text", "source"), "doc_id").join(proposals(t), "item_id")
    place = F.instr("text", F.col("quote"))
    head = F.substr("text", F.lit(1), F.greatest(place - 1, F.lit(0)))
    locator = F.when(place > 0, F.concat(F.lit("offset:"), place.cast("string"))).when(F.col("source").isNotNull(), F.concat(F.lit("source:"), F.col("source"))).otherwise("none")
    return found.select("item_id", "doc_id", locator.alias("locator"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).alias("line_no"))
