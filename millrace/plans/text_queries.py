"""Sources, cleaning and predicates over texts and pages (survey 2.1 to 2.3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import nested as N
from millrace.functions import text as X
from millrace.operators import pages as P
from millrace.operators.rules import compiled
from millrace.plans.inputs import HITS, NOTICES, QUESTIONS, STAFF, keyword_hits, notices, questions, staff
from millrace.plans.registry import Tables, query
from millrace.plans.rule_tables import met_sql, rule_table
from millrace.sources.files import binary_manifest as read_manifest
from millrace.sources.files import decode_bytes, file_kind
from millrace.sources.export import export_nested as write_export
from millrace.storage import new_path, written

#: SQL twins of the text expressions.
SQ = r"trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
ENT = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def sql_normalize(c: str) -> str:
    return SQ.format(ENT.format(f"regexp_replace(replace(coalesce({c}, ''), chr(0), ' '), '<[^>]+>', ' ', 'g')"))


#: Of what the parse of page trees decodes (all of HTML), the same as above: HTML takes these names and this number without their semicolon as well.
TREE_ENT = r"regexp_replace(regexp_replace({}, '&#0*39(;|$)', '''', 'g'), '&#0*39([^0-9;])', '''\1', 'g')"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("middot", "·"), ("copy", "©"), ("amp", "&")):
    TREE_ENT = f"regexp_replace({TREE_ENT}, '&{_name};?', '{_char}', 'g')"


def sql_tree_text(c: str) -> str:
    """sql_normalize for the texts of page trees."""
    return SQ.format(TREE_ENT.format(f"regexp_replace(replace(coalesce({c}, ''), chr(0), ' '), '<[^>]+>', ' ', 'g')"))


def sql_compact(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^0-9a-z가-힣]+', '', 'g')"


@query("SELECT 'doc:' || doc_id AS source_id, coalesce(text, '') AS content, coalesce(source, 'official_notice') AS source_type, 50 AS source_priority, 'not_required' AS extraction_status, '' AS attachment_text, 0 AS attachments FROM documents")
def src_records_defaults(t: Tables):
    """Raw records with empty defaults for the fields that a crawl may leave out."""
    return t.documents.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_id"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce("source", F.lit("official_notice")).alias("source_type"),
        F.lit(50).alias("source_priority"),
        F.lit("not_required").alias("extraction_status"),
        F.lit("").alias("attachment_text"),
        F.size(F.array()).alias("attachments"),
    )


@query("SELECT sha256(text) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def src_duplicate_ids(t: Tables):
    """Ids (content digests) that more than one record carries: a case bank with such ids is refused."""
    return t.documents.groupBy(F.sha2("text", 256).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"SELECT page_id, sha256({sql_normalize('html')}) AS digest, length({sql_normalize('html')}) AS n FROM pages")
def page_text_normalized(t: Tables):
    clean = t.pages.select("page_id", X.normalize(F.col("html")).alias("x"))
    return clean.select("page_id", F.sha2("x", 256).alias("digest"), F.length("x").alias("n"))


@query()
def binary_manifest(t: Tables):
    """The driver's Parquet files as binary attachments: name, size, digest, kind."""
    return read_manifest(t.spark, t.sf_dir, "*.parquet")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '\.html?$') THEN 'html'
  WHEN regexp_matches(lower(regexp_extract(url, '^[^?#]*')), '\.pdf$') THEN 'pdf' WHEN starts_with(html, '%PDF-') THEN 'pdf'
  WHEN regexp_matches(lower(substr(html, 1, 64)), '^\s*<(!doctype html|html)') THEN 'html' ELSE 'unsupported' END AS kind FROM pages""")
def file_kind_dispatch(t: Tables):
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return t.pages.select("page_id", file_kind(path, F.lit(None).cast("string"), F.col("html")).alias("kind"))


@query("SELECT doc_id, length(text)::INTEGER AS n, true AS same FROM documents")
def decode_fallback(t: Tables):
    """Texts encoded as UTF-8 or UTF-16 by their checksum, and what the decoder makes of the bytes."""
    odd = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2)) == 1
    raw = t.documents.select("doc_id", F.when(odd, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")).alias("body"), "text")
    return raw.select("doc_id", decode_bytes("body").alias("decoded"), "text").select("doc_id", F.length("decoded").alias("n"), (F.col("decoded") == F.col("text")).alias("same"))


@query(rf"""WITH items AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>.*?</li>') AS li FROM pages),
rows AS (SELECT page_id, unnest(range(0, len(li))) AS turn, li FROM items)
SELECT page_id, turn::INTEGER AS turn, {SQ.format(ENT.format("regexp_replace(li[turn + 1], '<[^>]+>', ' ', 'g')"))} AS title, {ENT.format("regexp_extract(li[turn + 1], 'href=\"([^\"]*)\"', 1)")} AS href FROM rows""")
def page_link_rows(t: Tables):
    """Rows of a list page: the items of the navigation, with turn, title and link."""
    rows = written(P.tree(t.pages), "tree")
    return P.board_rows(rows, "nav ul > li", "a", "a[href]", {})


@query(rf"""WITH x AS (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS q, regexp_extract_all(html, '<article>(.*?)</article>', 1, 's') AS a FROM pages),
z AS (SELECT page_id, unnest(range(1, len(q) + 1)) AS i, q, a FROM x WHERE len(q) = len(a)),
n AS (SELECT page_id, i, {sql_tree_text("q[i]")} AS question, {sql_tree_text("a[i]")} AS answer FROM z),
r AS (SELECT *, sha1('faq|' || question) AS key, row_number() OVER (PARTITION BY sha1('faq|' || question) ORDER BY page_id, i) AS turn FROM n WHERE question <> '' AND answer <> '')
SELECT page_id, question, key, length(answer) AS answer_chars FROM r WHERE turn = 1""")
def page_zip_pairs(t: Tables):
    """Headings zipped with bodies, page by page; a page whose counts differ is dropped; one row per key, the first page's."""
    pairs = P.zipped(written(P.tree(t.pages), "tree"), "h1", "article")
    keyed = pairs.withColumn("key", F.sha1(F.concat(F.lit("faq|"), F.col("question"))))
    first = F.min(F.struct("page_id", "turn", "question", F.length("answer").alias("answer_chars"))).alias("x")
    return keyed.groupBy("key").agg(first).select("x.page_id", "x.question", "key", "x.answer_chars")


@query(f"""WITH {STAFF} SELECT department, contact, duty, '02-555-' || extension AS phone, substr(sha1(department || '|' || contact || '|' || extension), 1, 16) AS key
FROM staff WHERE contact <> '' AND NOT contains(upper(contact), 'FAX')""")
def directory_parse(t: Tables):
    """Directory rows: extensions expanded to numbers, fax and empty rows dropped, a key from 16 hex digits."""
    key = F.substring(F.sha1(F.concat_ws("|", "department", "contact", "extension")), 1, 16)
    return staff(t).where((F.col("contact") != "") & ~F.upper("contact").contains("FAX")).select("department", "contact", "duty", F.concat(F.lit("02-555-"), F.col("extension")).alias("phone"), key.alias("key"))


@query(r"""WITH x AS (SELECT doc_id, regexp_extract(text, '(?i)version ([0-9]+(\.[0-9]+)?)', 1) AS version, contains(lower(substr(text, 1, 500)), 'repealed') AS repealed FROM documents)
SELECT doc_id, 'doc:' || doc_id || ':v' || version AS versioned_id, version FROM x WHERE version <> '' AND NOT repealed""")
def versioned_docs(t: Tables):
    """Documents that name a version and are not marked repealed at their head; the id carries the version."""
    version = F.regexp_extract("text", r"(?i)version ([0-9]+(\.[0-9]+)?)", 1)
    rows = t.documents.where(~F.lower(F.substring("text", 1, 500)).contains("repealed")).select("doc_id", version.alias("version")).where("version <> ''")
    return rows.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit(":v"), F.col("version")).alias("versioned_id"), "version")


@query(r"""SELECT p_partkey, p_type, p_brand, (2000 + p_size)::VARCHAR || '-' || substr(sha1(p_name), 1, 16) AS id FROM part
WHERE p_type IN ('ECONOMY', 'SMALL', 'STANDARD') AND regexp_extract('yr' || (2000 + p_size), '20[0-9][0-9]') >= '2010'""")
def catalog_filter(t: Tables):
    """Catalogue rows of allowed labels and recent years, with an id of year and digest."""
    year = (F.col("p_size") + 2000).cast("string")
    rows = t.part.where(F.col("p_type").isin("ECONOMY", "SMALL", "STANDARD") & (F.regexp_extract(F.concat(F.lit("yr"), year), "20[0-9][0-9]", 0) >= "2010"))
    return rows.select("p_partkey", "p_type", "p_brand", F.concat_ws("-", year, F.substring(F.sha1("p_name"), 1, 16)).alias("id"))


@query("""WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS published, coalesce(lines, '') AS lines FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def export_nested(t: Tables):
    """Orders with their lines nested, newest first, written by the export's own sink, and what reading it gives."""
    parents = t.orders.select(F.col("o_orderkey").alias("key"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey")
    path = new_path(t.spark, "export")
    write_export(parents, lines, "key", [F.desc("published"), "key"], ["l_linenumber", "l_partkey", "l_suppkey"], path, "lines")
    back = t.spark.read.schema("key long, o_custkey long, published string, lines array<struct<l_linenumber:int,l_partkey:long,l_suppkey:long>>").json(f"{path}/part-*.json")
    told = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), ",")
    return back.select(F.col("key").alias("o_orderkey"), "o_custkey", "published", told.alias("lines"))


@query(f"SELECT doc_id, {sql_normalize('text')} AS content FROM documents")
def doc_normalize(t: Tables):
    return t.documents.select("doc_id", X.normalize(F.col("text")).alias("content"))


@query("SELECT event_id, replace(event_type, chr(0), ' ') AS event_type, replace(props, chr(0), ' ') AS k FROM events")
def strip_control_nested(t: Tables):
    """NUL characters out of strings at any depth of a struct, array or map."""
    from millrace.functions.nested import strip_nul

    nested = t.events.select("event_id", F.struct("event_type", F.create_map(F.lit("k"), F.array("props")).alias("m")).alias("x"))
    clean = strip_nul(nested)
    return clean.select("event_id", F.col("x.event_type").alias("event_type"), F.col("x.m")["k"][0].alias("k"))


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
clean AS (SELECT doc_id, i, trim(regexp_replace(raw, '[ \t]+', ' ', 'g')) AS line FROM lines),
kept AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM clean WHERE line <> ''),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS content FROM kept WHERE before IS NULL OR before <> line GROUP BY doc_id)
SELECT doc_id, coalesce(content, '') AS content FROM documents LEFT JOIN joined USING (doc_id)""")
def doc_drop_repeated_lines(t: Tables):
    return t.documents.select("doc_id", F.coalesce(X.drop_repeated_lines(F.col("text")), F.lit("")).alias("content"))


@query(f"""SELECT p_partkey, {sql_compact('p_name')} AS compacted, replace(replace({sql_compact('p_name')}, 'widget', 'wdg'), 'bracket', 'brk') AS identity FROM part""")
def identity_key(t: Tables):
    """Comparison keys: letters and digits only, and long forms rewritten to short ones."""
    key = X.compact(F.col("p_name"))
    short = key
    for long_form, short_form in (("widget", "wdg"), ("bracket", "brk")):
        short = F.replace(short, F.lit(long_form), F.lit(short_form))
    return t.part.select("p_partkey", key.alias("compacted"), short.alias("identity"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '(?m)^#{1,6}[ ]+', '', 'g'), '(?m)^[ ]*[-*][ ]+', '• ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS plain FROM conversations""")
def strip_markup(t: Tables):
    return t.conversations.select("conv_id", "turn", X.strip_markup(F.col("text")).alias("plain"))


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_extract(text, '^[^.;:\n]*')) AS clause FROM documents)
SELECT doc_id, CASE WHEN length(clause) > 100 THEN substr(clause, 1, 100) || '…' ELSE clause END AS title, CASE WHEN length(clause) > 100 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM x""")
def title_compact(t: Tables):
    """The first clause as a title, cut at 100 characters with an ellipsis and then less sure."""
    long = F.length("clause") > 100
    return t.documents.select("doc_id", F.trim(F.regexp_extract("text", r"^[^.;:\n]*", 0)).alias("clause")).select(
        "doc_id", F.when(long, F.concat(F.substring("clause", 1, 100), F.lit("…"))).otherwise(F.col("clause")).alias("title"), F.when(long, 0.5).otherwise(0.9).alias("confidence")
    )


@query("SELECT event_id, CASE WHEN event_type IN ('signup', 'click', 'view', 'purchase') THEN event_type ELSE 'other' END AS event_type FROM events")
def domain_coerce(t: Tables):
    """Values outside the domain become its default."""
    inside = F.col("event_type").isin("signup", "click", "view", "purchase")
    return t.events.select("event_id", F.when(inside, F.col("event_type")).otherwise("other").alias("event_type"))


@query(f"""WITH {HITS},
best AS (SELECT item_id, doc_id FROM hits QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) = 1),
place AS (SELECT item_id, b.doc_id, d.text, max((length(w) * 1000000 + (1000000 - strpos(lower(d.text), w)))) FILTER (contains(lower(d.text), w)) AS x FROM best b JOIN documents d USING (doc_id) JOIN qkw USING (item_id) GROUP BY ALL)
SELECT item_id, doc_id, CASE WHEN length(text) <= 240 THEN text WHEN x IS NULL THEN substr(text, 1, 240)
  ELSE substr(text, greatest(1, (1000000 - x % 1000000) - 80), 240) END AS excerpt FROM place""")
def excerpt_window(t: Tables):
    """Of each question's best document: all of a short text, else a window around the longest keyword found, else the head."""
    best = keyword_hits(t).withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))).where("r = 1").select("item_id", "doc_id")
    rows = best.join(t.documents.select("doc_id", "text"), "doc_id").join(questions(t).select("item_id", "keywords"), "item_id")
    found = F.transform("keywords", lambda w: F.struct(F.length(w).alias("n"), (-F.instr(F.lower("text"), w)).alias("p")))
    top = F.array_max(F.filter(found, lambda x: x["p"] < 0))
    window = F.substr("text", F.greatest(F.lit(1), -top["p"] - 80), F.lit(240))
    return rows.select("item_id", "doc_id", F.when(F.length("text") <= 240, F.col("text")).when(top.isNull(), F.substring("text", 1, 240)).otherwise(window).alias("excerpt"))


@query(f"""WITH {QUESTIONS} SELECT item_id, string_agg(w, ' ' ORDER BY r) AS keywords FROM qkw GROUP BY 1""")
def query_keywords(t: Tables):
    return questions(t).where(F.size("keywords") > 0).select("item_id", F.array_join("keywords", " ").alias("keywords"))


@query(f"""WITH {NOTICES} SELECT source_id, source_priority, published_at FROM notices WHERE processed AND (contains(lower(title), 'version 2.0') OR contains(lower(content), 'version 2.0'))
ORDER BY source_priority DESC, published_at DESC, source_id LIMIT 20""")
def keyword_search_topn(t: Tables):
    """The 20 foremost notices that hold a literal string in title or text."""
    q = "version 2.0"
    found = notices(t).where("processed").where(F.lower("title").contains(q) | F.lower("content").contains(q))
    return found.orderBy(F.desc("source_priority"), F.desc("published_at"), "source_id").limit(20).select("source_id", "source_priority", "published_at")


@query(f"WITH {HITS} SELECT item_id, doc_id, hits FROM hits QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) <= 24")
def term_set_lookup(t: Tables):
    """For each question's terms the 24 documents that hold most of them."""
    turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))
    return keyword_hits(t).withColumn("turn", turn).where("turn <= 24").select("item_id", "doc_id", "hits")


@query(r"""WITH x AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority FROM pages),
h AS (SELECT *, lower(regexp_replace(authority, '^.*@|:[0-9]+$', '', 'g')) AS host FROM x)
SELECT page_id, scheme = 'https' AND host <> '' AND NOT contains(authority, '@') AND NOT regexp_matches(host, '^[0-9.]+$')
  AND (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org') AS allowed FROM h""")
def url_allowlist(t: Tables):
    """https, a host, no user info, no bare address, and an allowed domain or a name under it."""
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    user = F.try_parse_url("url", F.lit("USERINFO"))
    domain = F.lit(False)
    for d in ("example.com", "example.org"):
        domain = domain | (host == d) | host.endswith(f".{d}")
    allowed = (F.try_parse_url("url", F.lit("PROTOCOL")) == "https") & (host != "") & user.isNull() & ~host.rlike("^[0-9.]+$") & domain
    return t.pages.select("page_id", F.coalesce(allowed, F.lit(False)).alias("allowed"))


@query(r"""WITH x AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, list_contains(links, '/the') AS has_the, list_contains(links, '/de') AS has_de FROM x""")
def verified_links(t: Tables):
    """A proposed link is kept only if the page itself has exactly it."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.array_contains(links, "/the").alias("has_the"), F.array_contains(links, "/de").alias("has_de"))


PII = (("email", X.EMAIL), ("phone", X.PHONE), ("address", X.IPV4), ("id_number", X.LONG_NUMBER), ("account", r"(^|[^0-9])([0-9]{16}|[0-9]{3,6}-[0-9]{2,6}-[0-9]{3,7})($|[^0-9])"),
    ("name", r"(이름|성명|본인)\s*[:：은는]?\s*[가-힣]{2,4}"), ("grade", r"(?i)(성적|평점|학점)\s*[:：은는]?\s*([0-4]([.][0-9]{1,2})?|[A-F][+-]?)($|[^0-9A-Za-z])"))
_PII_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in PII) + ")"


def _pii(c):
    return F.concat_ws(",", *(F.when(c.rlike(p), F.lit(n)) for n, p in PII))


@query(f"SELECT doc_id, {_PII_SQL} AS labels FROM documents")
def pii_labels(t: Tables):
    """Labels of the sensitive data in a text, never the values."""
    return t.documents.select("doc_id", _pii(F.col("text")).alias("labels"))


@query(f"SELECT label, lang, count(*) AS n FROM (SELECT lang, unnest(string_split({_PII_SQL}, ',')) AS label FROM documents) WHERE label <> '' GROUP BY ALL")
def pii_summary(t: Tables):
    return t.documents.select("lang", F.explode(F.split(_pii(F.col("text")), ",")).alias("label")).where("label <> ''").groupBy("label", "lang").agg(F.count("*").alias("n"))


@query(f"""WITH said AS (SELECT conv_id, turn AS place, text FROM conversations), {met_sql("harm", "said", "conv_id, place")}, x AS (SELECT conv_id, place, list(rule) AS r FROM met GROUP BY ALL)
SELECT conv_id, place AS turn, coalesce(list_contains(r, 'harm.act') AND NOT (list_contains(r, 'harm.benign') AND NOT list_contains(r, 'harm.hidden')), false) AS dangerous, coalesce(list_contains(r, 'harm.report'), false) AS reporting FROM said LEFT JOIN x USING (conv_id, place)""")
def unsafe_filter(t: Tables):
    """Action and intent without a benign context, and reports of harm."""
    rules = compiled(rule_table(t))
    said = t.conversations.select("conv_id", "turn", rules.read(F.col("text")).alias("b"))
    met = {k: rules.holds(F.col("b"), f"harm.{k}") for k in ("act", "benign", "hidden", "report")}
    return said.select("conv_id", "turn", (met["act"] & ~(met["benign"] & ~met["hidden"])).alias("dangerous"), met["report"].alias("reporting"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+\.[0-9]+') AS versions FROM documents), asked(version) AS (VALUES ('2.0'), ('4.0'), ('3.0'))
SELECT doc_id, version, len(versions) = 0 OR list_contains(versions, version) AS passes FROM d CROSS JOIN asked""")
def constraint_filter(t: Tables):
    """A document passes a question's constraint if it names no value of that kind, or names the asked one."""
    versions = F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))
    # the asked values are a short literal list
    asked = F.explode(F.array(*map(F.lit, ("2.0", "4.0", "3.0"))))
    return t.documents.select("doc_id", versions.alias("v"), asked.alias("version")).select("doc_id", "version", ((F.size("v") == 0) | F.array_contains("v", F.col("version"))).alias("passes"))


@query(f"""WITH {NOTICES}, {met_sql("g", "notices", "doc_id", "content")}, titled AS (SELECT doc_id, rule FROM notices JOIN rules ON contains(lower(title), term) GROUP BY ALL),
x AS (SELECT m.doc_id, m.rule, t.rule IS NOT NULL AS named FROM met m LEFT JOIN titled t ON m.doc_id = t.doc_id AND m.rule = t.rule WHERE m.rule LIKE 'group.%')
SELECT doc_id, count(*) AS rejected_for, min(substr(rule, 7)) AS first_group FROM x WHERE named OR doc_id NOT IN (SELECT doc_id FROM met WHERE rule = 'general') GROUP BY doc_id""")
def scope_reject(t: Tables):
    """Documents for a special group that the question (here none) does not name: titled so, or speaking of it and not general."""
    rules = compiled(rule_table(t))
    read = notices(t).select("doc_id", rules.read(F.col("content")).alias("b"), rules.read(F.col("title")).alias("n"))
    general = rules.holds(F.col("b"), "general")
    groups = F.when(general, F.array_intersect(rules.all(F.col("b"), "group."), rules.all(F.col("n"), "group."))).otherwise(rules.all(F.col("b"), "group."))
    return read.select("doc_id", groups.alias("g")).where(F.size("g") > 0).select("doc_id", F.size("g").alias("rejected_for"), F.array_min("g").alias("first_group"))


@query("""WITH p(name, lo, hi) AS (VALUES ('early', NULL::TIMESTAMP, TIMESTAMP '1996-01-01'), ('middle', TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01'), ('late', TIMESTAMP '1998-01-01', NULL::TIMESTAMP))
SELECT name, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders JOIN p ON o_orderdate >= coalesce(lo, TIMESTAMP '0001-01-01') AND o_orderdate <= coalesce(hi, TIMESTAMP '9999-12-31') GROUP BY 1""")
def range_join_open_ended(t: Tables):
    """Orders in periods that may be open at either end."""
    p = t.spark.sql("SELECT * FROM VALUES ('early', NULL, '1996-01-01'), ('middle', '1996-01-01', '1998-01-01'), ('late', '1998-01-01', NULL) AS p(name, lo, hi)")
    lo, hi = F.coalesce("lo", F.lit("0001-01-01")).cast("timestamp_ntz"), F.coalesce("hi", F.lit("9999-12-31")).cast("timestamp_ntz")
    inside = (F.col("o_orderdate") >= lo) & (F.col("o_orderdate") <= hi)
    return t.orders.join(F.broadcast(p), inside).groupBy("name").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query(f"WITH {met_sql('role', 'documents', 'doc_id')} SELECT d.doc_id, coalesce(substr(min_by(rule, turn), 6), 'plain') AS role FROM documents d LEFT JOIN met USING (doc_id) GROUP BY 1")
def role_rules(t: Tables):
    """The first rule whose terms a document has without the rule's forbidden ones."""
    rules = compiled(rule_table(t))
    return t.documents.select("doc_id", rules.read(F.col("text")).alias("b")).select("doc_id", F.coalesce(rules.first(F.col("b"), "role."), F.lit("plain")).alias("role"))


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 120 THEN 'short' END, CASE WHEN contains(text, '@') AND NOT regexp_matches(text, '{X.EMAIL}') THEN 'contact' END,
  CASE WHEN contains(lower(text), 'version') AND NOT regexp_matches(text, '[0-9]') THEN 'number' END) AS reasons FROM documents""")
def extraction_review_flags(t: Tables):
    """Why an extraction has to be reviewed: short, or a context without the pattern it announces."""
    text = F.col("text")
    return t.documents.select("doc_id", F.concat_ws(",", F.when(F.length(text) < 120, F.lit("short")), F.when(text.contains("@") & ~text.rlike(X.EMAIL), F.lit("contact")), F.when(F.lower(text).contains("version") & ~text.rlike("[0-9]"), F.lit("number"))).alias("reasons"))


@query(f"""WITH {NOTICES} SELECT doc_id, coalesce(quality, 1) = 0 OR length(content) < 80 OR (coalesce(toxic, 0) = 1 AND NOT processed) OR contains(content, '***') AS needs_review FROM notices""")
def needs_review_flags(t: Tables):
    low = F.coalesce("quality", F.lit(1)) == 0
    odd = (F.coalesce("toxic", F.lit(0)) == 1) & ~F.col("processed")
    return notices(t).select("doc_id", (low | (F.length("content") < 80) | odd | F.col("content").contains("***")).alias("needs_review"))


@query(f"WITH {HITS} SELECT item_id, doc_id, hits FROM hits WHERE hits = n")
def term_support_filter(t: Tables):
    """Documents that support every keyword of a question."""
    return keyword_hits(t).where("hits = n").select("item_id", "doc_id", "hits")


#: What a plan may hold: turns, characters of a turn.
_CAPS = {"turns": 6, "text": 1500}


_PLACES = "SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations"


@query(f"""WITH p AS ({_PLACES}), f AS (SELECT conv_id, place, 0 AS k, 'role' AS name, role AS said, 160 AS most FROM p UNION ALL SELECT conv_id, place, 1, 'text', text, {_CAPS["text"]} FROM p),
v AS (SELECT conv_id, -1 AS turn, 0 AS k, '$.turns' AS path, 'too_many' AS reason FROM conversations GROUP BY 1 HAVING count(*) > {_CAPS["turns"]}
  UNION ALL SELECT conv_id, place, k, '$.turns[' || place || '].' || name, CASE WHEN regexp_matches(said, '{N.UNSAFE}') THEN 'unsafe' ELSE 'too_long' END FROM f WHERE regexp_matches(said, '{N.UNSAFE}') OR length(said) > most)
SELECT conv_id, path, reason FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) = 1""")
def quarantine_split(t: Tables):
    """Plans (here conversations as nested values) that may not be used, with the path and reason of the first violation."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    plans = t.conversations.groupBy("conv_id").agg(F.struct(turns.alias("turns")).alias("plan"))
    return N.quarantine(plans, "plan", caps=_CAPS)[1].select("conv_id", "path", "reason")
