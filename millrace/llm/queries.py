"""The registered queries opN_*, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import conversations, decontaminate, exact_dedup, language, lexical_search, licenses, mixing, quality, secrets, sharding, simhash, suffix_dedup, token_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_plan(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_codes.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(*conversations.damage(table(spark, sf_dir, "conversations")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_sharding, op3_secrets, op4_simhash, op5_exact_dedup, op6_licenses, op7_language, op8_decontamination, op9_token_codes, op10_quality, op11_suffix_dedup, op12_conversations, op13_lexical_search)
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 8))::BIGINT AS draw
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(source_size * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
rates AS (
  SELECT source, source_size, least((source_size * 2)::DOUBLE, (max(level) OVER ()) * weight) AS target FROM levels),
joined AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END AS rate,
    sum(size) OVER (PARTITION BY d.source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, draw) AS alike
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
taken AS (
  SELECT *, (floor(rate) + CASE WHEN upto - alike / 2::DOUBLE < target - floor(rate) * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM joined)
SELECT doc_id, source, size, source_size, target, rate, copies, size * copies AS taken FROM taken
"""

_OP5 = rf"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g')) AS text_sha256, coalesce(length(text), 0) AS n FROM documents),
ranked AS (
  SELECT *, row_number() OVER (w ORDER BY n DESC, doc_id NULLS LAST) AS turn,
    first_value(doc_id) OVER (w ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER w AS group_size
  FROM rows WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, turn = 1 AS kept, text_sha256 FROM ranked
"""


def _jump_sql(shards: int) -> str:
    """The jump hash of the column key, as a fold of as many steps as there are shards."""
    step = "(s.k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT"
    return f"""list_reduce(list_prepend({{'k': key, 'b': -1::BIGINT, 'j': 0::BIGINT}}, list_transform(range({shards}), lambda i: {{'k': 0::UHUGEINT, 'b': 0::BIGINT, 'j': 0::BIGINT}})),
  lambda s, x: CASE WHEN s.j >= {shards} THEN s ELSE {{'k': {step}, 'b': s.j, 'j': floor((s.j + 1) * (2147483648::DOUBLE / ((({step}) // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT}} END).b::INTEGER"""


_OP2 = f"""
WITH poly AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
raw AS (SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::UHUGEINT AS key FROM documents),
summed AS (SELECT doc_id, key, strlen(t) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM raw, poly),
placed AS (SELECT *, {_jump_sql(sharding.SHARDS)} AS shard, {_jump_sql(sharding.SHARDS + 1)} AS grown_shard FROM summed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed
"""


def _spans_sql(name: str, pattern: str, group: int, kind: int, ok: str) -> str:
    p = pattern.replace("'", "''")
    return rf"""
{name}_gaps AS (SELECT uid, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS parts
  FROM docs WHERE regexp_matches(t, '{p}')),
{name}_rows AS (SELECT uid, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts FROM {name}_gaps),
{name} AS (SELECT uid, {kind} AS kind, hit, stop - length(hit) AS s, stop AS e FROM (
    SELECT uid, hits[i] AS hit, parts[i] AS part, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS stop FROM {name}_rows)
  WHERE {ok})"""


def _op3() -> str:
    rules = "\n".join(f"WHEN regexp_matches(hit, '{p}') THEN {b}" for p, b in secrets.CLASSES)
    # DuckDB's engine knows no possessive groups and needs none
    allowed = " OR ".join("regexp_matches(hit, '%s')" % p.replace("++", "+").replace("*+", "*") for p in secrets.ALLOWED)
    w = secrets.WINDOW
    return f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
{_spans_sql("assigned", secrets.ASSIGN, 2, 0, "length(part) >= 6")},
{_spans_sql("access", secrets.ACCESS, 0, 1, "true")},
{_spans_sql("hexes", secrets.HEX, 0, 2, "true")},
{_spans_sql("runs", secrets.CANDIDATE, 0, 3, f"NOT ({allowed})")},
peaks AS (SELECT *, list_max(list_transform(range(1, greatest(length(hit) - {w}, 0) + 2), lambda i: round(list_entropy(string_split(substr(hit, i, {w}), '')), 6))) AS peak,
    CASE {rules} END AS bound FROM runs),
found AS (
  SELECT uid, kind, s, e FROM assigned UNION ALL SELECT uid, kind, s, e FROM access UNION ALL SELECT uid, kind, s, e FROM hexes
  UNION ALL SELECT uid, kind, s, e FROM peaks WHERE peak >= bound),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS span FROM found),
told AS (
  SELECT uid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (kind = 3) AS n_entropy, string_agg(span, ',' ORDER BY s, e, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, e, kind) AS spans
  FROM named GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (uid)
"""


def _op8() -> str:
    """All alignments of documents and items in which enough tokens are equal; nothing here looks at seeds."""
    unspaced = decontaminate.UNSPACED.replace("Is", "")
    tokens = rf"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '({unspaced})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, {tokens} AS words FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id, {tokens} AS item_words, least({decontaminate.WINDOW}, len({tokens})) AS width FROM benchmark),
item_at AS (SELECT iid, width, unnest(item_words) AS w, generate_subscripts(item_words, 1) AS j FROM items),
doc_at AS (SELECT uid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
hits AS (SELECT uid, iid, i - j AS shift FROM doc_at JOIN item_at USING (w) GROUP BY ALL HAVING count(*) >= any_value(width) * {decontaminate.SIMILARITY}),
pairs AS (SELECT doc_id, item_id, width,
    list_transform(range(0, len(item_words)), lambda k: CASE WHEN shift + k >= 0 AND words[shift + k + 1] = item_words[k + 1] THEN 1 ELSE 0 END) AS agree
  FROM hits JOIN docs USING (uid) JOIN items USING (iid)),
best AS (SELECT doc_id, item_id, width, list_max(list_transform(range(0, len(agree) - width + 1), lambda k: list_sum(agree[k + 1:k + width]))) AS most FROM pairs)
SELECT doc_id, item_id, max(most)::INTEGER AS agreeing, max(width)::INTEGER AS compared FROM best
WHERE most >= width * {decontaminate.SIMILARITY} GROUP BY doc_id, item_id
"""


_OP11 = """
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT uid, doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS w FROM (SELECT uid, doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM docs)),
repeats AS (SELECT uid, p FROM (SELECT uid, p, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, uid, p) AS turn FROM windows) WHERE turn > 1),
islands AS (SELECT uid, p, sum(new) OVER (PARTITION BY uid ORDER BY p) AS island
  FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY uid ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM repeats)),
spans AS (SELECT uid, island, min(p) AS start, max(p) + 100 AS stop FROM islands GROUP BY uid, island),
pieces AS (SELECT uid, start, stop, substr(h, 2 * coalesce(lag(stop) OVER o, 0) + 1, 2 * (start - coalesce(lag(stop) OVER o, 0))) AS piece FROM spans JOIN docs USING (uid) WINDOW o AS (PARTITION BY uid ORDER BY start)),
told AS (SELECT uid, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS stop, string_agg(piece, '' ORDER BY start) AS head FROM pieces GROUP BY uid)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN told USING (uid)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS terms FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS terms FROM benchmark),
wanted AS (SELECT iid, term, count(*) AS qtf FROM (SELECT iid, unnest(terms) AS term FROM items) GROUP BY ALL),
scale AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
held AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, scale GROUP BY term, n_docs),
impacts AS (
  SELECT uid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(terms) * n_docs) // n_terms)) AS impact
  FROM held JOIN docs USING (uid), scale),
scored AS (SELECT iid, uid, doc_id, sum(qtf * w * impact)::BIGINT AS score FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (iid) WHERE place <= {lexical_search.TOP}
"""



def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(cost: str, letter: str, state: str, when: str = "true") -> str:
    """A struct (cost, audit) or null; structs compare by cost, then by audit."""
    return f"CASE WHEN {when} THEN {{'c': {cost} + s.{state}.c, 'a': '{letter}' || s.{state}.a}} END"


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS terms FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS terms FROM benchmark),
wanted AS (SELECT iid, term, count(*) AS qtf FROM (SELECT iid, unnest(terms) AS term FROM items) GROUP BY ALL),
scale AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
held AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, scale GROUP BY term, n_docs),
impacts AS (
  SELECT uid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(terms) * n_docs) // n_terms)) AS impact
  FROM held JOIN docs USING (uid), scale),
scored AS (SELECT iid, uid, doc_id, sum(qtf * w * impact)::BIGINT AS score FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (iid) WHERE place <= {lexical_search.TOP}
"""



def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(cost: str, letter: str, state: str, when: str = "true") -> str:
    """A struct (cost, audit) or null; structs compare by cost, then by audit."""
    return f"CASE WHEN {when} THEN {{'c': {cost} + s.{state}.c, 'a': '{letter}' || s.{state}.a}} END"


def _op12() -> str:
    """The cheapest edits by a fold over each conversation's letters from the end, without any sharing."""
    letter, cut = "x.l", "CASE WHEN x.l <> lower(x.l) THEN 1 ELSE 0 END"
    step = {"n": "s.n"}
    for q, keeps, fill in (("q0", {"s": "q1", "u": "q2"}, "q2"), ("q1", {"u": "q2"}, "q2"), ("q2", {"a": "q3"}, "q3"), ("q3", {"u": "q2"}, "q2")):
        kept = [_way(cut, "K", to, f"lower({letter}) = '{r}'") for r, to in keeps.items()]
        step[q] = _least(_way("3", "D", q), *kept, _way(f"2 + {cut}", "R", fill, f"{letter} <> 'x'"))
    rows = ", ".join(f"'{q}': {v}" for q, v in step.items() if q != "n")
    insert = lambda q: f"{{'c': 2 + {q}.c, 'a': 'I' || {q}.a}}"
    turned = f"""list_transform([{{{rows}}}], lambda m: {{'q2': {_least("m.q2", insert("m.q3"))}, 'q3': {_least("m.q3", insert("m.q2"))}, 'm': m}})"""
    whole = f"""list_transform({turned}, lambda f: {{'l': '', 'q0': {_least("f.m.q0", insert("f.q2"))}, 'q1': {_least("f.m.q1", insert("f.q2"))}, 'q2': f.q2, 'q3': f.q3}})[1]"""
    end = "{'l': '', 'q0': {'c': 0, 'a': ''}, 'q1': {'c': 4, 'a': 'II'}, 'q2': {'c': 2, 'a': 'I'}, 'q3': {'c': 0, 'a': ''}}"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))"
    fill = "CASE WHEN s.st = 2 THEN 'assistant' ELSE 'user' END"
    to = "CASE WHEN s.st = 2 THEN 3 ELSE 2 END"
    line = lambda role, text: f"s.out || CASE WHEN s.n > 0 THEN chr(10) ELSE '' END || {role} || ':' || {text}"
    return rf"""
WITH poly AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, xor({crc}, 4294967295) % 20 AS kind FROM named, poly),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM dealt WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS row_at,
    regexp_replace(text, '{_SPACE}+$', '') AS seen FROM damaged),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY row_at) > 1 AS again_seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY row_at) AS prior FROM placed),
lettered AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS r,
    CASE WHEN seen = '' THEN 'blank' WHEN again_seen THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM told),
convs AS (
  SELECT conv_id, list(CASE fault WHEN '' THEN r WHEN 'truncated' THEN upper(r) ELSE 'x' END ORDER BY row_at) AS letters, list(role ORDER BY row_at) AS roles, list(text ORDER BY row_at) AS texts,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM lettered GROUP BY conv_id),
solved AS (SELECT *, list_reduce(list_prepend({end}, list_transform(list_reverse(letters), lambda l: {{'l': l, 'q0': {{'c': 0, 'a': ''}}, 'q1': {{'c': 0, 'a': ''}}, 'q2': {{'c': 0, 'a': ''}}, 'q3': {{'c': 0, 'a': ''}}}})),
    lambda s, x: {whole}).q0 AS best FROM convs),
written AS (SELECT *, list_reduce(list_prepend({{'e': '', 'i': 1, 'st': 0, 'n': 0, 'out': ''}}, list_transform(string_split(best.a, ''), lambda e: {{'e': e, 'i': 0, 'st': 0, 'n': 0, 'out': ''}})),
    lambda s, x: CASE x.e WHEN '' THEN s WHEN 'D' THEN {{'e': '', 'i': s.i + 1, 'st': s.st, 'n': s.n, 'out': s.out}}
      WHEN 'I' THEN {{'e': '', 'i': s.i, 'st': {to}, 'n': s.n + 1, 'out': {line(fill, "''")}}}
      WHEN 'R' THEN {{'e': '', 'i': s.i + 1, 'st': {to}, 'n': s.n + 1, 'out': {line(fill, "texts[s.i]")}}}
      ELSE {{'e': '', 'i': s.i + 1, 'st': CASE left(roles[s.i], 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'n': s.n + 1, 'out': {line("roles[s.i]", "texts[s.i]")}}} END).out AS repaired FROM solved)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN written w ON k.conv_id IS NOT DISTINCT FROM w.conv_id
"""


ORACLE_SQL: dict[str, str] = {"op1_mixing": _OP1, "op2_sharding": _OP2, "op3_secrets": _op3(), "op5_exact_dedup": _OP5, "op8_decontamination": _op8(), "op11_suffix_dedup": _OP11, "op12_conversations": _op12(), "op13_lexical_search": _OP13}
