"""Chunks, vectors and retrieval measures (survey 2.12 and 2.18)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import lowered
from millrace.operators import chunks as C
from millrace.operators import vectors as V
from millrace.plans.registry import Tables, query

FEATURES = r"""
{name}_w AS (SELECT {key}, regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+') AS words FROM {table}),
{name}_f AS (SELECT {key}, unnest(words || flatten(list_transform(words, lambda w: list_transform(range(1, greatest(length(w), 1) + 1), lambda i: substr('^' || w || '$', i, 3))))) AS f FROM {name}_w),
{name}_c AS (SELECT {key}, (('0x' || substr(sha256(f), 1, 8))::UBIGINT % 1536)::INTEGER AS idx, count(*) AS n FROM {name}_f GROUP BY ALL),
{name} AS (SELECT {key}, idx, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM {name}_c)"""
ITEM_VECTORS = FEATURES.format(name="qv", key="item_id", table="benchmark")
DOC_VECTORS = FEATURES.format(name="dv", key="doc_id", table="documents")

#: The stated query set of searches.
EVERY = 50


_END = "CASE WHEN {s} + 1400 >= length(text) THEN length(text) WHEN strpos(reverse(substr(text, {s} + 701, 700)), ' ') = 0 THEN {s} + 1400 ELSE {s} + 1401 - strpos(reverse(substr(text, {s} + 701, 700)), ' ') END"
BOUNDARIES = f"""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS i, 0::BIGINT AS s, {_END.format(s='0')} AS e FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, i + 1, greatest(e - 180, s + 1), {_END.format(s='greatest(e - 180, s + 1)')} FROM c WHERE e < length(text))
SELECT doc_id, i AS chunk_index, s::INTEGER AS start, e::INTEGER AS "end" FROM c"""


@query(BOUNDARIES)
def chunk_boundary(t: Tables):
    """Chunks that end at sentence ends or blanks; each start follows from the end before."""
    return C.sentence_chunks(t.documents).select("doc_id", "chunk_index", "start", "end")


@query(BOUNDARIES)
def chunk_lateral(t: Tables):
    """chunk_boundary as a table function in SQL."""
    from millrace.functions.hooks import lateral_chunks

    return lateral_chunks(t.documents)


@query("SELECT doc_id, true AS covers, true AS advances FROM documents WHERE length(text) > 0")
def chunk_invariants(t: Tables):
    """What must hold of chunk_boundary: the chunks cover the text without gaps, and starts and ends advance."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    c = C.sentence_chunks(t.documents).select("doc_id", "start", "end", F.lag("start").over(w).alias("s"), F.lag("end").over(w).alias("e"))
    g = c.groupBy("doc_id").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.bool_and(F.coalesce(F.col("start") <= F.col("e"), F.lit(True))).alias("joined"), F.bool_and(F.coalesce((F.col("start") > F.col("s")) & (F.col("end") > F.col("e")), F.lit(True))).alias("advances"))
    return g.join(t.documents.select("doc_id", F.length("text").alias("n")), "doc_id").select("doc_id", ((F.col("a") == 0) & (F.col("b") == F.col("n")) & F.col("joined")).alias("covers"), "advances")


@query("WITH x AS (SELECT doc_id, unnest(range(0, greatest(1, ((length(text) - 180 + 1219) // 1220)))) AS i, text FROM documents) SELECT doc_id, i::INTEGER AS chunk_index, length(substr(text, i * 1220 + 1, 1400)) AS n, md5(substr(text, i * 1220 + 1, 1400)) AS digest FROM x")
def chunk_fixed(t: Tables):
    return C.fixed_chunks(t.documents).select("doc_id", "chunk_index", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, line, unnest(range(0, (length(line) - 1) // 1400 + 1)) AS part FROM l WHERE line <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS chunk_index, substr(line, 1, 30) || CASE WHEN part > 0 THEN ' (' || (part + 1) || ')' ELSE '' END AS title, length(substr(line, part * 1400 + 1, 1400)) AS n FROM p""")
def chunk_sections(t: Tables):
    return C.section_chunks(t.documents)


@query("""SELECT o_orderkey, substr(concat_ws(chr(10), 'order: ' || o_orderkey, 'status: ' || o_orderstatus, 'priority: ' || o_orderpriority, 'date: ' || strftime(o_orderdate, '%Y-%m-%d'), 'customer: ' || coalesce(c_name, ''), 'segment: ' || coalesce(c_mktsegment, ''), 'nation: ' || coalesce(n_name, '')), 1, 5000) AS search_text
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def search_text(t: Tables):
    """The canonical search text: labelled lines in fixed order, missing values empty."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    lines = [line("order", F.col("o_orderkey").cast("string")), line("status", F.col("o_orderstatus")), line("priority", F.col("o_orderpriority")), line("date", F.date_format("o_orderdate", "yyyy-MM-dd")), line("customer", F.col("c_name")), line("segment", F.col("c_mktsegment")), line("nation", F.col("n_name"))]
    return rows.select("o_orderkey", F.substring(F.concat_ws("\n", *lines), 1, 5000).alias("search_text"))


@query(f"WITH {ITEM_VECTORS} SELECT item_id, idx, round(weight, 9) AS weight FROM qv")
def lexical_embedding(t: Tables):
    return V.lexical_vectors(t.benchmark, "item_id", "text").select("item_id", "idx", F.round("weight", 9).alias("weight"))


LEXICAL = f"{ITEM_VECTORS}, {DOC_VECTORS}, lexical AS (SELECT item_id, doc_id, round(sum(d.weight * q.weight), 6) AS cosine FROM dv d JOIN qv q USING (idx) GROUP BY ALL)"


@query(f"WITH {LEXICAL} SELECT item_id, doc_id, cosine FROM lexical QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) <= 5")
def lexical_topk(t: Tables):
    """The five documents nearest to each question by their sparse vectors."""
    low = lowered(F.col("text")).alias("text")
    return V.lexical_top(t.documents.select("doc_id", low), t.benchmark.select("item_id", low), 5)


@query("""WITH v AS (SELECT vec_id, embedding[1:48]::DOUBLE[] AS a FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS norm FROM v)
SELECT vec_id, round(a[1] / norm, 6) AS head, round(list_sum(list_transform(a, lambda x: abs(x))) / norm, 6) AS mass, 64 AS dim FROM n""")
def vector_fit(t: Tables):
    """Vectors cut to 48 and padded to 64 places, at unit length."""
    v = t.embeddings.select("vec_id", V.fit(V.fit(F.col("embedding"), 48), 64).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("head"), F.round(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.abs(x)), 6).alias("mass"), F.size("v").alias("dim"))


DENSE = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS query_label FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT query_id, vec_id, query_label, label, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS cosine FROM q, embeddings WHERE vec_id <> query_id)"""


def _queries(t: Tables):
    return t.embeddings.where(F.col("vec_id") % EVERY == 0)


@query(f"WITH {DENSE} SELECT query_id, vec_id, cosine FROM c WHERE cosine >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 10")
def vector_topk(t: Tables):
    """The ten nearest vectors of each query vector, over a least cosine."""
    return V.top_k(t.embeddings, _queries(t), 10, 0.1).select("query_id", "vec_id", "cosine")


@query(f"WITH {DENSE} SELECT query_id, vec_id, cosine FROM c WHERE cosine >= 0.45")
def vector_pairs(t: Tables):
    """All neighbours of each query vector above a least cosine: a search; vector_links joins all with all."""
    return V.top_k(t.embeddings, _queries(t), None, 0.45).select("query_id", "vec_id", "cosine")


@query("""WITH g AS (SELECT min(vec_id) AS vec_id, count(*) AS n, embedding FROM embeddings WHERE vec_id IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 GROUP BY embedding),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, a.n * b.n AS links FROM g a JOIN g b ON a.vec_id < b.vec_id)
SELECT * FROM p WHERE cosine >= 0.45 UNION ALL SELECT vec_id, vec_id, 1::DOUBLE, n * (n - 1) // 2 FROM g WHERE n > 1
UNION ALL SELECT g.vec_id, e.vec_id, 1::DOUBLE, 0 FROM embeddings e JOIN g USING (embedding) WHERE e.vec_id <> g.vec_id""")
def vector_links(t: Tables):
    """All pairs of vectors above a least cosine, whichever their ids; equal vectors through the first of them."""
    return V.links(t.embeddings, 0.45)


@query(f"WITH {DENSE} SELECT query_id, vec_id, cosine FROM c WHERE label % 2 = query_label % 2 AND cosine >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 20")
def vector_model_mask(t: Tables):
    """The nearest vectors of the query's model (here: of labels of its parity); those of others score 0, under the bound."""
    modelled = t.embeddings.withColumn("model", F.col("label") % 2)
    return V.top_k(modelled, modelled.where(F.col("vec_id") % EVERY == 0), 20, 0.3, "model").select("query_id", "vec_id", "cosine")


@query(f"""WITH {DENSE}, own AS (SELECT query_id, vec_id, cosine FROM c WHERE label = query_label AND cosine >= 0.34 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 20),
every AS (SELECT query_id, vec_id, cosine FROM c WHERE cosine >= 0.34 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 20)
SELECT * FROM own UNION ALL SELECT * FROM every WHERE query_id NOT IN (SELECT query_id FROM own)""")
def category_relax(t: Tables):
    """Candidates over the threshold in the query's category; those of all categories for queries that have none there."""
    own = V.top_k(t.embeddings, _queries(t), 20, 0.34, "label").select("query_id", "vec_id", "cosine")
    every = V.top_k(t.embeddings, _queries(t), 20, 0.34).select("query_id", "vec_id", "cosine")
    return own.unionByName(every.join(own.select("query_id").distinct(), "query_id", "left_anti"))


@query(f"""WITH {DENSE}, k AS (SELECT query_id, vec_id, cosine AS score, (label * 7 % 10) / 10.0::DOUBLE AS relevance, label = 3 AS rejected FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 5),
j AS (SELECT *, NOT rejected AND relevance >= 0.3 AS keep, bool_or(NOT rejected AND relevance >= 0.3) OVER (PARTITION BY query_id) AS any_kept FROM k)
SELECT query_id, vec_id, round(CASE WHEN any_kept THEN 0.7 * score + 0.3 * relevance ELSE score END, 9) AS score FROM j WHERE keep OR NOT any_kept""")
def rerank_blend(t: Tables):
    """Scores blended with judgements; what is rejected or irrelevant goes, unless all would go."""
    from millrace.operators.ranking import blend

    near = V.top_k(t.embeddings, _queries(t), 5).join(t.embeddings.select("vec_id", "label"), "vec_id")
    judged = near.select("query_id", "vec_id", F.col("cosine").alias("score"), (F.col("label") * 7 % 10 / F.lit(10.0)).alias("relevance"), (F.col("label") == 3).alias("rejected"))
    return blend(judged, "query_id").select("query_id", "vec_id", F.round("score", 9).alias("score"))


@query(f"""WITH {DENSE}, l AS (SELECT doc_id AS vec_id, len(string_split(text, ' ')) AS words FROM documents)
SELECT query_id, vec_id, cosine, coalesce(words, 0) AS words FROM c LEFT JOIN l USING (vec_id) WHERE (coalesce(words, 0) > 100 AND cosine >= 0.34) OR cosine >= 0.49""")
def semantic_rescue(t: Tables):
    """Rows over the threshold; those without a keyword (here: of short texts) only if their vector is near enough."""
    from millrace.operators.ranking import THRESHOLD, rescue

    words = t.documents.select(F.col("doc_id").alias("vec_id"), F.size(F.split("text", " ")).alias("words"))
    rows = V.top_k(t.embeddings, _queries(t), None, THRESHOLD).join(words, "vec_id", "left").select("query_id", "vec_id", "cosine", F.coalesce("words", F.lit(0)).alias("words"))
    return rescue(rows, F.col("words") > 100, F.col("cosine"))


HEADS = """h AS (SELECT query_id, vec_id, round(list_cosine_similarity(q[1:32], embedding[1:32]::DOUBLE[]), 6) AS head FROM q, embeddings WHERE vec_id <> query_id)"""


@query(f"""WITH {DENSE}, {HEADS}, a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS r FROM c QUALIFY r <= 20),
b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, vec_id) AS r FROM h QUALIFY r <= 20)
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.vec_id) AS vec_id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.vec_id = b.vec_id""")
def rrf_fusion(t: Tables):
    """Two rankings fused by reciprocal ranks: by the whole vectors, and by their first half."""
    from millrace.operators.ranking import reciprocal_rank_fusion

    ranked = lambda v: V.top_k(v, v.where(F.col("vec_id") % EVERY == 0), 20).select("query_id", "vec_id", F.col("place").alias("r"))
    heads = t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    return reciprocal_rank_fusion(ranked(t.embeddings), ranked(heads), ["query_id", "vec_id"]).select("query_id", "vec_id", F.round("score", 9).alias("score"))


@query(f"""WITH {DENSE}, k AS (SELECT query_id, label = query_label AS hit, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS r FROM c QUALIFY r <= 10),
n AS (SELECT query_id, count(*) FILTER (label = query_label) AS relevant FROM c GROUP BY 1)
SELECT query_id, round(count(*) FILTER (hit) / greatest(least(any_value(relevant), 10), 1)::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / min(r) FILTER (hit), 0), 6) AS mrr, bool_or(hit) AS hit,
  round(coalesce(sum(1.0::DOUBLE / log2(r + 1)) FILTER (hit), 0) / greatest(list_sum(list_transform(range(1, least(any_value(relevant), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 1e-9), 6) AS ndcg
FROM k JOIN n USING (query_id) GROUP BY 1""")
def retrieval_metrics(t: Tables):
    """Recall, reciprocal rank, hit and nDCG at ten, where a vector of the query's label is relevant."""
    from millrace.operators.ranking import retrieval_measures

    label = t.embeddings.select("vec_id", "label")
    own = label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    hits = V.top_k(t.embeddings, _queries(t), 10).join(label, "vec_id").join(own, "query_id").select("query_id", "place", (F.col("label") == F.col("query_label")).alias("hit"))
    sizes = label.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    relevant = _queries(t).select(F.col("vec_id").alias("query_id"), "label").join(sizes, "label").select("query_id", "relevant")
    return retrieval_measures(hits, relevant, 10)
