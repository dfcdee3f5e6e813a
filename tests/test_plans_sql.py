"""Rows that the driver's tables do not have, through a query and through its SQL."""

from types import SimpleNamespace

import duckdb
import pytest

from millrace.plans import catalog, extract_queries, text_queries


def _both(spark, query, table, rows, schema):
    df = spark.createDataFrame(rows, schema)
    held = df.toPandas()  # noqa: F841 -- DuckDB reads it by its name
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} AS SELECT * FROM held")
    result = con.execute(catalog.ORACLE_SQL[query.__name__])
    names = [c[0] for c in result.description]
    got = query(SimpleNamespace(**{table: df}))
    return sorted(tuple(r[c] for c in names) for r in got.collect()), sorted(result.fetchall())


@pytest.mark.parametrize("query", [extract_queries.page_main_content, text_queries.page_zip_pairs])
def test_entities_without_their_semicolon(spark, query):
    cut = ["a&amp;&amp", "x &lt y &gt z", "&quot;q&quot &copy 1 &#39s &#39;t", "plain words &#39", "&amplt; &amp;lt;"]
    pages = [(i, f"https://x.y/{i}", f"<html><body><h1>{x} title</h1><article>long enough {x}</article></body></html>") for i, x in enumerate(cut)]
    got, want = _both(spark, query, "pages", pages, "page_id long, url string, html string")
    assert got == want and len(got) == len(cut)


@pytest.mark.parametrize("turned", [False, True])
def test_first_violation_of_turns_that_tie(spark, turned):
    # of one turn, the order is by role and text; a role may break the rules as well
    rows = [(1, 1, "user", "see https://a.b"), (1, 1, "assistant", "fine"), (1, 2, "user", "x" * 1501), (2, 1, "user", "z" * 1600), (2, 1, "user", "a"), (3, 1, "r" * 161, "ok"), (4, None, "user", "sudo now"), (4, 0, "user", "ok"), (5, 1, None, None), (5, 2, "user", "y" * 1501)]
    got, want = _both(spark, text_queries.quarantine_split, "conversations", rows[::-1] if turned else rows, "conv_id long, turn int, role string, text string")
    assert got == want == [(1, "$.turns[1].text", "unsafe"), (2, "$.turns[1].text", "too_long"), (3, "$.turns[0].role", "too_long"), (4, "$.turns[0].text", "unsafe"), (5, "$.turns[1].text", "too_long")]


def test_words_beside_letters_that_are_not_ascii(spark):
    # as in the SQL, a word ends before any letter that is not ASCII, and the long s is an s
    texts = ["que sudoñboque", "Sudoñdorr", "bash가", "rm -é", "rm -e", "rm\x0b-rf", "rm\t -rf", "curl\u0301", "sudoku", "ſudo x", "httpſ://a", "<ſystem>", "chmod_x", "é bash é", "bash𝒜"]
    got, want = _both(spark, text_queries.quarantine_split, "conversations", [(i, 0, "user", x) for i, x in enumerate(texts)], "conv_id long, turn int, role string, text string")
    assert got == want == [(i, "$.turns[0].text", "unsafe") for i in (0, 1, 2, 4, 6, 7, 9, 10, 11, 13, 14)]
