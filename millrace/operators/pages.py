"""Pages as trees: one parse gives nodes with intervals, and selectors are filters and interval joins.

``tree`` turns the markup of each page into rows of elements and texts.  A row has its place ``node``
in the order of the page and ``leave``, the place behind the last one inside it, so x lies in y exactly
if y.node < x.node < y.leave.  End tags close the last open element of their name and all that is open
inside it, an end tag without one is skipped, and the page's end closes the rest; scripts, styles,
comments and declarations have no text.

Defined results: null markup has no rows; markup that ends within a tag or comment loses that piece;
attributes are lower-cased in name, and the first of a name counts.  A page's tree is made in one
task, and takes memory in proportion to the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.links import resolve
from millrace.functions.text import squeeze

# The elements of HTML that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>)?",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.DOTALL)

TREE = [
    T.StructField("node", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()),
]
_ARROW = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]


#: Elements whose rows have all text inside them, so that it need not be gathered; "" where they stand in
#: more than DEEP of their kind, as end tags that are left out make them, so that a page's texts stay in proportion to it.
SMALL, DEEP = frozenset(("a", "td", "th")), 16


def parse(markup: str) -> list[list]:
    """[node, leave, parent, tag, attrs, text] of every element, and of every text with the tag #text."""
    rows: list[list] = []
    stack: list[int] = []
    opened: Counter[str] = Counter()
    at = 0

    def add(tag: str, attrs: dict | None, text: str | None) -> int:
        rows.append([len(rows), len(rows) + 1, stack[-1] if stack else None, tag, attrs, text])
        return len(rows) - 1

    def say(text: str) -> None:
        text = html.unescape(text).strip()
        if text:
            add("#text", None, text)

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if rows[stack[i]][3] == name:
                for x in stack[i:]:
                    rows[x][1] = len(rows)
                    opened[rows[x][3]] -= 1
                del stack[i:]
                return

    while m := _TOKEN.search(markup, at):
        say(markup[at : m.start()])
        at = m.end()
        if m["end"]:
            close(m["end"].lower())
        elif m["start"] and m["close"]:
            tag, given = m["start"].lower(), m["attrs"].rstrip()
            attrs: dict[str, str] = {}
            for name, *values in _ATTR.findall(given):
                attrs.setdefault(name.lower(), html.unescape("".join(values)))
            x = add(tag, attrs, "" if opened[tag] > DEEP and tag in SMALL else None)
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(markup, at)
                at = end.start() if end else len(markup)
            if tag not in VOID and not given.endswith("/"):
                stack.append(x)
                opened[tag] += 1
    say(markup[at:])
    for x in stack:
        rows[x][1] = len(rows)
    texts = [r for r in rows if r[3] == "#text"]
    places = [r[0] for r in texts]
    for r in rows:
        if r[3] in SMALL and r[5] is None:
            inner = texts[bisect(places, r[0]) : bisect(places, r[1] - 1)]
            r[5] = " ".join(" ".join(t[5] for t in inner).split())
    return rows


def tree(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, node, leave, parent, tag, attrs, text): the rows of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                if rows := parse(batch.column(1)[i].as_py() or ""):
                    fields = [*zip(*rows, strict=True)]
                    fields[4] = [None if a is None else [*a.items()] for a in fields[4]]
                    columns = [pa.array(x, k) for x, k in zip(fields, _ARROW, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *columns], [key, *(f.name for f in TREE)])

    return pages.select(key, F.col(markup).cast("string")).mapInArrow(run, T.StructType([pages.schema[key], *TREE]))


_SIMPLE = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<klass>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)['\"]?(?P<value>[^'\"\]]*)['\"]?)?\]")


def matches(simple: str) -> Column:
    """Whether a row is an element that a selector without blanks names: tag, .class, #id, [attr], [attr=v], *=, ^=, $=, ~=."""
    found, ok, at = _SIMPLE.finditer(simple), F.col("tag") != "#text", 0
    words = lambda name: F.split(F.trim(F.element_at("attrs", name)), r"\s+")
    for m in found:
        if m.start() != at:
            break
        at = m.end()
        value = F.element_at("attrs", m["attr"] or "")
        if m["tag"]:
            ok = ok if m["tag"] == "*" else ok & (F.col("tag") == m["tag"].lower())
        elif m["klass"]:
            ok = ok & F.array_contains(words("class"), m["klass"])
        elif m["id"]:
            ok = ok & (F.element_at("attrs", "id") == m["id"])
        else:
            test = {None: value.isNotNull(), "=": value == m["value"], "*=": value.contains(m["value"] or ""), "^=": value.startswith(m["value"] or ""), "$=": value.endswith(m["value"] or ""), "~=": F.array_contains(words(m["attr"]), m["value"] or "")}
            ok = ok & test[m["op"]]
    if at != len(simple):
        raise ValueError(f"selector not understood: {simple}")
    return F.coalesce(ok, F.lit(False))


def select(rows: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """The elements that a selector names, with blanks for "anywhere inside" and > for "child of"."""
    found, child = None, False
    for word in selector.replace(">", " > ").split():
        if word == ">":
            child = True
            continue
        here = rows.where(matches(word))
        if found is not None:
            outer = found.select(F.col(key).alias("_key"), F.col("node").alias("_node"), F.col("leave").alias("_leave"))
            inside = (F.col("parent") == F.col("_node")) if child else (F.col("node") > F.col("_node")) & (F.col("node") < F.col("_leave"))
            here = here.join(outer, F.col(key).eqNullSafe(F.col("_key")) & inside, "left_semi")
        found, child = here, False
    return found


def inside(rows: DataFrame, roots: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """The elements that a selector names inside each root, with the root's place as ``root``."""
    outer = roots.select(F.col(key).alias("_key"), F.col("node").alias("root"), F.col("leave").alias("_leave"))
    here = F.col(key).eqNullSafe(F.col("_key")) & (F.col("node") > F.col("root")) & (F.col("node") < F.col("_leave"))
    return select(rows, selector, key).join(outer, here).drop("_key", "_leave")


def with_text(rows: DataFrame, nodes: DataFrame, key: str = "page_id", name: str = "content") -> DataFrame:
    """nodes with all text inside them, pieces joined by one blank and white space collapsed; "" where there is none."""
    pieces = rows.where(F.col("tag") == "#text").select(F.col(key).alias("_key"), F.col("node").alias("_at"), F.col("text").alias("_piece"))
    roots = nodes.select(F.col(key).alias("_root_key"), F.col("node").alias("_node"), F.col("leave").alias("_leave")).distinct()
    held = pieces.join(roots, F.col("_key").eqNullSafe(F.col("_root_key")) & (F.col("_at") > F.col("_node")) & (F.col("_at") < F.col("_leave")))
    said = held.groupBy("_root_key", "_node").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"))
    said = said.select("_root_key", "_node", squeeze(F.array_join(F.col("_pieces._piece"), " ")).alias("_text"))
    joined = nodes.join(said, F.col(key).eqNullSafe(F.col("_root_key")) & (F.col("node") == F.col("_node")), "left")
    return joined.withColumn(name, F.coalesce("_text", F.lit(""))).drop("_root_key", "_node", "_text")


def main_content(rows: DataFrame, selectors: Sequence[str], least: int = 5, key: str = "page_id") -> DataFrame:
    """(key, selector, node, leave, content): the longest node of the first selector that has one of at least so many characters."""
    found = None
    for i, selector in enumerate(selectors):
        part = select(rows, selector, key).select(key, "node", "leave", F.lit(i).alias("_turn"))
        found = part if found is None else found.unionByName(part)
    usable = with_text(rows, found, key).where(F.length("content") >= least)
    best = usable.groupBy(key).agg(F.min(F.struct("_turn", (-F.length("content")).alias("short"), "node", "leave", "content")).alias("b"))
    name = F.element_at(F.array(*map(F.lit, selectors)), F.col("b._turn") + 1)
    return best.select(key, name.alias("selector"), "b.node", "b.leave", "b.content")


def _numbered(nodes: DataFrame, by: list[str]) -> DataFrame:
    """nodes with their turn (from 0) among those of a page, or of a root; a page's nodes are bounded by the page."""
    return nodes.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("node")) - 1)


def board_rows(rows: DataFrame, row: str, column: str, link: str, place: dict[str, int], least: int = 1, ids: dict[str, str] | None = None, secret: str | None = None, day: str = "yy.MM.dd", key: str = "page_id") -> DataFrame:
    """Rows of list pages: key, turn, title, href, the columns at ``place``, published, pinned, ids.

    place: which child column holds what; ``published`` is read as a date in the form ``day`` and
    ``number`` tells pinned rows, whose number is none.  Negative places count from the end.
    ids: name -> field of the JSON in the link's attribute data-params; rows where the field
    ``secret`` is true go, as do rows without a link, with fewer columns than ``least``, or with a
    date that is none.
    """
    lines = _numbered(select(rows, row, key), [key])
    cells = rows.where(matches(column)).join(lines.select(F.col(key).alias("_key"), F.col("node").alias("root")), F.col(key).eqNullSafe(F.col("_key")) & (F.col("parent") == F.col("root"))).drop("_key")
    told = with_text(rows, cells, key).groupBy(key, "root").agg(F.array_sort(F.collect_list(F.struct("node", "content"))).alias("c"))
    links = with_text(rows, inside(rows, lines, link, key), key)
    first = links.groupBy(key, "root").agg(F.min_by(F.struct("attrs", "content"), "node").alias("a"))
    told, first = (x.withColumnsRenamed({key: "_key"}) for x in (told, first))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("node") == F.col("root"))
    all_ = lines.select(key, "node", "turn").join(told, same).drop("_key", "root").join(first, same).drop("_key", "root")
    size = F.size("c")
    cell = lambda i: F.try_element_at("c", F.lit(i + 1 if i >= 0 else i))["content"]
    params = F.element_at("a.attrs", "data-params")
    given = {name: F.get_json_object(params, f"$.{field}") for name, field in (ids or {}).items()}
    columns = {name: cell(i) for name, i in place.items()}
    if "number" in columns:
        columns["pinned"] = ~columns.pop("number").rlike("^[0-9]+$")
    if "published" in columns:
        columns["published"] = F.to_date(F.try_to_timestamp(F.regexp_extract(columns["published"], "[0-9]{2,4}([.-][0-9]{1,2}){2}", 0), F.lit(day)))
    out = all_.where(size >= least)
    if secret:
        out = out.where(F.coalesce(F.get_json_object(params, f"$.{secret}"), F.lit("false")) != "true")
    title = F.coalesce(F.nullif(F.element_at("a.attrs", "title"), F.lit("")), F.col("a.content"))
    out = out.select(key, "turn", title.alias("title"), F.element_at("a.attrs", "href").alias("href"), *(c.alias(n) for n, c in (columns | given).items()))
    return out.where("published IS NOT NULL") if "published" in columns else out


def zipped(rows: DataFrame, question: str, answer: str, key: str = "page_id") -> DataFrame:
    """(key, turn, question, answer): the n-th question of a page with its n-th answer; pages whose counts differ go, as do empty texts."""
    sides = []
    for selector, name in ((question, "question"), (answer, "answer")):
        told = with_text(rows, select(rows, selector, key), key, "said")
        sides.append(told.groupBy(F.col(key).alias(f"_{name}")).agg(F.array_sort(F.collect_list(F.struct("node", "said"))).alias(name)))
    pairs = sides[0].join(sides[1], F.col("_question").eqNullSafe(F.col("_answer"))).where(F.size("question") == F.size("answer"))
    lines = pairs.select(F.col("_question").alias(key), F.posexplode(F.arrays_zip(F.col("question.said").alias("q"), F.col("answer.said").alias("a"))).alias("turn", "x"))
    return lines.select(key, "turn", F.col("x.q").alias("question"), F.col("x.a").alias("answer")).where("question <> '' AND answer <> ''")


def page_references(rows: DataFrame, pages: DataFrame, attachment: str = "a[href*='download']", unnamed: Sequence[str] = ("PDF", "Download", "Attachment"), key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, place, kind, link, name): attachments, images and other links of pages, absolute, each link once.

    An attachment is named by its label, or where that says nothing by the cell before its own, else
    by its number; an image by its alternative text, else by its number.
    """
    file = matches(attachment)
    kind = F.when(file, "attachment").when(matches("img[src]"), "image").when(matches("a[href]"), "link")
    found = rows.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "node", "kind", F.coalesce("text", F.lit("")).alias("label"), F.element_at("attrs", F.when(F.col("kind") == "image", "src").otherwise("href")).alias("_ref"), F.element_at("attrs", "alt").alias("_alt"))
    base = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    found = found.join(base, F.col(key).eqNullSafe(F.col("_key"))).withColumn("link", resolve(F.col("_url"), F.col("_ref"))).drop("_key")
    # each link of a page once: as the first kind it is, at its first place
    turn = F.array_position(F.array(*map(F.lit, ("attachment", "image", "link"))), F.col("kind"))
    first = found.groupBy(key, "link").agg(F.min(F.struct(turn.alias("turn"), "node", "kind", "label", "_alt")).alias("f")).select(key, "link", "f.*")
    # the cell that an attachment stands in, and the text of the one before it in its row
    cells = rows.where(F.col("tag").isin("td", "th")).select(F.col(key).alias("_key"), F.col("node").alias("_cell"), "leave", F.lag("text").over(Window.partitionBy(key, "parent").orderBy("node")).alias("_before"))
    own = first.where("kind = 'attachment'").join(cells, F.col(key).eqNullSafe(F.col("_key")) & (F.col("node") > F.col("_cell")) & (F.col("node") < F.col("leave")))
    context = own.groupBy(F.col(key).alias("_own_key"), F.col("node").alias("_own")).agg(F.max_by("_before", "_cell").alias("_context"))
    named = first.join(context, F.col(key).eqNullSafe(F.col("_own_key")) & (F.col("node") == F.col("_own")), "left").drop("_own_key", "_own")
    number = F.row_number().over(Window.partitionBy(key, "kind").orderBy("node"))
    label = F.when((F.col("label") != "") & ~F.col("label").isin(*unnamed), F.col("label"))
    of_file = F.coalesce(label, F.nullif("_context", F.lit("")), F.concat(F.lit("attachment "), number))
    name = F.when(F.col("kind") == "attachment", of_file).when(F.col("kind") == "image", F.coalesce(F.nullif("_alt", F.lit("")), F.concat(F.lit("image "), number))).otherwise(F.col("label"))
    return named.select(key, F.col("node").alias("place"), "kind", "link", name.alias("name"))
