"""Repair of the structure of conversations, by a suffix-shared automaton of their signatures.

A row's signature is one letter: its role's initial (s, u, a, or o for any other), upper-case if the
row is truncated, and x if it must go (blank, or role and text seen earlier in the conversation).
Edits turn a conversation into one whose roles read (s?(ua)+)? at the least cost: Keep 0, Rerole 2,
Delete 3, Insert 2, and 1 for each truncated row that stays.  The audit is the edits' initials in
order, the ASCII-least of the cheapest.

1. Rows are reduced to (conv_id, turn, role, digest of the text) with a count, so that rows that
   repeat are one; the first turn of each role and text in a conversation tells duplicates.
2. These narrow rows are sorted by range, so that a conversation of any size lies over as many tasks
   as it needs, and become strings of at most BLOCK letters.  Where a conversation has several, a
   pass from its end gives what the rest costs from each grammar state.
3. Distinct strings are sorted from their end.  Strings that end alike share the nodes of that end:
   the automaton has one node for each distinct suffix, and the cost-to-go and the best audit suffix
   of a node are computed once for each grammar state, whatever the number of conversations.
4. Texts move once: sorted by conversation and turn they meet the audits, and a stream writes the
   repaired rows, or their hash.  A hash is a chain, so one task reads all of a conversation; it
   holds a batch of rows and the audit.

Defined results: a null role or text counts as one space, in the damage's key null ids count so too;
rows of the null conv_id are one conversation.  Rows of one turn are ordered by role, then by the
text's MD5; null turns come first.  An empty role has no initial and cannot be kept.  A conversation
without rows has zeros, an empty audit and the hash of nothing.  turn must be an integer.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.shared import SPACE, broadcast_if_small, write_table

#: Letters of a signature string at most.
BLOCK = 1024
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a.  0 and 3 may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What rerole and insert lead to from each state.
FILLS = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
#: (cost, audit) of each state at the end of a conversation.
END = ((0, ""), (4, "II"), (2, "I"), (0, ""))


def before(letter: str, after: tuple) -> tuple:
    """The node in front of ``after`` by one letter: least (cost, audit) for each grammar state."""
    cut = CUT if letter.isupper() else 0
    best = []
    for q in range(4):
        ways = [(DELETE + after[q][0], "D" + after[q][1])]
        if letter != "x":
            kept, (filled, _) = NEXT[q].get(letter.lower()), FILLS[q]
            if kept is not None:
                ways.append((cut + after[kept][0], "K" + after[kept][1]))
            ways.append((REROLE + cut + after[filled][0], "R" + after[filled][1]))
        best.append(min(ways))
    # an insert leads on at the same node; a second one in a row is of use only in front of u and a
    two, three = (min(best[q], (INSERT + best[5 - q][0], "I" + best[5 - q][1])) for q in (2, 3))
    zero, one = (min(best[q], (INSERT + two[0], "I" + two[1])) for q in (0, 1))
    return zero, one, two, three


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the damage of crc32(conv_id:turn) % 20, and how often each stands: dropped, emptied, without [.!?], repeated, or made the user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows, F.col("times")


def _keyed(rows: DataFrame, times: Column) -> DataFrame:
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.cast("int").alias("times"))
    return named.withColumn("digest", F.md5(F.col("text").cast("binary")))


def _letters(keyed: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, letters): letters of the rows alike in all four."""
    text = F.col("text")
    runs = keyed.where("times > 0").groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("times").alias("n"),
        F.max(~text.rlike(rf"[^\x20\x09-\x0D]")).alias("blank"),
        F.max(~text.rlike(rf"[.!?]{SPACE}*\z")).alias("cut"),
    )
    runs = write_table(runs, "conversation-rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = runs.where("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    seen = seen.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    initial = F.substring("role", 1, 1)
    kept = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    gone = F.col("blank") | (at > F.col("first"))
    head = F.when(F.coalesce(gone, F.col("blank")), "x").when(F.col("cut"), F.upper(kept)).otherwise(kept)
    return runs.join(seen, same, "left").select("conv_id", "turn", "role", "digest", head.alias("head"), (F.col("n") - 1).alias("more"))


#: Ascending, and so with nulls first.
_KEY = ["turn", "role", "digest"]


def _pieces(head: str, more: int, size: int) -> Iterator[str]:
    yield head
    for at in range(0, more, size):
        yield "x" * min(size, more - at)


def _cut_blocks(size: int):
    """Sorted rows become blocks of at most so many letters; a block has the key of the row that its first letter is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k, schema = None, 0, None
        for batch in batches:
            done = []
            schema = pa.schema([batch.schema.field(c) for c in ("conv_id", "turn", "role", "digest", "part")] + [pa.field("k", pa.int64()), pa.field("sig", pa.string())])
            for r in batch.to_pylist():
                for piece in _pieces(r.pop("head"), r.pop("more"), size):
                    while piece:
                        if held is None or held["conv_id"] != r["conv_id"] or len(held["sig"]) == size:
                            done += [held] if held else []
                            held, k = r | {"k": k, "sig": ""}, k + 1
                        room = size - len(held["sig"])
                        held["sig"] += piece[:room]
                        piece = piece[room:]
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of long conversations from the last to the first: what the rest of the conversation costs behind each."""
    last, node = (), END
    for batch in batches:
        exits, conv = [], batch.column("conv_id").to_pylist()
        for conv_id, sig in zip(conv, batch.column("sig").to_pylist(), strict=True):
            if (conv_id,) != last:
                last, node = (conv_id,), END
                exits.append("")
            else:
                exits.append(",".join(str(c) for c, _ in node))
            for letter in reversed(sig):
                node = before(letter, node)
                # only the costs go on, less what all states share
                least = min(c for c, _ in node)
                node = tuple((c - least, "") for c, _ in node)
        columns = [batch.column(c) for c in ("part", "k")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(exits, pa.string())], ["part", "k", "exit"])


def _suffix_automaton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures sorted from their end: the nodes of the last one's suffixes stay while the next one shares them."""
    nodes, was, exit_ = [END], "", None
    for batch in batches:
        out = []
        for e, turned, opens in zip(*(batch.column(c).to_pylist() for c in ("exit", "turned", "opens")), strict=True):
            if e != exit_:
                exit_, was, nodes = e, "", [tuple((int(c), "") for c in e.split(",")) if e else END]
            shared = next((i for i, (a, b) in enumerate(zip(was, turned)) if a != b), min(len(was), len(turned)))
            del nodes[shared + 1 :]
            for letter in turned[shared:]:
                nodes.append(before(letter, nodes[-1]))
            was = turned
            out.append([audit for _, audit in (nodes[-1][:1] if opens else nodes[-1])])
        columns = [batch.column(c) for c in ("exit", "turned", "opens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.string()))], ["exit", "turned", "opens", "audits"])


def _audited(keyed: DataFrame, block: int) -> DataFrame:
    """Blocks with their cheapest audits: one where the conversation opens with the block, else one for each grammar state."""
    letters, conv = _letters(keyed), keyed.schema["conv_id"]
    order = ["conv_id", *_KEY]
    dealt = letters.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    key = [conv, T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("part", T.IntegerType())]
    blocks = write_table(dealt.mapInArrow(_cut_blocks(block), T.StructType([*key, T.StructField("k", T.LongType()), T.StructField("sig", T.StringType())])), "blocks")
    place = F.struct("part", "k")
    spans = blocks.groupBy(F.col("conv_id").alias("_c")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    placed = blocks.join(spans, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("opens", place == F.col("first"))
    long = placed.where("first <> last").select("conv_id", "part", "k", "sig")
    long = long.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("k"))
    exits = long.mapInArrow(_chain, "part int, k long, exit string")
    turned = F.reverse("sig")
    marked = placed.where("first = last").select(*blocks.columns, "opens", F.lit("").alias("exit"))
    marked = marked.unionByName(placed.where("first <> last").join(exits, ["part", "k"]).select(*blocks.columns, "opens", "exit"))
    marked = write_table(marked.select("*", turned.alias("turned")).drop("sig"), "signatures")
    distinct = marked.select("exit", "turned", "opens").distinct().repartitionByRange("exit", "turned", "opens").sortWithinPartitions("exit", "turned", "opens")
    audits = write_table(distinct.mapInArrow(_suffix_automaton, "exit string, turned string, opens boolean, audits array<string>"), "audits")
    return marked.join(broadcast_if_small(audits, 10 * F.length("turned") + 64), ["exit", "turned", "opens"])


class _Walk:
    """One conversation as its rows pass: the edits, what is repaired, and the counts of the report."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.state, self.blocks, self.left, self.edits = conv_id, 0, deque(), "", iter("")
        self.audit, self.cost, self.hash, self.kept = [], 0, hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.least, self.turn, self.initial = 0, None, None, None

    def _write(self, role: str, text: str) -> tuple[str, str]:
        self.hash.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.kept += 1
        return role, text

    def _edit(self, letter: str, role: str, text: str, cut: int) -> tuple[str, str] | None:
        self.audit.append(letter)
        if letter == "D":
            self.cost += DELETE
            return None
        if letter == "K":
            self.cost, self.state = self.cost + cut, NEXT[self.state][role[0]]
        else:
            self.cost += INSERT if letter == "I" else REROLE + cut
            self.state, role = FILLS[self.state]
        return self._write(role, text)

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that stand in the repaired conversation for this one."""
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.least = self.turns + 1, turn, turn if self.least is None else self.least
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if not self.left:
            audits, turned = self.blocks.popleft()
            self.left, self.edits = turned, iter(audits[self.state if len(audits) > 1 else 0])
        letter, self.left = self.left[-1], self.left[:-1]
        blank = not _SEEN.search(text)
        self.blank += blank
        self.duplicate += letter == "x" and not blank
        self.truncated += letter.isupper()
        for edit in self.edits:
            if found := self._edit(edit, *(("", "", 0) if edit == "I" else (role, text, letter.isupper()))):
                yield edit, *found
            if edit != "I":
                return

    def end(self) -> Iterator[tuple[str, str, str]]:
        for edit in self.edits:
            yield edit, *self._edit(edit, "", "", 0)

    def report(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _walked(batches: Iterator[pa.RecordBatch], report: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    walk, seq = None, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if walk is None or walk.conv_id != r["conv_id"]:
                if walk:
                    ended = [(walk.conv_id, seq + i, *x) for i, x in enumerate(walk.end())]
                    out += [walk.report()] if report else ended
                walk, seq = _Walk(r["conv_id"]), 0
            if r["audits"] is not None:
                walk.blocks.append((r["audits"], r["turned"]))
            for _ in range(r["times"]):
                for x in walk.row(r["turn"], r["role"], r["text"]):
                    if not report:
                        out.append((walk.conv_id, seq, *x))
                    seq += 1
        yield _record(out, schema)
    if walk:
        ended = [(walk.conv_id, seq + i, *x) for i, x in enumerate(walk.end())]
        yield _record([walk.report()] if report else ended, schema)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _streamed(rows: DataFrame, times: Column, block: int, report: bool) -> DataFrame:
    keyed, conv = _keyed(rows, times), rows.schema["conv_id"].dataType
    none = F.lit(None)
    texts = keyed.select("*", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("k"), none.cast("string").alias("turned"), none.cast("array<string>").alias("audits"))
    blocks = _audited(keyed, block).select("conv_id", "turn", "role", none.cast("string").alias("text"), F.lit(0).alias("times"), "digest", "part", "k", "turned", "audits")
    both = texts.unionByName(blocks).repartition("conv_id")
    # of one key the blocks come first, in order, then the texts
    both = both.sortWithinPartitions("conv_id", *_KEY, F.col("audits").isNull(), "part", "k")
    own = [("audit", T.StringType()), ("repaired_sha256", T.StringType())]
    fields = [("conv_id", conv), *((c, T.LongType()) for c in _COUNTS), *own] if report else [("conv_id", conv), ("seq", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)
    return both.mapInArrow(lambda batches: _walked(batches, report, arrow), schema)


def repaired(rows: DataFrame, times: Column | None = None, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, seq, edit (K, R or I), role, text."""
    return _streamed(rows, F.lit(1) if times is None else times, block, False)


def repair_report(rows: DataFrame, times: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row a conversation: faults, cost and audit of the repair, hash of the result.

    times: how often each row stands; 0 makes its conversation known and no more.
    """
    return _streamed(rows, F.lit(1) if times is None else times, block, True)
