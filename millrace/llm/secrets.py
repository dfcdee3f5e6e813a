"""Secret scans: patterns with spans, plus runs of high entropy.  DataFrame functions only, one pass, no shuffle.

Three base kinds are patterns (leftmost, not overlapping, per kind).  A fourth kind, ``entropy``,
covers runs of key characters: a window slides over the run, the counts of its characters are
updated by the one that enters and the one that leaves, and so is the sum of c*log2(c), from which
Shannon's entropy follows.  A run is reported if any window passes the bound of the run's character
class.  An allow-list suppresses runs, never base spans.  A run without digits is allowed only if it reads
as names: letters whose case changes at random count as a key.

Spans are in code points, end exclusive.  Defined results: a null text is empty and has no spans;
rows stay as they are, repeated ones included; nothing is cut, whatever the length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
BLOCK = 256
KINDS = ("assign", "access", "hex", "entropy")

#: Window length, and for each character class (first that fits a run) the bits that a window must pass.
WINDOW = 20
PACKED = 10
CLASSES = ((r"^[0-9a-f]+$", 2.9), (r"^[0-9A-F]+$", 2.9), (r"^[A-Z0-9]+$", 3.4), (r"^[A-Za-z0-9]+$", 3.6), (r"^[A-Za-z0-9+/_=-]+$", 3.7))
#: A name: words run together by capitals, with two small letters or two capitals each, or one letter or two.
_NAME = r"(?:(?:[A-Z]*[a-z]{2,}|[A-Z]{2,})++|[A-Z]?[a-z]|[A-Z])"
#: Runs that are no secrets: numbers and rulers, UUIDs, and names joined by signs, with numbers of up to four digits
#: between.  Every repeated group is possessive, so that the engine walks it in a loop and not by a call for each turn.
ALLOWED = (
    r"^[0-9_+/=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"^[_/=+-]*{_NAME}(?:[_/=+-]+(?:{_NAME}|[0-9]{{1,4}}))*+[_/=+-]*$",
)
ALPHABET = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_=-"


def _spans(text: Column, pattern: str, kind: str, ok=lambda match, group: F.lit(True), group: int = 0) -> Column:
    """All matches of pattern as array<struct<start, end, kind, match>>, those that fail ok left out.

    The pieces between the matches and the matches themselves add up to the offsets.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    kind_no = F.lit(KINDS.index(kind))
    span = "array<struct<start:bigint,end:bigint,kind:int,hit:string>>"
    empty = F.array().cast(span)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), kind_no.alias("kind"), x["hit"].alias("hit")))
        keep = x["hit"].isNotNull() & ok(x["hit"], x["part"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def block(acc: Column, xs: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0).cast("bigint"))
        return F.concat(acc, F.array(F.aggregate(xs, F.struct(at.alias("at"), empty.alias("found")), step)))

    def folded(parts: Column) -> Column:
        # a fold copies the list that it extends, so it runs over blocks of matches, and only the blocks' ends pass on
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(parts, i, F.lit(BLOCK)))
        ends = F.aggregate(blocks, F.array().cast(f"array<struct<at:bigint,found:{span}>>"), block)
        return F.flatten(F.transform(ends, lambda b: b["found"]))

    # as the one element of an array, the parts are found once and not again for each block
    return F.when(text.rlike(pattern), F.transform(F.array(parts), folded)[0]).otherwise(empty)


def _clogc(count: int) -> float:
    return count * math.log2(count) if count > 1 else 0.0


def peak_entropy(run: Column, window: int = WINDOW) -> Column:
    """The highest entropy, in bits, of any window of the run (one window if the run is shorter).

    The fold's state is a count for each letter of ALPHABET (PACKED counts of 5 bits to a long, so windows
    have up to 31 characters), the sum of c*log2(c), and its lowest value in the full windows before.
    """
    chars = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    left = F.concat(F.array_repeat(F.lit(-1), window), chars)
    moves = F.arrays_zip(chars.alias("enters"), F.slice(left, F.lit(1), F.size(chars)).alias("leaves"), F.sequence(F.lit(1), F.size(chars)).alias("n"))
    width = F.least(F.lit(window), F.length(run)).cast("double")
    letters = range(len(ALPHABET))
    # by letter: its long, and the unit of its count there; by count: what one more and one less do to the sum
    word, unit = F.array(*(F.lit(i // PACKED) for i in letters)), F.array(*(F.lit(1 << 5 * (i % PACKED)).cast("long") for i in letters))
    gain, loss = (F.array(*(F.lit(_clogc(c + 1 - d) - _clogc(c - d)) for c in range(window + 2))) for d in (0, 1))
    count = lambda acc, letter: F.floor(F.get(acc["counts"], F.get(word, letter)) / F.get(unit, letter)).bitwiseAND(F.lit(31)).cast("int")
    # entropy = log2(width) - sum / width: the peak is where the sum is lowest, among full windows
    low = lambda acc: F.when(acc["n"] <= window, acc["sum"]).otherwise(F.least(acc["low"], acc["sum"]))

    def step(acc: Column, x: Column) -> Column:
        stay = x["leaves"] == x["enters"]
        less = F.when(x["leaves"] >= 0, F.get(loss, count(acc, x["leaves"]))).otherwise(F.lit(0.0))
        more = F.get(gain, count(acc, x["enters"]))
        counts = F.transform(
            acc["counts"],
            lambda c, i: c + F.when(i == F.get(word, x["enters"]), F.get(unit, x["enters"])).otherwise(F.lit(0)) - F.when((x["leaves"] >= 0) & (i == F.get(word, x["leaves"])), F.get(unit, x["leaves"])).otherwise(F.lit(0)),
        )
        return F.struct(F.when(stay, acc["counts"]).otherwise(counts).alias("counts"), F.when(stay, acc["sum"]).otherwise(acc["sum"] - less + more).alias("sum"), low(acc).alias("low"), x["n"].alias("n"))

    zero = F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACKED))
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("low"), F.lit(0).alias("n"))
    return F.round(F.log2(width) - F.aggregate(moves, start, step, low) / width, 6)


def suspicious(run: Column) -> Column:
    """Whether a run of key characters is a secret by entropy and not allow-listed."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | run.rlike(pattern)
    bound = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        bound = F.when(run.rlike(pattern), F.lit(bits)).otherwise(bound)
    return F.when(allowed, F.lit(False)).otherwise(peak_entropy(run) >= bound)


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs' doc_id with ``found``: array<struct<start, end, kind, hit>>, by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        _spans(F.col("_text"), ASSIGN, "assign", lambda hit, value: F.length(value) >= 6, 2),
        _spans(F.col("_text"), ACCESS, "access"),
        _spans(F.col("_text"), HEX, "hex"),
    )
    runs = _spans(F.col("_text"), CANDIDATE, "entropy", lambda hit, _: suspicious(hit))
    return docs.select("doc_id", text.alias("_text")).select("doc_id", F.array_sort(F.concat(base, runs)).alias("found"))


def joined(found: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] != KINDS.index("entropy"))
    return find_secrets(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
