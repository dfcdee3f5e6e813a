"""Rules as data: a table of terms, compiled once, and one pass over each text for all of them.

A rule table has the columns rule, kind, term, turn.  Terms of one rule and kind are alternatives.  A
kind that begins with ``any`` must be met, all of a rule's together (AND of OR); one that begins with
``not`` must not.  ``turn`` orders the rules: where one has to be chosen, the least turn wins.

Compiled, each (rule, kind) is a bit.  All terms of all rules are one automaton, with which a text is
read once, whatever the number of rules; rules are then tests of bits, in column expressions.

A rule table is a dimension, small by nature: more than ``MOST`` rows are an error.  Texts and terms
are compared lower-cased; a null text holds no term; rows without rule, kind or term are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 20_000
#: Bits of a long that are used, so that none is negative.
WORD = 62


@dataclass(frozen=True)
class Rules:
    """A compiled rule table: its rules in order, the bit of each (rule, kind), and the terms with theirs."""

    order: tuple[str, ...]
    bits: dict[tuple[str, str], int]
    terms: dict[str, tuple[int, ...]]

    def read(self, text: Column) -> Column:
        """array<long>: the bits of a text, for the tests below."""
        terms, words = self.terms, -(-max(len(self.bits), 1) // WORD)

        @F.arrow_udf("array<long>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = ahocorasick.Automaton()
            for term, where in terms.items():
                automaton.add_word(term, where)
            automaton.make_automaton()
            for texts in batches:
                yield _all_bits(automaton, texts, words) if terms else pa.array([[0] * words] * len(texts), pa.list_(pa.int64()))

        return run(F.lower(F.coalesce(text, F.lit(""))))

    def has(self, bits: Column, rule: str, kind: str) -> Column:
        """Whether the text holds a term of that rule and kind; false for a pair that the table does not have."""
        at = self.bits.get((rule, kind))
        return F.lit(False) if at is None else bits[at // WORD].bitwiseAND(F.lit(1 << at % WORD)) != 0

    def holds(self, bits: Column, rule: str) -> Column:
        """Whether a rule is met: all its ``any`` kinds, and none of its ``not`` kinds."""
        kinds = [k for r, k in self.bits if r == rule]
        met = (self.has(bits, rule, k) if k.startswith("any") else ~self.has(bits, rule, k) for k in kinds if k.startswith(("any", "not")))
        return reduce(Column.__and__, met, F.lit(bool(kinds)))

    def all(self, bits: Column, prefix: str = "") -> Column:
        """The names of all rules that are met, in order; those under a prefix, without it."""
        return F.array_compact(F.array(*(F.when(self.holds(bits, r), F.lit(r[len(prefix) :])) for r in self.order if r.startswith(prefix)), F.lit(None).cast("string")))

    def first(self, bits: Column, prefix: str = "") -> Column:
        """The name of the first rule that is met, else null."""
        return F.coalesce(*(F.when(self.holds(bits, r), F.lit(r[len(prefix) :])) for r in self.order if r.startswith(prefix)), F.lit(None).cast("string"))


def _bits(automaton: ahocorasick.Automaton, text: str, words: int) -> list[int]:
    out = [0] * words
    for where in {w for _, w in automaton.iter(text)}:
        for at in where:
            out[at // WORD] |= 1 << at % WORD
    return out


def _all_bits(automaton: ahocorasick.Automaton, texts: pa.Array, words: int) -> pa.Array:
    """The bits of a batch of texts, of which one at a time is a Python object."""
    return pa.array([_bits(automaton, x.as_py(), words) for x in texts], pa.list_(pa.int64()))


def compiled(rules: DataFrame, most: int = MOST) -> Rules:
    """The rules of a table; the driver holds its rows, of which it takes at most so many."""
    rows = rules.where("rule IS NOT NULL AND kind IS NOT NULL AND term <> ''").select("rule", "kind", F.lower("term").alias("term"), F.coalesce(F.col("turn"), F.lit(1 << 30)).alias("turn")).distinct()
    held = rows.orderBy("turn", "rule", "kind", "term").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a rule table has at most {most} rows")
    bits: dict[tuple[str, str], int] = {}
    terms: dict[str, set[int]] = {}
    for r in held:
        at = bits.setdefault((r["rule"], r["kind"]), len(bits))
        terms.setdefault(r["term"], set()).add(at)
    return Rules(tuple(dict.fromkeys(r["rule"] for r in held)), bits, {t: tuple(sorted(b)) for t, b in terms.items()})
