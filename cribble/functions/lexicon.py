"""Counting which word-list entries occur in a text, and the score built on it.

The semantics are containment of the entry *anywhere* in the lower-cased text
(no tokens), once per list entry, so an entry listed twice counts twice.
Entries themselves are not lower-cased.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribble.settings import STRONG_MARKERS, LexiconWeights

try:
    import ahocorasick
except ImportError:  # the built-in plan is used instead
    ahocorasick = None

# Functions that run in tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lists the score reads.
SCORED_LISTS = ("lb", "msa", "egy", "gulf", "sy", "strong_lb_hits")

# The word lists pass through the driver, so their size is checked (about 100 MB).
# Larger tables go through ``cribble.operators.lexhits``, which joins instead.
MAX_TERMS = 2_000_000

# One automaton holds so many terms; larger lists are cut into several.
PART_TERMS = 100_000
# A task keeps so many automata; beyond, each is built anew for every so many bytes of text.
KEPT_PARTS = 4
HELD_CHARS = 1 << 26
# The matches of so many texts are held as sets before they are added up.
MATCHED_ROWS = 128

# Up to here the terms can be constants of a plan.
MAX_PLAN_TERMS = 100_000

# Up to here trying each term with ``contains`` beats one automaton pass that
# first ships the text to Python (see the timings in README.md).
BUILTIN_TERMS = 32


class LexiconTooLarge(ValueError):
    """The term table does not fit in a query plan."""


@dataclass(frozen=True)
class Lexicons:
    """Word lists in compact form: each distinct term once with its count per list."""

    names: tuple[str, ...]
    terms: tuple[tuple[str, tuple[int, ...]], ...]

    @classmethod
    def from_lists(cls, lists: Mapping[str, Iterable[str]]) -> Lexicons:
        names = tuple(lists)
        table: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            for term, n in Counter(lists[name]).items():
                table.setdefault(term, [0] * len(names))[i] = n
        return cls(names, tuple((t, tuple(table[t])) for t in sorted(table)))

    @classmethod
    def from_table(
        cls,
        table: DataFrame,
        names: Iterable[str] | None = None,
        max_terms: int = MAX_TERMS,
    ) -> Lexicons:
        """Read a ``(lexicon, term)`` table; refuses one above ``max_terms`` distinct pairs."""
        rows = (
            table.groupBy("lexicon", "term").agg(F.count(F.lit(1)).alias("n"))
            .limit(max_terms + 1).collect()
        )
        if len(rows) > max_terms:
            raise LexiconTooLarge(f"more than {max_terms} terms; use lexicon_hits or count_matches_table")
        order = tuple(names) if names is not None else tuple(sorted({r.lexicon for r in rows}))
        terms: dict[str, list[int]] = {}
        for r in rows:
            if r.lexicon in order:
                terms.setdefault(r.term, [0] * len(order))[order.index(r.lexicon)] = r.n
        return cls(order, tuple((t, tuple(terms[t])) for t in sorted(terms)))

    def select(self, names: Iterable[str]) -> Lexicons:
        """The given lists only, in that order; one that is missing is an empty list."""
        names = tuple(names)
        at = [self.names.index(n) if n in self.names else None for n in names]
        kept = ((t, tuple(0 if i is None else c[i] for i in at)) for t, c in self.terms)
        return Lexicons(names, tuple((t, c) for t, c in kept if any(c)))

    def with_markers(self, markers: Iterable[str] = STRONG_MARKERS) -> Lexicons:
        """These lists and, if none is given, the strong markers as ``strong_lb_hits``."""
        if "strong_lb_hits" in self.names:
            return self
        lists = {n: [t for t, c in self.terms for _ in range(c[i])] for i, n in enumerate(self.names)}
        return Lexicons.from_lists(lists | {"strong_lb_hits": list(markers)})

    def as_array(self) -> Column:
        """The terms as one constant ``array<struct<term, counts>>``."""
        rows = [{"term": t, "counts": list(c)} for t, c in self.terms]
        return F.from_json(
            F.lit(json.dumps(rows, ensure_ascii=False)),
            "array<struct<term:string,counts:array<int>>>",
        )


def _matcher_builder(lexicons: Lexicons) -> Callable[[], Callable[[str], set[int]]]:
    """A function that builds, on an executor, the map from a text to its matched terms.

    Everything shipped is nested in here, so executors need no copy of this package.
    """
    return _builder_of([t for t, _ in lexicons.terms])


def _builder_of(terms: list[str]) -> Callable[[], Callable[[str], set[int]]]:
    def build():
        import ahocorasick

        always = {i for i, term in enumerate(terms) if not term}
        if len(always) == len(terms):
            return lambda text: always
        machine = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            if term:
                machine.add_word(term, i)
        machine.make_automaton()
        return lambda text: always.union(i for _, i in machine.iter(text))

    return build


def _in_parts(lexicons: Lexicons):
    """``run(batches, empty, add, finish)``: pass texts through one automaton after the other.

    ``add`` puts the matched terms of one part, as sets of numbers counted from ``start``, on what ``empty``
    made for a batch; ``finish`` gives the batch's result. Parts of more than one are broadcast, each of at most
    ``PART_TERMS`` terms. Texts are read once: where there are more parts than a task keeps, texts are
    held (``HELD_CHARS`` bytes of them) while each automaton is built in turn.
    """
    terms = [t for t, _ in lexicons.terms]
    cuts = range(0, max(1, len(terms)), PART_TERMS)
    context = SparkSession.active().sparkContext
    # Lists that a plan can hold travel with the function itself.
    shared = [context.broadcast(terms[x:x + PART_TERMS]) for x in cuts] if len(terms) > PART_TERMS else None
    starts, kept, held, step = list(cuts), KEPT_PARTS, HELD_CHARS, MATCHED_ROWS
    first = None if shared else _builder_of(terms)
    builder_of = _builder_of

    def run(batches: Iterator[pa.Array], empty: Callable, add: Callable, finish: Callable) -> Iterator:
        machines: dict[int, Callable] = {}

        def machine(k: int) -> Callable[[str], set[int]]:
            if k not in machines:
                if len(machines) >= kept:
                    machines.clear()
                machines[k] = first() if shared is None else builder_of(shared[k].value)()
            return machines[k]

        def through(group: list[pa.Array]) -> Iterator:
            totals = [empty(len(texts)) for texts in group]
            for k, start in enumerate(starts):
                match = machine(k)
                for texts, total in zip(group, totals):
                    for a in range(0, len(texts), step):
                        add(total[a:a + step], start, [match(t) for t in texts.slice(a, step).to_pylist()])
            for total in totals:
                yield finish(total)

        group, size = [], 0
        for texts in batches:
            group.append(texts)
            size += texts.nbytes
            del texts  # or it would stay while the next batch comes in
            if len(starts) <= kept or size >= held:
                yield from through(group)
                group, size = [], 0
        if group:
            yield from through(group)

    return run


def _arrow_counts(lexicons: Lexicons, low: Column) -> Column:
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in lexicons.names])
    run, names = _in_parts(lexicons), list(lexicons.names)
    weights = np.array([c for _, c in lexicons.terms], dtype=np.int32).reshape(len(lexicons.terms), len(names))
    if len(weights) > PART_TERMS:
        weights_shared = SparkSession.active().sparkContext.broadcast(weights)
        weights = None

    @F.arrow_udf(schema)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = weights_shared.value if weights is None else weights

        def add(total: np.ndarray, start: int, matched: list[set[int]]) -> None:
            sizes = np.array([len(m) for m in matched], dtype=np.int64)
            if not sizes.sum():
                return
            ids = np.fromiter((i for m in matched for i in m), dtype=np.int64, count=int(sizes.sum())) + start
            # Hits stand row by row: running sums at the rows' ends give each row's total.
            sums = np.concatenate([np.zeros((1, table.shape[1]), np.int64), np.cumsum(table[ids], axis=0, dtype=np.int64)])
            ends = np.cumsum(sizes)
            total += sums[ends] - sums[ends - sizes]

        yield from run(batches, lambda n: np.zeros((n, len(names)), np.int64), add,
                       lambda total: pa.StructArray.from_arrays([pa.array(x) for x in total.astype(np.int32).T], names))

    return count(low)


def _arrow_hits(lexicons: Lexicons, low: Column) -> Column:
    run, terms = _in_parts(lexicons), [t for t, _ in lexicons.terms]
    if len(terms) > PART_TERMS:
        terms_shared = SparkSession.active().sparkContext.broadcast(terms)
        terms = None

    @F.arrow_udf("array<string>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = terms_shared.value if terms is None else terms

        def add(total: list[list[str]], start: int, matched: list[set[int]]) -> None:
            for row, found in zip(total, matched):
                row.extend(names[start + i] for i in sorted(found))

        yield from run(batches, lambda n: [[] for _ in range(n)], add, lambda total: pa.array(total, pa.list_(pa.string())))

    return hits(low)


def _builtin_hits(lexicons: Lexicons, low: Column) -> Column:
    """Matched entries. The text is bound to a lambda variable so that ``lower`` runs once."""
    return F.get(
        F.transform(
            F.array(low),
            lambda t: F.filter(lexicons.as_array(), lambda e: F.contains(t, e["term"])),
        ),
        0,
    )


def _builtin_counts(lexicons: Lexicons, low: Column) -> Column:
    def total(hits: Column, k: int) -> Column:
        return F.aggregate(hits, F.lit(0), lambda acc, e: acc + F.get(e["counts"], k))

    return F.get(
        F.transform(
            F.array(_builtin_hits(lexicons, low)),
            lambda hits: F.struct(
                *[total(hits, k).alias(name) for k, name in enumerate(lexicons.names)]
            ),
        ),
        0,
    )


def _use_arrow(lexicons: Lexicons, plan: str) -> bool:
    if plan not in ("auto", "builtin", "arrow"):
        raise ValueError(f"unknown plan {plan!r}")
    if plan == "arrow" and ahocorasick is None:
        raise RuntimeError("the arrow plan needs pyahocorasick on every executor")
    if plan == "builtin" and len(lexicons.terms) > MAX_PLAN_TERMS:
        raise LexiconTooLarge(f"more than {MAX_PLAN_TERMS} terms can't be constants of a plan; use auto or arrow")
    if plan == "auto":
        return ahocorasick is not None and len(lexicons.terms) > BUILTIN_TERMS
    return plan == "arrow"


def count_matches(text: Column | str, lexicons: Lexicons, plan: str = "auto") -> Column:
    """``struct`` of one count per word list; a null text counts as empty.

    ``builtin`` tries every distinct term with ``contains`` inside the JVM.
    ``arrow`` walks each text once through an automaton of all terms, so its
    cost does not grow with the lists. ``auto`` picks by the number of terms.
    """
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    if _use_arrow(lexicons, plan):
        return _arrow_counts(lexicons, low)
    return _builtin_counts(lexicons, low)


def matched_terms(text: Column | str, lexicons: Lexicons, plan: str = "auto") -> Column:
    """Distinct matched terms as ``array<string>``."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    if _use_arrow(lexicons, plan):
        return _arrow_hits(lexicons, low)
    return F.transform(_builtin_hits(lexicons, low), lambda e: e["term"])


def dominance_ratio(lb: Column, msa: Column) -> Column:
    """``msa / (lb + msa)``, 0 when both are 0."""
    return F.when(lb + msa > 0, msa / (lb + msa)).otherwise(F.lit(0.0))


def raw_score(counts: Column, weights: LexiconWeights = LexiconWeights()) -> Column:
    """Weighted sum, less an extra penalty once the unrounded ratio reaches its limit."""
    w = weights
    base = (
        counts["lb"] * F.lit(w.lb)
        - counts["msa"] * F.lit(w.msa)
        - counts["egy"] * F.lit(w.egy)
        - counts["gulf"] * F.lit(w.gulf)
        - counts["sy"] * F.lit(w.sy)
    )
    dominated = dominance_ratio(counts["lb"], counts["msa"]) >= w.dominance_ratio
    return F.when(dominated, base - counts["msa"] * F.lit(w.dominance_penalty)).otherwise(base)


def clamp_score(raw: Column, weights: LexiconWeights = LexiconWeights()) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / F.lit(weights.scale)))


def lexicon_details(counts: Column, weights: LexiconWeights = LexiconWeights()) -> Column:
    """The nine-field score struct from a ``count_matches`` struct."""

    def build(c: Column) -> Column:
        raw = raw_score(c, weights)
        return F.struct(
            *[c[k].alias(k) for k in SCORED_LISTS],
            F.round(dominance_ratio(c["lb"], c["msa"]), 3).alias("msa_ratio_core"),
            raw.alias("raw_score"),
            clamp_score(raw, weights).alias("lexicon_score"),
        )

    # Bound once: the counts are the costly part and each field reads them.
    return F.get(F.transform(F.array(counts), build), 0)


def lexicon_score(
    text: Column | str,
    lexicons: Lexicons,
    weights: LexiconWeights = LexiconWeights(),
    plan: str = "auto",
) -> Column:
    """Counts of the six lists and the score from them; lists of other names are ignored."""
    return lexicon_details(count_matches(text, lexicons.select(SCORED_LISTS), plan), weights)


def final_score(
    text: Column | str,
    lexicons: Lexicons,
    weights: LexiconWeights = LexiconWeights(),
    plan: str = "auto",
) -> Column:
    """``struct(final_score, lex_score, lexicon_details, adi)``; ``adi`` is always null."""
    return F.get(
        F.transform(
            F.array(lexicon_score(text, lexicons, weights, plan)),
            lambda d: F.struct(
                d["lexicon_score"].alias("final_score"),
                d["lexicon_score"].alias("lex_score"),
                d.alias("lexicon_details"),
                F.lit(None).cast("string").alias("adi"),
            ),
        ),
        0,
    )
