"""Item-by-term hits, one row per matched list entry, and counts from term tables of any size."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.functions.lexicon import Lexicons, LexiconTooLarge, count_matches, matched_terms

# Functions that run in tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Terms up to this long are looked up whole; longer ones first by a prefix of this length.
PREFIX = 16
#: Size of the filter over the terms, in bits; a fuller filter lets more through, nothing is lost.
BITS_PER_TERM = 32
PROBES = 4
MIN_BITS, MAX_BITS = 1 << 20, 1 << 27
#: Characters (or bytes, for texts hashed together) that a task takes in and hashes at once: arrays
#: and hits that it holds follow this, not the size of the batches that come in.
SLICE = 1 << 18
FAN_IN = 32

_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9


def lexicon_hits(
    items: DataFrame, table: DataFrame, id_col: str = "id", text_col: str = "text",
    plan: str = "auto",
) -> DataFrame:
    """``(id, lexicon, term, multiplicity)`` for every list entry contained in the text.

    Word lists that fit in memory are matched row by row with no shuffle of the
    texts. Larger term tables take the join below; both give the same rows.
    """
    counted = count_terms(table)
    try:
        lexicons = Lexicons.from_table(table)
    except LexiconTooLarge:
        return gram_join_hits(items, counted, id_col, text_col)
    found = items.select(
        F.col(id_col), F.explode(matched_terms(text_col, lexicons, plan)).alias("term")
    )
    # The term side passed the size check above; its counts are those just collected.
    rows = [(name, term, n) for term, counts in lexicons.terms for name, n in zip(lexicons.names, counts) if n]
    local = items.sparkSession.createDataFrame(rows, "lexicon string, term string, multiplicity bigint")
    return found.join(F.broadcast(local), "term").select(
        id_col, "lexicon", "term", "multiplicity"
    )


def count_terms(table: DataFrame) -> DataFrame:
    """``(lexicon, term, multiplicity)`` of a ``(lexicon, term)`` table."""
    return table.groupBy("lexicon", "term").agg(F.count(F.lit(1)).alias("multiplicity"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)


def _mixed(h: np.ndarray, length: int, kind: int) -> np.ndarray:
    h = h + np.uint64((length * 2 + kind) * _MIX % 2**64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX)
    return (h ^ (h >> np.uint64(29))) * np.uint64(_BASE)


class _Windows:
    """Hashes of all windows of a text: differences of running sums of ``code * base^place``,
    shifted back by powers of the base's inverse, all modulo 2^64."""

    def __init__(self):
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, factor in (("power", _BASE), ("inverse", pow(_BASE, -1, 2**64))):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        self.grow(len(codes) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.power[:len(codes)], dtype=np.uint64)])

    def hashes(self, sums: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of every window of a length, or of those that start at the given places."""
        if at is None:
            n = max(0, len(sums) - length)
            return (sums[length:length + n] - sums[:n]) * self.inverse[:n]
        return (sums[at + length] - sums[at]) * self.inverse[at]


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The place of the ``k``-th bit of a hash: the upper bits of a product."""
    return (h * np.uint64(pow(_MIX, k, 2**64))) >> np.uint64(64 - (bits - 1).bit_length())


def _filter_of(bits: int):
    """Per partition of terms, a bit array with ``PROBES`` bits for each term and each prefix."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, found = _Windows(), np.zeros(bits // 8, np.uint8)

        def put(codes: np.ndarray, kind: int) -> None:
            length = codes.shape[1]
            windows.grow(length)
            h = _mixed((codes * windows.power[:length]).sum(1, dtype=np.uint64), length, kind)
            for k in range(PROBES):
                place = _probe(h, k, bits)
                np.bitwise_or.at(found, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for term in batch.column("term").to_pylist():
                by_length.setdefault(len(term), []).append(term)
            for length, terms in by_length.items():
                codes = _codes("".join(terms)).reshape(len(terms), length)
                put(codes, 0)
                if length > PREFIX:
                    put(codes[:, :PREFIX], 1)
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["bits"])

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column("bits"):
            part = np.frombuffer(row.as_py(), np.uint8)
            total = part if total is None else total | part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["bits"])


def term_filter(terms: DataFrame, n: int) -> bytes:
    """A Bloom filter over the ``term`` column: each partition's bits, joined by a tree of tasks.

    At most ``MAX_BITS`` (16 MB), whatever the number of terms.
    """
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (n * BITS_PER_TERM - 1).bit_length() if n else 0))
    # No more partitions than terms to fill them: each one gives a whole filter.
    parts = max(1, min(terms.rdd.getNumPartitions(), n // 10_000))
    found = terms.select("term").repartition(parts).mapInArrow(_filter_of(bits), "bits binary")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts).mapInArrow(_merge, "bits binary")
    return bytes(found.first()["bits"])


def _scanner(filter_: bytes, lengths: Sequence[int]):
    """Of each text, the distinct windows (by a 64-bit hash) that the filter takes for terms."""
    short = [n for n in lengths if n <= PREFIX]
    long_ones = [n for n in lengths if n > PREFIX]
    overlap = max(lengths, default=1) - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, table = _Windows(), np.frombuffer(filter_, np.uint8)
        bits = len(table) * 8

        def may_be(h: np.ndarray) -> np.ndarray:
            """Places in ``h`` that pass: each probe is only for those that passed the one before."""
            at = np.arange(len(h))
            for k in range(PROBES):
                p = _probe(h[at], k, bits)
                at = at[(table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            return at

        def found(joined: str, starts: np.ndarray) -> list[tuple[int, str]]:
            """Row and window, of rows that begin at ``starts`` and end one place before the next."""
            sums, out, ends = windows.sums(_codes(joined)), [], np.append(starts[1:] - 1, len(joined))

            def take(at: np.ndarray, h: np.ndarray, length: int) -> None:
                row = np.searchsorted(starts, at, "right") - 1
                inside = at + length <= ends[row]
                at, h, row = at[inside], h[inside], row[inside]
                order = np.lexsort((h, row))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
                out.extend((r, joined[i:i + length]) for r, i in zip(row[order][new].tolist(), at[order][new].tolist()))

            for length in short:
                h = _mixed(windows.hashes(sums, length), length, 0)
                at = may_be(h)
                take(at, h[at], length)
            if long_ones:
                begun = may_be(_mixed(windows.hashes(sums, PREFIX), PREFIX, 1))
                for length in long_ones:
                    at = begun[begun + length <= len(joined)]
                    h = _mixed(windows.hashes(sums, length, at), length, 0)
                    passed = may_be(h)
                    take(at[passed], h[passed], length)
            return out

        for batch in batches:
            low, first = batch.column("low"), 0
            sizes = pc.binary_length(low).to_pylist()
            while first < len(sizes):
                # Short texts are hashed together, a long one in slices that overlap.
                end, size = first, 0
                while end < len(sizes) and (end == first or size + sizes[end] < SLICE):
                    size += sizes[end]
                    end += 1
                texts = low.slice(first, end - first).to_pylist()
                if end == first + 1:
                    text = texts[0]
                    hits = list({(0, w) for x in range(0, max(len(text) - overlap, 1), SLICE)
                                 for _, w in found(text[x:x + SLICE + overlap], np.zeros(1, np.int64))})
                else:
                    hits = found("\0".join(texts), np.cumsum([0, *[len(x) + 1 for x in texts[:-1]]]))
                owners = pa.array([first + row for row, _ in hits], pa.int64())
                # Given on at once: the hits of a whole batch would take many times its texts.
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(owners), pa.array([w for _, w in hits], pa.string())], names=["id", "term"])
                first = end

    return scan


def gram_join_hits(
    items: DataFrame, counted: DataFrame, id_col: str = "id", text_col: str = "text",
) -> DataFrame:
    """The same hits for a term table of any size; ids must be unique.

    A Bloom filter over the terms goes to the texts. A text's windows of each length that terms
    have are hashed in whole arrays and tested (those longer than ``PREFIX`` only where a
    prefix of a term starts); a window that passes is very likely a term. So what is shuffled
    is about the hits, as ``(id, window)``, never the texts or all their grams, and the join with the term
    table by the term itself settles which windows are terms.
    """
    filled = counted.withColumn("term", F.coalesce("term", F.lit("")))
    # One row per length that occurs; one per lexicon with an empty term, which every text contains.
    sizes = {r["l"]: r["n"] for r in filled.groupBy(F.char_length("term").alias("l")).agg(F.countDistinct("term").alias("n")).collect()}
    everywhere = [(r["lexicon"], r["multiplicity"]) for r in filled.where("term = ''").select("lexicon", "multiplicity").collect()]
    low = items.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    id_type = low.schema["id"].dataType.simpleString()
    lengths = sorted(n for n in sizes if n)
    parts = []
    if lengths:
        terms = filled.where("term <> ''")
        seen = low.mapInArrow(
            _scanner(term_filter(terms.select("term").distinct(), sum(sizes[n] for n in lengths)), lengths), f"id {id_type}, term string")
        parts.append(seen.join(terms, "term").select("id", "lexicon", "term", "multiplicity"))
    if everywhere or not parts:
        always = F.array(*[F.struct(F.lit(x).alias("lexicon"), F.lit("").alias("term"), F.lit(n).cast("bigint").alias("multiplicity"))
                           for x, n in everywhere]) if everywhere else F.from_json(
            F.lit("[]"), "array<struct<lexicon:string,term:string,multiplicity:bigint>>")
        parts.append(low.select("id", F.explode(always).alias("h")).select("id", "h.*"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumnRenamed("id", id_col)


def count_matches_table(
    items: DataFrame, table: DataFrame, names: Sequence[str], id_col: str = "id", text_col: str = "text",
    out: str = "counts", max_terms: int | None = None,
) -> DataFrame:
    """``items`` with a struct of one count per word list, from a ``(lexicon, term)`` table of any size.

    Tables that fit in memory are counted as ``count_matches`` does, without a shuffle. Beyond, the hits of
    ``gram_join_hits`` are added up per item and joined to it; ids must be unique then. Feed the struct to
    ``lexicon_details`` for the score.
    """
    wanted = table.where(F.col("lexicon").isin(*names))
    try:
        lexicons = Lexicons.from_table(wanted, names, **({} if max_terms is None else {"max_terms": max_terms}))
    except LexiconTooLarge:
        hits = gram_join_hits(items, count_terms(wanted), id_col, text_col).groupBy(F.col(id_col).alias("_id")).agg(
            *[F.sum(F.when(F.col("lexicon") == n, F.col("multiplicity"))).alias(f"_{n}") for n in names])
        counts = F.struct(*[F.coalesce(F.col(f"_{n}"), F.lit(0)).cast("int").alias(n) for n in names])
        joined = items.join(hits, F.col(id_col) == F.col("_id"), "left")
        return joined.withColumn(out, counts).drop("_id", *[f"_{n}" for n in names])
    return items.withColumn(out, count_matches(text_col, lexicons))
