"""Removing byte strings that occur earlier in the corpus, with suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.llm.passages import Unit, covered, repeated_spans, runs_of
from cribble.llm.shared import NULL_ID
from cribble.llm.suffixes import permuted_lcp, suffix_array

SPAN = 100
GRAM = 32


def _comparing(span: int):
    def compare(table: pa.Table) -> pa.Table:
        segs = table.column("seg").to_pylist()
        size = np.array([len(x) for x in segs])
        # Symbols: 0 ends the text, 1 ends a segment, bytes follow.
        text = np.frombuffer(b"\0".join(segs), np.uint8).astype(np.int64) + 2
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        text[begin[1:] - 1] = 1
        text = np.append(text, 0)
        order = suffix_array(text)
        shared = permuted_lcp(text, order)
        segment = np.repeat(np.arange(len(segs)), size + 1)
        room = begin[segment] + size[segment] - np.arange(len(segment))
        order = order[1:]  # without the end
        # A string of ``span`` bytes inside its segment and all equal ones are neighbours.
        whole = room[order] >= span
        new = shared[order] < span
        group = np.cumsum(new | ~whole)
        at, group = order[whole], group[whole]
        column = lambda name: table.column(name).to_numpy()
        ids, part = column("id")[segment[at]], column("part")[segment[at]]
        start = column("start")[segment[at]].astype(np.int64) + at - begin[segment[at]]
        many = np.bincount(group, minlength=1)[group] > 1
        ids, part, start, group = ids[many], part[many], start[many], group[many]
        by = np.lexsort((start, part, ids, group))
        ids, part, start, group = ids[by], part[by], start[by], group[by]
        later = np.zeros(len(by), bool)
        later[1:] = group[1:] == group[:-1]
        return runs_of(ids[later], part[later], start[later])

    return compare


def _removing(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            at = batch.column("spans").offsets.to_numpy()
            start, n = (batch.column("spans").values.field(k).to_numpy() for k in (0, 1))
            kept, sizes, removed, runs = [], [], [], []
            for k, text in enumerate(texts):
                sizes.append(len(text))
                if at[k] == at[k + 1]:
                    kept.append(text)
                    removed.append(0)
                    runs.append(0)
                    continue
                gone = covered(start[at[k]: at[k + 1]], n[at[k]: at[k + 1]], span, len(text))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)]],
                ["id", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def remove_repeated_bytes(transcripts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Remove each byte inside a string of ``span`` bytes that also starts earlier.

    ``transcripts``: ``id, text``; other columns are ignored. Texts are UTF-8
    bytes, earlier means in a transcript with a smaller id or before in the same
    one, and strings are judged on the input. Candidate segments are dealt into
    shards by anchor (see ``passages``); each shard is sorted by a suffix array
    and its permuted common prefixes show the equal strings.

    Returns one row per input row: ``id, kept`` (binary: the bytes left may cut
    a character), ``n_bytes, n_removed, n_spans`` (maximal removed runs). A null
    or empty text has no bytes. A null id comes before all others. Rows with
    equal id and text are one transcript given twice and get the same result;
    with equal id and different texts, a hash of the text decides which is
    earlier.
    """
    unit = Unit(words=False, span=span, gram=gram, across=False)
    _, rows = repeated_spans(transcripts, unit, "suffixes", _comparing(span))
    return rows.mapInArrow(
        _removing(span), "id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint",
    ).withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
