"""Removing lines that several transcripts share.

Lines never meet in a join. Each text's distinct line hashes are counted; the
hashes held often enough are indexed by a minimal perfect hash per shard, whose
slots point into fingerprint, count and holder arrays; the texts' hashes are
then sent to the shard that owns them and look themselves up there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.llm.shared import NULL_ID, settle
from cribble.llm.words import mixed

MIN_LENGTH = 20
MIN_TEXTS = 3
SHARD_KEYS = 1 << 15
#: A hash held by over 1 / HOT_PARTS of all (text, line) pairs is looked up where the
#: text is; there are at most HOT_PARTS such hashes, whatever the corpus.
HOT_PARTS = 5_000

BLANKS = b" \t\n\x0b\x0c\r"
COLUMNS = "id bigint, h1 bigint, h2 bigint"


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def line_hashes(text: bytes, min_length: int) -> list[tuple[bytes, bytes | None]]:
    """Every line with the 16-byte hash of its key, None for a key that is too short."""
    from hashlib import blake2b

    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANKS).lower()
        # Bytes that continue a character are 10xxxxxx, as signed numbers below -64.
        long = len(key) >= min_length and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_length)
        out.append((line, blake2b(key, digest_size=16).digest() if long else None))
    return out


class PerfectHash:
    """A minimal perfect hash of 128-bit keys: level by level, keys that fall alone
    into a slot of a bit array stay there, the others try the next level."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, gamma: int = 2):
        self.levels: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        base = 0
        while len(h1):
            size = gamma * len(h1) + 1
            at = self.slots(h1, h2, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            self.ranks.append(base + np.cumsum(alone) - 1)
            base += int(alone.sum())
            h1, h2 = h1[~alone[at]], h2[~alone[at]]
        self.size = base

    @staticmethod
    def slots(h1, h2, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64)
        return (mixed(h1 ^ mixed(h2 + seed)) % np.uint64(size)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for a key that is not in the set."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (alone, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self.slots(h1[left], h2[left], level, len(alone))
            here = alone[at]
            out[left[here]] = ranks[at[here]]
            left = left[~here]
        return out


class LineIndex:
    """Arrays behind a perfect hash: fingerprint, number of texts, largest text id."""

    def __init__(self, h1, h2, counts, holders):
        self.hash = PerfectHash(h1.view(np.uint64), h2.view(np.uint64))
        at = self.hash.find(h1.view(np.uint64), h2.view(np.uint64))
        self.print1, self.print2, self.counts, self.holders = (np.empty(len(at), np.int64) for _ in range(4))
        for to, values in ((self.print1, h1), (self.print2, h2), (self.counts, counts), (self.holders, holders)):
            to[at] = values

    def dropped(self, ids, h1, h2, min_texts: int) -> np.ndarray:
        """Which (text, line) pairs lose their line: an indexed line whose last holder is another."""
        if not self.hash.size:
            return np.zeros(len(ids), bool)
        at = self.hash.find(h1.view(np.uint64), h2.view(np.uint64))
        hit = (at >= 0) & (self.print1[at] == h1) & (self.print2[at] == h2)
        return hit & (self.counts[at] >= min_texts) & (self.holders[at] != ids)


def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _hashing(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = {h for _, h in line_hashes(text, min_length) if h}
                ids.append(np.full(len(found), i, np.int64))
                keys.extend(found)
            pairs = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids or [np.zeros(0, np.int64)])),
                 pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["id", "h1", "h2"])

    return run


def _probing(min_texts: int):
    """Streams partitions sorted by shard: index rows come first in each shard, then lookups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, index = None, [], None
        for batch in batches:
            shard, kind = _column(batch, "shard"), _column(batch, "n")
            columns = [_column(batch, x) for x in ("h1", "h2", "n", "id")]
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind > 0) != 0)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if a == b:
                    continue
                if shard[a] != current:
                    current, rows, index = shard[a], [], None
                part = [c[a:b] for c in columns]
                if kind[a] > 0:
                    rows.append(part)
                    continue
                if index is None:
                    none = [np.zeros(0, np.int64)] * 4
                    index, rows = LineIndex(*(np.concatenate(x) for x in zip(*(rows or [none])))), []
                lost = index.dropped(part[3], part[0], part[1], min_texts)
                out.append(np.stack([part[3][lost], part[0][lost], part[1][lost]]))
            found = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "h1", "h2"])

    return run


def _hot_probing(hot: tuple[np.ndarray, ...], min_texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex(*hot)
        for batch in batches:
            lost = index.dropped(*(_column(batch, x) for x in ("id", "h1", "h2")), min_texts)
            yield batch.filter(pa.array(lost))

    return run


def _rewriting(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, lost = [], [], []
            at = batch.column(2).offsets.to_numpy()
            pairs = np.stack([batch.column(2).values.field(x).to_numpy() for x in (0, 1)], 1)
            rows = zip(batch.column(1).cast(pa.binary()).to_pylist(), at, at[1:])
            for text, a, b in rows:
                if a == b:
                    texts.append(text)
                    n.append(text.count(b"\n") + 1)
                    lost.append(0)
                    continue
                drop = {pair.tobytes() for pair in pairs[a:b]}
                lines = line_hashes(text, min_length)
                kept = [line for line, h in lines if h not in drop]
                texts.append(b"\n".join(kept))
                n.append(len(lines))
                lost.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()),
                 pa.array(n, pa.int64()), pa.array(lost, pa.int64()), batch.column(3)],
                ["id", "text", "n_lines", "n_dropped", "carried"])

    return run


def drop_shared_lines(
    transcripts: DataFrame, min_length: int = MIN_LENGTH, min_texts: int = MIN_TEXTS,
    shard_keys: int = SHARD_KEYS, carry: Sequence[str] = (),
) -> DataFrame:
    """Keep each line that many transcripts share only in the transcript with the largest id.

    ``transcripts``: ``id, text``; of other columns, those named in ``carry`` come
    along in a struct ``carried``. Lines end at
    ``\\n``; they are equal when they agree without white space at both ends and
    without case (A-Z). Lines of ``min_length`` characters or more that stand in
    ``min_texts`` transcripts or more lose all copies but those in the last.

    Returns one row per input row: ``id, text`` (the lines left), ``n_lines``
    (before), ``n_dropped, carried``. A null or empty text is one empty line. A null id
    counts as the smallest id. Each row counts as a transcript; rows with the
    same id keep or lose the same lines.

    Keys are 128-bit hashes. A shard holds about ``shard_keys`` of them; a
    lookup that streams past needs no memory, so only the index is held.
    """
    spark = transcripts.sparkSession
    rows = transcripts.select(F.coalesce(F.col("id").cast("bigint"), F.lit(NULL_ID)).alias("id"),
                              F.coalesce("text", F.lit("")).alias("text"),
                              F.struct(*(carry or [F.lit(True).alias("none")])).alias("carried"))
    pairs = settle(rows.select("id", "text").mapInArrow(_hashing(min_length), COLUMNS), "lines")
    # Partial counts leave one row per hash and task, however often a line occurs.
    held = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"))
    index = settle(held.where(F.col("n") >= min_texts), "line_index")
    total, keys = pairs.count(), index.count()
    shards = max(1, -(-keys // shard_keys))
    least = max(min_texts, total // HOT_PARTS + 1)
    hot_rows = index.where(F.col("n") >= least).toArrow() if keys else None  # at most HOT_PARTS
    hot = tuple(hot_rows.column(x).to_numpy() if keys else np.zeros(0, np.int64) for x in ("h1", "h2", "n", "id"))

    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    of_index = index.where(F.col("n") < least).select(shard, "h1", "h2", "n", "id")
    lookups = pairs.select(shard, "h1", "h2", F.lit(0).cast("bigint").alias("n"), "id")
    if len(hot[0]):
        names = spark.createDataFrame(pa.table({"h1": hot[0], "h2": hot[1]}))
        lookups = lookups.join(F.broadcast(names), ["h1", "h2"], "left_anti").select("shard", "h1", "h2", "n", "id")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    lost = (
        of_index.unionByName(lookups).repartition(int(parts), "shard")
        .sortWithinPartitions("shard", F.col("n").desc())
        .mapInArrow(_probing(min_texts), COLUMNS)
    )
    if len(hot[0]):
        lost = lost.unionByName(pairs.mapInArrow(_hot_probing(hot, min_texts), COLUMNS))
    drops = lost.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    kind = rows.schema["carried"].dataType.simpleString()
    return rows.join(drops, "id", "left").select("id", "text", "drop", "carried").mapInArrow(
        _rewriting(min_length), f"id bigint, text string, n_lines bigint, n_dropped bigint, carried {kind}",
    ).withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
