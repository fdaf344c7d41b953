"""Where repeated passages can be: what suffix-array and phrase de-duplication share.

A string of ``span`` units (bytes or words) is stood for by its anchor, the
rightmost least hash among its ``gram``-unit grams. Equal strings have equal
anchors at equal places. Neighbouring strings with the same anchor make a
segment, so a text falls into segments of at most ``2 * span`` units, and
equal strings can only lie in segments of one anchor hash. Segments are dealt
out by that hash. Equal segments are collapsed into the first before anything
else; only groups with different segments left need their texts compared.
Where one anchor has many different segments, their strings are collapsed in the
same way, each by a 128-bit hash of its own, so that a string shared by any number
of texts is never gathered. Strings left by that are all different.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.llm.shared import keyed, settle
from cribble.llm.words import AS_IS, NOT_SPACE, Rolling, Words, buffers, portions

#: Bytes of text whose segments are collapsed together before they are dealt out.
COMBINE = 1 << 24
PIECE = 1 << 20
#: Bytes (or about six times the words) of segments compared in one go.
SHARD = 1 << 21
#: Groups with more different segments are collapsed string by string, dealt by the string.
WIDE = 2_000
#: Segments, equal ones included, that one task streams past the passages of a shard.
PART = 50_000


@dataclass(frozen=True)
class Unit:
    """What a text is made of, and the length of strings that count as repeated.

    ``across``: only a string that starts in a text with a smaller id counts;
    otherwise one that starts earlier in the same text does as well.
    """

    words: bool
    span: int
    gram: int
    across: bool

    @property
    def width(self) -> int:
        return self.span - self.gram + 1


def units_of(column, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (words) or bytes of many texts, and the texts' bounds in them."""
    data, bounds = buffers(column)
    if not unit.words:
        return data, bounds
    words = Words(data, bounds, NOT_SPACE, AS_IS)
    return words.hashes, words.first


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the rightmost least gram in each ``width`` consecutive ones."""
    low, at, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right, right_at = low[step:], at[step:]
        low, at = low[: len(low) - step], at[: len(at) - step]
        take = right <= low
        low, at = np.where(take, right, low), np.where(take, right_at, at)
        have += step
    return at


def segments(values: np.ndarray, bounds: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Every segment: text number, start in it, number of strings, anchor hash, content hash.

    Goes in pieces with an overlap, so memory does not depend on a text's length.
    A segment may be cut where a piece ends, which only makes two of it.
    """
    grams, content = Rolling(11), Rolling(12)
    out = []
    for a in range(0, len(values), PIECE):
        part = values[a: a + PIECE + unit.span - 1]
        if len(part) < unit.span:
            break
        part = part if unit.words else grams.table[part]
        hashes = grams.grams(part, unit.gram)
        at = anchors(hashes, unit.width)
        n = len(at)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(np.clip(bounds - a, 0, n)))
        inside = np.arange(a, a + n) + unit.span <= bounds[text + 1]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, n))
        ok = inside[first]
        first, run = first[ok], run[ok]
        sums = content.prefix(part)
        out.append((text[first], first + a - bounds[text[first]], run, hashes[at[first]],
                    content.runs(sums, first, first + run - 1 + unit.span)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


SEGMENT = "deal bigint, v bigint, s bigint, anchor bigint, id bigint, part bigint, start int, run int, twin boolean"
SIFTED = "v bigint, anchor bigint, id bigint, part bigint, start int, run int, twin boolean"


def _collapsed(rows: list[tuple[np.ndarray, ...]], unit: Unit) -> pa.RecordBatch:
    """Rows of ``id, part, start, run, v, s``: the earliest of equal ``v, s`` stay, later ones are known to repeat."""
    ids, part, start, run, v, s = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((start, part, ids, s, v))
    ids, part, start, run, v, s = (x[order] for x in (ids, part, start, run, v, s))
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    later = ids > ids[first]
    if not unit.across:
        later |= (part != part[first]) | (start != start[first])
    deal = np.where(later, ids * 31 + start, v.view(np.int64))
    twin = np.zeros(len(v), bool)
    heads = np.flatnonzero(new)
    if len(heads):
        twin[heads] = np.logical_or.reduceat(later, heads)
    return pa.RecordBatch.from_arrays(
        [pa.array(deal), pa.array(v.view(np.int64), mask=later), pa.array(s.view(np.int64), mask=later),
         pa.array(v.view(np.int64)), pa.array(ids), pa.array(part), pa.array(start.astype(np.int32)),
         pa.array(run.astype(np.int32)), pa.array(twin)],
        ["deal", "v", "s", "anchor", "id", "part", "start", "run", "twin"])


def _segment_rows(unit: Unit):
    """Segments to deal out by anchor (``v`` set), and those known to repeat (``v`` null, ``anchor`` set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            part = batch.column(1).to_numpy(zero_copy_only=False)
            _, bounds = buffers(batch.column(2))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + COMBINE, "right")) - 1)
                text, start, n, v, s = segments(*units_of(batch.column(2).slice(a, b - a), unit), unit)
                held.append((ids[a:b][text], part[a:b][text], start, n, v, s))
                size += int(bounds[b] - bounds[a])
                a = b
                if size >= COMBINE:
                    yield _collapsed(held, unit)
                    held, size = [], 0
        if held:
            yield _collapsed(held, unit)

    return run


def _sift(unit: Unit):
    """Streams segments sorted by ``v, s, id, part, start``: gives those that repeat an equal
    one (``v`` null), and all different ones of an anchor that has several. Across texts, the
    first of equal ones is given once more (``twin``), as what its copies are located by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that the next batch goes on from
        head = None  # the first row of the current (v, s)
        waiting = None  # the only segment so far of the current v
        marked = False  # the current head is known to have copies
        for batch in batches:
            done, batch = batch.filter(batch.column("v").is_null()), batch.filter(batch.column("v").is_valid())
            if done.num_rows:
                yield done.select(["v", "anchor", "id", "part", "start", "run", "twin"])
            if not batch.num_rows:
                continue
            v, s, ids, part, start, n = (batch.column(x).to_numpy() for x in ("v", "s", "id", "part", "start", "run"))
            count = len(v)
            new = np.ones(count, bool)
            new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
            if last is not None:
                new[0] = (v[0], s[0]) != last
            first = np.maximum.accumulate(np.where(new, np.arange(count), -1))
            of = [np.where(first >= 0, x[first], h) for x, h in zip((ids, part, start), head or (0, 0, 0))]
            same = (ids == of[0]) & (part == of[1]) & (start == of[2])
            later = ids > of[0] if unit.across else ~same
            # Different segments, and (across texts) equal ones of one text, stand for themselves.
            kept = np.flatnonzero(new | (~later & ~same))
            rows = np.stack([x[kept].astype(np.int64) for x in (v, ids, part, start, n)])
            if waiting is not None:
                rows = np.concatenate([waiting[1], rows], 1)
            alone_before = waiting is not None and waiting[0]
            if rows.shape[1]:
                linked = np.zeros(rows.shape[1], bool)
                equal = rows[0, 1:] == rows[0, :-1]
                linked[1:] |= equal
                linked[:-1] |= equal
                if waiting is not None and not alone_before:
                    linked[0] = False  # it was given already and only shows that its v has several
                    same_v = rows[0] == rows[0, 0]
                    linked[1:] |= same_v[1:]
                final = rows[:, -1:]
                given = bool(linked[-1]) or (rows.shape[1] == 1 and waiting is not None and not alone_before)
                if not given:
                    linked[-1] = False
                waiting = (not given, final)
                out = rows[:, linked]
            else:
                out = rows
            gone = np.stack([x[later & ~new].astype(np.int64) for x in (v, ids, part, start, n)])
            of_group = np.cumsum(new)  # 0: the group that the batch before ended in
            copied = np.bincount(of_group, later | batch.column("twin").to_numpy(zero_copy_only=False)) > 0
            marks = out[:, :0]
            if unit.across:
                tell = copied.copy()
                tell[0] &= not marked
                begins = np.flatnonzero(np.diff(of_group, prepend=-1))
                begins = begins[tell[of_group[begins]]]
                marks = np.stack([v[begins], *[x[begins] for x in of], n[begins]]).astype(np.int64)
            marked = bool(copied[-1]) or (len(copied) == 1 and marked)
            both = np.concatenate([out, marks, gone], 1)
            place = np.arange(both.shape[1])
            null = place >= out.shape[1] + marks.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[0], mask=null), pa.array(both[0]), pa.array(both[1]), pa.array(both[2]),
                 pa.array(both[3].astype(np.int32)), pa.array(both[4].astype(np.int32)),
                 pa.array((place >= out.shape[1]) & ~null)],
                ["v", "anchor", "id", "part", "start", "run", "twin"])
            last = (v[-1], s[-1])
            if first[-1] >= 0:
                head = tuple(int(x[first[-1]]) for x in (ids, part, start))

    return run


def _string_rows(unit: Unit):
    """The strings of wide groups' segments as rows like ``_segment_rows``, ``v, s`` being the string's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = Rolling(13), Rolling(14)
        held, size = [], 0
        for batch in batches:
            data, bounds = buffers(batch.column("text"))
            ids, part = (batch.column(x).to_numpy() for x in ("id", "part"))
            wanted = batch.column("wanted")
            at = wanted.offsets.to_numpy()
            start, n, wide, chosen, twin = (
                wanted.values.field(k).to_numpy(zero_copy_only=False) for k in range(3, len(WANTED)))
            wide = wide & chosen & ~twin
            for a, b in portions(bounds):
                owner = np.repeat(np.arange(a, b), np.diff(at[a: b + 1]))
                which = np.flatnonzero(wide[at[a]: at[b]])
                if not len(which):
                    continue
                owner, which = owner[which], which + at[a]
                values, first = (data[bounds[a]: bounds[b]],) * 2, bounds[a: b + 1] - bounds[a]
                if unit.words:  # words are hashed twice as well
                    both = [Words(values[0], first, NOT_SPACE, AS_IS, seed) for seed in (1, 2)]
                    values, first = [w.hashes for w in both], both[0].first
                most = max(1, PIECE // (3 * unit.span))
                for k in range(0, len(which), most):
                    of, seg = owner[k: k + most], which[k: k + most]
                    run, begin = n[seg].astype(np.int64), start[seg].astype(np.int64)
                    long = run + unit.span - 1
                    offset = np.cumsum(long) - long
                    units = np.arange(long.sum()) + np.repeat(first[of - a] + begin - offset, long)
                    step = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
                    place = np.repeat(offset, run) + step
                    hashes = []
                    for roll, x in zip(rolls, values):
                        sums = roll.prefix(x[units] if unit.words else roll.table[x[units]])
                        hashes.append(roll.runs(sums, place, place + unit.span))
                    held.append((np.repeat(ids[of], run), np.repeat(part[of], run), np.repeat(begin, run) + step,
                                 np.ones(len(step), np.int64), *hashes))
                    size += 48 * len(step)
                    if size >= COMBINE:
                        yield _collapsed(held, unit)
                        held, size = [], 0
        if held:
            yield _collapsed(held, unit)

    return run


WANTED = ("anchor", "shard", "salt", "start", "run", "wide", "compared", "twin")
CUT = "shard bigint, salt int, id bigint, part bigint, start int, run int, twin boolean, seg binary"


def _cut_out(unit: Unit, compared: bool):
    """The text of segments, of those to compare alone or of all, without those of wide groups.

    A segment asked for twice, once as the first of equal ones, is given once, as that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column("text"))
            wanted = batch.column("wanted")
            at = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
            _, shard, salt, start, n, wide, chosen, twin = (
                x.to_numpy(zero_copy_only=False) for x in wanted.flatten().flatten())
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            which = np.flatnonzero(~wide & (chosen if compared else ~twin))
            which = which[np.lexsort((~twin[which], start[which], owner[which]))]
            new = np.ones(len(which), bool)
            new[1:] = (owner[which[1:]] != owner[which[:-1]]) | (start[which[1:]] != start[which[:-1]])
            which = which[new]
            for a, b in portions(bounds):
                mine = which[np.searchsorted(owner[which], a): np.searchsorted(owner[which], b)]
                text, first = data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a]
                low = start[mine].astype(np.int64)
                high = low + n[mine] - 1 + unit.span
                if unit.words:
                    found = Words(text, first, NOT_SPACE, AS_IS)
                    first = found.first[owner[mine] - a]
                    low, high = found.starts[first + low], found.ends[first + high - 1]
                else:
                    low, high = low + first[owner[mine] - a], high + first[owner[mine] - a]
                raw = text.tobytes()
                for k in range(0, len(mine), 20_000):
                    i = mine[k: k + 20_000]
                    segs = [raw[x:y] for x, y in zip(low[k: k + 20_000].tolist(), high[k: k + 20_000].tolist())]
                    of = pa.array(owner[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard[i], pa.int64()), pa.array(salt[i], pa.int32()), batch.column("id").take(of),
                         batch.column("part").take(of), pa.array(start[i], pa.int32()), pa.array(n[i], pa.int32()),
                         pa.array(twin[i]), pa.array(segs, pa.binary())],
                        ["shard", "salt", "id", "part", "start", "run", "twin", "seg"])

    return run


def runs_of(ids, part, start) -> pa.Table:
    """Single string starts as runs of consecutive ones."""
    order = np.lexsort((start, part, ids))
    ids, part, start = (np.asarray(x, np.int64)[order] for x in (ids, part, start))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return pa.table({"id": ids[first], "part": part[first], "start": pa.array(start[first], pa.int32()),
                     "run": pa.array(np.diff(np.append(first, len(ids))), pa.int32())})


RUNS = "id bigint, part bigint, start int, run int"
#: What ``confirm`` gives: passages of a shard and, for each of their strings, the least id that holds it.
PASSAGE = "shard bigint, passage binary, least binary"


def repeated_spans(
    transcripts: DataFrame, unit: Unit, name: str, compare: Callable[[pa.Table], pa.Table],
    locate: Callable[[pa.Table, pa.Table], pa.Table] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Texts as ``id, part, text``, and per text the starts of its repeated strings.

    Without ``locate``, ``compare`` gets the different segments of a shard (``id,
    part, start, run, twin, seg``) and gives the starts (``id, part, start,
    run``) of strings that repeat an earlier one; equal segments are told by
    their hash. With ``locate`` (only across texts), ``compare`` gives the
    passages of a shard instead, and ``locate`` gets them and any part of the
    segments with the shard's anchors, every equal one among them, and gives the
    starts. A shard with many segments is dealt to several tasks, each with
    the same passages. ``part`` is 0, or a hash of the text where an id is used more
    than once: rows with equal id and text count as one text given twice.
    """
    texts = keyed(transcripts)
    twice = settle(texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("twice")), name)
    # Settled, so that the planner knows its size: it is empty unless ids repeat.
    texts = texts.join(twice, "id", "left").select(
        "id", F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0)).cast("bigint").alias("part"), "text")
    spark = transcripts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("id", "part", "text").mapInArrow(_segment_rows(unit), SEGMENT)
    sifted = settle(
        dealt.repartition(parts, "deal").sortWithinPartitions("v", "s", "id", "part", "start")
        .mapInArrow(_sift(unit), SIFTED), name)
    different = F.col("v").isNotNull() & ~F.col("twin")
    held = F.count_if(~F.col("twin"))
    busy = settle(
        sifted.groupBy("anchor").agg(F.count_if(different).alias("different"), held.alias("held"))
        .where((F.col("different") > WIDE) | (F.col("held") > PART))
        .select("anchor", (F.col("different") > WIDE).alias("wide"), F.ceil(F.col("held") / PART).cast("int").alias("salts")), name)
    rows = sifted if locate else sifted.where(F.col("v").isNotNull())
    rows = rows.join(busy, "anchor", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    length = F.when(F.col("wide") | F.col("v").isNull(), 0).otherwise(F.col("run") + unit.span)
    total, count = rows.agg(F.sum(length.cast("bigint")), F.count(F.lit(1))).first()
    shards = max(1, -(-(total or 0) * (6 if unit.words else 1) // SHARD))
    usual = max(1, -(-count // (shards * PART)))
    shard = F.pmod(F.col("anchor"), F.lit(shards)).cast("bigint")
    salts = F.greatest(F.lit(usual), F.coalesce("salts", F.lit(1)))
    wanted = rows.select(
        "id", "part", F.struct(
            "anchor", shard.alias("shard"), F.pmod(F.xxhash64("id", "part", "start"), salts).cast("int").alias("salt"),
            "start", "run", "wide", F.col("v").isNotNull().alias("compared"), "twin").alias("w"))
    per_text = wanted.groupBy("id", "part").agg(F.collect_list("w").alias("wanted"))
    # All joins below deal the texts out alike, so that exchange runs once.
    asked = texts.join(per_text, ["id", "part"]).select("id", "part", "text", "wanted")
    if not twice.isEmpty():
        asked = asked.dropDuplicates(["id", "part"])  # a repeated row would repeat itself
    segs = asked.mapInArrow(_cut_out(unit, True), CUT).groupBy("shard")
    if locate is None:
        by_hash = sifted.where(F.col("v").isNull()).select("id", "part", "start", "run")
        gone = by_hash.unionByName(segs.applyInArrow(compare, RUNS))
    else:
        most = busy.groupBy(shard.alias("shard")).agg(F.max("salts").alias("salts"))
        passages = segs.applyInArrow(compare, PASSAGE).join(most, "shard", "left").select(
            "shard", "passage", "least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        stream = asked.mapInArrow(_cut_out(unit, False), CUT)
        gone = passages.groupBy("shard", "salt").cogroup(stream.groupBy("shard", "salt")).applyInArrow(locate, RUNS)
    several = not busy.where("wide").isEmpty()
    if several:
        strings = asked.where(F.exists("wanted", lambda x: x["wide"])).mapInArrow(_string_rows(unit), SEGMENT)
        judged = strings.repartition(parts, "deal").sortWithinPartitions("v", "s", "id", "part", "start") \
            .mapInArrow(_sift(unit), SIFTED)
        gone = gone.unionByName(judged.where(F.col("v").isNull()).select("id", "part", "start", "run"))
    spans = gone.groupBy("id", "part").agg(F.collect_list(F.struct("start", "run")).alias("spans"))
    found = texts.join(spans, ["id", "part"], "left")
    if locate and several:
        # Strings of wide groups reach no passage; segments that repeat an equal one lie with their text already.
        known = per_text.select("id", "part", F.transform(
            F.filter("wanted", lambda x: x["wide"] & ~x["compared"]), lambda x: F.struct(x["start"], x["run"])).alias("known"))
        found = found.join(known.where(F.size("known") > 0), ["id", "part"], "left").withColumn(
            "spans", F.coalesce(F.concat("spans", "known"), "spans", "known"))
    return texts, found.select("id", "part", "text", "spans")


def covered(start: np.ndarray, run: np.ndarray, span: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a repeated string."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + run - 1 + span, -1)
    return np.cumsum(step)[:n] > 0
