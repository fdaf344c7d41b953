"""The trie of conversations: which transcripts begin with the same samples.

Transcripts are cut into blocks of a fixed number of samples. They are grouped by
the digests of their successive blocks first: whoever shares the blocks so far and
the digest of the next one shares every sample in it, and none of these needs a
look. Only in blocks where transcripts that came the same way part do prefixes
of single samples get digests of their own.

Nothing walks the trie. What a node sums over its subtree is a sum over its
members: each member adds what lies below on its own path, and of a shared node only its
smallest member counts the node itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribble.llm.shared import NULL_ID, id_or_null, settle
from cribble.operators.ranking import number_rows

BLOCK = 4
#: Samples of one transcript that a window takes in; longer ones are carried over from chunk to chunk.
CHUNK = 4_096
#: Keys of more rows than one in so many are joined by broadcast; there are fewer of them than this.
HOT_KEYS = 1_000


class PrefixTrie(NamedTuple):
    """``nodes``: one row per node. ``ends``: ``depth, node, id`` of each transcript's last node."""

    nodes: DataFrame
    ends: DataFrame


def join_counted(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """Join with a table of one row per key, in which ``count`` tells how many rows have it.

    Hot keys, below ``HOT_KEYS`` by the count, are broadcast; no other key brings more than that
    share of the rows to one task. Both sides are read twice: give settled tables.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_KEYS > total
    marked = rows.join(F.broadcast(table.where(hot)), keys, "left")
    rest = marked.where(F.col(count).isNull()).select(*rows.columns)
    return marked.where(F.col(count).isNotNull()).unionByName(rest.join(table.where(~hot), keys, how))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, a row's place (from 0) among those of its ``id`` in the given order, and their number ``m``.

    Rows are numbered by ranges, so that one id may hold any share of them.
    """
    numbered = number_rows(rows, ["id", *order], "_n")
    of_id = settle(numbered.groupBy("id").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("m")), "starts")
    return join_counted(numbered, of_id, ["id"], "m").withColumn("pos", F.col("_n") - F.col("_first")).drop("_n", "_first")


def _chain(turns: Column) -> Column:
    return F.md5(F.array_join(F.transform(turns, lambda t: t["digest"]), ""))


def _block_prefixes(turns: DataFrame) -> DataFrame:
    """One row per transcript and block: its digest, and two hashes of the blocks before it.

    The hash of a sequence of blocks is the exclusive or of hashes of (place, digest), so that
    chunks of a long transcript can be hashed apart and put together.
    """
    blocks = turns.withColumns({
        "block": F.floor(F.col("pos") / BLOCK), "chunk": F.floor(F.col("pos") / CHUNK),
    }).repartition("id", "chunk").groupBy("id", "chunk", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns"), F.max("m").alias("m"),
    ).withColumn("digest", _chain(F.col("turns")))
    one, two = F.xxhash64("block", "digest"), F.xxhash64("digest", "block")
    before = Window.partitionBy("id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = settle(blocks.withColumns({
        "h1": one, "h2": two,
        "p1": F.coalesce(F.bit_xor(one).over(before), F.lit(0)), "p2": F.coalesce(F.bit_xor(two).over(before), F.lit(0)),
    }), "blocks")
    long_ones = local.where(F.col("m") > CHUNK)
    earlier = Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = long_ones.groupBy("id", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2")).select(
        "id", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")])
    joined = long_ones.join(carried, ["id", "chunk"]).withColumns({
        "p1": F.col("p1").bitwiseXOR(F.col("c1")), "p2": F.col("p2").bitwiseXOR(F.col("c2"))})
    return local.where(F.col("m") <= CHUNK).drop("h1", "h2").unionByName(joined.drop("h1", "h2", "c1", "c2"))


def _shared_nodes(blocks: DataFrame) -> DataFrame:
    """``id, m, depth, chars, node, n, n_ends``: each sample with its node's smallest member, members and ends."""
    at = ["block", "p1", "p2"]
    last = F.col("block") == F.floor((F.col("m") - 1) / BLOCK)
    # Transcripts that share all blocks before this one and go on; those alone need no row.
    groups = settle(blocks.groupBy(*at).agg(
        F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"),
        F.min("id").alias("node"), F.count_if(last).alias("n_last"),
    ).where("n > 1"), "groups")
    parting = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    samples = F.transform("turns", lambda t, i: F.struct(
        (t["pos"] + 1).alias("depth"), t["chars"].alias("chars"), (i + 1 == F.size("turns")).alias("closes"),
        F.when(parting, _chain(F.slice("turns", F.lit(1), i + 1))).alias("prefix")))
    rows = settle(join_counted(blocks, groups, at, "n", "left").select(
        "id", "m", "p1", "p2", "n", "node", "n_last", F.explode(samples).alias("s"),
    ).select("id", "m", "p1", "p2", "n", "node", "n_last", "s.*").withColumn("ends", F.col("depth") == F.col("m")), "samples")

    together = rows.where(F.col("prefix").isNull()).select(
        "id", "m", "depth", "chars", F.coalesce("node", "id").alias("node"), F.coalesce("n", F.lit(1)).alias("n"),
        F.when(F.col("closes"), F.coalesce("n_last", F.col("ends").cast("bigint"))).otherwise(F.lit(0)).alias("n_ends"))
    apart, key = rows.where(F.col("prefix").isNotNull()).drop("n", "node", "n_last"), ["depth", "p1", "p2", "prefix"]
    nodes = settle(apart.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("node"), F.count_if("ends").alias("n_ends")), "prefixes")
    return together.unionByName(join_counted(apart, nodes, key, "n").select(*together.columns))


def _below(samples: DataFrame) -> DataFrame:
    """Add what a transcript's own path holds from each sample on: ``saved, leaves, child, parent``."""
    own = F.col("node") == F.col("id")
    rows = samples.withColumns({
        "chunk": F.floor((F.col("depth") - 1) / CHUNK), "own": own.cast("bigint"),
        "spare": F.when(own, F.lit(0)).otherwise(F.col("chars")),
        "leaf": (own & (F.col("depth") == F.col("m")) & (F.col("n_ends") == F.col("n"))).cast("bigint")})
    upwards = Window.partitionBy("id", "chunk").orderBy(F.desc("depth"))
    so_far = upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({
        "saved": F.sum("spare").over(so_far), "leaves": F.sum("leaf").over(so_far),
        "child": F.lag("own").over(upwards), "parent": F.lead("node").over(upwards)})
    by_id = Window.partitionBy("id").orderBy(F.desc("chunk"))
    later = by_id.rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.where(F.col("m") > CHUNK).groupBy("id", "chunk").agg(
        F.sum("spare").alias("s"), F.sum("leaf").alias("l"), F.min_by("own", "depth").alias("o"), F.max_by("node", "depth").alias("d"),
    ).select("id", "chunk", F.sum("s").over(later).alias("later_saved"), F.sum("l").over(later).alias("later_leaves"),
             F.lag("o").over(by_id).alias("next_own"), F.lead("d").over(by_id).alias("last_node"))
    whole = local.where(F.col("m") > CHUNK).join(carried, ["id", "chunk"]).withColumns({
        "saved": F.col("saved") + F.coalesce("later_saved", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("later_leaves", F.lit(0)),
        "child": F.coalesce("child", "next_own"), "parent": F.coalesce("parent", "last_node")})
    return local.where(F.col("m") <= CHUNK).unionByName(whole.select(*local.columns))


def prefix_trie(samples: DataFrame, transcripts: DataFrame | None = None) -> PrefixTrie:
    """Every distinct beginning of the transcripts' sample sequences, with who shares it.

    ``samples``: ``id, sample_idx, language, text``, as ``flatten_samples`` gives them (of a
    chat, ``language`` is the speaker's role); a transcript's samples are taken in the order of
    ``sample_idx``, null first, ties by a digest of the sample. Two samples are equal when
    language and text are; null counts as empty. ``transcripts``: ``id`` of further transcripts,
    which may have no sample. Other columns are ignored; sequences are compared by 128 bits of digest.

    ``nodes``: ``id`` (the smallest member, which with ``depth`` names the node), ``depth``,
    ``parent_id`` (null for the root, depth 0), ``n_transcripts`` (members: transcripts
    beginning so), ``n_children``, ``n_leaves`` (childless nodes in the subtree, itself
    included) and ``saved_chars`` (over the subtree, ``n_transcripts - 1`` times the code points of
    each node's last text). ``ends``: one row per transcript, the ``depth`` and id (``node``) of the node it ends at.

    Samples with a null id form one transcript, the smallest, whose id is given back as null.
    Repeated samples stand side by side. Without any transcript there is no node.
    """
    language, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("language", "text"))
    known = F.coalesce(F.col("id").cast("bigint"), F.lit(NULL_ID)).alias("id")
    slim = samples.select(known, "sample_idx", F.md5(F.concat(F.length(language).cast("string"), F.lit(":"), language, text)).alias("digest"),
                          F.length(text).cast("bigint").alias("chars"))
    turns = placed(slim, ["sample_idx", "digest"])
    found = settle(_shared_nodes(_block_prefixes(turns)), "turns")
    ids = found.where("depth = 1").select("id", F.lit(True).alias("spoken"))
    if transcripts is not None:
        ids = ids.unionByName(transcripts.select(known, F.lit(False).alias("spoken")))
    ids = settle(ids.groupBy("id").agg(F.max("spoken").alias("spoken")), "transcripts")
    path = settle(_below(found), "paths")

    members = ids.agg(F.count(F.lit(1)).alias("n_transcripts"), F.min("id").alias("id")).first()
    top = members["id"]
    schema = "id bigint, depth bigint, parent_id bigint, n_transcripts bigint, n_children bigint, n_leaves bigint, saved_chars bigint"
    total = path.where("depth = 1").agg(
        F.coalesce(F.sum("own"), F.lit(0)), F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)), F.coalesce(F.sum("saved"), F.lit(0))).first()
    root = samples.sparkSession.createDataFrame(
        [(top, 0, None, members["n_transcripts"], *total)] if members["n_transcripts"] else [], schema)
    node = path.select(
        F.col("node").alias("id"), "depth", F.when(F.col("own") == 1, F.coalesce("parent", F.lit(top))).alias("parent_id"),
        F.col("n").alias("n_transcripts"), F.coalesce("child", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_chars"))
    shared = node.where("n_transcripts > 1").groupBy("id", "depth").agg(
        F.max("parent_id").alias("parent_id"), F.max("n_transcripts").alias("n_transcripts"),
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_chars")])
    nodes = root.unionByName(node.where("n_transcripts = 1")).unionByName(shared)
    ends = found.where("depth = m").select("depth", "node", "id").unionByName(
        ids.where("NOT spoken").select(F.lit(0).cast("bigint").alias("depth"), F.lit(top).cast("bigint").alias("node"), "id"))
    return PrefixTrie(
        nodes.withColumns({"id": id_or_null("id"), "parent_id": id_or_null("parent_id")}),
        ends.withColumns({"node": id_or_null("node"), "id": id_or_null("id")}))


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, node, ends_sha256``: SHA-256 of the ids that end at a node, ascending, joined by commas.

    The hash of a list has to be taken in order, so the last step streams a node's list
    through one task; by then tasks that hold ranges of the ids have joined them to long strings. A null
    id is an empty string.
    """
    joined = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("text", pa.string())])
    hashed = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for depth, node, id_ in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "id"))):
                if not rows or rows[-1][:2] != (depth, node):
                    rows.append((depth, node, id_, []))
                rows[-1][3].append("" if id_ == NULL_ID else str(id_))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(joined.names, (*r[:3], ",".join(r[3])))) for r in rows], schema=joined)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for depth, node, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "text"))):
                if (depth, node) != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (depth, node), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(hashed.names, r)) for r in done], schema=hashed)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(hashed.names, (*key, sha.hexdigest())))], schema=hashed)

    order = ["depth", "node", "id"]
    filled = ends.withColumns({c: F.coalesce(c, F.lit(NULL_ID)) for c in ("node", "id")})
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strings = filled.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        runs, "depth bigint, node bigint, first bigint, text string")
    out = strings.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(
        hashes, "depth bigint, node bigint, ends_sha256 string")
    return out.withColumn("node", id_or_null("node"))
