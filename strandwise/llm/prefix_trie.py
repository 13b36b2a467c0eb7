"""The trie of all prefixes of conversations, with counts per node.

1. ``placed``: turns get their place in the conversation. Only digests and lengths move;
   rows are dealt by ranges of (conversation, turn), so that one conversation may lie in many.
2. ``prefixes``: each place's digest is mixed with its place, and the mixed values of all
   places up to it, joined by exclusive or, are the prefix's digest (two times 64 bits).
   That is summed within pieces of ``PIECE`` places, then over the pieces before.
3. ``screen``: a count-min sketch of the prefixes' digests, whose counters stop at two. It
   never counts too few, so an estimate of one proves a prefix that no other conversation
   has. Tasks send the cells that they touched, once each, by blocks of cells.
4. Rows of proven singletons below such a parent are finished where they are. All others
   are shuffled: grouped exactly by digest, joined to their group's smallest member, summed
   along each conversation from its end, and grouped again by node.

What a node's subtree holds is a sum over its members: a conversation brings what its own
path costs from there on, where it isn't the node's smallest member, and one leaf if it is
the smallest member of its last node and nothing goes on from there.

The sketch has two rows of at most ``MOST_CELLS`` cells (16 MB of bits each), whatever the
input; beyond that it lets more singletons through to the exact grouping, and the result
is the same. Groups of copies: a digest is counted before it is shuffled, keys that hold
more than a ten-thousandth of the rows are joined by broadcast (``join_counted``), and the
ids that end in one node are joined as texts of some thousand ids, range by range, before
one task streams them through SHA-256, which only runs in order.

Edge cases: rows without a conversation id belong to no conversation; a null turn comes
first; turns of one number stand in the order of the MD5 of role and text; a null role or
text is empty; conversations without turns are members of the root; other
columns are not read; an empty table gives an empty result. Prefixes are told apart by 128
bits: at n different prefixes two meet with a probability of n * n / 2 ** 129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, stage

PIECE = 4096
MOST_CELLS = 1 << 27
_BLOCK = 1 << 16
_SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_JOINED = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# ---------------------------------------------------------------- turns and prefixes


def placed(rows: DataFrame) -> DataFrame:
    """``conv_id, n`` (from 1), ``digest`` of role and text, ``bytes`` of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = stage(turns.select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    pieces = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("conv_id", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # one row per conversation and range: a conversation in many ranges is split over them
    return turns.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("start") + F.col("at") - F.col("low") + 1).alias("n"), "digest", "bytes")


def _xor_before(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Exclusive or of ``columns`` over a conversation's places up to each row, by pieces."""
    piece = F.floor((F.col("place") - 1) / PIECE)
    rows = rows.withColumn("piece", piece)
    upto = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"d{i}": F.expr(f"bit_xor({c})").over(upto) for i, c in enumerate(columns)})
    long = rows.where(F.col("length") > PIECE)
    sums = long.groupBy("conv_id", "piece").agg(*(F.expr(f"bit_xor({c})").alias(c) for c in columns))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "piece", *(F.expr(f"bit_xor({c})").over(before).alias(f"b{i}") for i, c in enumerate(columns)))
    joined = inside.join(starts, ["conv_id", "piece"], "left")
    return joined.withColumns({f"d{i}": F.col(f"d{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in range(len(columns))}).drop(*(f"b{i}" for i in range(len(columns))))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, place, length, bytes``, the prefix's digest ``d0, d1``, that of the prefix
    before, ``p0``, and that of the conversation's first turn, ``g0`` (null where a long
    conversation's piece does not hold it). Rows: ``conv_id, place, length, digest, bytes``."""
    mixed = {"m0": F.xxhash64("digest", "place"), "m1": F.xxhash64(F.lit(7), "place", "digest")}
    rows = _xor_before(rebuilt.withColumns(mixed), ["m0", "m1"])
    piece = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("piece") == 0, F.first("d0").over(piece))
    return rows.select("conv_id", "place", "length", "bytes", "d0", "d1", F.col("d0").bitwiseXOR(F.col("m0")).alias("p0"), first.alias("g0"))


# ---------------------------------------------------------------- the screen


def _cells(digests: np.ndarray, row: int, cells: int) -> np.ndarray:
    shift = np.uint64(64 - (cells.bit_length() - 1))
    with np.errstate(over="ignore"):
        x = (digests.view(np.uint64) ^ (digests.view(np.uint64) >> np.uint64(29))) * np.uint64(_SEEDS[row])
        return ((x ^ (x >> np.uint64(32))) * np.uint64(_SEEDS[1 - row])) >> shift


def _touched(cells: int):
    """Per task and sketch row: the cells touched once and twice or more, by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches]
        every = np.concatenate(held) if held else np.zeros(0, np.int64)
        for row in range(2):
            found, counts = np.unique(_cells(every, row, cells), return_counts=True)
            block = (found // _BLOCK).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block)) + 1
            place = (found % _BLOCK).astype(np.uint16)
            many = counts > 1
            for a, b in zip([0, *cuts], [*cuts, len(found)]):
                if b > a:
                    yield pa.RecordBatch.from_pydict({"row": [row], "block": [int(block[a])], "once": [place[a:b][~many[a:b]].tobytes()], "often": [place[a:b][many[a:b]].tobytes()]})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by row and block in: per block the bits of the cells that count two or more."""
    key, once, often = None, None, None

    def out():
        return pa.RecordBatch.from_pydict({"row": [key[0]], "block": [key[1]], "bits": [np.packbits(often, bitorder="little").tobytes()]})

    for batch in batches:
        for row, block, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if (row, block) != key:
                if key is not None:
                    yield out()
                key, once, often = (row, block), np.zeros(_BLOCK, bool), np.zeros(_BLOCK, bool)
            a, b = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
            often[b] = True
            often[a] |= once[a]
            once[a] = True
            once[b] = True
    if key is not None:
        yield out()


def screen(digests: DataFrame, total: int, most: int = MOST_CELLS) -> tuple[np.ndarray, int]:
    """Bits of the cells that count two or more, a row of the sketch each, and the cells of
    a row: four to eight times the prefixes, up to ``most``."""
    cells = min(most, max(_BLOCK, 1 << (4 * max(1, total)).bit_length()))
    sent = digests.mapInArrow(_touched(cells), "row long, block long, once binary, often binary")
    sent = sent.repartition("row", "block").sortWithinPartitions("row", "block")
    out = np.zeros((2, max(cells, _BLOCK) // 8), np.uint8)
    for r in sent.mapInArrow(_merged, "row long, block long, bits binary").toLocalIterator():
        out[r["row"], r["block"] * (_BLOCK // 8) : (r["block"] + 1) * (_BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out, cells


def _estimates(bits, cells: int):
    """Adds whether the sketch leaves it open that a prefix, the one before it, or the
    conversation's first is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value

        def open_(digests: np.ndarray) -> np.ndarray:
            out = np.ones(len(digests), bool)
            for row in range(2):
                at = _cells(digests, row, cells)
                out &= (table[row][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return out

        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            place = column("place").to_numpy()
            g0 = column("g0")
            # below a proven singleton all are singletons
            first = g0.is_null().to_numpy(zero_copy_only=False) | open_(g0.fill_null(0).to_numpy())
            shared = first & open_(column("d0").to_numpy())
            above = first & (place > 1) & open_(column("p0").to_numpy())
            last = first & (place == column("length").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared), pa.array(above), pa.array(last)], [*batch.schema.names, "shared", "above", "last"])

    return run


# ---------------------------------------------------------------- ids that end in a node


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by node and id in: the ids of a node as comma-joined texts."""

    def made():
        key, ids, first = None, [], None
        for batch in batches:
            for lead, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (lead, depth) != key or len(ids) >= _JOINED:
                    if ids:
                        yield *key, first, ",".join(ids)
                    key, ids, first = (lead, depth), [], conv
                ids.append(str(conv))
        if ids:
            yield *key, first, ",".join(ids)

    yield from _columns(made(), [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["lead", "depth", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        key, digest = None, None
        for batch in batches:
            for lead, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (lead, depth) != key:
                    if key is not None:
                        yield *key, digest.hexdigest()
                    key, digest = (lead, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
        if key is not None:
            yield *key, digest.hexdigest()

    yield from _columns(made(), [pa.int64(), pa.int64(), pa.string()], ["lead", "depth", "ends"])


def _columns(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], most: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``lead, depth, ends``: SHA-256 of the ids that end in a node. Rows: lead, depth, conv_id."""
    dealt = ends.select("lead", "depth", "conv_id").repartitionByRange("lead", "depth", "conv_id").sortWithinPartitions("lead", "depth", "conv_id")
    texts = dealt.mapInArrow(_joined_ids, "lead long, depth long, first long, ids string")
    return texts.repartition("lead", "depth").sortWithinPartitions("lead", "depth", "first").mapInArrow(_hashed_ids, "lead long, depth long, ends string")


# ---------------------------------------------------------------- the trie


def _own_end() -> Column:
    return F.when(F.col("place") == F.col("length"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY))


def _along(rows: DataFrame) -> DataFrame:
    """Adds what a conversation's path holds from a row on: ``saved`` and ``leaves``; the
    smallest member of the node above, ``up``; and whether the node below is its own,
    ``child``. By pieces, then over the pieces."""
    rows = rows.withColumn("piece", F.floor((F.col("place") - 1) / PIECE))
    whole = Window.partitionBy("conv_id", "piece").orderBy("place")
    rest = whole.rowsBetween(0, Window.unboundedFollowing)
    own = (F.col("lead") == F.col("conv_id")).cast("long")
    near = lambda c, at: F.when(at("place").over(whole) == F.col("place") + (1 if at is F.lead else -1), at(c).over(whole))
    out = rows.withColumns({"own": own}).withColumns({"saved": F.sum("weight").over(rest), "leaves": F.sum("leaf").over(rest), "up": near("lead", F.lag), "child": near("own", F.lead)})
    long = rows.where(F.col("length") > PIECE)
    sums = long.groupBy("conv_id", "piece").agg(
        F.sum("weight").alias("w"), F.sum("leaf").alias("l"),
        F.min(F.struct("place", "lead")).alias("head"), F.max(F.struct("place", "lead")).alias("tail"),
    )
    after = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    beside = Window.partitionBy("conv_id").orderBy("piece")
    joins = sums.select("conv_id", "piece", F.sum("w").over(after).alias("more_w"), F.sum("l").over(after).alias("more_l"), F.lag("tail").over(beside).alias("prior"), F.lead("head").over(beside).alias("following"))
    out = out.join(joins, ["conv_id", "piece"], "left")
    up = F.when(F.col("prior.place") == F.col("place") - 1, F.col("prior.lead"))
    child = F.when(F.col("following.place") == F.col("place") + 1, (F.col("following.lead") == F.col("conv_id")).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.withColumns({
        "saved": F.col("saved") + zero("more_w"), "leaves": F.col("leaves") + zero("more_l"),
        # a row that is not here was a proven singleton: its node is the conversation's own
        "up": F.coalesce("up", up, "conv_id"), "child": zero(F.coalesce("child", child)),
    })


def prefix_trie(rebuilt: DataFrame, convs: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """One row per node. ``rebuilt``: ``conv_id, place`` (from 1), ``length, digest, bytes``;
    ``convs``: every ``conv_id`` with its ``length``, also of conversations without turns."""
    convs = stage(convs.select("conv_id", "length"), "convs")
    rows = stage(prefixes(rebuilt), "prefixes")
    total = rows.count()
    root_id, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not n_convs:
        return convs.select(*(F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in COLUMNS))
    spark = rows.sparkSession
    bits, cells = screen(rows.select("d0"), total, most)
    bits = spark.sparkContext.broadcast(bits)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = stage(rows.mapInArrow(_estimates(bits, cells), f"{kinds}, shared boolean, above boolean, last boolean"), "screened")

    alone = rows.where("not shared and not above").select(
        "conv_id", F.col("place").alias("depth"), F.when(F.col("place") == 1, F.lit(root_id)).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (F.col("place") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), _own_end().alias("ends_sha256"),
    )

    open_ = rows.where("shared")
    ends_here = (F.col("place") == F.col("length")).cast("long")
    key = ["place", "d0", "d1"]
    groups = stage(open_.groupBy(*key).agg(F.min("conv_id").alias("lead"), F.count("*").alias("n"), F.sum(ends_here).alias("ended")), "groups")
    known = join_counted(open_, groups, key, "n", total).select("conv_id", "place", "length", "bytes", "lead", "n", "ended")
    edge = rows.where("not shared and (above or last)")
    edge = edge.select("conv_id", "place", "length", "bytes", F.col("conv_id").alias("lead"), F.lit(1).cast("long").alias("n"), ends_here.alias("ended"))
    path = known.withColumn("seen", F.lit(True)).unionByName(edge.withColumn("seen", F.lit(False)))
    weight = F.when(F.col("lead") == F.col("conv_id"), 0).otherwise(F.col("bytes"))
    leaf = ((F.col("lead") == F.col("conv_id")) & (F.col("place") == F.col("length")) & (F.col("ended") == F.col("n"))).cast("long")
    path = stage(_along(path.withColumns({"weight": weight.cast("long"), "leaf": leaf})), "paths")

    seen = path.where("seen").withColumns({"own_up": F.when(F.col("lead") == F.col("conv_id"), F.col("up"))})
    nodes = seen.groupBy("lead", "place").agg(F.max("own_up").alias("up"), F.max("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = ends_digests(seen.where("place = length").select("lead", F.col("place").alias("depth"), "conv_id"))
    nodes = nodes.join(ends.withColumnRenamed("depth", "place"), ["lead", "place"], "left").select(
        F.col("lead").alias("conv_id"), F.col("place").alias("depth"), F.when(F.col("place") == 1, F.lit(root_id)).otherwise(F.col("up")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    # below a shared node: alone, under the node that the path gives
    below = path.where("not seen and up is not null").join(rows.where("not shared and above").select("conv_id", "place"), ["conv_id", "place"], "left_semi")
    below = below.select(
        "conv_id", F.col("place").alias("depth"), F.col("up").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("place") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), _own_end().alias("ends_sha256"),
    )
    out = stage(alone.select(*COLUMNS).unionByName(nodes.select(*COLUMNS)).unionByName(below.select(*COLUMNS)), "nodes")

    at_root = ends_digests(convs.where("length = 0").select(F.lit(root_id).alias("lead"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    zero = F.lit(0).cast("long")
    parts = out.where("depth = 1").select(F.lit(1).cast("long").alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
    parts = parts.unionByName(at_root.select(zero.alias("child"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends"))
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0))
    root = parts.agg(summed("child").alias("n_children"), F.greatest(summed("n_leaves"), F.lit(1)).alias("n_leaves"), summed("saved_tokens").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(_EMPTY)).alias("ends_sha256")).select(
        F.lit(root_id).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).alias("n_convs"), "*",
    )
    return out.unionByName(root.select(*COLUMNS))
