"""Near duplicates by n-gram Jaccard: an exact T-occurrence search (DivideSkip).

A document's set is its distinct ``width``-word shingles (64-bit hashes of the words,
A-Z lower-cased). Two documents link when 100 * |intersection| >= ``percent`` * |union|.

1. ``classes``: documents with equal sets are one class; its representative is the
   smallest id. All later work is on representatives.
2. Pruning. Shingles are ordered by hash. With t the threshold, a link shares at least
   ceil(t * n) of the n shingles of either side, so of the n - ceil(t * n) + T smallest
   hashes of the side whose list ends first, at least T are on the other side's list too.
   Each representative lists that many (``probe_list``), the lists meet in one shuffle,
   and shingles on one list only are dropped. A representative with fewer than T shared
   shingles left has no link. Of the others, the rarest shared - T + 1 shingles suffice
   to bring every linked pair together (the T-occurrence form of prefix filtering), so
   passages that very many documents share bring nobody together.
3. Families: components over (smallest member, member) pairs per remaining shingle. A
   link never leaves a family, and no pairs are made inside one.
4. Each member is compared with its family's first member by a join. Those that link are
   settled: they are one component already. The rest, usually few, are queries.
5. ``divide_skip``: queries meet the other members of their family whose number of
   shingles lets them link, in blocks of bounded size: members are cut into bands of sizes
   by the ratio that a link allows, so a query meets three bands, and bands into parts.
   Sets go straight to their blocks: a bitmap stops those that no other set meets, and only
   the blocks cut into parts, few at any size, are looked up. In a block the inverted lists
   of the query's shingles are split into long and short; the short ones are merged,
   candidates that can still reach T are kept, the long ones are probed by binary search,
   and documents that reach the required overlap are returned, one link per component of
   the block.
6. Components over all links; every document gets the smallest id of its component.

Counts of common shingles go back to their rows by ``join_counted``; families are joined
to one row each, where adaptive execution splits what is large. No partner or candidate is capped. Heap or sort in ``merge_counts``
and how many lists are set aside are matters of speed; they do not change results.

Edge cases: a text of fewer words than ``width`` has its whole sequence as the only
shingle; a null text or one without words has an empty set, links with nothing and is its
own component; repeated rows with one id are one document; of rows with one id and
different texts, the one whose set has the smallest hash stands for the document and all
of them get its component; a null id gets a null component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, Hasher, discard, join_counted, list_array, mix, slices, stage, word_bounds
from .components import components

WIDTH = 5
PERCENT = 80
#: Shingles on each side of a block.
PART = 2_000_000
#: Size of the filters that tell which texts to fetch and which sets have a block (128 KB
#: to 8 MB). Beyond some millions of members they let most pass; what comes after them, a
#: join or an empty side of a block, decides in any case.
BITMAP_BITS = (1 << 20, 1 << 26)
#: With no more entries than this on the short lists as many lists as possible are set
#: aside; beyond, the number follows from the longest list.
MERGE_MOST = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a buffer."""
    data = LOWER_AZ[data]
    hasher = Hasher(data)
    starts, ends, firsts = word_bounds(data, offsets)
    words = hasher.ranges(starts, ends)
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams = mix(grams * _STEP + words[k : k + n])
    grams = grams.view(np.int64)
    for i in range(len(offsets) - 1):
        a, b = firsts[i], firsts[i + 1]
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(np.array([whole * _STEP + w]))[0]
            yield np.array([whole], np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def required(n: int, percent: int) -> int:
    """Shingles that any partner of a set of n shares at least."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    """T: how many listed shingles a link shares at least."""
    return max(1, n // 20)


def probe_length(n: int, percent: int) -> int:
    return min(n, n - required(n, percent) + slack(n))


def set_key(grams: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """A set as 128 bits: sums of two mixes of its members."""
    u = grams.view(np.uint64)
    return mix(u).sum(dtype=np.uint64), mix(u ^ _STEP).sum(dtype=np.uint64)


def _keys(pairs: list[tuple[np.uint64, np.uint64]]) -> list[pa.Array]:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _sketch(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for s in slices(batches):
                sizes, keys, lists = [], [], []
                for grams in shingle_sets(s.bytes, s.offsets, width):
                    sizes.append(len(grams))
                    keys.append(set_key(grams))
                    lists.append(grams[: probe_length(len(grams), percent)])
                listed = list_array(np.concatenate(lists), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([s.columns[0], pa.array(sizes, pa.int32()), *_keys(keys), listed], ["doc_id", "n", "k1", "k2", "probe"])

    return run


def _place(columns: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def bitmap_size(n: int) -> int:
    """Places for n keys: sixteen each, within ``BITMAP_BITS``."""
    least, most = BITMAP_BITS
    return min(most, max(least, 1 << (16 * max(n, 1) - 1).bit_length()))


def bitmap_of(keys: DataFrame, columns: Sequence[str], bits: int) -> np.ndarray:
    """Bits at the hashed places of keys: a filter of bounded size, however many keys there
    are. It may let others pass, never stop one of these."""
    n = _place(columns, bits) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passed(wanted: np.ndarray):
    """Rows whose ``place`` is set in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.schema.get_field_index("place")).to_numpy()
            yield batch.filter(pa.array((wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))

    return run


def _sets(width: int, wanted: np.ndarray):
    """Whole sets of the documents that pass the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for s in slices(_passed(wanted)(batches)):
                sets = list(shingle_sets(s.bytes, s.offsets, width))
                yield pa.RecordBatch.from_arrays([s.columns[0], *_keys([set_key(x) for x in sets]), list_array(np.concatenate(sets), [len(x) for x in sets])], ["cid", "k1", "k2", "grams"])

    return run


def candidate_families(reps: DataFrame, percent: int) -> DataFrame:
    """``node, component``: representatives that may link, by family (steps 2 and 3)."""
    listed = reps.select("cid", F.explode("probe").alias("gram"))
    counted = stage(listed.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "counted")
    total = counted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    shared = stage(join_counted(listed, counted, ["gram"], "df", total), "shared")
    discard(counted)
    # a partner of a set of n has at least ceil(t * n) shingles, so T is at least this
    least_partner = F.ceil(F.col("n") * percent / F.lit(100.0))
    t = F.greatest(F.lit(1), F.floor(least_partner / 20)).cast("int")
    per_doc = shared.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    per_doc = per_doc.join(reps.select("cid", "n"), "cid").withColumn("t", t)
    kept = per_doc.where(F.size("grams") >= F.col("t")).select("cid", F.explode(F.slice("grams", F.lit(1), F.size("grams") - F.col("t") + 1)).alias("g")).select("cid", "g.gram")
    kept = stage(kept, "kept")
    discard(shared)
    heads = kept.groupBy("gram").agg(F.min("cid").alias("head"), F.count("*").alias("members")).where("members > 1").drop("members")
    pairs = kept.join(heads, "gram").where("cid != head").select(F.col("cid").alias("a"), F.col("head").alias("b"))
    families = components(pairs)
    discard(kept)
    return families


class InvertedLists:
    """Sorted places of the documents that hold each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        grams = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, grams))
        grams, self.owner = grams[order], owner[order]
        self.grams, first = np.unique(grams, return_index=True)
        self.first = np.append(first, len(grams))

    def lists(self, grams: np.ndarray) -> list[np.ndarray]:
        if not len(self.grams):
            return []
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return [self.owner[self.first[i] : self.first[i + 1]] for i in at[self.grams[at] == grams]]


def merge_counts(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents on at least ``least`` of the lists, with the number of lists."""
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if sum(map(len, lists)) < 64:
        out: dict[int, int] = {}
        for doc in heapq.merge(*(x.tolist() for x in lists)):
            out[doc] = out.get(doc, 0) + 1
        docs, counts = np.array(list(out), np.int64), np.array(list(out.values()), np.int64)
    else:
        # a stable sort of sorted runs is their merge
        merged = np.sort(np.concatenate(lists), kind="stable")
        first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        docs, counts = merged[first], np.diff(np.append(first, len(merged)))
    enough = counts >= least
    return docs[enough], counts[enough]


def divide_skip(index: InvertedLists, grams: np.ndarray, percent: int) -> np.ndarray:
    """Places in the index whose sets link with ``grams``."""
    n = len(grams)
    t = required(n, percent)
    lists = sorted(index.lists(grams), key=len)
    if len(lists) < t:
        return np.zeros(0, np.int64)
    # any T - L of the short lists must hold a result when L lists are set aside
    most = len(lists[-1])
    aside = t - 1
    if sum(map(len, lists[: len(lists) - aside])) > MERGE_MOST:
        aside = min(t - 1, int(t / (0.02 * math.log2(most + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    docs, counts = merge_counts(short, t - aside)
    for i, places in enumerate(long):
        if not len(docs):
            break
        at = np.minimum(np.searchsorted(places, docs), len(places) - 1)
        counts = counts + (places[at] == docs)
        still = counts + (len(long) - i - 1) >= t
        docs, counts = docs[still], counts[still]
    return docs[100 * counts >= percent * (n + index.sizes[docs] - counts)]


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in column]


def _search(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids = left.column("cid").to_numpy()
        settled = left.column("settled").to_numpy()
        index = InvertedLists(_lists(left.column("grams")))
        # one link to each component of the block is enough
        parent = {int(i): int(i) for i in ids}
        hub = next((int(i) for i, s in zip(ids, settled, strict=True) if s), None)
        for i, s in zip(ids, settled, strict=True):
            if s:
                parent[int(i)] = hub

        def find(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for query, grams in zip(right.column("query").to_pylist(), _lists(right.column("asked")), strict=True):
            for place in divide_skip(index, grams, percent):
                other = int(ids[place])
                if other != query and (x := find(query)) != (y := find(other)):
                    parent[x] = y
                    a.append(query)
                    b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def settle(sets: DataFrame, percent: int) -> DataFrame:
    """``family, cid, size, settled, grams``: whether each member links with its family's first."""
    first = sets.where("cid = family").select("family", F.col("grams").alias("first_grams"))
    same = F.size(F.array_intersect("grams", "first_grams"))
    settled = 100 * same >= percent * (F.size("grams") + F.size("first_grams") - same)
    return sets.join(first, "family").select("family", "cid", F.size("grams").alias("size"), settled.alias("settled"), "grams")


def _bands(percent: int) -> tuple[Column, Column]:
    """Band of a set's size, and the array of bands that it may link with: sizes of
    linked sets differ by a factor of 100 / ``percent`` at most."""
    step = math.log(100 / percent) if percent < 100 else 1.0
    own = F.log(F.col("size").cast("double"))
    reach = step * (percent < 100) + 1e-9
    band = lambda x: F.floor(x / F.lit(step)).cast("int")
    return band(own), F.sequence(band(own - reach), band(own + reach))


def _own(n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def blocks_of(found_in: DataFrame, asking: DataFrame, part: int) -> DataFrame:
    """``family, band, parts, asks``: where a query meets another member, and into how many
    parts members and queries are cut there."""
    on = ["family", "band"]
    sums = found_in.groupBy(*on).agg(F.sum("size").alias("held"), F.count("*").alias("members"), F.max("settled").alias("any_settled"))
    asked = asking.groupBy(*on).agg(F.sum("size").alias("asked"), F.count("*").alias("askers"))
    # a member that is not settled asks in its own band
    alone = F.expr("members = 1 and askers = 1 and not any_settled")
    return sums.join(asked, on).where(~alone).select(*on, F.ceil(F.col("held") / part).cast("int").alias("parts"), F.ceil(F.col("asked") / part).cast("int").alias("asks"))


def links(docs: DataFrame, families: DataFrame, percent: int, width: int, part: int = PART) -> DataFrame:
    """``a, b``: enough links between representatives to connect all that are linked.
    ``families``: ``cid, k1, k2, family`` of the members, written."""
    n = families.count()
    bits = bitmap_size(n)
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", _place(["doc_id"], bits).alias("place"), "text")
    sets = texts.mapInArrow(_sets(width, bitmap_of(families, ["cid"], bits)), "cid long, k1 long, k2 long, grams array<long>")
    # one key for both, so that whole sets are shuffled once
    key = ["cid", "k1", "k2"]
    sets = stage(sets.dropDuplicates(key).join(families, key).drop("k1", "k2"), "sets")
    met = stage(settle(sets, percent), "met")
    discard(sets)
    direct = met.where("settled and cid != family").select(F.col("cid").alias("a"), F.col("family").alias("b"))

    own, reach = _bands(percent)
    # no query links with its family's first
    found_in = met.where("cid != family").withColumn("band", own)
    asking = met.where("not settled").withColumn("band", F.explode(reach))
    blocks = stage(blocks_of(found_in, asking, part), "blocks")
    on = ["family", "band"]
    bits = bitmap_size(blocks.count())
    passed = _passed(bitmap_of(blocks, on, bits))
    # each holds or asks more than a part, so there are few of them
    cut = F.broadcast(blocks.where("parts > 1 or asks > 1"))

    def dealt(rows: DataFrame) -> DataFrame:
        placed = rows.select(*on, "cid", "settled", "grams", _place(on, bits).alias("place"))
        kept = placed.mapInArrow(passed, placed.schema).drop("place")
        return kept.join(cut, on, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "asks")})

    block = ["family", "band", "part", "ask"]
    index = dealt(found_in).select(*on, _own("parts", 1).alias("part"), "asks", "cid", "settled", "grams").select(*on, "part", _every("asks").alias("ask"), "cid", "settled", "grams")
    queries = dealt(asking).select(*on, "parts", _own("asks", 2).alias("ask"), "cid", "grams").select(*on, _every("parts").alias("part"), "ask", "cid", "grams")
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in block), F.col("cid").alias("query"), F.col("grams").alias("asked"))
    found = index.groupBy(*block).cogroup(queries.groupBy(*(f"q_{c}" for c in block))).applyInArrow(_search(percent), "a long, b long")
    found = stage(direct.unionByName(found), "found")
    discard(met, blocks)
    return found


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, class_id`` (smallest id with the same
    set; null for an empty set) and ``component_id``."""
    texts = docs.select("doc_id", "text")
    sketch = stage(texts.mapInArrow(_sketch(width, percent), "doc_id long, n int, k1 long, k2 long, probe array<long>"), "sketch")
    known = sketch.where("n > 0 and doc_id is not null")
    # one set stands for each id
    standing = known.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("s")).select("doc_id", "s.k1", "s.k2")
    standing = stage(standing, "standing")
    classes = stage(standing.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = known.join(classes.withColumnRenamed("class_id", "doc_id").hint("shuffle_hash"), ["doc_id", "k1", "k2"], "left_semi").select(F.col("doc_id").alias("cid"), "n", "probe")
    reps, rows = stage(reps, "representatives"), stage(sketch.select("doc_id", "n"), "sizes")
    discard(sketch)
    families = candidate_families(reps, percent).select(F.col("node").alias("class_id"), F.col("component").alias("family"))
    discard(reps)
    families = stage(families.join(classes, "class_id").select(F.col("class_id").alias("cid"), "k1", "k2", "family"), "families")
    found = components(links(texts, families, percent, width))
    of_class = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = standing.join(of_class, ["k1", "k2"]).select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component"))
    out = rows.join(named, "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
