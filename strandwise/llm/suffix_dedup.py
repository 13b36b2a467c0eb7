"""Repeated-substring removal over a corpus with a logarithmic suffix-index family.

A byte goes when it lies in a ``length``-byte string that also starts earlier (in a
smaller document id, or earlier in the same document). Strings are judged on the input.

How it scales. A suffix array over every byte would be many times the corpus, so the
index is sparse: of every ``length``-byte string only its *anchor*, the position of its
smallest k-gram hash, enters the index. Equal strings have equal anchors, so no match
is lost. All strings that share one anchor form a *run*.

1. ``_anchors`` scans the texts and makes one row per run: the hash of the anchor's
   k-gram, the hash of all bytes that the run covers, and the place.
2. ``match_runs`` (rows dealt by k-gram hash, in document order) keeps a family of
   levels: every Arrow batch is sorted, merge-scanned against the sorted levels and then
   becomes a level; levels of equal size merge. A run whose covered bytes are all in the
   index is a repeat as a whole. A run that shares only its k-gram may match in part.
3. Runs that may match in part are cut into pieces of ``PIECES`` strings, aligned at the
   anchor, and pieces that may match in part into single strings. Both go through
   families of their own, keyed by the bytes that all strings of a piece share (of a
   single string: its ``length`` bytes), so contexts that only lie near each other part.

Tasks hold only the distinct runs of their share of the hash space. Every part of the
input is settled by itself before the shuffle (``settled``): copies are repeats, and
where one key has several variants all of them are known to match in part. Of each key
at most one variant, or one flag instead of all of them, goes on to be dealt by key, so
no key gathers the contexts of a passage. Bytes are compared by 64-bit hashes: of the
shared bytes and of all bytes covered.

Edge cases: a null text is empty; texts under ``length`` bytes lose nothing; repeated
rows with one doc_id are each judged as that document's text (the same start in the same
document is one occurrence, so equal rows keep equal texts); a null doc_id is kept and
loses nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, mix, slices, stage
from .levels import LevelFamily

LENGTH = 100
GRAM = 28
#: Longer texts are cut into overlapping segments of this many bytes.
SEGMENT = 4 << 20
#: Texts looked at together have about this many bytes.
SLICE = 1 << 19
#: Strings in a piece of a run that may match in part; then strings on their own.
PIECES = (8, 1)
#: Runs that are settled together before the shuffle.
SETTLE = 200_000
_POS_BITS = np.uint64(24)

#: ``tag`` tells texts of one doc_id apart; ``lead`` is how far the anchor lies behind the start.
_RUN = "h long, u long, doc_id long, tag int, start int, n int, lead int, kind int"
_RUN_NAMES = ["h", "u", "doc_id", "tag", "start", "n", "lead", "kind"]
#: A flag stands for all variants of a key that one part of the input holds.
FRESH, WHOLE, PARTIAL, FLAG = 0, 1, 2, 3
_NO_DOC = np.iinfo(np.int64).min
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    out, have = keys, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def _segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Byte ranges (from, to, document offsets inside) that fit the position bits."""
    if offsets[-1] <= SEGMENT or len(offsets) > 2:
        yield 0, int(offsets[-1]), offsets
        return
    size = int(offsets[-1])
    for at in range(0, max(1, size - length + 1), SEGMENT - length + 1):
        stop = min(size, at + SEGMENT)
        yield at, stop, np.array([0, stop - at])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """What ``led_runs`` finds, without the leads."""
    found = led_runs(data, offsets, length, gram)
    return found and found[:5]


def led_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of ``length``-byte strings that share an anchor: for each its anchor's hash,
    the hash of its bytes, its document's index, its first start in the buffer, how
    many strings it has and how far its anchor lies behind its start."""
    n = len(data)
    if n < length:
        return None
    hasher = Hasher(data)
    at = np.arange(n - gram + 1)
    grams = hasher.ranges(at, at + gram)
    keys = (grams & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    least = _sliding_min(keys, length - gram + 1)  # one for each start of a string
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    fits = np.arange(len(least)) + length <= offsets[doc + 1]
    starts = np.flatnonzero(fits)
    if not len(starts):
        return None
    anchors = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    start, anchor = starts[first], anchors[first]
    # the place of the anchor in the run is part of what must be equal
    whole = mix(hasher.ranges(start, start + count + length - 1) + (anchor - start).astype(np.uint64))
    return grams[anchor], whole, doc[start], start, count, anchor - start


def _first_of(keys: list[np.ndarray]) -> np.ndarray:
    """Whether each row of sorted columns differs from the row before."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def settled(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """What one part of the input tells of its runs by itself."""
    order = np.lexsort((rows["tag"], rows["start"], rows["doc_id"], rows["u"], rows["h"]))
    rows = {k: v[order] for k, v in rows.items()}
    # repeated rows of one document are one occurrence
    once = _first_of([rows[k] for k in ("h", "u", "doc_id", "start", "tag")])
    rows = {k: v[once] for k, v in rows.items()}
    h, doc, start = rows["h"], rows["doc_id"], rows["start"]
    new = _first_of([h, rows["u"]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    repeat = (doc != doc[first]) | (start != start[first])
    new_h = _first_of([h])
    key = np.cumsum(new_h) - 1
    several = np.bincount(key, weights=new)[key] > 1
    kind = np.where(repeat, WHOLE, np.where(several, PARTIAL, FRESH))
    flagged = np.flatnonzero(new_h & several)
    done = kind != FRESH  # no need to meet others
    out = {**rows, "h": np.where(done, mix(doc.view(np.uint64)), h), "u": np.where(done, np.uint64(0), rows["u"]), "kind": kind}
    flags = {k: np.zeros(len(flagged), v.dtype) for k, v in out.items()}
    flags |= {"h": h[flagged], "doc_id": np.full(len(flagged), _NO_DOC), "kind": np.full(len(flagged), FLAG)}
    both = {k: np.concatenate((out[k], flags[k])) for k in _RUN_NAMES}
    columns = [both[k].view(np.int64) if k in ("h", "u") else both[k] if k == "doc_id" else both[k].astype(np.int32) for k in _RUN_NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _RUN_NAMES)


def _settle(found: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for rows in found:
        held.append(rows)
        size += len(rows["h"])
        if size > SETTLE:
            yield settled({k: np.concatenate([x[k] for x in held]) for k in rows})
            held, size = [], 0
    if held:
        yield settled({k: np.concatenate([x[k] for x in held]) for k in held[0]})


def _anchors(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for s in slices(batches, most=SLICE):
            ids, tags = (c.to_numpy(zero_copy_only=False) for c in s.columns)
            for at, stop, offsets in _segments(s.offsets, length):
                found = led_runs(s.bytes[at:stop], offsets, length, gram)
                if found is not None:
                    h, u, doc, start, n, lead = found
                    yield {"h": h, "u": u, "doc_id": ids[doc].astype(np.int64), "tag": tags[doc], "start": (start - offsets[doc] + at).astype(np.int32), "n": n.astype(np.int32), "lead": lead.astype(np.int32)}

    return lambda batches: _settle(find(batches))


def _bisect(level_u: np.ndarray, lo: np.ndarray, hi: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Places of ``u`` in the ranges [lo, hi) of a sorted column, all at once."""
    lo, end = lo.copy(), hi.copy()
    while (open_ := lo < end).any():
        mid = (lo + end) // 2
        less = open_ & (level_u[np.minimum(mid, len(level_u) - 1)] < u)
        lo = np.where(less, mid + 1, lo)
        end = np.where(open_ & ~less, mid, end)
    return lo


def match_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in document order, flags first; yields runs that repeat as a whole and
    runs (of either side) that may match in part."""
    family = LevelFamily(lambda rows: np.lexsort((rows["u"], rows["h"])))
    names = _RUN_NAMES[:-1]

    def out(rows: dict[str, np.ndarray], at: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(rows[k][at]) for k in names), pa.array(np.broadcast_to(np.int32(kind), len(at)))], _RUN_NAMES)

    for batch in batches:
        rows = {k: batch.column(i).to_numpy() for i, k in enumerate(names)}
        kind = batch.column(len(names)).to_numpy()
        done = (kind == WHOLE) | (kind == PARTIAL)
        if done.any():
            yield out(rows, np.flatnonzero(done), kind[done])
            rows = {k: v[~done] for k, v in rows.items()}
        if not len(rows["h"]):
            continue
        # the batch's own sorted array; the sort is stable, so the first of equals is the earliest
        order = np.lexsort((rows["u"], rows["h"]))
        rows = {k: v[order] for k, v in rows.items()}
        h, u, doc, start = (rows[k] for k in ("h", "u", "doc_id", "start"))
        flag = doc == _NO_DOC
        new = _first_of([h, u])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        first_doc, first_start = doc[first], start[first]
        several = flag.copy()
        spans = []
        for level in family.levels:
            lo, hi = np.searchsorted(level["h"], h, "left"), np.searchsorted(level["h"], h, "right")
            some = np.flatnonzero(hi > lo)
            low, high = lo[some], hi[some]
            several[some] |= level["sent"][low] | (level["u"][low] != u[some]) | (level["u"][high - 1] != u[some])
            place = _bisect(level["u"], low, high, u[some])
            at = np.minimum(place, len(level["u"]) - 1)
            hit = (place < high) & (level["u"][at] == u[some])
            # levels of one (h, u) hold its first occurrence only, once for each text that has it
            first_doc[some[hit]], first_start[some[hit]] = level["doc_id"][at[hit]], level["start"][at[hit]]
            spans.append((level, lo, hi))
        repeat = ~flag & ((doc != first_doc) | (start != first_start))
        if repeat.any():
            yield out(rows, np.flatnonzero(repeat), WHOLE)
        # variants of one key, here or in levels; all rows of a key are sent, or none
        new_h = _first_of([h])
        key = np.cumsum(new_h) - 1
        several = (np.bincount(key, weights=several)[key] > 0) | (np.bincount(key, weights=new)[key] > 1)
        partial = several & ~repeat & ~flag
        if partial.any():
            yield out(rows, np.flatnonzero(partial), PARTIAL)
        for level, lo, hi in spans:
            of = np.flatnonzero(new_h & several & (hi > lo))
            of = of[~level["sent"][lo[of]]]
            if len(of):
                count = hi[of] - lo[of]
                at = np.repeat(lo[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                level["sent"][at] = True
                yield out(level, at, PARTIAL)
        keep = ~repeat & (~flag | new)
        family.add({k: v[keep] for k, v in {**rows, "sent": several}.items()})


def _pieces(length: int, width: int):
    """Pieces of up to ``width`` strings of the runs asked for. Equal strings lie at the
    same place before equal anchors, so they meet in pieces with the same shared bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for s in slices(batches, most=SLICE):
            ids, tags = (s.columns[i].to_numpy(zero_copy_only=False) for i in (0, 1))
            asked = s.columns[2]
            of = np.repeat(np.arange(len(s)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
            flat = asked.flatten()
            start, n, lead = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n", "lead"))
            owner = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            block = (lead[owner] - inside) // width
            begin = np.flatnonzero(_first_of([owner, block]))
            count = np.diff(np.append(begin, len(owner)))
            owner, inside, block = owner[begin], inside[begin], block[begin]
            at = s.offsets[of[owner]] + start[owner] + inside
            last = at + lead[owner] - inside - block * width  # where the last string of a full piece starts
            hasher = Hasher(s.bytes)
            shared = mix(hasher.ranges(last, last - width + 1 + length) + block.astype(np.uint64))
            half = at + length // 2
            covered = hasher.ranges(at, half) * _STEP + hasher.ranges(half, at + count - 1 + length)
            behind = lead[owner] - inside
            yield {"h": shared, "u": mix(covered + behind.astype(np.uint64)), "doc_id": ids[of[owner]].astype(np.int64), "tag": tags[of[owner]], "start": (start[owner] + inside).astype(np.int32), "n": count.astype(np.int32), "lead": behind.astype(np.int32)}

    return lambda batches: _settle(find(batches))


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per ``doc_id, tag`` of texts the runs of repeated strings: ``spans`` (array of
    start and count of consecutive repeated strings, in bytes), unmerged."""
    runs = texts.select("doc_id", "tag", "text").mapInArrow(_anchors(length, gram), _RUN)
    found = None
    for width in (0, *PIECES):
        if width:
            asked = matched.where(F.col("kind") == PARTIAL).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n", "lead")).alias("asked"))
            with_asked = texts.join(asked.hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "asked", "text")
            runs = with_asked.mapInArrow(_pieces(length, width), _RUN)
        matched = runs.repartition("h").sortWithinPartitions("doc_id", "start").mapInArrow(match_runs, _RUN)
        if width != 1:
            matched = stage(matched, "runs")
        whole = matched.where(F.col("kind") == WHOLE).select("doc_id", "tag", "start", "n")
        found = whole if found is None else found.unionByName(whole)
    return found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            removed, spans, kept, texts = [], [], [], []
            for i in range(len(s)):
                text, found = s.doc(i), s.columns[1][i].values
                if found is None or not len(found):
                    removed.append(0)
                    spans.append(0)
                else:
                    start = found.field("start").to_numpy().astype(np.int64)
                    end = start + found.field("n").to_numpy() + length - 1
                    step = np.zeros(len(text) + 1, np.int32)
                    np.add.at(step, np.minimum(start, len(text)), 1)
                    np.add.at(step, np.minimum(end, len(text)), -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0)
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                kept.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            out = [s.columns[0], pa.array(np.diff(s.offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.binary())] * with_text, _CUT_NAMES + ["kept"] * with_text)

    return run


_CUT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and,
    with ``with_text``, ``kept`` (the remaining bytes)."""
    rows = docs.select("doc_id", "text", F.hash("text").alias("tag"))
    whole = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    texts = rows.where(whole)
    found = repeats(texts, length, gram)
    spanned = texts.join(found.hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "spans", "text")
    others = rows.where(~whole).select("doc_id", F.lit(None).cast("array<struct<start:int,n:int>>").alias("spans"), "text")
    return spanned.unionByName(others).mapInArrow(_cut(length, with_text), _CUT + ", kept binary" * with_text)
