"""Language-model scores: unigrams with add-one, and a hashed maximum-entropy model.

The model factors a token's probability three times:

    P(token | history) = P(class | history) P(part | class, history) P(token | part)

* Classes are learned: units (the ``WORDS`` most frequent words, and hashed endings of
  ``ENDING`` bytes for all other words) are grouped by what stands near them, so that
  words of one language or kind share a class. The ``FREQUENT`` most common words and the
  end are classes of their own.
* P(class | history) is a softmax over two hashed features: the n-gram of the two classes
  before, and the skip feature of the two classes before those.
* A class is cut into ``PARTS`` parts by word hash. P(part | class, history) is a softmax
  with one hashed feature, the word before; its weights are the logs of smoothed counts,
  which is where the gradient of a single feature vanishes.
* P(token | part) has one feature per token, with the smoothed log counts as weights.

Each factor sums to one, over the training tokens of a part and one unknown token.

Training is distributed. Every task sums, over its training tokens, how often features
meet classes and how often each context (four classes of history) occurs; there are at
most ``CONTEXTS`` contexts, whatever the corpus. Gradient rounds then run over contexts:
tasks sum what the model expects for their contexts, and the gradient (observed less
expected, scaled feature by feature) updates the weights. The first round starts from
class frequencies, where the expected counts need no pass.

What grows with the corpus: token counts, which stay distributed, and the hashed table of
words before (``before_rows``: one row per so many tokens, up to what a task can hold).
Documents are dealt into blocks of about ``BLOCK_BYTES``, each block counts its tokens,
counts are summed by token in one step and go back to the blocks in another
(``join_counted``: a token that stands in every block is not gathered). Texts travel
compressed.

Tokens are identified by 64-bit hashes. Edge cases: a null or empty text is the end token
alone; repeated rows count and score each; a null doc_id is a training row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, Hasher, Slice, discard, join_counted, mix, slices, stage, word_bounds

BLOCK_BYTES = 8 << 20
WORDS = 2048
ENDING, ENDINGS = 3, 4096
FREQUENT, GROUPS = 7, 24
CLASSES = FREQUENT + 1 + GROUPS
#: Units seen most, whose neighbourhood tells units apart.
NEAR = 63
PARTS = 16
#: Classes of history, with one for what lies before the text.
SIDES = CLASSES + 1
PAIRS = SIDES * SIDES
CONTEXTS = PAIRS * PAIRS
ROUNDS = 6
#: Of each class' share, added to what is expected of a feature.
PRIOR = 5.0
RIDGE = 2.0
#: Weight of the parts' shares where a word before says little.
PART_PRIOR = 50.0
#: Cells of the sums that are added up together.
CELLS = 1 << 16

END = np.int64(0x454E44)
_START = np.uint64(0x5354415254)
_UNITS = WORDS + ENDINGS + 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Tokens(NamedTuple):
    """Tokens of a slice, each document's words followed by its end."""

    word: np.ndarray
    ending: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def before(self, values: np.ndarray, far: int, start) -> np.ndarray:
        """What stood ``far`` tokens earlier in the same document, else ``start``."""
        out = np.full(len(values), start, values.dtype)
        if len(values) > far:
            out[far:] = values[:-far]
        for k in range(far):
            at = self.first + k
            out[at[at < np.append(self.first[1:], len(values))]] = start
        return out


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data = LOWER_AZ[data]
    starts, ends, firsts = word_bounds(data, offsets)
    n_docs = len(offsets) - 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    # a document without bytes shares its offset with the next one; words are never there
    place = np.arange(len(starts)) + doc
    size = len(starts) + n_docs
    word = np.full(size, END, np.int64)
    word[place] = Hasher(data).ranges(starts, ends).view(np.int64)
    ending = np.full(size, -1, np.int64)
    if len(starts):
        last = np.zeros(len(starts), np.uint64)
        for k in range(1, ENDING + 1):
            last = last * np.uint64(256) + np.where(ends - k >= starts, data[np.maximum(ends - k, 0)], 0).astype(np.uint64)
        ending[place] = (mix(last + np.uint64(1)) >> np.uint64(40)).astype(np.int64) % ENDINGS
    lengths = np.diff(firsts) + 1
    return Tokens(word, ending, np.repeat(np.arange(n_docs), lengths), np.cumsum(lengths) - lengths)


def part_of(word: np.ndarray) -> np.ndarray:
    return (mix(word.view(np.uint64) ^ _START) >> np.uint64(60)).astype(np.int64) % PARTS


class Units:
    """The most frequent words by place, other words by their ending, and the end last."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        self.words, self.place = words[order], order

    def of(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = np.where(ending < 0, _UNITS - 1, WORDS + ending)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = (self.words[at] == word) & (ending >= 0)
            out[hit] = self.place[at[hit]]
        return out


# ------------------------------------------------------------------ counts by block


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            packed = [squeeze.compress((t.as_py() or "").encode()) for t in part.column(3)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(packed, pa.binary())], ["block", "doc_id", "held", "packed"])


def packed_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """``block, doc_id, held, packed``: documents dealt into blocks, compressed."""
    # rows without an id are dealt by their text
    dealt = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit("block"))).otherwise(F.xxhash64("text"))
    block = F.pmod(dealt, F.lit(blocks)).cast("int").alias("block")
    return docs.select(block, "doc_id", held_out().alias("held"), "text").mapInArrow(_pack, "block int, doc_id long, held boolean, packed binary")


def _unpacked(table: pa.Table, most: int = 2 << 20) -> Iterator[Slice]:
    """Slices of a block with the columns ``doc_id`` and ``held``."""
    expand = zstandard.ZstdDecompressor()
    ids, held = table.column("doc_id"), table.column("held")
    texts: list[bytes] = []
    start = size = 0
    for i, packed in enumerate(table.column("packed")):
        texts.append(expand.decompress(packed.as_py()))
        size += len(texts[-1])
        if size >= most or i + 1 == table.num_rows:
            columns = [c.slice(start, len(texts)).combine_chunks() for c in (ids, held)]
            yield Slice(columns, pa.array([t.decode() for t in texts], pa.large_string()))
            start, size, texts = i + 1, 0, []


def _count_block(table: pa.Table) -> pa.Table:
    words, endings, counts = [], [], []
    for s in _unpacked(table):
        tokens = tokens_of(s.bytes, s.offsets)
        held = s.columns[1].to_numpy(zero_copy_only=False)
        word, at, inverse = np.unique(tokens.word, return_index=True, return_inverse=True)
        words.append(word)
        endings.append(tokens.ending[at])
        counts.append(np.bincount(inverse, weights=~held[tokens.doc], minlength=len(word)).astype(np.int64))
    word, at, inverse = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(word)).astype(np.int64)
    block = pa.array(np.full(len(word), table.column("block")[0].as_py(), np.int32))
    return pa.table({"word": word, "block": block, "ending": np.concatenate(endings)[at].astype(np.int32), "n": n})


class Vocabulary(NamedTuple):
    """What is known of the training tokens as a whole."""

    total: int
    distinct: int
    frequent: np.ndarray
    near: np.ndarray


def vocabulary(totals: DataFrame) -> Vocabulary:
    """From ``word, ending, c``: sums, the most frequent words, and the units seen most."""
    sums = totals.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    top = totals.where("ending >= 0").orderBy(F.desc("c"), "word").limit(WORDS).select("word", "c").collect()
    mass = np.zeros(_UNITS)
    mass[: len(top)] = [r["c"] for r in top]
    for r in totals.groupBy("ending").agg(F.sum("c").alias("c")).collect():  # at most ENDINGS + 1 rows
        mass[_UNITS - 1 if r["ending"] < 0 else WORDS + r["ending"]] = r["c"]
    near = np.full(_UNITS, NEAR)
    most = np.argsort(-mass, kind="stable")[:NEAR]
    near[most] = np.arange(len(most))
    return Vocabulary(sums["total"], sums["distinct"], np.array([r["word"] for r in top], np.int64), near)


# ------------------------------------------------------------------ sums of all tasks


def _cells(sums: np.ndarray, offset: int = 0) -> Iterator[pa.RecordBatch]:
    """A flat array in parts of ``CELLS``, without the empty ones."""
    for at in range(0, len(sums), CELLS):
        part = sums[at : at + CELLS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([(offset + at) // CELLS], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["part", "sums"])


def _add_up(table: pa.Table) -> pa.Table:
    out = np.zeros(CELLS)
    for x in table.column("sums"):
        part = np.frombuffer(x.as_py(), np.float32)
        out[: len(part)] += part
    return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([out.tobytes()], pa.binary())})


def _whole(rows: DataFrame, start: int, size: int) -> np.ndarray:
    """``size`` cells from ``start`` of added-up parts (tables of a fixed size)."""
    low, high = start // CELLS, (start + size - 1) // CELLS
    out = np.zeros((high - low + 1) * CELLS)
    for r in rows.where(F.col("part").between(low, high)).collect():
        at = (r["part"] - low) * CELLS
        out[at : at + CELLS] = np.frombuffer(r["sums"])
    return out[start - low * CELLS :][:size]


def _near(units: Units, near: np.ndarray):
    """How often each unit stands within two tokens of each of the units seen most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = NEAR + 2
        sums = np.zeros(_UNITS * wide)
        for s in slices(batches):
            tokens = tokens_of(s.bytes, s.offsets)
            unit = units.of(tokens.word, tokens.ending)
            kind = near[unit]
            for far in (1, 2):
                sums += np.bincount(unit * wide + tokens.before(kind, far, NEAR + 1), minlength=len(sums))
                earlier = tokens.before(unit, far, -1)
                sums += np.bincount((earlier * wide + kind)[earlier >= 0], minlength=len(sums))
        yield from _cells(sums)

    return run


def grouped_units(sums: np.ndarray, groups: int = GROUPS, rounds: int = 25) -> np.ndarray:
    """Group of each unit: k-means over square roots of the shares of what stands near
    it, from the heaviest unit on, each further centre far from those before."""
    table = sums.reshape(_UNITS, -1)
    weight = table.sum(axis=1)
    if not weight.sum():
        return np.zeros(_UNITS, np.int64)
    usual = table.sum(axis=0) / weight.sum()
    shares = (table + 30 * usual) / (weight + 30)[:, None]
    points = np.sqrt(shares) - np.sqrt(usual)
    heavy = np.argsort(-weight, kind="stable")[:2000]
    centres = [points[heavy[0]]]
    gap = ((points[heavy] - centres[0]) ** 2).sum(axis=1)
    for _ in range(groups - 1):
        centres.append(points[heavy[np.argmax(gap * weight[heavy])]])
        gap = np.minimum(gap, ((points[heavy] - centres[-1]) ** 2).sum(axis=1))
    middle = np.array(centres)
    for _ in range(rounds):
        far = (points**2).sum(axis=1)[:, None] - 2 * points @ middle.T + (middle**2).sum(axis=1)[None]
        own = far.argmin(axis=1)
        for g in range(groups):
            if (mine := own == g).any() and weight[mine].sum():
                middle[g] = (points[mine] * weight[mine][:, None]).sum(axis=0) / weight[mine].sum()
    return own


class Classes(NamedTuple):
    units: Units
    of_unit: np.ndarray
    before_rows: int

    def of(self, tokens: Tokens) -> np.ndarray:
        return self.of_unit[self.units.of(tokens.word, tokens.ending)]

    def history(self, tokens: Tokens, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the n-gram and the skip feature, and of the word before."""
        one, two, three, four = (tokens.before(classes, far, CLASSES) for far in (1, 2, 3, 4))
        word = tokens.before(tokens.word, 1, END).view(np.uint64)
        return one * SIDES + two, three * SIDES + four, (mix(word) >> np.uint64(32)).astype(np.int64) % self.before_rows


def classes_of(texts: DataFrame, known: Vocabulary) -> Classes:
    units = Units(known.frequent)
    near = stage(texts.where(~held_out()).select("text").mapInArrow(_near(units, known.near), "part int, sums binary").groupBy("part").applyInArrow(_add_up, "part int, sums binary"), "near")
    groups = grouped_units(_whole(near, 0, _UNITS * (NEAR + 2)))
    discard(near)
    of_unit = FREQUENT + 1 + groups
    of_unit[:FREQUENT] = np.arange(FREQUENT)
    of_unit[_UNITS - 1] = FREQUENT
    rows = 1 << max(10, min(12, (max(known.total, 1) // 65536).bit_length()))
    return Classes(units, of_unit, rows)


# ------------------------------------------------------------------ training

_MEETINGS = PAIRS * CLASSES
#: Where the sums of each table begin, on whole parts.
_round = lambda n: -(-n // CELLS) * CELLS
_SKIP_AT = _round(_MEETINGS)
_CONTEXT_AT = 2 * _round(_MEETINGS)
_BEFORE_AT = _CONTEXT_AT + _round(CONTEXTS)


def _meet(classes: Classes):
    """How often features meet classes, how often contexts occur, and how often words
    before meet the parts of classes, summed over a task's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, skips = np.zeros(_MEETINGS), np.zeros(_MEETINGS)
        contexts, before = np.zeros(CONTEXTS, np.float32), np.zeros(classes.before_rows * CLASSES * PARTS, np.float32)
        for s in slices(batches):
            tokens = tokens_of(s.bytes, s.offsets)
            own = classes.of(tokens)
            pair, skip, row = classes.history(tokens, own)
            pairs += np.bincount(pair * CLASSES + own, minlength=_MEETINGS)
            skips += np.bincount(skip * CLASSES + own, minlength=_MEETINGS)
            contexts += np.bincount(pair * PAIRS + skip, minlength=CONTEXTS)
            before += np.bincount((row * CLASSES + own) * PARTS + part_of(tokens.word), minlength=len(before))
        for table, at in ((pairs, 0), (skips, _SKIP_AT), (contexts, _CONTEXT_AT), (before, _BEFORE_AT)):
            yield from _cells(table, at)

    return run


def log_softmax(pair: np.ndarray, skip: np.ndarray, bias: np.ndarray, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log probability of every class for each pair of feature rows."""
    score = pair[rows[0]] + skip[rows[1]]
    score += bias
    score -= score.max(axis=1, keepdims=True)
    return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def _expect(model: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """What the model expects of features and classes, summed over a task's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, PAIRS, CLASSES))
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(sums.as_py())
                context = np.flatnonzero(counts)
                rows = (context + (part * CELLS - _CONTEXT_AT)) // PAIRS, (context + (part * CELLS - _CONTEXT_AT)) % PAIRS
                p = np.exp(log_softmax(*model, rows)) * counts[context][:, None]
                for k in range(2):
                    order = np.argsort(rows[k], kind="stable")
                    row = rows[k][order]
                    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    out[k, row[first]] += np.add.reduceat(p[order], first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["expected"])

    return run


class Model(NamedTuple):
    classes: Classes
    pair: np.ndarray
    skip: np.ndarray
    bias: np.ndarray
    #: log10 P(part | class, word before) and, per class and part, log10 of 1 + its tokens and its distinct tokens
    parts: np.ndarray
    inside: np.ndarray


def train(texts: DataFrame, classes: Classes, leaves: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model:
    """``leaves``: training tokens and distinct tokens of each part of each class."""
    met = texts.where(~held_out()).select("text").mapInArrow(_meet(classes), "part int, sums binary")
    met = stage(met.groupBy("part").applyInArrow(_add_up, "part int, sums binary"), "met")
    observed = np.stack((_whole(met, 0, _MEETINGS), _whole(met, _SKIP_AT, _MEETINGS))).reshape(2, PAIRS, CLASSES)
    share = observed[0].sum(axis=0) + 1
    share /= share.sum()
    bias = np.log(share)
    weights = np.zeros_like(observed)
    prior = PRIOR * share
    contexts = met.where(F.col("part").between(_CONTEXT_AT // CELLS, _BEFORE_AT // CELLS - 1))
    for step in range(rounds):
        if step:
            # one row per task over a table of fixed size
            found = contexts.mapInArrow(_expect((weights[0].astype(np.float32), weights[1].astype(np.float32), bias.astype(np.float32))), "expected binary")
            expected = sum((np.frombuffer(r["expected"]).reshape(observed.shape) for r in found.collect()), np.zeros_like(observed))
        else:
            expected = observed.sum(axis=2, keepdims=True) * share
        # of the log likelihood with a Gaussian prior on the weights, scaled by what is
        # expected; each token has two features, so half a step does not overshoot
        gradient = (observed - expected - RIDGE * weights) / (expected + prior + RIDGE)
        weights += np.clip(np.log1p(np.maximum(gradient, -0.99)), -4, 4) / 2
    total, distinct = (x.reshape(CLASSES, PARTS) for x in leaves)
    size = total + distinct + 1
    usual = size / size.sum(axis=1, keepdims=True)
    before = _whole(met, _BEFORE_AT, classes.before_rows * CLASSES * PARTS).reshape(-1, CLASSES, PARTS)
    parts = np.log10((before + PART_PRIOR * usual) / (before.sum(axis=2, keepdims=True) + PART_PRIOR))
    discard(met)
    return Model(classes, weights[0].astype(np.float32), weights[1].astype(np.float32), bias.astype(np.float32), parts.astype(np.float32), np.log10(size))


def _leaves(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(CLASSES * PARTS), np.zeros(CLASSES * PARTS)
        for batch in batches:
            word, ending, c = (batch.column(i).to_numpy() for i in range(3))
            leaf = classes.of_unit[classes.units.of(word, ending.astype(np.int64))] * PARTS + part_of(word)
            total += np.bincount(leaf, weights=c, minlength=len(total))
            distinct += np.bincount(leaf, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(distinct)], ["leaf", "total", "distinct"])

    return run


def leaves_of(totals: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    rows = totals.select("word", "ending", "c").mapInArrow(_leaves(classes), "leaf int, total double, distinct double")
    total, distinct = np.zeros(CLASSES * PARTS), np.zeros(CLASSES * PARTS)
    for r in rows.groupBy("leaf").agg(F.sum("total").alias("t"), F.sum("distinct").alias("d")).collect():  # CLASSES x PARTS rows
        total[r["leaf"]], distinct[r["leaf"]] = r["t"], r["d"]
    return total, distinct


# ------------------------------------------------------------------ scoring


def token_scores(model: Model, tokens: Tokens, count: np.ndarray) -> np.ndarray:
    """log10 probability of each token; ``count``: how often training has it."""
    own = model.classes.of(tokens)
    pair, skip, row = model.classes.history(tokens, own)
    part = part_of(tokens.word)
    log_class = np.empty(len(own))
    for at in range(0, len(own), 1 << 15):
        some = slice(at, at + (1 << 15))
        found = log_softmax(model.pair, model.skip, model.bias, (pair[some], skip[some]))
        log_class[some] = found[np.arange(len(found)), own[some]]
    return log_class / np.log(10) + model.parts[row, own, part] + np.log10(count + 1.0) - model.inside[own, part]


def _score_block(known: Vocabulary, model: Model):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    denominator = np.log10(known.total + 1.0 * (known.distinct + 1))

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        word = counts.column("word").to_numpy()
        order = np.argsort(word)
        word, c = word[order], counts.column("c").to_numpy()[order]
        for s in _unpacked(texts) if texts.num_rows else ():
            tokens = tokens_of(s.bytes, s.offsets)
            if len(word):
                at = np.minimum(np.searchsorted(word, tokens.word), len(word) - 1)
                count = np.where(word[at] == tokens.word, c[at], 0)
            else:
                count = np.zeros(len(tokens.word), np.int64)
            add = lambda x: np.add.reduceat(x, tokens.first)  # noqa: B023, E731
            lengths = np.diff(np.append(tokens.first, len(tokens.word)))
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        s.columns[0],
                        s.columns[1],
                        pa.array(lengths),
                        pa.array(add((count > 0).astype(np.int64))),
                        pa.array(np.full(len(s), known.total)),
                        pa.array(add(np.log10(count + 1.0) - denominator)),
                        pa.array(add(token_scores(model, tokens, count))),
                    ],
                    names,
                )
            )
        return pa.Table.from_batches(out, pa.schema(list(zip(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True))))

    return run


class Learned(NamedTuple):
    packed: DataFrame
    counts: DataFrame
    known: Vocabulary
    model: Model


def learn(docs: DataFrame, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> Learned:
    """Packed texts by block, each block's token counts (``block, word, c``), what is
    known of all training tokens, and the model."""
    texts = docs.select("doc_id", "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    packed = packed_blocks(texts, max(1, -(-size // block_bytes)))
    rows = stage(packed.groupBy("block").applyInArrow(_count_block, "word long, block int, ending int, n long"), "tokens")
    totals = rows.groupBy("word").agg(F.sum("n").alias("c"), F.min("ending").alias("ending"), F.count("*").alias("blocks")).where("c > 0")
    totals = stage(totals, "totals")
    known = vocabulary(totals)
    classes = classes_of(texts, known)
    model = train(texts, classes, leaves_of(totals, classes), rounds)
    counts = join_counted(rows.select("word", "block"), totals.select("word", "c", "blocks"), ["word"], "blocks", rows.count())
    return Learned(packed, counts.select("block", "word", "c"), known, model)


def language_model_scores(docs: DataFrame, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score`` (unigrams) and ``score`` (the model), in log10."""
    learned = learn(docs, rounds, block_bytes)
    of = learned.counts.select(F.col("block").alias("of"), "word", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return learned.packed.groupBy("block").cogroup(of.groupBy("of")).applyInArrow(_score_block(learned.known, learned.model), schema)
