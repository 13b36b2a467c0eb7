"""Postings in blocks: one row for many postings of a term, not one for each.

A block is ``term, field, opens, seq, wide, n, postings``: ``n`` postings, each as three
numbers of 7 bits a byte: what the key is above the key before; ``tf``, with a bit for a null
key and one for a posting that begins a run of ascending keys and states its key in full; and
the length of the field. So blocks are joined by joining bytes. Keys that are no whole numbers
are in ``keys``. A posting takes about four bytes wherever it is written, dealt or sorted.

``opens`` is 0, or as in ``text.inverted_index`` on blocks without a term, which hold a row
per document and field: how many words differ in it, and its length.

Blocks are dealt by a hash of their term. A term with more than a part's share of a chunk of
documents is ``wide`` there and dealt by its postings too, so no part has to hold all of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators.text import _plain

#: Most bytes of text, rows, and bytes of blocks held at once; postings of a block, about; rows packed and unpacked at once.
TEXT, ROWS, HELD, BLOCK, SLICE, UNPACKED = 16 << 20, 1 << 20, 32 << 20, 1 << 12, 1 << 19, 1 << 17
WHOLE = ("tinyint", "smallint", "int", "bigint")
DEALT = "part int, blocks binary"

#: Lower case of a byte of ASCII or of words that are in lower case already, and if it is in a word.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = bytes(48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256))


def block_schema(key_type: str) -> str:
    keys = "" if key_type in WHOLE else f", keys array<{key_type}>"
    return f"term string, field string, opens int, seq long, wide boolean, n int, postings binary{keys}"


def part_of(term: str, parts: int) -> int:
    """The part of a term that is not wide."""
    return zlib.crc32(term.encode()) % parts


# ---------------------------------------------------------------- numbers in bytes


def encode(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Unsigned numbers at 7 bits a byte, an entry for each run that begins at ``starts``."""
    if len(values) and values.max() < 1 << 32:
        values = values.astype(np.uint32)
    size = np.ones(len(values), np.uint8)
    for bits in range(7, 8 * values.itemsize, 7):
        more = values >= values.dtype.type(1 << bits)
        if not more.any():
            break
        size += more
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    offsets, out = ends[np.append(starts, len(values))], np.empty(ends[-1], np.uint8)
    left, at = values, ends[:-1]
    while len(left):
        more = left > 127
        out[at] = (left & 127).astype(np.uint8) | (more.view(np.uint8) << 7)
        left, at = left[more] >> 7, at[more] + 1
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of a text or binary column begin and end, and all their bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return offsets - offsets[0], data


def decode(column: pa.Array) -> np.ndarray:
    """All numbers of a column that ``encode`` made."""
    _, data = _bytes(column)
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends + 1)[:-1]
    out, size, k = (data[starts] & 127).astype(np.uint64), ends - starts, 1
    live = np.flatnonzero(size)
    while len(live):
        out[live] |= (data[starts[live] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        live, k = live[size[live] > k], k + 1
    return out


# ---------------------------------------------------------------- batches


def _cut(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` in all; a larger row is a slice of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _chunks(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.Table]:
    """The batches in tables of about ``most`` in all."""
    held, size = [], 0
    for batch in batches:
        for part in _cut(batch, sizes(batch), most):
            more = int(sizes(part).sum())
            if held and size + more > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name)
    return found.chunk(0) if found.num_chunks == 1 else pa.concat_arrays(found.chunks)


def _numpy(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def _row_bytes(columns: Sequence[str]) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: sum(_numpy(pc.fill_null(pc.binary_length(batch.column(c)), 0)).astype(np.int64) for c in columns) + 32


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that agree in all columns begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ---------------------------------------------------------------- making blocks


def _blocks(keys: pa.Array, whole: bool, code: np.ndarray, kind: np.ndarray, tf: np.ndarray, length: np.ndarray, terms: pa.Array, kinds: list[tuple], wide: np.ndarray) -> pa.RecordBatch:
    """Blocks of rows in the order of ``code`` (of one of ``terms``), ``kind`` (of one of
    ``kinds``: field, opens, seq) and key; ``wide`` is by code."""
    run = _runs(code, kind)
    place = np.arange(len(code)) - np.repeat(run, np.diff(np.append(run, len(code))))
    starts = np.flatnonzero(place % BLOCK == 0)
    null = _numpy(keys.is_null())
    numbers = np.zeros((len(code), 3), np.uint64)
    if whole:
        value = _numpy(pc.fill_null(keys, 0)).astype(np.int64)
        numbers[:, 0] = np.diff(value, prepend=0).view(np.uint64)
        first = value[starts]
        numbers[starts, 0] = ((first << 1) ^ (first >> 63)).view(np.uint64)
    numbers[:, 1], numbers[:, 2] = tf * 4 + null * 2, length
    numbers[starts, 1] += np.uint64(1)
    field, opens, seq = zip(*kinds)
    of, n = kind[starts], np.diff(np.append(starts, len(code)))
    columns = {
        "term": terms.take(pa.array(code[starts])),
        "field": pa.array(field, pa.string()).take(pa.array(of)),
        "opens": pa.array(np.array(opens, np.int32)[of]),
        "seq": pa.array(np.array(seq, np.int64)[of]),
        "wide": pa.array(wide[code[starts]]),
        "n": pa.array(n.astype(np.int32)),
        "postings": encode(numbers.ravel(), starts * 3),
    }
    if not whole:
        columns["keys"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)).astype(np.int32)), keys)
    return pa.RecordBatch.from_pydict(columns)


def _wide(code: np.ndarray, terms: int, parts: int) -> np.ndarray:
    count = np.bincount(code, minlength=terms)
    return count > max(BLOCK, len(code) // parts)


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that end in a space, and how many each text has. A text is ASCII,
    where words are as ``text.tokens`` has them, or made by it."""
    offsets, data = _bytes(text)
    low = data.tobytes().translate(_LOWER)
    data, held = np.frombuffer(low, np.uint8), np.frombuffer(bytearray(low.translate(_WORD)), bool)
    quote = np.flatnonzero(data[:-2] == 39)
    after = data[quote + 2]
    held[quote[(data[quote + 1] == 115) & ~held[quote + 2] & (after != 95)] + 1] = False
    # a word begins and ends where this changes; the last byte is a space
    edge = np.flatnonzero(held[1:] != held[:-1]) + 1
    edge = np.append(0, edge) if held[:1].any() else edge
    starts, ends = edge[::2], edge[1::2]
    spots = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(spots), pa.py_buffer(data[held])])
    return words, np.diff(np.searchsorted(starts, offsets))


def _pack_texts(names: list[str], seq: int, parts: int, whole: bool) -> Callable:
    texts = [f"_{i}" for i in range(len(names))]

    def run(batches):
        for table in _chunks(batches, _row_bytes(texts), TEXT):
            keys, docs = _column(table, "key"), len(table)
            if whole:
                order = np.argsort(_numpy(pc.fill_null(keys, 0)), kind="stable")
                keys = keys.take(pa.array(order))
            else:
                order = np.arange(docs)
            words, counts = zip(*(_words(_column(table, c)) for c in texts))
            coded = pa.concat_arrays(words).dictionary_encode()
            # rows are fields, and in them documents by key
            length = np.concatenate([count[order] for count in counts])
            rank = np.empty(docs, np.int64)
            rank[order] = np.arange(docs)
            bits = np.int64(len(length).bit_length())
            spot = (_numpy(coded.indices).astype(np.int64) << bits) | np.concatenate([np.repeat(rank + i * docs, count) for i, count in enumerate(counts)])
            del table, words
            spot.sort()
            first = _runs(spot)
            tf, spot = np.diff(np.append(first, len(spot))), spot[first]
            code, row = spot >> bits, spot & ((1 << int(bits)) - 1)
            full = length.reshape(-1, docs) > 0
            opens = np.where(full & (np.cumsum(full, axis=0) == 1), 2, 1).ravel()
            field, doc = np.divmod(np.arange(len(length)), docs)
            by = np.argsort(field * 2 + opens - 1, kind="stable")
            by = by[full.ravel()[by]]
            differ = np.bincount(row, minlength=len(length))
            if len(by):
                kinds = [(f, o, seq) for f in names for o in (1, 2)]
                yield _blocks(keys.take(pa.array(doc[by])), whole, np.zeros(len(by), np.int64), (field * 2 + opens - 1)[by], differ[by], length[by], pa.nulls(1, pa.string()), kinds, np.ones(1, bool))
                terms, kinds = coded.dictionary, [(f, 0, seq) for f in names]
                wide = _wide(code, len(terms), parts)
                for at in range(0, len(code), SLICE):
                    some = slice(at, at + SLICE)
                    yield _blocks(keys.take(pa.array(doc[row[some]])), whole, code[some], field[row[some]], tf[some], length[row[some]], terms, kinds, wide)

    return run


def _pack_rows(whole: bool) -> Callable:
    """Blocks of rows as ``_unpack`` gives them."""

    def run(batches):
        for table in _chunks(batches, lambda b: np.ones(len(b), np.int64), ROWS):
            keys, terms, fields = _column(table, "key"), _column(table, "term").dictionary_encode(), _column(table, "field").dictionary_encode()
            code = _numpy(pc.fill_null(terms.indices, len(terms.dictionary))).astype(np.int64)
            seqs, seq = np.unique(_numpy(_column(table, "seq")), return_inverse=True)
            kind = (_numpy(fields.indices).astype(np.int64) * 3 + _numpy(_column(table, "opens"))) * len(seqs) + seq
            kinds = [(f.as_py(), o, int(s)) for f in fields.dictionary for o in range(3) for s in seqs]
            order = np.lexsort((_numpy(pc.fill_null(keys, 0)), kind, code) if whole else (kind, code))
            tf, length, wide = (_numpy(_column(table, c))[order] for c in ("tf", "length", "wide"))
            code = code[order]
            of_code = np.bincount(code, weights=wide) > 0
            yield _blocks(keys.take(pa.array(order)), whole, code, kind[order], tf, length, pa.concat_arrays([terms.dictionary, pa.nulls(1, pa.string())]), kinds, of_code)

    return run


# ---------------------------------------------------------------- dealing


def _join(blocks: pa.Table) -> pa.RecordBatch:
    """Blocks in the order of term and kind; those that agree in both joined up to about
    ``BLOCK`` postings."""
    terms, fields = (_column(blocks, c).dictionary_encode() for c in ("term", "field"))
    order = _numpy(pc.array_sort_indices(terms.dictionary))
    rank = np.zeros(len(order) + 1, np.int64)
    rank[order] = np.arange(1, len(order) + 1)  # the last is for no term
    code = rank[_numpy(pc.fill_null(terms.indices, len(order))).astype(np.int64)]
    opens, seq, wide = (_numpy(_column(blocks, c)) for c in ("opens", "seq", "wide"))
    kind = (_numpy(fields.indices).astype(np.int64) * 3 + opens) * 2 + wide
    by = np.lexsort((seq, kind, code))
    blocks = blocks.take(pa.array(by)).combine_chunks()
    n = _numpy(_column(blocks, "n")).astype(np.int64)
    code, kind, seq, before = code[by], kind[by], seq[by], np.cumsum(n) - n
    run = _runs(code, kind, seq)
    place = (before - np.repeat(before[run], np.diff(np.append(run, len(n))))) // BLOCK
    starts = _runs(code, kind, seq, place)
    ends = np.append(starts, len(n))
    out = {c: _column(blocks, c).take(pa.array(starts)) for c in ("term", "field", "opens", "seq", "wide")}
    out["n"] = pa.array(np.add.reduceat(n, starts).astype(np.int32))
    offsets, data = _bytes(_column(blocks, "postings"))
    out["postings"] = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets[ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    if "keys" in blocks.column_names:
        keys = _column(blocks, "keys")
        out["keys"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n))[ends].astype(np.int32)), keys.flatten())
    return pa.RecordBatch.from_pydict(out)


def _hashes(values: pa.Array) -> np.ndarray:
    offsets, data = _bytes(values)
    data, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])], np.int64)


def _deal(parts: int) -> Callable:
    """Blocks by part, those of a part in one row, compressed."""

    def run(batches):
        for table in _chunks(batches, _row_bytes(["term", "postings"]), HELD):
            terms = _column(table, "term").dictionary_encode()
            hashes = np.append(_hashes(terms.dictionary), 0)[_numpy(pc.fill_null(terms.indices, len(terms.dictionary)))]
            wide = np.flatnonzero(_numpy(_column(table, "wide")))
            hashes[wide] += _hashes(_column(table, "postings").take(pa.array(wide)))
            part = hashes % parts
            by = np.argsort(part, kind="stable")
            table, part = table.take(pa.array(by)).combine_chunks(), part[by]
            table = table.set_column(1, "field", table.column("field").dictionary_encode())  # else its offsets take a tenth
            starts = _runs(part)
            for at, to in zip(starts, np.append(starts[1:], len(part))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(at, to - at))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part[at]], pa.int32()), "blocks": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return run


def _gather(batches):
    """Blocks of the rows that ``_deal`` made, by part, and by term in runs of about ``HELD``
    bytes."""
    held, size, last = [], 0, None

    def done():
        joined = _join(pa.concat_tables(held))
        for at in range(0, len(joined), 1 << 13):
            some = joined.slice(at, 1 << 13)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), last, np.int32)), *some.columns], ["part", *some.schema.names])

    for batch in batches:
        for part, blocks in zip(_numpy(batch.column("part")), batch.column("blocks")):
            if held and (part != last or size > HELD):
                yield from done()
                held, size = [], 0
            table, last = pa.ipc.open_stream(blocks.as_buffer()).read_all(), part
            table = table.set_column(1, "field", table.column("field").cast(pa.string()))
            held.append(table)
            size += table.nbytes
    if held:
        yield from done()


# ---------------------------------------------------------------- frames


def _texts(docs: DataFrame, key: str, key_type: str, fields: Mapping[str, Column]) -> DataFrame:
    """``key``, and each field as ``_words`` takes it: ASCII needs no patterns, as what is no
    letter or digit stands between words."""
    own = docs.select(F.col(key).cast(key_type).alias("key"), *(F.coalesce(c, F.lit("")).alias(f"_{i}") for i, c in enumerate(fields.values())))
    return own.select("key", *(F.concat(F.when(F.octet_length(t) == F.length(t), F.col(t)).otherwise(_plain(F.col(t))), F.lit(" ")).alias(t) for t in own.columns[1:]))


def pack_texts(docs: DataFrame, key: str, key_type: str, fields: Mapping[str, Column], seq: int, parts: int) -> DataFrame:
    """Blocks of the inverted index of ``docs``, by parts as ``gathered`` takes them.
    Each document is read once, and all words that ``text.tokens`` finds are counted."""
    pack, deal = _pack_texts(list(fields), seq, parts, key_type in WHOLE), _deal(parts)
    return _texts(docs, key, key_type, fields).mapInArrow(lambda batches: deal(pack(batches)), DEALT)


def pack_rows(rows: DataFrame, key: str, key_type: str, parts: int) -> DataFrame:
    """Blocks of some of the rows that ``unpack`` gives, by parts."""
    pack, deal = _pack_rows(key_type in WHOLE), _deal(parts)
    return rows.withColumnRenamed(key, "key").mapInArrow(lambda batches: deal(pack(batches)), DEALT)


def pack_blocks(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.mapInArrow(_deal(parts), DEALT)


def gathered(packed: DataFrame, key_type: str, parts: int) -> DataFrame:
    """``part`` and blocks, a part in one task, by term in large runs."""
    return packed.repartitionById(parts, "part").mapInArrow(_gather, f"part int, {block_schema(key_type)}")


_ROW = {"field": "string", "term": "string", "tf": "long", "length": "int", "opens": "int", "seq": "long", "wide": "boolean"}


def _unpack(key: str, whole: bool, key_type: pa.DataType | None, names: Sequence[str]) -> Callable:
    def run(batches):
        for batch in batches:
            for some in _cut(batch, _numpy(batch.column("n")).astype(np.int64), UNPACKED):
                n = _numpy(some.column("n")).astype(np.int64)
                numbers = decode(some.column("postings")).reshape(-1, 3)
                if whole:
                    above, flags = numbers[:, 0].copy(), numbers[:, 1].astype(np.uint8)
                    starts = np.flatnonzero(flags & 1)
                    first = above[starts]
                    first = (first >> np.uint64(1)) ^ (np.uint64(0) - (first & np.uint64(1)))
                    above[starts] = first
                    value = np.cumsum(above)  # of all runs, modulo 2^64
                    value -= np.repeat(value[starts] - first, np.diff(np.append(starts, len(value))))
                    null = (flags & 2) > 0
                    keys = pa.array(value.view(np.int64), mask=null if null.any() else None).cast(key_type)
                else:
                    keys = some.column("keys").flatten()
                at = pa.array(np.repeat(np.arange(len(n)), n))
                made = {"tf": lambda: pa.array((numbers[:, 1] >> np.uint64(2)).astype(np.int64)), "length": lambda: pa.array(numbers[:, 2].astype(np.int32))}  # noqa: B023
                yield pa.RecordBatch.from_arrays([keys, *(made[c]() if c in made else some.column(c).take(at) for c in names)], [key, *names])

    return run


def unpack(blocks: DataFrame, key: str, key_type: str, names: Sequence[str] = tuple(_ROW)) -> DataFrame:
    """A row for each posting of blocks: the key, and what is named."""
    whole = key_type in WHOLE
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}.get(key_type)
    needed = ["n", "postings", *(c for c in names if c not in ("tf", "length")), *([] if whole else ["keys"])]
    schema = ", ".join([f"`{key}` {key_type}", *(f"{c} {_ROW[c]}" for c in names)])
    return blocks.select(*needed).mapInArrow(_unpack(key, whole, arrow, list(names)), schema)
