"""Exact byte-level BPE encoding and decoding.

Each pre-token's bytes are mapped to Latin-1 characters (one per byte), so that the
vocabulary becomes an Aho-Corasick automaton over strings. Encoding takes the longest
token at each place and backtracks: a token may follow another only if the two stay
apart when their bytes are merged by rank. That compatibility is memoised per pair of
tokens, and a bit per byte position remembers dead ends, so the work is linear in the
bytes; the result is the merge-by-rank result, not the greedy one.

Every task encodes its own rows: there is no shuffle. A text is cut before a space that
a non-space follows, and around a line end between non-spaces; the pattern never joins
across such a place, so the words between can be memoised by content. The memos are
bounded.

Edge cases: a null or empty text has no tokens (both digests are of nothing); repeated
rows and other columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words that a worker keeps in each memo.
_MEMO = 500_000


class BytePairEncoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pieces = {b: a for a, b in self.ranks.items()}
        self.lengths = {b: len(a) for a, b in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for piece, rank in self.ranks.items():
            self.automaton.add_word(piece.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._apart: dict[int, bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int | None] = {}
        self._plain, self._spaced = _Memo(self, ""), _Memo(self, " ")
        self._line_end = f" {self.ranks[bytes([10])]} "
        self._bytes_of = {str(b): a for a, b in self.ranks.items()}
        self._words: dict[str, list[int]] = {}

    # -- compatibility of neighbours

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._split:
            piece = self.pieces[token]
            self._split[token] = None if len(piece) == 1 else self._last_merge(piece, token)
        return self._split[token]

    def _last_merge(self, piece: bytes, rank: int) -> tuple[int, int] | None:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            best, at = min(((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these neighbours as they are (memoised)."""
        key = left << 20 | right
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > 1_000_000:
                self._apart.clear()
            found = self._apart[key] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undoes the merges beside the boundary, latest first, and looks for a merge
        across it that would have come earlier than the merge just undone."""
        ranks, pieces = self.ranks, self.pieces
        limit = len(ranks) + 1
        while True:
            across = ranks.get(pieces[left] + pieces[right])
            if across is not None and across < limit:
                return False
            in_left, in_right = self._parts(left), self._parts(right)
            if in_left is not None and (left > right or in_right is None):
                limit, left = left, in_left[1]
            elif in_right is not None:
                limit, right = right + 1, in_right[0]
            else:
                return True

    # -- encoding

    def _next_shorter(self, token: int) -> int | None:
        """The longest other token that starts this one."""
        if token not in self._shorter:
            piece = self.pieces[token]
            self._shorter[token] = next((self.ranks[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ranks), None)
        return self._shorter[token]

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens of one pre-token (memoised while it is short)."""
        found = self._words.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            found = [whole] if whole is not None else self._backtrack(data.decode("latin-1"))
            if len(piece) < 32 and len(self._words) < _MEMO // 2:
                self._words[piece] = found
        return found

    def _backtrack(self, text: str) -> list[int]:
        end = len(text)
        dead = bytearray(end + 1)
        lengths, longest, compatible, shorter_of = self.lengths, self.automaton.iter_long, self._compatible, self._next_shorter
        tokens: list[int] = []
        at = 0
        token: int | None = next(longest(text))[1]
        while True:
            stop = at + lengths[token]
            if not dead[stop] and (not tokens or compatible(tokens[-1], token)):
                tokens.append(token)
                if stop == end:
                    return tokens
                at = stop
                token = next(longest(text, at))[1]
                continue
            token = shorter_of(token)
            while token is None:  # no token fits here: a dead end
                dead[at] = 1
                last = tokens.pop()
                at -= lengths[last]
                token = shorter_of(last)

    def encode(self, text: str) -> list[int]:
        return [t for chunk in chunks(text) for piece in self.pattern.findall(chunk) for t in self.encode_piece(piece)]

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, tokens))

    def id_text(self, text: str) -> str:
        """Decimal ids joined by one space. The usual text, words set apart by single
        spaces and line ends, goes word by word through the memos."""
        if not text:
            return ""
        plain, spaced = self._plain.__getitem__, self._spaced.__getitem__
        try:
            lines = []
            for line in text.split("\n"):
                words = line.split(" ")
                words[0] = plain(words[0])
                words[1:] = map(spaced, words[1:])
                lines.append(" ".join(words))
            return self._line_end.join(lines)
        except _OtherSpace:
            return " ".join(map(str, self.encode(text)))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids, digest of the bytes decoded from the ids."""
        ids = self.id_text(text)
        decoded = hashlib.sha256(b"".join(map(self._bytes_of.__getitem__, ids.split(" "))) if ids else b"")
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), decoded.hexdigest()


class _OtherSpace(Exception):
    """A word that touches other white space than one space or one line end."""


class _Memo(dict):
    """Ids of a word by its text, worked out on first sight; it keeps the first
    ``_MEMO`` words it meets, which holds nearly all frequent ones."""

    def __init__(self, bpe: BytePairEncoder, before: str):
        super().__init__()
        self.bpe, self.before = bpe, before

    def __missing__(self, word: str) -> str:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _OtherSpace
        bpe, head, last = self.bpe, word[:-1], word[-1]
        if word.isalpha():
            ids = bpe.encode_piece(self.before + word)
        elif last in ",." and head.isalpha():
            ids = bpe.encode_piece(self.before + head) + bpe.encode_piece(last)
        else:
            ids = [t for piece in bpe.pattern.findall(self.before + word) for t in bpe.encode_piece(piece)]
        found = " ".join(map(str, ids))
        if len(self) < _MEMO and len(word) < 64:
            self[word] = found
        return found


def chunks(text: str) -> list[str]:
    """Cuts before every space that a non-space follows."""
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


_MADE: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder per worker process."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = BytePairEncoder(path, pattern)
    return _MADE[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [bpe.digest(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found]), pa.array([x[2] for x in found])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id`` and the array ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [bpe.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Inverse of ``token_ids``: ``doc_id`` and the bytes; a null list decodes to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            out = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
