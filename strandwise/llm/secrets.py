"""Secret scans with DataFrame functions only.

Base kinds are patterns. The fourth kind, ``random``, comes from a battery of randomness
tests over candidate tokens (runs of encoding letters):

* the encoding is inferred from the letters used (hex, base32, base36 or base64) and from
  how many of them are capitals, small letters and digits: a token whose mix would be
  rarer than one in a thousand in an encoding is not in that encoding. Identifiers,
  paths, words and numbers mostly end here;
* chi-squared against equal frequencies of the encoding's letters (Wilson-Hilferty
  gives the p-value);
* runs test above and below the middle of the alphabet, two-sided;
* serial correlation of neighbours, two-sided;
* of the three p-values the smallest, m, gives 1 - (1 - m)^3, which is uniform for
  random strings.

How often a string that is not random passes depends on its length. So the cut is set per
encoding and length band over the whole corpus, from two things: p-values of random
strings are uniform, and how often strings that are not random pass is seen on all
different letter tokens of the corpus, which hold no encoding. Both give how many tokens
of a band are random and how many others lie above a cut; the lowest cut is chosen at
which the share of others stays within ``fdr``. Sparse bands are pooled with their
neighbours; where these are sparse too, the cut is the lowest that at most ``fdr`` of the
letter tokens pass. Bands are a fixed small number, so the table of cuts has a fixed size.

Limits of the method: tokens under 8 letters, tokens of digits alone and tokens of small
or of capital letters alone are never ``random``, as words and numbers look the same.

Scale: texts are scanned once, and never shuffled; letter tokens are reduced to different
ones before and after one shuffle. What is written in between is places, alphabets and
p-values, never the text of a match. Spans are code points, end exclusive.

Edge cases: a null or empty text has no spans (digest of nothing); repeated rows stay
separate; an empty table gives an empty result; other columns are ignored; very long
texts take time in proportion to their matches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Each run of these letters is taken whole, so asking for the length in the pattern
# finds the same spans as dropping short ones afterwards.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_MIN = 8
#: With a digit somewhere, or a capital behind the first letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Za-z+/_-][a-z+/_-]*+[A-Z])[A-Za-z0-9+/_-]{8,}"
PLAIN = r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]{8,}+(?![0-9])"
#: Chi-squared values that one in a thousand exceeds, with one and two degrees of freedom.
RARE = {1: 10.83, 2: 13.82}
#: Matches of a text that are placed together.
STEP = 64
KINDS = ("assign", "access", "hex", "random")
FDR = 0.1
BINS = 20
LONGEST_BAND = 16
SIZES = (16, 32, 36, 64)
#: Fewer tokens than these do not make a cut of their own.
FEW = 50


_SPAN = "struct<start:int,stop:int,match:string>"


def _spans(text: Column, pattern: str, keep) -> Column:
    """Array of (start, stop, match): places follow from the gaps between matches.

    ``keep(match)`` says which stay. Texts without a match cost one scan; others are
    placed ``STEP`` matches at a time, as an array grows by copying.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), m.alias("match")))
    none = F.array().cast(f"array<{_SPAN}>")

    def place(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["gap"]
        stop = start + F.length(piece["match"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), piece["match"].alias("match")))).alias("out"))

    def place_all(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), place)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def placed(pieces: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(pieces), F.lit(STEP))
        chunks = F.transform(starts, lambda i: F.slice(pieces, i, F.lit(STEP)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        return F.flatten(F.aggregate(chunks, zero, place_all, lambda acc: acc["out"]))

    some = _let(pieces, lambda p: F.when(F.size(p) == 0, none).otherwise(placed(p)))
    return F.filter(some, lambda s: keep(s["match"]))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also inside of other lambdas."""
    return F.transform(F.array(value), use)[0]


def _upper_tail(value: Column) -> Column:
    """P(Z > z) of a standard normal, by a published rational approximation (1e-7)."""

    def of(z: Column) -> Column:
        poly = _let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
        return _let(tail, lambda x: F.when(z >= 0, x).otherwise(1 - x))

    return _let(value, of)


def _count(token: Column, letters: str) -> Column:
    return F.length(token) - F.length(F.translate(token, letters, ""))


def encoding_of(token: Column) -> Column:
    """Size of the inferred alphabet: 16, 32, 36 or 64; null where the token's mix of
    letters fits no encoding."""
    n = F.length(token)
    digits, upper, lower = _count(token, "0123456789"), _count(token, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _count(token, "abcdefghijklmnopqrstuvwxyz")

    def far(*parts: tuple[Column, int, int]) -> Column:
        """Chi-squared of (count, letters of this kind, letters in all)."""
        out = F.lit(0.0)
        for count, kind, every in parts:
            expected = n * (kind / every)
            out = out + (count - expected) * (count - expected) / expected
        return out

    letters = n - digits
    fits = (
        F.when(_size_is(token, 16), far((digits, 10, 16), (letters, 6, 16)) <= RARE[1])
        .when(_size_is(token, 32), far((digits, 6, 32), (letters, 26, 32)) <= RARE[1])
        .when(_size_is(token, 36), far((digits, 10, 36), (letters, 26, 36)) <= RARE[1])
        .otherwise(far((upper, 26, 64), (lower, 26, 64), (n - upper - lower, 12, 64)) <= RARE[2])
    )
    mixed = (digits > 0) & (letters > 0) | (upper > 0) & (lower > 0)
    return F.when(mixed & fits, _alphabet(token))


_ALPHABETS = {16: "^([0-9a-f]+|[0-9A-F]+)$", 32: "^[A-Z2-7]+$", 36: "^([a-z0-9]+|[A-Z0-9]+)$"}


def _size_is(token: Column, size: int) -> Column:
    return token.rlike(_ALPHABETS[size])


def _alphabet(token: Column) -> Column:
    return F.when(_size_is(token, 16), 16).when(_size_is(token, 32), 32).when(_size_is(token, 36), 36).otherwise(64)


def _codes(token: Column, size: Column) -> Column:
    """Each letter's number in its alphabet (letters before digits, except hex)."""
    letter = F.lower(token)
    hexes = F.transform(F.split(letter, ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    lowers = F.transform(F.split(letter, ""), lambda c: F.instr(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), c) - 1)
    threes = F.transform(F.split(letter, ""), lambda c: F.instr(F.lit("abcdefghijklmnopqrstuvwxyz234567"), c) - 1)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    wide = F.transform(F.split(F.translate(token, "-_", "+/"), ""), lambda c: F.instr(F.lit(base64), c) - 1)
    return F.when(size == 16, hexes).when(size == 32, threes).when(size == 36, lowers).otherwise(wide)


def randomness_p(codes: Column, size: Column) -> Column:
    """Combined p-value of the battery: small for what is not random."""
    n = F.size(codes).cast("double")
    counts = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda x: x == c)).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x) * size / n - n
    df = (size - 1).cast("double")
    p_chi = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    def runs_p(high: Column) -> Column:
        following = F.slice(high, 2, F.size(high) - 1)
        changes = F.aggregate(F.zip_with(high, following, lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0))), F.lit(0), lambda a, x: a + x)

        def of(ones: Column) -> Column:
            mean = 2 * ones * (n - ones) / n + 1
            return _let(mean, lambda m: _let((m - 1) * (m - 2) / (n - 1), lambda var: F.when(var > 0, 2 * _upper_tail(F.abs(changes + 1 - m) / F.sqrt(var))).otherwise(0.0)))

        return _let(F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double"), of)

    def serial_p(dev: Column) -> Column:
        square = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x)
        cross = F.aggregate(F.zip_with(dev, F.slice(dev, 2, F.size(dev) - 1), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        return _let(square, lambda q: F.when(q > 0, 2 * _upper_tail(F.abs(cross / q + 1 / n) * F.sqrt(n))).otherwise(0.0))

    p_runs = _let(F.transform(codes, lambda c: (2 * c >= size).cast("int")), runs_p)
    centre = _mean(F.transform(codes, lambda c: c.cast("double")))
    p_serial = _let(_let(centre, lambda m: F.transform(codes, lambda c: c - m)), serial_p)
    least = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(p_chi, p_runs, p_serial)))
    return 1 - F.pow(1 - least, 3)


def _tested(spans: Column, size=encoding_of) -> Column:
    """Candidates with their alphabet, length band and p-value."""
    sized = F.filter(F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["match"], size(s["match"]).alias("size"))), lambda s: s["size"].isNotNull())
    coded = F.transform(sized, lambda s: F.struct(s["start"], s["stop"], s["size"], _codes(s["match"], s["size"]).alias("codes")))
    return F.transform(
        coded,
        lambda s: F.struct(
            s["start"],
            s["stop"],
            s["size"],
            F.least(F.floor((s["stop"] - s["start"]) / 8).cast("int"), F.lit(LONGEST_BAND)).alias("band"),
            randomness_p(s["codes"], s["size"]).alias("p"),
        ),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, an array of (start, stop) per base kind, and the tested candidates."""
    text = text_of()
    rows = docs.select(
        "doc_id",
        _spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_MIN).alias("assign"),
        _spans(text, ACCESS, lambda m: F.lit(True)).alias("access"),
        _spans(text, HEX, lambda m: F.lit(True)).alias("hex"),
        _spans(text, CANDIDATE, lambda m: F.lit(True)).alias("candidates"),
    )
    places = {kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))) for kind in KINDS[:3]}
    return rows.withColumns(places | {"candidates": F.when(F.size("candidates") > 0, _tested(F.col("candidates")))})


def letter_tokens(docs: DataFrame) -> DataFrame:
    """``c`` (alphabet, length band and p-value) of each different letter token."""
    tokens = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text_of(), F.lit(PLAIN), F.lit(0)))).alias("token")).distinct()
    span = F.struct(F.lit(0).alias("start"), F.length("token").alias("stop"), F.col("token").alias("match"))
    return tokens.select(F.explode(_tested(F.array(span), _alphabet)).alias("c"))


def _bins(tested: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Tokens per p-value bin, by alphabet and band (at most 4 x 17 x ``BINS`` rows)."""
    rows = tested.select("c.size", "c.band", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in rows.groupBy("size", "band", "bin").agg(F.count("*").alias("n")).collect():
        out.setdefault((r["size"], r["band"]), np.zeros(BINS))[r["bin"]] += r["n"]
    return out


def _pooled(table: dict[tuple[int, int], np.ndarray], size: int, band: int, reach: int) -> np.ndarray:
    """A band's bins, with neighbours up to ``reach`` away while they hold few tokens."""
    for far in range(reach + 1):
        out = sum((table.get((size, b), np.zeros(BINS)) for b in range(band - far, band + far + 1)), np.zeros(BINS))
        if out.sum() >= FEW:
            break
    return out


def _at_least(bins: np.ndarray) -> np.ndarray:
    return np.cumsum(bins[::-1])[::-1]


def cut_of(found: np.ndarray, plain: np.ndarray, fdr: float) -> float | None:
    """Lowest p-value to accept, from the bins of candidates and of tokens that are not
    random; none where no cut keeps the share of the latter within ``fdr``."""
    passing = _at_least(plain) / plain.sum() if plain.sum() else np.zeros(BINS)
    passing[0] = 1.0
    if found.sum() < FEW:
        good = passing <= fdr
    else:
        above, half = _at_least(found), BINS // 2
        random = np.clip((above[half] - above[0] * passing[half]) / (0.5 - passing[half]), 0, above[0]) if passing[half] < 0.5 else 0.0
        good = (above > 0) & ((above[0] - random) * passing <= fdr * above)
    return float(np.argmax(good)) / BINS if good.any() else None


def cuts(candidates: DataFrame, letters: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], float | None]:
    """Lowest accepted p-value per alphabet and length band (4 x 17 entries)."""
    found, plain = _bins(candidates), _bins(letters)
    every = sum(plain.values(), np.zeros(BINS))

    def null(size: int, band: int) -> np.ndarray:
        near = _pooled(plain, size, band, LONGEST_BAND)
        return near if near.sum() >= FEW else every

    return {(s, b): cut_of(_pooled(found, s, b, 1), null(s, b), fdr) for s in SIZES for b in range(LONGEST_BAND + 1)}


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (start, kind, stop)
    in order; ``kind`` is a place in ``KINDS``."""
    scanned = stage(scan(docs), "secrets")
    found = cuts(scanned.select(F.explode("candidates").alias("c")), letter_tokens(docs), fdr)
    # 4 x 17 entries, as one map
    table = F.create_map(*(F.lit(x) for (size, band), cut in found.items() for x in (size * 100 + band, 2.0 if cut is None else cut)))

    def of(column: str, kind: int) -> Column:
        return F.transform(F.col(column), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))

    passed = F.filter(F.col("candidates"), lambda c: c["p"] >= F.coalesce(F.element_at(F.col("cuts"), c["size"] * 100 + c["band"]), F.lit(2.0)))
    rows = scanned.withColumn("cuts", table).withColumn("random", passed)
    added = F.coalesce(of("random", 3), F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    base = F.concat(of("assign", 0), of("access", 1), of("hex", 2))
    return rows.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, added)).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
