"""Text search (section J): an inverted index as a table, BM25 and evidence scores."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.columns import yes
from strandwise.functions.lexicons import STOPWORDS, SYNONYMS

QUERY_TERMS = 6
K1, B = 1.2, 0.75


def _plain(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "'s\\b", "")
    return F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")


def tokens(text: Column) -> Column:
    """All words of a text, in order."""
    return F.filter(F.split(_plain(text), " "), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """Query terms: no stopwords, no single letters (but before "cell"), unique, six at most."""
    words = tokens(text)
    kept = F.filter(words, lambda w, i: ~w.isin(*STOPWORDS) & ((F.length(w) > 1) | yes(F.get(words, i + 1).startswith("cell"))))
    return F.slice(F.array_distinct(kept), 1, QUERY_TERMS)


def inverted_index(df: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """``key, field, term, tf, length, opens``: terms counted inside each row (all words
    of a document are in one), so nothing is shuffled. ``opens`` is 2 on one row of each
    document, 1 on one row of each of its other fields and 0 else: figures of documents
    and fields need no distinct. ``key`` must tell the rows apart."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.sort_array(tokens(c)).alias("words")) for f, c in fields.items()))
    full = F.filter("parts", lambda p: F.size(p["words"]) > 0)
    rows = df.select(key, parts.alias("parts")).select(key, F.posexplode(full).alias("rank", "p")).select(key, "rank", "p.field", "p.words", F.size("p.words").alias("length"))
    # equal words lie side by side: where each begins, and how far it is to the next
    begins = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    rows = rows.withColumn("begins", begins)
    terms = F.transform("begins", lambda at, i: F.struct(F.get("words", at).alias("term"), (F.coalesce(F.get("begins", i + 1), F.col("length")) - at).cast("long").alias("tf")))
    rows = rows.select(key, "rank", "field", "length", F.posexplode(terms).alias("place", "t"))
    opens = F.when(F.col("place") > 0, 0).when(F.col("rank") > 0, 1).otherwise(2)
    return rows.select(key, "field", "t.term", "t.tf", "length", opens.alias("opens"))


def postings(df: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """``key, field, term, tf, length`` of the inverted index."""
    return inverted_index(df, key, fields).drop("opens")


def bm25(index: DataFrame, key: str, terms: Sequence[str], weights: Mapping[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """``key, score``: BM25 over fields with weights, summed over terms.

    ``index`` is an ``inverted_index``, best a written one: corpus figures (documents,
    mean lengths, frequencies of the few terms asked) are small aggregates of it.
    """
    hit = index.where(F.col("term").isin(list(terms)))
    docs = index.where("opens = 2").agg(F.count("*").alias("n"))
    lengths = index.where("opens > 0").groupBy("field").agg(F.avg("length").alias("mean"))
    df_ = hit.groupBy("term").agg(F.countDistinct(key).alias("df"))
    rows = hit.join(df_, "term").join(lengths, "field").join(docs, F.lit(True))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    weight = F.lit(0.0)
    for f, w in weights.items():
        weight = F.when(F.col("field") == f, F.lit(float(w))).otherwise(weight)
    return rows.groupBy(key).agg(F.sum(F.round(weight * idf * norm, 6).cast("decimal(18,6)")).cast("double").alias("score"))


def variants(term: Column) -> Column:
    """A term with its plain plural and singular."""
    forms = F.array(
        term,
        F.when(term.endswith("ies"), F.regexp_replace(term, "ies$", "y")),
        F.when(term.endswith("s") & ~term.endswith("ss"), F.regexp_replace(term, "s$", "")),
        F.when(~term.endswith("s"), F.concat(term, F.lit("s"))),
    )
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))


def known_synonyms(terms: DataFrame) -> DataFrame:
    """``term, synonym`` of the terms that the fixed list of synonyms has."""
    table = F.create_map(*(x for term, words in SYNONYMS.items() for x in (F.lit(term), F.array(*map(F.lit, words)))))
    return terms.select("term", F.explode(F.element_at(table, F.col("term"))).alias("synonym")).where("synonym != term")


def expand_terms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``term, variant``: inflections and synonyms; the variants of a term are OR-ed."""
    own = terms.select("term", F.explode(variants(F.col("term"))).alias("variant"))
    more = terms.join(synonyms, "term").select("term", F.col("synonym").alias("variant"))
    return own.unionByName(more).distinct()


def prefix_match(index: DataFrame, key: str, term: str) -> DataFrame:
    """Documents with a term that starts with this one, when it is long enough and not a
    number; else with the term itself."""
    hit = F.col("term").startswith(term) if len(term) >= 4 and not term.isdigit() else F.col("term") == term
    return index.where(hit).select(key).distinct()


def and_or_search(index: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """``key, matched, any_only``: documents with all terms; if there are none and two or
    more terms, documents with any, flagged."""
    wanted = sorted(set(terms))
    counts = index.where(F.col("term").isin(wanted)).groupBy(key).agg(F.countDistinct("term").alias("matched"))
    full = counts.agg(F.coalesce(F.max("matched"), F.lit(0)).alias("_best"))
    rows = counts.join(full, F.lit(True))
    every = F.col("matched") == len(wanted)
    return rows.where(every | (F.col("_best") < len(wanted)) & F.lit(len(wanted) > 1)).select(key, "matched", (~every).alias("any_only"))


def hybrid_score(own: DataFrame, children: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``key, score``: 3 x own + best child + 2 x the matching share of children (scores
    grow with relevance here). ``children``: key, score, one row per child that matches."""
    kids = children.groupBy(key).agg(F.max("score").alias("_best"), F.count("*").alias("_n"))
    rows = own.withColumnRenamed("score", "_own").join(kids, key, "full_outer").join(sizes, key, "left")
    share = F.coalesce(F.col("_n") / F.greatest(F.col("size"), F.lit(1)), F.lit(0.0))
    score = 3 * F.coalesce("_own", F.lit(0.0)) + F.coalesce("_best", F.lit(0.0)) + 2 * share
    return rows.select(key, F.round(score, 4).alias("score"))


def sample_hybrid(child: DataFrame, parent: DataFrame, links: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children hit directly or through their parent: own score + half the parent's."""
    own = child.select(child_key, F.col("score").alias("_c"))
    up = parent.select(parent_key, F.col("score").alias("_p"))
    rows = links.select(child_key, parent_key).join(own, child_key, "left").join(up, parent_key, "left").where("_c is not null or _p is not null")
    return rows.select(child_key, F.round(F.coalesce("_c", F.lit(0.0)) + 0.5 * F.coalesce("_p", F.lit(0.0)), 6).alias("score"))


def soft_candidates(df: DataFrame, key: str, hard: Column, signals: Sequence[tuple[float, Column]], most: int = 200) -> DataFrame:
    """Rows that pass the hard filter and meet any signal, by evidence."""
    evidence = sum((F.when(yes(c), F.lit(w)).otherwise(0.0) for w, c in signals), F.lit(0.0))
    return df.where(yes(hard)).select(key, evidence.alias("evidence")).where("evidence > 0").orderBy(F.desc("evidence"), key).limit(most)


def evidence_score(
    df: DataFrame, key: str, facets: Mapping[str, tuple[float, Sequence[str]]], text: Mapping[str, Column], keywords: Sequence[str], has_file: Column, n_samples: Column, year: Column
) -> DataFrame:
    """``key, score, full, evidence``.

    ``facets``: array column -> (weight, wanted). A facet without annotation that the
    text mentions gives 1.5; keywords give 1.5 in the title and 1 in the body, 4 at most;
    a file, its size and a recent year add to it. ``evidence`` names hit, partial or miss
    per facet. ``full``: nothing wanted is missing.
    """
    title, body = F.lower(text["title"]), F.lower(text["body"])
    score, full, notes = F.lit(0.0), F.lit(True), []
    for name, (weight, wanted) in facets.items():
        have = F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.lower(x))
        hits = F.size(F.array_intersect(have, F.array(*(F.lit(w.lower()) for w in wanted))))
        mention = F.lit(False)
        for w in wanted:
            mention = mention | title.contains(w.lower()) | body.contains(w.lower())
        partial = (F.size(have) == 0) & mention
        score = score + F.when(hits > 0, F.lit(float(weight)) * hits / len(wanted)).when(partial, 1.5).otherwise(0.0)
        full = full & ((hits > 0) | partial)
        notes.append(F.concat(F.lit(f"{name}="), F.when(hits > 0, "hit").when(partial, "partial").otherwise("miss")))
    words = F.lit(0.0)
    for k in keywords:
        in_title, in_body = title.contains(k.lower()), body.contains(k.lower())
        words = words + F.when(in_title, 1.5).otherwise(0.0) + F.when(in_body, 1.0).otherwise(0.0)
        full = full & (in_title | in_body)
    score = score + F.least(words, F.lit(4.0)) + F.when(yes(has_file), 0.5).otherwise(0.0)
    score = score + F.coalesce(F.log10(n_samples + 1) * 0.3, F.lit(0.0)) + F.when(yes(year >= 2020), 0.2).otherwise(0.0)
    return df.select(key, F.round(score, 3).alias("score"), full.alias("full"), F.concat_ws(";", *notes).alias("evidence"))


def child_evidence(studies: DataFrame, key: str, total: str, cells: Sequence[str], held: DataFrame, terms: Sequence[str], matches: DataFrame, titles: Sequence[str] = ("title",), bodies: Sequence[str] = ("body",)) -> DataFrame:
    """``key, cell_score, word_score, full``: what a study's children add to its evidence.

    ``held`` (``key, value, n``): children of each asked cell type; one that is held gives
    1 + 2 x its share of the ``total`` children. ``matches`` (``key, term, field, n``, as
    ``match_counts`` gives them, also for variants of the terms): a term gives 1.5 in a
    title field, 1 in a body field, and 0.5 x the largest share of children of any other
    field; all terms give 4 at most. ``full``: every cell type is held or named in title or
    body, and every term is met. A term's plain plural and singular count as the term.
    """
    asked = studies.sparkSession.createDataFrame([("cell", c) for c in cells] + [("word", t) for t in terms], "kind string, asked string")
    forms = asked.select("kind", "asked", F.explode(variants(F.col("asked"))).alias("term"))
    in_, most = (lambda names: F.col("field").isin(list(names))), lambda c: F.max(F.coalesce(c, F.lit(0)))
    met = matches.join(F.broadcast(forms), "term").select(  # as many rows as were asked
        key, "kind", "asked", in_(titles).cast("int").alias("title"), in_(bodies).cast("int").alias("body"),
        F.when(~in_([*titles, *bodies]), F.col("n")).otherwise(0).cast("long").alias("children"), F.lit(0).cast("long").alias("held"),
    )
    own = held.where(F.col("value").isin(list(cells))).select(key, F.lit("cell").alias("kind"), F.col("value").alias("asked"), F.lit(0).alias("title"), F.lit(0).alias("body"), F.lit(0).cast("long").alias("children"), F.col("n").cast("long").alias("held"))
    rows = met.unionByName(own).groupBy(key, "kind", "asked").agg(*(most(F.col(c)).alias(c) for c in ("title", "body", "children", "held")))
    rows = rows.join(studies.select(key, F.greatest(F.col(total), F.lit(1)).alias("_total")), key)
    share = lambda c: F.least(F.lit(1.0), F.col(c) / F.col("_total"))
    cell, word = F.col("kind") == "cell", F.col("kind") == "word"
    cell_score = F.when(cell & (F.col("held") > 0), 1 + 2 * share("held")).otherwise(0.0)
    word_score = F.when(word, 1.5 * F.col("title") + F.col("body") + 0.5 * share("children")).otherwise(0.0)
    there = F.when(cell, (F.col("held") > 0) | (F.col("title") + F.col("body") > 0)).otherwise(F.col("title") + F.col("body") + F.col("children") > 0)
    sums = rows.groupBy(key).agg(F.sum(F.round(cell_score, 6)).alias("cell_score"), F.sum(F.round(word_score, 6)).alias("word_score"), F.count_if(there).alias("_there"))
    out = studies.select(key).join(sums, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(key, F.round(zero(F.col("cell_score")), 4).alias("cell_score"), F.round(F.least(zero(F.col("word_score")), F.lit(4.0)), 4).alias("word_score"), (zero(F.col("_there")) == len(cells) + len(terms)).alias("full"))


def relevance_cut(scored: DataFrame) -> DataFrame:
    """Full matches, or scores of at least max(2, 0.35 x the best)."""
    top = scored.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_top"))
    return scored.join(top, F.lit(True)).where(F.col("full") | (F.col("score") >= F.greatest(F.lit(2.0), 0.35 * F.col("_top")))).drop("_top")


def match_counts(children: DataFrame, key: str, terms: Sequence[str], fields: Sequence[str], short: int = 3) -> DataFrame:
    """``key, term, field, n``: child rows per term and field; short terms need whole words."""
    options = []
    for term in terms:
        for field in fields:
            low = F.lower(F.coalesce(F.col(field), F.lit("")))
            literal = re.sub(r"([^a-z0-9])", r"\\\1", term)  # a term is text, not a pattern
            hit = low.rlike(rf"(^|[^a-z0-9]){literal}([^a-z0-9]|$)") if len(term) <= short else low.contains(term)
            options.append(F.struct(F.lit(term).alias("term"), F.lit(field).alias("field"), hit.alias("hit")))
    rows = children.select(key, F.explode(F.array(*options)).alias("o")).where("o.hit")
    return rows.groupBy(key, "o.term", "o.field").agg(F.count("*").alias("n"))


def filter_matches(df: DataFrame, key: str, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """``key, field, value``: which asked values a row holds (array columns)."""
    options = [F.struct(F.lit(f).alias("field"), F.array_intersect(F.col(f), F.array(*map(F.lit, v))).alias("values")) for f, v in wanted.items()]
    return df.select(key, F.explode(F.array(*options)).alias("o")).select(key, "o.field", F.explode("o.values").alias("value"))


def unclassified(df: DataFrame, key: str, group: Column, fields: Mapping[str, Column], words: Sequence[str], around: int = 50) -> DataFrame:
    """``key, field, snippet, place``: rows without a group whose text names it, by the
    first field that does, with the text around the first mention."""
    pattern = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(words) + ")"
    found = None
    for rank, (name, text) in enumerate(fields.items()):
        at = F.when(text.rlike(pattern), F.length(F.split(text, pattern, 2)[0]) + 1)
        cut = F.substring(text, F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + around)
        item = F.when(at.isNotNull(), F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("field"), cut.alias("snippet")))
        found = item if found is None else F.coalesce(found, item)
    rows = df.where(group.isNull()).select(key, found.alias("f")).where("f is not null")
    return rows.select(key, "f.rank", "f.field", "f.snippet")


def unmapped_count(df: DataFrame, group: Column, by: str) -> DataFrame:
    return df.where(group.isNull()).groupBy(by).agg(F.count("*").alias("n"))
