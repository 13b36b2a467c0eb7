"""Queries of section J over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.functions.staging import stage
from strandwise.operators import text as J

from .registry import Tables, query


def title():
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", 2)[0]


def body():
    return F.coalesce(F.get(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", 2), F.lit(1)), F.lit(""))


_D = "(SELECT *, split_part(text, chr(10), 1) AS title, CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS body FROM documents)"
_TOK = r"list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '''s\b', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def tok(c):
    return _TOK.replace("{c}", c)


def index(t: Tables):
    return J.inverted_index(t.documents, "doc_id", {"title": title(), "body": body()})


_INDEX = f"""p AS (SELECT doc_id, field, unnest(ws) AS term, len(ws) AS length FROM (SELECT doc_id, 'title' AS field, {tok('title')} AS ws FROM {_D} UNION ALL SELECT doc_id, 'body', {tok('body')} FROM {_D})),
i AS (SELECT doc_id, field, term, count(*) AS tf, any_value(length) AS length FROM p GROUP BY doc_id, field, term)"""


@query("tokenize", f"""
WITH w AS (SELECT item_id, {tok("'the T cell ' || text")} AS ws FROM benchmark),
k AS (SELECT item_id, unnest(ws) AS w, unnest(list_concat(ws[2:], [''])) AS nx, unnest(range(len(ws))) AS i FROM w),
f AS (SELECT item_id, w, min(i) AS i FROM k WHERE NOT w IN ({', '.join(f"'{s}'" for s in J.STOPWORDS)}) AND (length(w) > 1 OR nx LIKE 'cell%') GROUP BY item_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM f)
SELECT item_id, string_agg(w, ' ' ORDER BY r) AS terms FROM r WHERE r <= 6 GROUP BY 1""")
def _(t):
    return t.benchmark.select("item_id", F.array_join(J.tokenize(F.concat(F.lit("the T cell "), "text")), " ").alias("terms"))


@query("postings", f"WITH {_INDEX} SELECT doc_id, field, term, tf, length FROM i")
def _(t):
    return J.postings(t.documents, "doc_id", {"title": title(), "body": body()})


TERMS = ["the", "que", "idiot", "chung"]
_BM = f"""WITH {_INDEX}, n AS (SELECT count(DISTINCT doc_id) AS n FROM i), l AS (SELECT field, avg(length) AS mean FROM (SELECT DISTINCT doc_id, field, length FROM i) GROUP BY 1),
h AS (SELECT * FROM i WHERE term IN ('the', 'que', 'idiot', 'chung')), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM h GROUP BY 1),
bm AS (SELECT doc_id, sum(round((CASE field WHEN 'title' THEN 3.0::double ELSE 1.0 END) * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2::double / (tf + 1.2::double * (0.25 + 0.75 * length / mean))), 6)::decimal(18,6))::double AS score FROM h JOIN d USING (term) JOIN l USING (field), n GROUP BY 1)"""


def scores(t: Tables):
    return J.bm25(stage(index(t), "index"), "doc_id", TERMS, {"title": 3.0, "body": 1.0})


@query("bm25", f"{_BM} SELECT doc_id, round(score, 4) AS score FROM bm")
def _(t):
    return scores(t).withColumn("score", F.round("score", 4))


SYNONYMS = [("idiot", "moron"), ("idiot", "clown"), ("trash", "scum")]


@query("expand_terms", f"""
WITH w AS (SELECT DISTINCT unnest({tok('text')}) AS term FROM documents),
s AS (SELECT * FROM (VALUES ('idiot', 'moron'), ('idiot', 'clown'), ('trash', 'scum')) s(term, variant))
SELECT term, term AS variant FROM w UNION SELECT term, regexp_replace(term, 'ies$', 'y') FROM w WHERE term LIKE '%ies' UNION SELECT term, regexp_replace(term, 's$', '') FROM w WHERE term LIKE '%s' AND term NOT LIKE '%ss'
UNION SELECT term, term || 's' FROM w WHERE term NOT LIKE '%s' UNION SELECT w.term, variant FROM w JOIN s USING (term)""")
def _(t):
    terms = t.documents.select(F.explode(J.tokens(F.col("text"))).alias("term")).distinct()
    return J.expand_terms(terms, t.spark.createDataFrame(SYNONYMS, "term string, synonym string"))


@query("known_synonyms", """
WITH w AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tumor' WHEN 1 THEN 'old' WHEN 2 THEN p_name ELSE 'pdx' END AS term FROM part)
SELECT p_partkey, term, unnest(CASE term WHEN 'tumor' THEN ['tumour', 'tumors', 'tumours'] WHEN 'old' THEN ['aged', 'aging', 'ageing'] WHEN 'pdx' THEN ['xenograft'] ELSE [] END) AS synonym FROM w""")
def _(t):
    k = F.col("p_partkey") % 4
    rows = t.part.select("p_partkey", F.when(k == 0, "tumor").when(k == 1, "old").when(k == 2, F.col("p_name")).otherwise("pdx").alias("term"))
    return rows.join(J.known_synonyms(rows.select("term").distinct()), "term").select("p_partkey", "term", "synonym")


@query("expanded_hits", f"WITH {_INDEX} SELECT DISTINCT doc_id FROM i WHERE term IN ('idiot', 'idiots', 'moron', 'clown')")
def _(t):
    terms = J.expand_terms(t.spark.createDataFrame([("idiot",)], "term string"), t.spark.createDataFrame(SYNONYMS, "term string, synonym string"))
    return index(t).join(terms.select(F.col("variant").alias("term")), "term", "left_semi").select("doc_id").distinct()


@query("prefix_match", f"WITH {_INDEX} SELECT DISTINCT doc_id FROM i WHERE term LIKE 'idio%'")
def _(t):
    return J.prefix_match(index(t), "doc_id", "idio")


@query("and_or_search", f"""
WITH {_INDEX}, c AS (SELECT doc_id, count(DISTINCT term) AS matched FROM i WHERE term IN ('idiot', 'zzzz') GROUP BY 1)
SELECT doc_id, matched, matched < 2 AS any_only FROM c WHERE matched = 2 OR (SELECT max(matched) FROM c) < 2""")
def _(t):
    return J.and_or_search(index(t), "doc_id", ["idiot", "zzzz"])


_KIDS = f"""k AS (SELECT conv_id AS doc_id, turn, (length(text) % 50) / 10.0::double AS score FROM conversations WHERE text LIKE '%que%'), s AS (SELECT conv_id AS doc_id, count(*) AS size FROM conversations GROUP BY 1)"""


def kids(t: Tables):
    return t.conversations.where("text like '%que%'").select(F.col("conv_id").alias("doc_id"), "turn", ((F.length("text") % 50) / 10.0).alias("score"))


@query("hybrid_score", f"""
{_BM}, {_KIDS}, g AS (SELECT doc_id, max(score) AS best, count(*) AS n FROM k GROUP BY 1)
SELECT doc_id, round(3 * coalesce(round(bm.score, 4), 0) + coalesce(best, 0) + 2 * coalesce(n / greatest(size, 1), 0), 4) AS score FROM bm FULL JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)""")
def _(t):
    sizes = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("size"))
    return J.hybrid_score(scores(t).withColumn("score", F.round("score", 4)), kids(t).select("doc_id", "score"), "doc_id", sizes)


@query("sample_hybrid", f"""
{_BM}, {_KIDS}
SELECT c.conv_id || ':' || c.turn AS child, round(coalesce(k.score, 0) + 0.5 * coalesce(round(bm.score, 4), 0), 6) AS score
FROM conversations c LEFT JOIN k ON k.doc_id = c.conv_id AND k.turn = c.turn LEFT JOIN bm ON bm.doc_id = c.conv_id WHERE k.score IS NOT NULL OR bm.score IS NOT NULL""")
def _(t):
    name = lambda a: F.concat_ws(":", a, "turn").alias("child")
    links = t.conversations.select(name("conv_id"), F.col("conv_id").alias("doc_id"))
    return J.sample_hybrid(kids(t).select(name("doc_id"), "score"), scores(t).withColumn("score", F.round("score", 4)), links, "child", "doc_id")


@query("soft_candidates", f"""
SELECT doc_id, evidence FROM (SELECT doc_id, CASE WHEN title LIKE '%que%' THEN 4.0::double ELSE 0 END + CASE WHEN body LIKE '%chung%' THEN 2.0::double ELSE 0 END AS evidence FROM {_D} WHERE n_chars >= 500) WHERE evidence > 0 ORDER BY evidence DESC, doc_id LIMIT 200""")
def _(t):
    return J.soft_candidates(t.documents, "doc_id", F.col("n_chars") >= 500, [(4.0, title().contains("que")), (2.0, body().contains("chung"))])


_EV = f"""e AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN true WHEN lang = 'es' AND (contains(lower(title), 'fr') OR contains(lower(body), 'fr')) THEN true ELSE false END AS f,
  CASE WHEN lang = 'fr' THEN 'lang=hit' WHEN lang = 'es' AND (contains(lower(title), 'fr') OR contains(lower(body), 'fr')) THEN 'lang=partial' ELSE 'lang=miss' END AS evidence,
  CASE WHEN lang = 'fr' THEN 3.0::double WHEN lang = 'es' AND (contains(lower(title), 'fr') OR contains(lower(body), 'fr')) THEN 1.5 ELSE 0 END AS a,
  least(CASE WHEN contains(lower(title), 'que') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(body), 'que') THEN 1.0 ELSE 0 END, 4.0)::double AS w,
  contains(lower(title), 'que') OR contains(lower(body), 'que') AS k, CASE WHEN doc_id % 2 = 0 THEN 0.5::double ELSE 0 END + log10(n_chars + 1) * 0.3 + CASE WHEN 2015 + doc_id % 10 >= 2020 THEN 0.2::double ELSE 0 END AS b FROM {_D}),
sc AS (SELECT doc_id, round(a + w + b, 3) AS score, f AND k AS "full", evidence FROM e)"""


def evidence(t: Tables):
    rows = t.documents.withColumn("lang", F.when(F.col("lang") != "es", F.array("lang")))
    return J.evidence_score(rows, "doc_id", {"lang": (3.0, ["fr"])}, {"title": title(), "body": body()}, ["que"], F.col("doc_id") % 2 == 0, F.col("n_chars"), 2015 + F.col("doc_id") % 10)


@query("evidence_score", f'WITH {_EV} SELECT doc_id, score, "full", evidence FROM sc')
def _(t):
    return evidence(t)


@query("relevance_cut", f'WITH {_EV} SELECT doc_id, score, "full", evidence FROM sc WHERE "full" OR score >= greatest(2.0, 0.35 * (SELECT max(score) FROM sc))')
def _(t):
    return J.relevance_cut(evidence(t))


@query("match_counts", r"""
SELECT conv_id, 'que' AS term, 'text' AS field, count(*) AS n FROM conversations WHERE regexp_matches(lower(text), '(^|[^a-z0-9])que([^a-z0-9]|$)') GROUP BY 1
UNION ALL SELECT conv_id, 'user', 'role', count(*) FROM conversations WHERE contains(lower(role), 'user') GROUP BY 1
UNION ALL SELECT conv_id, 'user', 'text', count(*) FROM conversations WHERE contains(lower(text), 'user') GROUP BY 1""")
def _(t):
    return J.match_counts(t.conversations, "conv_id", ["que", "user"], ["text", "role"])


@query("child_evidence", r"""
WITH m AS (SELECT conv_id, count(*) AS total, count(*) FILTER (WHERE role = 'system') AS sys, count(*) FILTER (WHERE role = 'user') AS usr,
  count(*) FILTER (WHERE regexp_matches(lower(text), '(^|[^a-z0-9])que([^a-z0-9]|$)')) AS que, count(*) FILTER (WHERE contains(lower(text), 'ques')) AS ques,
  count(*) FILTER (WHERE contains(lower(text), 'thing')) AS thing, bool_or(contains(lower(role), 'user')) AS t_user, bool_or(contains(lower(role), 'assistant')) AS t_assistant,
  count(*) FILTER (WHERE contains(lower(text), 'assistant')) AS x_assistant, bool_or(contains(lower(text), 'user')) AS x_user, bool_or(contains(lower(role), 'system')) AS t_system FROM conversations GROUP BY 1)
SELECT conv_id, round(CASE WHEN sys > 0 THEN 1 + 2 * sys / total ELSE 0 END + CASE WHEN usr > 0 THEN 1 + 2 * usr / total ELSE 0 END, 4) AS cell_score,
  round(least(4.0::double, round(0.5 * greatest(que, ques) / total, 6) + round(0.5 * thing / total, 6) + round(1.5 * t_assistant::int + 0.5 * x_assistant / total, 6)), 4)::double AS word_score,
  (sys > 0 OR t_system) AND (usr > 0 OR t_user) AND greatest(que, ques) > 0 AND thing > 0 AND (t_assistant OR x_assistant > 0) AS "full" FROM m""")
def _(t):
    rows = t.conversations
    studies = rows.groupBy("conv_id").agg(F.count("*").alias("total"))
    held = rows.groupBy("conv_id", F.col("role").alias("value")).agg(F.count("*").alias("n"))
    terms, cells = ["que", "thing", "assistants"], ["system", "user"]
    forms = ["que", "ques", "thing", "things", "assistants", "assistant", "system", "systems", "user", "users"]
    matches = J.match_counts(rows, "conv_id", forms, ["text", "role"])
    return J.child_evidence(studies, "conv_id", "total", cells, held, terms, matches, titles=["role"], bodies=[])


@query("filter_matches", """
SELECT DISTINCT o_custkey, 'priorities' AS field, o_orderpriority AS value FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT DISTINCT o_custkey, 'statuses', o_orderstatus FROM orders WHERE o_orderstatus IN ('P')""")
def _(t):
    groups = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("priorities"), F.collect_set("o_orderstatus").alias("statuses"))
    return J.filter_matches(groups, "o_custkey", {"priorities": ["1-URGENT", "2-HIGH"], "statuses": ["P"]})


_MENTION = r"(?is)^((?:.*?[^\p{L}\p{N}])??)(?:que|chung|thing)"
_AT = "length(regexp_extract({c}, '" + _MENTION + "', 1)) + 1"


def _snippet(c: str) -> str:
    at = _AT.replace("{c}", c)
    return f"substr({c}, greatest({at} - 50, 1), least({at} - 1, 50) + 50)"


@query("unclassified", f"""
WITH r AS (SELECT d.doc_id, title, body, regexp_matches(title, '{_MENTION}') AS t, regexp_matches(body, '{_MENTION}') AS b FROM {_D} d LEFT JOIN labels USING (doc_id) WHERE quality IS NULL)
SELECT doc_id, CASE WHEN t THEN 0 ELSE 1 END AS rank, CASE WHEN t THEN 'title' ELSE 'body' END AS field, CASE WHEN t THEN {_snippet('title')} ELSE {_snippet('body')} END AS snippet FROM r WHERE t OR b""")
def _(t):
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return J.unclassified(rows, "doc_id", F.col("quality"), {"title": title(), "body": body()}, ["que", "chung", "thing"])


@query("unmapped_count", "SELECT lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL GROUP BY 1")
def _(t):
    return J.unmapped_count(t.documents.join(t.labels, "doc_id", "left"), F.col("quality"), "lang")
