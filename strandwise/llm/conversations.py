"""The conversation operators as named queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefix_trie, repair
from .common import stage, table


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with every twentieth row lost, emptied, cut, repeated or re-roled."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20
    rows = repair.cleaned(rows).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair.repair_report(damaged(rows)).withColumnRenamed("conv_id", "found_id")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    lost = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in "gaps blank duplicate truncated illegal cost".split()}
    lost |= {"audit": F.coalesce("audit", F.lit("")).alias("audit"), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select("conv_id", *lost.values())


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda k: (unicode(c)::bigint >> k) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, b: xor(a >> 1, xor(a & 1, b) * 3988292384::bigint)), 4294967295::bigint)"


def _arcs_sql() -> str:
    """All ways over a row: node before, inserted turns and their lines, edit, node after."""
    rows = []
    for q in range(4):
        at, letters, lines = q, "", ""
        for _ in range(3):
            over = [("D", "*", at, "NULL"), ("R", "*", repair._NEXT[at], f"'{repair._ROLE[repair._NEXT[at]]}'"), ("K", "a" if at == repair.USER else "u", repair._NEXT[at], "NULL")]
            over += [("K", "s", repair.SYSTEM, "NULL")] if at == repair.NONE else []
            rows += [f"({q}, '{letters}', {len(letters) * repair.INSERT}, '{lines}', '{edit}', '{first}', {to}, {role})" for edit, first, to, role in over]
            at = repair._NEXT[at]
            letters, lines = letters + "I", lines + f"|{repair._ROLE[at]}:"
    return ", ".join(rows)


REPAIR_SQL = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 AS k
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM base WHERE k <> 0
), placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 0 WHEN seen > 1 THEN 1 WHEN last NOT IN ('.', '!', '?') THEN 2 ELSE 3 END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY n) || c AS pair
  FROM placed
), arcs (q, letters, more, lines, edit, first, after, becomes) AS (VALUES {_arcs_sql()}),
step AS (
  SELECT DISTINCT conv_id, 0::bigint AS n, 0 AS q, {{'cost': 0::bigint, 'audit': '', 'out': ''}} AS best FROM judged
  UNION ALL
  SELECT s.conv_id, s.n + 1, a.after, min({{
    'cost': s.best.cost + a.more + CASE edit WHEN 'D' THEN {repair.DELETE} ELSE (edit = 'R')::int + CASE WHEN fault = 2 THEN {repair.TRUNCATED} ELSE 0 END END,
    'audit': s.best.audit || a.letters || a.edit,
    'out': s.best.out || replace(a.lines, '|', chr(10)) || CASE edit WHEN 'D' THEN '' ELSE chr(10) || coalesce(a.becomes, r.role) || ':' || r.text END}})
  FROM step s JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.n = s.n + 1
  JOIN arcs a ON a.q = s.q AND (edit = 'D' OR fault >= 2 AND (edit = 'R' OR a.first = r.c))
  GROUP BY s.conv_id, s.n, a.after
), told AS (
  SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 0) AS blank, count(*) FILTER (WHERE fault = 1) AS duplicate, count(*) FILTER (WHERE fault = 2) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), tails (q, more, letters, lines) AS (VALUES (0, 0, '', ''), (1, {2 * repair.INSERT}, 'II', '|user:|assistant:'), (2, {repair.INSERT}, 'I', '|assistant:'), (3, 0, '', '')),
ends AS (
  SELECT s.conv_id, min({{'cost': s.best.cost + t.more, 'audit': s.best.audit || t.letters, 'out': s.best.out || replace(t.lines, '|', chr(10))}}) AS best
  FROM step s JOIN told ON told.conv_id IS NOT DISTINCT FROM s.conv_id AND told.n = s.n JOIN tails t ON t.q = s.q GROUP BY s.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
  coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(best.cost, 0)::bigint AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.out, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""

def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the conversation that starts their five;
    with the ids and lengths of all, also of those left without turns."""
    turns = stage(prefix_trie.placed(rows), "placed")
    first = turns.where("conv_id % 5 = 0 and n <= 8").withColumnRenamed("conv_id", "base")
    held = first.groupBy("base").agg(F.count("*").alias("held"))
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("own")).withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % 9, "base": F.col("conv_id") - F.col("conv_id") % 5})
    convs = convs.join(held, "base", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    convs = stage(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    head = convs.join(first, "base").where("n <= h").withColumn("place", F.col("n"))
    # a long conversation is dealt by its pieces
    size = prefix_trie.PIECE
    pieces = convs.where("own > h").withColumn("of", F.explode(F.sequence(F.lit(0), F.floor((F.col("own") - 1) / size))))
    tail = turns.withColumn("of", F.floor((F.col("n") - 1) / size)).join(pieces, ["conv_id", "of"]).where("n > h").withColumn("place", F.col("n") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "place", "length", "digest", "bytes"]
    return head.select(*columns).unionByName(tail.select(*columns)), convs.select("conv_id", "length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


TRIE_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id::varchar")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), heads AS (
  SELECT i.conv_id, n AS place, role, text FROM ids i JOIN t ON t.conv_id = i.base AND n <= h
), taken AS (
  SELECT conv_id, count(*) AS k FROM heads GROUP BY conv_id
), turns AS (
  SELECT * FROM heads
  UNION ALL
  SELECT i.conv_id, n - h + coalesce(k, 0), role, text FROM ids i JOIN t ON t.conv_id = i.conv_id AND n > h LEFT JOIN taken ON taken.conv_id = i.conv_id
), prefix AS (
  SELECT conv_id, place, strlen(text) AS bytes,
    md5(string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY place)) AS d
  FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), member AS (
  SELECT *, min(conv_id) OVER (PARTITION BY place, d) AS lead, max(place) OVER (PARTITION BY conv_id) AS length FROM prefix
), nodes AS (
  SELECT lead, place, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE place = length), '')) AS ends
  FROM member GROUP BY lead, place
), above AS (
  SELECT nodes.*, m.lead AS up FROM nodes LEFT JOIN member m ON m.conv_id = nodes.lead AND m.place = nodes.place - 1
), children AS (
  SELECT up, place - 1 AS place, count(*) AS n FROM above WHERE place > 0 GROUP BY ALL
), below AS (
  SELECT m.lead, m.place, sum((y.n - 1) * y.bytes)::bigint AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes y JOIN member m ON m.conv_id = y.lead AND m.place <= y.place
  LEFT JOIN children c ON c.up = y.lead AND c.place = y.place GROUP BY ALL
)
SELECT a.lead AS conv_id, a.place AS depth, a.up AS parent_conv_id, a.n AS n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves,
  b.saved AS saved_tokens, a.ends AS ends_sha256
FROM above a JOIN below b ON b.lead = a.lead AND b.place = a.place LEFT JOIN children c ON c.up = a.lead AND c.place = a.place
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie, "op12_conversation_repair": op12_conversation_repair}
ORACLE_SQL = {"op11_prefix_trie": TRIE_SQL, "op12_conversation_repair": REPAIR_SQL}
