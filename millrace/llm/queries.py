"""Queries op1 to op13 over whole tables, the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bin_packing, conversation_repair, decontaminate, license_scan, line_chunks, packing, quality_rules, sentence_spans, sharding, simhash, spelling_variants, token_counts, toxicity
from millrace.llm._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.fails(quality_rules.BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~quality_rules.fails(quality_rules.CURRENT)).alias("kept"), "failed",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "res.n_words", "res.n_hit", F.size("res.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("res.items", ","), 256).alias("items_sha256"), (F.col("res.n_hit") > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_sentences(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "row.text", "res.*")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_whole_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_spellings(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_quality_rules, op2_license_scan, op3_sharding, op4_decontamination, op5_toxicity, op6_token_counts, op7_packing,
        op8_substring_dedup, op9_simhash, op10_line_dedup, op11_best_fit_packing, op12_conversation_repair, op13_spelling_variants,
    ]
    return {f.__name__: f for f in ops}


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, p, ws[p] || chr(31) || ws[p + 1] || chr(31) || ws[p + 2] || chr(31) || ws[p + 3] || chr(31) || ws[p + 4] AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM again) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'gs'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(dup.lines, 0) AS n_lines, len(list_filter(range(2, len(ws) + 1), lambda p: ws[p] = ws[p - 1])) AS n_stutters
      FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
        + 8 * (word_chars > 14 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
        + 64 * (n_words > 100000)::BIGINT + 128 * (5 * n_stutters > n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

_FOLDED = r"translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op2_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(license_scan.TEMPLATES))
    grams = "list_distinct(list_transform(range(1, len(ws)), lambda p: ws[p] || ' ' || ws[p + 1]))"
    least = f"{license_scan.THRESHOLD} * len(tg) <= {200 - license_scan.THRESHOLD}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, name, len(ws) AS k, {grams} AS tg FROM (SELECT i, name, {_WORDS % "body"} AS ws FROM (VALUES {rows}) v(i, name, body))),
l AS (SELECT r, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM d),
p AS (SELECT r, line_no, generate_subscripts(ps, 1) AS q, unnest(ps) AS part FROM (SELECT r, line_no, string_split(regexp_replace(line, '([.!?;:])[ \t]+', '\\1' || chr(10), 'g'), chr(10)) AS ps FROM l)),
w AS (SELECT r, line_no, q, {_WORDS % "part"} AS ws FROM p),
s AS (SELECT r, line_no, row_number() OVER (PARTITION BY r ORDER BY line_no, q) AS s, len(ws) AS n, sum(len(ws)) OVER (PARTITION BY r ORDER BY line_no, q) AS upto, ws FROM w WHERE len(ws) > 0),
a AS (SELECT r, flatten(list(ws ORDER BY s)) AS ws, max(s) AS last FROM s GROUP BY r),
g AS (SELECT r, {grams} AS g FROM a WHERE len(ws) > 1),
c AS (SELECT r, i, name, k, tg FROM g, t WHERE {least} * len(list_intersect(g, tg))),
j AS (SELECT c.r, i, name, tg, x.line_no, x.s AS lo, coalesce(min(y.s), any_value(a.last)) AS hi FROM c JOIN a USING (r) JOIN s x ON x.r = c.r LEFT JOIN s y ON y.r = c.r AND y.upto >= x.upto - x.n + c.k GROUP BY ALL),
u AS (SELECT r, i, name, tg, line_no, lo, hi FROM j UNION SELECT r, i, name, tg, line_no, lo, hi - 1 FROM j WHERE hi > lo),
b AS (SELECT u.r, u.i, u.name, u.tg, u.line_no, a.ws[(x.upto - x.n + 1)::BIGINT : y.upto::BIGINT] AS ws FROM u JOIN a ON a.r = u.r JOIN s x ON x.r = u.r AND x.s = u.lo JOIN s y ON y.r = u.r AND y.s = u.hi),
h AS (SELECT r, line_no, name, tg, {grams} AS g FROM b WHERE len(ws) > 1),
m AS (SELECT r, line_no, name, len(g) + len(tg) AS total, len(list_intersect(g, tg)) AS common FROM h),
k AS (SELECT r, line_no, name, round(2.0 * common / total, 6) AS dice, 2.0 * common / total AS exact FROM m WHERE 200 * common >= {license_scan.THRESHOLD} * total),
e AS (SELECT r, first(name ORDER BY exact DESC, line_no, name) AS license_id, first(dice ORDER BY exact DESC, line_no, name) AS dice,
        first(line_no ORDER BY exact DESC, line_no, name) AS line_no, count(*) AS n FROM k GROUP BY r),
f AS (SELECT r, string_agg(name, ',' ORDER BY name) AS licenses FROM (SELECT DISTINCT r, name FROM k) GROUP BY r)
SELECT doc_id, license_id, dice::DOUBLE AS dice, coalesce(line_no, -1)::BIGINT AS line_no, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_matches
FROM d LEFT JOIN e USING (r) LEFT JOIN f USING (r)
"""


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS % "coalesce(text, '')"} AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS % "text"} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, p, n, array_to_string(ws[p : p + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT r, p, n, item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


#: One row: the table of the CRC-32 polynomial.
_CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""
_CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
d AS (SELECT conv_id, turn, role, text, {_CRC.format(bytes="bytes")} % 20 AS chance FROM c, tab),
m AS (SELECT conv_id, turn, CASE chance WHEN 4 THEN 'user' ELSE role END AS role, CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE chance WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE chance <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM m),
s AS (SELECT *, count(*) OVER (PARTITION BY g, role, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier, left(role, 1) AS r,
        lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS q FROM o),
f AS (SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN earlier > 0 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM s),
-- states: 0 nothing, 1 system, 2 user, 3 assistant; what can be inserted, with its cost
ins(a, st, label, extra, lines) AS (VALUES (0, 0, '', 0, ''), (0, 2, 'I', 2, chr(10) || 'user:'), (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, '', 0, ''),
  (1, 2, 'I', 2, chr(10) || 'user:'), (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, '', 0, ''), (2, 3, 'I', 2, chr(10) || 'assistant:'), (3, 3, '', 0, ''), (3, 2, 'I', 2, chr(10) || 'user:')),
p AS (
  SELECT g, 0::BIGINT AS i, st, extra AS cost, label AS audit, lines FROM (SELECT DISTINCT g FROM f), ins WHERE a = 0
  UNION ALL
  SELECT g, i, st, cost, audit, lines FROM (
    SELECT w.g, w.i, ins.st, w.cost + ins.extra AS cost, w.audit || ins.label AS audit, w.lines || ins.lines AS lines FROM (
      SELECT p.g, f.i, e.st, p.cost + e.cost AS cost, p.audit || e.label AS audit, p.lines || e.lines AS lines FROM p JOIN f ON f.g = p.g AND f.i = p.i + 1,
        LATERAL (SELECT p.st AS st, 3 AS cost, 'D' AS label, '' AS lines
          UNION ALL SELECT CASE p.st WHEN 2 THEN 3 ELSE 2 END, 2 + (fault = 3)::INT, 'R', chr(10) || CASE p.st WHEN 2 THEN 'assistant:' ELSE 'user:' END || text WHERE fault NOT IN (1, 2)
          UNION ALL SELECT CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, (fault = 3)::INT, 'K', chr(10) || role || ':' || text
            WHERE fault NOT IN (1, 2) AND ((r = 's' AND p.st = 0) OR (r = 'u' AND p.st <> 2) OR (r = 'a' AND p.st = 2))) e) w JOIN ins ON ins.a = w.st)
  QUALIFY row_number() OVER (PARTITION BY g, st ORDER BY cost, audit) = 1),
n AS (SELECT g, any_value(conv_id) AS conv_id, max(i) AS i, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
        count_if(fault = 3) AS truncated, count_if(q IS NOT NULL AND q || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g),
b AS (SELECT n.*, cost, audit, lines FROM n JOIN p USING (g, i) WHERE st IN (0, 3) QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, audit) = 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
"""


_CODES = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))"

OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED % "text"}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, k, {_CRC.format(bytes=_CODES)} AS h FROM k, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
s AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS pattern FROM i),
d AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS less FROM i),
p AS (SELECT a.word, b.word AS other, b.n FROM s a JOIN s b ON a.pattern = b.pattern AND a.word <> b.word
      UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
f AS (SELECT v.word, v.n, count(*) AS n_near, first(other ORDER BY p.n DESC, other) AS other, max(p.n) AS other_n FROM p JOIN v ON p.word = v.word GROUP BY v.word, v.n),
l AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN f USING (word)),
c AS (SELECT word, word AS at FROM l UNION ALL SELECT c.word, l.form FROM c JOIN l ON l.word = c.at WHERE l.form IS NOT NULL),
e AS (SELECT c.word, c.at AS root FROM c JOIN l ON l.word = c.at WHERE l.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM l JOIN e USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_license_scan": op2_sql(), "op4_decontamination": OP4_SQL, "op12_conversation_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
