"""The ``opN_<name>`` queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, jaccard, langid, lm, mixing, neardup, pii, quality, quotes, spelling, url_filter
from .common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op7_mix_sources")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


#: the words of a text and every window, matched as joined strings
_OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
g AS (SELECT item, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, l, array_to_string(w[p:p + l - 1], ' ') AS s FROM g),
pos AS (SELECT rid, l, w, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
m AS (SELECT rid, item, pos.l AS l, p FROM pos JOIN win ON win.l = pos.l AND win.s = array_to_string(w[p:p + pos.l - 1], ' ')),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + l)) AS q FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""


@query("op10_decontaminate", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_groups(table(spark, sf_dir, "documents")).drop("text_key")


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                         table(spark, sf_dir, "pages")).drop("text_key")


@query("op1_lm_score")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op3_embedding_neardup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "embeddings"))


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


def op8_sql(min_words: int = quotes.MIN_WORDS) -> str:
    """The passage rule in DuckDB SQL."""
    return _OP8_SQL.replace("@MIN_WORDS", str(min_words))


_OP8_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
l AS (
  SELECT rid, conv_id, turn, p, line, regexp_extract(line, '^(?:[ \t]*>)+') AS marks
  FROM (SELECT rid, conv_id, turn, unnest(range(1, len(s) + 1)) AS p, unnest(s) AS line
        FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS s FROM m WHERE text IS NOT NULL))),
b AS (
  SELECT rid, conv_id, turn, p, len(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, len(marks) + 1) AS body FROM l),
c AS (SELECT *, trim(body, ' ' || chr(9)) = '' AS blank, lag(level) OVER o AS level0, lag(trim(body, ' ' || chr(9)) = '') OVER o AS blank0
  FROM b WINDOW o AS (PARTITION BY rid ORDER BY p)),
s AS (SELECT *, count(*) FILTER (level0 IS NULL OR level0 <> level OR blank OR blank0) OVER (PARTITION BY rid ORDER BY p) AS pid FROM c),
pas AS (SELECT rid, conv_id, turn, pid, level, string_agg(body, chr(10) ORDER BY p) AS t FROM s
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
u AS (
  SELECT rid, conv_id, turn, pid, level, t AS u FROM pas UNION ALL
  SELECT rid, conv_id, turn, pid, level, unnest(regexp_split_to_array(t, '[.!?]+[ \t\n]+')) FROM pas UNION ALL
  SELECT rid, conv_id, turn, pid, level, unnest(string_split(t, chr(10))) FROM pas),
k AS (SELECT DISTINCT rid, conv_id, turn, pid, level, trim(regexp_replace(translate(
    u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), ' ') AS h FROM u),
q AS (SELECT conv_id, turn, level, h, len(string_split(h, ' ')) AS words, count(*) AS n FROM k WHERE level > 0 AND h <> '' GROUP BY ALL),
o AS (SELECT conv_id, h, min(turn) AS t FROM k WHERE level = 0 AND h <> '' GROUP BY ALL),
f AS (SELECT h, conv_id AS fc, t AS ft FROM o QUALIFY row_number() OVER (PARTITION BY h ORDER BY conv_id, t) = 1),
to_ AS (
  SELECT q.conv_id, q.turn, q.level, q.n, q.n * q.words AS weight,
    CASE WHEN o.t < q.turn THEN q.conv_id WHEN words >= @MIN_WORDS AND (fc, ft) < (q.conv_id, q.turn) THEN fc END AS tc,
    CASE WHEN o.t < q.turn THEN o.t WHEN words >= @MIN_WORDS AND (fc, ft) < (q.conv_id, q.turn) THEN ft END AS tt
  FROM q LEFT JOIN o ON o.conv_id = q.conv_id AND o.h = q.h LEFT JOIN f ON f.h = q.h),
g AS (SELECT conv_id, turn, level, tc, tt, sum(n) AS n, sum(weight) AS weight FROM to_ WHERE tc IS NOT NULL GROUP BY ALL),
r AS (
  SELECT conv_id, turn, tc, tt, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked FROM g
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, tc, tt) = 1),
w AS (
  SELECT conv_id, turn, tc AS uc, tt AS ut, tc || ':' || tt || '/' || conv_id || ':' || turn AS path, 1 AS d FROM r
  UNION ALL
  SELECT w.conv_id, w.turn, r.tc, r.tt, r.tc || ':' || r.tt || '/' || w.path, d + 1 FROM w JOIN r ON r.conv_id = w.uc AND r.turn = w.ut),
top AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY d DESC) = 1),
own AS (
  SELECT rid, coalesce(string_agg(body, chr(10) ORDER BY p) FILTER (level = 0), '') AS t,
    count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level FROM b GROUP BY rid)
SELECT m.conv_id, m.turn, role, CASE WHEN m.text IS NOT NULL THEN
    regexp_replace(regexp_replace(own.t, '^(?:[ \t]*\n)+', ''), '(?:\n[ \t]*)+$', '') END AS text,
  coalesce(n_quoted, 0) AS n_quoted, CAST(coalesce(max_level, 0) AS BIGINT) AS max_level,
  CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, r.tc AS reply_conv, r.tt AS reply_turn,
  coalesce(uc, m.conv_id) AS thread_conv, coalesce(ut, m.turn) AS thread_turn,
  coalesce(path, m.conv_id || ':' || m.turn) AS path
FROM m LEFT JOIN own USING (rid) LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn
LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
"""


@query("op8_chat_quotes", op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_chats(table(spark, sf_dir, "conversations"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")


@query("op12_bpe_round_trip")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded_col="text")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


_OP13_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
g AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(w) + 1) AS c1,
    CAST('0x' || x[9:16] AS BIGINT) % (len(w) + 1) AS c2, CAST('0x' || x[25:32] AS BIGINT) % 100 < 50 AS spm FROM h),
c AS (
  SELECT *, array_to_string(w[1:least(c1, c2)], '') AS p, array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(w[greatest(c1, c2) + 1:], '') AS s, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>')
      OR contains(t, '<M>') THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""


@query("op13_fill_in_middle", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fim.restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
