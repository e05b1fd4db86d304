"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.chat import format_chats, read_chats
from millrace.llm.collocations import collocations
from millrace.llm.common import documents, written
from millrace.llm.divergence import source_divergence
from millrace.llm.exact_dedup import exact_groups
from millrace.llm.language_id import identify
from millrace.llm.maxent import score_texts
from millrace.llm.mixing import mix_sources
from millrace.llm.near_dedup import Near, near_groups
from millrace.llm.packing import pack_documents
from millrace.llm.quality import classify
from millrace.llm.sharding import shard_documents
from millrace.llm.tiff import media_digests, text_media
from millrace.llm.token_count import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), capacity=2048, end=0)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), Near(words=2, percent=80))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=17)


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), weights=[1.0] * 40)


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(text_media(documents(spark, sf_dir)))


def op7_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    how = (_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    formatted = written(format_chats(turns.unionByName(extra), *how), "chats")
    return read_chats(formatted, *how).drop("n_ids", "loss_ids")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir), least=10, top=10)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), folds=3, fold=1)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), least=10, share=50, top=2000)


def queries() -> dict[str, Query]:
    found = (
        op1_pack_sequences, op2_near_dedup, op3_quality_classifier, op4_mix_sources, op5_rendezvous_shards,
        op6_tiff_media, op7_score_texts, op8_count_tokens, op9_exact_dedup, op10_chat_format,
        op11_source_divergence, op12_language_id, op13_collocations,
    )
    return {f.__name__: f for f in found}


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""


#: All pairs of documents that share a shingle, in whole; only fit for small tables.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 2 THEN words ELSE words[i:i+1] END AS shingle
  FROM w, unnest(range(1, greatest(2, len(words)))) AS u(i)
  WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (SELECT source, sum(size) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
c AS (
  SELECT *, 2.0 * n AS cap, coalesce(sum(2.0 * n) OVER o, 0) AS held, coalesce(sum(w) OVER o, 0) AS used, sum(w) OVER () AS all_w, 1.5 * sum(n) OVER () AS budget
  FROM s WINDOW o AS (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((budget - held) / (all_w - used)) FILTER (WHERE (budget - held) / (all_w - used) <= cap / w) AS level, max(cap / w) AS top FROM c),
t AS (SELECT source, n, CAST(least(cap, w * coalesce(level, top)) AS DOUBLE) AS target FROM c, l),
r AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.doc_id, d.size, r.n, r.target, r.whole, round(r.target - r.whole * r.n) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(draw, 1, 16), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(text, '(\\|### System:|### User:|### Assistant:|### Role|</turn>)', '\\\1', 'g')) AS body,
         CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
              ELSE 11 + length(regexp_replace(role, '(\\|### System:|### User:|### Assistant:|### Role|</turn>)', '\\\1', 'g')) END AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, md5(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(head + body + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


#: Every term in every group, and every pair of groups in every term; only fit for small tables.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, CAST(coalesce(m.n, 0) AS HUGEINT) AS n, CAST(k.total AS HUGEINT) AS total
      FROM g JOIN k USING (lang) LEFT JOIN m ON m.lang = g.lang AND m.source = g.source AND m.term = k.term),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
v AS (SELECT lang, count(*) AS terms, sum(total) AS size FROM k GROUP BY lang),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 2)) // (s.size + 2 * v.terms) AS p, 1 + (1000000000 * (c.total + 2)) // (v.size + 2 * v.terms) AS q
      FROM c JOIN s USING (lang, source) JOIN v ON v.lang = c.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
t AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
f1 AS (SELECT lang, words[i] AS x, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL),
f2 AS (SELECT lang, words[i] AS x, words[i + 1] AS y, CAST(count(*) AS HUGEINT) AS n FROM t WHERE i < len(words) GROUP BY ALL),
f3 AS (SELECT lang, words[i] AS x, words[i + 1] AS y, words[i + 2] AS z, CAST(count(*) AS HUGEINT) AS n FROM t WHERE i < len(words) - 1 GROUP BY ALL HAVING count(*) >= 10),
around AS (SELECT lang, x, y, max(n) AS n FROM (SELECT lang, x, y, n FROM f3 UNION ALL SELECT lang, y, z, n FROM f3) GROUP BY ALL),
c AS (
  SELECT a.lang, a.x || ' ' || a.y AS phrase, a.n AS a, b.n AS l, c.n AS r
  FROM f2 a JOIN f1 b ON b.lang = a.lang AND b.x = a.x JOIN f1 c ON c.lang = a.lang AND c.x = a.y
  LEFT JOIN around o ON o.lang = a.lang AND o.x = a.x AND o.y = a.y WHERE a.n >= 10 AND NOT coalesce(100 * o.n >= 50 * a.n, false)
  UNION ALL
  SELECT a.lang, a.x || ' ' || a.y || ' ' || a.z, a.n, CASE WHEN early THEN l1 ELSE l2 END, CASE WHEN early THEN r1 ELSE r2 END
  FROM (SELECT f3.*, b.n AS l1, c.n AS r1, e.n AS l2, g.n AS r2, (1000000 * f3.n * f3.n) // (b.n * c.n) <= (1000000 * f3.n * f3.n) // (e.n * g.n) AS early
        FROM f3 JOIN f1 b ON b.lang = f3.lang AND b.x = f3.x JOIN f2 c ON c.lang = f3.lang AND c.x = f3.y AND c.y = f3.z
        JOIN f2 e ON e.lang = f3.lang AND e.x = f3.x AND e.y = f3.y JOIN f1 g ON g.lang = f3.lang AND g.x = f3.z) a),
s AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM c)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST((SELECT sum(n) FROM f1 WHERE f1.lang = s.lang) AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op4_mix_sources": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_collocations": OP13_SQL}
