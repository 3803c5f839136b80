"""The registered queries of sharding, spelling variants and collocations, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import collocations, sharding, variants
from tidemark.llm.registry import query
from tidemark.llm.sql_parts import crc32, crc_table, hilbert
from tidemark.session import table


def rank_level(column: str) -> str:
    return f"""(SELECT {column} AS v, floor((sum(count(*)) OVER (ORDER BY {column}) - count(*)) * 32 / sum(count(*)) OVER ()) AS level
  FROM documents WHERE {column} IS NOT NULL GROUP BY {column})"""


@query("op11_sharding", f"""
WITH {crc_table()},
ends AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents),
based AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, coalesce(a.level, 0) AS l0, coalesce(b.level, 0) AS l1,
         coalesce(least(floor((doc_id - lo)::DOUBLE * 32 / (hi - lo + 1)::DOUBLE), 31), 0) AS l3, coalesce(text, '') AS body
  FROM documents LEFT JOIN {rank_level('lang')} a ON lang = a.v LEFT JOIN {rank_level('source')} b ON source = b.v, ends),
summed AS (SELECT doc_id, size, l0, l1, length(bin(size)) - 1 AS l2, l3, {crc32('body')} AS crc FROM based, tab),
{hilbert('summed', ['l0', 'l1', 'l2', 'l3'], 5)},
run AS (SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total, row_number() OVER o AS place FROM curved
        WINDOW o AS (ORDER BY curve, doc_id, size, crc ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, floor(before * 8 / total)::INT AS shard FROM run)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::DOUBLE AS grown_shard
FROM dealt""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants", rf"""
WITH RECURSIVE {crc_table()},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
  FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32("doc_id || ':' || run")} AS h FROM pairs, tab),
spelled AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
wild AS (SELECT word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) AS pattern, left(word, i - 1) || substr(word, i + 1) AS less FROM holes),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM wild a JOIN wild b ON a.pattern = b.pattern AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM wild a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM wild a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::DOUBLE AS form_n FROM formed JOIN ends USING (word)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


@query("op13_phrase_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda s: w[s:s + 4])) AS w FROM words),
counts AS (
  SELECT lang, d, array_to_string(w[:d], ' ') AS phrase, count(*) AS f
  FROM starts, range(1, 6) AS lengths(d) WHERE d <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE d >= 2),
inner_ones AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS around
  FROM candidates, range(1, 5) AS begins(s), range(2, 5) AS sizes(m) WHERE m < d AND s + m - 1 <= d GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM candidates c JOIN total USING (lang), range(1, 5) AS places(k), counts x, counts y
  WHERE k < c.d AND x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(w[:k], ' ') AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ones i USING (lang, phrase) WHERE coalesce(i.around, 0) < a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
