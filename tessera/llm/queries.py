"""Driver bindings of the training-data operators: ``QUERIES`` and their ``SQL``.

Each query applies one operator with its production parameters to its whole
table. SQL is given where it can express the result; the others are tested
against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, backoff, chat, divergence, html_text, infill, jaccard, langid, mixing, passages, pieces, quality, suffix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return (jaccard.join_components(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "class_id", "component_id"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and host verdict of every document."""
    return (quality.quality(_table(spark, sf_dir, "documents"))
            .select("doc_id", *quality.COUNTS, "base_failed", "kept"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window, slot and position of every document in the mix of its source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    out = mixing.mix_sources(docs)
    return out.selectExpr("doc_id", "source", "_m_block AS block", "_m_release AS release", "_m_deadline AS deadline",
                          "_m_slot AS slot", "_m_position AS position")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return suffix.suffix_dedup(_table(spark, sf_dir, "documents"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from each participant's side, turn by turn."""
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the four best segmentations with their digests and scores, and the round trip of every document."""
    return pieces.encode_pieces(_table(spark, sf_dir, "documents"), both=True)


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every query vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by the counts of all others."""
    return backoff.backoff_scores(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the sources of a language, and the terms that mark each source."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts, digest of the transformed text and of the text rebuilt from it, of every document."""
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that a document with a smaller id has."""
    made = passages.without_passages(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_host_quality, op3_mix_sources, op4_suffix_dedup, op5_chat_perspectives, op6_page_text, op7_language_spans,
    op8_sentencepiece, op9_nearest_vectors, op10_backoff_scores,
    op11_source_divergence, op12_fill_in_middle, op13_passage_dedup)}

OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
counts AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source),
moments AS (SELECT sum(f) / sum(n) AS prior, avg(f / n) AS m, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS sampling FROM hosts),
prior AS (SELECT prior, CASE WHEN v - m * (1 - m) * sampling <= 0 THEN 1000.0
                             ELSE least(1000.0, greatest(1.0, m * (1 - m) / (v - m * (1 - m) * sampling) - 1)) END AS strength FROM moments),
verdict AS (SELECT source, (f + prior * strength) / (n + strength) > 0.5 AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdict ON judged.source IS NOT DISTINCT FROM verdict.source
"""

OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
                  regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1|>', 'g') AS body FROM conversations),
c AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, perspective, turn, speaker, body, speaker = perspective AS own,
             '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                                    ELSE 'user name=' || speaker END || chr(10) AS head
      FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
s AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM r),
o AS (SELECT *, row_number() OVER w AS seq, CAST(length(rendered) AS BIGINT) AS n_chars,
             CAST(sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(rendered) AS start
      FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, turn, seq, speaker, rendered, start, n_chars,
       CASE WHEN own THEN start + length(head) END AS mask_start, CASE WHEN own THEN start + n_chars - 1 END AS mask_end
FROM o
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i >= 2 THEN w[i - 1] END AS b, CASE WHEN i >= 3 THEN w[i - 2] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
n AS (SELECT count(*) AS n FROM t), d AS (SELECT doc_id, count(*) AS own FROM t GROUP BY doc_id),
u AS (SELECT *, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS c1,
             CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) END AS c2,
             CASE WHEN a IS NOT NULL THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) END AS c3 FROM t),
-- the counts of a word's context are those of the word before it
v AS (SELECT *, lag(c1) OVER p AS h1, lag(c2) OVER p AS h2 FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3 / h2)
                          WHEN c2 > 0 THEN ln(c2 / h1) + CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END
                          ELSE ln(greatest(c1, 0.5) / greatest(n - own, 1)) + CASE WHEN i = 1 THEN 0 WHEN i = 2 THEN ln(0.4) ELSE 2 * ln(0.4) END END AS l
      FROM v JOIN d USING (doc_id), n),
r AS (SELECT doc_id, count(*) AS k, CAST(sum(l) AS DOUBLE) AS l FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_words, round(coalesce(l, 0.0), 4) AS log_score, round(l / k, 4) AS mean_log
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""

# weights as in ``mixing.targets``, slot by slot as in ``mixing.schedule``, ranks by MD5
OP3_SQL = """
WITH RECURSIVE counts AS (SELECT source, coalesce('s' || source, '-') AS src, count(*) AS n FROM documents GROUP BY source),
share AS (SELECT src, CAST(round(sqrt(n) * 1000000) AS BIGINT) AS a, CAST((n + 15) // 16 AS BIGINT) AS blocks FROM counts),
ws AS (SELECT list(a ORDER BY src) AS a, list(src ORDER BY src) AS s, list(blocks ORDER BY src) AS b, CAST(sum(a) AS BIGINT) AS d,
              CAST(count(*) AS BIGINT) AS k, CAST(sum(blocks) AS BIGINT) AS total FROM share),
sim(t, done, pick, placed) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ws
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda i: done[i] + CASE WHEN i = p.i THEN 1 ELSE 0 END), p.i, placed + CASE WHEN p IS NULL THEN 0 ELSE 1 END
  FROM (SELECT sim.t, sim.done, sim.placed, ws.k, list_min(list_filter(list_transform(range(1, ws.k + 1), lambda i:
               {'due': ((sim.done[i] + 1) * ws.d + ws.a[i] - 1) // ws.a[i], 'i': i, 'open': sim.done[i] < ws.b[i] AND (sim.done[i] * ws.d) // ws.a[i] <= sim.t + 1}),
               lambda y: y.open)) AS p
        FROM sim, ws WHERE sim.placed < ws.total)),
places AS (SELECT ws.s[pick] AS src, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM sim, ws WHERE t >= 0 AND pick IS NOT NULL),
ranked AS (SELECT doc_id, source, coalesce('s' || source, '-') AS src,
                  row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rk FROM documents),
placed AS (SELECT r.doc_id, r.source, r.rk, r.rk // 16 AS b, s.a, ws.d, r.src FROM ranked r JOIN share s ON r.src = s.src, ws)
SELECT doc_id, source, CAST(b AS BIGINT) AS block, CAST((b * x.d) // x.a AS BIGINT) AS release, CAST(((b + 1) * x.d + x.a - 1) // x.a AS BIGINT) AS deadline,
       CAST(p.slot AS BIGINT) AS slot, CAST(p.slot * 16 + rk % 16 AS BIGINT) AS position
FROM placed x JOIN places p ON x.src = p.src AND p.j = x.b
"""

# links between the smallest ids of equal sets, followed from each to all it reaches
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
sets AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS class_id
         FROM (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id)),
one AS (SELECT s.doc_id, s.g, sets.n FROM s JOIN sets ON s.doc_id = sets.doc_id AND sets.class_id = sets.doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
           FROM one x JOIN one y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(x, y) AS (SELECT class_id, class_id FROM sets UNION SELECT x, b FROM reach JOIN ways ON y = a),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(class_id, d.doc_id) AS BIGINT) AS class_id,
       CAST(coalesce(root, d.doc_id) AS BIGINT) AS component_id
FROM d LEFT JOIN sets ON d.doc_id = sets.doc_id LEFT JOIN roots ON class_id = x
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
kept AS (SELECT lang, term FROM (SELECT DISTINCT lang, k, unnest(t) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
occurrences AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT g.lang, g.source, kept.term, coalesce(o.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang
           LEFT JOIN occurrences o ON o.lang = g.lang AND o.source = g.source AND o.term = kept.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM counts JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
          FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) JOIN v USING (lang)),
apart AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
above AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM above)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank
FROM ranked WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item) ASC)
QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
s AS (SELECT doc_id, n, t, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
             coalesce(array_to_string(u[b + 1:], ''), '') AS x,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || x END) AS restored_sha256
FROM s
"""

# a window's words stand in its key, joined by a space: no word holds one
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT k, coalesce(doc_id, 9223372036854775807) AS id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g
      FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT k, i FROM (SELECT k, i, id, min(id) OVER (PARTITION BY g) AS least FROM o) WHERE least < id),
gone AS (SELECT k, list(DISTINCT p) AS p FROM (SELECT k, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY k),
word AS (SELECT k, p, w[p] AS word FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
left_over AS (SELECT k, string_agg(word, ' ' ORDER BY p) AS kept FROM word
              WHERE NOT EXISTS (SELECT 1 FROM (SELECT k AS gk, unnest(p) AS gp FROM gone) WHERE gk = word.k AND gp = word.p) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (k) LEFT JOIN left_over USING (k)
"""

SQL: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op13_passage_dedup": OP13_SQL, "op11_source_divergence": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op3_mix_sources": OP3_SQL, "op10_backoff_scores": OP10_SQL, "op2_host_quality": OP2_SQL, "op5_chat_perspectives": OP5_SQL}
