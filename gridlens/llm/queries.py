"""The registered queries of this subpackage: one per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import (ann, decontaminate, filter_audit, line_dedup, maxent_lm, mixing, paragraphs, prefix_trie,
                          quality, sharding, simhash, token_files, toxicity)
from gridlens.llm.common import crc32_of_id
from gridlens.session import read_table

#: Production schedules of the mix: integrals 5, 2 and 1; the heavy sources rise, the light ones fall.
SCHEDULES = [[(0.0, 4.0), (1.0, 6.0)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)]]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), min_lines=3, min_words=50)
    return out.select("row.doc_id", "n_lines", "n_removed", "longest_run", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(read_table(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_phrases(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                                       size=10)
    n_hit = decontaminate.words_hit(F.col("hits"))
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paragraphs.dedup_paragraphs(read_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_paragraphs", F.size("removed").cast("long").alias("n_removed"),
                      F.array_join("removed", ",").alias("removed_places"),
                      F.coalesce("sources", F.expr("cast(array() as array<bigint>)")).alias("source_doc_ids"),
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: Labels may be learned from where this holds; the rest is held out.
def learnable(doc_id: str = "doc_id"):
    return crc32_of_id(F.col(doc_id)) % 3 != 1


def _scored(out: DataFrame, least: float) -> DataFrame:
    return out.select("row.doc_id", (~learnable("row.doc_id")).alias("held_out"), "score",
                      (F.col("score") >= least).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _scored(toxicity.score(docs, toxicity.fit(docs, labels, allowed=learnable())), 0.7)


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _scored(quality.score(docs, quality.fit(docs, labels, allowed=learnable())), 0.5)


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(read_table(spark, sf_dir, "documents"), SCHEDULES, share=1.5, max_repeats=2.0)


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    left_out = crc32_of_id(F.col("doc_id")) % 7 == 2
    out = maxent_lm.score(read_table(spark, sf_dir, "documents"), ~left_out)
    held_out = crc32_of_id(F.col("row.doc_id")) % 7 == 2
    return out.select("row.doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(read_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


#: Failure conditions of the audited filters, as SQL; E, copies, is the last.
AUDITED = {
    "A": "words.n < 100",
    "B": "100 * words.different < 80 * words.n",
    "C": "100 * regexp_count(text, '[A-Z]') > 10 * char_length(text)",
    "D": "text rlike '[#$%&*|]'",
}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return filter_audit.audit(docs, AUDITED, "E", F.coalesce(docs["lang"], F.lit("")),
                              {"good": labels["quality"] == 1, "toxic": labels["toxic"] == 1}, labels)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenized(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(read_table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_decontaminate": op3_decontaminate,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_learned_partitions": op6_learned_partitions,
    "op7_quality": op7_quality,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_files": op12_token_files,
    "op13_prefix_trie": op13_prefix_trie,
}

WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS dn, doc_id, string_split(text, chr(10)) AS ls
           FROM documents),
 l AS (SELECT dn, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
 f AS (SELECT dn, pos, line AS w1,
              lead(line, 1) OVER (PARTITION BY dn ORDER BY pos) AS w2, lead(line, 2) OVER (PARTITION BY dn ORDER BY pos) AS w3
       FROM l),
 c AS (SELECT dn, pos, 1 AS k, w1 AS run, len(regexp_extract_all(w1, '[^\x20\x09-\x0D]+')) >= 50 AS ok FROM f
       UNION ALL SELECT dn, pos, 2, w1 || chr(10) || w2,
              len(regexp_extract_all(w1 || chr(10) || w2, '[^\x20\x09-\x0D]+')) >= 50 FROM f WHERE w2 IS NOT NULL
       UNION ALL SELECT dn, pos, 3, w1 || chr(10) || w2 || chr(10) || w3, true FROM f WHERE w3 IS NOT NULL),
 r AS (SELECT dn, pos, k, row_number() OVER (PARTITION BY k, run ORDER BY dn, pos) AS nth FROM c WHERE ok),
 g AS (SELECT DISTINCT dn, pos + u AS pos FROM (SELECT dn, pos, unnest(range(k)) AS u FROM r WHERE nth > 1)),
 m AS (SELECT l.dn, l.pos, l.line, g.dn IS NOT NULL AS gone FROM l LEFT JOIN g ON l.dn = g.dn AND l.pos = g.pos),
 i AS (SELECT dn, gone, count(*) AS n FROM (SELECT dn, gone, pos - row_number() OVER (PARTITION BY dn, gone ORDER BY pos)
              AS isle FROM m) GROUP BY dn, gone, isle),
 t AS (SELECT dn, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
              md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
       FROM m GROUP BY dn)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
       coalesce((SELECT max(n) FROM i WHERE i.dn = d.dn AND gone), 0)::BIGINT AS longest_run, t.text_md5
FROM d LEFT JOIN t ON t.dn = d.dn
"""

OP3_SQL = f"""
WITH it AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark),
 iw AS (SELECT item_id, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda i: array_to_string(w[i+1:i+10], ' '))) AS p,
               least(len(w), 10) AS n FROM it WHERE len(w) > 0),
 d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({WORDS.format('text')}, []) AS w FROM documents),
 s AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT rn, n, unnest(range(len(w) - n + 1)) AS pos,
               unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i+1:i+n], ' '))) AS p
        FROM d, s WHERE len(w) >= n),
 h AS (SELECT rn, pos, dw.n, item_id FROM dw JOIN iw ON dw.p = iw.p AND dw.n = iw.n),
 x AS (SELECT rn, count(DISTINCT q) AS n_hit FROM (SELECT rn, unnest(range(pos, pos + n)) AS q FROM h) GROUP BY rn),
 y AS (SELECT rn, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT rn, item_id::VARCHAR AS i FROM h) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x ON d.rn = x.rn LEFT JOIN y ON d.rn = y.rn
"""

OP11_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
              [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
               100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
               (doc_id IS NULL AND first IS NOT NULL) OR coalesce(doc_id > first, false)] AS fails
       FROM w LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
       FROM m GROUP BY part, fails),
 f AS (SELECT unnest(range(1, 6)) AS i),
 o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
 s AS (SELECT o, i AS step, o[i] AS own, list_slice(o, 1, i - 1) AS earlier FROM o, f),
 x AS (SELECT c.*, o, step, own, len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone,
              len(list_filter(fails, lambda e: e)) = 1 AS single FROM c, s),
 r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails[own]), 0) AS kept,
              coalesce(sum(n) FILTER (WHERE NOT gone AND fails[own]), 0) AS removed,
              coalesce(sum(n) FILTER (WHERE gone AND fails[own]), 0) AS redundant,
              coalesce(sum(n) FILTER (WHERE single AND fails[own]), 0) AS unique_fails,
              coalesce(sum(good) FILTER (WHERE NOT gone AND fails[own]), 0) AS good_lost,
              coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails[own]), 0) AS toxic_lost
       FROM x GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda e: substr('ABCDE', e, 1)), '') AS filter_order, step::INTEGER AS step,
       kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

#: crc32 of an id's decimal text, bit by bit, for DuckDB, which has no such function.
OP13_SQL = r"""
WITH RECURSIVE
 t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
              {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, list(x ORDER BY nth) AS own FROM t GROUP BY conv_id),
 e AS (SELECT 0 AS i, range AS b, range AS v FROM range(256)
       UNION ALL SELECT i + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM e WHERE i < 8),
 k AS (SELECT list(v ORDER BY b) AS v FROM e WHERE i = 8),
 h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
              range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
              lambda a, s: xor(a >> 8, k.v[(xor(a, s) & 255) + 1])), 4294967295) % 6 AS h FROM c, k),
 r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h), []), list_slice(h.own, h + 1, len(h.own))) AS s
       FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
 p AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS d, len(s) AS n, s FROM r),
 q AS (SELECT conv_id, d, d = n AS ends, list_slice(s, 1, d) AS path, CASE WHEN d = 0 THEN 0 ELSE length(s[d].t) END AS size FROM p),
 nodes AS (SELECT path, d, min(conv_id) AS low, count(*) AS n, max(size) AS size,
              coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM q GROUP BY path, d),
 links AS (SELECT o.path, o.d, o.low, q.path AS up, q.conv_id FROM nodes o JOIN q ON q.conv_id = o.low AND q.d = o.d - 1),
 kids AS (SELECT up AS path, count(*) AS n FROM links GROUP BY up),
 below AS (SELECT q.path, sum((o.n - 1) * o.size) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
           FROM nodes o JOIN q ON q.conv_id = o.low AND q.d <= o.d LEFT JOIN kids ON kids.path = o.path GROUP BY q.path)
SELECT o.low AS conv_id, o.d::BIGINT AS depth, u.low AS parent_conv_id, o.n::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens,
       sha256(o.ends) AS ends_sha256
FROM nodes o JOIN below ON below.path = o.path LEFT JOIN kids ON kids.path = o.path
     LEFT JOIN links ON links.path = o.path LEFT JOIN nodes u ON u.path = links.up
"""

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op3_decontaminate": OP3_SQL, "op11_filter_audit": OP11_SQL,
                          "op13_prefix_trie": OP13_SQL}
