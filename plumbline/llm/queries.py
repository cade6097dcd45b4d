"""The registered queries of this package and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    byte_gru, host_quality, line_dedup, packing, prefix_trie, reply_trees, simhash_trie, spaced_seeds,
    spelling_variants, suffix_family, suffix_tree_lm, toxicity_chain, warc_derivatives,
)
from plumbline.llm.spark import documents
from plumbline.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


@query("op1_simhash_trie")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.similar(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


@query("op9_suffix_family")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_family.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# The same rules and prior in SQL; the numbers are those of host_quality.
HOST_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
several AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows),
hit AS (SELECT DISTINCT doc_id, i + o AS p FROM several, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1),
repeated AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
m AS (
  SELECT words.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
f AS (
  SELECT *, n_words < 50 AS f1, n_repeat_words * 100 > n_words * 50 AS f2, n_symbols * 10 > n_words AS f3,
         (word_chars < n_words * 3 OR word_chars > n_words * 10) AS f4, n_dup_lines * 10 > n_lines * 3 AS f5
  FROM m),
c AS (
  SELECT source, rule, count(*) AS n, count_if(failed) AS k
  FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS failed
        FROM f WHERE source IS NOT NULL) GROUP BY source, rule),
p AS (
  SELECT rule, count(*) AS hosts, CAST(sum(n) AS DOUBLE) AS size, sum(k) / CAST(sum(n) AS DOUBLE) AS mu,
         sum(k * k / CAST(n AS DOUBLE)) - sum(k) * (sum(k) / CAST(sum(n) AS DOUBLE)) AS q, sum(n * n) AS squares
  FROM c GROUP BY rule),
b AS (SELECT *, mu * (1 - mu) AS spread, q - (hosts - 1) * (mu * (1 - mu)) AS among, size - squares / size AS room FROM p),
s AS (
  SELECT rule, mu, CASE WHEN among > 0 AND room > 0
    THEN least(greatest(spread * room / among - 1, 10.0), 1e6) ELSE 1e6 END AS a FROM b),
bad AS (SELECT DISTINCT source FROM c JOIN s USING (rule) WHERE (k + a * mu) / (n + a) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND NOT ((f3 OR f4 OR f5) AND bad.source IS NOT NULL) AS kept
FROM f LEFT JOIN bad USING (source)
"""


@query("op8_host_quality", HOST_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_quality.judged(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def id_part(column: str = "doc_id"):
    """The remainder by which documents are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


@query("op5_suffix_tree_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scored(documents(spark, sf_dir), id_part() != 1)


@query("op10_byte_gru")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_gru.identified(documents(spark, sf_dir), id_part() != 0)


@query("op2_reply_trees")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = f"{reply_trees.CLOSE}{reply_trees.OPEN}assistant ok"
    hostile = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = reply_trees.chained(turns.unionByName(hostile))
    return reply_trees.digests(reply_trees.conversations(messages))


@query("op3_toxicity_chain")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity_chain.scored(documents(spark, sf_dir), labels, ["low_quality", "toxic"])


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return placed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op6_spaced_seeds")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op7_warc_derivatives")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc_derivatives.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc_derivatives.derivatives(pages).withColumnRenamed("key", "page_id")


LINE_SQL = r"""
WITH split AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
each AS (SELECT doc_id, text, unnest(l) AS line, unnest(range(len(l))) AS i FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, text
"""


@query("op12_line_dedup", LINE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_common_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# The checksum of an id is worked out byte by byte from its table. Totals are sums over every node below, found through
# the prefixes of its smallest member.
TRIE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    range(8), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)), CAST(i AS BIGINT))) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS own,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM turns, crc GROUP BY conv_id, t),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS l
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
pre AS (
  SELECT conv_id, d, sha256(CAST(l[1:d] AS VARCHAR) || array_to_string(list_transform(l[1:d], lambda x:
           length(x.role) || '_' || x.role || length(x.text) || '_' || x.text), ',')) AS p, l[d].text AS t, len(l) = d AS ends
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM built)),
node AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n,
         len(regexp_extract_all(coalesce(any_value(t), ''), '[^\x20\x09-\x0D]+')) AS words,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
  FROM pre GROUP BY d, p),
parent AS (
  SELECT node.*, up.p AS pp, up.conv_id AS parent FROM node
  LEFT JOIN pre ON pre.conv_id = node.conv_id AND pre.d = node.d - 1
  LEFT JOIN node up ON up.d = pre.d AND up.p = pre.p),
children AS (SELECT d - 1 AS d, pp AS p, count(*) AS k FROM parent WHERE d > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN children USING (d, p)),
total AS (
  SELECT pre.d, pre.p, count(*) FILTER (own.k = 0) AS leaves, sum((own.n - 1) * own.words) AS saved
  FROM own JOIN pre ON pre.conv_id = own.conv_id AND pre.d <= own.d GROUP BY pre.d, pre.p)
SELECT own.conv_id, own.d AS depth, parent.parent AS parent_conv_id, own.n AS n_convs, own.k AS n_children,
       total.leaves AS n_leaves, CAST(total.saved AS BIGINT) AS saved_tokens, own.ends AS ends_sha256
FROM own JOIN total USING (d, p) JOIN parent USING (d, p)
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


# Near words are found by what is left when one character is taken away: an insertion leaves the other word, a
# replacement the same rest at the same place.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    range(8), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)), CAST(i AS BIGINT))) AS t),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM runs WHERE length(r) >= 5),
hashed AS (
  SELECT r, n, xor(list_reduce(
    list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word,
         CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE length(word) >= 5 AND n >= 3),
rests AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM rests WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM rests WHERE rest IN (SELECT word FROM words)),
best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n
  FROM pairs JOIN words ON words.word = pairs.b GROUP BY a),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
         CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS reached FROM forms
  UNION SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.reached WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.n, forms.n_near, forms.form, forms.form_n, walk.reached AS root
FROM forms JOIN walk ON walk.word = forms.word JOIN forms f ON f.word = walk.reached AND f.form IS NULL
"""


@query("op11_spelling_variants", SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = cut_lineage(spelling_variants.word_counts(documents(spark, sf_dir)), "words")
    return spelling_variants.variants(words)
