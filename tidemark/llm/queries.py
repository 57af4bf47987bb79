"""One query per operator on the test tables, with its DuckDB statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize

from . import bpe, conversations, exactdup, langid, licences, neardup, packing, repetition, sharding, spelling, tokencount, urlfilter, vectors

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def _canonical_sql(text: str) -> str:
    """The canonical lines of ``licences`` in SQL."""
    notice = licences.NOTICE.replace("(?md)", "(?m)")
    form = f"regexp_replace(lower(coalesce({text}, '')), '{notice}', '', 'g')"
    form = f"regexp_replace({form}, '[^\\p{{L}}\\p{{N}}\\n]+', '  ', 'g')"
    form = f"'  ' || replace({form}, chr(10), '  ' || chr(10) || '  ') || '  '"
    for old, new in licences.SPELLINGS:
        form = f"replace({form}, ' {old} ', ' {new} ')"
    form = f"regexp_replace({form}, ' +', ' ', 'g')"
    return f"[trim(l) for l in string_split({form}, chr(10)) if trim(l) <> '']"


def _known_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in licences.KNOWN)


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_canonical_sql("text")} AS lines FROM documents),
k AS (SELECT licence, array_to_string({_canonical_sql("text")}, ' ') AS form FROM (VALUES {_known_sql()}) AS v(licence, text)),
b AS (SELECT form, min(licence) AS licence FROM k WHERE form <> '' GROUP BY form),
s AS (
  SELECT n, list_sort(list_distinct(list(b.licence))) AS line_licences
  FROM (SELECT n, unnest(lines) AS form FROM d) JOIN b USING (form) GROUP BY n
)
SELECT d.doc_id, sha256(array_to_string(d.lines, ' ')) AS text_digest, b.licence, coalesce(s.line_licences, []) AS line_licences
FROM d LEFT JOIN b ON b.form = array_to_string(d.lines, ' ') LEFT JOIN s ON s.n = d.n
"""


def op6_offset_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line's border goes by majority."""
    return tokencount.attribute(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op7_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty: no ids, and the digests of nothing."""
    docs = table(spark, sf_dir, "documents")
    coded = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


#: Two regions of four racks with three shards each, and the same with one shard more.
TREE = sharding.Tree.even(regions=2, racks=4, per_rack=3)
GROWN = TREE.grown("region1", "rack2")

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
RULE_VALUES = "(VALUES " + ", ".join(map(str, RULES)) + ") AS r(host, path, verdict)"


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by law ``key``: equal texts are not held together, equal keys are."""
    placed = sharding.placement(table(spark, sf_dir, "documents"), TREE, GROWN)
    return placed.withColumn("law", F.lit("key"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {RULE_VALUES}")
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), u AS (
  SELECT n, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
)
SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM u LEFT JOIN {RULE_VALUES}
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
QUALIFY row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) = 1
"""


def op3_star_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
  FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM u x JOIN u y USING (g) GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def op4_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdup.verdicts(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, text_sha256, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.linked(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_sum([x * x for x in e])) AS norm FROM v
  WHERE e IS NOT NULL AND len([x for x in e if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.a AS vec_id, coalesce(max(n.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""


def op9_bounded_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN, added=True)


def op10_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text", "longest_repeat")


def _same_window(words: int, level: int, name: str) -> str:
    """Whether the window of so many words from here occurs twice, told by two windows of ``level`` that cover it."""
    key = f"h{level}, lead(h{level}, {words - level}) OVER o"
    return f"CASE WHEN i + {words} <= size + 1 THEN hash({key}) END AS {name}"


def _covered(name: str, words: int) -> str:
    return f"coalesce(max(CASE WHEN n_{name} > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN {words - 1} PRECEDING AND CURRENT ROW), 0)"


LIMITS = repetition.Limits()
OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), x AS (
  SELECT n, size, unnest(w) AS word, unnest(range(1, size + 1)) AS i
  FROM (SELECT n, w, len(w) AS size FROM (SELECT n, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d))
), h1 AS (SELECT *, hash(word) AS h1 FROM x),
h2 AS (SELECT *, hash(h1, lead(h1, 1) OVER o) AS h2 FROM h1 WINDOW o AS (PARTITION BY n ORDER BY i)),
h4 AS (SELECT *, hash(h2, lead(h2, 2) OVER o) AS h4 FROM h2 WINDOW o AS (PARTITION BY n ORDER BY i)),
h8 AS (SELECT *, hash(h4, lead(h4, 4) OVER o) AS h8 FROM h4 WINDOW o AS (PARTITION BY n ORDER BY i)),
h16 AS (SELECT *, hash(h8, lead(h8, 8) OVER o) AS h16 FROM h8 WINDOW o AS (PARTITION BY n ORDER BY i)),
h32 AS (SELECT *, hash(h16, lead(h16, 16) OVER o) AS h32 FROM h16 WINDOW o AS (PARTITION BY n ORDER BY i)),
h64 AS (SELECT *, hash(h32, lead(h32, 32) OVER o) AS h64 FROM h32 WINDOW o AS (PARTITION BY n ORDER BY i)),
k AS (
  SELECT n, i, word, {_same_window(LIMITS.window, 2, "short")}, {_same_window(LIMITS.repeat, 8, "long")},
         {_same_window(LIMITS.longest + 1, 64, "whole")}
  FROM h64 WINDOW o AS (PARTITION BY n ORDER BY i)
), c AS (
  SELECT n, i, word,
         CASE WHEN short IS NOT NULL THEN count(*) OVER (PARTITION BY n, short) END AS n_short,
         CASE WHEN long IS NOT NULL THEN count(*) OVER (PARTITION BY n, long) END AS n_long,
         CASE WHEN whole IS NOT NULL THEN count(*) OVER (PARTITION BY n, whole) END AS n_whole
  FROM k
), p AS (
  SELECT n, word, n_whole, {_covered("short", LIMITS.window)} AS in_short, {_covered("long", LIMITS.repeat)} AS in_long FROM c
), m AS (
  SELECT n, count(*) AS n_words, sum(length(word)) AS word_chars, sum(in_short) AS n_repeat_words,
         sum(in_long * length(word)) AS repeat_chars, coalesce(max(n_whole), 0) > 1 AS too_long
  FROM p GROUP BY n
), l AS (
  SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n
), f AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(repeat_chars, 0)::BIGINT AS repeat_chars, coalesce(too_long, false) AS too_long
  FROM d LEFT JOIN m USING (n) LEFT JOIN l USING (n)
), b AS (
  SELECT *, n_words < {LIMITS.words} OR 100 * n_repeat_words > {LIMITS.window_percent} * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, base_failed,
       NOT base_failed AND 100 * repeat_chars <= {LIMITS.covered_percent} * word_chars AND NOT too_long AS kept
FROM b
"""


def op12_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, some of them misspelt by rule."""
    runs = spelling.runs(table(spark, sf_dir, "documents"), "doc_id", "text", 6)
    words = runs.select(spelling.misspelt(F.col("key"), F.col("word")).alias("word"))
    return spelling.grouped(materialize(spelling.vocabulary(words)))


def op13_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after some of its turns have been damaged by rule."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.verdicts(conversations.damaged(rows), ids=rows)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_hash_tree,
        op2_url_rules,
        op3_star_minhash,
        op4_digest_index,
        op5_licence_digests,
        op6_offset_sections,
        op7_transducer_bpe,
        op8_nn_descent,
        op9_bounded_best_fit,
        op10_family_svm,
        op11_suffix_repeats,
        op12_trie_pairs,
        op13_edit_lattice,
    )
}
SQL: dict[str, str] = {
    "op2_url_rules": OP2_SQL,
    "op3_star_minhash": OP3_SQL,
    "op4_digest_index": OP4_SQL,
    "op5_licence_digests": OP5_SQL,
    "op8_nn_descent": OP8_SQL,
    "op11_suffix_repeats": OP11_SQL,
}
