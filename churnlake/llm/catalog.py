"""Registered queries of the subpackage: the operators with production parameters on their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytebpe, conversations, edits, exact, lexical, near, packing, pii, quality, substrings, topk, toxicity
from .scan import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


@query("op1_personal_data")
def personal_data(spark, sf_dir):
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op3_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), scored AS (
      SELECT a.vec_id AS query_id, b.vec_id,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
      WHERE a.vec_id % 50 = 0
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def exact_top_k(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query(
    "op4_exact_dedup",
    """
    WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           coalesce(doc_id = max(doc_id) OVER same, false) AS kept, text_sha256
    FROM t WINDOW same AS (PARTITION BY text_sha256)
    """,
)
def exact_dedup(spark, sf_dir):
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def quality_classifier(spark, sf_dir):
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op6_minhash_near_dedup")
def minhash_near_dedup(spark, sf_dir):
    return near.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


@query("op7_toxicity")
def toxicity_scores(spark, sf_dir):
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op8_substring_dedup")
def substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op9_edit_aware_counts")
def edit_aware_counts(spark, sf_dir):
    return edits.count_under_edits(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_bpe_round_trip")
def bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_byte_bpe")
def byte_bpe(spark, sf_dir):
    return bytebpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query(
    "op12_conversation_trie",
    """
    WITH t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
      SELECT DISTINCT conv_id, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE (x >> 1) + y END))) % 6 AS h
      FROM t
    ), r AS (
      SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
      UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
    ), p AS (
      SELECT conv_id, row_number() OVER path AS depth, length(text) AS chars,
        string_agg(sha256(length(role) || ':' || role || text), ',') OVER path AS key
      FROM r WINDOW path AS (PARTITION BY conv_id ORDER BY part, pos)
      UNION ALL SELECT conv_id, 0, 0, '' FROM c
    ), q AS (SELECT *, lag(key) OVER path AS parent, lead(key) OVER path AS child FROM p WINDOW path AS (PARTITION BY conv_id ORDER BY depth)),
    node AS (
      SELECT key, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, count(DISTINCT child) AS n_children,
        (count(*) - 1) * any_value(chars) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (child IS NULL), '')) AS ends_sha256
      FROM q GROUP BY key, depth, parent
    ), below AS (
      SELECT p.key, p.depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
      FROM node JOIN p ON p.conv_id = node.conv_id AND p.depth <= node.depth GROUP BY p.key, p.depth
    )
    SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM node n JOIN below b ON n.key = b.key AND n.depth = b.depth LEFT JOIN node up ON up.key = n.parent AND up.depth = n.depth - 1
    """,
)
def conversation_trie(spark, sf_dir):
    return conversations.prefix_trie(read_table(spark, sf_dir, "conversations"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    "op13_lexical_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS terms FROM documents),
    s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
    tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) GROUP BY ALL),
    q AS (
      SELECT DISTINCT item_id, unnest({_TERMS}) AS term
      FROM (SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
    ), w AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, s GROUP BY term, n_docs
    ), scored AS (
      SELECT item_id, row_id, doc_id, CAST(sum(w * ((1000000000 * tf) //
        (1000 * tf + 20 * (50 + ((50 * len(terms) * n_docs) // n_terms))))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (row_id), s
      WHERE doc_id IS NOT NULL GROUP BY item_id, row_id, doc_id
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
)
def lexical_search(spark, sf_dir):
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 50)
