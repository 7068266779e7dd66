"""Registered queries of the operators in this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm import audit, fim, identifiers, language, lines, near_text, packing, pieces, quality, toxicity, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def _query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(parts: int, held: int) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo ``parts``. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))


@_query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs.where(~fold(4, 2)))
    return language.identify(docs, profiles).select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


@_query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~fold(5, 0)))
    return toxicity.score(docs, model).select("doc_id", fold(5, 0).alias("held_out"), "score", "predicted")


@_query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels").where(~fold(3, 1)))
    return quality.score(docs, model).select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


@_query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query(
    "op5_topk_search",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
       s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
         FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
       SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
         (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vectors.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


@_query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.find(_table(spark, sf_dir, "documents"))


@_query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


@_query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op9_embedding_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text with merge-dropout, and whether they decode to the text again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    coded = pieces.encode(docs, model, keep=("text_crc32",)).withColumn("n_ids", F.size("ids").cast("bigint")).withColumn("ids_crc32", F.crc32(F.array_join("ids", " ")))
    back = pieces.decode(coded, model, keep=("text_crc32", "n_ids", "ids_crc32"))
    return back.select("doc_id", "n_ids", "ids_crc32", (F.crc32("decoded") == F.col("text_crc32")).alias("round_trip"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@_query(
    "op11_quality_rules",
    rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
       g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
       again AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
       repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM again GROUP BY doc_id),
       l AS (SELECT doc_id, host, text, line, {_WORDS.format(f"translate(line, '{_UPPER}0123456789', '{_LOWER}0000000000')")} AS lw
         FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
       full_lines AS (SELECT *, array_to_string(lw, ' ') AS norm FROM l WHERE len(lw) > 0),
       frequent AS (SELECT host, norm FROM full_lines GROUP BY host, norm HAVING count(DISTINCT text) > 10),
       per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(len(lw)) FILTER (WHERE f.norm IS NOT NULL), 0) AS gone
         FROM full_lines LEFT JOIN frequent f USING (host, norm) GROUP BY doc_id),
       r AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS removed_words FROM d LEFT JOIN per USING (doc_id) LEFT JOIN repeated USING (doc_id))
       SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * (n_words - removed_words) < 50 * n_words AS kept FROM r""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(_table(spark, sf_dir, "documents"))


@_query(
    "op12_filter_audit",
    rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
       f AS (SELECT part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM d LEFT JOIN labels USING (doc_id)),
       cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
       letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
       orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
       met AS (SELECT *, coalesce(list_min(list_filter(range(1, 6), lambda s: contains(fails, filter_order[s]))), 6) AS hit FROM cells, orders),
       steps AS (SELECT part, filter_order, step, filter_order[step] AS x, fails, hit, n, good, toxic FROM met, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
       r AS (SELECT part, filter_order, step, x, sum(n) FILTER (WHERE hit > step) AS kept, sum(n) FILTER (WHERE hit = step) AS removed, sum(n) FILTER (WHERE hit < step AND contains(fails, x)) AS redundant,
         sum(n) FILTER (WHERE fails = x) AS unique_fails, sum(good) FILTER (WHERE hit = step) AS good_lost, sum(toxic) FILTER (WHERE hit = step) AS toxic_lost FROM steps GROUP BY ALL)
       SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
         CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley FROM r""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(
    "op13_fill_in_middle",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
       h AS (SELECT doc_id, text, t, len(t) AS n, list_transform([1, 9, 17, 25], lambda a: CAST('0x' || x[a:a + 7] AS BIGINT)) AS h FROM d),
       c AS (SELECT doc_id, text, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
       p AS (SELECT doc_id, text, n, form, array_to_string(t[1:low], '') AS p, array_to_string(t[low + 1:high], '') AS m, array_to_string(t[high + 1:n], '') AS s FROM c)
       SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
         sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_table(spark, sf_dir, "documents"))
    back = fim.restore(made.withColumn("output_sha256", F.sha2("output", 256)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("text", 256).alias("restored_sha256"))
