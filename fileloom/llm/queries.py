"""The queries of this folder: opN_<name>(spark, sf_dir) over whole tables, and SQL for those that
SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenout import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_filter

    found, _ = quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"), per_language=1200, per_document=4)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how often the mixture uses it, and where in its source's permutation."""
    from .mixing import with_copies

    mixed = with_copies(table(spark, sf_dir, "documents"), repetition=1.5)
    return mixed.selectExpr("doc_id", "source", "mix_tokens AS n_tokens", "mix_weight AS weight", "mix_epochs AS epochs", "mix_exponent AS exponent", "mix_copies AS copies", "mix_block_rank AS block_rank", "mix_position AS position")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import tile

    found = tile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.5)
    return found.select("doc_id", "contaminated", "hit_items", "best_item", "coverage", "n_tiles")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), every=True)


#: The listed rules of op11_url_filter.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations")).drop("hi", "lo")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectorcodes import compress

    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_token_counts": op3_token_counts,
    "op10_token_output": op10_token_output,
    "op1_warc_transactions": op1_warc_transactions,
    "op9_quality_rules": op9_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op2_language_id": op2_language_id,
    "op6_source_mixing": op6_source_mixing,
    "op8_decontamination": op8_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op7_language_model": op7_language_model,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op1_warc_transactions": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, CAST(q.payload_bytes AS BIGINT) AS payload_bytes, q.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> q.page_id THEN f.first_id END AS refers_to
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest AND q.payload_bytes >= 100
""",
    "op12_prefix_trie": """
WITH t AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT c, n, c - c % 100 AS base, list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS inverse
    FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), convs AS (
    SELECT c, base, h, n, (SELECT count(*) FROM t WHERE t.c = base AND pos <= h) AS taken
    FROM (SELECT *, xor(inverse, 4294967295) % 6 AS h FROM ids)
), turns AS (
    SELECT convs.c, pos AS d, role, text FROM convs JOIN t ON t.c = base AND pos <= h
    UNION ALL SELECT convs.c, pos - h + taken, role, text FROM convs JOIN t ON t.c = convs.c AND pos > h
), keyed AS (
    SELECT c, d, text, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d) AS k FROM turns
    UNION ALL SELECT c, 0, '', [] FROM convs
), ends AS (SELECT c, max(d) AS last FROM keyed GROUP BY c),
nodes AS (
    SELECT k, min(keyed.c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(length(text)) AS chars,
           sha256(coalesce(string_agg(CAST(keyed.c AS VARCHAR), ',' ORDER BY keyed.c) FILTER (d = last), '')) AS ends_sha256
    FROM keyed JOIN ends ON keyed.c = ends.c GROUP BY k
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes AS x WHERE x.depth = n.depth + 1 AND x.k[:n.depth] = n.k) AS n_children
    FROM nodes AS n LEFT JOIN nodes AS p ON n.depth > 0 AND p.k = n.k[:n.depth - 1]
), sums AS (
    SELECT y.k, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved
    FROM linked AS x JOIN keyed AS y ON y.c = x.conv_id AND y.d <= x.depth GROUP BY y.k
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN sums ON linked.k = sums.k
""",
    "op13_vector_codes": """
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT i, p, v[1 + p * len(v) // 16 : (p + 1) * len(v) // 16] AS v FROM kept, range(16) AS r(p)
), b0 AS (SELECT p, i - 1 AS e, v FROM parts WHERE i <= 64),
a1 AS (
    SELECT i, p, arg_min(e, (d, e)) AS e FROM (
        SELECT x.i, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts AS x JOIN b0 AS b ON x.p = b.p
    ) GROUP BY i, p
), m1 AS (
    SELECT p, e, list(v ORDER BY place) AS v FROM (
        SELECT x.p, e, place, CAST(floor(sum(x.v[place]) / count(*)) AS BIGINT) AS v FROM parts AS x JOIN a1 AS a ON a.i = x.i AND a.p = x.p, range(1, 1 + len(x.v)) AS r(place) GROUP BY x.p, e, place
    ) GROUP BY p, e
), b1 AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b0 AS b LEFT JOIN m1 AS m ON m.p = b.p AND m.e = b.e),
a2 AS (
    SELECT i, p, arg_min(e, (d, e)) AS e FROM (
        SELECT x.i, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts AS x JOIN b1 AS b ON x.p = b.p
    ) GROUP BY i, p
), m2 AS (
    SELECT p, e, list(v ORDER BY place) AS v FROM (
        SELECT x.p, e, place, CAST(floor(sum(x.v[place]) / count(*)) AS BIGINT) AS v FROM parts AS x JOIN a2 AS a ON a.i = x.i AND a.p = x.p, range(1, 1 + len(x.v)) AS r(place) GROUP BY x.p, e, place
    ) GROUP BY p, e
), b2 AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b1 AS b LEFT JOIN m2 AS m ON m.p = b.p AND m.e = b.e),
last AS (
    SELECT i, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT x.i, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts AS x JOIN b2 AS b ON x.p = b.p
    ) GROUP BY i, p
), coded AS (
    SELECT i, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY i
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM kept JOIN coded ON kept.i = coded.i
""",
}
