"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelspark.llm import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import exact_dedup

    docs = exact_dedup.numbered(_table(spark, sf_dir, "documents"))
    return exact_dedup.decide(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import audio

    return audio.digests(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import substring_dedup

    cut = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import jaccard_join

    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelspark.llm import storage, token_files

    target = storage.fresh_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2)
    return token_files.read(spark, target)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import url_filters as u

    return u.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), u.HOST_RULES, u.TOKEN_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import sharding

    return sharding.shard(_table(spark, sf_dir, "documents"), 24)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import mixing

    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import clustering

    return clustering.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import lexical_search

    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm import language

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~F.coalesce(language.held_out(), F.lit(False))))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.concat_ws("+", "lang_set").alias("lang_set"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _clustering_sql(rounds: int) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS (
            SELECT vec_id, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': cluster}}) AS best
            FROM kept, c{i} GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""
        u{i} AS (SELECT best.c AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}),
        s{i} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM u{i} GROUP BY cluster, i),
        m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY cluster),
        c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < 16),{",".join(steps)}
        SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
               (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON best.c = cluster"""


ORACLE_SQL = {
    "op11_clustering": _clustering_sql(3),
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
        t AS (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
        size AS (SELECT count(DISTINCT r)::HUGEINT AS nn, count(*)::HUGEINT AS ll FROM t),
        f AS (SELECT r, doc_id, n, term, count(*)::HUGEINT AS tf FROM t GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, size GROUP BY term, nn),
        q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
            FROM benchmark),
        q2 AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        s AS (
            SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
            FROM q2 JOIN f USING (term) JOIN w USING (term), size GROUP BY item_id, r, doc_id),
        o AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op8_url_filters": r"""
        WITH p AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        f AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS v
            FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
        SELECT p.page_id, host, path, rule,
               coalesce(v, CASE WHEN list_has_any(string_split_regex(host, '[^A-Za-z0-9]+'), ['casino', 'poker', 'adult', 'porn', 'xxx', 'viagra', 'torrent', 'warez', 'spam', 'win']) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN f USING (page_id)""",
}
