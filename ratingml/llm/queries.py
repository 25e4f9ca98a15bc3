"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingml.llm import (
    collocations,
    fm_decontam,
    html_mss,
    minhash_forest,
    periodic_runs,
    pii_surrogates,
    quality_hosts,
    token_coder,
    toxicity_fm,
    uniform_shards,
    unigram_pieces,
    url_filter,
    warc_normal,
)
from ratingml.llm.common import UPPER, kept_apart, table
from ratingml.llm.registry import query

_LISTED_SQL = ", ".join(f"('{k}')" for k in url_filter.LISTED)
_RULES_SQL = ", ".join(
    f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_filter.RULES
)


@query(
    "op3_bloom_cascade_verdicts",
    f"""
    WITH rules(decision, rule, rule_host, rule_path) AS (VALUES {_RULES_SQL}),
    listed(key) AS (VALUES {_LISTED_SQL}),
    parts AS (
      SELECT page_id,
             translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{UPPER.lower()}') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages
    ),
    fitting AS (
      SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(decision, length(rule)) AS decision
      FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY host, path
    ),
    blocked AS (
      SELECT DISTINCT host FROM (SELECT DISTINCT host FROM parts) p JOIN listed
        ON host = key OR ends_with(host, '.' || key)
    )
    SELECT page_id, p.host, p.path, rule,
           coalesce(decision, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM parts p LEFT JOIN fitting f ON p.host = f.host AND p.path = f.path LEFT JOIN blocked b ON p.host = b.host
    """,
)
def op3_bloom_cascade_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in url_filter.LISTED], "key string")
    return url_filter.verdicts(table(spark, sf_dir, "pages"), listed)


@query(
    "op8_host_quality_rules",
    f"""
    WITH split AS (
      SELECT doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents
    ),
    windows AS (
      SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) > 2) x
    ),
    twice AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT place) AS n
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM windows JOIN twice USING (doc_id, w)) x GROUP BY doc_id
    ),
    measured AS (
      SELECT doc_id, source, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM split LEFT JOIN covered USING (doc_id)
    ),
    failed AS (
      SELECT *, n_words < {quality_hosts.MIN_WORDS} OR 100 * n_repeat_words > {quality_hosts.MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM measured
    ),
    hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM failed GROUP BY source),
    sums AS (
      SELECT count(*) AS k, sum(n) AS nt, sum(f) AS ft, sum(f) / sum(n) AS mean, sum(n * n) AS nn, sum(f * f / n) AS ff FROM hosts
    ),
    between_hosts AS (
      SELECT *, (ff - nt * mean * mean - (k - 1) * mean * (1 - mean)) / nullif(nt - nn / nt, 0) AS v FROM sums
    ),
    strengths AS (
      SELECT mean, CASE WHEN k < 2 OR ft = 0 OR ft = nt THEN 0 WHEN v <= 0 THEN 1e6
                        ELSE least(1e6, greatest(0, mean * (1 - mean) / v - 1)) END AS s FROM between_hosts
    ),
    rates AS (SELECT source, (f + mean * s) / (n + s) AS rate FROM hosts, strengths)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND rate <= {quality_hosts.MAX_RATE} AS kept
    FROM failed f JOIN rates r ON f.source IS NOT DISTINCT FROM r.source
    """,
)
def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_hosts.judge(table(spark, sf_dir, "documents")).drop("host_rate")


@query("op1_factorization_toxicity")
def op1_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_fm.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity_fm.scored(docs, model)
    return rows.select(
        "doc_id",
        toxicity_fm.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        toxicity_fm.predicted(F.col("score")).alias("predicted"),
    )


@query(
    "op7_fm_index_decontamination",
    f"""
    WITH doc_words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
    ),
    item_words AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
    ),
    windows AS (
      SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS w
      FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM item_words WHERE len(words) > 0) x
    ),
    lengths AS (SELECT DISTINCT n FROM windows),
    places AS (
      SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
      FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM doc_words, lengths WHERE len(words) >= n) x
    ),
    found AS (SELECT DISTINCT doc_id, n, i, item_id FROM places JOIN windows USING (n, w)),
    hit AS (
      SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) x GROUP BY doc_id
    ),
    items AS (
      SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY doc_id
    )
    SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_decontam.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: A fixed key keeps the query repeatable; a user passes a secret of their own.
PII_KEY = "surrogate-key-of-the-registered-query"


@query("op9_pii_surrogates")
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replaced(docs, PII_KEY, count_col="n_entities")


@query("op10_unigram_pieces")
def op10_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = unigram_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    rows = unigram_pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab, keep=["doc_id"])
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")



@query("op2_scored_main_text")
def op2_scored_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = html_mss.extracted(pages, html_mss.fit(pages))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op4_warc_normalised",
    f"""
    WITH payloads AS (
      SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest FROM pages
    ),
    newest AS (SELECT html, max(page_id) AS newest FROM payloads WHERE payload_bytes >= {warc_normal.MIN_REVISIT_BYTES} GROUP BY html)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN newest IS NULL OR newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN newest <> page_id THEN newest END AS refers_to
    FROM payloads p LEFT JOIN newest n ON p.html = n.html
    """,
)
def op4_warc_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_normal.archived(table(spark, sf_dir, "pages"))


@query("op6_context_mixed_tokens")
def op6_context_mixed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_coder.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_minhash_forest_join")
def op5_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.joined(table(spark, sf_dir, "documents")).drop("text_hash", "lead_hash")


@query("op11_hypergeometric_shards")
def op11_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uniform_shards.sharded(table(spark, sf_dir, "documents"), shards=24)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op12_stream_collocations",
    f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents
    ),
    split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
    totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang),
    windows AS (
      SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM split, (VALUES (1), (2), (3), (4)) v(k)
            WHERE len(words) >= k) x
    ),
    grams AS (SELECT lang, k, phrase, count(*) AS f FROM windows GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
    candidates AS (SELECT *, string_split(phrase, ' ') AS words FROM grams WHERE k > 1),
    cuts AS (
      SELECT lang, phrase, f, words, k, unnest(range(1, k)) AS cut FROM candidates
    ),
    scored AS (
      SELECT c.lang, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r,
             ({collocations.SCALE}::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS score
      FROM cuts c
      JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.cut], ' ')
      JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')
    ),
    lowest AS (
      SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
    ),
    inner_parts AS (
      SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, f
      FROM (SELECT lang, words, f, k, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (VALUES (2), (3)) v(m) WHERE m < k) x
    ),
    covered AS (
      SELECT DISTINCT g.lang, g.phrase FROM candidates g JOIN inner_parts p ON p.lang = g.lang AND p.phrase = g.phrase
      WHERE 100 * p.f::HUGEINT >= {collocations.COVERED_PERCENT} * g.f::HUGEINT
    ),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM lowest s WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = s.lang AND c.phrase = s.phrase)
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
    """,
)
def op12_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document, by the crc32 of its id, repeats a stretch of its words up to its end.

    With h = crc32(id), g = floor(h / 10) and h % 10 = 0, the words from a = g % n on become the first
    p = 1 + floor((n - a) / (3 + g % 8)) of them, over and over. A row without id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = kept_apart(
        docs.select("doc_id", "text"), g=F.floor(h / 10), words=F.when(h % 10 == 0, chosen).otherwise(F.lit(None))
    )
    n = F.size("words")
    rows = kept_apart(rows.withColumn("n", n), a=F.when(n > 0, (F.col("g") % n).cast("int")))
    length = F.col("n") - F.col("a")
    p = (F.lit(1) + F.floor(length / (F.lit(3) + F.col("g") % 8))).cast("int")
    times = F.ceil(length / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, p), times))
    new = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), length)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


@query("op13_automaton_runs")
def op13_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.with_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # the greatest exponent first, compared as a fraction by cross-multiplication
    better = (
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), "
        "(best, r) -> CASE WHEN best IS NULL OR CAST(r.length AS DECIMAL(19, 0)) * CAST(best.period AS DECIMAL(19, 0)) "
        "> CAST(best.length AS DECIMAL(19, 0)) * CAST(r.period AS DECIMAL(19, 0)) THEN r ELSE best END)"
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.expr(better).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return rows.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
