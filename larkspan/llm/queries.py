"""The registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import alignment, best_fit, decontamination, html_text, lines, packing, quality, simhash, substrings, token_counts, token_files, toxicity, whitening
from larkspan.llm.common import settled, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_texts(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_texts(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(_texts(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(_texts(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduped_lines(_texts(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality_rules(docs, with_text=False).select("doc_id", *quality.ADDED)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tree is stored, then gets a revision of four edits, all made from its own text and length."""
    stored = settled(token_counts.trees(_texts(spark, sf_dir)), "token-trees", "zstd")
    text = F.array_join("leaves", "")
    n = F.char_length(text).cast("int")
    edits = F.array(
        F.struct(F.floor(n / 3).cast("int").alias("start"), F.lit(5).alias("removed"), F.lit(" edited").alias("added")),
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("removed"), F.lit("Note: ").alias("added")),
        F.struct(F.floor(2 * n / 3).cast("int").alias("start"), F.lit(40).alias("removed"), F.substring(text, 1, 30).alias("added")),
        F.struct((n + 100).alias("start"), F.lit(0).alias("removed"), F.lit(" The end.").alias("added")),
    )
    return token_counts.edited(stored.withColumn("edits", edits), with_leaves=False)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_texts(spark, sf_dir))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(_texts(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_token_files": op2_token_files,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_best_fit": op13_best_fit,
}

#: White space of words and keys, for trim() and for patterns.
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _quality_sql() -> str:
    shares = {"word_length": "word_chars / greatest(n_words, 1)", "symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)"}
    quartiles = ", ".join(f"quantile_disc({k}, 0.25) AS a_{k}, quantile_disc({k}, 0.75) AS b_{k}" for k in shares)
    own = lambda side, k: f"(CASE WHEN g.n >= {quality.LEAST_GROUP} THEN g.{side}_{k} ELSE e.{side}_{k} END)"
    gap = lambda k: f"greatest({own('b', k)} - {own('a', k)}, {quality.MEASURES[k]}) * {quality.FENCE}"
    within = " AND ".join(f"m.{k} <= {own('b', k)} + {gap(k)}" for k in shares) + f" AND m.word_length >= {own('a', 'word_length')} - {gap('word_length')}"
    return rf"""
        WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
        again AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        s AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(again.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN again USING (doc_id) LEFT JOIN covered USING (doc_id)),
        m AS (SELECT *, n_words < {quality.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {quality.MOST_REPEATED} AS base_failed, {", ".join(f"{v} AS {k}" for k, v in shares.items())} FROM s),
        g AS (SELECT lang, source, count(*) AS n, {quartiles} FROM m GROUP BY lang, source),
        e AS (SELECT {quartiles} FROM m)
        SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, NOT m.base_failed AND {within} AS kept
        FROM m JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source, e"""


ORACLE_SQL: dict[str, str] = {
    "op9_quality_rules": _quality_sql(),
    "op1_main_text": r"""
        WITH article AS (SELECT page_id, url, split_part(split_part(html, '<article>', 2), '</article>', 1) AS a FROM pages),
        block AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(replace(a, '<br>', ' '), '</?b>', '', 'g'), '</?(p|h1)>'),
            lambda x: trim(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS b FROM article),
        text AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM block)
        SELECT page_id, url, text, length(text) AS n_chars FROM text""",
    "op4_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM w WHERE len(w) >= 35),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM i),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM k),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(generate_series(0, 34)) AS j) WHERE n > 1),
        each AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
        bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM b)),
        n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS m FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, m::INTEGER AS n_shared, n::INTEGER AS n_shingles, m / n AS containment FROM m JOIN n USING (item_id) WHERE m >= 0.8 * n - 1e-9""",
    "op8_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
        k AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
        m AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first, max(doc_id) OVER (PARTITION BY k) AS last FROM k),
        f AS (SELECT *, length(k) >= 10 AND first < last AND doc_id <> first AS dropped FROM m)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT dropped), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
}
