"""Queries over the given tables: each applies one operator with its production parameters and returns the whole result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.lm_scoring import lm_scores

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return lm_scores(table(spark, sf_dir, "documents"), held_out).drop("n_bytes")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.warc import archive, read_archive

    found = read_archive(spark, archive(table(spark, sf_dir, "pages"), nameless=True))
    page = lambda urn: F.when(urn.startswith("urn:page:"), F.substring_index(urn, ":", -1)).cast("long")
    whole = F.col("payload").isNotNull()
    return found.select(
        page(F.col("record_id")).alias("page_id"), F.when(whole, F.length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.line_dedup import dedup_lines

    rows = dedup_lines(table(spark, sf_dir, "documents"), exact_chars=1)
    return rows.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2("text", 256).alias("text_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), BYTE_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.pii import listed, personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.stop - x.start)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.quality_rules import quality_rules

    rows = quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "quality")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.quality_classifier import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.alignment import aligned

    rows = aligned(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.coalesce("groups", F.lit("")).alias("groups_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    rows = toxicity(docs, fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_words", "n_matches")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnweave.llm.merkle import folded, leaf, manifest

    docs = table(spark, sf_dir, "documents")
    # Tampering of every seventh document: its n_chars is one more.
    changed = leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars").cast("decimal(20,0)") + 1, F.col("text")])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.when(F.col("n_chars").isNotNull(), changed))
    rows = manifest(docs, also=tampered)
    proof = F.array_join(F.transform("path", lambda s: F.coalesce(s["digest"], F.lit(""))), "")
    found = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded(F.coalesce("also", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def base_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: all but the model's own score."""
    return op1_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: how many spans of each base kind a text has."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: the base's counts and verdict."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_warc, op3_token_counts, op4_line_dedup, op5_packing, op6_pii, op7_decontamination, op8_quality_rules, op9_quality_classifier, op10_simhash, op11_alignment, op12_toxicity, op13_merkle, base_lm_scoring, base_pii, base_quality_rules)}

#: CRC-32 of a number's decimal digits, a bit at a time.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::UBIGINT)"""

#: A field as it goes into a leaf: byte count and value, or a dash.
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"

#: DuckDB SQL for queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT *, strlen(html) >= 1000 AND max(page_id) OVER copies IS NOT NULL AND row_number() OVER (copies ORDER BY page_id DESC NULLS LAST) > 1 AS again, max(page_id) OVER copies AS first FROM p WINDOW copies AS (PARTITION BY html))
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM k
    """,
    "op7_decontamination": r"""
        WITH lowered AS (
            SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
            UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
        worded AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
        windows AS (SELECT DISTINCT id AS item, w[k:k + least(10, len(w)) - 1] AS words FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM worded WHERE side = 'b' AND len(w) > 0)),
        sizes AS (SELECT DISTINCT len(words) AS size FROM windows),
        places AS (SELECT id, k, size, w[k:k + size - 1] AS words FROM (SELECT id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM worded, sizes WHERE side = 'd' AND len(w) >= size)),
        found AS (SELECT p.id, p.k, p.size, i.item FROM places p JOIN windows i ON p.words = i.words),
        hits AS (SELECT id, count(DISTINCT spot) AS n_hit FROM (SELECT id, unnest(generate_series(k, k + size - 1)) AS spot FROM found) GROUP BY 1),
        named AS (SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM found) GROUP BY 1)
        SELECT d.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM worded d LEFT JOIN hits h ON d.id = h.id LEFT JOIN named n ON d.id = n.id WHERE side = 'd'
    """,
    "op13_merkle": r"""
        WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({head} || {n} || {text}) AS leaf, sha256({head} || {more} || {text}) AS changed, {crc} % 7 = 0 AS hit FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
        nodes(lang, level, i, h, n) AS (SELECT lang, 0, i, leaf, n FROM l UNION ALL
            SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
        sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops(level, i, h, n) AS (SELECT 0, i, h, n FROM sub UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2),
        steps AS (SELECT p.lang, p.level, p.i, CASE WHEN s.h IS NULL THEN '' WHEN s.i < p.i THEN '<' || s.h ELSE '>' || s.h END AS step FROM nodes p
            LEFT JOIN nodes s ON p.lang IS NOT DISTINCT FROM s.lang AND p.level = s.level AND s.i = xor(p.i, 1) WHERE p.n > 1),
        top_steps AS (SELECT p.level, p.i, CASE WHEN s.h IS NULL THEN '' WHEN s.i < p.i THEN '<' || s.h ELSE '>' || s.h END AS step FROM tops p LEFT JOIN tops s ON p.level = s.level AND s.i = xor(p.i, 1) WHERE p.n > 1),
        low AS (SELECT l.lang, l.i, list(step ORDER BY level) FILTER (step IS NOT NULL) AS steps FROM l LEFT JOIN steps s ON l.lang IS NOT DISTINCT FROM s.lang AND s.i = l.i >> s.level GROUP BY 1, 2),
        high AS (SELECT sub.lang, sub.h, list(step ORDER BY level) FILTER (step IS NOT NULL) AS steps FROM sub LEFT JOIN top_steps s ON s.i = sub.i >> s.level GROUP BY 1, 2),
        whole AS (SELECT l.*, high.h AS subroot, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS path FROM l
            JOIN low ON l.lang IS NOT DISTINCT FROM low.lang AND l.i = low.i JOIN high ON l.lang IS NOT DISTINCT FROM high.lang),
        done AS (SELECT *, (SELECT h FROM tops WHERE n = 1) AS root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
            list_reduce(list_prepend(CASE WHEN hit THEN changed ELSE leaf END, path), lambda h, s: sha256(CASE s[1] WHEN '<' THEN s[2:] || h WHEN '>' THEN h || s[2:] ELSE h END)) AS folded_root FROM whole)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
    """.replace("{head}", " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang"))).replace("{n}", _FIELD.format("n_chars")).replace("{more}", _FIELD.format("(n_chars + 1)")).replace("{text}", _FIELD.format("text")).replace("{crc}", _CRC32.format("doc_id")),
    "base_lm_scoring": r"""
        WITH d AS (SELECT doc_id, {crc} % 5 = 1 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
        t AS (SELECT doc_id, held_out, unnest(w) AS token FROM d),
        c AS (SELECT token, count(*) FILTER (NOT held_out) AS c FROM t GROUP BY 1),
        n AS (SELECT sum(c)::BIGINT AS n, count(*) FILTER (c > 0) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, n AS train_tokens, round(sum(log10((c + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
        FROM t JOIN c USING (token), n GROUP BY doc_id, held_out, n
    """.replace("{crc}", _CRC32.format("doc_id")),
    "base_pii": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
            list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones FROM d)
        SELECT doc_id, n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INT), 0) > 255)) = 0))::BIGINT AS n_ip,
            len(list_filter(cards, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(x), ''), lambda c, k: CASE WHEN k % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0))::BIGINT AS n_card,
            len(list_filter(phones, lambda x: length(x) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM m
    """,
    "base_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        k AS (SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS k, w FROM d WHERE len(w) >= 5),
        s AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS words FROM k), again AS (SELECT doc_id, words FROM s GROUP BY ALL HAVING count(*) > 1),
        hit AS (SELECT doc_id, count(DISTINCT spot)::BIGINT AS n FROM (SELECT s.doc_id, unnest(generate_series(k, k + 4)) AS spot FROM s JOIN again ON s.doc_id = again.doc_id AND s.words = again.words) GROUP BY 1),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM d),
        b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN hit ON d.doc_id = hit.doc_id)
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
    """,
}
