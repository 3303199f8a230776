"""The registered queries opN_<name>: thin, with the production parameters of each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, chat, decontaminate, divergence, exact_dedup, html_text, mixing, ngram_join, quality, secrets, toxicity, vector_codes, warc
from tessera.session import scratch_path, small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_report(_read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return ngram_join.jaccard_classes(docs, width=3, num=90, den=100).withColumnRenamed("class_id", "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(_read(spark, sf_dir, "embeddings"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_secret_scan, op3_byte_bpe, op4_mix_sources, op5_warc, op6_ngram_jaccard, op7_quality_rules, op8_toxicity, op9_chat_format, op10_html_text, op11_vector_codes, op12_decontaminate, op13_source_divergence)}

#: The sketches as SQL: the same log buckets, merged to three levels.
_OP7 = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS word FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS x FROM d)),
    g AS (SELECT *, CASE WHEN lead(word, 2) OVER o IS NOT NULL THEN word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o END AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
    f AS (SELECT r, i, word, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS again FROM g),
    h AS (SELECT r, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM f),
    c AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (again) AS n_repeat_words FROM h GROUP BY r),
    l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    m AS (SELECT d.doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars::DOUBLE / greatest(n_words, 1) AS m0, n_symbols::DOUBLE / greatest(n_words, 1) AS m1, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS m2 FROM m),
    p AS (SELECT lang, source, unnest([{'m': 0, 'v': m0}, {'m': 1, 'v': m1}, {'m': 2, 'v': m2}]) AS p FROM v WHERE NOT base_failed),
    b AS (SELECT lang, source, p.m AS m, CASE WHEN p.v > 1e-9 THEN ceil(ln(p.v) / ln(1.02::DOUBLE))::INT ELSE -100000 END AS b FROM p),
    s AS (SELECT 0 AS level, lang, source, m, b, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 1, lang, NULL, m, b, count(*) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, m, b, count(*) FROM b GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER (k ORDER BY b) AS upto, sum(n) OVER k AS total FROM s WINDOW k AS (PARTITION BY level, lang, source, m)),
    q AS (SELECT level, lang, source, m, max(total) AS total, min(b) FILTER (upto >= floor(0.25::DOUBLE * (total - 1)) + 1) AS b1, min(b) FILTER (upto >= floor(0.75::DOUBLE * (total - 1)) + 1) AS b3 FROM u GROUP BY level, lang, source, m),
    t AS (SELECT level, lang, source, m, CASE WHEN b1 = -100000 THEN 0 ELSE 2 / 2.02::DOUBLE * pow(1.02::DOUBLE, b1) END AS q1, CASE WHEN b3 = -100000 THEN 0 ELSE 2 / 2.02::DOUBLE * pow(1.02::DOUBLE, b3) END AS q3 FROM q WHERE total >= 100 OR level = 2),
    z AS (SELECT *, greatest(q3 - q1, CASE m WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.04::DOUBLE ELSE 0.15::DOUBLE END) AS spread FROM t),
    e AS (SELECT a.lang, a.source, z.m, arg_min(CASE WHEN m = 0 THEN q1 - 3 * spread END, level) AS low, arg_min(q3 + 3 * spread, level) AS high
          FROM (SELECT DISTINCT lang, source FROM v) a JOIN z ON (level = 2 OR a.lang IS NOT DISTINCT FROM z.lang) AND (level > 0 OR a.source IS NOT DISTINCT FROM z.source) GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce((SELECT bool_and(coalesce(CASE e.m WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END BETWEEN coalesce(low, -1e300) AND high, TRUE))
        FROM e WHERE e.lang IS NOT DISTINCT FROM v.lang AND e.source IS NOT DISTINCT FROM v.source), TRUE) AS kept FROM v"""

def _op11() -> str:
    """Four rounds and the last assignment, each with all distances; doubles hold these whole numbers exactly."""
    w = ["""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        "x AS MATERIALIZED (SELECT r, p, list_slice(q, p * (len(q) // 4) + 1, (p + 1) * (len(q) // 4)) AS v FROM k, range(4) t(p))",
        "b0 AS MATERIALIZED (SELECT p, r AS e, v FROM x WHERE r < 256)"]
    for i in range(5):
        w.append(f"""a{i} AS MATERIALIZED (SELECT r, p, arg_min({{'e': e, 'd': d}}, {{'d': d, 'e': e}}) AS a FROM (SELECT x.r, p, b.e, list_dot_product(x.v, x.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(x.v, b.v) AS d FROM x JOIN b{i} b USING (p)) GROUP BY r, p)""")
        if i < 4:
            w.append(f"""m{i} AS (SELECT p, e, list(floor(s / n) ORDER BY j) AS v FROM (SELECT p, a.e AS e, j, sum(x.v[j]) AS s, count(*) AS n FROM a{i} JOIN x USING (r, p), generate_series(1, len(x.v)) t(j) GROUP BY ALL) GROUP BY p, e),
        b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (p, e))""")
    return f"""WITH {", ".join(w)},
        c AS (SELECT r, string_agg(printf('%02x', a.e), '' ORDER BY p) AS code, sum(a.d)::BIGINT AS error FROM a4 GROUP BY r),
        h AS (SELECT sha256(string_agg(v[j]::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b4, generate_series(1, len(v)) t(j))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op11_vector_codes": _op11(),
    "op12_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS x FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS x FROM benchmark),
        w AS (SELECT DISTINCT item_id, least(len(x), 10) AS n, array_to_string(list_slice(x, s, s + 9), ' ') AS g FROM i, generate_series(1, greatest(len(x) - 9, 1)) t(s) WHERE len(x) > 0),
        o AS MATERIALIZED (SELECT DISTINCT r, s, n, g FROM (SELECT r, s, l.n, array_to_string(list_slice(x, s, s + l.n - 1), ' ') AS g FROM d, (SELECT DISTINCT n FROM w) l, generate_series(1, len(x) - l.n + 1) t(s)) SEMI JOIN w USING (n, g)),
        h AS (SELECT r, count(DISTINCT s + k) AS n_hit FROM o, range(n) t(k) GROUP BY r),
        a AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM o JOIN w USING (n, g) GROUP BY r)
        SELECT doc_id, len(x) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN a USING (r)""",
    "op13_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS x FROM documents),
        t AS MATERIALIZED (SELECT r, lang, source, unnest(x) AS term FROM d),
        k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
        g AS MATERIALIZED (SELECT a.lang, a.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN c USING (lang, source) GROUP BY ALL),
        s AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (g.n + 2 * v.v)::HUGEINT AS p, 1 + 1000000000 * (k.n + 2)::HUGEINT // (v.n + 2 * v.v)::HUGEINT AS q
              FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= 10""",
    "op4_mix_sources": f"WITH {mixing.oracle('documents', 'doc_id, source, lang')} SELECT doc_id, source, lang, topic, round(p, 6) AS probability, u < p AS kept FROM mixed_documents",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT DISTINCT h, string_agg(lpad(bin(('0x' || substr(h, i * 2 + 1, 2))::INT), 8, '0'), '' ORDER BY i) AS bits FROM (SELECT DISTINCT h FROM p), range(20) r(i) GROUP BY h),
        d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(bits, i * 5 + 1, 5))::INT + 1, 1), '' ORDER BY i) AS digest FROM b, range(32) r(i) GROUP BY h),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
        SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = least OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to FROM m JOIN d USING (h)""",
    "op6_ngram_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
        s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(x) >= 3 THEN list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.m = l.a)
        SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY d""",
    "op7_quality_rules": _OP7,
    "op9_chat_format": r"""
        WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS m FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               (3 + sum(CASE WHEN role = 'assistant' THEN n + 4 ELSE n + m + 14 END))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id, own""",
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ \\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
}
