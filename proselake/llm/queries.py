"""The queries opN_<name> over whole tables, and the pipeline over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contained_items
from .host_rules import judged
from .html_text import main_text
from .mixing import mix_documents
from .ngram_join import jaccard_components
from .sharding import shard_documents
from .source_audit import divergence
from .span_dedup import repeated_spans
from .token_counts import VOCABULARY, token_counts
from .topk import top_k
from .toxicity import toxicity_scores
from .url_filter import judge_urls
from .url_seeds import seeds
from .whitening import whiten

#: The rules of op10, by host and path.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets reach a Jaccard of 0.85; nulls, empty texts and repeats as in jaccard_components."""
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of every text; null and empty ones have 0."""
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of every row whose id is divisible by 20; what takes no part is named in top_k."""
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty pages have an empty one."""
    return main_text(_table(spark, sf_dir, "pages"))


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 400 bytes take from every text; ``runs`` are the removed byte ranges, ``changed`` whether there are any."""
    found = repeated_spans(_table(spark, sf_dir, "documents"), length=400, gram=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs", (F.col("n_removed") > 0).alias("changed"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text, learned from rows that are not held out; nulls, empty, long and repeated texts as in toxicity_scores."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold; rows without an id can't be named here, the pipeline's stage finds them as well."""
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row by the law ``bytes``; nulls, empty tables and repeats as in shard_documents."""
    return shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null sources and texts, empty tables and repeats as in mix_documents."""
    return mix_documents(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every page by the rules, else by trees learned from the URLs of url_seeds; null and odd urls as in judge_urls."""
    labelled = spark.createDataFrame(seeds(), "url string, blocked int")
    return judge_urls(_table(spark, sf_dir, "pages"), labelled, URL_RULES)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every vector; what takes no part, and what is null, is named in whiten."""
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every text, with its source as its host; nulls, empty and long texts, repeats as in judged."""
    return judged(_table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language and their most telling terms; nulls, empty tables, ties and repeats as in divergence."""
    return divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_token_counts": op2_token_counts,
        "op3_exact_topk": op3_exact_topk,
        "op4_html_text": op4_html_text,
        "op5_span_dedup": op5_span_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_decontamination": op7_decontamination,
        "op8_sharding": op8_sharding,
        "op9_mixing": op9_mixing,
        "op10_url_filter": op10_url_filter,
        "op11_whitening": op11_whitening,
        "op12_host_rules": op12_host_rules,
        "op13_source_audit": op13_source_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": """
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], chr(10)) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            e AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
            r(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.x)
            SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(x) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
        "op3_exact_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id AND q.vec_id % 20 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
            SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 20""",
        "op5_span_dedup": """
            WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
            w AS (SELECT doc_id, i, hash(b[i:i+399]) AS k FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)),
            s AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
            o AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS new FROM s),
            g AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
            r AS (SELECT doc_id, run, min(i) - 1 AS a, max(i) + 399 AS z FROM g GROUP BY 1, 2),
            p AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS y FROM r),
            t AS (SELECT d.doc_id, sum(z - a) AS gone, count(*) AS spans, list([a, z] ORDER BY run) AS runs, string_agg(hex(b[y + 1:a]), '' ORDER BY run) || hex(any_value(b)[max(z) + 1:any_value(n)]) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY d.doc_id)
            SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, hex(b)))) AS kept_sha256, coalesce(runs, []) AS runs, gone IS NOT NULL AS changed FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
        "op7_decontamination": """
            WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
            w AS (SELECT kind, id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM t WHERE text IS NOT NULL AND id IS NOT NULL),
            s AS (SELECT DISTINCT kind, id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
            n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id),
            c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS c FROM s d JOIN s b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 GROUP BY 1, 2)
            SELECT doc_id, item_id, n AS n_item, c AS n_common, c / n AS containment FROM c JOIN n ON n.id = item_id WHERE c >= ceil(n * CAST(0.8 AS DOUBLE))""",
        "op12_host_rules": """
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
            k AS (SELECT r, i, w[i:i+7] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
            p AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS j FROM (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, k) > 1)) GROUP BY r),
            m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p ON p.r = d.r),
            e AS (SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(bad AS INT)) AS DOUBLE) AS f FROM (
                SELECT host, unnest(['symbols', 'lines', 'lengths']) AS rule, unnest([10 * n_symbols > n_words, 2 * n_dup_lines > n_lines, word_chars > 10 * n_words OR word_chars < 3 * n_words]) AS bad
                FROM m WHERE host IS NOT NULL) GROUP BY host, rule),
            g AS (SELECT rule, count(*) AS h, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) AS s, sum(n * n) AS n2 FROM e GROUP BY rule),
            c AS (SELECT rule, n, m, CASE WHEN m * (1 - m) > 0 AND n - n2 / n - (h - 1) > 0 THEN (s - n * m * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (n - n2 / n - (h - 1))) ELSE 0 END AS c FROM g),
            b AS (SELECT rule, m, CASE WHEN c > 0 THEN least(greatest(1 / c - 1, 1), greatest(n, 1)) ELSE greatest(n, 1) END AS z FROM c),
            v AS (SELECT host, max(x) > 0.5 AS rejected, bool_or(x >= 0.01 AND rule = 'symbols') AS a1, bool_or(x >= 0.01 AND rule = 'lines') AS a2, bool_or(x >= 0.01 AND rule = 'lengths') AS a3
                FROM (SELECT e.host, e.rule, (e.f + b.m * b.z) / (e.n + b.z) AS x FROM e JOIN b ON b.rule = e.rule) GROUP BY host),
            z AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(v.rejected, false) AS host_rejected,
                coalesce((a1 AND 10 * n_symbols > n_words) OR (a2 AND 2 * n_dup_lines > n_lines) OR (a3 AND (word_chars > 10 * n_words OR word_chars < 3 * n_words)), false) AS breaks FROM m LEFT JOIN v ON v.host = m.host)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR host_rejected OR breaks) AS kept, host, host_rejected FROM z""",
        "op13_source_audit": """
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
            w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
            k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
            v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
            c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
            s AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
            p AS (SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + CAST(1000000000 * (coalesce(c.c, 0)::HUGEINT + 2) // (s.n + 2 * v.v) AS HUGEINT) AS p
                FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
            l AS (SELECT lang, sum(n) AS n FROM s GROUP BY lang),
            q AS (SELECT c.lang, c.term, 1 + CAST(1000000000 * (sum(c.c)::HUGEINT + 2) // (any_value(l.n) + 2 * any_value(v.v)) AS HUGEINT) AS q FROM c JOIN l ON l.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY 1, 2),
            x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
            o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM s a JOIN s b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
                UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q),
            z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
            SELECT * FROM z WHERE part = 'pair' OR rank <= 10""",
    }
