"""The registered corpus queries (``opN_<name>``) and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode_decode
from .byte_convnet import fit_language_model, predict_language
from .decontaminate import contaminated
from .filter_audit import filter_audit
from .html_tree import extract_main_text, fit_tree_model, training_pages
from .interpolated_lm import lm_scores
from .line_dedup import line_dedup
from .ngram_jaccard import ngram_jaccard_join
from .quality_lines import quality_rules
from .runtime import stored_path
from .sort_means import sort_means
from .suffix_columns import remove_repeats
from .toxicity import fit_toxicity, labelled_sample, score_toxicity
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"), exact_words=1)
    return out.select("doc_id", "n_removed", "n_near", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def held_out(modulus: int, remainder: int):
    return (F.crc32(F.col("doc_id").cast("string")) % modulus) == remainder


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(labelled_sample(docs, _table(spark, sf_dir, "labels").where(~held_out(5, 0))))
    out = score_toxicity(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"), held_out(7, 2))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = contaminated(docs, _table(spark, sf_dir, "benchmark"))
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("matched").alias("n_matched"))
    out = docs.select("doc_id").join(lists, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(_table(spark, sf_dir, "pages"), fit_tree_model(training_pages()))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode_decode(_table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = fit_language_model(docs.where(~held_out(3, 1)).select("text", "lang"))
    return predict_language(docs, net, ["doc_id"]).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_warc, op4_line_dedup, op5_toxicity, op6_lm_scoring, op7_suffix_dedup, op8_decontaminate, op9_html_extraction, op10_bpe, op11_language_id, op12_sort_means, op13_filter_audit)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _clustering_sql(rounds: int = 5, k: int = 40) -> str:
    """Lloyd's rounds in full: every distance of every round, one block of tables a round."""
    sql = f"""WITH p AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM p WHERE vec_id IS NOT NULL QUALIFY c < {k}),\n"""
    for r in range(rounds + 1):
        sql += f"""a{r} AS MATERIALIZED (SELECT row, vec_id, v, min(struct_pack(d, c)) AS best FROM (SELECT row, vec_id, v, c, list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM p, c{r}) GROUP BY row, vec_id, v),\n"""
        if r < rounds:
            sql += f"""u{r} AS (SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(w.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM u{r} GROUP BY c) w ON w.c = c{r}.c),\n"""
    return (
        sql
        + f"""h AS (SELECT c, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h ON h.c = best.c"""
    )


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op2_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
w AS (SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT row, {_WORDS.format("text")} AS ws FROM d)),
t AS (SELECT row, i, w AS a, lead(w, 1) OVER v AS b, lead(w, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY row ORDER BY i)),
k AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM t WHERE c IS NOT NULL),
rw AS (SELECT row, count(DISTINCT i + j) AS n_repeat_words FROM k, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY row),
nw AS (SELECT row, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY row),
ln AS (SELECT row, source, line, i, {_WORDS.format(_LOWER.format("line"))} AS ws FROM (SELECT row, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT row, source, string_split(text, chr(10)) AS ls FROM d))),
lw AS (SELECT row, source, line, i, array_to_string(ws, ' ') AS norm, len(ws) AS n FROM ln WHERE len(ws) > 0),
du AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY row),
lim AS (SELECT source, greatest(3, count(*) * 0.01) AS lim FROM d GROUP BY source),
cm AS (SELECT lw.source, norm FROM lw JOIN lim ON lim.source = lw.source GROUP BY lw.source, norm HAVING count(DISTINCT row) > any_value(lim)),
rm AS (SELECT row, sum(n)::BIGINT AS removed_words FROM lw JOIN cm ON cm.source = lw.source AND cm.norm = lw.norm GROUP BY row),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
 FROM d LEFT JOIN nw USING (row) LEFT JOIN rw USING (row) LEFT JOIN du USING (row) LEFT JOIN rm USING (row))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= 80 * n_words AND n_words - removed_words >= 50 AS kept FROM f""",
    "op3_warc": "WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS head FROM p)\nSELECT page_id, payload_bytes, "
    + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, {1 + 5 * k}, 5))::INT >> {b}) & 31), 1)" for k in range(8) for b in (15, 10, 5, 0))
    + " AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM s",
    "op12_sort_means": _clustering_sql(),
    "op13_filter_audit": f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT row, count(*) AS words, count(DISTINCT w) AS distinct_words FROM (SELECT row, unnest({_WORDS.format("text")}) AS w FROM d) GROUP BY row),
e AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic, (coalesce(words, 0) < 200)::INT + 2 * (100 * coalesce(distinct_words, 0) < 50 * coalesce(words, 0))::INT
 + 4 * (100 * len(regexp_extract_all(d.text, '[A-Z]')) > 3 * length(d.text))::INT + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > e.first, false)::INT AS failed
 FROM d LEFT JOIN w USING (row) LEFT JOIN e ON e.text = d.text LEFT JOIN m ON m.doc_id = d.doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[:step - 1], '') IF x <> ''])::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
t AS (SELECT c.*, s.* REPLACE (coalesce(before, 0) AS before) FROM c, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (failed & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failed & before = 0 AND failed & bit <> 0), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (failed & before <> 0 AND failed & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (failed & before = 0 AND failed & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & bit <> 0), 0)::BIGINT AS toxic_lost,
 coalesce(sum(n * (120 // greatest(bit_count(failed), 1))) FILTER (failed & bit <> 0), 0)::BIGINT AS shapley FROM t GROUP BY part, filter_order, step""",
}
