"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import audit, bpe, decontam, fim, jaccard, licenses, lines, packing, quality, spans, tokenfile, toxicity, urls
from keepsake.llm.common import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.remove_repeated(table(spark, sf_dir, "documents"), with_counts=True)
    return left.select("_row.doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.md5("_row.text").alias("text_md5"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), TOKENIZER))


def op3_rare_word_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("_row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, models, ["doc_id"]).withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.with_component_id(jaccard.link(table(spark, sf_dir, "documents"))).select("doc_id", "n_shingles", "component_id")


def op6_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), ["page_id"])


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as tmp:  # the files go when they have been read back
        tokenfile.write_token_file(table(spark, sf_dir, "documents"), f"{tmp.path}/token-orc", TOKENIZER)
        return tokenfile.token_index(spark, f"{tmp.path}/token-orc")


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), ["doc_id"])
    return scored.select("_row.doc_id", *quality.STATISTICS, "base_failed", "kept", "quality")


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "word", F.round("question", 6).alias("question"), F.round("answer", 6).alias("answer"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = spans.remove_repeated(table(spark, sf_dir, "documents"), with_counts=True)
    return left.select("_row.doc_id", "n_sentences", "n_removed", (F.col("n_removed") > 0).alias("repeats"), F.col("_row.text").alias("text"))


def op11_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as tmp:
        tokens = bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], BYTE_RANKS, public_tokenizers.PATTERN, tmp)
        both = bpe.decode(tokens, BYTE_RANKS)
        digests = both.select("_row.doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
        return tmp.result(digests, "tokens")


def op12_boundary_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), ["doc_id"])
    restored = fim.restore(F.col("form"), F.col("output"))
    return made.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_segment_line_dedup": op1_segment_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_rare_word_licences": op3_rare_word_licences,
    "op4_classifier_chain": op4_classifier_chain,
    "op5_grouped_prefix_join": op5_grouped_prefix_join,
    "op6_link_graph_urls": op6_link_graph_urls,
    "op7_token_orc": op7_token_orc,
    "op8_weak_supervision": op8_weak_supervision,
    "op9_bm25_decontamination": op9_bm25_decontamination,
    "op10_sentence_spans": op10_sentence_spans,
    "op11_distinct_word_bpe": op11_distinct_word_bpe,
    "op12_boundary_fim": op12_boundary_fim,
    "op13_survival_words": op13_survival_words,
}
ORACLE: dict[str, str] = {
    "op12_boundary_fim": fim.oracle(),
    "op13_survival_words": audit.oracle(),
    "op3_rare_word_licences": licenses.oracle(),
    "op5_grouped_prefix_join": """
WITH RECURSIVE lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM lowered),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
""",
}
