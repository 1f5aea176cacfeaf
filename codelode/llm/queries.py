"""Queries of the text operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.handwritten import not_handwritten
from codelode.llm.language import document_languages, known_names, language_segments, unlabelled_languages
from codelode.llm.leaks import leaked_passages
from codelode.llm.mixing import mix
from codelode.llm.pairs import documented_functions, source_pairs
from codelode.session import cut
from codelode.sources.tables import load


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return documented_functions(load(spark, folder, "symbols")).select("id")


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documented_functions(load(spark, folder, "symbols"))


def p2_source_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that stand in the code of documents themselves."""
    return source_pairs(load(spark, folder, "documents"), "doc_id", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(load(spark, folder, "files"), load(spark, folder, "symbols")).select("file_id").distinct()


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(load(spark, folder, "files"), load(spark, folder, "symbols"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a window of an item word for word."""
    return leaked_passages(load(spark, folder, "documents"), load(spark, folder, "eval_items")).where("edits = 0").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the windows that are an edit away, and how many windows matched."""
    return leaked_passages(load(spark, folder, "documents"), load(spark, folder, "eval_items"))


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    return mix(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))[1]


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per target: its documents, how many of them are used more often than allowed, and whether its share is missed by more than a document of each source weighs."""
    targets = load(spark, folder, "mix_targets")
    uses, report = mix(load(spark, folder, "documents"), targets)
    uses = cut(uses)
    cap = report.select("source", "max_repeats")
    per = uses.join(F.broadcast(cap), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_over_cap"))
    heaviest = uses.agg(F.max("tokens").alias("heaviest"))
    total = report.agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"))
    sizes = heaviest.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k")
    told = report.withColumn("_k", F.lit(1)).join(F.broadcast(sizes), "_k").join(per, "source", "left")
    off = F.abs(F.col("tokens") - F.col("target_share") * F.col("total")) > F.col("heaviest") * (1 + F.col("n") * F.col("target_share"))
    zero = F.lit(0).cast("long")
    return told.select("source", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("n_over_cap", zero).alias("n_over_cap"), (F.col("n_documents").isNotNull() & off).cast("int").alias("missed"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, samples = load(spark, folder, "documents"), load(spark, folder, "lang_samples")
    return unlabelled_languages(language_segments(documents, samples), documents, names=known_names(samples))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language_segments(load(spark, folder, "documents"), load(spark, folder, "lang_samples"))


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One language per document, with a confidence, beside the one its label names."""
    documents, samples = load(spark, folder, "documents"), load(spark, folder, "lang_samples")
    segments = cut(language_segments(documents, samples))
    return document_languages(segments, documents, names=known_names(samples)).withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p2_source_pairs, p5_found, p5_reasons, p6_found, p6_leaks, p7_copies, p7_shares, p7_invariants, p8_found, p8_segments, p8_documents)}

# What SQL can say of these: leaks are equal runs of words, found here by an equality join.
_WORDS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x))"
_SOURCE = r"nullif(regexp_replace(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))), '[\s\-]+', '_', 'g'), '')"
ORACLE = {
    "p7_invariants": f"""WITH d AS (SELECT doc_id, min({_SOURCE}) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY 1), t AS (SELECT DISTINCT {_SOURCE} AS source FROM mix_targets WHERE target_share > 0 AND max_repeats > 0)
 SELECT t.source, count(d.doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_over_cap, 0 AS missed FROM t LEFT JOIN d ON d.source = t.source WHERE t.source IS NOT NULL GROUP BY 1""",
    "p6_found": f"""WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items),
 iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[s : s + least(len(w), 13) - 1] AS win FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS s FROM i WHERE len(w) > 0)),
 lens AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT DISTINCT doc_id, n, w[s : s + n - 1] AS win FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d JOIN lens ON len(w) >= n))
 SELECT DISTINCT dw.doc_id, iw.item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.win = dw.win""",
}
