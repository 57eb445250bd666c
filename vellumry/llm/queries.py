"""Queries of the text problems (2, 5, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.llm import leakage, packing, residue, sentences, tokens
from vellumry.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    modes = table(spark, d, "format_modes").where(F.col("semantic")).select("mode").distinct()
    wanted = table(spark, d, "normalized_sources").select("source_id", "mode", "text").join(modes, "mode", "left_semi")
    return sentences.sentence_units(wanted, "source_id")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document, counted per kind of document."""
    docs = table(spark, d, "documents").select("doc_id", "kind", "text")
    counts = sentences.unit_counts(docs, "doc_id", ["kind"]).where("n_units > 0")
    return counts.groupBy("kind").agg(F.sum("n_units").alias("n_units"), F.max("n_units").alias("most_units"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "inline_regions").select("region_id", "batch_id", "mode", "source", "first_width", "final_width")
    return packing.pack_regions(regions, table(spark, d, "format_modes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.divided(_lines(spark, d))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def p5_quality(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_quality(_lines(spark, d))


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Every region whole and once on lines within the capacity."""
    return packing.packing_check(_lines(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p6_method(spark: SparkSession, d: str) -> DataFrame:
    """The replay over the words of the whole corpus: each distinct piece with its ids."""
    return tokens.corpus_words(table(spark, d, "documents"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per kind of document."""
    ids = tokens.encode_documents(table(spark, d, "documents"), keys=["kind"]).select("kind", F.size("ids").alias("n"))
    return ids.groupBy("kind").agg(F.sum("n").alias("n_tokens"), F.max("n").alias("most_tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and the number of documents that hold them."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents kept after the exclusion, per kind."""
    docs = table(spark, d, "documents").select("doc_id", "kind")
    kept = docs.join(p8_found(spark, d), "doc_id", "left_anti")
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n_kept"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p5_found, p5_lines, p5_check, p5_quality, p6_ids, p6_method, p6_counts, p7_found, p7_items, p8_found, p8_kept)}
