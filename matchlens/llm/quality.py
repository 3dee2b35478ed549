"""Quality by perplexity under an interpolated modified Kneser-Ney model of word trigrams, trained on all trusted text per language.

A document is kept if its perplexity isn't above its language's quantile among trusted documents, with some slack for short texts. The model
(wordmodel) grows with the trusted text and stays in sharded tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm import wordmodel
from matchlens.llm.common import small_ids, small_rows, written

QUANTILE = 0.995
SLACK = 2.0                  # the mean over n tokens is uncertain: a text's limit is exp(SLACK / sqrt(n)) times its language's
POOLED = wordmodel.POOLED


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per row of docs: doc_id, lang, n_symbols, perplexity (per token), threshold, keep.

    Trusted are all documents that labels call quality 1 and not toxic. A null language, or one without trusted text, uses the pooled model
    and threshold. Texts without symbols, and all texts if nothing is trusted, have a null perplexity and are kept. Repeated rows count each;
    labels may repeat.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("_good"))
    good = small_ids(good, "trusted").withColumn("_is", F.lit(True))
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(lang, F.lit(POOLED)).alias("_own"), text.alias("text"),
                       F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_symbols"))
    rows = rows.join(good, F.col("doc_id") == F.col("_good"), "left").withColumn("trusted", F.coalesce("_is", F.lit(False))).drop("_good", "_is")
    trusted = rows.where("trusted and n_symbols > 0").select(F.col("_own").alias("lang"), "text")
    languages = small_ids(trusted.select(F.col("lang").alias("_known")).distinct(), "languages")
    rows = rows.join(languages, F.col("_own") == F.col("_known"), "left").withColumn("model", F.coalesce("_known", F.lit(POOLED))).drop("_own", "_known")
    rows = rows.withColumn("row", F.xxhash64("doc_id", "lang", "text"))
    sums, models = wordmodel.scored(rows.where("n_symbols > 0").select("row", "model", "text", "trusted"))
    found = rows.drop("text").join(sums, "row", "left").join(small_rows(models), "model", "left")
    # The end of a text, too, is left out of a trusted text that alone has it.
    total = F.col("total") + F.when(F.col("trusted") & (F.col("texts") <= 1), 0.0).otherwise(F.col("last"))
    perplexity = F.when(F.col("n_symbols") > 0, F.exp(-F.col("unknown") - total / F.col("tokens")))
    found = written(found.withColumn("perplexity", perplexity), "perplexities")
    seen = found.where("trusted and perplexity is not null")
    seen = seen.select(F.explode(F.array_distinct(F.array(F.col("model"), F.lit(POOLED)))).alias("model"), "perplexity")
    limits = seen.groupBy("model").agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold"))
    own = F.col("threshold") * F.exp(SLACK / F.sqrt(F.nullif(F.col("tokens"), F.lit(0)).cast("double")))
    return found.join(small_rows(limits), "model", "left").withColumn("threshold", own).select(
        "doc_id", "lang", "n_symbols", "perplexity", "threshold",
        F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))
