"""Quality rules with thresholds that follow the corpus.

Each document gets integer metrics. For every (language, source) the metrics' distributions are kept as
histogram sketches, which merge by addition, so the result doesn't depend on how rows are dealt to tasks. Bins are
exact up to EXACT and keep eleven significant bits of larger values, so a sketch has a bounded number of bins and no value is cut off. Each metric's fence is read off the sketch (upper quartile plus a multiple of the quartile
distance); a group with few rows takes the fence of its language, and a language with few rows that of the corpus.
Documents are then joined with their group's fences and filtered. Everything is built from DataFrame functions.

Defined results: null text counts as empty (0 words, base_failed). Null lang or source is a group of its own.
Repeated rows stay repeated. Other columns of the input pass through `rules` unchanged; names that begin with
`_q_` are the operator's own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.llm.common import SPACES, small_join, table, words_of, written

#: Per metric: the least distance between the median and the fence, in the metric's units (per mille, tenths).
METRICS = {"symbols": 60, "capitals": 250, "marks": 120, "sameness": 450, "word_length": 40}
#: A power of two; values below it have a bin of their own.
EXACT = 2048
MIN_GROUP_ROWS = 100
FENCE = 4


def _bin(value: Column) -> Column:
    """The value itself below EXACT; beyond it, each doubling has EXACT / 2 bins. Bins rise with the values."""
    more = F.greatest(F.length(F.bin(value)) - (EXACT.bit_length() - 1), F.lit(0))
    return (more * (EXACT // 2) + F.call_function("shiftright", value, more)).cast("int")


def _length_without(text: Column, keep: str) -> Column:
    """Characters of text that are in the regex class body `keep`."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def cheap_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _q_words, _q_n_words, _q_word_chars, _q_n_symbols and the array _q_bins, one bin for each of METRICS."""
    words = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_q_words", words_of(F.col("_q_text")))
    counted = words.withColumns(
        {
            "_q_n_words": F.size("_q_words").cast("long"),
            "_q_word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "_q_n_symbols": _length_without(F.col("_q_text"), "#*$%&|<>").cast("long"),
            "_q_capitals": _length_without(F.col("_q_text"), r"\p{Lu}").cast("long"),
            "_q_marks": _length_without(F.col("_q_text"), "!?").cast("long"),
            "_q_distinct": F.size(F.array_distinct("_q_words")).cast("long"),
        }
    )
    bins = {
        "symbols": F.expr("_q_n_symbols * 1000 div greatest(_q_word_chars, 1)"),
        "capitals": F.expr("_q_capitals * 1000 div greatest(_q_word_chars, 1)"),
        "marks": F.expr("_q_marks * 1000 div greatest(_q_word_chars, 1)"),
        "sameness": F.expr("(_q_n_words - _q_distinct) * 1000 div greatest(_q_n_words, 1)"),
        "word_length": F.expr("_q_word_chars * 10 div greatest(_q_n_words, 1)"),
    }
    return counted.withColumn("_q_bins", F.array(*[_bin(bins[m]) for m in METRICS])).drop("_q_capitals", "_q_marks", "_q_distinct")


def group_key(lang: str = "lang", source: str = "source") -> dict[str, Column]:
    """Null-safe keys: a null is a group of its own and can't meet a value."""
    return {f"_q_{k}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for k, c in (("lang", lang), ("source", source))}


def sketches(measured: DataFrame) -> DataFrame:
    """(_q_lang, _q_source, metric, bin, n): the mergeable histogram sketch of each group and metric."""
    rows = measured.select("_q_lang", "_q_source", F.posexplode_outer("_q_bins").alias("metric", "bin"))  # outer: no filter on the array, which would compute it twice
    return rows.groupBy("_q_lang", "_q_source", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, fences) of sketches merged to keys."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"cum": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    quantile = lambda q: F.min(F.when(F.col("cum") * 100 >= F.col("total") * q, F.col("bin")))
    quart = ranked.groupBy(*keys, "metric").agg(quantile(25).alias("q25"), quantile(50).alias("q50"), quantile(75).alias("q75"), F.max("total").alias("rows"))
    slack = F.element_at(F.array(*[F.lit(x) for x in METRICS.values()]), F.col("metric") + 1)
    fence = F.greatest(F.col("q75") + FENCE * (F.col("q75") - F.col("q25")), F.col("q50") + slack)
    return quart.groupBy(*keys).agg(F.max("rows").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("metric", fence.alias("fence")))), lambda x: x.fence).alias("fences"))


def thresholds(sketch: DataFrame, min_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    """(_q_lang, _q_source, _q_fences): one row for each group, with the fences of the finest level that has enough rows."""
    own = _fences(sketch, ["_q_lang", "_q_source"])
    lang = _fences(sketch, ["_q_lang"]).select("_q_lang", F.col("rows").alias("lang_rows"), F.col("fences").alias("lang_fences"))
    everything = _fences(sketch.withColumn("_q_all", F.lit(0)), ["_q_all"]).select(F.col("fences").alias("all_fences"), F.lit(0).alias("_q_all"))
    chosen = F.when(F.col("rows") >= min_rows, F.col("fences")).when(F.col("lang_rows") >= min_rows, F.col("lang_fences")).otherwise(F.col("all_fences"))
    joined = own.join(lang, "_q_lang", "left").withColumn("_q_all", F.lit(0)).join(F.broadcast(everything), "_q_all", "left")
    return joined.select("_q_lang", "_q_source", chosen.alias("_q_fences"))


def _repeat_words() -> Column:
    """Words covered by three-word windows that occur twice or more, from _q_sorted: (hash, place) of windows in order."""
    twice = F.filter(
        F.col("_q_sorted"),
        lambda x, i: F.coalesce(x.h == F.get(F.col("_q_sorted"), i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(F.col("_q_sorted"), i + 1).h, F.lit(False)),
    )
    places = F.sort_array(F.transform(twice, lambda x: x.p))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a.last)).alias("n"))
    return F.aggregate(places, start, step, lambda a: a.n)


def base_counts(measured: DataFrame) -> DataFrame:
    """measured with the counts of the base rules; needs the columns of cheap_metrics."""
    lines = F.filter(F.split(F.col("_q_text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    w = F.col("_q_words")
    hashes = F.when(F.col("_q_n_words") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(3)) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    repeated = F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes")
    out = measured.withColumns({"_q_lines": lines, "_q_hashes": hashes})
    out = out.withColumn("_q_sorted", F.when(repeated, F.sort_array(F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    out = out.withColumns(
        {
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_n_repeat_words": F.coalesce(_repeat_words(), F.lit(0)).cast("long"),
        }
    )
    failed = (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))
    return out.withColumn("_q_base_failed", failed).drop("_q_words", "_q_lines", "_q_hashes", "_q_sorted")


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = MIN_GROUP_ROWS, carried: list[str] | None = None) -> DataFrame:
    """docs, row by row, with the _q_ columns: counts, _q_base_failed, _q_broken (metrics beyond their fence) and _q_kept.

    Texts are measured in one pass, which writes docs' columns, or only the carried ones, and the counts; sketches, fences and verdicts need the written counts only.
    """
    full = base_counts(cheap_metrics(docs, text)).withColumns(group_key(lang, source)).drop("_q_text")
    measured = written(full if carried is None else full.drop(*[c for c in docs.columns if c not in carried]))
    fences = written(thresholds(written(sketches(measured)), min_rows))
    judged = small_join(measured, fences, ["_q_lang", "_q_source"])
    broken = F.filter(F.transform(F.arrays_zip("_q_bins", "_q_fences"), lambda x, i: F.when(x["_q_bins"] > x["_q_fences"], i)), lambda i: i.isNotNull())
    judged = judged.withColumn("_q_broken", F.coalesce(broken, F.array().cast("array<int>")))
    return judged.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.size("_q_broken") == 0)).drop("_q_lang", "_q_source", "_q_bins", "_q_fences")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    return rules(docs).where("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules(docs, carried=["doc_id"]).select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in names])
