"""Secret scans: single-pattern finds, and credentials whose parts lie apart.

Strong finds need one pattern only (assign, access, hex). Weak parts - short assigned values, account names, endpoints -
say little alone. A weak part is reported only when parts that complement it occur within the same scope, a stretch of
`REACH` characters: a weak secret needs an account, an access identifier or an endpoint; an account needs a secret; an
endpoint needs both a secret and an account or access identifier. The interval join runs as a merge: within a document,
parts are ordered by place, and the nearest complementary part before and after each part is looked up in windows, so
no pairs are made. Everything is built from DataFrame functions.

Defined results: null text counts as empty. Repeated rows come back as often as they went in. A null doc_id is kept.
Extra columns are ignored. An empty table gives an empty result. Work and memory grow with the parts of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.llm.common import table

#: Kinds in the order in which equal starts are listed: pattern, group that has a least length, that length.
STRONG = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 0),
    "hex": (r"[0-9a-f]{16,}", 0, 0),
}
WEAK = {
    "weak_secret": (r"""(?<![A-Za-z0-9_])(?i:(?:password|passwd|secret|token|api_?key|pwd|passphrase|auth|credential)s?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{6,})""", 0, 0),
    "account": (r"""(?<![A-Za-z0-9_])(?i:(?:user(?:_?name)?|login|account|(?:client|access_?key)_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]{3,})""", 0, 0),
    "endpoint": (r"""(?<![A-Za-z0-9_])(?i:(?:[a-z][a-z0-9+.-]*://[^\s"'<>]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]+)?))""", 0, 0),
}
KINDS = [*STRONG, *WEAK]
REACH = 240


def spans(text: Column, kind: str) -> Column:
    """array<struct<s, e, k>> of a kind's matches, leftmost and not overlapping; places in code points."""
    pattern, group, least = (STRONG | WEAK)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,k:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc.at + F.length(x.g)
        e = s + F.coalesce(F.length(x.f), F.lit(0))
        hit = F.coalesce(F.length(x.v) >= least, F.lit(False))
        row = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(KINDS.index(kind)).alias("k")))
        return F.struct(e.alias("at"), F.when(hit, F.concat(acc.out, row)).otherwise(acc.out).alias("out"))

    zipped = F.arrays_zip(gaps.alias("g"), found.alias("f"), value.alias("v"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda a: a.out)).otherwise(F.array().cast("array<struct<s:int,e:int,k:int>>"))


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, first, s, e, k): one row for each part of a document, or one without a part. h tells texts of one doc_id apart."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = found.select("doc_id", F.xxhash64("t").alias("h"), F.concat(*[spans(F.col("t"), k) for k in KINDS]).alias("parts"))
    return found.select("doc_id", "h", F.posexplode_outer("parts").alias("i", "p")).select("doc_id", "h", (F.coalesce("i", F.lit(0)) == 0).alias("first"), "p.s", "p.e", "p.k")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """found with `told`: whether the part is to be reported."""
    doc = Window.partitionBy("doc_id", "h")
    before = doc.orderBy("s", "e", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = doc.orderBy(F.desc("s"), F.desc("e"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)  # in falling order, as a running frame is linear
    k = {name: F.col("k") == i for i, name in enumerate(KINDS)}
    inside_strong = F.coalesce(F.max(F.when(k["assign"] | k["hex"], F.col("e"))).over(before) > F.col("s"), F.lit(False))
    groups = {"secret": k["assign"] | k["hex"] | k["weak_secret"], "name": k["access"] | k["account"], "place": k["endpoint"]}
    near = {}
    for name, of in groups.items():
        left = F.max(F.when(of, F.col("e"))).over(before) >= F.col("s") - reach
        right = F.min(F.when(of, F.col("s"))).over(after) <= F.col("e") + reach
        near[name] = F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))
    told = (
        F.when(F.col("k") < len(STRONG), F.lit(True))
        .when(k["weak_secret"], (near["name"] | near["place"]) & ~inside_strong)
        .when(k["account"], near["secret"])
        .when(k["endpoint"], near["secret"] & near["name"])
    )
    return found.withColumn("told", F.coalesce(told, F.lit(False)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(doc_id, base, spans): for each row of docs, its strong spans and all reported spans as arrays of (s, k, e)."""
    found = linked(parts(docs, doc_id, text), reach)
    span = lambda which: F.array_sort(F.collect_set(F.when(which, F.struct("s", "k", "e"))))
    out = found.groupBy("doc_id", "h").agg(span(F.col("told") & (F.col("k") < len(STRONG))).alias("base"), span(F.col("told")).alias("spans"), F.sum(F.col("first").cast("int")).cast("int").alias("times"))
    return out.select("doc_id", "base", "spans", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def joined(spans_: Column) -> Column:
    """kind:start:end by start, then kind, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x.k), x.s, x.e)), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x.k == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, STRONG), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
