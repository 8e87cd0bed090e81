"""URL filters: rules first, then a naive Bayes judgement of segmented host and path words.

1. A url is cut into host and path, and the longest rule that fits gives its verdict.
2. Host names are often words run together. Words are counted over the titles of all pages; each distinct host name's substrings are
   joined with the counts, and a unigram Viterbi pass picks the split of the greatest probability. Words and unknown stretches may be of
   any length.
3. Multinomial naive Bayes learns from the urls that a rule decides, and from nothing else at first. Words that rules name are left out, as
   they would only repeat the rule. Then it trains itself for ROUNDS rounds: urls without a rule whose words and title together have
   log-odds of SURE or more are learned from too. A title counts as at most TITLE_WORDS words. Words are hashed to SLOTS, so the counts that
   are gathered and sent out have a fixed size; each round reads all urls' slots once.
4. Urls without a rule are blocked if the log-odds of their host's and path's words reach BLOCK_FROM. The classes' shares among
   learned urls say what the rules cover, not what the web is like, so both classes count as equally frequent beforehand.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed for want of words. Repeated rows
come back as often as they went in. Null html has no title. Extra columns are ignored. If nothing could be learned, urls without a rule
are allowed. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm.common import small_join, table, written

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SLOTS = 1 << 16
#: What is added to the count of every class and slot, and the cost of an unknown letter of a name.
SMOOTHING, UNKNOWN_LETTER = 0.5, 2.5
#: Rounds of self-training, log-odds from which a url is learned from, and how many words a title counts for.
ROUNDS, SURE, TITLE_WORDS = 2, 4.0, 4
#: Log-odds from which a url without a rule is blocked.
BLOCK_FROM = 2.0


def parts(url: Column) -> dict[str, Column]:
    """host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return {"host": F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def words_of_title(html: Column) -> Column:
    """Lower-case letter words of a page's title; null without one."""
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.regexp_extract_all(title, F.lit(r"\p{L}+"), F.lit(0))


def title_words(pages: DataFrame) -> DataFrame:
    """(word, n): words of all titles."""
    return pages.select(F.explode_outer(words_of_title(F.col("html"))).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(name: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most probable words of a name; found has (start, length, count) of the substrings that are words."""
    known = np.log(total + 1.0)
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, length, n in found:
        ending.setdefault(start + length, []).append((start, known - np.log(n)))
    best, back = [0.0], [0]
    free, free_from = 0.0, 0  # the cheapest way to begin an unknown stretch, less what its letters cost
    for end in range(1, len(name) + 1):
        cost, start = free + known + UNKNOWN_LETTER * end, free_from
        for at, own in ending.get(end, ()):
            if best[at] + own < cost:
                cost, start = best[at] + own, at
        best.append(cost)
        back.append(start)
        if cost - UNKNOWN_LETTER * end < free:
            free, free_from = cost - UNKNOWN_LETTER * end, end
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) of distinct names; words, a written table, has (word, n)."""
    sums = words.agg(F.sum("n").alias("n"), F.max(F.length("word")).alias("longest")).first()
    total, longest = sums["n"] or 0, sums["longest"] or 0  # no substring beyond the longest word can be one
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    lengths = starts.withColumn("length", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("name") - F.col("start") + 1))))
    pieces = lengths.withColumn("word", F.substr("name", "start", "length"))
    hits = pieces.join(words, "word").groupBy("name").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - 1).alias("s"), F.col("length").alias("l"), F.col("n").alias("n")))).alias("found"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([split_name(n, [(r["s"], r["l"], r["n"]) for r in f] if f is not None else [], total) for n, f in zip(name, found, strict=True)], dtype=object)

    return names.join(hits, "name", "left").select("name", split("name", "found").alias("words"))


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts: the words of its names, run-together ones split."""
    names = hosts.select("host", F.posexplode(F.regexp_extract_all(F.col("host"), F.lit(r"\p{L}+"), F.lit(0))).alias("i", "name"))
    split = segmented(names.select("name").distinct(), words)
    by_host = names.join(split, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x.words)).alias("words"))
    return hosts.join(by_host, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def path_words(path: Column) -> Column:
    """Lower-case letter words of a path, and `0` for each number."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(path), "[0-9]+", "0"), F.lit(r"\p{L}+|0"), F.lit(0))


def without(words: Column | str, named: set[str]) -> Column:
    """words but those that are named; repeats stay."""
    return F.filter(words, lambda w: ~w.isin(sorted(named))) if named else F.filter(words, lambda w: w.isNotNull())


def slots_of(words: Column) -> Column:
    """The slot of each word; repeats stay."""
    return F.coalesce(F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(SLOTS)).cast("int")), F.array().cast("array<int>"))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """(slots, 2) counts of blocked and allowed words to each slot's log-odds; 0 for a slot without words."""
    used = counts.sum(1) > 0
    share = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * max(int(used.sum()), 1)))
    return np.where(used, share[:, 0] - share[:, 1], 0).astype(np.float32)


def _sum_of(odds: np.ndarray, most: int | None = None):
    """Function of arrays of slots: the sum of their log-odds, scaled down to that of `most` words."""

    @F.pandas_udf("double")
    def score(slots: pd.Series) -> pd.Series:
        return pd.Series([float(odds[own].sum(dtype=np.float64)) * (min(1, most / max(len(own), 1)) if most else 1) for own in slots], dtype=float)

    return score


def learned(seen: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the slots of host and path words, and of title words, from a written table (verdict, words, title)."""
    label = F.col("verdict")
    odds = np.zeros((2, SLOTS), np.float32)
    for n in range(rounds + 1):
        rows = seen.select(label.alias("label"), "words", "title")
        if n:
            both = _sum_of(odds[0])("words") + _sum_of(odds[1], TITLE_WORDS)("title")
            pseudo = F.when(F.col("both") >= sure, F.lit("block")).when(F.col("both") <= -sure, F.lit("allow"))
            rows = rows.withColumn("both", both).select(F.coalesce("label", pseudo).alias("label"), "words", "title")
        each = F.concat(F.transform("words", lambda s: F.struct(F.lit(0).alias("part"), s.alias("slot"))), F.transform("title", lambda s: F.struct(F.lit(1).alias("part"), s.alias("slot"))))
        exploded = rows.where("label IS NOT NULL").select("label", F.explode(each).alias("x"))
        counts = exploded.groupBy("x.part", "x.slot").agg(*[F.count(F.when(F.col("label") == v, 1)).alias(v) for v in ("block", "allow")]).toPandas()
        for part in (0, 1):
            own = counts[counts["part"] == part]
            table_ = np.zeros((SLOTS, 2))
            table_[own["slot"].to_numpy(int)] = own[["block", "allow"]].to_numpy(float)
            odds[part] = log_odds(table_)
    return odds[0], odds[1]


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, block_from: float = BLOCK_FROM, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) for each row of pages (page_id, url, html)."""
    url = parts(F.col("url"))
    cut = pages.select("page_id", *[c.alias(k) for k, c in url.items()], words_of_title(F.col("html")).alias("title"))
    hosts = written(pages.select(url["host"].alias("host")).distinct())
    known = written(host_words(hosts, written(title_words(pages))))
    named = {w for host, path, _ in rules for w in re.findall(r"[^\W\d_]+", host + path)}
    # a host may have a large share of all urls
    joined = small_join(cut, known.withColumnRenamed("words", "host_words"), ["host"])
    words = F.concat(F.coalesce("host_words", F.array().cast("array<string>")), path_words(F.col("path")))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    seen = written(joined.select("page_id", "host", "path", rule.alias("r"), slots_of(without(words, named)).alias("words"), slots_of(without("title", named)).alias("title")).select("page_id", "host", "path", "r.*", "words", "title"))
    of_words, _ = learned(seen, rounds, sure)
    scored = seen.withColumn("log_odds", _sum_of(of_words)("words"))
    verdict = F.coalesce("verdict", F.when(F.col("log_odds") >= block_from, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "log_odds")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
