"""URL filters: host rules first, then word segmentation of hosts and naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, join_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Longest word that the segmentation knows; size of the hashed table of token weights.
LONGEST, BUCKETS = 24, 1 << 16
#: Places of a name whose substrings are listed at once.
STARTS = 4096

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over the visible text of all pages, for words that a host name can be made of."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}\p{N}]+")).alias("word"))
    return words.filter(F.col("word").rlike(rf"^[a-z0-9]{{1,{LONGEST}}}$")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(token: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of token into words of the highest unigram probability; unknown words pay by length."""
    best = [0.0] + [-math.inf] * len(token)
    back = [0] * (len(token) + 1)
    for end in range(1, len(token) + 1):
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(token[start:end], 0)
            score = best[start] + (math.log(n / total) if n else -math.log(total + 1) - (end - start) * math.log(10))
            if score > best[end]:
                best[end], back[end] = score, start
    words, end = [], len(token)
    while end:
        words.append(token[back[end] : end])
        end = back[end]
    return words[::-1]


def segment_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words: each host's names split into words, in order. Names are looked up by a join, not a broadcast.

    hosts has distinct hosts. Letters that are in nearly all names, and names that are in nearly all hosts, are dealt to several tasks.
    """
    names = cut(hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("at", "name")).filter("name != ''"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1
    times = names.groupBy("name").agg(F.count("*").alias("times")).withColumn("key", F.md5("name"))

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each name's substrings, as many as STARTS places give at a time, with its key: a very long name is repeated for none."""
        keys, words = [], []
        for batch in batches:
            for key, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, len(name), STARTS):
                    some = {name[i : i + n] for i in range(at, min(at + STARTS, len(name))) for n in range(1, min(LONGEST, len(name) - i) + 1)}
                    keys += [key] * len(some)
                    words += some
                    if len(words) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(words)], names=["key", "word"])
                        keys, words = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], names=["key", "word"])

    pieces = times.select("key", "name").mapInArrow(pieces_of, "key string, word string")
    wanted = cut(pieces.groupBy("word").agg(F.count("*").alias("names")).join(counts, "word"))
    looked_up = wanted.agg(F.coalesce(F.sum("names"), F.lit(0))).first()[0]
    known = join_counted(pieces, wanted, "word", "names", looked_up).groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(a, {k["word"]: int(k["n"]) for k in b}, total) for a, b in zip(name, known, strict=True)], dtype=object)

    none = F.array().cast("array<struct<word:string,n:long>>")
    split_names = times.join(known, "key", "left").select("name", "times", split("name", F.coalesce("known", none)).alias("parts"))
    ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "parts"))), lambda x: x["parts"]))
    return join_counted(names, cut(split_names), "name", "times", names.count()).groupBy("host").agg(ordered.alias("words"))


def features(words: Column, path: Column) -> Column:
    """Buckets of a URL's host words and path tokens; numbers count as one token."""
    tokens = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    tokens = F.transform(tokens, lambda t: F.when(t.rlike(r"^[0-9]+$"), F.lit("<number>")).otherwise(t))
    both = F.concat(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), F.transform(tokens, lambda t: F.concat(F.lit("p:"), t)))
    return F.transform(both, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


def fit_weights(labelled: DataFrame) -> np.ndarray:
    """Log odds of block by bucket (a table of BUCKETS numbers), from rows of buckets and block."""
    counts = labelled.select("block", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum(F.col("block").cast("long")).alias("b"), F.count("*").alias("n")).toPandas()
    blocked, allowed = np.zeros(BUCKETS), np.zeros(BUCKETS)
    blocked[counts["bucket"]], allowed[counts["bucket"]] = counts["b"], counts["n"] - counts["b"]
    seen = blocked + allowed > 0
    k = max(1, int(seen.sum()))
    odds = np.log((blocked + 1) / (blocked.sum() + k)) - np.log((allowed + 1) / (allowed.sum() + k))
    return np.where(seen, odds, 0.0)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns named in keep, then host, path, rule, verdict, score and host_words of every row.

    rules are (host, path, allow or block). URLs that a rule decides are the classifier's
    labelled rows; the others are blocked where the log odds of their host words and path
    tokens are above 0, both classes being held equally likely. So a null URL, an empty one, and any
    URL when no rule fits anywhere score 0 and are allowed. Repeated rows are judged alike; hosts, names and paths of any length are
    judged whole; an empty table gives an empty result; columns of pages other than url, html and those in keep are left out, whatever their names.
    """
    url = F.col("url").cast("string")
    base = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("_rule", longest_rule(rules, F.col("host"), F.col("path")))
    urls_of = cut(base.groupBy("host").agg(F.count("*").alias("_urls")))
    # Hosts without a name, as the empty one, may be as frequent as any.
    split_hosts = cut(urls_of.join(segment_hosts(urls_of.select("host"), cut(word_counts(pages))), "host", "left"))
    rows = join_counted(base, split_hosts, "host", "_urls", urls_of.agg(F.coalesce(F.sum("_urls"), F.lit(0))).first()[0]).withColumn("buckets", features(F.col("words"), F.col("path")))
    labelled = rows.filter(F.col("_rule").isNotNull()).select((F.col("_rule.verdict") == "block").alias("block"), "buckets")
    weights = pages.sparkSession.sparkContext.broadcast(fit_weights(labelled))

    @F.pandas_udf("double")
    def score(buckets: pd.Series) -> pd.Series:
        table = weights.value
        return pd.Series([float(table[np.asarray(b, dtype=np.int64)].sum()) for b in buckets], dtype="float64")

    rows = rows.withColumn("score", score("buckets"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score", F.coalesce("words", F.array().cast("array<string>")).alias("host_words"))
