"""Mixing sources to target weights.

Each document gets a key from an exponential distribution whose rate is its quality
weight (Efraimidis and Spirakis); sorted by key, the documents of a source are a weighted
sample without replacement at every prefix.  A source's token budget is spent on complete
epochs first and then on the prefix that fits.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.batches import map_batches

#: Key buckets to a doubling of the key: no bucket holds more than a thousandth of a source.
PER_OCTAVE = 1_024
_WORD = re.compile(r"\w+")


@lru_cache(maxsize=2)
def tokenizer(path: str | None):
    """The public byte-level tokenizer at ``path`` (the installed one if None)."""
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path or public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_label(col):
    """A source's label in one spelling: lower case, words joined by hyphens."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s_-]+", "-")


def quality(text: str) -> float:
    """Quality weight of a text, from 0.05 to 1: letters among its characters times
    variety of its words, less for very short texts."""
    if not text:
        return 0.05
    w = _WORD.findall(text.lower())
    letters = sum(map(len, w)) / len(text)
    variety = (len(set(w)) / len(w)) ** 0.5 if w else 0.0
    return round(max(0.05, letters * variety * min(1.0, len(w) / 20)), 6)


def sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, quality): source in one spelling, null without label."""

    def run(doc_id, source, text) -> list:
        encode = tokenizer(path).encode_ordinary
        return [doc_id, source, [len(encode(t)) if t else 0 for t in text], [quality(t) for t in text]]

    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_label(F.col("source")).alias("source"), "text")
    return map_batches(d, run, "doc_id bigint, source string, tokens bigint, quality double")


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, max_repeats, available, budget) per target that occurs.

    ``share`` is the target among the sources that occur and have tokens.  The mixture is
    as large as the repeats allow with all shares met: its size is the least of
    available * max_repeats / share.
    """
    have = sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("available"))
    t = targets.groupBy(source_label(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(have, "source").where("available > 0 AND target_share > 0 AND max_repeats > 0")
    every = Window.partitionBy(F.lit(0))
    j = j.withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    total = F.min(F.col("available") * F.col("max_repeats") / F.col("share")).over(every)
    return j.withColumn("budget", F.floor(total * F.col("share")).cast("bigint"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, copies): documents of the mixture and how often each is used.

    The running sum along a source's keys is taken within buckets of keys, after summing
    the buckets before, so a source with a third of all rows is no single task.  Ties are
    broken by doc_id.  Documents without source, tokens or target are not used.
    """
    p = plan(sized, targets).select("source", "available", "budget", "max_repeats")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = sized.where("tokens > 0 AND source IS NOT NULL").withColumn("_key", -F.log(u) / F.col("quality"))
    keyed = keyed.withColumn("_bucket", F.floor(F.log2("_key") * PER_OCTAVE).cast("int"))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.join(offsets, ["source", "_bucket"]).withColumn("_end", F.col("_before") + F.sum("tokens").over(within))
    epochs = F.floor(F.col("budget") / F.col("available"))
    rest = F.col("budget") - epochs * F.col("available")
    copies = F.least(F.col("max_repeats").cast("bigint"), epochs + F.when(F.col("_end") <= rest, 1).otherwise(0)).cast("int")
    return run.join(p, "source").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(sized: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Target and actual share of every target; targets without documents have share 0."""
    t = targets.groupBy(source_label(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    p = plan(sized, targets).select("source", F.col("share").alias("_share"), "available", "budget")
    j = t.join(p, "source", "left").join(used, "source", "left").fillna(0, ["used_tokens", "most_copies", "available", "budget"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    return j.select("source", "target_share", F.round("_share", 6).alias("feasible_share"), "available", "budget", "used_tokens", "most_copies", F.round(F.try_divide("used_tokens", total), 6).alias("actual_share"))
