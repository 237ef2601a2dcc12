"""Token counts: an exact histogram of encoded lengths and its suffix sums.

The histogram has one row per distinct length and is stored, so texts are
encoded once. From its suffix sums every question about a context limit L
follows without another pass over the text: documents that fit, tokens kept
when each document is cut at L, quantiles. A limit between two lengths that
occur is answered by the sums at the lower one.

Null and empty texts have length 0. An empty table gives an empty histogram.
Repeated rows count as often as they occur. Texts may be of any length, with
runs of any length: long runs of white space, which the library's splitter
can't take, are cut off where tokens end anyway. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.shared import bounded_batches, written

#: Rank file of a public byte-level vocabulary; every machine or the driver alone may hold it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space by Unicode's property, as that pattern has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of white space that are encoded apart from the text around them.
LONG_RUN = re.compile(f"[{WHITE}]{{10000,}}")
#: Lengths of one block of the two-level suffix sums.
BLOCK = 512


class Counter:
    """Counts the tokens of texts under a vocabulary given as a rank file's bytes."""

    def __init__(self, ranks: bytes) -> None:
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        coder = lambda pattern: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.whole, self.white = coder(PATTERN), coder(r"\s+")

    def __call__(self, text: str) -> int:
        """A run of white space is one token piece but for its last character, if a word follows: that one goes with the word."""
        total, at = 0, 0
        for run in LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            total += len(self.whole.encode_ordinary(text[at : run.start()])) + len(self.white.encode_ordinary(text[run.start() : end]))
            at = end
        return total + len(self.whole.encode_ordinary(text[at:]))


def token_length(spark: SparkSession, text: Column, ranks: str = RANKS) -> Column:
    """Number of tokens of each text; the vocabulary (under 1 MB) is broadcast."""
    bounded_batches(spark)
    with open(ranks, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = Counter(held.value)
        for part in parts:
            yield pd.Series([count(x) if x else 0 for x in part], dtype="int64")

    return lengths(text)


def length_histogram(docs: DataFrame, text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """n_tokens, n_docs: one row per distinct encoded length, stored."""
    length = token_length(docs.sparkSession, F.col(text_col), ranks)
    return written(docs.select(length.alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")


def with_suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L that occurs, taken as a context limit:

    docs_over, tokens_over (documents longer than L and their tokens),
    docs_within, tokens_within, truncated_tokens (sum of min(length, L)) and
    share_within (documents of L tokens or fewer / all: L is that quantile).

    Sums run within blocks of lengths and over the blocks' totals, so no task
    sees more than one block of lengths or one row per block.
    """
    h = histogram.select(
        "n_tokens", "n_docs", F.col("n_tokens").alias("L"), F.expr(f"n_tokens div {block}").alias("blk")
    )
    totals = h.groupBy("blk").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("L")).alias("t"))
    above = Window.orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "blk",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    inside = Window.partitionBy("blk").orderBy(F.desc("L")).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.col("d_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    tokens_over = F.col("t_above") + F.coalesce(F.sum(F.col("n_docs") * F.col("L")).over(inside), F.lit(0))
    return (
        h.join(totals, "blk")
        .withColumns({"docs_over": docs_over, "tokens_over": tokens_over})
        .select(
            "n_tokens",
            "n_docs",
            "docs_over",
            "tokens_over",
            (F.col("d_all") - F.col("docs_over")).alias("docs_within"),
            (F.col("t_all") - F.col("tokens_over")).alias("tokens_within"),
            (F.col("t_all") - F.col("tokens_over") + F.col("docs_over") * F.col("L")).alias("truncated_tokens"),
            ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("share_within"),
        )
    )


def limits_report(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_within, truncated_tokens, tokens_lost for any limits, also between lengths that occur.

    One aggregation looks up, for each limit, the sums at the largest length
    that is not over it, and the totals; without documents there are no rows.
    """
    columns = ("docs_over", "tokens_over", "docs_within", "tokens_within")
    row = F.struct(*columns)
    under = [F.max_by(row, F.when(F.col("n_tokens") <= int(x), F.col("n_tokens"))).alias(f"at_{i}") for i, x in enumerate(limits)]
    totals = F.max(F.col("docs_over") + F.col("docs_within")).alias("docs"), F.max(F.col("tokens_over") + F.col("tokens_within")).alias("tokens")
    found = sums.agg(*totals, *under).where("docs is not null")
    none = F.struct(F.col("docs").alias(columns[0]), F.col("tokens").alias(columns[1]), F.lit(0).cast("long").alias(columns[2]), F.lit(0).cast("long").alias(columns[3]))
    answers = F.array(*[F.struct(F.lit(int(x)).cast("long").alias("limit"), F.coalesce(f"at_{i}", none).alias("at")) for i, x in enumerate(limits)])
    kept = F.col("at.docs_over") * F.col("limit")
    return found.select(F.inline(answers)).select(
        "limit", F.col("at.docs_within").alias("docs_within"), (F.col("at.tokens_within") + kept).alias("truncated_tokens"), (F.col("at.tokens_over") - kept).alias("tokens_lost")
    )


def length_quantile(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least that share of documents don't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return (
        sums.join(F.broadcast(asked), F.col("share_within") >= F.col("share"))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
