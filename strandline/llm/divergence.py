"""How the sources of a language differ in their words: exact counts behind a count-min sketch.

A term is kept in a language if at least `least_docs` of its documents have it. Most
distinct terms are rarer, and to count them exactly they would all have to be
shuffled. So documents are read twice:

1. Every task adds the document frequencies of its (language, term) pairs to a
   count-min sketch: DEPTH rows of cells, to each of which many terms add. Cells
   stop at `least_docs`, which is all that is asked of them, and fit a byte; the
   tasks' non-empty pages of cells are added page by page. A cell never says less
   than the frequency of any of its terms, so a term with a cell below the least
   number can't be kept. What is left of the sketch is a bit per cell. The cells of
   a row grow with the number of documents, up to 2^26 (8 MB of bits a row); the
   result never depends on how many there are.
2. Every task counts the terms that the bits let pass, sums them by (language,
   source, term), and shuffles those alone. Their frequencies are then exact, and
   terms that only collisions let pass are dropped.

Shares are integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with V kept terms
in the language, N the group's count over them. Two groups differ by the sum over
all V terms of f = floor((p - q)^2 / (p + q)). Terms that a group lacks all have
the same share, so the sum over V terms is made of sparse parts: each group's own
terms against the other's constant (from its histogram of counts), the number
of terms that neither has, and, joined by term, a correction for those that both
have. No dense table of groups by terms is made.

Defined results: null text, language and source are ''. A (language, source) group
counts even without terms, and a language may keep none: its pairs have the value
0. Repeated documents count as often as they occur. Ties go by the item's bytes. An
empty table gives an empty result. Texts may be of any length: a task holds one
batch's words and about HELD terms. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import bounded_batches, split_join, trimmed, written

#: Documents of a language that must have a term, places of the report of terms.
LEAST_DOCS, RANKS = 10, 10
#: Scale of the integer shares; added to each count.
SCALE, PRIOR = 1_000_000_000, 2
#: Rows of the sketch, least and greatest log2 of a row's cells, cells of a page, cells for each document.
DEPTH, NARROW, WIDE, PAGE, CELLS = 2, 16, 26, 1 << 12, 64
#: Tasks whose pages are added first.
TASKS = 256
#: Terms of groups that a task holds before it adds them to the sketch or hands them on; looked at after each Arrow batch.
HELD = 400_000
#: Rows of group figures that are broadcast at most.
FEW_GROUPS = 20_000

#: What parts words becomes a space, A-Z their small letters; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and other than ASCII characters."""
    return text.translate(LETTERS).split() if text else []


def hashed(items: list[bytes]) -> np.ndarray:
    """64 bits of each, the same on every machine."""
    return pd.util.hash_array(np.array(items, dtype=object), categorize=False)


def cells(lang: bytes, terms: list[bytes], width: int) -> list[np.ndarray]:
    """The cell of each term of a language in each row: parts of one hash of both."""
    mixed = (hashed(terms) ^ hashed([lang])) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    return [((mixed >> np.uint64(32 * i)) & np.uint64((1 << width) - 1)).astype(np.int64) for i in range(DEPTH)]


def columns(part: pa.RecordBatch) -> zip:
    return zip(*(part.column(i).cast(pa.binary()).to_pylist() for i in range(part.num_columns)), strict=True)


def width_for(n_docs: int) -> int:
    return min(WIDE, max(NARROW, (CELLS * max(1, n_docs) - 1).bit_length()))


def sketch(docs: DataFrame, least_docs: int, width: int) -> DataFrame:
    """row, page, cells: counters from 0 to least_docs (as bytes) of the non-empty pages, added over all documents (lang, text)."""
    page_cells = min(PAGE, 1 << width)

    def add(counters: np.ndarray, seen: dict[bytes, Counter]) -> None:
        for lang, terms in seen.items():
            n = np.fromiter(terms.values(), dtype=np.int64, count=len(terms))
            for row, at in enumerate(cells(lang, list(terms), width)):
                where, place = np.unique(at, return_inverse=True)
                counters[row, where] = np.minimum(counters[row, where] + np.bincount(place, weights=n), least_docs)
        seen.clear()

    @trimmed
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = np.zeros((DEPTH, 1 << width), dtype=np.uint8), defaultdict(Counter)
        for part in parts:
            for lang, text in columns(part):
                seen[lang].update(set(words(text)))
            if sum(map(len, seen.values())) > HELD:
                add(counters, seen)
        add(counters, seen)
        pages = counters.reshape(DEPTH, -1, page_cells)
        row, page = np.nonzero(pages.any(axis=2))
        for a in range(0, len(row), 256):
            at = row[a : a + 256], page[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array([x.tobytes() for x in pages[at]], pa.binary())], ["row", "page", "cells"])

    @F.pandas_udf("binary")
    def added(pages: pd.Series) -> bytes:
        out = np.zeros(page_cells, dtype=np.int32)
        for page in pages:
            out = np.minimum(out + np.frombuffer(page, dtype=np.uint8), least_docs)
        return out.astype(np.uint8).tobytes()

    made = docs.select("lang", "text").mapInArrow(count, "row int, page int, cells binary")
    some = made.withColumn("some", F.floor(F.spark_partition_id() / TASKS)).groupBy("row", "page", "some").agg(added("cells").alias("cells"))
    return some.groupBy("row", "page").agg(added("cells").alias("cells"))


def passing(pages: DataFrame, least_docs: int, width: int) -> np.ndarray:
    """A bit for each cell that reaches least_docs: DEPTH x 2^width / 8 bytes, 16 MB at most."""

    @F.pandas_udf("binary")
    def bits(page: pd.Series) -> pd.Series:
        return page.map(lambda x: np.packbits(np.frombuffer(x, dtype=np.uint8) >= least_docs, bitorder="little").tobytes())

    out, step = np.zeros((DEPTH, 1 << width >> 3), dtype=np.uint8), min(PAGE, 1 << width) >> 3
    for x in pages.select("row", "page", bits("cells").alias("bits")).toLocalIterator():
        out[x["row"], x["page"] * step : (x["page"] + 1) * step] = np.frombuffer(x["bits"], dtype=np.uint8)
    return out


def term_counts(docs: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """lang, source, term, n (occurrences), docs of the terms that the sketch lets pass, summed over all documents (lang, source, text)."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def let_pass(lang: bytes, terms: list[bytes]) -> np.ndarray:
        ok = np.ones(len(terms), dtype=bool)
        for row, at in enumerate(cells(lang, terms, width)):
            ok &= (held.value[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok

    def batches(seen: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in seen.items():
            terms = list(n)
            ok = let_pass(lang, terms)
            left = list(compress(terms, ok))
            name = lambda x: pa.array([x] * len(left), pa.binary()).cast(pa.string())
            counts = [pa.array(list(compress(c.values(), ok)), pa.int64()) for c in (n, {t: in_docs[t] for t in terms})]
            yield pa.RecordBatch.from_arrays([name(lang), name(source), pa.array(left, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
        seen.clear()

    @trimmed
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = defaultdict(lambda: (Counter(), Counter()))
        for part in parts:
            for lang, source, text in columns(part):
                n, in_docs = seen[lang, source]
                found = words(text)
                n.update(found)
                in_docs.update(set(found))
            if sum(len(n) for n, _ in seen.values()) > HELD:
                yield from batches(seen)
        yield from batches(seen)

    made = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # tasks have summed their own rows; by language and term, the sources of a term meet without another shuffle
    return made.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, everywhere (occurrences in the language), leads (on one row of each term) of the terms that enough documents have, exactly."""
    own = Window.partitionBy("lang", "term")  # a row per source
    rows = counts.withColumns({"in_docs": F.sum("docs").over(own), "everywhere": F.sum("n").over(own), "leads": F.min("source").over(own) == F.col("source")})
    return rows.where(F.col("in_docs") >= least_docs).drop("docs", "in_docs")


def share(count: str, n: str, v: str = "v") -> Column:
    """1 + floor(SCALE (count + PRIOR) / (n + PRIOR v)) in whole numbers; null if nothing is kept."""
    return F.expr(f"1 + (cast({count} + {PRIOR} as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div nullif(cast({n} + {PRIOR} * {v} as decimal(20,0)), 0)")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def group_figures(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n and terms of each group, v and n_all of its language, p0: the share of a term that the group lacks."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("n_all"), F.sum(F.col("leads").cast("long")).alias("v"))
    rows = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    return rows.withColumn("p0", share("0", "n"))


def term_report(terms: DataFrame, ranks: int = RANKS) -> DataFrame:
    """The terms that a group uses more than its language does, by f; Spark keeps the first ranks of each task before it shuffles."""
    rows = terms.withColumn("q", share("everywhere", "n_all")).where("p > q").withColumn("value", apart("p", "q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def pair_report(terms: DataFrame, figures: DataFrame) -> DataFrame:
    """Every other source of the language by the sum of f over all kept terms, from sparse parts."""
    other = figures.select("lang", F.col("source").alias("item"), F.col("terms").alias("terms_b"), F.col("p0").alias("q0"))
    both_ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    parts = ["lang", "x.source", "x.item", "value"]

    each = split_join(figures, "lang", F.xxhash64("source"), other, FEW_GROUPS).where("source <> item")  # the pairs of the result
    lacked = each.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("terms") - F.col("terms_b")) * apart("p0", "q0"), F.lit(0)).alias("value"))

    counted = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    against = split_join(counted, "lang", F.xxhash64("source", "p"), other.select("lang", "item", "q0"), FEW_GROUPS).where("source <> item")
    own = against.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * apart("p", "q0")).alias("value")).select("lang", both_ways, "value").select(*parts)

    second = terms.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = terms.join(second, ["lang", "term"]).where("source < item")
    extra = apart("p", "q") - apart("p", "q0") - apart("p0", "q") + apart("p0", "q0")
    common = shared.groupBy("lang", "source", "item").agg(F.sum(extra).alias("value")).select("lang", both_ways, "value").select(*parts)

    value = lacked.unionByName(own).unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, ranks: int = RANKS, width: int | None = None
) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see above. least_docs is at most 127, width the log2 of the sketch's cells a row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    width = width_for(docs.count()) if width is None else width
    bits = passing(sketch(docs, least_docs, width), least_docs, width)
    kept = written(kept_counts(term_counts(docs, bits, width), least_docs), "kept")
    figures = written(group_figures(docs, kept), "groups")
    own = figures.select(F.struct("lang", "source").alias("group"), F.col("n").alias("n_own"), "n_all", "v", "p0")
    rows = kept.withColumn("group", F.struct("lang", "source"))
    terms = split_join(rows, "group", F.xxhash64("term"), own, FEW_GROUPS).withColumn("p", share("n", "n_own")).drop("group")
    return pair_report(terms, figures).unionByName(term_report(terms, ranks))
