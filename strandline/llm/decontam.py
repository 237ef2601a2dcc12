"""Benchmark decontamination over a positional inverted index of the corpus.

The corpus is read once into postings (doc_id, text_hash, pos, term) of the
terms that test items use, kept as a table in the shared folder together with
each document's end mark, which gives its length. A test window (13
consecutive item words; a shorter item is one window) is looked up from its
rarest terms: their posting lists are shifted by the terms' offsets and
intersected, which leaves (document, item, diagonal) candidates. Exact matches
are then read off along each diagonal in the document's own words. Proximity
matches are windows whose rarest terms all stand within `slop` of their places
around the rarest of them.

Everything runs as DataFrame operations. Test terms, windows and items are
broadcast only where a count shows that they are within `broadcast_rows`;
otherwise the same joins shuffle, with every key of the smaller side in several
places, so that rows which repeat a document don't meet in one task.

Defined results: null texts have no words; a document without words is not
contaminated; a repeated row gives a repeated result (documents are told apart
by id and text); items without an id or words take no part, and items that
repeat count once by id. Texts may be of any length: each word is a row until
matches are read off. Other columns are not read. Empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import ascii_lower, maybe_broadcast, split_join, written

#: Words are runs of anything but these: ASCII other than letters and digits.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A broadcast side has at most so many rows of a few dozen bytes (items: of one text).
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words, lower-cased in A-Z, between two empty strings: word i stands at index i, from 1."""
    return F.split(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), BETWEEN_WORDS)


def test_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item_hash, item_words (with an empty string at either end), size; no null ids, no repeats."""
    return (
        benchmark.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("item_id"), F.xxhash64(text_col).alias("item_hash"), words(F.col(text_col)).alias("item_words"))
        .dropDuplicates(["item_id", "item_hash"])
        .withColumn("size", F.size("item_words") - 2)
        .where("size > 0")
    )


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Postings of the given terms, stored. The term '' marks a document's end at pos n_words + 1."""
    postings = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    found = split_join(postings, "term", F.xxhash64("text_hash", "pos"), terms, rows)  # a frequent term's postings are split
    return written(found.where("term <> '' or pos > 0").select("doc_id", "text_hash", "pos", "term"), "postings")


def rarest_terms(items: DataFrame, index: DataFrame, window: int, keep: int) -> DataFrame:
    """item_id, item_hash, terms: an array of the window's `keep` rarest (n, offset, term), rarest first.

    One row per distinct array of an item; windows with a term that no
    document has are left out, as they can't occur.
    """
    counts = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
    placed = items.select("item_id", "item_hash", "size", F.posexplode("item_words").alias("at", "term")).where("term <> ''")
    placed = placed.join(counts, "term", "left").withColumn("width", F.least(F.lit(window), F.col("size")))
    first = F.greatest(F.lit(1), F.col("at") - F.col("width") + 1)
    last = F.least(F.col("at"), F.col("size") - F.col("width") + 1)
    by_window = placed.withColumn("start", F.explode(F.sequence(first, last))).groupBy("item_id", "item_hash", "start")
    found = by_window.agg(
        F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("terms"), F.count("n").alias("known"), F.count("*").alias("width")
    )
    return found.where("known = width").select("item_id", "item_hash", F.slice("terms", 1, keep).alias("terms")).distinct()


def shifted(index: DataFrame, rare: DataFrame, rows: int) -> DataFrame:
    """Postings of the rare terms, moved to where the item's first word would stand (diag)."""
    asked = rare.select("item_id", "item_hash", F.col("terms.at").alias("key"), F.size("terms").alias("n_terms"), F.posexplode("terms").alias("k", "x"))
    asked = asked.select("item_id", "item_hash", "key", "n_terms", "k", F.col("x.at").alias("at"), F.col("x.term").alias("term"))
    return split_join(index.where("term <> ''"), "term", F.xxhash64("text_hash", "pos"), asked, rows).withColumn("diag", F.col("pos") - F.col("at"))


def candidate_diagonals(index: DataFrame, rare: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, item_id, item_hash, diag where all rare terms of some window line up."""
    return (
        shifted(index, rare, rows)
        .groupBy("doc_id", "text_hash", "item_id", "item_hash", "key", "diag")
        .agg(F.countDistinct("k").alias("n"), F.max("n_terms").alias("n_terms"))
        .where("n = n_terms")
        .select("doc_id", "text_hash", "item_id", "item_hash", "diag")
        .distinct()
    )


def proximity_matches(index: DataFrame, rare: DataFrame, slop: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, item_id, diag: windows whose rare terms all stand within `slop` of their places around the rarest one."""
    moved = shifted(index, rare, rows).select("doc_id", "text_hash", "item_id", "item_hash", "key", "n_terms", "k", "diag").distinct()
    doc = ["doc_id", "text_hash", "item_id", "item_hash", "key"]
    cell = F.expr(f"floor(diag / {slop + 1})")
    anchor = moved.where("k = 0").select(*doc, "n_terms", "diag", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    other = moved.select(*doc, "k", F.col("diag").alias("there"), cell.alias("cell"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*doc, "cell")]
    near = anchor.alias("a").join(other.alias("b"), same).where(F.abs(F.col("there") - F.col("diag")) <= slop)
    return (
        near.groupBy(*[F.col(f"a.{c}") for c in doc], "diag")
        .agg(F.countDistinct("k").alias("n"), F.max("n_terms").alias("n_terms"))
        .where("n = n_terms")
        .select("doc_id", "text_hash", "item_id", "diag")
        .distinct()
    )


def doc_key(id_col: str = "doc_id", hash_col: str = "text_hash") -> Column:
    """A document told by id, null or not, and text."""
    return F.struct(F.col(id_col).alias("id"), F.col(hash_col).alias("hash"))


def exact_matches(docs: DataFrame, items: DataFrame, candidates: DataFrame, window: int, id_col: str, text_col: str, rows: int) -> DataFrame:
    """doc_id, text_hash, item_id, hits: the document's word positions inside occurrences of the item's windows."""
    found = candidates.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "item_hash", "diag")).alias("found"))
    wanted = written(found.select(doc_key().alias("doc"), "found"), "candidates")
    own = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("doc"), F.col(text_col).alias("text"))
    # of rows that repeat a document each task hands on one
    own = split_join(own, "doc", F.monotonically_increasing_id(), wanted.select("doc"), rows).groupBy("doc").agg(F.max("text").alias("text"))
    own = own.join(wanted, "doc").select(F.col("doc.id").alias("doc_id"), F.col("doc.hash").alias("text_hash"), "text", "found")
    each = own.select("doc_id", "text_hash", words(F.col("text")).alias("doc_words"), "found").select("doc_id", "text_hash", "doc_words", F.inline("found"))
    each = each.join(maybe_broadcast(items, rows // 10), ["item_id", "item_hash"])
    low = F.greatest(F.lit(1), 1 - F.col("diag"))
    high = F.least(F.col("size"), F.size("doc_words") - 2 - F.col("diag"))
    each = each.withColumns({"low": low, "high": high, "width": F.least(F.lit(window), F.col("size"))}).where("high - low + 1 >= width")
    length = F.col("high") - F.col("low") + 1
    equal = F.zip_with(
        F.slice("item_words", F.col("low") + 1, length),
        F.slice("doc_words", F.col("low") + F.col("diag") + 1, length),
        lambda a, b: F.when(a == b, "1").otherwise("0"),
    )
    each = each.select("doc_id", "text_hash", "item_id", (F.col("low") + F.col("diag")).alias("base"), "width", length.alias("n"), F.array_join(equal, "").alias("line"))
    starts = F.expr("filter(sequence(1, n - width + 1), i -> substring(line, i, width) = repeat('1', width))")
    each = each.withColumn("starts", starts).where("size(starts) > 0")
    hits = F.expr("array_distinct(flatten(transform(starts, i -> sequence(base + i - 1, base + i + width - 2))))")
    return each.select("doc_id", "text_hash", "item_id", hits.alias("hits"))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, rarest: int = 2, one_in: int = 20, broadcast_rows: int = BROADCAST_ROWS, slop: int | None = None,
) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted strings), contaminated and, with slop, n_near.

    A document is contaminated if words inside windows make up at least 1 in
    `one_in`. n_near counts the items with a proximity match.
    """
    items = test_items(benchmark, item_id_col, item_text_col)
    terms = items.select(F.explode("item_words").alias("term")).unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    index = positional_index(docs, terms, id_col, text_col, broadcast_rows)
    rare = rarest_terms(items, index, window, rarest)
    if slop is not None:
        rare = written(rare, "rare")
    matches = exact_matches(docs, items, candidate_diagonals(index, rare, broadcast_rows), window, id_col, text_col, broadcast_rows)
    by_doc = matches.groupBy(doc_key().alias("doc")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    if slop is not None:
        near = proximity_matches(index, rare, slop, broadcast_rows).groupBy(doc_key().alias("doc")).agg(F.countDistinct("item_id").alias("n_near"))
        by_doc = by_doc.join(near, "doc", "full")
    ends = index.where("term = ''").select(doc_key().alias("doc"), (F.col("pos") - 1).cast("long").alias("n_words"))
    all_ = split_join(ends, "doc", F.monotonically_increasing_id(), written(by_doc, "matches"), broadcast_rows, how="left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return all_.select(
        F.col("doc.id").alias("doc_id"), F.col("doc.hash").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"), *([F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if slop is not None else []),
    )
