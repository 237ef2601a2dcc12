"""Language identification that fuses the text with what surrounds it.

The text's likelihood under byte trigrams of each language, the language that
the markup or the table declares, the address suffix and a prior of the host
are combined by Bayes' rule. Host priors come from grouped sums of the texts'
own posteriors and are smoothed along host, domain, suffix and all: a host
with few documents leans on its domain, and so on up. How far a declaration or
suffix is to be trusted is counted in the same way. A document's own share is
taken out of the sums of its host, its declaration and its suffix.

The trigram model is fitted on about `SAMPLE` labelled documents of each
language, chosen by a hash of their ids and texts; a language with fewer gives
all. Which languages there are comes from all rows, and so does all else.

Besides the languages of the labels there is "und" for anything else: a text
without letters, or one that even distribution explains better.

Defined results: null and empty texts are "und" with confidence 1. Null
declarations and addresses are no evidence. Repeated rows give equal results
up to the share taken out. Rows without an id take part like others. Texts and
pages may be of any length and are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import bounded_batches, looked_up, trimmed, without, written

#: Labelled documents of each language that its trigrams are counted on.
SAMPLE = 4000
UND = "und"
#: Cells of the trigram tables, log probability of a trigram in "und", trigrams that count as independent evidence.
CELLS, UND_LOG, EVIDENCE = 1 << 17, -11.0, 60.0
CELLS_PRIME = 131_071
#: Prior share of "und", weight of the level above in host priors, smoothing of declaration counts.
UND_PRIOR, KAPPA, ALPHA = 0.01, 5.0, 0.5
#: Rows of what is known of declarations, suffixes or hosts (a few numbers for each language) that are broadcast at most.
BROADCAST_ROWS = 50_000
#: Values of the hash that chooses documents.
HASHES = 1 << 40
#: Characters that are handled at a time.
TOGETHER = 500_000

SYMBOLS = np.zeros(256, np.int32)
SYMBOLS[ord("a") : ord("z") + 1] = np.arange(1, 27)
SYMBOLS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
SYMBOLS[128:] = np.arange(27, 155)

DROP = re.compile(r"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
#: The language of the html element (group 2), or something before it whose content is no markup.
HTML_LANG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|noscript|title|textarea)\b.*?(?:</\1\b|\Z)|<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.S | re.I
)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each trigram that holds a letter, and the number of the text it is in."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 3 for r in raw], np.int64)
    symbols = SYMBOLS[np.frombuffer(b" " + b"  ".join(r + b" " for r in raw) + b"  ", np.uint8)[: sizes.sum()]]
    code = (symbols[:-2] * 155 + symbols[1:-1]) * 155 + symbols[2:]
    held = symbols[1:-1] > 0
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[1:-1]
    return code[held] % CELLS_PRIME, owner[held]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and size < TOGETHER:
            size, end = size + len(texts[end]), end + 1
        yield start, end
        start = end


@dataclass
class TextModel:
    languages: list[str]  # the last is UND
    table: np.ndarray  # cells x languages: log probabilities


def text_posteriors(model: TextModel, texts: list[str]) -> np.ndarray:
    """P(language) of each text from its trigrams alone, with even priors but for UND's."""
    k = len(model.languages)
    out = np.empty((len(texts), k))
    prior = np.log(np.array([(1 - UND_PRIOR) / max(1, k - 1)] * (k - 1) + [UND_PRIOR]))
    for start, end in slices(texts):
        cell, owner = trigrams(texts[start:end])
        n = np.bincount(owner, minlength=end - start)
        total = np.stack([np.bincount(owner, model.table[cell, i], end - start) for i in range(k)], axis=1)
        mean = total / np.maximum(n, 1)[:, None]
        post = mean * np.minimum(n, EVIDENCE)[:, None] + prior
        post[n == 0] = [-60.0] * (k - 1) + [0.0]
        out[start:end] = post - reduce(np.logaddexp, post.T)[:, None]
    return np.exp(out)


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Trigram counts of each declared language, summed by Spark over about `sample` labelled texts of each."""
    known = F.lower(F.regexp_extract(F.col(lang_col), "^[A-Za-z]{2,8}", 0))
    texts = docs.select(known.alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_hash")).where("_lang <> '' and _text is not null")
    sizes = texts.groupBy("_lang").agg(F.approx_count_distinct("_hash").alias("n"))  # a row per language
    part = F.least(F.lit(1.0), sample / F.col("n")) * HASHES
    shares = F.broadcast(sizes.select("_lang", F.ceil(part).alias("_part")))

    @trimmed
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, some in part.groupby("_lang"):
                own = some["_text"].tolist()
                for start, end in slices(own):
                    n = np.bincount(trigrams(own[start:end])[0], minlength=CELLS)
                    at = np.flatnonzero(n)
                    yield pd.DataFrame({"lang": lang, "cell": at, "n": n[at]})

    # the sums are at most cells x languages
    chosen = texts.join(shares, "_lang").where(F.pmod("_hash", F.lit(HASHES)) < F.col("_part")).select("_lang", "_text")
    sums = chosen.mapInPandas(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(sums["lang"]) - {UND})
    table = np.full((CELLS, len(languages) + 1), UND_LOG, np.float64)
    for i, lang in enumerate(languages):
        n = np.zeros(CELLS)
        own = sums[sums["lang"] == lang]
        n[own["cell"].to_numpy()] = own["n"]
        table[:, i] = np.log((n + 0.02) / (n.sum() + 0.02 * CELLS))
    return TextModel([*languages, UND], table.astype(np.float32))


def page_text(html: str) -> tuple[str, str | None]:
    """Text of a page, roughly, and the language that its markup declares, wherever the html element stands."""
    from html import unescape

    declared = next((x[2].lower() for x in HTML_LANG.finditer(html) if x[2]), None)
    return unescape(DROP.sub(" ", html)), declared


def identified(
    rows: DataFrame, model: TextModel, id_col: str, text_col: str, declared: Column | None = None, host: Column | None = None,
    suffix: Column | None = None, markup: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """id, language, confidence, text_language, declared, host, plus the columns in `keep`.

    declared, host and suffix are expressions over rows; with markup the text
    is HTML, and its own declaration counts.
    """
    bounded_batches(rows.sparkSession)
    k, languages = len(model.languages), model.languages
    held = rows.sparkSession.sparkContext.broadcast((languages, model.table))
    none = F.lit(None).cast("string")
    given = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep or [])]
    own = rows.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), (declared if declared is not None else none).alias("_declared"),
        F.lower(host if host is not None else none).alias("host"), F.lower(suffix if suffix is not None else none).alias("suffix"), *given,
    )

    @F.pandas_udf("own array<double>, marked string")
    @trimmed
    def posteriors(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, table = held.value
        inner = TextModel(languages, table)
        for part in parts:
            texts, marked = part.tolist(), [None] * len(part)
            if markup:
                pairs = [page_text(t) for t in texts]
                texts, marked = [t for t, _ in pairs], [m for _, m in pairs]
            yield pd.DataFrame({"own": list(text_posteriors(inner, texts)), "marked": marked})

    seen = own.withColumn("_x", posteriors("_text"))
    seen = seen.select("_id", "host", "suffix", F.coalesce("_x.marked", F.lower(F.regexp_extract("_declared", "^[A-Za-z]{2,8}", 0))).alias("declared"), F.col("_x.own").alias("own"), *[c for c in seen.columns if c.startswith("keep_")])
    place = F.when(F.col("host").isNotNull(), F.concat_ws("\n", "host", F.coalesce("suffix", F.lit(""))))  # one row of what is known of a host
    more = {"declared": F.when(F.col("declared") != "", F.col("declared")), "domain": F.regexp_extract("host", r"([^.]+\.)?[^.]+$", 0), "place": place, "row": F.monotonically_increasing_id()}
    seen = written(seen.withColumns(more), "texts")

    def sums(df: DataFrame, *by: str) -> DataFrame:
        """n and s (the posteriors summed per language) of each group."""
        out = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(k)])
        return out.select(*by, "n", F.array(*[f"s{i}" for i in range(k)]).alias("s"))

    def added(df: DataFrame, *by: str) -> DataFrame:
        out = df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)])
        return out.select(*by, "n", F.array(*[f"s{i}" for i in range(k)]).alias("s"))

    even = F.array(*[F.lit((1 - UND_PRIOR) / max(1, k - 1))] * (k - 1), F.lit(UND_PRIOR))
    smooth = lambda s, n, above: F.zip_with(s, above, lambda a, b: (a + KAPPA * b) / (n + KAPPA))
    by_host = sums(seen.where("host is not null"), "host", "domain", "suffix")
    by_domain, by_suffix = added(by_host, "domain", "suffix"), added(by_host, "suffix")
    total = added(by_suffix)
    top = total.select(smooth(F.coalesce("s", F.transform(even, lambda _: F.lit(0.0))), F.coalesce("n", F.lit(0)), even).alias("p_all"))
    by_suffix = by_suffix.join(F.broadcast(top)).select("suffix", smooth(F.col("s"), F.col("n"), F.col("p_all")).alias("p_suffix"))  # top is one row
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    by_domain = by_domain.alias("a").join(by_suffix.alias("b"), same("suffix")).select("a.domain", "a.suffix", smooth(F.col("s"), F.col("n"), F.col("p_suffix")).alias("p_domain"))
    hosts = by_host.alias("a").join(by_domain.alias("b"), same("suffix") & (F.col("a.domain") == F.col("b.domain"))).select(
        F.concat_ws("\n", "a.host", F.coalesce("a.suffix", F.lit(""))).alias("place"), "n", "s", "p_domain"
    )

    def trust(by: str) -> DataFrame:
        """by, s_by (posteriors summed for this value), t_by (for all values), v_by (how many values there are)."""
        one = sums(seen.where(F.col(by).isNotNull()), by)
        all_ = added(one.withColumn("n", F.lit(1))).select(F.col("s").alias("t"), F.col("n").alias("v"))
        per = one.join(F.broadcast(all_))  # one row
        return per.select(by, F.col("s").alias(f"s_{by}"), F.col("t").alias(f"t_{by}"), F.col("v").alias(f"v_{by}"))

    def attached(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
        """rows with what table says of their key, if anything; a frequent key's rows are spread."""
        table = written(table, key)
        if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return rows.join(F.broadcast(table), key, "left")
        return looked_up(rows, key, "row", table, asking=seen, how="left")

    def evidence_of(by: str) -> Column:
        """log P(this value | language), up to a constant, without the row itself; 0 without a value."""
        parts = F.arrays_zip(F.col(f"s_{by}").alias("s"), F.col(f"t_{by}").alias("t"), F.col("own").alias("own"))
        left = lambda x: F.greatest(x, F.lit(0.0))
        log = F.transform(parts, lambda x: F.ln((left(x["s"] - x["own"]) + ALPHA) / (left(x["t"] - x["own"]) + ALPHA * F.col(f"v_{by}"))))
        return F.coalesce(log, nothing)

    rows_ = seen
    for key, table in (("declared", trust("declared")), ("suffix", trust("suffix")), ("place", hosts)):
        rows_ = attached(rows_, key, table)
    nothing = F.array(*[F.lit(0.0)] * k)
    # the host's sums without the row itself
    prior = F.when(
        F.col("n").isNotNull(),
        F.transform(F.arrays_zip(F.col("s").alias("s"), F.col("own").alias("own"), F.col("p_domain").alias("p")), lambda x: (F.greatest(x["s"] - x["own"], F.lit(0.0)) + KAPPA * x["p"]) / (F.col("n") - 1 + KAPPA)),
    ).otherwise(even)
    evidence = F.zip_with(
        F.zip_with("own", prior, lambda a, b: F.ln(F.greatest(a, F.lit(1e-30))) + F.ln(F.greatest(b, F.lit(1e-12)))),
        F.zip_with(evidence_of("declared"), evidence_of("suffix"), lambda a, b: a + b),
        lambda a, b: a + b,
    )
    wordless = F.col("own")[k - 1] > 1 - 1e-12  # no letters, or hardly: nothing around a text makes it one
    evidence = F.zip_with(evidence, F.array(*[F.lit(x) for x in np.log([(1 - UND_PRIOR) / max(1, k - 1)] * (k - 1) + [UND_PRIOR])]), lambda a, b: a - b)
    final = rows_.withColumn("_e", F.when(wordless, F.array(*[F.lit(-60.0)] * (k - 1), F.lit(0.0))).otherwise(evidence))
    final = final.withColumn("_m", F.array_max("_e"))
    names = F.array(*[F.lit(x) for x in languages])
    at = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    weight = F.aggregate(F.transform("_e", lambda x: F.exp(x - F.col("_m"))), F.lit(0.0), lambda a, x: a + x)
    return final.select(
        F.col("_id").alias(id_col), at(F.col("_e")).alias("language"), (1 / weight).alias("confidence"), at(F.col("own")).alias("text_language"), "declared", "host",
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])],
    )


def of_documents(docs: DataFrame, model: TextModel, **more) -> DataFrame:
    """Documents: the table declares the language, the source stands for the host."""
    return identified(docs, model, "doc_id", "text", declared=F.col("lang"), host=F.col("source"), **more)


def of_pages(pages: DataFrame, model: TextModel, **more) -> DataFrame:
    """Pages: the markup declares the language; host and suffix come from the address."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    host = F.when(host != "", host)
    suffix = F.regexp_extract(host, r"\.([A-Za-z0-9-]+)$", 1)
    return identified(pages, model, "page_id", "html", host=host, suffix=F.when(suffix != "", suffix), markup=True, **more)


def accepted(docs: DataFrame, languages: list[str] | None = None, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns kept, in a known language (or one of those given) with at least that confidence.

    Without any labelled document nothing can be told, and all rows stay.
    """
    model = learned(docs, sample=sample)
    if model.languages == [UND]:
        return docs
    known = F.col("language").isin(languages) if languages else F.col("language") != UND
    found = of_documents(docs.withColumn("text_hash", F.xxhash64("text")), model, keep=["text_hash"])
    return without(docs, found.where(~(known & (F.col("confidence") >= least))).select("doc_id", "text_hash"))


def both_tables(spark: SparkSession, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id or page_id, language, confidence, text_language, declared, accepted for documents and pages."""
    model = learned(docs)
    of_docs = of_documents(docs, model).select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), "language", "confidence", "text_language", "declared")
    of_page = of_pages(pages, model).select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), "language", "confidence", "text_language", "declared")
    return of_docs.unionByName(of_page).withColumn("accepted", (F.col("language") != UND) & (F.col("confidence") >= 0.5))
