import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import divergence


def terms(text):
    out, word = [], ""
    for c in text or "":
        if c.isascii() and not c.isalpha():
            out, word = (out + [word] if word else out), ""
        else:
            word += c.lower() if c.isascii() else c
    return out + [word] if word else out


def brute(rows, least=10, ranks=10):
    """rows: (lang, source, text); dense tables of all groups by all kept terms."""
    docs = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    frequency, counts = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang, source) for lang, source, _ in docs})
    for lang, source, words in docs:
        frequency[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in sorted({lang for lang, _ in groups}):
        kept = sorted(t for t, n in frequency[lang].items() if n >= least)
        sources = [s for x, s in groups if x == lang]
        table = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        table[None] = {t: sum(table[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()} for s, c in table.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            value = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(value)]
            value = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if table[s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(value[:ranks])]
    return sorted(out)


def got(df):
    return sorted((x.lang, x.source, x.part, x["item"], x.value, x["rank"]) for x in df.collect())


def rows_of(n, seed, langs=("en", "de", None), sources=("a", "b", "c", None, "\0x")):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Straße", "ÉTÉ", "naïve", "漢字", "😀x"]
    out = []
    for _ in range(n):
        source = rng.choice(sources)
        pick = vocabulary[: 60 + 10 * len(source or "")]
        out.append((rng.choice(langs), source, " ".join(rng.choice(pick) + rng.choice(["", "!", "7"]) for _ in range(rng.randrange(0, 40)))))
    return out


@pytest.fixture(scope="module")
def some():
    lonely = [("fr", "only", "un deux trois"), ("es", "p", None), ("es", "q", ""), ("en", "no terms", "123 456")]
    return rows_of(300, 1) + lonely + rows_of(40, 2)[:20] * 2


def frame(spark, rows):
    """With columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], "lang string, source string, text string, n long, term string, p long, value int")


@pytest.mark.parametrize("width", [None, 4, 16])
def test_audit_by_brute_force(spark, some, width):
    assert got(divergence.audit(frame(spark, some), width=width)) == brute(some)


def test_other_limits_and_splits(spark, some, monkeypatch):
    monkeypatch.setattr(divergence, "FEW_GROUPS", 0)  # joins that split every key
    monkeypatch.setattr(divergence, "HELD", 7)  # tasks hand on many times
    assert got(divergence.audit(frame(spark, some).repartition(7), least_docs=3, ranks=4)) == brute(some, 3, 4)


def test_sketch_never_underestimates(spark, some):
    width = 6
    docs = frame(spark, some).repartition(5).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    pages = {(x["row"], x["page"]): np.frombuffer(x["cells"], dtype=np.uint8) for x in divergence.sketch(docs, 10, width).collect()}
    for lang in ("en", "de", ""):
        frequency = Counter(t.encode() for x, _, text in some if (x or "") == lang for t in set(terms(text)))
        for row, at in enumerate(divergence.cells(lang.encode(), list(frequency), width)):
            assert all(pages[row, 0][a] >= min(10, n) for a, n in zip(at, frequency.values(), strict=True))


def test_only_what_passes_is_shuffled(spark):
    """One frequent word among thousands of rare ones: the rare ones don't leave the tasks."""
    rows = [("en", "s", f"common {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q") for i in range(4000)]
    docs = frame(spark, rows)
    width = divergence.width_for(len(rows))
    bits = divergence.passing(divergence.sketch(docs, 10, width), 10, width)
    left = {x.term: (x.n, x.docs) for x in divergence.term_counts(docs, bits, width).collect()}
    assert left["common"] == (4000, 4000) and len(left) < 40


def test_empty_odd_and_long(spark, odd, odd_rows, none):
    assert divergence.audit(none).count() == 0
    assert got(divergence.audit(odd, least_docs=2)) == brute([("en", "src0", t) for _, t in odd_rows], 2)
    rows = [("en", s, "Word " * 100_000 + "x" * 300_000) for s in "ab"] + [("en", "a", "word")] * 10
    assert got(divergence.audit(frame(spark, rows))) == brute(rows)


def test_shares_of_large_counts(spark):
    n = 5 * 10**17
    df = spark.createDataFrame([(n, 3 * n, 10**9)], "c long, n long, v long")
    assert df.select(divergence.share("c", "n")).first()[0] == 1 + 10**9 * (n + 2) // (3 * n + 2 * 10**9)
