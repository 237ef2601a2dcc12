import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann, langid, lm, quality, shared, token_counts
from tests.llm.conftest import prose


# --- token counts


def test_histogram_and_sums(spark, odd, odd_rows, none):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.RANKS, "rb"))}
    coder = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = [len(coder.encode_ordinary(t or "")) for _, t in odd_rows]
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(odd), block=4).cache()
    assert {x.n_tokens: x.n_docs for x in sums.collect()} == {n: sizes.count(n) for n in set(sizes)}
    for x in sums.collect():
        assert x.docs_over == sum(s > x.n_tokens for s in sizes) and x.tokens_over == sum(s for s in sizes if s > x.n_tokens)
        assert x.truncated_tokens == sum(min(s, x.n_tokens) for s in sizes)
    limits = [0, 1, 3, 500, 10**6, max(sizes)]
    got = {x.limit: (x.docs_within, x.truncated_tokens, x.tokens_lost) for x in token_counts.limits_report(sums, limits).collect()}
    assert got == {n: (sum(s <= n for s in sizes), sum(min(s, n) for s in sizes), sum(max(s - n, 0) for s in sizes)) for n in limits}
    half = token_counts.length_quantile(sums, [0.5]).first().n_tokens
    assert half == sorted(sizes)[-(-len(sizes) // 2) - 1]
    assert token_counts.with_suffix_sums(token_counts.length_histogram(none)).count() == 0


def test_long_runs(spark):
    count = token_counts.Counter(open(token_counts.RANKS, "rb").read())
    n = 12_000
    for run in (" " * n, "\n" * n, " \n\t" * (n // 3), "\u3000 " * (n // 2), "x" * n, "-" * n):
        for text in (run, f"a{run}", f"{run}b", f"a{run}b c{run} d{run}'s", f"a{run}\x1c{run}"):
            assert count(text) == len(count.whole.encode_ordinary(text)), (run[:3], text[-3:])
    rows = [(i, t) for i, t in enumerate(["x" + " " * 1_000_000, "\n" * 1_000_000 + "y", "z" * 1_000_000])]
    got = token_counts.length_histogram(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.agg(F.sum("n_docs")).first()[0] == 3 and got.agg(F.max("n_tokens")).first()[0] > 900_000


def test_texts_are_encoded_once(spark, odd):
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(odd))
    assert "ArrowEvalPython" not in sums._jdf.queryExecution().executedPlan().toString()
    assert token_counts.limits_report(sums.where("false"), [3]).count() == 0


# --- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12)).astype(np.float32).astype(float)
    x[100:130] = x[99]  # a group of copies
    rows = [(i, [float(v) for v in r], "s") for i, r in enumerate(x)]
    bad = [(500, None, "s"), (550, [0.0] * 12, "s"), (600, [1.0, None] + [0.0] * 10, "s"), (601, [float("nan")] * 12, "s"), (602, [float("inf")] * 12, "s"), (650, [1.0, 2.0], "s"), (None, [1.0] * 12, "s"), (399, rows[399][1], "s")]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(df, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert sorted(got) == list(range(0, 400, 50))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        found.sort()
        s = u @ u[q]
        s[q] = -2
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        assert [(-round(f[2], 12), f[1]) for f in found] == sorted((-round(f[2], 12), f[1]) for f in found)
        assert all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hit += len({f[1] for f in found} & set(np.lexsort((np.arange(400), -np.round(s, 12)))[:5].tolist()))
    assert hit >= 0.9 * 5 * len(got)
    assert ann.nearest(df.where("false"), F.col("id") % 50 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), F.col("id") % 50 == 0).collect()
    assert sorted(r.id for r in few) == [1, 2]


def test_repeated_ids_take_one_place(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    near = x[0] + rng.normal(0, 0.01, size=(60, 8))  # one id's rows, all closer to the query than any other
    vectors = [*enumerate(x), *((1, v) for v in near), *((1, near[0]) for _ in range(60)), *((0, x[0]) for _ in range(3))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    got = {r["rank"]: (r.id, r.score) for r in ann.nearest(df, F.col("id") == 0, leaf=1000).collect()}
    best = {}
    for i, v in vectors:
        if i:
            best[i] = max(best.get(i, -2), v @ x[0] / np.linalg.norm(v) / np.linalg.norm(x[0]))
    want = sorted(best.items(), key=lambda b: -b[1])[:5]
    assert [got[i + 1][0] for i in range(5)] == [i for i, _ in want] and got[1][0] == 1
    assert [got[i + 1][1] for i in range(5)] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize("n", [600, 4000])
def test_recall_with_fewer_products_than_rows(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("id") % 50 == 0).collect()
    u = ann.unit(x.astype(float))
    hit = 0
    for q in range(0, n, 50):
        s = u @ u[q]
        s[q] = -2
        own = [r for r in got if r.query_id == q]
        assert all(abs(r.score - s[r.id]) < 1e-12 for r in own)
        hit += len({r.id for r in own} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 5 * len(range(0, n, 50))
    forest = ann.grown(u)
    leaves = np.stack([forest.route(u, t) for t in range(ann.TREES)], axis=1)
    scored = [np.isin(leaves, forest.search(u[q], ann.SHARE)).any(axis=1).sum() for q in range(0, n, 50)]
    assert max(scored) < 0.9 * n


def test_copies_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8))
    rows = [*enumerate(x), *((1000 + i, x[7]) for i in range(90))]  # a hot vector in many blocks
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in rows], "vec_id long, embedding array<double>")
    got = [r.id for r in sorted(ann.nearest(df, F.col("id") == 1050, share=1.0).collect(), key=lambda r: r["rank"])]
    assert got == [7, 1000, 1001, 1002, 1003]


# --- language


def test_language(spark, sf_dir, odd, none):
    docs = shared.table(spark, sf_dir, "documents")
    model = langid.learned(docs)
    found = langid.of_documents(docs, model).collect()
    lang = dict(docs.select("doc_id", "lang").collect())
    assert np.mean([x.language == lang[x.doc_id] for x in found]) > 0.97
    pages = langid.of_pages(shared.table(spark, sf_dir, "pages"), model).collect()
    assert np.mean([x.language == x.declared for x in pages]) > 0.9
    rows = {x.doc_id: x for x in langid.of_documents(odd, model).collect()}
    assert rows[5].language == rows[6].language == rows[7].language == langid.UND
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    assert langid.of_documents(none, model).count() == 0 and langid.accepted(none).count() == 0


def test_host_prior_decides_a_short_text(spark):
    words = {"de": "und der die das nicht ein ist", "fr": "les des une est dans pour que"}
    rows = [(i, " ".join([words[k]] * 5), k, f"{k}.example.net") for k in words for i in range(20 * (k == "fr"), 20 * (k == "fr") + 20)]
    rows += [(100, "q", None, "de.example.net"), (101, "q", None, "fr.example.net")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.language for x in langid.of_documents(docs, langid.learned(docs)).collect()}
    assert got[100] == "de" and got[101] == "fr"


def plain_fusion(rows, own, languages):
    """language and confidence of (declared, host, suffix) rows from their texts' posteriors, with plain loops."""
    k = len(languages)
    even = [(1 - langid.UND_PRIOR) / (k - 1)] * (k - 1) + [langid.UND_PRIOR]
    out = []
    domain = lambda h: ".".join(h.split(".")[-2:])
    hosts = {(h, s) for _, h, s in rows if h}
    total = lambda test: (sum(1 for r in rows if test(r)), np.sum([np.zeros(k)] + [own[i] for i, r in enumerate(rows) if test(r)], axis=0))
    smooth = lambda n, s, above: (s + langid.KAPPA * np.array(above)) / (n + langid.KAPPA)
    p_all = smooth(*total(lambda r: r[1]), even)
    for i, (declared, host, suffix) in enumerate(rows):
        if own[i][k - 1] > 1 - 1e-12:
            out.append((langid.UND, 1.0))
            continue
        prior = np.array(even)
        if (host, suffix) in hosts:
            p_suffix = smooth(*total(lambda r: r[1] and r[2] == suffix), p_all)
            p_domain = smooth(*total(lambda r: r[1] and r[2] == suffix and domain(r[1]) == domain(host)), p_suffix)
            n, s = total(lambda r: r[1:] == (host, suffix))
            prior = (np.maximum(s - own[i], 0) + langid.KAPPA * p_domain) / (n - 1 + langid.KAPPA)
        e = np.log(np.maximum(own[i], 1e-30)) + np.log(np.maximum(prior, 1e-12)) - np.log(even)
        for at, value in ((0, declared), (2, suffix)):
            if value:
                _, s = total(lambda r: r[at] == value)
                _, t = total(lambda r: r[at])
                v = len({r[at] for r in rows if r[at]})
                e += np.log((np.maximum(s - own[i], 0) + langid.ALPHA) / (np.maximum(t - own[i], 0) + langid.ALPHA * v))
        p = np.exp(e - e.max())
        out.append((languages[int(e.argmax())], p.max() / p.sum()))
    return out


@pytest.mark.parametrize("most", [langid.BROADCAST_ROWS, 0])
def test_fusion_against_plain_loops(spark, sf_dir, most, monkeypatch):
    monkeypatch.setattr(langid, "BROADCAST_ROWS", most)
    model = langid.learned(shared.table(spark, sf_dir, "documents"))
    texts = [r.text for r in shared.table(spark, sf_dir, "documents").orderBy("doc_id").limit(60).collect()] + ["q", "", None, "12"]
    rng = np.random.default_rng(0)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    rows = [(i, t[:40] if t and i % 3 else t, pick("de", "en", "zz", None), pick("a.x.de", "b.x.de", "y.org", None), pick("de", "org", None), "e", 1) for i, t in enumerate(texts)]
    rows = [(*r[:4], r[3] and r[3].rsplit(".", 1)[1], *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, h string, s string, place string, row int")
    got = {x.doc_id: x for x in langid.identified(df, model, "doc_id", "text", declared=F.col("d"), host=F.col("h"), suffix=F.col("s")).collect()}
    own = langid.text_posteriors(model, [t or "" for _, t, *_ in rows])
    for (i, *_), (language, confidence) in zip(rows, plain_fusion([r[2:5] for r in rows], own, model.languages), strict=True):
        assert got[i].language == language and got[i].confidence == pytest.approx(confidence, rel=1e-6)


def test_language_with_declarations_withheld(spark):
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.learned(docs.where(F.col("doc_id") % 2 == 0))
    rest = docs.where(F.col("doc_id") % 2 == 1)
    lang = dict(rest.select("doc_id", "lang").collect())
    got = langid.of_documents(rest.withColumns({"lang": F.lit(None).cast("string")}), model).collect()
    assert np.mean([x.language == lang[x.doc_id] for x in got]) > 0.9
    assert np.mean([x.text_language == lang[x.doc_id] for x in got]) > 0.9


def test_declaration_after_a_long_start():
    for start in ("", f"<!-- {'licence ' * 600} -->", " \n" * 3000, f"<!-- {'x' * 5000} <html lang='xx'> --><!doctype html>"):
        assert langid.page_text(f"{start}<html class='a' lang=\"DE-at\"><body>q")[1] == "de"
    assert langid.page_text("<html><body><script>var t = '<html lang=xx>'</script><!-- <html lang=xx> --> q")[1] is None
    assert langid.page_text("<!--><html lang=fr>")[1] == "fr" and langid.page_text("")[1] is None


def test_rare_languages_are_learned(spark):
    words = {"de": "und der die das nicht ein ist", "fr": "les des une est dans pour que", "fi": "mutta sekä joka kun vain niin"}
    rows = [(i, f"{words['de']} {i}", "de") for i in range(1500)] + [(None, f"{words['fr']} {i}", "fr") for i in range(5)]
    rows += [(3000 + i, f"{words['fi']} {i}", "fi-FI") for i in range(3)] + [(4000, words["fi"], "und")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string"))
    model = langid.learned(docs, sample=20)
    assert model.languages == ["de", "fi", "fr", langid.UND]
    got = [x.language for x in langid.of_documents(docs.where("doc_id between 3000 and 3999 or doc_id is null"), model).collect()]
    assert sorted(got) == ["fi"] * 3 + ["fr"] * 5


# --- quality


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    counts, turn = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    score = rng.normal(size=(8, 2))
    got, pairs = quality.marginals(score, turn, counts)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in counts:
        total, each, two = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + i, s] for i, s in enumerate(path)) + sum(turn[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for i, s in enumerate(path):
                each[i, s] += w
            for a, b in itertools.pairwise(path):
                two[a, b] += w
        assert np.allclose(got[at : at + n], each / total)
        want_pairs += two / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_quality_on_held_out_documents(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = shared.table(spark, sf, "documents"), shared.table(spark, sf, "labels")
    held = shared.crc_mod(F.col("doc_id"), 4) == 2
    got = quality.scored(docs, labels, held).join(labels, "doc_id").collect()
    out = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert len(out) > 50 and np.mean([x.predicted == x.quality for x in out]) > 0.95
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x.doc_id: x.score for x in quality.scored(docs, flipped, held).collect()}
    assert all(again[x.doc_id] == x.score for x in got)
    edge = quality.scored(odd, labels, held, line_scores=True).collect()
    assert all(0 <= x.score <= 1 for x in edge)
    lines = {x.doc_id: len(x.lines) for x in edge}
    assert lines[5] == lines[6] == 1 and lines[7] == 2
    assert quality.scored(none, labels, held).count() == 0
    assert {x.score for x in quality.scored(odd, labels.where("false"), held).collect()} == {0.5}


# --- language model


def test_tables_are_normalised():
    rng = np.random.default_rng(0)
    p = lm.first_values(rng.dirichlet(np.ones(9000)))
    p["target"] = rng.normal(0, 1, p["target"].shape)
    near, far, norm = lm.normalised(p)
    for a, b in ((5, 9), (0, 0), (1023, 700)):
        logit = (near[a] + far[b]).astype(float) @ p["target"].T + p["bias"]
        assert np.exp(logit - norm[a, b]).sum() == pytest.approx(1, abs=1e-3)


def plain_scores(docs, vocab, p):
    """log10 of each text's probability by a softmax over all outputs for every token, and word shares within classes."""
    outputs, classes = vocab.tables()
    out = []
    for text in docs:
        total, before = 0.0, [0, 0]
        for w in [*lm.text_words(text), b""]:
            code = vocab.words.get(w, lm.ending_class(w) - lm.ENDINGS)
            h = p["context"][before[-1]] @ p["one"] + p["context"][before[-2]] @ p["two"]
            logit = p["target"] @ h + p["bias"]
            o = outputs[code]
            total += logit[o] - logit.max() - np.log(np.exp(logit - logit.max()).sum())
            if o >= vocab.singles:
                e = o - vocab.singles
                c = vocab.counts[code] if code >= 0 else 0
                total += np.log((c + 0.5) / (vocab.class_total[e] + 0.5 * (vocab.class_words[e] + 1)))
            before.append(classes[code])
        out.append(total / np.log(10))
    return out


def test_lm_against_a_plain_softmax_whatever_the_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "OUTPUT_WORDS", 900)
    monkeypatch.setattr(lm, "SLOT_TOKENS", 2000)
    kept, first = {}, lm.normalised
    monkeypatch.setattr(lm, "normalised", lambda p: kept.update(p=p) or first(p))
    words, made = lm.vocabulary, []
    monkeypatch.setattr(lm, "vocabulary", lambda counts: made.append(words(counts)) or made[-1])
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = []
    for n in (1, 4, 40):
        got = {x.doc_id: x.score for x in lm.scored(docs.repartition(n), held_out=shared.crc_mod(F.col("doc_id"), 5) == 1).collect()}
        scores.append([got[i] for i in sorted(got)])
    assert scores[1] == pytest.approx(scores[0], rel=1e-7) and scores[2] == pytest.approx(scores[0], rel=1e-7)
    rows = [(x.doc_id, x.text) for x in docs.collect() if len(x.text or "") < 800][:60]
    assert [got[i] for i, _ in rows] == pytest.approx(plain_scores([t for _, t in rows], made[-1], kept["p"]), rel=1e-4, abs=1e-2)


def test_copies_are_dealt_over_slots(spark, monkeypatch):
    """400 copies of one row among 1,000, and null ones: no slot has more than twice SLOT_TOKENS, and every row is coded once."""
    monkeypatch.setattr(lm, "SLOT_TOKENS", 2000)
    docs = [(1, prose(120, 1))] * 400 + [(i, prose(100, i)) for i in range(2, 550)] + [(None, None)] * 52
    rows = spark.createDataFrame(docs, "_id long, _text string").repartition(5).withColumn("_out", F.lit(False))
    for most in (lm.FREQUENT_ROWS, 0):
        monkeypatch.setattr(lm, "FREQUENT_ROWS", most)
        vocab = lm.vocabulary(shared.written(lm.word_counts(rows.select("_text")), "counts"))
        slots = lm.ROUNDS * round(vocab.n / (lm.ROUNDS * lm.SLOT_TOKENS))
        loads = {r.slot: r.n for r in lm.coded(rows, vocab, slots).groupBy("slot").agg(F.sum("n_tokens").alias("n")).collect()}
        assert sum(loads.values()) == vocab.n == sum(len((t or "").split()) + 1 for _, t in docs)
        assert max(loads.values()) <= 2 * lm.SLOT_TOKENS, sorted(loads.values())[-3:]


def check_lm(got, docs, held):
    want = {}
    train = [w for i, t in docs if not held(i) for w in [*(t or "").encode().lower().split(), b""]]
    counts = {}
    for w in train:
        counts[w] = counts.get(w, 0) + 1
    n, v = len(train), len(counts)
    for i, t in docs:
        ws = [*(t or "").encode().lower().split(), b""]
        want[i] = (len(ws), sum(w in counts for w in ws), sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    for x in got:
        size, known, base = want[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (size, known, n, held(x.doc_id))
        assert x.base_score == pytest.approx(base, abs=1e-6) and np.isfinite(x.score) and x.score <= 0


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("most", [lm.BROADCAST_WORDS, 50])
def test_lm(spark, sf_dir, most, monkeypatch):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (most,))
    docs = shared.table(spark, sf_dir, "documents")
    got = lm.scored(docs, held_out=shared.crc_mod(F.col("doc_id"), 5) == 1).collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    check_lm(got, rows, held_out)
    if most > 50:
        out = [x for x in got if x.held_out]
        assert sum(x.score for x in out) > sum(x.base_score for x in out)


def test_lm_odd_rows(spark, odd, odd_rows, none):
    assert lm.scored(odd.repartition(40)).count() == len(odd_rows)  # most partitions are empty
    got = lm.scored(odd, held_out=shared.crc_mod(F.col("doc_id"), 5) == 1).collect()
    assert len(got) == len(odd_rows)
    check_lm(got, odd_rows, held_out)
    assert lm.scored(none).count() == 0
    unseen = lm.scored(odd, held_out=F.lit(True)).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 for x in unseen)
