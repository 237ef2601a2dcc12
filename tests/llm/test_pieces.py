import random

import sentencepiece

from strandline.llm import pieces


def plain_agenda(unit, vocab, key, limit):
    """One unit by the definition: best score, then leftmost; each turn draws; a skipped pair is out until it changes."""
    if unit == pieces.SPACE:
        return [vocab.byte_ids[b] for b in unit.encode()]
    symbols, turn, out = [(c, False) for c in unit.replace(" ", pieces.SPACE)], 0, []
    dead = set()
    names = [c for c, _ in symbols]
    marks = list(range(len(names)))  # identity of each symbol
    fresh = len(names)
    while True:
        open_ = [(int(vocab.order[vocab.ids[names[i] + names[i + 1]]]), i) for i in range(len(names) - 1) if names[i] + names[i + 1] in vocab.ids and (marks[i], marks[i + 1]) not in dead]
        if not open_:
            break
        _, i = min(open_)
        skip = pieces.skipped(key, turn, limit)
        turn += 1
        if skip:
            dead.add((marks[i], marks[i + 1]))
            continue
        names[i : i + 2], marks[i : i + 2] = [names[i] + names[i + 1]], [fresh]
        fresh += 1
    for s in names:
        out.extend([vocab.ids[s]] if s in vocab.ids else [vocab.byte_ids[b] for b in s.encode("utf-8")])
    return out


def plain_encode(text, vocab, seed, dropout, doc_id):
    units = pieces.UNIT.findall(" " + text) if text else []
    keys = pieces.unit_keys(pieces.document_key(seed, doc_id), len(units))
    return [i for u, k in zip(units, keys, strict=True) for i in plain_agenda(u, vocab, int(k), round(dropout * 65536))]


VOCAB = pieces.load()
TEXTS = ["", " ", "the of and the of and", "\n x\ty  lead", "▁x ▁▁ y", "é漢字😀\x00", "a" * 90 + " b", "Mississippi straightforwardness reorganisation", "x" * 40 + "internationalisation" * 3]


def test_same_as_the_library_without_dropout():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coder = pieces.Encoder(VOCAB, dropout=0.0)
    for t in TEXTS:
        if pieces.SPACE not in t:
            assert list(coder.encode(t)) == sp.encode(t)


def test_same_as_the_definition_with_dropout():
    rng = random.Random(3)
    texts = [*TEXTS, *(" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 45))) for _ in range(30)) for _ in range(5))]
    for seed in (1, 2):
        coder = pieces.Encoder(VOCAB, seed=seed, dropout=0.25)
        for _ in range(2):  # with and without kept units
            for i, t in enumerate(texts):
                assert list(coder.encode(t, i)) == plain_encode(t, VOCAB, seed, 0.25, i)


def test_seeds_vary_and_decode():
    text = "the straightforward reorganisation of international houses " * 5
    a, b = (pieces.Encoder(VOCAB, seed=s, dropout=0.2).encode(text, 1) for s in (1, 2))
    assert a != b and pieces.decode(a, VOCAB.spelled) == pieces.decode(b, VOCAB.spelled) == text


def test_rows(spark, odd, odd_rows, none):
    got = pieces.encoded(odd)
    rows = got.select("doc_id", "text", "piece_ids", "lossless").collect()
    assert len(rows) == len(odd_rows)
    for x in rows:
        assert x.lossless is (None if x.text is None else True)
        assert (x.piece_ids is None) == (x.text is None)
    assert set(got.columns) == {*odd.columns, "piece_ids"}
    back = pieces.decoded(spark, got.select("doc_id", F_text(got), "piece_ids"))
    assert back.where("not (text <=> was)").count() == 0
    assert pieces.encoded(none).count() == 0


def F_text(df):
    return df["text"].alias("was")


def test_string_ids(spark):
    rows = [("a", "the straightforward reorganisation of houses " * 9), (None, "x"), ("a", "the straightforward reorganisation of houses " * 9)]
    got = pieces.encoded(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(x.lossless for x in got)
    assert len({tuple(x.piece_ids) for x in got if x.doc_id == "a"}) == 1
