import pytest

from strandline.llm import neardup
from tests.llm.conftest import edited, prose, table


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows):
    got = neardup.near_duplicates(table(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (*want[x.doc_id], x.doc_id == want[x.doc_id][1])


def test_odd_rows(spark, odd_rows):
    check(spark, odd_rows)


def test_one_large_loose_group(spark):
    base = prose(150, 9)
    rows = [(i, edited(base, 0.012 * (1 + i % 5), i)) for i in range(260)] + [(1000 + i, prose(40, 50 + i)) for i in range(40)]
    check(spark, rows)


def test_blocks_of_two_documents(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    base = prose(120, 5)
    check(spark, [(i, edited(base, 0.02 + 0.001 * i, i)) for i in range(60)])


def test_texts_that_share_an_id_stay_apart(spark):
    a, b, c = prose(60, 21), prose(60, 22), prose(60, 23)
    rows = [(1, a), (2, a), (2, b), (1, c), (3, c), (1, a), (4, None), (4, None), (4, ""), (None, a), (None, a)]
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (1, 1, True), (3, 1, False), (1, 1, True), (4, 4, True), (4, 4, True), (4, 4, True), (None, None, True), (None, None, True)], key=str)
    left = sorted(((x.doc_id, x.text) for x in neardup.deduplicated(table(spark, rows)).collect()), key=str)
    assert left == sorted([(1, a), (2, b), (1, c), (4, None), (4, ""), (None, a), (None, a)], key=str)
    one = neardup.deduplicated(table(spark, [(7, a), (7, a.upper()), (8, a)])).collect()
    assert len(one) == 1 and one[0].doc_id == 7


def test_very_long_texts(spark):
    base = prose(150_000, 31)
    check(spark, [(1, base), (2, base + " more"), (3, "x " * 400_000), (4, prose(100, 32)), (5, edited(base, 0.03, 1))])


def test_clashing_names(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f")]
    docs = table(spark, rows).selectExpr("*", "1 as key_id", "2 as KEY_HASH", "3 as gone_id", "4 as comp", "5 as salt", "6 as component_id", "7 as node", "8 as least")
    left = neardup.deduplicated(docs)
    assert left.columns == docs.columns and [x.doc_id for x in left.collect()] == [1]


def test_cuts_of_a_leader(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TOGETHER", 300)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    base = prose(120, 6)
    check(spark, [(i, edited(base, 0.02 + 0.001 * i, i)) for i in range(50)])


def test_empty(none):
    assert neardup.near_duplicates(none).count() == 0


def test_bounds_keep_pairs_at_the_threshold():
    for n, m in neardup.least_matches(128, 16, 75, 1e-7):
        assert 0 <= m < 0.75 * n


def test_deduplicated_keeps_columns(spark, odd, odd_rows):
    left = neardup.deduplicated(odd)
    assert left.columns == odd.columns
    want = brute(odd_rows)
    assert sorted(x.doc_id for x in left.where("doc_id is not null").select("doc_id").distinct().collect()) == sorted(i for i, (_, c) in want.items() if i == c)


@pytest.mark.parametrize("size", [5, 3])
def test_common_shingles(size):
    sets = [neardup.shingle_hashes(prose(n, n), neardup.WordHashes(), size) for n in (3, 40, 80)]
    got = neardup.common_shingles(sets, sets, width=7)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == len(set(a.tolist()) & set(b.tolist()))
