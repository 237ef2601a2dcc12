import hashlib
import random
import re

from pyspark.sql import functions as F

from strandline.llm import decontam, shared
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            q = words(t)
            m = min(13, len(q))
            if item_id is None or not m:
                continue
            grams = {tuple(q[i : i + m]) for i in range(len(q) - m + 1)}
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in grams:
                    hit.update(range(i, i + m))
                    ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(odd_rows):
    item = prose(60, 77)
    items = [(1, item), (2, prose(30, 78)), (3, "two words"), (4, None), (5, "--"), (None, item), (1, item), (10, "Rare! one-off thing"), (11, item.upper())]
    docs = [*odd_rows, (50, "x " + item + " y"), (51, prose(400, 79) + " " + " ".join(item.split()[5:30])), (52, "two; words, two words"), (53, " ".join(item.split()[:12])), (54, "RARE one off thing " * 3), (55, item + " " + item)]
    return docs, items


def test_against_brute_force(spark, odd_rows):
    docs, items = cases(odd_rows)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, diag int")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, size int")
    got = decontam.decontaminated(d, b).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, ",".join(x.item_ids), x.contaminated) for x in got), key=str) == brute(docs, items)


def test_shuffled_joins_agree(spark, odd_rows):
    docs, items = cases(odd_rows)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminated(d, b, broadcast_rows=0).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, ",".join(x.item_ids), x.contaminated) for x in got), key=str) == brute(docs, items)


def test_empty_tables(spark, odd, none):
    b = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert decontam.decontaminated(none, b).count() == 0
    assert decontam.decontaminated(odd, b.where("false")).where("contaminated").count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta"
    docs = [(1, "alpha beta gamma delta"), (2, "alpha so beta gamma and delta"), (3, "delta far away from all the others in this text here alpha beta gamma"), (4, "alpha")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    items = decontam.test_items(b)
    index = decontam.positional_index(d, items.select(F.explode("item_words").alias("term")).distinct(), "doc_id", "text")
    near = lambda slop: sorted({x.doc_id for x in decontam.proximity_matches(index, decontam.rarest_terms(items, index, 13, 4), slop).collect()})
    assert near(0) == [1] and near(2) == [1, 2] and near(20) == [1, 2, 3]


def test_no_python_on_the_main_path(spark, odd):
    b = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    plan = decontam.decontaminated(odd, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def brute_near(docs, items, slop, rarest=2):
    """n_near of each document, from words and loops."""
    held = {(str(i), t) for i, t in items if i is not None and words(t)}
    wanted = {x for _, t in held for x in words(t)}
    count = {}
    for _, text in docs:
        for x in words(text):
            if x in wanted:
                count[x] = count.get(x, 0) + 1
    out = []
    for doc_id, text in docs:
        w, near = words(text), set()
        at = {}
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        for item_id, t in held:
            q = words(t)
            m = min(13, len(q))
            for s in range(len(q) - m + 1):
                if any(q[i] not in count for i in range(s, s + m)):
                    continue
                rare = sorted((count[q[i]], i, q[i]) for i in range(s, s + m))[:rarest]
                places = [[i - p for i in at.get(x, [])] for _, p, x in rare]
                if any(all(any(abs(d - a) <= slop for d in more) for more in places[1:]) for a in places[0]):
                    near.add(item_id)
        out.append((doc_id, len(near)))
    return sorted(out, key=str)


def test_proximity_in_the_result_by_brute_force(spark):
    """200 documents, some with an item's words moved apart by up to 25 places."""
    rng = random.Random(6)
    items = [(i, prose(rng.randrange(1, 40), 500 + i)) for i in range(12)] + [(3, "other text"), (None, prose(20, 1))]
    docs = []
    for i in range(200):
        own = prose(rng.randrange(0, 120), 900 + i).split()
        if i % 3 == 0:
            at = 0
            for x in items[i % 12][1].split():
                at += 1 + rng.choice([0, 0, 0, 1, 2, i % 25])
                own[at:at] = [x]
        docs.append((i, " ".join(own)))
    docs += [docs[0]] * 5
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 2, 20):
        for rows in (decontam.BROADCAST_ROWS, 0):
            got = decontam.decontaminated(d, b, slop=slop, broadcast_rows=rows).select("doc_id", "n_near").collect()
            assert sorted(map(tuple, got), key=str) == brute_near(docs, items, slop)
    exact = {x.doc_id: x.n_items for x in decontam.decontaminated(d, b, slop=0).collect()}
    assert any(exact.values())


def test_a_row_in_a_third_of_the_table(spark):
    """Its copies are looked up in many tasks and matched once for each of them."""
    item = prose(40, 70)
    docs = [(1, "x " + item)] * 300 + [(i, prose(30, i)) for i in range(2, 500)] + [(None, item)] * 50
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame([(9, item)], "item_id long, text string")
    for rows in (decontam.BROADCAST_ROWS, 0):
        got = decontam.decontaminated(d, b, broadcast_rows=rows, slop=2).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, ",".join(x.item_ids), x.contaminated) for x in got), key=str) == brute(docs, [(9, item)])
        assert all(x.n_near == 1 for x in got if x.contaminated)
    # a join that shuffles has every wanted document in several places
    found = shared.split_join(d.select(F.struct("doc_id").alias("doc")), "doc", F.monotonically_increasing_id(), d.select(F.struct("doc_id").alias("doc")).distinct(), 0)
    counts = [r["count"] for r in found.where("doc.doc_id = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert found.count() == len(docs) and (len(counts) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true")
