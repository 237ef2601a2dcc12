"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact links.

A document's set holds its distinct shingles of five words (fewer words: the
whole sequence). Documents with equal sets form a class at once; one row of
each class goes on as its node. A node is a number of its own, so texts that
share an id stay apart. Nodes that share a band of their signatures share a
bucket. Candidates are compared batch by batch of signature values: a pair is
dropped as soon as the posterior probability that its similarity reaches the
threshold falls under a chosen miss probability. Survivors are confirmed on
their full sets, which are hashed once and then travel as hashes.

Buckets never emit all their pairs. First each member is compared with its
bucket's leader, and with another leader as long as most members of the
undecided buckets are not linked to the largest component there. Then, in
buckets whose members still lie in several components, members outside the
main one are compared with all members of other components, in blocks of
bounded size inside the tasks: pruned by their signatures, confirmed on their
full sets, and only links leave the block. So each pair of a bucket is either
linked through others or compared, whatever the bucket's size. What is known of
a bucket, a leader or a component reaches its rows through keys that are salted
by the row, so that a group of a third of all rows is dealt to many tasks.

Defined results: null or wordless texts have an empty set and are linked with
nothing. Rows that repeat an id and text get equal results. Different texts
with one id are told apart: each belongs to its own component. A row without an
id is linked with nothing, has no component and is kept. Texts may be of any
length: a set is held whole, and pairs are dealt out by the size of their sets.
Other columns are not read. An empty table gives no rows. `deduplicated` leaves
one row of each component, and one of rows that repeat an id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import bounded_batches, looked_up, one_of_repeats, salted, trimmed, without, written

SHINGLE = 5
#: Similarity in percent that makes a link.
PERCENT = 75
#: 32 bands of 4 values: a pair at the threshold shares none with probability 5e-6.
BANDS, ROWS = 32, 4
#: Signature values compared before the posterior is looked at again.
BATCH = 16
#: A pair is dropped when the posterior probability of a link is under this.
MISS = 1e-7
SEED = 20_240_229
#: Rounds with one leader per bucket before the block comparison, documents of a block's side and their shingles.
STAR_ROUNDS, BLOCK, BLOCK_SHINGLES = 3, 192, 400_000
#: Shingles of the followers that are confirmed with one copy of their leader's.
TOGETHER = 100_000
#: Edges that one task of the component search takes at least.
EDGES_PER_TASK = 100_000
#: Ids of candidate documents (8 bytes each) are broadcast up to so many.
BROADCAST_ROWS = 400_000


class WordHashes(dict):
    """64-bit hash of each word, computed once per batch."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    width = min(size, n)
    total = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(total)


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(seed).integers(0, 2**64, (2, count), np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Least value of each hash function over the set, in 32 bits."""
    least = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def least_matches(total: int, batch: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n values, fewer than m equal ones leave the posterior under `miss`.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1);
    its tail above t is the binomial sum of n + 1 draws up to m.
    """
    t, out = percent / 100, []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def signed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (128 bits of the whole set; null if empty), sig."""
    kind = dict(docs.dtypes)[id_col]
    a, b = hash_family(BANDS * ROWS, SEED)

    @trimmed
    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for part in parts:
            hashes, sizes, digests, sigs = WordHashes(), [], [], []
            for text in part["_text"]:
                s = shingle_hashes(text, hashes)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, a, b) if len(s) else None)
            yield pd.DataFrame({"doc_id": part["_id"], "text_hash": part["_hash"], "n_shingles": sizes, "digest": digests, "sig": sigs})

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    return own.mapInPandas(sign, f"doc_id {kind}, text_hash long, n_shingles long, digest binary, sig binary")


def in_buckets(nodes: DataFrame) -> DataFrame:
    """node, band, bucket: one row per band."""
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, i * {4 * ROWS} + 1, {4 * ROWS})))")
    return nodes.select("node", F.posexplode(keys).alias("band", "bucket"))


def passing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b whose signatures survive the sequential pruning."""
    bounds = least_matches(BANDS * ROWS, BATCH, PERCENT, MISS)

    @trimmed
    def prune(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x, y = (np.frombuffer(b"".join(part[c]), ">u4").reshape(len(part), -1) for c in ("sig_a", "sig_b"))
            left, equal, at = np.arange(len(part)), np.zeros(len(part), int), 0
            for n, m in bounds:
                equal = equal + (x[left, at:n] == y[left, at:n]).sum(axis=1)
                keep, at = equal >= m, n
                left, equal = left[keep], equal[keep]
            yield part.iloc[left][["a", "b"]]

    pairs = written(pairs, "pairs")
    signed = lambda end: nodes.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"))
    # a node follows in one pair a band at most, but leads in any number
    both = looked_up(pairs.join(signed("b"), "b"), "a", "b", signed("a"), asking=pairs)
    return both.select("a", "b", "sig_a", "sig_b").mapInPandas(prune, "a long, b long")


def sets_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, n_shingles, shingles (8 bytes each, sorted) of the nodes in ids (column node, distinct), stored."""
    wanted = written(nodes.join(ids, "node", "left_semi").select("node", "doc_id", "text_hash"), "wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select("node", "text")

    @trimmed
    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            hashes = WordHashes()
            sets = [shingle_hashes(t, hashes) for t in part["text"]]
            yield pd.DataFrame({"node": part["node"], "n_shingles": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return written(texts.mapInPandas(hashed, "node long, n_shingles long, shingles binary").dropDuplicates(["node"]), "sets")


def as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs a, b (a leads) that are links on their full sets; pairs is a stored table.

    A leader's pairs are cut by the size of the followers' sets, and each cut
    takes one copy of the leader's set.
    """
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, id_col, text_col)
    sized = pairs.join(nodes.select(F.col("node").alias("b"), "n_shingles"), "b")
    cuts = written(sized.groupBy("a").agg(F.ceil(F.sum("n_shingles") / TOGETHER).alias("cuts")), "cuts")
    followers = looked_up(pairs, "a", "b", cuts).select("a", F.pmod(F.xxhash64("b"), F.col("cuts")).alias("cut"), "b")
    followers = followers.join(sets.select(F.col("node").alias("b"), "shingles"), "b").select("a", "cut", "b", "shingles")
    leaders = cuts.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("lead")), "a")
    leaders = leaders.select("a", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "lead")

    def confirm(key, led: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        x, keep = as_set(lead["lead"].iloc[0]), []
        for raw in led["shingles"]:
            y = as_set(raw)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        return led.loc[np.array(keep, bool), ["a", "b"]]

    return followers.groupBy("a", "cut").cogroup(leaders.groupBy("a", "cut")).applyInPandas(confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node reachable) for the nodes of edges a, b; edges is a stored table."""
    tasks = 1 + edges.count() // EDGES_PER_TASK
    kept = lambda df, name: written(df.coalesce(tasks), name)
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = kept(both, "edges")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = looked_up(both, "b", "a", labels.select(F.col("node").alias("b"), "comp")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("there"))
        step = kept(looked_up(lower, "to", "node", jump).select("node", "was", F.least("to", "there").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if not step.where("comp <> was").limit(1).count():
            return labels


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with comp: their component so far, or themselves."""
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def main_components(members: DataFrame) -> DataFrame:
    """bucket, main (the component with most members), size, in_main, shingles of all and of those in main."""
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    most = F.max(F.struct("n", "comp", "weight"))
    return sizes.groupBy("bucket").agg(most.alias("most"), F.sum("n").alias("size"), F.sum("weight").alias("weight")).select(
        "bucket", F.col("most.comp").alias("main"), "size", F.col("most.n").alias("in_main"), "weight", (F.col("weight") - F.col("most.weight")).alias("outer_weight")
    )


def common_shingles(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by matrix products over shingles that occur on both sides."""
    a, b = np.concatenate(left), np.concatenate(right)
    of_a, of_b = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(shared), width):
        some = shared[i : i + width]
        sides = []
        for values, owner, n in ((a, of_a, len(left)), (b, of_b, len(right))):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[at] == values
            side = np.zeros((n, len(some)), np.float32)
            side[owner[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def block_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links a, b between different components of a bucket; of an outsider's links to one component, one.

    members: bucket, band, node, n_shingles, comp. In each bucket the
    members outside its main component meet all members, block by block. A pair
    is taken up in the first band that it shares, so that other buckets of it
    pass it over.
    """
    parts = lambda n, weight: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES))
    main = main_components(members).withColumns(
        {"blocks": parts(F.col("size"), F.col("weight")), "outer": parts(F.col("size") - F.col("in_main"), F.col("outer_weight"))}
    )
    sets = sets_of(members.select("node").distinct(), nodes, docs, id_col, text_col).select("node", "shingles")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    all_of = looked_up(members, "bucket", "node", main.select("bucket", "main", "blocks", "outer"))
    inner = all_of.select("bucket", "band", "node", "comp", F.lit(False).alias("out"), place("blocks").alias("j"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"))
    outer = all_of.where("comp <> main").select("bucket", "band", "node", "comp", F.lit(True).alias("out"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), place("outer").alias("i"))
    bounds = least_matches(BANDS * ROWS, BATCH, PERCENT, MISS)

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(block["sig"]), ">u4").reshape(len(block), -1).astype(np.uint32)
        bands = sig.reshape(len(block), BANDS, ROWS)
        out, node, comp, band = (block[c].to_numpy() for c in ("out", "node", "comp", "band"))
        inside, outside = np.flatnonzero(~out), np.flatnonzero(out)
        left_of: dict[int, np.ndarray] = {}
        for k in outside:
            left = inside[comp[inside] != comp[k]]
            equal, at = np.zeros(len(left), int), 0
            for n, m in bounds:
                equal = equal + (sig[left, at:n] == sig[k, at:n]).sum(axis=1)
                keep, at = equal >= m, n
                left, equal = left[keep], equal[keep]
            if len(left):
                left = left[(bands[left] == bands[k]).all(axis=2).argmax(axis=1) == band[k]]
            if len(left):
                left_of[k] = left
        found_a, found_b = [node[:0]], [node[:0]]
        if left_of:
            raw = block["shingles"].tolist()
            rights = np.unique(np.concatenate(list(left_of.values())))
            ours, theirs = ([as_set(raw[k]) for k in which] for which in (left_of, rights))
            common = common_shingles(ours, theirs)
            size = np.array(list(map(len, theirs)))
            for i, (k, left) in enumerate(left_of.items()):
                at = np.searchsorted(rights, left)
                link = left[100 * common[i, at] >= PERCENT * (len(ours[i]) + size[at] - common[i, at])]
                link = link[np.unique(comp[link], return_index=True)[1]]
                found_a.append(np.minimum(node[link], node[k]))
                found_b.append(np.maximum(node[link], node[k]))
        return pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    whole = nodes.select("node", "sig").join(sets, "node")
    cut = inner.unionByName(outer).join(whole, "node")
    return cut.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def bucket_members(nodes: DataFrame) -> DataFrame:
    """bucket, band, node, n_shingles, leader, n of the nodes in buckets of two or more (each band's bucket of a node is one row)."""
    rows = salted(in_buckets(nodes), "node")
    # counts by salt are summed per bucket and go back by salt, so that no task meets a whole bucket
    by_salt = rows.groupBy("bucket", "salt").agg(F.min("node").alias("least"), F.count("*").alias("k"))
    shared = by_salt.groupBy("bucket").agg(F.min("least").alias("leader"), F.sum("k").alias("n")).where("n > 1")
    placed = by_salt.select("bucket", "salt").join(shared, "bucket")
    return rows.join(placed, ["bucket", "salt"]).join(nodes.select("node", "n_shingles"), "node").select("bucket", "band", "node", "n_shingles", "leader", "n")


def placed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, digest, comp (a number for each component; null without a set or an id), component_id."""
    bounded_batches(docs.sparkSession)
    signed = written(signed_documents(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signed")
    linkable = signed.where("digest is not null and doc_id is not null")
    classes = written(linkable.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("row").alias("node")), "classes")
    nodes = written(linkable.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node").drop("digest"), "nodes")
    members = written(bucket_members(nodes), "members")
    pairs = passing(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes)
    links = written(confirmed(written(pairs, "survivors"), nodes, docs, id_col, text_col), "links")
    labels = components(links)
    for turn in range(1, STAR_ROUNDS + 1):
        # all members have met their leader; a bucket is open while the others lie in several components
        held = written(labelled(members.where("n > 2").select("bucket", "band", "node", "n_shingles", "leader"), labels), "held")
        spread = held.where("node <> leader").groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        held = written(looked_up(held, "bucket", "node", spread.select("bucket")), "open")
        size, in_main = main_components(held).agg(F.sum("size"), F.sum("in_main")).first()
        if not size:
            break
        if turn == STAR_ROUNDS or 2 * in_main >= size:
            more = block_links(held.drop("leader"), nodes, docs, id_col, text_col)
            links = links.unionAll(written(more, "links"))
            labels = components(links)
            break
        # another leader: from outside the first leader's component, by a hash that changes with the round
        heads = held.where("node = leader").select("bucket", F.col("comp").alias("led"))
        rest = looked_up(held, "bucket", "node", heads).where("comp <> led")
        chosen = rest.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node"), F.col("comp"))).alias("x"))
        chosen = chosen.select("bucket", F.col("x.node").alias("a"), F.col("x.comp").alias("to_comp"))
        ends = looked_up(held, "bucket", "node", chosen).where("comp <> to_comp")
        pairs = passing(ends.select("a", F.col("node").alias("b")).distinct(), nodes)
        links = links.unionAll(written(confirmed(written(pairs, "survivors"), nodes, docs, id_col, text_col), "links"))
        labels = components(links)
    found = written(labelled(classes, labels), "found")
    firsts = found.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = looked_up(found.select("digest", "comp"), "comp", "digest", firsts).select("digest", "comp", "component_id")
    rows = signed.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"), "row")
    held = looked_up(rows.where("digest is not null"), "digest", "row", of_class).select("doc_id", "text_hash", "n_shingles", "digest", "comp", "component_id")
    alone = rows.where("digest is null").select("doc_id", "text_hash", "n_shingles", "digest", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return held.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least id reachable), kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return placed_rows(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id and, of several texts with that id, of the least hash."""
    rows = written(placed_rows(docs, id_col, text_col).select("doc_id", "text_hash", "comp", "component_id"), "placed")
    heads = rows.where("comp is not null and doc_id = component_id")
    several = heads.groupBy("comp").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most")
    others = heads.join(several.select("comp", "least"), "comp").where("text_hash <> least")
    gone = rows.where("doc_id <> component_id").select("doc_id", "text_hash").unionAll(others.select("doc_id", "text_hash"))
    gone = written(gone.distinct(), "gone")
    repeats = rows.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    return one_of_repeats(without(docs, gone, id_col, text_col), repeats, id_col, text_col)
