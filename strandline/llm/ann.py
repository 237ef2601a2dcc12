"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits its vectors at the median
of their projections on the difference of two of them. Every row is then
indexed in one leaf of each tree; its vector is stored once, beside the list of
its leaves. A query walks all trees at once through one priority queue, ordered
by the squared distance that it would have to cross the planes by, until the
leaves it has reached hold a set share of the distinct rows (told from the
sample). Leaf members are reranked by their exact cosine in double precision.

Neighbouring leaves are taken together in groups of about `BLOCK` rows, larger
leaves are cut in blocks of that size, and so are a group's queries: a leaf that
holds a third of all rows is many small matrix products. Only each block's best
k ids per query leave it. The work of a query grows with the share it searches,
which is set for vectors that have next to no structure: a row that
several trees lead to is scored in the first of them only, so a query takes
that share of all rows in products.

Defined results: vectors that are null, zero, of another length than most or
with null or non-finite components take no part, as rows and as queries. Rows
without an id take no part. Rows that repeat an id and its vector count once. Of
rows that repeat an id alone each is a candidate, and the id is listed once, with
its best score, in one of the k places. A query with fewer candidates than k gets
all that it reaches. Copies of a vector under several ids score alike, and the
smaller ids come first. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import written

#: Rows that the trees are fitted on, trees, sampled rows in a leaf, share of all rows that a query's leaves hold together.
SAMPLE, TREES, LEAF, SHARE = 20_000, 2, 24, 0.8
#: Rows and most queries of a block.
BLOCK, QUERY_BLOCK = 2048, 1024
#: Values of the hash that chooses the sample, and how many more rows than wanted it lets through.
HASHES, SPARE = 1 << 40, 1.3
#: Scores closer than this are computed once more, in an order that is the same for equal vectors.
NEAR = 1e-9
SEED = 5


@dataclass
class Forest:
    planes: np.ndarray  # of each inner node
    cuts: np.ndarray
    left: np.ndarray  # child of each inner node; ~leaf if it is a leaf
    right: np.ndarray
    roots: np.ndarray  # like a child
    members: np.ndarray  # sampled rows, leaf by leaf, tree by tree ...
    starts: np.ndarray  # ... and where each leaf's begin, with the end
    rows: int  # of the sample

    @property
    def leaves(self) -> int:
        return len(self.starts) - 1

    def route(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each vector in one tree."""
        at = np.full(len(x), self.roots[tree])
        while len(on := np.flatnonzero(at >= 0)):
            node = at[on]
            right = np.einsum("ij,ij->i", x[on], self.planes[node]) > self.cuts[node]
            at[on] = np.where(right, self.right[node], self.left[node])
        return ~at

    def search(self, x: np.ndarray, share: float) -> list[int]:
        """Leaves of all trees, nearest first, until they hold that share of the sampled rows."""
        margin = (self.planes @ x - self.cuts).tolist()
        left, right, starts = self.left, self.right, self.starts
        queue, found, held, seen = [(0.0, int(r)) for r in self.roots], [], 0, np.zeros(self.rows, bool)
        heapq.heapify(queue)
        while queue and held < share * self.rows:
            far, node = heapq.heappop(queue)
            if node < 0:
                found.append(~node)
                own = self.members[starts[~node] : starts[~node + 1]]
                held += len(own) - int(np.count_nonzero(seen[own]))
                seen[own] = True
            else:
                m = margin[node]
                heapq.heappush(queue, (far if m > 0 else far + m * m, int(right[node])))
                heapq.heappush(queue, (far + m * m if m > 0 else far, int(left[node])))
        return found


def grown(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """A forest over the unit vectors x."""
    rng = np.random.default_rng(seed)
    planes, cuts, left, right, leaves = [], [], [], [], []

    def grow(members: np.ndarray) -> int:
        if len(members) > leaf:
            a, b = x[rng.choice(members, 2, replace=False)]
            plane = a - b if (a != b).any() else rng.normal(size=x.shape[1])
            plane = plane / np.linalg.norm(plane)
            along = x[members] @ plane
            cut = float(np.median(along))
            over = along > cut
            if over.any() and not over.all():
                at = len(planes)
                planes.append(plane)
                cuts.append(cut)
                left.append(0)
                right.append(0)
                left[at], right[at] = grow(members[~over]), grow(members[over])
                return at
        leaves.append(members)
        return -len(leaves)

    roots = [grow(np.arange(len(x))) for _ in range(trees)]
    starts = np.concatenate([[0], np.cumsum(list(map(len, leaves)))])
    nodes = (np.array(planes).reshape(-1, x.shape[1]), np.array(cuts), np.array(left, np.int64), np.array(right, np.int64))
    return Forest(*nodes, np.array(roots, np.int64), np.concatenate(leaves), starts, len(x))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (floats stay floats, all else is double) of rows that take part, of any length."""
    vec = F.col(vec_col) if dict(rows.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & sound & F.exists("vec", lambda x: x != 0))


def sampled(valid: DataFrame, most: int) -> pd.DataFrame:
    """At most so many rows, those of the least hashes; the hash alone thins out a large table first."""
    n = valid.count()
    hashed = valid.withColumn("hash", F.pmod(F.xxhash64("id", "vec"), F.lit(HASHES)))
    few = hashed.where(F.col("hash") < int(min(1.0, SPARE * most / max(n, 1)) * HASHES))
    return few.orderBy("hash", "id").limit(most).toPandas()


def groups_of(forest: Forest, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each leaf (leaves are numbered along each tree), and the blocks that a group is cut in."""
    group, blocks, held = np.zeros(forest.leaves, np.int64), [], np.inf
    for leaf, n in enumerate(sizes):
        if held + n > BLOCK:
            blocks.append(1)
            held = 0
        group[leaf], held = len(blocks) - 1, held + n
        blocks[-1] = max(1, int(np.ceil(held / BLOCK)))
    return group, np.array(blocks, np.int64)


def best_of_block(ids: np.ndarray, x: np.ndarray, tree: np.ndarray, leaves: np.ndarray, query_ids: np.ndarray, q: np.ndarray, visited: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, id, score: the k best ids of each query among the rows that this block's trees are the first to lead it to.

    tree: the one that put a row in this block; leaves: rows x trees; visited: queries x leaves.
    """
    leaf = leaves[np.arange(len(ids)), tree]
    order = np.argsort(leaf, kind="stable")
    ids, x, tree, leaf, leaves = ids[order], x[order], tree[order], leaf[order], leaves[order]
    names, starts = np.unique(leaf, return_index=True)
    size, length = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    score = np.full((len(q), len(x)), -2.0)
    for j, (a, b) in enumerate(zip(starts, [*starts[1:], len(x)], strict=True)):
        asking = np.flatnonzero(visited[:, names[j]])
        if not tree[a]:
            score[asking, a:b] = q[asking] @ x[a:b].T / (length[asking, None] * size[a:b])
            continue
        met = visited[asking[:, None, None], leaves[None, a:b, : tree[a]]].any(axis=2)
        i, row = np.nonzero(~met)
        i, row = asking[i], row + a
        score[i, row] = np.einsum("ij,ij->i", q[i], x[row]) / (length[i] * size[row])
    firsts, of_id = np.unique(ids, return_inverse=True)
    repeats = len(firsts) < len(ids)
    out = []
    for i, query in enumerate(query_ids):
        own = np.where(ids == query, -2.0, score[i])
        best = own
        if repeats:  # an id takes one place, by its best row
            best = np.full(len(firsts), -2.0)
            np.maximum.at(best, of_id, own)
        least = np.partition(best, len(best) - k)[len(best) - k] if len(best) > k else -1.5
        top = np.flatnonzero(own >= max(least, -1.5) - NEAR)
        exact = (x[top] * q[i]).sum(axis=1) / (size[top] * length[i])
        order = np.lexsort((-exact, ids[top]))
        top, exact = top[order], exact[order]
        first = np.concatenate([[True], ids[top][1:] != ids[top][:-1]])[: len(top)]
        top, exact = top[first], exact[first]
        order = np.lexsort((ids[top], -exact))[:k]
        out.append((np.repeat(query, len(order)), ids[top][order], exact[order]))
    return pd.DataFrame(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def nearest(
    rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, trees: int = TREES,
    leaf: int = LEAF, share: float = SHARE,
) -> DataFrame:
    """query_id, rank, id, score: the k nearest found of each row that satisfies `queries` (over the column id)."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[id_col]
    valid = valid_vectors(rows, id_col, vec_col)
    taken = sampled(valid, sample)
    if taken.empty:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    width = int(taken["vec"].map(len).mode()[0])
    forest = grown(unit(np.array([v for v in taken["vec"] if len(v) == width], float)), trees, leaf)
    held = spark.sparkContext.broadcast(vars(forest))
    raw = "<f4" if dict(valid.dtypes)["vec"] == "array<float>" else "<f8"

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_ = Forest(**held.value)
        for part in parts:
            x = np.array(part["vec"].tolist(), float).reshape(-1, width)
            u = unit(x)
            leaves = np.stack([trees_.route(u, t) for t in range(len(trees_.roots))], axis=1)
            yield pd.DataFrame({"id": part["id"], "leaves": list(leaves), "vec": [r.tobytes() for r in x.astype(raw)]})

    whole = valid.where(F.size("vec") == width).dropDuplicates(["id", "vec"])
    indexed = written(whole.mapInPandas(index, f"id {kind}, leaves array<int>, vec binary"), "index")
    counted = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).toPandas()  # a row per leaf of the bounded forest
    sizes = np.zeros(forest.leaves)
    sizes[counted["leaf"].to_numpy(int)] = counted["n"].to_numpy(float)
    group, blocks = groups_of(forest, sizes)
    placed = spark.sparkContext.broadcast(group)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees_, group_ = Forest(**held.value), placed.value
        for part in parts:
            for q, v in zip(part["id"], part["vec"], strict=True):
                x = np.frombuffer(v, raw).astype(float)
                found, visited = trees_.search(x / np.linalg.norm(x), share), np.zeros(trees_.leaves, bool)
                visited[found] = True
                names = np.unique(group_[found])
                yield pd.DataFrame({"grp": names, "query_id": q, "query": [v] * len(names), "visited": [np.packbits(visited).tobytes()] * len(names)})

    asked = written(indexed.where(queries).select("id", "vec").mapInPandas(walk, f"grp int, query_id {kind}, query binary, visited binary"), "asked")
    cuts = asked.groupBy("grp").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    of_group = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "grp int, blocks int")
    cuts = cuts.join(F.broadcast(of_group), "grp")  # a row per group of the bounded forest's leaves, as is the next
    of_leaf = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "leaf int, grp int").join(cuts, "grp")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    ours = indexed.select("id", "vec", "leaves", F.posexplode("leaves").alias("tree", "leaf")).join(F.broadcast(of_leaf), "leaf")
    ours = ours.select("grp", place(("id", "vec"), "blocks").alias("block"), each("parts").alias("part"), "id", "vec", "tree", "leaves")
    theirs = asked.join(F.broadcast(cuts), "grp").select("grp", each("blocks").alias("block"), place(("query_id", "query"), "parts").alias("part"), "query_id", "query", "visited")

    def rerank(key, block: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(part):
            return pd.DataFrame({"query_id": part["query_id"].iloc[:0], "id": block["id"].iloc[:0], "score": np.empty(0)})
        x, q = (np.frombuffer(b"".join(c), raw).astype(float).reshape(-1, width) for c in (block["vec"], part["query"]))
        leaves, visited = np.array(block["leaves"].tolist()), np.frombuffer(b"".join(part["visited"]), np.uint8).reshape(len(q), -1)
        return best_of_block(block["id"].to_numpy(), x, block["tree"].to_numpy(), leaves, part["query_id"].to_numpy(), q, np.unpackbits(visited, axis=1).astype(bool), k)

    keys = ["grp", "block", "part"]
    found = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(rerank, f"query_id {kind}, id {kind}, score double")
    # the same pair comes from several trees: once more by its best score, then by rank
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")
