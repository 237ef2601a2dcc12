"""k-means with Yinyang filters, in whole numbers.

Centroids are put into groups once. Every vector carries its cluster, an upper
bound of its distance to that centroid and one lower bound per group of its
distance to the group's other centroids. When centroids have moved, bounds move
along by the distance they went. A vector whose lower bounds all exceed its upper
bound keeps its cluster (global filter; tried once more after the upper bound is
made exact); else only groups whose bound does not exceed it are looked at (group
filter), and their centroids are scanned exactly. Bounds are compared with slack
for rounding, so centroids that tie or nearly tie are always scanned and compared
in whole numbers: results are those of the plain method, bit by bit.

A round is one task per part of the vectors, without a shuffle of them: it reads
vectors with their bounds from a table in the shared folder and writes the next
one, with a row of sums for each task. Only sums are shuffled, and the driver holds
k centroids. Lost executors cost the tasks they ran.

Defined results: vectors that are null, of another length than `dims` or with null
or non-finite components take no part. Centroids start as the k vectors with the
smallest hashes of seed and id, ties by components, null ids last; with fewer
vectors there are fewer centroids. Repeated rows each take part, equal vectors meet
in the smaller of equal centroids, and a centroid without vectors stays where it
is. A component beyond 65,536 after scaling by 1,024 (2^26) is refused: distances
would not be exact in 64 bits. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import trimmed, written

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Centroids for each group, and rounds that find the groups.
IN_GROUP, GROUP_ROUNDS = 4, 5
#: Greatest size of a scaled component, and up to which products in doubles are exact.
LARGEST, EXACT = 1 << 26, 1 << 22
#: Bounds are compared with this part of slack; doubles are exact to about 1e-15 of it.
SLACK = 1e-9


@dataclass
class Clusters:
    rows: DataFrame  # id, cluster, distance
    centroids: list[list[int]]
    scans: list[int] = field(default_factory=list)  # distances computed in each pass


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of rows of x to rows of c, both int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:  # all sums stay below 2^53
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def grouped(c: np.ndarray) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means among the centroids."""
    n = -(-len(c) // IN_GROUP)
    heads = c[:n].astype(np.float64)
    for _ in range(GROUP_ROUNDS):
        of = ((c[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        heads = np.stack([c[of == g].mean(axis=0) if (of == g).any() else heads[g] for g in range(n)])
    return np.unique(of, return_inverse=True)[1]


def first_pass(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower, distances computed: everything is scanned."""
    d = squared(x, c)
    at = d.argmin(axis=1)
    far = np.sqrt(d.astype(np.float64))
    upper = far[np.arange(len(x)), at].copy()
    far[np.arange(len(x)), at] = np.inf
    lower = np.stack([far[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)
    return at, upper, lower, d.size


def next_pass(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, moved: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids moved to c, by these distances; only what the filters leave is scanned."""
    at, groups = at.copy(), range(group.max() + 1)
    upper = upper + moved[at]
    lower = np.maximum(0, lower - np.array([moved[group == g].max() for g in groups]))
    clear = lambda low, up: low * (1 - SLACK) > up * (1 + SLACK)
    rows = np.flatnonzero(~clear(lower.min(axis=1), upper))
    n = len(rows)
    near = np.empty(n, dtype=np.int64)  # the exact distance to the own centroid
    for j in np.unique(at[rows]):
        mine = at[rows] == j
        near[mine] = squared(x[rows[mine]], c[j : j + 1])[:, 0]
    upper[rows] = np.sqrt(near.astype(np.float64))
    left = ~clear(lower[rows].min(axis=1), upper[rows])
    rows, near = rows[left], near[left]
    own, best, best_at, found = at[rows], near.copy(), at[rows].copy(), {}
    own_upper = upper[rows]
    for g in groups:
        into = np.flatnonzero(~clear(lower[rows, g], own_upper))
        if not len(into):
            continue
        members = np.flatnonzero(group == g)
        d = squared(x[rows[into]], c[members])
        n += d.size - int(np.isin(own[into], members).sum())  # the own centroid's was known
        least = d.argmin(axis=1)
        value, place = d[np.arange(len(into)), least], members[least]
        better = (value < best[into]) | ((value == best[into]) & (place < best_at[into]))
        best[into[better]], best_at[into[better]] = value[better], place[better]
        found[g] = into, members, d
    for g, (into, members, d) in found.items():
        others = np.where(members[None, :] == best_at[into][:, None], np.inf, np.sqrt(d.astype(np.float64)))
        lower[rows[into], g] = others.min(axis=1)
    gone = np.flatnonzero(best_at != own)  # the centroid left behind is now one of its group's others
    home = group[own[gone]]
    lower[rows[gone], home] = np.minimum(lower[rows[gone], home], np.sqrt(near[gone].astype(np.float64)))
    at[rows], upper[rows] = best_at, np.sqrt(best.astype(np.float64))
    return at, upper, lower, n


def whole_numbers(rows: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """id, vec (array<bigint>) of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = rows.select(F.col(id_col).alias("id"), vec.alias("vec")).where((F.size("vec") == dims) & ~bad)
    return held.select("id", F.transform("vec", lambda x: F.floor(x * scale)).alias("vec"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r["vec"]) for r in vectors.orderBy(order.asc_nulls_last(), "vec").limit(k).collect()]


def numbers(part: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(part.column(part.schema.get_field_index(name)))


def lists(part: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of lists of one length (without nulls) as a matrix."""
    return np.asarray(part.column(part.schema.get_field_index(name)).flatten()).reshape(part.num_rows, -1)


def row_lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def assigned(rows: DataFrame, c: np.ndarray, moved: np.ndarray | None, group: np.ndarray, name: str) -> tuple[DataFrame, list[int], list[list[int]], int]:
    """One pass, stored: id, vec, cluster, upper, lower, distance; and the counts and sums of all clusters and the distances computed."""
    k, dims = c.shape
    kind = rows.schema["id"].dataType.simpleString()
    arrow = ["id", "vec", "cluster", "upper", "lower", "distance", "sums", "summary"]

    @trimmed
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scans, none = np.zeros((k, dims + 1), dtype=np.int64), 0, None
        for part in parts:
            if not part.num_rows:
                continue
            x = lists(part, "vec").astype(np.int64)
            if (np.abs(x) > LARGEST).any():
                raise ValueError(f"a scaled component is beyond {LARGEST}")
            if moved is None:
                at, upper, lower, n = first_pass(x, c, group)
            else:
                at, upper, lower, n = next_pass(x, numbers(part, "cluster"), numbers(part, "upper"), lists(part, "lower"), c, moved, group)
            scans += n
            distance = ((x - c[at]) ** 2).sum(axis=1)
            for j in np.unique(at):
                sums[j] += [int((at == j).sum()), *x[at == j].sum(axis=0)]
            none = part.column(0).type
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), row_lists(x, pa.int32()), pa.array(at, pa.int32()), pa.array(upper), row_lists(lower, pa.float64()), pa.array(distance),
                    pa.nulls(len(x), pa.list_(pa.int64())), pa.array(np.zeros(len(x), dtype=bool)),
                ], arrow,
            )
        if none is not None:
            empty = [pa.nulls(1, t) for t in (none, pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([[*sums.ravel().tolist(), scans]], pa.list_(pa.int64())), pa.array([True])], arrow)

    schema = f"id {kind}, vec array<int>, cluster int, upper double, lower array<double>, distance long, sums array<bigint>, summary boolean"
    out = written(rows.mapInArrow(run, schema), name, "summary")
    added = out.where("summary").select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    flat = dict.fromkeys(range(k * (dims + 1) + 1), 0) | {r["at"]: int(r["value"]) for r in added.collect()}  # k (dims + 1) + 1 numbers
    table = [[flat[j * (dims + 1) + i] for i in range(dims + 1)] for j in range(k)]
    return out.where("not summary").drop("sums", "summary"), [t[0] for t in table], [t[1:] for t in table], flat[k * (dims + 1)]


def clustered(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> Clusters:
    """The clusters after `rounds` rounds of assignment and update and one more assignment."""
    vectors = whole_numbers(rows, id_col, vec_col, dims, scale)
    c = np.array(first_centroids(vectors, k, seed), dtype=np.int64).reshape(-1, dims)
    if not len(c):
        return Clusters(vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), [])
    group, moved, scans = grouped(c), None, []
    for at in range(rounds + 1):
        vectors, counts, sums, n = assigned(vectors, c, moved, group, f"centroids-{at}")
        scans.append(n)
        if at < rounds:
            after = np.array([[s // counts[j] for s in sums[j]] if counts[j] else c[j].tolist() for j in range(len(c))], dtype=np.int64)
            moved, c = np.sqrt(((after - c) ** 2).sum(axis=1).astype(np.float64)), after
    return Clusters(vectors.select("id", "cluster", "distance"), c.tolist(), scans)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def report(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector; what is joined has k rows."""
    whole: Column = F.sum("distance").cast("long")
    each = found.rows.groupBy("cluster").agg(whole.alias("cluster_inertia"))
    total = found.rows.agg(whole.alias("inertia"))
    names = found.rows.sparkSession.createDataFrame([(j, digest(x)) for j, x in enumerate(found.centroids)], "cluster int, centroid_sha256 string")
    figures = each.join(F.broadcast(names), "cluster").crossJoin(total)  # one total
    return found.rows.join(F.broadcast(figures), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
