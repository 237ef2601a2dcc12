"""Secrets in texts: three fixed forms, and random strings told by their token efficiency.

The base finds assignments to a name such as password or token, access keys and
long runs of lower-case hex digits; each kind leftmost first, without overlaps
among its own.

The method adds strings that no form describes. A byte-pair vocabulary has
merges for what occurs in texts, so words of any language take a token for
several characters, and random characters little more than one each: a run of
RUN or more characters of base64 and its kin whose characters per token are at
most EFFICIENCY is reported as random. Runs longer than BLOCK are encoded in
blocks of that size, as merges of a long run take time that grows with its
square; their tokens are added. Not reported: what lies within a base span, hex
digests of the usual lengths, integrity values, content and object identifiers
(UUID, ULID, multihash), and runs without a letter (numbers, dates, rulers).

One pass over the texts in Arrow batches, without a shuffle; rows come out as they
are. Positions are code points, ends are exclusive. Null and empty texts have no
spans. Repeated rows each have theirs; ties at a start go by kind, then end. Texts
and runs may be of any length. An empty table gives an empty result. Of the other
columns none is read, and the results' names are the ones below only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import bounded_batches, trimmed

#: Rank file of a public byte-level vocabulary for many languages, under 1 MB.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits a text before merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Least length of a run that is tested, characters per token that it may have at most, characters encoded at once.
RUN, EFFICIENCY, BLOCK = 20, 2.0, 512
#: In the order of spans that start together.
KINDS = ("assign", "access", "hex", "random")

SCHEMA = "doc_id {kind}, spans array<struct<kind:string,start:long,end:long,efficiency:double>>"

#: Fixed forms of the base: pattern, group that is measured, its least length.
BASE = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a shorter run holds no longer one
}
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN},}}")
#: Whole runs that are known digests and identifiers; hex lengths are those of MD5, SHA-1 and the SHA-2 family.
KNOWN = re.compile(
    r"""(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128}
    |sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}
    |[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}
    |[0-7][0-9A-HJKMNP-TV-Z]{25}
    |Qm[1-9A-HJ-NP-Za-km-z]{44}|b[a-z2-7]{58}
    |[^A-Za-z]*)""",
    re.VERBOSE,
)


class Efficiency:
    """Characters per token of a run under a vocabulary given as a rank file's bytes."""

    def __init__(self, ranks: bytes) -> None:
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, run: str) -> float:
        return len(run) / sum(len(self.encoding.encode_ordinary(run[i : i + BLOCK])) for i in range(0, len(run), BLOCK))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the fixed forms, kind by kind."""
    return [(kind, *m.span()) for kind, (form, group, least) in BASE.items() for m in form.finditer(text) if m.end(group) - m.start(group) >= least]


def spans_of(text: str, efficiency: Efficiency, most: float = EFFICIENCY) -> list[tuple[str, int, int, float | None]]:
    """kind, start, end, efficiency (of random strings) in order."""
    base = base_spans(text)
    found: list[tuple[str, int, int, float | None]] = [(*x, None) for x in base]
    covered = sorted((a, b) for _, a, b in base)
    reach, at = 0, 0  # the furthest end of the base spans that start no later than the run
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][0] <= a:
            reach, at = max(reach, covered[at][1]), at + 1
        if b > reach and not KNOWN.fullmatch(m[0]) and (r := efficiency(m[0])) <= most:
            found.append(("random", a, b, r))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, most: float = EFFICIENCY) -> DataFrame:
    """doc_id, spans (kind, start, end, efficiency) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(ranks, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    @trimmed
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = Efficiency(held.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("efficiency", pa.float64())]))
        for part in parts:
            spans = [[dict(zip(("kind", "start", "end", "efficiency"), x, strict=True)) for x in spans_of(t, efficiency, most)] if t else [] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, SCHEMA.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def written_spans(spans: Column, *kinds: str) -> Column:
    """The spans of these kinds as kind:start:end, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.filter(spans, lambda x: x["kind"].isin(*kinds)), one), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of scanned rows."""
    spans = F.col("spans")
    counts = [n_of(spans, kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(written_spans(spans, *KINDS[:3]), 256).alias("base_sha256"), written_spans(spans, *KINDS).alias("spans"))


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with a mark in place of each stretch that spans cover; overlapping spans share one."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    length = lambda a, b: F.greatest(F.lit(0), b - a).cast("int")

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        between = F.when(fresh, text.substr((s["at"] + 1).cast("int"), length(s["at"], x["start"]))).otherwise("")
        begun = F.when(fresh, F.lit(mark)).otherwise("")
        return F.struct(F.concat(s["out"], between, begun).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    end = F.aggregate(spans, state, step)
    return F.concat(end["out"], text.substr((end["at"] + 1).cast("int"), length(end["at"], F.char_length(text).cast("long"))))
