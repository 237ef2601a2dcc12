"""Document quality from a linear-chain conditional random field over lines.

Each line has features of its own characters and those of the lines before and
after it. A chain of two states, bad and good, scores the lines together;
forward-backward gives each line's marginal, and the marginals, weighted by
the lines' lengths, give the document's share of good text. A logistic curve
fitted on the training documents turns that share into a score.

Labels mark documents, so training goes round: at first every line has its
document's label; then lines of bad documents that the chain itself finds
good are taken for good ones, and the chain is fitted again.

The fit uses a sample of labelled documents, chosen by a hash of their ids, of
at most `SAMPLE` documents; scoring covers every line of every document.

Defined results: a null or empty text is one empty line. Where an id has
several labels the least counts. Rows without an id are scored too. Repeated
rows get equal scores. Without training labels every score is 0.5, and
`good_documents`, which then can't tell, keeps all rows. Texts may be of any
length: a text's lines are one chain. Of documents only the id and the text are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import bounded_batches, trimmed

#: Labelled documents used to fit the chain; their lines' features reach the driver (under 100 bytes a line).
SAMPLE = 4000
ROUNDS, STEPS, RATE, RIDGE = 2, 80, 0.15, 1e-3
#: Characters that are handled at a time.
TOGETHER = 1_000_000
#: Score from which a document counts as good.
THRESHOLD = 0.7

LOWER, UPPER, DIGIT, BLANK, STOP, SHOUT, BAR, MARK, END = range(9)
KINDS = np.full(256, MARK, np.uint8)
KINDS[ord("a") : ord("z") + 1] = LOWER
KINDS[128:] = LOWER
KINDS[ord("A") : ord("Z") + 1] = UPPER
KINDS[ord("0") : ord("9") + 1] = DIGIT
KINDS[[9, 11, 12, 13, 32]] = BLANK
KINDS[[ord(c) for c in ".,;:?'\"-()"]] = STOP
KINDS[ord("!")], KINDS[ord("|")], KINDS[10] = SHOUT, BAR, END
#: Features of one line.
OWN = 15


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, the lines' lengths, and the number of lines of each text."""
    counts = np.array([t.count("\n") + 1 for t in texts])
    raw = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass")
    kinds = KINDS[np.frombuffer(raw, np.uint8)]
    ends = np.flatnonzero(kinds == END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = lambda x: np.add.reduceat(x.astype(np.int32), starts)
    size = ends - starts
    by_kind = [total(kinds == k) for k in range(END)]
    blank = np.concatenate([[True], (kinds[:-1] == BLANK) | (kinds[:-1] == END)])
    words = total(blank & (kinds != BLANK) & (kinds != END))
    mark = (kinds == MARK) | (kinds == SHOUT)
    runs = total(mark & np.concatenate([[False], mark[:-1]]))
    last = kinds[np.maximum(ends - 1, starts)]
    seen: set[bytes] = set()
    again, same, fresh = np.zeros((3, len(ends)))
    lines, at = raw.split(b"\n"), 0
    for n in counts:
        seen.clear()
        for i in range(at, at + n):
            if lines[i] in seen:
                again[i] = 1
            else:
                seen.add(lines[i])
            found = lines[i].split()
            if len(found) > 1:
                same[i] = sum(map(eq, found, islice(found, 1, None))) / len(found)
                fresh[i] = len(set(found)) / len(found)
        at += n
    share = lambda x: x / np.maximum(size, 1)
    own = np.stack(
        [
            np.log1p(size), np.log1p(words), size / np.maximum(words, 1) / 10, share(by_kind[UPPER]), share(by_kind[DIGIT]), share(by_kind[STOP]),
            share(by_kind[SHOUT]), share(by_kind[BAR]), share(by_kind[MARK]), share(runs), last == STOP, size == 0, again, same, fresh,
        ],
        axis=1,
    ).astype(np.float32)
    return own, size, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The line's features, those of the lines before and after it, and whether there are none."""
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    lasts = firsts + counts - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[firsts], after[lasts] = 0, 0
    edge = np.zeros((len(own), 3), np.float32)
    edge[firsts, 0], edge[lasts, 1], edge[:, 2] = 1, 1, 1
    return np.concatenate([own, before, after, edge], axis=1)


def marginals(score: np.ndarray, turn: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state) of each line and the expected number of each change of state in all chains.

    score: lines x 2; turn: log weights of (state, next state). Chains run
    side by side, longest first, one position at a time.
    """
    order = np.argsort(-counts, kind="stable")
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    sizes, longest = counts[order], int(counts.max())
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than the position
    norm = lambda x: x - np.logaddexp(x[:, :1], x[:, 1:])
    forward, back, pairs = np.empty_like(score), np.zeros_like(score), np.zeros((2, 2))
    forward[firsts] = norm(score[firsts])
    for t in range(1, longest):
        at = firsts[: active[t]] + t
        was = forward[at - 1]
        forward[at] = norm(score[at] + np.logaddexp(was[:, :1] + turn[0], was[:, 1:] + turn[1]))
    for t in range(longest - 2, -1, -1):
        at = firsts[: active[t + 1]] + t
        next_ = score[at + 1] + back[at + 1]
        both = forward[at][:, :, None] + turn + next_[:, None, :]
        back[at] = norm(np.logaddexp(turn[:, 0] + next_[:, :1], turn[:, 1] + next_[:, 1:]))
        flat = both.reshape(len(at), 4)
        flat = np.exp(flat - flat.max(axis=1, keepdims=True))
        pairs += (flat / flat.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)
    post = forward + back
    return np.exp(post - np.logaddexp(post[:, :1], post[:, 1:])), pairs


def good_share(p_good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marginals averaged over each document, weighted by length; as log odds, held within +-8."""
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    weight = size + 1.0
    share = np.add.reduceat(p_good * weight, firsts) / np.add.reduceat(weight, firsts)
    share = np.clip(share, 3e-4, 1 - 3e-4)
    return np.log(share / (1 - share))


class Chain:
    """Weights of the field and of the curve on top of it."""

    def __init__(self, mean, scale, weights, turn, slope=1.0, shift=0.0):
        self.mean, self.scale, self.weights, self.turn, self.slope, self.shift = mean, scale, weights, turn, slope, shift

    def states(self, x: np.ndarray) -> np.ndarray:
        good = ((x - self.mean) / self.scale) @ self.weights
        return np.stack([np.zeros(len(good)), good], axis=1)

    def lines(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        return marginals(self.states(with_neighbours(own, counts)), self.turn, counts)[0][:, 1]

    def score(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * odds + self.shift)))


def fitted(own: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Chain:
    x = with_neighbours(own, counts).astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    chain = Chain(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)))
    of_doc = np.repeat(labels, counts)
    state = of_doc.astype(float)
    same = np.concatenate([np.repeat(np.arange(len(counts)), counts)[1:] == np.repeat(np.arange(len(counts)), counts)[:-1], [False]])
    weight_sq, turn_sq = np.full(x.shape[1], 1e-8), np.full((2, 2), 1e-8)
    for turn in range(ROUNDS):
        seen = np.zeros((2, 2))
        now, then = state[:-1][same[:-1]].astype(int), state[1:][same[:-1]].astype(int)
        np.add.at(seen, (now, then), 1)
        for _ in range(STEPS):
            p, pairs = marginals(chain.states(x), chain.turn, counts)
            up = z.T @ (state - p[:, 1]) / len(z) - RIDGE * chain.weights
            change = (seen - pairs) / len(z) - RIDGE * chain.turn
            weight_sq += up * up
            turn_sq += change * change
            chain.weights = chain.weights + RATE * up / np.sqrt(weight_sq)
            chain.turn = chain.turn + RATE * change / np.sqrt(turn_sq)
        if turn + 1 < ROUNDS:
            p = marginals(chain.states(x), chain.turn, counts)[0][:, 1]
            state = np.where((of_doc == 0) & (p < 0.5), 0.0, 1.0)
    odds = good_share(marginals(chain.states(x), chain.turn, counts)[0][:, 1], size, counts)
    a = np.stack([odds, np.ones(len(odds))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps of a slightly ridged logistic fit
        p = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(2), a.T @ (labels - p) - 0.5 * (w - [1.0, 0.0]))
    chain.slope, chain.shift = w
    return chain


def learned(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str, sample: int) -> Chain | None:
    """The chain fitted on a bounded sample of labelled documents that aren't held out (held_out: over the id)."""
    bounded_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    marked = marked.where(~held_out).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @trimmed
    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc_id, label, text in zip(part["doc_id"], part["label"], part["text"], strict=True):
                own, size, _ = line_features([text])
                yield pd.DataFrame({"doc_id": [doc_id], "label": [label], "own": [own.tobytes()], "size": [size.astype(np.int64).tobytes()]})

    kind = dict(docs.dtypes)[id_col]
    # at most `sample` ids are broadcast
    rows = texts.join(F.broadcast(marked), "doc_id").mapInPandas(features, f"doc_id {kind}, label int, own binary, size binary").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values("doc_id", kind="stable")
    own = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, OWN) for x in rows["own"]])
    size = [np.frombuffer(x, np.int64) for x in rows["size"]]
    return fitted(own, np.concatenate(size), np.array([len(x) for x in size]), (rows["label"].to_numpy() > 0).astype(int))


def scored(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, line_scores: bool = False,
) -> DataFrame:
    """doc_id, score, predicted per row; with line_scores also each line's P(good) as an array.

    held_out is a condition on the column doc_id: labels of such ids are never read.
    """
    chain = learned(docs, labels, held_out, id_col, text_col, label_col, sample)
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, score double, predicted int" + ", lines array<double>" * line_scores

    @trimmed
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            edges = np.cumsum(part["_text"].str.len().to_numpy()) // TOGETHER
            for _, some in part.groupby(edges, sort=False):
                texts = some["_text"].tolist()
                own, size, counts = line_features(texts)
                p = chain.lines(own, counts) if chain else np.full(len(own), 0.5)
                value = chain.score(good_share(p, size, counts)) if chain else np.full(len(texts), 0.5)
                out = pd.DataFrame({"doc_id": some["_id"].to_numpy(), "score": value, "predicted": (value >= THRESHOLD).astype(int)})
                if line_scores:
                    out["lines"] = np.split(p, np.cumsum(counts)[:-1])
                yield out

    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInPandas(score, schema)


def good_documents(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all their columns kept, whose score reaches the threshold; all of them without training labels."""
    chain = learned(docs, labels, held_out, id_col, text_col, label_col, sample)

    @F.pandas_udf("double")
    @trimmed
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out, start = part.tolist(), [], 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and size < TOGETHER:
                    size, end = size + len(texts[end]), end + 1
                own, sizes, counts = line_features(texts[start:end])
                out.append(chain.score(good_share(chain.lines(own, counts), sizes, counts)) if chain else np.full(end - start, 0.5))
                start = end
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.where(score(F.coalesce(F.col(text_col), F.lit(""))) >= threshold) if chain else docs
