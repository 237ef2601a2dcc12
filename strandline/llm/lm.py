"""LM scoring with a log-bilinear neural model over the whole corpus.

The model predicts the next token from the two before it. It predicts the most
frequent words and the end of a text one by one, and all other words by a class
of their last letters; such a word's share of its class is its smoothed count.
The tokens before are known by the very frequent words and the same classes.

Training is noise-contrastive estimation in numpy on every training text. Texts
are dealt by a hash of their ids and texts to slots of about `SLOT_TOKENS` tokens,
so that the number of slots grows with the corpus and does not depend on its
partitions. A row that repeats so often that its copies would fill half a slot
has them dealt over as many slots as they need, one after the other; only there
does the place of a row matter. The slots make up `ROUNDS` rounds. In a round each slot goes on from
the same parameters, in an order given by the hash; Spark then averages the
slots' parameters, weighted by tokens, and the next round starts there.

A context's logits are sums of two rows of context-by-word tables, so one
matrix product of their exponentials normalises all contexts at once, and
scoring a token is a product of short vectors and a table lookup.

Word counts cover all training texts. The most frequent words (a bounded
number) are broadcast with their counts; counts of all others reach their
texts by a join on the word.

Defined results: a null or empty text is the end token alone. A row without
an id trains and is not held out. Repeated rows give repeated results. Texts may
be of any length: their codes are held whole, 4 bytes a token. Other columns are
not read. Without training texts every count is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import bounded_batches, split_join, trimmed, written

#: Words broadcast with their counts (about 100 bytes each in a task), words that are predicted one by one, words that contexts are known by, classes by ending.
BROADCAST_WORDS, OUTPUT_WORDS, CONTEXT_WORDS, ENDINGS = 200_000, 20_000, 767, 256
#: Classes of a token before, with the end of a text as class 0.
CONTEXTS = 1 + CONTEXT_WORDS + ENDINGS
DIMENSIONS = 16
#: Tokens of a training step, noise words drawn for each step, learning rate of AdaGrad.
STEP_TOKENS, NOISE, RATE = 1024, 128, 0.1
#: Rounds of training, and tokens of a slot.
ROUNDS, SLOT_TOKENS = 4, 1_000_000
#: Most tasks of a round; beyond, a task learns several slots, one after the other.
TASKS = 10_000
#: Numbers in a row of parameters, and rows that are summed first by the task that they come from.
SLICE, FIRST_SUMS = 8192, 64
#: Rows of frequent copies that are broadcast at most.
FREQUENT_ROWS = 400_000
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 300_000
#: Words that are handled at a time.
CHUNK_WORDS = 250_000
SEED = 11


def text_words(text: str | None) -> list[bytes]:
    """Lower-cased in A-Z, cut at the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-2:] + (b"" if word.isascii() else b"~")) % ENDINGS


def word_counts(texts: DataFrame) -> DataFrame:
    """word, ending (its class by ending), n over all texts; the word '' stands for the ends of texts."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame(
                {"word": [w.decode("utf-8", "replace") for w in held], "ending": [ending_class(w) for w in held], "n": list(held.values())}
            )
            held.clear()
            return out

        for part in parts:
            for text in part["_text"]:
                held.update(text_words(text))
                held[b""] += 1
                if len(held) > HELD_WORDS:
                    yield passed_on()
        if held:
            yield passed_on()

    return texts.mapInPandas(count, "word string, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    words: dict[bytes, int]  # code of each broadcast word, by falling count; the end of a text is b''
    endings: np.ndarray  # of each code
    counts: np.ndarray  # of each code
    singles: int  # codes under this are predicted one by one
    class_total: np.ndarray  # tokens and distinct words of each ending, without words that are predicted one by one
    class_words: np.ndarray
    n: int  # training tokens
    v: int  # distinct ones

    def unigram(self) -> np.ndarray:
        """Share of each output: single words, then endings."""
        total = np.concatenate([self.counts[: self.singles], self.class_total]) + 0.5
        return total / total.sum()

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Output and context class of each code; the last ENDINGS entries are those of the codes -ENDINGS to -1."""
        code = np.arange(len(self.counts))
        more = np.arange(ENDINGS)
        out = np.where(code < self.singles, code, self.singles + self.endings)
        context = np.where(code <= CONTEXT_WORDS, code, 1 + CONTEXT_WORDS + self.endings)
        return np.concatenate([out, self.singles + more]), np.concatenate([context, 1 + CONTEXT_WORDS + more])


def vocabulary(counts: DataFrame, most: int = BROADCAST_WORDS) -> Vocabulary:
    """The frequent words: all with at least a count that at most `most` words reach."""
    size = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.where("word <> ''").groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("size")).collect()
    least, taken = None, 0
    for step in steps:
        taken += step["words"]
        if taken > most:
            break
        least = step["least"]
    common = counts.where(F.col("n") >= least if least is not None else F.lit(False)).where("word <> ''").toPandas()
    common = common.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("ends")).first()
    by_class = counts.where("word <> ''").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_total, class_words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in by_class:
        class_total[row["ending"]], class_words[row["ending"]] = row["n"], row["v"]
    head = common[:OUTPUT_WORDS]
    np.subtract.at(class_total, head["ending"].to_numpy(int), head["n"].to_numpy(float))
    np.subtract.at(class_words, head["ending"].to_numpy(int), 1)
    words = {b"": 0} | {w.encode(): i + 1 for i, w in enumerate(common["word"])}
    endings = np.concatenate([[0], common["ending"].to_numpy(int)])
    held = np.concatenate([[totals["ends"] or 0], common["n"].to_numpy(float)])
    return Vocabulary(words, endings, held, 1 + len(head), class_total, class_words, totals["n"] or 0, totals["v"] or 0)


class Codes(dict):
    """Code of each broadcast word; of any other word its ending - ENDINGS."""

    def __missing__(self, word: bytes) -> int:
        return ending_class(word) - ENDINGS


def frequent_rows(hashed: DataFrame, slots: int) -> DataFrame:
    """_hash, _shares of training rows whose copies hold half a slot's tokens or more: the slots that they are dealt over, stored."""
    tokens = F.count("*") * (F.coalesce(F.max(F.octet_length("_text")), F.lit(0)) / 2 + 1)  # words of one letter, at the most
    counted = hashed.where("not _out").groupBy("_hash").agg(F.count("*").alias("n"), tokens.alias("tokens"))
    shares = F.least(F.lit(slots), F.col("n"), F.ceil(2 * F.col("tokens") / SLOT_TOKENS)).cast("int")
    return written(counted.where("n > 1").select("_hash", shares.alias("_shares")).where("_shares > 1"), "frequent")


def coded(rows: DataFrame, vocab: Vocabulary, slots: int) -> DataFrame:
    """doc_id, out, slot, hash, codes (int32 of every token), n_tokens, rare (words that are not broadcast, with their times), stored by round.

    rows: _id, _text, _out. Held-out rows have no slot and are in round -1.
    """
    kind = dict(rows.dtypes)["_id"]
    held = rows.sparkSession.sparkContext.broadcast(vocab.words)

    @trimmed
    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = held.value
        codes = Codes(words)
        for part in parts:
            found, rare = [], []
            for text in part["_text"]:
                tokens = text_words(text)
                tokens.append(b"")
                own = np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens))
                found.append(own)
                times = Counter(tokens[i] for i in np.flatnonzero(own < 0))
                rare.append([{"word": w.decode("utf-8", "replace"), "times": k} for w, k in times.items()])
            yield pd.DataFrame(
                {"doc_id": part["_id"], "out": part["_out"], "slot": part["_slot"], "hash": part["_hash"], "codes": [c.tobytes() for c in found], "n_tokens": list(map(len, found)), "rare": rare}
            )

    hashed = rows.withColumn("_hash", F.xxhash64("_id", "_text"))
    copy = F.pmod(F.monotonically_increasing_id(), F.coalesce("_shares", F.lit(1)))
    hashed = split_join(hashed, "_hash", F.monotonically_increasing_id(), frequent_rows(hashed, slots), FREQUENT_ROWS, how="left")
    hashed = hashed.withColumn("_slot", F.when(F.col("_out"), F.lit(-1)).otherwise(F.pmod(F.pmod("_hash", F.lit(slots)) + copy, F.lit(slots))))
    schema = f"doc_id {kind}, out boolean, slot long, hash long, codes binary, n_tokens long, rare array<struct<word string, times int>>"
    out = hashed.mapInPandas(code, schema).withColumns({"row": F.monotonically_increasing_id(), "round": F.when(F.col("out"), F.lit(-1)).otherwise(F.col("slot") % ROUNDS).cast("int")})
    return written(out, "coded", "round")


def contexts(codes: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of texts that stand one after the other: class of the token before and of that before it; and where each text starts."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own = classes[codes]
    one, two = np.roll(own, 1), np.roll(own, 2)
    one[starts] = two[starts] = 0  # before its start a text has ends
    two[np.minimum(starts + 1, len(two) - 1)[sizes > 1]] = 0
    return one, two, starts


def first_values(unigram: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters before training, and AdaGrad's sums of squares (named with a 2)."""
    rng = np.random.default_rng(SEED)
    small = lambda *shape: rng.normal(0, 0.1, shape)
    p = {"context": small(CONTEXTS, DIMENSIONS), "target": small(len(unigram), DIMENSIONS), "one": np.eye(DIMENSIONS), "two": np.eye(DIMENSIONS) / 2, "bias": np.log(unigram)}
    return p | {f"{k}2": np.full_like(v, 1.0) for k, v in p.items()}


def summed_rows(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The rows added up by their index."""
    at = index[:, None] * DIMENSIONS + np.arange(DIMENSIONS)
    return np.bincount(at.ravel(), rows.ravel(), n * DIMENSIONS).reshape(n, DIMENSIONS)


class Learner:
    """Noise-contrastive estimation by AdaGrad on one slot."""

    def __init__(self, start: dict[str, np.ndarray], unigram: np.ndarray, slot: int) -> None:
        self.p, self.noise, self.seen = {k: v.copy() for k, v in start.items()}, np.cumsum(unigram), 0
        self.rng, self.shift = np.random.default_rng([SEED, slot]), np.log(NOISE * unigram)
        self.room = np.empty((STEP_TOKENS, NOISE), np.float32)  # of a step's scores, used again

    def update(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        squares = self.p[name + "2"][rows]
        squares += gradient * gradient
        self.p[name + "2"][rows] = squares
        change = np.sqrt(squares)
        np.divide(RATE * gradient, change, out=change)
        self.p[name][rows] += change

    def step(self, own: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n = self.p, len(own)
        r1, r2, q = p["context"][one], p["context"][two], p["target"][own]
        h = r1 @ p["one"] + r2 @ p["two"]
        drawn = np.searchsorted(self.noise, self.rng.random(NOISE) * self.noise[-1])
        single, qn = h.astype(np.float32), p["target"][drawn].astype(np.float32)
        up = 1 - 1 / (1 + np.exp(self.shift[own] - np.einsum("ij,ij->i", h, q) - p["bias"][own]))
        down = np.matmul(single, qn.T, out=self.room[:n])
        down += (p["bias"][drawn] - self.shift[drawn]).astype(np.float32)
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        gh = up[:, None] * q + down @ qn
        rows, at = np.unique(np.concatenate([own, drawn]), return_inverse=True)
        target = summed_rows(at, np.concatenate([up[:, None] * h, down.T @ single]), len(rows))
        bias = np.bincount(at, np.concatenate([up, down.sum(axis=0)]), len(rows))
        context = summed_rows(np.concatenate([one, two]), np.concatenate([gh @ p["one"].T, gh @ p["two"].T]), CONTEXTS)
        change_one, change_two = r1.T @ gh, r2.T @ gh
        self.update("target", target, rows)
        self.update("bias", bias, rows)
        self.update("context", context)
        self.update("one", change_one)
        self.update("two", change_two)

    def learn(self, codes: list[np.ndarray], outputs: np.ndarray, classes: np.ndarray) -> None:
        if not codes:
            return
        flat = np.concatenate(codes)
        one, two, _ = contexts(flat, np.array(list(map(len, codes))), classes)
        own = outputs[flat]
        order = self.rng.permutation(len(own))
        for i in range(0, len(own), STEP_TOKENS):
            at = order[i : i + STEP_TOKENS]
            self.step(own[at], one[at], two[at])
        self.seen += len(own)


def flat_values(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def averaged(learnt: DataFrame) -> np.ndarray | None:
    """learnt (slice, task, weight, sums: each task's weighted parameters, cut in slices): their mean.

    Slices are summed by the task's number first, so no sum takes more than a
    small share of the tasks; the mean reaches the driver once.
    """
    schema = "slice int, first int, weight double, sums binary"

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in group["sums"]], axis=0)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "first": group["first"].iloc[:1], "weight": [group["weight"].sum()], "sums": [total.tobytes()]})

    some = learnt.withColumn("first", F.col("task") % FIRST_SUMS).groupBy("slice", "first").applyInPandas(add, schema)
    rows = some.withColumn("first", F.lit(0)).groupBy("slice", "first").applyInPandas(add, schema).toPandas().sort_values("slice")
    return np.concatenate([np.frombuffer(x) / w for x, w in zip(rows["sums"], rows["weight"], strict=True)]) if len(rows) else None


def trained(whole: DataFrame, vocab: Vocabulary, slots: int) -> dict[str, np.ndarray]:
    """The parameters after all rounds over the training rows of `coded`."""
    spark, unigram = whole.sparkSession, vocab.unigram()
    outputs, classes = vocab.tables()
    values = first_values(unigram)
    for turn in range(ROUNDS if vocab.n else 0):
        held = spark.sparkContext.broadcast((values, unigram, outputs, classes))

        @trimmed
        def learn(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            start, unigram, outputs, classes = held.value
            learner, slot, codes, size, total, weight = None, None, [], 0, 0.0, 0
            for part in parts:
                for s, raw in zip(part["slot"], part["codes"], strict=True):
                    if s != slot or size >= CHUNK_WORDS:
                        if learner:
                            learner.learn(codes, outputs, classes)
                        codes, size = [], 0
                    if s != slot:
                        if learner:
                            total, weight = total + learner.seen * flat_values(learner.p), weight + learner.seen
                        learner, slot = Learner(start, unigram, int(s)), s
                    codes.append(np.frombuffer(raw, np.int32))
                    size += len(codes[-1])
            if learner:
                learner.learn(codes, outputs, classes)
                total, weight = total + learner.seen * flat_values(learner.p), weight + learner.seen
                cut = [total[i : i + SLICE] for i in range(0, len(total), SLICE)]
                yield pd.DataFrame({"slice": np.arange(len(cut)), "task": TaskContext.get().partitionId(), "weight": float(weight), "sums": [x.tobytes() for x in cut]})

        own = whole.where(F.col("round") == turn).select("slot", "hash", "codes")
        tasks = min(TASKS, slots // ROUNDS)
        placed = own.repartitionById(tasks, F.expr(f"slot div {ROUNDS} % {tasks}").cast("int")).sortWithinPartitions("slot", "hash")
        mean = averaged(placed.mapInPandas(learn, "slice int, task int, weight double, sums binary"))
        if mean is not None:
            at = 0
            for k, v in values.items():
                values[k], at = mean[at : at + v.size].reshape(v.shape), at + v.size
        held.unpersist()
    return values


def normalised(p: dict[str, np.ndarray], width: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near[c1] + far[c2] times an output's vector, with its bias, is a logit; norm[c1, c2] is the log of the sum of their exponentials over all outputs."""
    near, far = (p["context"] @ p[k] for k in ("one", "two"))
    logits = lambda a, b, bias: (a @ p["target"][b : b + width].T + bias * p["bias"][b : b + width]).astype(np.float32)
    cuts = range(0, len(p["bias"]), width)
    tops = [np.max([logits(a, b, bias).max(axis=1) for b in cuts], axis=0)[:, None] for a, bias in ((near, 1), (far, 0))]
    total = sum((np.exp(logits(near, b, 1) - tops[0]) @ np.exp(logits(far, b, 0) - tops[1]).T).astype(float) for b in cuts)
    norm = np.log(np.maximum(total, 1e-300)) + tops[0] + tops[1].T
    return near.astype(np.float32), far.astype(np.float32), norm.astype(np.float32)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where held_out is not true train the model. base_score is that of
    smoothed word counts, score the model's; both are log10 of probabilities.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), out.alias("_out"))
    counts = written(word_counts(rows.where("not _out").select("_text")), "counts")
    vocab = vocabulary(counts)
    slots = ROUNDS * max(1, round(vocab.n / (ROUNDS * SLOT_TOKENS)))
    whole = coded(rows, vocab, slots)
    p = trained(whole, vocab, slots)
    outputs, classes = vocab.tables()
    singles = np.arange(len(outputs)) < vocab.singles
    counted = np.concatenate([vocab.counts, np.zeros(ENDINGS)])
    common = np.arange(len(outputs)) < len(vocab.counts)
    log_count = np.where(common, np.log10(counted + 0.5), 0.0)  # of words that are not broadcast, later
    # of a word of a class: log10(c + 0.5) less that of the class
    share = np.concatenate([np.zeros(vocab.singles), np.log10(vocab.class_total + 0.5 * (vocab.class_words + 1))])
    inside = np.where(singles, 0.0, log_count) - share[outputs]
    n, v = vocab.n, vocab.v
    each = float(np.log10(n + 0.5 * (v + 1)))
    model = (*normalised(p), p["target"].astype(np.float32), p["bias"].astype(np.float32))
    held = spark.sparkContext.broadcast((outputs, classes, counted > 0, log_count, inside, model))
    kind = dict(docs.dtypes)[id_col]

    @trimmed
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outputs, classes, known, log_count, inside, (near, far, norm, target, bias) = held.value
        for part in parts:
            for _, some in part.groupby(np.cumsum(part["n_tokens"].to_numpy()) // CHUNK_WORDS, sort=False):
                sizes, codes = some["n_tokens"].to_numpy(), np.frombuffer(b"".join(some["codes"]), np.int32)
                one, two, starts = contexts(codes, sizes, classes)
                logit = np.empty(len(codes))
                for i in range(0, len(codes), CHUNK_WORDS):  # a text may be longer
                    at = slice(i, i + CHUNK_WORDS)
                    own = outputs[codes[at]]
                    logit[at] = np.einsum("ij,ij->i", near[one[at]] + far[two[at]], target[own]) + bias[own] - norm[one[at], two[at]]
                sums = lambda x, starts=starts: np.add.reduceat(x, starts)
                yield pd.DataFrame(
                    {
                        "row": some["row"].to_numpy(), "doc_id": some["doc_id"].to_numpy(), "held_out": some["out"].to_numpy(), "n_tokens": sizes,
                        "known": sums(known[codes].astype(np.int64)), "base": sums(log_count[codes]) - sizes * each,
                        "model": sums(logit / np.log(10) + inside[codes]),
                    }
                )

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double"
    found = whole.select("row", "doc_id", "out", "n_tokens", "codes").mapInPandas(score, schema)
    rare = whole.select("row", F.inline("rare")).join(counts.select("word", "n"), "word", "left")
    by_row = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("seen")
    )
    more = F.coalesce("more", F.lit(0.0))
    return found.join(by_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
