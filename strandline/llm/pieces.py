"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut into units (spaces and the word after them), since no piece of
the vocabulary has a space after a letter. Each unit's adjacent symbols that
merge to a piece are candidates on an agenda, best score first, leftmost on
ties. When a candidate comes up, a hash keyed by the seed, the document, the
unit's place in it and the candidate's turn decides whether it is skipped for
good. The same seed always gives the same pieces, another seed others, and
all decode to the same text. Characters outside the vocabulary, and a literal
U+2581, become byte pieces.

Defined results: a null text has null ids and decodes to null, an empty one
has no ids. Repeated rows with one id get equal pieces; a null id counts as 0,
an id that is no integer by a hash. Texts may be of any length: texts are encoded
whole, a long unit by a heap. Other columns pass through unread.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.shared import bounded_batches, trimmed

#: A public vocabulary with byte pieces; only the driver reads the file (under 1 MB), tasks get a broadcast.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of candidate merges that are skipped.
DROPOUT = 0.1
SEED = 17
SPACE = "▁"
UNIT = re.compile(f" *[^ {SPACE}]+| +|{SPACE}")
#: Turns whose draws are made for all units at once, and units and their variations kept with their pieces (about 250 bytes each).
TURNS, HELD = 16, 400_000
#: Symbols beyond which a unit's agenda is a heap; characters of texts that are encoded together.
LONG, TOGETHER = 32, 600_000
NEVER = 1 << 30
#: A bit that all draws have: units with more turns than bits test for it, so that their agenda is always run.
ALWAYS = 1 << 20
GOLDEN = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1


@dataclass
class Vocabulary:
    ids: dict[str, int]  # pieces that can merge
    byte_ids: list[int]
    spelled: list[bytes]  # of each id
    order: np.ndarray  # of each id: less merges sooner
    chars: np.ndarray  # id of each code point, or -1
    slots: np.ndarray  # open-addressed table of pairs of ids ...
    joined: np.ndarray  # ... and of the id each pair merges to


SLOT_BITS = 19


def slot_of(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def load(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    ids, byte_ids, spelled = {}, [0] * 256, []
    order, chars = np.full(n, NEVER, np.int32), np.full(0x110000, -1, np.int32)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            spelled.append(b"")
        else:
            ids[piece], order[i] = i, round(-sp.get_score(i))
            spelled.append(piece.replace(SPACE, " ").encode())
            if len(piece) == 1:
                chars[ord(piece)] = i
    slots, joined = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, np.int32)
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                pair = left << 32 | right
                at = (pair * GOLDEN & MASK64) >> (64 - SLOT_BITS)
                while slots[at] >= 0:
                    at = (at + 1) % len(slots)
                slots[at], joined[at] = pair, i
    return Vocabulary(ids, byte_ids, spelled, order, chars, slots, joined)


def mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK64
    return x ^ (x >> 31)


def mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def document_number(doc_id: object) -> int:
    """The id itself if it is an integer, 0 if there is none, a hash of its text otherwise."""
    if doc_id is None or isinstance(doc_id, int):
        return doc_id or 0
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id))


def document_key(seed: int, doc_id: int) -> int:
    return mixed((mixed(seed & MASK64) + doc_id * GOLDEN) & MASK64)


def unit_keys(doc_key: int, n: int) -> np.ndarray:
    return mixed_all(np.uint64(doc_key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN))


def skipped(key: int, turn: int, limit: int) -> bool:
    """Whether the unit's candidate of this turn is skipped: 16 bits of a keyed hash against a limit."""
    return (mixed((key + (turn // 4 + 1) * GOLDEN) & MASK64) >> 16 * (turn % 4)) & 0xFFFF < limit


def skips(keys: np.ndarray, limit: int) -> np.ndarray:
    """The same for the first turns of all units, as bits."""
    bits = np.zeros(len(keys), np.int64)
    for block in range(TURNS // 4):
        drawn = mixed_all(keys + np.uint64((block + 1) * GOLDEN & MASK64))
        for i in range(4):
            low = (drawn >> np.uint64(16 * i)) & np.uint64(0xFFFF)
            bits |= (low < limit).astype(np.int64) << (4 * block + i)
    return bits


class Encoder:
    """Encodes texts; keeps the pieces of units that it has met."""

    def __init__(self, vocab: Vocabulary, seed: int = SEED, dropout: float = DROPOUT, store: dict | None = None) -> None:
        self.v, self.seed, self.limit = vocab, seed, round(dropout * 65536)
        self.store = {} if store is None else store
        if not self.store:
            self.forget()

    def forget(self) -> None:
        """Starts with an empty store.

        An entry is a run of ids. units: the entry of each unit's ids without
        skips; varied: the entry of its ids under some draws, by entry and
        draws. use: the turns that an entry's unit took, as bits; within:
        those that its varied ids are kept by.
        """
        small = {"start": np.int64, "size": np.int32, "use": np.int32, "within": np.int32, "ids": np.int32}
        self.store.update({k: np.zeros(1024, kind) for k, kind in small.items()}, units={}, varied={}, entries=0, held=0)

    def put(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, use: np.ndarray | int = 0, within: np.ndarray | int = 0) -> int:
        """Adds entries, whose ids start in flat at start; returns the number of the first."""
        s = self.store
        first, held = s["entries"], s["held"]
        s["entries"], s["held"] = first + len(start), held + len(flat)
        for name, values, at, end in (
            ("ids", flat, held, s["held"]), ("start", start + held, first, s["entries"]), ("size", size, first, s["entries"]),
            ("use", use, first, s["entries"]), ("within", within, first, s["entries"]),
        ):
            if end > len(s[name]):
                wider = np.zeros(max(end, 2 * len(s[name])), s[name].dtype)
                wider[:at] = s[name][:at]
                s[name] = wider
            s[name][at:end] = values
        return first

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair of ids merges to, or -1."""
        pairs = a.astype(np.int64) << 32 | np.maximum(b, 0)
        found = np.full(len(a), -1, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        at = slot_of(pairs[left]).astype(np.int64)
        while len(left):
            held = self.v.slots[at]
            hit = held == pairs[left]
            found[left[hit]] = self.v.joined[at[hit]]
            on = ~hit & (held >= 0)
            left, at = left[on], (at[on] + 1) & (len(self.v.slots) - 1)
        return found

    def agendas(self, units: list[str], bits: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units in one array; where each unit's start and how many they are; the number of its candidates that came up.

        keys None: nothing is skipped. All units take their turns together:
        every unit that still has candidates has had as many as there have
        been rounds.
        """
        start, size, turns = np.zeros((3, len(units)), np.int64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        flat, held, low = [np.empty(0, np.int32)], 0, 0
        for high in (4, 6, 8, 10, 12, 16, 24, LONG):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if len(which):
                ids, n = self.short_agendas([units[i] for i in which], lengths[which], high, which, bits, keys, turns)
                flat.append(ids)
                start[which], size[which] = held + np.cumsum(n) - n, n
                held += len(ids)
        for i in np.flatnonzero(lengths > LONG):
            symbols = list(units[i].replace(" ", SPACE))
            found, turns[i] = self.long_agenda(symbols, int(bits[i]), None if keys is None else int(keys[i]))
            flat.append(np.array(found, np.int32))
            start[i], size[i] = held, len(found)
            held += len(found)
        return np.concatenate(flat), start, size, turns

    def short_agendas(self, units, sizes, width, which, bits, keys, turns) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        literal = np.fromiter((u == SPACE for u in units), bool, len(units))
        ids = self.v.chars[points]
        inside = np.arange(width) < sizes[:, None]
        symbols = np.full((len(units), width), -1, np.int32)
        symbols[inside] = np.where(ids >= 0, ids, -2 - points)  # below -1: a code point that is no piece
        symbols[literal, 0] = -2 - ord(SPACE)
        joined = np.full((len(units), width), -1, np.int32)
        joined[:, :-1] = self.merged(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(units), -1)
        ranks = np.where(joined >= 0, self.v.order[joined], np.int32(NEVER))
        done, row, turn = symbols.copy(), np.arange(len(units)), 0
        while True:
            best = ranks.argmin(axis=1)
            open_ = ranks[np.arange(len(row)), best] < NEVER
            ended = row[~open_]
            done[ended], turns[which[ended]] = symbols[~open_], turn
            row, symbols, joined, ranks, best = row[open_], symbols[open_], joined[open_], ranks[open_], best[open_]
            if not len(row):
                break
            if turn < TURNS:
                skip = (bits[which[row]] >> turn & 1).astype(bool)
            elif keys is None:
                skip = np.zeros(len(row), bool)
            else:
                drawn = mixed_all(keys[which[row]] + np.uint64((turn // 4 + 1) * GOLDEN & MASK64))
                skip = (drawn >> np.uint64(16 * (turn % 4))) & np.uint64(0xFFFF) < self.limit
            turn += 1
            ranks[skip, best[skip]] = NEVER
            at = np.flatnonzero(~skip)
            i = best[at]
            into = joined[at, i]
            # what stands right of the pair moves one place to the left, in the few columns that any row needs
            low = int(i.min()) + 1 if len(i) else width
            keep = np.arange(low, width) <= i[:, None]
            for x, fill in ((symbols, -1), (joined, -1), (ranks, NEVER)):
                old = x[at, low:]
                moved = np.full_like(old, fill)
                moved[:, :-1] = old[:, 1:]
                x[at, low:] = np.where(keep, old, moved)
            symbols[at, i] = into
            for place in (i - 1, i):
                fits = place >= 0
                r, c = at[fits], place[fits]
                new = self.merged(symbols[r, c], symbols[r, np.minimum(c + 1, width - 1)])
                new[c + 1 >= width] = -1
                joined[r, c] = new
                ranks[r, c] = np.where(new >= 0, self.v.order[new], np.int32(NEVER))
        ids, n = done[done != -1], (done != -1).sum(axis=1)
        strange = ids < -1
        if strange.any():  # a code point that is no piece becomes its bytes
            spelled = [[self.v.byte_ids[b] for b in chr(-2 - x).encode("utf-8", "surrogatepass")] for x in ids[strange].tolist()]
            times = np.ones(len(ids), np.int64)
            times[strange] = list(map(len, spelled))
            np.add.at(n, np.repeat(np.arange(len(n)), n)[strange], times[strange] - 1)
            strange, ids = np.repeat(strange, times), np.repeat(ids, times)
            ids[strange] = list(chain.from_iterable(spelled))
        return ids, n

    def long_agenda(self, symbols: list[str], bits: int, key: int | None) -> tuple[tuple[int, ...], int]:
        """The agenda of one long unit, as a heap."""
        ids, order, n, turn = self.v.ids.get, self.v.order, len(symbols), 0
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        agenda: list[tuple[int, int, int, str]] = []

        def add(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (x := ids(joined := symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (int(order[x]), i, j, joined))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            if after[i] != j or not symbols[i] or symbols[i] + symbols[j] != joined:
                continue  # one of its symbols has changed meanwhile
            skip = bits >> turn & 1 if turn < TURNS else key is not None and skipped(key, turn, self.limit)
            turn += 1
            if skip:
                continue
            symbols[i], symbols[j] = joined, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            add(before[i], i)
            add(i, after[i])
        out: list[int] = []
        for s in symbols:
            if s:
                out.extend([ids(s)] if ids(s) is not None else [self.v.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")])
        return tuple(out), turn

    def encode_all(self, texts: list[str], doc_ids: list[int]) -> list[array]:
        """Ids of each text."""
        by_text = [UNIT.findall(" " + t) if t else [] for t in texts]
        units = [u for found in by_text for u in found]
        if self.store["entries"] > HELD:
            self.forget()
        s, place, varied = self.store, self.store["units"], self.store["varied"]
        if new := list(set(units).difference(place)):
            *found, turns = self.agendas(new, np.zeros(len(new), np.int64), None)
            use = np.where(turns <= TURNS, (1 << np.minimum(turns, TURNS)) - 1, ALWAYS)
            first = self.put(*found, use, (1 << np.minimum(TURNS, turns + 3)) - 1)
            place.update(zip(new, range(first, first + len(new)), strict=True))
        entry = np.fromiter(map(place.__getitem__, units), np.int64, len(units))
        if self.limit and units:
            keys = np.concatenate([unit_keys(document_key(self.seed, d), len(found)) for d, found in zip(doc_ids, by_text, strict=True)])
            bits = skips(keys, self.limit) | ALWAYS
            hit = np.flatnonzero(bits & s["use"][entry])
            plain = entry[hit]
            wanted = plain << TURNS | bits[hit] & s["within"][plain]
            known = np.fromiter(map(varied.get, wanted.tolist(), repeat(-1)), np.int64, len(hit))
            entry[hit] = known
            if len(left := np.flatnonzero(known < 0)):
                todo, plain = hit[left], plain[left]
                *found, turns = self.agendas([units[k] for k in todo.tolist()], bits[todo], keys[todo])
                first = self.put(*found)
                entry[todo] = first + np.arange(len(todo))
                # to be kept, no draw beyond those in the key may have been made
                keep = np.flatnonzero((turns < TURNS) & (1 << np.minimum(turns, TURNS) <= s["within"][plain] + 1) & (s["use"][plain] & ALWAYS == 0))
                varied.update(zip(wanted[left[keep]].tolist(), (first + keep).tolist(), strict=True))
        size = s["size"][entry].astype(np.int64)
        ends = np.cumsum(size)
        ids = s["ids"][np.repeat(s["start"][entry] - ends + size, size) + np.arange(size.sum())]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, by_text)])].tolist()
        return [array("i", ids[a:b].tobytes()) for a, b in pairwise(bounds)]

    def encode(self, text: str, doc_id: int = 0) -> array:
        return self.encode_all([text], [doc_id])[0]


def decode(ids, spelled: list[bytes]) -> str:
    """The text of which ids are an encoding."""
    return b"".join(map(spelled.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT
) -> DataFrame:
    """docs with piece_ids (array of int) and lossless (whether they decode to the text), in place of any columns so named."""
    bounded_batches(docs.sparkSession)
    # a Python worker keeps a broadcast's value from task to task, and so the units that it has met
    held = docs.sparkSession.sparkContext.broadcast((vars(load(model)), {}))
    docs = docs.drop("piece_ids", "lossless")
    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("lossless", T.BooleanType())])

    @trimmed
    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, store = held.value
        coder = Encoder(Vocabulary(**vocab), seed, dropout, store)
        for part in parts:
            yield batch(part, coder)

    def batch(part: pa.RecordBatch, coder: Encoder) -> pa.RecordBatch:
        flat, sizes, same = array("i"), [], []
        texts = part.column(at_text).to_pylist()
        doc_ids = [document_number(x) for x in part.column(at_id).to_pylist()]
        missing, start = [t is None for t in texts], 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and size < TOGETHER:
                size, end = size + len(texts[end] or ""), end + 1
            for text, ids in zip(texts[start:end], coder.encode_all(texts[start:end], doc_ids[start:end]), strict=True):
                flat.extend(ids)
                sizes.append(len(ids))
                same.append(None if text is None else decode(ids, coder.v.spelled) == text)
            start = end
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, np.int32)), mask=pa.array(missing))
        return pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same, pa.bool_())], names=[*names, "piece_ids", "lossless"])

    return docs.mapInArrow(encode, schema)


def decoded(spark: SparkSession, pieces: DataFrame, ids_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """pieces with the column text: what the ids spell."""
    held = spark.sparkContext.broadcast(load(model).spelled)

    @F.pandas_udf("string")
    def spell(column):
        return column.map(lambda ids: None if ids is None else decode(ids, held.value))

    return pieces.withColumn("text", spell(F.col(ids_col)))
