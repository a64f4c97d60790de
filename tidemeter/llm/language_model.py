"""N-gram language model as a weighted backoff automaton, scored over a corpus of any size.

The model is a chain of mixtures: p_k(w | context) = (count + mu * p_{k-1}(w)) / (context count + mu), down to the
smoothed word frequency. As an automaton, seen contexts are states, seen n-grams arcs, and every state has a failure
arc to its shorter context with weight mu / (context count + mu). A text is scored in one traversal from left to right
that carries the state and adds log10 weights; its end is a token.

No task holds the whole model. Documents fall into blocks; a block sends each of its distinct n-grams once, with its own
training count, in packed runs by key range. A range adds the counts of all blocks and answers in the same order. The
block builds the part of the automaton that its texts can reach, and walks it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import mix, rolled, stored, text_bytes, words_of

#: Bytes of a key that are sent; the key range tells the rest but for a few bits. A range holds a fixed number of n-grams
#: whatever the corpus, so two of them agree in one range of several hundred.
SENT = 6


def shortened(keys: np.ndarray) -> np.ndarray:
    """The sent bytes of keys, lowest first."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]


def lengthened(sent: bytes) -> np.ndarray:
    """Sent bytes as numbers."""
    out = np.zeros((len(sent) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(sent, np.uint8).reshape(-1, SENT)
    return out.view("<u8").ravel()


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all their second ones: the high bytes of small counts compress to nothing."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(sent: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(sent, np.uint8).reshape(width, -1).T).view(kind).ravel()


#: Keys of the text's begin and end, which are no words.
BEGIN, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)


class Block:
    """Tokens of some texts and the keys of all n-grams in them; the lowest two bits of a key are its order less one."""

    def __init__(self, texts: list[str | None], train: np.ndarray, order: int):
        import xxhash

        if not 1 <= order <= 4:
            raise ValueError("order is 1 to 4")
        self.order, number, words = order, {b"": 0}, []
        lengths = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = words_of(text)
            lengths[i] = len(own) + 1
            words += [number.setdefault(w, len(number)) for w in own]
            words.append(0)  # the end; no word is empty
        self.lengths = lengths
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.tokens = np.array(words, np.int64)
        of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        of_word[0] = END
        # Texts with order - 1 begin marks in front of each, in one row of keys.
        pad = order - 1
        row = np.full(len(self.tokens) + pad * len(texts), BEGIN, np.uint64)
        self.at = np.arange(len(self.tokens)) + pad * np.repeat(np.arange(1, len(texts) + 1), lengths)
        row[self.at] = of_word[self.tokens]
        levels = []
        for k in range(1, order + 1):
            keys = mix(row) if k == 1 else rolled(row, k)
            levels.append(((keys >> np.uint64(2)) << np.uint64(2) | np.uint64(k - 1))[self.at - (k - 1)])
        self.keys, places = np.unique(np.concatenate(levels), return_inverse=True)
        self.places = places.reshape(order, len(self.tokens))
        seen = np.repeat(train, lengths)
        self.counts = np.zeros(len(self.keys), np.uint64)
        for level in self.places:
            self.counts += np.bincount(level[seen], minlength=len(self.keys)).astype(np.uint64)

    def packets(self, ranges: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(range, keys, counts) of each key range that is not empty."""
        which = (self.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.searchsorted(which, np.arange(ranges + 1, dtype=np.uint64))
        return [(r, self.keys[a:b], self.counts[a:b]) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


class Automaton:
    """States, arcs and failure arcs that the texts of a block can reach, from the corpus counts of its n-grams."""

    def __init__(self, block: Block, totals: np.ndarray, tokens: int, types: int, ends: int, mu: float):
        self.block, order, places = block, block.order, block.places
        counts = totals.astype(np.float64)
        word = places[0]
        first = np.zeros(int(block.tokens.max(initial=0)) + 1, np.int64)
        first[block.tokens[::-1]] = np.arange(len(block.tokens))[::-1]
        self.base = np.log10((counts[word] + 0.5) / (tokens + 0.5 * (types + 1)))
        self.known = counts[word] > 0
        chance = 10.0**self.base
        begins = block.at - np.repeat(np.arange(len(block.lengths)) * (order - 1) + block.starts[:-1] + order - 1, block.lengths)
        # State 0 is the root, state k (1 .. order - 1) the begin of a text seen through k marks, then one state for
        # every seen context of the block.
        state_of = np.full(len(block.keys), -1, np.int64)
        is_context = (counts > 0) & ((block.keys & np.uint64(3)) < order - 1) if order > 1 else np.zeros(len(counts), bool)
        ends_place = word[block.tokens == 0][:1]
        is_context[ends_place] = False
        state_of[is_context] = order + np.arange(int(is_context.sum()))
        states = order + int(is_context.sum())
        self.fail = np.zeros(states, np.int64)
        self.fail_weight = np.zeros(states)
        begin_weight = math.log10(mu / (ends + mu))
        for k in range(1, order):
            self.fail[k], self.fail_weight[k] = k - 1, begin_weight
        self.fail_weight[order:] = np.log10(mu / (counts[is_context] + mu))

        def suffix_state(level: int) -> np.ndarray:
            """State of the longest seen context of at most ``level`` words that ends at each token."""
            out = np.zeros(len(word), np.int64)
            for k in range(1, level + 1):
                own = state_of[places[k - 1]]
                out = np.where(own >= 0, own, out)
            return out

        for k in range(1, order - 1):  # failure of contexts of k + 1 words
            own = state_of[places[k]]
            at = np.flatnonzero(own >= 0)
            self.fail[own[at]] = suffix_state(k)[at]
        after = suffix_state(order - 1) if order > 1 else np.zeros(len(word), np.int64)
        self.root_weight = np.log10(chance)[first].tolist()
        self.root_next = [0] * len(first) if order == 1 else np.maximum(state_of[word[first]], 0).tolist()
        keys, weights, nexts = [], [], []
        for k in range(1, order):  # arcs from contexts of k words
            before = np.zeros(len(word), np.int64)
            inner = begins >= k
            back = np.flatnonzero(inner)
            before[back] = np.maximum(state_of[places[k - 1][back - 1]], 0)
            context = np.zeros(len(word))
            context[back] = counts[places[k - 1][back - 1]]
            pure = begins == 0
            before[pure], context[pure] = k, ends
            mixed = (begins > 0) & ~inner  # a context that begins with marks: its key holds them
            at = np.flatnonzero(mixed)
            before[at] = np.maximum(state_of[places[k - 1][at - 1]], 0)
            context[at] = counts[places[k - 1][at - 1]]
            own = counts[places[k]]
            chance = np.where(context > 0, (own + mu * chance) / (context + mu), chance)
            _, where = np.unique(places[k], return_index=True)
            where = where[(own[where] > 0) & (before[where] > 0)]
            keys.append(before[where] * len(first) + block.tokens[where])
            weights.append(np.log10(chance[where]))
            nexts.append(after[where])
        self.chance = chance
        self.width = len(first)
        self.arcs = {}
        if keys:
            triples = zip(np.concatenate(keys).tolist(), np.concatenate(weights).tolist(), np.concatenate(nexts).tolist())
            self.arcs = {key: (weight, to) for key, weight, to in triples}
        self.fail, self.fail_weight = self.fail.tolist(), self.fail_weight.tolist()

    def walk(self, tokens: list[int]) -> float:
        """Log10 probability of one text: one pass, carrying the state."""
        arc, width, fail, fail_weight = self.arcs.get, self.width, self.fail, self.fail_weight
        root_weight, root_next = self.root_weight, self.root_next
        state, total = self.block.order - 1, 0.0
        for w in tokens:
            hit = arc(state * width + w)
            while hit is None:
                if not state:
                    hit = root_weight[w], root_next[w]
                    break
                total += fail_weight[state]
                state = fail[state]
                hit = arc(state * width + w)
            total += hit[0]
            state = hit[1]
        return total


def score_texts(
    docs: DataFrame,
    held_out: Column,
    order: int = 2,
    mu: float = 20.0,
    block_bytes: int = 4 << 20,
    range_grams: int = 1_500_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``held_out`` is a condition on ``doc_id``; rows where it is not true train the model. Words are runs without ASCII white
    space, A-Z lower-cased; every text ends with one more token, so a null or empty text is that token alone.
    ``base_score`` is the smoothed word frequency model, ``score`` the automaton's. Words that training lacks get the
    frequency of a count of zero. Repeated rows count as often as they occur. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    size = text_bytes(rows)
    blocks = max(1, math.ceil(size / block_bytes))
    ranges = max(1, math.ceil(size / 6 * order / range_grams))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def block_of(part) -> Block:
        return Block(part.column("text").to_pylist(), ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), order)

    def send(key, part):
        import pyarrow as pa

        packed = block_of(part).packets(ranges)
        return pa.table(
            {
                "range": pa.array([r for r, _, _ in packed], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(packed), pa.int32()),
                "keys": pa.array([shortened(k).tobytes() for _, k, _ in packed], pa.binary()),
                "counts": pa.array([planes(c.astype(np.uint32)) for _, _, c in packed], pa.binary()),
            }
        )

    def add(key, part):
        """Corpus counts for every packet of a range, and a row without block for the range's words."""
        import pyarrow as pa

        keys = [lengthened(x.as_py()) for x in part.column("keys")]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([from_planes(x.as_py(), np.uint32) for x in part.column("counts")])
        totals = np.bincount(place, weights=counts.astype(np.float64), minlength=len(every)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        answers = [planes(totals[place[e - len(k) : e]]) for k, e in zip(keys, ends)]
        words = totals[(every & np.uint64(3)) == 0]
        ends_key = mix(np.array([END])) >> np.uint64(2) << np.uint64(2)
        here = int(ends_key[0] >> np.uint64(32)) * ranges >> 32 == key[0].as_py()
        at = np.flatnonzero(every == lengthened(shortened(ends_key).tobytes())[0]) if here else []
        n = len(answers)
        return pa.table(
            {
                "block": pa.array([*part.column("block").to_pylist(), None], pa.int32()),
                "range": pa.array([key[0].as_py()] * (n + 1), pa.int32()),
                "totals": pa.array([*answers, None], pa.binary()),
                "tokens": pa.array([None] * n + [int(words.sum())], pa.int64()),
                "types": pa.array([None] * n + [int((words > 0).sum())], pa.int64()),
                "ends": pa.array([None] * n + [int(totals[at[0]]) if len(at) else 0], pa.int64()),
            }
        )

    sent = rows.groupBy("block").applyInArrow(send, "range int, block int, keys binary, counts binary")
    answered = stored(
        sent.groupBy("range").applyInArrow(add, "block int, range int, totals binary, tokens long, types long, ends long"), "lm-counts"
    )
    zero = F.lit(0)
    tokens, types, ends = answered.agg(*(F.coalesce(F.sum(c), zero).cast("long") for c in ("tokens", "types", "ends"))).first()

    def score(key, part, answers):
        import pyarrow as pa

        block = block_of(part)
        answers = answers.sort_by("range")
        totals = np.concatenate([from_planes(x.as_py(), np.uint64) for x in answers.column("totals")]) if answers.num_rows else np.empty(0, np.uint64)
        if len(totals) != len(block.keys):
            raise ValueError(f"{len(totals)} counts for {len(block.keys)} n-grams of block {key[0]}")
        machine = Automaton(block, totals, tokens, types, ends, mu)
        every, cuts = block.tokens.tolist(), block.starts.tolist()
        walked = [machine.walk(every[a:b]) for a, b in zip(cuts, cuts[1:])]
        n = part.num_rows
        return pa.table(
            {
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "n_tokens": pa.array(block.lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat(machine.known.astype(np.int64), block.starts[:-1]), pa.int64()),
                "train_tokens": pa.array([tokens] * n, pa.int64()),
                "base_score": pa.array(np.add.reduceat(machine.base, block.starts[:-1]), pa.float64()),
                "score": pa.array(walked, pa.float64()),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = answered.where("block IS NOT NULL").select("block", "range", "totals")
    return rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, schema)
