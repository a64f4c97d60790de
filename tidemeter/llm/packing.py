"""Best-fit packing of tokenised documents into sequences of bounded length.

Every partition cuts its documents into pieces and packs them by best fit, longest first. Bins that are nearly
full leave at once; the others become items of the next round, in which a few partitions' items meet in one.
Rounds follow until one partition is left or, for very many items, until each partition holds its fill; then the bins
leave as they are. Only underfull bins are shuffled.
"""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import Remembered, stored

PIECE = "doc_id: long, piece: int, start: long, length: long, ids_crc32: long, ids: binary, offset: long"
FIELDS = [f.split(":")[0] for f in PIECE.split(", ")]
BINS = f"sequence_id long, size int, closed boolean, members array<struct<{PIECE}>>"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as is, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts by a tokenizer file, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what stands on both sides of it, so words between blanks and line
    feeds are encoded once and remembered. It lower-cases and cuts off marks behind letters: plain Latin words, with or
    without such a mark, go to its merges directly, all others through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = {ord(chr(b)): letter for b, letter in byte_letters().items()}
        self.plain = Remembered(self._plain, most // 2)
        self.word = Remembered(self._word, most).__getitem__

    def _plain(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(spelt)])

    def _word(self, word: str) -> bytes:
        if word and max(word) < "\u0130":
            if word.isalpha():
                return self.plain[word.lower()]
            if word[-1] in ".," and word[:-1].isalpha():
                return self.plain[word[:-1].lower()] + self.plain[word[-1]]
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.word, text.replace("\n", " ").split(" ")))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of this worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that still holds it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_rest: list[list[int]] = [[] for _ in range(limit + 1)]
    open_rests = 0  # bit r: some bin has r tokens left
    bins: list[list[int]] = []
    for item in order:
        size = sizes[item]
        fitting = open_rests >> size
        if fitting:
            rest = size + (fitting & -fitting).bit_length() - 1
            held = by_rest[rest]
            number = held.pop()
            if not held:
                open_rests ^= 1 << rest
            bins[number].append(item)
        else:
            rest, number = limit, len(bins)
            bins.append([item])
        rest -= size
        if rest:
            by_rest[rest].append(number)
            open_rests |= 1 << rest
    return bins


def placed(members: list[tuple]) -> list[tuple]:
    """Members with their offsets in the bin."""
    ends = list(accumulate((m[3] for m in members), initial=0))
    return [(*m[:6], at) for m, at in zip(members, ends)]


class Emitter:
    """Arrow batches of bins with sequence numbers that no other task of any round gives."""

    def __init__(self, stage: int):
        from pyspark import TaskContext

        self.next = (stage << 56) | (TaskContext.get().partitionId() << 32)

    def batch(self, bins: list[tuple[int, bool, list]]):
        import pyarrow as pa

        member = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("offset", pa.int64())])
        numbers = list(range(self.next, self.next + len(bins)))
        self.next += len(bins)
        arrays = [
            pa.array(numbers, pa.int64()),
            pa.array([b[0] for b in bins], pa.int32()),
            pa.array([b[1] for b in bins], pa.bool_()),
            pa.array([[dict(zip(FIELDS, m)) for m in placed(b[2])] for b in bins], pa.list_(member)),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["sequence_id", "size", "closed", "members"])


def pack_items(items: list[tuple[int, list]], limit: int, slack: int, last: bool) -> list[tuple[int, bool, list]]:
    """(size, closed, members) of the bins of (size, members) items."""
    out = []
    for rows in best_fit([size for size, _ in items], limit):
        size = sum(items[i][0] for i in rows)
        out.append((size, last or limit - size <= slack, [m for i in rows for m in items[i][1]]))
    return out


def pack_documents(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    end_id: int = 0,
    slack: int = 4,
    fan_in: int = 8,
    task_items: int = 50_000,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    A document is its token ids and then ``end_id``; a null text counts as empty, so every row has a piece. Only
    documents longer than ``limit`` are cut, into full pieces and a last one. Offsets of a sequence have no gaps. Repeated rows
    are packed as often as they occur; rows with a null id are packed too. ``path`` names a tokenizer file that every
    executor has. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def first(batches):
        tokenizer, end = tokenizer_of(path), np.array([end_id], "<u4").tobytes()
        emitter, items, full = Emitter(0), [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.encode(text.as_py() or "") + end
                for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                    own = ids[4 * start : 4 * (start + limit)]
                    member = (doc_id, piece, start, len(own) // 4, zlib.crc32(own), own if keep_ids else None)
                    if len(own) == 4 * limit:
                        full.append((limit, True, [member]))
                    else:
                        items.append((len(own) // 4, [member]))
            if len(full) >= 1000:
                yield emitter.batch(full)
                full = []
            if len(items) >= task_items:
                yield emitter.batch(pack_items(items, limit, slack, False))
                items = []
        yield emitter.batch(full + pack_items(items, limit, slack, False))

    def again(stage, last):
        def run(batches):
            items = []
            emitter = Emitter(stage)

            def give():
                bins = pack_items(items, limit, slack, last)
                for start in range(0, len(bins), 2000):
                    yield emitter.batch(bins[start : start + 2000])

            for batch in batches:
                for size, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    items.append((size, [tuple(m.values()) for m in members]))
                if len(items) >= 2 * task_items:
                    yield from give()
                    items = []
            yield from give()

        return run

    made = [stored(rows.mapInArrow(first, BINS), "packing-0")]
    parts, stage = None, 0
    while True:
        left = made[-1].where(~F.col("closed"))
        count, tasks = left.agg(F.count("*"), F.countDistinct(F.shiftright("sequence_id", 32))).first()
        if not count:
            break
        least = math.ceil(count / task_items)
        parts = max(least, math.ceil((parts or tasks) / fan_in))
        stage += 1
        last = parts <= least
        # A rebalance by a hash of the bin: any even deal is right, and a retried task gets the same one.
        dealt = left.repartition(parts, F.xxhash64("sequence_id")).select("size", "members")
        made.append(stored(dealt.mapInArrow(again(stage, last), BINS), f"packing-{stage}"))
        if last:
            break
    bins = made[0].where("closed")
    for part in made[1:]:
        bins = bins.unionByName(part.where("closed"))
    out = bins.select("sequence_id", F.explode("members").alias("m"))
    out = out.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset", "m.ids")
    return out if keep_ids else out.drop("ids")
