"""Byte-level BPE as a finite-state transducer that is determinised while it is used.

The merges are compiled into a trie over the tokens' bytes and the rule that a sequence of tokens is the BPE encoding
of its bytes exactly if every adjacent pair is the encoding of its own bytes. Each prefix of a text then has one
last token. A state of the transducer is the set of places where the next token may still start: for each, the trie
node reached since then and the token before it. A byte moves all places and puts out the last token of the prefix
that it ends; read from the end, each of these tokens tells where the one before it ends. States do not hold the
tokens that led to them, so words of different beginnings share them. States and transitions are built when they are
wanted again and thrown away when there are too many, which bounds memory. Transitions stand in a table of bytes by
states, so the words of many texts take their steps at the same time, a byte of each word in one.

Decoding is a second machine of that kind: its state is the unfinished part of a UTF-8 sequence.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import Remembered


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merges(piece: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[list[bytes], int]]:
    """The parts of one token's bytes after each merge, and its rank: lowest rank first, leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    yield parts, -1
    while len(parts) > 1:
        pairs = [(ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs)
        if rank > len(ranks):
            break
        parts = parts[:i] + [parts[i] + parts[i + 1]] + parts[i + 2 :]
        yield parts, rank


class Encoder:
    """Lazily determinised transducer for pieces of text; ``encode`` gives the tokens of one piece, ``encode_all`` of many."""

    BRIEF = 64  # bytes of a short piece

    def __init__(self, ranks: dict[bytes, int], most_states: int = 150_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing[:5]}")
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.length_of = np.zeros(max(self.lengths) + 1, np.int32)
        self.length_of[list(self.lengths)] = list(self.lengths.values())
        self.same = np.full(len(self.length_of), None, object)  # one object for each token, whoever holds it
        self.same[list(self.lengths)] = list(self.lengths)
        self.at_once = max(most_states // 2, self.BRIEF)
        self.room = most_states + self.at_once + 3
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.never = len(ranks) + 1
        self.spines: dict[tuple[int, bool], tuple[list[bytes], list[int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # A place: (trie node, token before it or -1).
        self.states: list[tuple] = [((0, -1),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        # Next state by row of the byte and state; 0 is none, as no byte leads to the first state. Bytes get their
        # rows when they are met, since rows without entries take no memory.
        self.moves = np.zeros(256 * self.room, np.int32)
        self.row: dict[int, int] = {}
        self.row_of = np.zeros(256, np.int64)
        self.last = np.full(self.room, -1, np.int32)
        self.met: set[int] = set()

    def spine(self, token: int, last: bool) -> tuple[list[bytes], list[int]]:
        """The growing part of a token at its last (or first) byte, and for each the rank of the merge that takes it in."""
        known = self.spines.get((token, last))
        if known is None:
            grown, made = [], []
            for parts, rank in merges(self.bytes_of[token], self.ranks):
                part = parts[-1 if last else 0]
                if not grown or part != grown[-1]:
                    grown.append(part)
                    made.append(rank)
            known = self.spines[token, last] = grown, [*made[1:], self.never]
        return known

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: begin the piece).

        It may not if, while both are merged, the parts that meet at their border have a merge of their own that
        comes before the next merge on either side. Merges go by rank, equal ones from the left.
        """
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            right, taken_right = self.spine(token, False)
            known = right[-1] == self.bytes_of[token]
            if known and before >= 0:
                left, taken_left = self.spine(before, True)
                rank_of, never = self.ranks.get, self.never
                i = j = 0
                a, b = taken_left[0], taken_right[0]
                while True:
                    cross = rank_of(left[i] + right[j], never)
                    if cross < a and cross <= b:  # no merge has the rank ``never``
                        known = False
                        break
                    if a <= b:
                        if a == never:
                            break
                        i += 1
                        a = taken_left[i]
                    else:
                        j += 1
                        b = taken_right[j]
            self.pairs[before, token] = known
        return known

    def follow(self, places, data: Iterable[int], last: list[int]):
        """The places after some more bytes; the last one begins a token there. Appends the last token of each prefix."""
        children, token_at, pairs = self.children, self.token_at, self.pairs
        for byte in data:
            moved, ended = [], -1
            for node, before in places:
                node = children[node].get(byte)
                if node is None:
                    continue
                if ended < 0:
                    token = token_at[node]
                    if token >= 0:
                        fits = pairs.get((before, token))
                        if fits or (fits is None and self.fits(before, token)):
                            ended = token
                if children[node]:
                    moved.append((node, before))
            if ended < 0:
                raise AssertionError("every prefix has an encoding when all single bytes are tokens")
            moved.append((0, ended))
            last.append(ended)
            places = moved
        return places

    def state_of(self, places: tuple) -> int:
        """Number of the state that has these places."""
        number = self.number.get(places)
        if number is None:
            number = self.number[places] = len(self.states)
            self.states.append(places)
            self.last[number] = places[-1][1]
        return number

    def begin(self, data: Iterable[int]) -> None:
        """Room for some more steps, and rows for the bytes they take."""
        if len(self.states) > self.most_states or len(self.met) > 4 * self.most_states:
            self.reset()
        for byte in data:
            if byte not in self.row:
                self.row[byte] = len(self.row)
                self.row_of[byte] = self.row[byte] * self.room

    def step(self, state: int, byte: int) -> int:
        """Builds the transition of one state for one byte."""
        number = self.state_of(tuple(self.follow(self.states[state], (byte,), [])))
        self.moves[self.row[byte] * self.room + state] = number
        return number

    def wanted(self, state: int, piece: bytes, at: int, last: list[int]) -> int:
        """The next state of a short piece by a transition that it lacks, or 0 with the last tokens of all further prefixes.

        A transition is built when it is wanted for the second time. The rest of a piece that wants one for the
        first time is followed as a set of places, without making states.
        """
        key = state << 8 | piece[at]
        if key in self.met:
            return self.step(state, piece[at])
        self.met.add(key)
        self.follow(self.states[state], piece[at:], last)
        return 0

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece of text."""
        # The library takes a piece that is a token as a whole, even where merges would not reach it.
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        self.begin(set(piece))
        state, last, brief = 0, [], len(piece) <= self.BRIEF
        for at, byte in enumerate(piece):
            if not brief and len(self.states) > self.most_states:  # a very long piece: keep only the state it is in
                held = self.states[state]
                self.begin(set(piece))
                state = self.state_of(held)
            move = self.moves.item(self.row[byte] * self.room + state)
            if not move:
                move = self.wanted(state, piece, at, last) if brief else self.step(state, byte)
                if not move:
                    break
            state = move
            last.append(self.last.item(state))
        out, at, lengths = [], len(last), self.lengths
        while at:
            token = last[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def encode_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of many pieces of text."""
        rank_of = self.ranks.get
        out = [None if (token := rank_of(piece)) is None else (token,) for piece in pieces]
        group, size = [], 0
        for i, piece in enumerate(pieces):
            if out[i] is not None:
                continue
            if len(piece) > self.BRIEF:
                out[i] = tuple(self.encode(piece))
                continue
            if size + len(piece) > self.at_once:
                self.walk(pieces, group, out)
                group, size = [], 0
            group.append(i)
            size += len(piece)
        if size:
            self.walk(pieces, group, out)
        return [() if ids is None else ids for ids in out]

    def walk(self, pieces: list[bytes], group: list[int], out: list) -> None:
        """Encodes the pieces of a group, the longest first, one byte of each in a step."""
        group = sorted((i for i in group if pieces[i]), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in group])
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join([pieces[i] for i in group]), np.uint8)
        self.begin(np.unique(data).tolist())
        rows, moves = self.row_of[data], self.moves
        last, rests = np.empty(len(data), np.int32), []
        lanes, state = np.arange(len(group)), np.zeros(len(group), np.int32)
        for at in range(sizes[0]):
            lanes = lanes[: np.searchsorted(-sizes[lanes], -at)]  # those that are longer
            state = state[: len(lanes)]
            if not len(lanes):
                break
            places = first[lanes] + at
            cells = rows[places] + state
            moved = moves[cells]
            for k in np.flatnonzero(moved == 0).tolist():
                number, piece, rest = moves.item(cells[k]), pieces[group[lanes[k]]], []
                if not number:
                    number = self.wanted(state.item(k), piece, at, rest)
                    if not number:
                        rests.append((places[k], rest))
                moved[k] = number
            last[places] = self.last[moved]
            kept = moved > 0
            lanes, state = (lanes, moved) if kept.all() else (lanes[kept], moved[kept])
        for place, rest in rests:
            last[place : place + len(rest)] = rest
        # Read from the end, each token tells where the one before it ends.
        at, lanes, steps = first + sizes - 1, np.arange(len(group)), []
        many = np.zeros(len(group), np.int64)
        while len(lanes):
            tokens = last[at]
            steps.append((lanes, tokens))
            many[lanes] += 1
            at = at - self.length_of[tokens]
            more = at >= first[lanes]
            lanes, at = lanes[more], at[more]
        ends = np.cumsum(many)
        ids = np.empty(ends[-1], object)
        for k, (lanes, tokens) in enumerate(steps):
            ids[ends[lanes] - 1 - k] = self.same[tokens]
        ids, start = ids.tolist(), 0
        for i, end in zip(group, ends.tolist()):
            out[i] = tuple(ids[start:end])
            start = end


class Utf8Decoder:
    """Incremental decoding of token ids: ``feed`` gives the text that is complete so far.

    The state is the unfinished byte sequence (at most three bytes); moves from a state by a token are remembered.
    Bytes that are not UTF-8 become replacement characters.
    """

    def __init__(self, bytes_of: dict[int, bytes], most_moves: int = 400_000):
        self.bytes_of, self.most_moves = bytes_of, most_moves
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.rest = b""

    @staticmethod
    def wanted(lead: int) -> int:
        """Bytes of a sequence by its first byte; 0 if no sequence starts so."""
        if lead < 0x80:
            return 1
        if 0xC2 <= lead <= 0xDF:
            return 2
        if 0xE0 <= lead <= 0xEF:
            return 3
        return 4 if 0xF0 <= lead <= 0xF4 else 0

    def split(self, data: bytes) -> tuple[bytes, str]:
        """Unfinished tail and decoded text of a run of bytes."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            if self.wanted(lead) > back:
                try:
                    data[-back:].decode()
                except UnicodeDecodeError as error:
                    if error.reason == "unexpected end of data":
                        return data[-back:], data[:-back].decode("utf-8", "replace")
            break
        return b"", data.decode("utf-8", "replace")

    def feed(self, token: int) -> str:
        move = self.moves.get((self.rest, token))
        if move is None:
            if len(self.moves) > self.most_moves:
                self.moves.clear()
            move = self.moves[self.rest, token] = self.split(self.rest + self.bytes_of[token])
        self.rest, text = move
        return text

    def feed_all(self, tokens: list[int]) -> str:
        """Text of a run of tokens; the bytes of some thousand tokens are one step."""
        out: list[str] = []
        for start in range(0, len(tokens), 4096):
            self.rest, text = self.split(self.rest + b"".join(map(self.bytes_of.__getitem__, tokens[start : start + 4096])))
            out.append(text)
        return "".join(out)

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")

    def stream(self, tokens: Iterable[int]) -> Iterator[str]:
        """Decoded text, token by token."""
        yield from map(self.feed, tokens)
        yield self.finish()


#: A word, maybe behind a line feed. Any other part between two blanks has white space beside white space, where a
#: match of the pattern may reach over the end of a word.
_WORD = re.compile(r"\n?\S+").fullmatch


class Codec:
    """Pattern, encoder and decoder of one vocabulary, with the words met lately remembered.

    Where single blanks and line feeds stand between words, no match of the pattern reaches from one word into
    the next, and a blank belongs to the word behind it. Such words are looked up; all other texts are matched whole.
    The pattern must have that property, as the public pattern of the vocabulary has.
    """

    LONG = 1 << 20  # characters that are looked up together

    def __init__(self, path: str, pattern: str, most_words: int = 250_000):
        import regex

        self.encoder = Encoder(read_ranks(path))
        self.decoder = Utf8Decoder(self.encoder.bytes_of)
        self.matches = regex.compile(pattern).findall
        # Words behind a blank, or behind and with a line feed, and matches of the pattern.
        self.words = Remembered(None, most_words)
        self.pieces = Remembered(None, most_words // 4)

    def cut(self, word: str, blank: str = " ") -> list[str]:
        """The matches of the pattern in a word."""
        if word[0] == "\n":
            return ["\n", *self.cut(word[1:], "")]
        # A word of Latin letters, or of these and a mark, needs no matching.
        if word.isascii() or max(word) < "\u0250":
            if word.isalpha():
                return [blank + word]
            if word[-1] in ".," and word[:-1].isalpha():
                return [blank + word[:-1], word[-1]]
        return self.matches(blank + word)

    def of_pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of distinct matches of the pattern."""
        data = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        # Steps of arrays pay for many pieces.
        return dict(zip(pieces, self.encoder.encode_all(data) if len(data) >= 32 else [tuple(self.encoder.encode(piece)) for piece in data]))

    def of_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of distinct words."""
        cuts = {word: self.cut(word) for word in words}
        ids = self.of_pieces(dict.fromkeys(chain.from_iterable(cuts.values())))
        return {word: ids[cut[0]] if len(cut) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, cut))) for word, cut in cuts.items()}

    def looked_up(self, rows: list[list[str]], held: Remembered, make, fit=None) -> list[list[int] | None]:
        """Tokens of rows of parts; parts not held are made once and together. None for a row with a part that does not fit."""
        ids = dict.fromkeys(chain.from_iterable(rows))
        for part in ids:
            ids[part] = held.get(part)
        new = {part: held.before.get(part) for part, known in ids.items() if known is None}
        unfit = {part for part in new if not fit(part)} if fit else set()
        if unfit:
            rows = [row if unfit.isdisjoint(row) else None for row in rows]
        new |= make([part for part, known in new.items() if known is None and part not in unfit])
        for part in unfit:
            del new[part]
        held.keep(new)
        ids |= new
        return [None if row is None else list(chain.from_iterable(map(ids.__getitem__, row))) for row in rows]

    def runs(self, runs: Iterable[str]) -> list[list[int] | None]:
        """Tokens of runs of words, each behind a blank or line feed; None where other white space is among them."""
        return self.looked_up([run.replace("\n", " \n").split(" ")[1:] for run in runs], self.words, self.of_words, _WORD)

    def long_run(self, run: str) -> list[int] | None:
        """Tokens of a long run, which is cut before blanks."""
        out, start = [], 0
        while start < len(run):
            end = run.find(" ", start + self.LONG)
            end = len(run) if end < 0 else end
            ids = self.runs([run[start:end]])[0]
            if ids is None:
                return None
            out += ids
            start = end
        return out

    def encode(self, text: str) -> list[int]:
        """Tokens of one text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Tokens of some texts; what is not remembered is encoded once and together.

        A text is read as if it stood behind a line feed, whose one token then goes.
        """
        brief = iter(self.runs("\n" + text for text in texts if 0 < len(text) <= self.LONG))
        out = [self.long_run("\n" + text) if len(text) > self.LONG else next(brief) if text else [0] for text in texts]
        others = iter(self.looked_up([self.matches(text) for text, ids in zip(texts, out) if ids is None], self.pieces, self.of_pieces))
        return [next(others) if ids is None else ids[1:] for ids in out]

    def encode_in_groups(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Tokens of texts, one after another, for groups of bounded size; a null text counts as empty."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= self.LONG:
                yield from self.encode_all(group)
                group, size = [], 0
        yield from self.encode_all(group)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.feed_all(list(ids)) + self.decoder.finish()


_codecs: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, pattern: str) -> Codec:
    """The codec of this worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


@contextmanager
def uncollected():
    """Python's cycle collector rests: nothing here forms cycles, and it would walk all states and words held again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every whole text and the text decoded from them.

    ``path`` names a rank file that every executor has. A null text counts as empty; an empty text has no ids and
    decodes to the empty text. Rows are not grouped: repeated ids and null ids stay as they are.
    """

    def run(batches):
        import pyarrow as pa

        codec = codec_of(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                with uncollected():
                    ids = list(codec.encode_in_groups(part.column(1).to_pylist()))
                    texts = [codec.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, from the ids and texts of ``encode_documents``'s codec.

    The digests are taken where the ids are, as ids of a whole corpus are larger than its text.
    """

    def run(batches):
        import pyarrow as pa

        codec = codec_of(path, pattern)
        decoder, empty = codec.decoder, hashlib.sha256().hexdigest()
        digits = np.array([b"%d " % i for i in range(len(codec.encoder.length_of))])
        for batch in batches:
            counts, ids_sum, text_sum = [], [], []
            with uncollected():
                for ids in codec.encode_in_groups(value.as_py() for value in batch.column(1)):
                    counts.append(len(ids))
                    ids_sum.append(hashlib.sha256(digits[ids].tobytes().replace(b"\0", b"")[:-1]).hexdigest() if ids else empty)
                    own = hashlib.sha256()
                    for start in range(0, len(ids), 65_536):
                        own.update(decoder.feed_all(ids[start : start + 65_536]).encode())
                    own.update(decoder.finish().encode())
                    text_sum.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
