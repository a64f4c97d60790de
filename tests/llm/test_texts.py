"""Tokens, packing, language model, near duplicates and the classifier against brute force, and their edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemeter.llm import bpe, language_model, neardup, packing, quality

SCHEMA = "doc_id long, text string, source string, block int, score double, node long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = ["a", "b", " ", "é", "日", "\n", "'s", "1", "22", "!!", "the", " ", "😀", "\t", "A", "zz", "ing", " ", "=", "-", ".", ",", "\u0301", "\r", "Σ", "İ", "<|endoftext|>"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, 1, 0.5, 3) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_transducer_equals_the_library(library):
    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN, 500), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 25)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text
    for text in ("a" * 5000, " " * 3000 + "x", "=" * 3000, "ab" * 2000, "日" * 1000):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_transducer_with_few_states_and_streamed_decoding(library):
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), most_states=20)
    rng = random.Random(4)
    for _ in range(500):
        piece = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 90)))
        assert encoder.encode(piece.encode()) == library.encode_ordinary(piece)
    decoder = bpe.Utf8Decoder({0: b"\xf0", 1: b"\x9f\x98", 2: b"\x80a", 3: b"\xff"})
    assert list(decoder.stream([0, 1, 2])) == ["", "", "😀a", ""]
    assert "".join(decoder.stream([0, 1])) == "�"
    assert "".join(decoder.stream([3, 2])) == "��a"


def test_transducer_states_do_not_hold_the_tokens_before_them():
    encoder, rng = bpe.Encoder(bpe.read_ranks(RANKS)), random.Random(6)
    parts = ["an", "er", "th", "ing", "re", "ou", "ly", "bl", "sh", "wh"]
    pieces = ["".join(rng.choice(parts) for _ in range(rng.randint(4, 9))).encode() for _ in range(1500)]
    for piece in pieces + pieces + pieces:
        encoder.encode(piece)
    assert len({tuple(place[:2] for place in state) for state in encoder.states}) == len(encoder.states)


def test_word_and_mark_share_the_tokens_of_the_word(library):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    taken = []
    encode, codec.encoder.encode = codec.encoder.encode, lambda piece: taken.append(piece) or encode(piece)
    text = "x Tolyntan Tolyntan, Tolyntan. Tolyntan,"
    assert codec.encode(text) == library.encode_ordinary(text)
    assert taken.count(b" Tolyntan") == 1


def test_words_of_many_texts_are_walked_together(library, monkeypatch):
    encoder, rng = bpe.Encoder(bpe.read_ranks(RANKS), most_states=30), random.Random(7)
    pieces = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 90))).encode() for _ in range(800)]
    assert [list(ids) for ids in encoder.encode_all(pieces)] == [library._encode_single_piece(p) if p else [] for p in pieces]
    codec, alone = bpe.Codec(RANKS, public_tokenizers.PATTERN, 300), []
    monkeypatch.setattr(codec, "LONG", 400)
    encode, codec.encoder.encode = codec.encoder.encode, lambda piece: alone.append(piece) or encode(piece)
    words = ["".join(rng.choice(["an", "er", "th", "ing", "ou", "é", "'s", "日", "!", "7"]) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.choice([1, 40, 900]))) for _ in range(60)]
    texts += ["", None, "\n", " a", "a ", "a\nb \nc", "a\n\nb", "a\u00a0b c", *["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 500))) for _ in range(60)]]
    texts += [texts[0].replace(" ", "\n"), texts[2] + " ", "\n".join(texts[:3]), "a " * 500 + "\tb"]
    ids = list(codec.encode_in_groups(texts))
    assert ids == [library.encode_ordinary(t or "") for t in texts]
    assert [codec.decode(i) for i in ids] == [t or "" for t in texts]
    assert len(alone) < len(words) / 2


def test_digests_equal_the_library(spark, library):
    import hashlib

    texts = ["", None, "Hello world", "日本 é\n'tis 1234", "!" * 500, "\n\n x", "a"]
    rows = bpe.digests(frame(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    for text, row in zip(texts, sorted(rows, key=lambda r: r.doc_id)):
        ids = library.encode_ordinary(text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_collector_works_again_after_a_batch():
    import gc

    with pytest.raises(ValueError), bpe.uncollected():
        assert not gc.isenabled()
        raise ValueError
    assert gc.isenabled()


def test_encode_documents_edges(spark, library):
    texts = ["", None, "Hello world", "Hello world", "x " * 20000]
    rows = bpe.encode_documents(frame(spark, texts, [0, 1, 2, 2, None]), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(len(r.ids) for r in rows) == sorted(len(library.encode_ordinary(t or "")) for t in texts)
    assert sorted(r.decoded for r in rows) == sorted(t or "" for t in texts)
    assert bpe.encode_documents(frame(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []
    assert bpe.digests(frame(spark, ["", None]), RANKS, public_tokenizers.PATTERN).select("n_tokens").distinct().collect()[0][0] == 0


def test_word_tokenizer_equals_the_library():
    whole, own, rng = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS, 300), random.Random(3)
    pieces = [*LETTERS, "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert own.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def check_packing(pieces, texts, limit):
    tokenizer = packing.WordTokenizer(WORDS)
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
    want = []
    for i, text in texts:
        ids = np.append(np.frombuffer(tokenizer.encode(text or ""), "<u4"), np.uint32(0))
        want += [(i, n, s, len(ids[s : s + limit]), zlib.crc32(ids[s : s + limit].tobytes())) for n, s in enumerate(range(0, len(ids), limit))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces), key=key) == sorted(want, key=key)
    return len(by_sequence)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["cat", "tree", "of"]) for _ in range(rng.randint(0, 70)))) for i in range(600)]
    docs = frame(spark, [t for _, t in texts]).repartition(7)
    pieces = packing.pack_documents(docs, WORDS, limit=64, fan_in=2, task_items=50).collect()
    bins = check_packing(pieces, texts, 64)
    assert bins <= 1.05 * sum(p.length for p in pieces) / 64 + 1


def test_packing_edges(spark):
    rows = [(None, "one"), (1, None), (1, None), (2, ""), (3, "cat " * 500)]
    pieces = packing.pack_documents(frame(spark, [t for _, t in rows], [i for i, _ in rows]), WORDS, limit=100, keep_ids=True).collect()
    check_packing(pieces, rows, 100)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in pieces)
    assert packing.pack_documents(frame(spark, []), WORDS).collect() == []


def test_best_fit_takes_the_fullest_bin():
    assert sorted(map(sorted, packing.best_fit([6, 5, 4, 5], 10))) == [[0, 2], [1, 3]]
    assert packing.best_fit([], 10) == []


def brute_scores(texts, held, order, mu):
    words = [[w for w in (t or "").encode().lower().split()] + [None] for t in texts]
    counts, contexts = collections.Counter(), collections.Counter()
    for ws, h in zip(words, held):
        row = ["begin"] * (order - 1) + ws
        for j in range(order - 1, len(row)) if not h else ():
            for k in range(1, order + 1):
                counts[tuple(row[j - k + 1 : j + 1])] += 1
                contexts[tuple(row[j - k + 1 : j])] += 1
    total, types = contexts[()], sum(len(k) == 1 for k in counts)
    out = []
    for ws in words:
        row, base, score = ["begin"] * (order - 1) + ws, 0.0, 0.0
        for j in range(order - 1, len(row)):
            p = (counts[(row[j],)] + 0.5) / (total + 0.5 * (types + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                if c := contexts[tuple(row[j - k + 1 : j])]:
                    p = (counts[tuple(row[j - k + 1 : j + 1])] + mu * p) / (c + mu)
            score += math.log10(p)
        out.append((len(ws), sum(counts[(w,)] > 0 for w in ws), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_automaton_equals_the_recursion(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["a", "B", "b", "c", "dé", "X"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None, " \t ", "new words"]
    held = [i % 5 == 1 for i in range(len(texts))]
    found = language_model.score_texts(frame(spark, texts), F.col("doc_id") % 5 == 1, order=order, mu=3.0, block_bytes=500, range_grams=40)
    rows = {r.doc_id: r for r in found.collect()}
    for i, (n, known, total, base, score) in enumerate(brute_scores(texts, held, order, 3.0)):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert math.isclose(r.base_score, base, abs_tol=1e-9) and math.isclose(r.score, score, abs_tol=1e-9)


def test_language_model_edges(spark):
    assert language_model.score_texts(frame(spark, []), F.col("doc_id") == 1).collect() == []
    rows = language_model.score_texts(frame(spark, ["a b", "a b", None], [None, None, 1]), F.col("doc_id") == 1).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3]
    none = language_model.score_texts(frame(spark, ["a b"], [1]), F.col("doc_id") == 1).collect()[0]
    assert none.train_tokens == 0 and none.n_known == 0 and math.isfinite(none.score)


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = ["", None, " \n", "one two", "ONE two", "one  two three", "É a b c d e", "é a b c d e"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = [w if rng.random() > 0.02 else rng.choice(vocabulary) for w in base]
            texts.append(" ".join(copy if rng.random() < 0.7 else copy + passage))
    docs = frame(spark, texts).repartition(5)
    for settings in ({}, {"block_bytes": 3000, "range_grams": 50, "tile_nodes": 5, "tile_grams": 100}):
        found = neardup.near_duplicates(docs, **settings)
        assert sorted(map(tuple, found.collect())) == brute_classes(texts)


def test_near_duplicate_edges(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    long = " ".join(f"x{i}" for i in range(30000))
    rows = frame(spark, [long, long + " end", "a b c", "a b c", "a b c", None], [4, 3, 9, 8, 8, None])
    assert sorted(map(tuple, neardup.near_duplicates(rows).collect())) == [(3, 29997, 3), (4, 29996, 3), (8, 1, 8), (9, 1, 8)]


def labelled(spark, n):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["The", "quiet", "river.", "runs", "slowly,", "home"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "###", "$$$", "CHEAP!!", "|"]) for _ in range(40))
    texts = [good() if i % 4 else bad() for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)] + [(None, 1, 0), (n + 5, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    return texts, labels


def test_quality_on_held_out_rows(spark):
    texts, labels = labelled(spark, 200)
    docs = frame(spark, [*texts, "", None], [*range(200), 300, None])
    model = quality.fit(docs, labels, F.col("doc_id") % 5 != 0, per_label=40)
    rows = quality.score_quality(docs, model).select("row.doc_id", "row.score", F.col("score").alias("s"), "predicted").collect()
    assert len(rows) == 202 and all(0 <= r.s <= 1 and r.score == 0.5 for r in rows)
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in rows if r.doc_id is not None and r.doc_id < 200)
    assert {round(r.s, 6) for r in rows if r.doc_id in (300, None)} == {round(model.prior, 6)}


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(frame(spark, ["a"]), none, F.lit(True)) is None
    assert quality.score_quality(frame(spark, ["a"]), None).first().score == 0.5
    texts, labels = labelled(spark, 20)
    assert quality.score_quality(frame(spark, []), quality.fit(frame(spark, texts), labels, F.lit(True))).collect() == []


def test_components_of_random_graphs(spark):
    from tidemeter.llm.common import components

    rng = random.Random(9)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)] + [(5000 + i, 5001 + i) for i in range(400)] + [(9000, 9001 + i) for i in range(300)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    frame = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r.node: r.component for r in components(frame, "test-components").collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(frame.where("a < 0"), "test-components").collect() == []
