"""Line, secret and url operators: edge cases, and the pipeline's stages."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from tests.test_oracles import TABLES, assert_same
from tidemeter.llm import linededup, secrets, urlgraph
from tidemeter.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, lines int, pages int, key long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, 1, 2, 3) for i, t, s in rows], SCHEMA)


def test_lines_above_the_ratio_go(spark):
    rows = [(i, f"Menu \nown line {i}\n\n Menu", "a") for i in range(5)] + [(9, "Menu\nx", "b"), (10, None, "a"), (11, "", None), (None, "Menu", "a")]
    out = {r.row.doc_id: r for r in linededup.drop_boilerplate(frame(spark, rows), ratio=0.5).collect()}
    assert out[0].row.text == "own line 0\n" and (out[0].n_lines, out[0].n_dropped) == (4, 2)
    assert out[9].row.text == "Menu\nx" and out[10].row.text is None and out[11].row.text == "" and out[None].row.text == ""
    assert out[3].row.pages == 2 and linededup.drop_boilerplate(frame(spark, [])).collect() == []


def test_pipeline_drops_planted_passages_and_keeps_copies(spark):
    passage, copied = " ".join(f"planted{i}" for i in range(80)), " ".join(f"copied{i}" for i in range(80))
    rows = [(i, f"own line {i}" + (f"\n{passage}\nMIT License" if i % 100 == 0 else ""), "hot") for i in range(2000)]
    rows += [(5000 + i, f"{copied}\nend of copy", "hot") for i in range(300)] + [(6000 + i, f"pair\nrest {i}", "small") for i in range(2)]
    lines = corpus_pipeline.drop_lines(spark, frame(spark, rows), SF)
    out = {r.doc_id: r.text for r in lines.collect()}
    assert len(out) == len(rows) and [i for i in range(2000) if out[i] != f"own line {i}"] == []
    assert {out[5000 + i] for i in range(300)} == {f"{copied}\nend of copy"} and out[6001] == "pair\nrest 1"


def spans(spark, texts, sources=None):
    docs = frame(spark, [(i, t, (sources or "abcdefgh")[i % 8]) for i, t in enumerate(texts)])
    rows = secrets.find_secrets(docs).select("doc_id", secrets.joined(F.col("base")).alias("b"), secrets.joined(F.col("added")).alias("a"), "shared")
    return {r.doc_id: (r.b, r.a, r.shared) for r in rows.collect()}


def test_secret_spans_by_hand(spark):
    texts = [
        "é😀 password=abcdefghijkl!",
        "secret=token: abcdefghijklmnop",
        "PassWord: 'abcdefghijklm' AKIAABCDEFGHIJKLMN AKIASHORT",
        "0123456789abcdef0 api-key=x apikey=0123456789abcdef",
        None,
        "",
        "Zm9vYmFyYmF6cXV4MTIzNDU2 tail",
        "ſecret=abcdefghijklmnop to" + "ken=abcdefghijkl" * 2,
    ]
    out = spans(spark, texts)
    assert out[0] == ("assign:3:24", "", 0)
    assert out[1][0] == ""
    assert out[2][0] == "assign:0:24,access:26:44"
    assert out[3][0] == "hex:0:17,assign:28:51,hex:35:51"
    assert out[4] == out[5] == ("", "", 0)
    assert out[6] == ("", "owner:0:24", 0)
    assert out[7][0] == "assign:24:58"  # the value runs over the second "ken=" too


def test_widely_copied_values_are_no_owners_secret(spark):
    example, own = "Zm9vYmFyYmF6cXV4MTIzNDU2", "QWxhZGRpbjpvcGVuIHNlc2FtZTEy"
    texts = [f"use {example} here" for _ in range(6)] + [f"use {own} here", f"password={example}"]
    out = spans(spark, texts)
    assert all(out[i][1] == "" for i in range(6)) and out[6][1] == "owner:4:32"
    assert out[7] == ("assign:0:33", "", 1)
    assert secrets.find_secrets(frame(spark, [])).collect() == []


def test_a_value_in_many_unlike_documents_of_one_owner_is_copied(spark):
    example, live, other = "Zm9vYmFyYmF6cXV4MTIzNDU2", "QWxhZGRpbjpvcGVuIHNlc2FtZTEy", "c2VjcmV0b2ZvbmVvd25lcjE3"
    words = lambda s, n: [f"{s}{n}x{j}" for j in range(30)]
    near = lambda n: " ".join(w if j != n % 30 else f"new{n}" for j, w in enumerate(words("b", 0)))
    texts = [f"{' '.join(words('a', i))} use {example} here" for i in range(60)]  # one owner, unlike documents: an example
    texts += [f"{near(i)} use {live} here" for i in range(60)]  # one owner, near copies of one document: live
    texts += [f"{' '.join(words('c', i))} use {other} here" for i in range(4)]  # one owner, few documents: live
    texts += [f"{' '.join(words('d', 0))} password=abcdefgh1jklmnop"]
    docs = frame(spark, [(i, t, "hot") for i, t in enumerate(texts)])
    assert docs.where("doc_id = 0").select(F.size(F.array_distinct(secrets.sketch_of(F.col("text"))))).first()[0] == secrets.SKETCHES
    out = {r.doc_id: len(r.added) for r in secrets.find_secrets(docs).collect()}
    assert [out[i] for i in range(60)] == [0] * 60 and [out[i] for i in range(60, 125)] == [1] * 64 + [0]
    clean = {r.row.doc_id: r.row.text for r in secrets.redact(docs).collect()}
    assert clean[0] == texts[0] and live not in clean[70] and other not in clean[121] and clean[124].endswith(" [SECRET]")


def test_redaction_merges_overlaps(spark):
    rows = [(1, "é apikey=0123456789abcdef end", "s"), (1, "é apikey=0123456789abcdef end", "s"), (None, None, None), (2, "clean", "s")]
    out = [r.row.text for r in secrets.redact(frame(spark, rows)).collect()]
    assert sorted(map(str, out)) == ["None", "clean", "é [SECRET] end", "é [SECRET] end"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1.0) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, rule double")


def test_rules_and_parts_of_urls(spark):
    rows = [
        ("HTTP://Sub.Example.COM/en/x?q#f", None), ("http://www.example.com/en/a", ""), ("http://example.com?x", None), ("//example.com/en/", None),
        (None, None), ("http://a.net/es/1", None), ("http://xnet/es/1", None), ("http://ÉA.net/fr/#x", None), ("a://b://c/d", None), ("http://", None),
    ]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.judge(pages(spark, rows)).collect()}
    assert out == {
        0: ("sub.example.com", "/en/x", "example.com/en/", "block"), 1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        2: ("example.com", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("a.net", "/es/1", "net/es/", "block"),
        6: ("xnet", "/es/1", None, "allow"), 7: ("Éa.net", "/fr/", "net/fr/", "block"), 8: ("b:", "//c/d", None, "allow"), 9: ("", "", None, "allow"),
    }
    assert urlgraph.judge(pages(spark, [])).collect() == []


def test_trust_follows_links_and_distrust_goes_back(spark):
    to = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [("http://bad.net/es/1", to("other.org")), ("http://farm.org/a", to("bad.net", "bad.net")), ("http://good.com/a", to("friend.org")), ("http://friend.org/a", '<a href="/local">'), ("http://lone.org/", None)]
    out = {r.host: r for r in urlgraph.judge(pages(spark, rows)).collect()}
    assert out["farm.org"].verdict == "block" and out["farm.org"].distrust > 0.5
    assert out["friend.org"].verdict == "allow" and out["friend.org"].trust > 0.5
    assert out["lone.org"].verdict == "allow" and out["lone.org"].trust == 0
    n = 10  # by hand: a host without links keeps rank, one link passes all of it on
    trust = 0.0
    for _ in range(n):
        trust = 0.85 * (trust + (1.0 if _ == 0 else 0.15))
    assert out["friend.org"].trust == pytest.approx(trust)


def test_link_graph_sql_with_links(spark):
    import duckdb

    hosts = [f"{'abcdefg'[i]}.{t}" for i, t in enumerate(["com", "net", "org", "net", "org", "com", "org"])]
    rows = [(f"http://{h}/{['en', 'es', 'x'][j % 3]}/{j}", "".join(f"<a href='http://{hosts[(i * 3 + j * 5 + k) % 7]}/q'>" for k in range(j % 3))) for i, h in enumerate(hosts) for j in range(9)]
    data = pages(spark, rows).select("page_id", "url", "html")
    con = duckdb.connect()
    con.register("pages", data.toArrow())
    expected = con.execute(ORACLES["op6_link_graph_filter"]).to_arrow_table()
    assert_same(urlgraph.judge(data).drop("trust", "distrust").toArrow(), expected)


def test_registered(spark):
    assert set(QUERIES) <= set(entry_module.queries()) and "pipeline" in entry_module.queries()
    assert set(ORACLES) <= set(QUERIES) and set(TABLES)


def test_unlike_texts_of_one_id_all_stay(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(1, words("a"), "s"), (1, words("b"), "s"), (1, words("b"), "s"), (2, words("b") + " more", "s"), (2, words("c"), "s"), (3, "", "s"), (3, None, "s")]
    kept = [(r.doc_id, (r.text or "")[:2]) for r in corpus_pipeline.keep_first_copies(spark, frame(spark, rows), SF).collect()]
    assert sorted(kept) == [(1, "a0"), (1, "b0"), (2, "c0"), (3, "")]


def test_pipeline_stages(spark):
    key = "password=abcdefghijklmnop"
    words = lambda n, s: " ".join(f"{s}{n}x{i}" for i in range(60))
    rows = [(i, f"Home\n{words(i * 31, 'w')}", "s") for i in range(6)] + [(7, f"Home\n{words(0, 'w')} more", "s"), (8, f"own {key}", "s"), (9, "", "t"), (10, None, None), (None, "", "s"), (3, f"Home\n{words(93, 'w')}", "s")]
    docs = frame(spark, rows)
    names = docs.columns
    lines = corpus_pipeline.drop_lines(spark, docs, SF)
    assert lines.columns == names and lines.where("text LIKE 'Home%'").count() == 0 and lines.count() == len(rows)
    kept = corpus_pipeline.keep_first_copies(spark, lines, SF)
    assert kept.columns == names and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(6), 8, 9, 10, None], key=str)
    masked = corpus_pipeline.mask_secrets(spark, kept, SF)
    row = masked.where("doc_id = 8").first()
    assert masked.columns == names and row.text == "own [SECRET]" and row.n_chars == 12
    packed = corpus_pipeline.pack(spark, masked, SF)
    assert sorted((r.doc_id for r in packed.collect()), key=str) == sorted([*range(6), 8, 9, 10, None], key=str)
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_pipeline_keeps_good_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    good = docs.join(labels, "doc_id", "left_semi").count()
    assert kept.columns == docs.columns and kept.join(labels, "doc_id", "left_semi").count() >= 0.97 * good
