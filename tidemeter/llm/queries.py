"""The named queries of this package and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.llm import bpe, decontamination, language_model, linededup, neardup, packing, postings, quality, resampling, secrets, topk, urlgraph, whitening
from tidemeter.llm.common import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth embedding."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT vec_id AS query_id, unnest(range(1, 1 + len(e))) AS i, unnest(e) AS a FROM v WHERE vec_id % 50 = 0),
d AS (SELECT vec_id, unnest(range(1, 1 + len(e))) AS i, unnest(e) AS b FROM v),
s AS (
  SELECT query_id, vec_id, CAST(sum(a * b) AS BIGINT) AS score
  FROM q JOIN d USING (i) WHERE query_id <> vec_id GROUP BY query_id, vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op3_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the five nearest embeddings by cosine of every fiftieth; tested against brute force."""
    return postings.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document by the byte-level vocabulary; tested against the library."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; tested against a brute-force version."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingles overlap by three quarters; tested against brute force."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host trust for every page url."""
    return urlgraph.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def _ranks(seed: str, src: str, dst: str, rounds: int = 10) -> str:
    """Check SQL of the propagation: one written-out step per round."""
    steps = [f"{seed}_0 AS MATERIALIZED (SELECT host, {seed} AS rank FROM hosts)"]
    for i in range(1, rounds + 1):
        steps.append(f"""{seed}_{i} AS MATERIALIZED (
  SELECT h.host, 0.15 * h.{seed} + 0.85 * (coalesce(g.gain, 0) + CASE WHEN h.host IN (SELECT {src} FROM edges) THEN 0 ELSE r.rank END) AS rank
  FROM hosts h JOIN {seed}_{i - 1} r USING (host) LEFT JOIN (
    SELECT e.{dst} AS host, sum(x.rank * e.weight / t.total) AS gain
    FROM edges e JOIN {seed}_{i - 1} x ON x.host = e.{src}
    JOIN (SELECT {src} AS s, sum(weight) AS total FROM edges GROUP BY 1) t ON t.s = e.{src} GROUP BY 1
  ) g ON g.host = h.host)""")
    return ",\n".join(steps)


ORACLES["op6_link_graph_filter"] = f"""
WITH u AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(rule_verdict, rh, rp) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT h.host, h.path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rule_verdict, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM u) h JOIN rules ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp)
  GROUP BY h.host, h.path
), j AS (SELECT u.*, fit.rule, fit.v FROM u LEFT JOIN fit ON fit.host = u.host AND fit.path = u.path),
links AS (
  SELECT host AS src, unnest(list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1),
    lambda x: translate(regexp_extract(x, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS dst
  FROM u
), edges AS MATERIALIZED (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM links WHERE dst <> '' AND src <> '' AND src <> dst GROUP BY 1, 2
), hosts AS MATERIALIZED (
  SELECT host, avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM j GROUP BY 1
  UNION ALL SELECT DISTINCT dst, 0.0, 0.0 FROM edges WHERE dst NOT IN (SELECT host FROM j)
), {_ranks("allowed", "src", "dst")},
{_ranks("blocked", "dst", "src")}
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN host <> '' AND round(b.rank - a.rank, 9) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN allowed_10 a USING (host) JOIN blocked_10 b USING (host)
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than a tenth of their source's documents hold."""
    clean = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return clean.select("row.doc_id", "row.text", "n_lines", "n_dropped")


ORACLES["op9_line_dedup"] = """
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), t AS (SELECT host, count(*) AS pages FROM l GROUP BY 1),
h AS (
  SELECT host, line, count(*) AS holders
  FROM (SELECT host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM l) WHERE line <> '' GROUP BY 1, 2
), bad AS (
  SELECT host, list(line) AS bad FROM h JOIN t USING (host) WHERE holders >= 3 AND holders > pages * 0.1 GROUP BY 1
), k AS (
  SELECT doc_id, text, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' '))) END AS kept
  FROM l LEFT JOIN bad USING (host)
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
  CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(lines) - len(kept) AS INTEGER) AS n_dropped
FROM k
"""


@query
def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digests of the fixed patterns, and all spans with the added ones."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.col("shared").cast("long").alias("n_shared"),
    )


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Check SQL of one kind's spans: places from the lengths of matches and of what lies between."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {secrets.ORDER[kind]} AS kind_rank, place + gap AS start, place + gap + length(hit) AS stop, value
  FROM (
    SELECT doc_id, hit, value, length(gap) AS gap,
      coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM (
      SELECT doc_id, unnest(range(1, 1 + len(hits))) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap
      FROM (
        SELECT doc_id, regexp_extract_all(text, '{quoted}', 0) AS hits, regexp_extract_all(text, '{quoted}', {group}) AS vals,
          string_split_regex(text, '{quoted}') AS gaps
        FROM t
      ) WHERE len(hits) > 0
    )
  ) WHERE length(value) >= {least}"""


ORACLES["op10_secret_ownership"] = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_spans(*k) for k in secrets.KINDS)}),
token AS ({_spans(*secrets.TOKEN)} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
more AS (
  SELECT * FROM token x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.start < x.stop AND x.start < b.stop)
), owners AS (
  SELECT value, count(DISTINCT owner) > 2 AS copied FROM (SELECT * FROM base UNION ALL SELECT * FROM more) JOIN t USING (doc_id) GROUP BY value
), b AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_rank) AS spans, count(*) FILTER (copied) AS n_shared
  FROM base JOIN owners USING (value) GROUP BY doc_id
), a AS (SELECT * FROM more JOIN owners USING (value) WHERE NOT copied),
every AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_rank) AS spans, count(*) FILTER (kind = 'owner') AS n_added
  FROM (SELECT doc_id, kind, kind_rank, start, stop FROM base UNION ALL SELECT doc_id, kind, kind_rank, start, stop FROM a) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(n_shared, 0) AS n_shared
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN every USING (doc_id)
"""


@query
def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document by a bigram automaton; tested against a brute-force version."""
    return language_model.score_texts(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id")) == 1)


@query
def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learnt from four fifths of the labels; tested by held-out accuracy."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of(F.col("doc_id")) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score_quality(docs, model).select("row.doc_id", "score", "predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of every document, a quarter of the long enough ones drawn towards the benchmark texts."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, longest=2, least_words=20, percent=25, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: One table of the crc32, from its polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op11_importance_resampling"] = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED (
  SELECT doc_id, feature, count(*) AS n FROM (
    SELECT doc_id, unnest(w) AS feature FROM d
    UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
  ) GROUP BY ALL
), bf AS MATERIALIZED (
  SELECT feature, count(*) AS n FROM (
    SELECT unnest(w) AS feature FROM b
    UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b
  ) GROUP BY ALL
), f AS MATERIALIZED (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM df UNION SELECT feature FROM bf)),
g AS MATERIALIZED (
  SELECT feature, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 10000 AS bucket
  FROM f, crc
), s AS (SELECT bucket, sum(n) AS s FROM df JOIN g USING (feature) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN g USING (feature) GROUP BY 1),
every AS (SELECT (SELECT coalesce(sum(n), 0) FROM df) AS sa, (SELECT coalesce(sum(n), 0) FROM bf) AS ta),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)::DOUBLE / ((s + 1)::DOUBLE * (ta + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), every
), w AS (
  SELECT doc_id, sum(n) AS n, sum(n * gain) AS total FROM df JOIN g USING (feature) JOIN gain USING (bucket) GROUP BY 1
), x AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (doc_id)
), y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= 20),
q AS (SELECT count(*) * 25 // 100 AS most FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id), q
"""


@query
def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 whitened components; tested against a brute-force version."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


@query
def op13_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in ten-word windows of benchmark items, and these items."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op13_prefix_decontamination"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, 2 + greatest(len(w) - 10, 0))) AS i FROM b WHERE len(w) > 0)
), places AS MATERIALIZED (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, 2 + len(w) - size)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, run)),
words AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
