"""Secrets in texts, with DataFrame functions only; corpus-wide ownership tells live-looking ones from examples.

Fixed patterns give the base spans. Every other long token of letters and digits is a candidate. Candidates are
aggregated over the corpus by the hash of their value: by distinct repositories and by distinct owners. A value that
many owners have, or that stands in many unlike repositories of each of its owners, is a widely copied example; any
other looks live, and its spans are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import stored


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed patterns: kind, pattern, group of the value, least length of the value.
KINDS = (
    (
        "assign",
        "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Further candidates: long tokens with letters and digits.
TOKEN = ("owner", "[A-Za-z0-9+/_=-]{20,}", 0, 20)
ORDER = {"assign": 0, "access": 1, "hex": 2, "owner": 3}

#: Min-hashes of a text. Two near copies that share a part J of their shingles differ in all of them at (1 - J) to this power.
SKETCHES = 8

SPAN = "struct<start: int, rank: int, kind: string, end: int, value: bigint>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def spans_of(frame: DataFrame, text: str, kind: str, pattern: str, group: int, least: int, out: str) -> DataFrame:
    """Adds the spans of one kind: code points from the lengths of the matches and of the texts between them."""
    frame = frame.withColumn("__all", _matches(F.col(text), pattern, 0))
    value = _matches(F.col(text), pattern, group) if group else F.col("__all")
    between = F.slice(F.split(F.col(text), pattern, -1), 1, F.size("__all"))
    found = F.arrays_zip(between.alias("gap"), F.col("__all").alias("hit"), value.alias("value"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        own = F.struct(
            start.alias("start"), F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(x["value"]).alias("value")
        )
        keep = F.length(x["value"]) >= least
        if kind == "owner":
            keep = keep & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], F.array(own))).otherwise(state["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
    spans = F.when(F.size("__all") == 0, none).otherwise(F.aggregate(found, begin, add)["out"])
    return frame.withColumn(out, spans).drop("__all")


def sketch_of(text: Column) -> Column:
    """Min-hashes of the runs of three words, so that near copies have some in common."""
    words = F.split(text, "\\s+")
    runs = F.transform(F.arrays_zip(words, F.slice(words, 2, F.size(words)), F.slice(words, 3, F.size(words))), lambda x: F.xxhash64(x))

    def least(keys: Column, n: int) -> Column:
        return F.array_min(F.transform(keys, lambda x: F.xxhash64(x, F.lit(n))))

    return F.element_at(F.transform(F.array(runs), lambda keys: F.array(*[least(keys, n) for n in range(SKETCHES)])), 1)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, key, owner, repository, base, more, sketch): base spans of every row, and candidates that overlap none of them.

    ``sketch`` is null where a row has neither.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    names = []
    for kind, pattern, group, least in (*KINDS, TOKEN):
        rows = spans_of(rows, "text", kind, pattern, group, least, f"__{kind}")
        names.append(f"__{kind}")
    base = F.array_sort(F.concat(*names[:-1]))
    more = F.filter("__owner", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    rows = rows.withColumn("base", base)
    rows = rows.withColumn("more", more)
    sketch = F.when(F.size("base") + F.size("more") > 0, sketch_of(F.col("text")))
    return rows.select("doc_id", "key", "owner", "repository", "base", "more", sketch.alias("sketch"))


def ownership(scanned: DataFrame) -> DataFrame:
    """(value, repositories, owners, unlike) of every candidate value in the corpus.

    ``unlike`` are the repositories whose text has no min-hash in common with another of the value and owner; all the
    others of an owner, near copies, count as one. Pairs are made distinct before they are counted, so a value that
    everybody has meets in small partial sums.
    """
    every = scanned.where(F.size("base") + F.size("more") > 0).select(
        F.explode(F.transform(F.concat("base", "more"), lambda x: x["value"])).alias("value"), "owner", "repository", "sketch"
    )
    pairs = every.groupBy("value", "owner", "repository").agg(F.min("sketch").alias("sketch"))
    hashes = pairs.select("value", "owner", "repository", F.posexplode("sketch").alias("n", "least"))
    held = hashes.groupBy("value", "owner", "n", "least").agg(F.count("*").alias("holders"), F.min("repository").alias("repository"))
    own = F.count_if(F.col("holders") == 1)
    by_repository = held.groupBy("value", "owner", "repository").agg((own == SKETCHES).alias("alone"))
    alone = by_repository.groupBy("value", "owner").agg(F.count_if("alone").alias("alone"))
    by_owner = pairs.groupBy("value", "owner").agg(F.count("*").alias("n")).join(alone, ["value", "owner"])
    unlike = F.col("alone") + (F.col("n") > F.col("alone")).cast("int")
    return by_owner.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"), F.sum(unlike).alias("unlike"))


def find_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    most_owners: int = 2,
    most_repositories: int = 10,
) -> DataFrame:
    """(doc_id, key, base, added, shared): spans of every row.

    ``base`` are the spans of the fixed patterns, ``added`` the candidates whose value is not copied, ``shared`` the
    number of base spans whose value is (copied examples; they stay). A value is copied if more than ``most_owners``
    owners have it, or if it has more than ``most_repositories`` unlike repositories for each owner. Spans are
    (start, rank, kind, end, value), in order, in code points. ``key`` is a hash of id and text, which equal rows share.
    A null text counts as empty, a null owner or repository as one of that name. Every row is returned.
    """
    scanned = stored(scan(docs, doc_id, text, owner, repository), "secret-scan")
    owners = ownership(scanned).select(
        "value", ((F.col("owners") > most_owners) | (F.col("unlike") > F.col("owners") * most_repositories)).alias("copied")
    )
    marked = (
        scanned.where(F.size("base") + F.size("more") > 0)
        .select("key", F.explode(F.concat("base", "more")).alias("span"))
        .distinct()
        .select("key", "span", F.col("span.value").alias("value"))
        .join(owners, "value")
        .groupBy("key")
        .agg(
            F.array_sort(F.collect_list(F.when((F.col("span.kind") == "owner") & ~F.col("copied"), F.col("span")))).alias("added"),
            F.count_if((F.col("span.kind") != "owner") & F.col("copied")).alias("shared"),
        )
    )
    none = F.array().cast(f"array<{SPAN}>")
    return scanned.join(marked, "key", "left").select(
        "doc_id", "key", "base", F.coalesce("added", none).alias("added"), F.coalesce("shared", F.lit(0)).alias("shared")
    )


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", mask: str = "[SECRET]", most_owners: int = 2) -> DataFrame:
    """``row`` (all columns of ``docs``) with every base and added span of ``text`` replaced by ``mask``; overlapping spans are one.

    The fixed patterns are masked whether copied or not; of the other candidates only those that are not copied.
    """
    found = find_secrets(docs, doc_id, text, owner, doc_id, most_owners)
    spans = F.array_sort(F.concat("base", "added"))
    hit = found.where(F.size(spans) > 0).select("key", spans.alias("spans")).dropDuplicates(["key"])
    hit = stored(hit, "secret-spans").select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    whole = whole.withColumn("__key", F.xxhash64(F.col("row")[doc_id], F.col("row")[text])).join(hit, "__key", "left")
    source = F.col("row")[text]

    def add(state: Column, x: Column) -> Column:
        apart = x["start"] >= state["at"]
        piece = F.concat(F.substring(source, state["at"] + 1, x["start"] - state["at"]), F.lit(mask))
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(source, state["at"] + 1, F.length(source)))
    clean = F.when(F.col("__spans").isNull() | source.isNull(), source).otherwise(F.aggregate("__spans", begin, add, rest))
    return whole.select(F.col("row").withField(text, clean).alias("row"))
