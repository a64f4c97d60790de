"""Documents that hold passages of benchmark items: a set join filtered by prefixes, checked word by word.

A window is a run of an item's words. It occurs in a document only if all its shingles do, so the shingle that the
fewest places of the documents hold is a sufficient prefix: documents meet a window by that shingle alone.
What meets must fit by length and place, and is then compared with the document's own words at that place.

Windows are taken in blocks of at most about ``BLOCK`` (dealt by a hash of the distinct windows), each of which is
broadcast; the documents' shingles never cross the network. Word positions are made by an explode whose rows
live within one stage of generated code.

Only the columns of id and text are read, so others may have any name. Null and empty texts have no words; items
without words have no windows. Rows that share an id are judged by their own texts; repeated rows all come back.
Repeated items count once by id; an item with a null id marks words but has no id to list. Empty tables give
no rows, or no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, once A-Z is lower-cased: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that are broadcast at once: some 30 MB.
BLOCK = 250_000


def plain_words(text: Column) -> Column:
    """The words of a text with one space between them; only A-Z is lower-cased. Texts in ASCII take the shorter way."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.trim(F.regexp_replace(lowered, BETWEEN, " ")), F.lit(""))


def word_count(plain: Column) -> Column:
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1)


def shingles(rows: DataFrame, size: int, *carried: str) -> DataFrame:
    """(carried, words, at, shingle): the key of ``size`` words at each of their places in ``plain``."""
    words = rows.where(F.col("n_words") >= size).withColumn("words", F.split("plain", " "))
    # the outer form keeps the optimizer from splitting the text once more for a filter on the number of places
    placed = words.select(*carried, "words", F.explode_outer(F.sequence(F.lit(0), F.col("n_words") - size)).alias("at"))
    key = F.xxhash64(*[F.get("words", F.col("at") + i) for i in range(size)])
    return placed.select(*carried, "words", "at", key.alias("shingle"))


def item_windows(items: DataFrame, length: int, id_column: str, text_column: str) -> DataFrame:
    """(item_id, plain, n_words): every run of ``length`` words, or the whole item if it is shorter."""
    plain = items.select(F.col(id_column).cast("string").alias("item_id"), plain_words(F.col(text_column)).alias("plain")).where("plain <> ''")
    words = plain.select("item_id", F.split("plain", " ").alias("words"))
    last = F.greatest(F.size("words") - length, F.lit(0))
    runs = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    run = runs.select("item_id", F.slice("words", F.col("at") + 1, F.lit(length)).alias("run"))
    return run.select("item_id", F.array_join("run", " ").alias("plain"), F.size("run").alias("n_words")).distinct()


def rarest(windows: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(plain, length, at, shingle): the rarest shingle of every window that can occur at all, and its place in it.

    A window with a shingle that no document holds is left out.
    """
    own = shingles(windows, size, "plain", "n_words").drop("words")
    wanted = F.broadcast(own.select("shingle").distinct())  # at most ten for each window of a block
    held = shingles(docs, size).join(wanted, "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("places"))
    found = own.join(held, "shingle").groupBy("plain", "n_words")
    best = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("places", "at", "shingle")).alias("best"))
    whole = best.where(F.col("n") == F.col("n_words") - size + 1)
    return whole.select("plain", F.col("n_words").alias("length"), "best.at", "best.shingle")


def occurrences(docs: DataFrame, prefixes: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, plain, start, stop): every place of a document where a window stands, word by word."""
    prefix = F.broadcast(prefixes.select("plain", "length", F.col("at").alias("inside"), "shingle"))
    met = shingles(docs, size, "doc_id", "text_key", "n_words").join(prefix, "shingle")
    start = F.col("at") - F.col("inside")
    fits = met.where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    same = F.array_join(F.slice("words", start + 1, F.col("length")), " ") == F.col("plain")
    return fits.where(same).select("doc_id", "text_key", "plain", start.alias("start"), (start + F.col("length")).alias("stop"))


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_hit): words inside any occurrence, from the occurrences in order of their start."""
    spans = found.groupBy("doc_id", "text_key", "start").agg(F.max("stop").alias("stop"))
    ahead = Window.partitionBy("doc_id", "text_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("seen", F.coalesce(F.max("stop").over(ahead), F.lit(0)))
    length = F.greatest(F.col("stop") - F.greatest("start", "seen"), F.lit(0))
    return new.groupBy("doc_id", "text_key").agg(F.sum(length).cast("long").alias("n_hit"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    length: int = 10,
    shingle: int = 5,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items): words of every document, those inside windows of items, and the sorted ids of these items as text."""
    doc_id, text = F.col(id_column), F.col(text_column)
    plain = docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_key"), plain_words(text).alias("plain"))
    plain = stored(plain.withColumn("n_words", word_count(F.col("plain"))), "decontamination-docs")
    own = stored(item_windows(items, length, item_column, "text"), "decontamination-items")
    blocks = -(-max(1, own.select("plain").distinct().count()) // block)
    distinct = own.select("plain", "n_words").distinct().withColumn("block", F.pmod(F.xxhash64("plain"), F.lit(blocks)))
    parts = []
    for number in range(blocks):
        windows = distinct.where(F.col("block") == number)
        sizes = [r[0] for r in windows.select(F.least("n_words", F.lit(shingle))).distinct().collect()]  # 1 to ``shingle``
        for size in sizes:
            of_size = windows.where(F.least("n_words", F.lit(shingle)) == size)
            prefixes = stored(rarest(of_size, plain, size), "decontamination-prefixes")
            parts.append(stored(occurrences(plain, prefixes, size), "decontamination-places"))
    key = ["doc_id", "text_key"]
    if not parts:
        nothing = plain.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"))
        return nothing.withColumn("items", F.array().cast("array<string>"))
    found = reduce(DataFrame.unionByName, parts)
    listed = own.where("item_id IS NOT NULL").select("item_id", "plain")
    named = found.select(*key, "plain").distinct().join(listed, "plain").select(*key, "item_id").distinct()
    lists = named.groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    hits = covered(found).alias("h").join(lists.alias("l"), _same("h", "l"), "left").select("h.*", "l.items")
    joined = plain.select(*key, "n_words").alias("d").join(hits.alias("h"), _same("d", "h"), "left")
    return joined.select(
        "d.doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_key") == F.col(f"{right}.text_key"))
