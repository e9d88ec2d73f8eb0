"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``WINDOW`` words (one window, if it is shorter). A document that
contains a window contains all its shingles of ``SHINGLE`` words, so one necessary shingle per
window suffices as the join key: the one that is rarest in the documents, counted over all of them. A place of this
shingle in a document fixes where the window would have to start; it must start and end inside the
document (length and position bounds), and then the words there are compared with the window's.

The benchmark is small beside the documents. Its shingles and windows are broadcast if a count shows
at most ``BROADCAST_WINDOWS`` of them; beyond that the same joins run by shuffle on (shingle), with
document positions only, and the texts come back by key for the comparison.

Null and empty texts have no words. Rows that repeat (id and text) give repeated results. Items with the
same id count once; a null item id is left out of the list of items, and its windows still hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protoscan.llm.common import materialise, with_key

WINDOW = 10
SHINGLE = 3
BROADCAST_WINDOWS = 200_000

#: ASCII other than digits and letters; letters of either case are words here, since words are lower-cased one by one.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """The words of a text, in their own case."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS), "")


def folded(text: Column) -> Column:
    """ASCII letters in lower case."""
    return F.translate(text, UPPER, LOWER)


def _key(list_: str, at: str, n: int) -> Column:
    """A hash of ``n`` words from 0-based ``at``. Full lower case is coarser than the comparison's, so nothing is missed."""
    return F.expr(f"xxhash64({', '.join(f'lower(get({list_}, {at} + {i}))' for i in range(n))})")


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct window text and shingle in it: window, size, items, shingle (words), offset, key."""
    found = items.select(F.col(item).cast("string").alias("item"), words(text).alias("w")).where("size(w) > 0")
    starts = found.select("item", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")).alias("start"))
    cut = starts.select("item", F.slice("w", F.col("start") + 1, window).alias("w"))
    texts = cut.select(folded(F.array_join("w", " ")).alias("window"), F.size("w").alias("size"), "item")
    whole = texts.groupBy("window", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))
    each = whole.withColumn("w", F.split("window", " ")).withColumn("shingle", F.least(F.lit(shingle), "size"))
    each = each.select("*", F.explode(F.expr("sequence(0, size - shingle)")).alias("offset"))
    keys = [F.when(F.col("shingle") == n, _key("w", "offset", n)) for n in range(1, shingle + 1)]
    return each.select("window", "size", "items", "shingle", "offset", F.coalesce(*keys).alias("key"))


def _places(documents: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per position and shingle length: the columns of ``documents``, at, shingle, key."""
    each = documents.select("*", F.explode(F.expr("sequence(0, size(w) - 1)")).alias("at"))
    parts = [each.select("*", F.lit(n).alias("shingle"), _key("w", "at", n).alias("key")).where(F.expr(f"at + {n} <= size(w)")) for n in lengths]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def hits(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_column: str = "doc_id") -> DataFrame:
    """(id, text_key, start, size, items): every place where a window occurs."""
    parts = materialise(item_windows(items, window, shingle))
    counted = parts.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("shingle")).alias("lengths")).first()
    small = counted["n"] <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    keyed = with_key(documents, id_column).select(id_column, "text_key", words("text").alias("w")).where("size(w) > 0")
    lengths = counted["lengths"] or [shingle]

    frequency = _places(keyed, lengths).select("shingle", "key").join(hint(parts.select("shingle", "key").distinct()), ["shingle", "key"]).groupBy("shingle", "key").count()
    order = F.struct(F.coalesce("count", F.lit(0)).alias("n"), "offset", "key")
    best = parts.join(frequency, ["shingle", "key"], "left").groupBy("window", "size", "shingle").agg(F.first("items").alias("items"), F.min(order).alias("b"))
    prefix = materialise(best.where("b.n > 0").select("window", "size", "shingle", "items", F.col("b.offset").alias("offset"), F.col("b.key").alias("key")))

    inside = "at >= offset and at - offset + size <= n_words"
    same = folded(F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " ")) == F.col("window")
    if small:
        found = _places(keyed.withColumn("n_words", F.size("w")), lengths).join(F.broadcast(prefix), ["shingle", "key"]).where(inside)
        found = found.withColumn("start", F.expr("at - offset"))
    else:
        places = _places(keyed.withColumn("n_words", F.size("w")), lengths).select(id_column, "text_key", "n_words", "at", "shingle", "key")
        near = places.join(prefix, ["shingle", "key"]).where(inside).select(id_column, "text_key", F.expr("at - offset").alias("start"), "size", "window", "items").distinct()
        near = near.withColumnRenamed(id_column, "_id")
        found = near.join(keyed.dropDuplicates([id_column, "text_key"]), F.col("_id").eqNullSafe(F.col(id_column)) & (near["text_key"] == keyed["text_key"])).drop(near["text_key"])
    return found.where(same).select(id_column, "text_key", "start", "size", "items").distinct()


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, n_words, n_hit (words inside an occurring window), item_ids (sorted as strings), contaminated."""
    found = materialise(hits(documents, items, window, shingle, id_column))
    spans = found.groupBy(id_column, "text_key", "start").agg(F.max("size").alias("size"))
    by_doc = "partition by `{0}`, text_key order by start rows between unbounded preceding and 1 preceding".format(id_column)
    spans = spans.withColumn("seen", F.expr(f"coalesce(max(start + size) over ({by_doc}), 0)"))
    n_hit = spans.groupBy(id_column, "text_key").agg(F.sum(F.expr("greatest(start + size - greatest(start, seen), 0)")).alias("n_hit"))
    names = found.select(id_column, "text_key", F.explode("items").alias("item")).distinct()
    names = names.groupBy(id_column, "text_key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    per = n_hit.join(names.withColumnRenamed(id_column, "_n").withColumnRenamed("text_key", "_k"), F.expr(f"`{id_column}` <=> _n and text_key = _k"), "left")
    per = per.select(F.col(id_column).alias("_id"), F.col("text_key").alias("_key"), "n_hit", "item_ids")
    every = with_key(documents, id_column).select(id_column, "text_key", F.size(words("text")).cast("long").alias("n_words"))
    joined = every.join(per, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select(
        id_column, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
