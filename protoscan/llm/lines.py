"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its shingles of ``SHINGLE`` lower-cased words (a shorter line is one shingle). Every
line goes whose Jaccard similarity with an earlier line, kept or not, is at least 4/5; earlier means a smaller
(doc_id, line number). Steps:

1. The sieve. Shingles are ordered by the hash of their first word, and of each line only those of its first
   ``p div 5 + SHARED`` distinct first words are made (p: places of a shingle). They hold the first ``n div 5 + SHARED`` of its n
   shingles, of which ``n div 5`` at most are missing from a similar line; so similar lines have the first ``SHARED`` of all that
   they share in both. A line of which fewer are found in lines of other words is similar to none of these.
2. Lines of equal words go but for the earliest. The lines that the sieve leaves are read from the texts again, one of each
   wording, now with all their shingles.
3. Shingles are ordered anew: a long is the frequency class of a shingle's hash bucket (``BUCKETS``, a table of fixed
   size, a literal in the plans) above 57 bits of hash, so the natural order of the longs puts rare ones first. The prefix of
   a set, the first ``n - ceil(4n/5) + 1`` shingles, must meet the prefix of any match.
4. Shingles that are in one prefix only are left out. Each line is first compared with the earliest line of
   each of its shingles, which settles families of near copies in linear work; only lines that
   stay unsettled meet the whole lists. A pair is met only if lengths fit and enough places are left behind the shingle in both lines; at a shingle
   of more than ``HOT`` lines it is met once only, at the first that both prefixes have, and if the prefixes share enough
   (``ONCE``). Then whole sets are compared.

Shingles are compared by a 57-bit hash, lines of equal words by 128 bits.

Null texts have no lines. Lines without a word (blank lines) always stay. Documents with a null id come after all others.
Rows with equal id and text are one document: they get the same result. Documents of equal id (or none) and different texts
are ordered by the hash of their texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from protoscan.llm.common import columns, materialise, others, with_key
from protoscan.operators.bounded import broadcast_if_small

SHINGLE = 5
BUCKETS = 1 << 17
BROADCAST_ROWS = 2_000_000
#: A shingle in the prefixes of more lines than this brings their prefixes along; with fewer, the pairs are few either way.
HOT = 16
#: So many shingles of the sieve a line has in common with a similar one, or all that were made; 5 at most, since up to four shingles are equal as a whole.
SHARED = 3
HASH = (1 << 57) - 1

#: What names a line.
PLACE = ["doc_id", "text_key", "line_no"]
#: Orders lines; a null id sorts last.
LINE = "named_struct('last', doc_id is null, 'doc_id', doc_id, 'text_key', text_key, 'line_no', line_no)"
#: What the first common shingle of a similar pair fulfils: fitting lengths, and enough places left behind it in both lines.
BOUNDS = "4 * m <= 5 * n and 4 * n <= 5 * m and 9 * least(n - pos, m - pos2) >= 4 * (n + m)"
#: A pair is met at the first shingle that both prefixes have. All that the lines share lies in both prefixes or behind the
#: prefix that ends first, so the shingles counted in the prefixes bound what they can have in common.
ONCE = """array_min(array_intersect(prefix, prefix2)) = token
    and 9 * (size(array_intersect(prefix, prefix2)) + if(element_at(prefix, -1) <= element_at(prefix2, -1), n - size(prefix), m - size(prefix2))) >= 4 * (n + m)"""


def line_words(documents: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, line_no, w): the lower-cased words of every line that has some; ``only``: of these lines, with their lid.

    Blanks other than the space are rare: they become spaces first, and lines are then cut at a single character.
    """
    blank = F.col("low").contains("\t") | F.col("low").contains("\x0b") | F.col("low").contains("\x0c") | F.col("low").contains("\r")
    low = with_key(documents).select("doc_id", "text_key", F.lower("text").alias("low"))
    low = low.select("doc_id", "text_key", F.when(blank, F.translate("low", "\t\x0b\x0c\r", "    ")).otherwise(F.col("low")).alias("low"))
    each = low.select("doc_id", "text_key", F.posexplode(F.split("low", "\n")).alias("line_no", "line"))
    if only is not None:
        each = each.join(broadcast_if_small(only, BROADCAST_ROWS), F.expr("doc_id <=> only_id and text_key = only_key and line_no = only_no"))
    return each.where("trim(line) <> ''").select(*(PLACE if only is None else ["lid"]), F.array_remove(F.split("line", " "), "").alias("w"))


def sieved(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, line_no, s1, s2, tokens): a hash of the words of every line that has some, and its shingles of the sieve."""
    keyed = line_words(documents).select(*PLACE, "w", F.expr("transform(w, x -> xxhash64(x))").alias("k"))
    keyed = keyed.select("*", F.expr("xxhash64(k)").alias("s1"), F.expr("xxhash64(7, k)").alias("s2"), F.expr(f"greatest(size(k) - {shingle - 1}, 1)").alias("p"))
    bound = keyed.withColumn("firsts", F.expr("sort_array(array_distinct(slice(k, 1, p)))")).withColumn("bound", F.expr(f"element_at(firsts, cast(least(p div 5 + {SHARED}, size(firsts)) as int))"))
    # where an equal word comes last, all of its places count, so that the shingles are the first of an order that all lines have
    at = bound.select(*PLACE, "s1", "s2", "w", F.expr("filter(sequence(0, p - 1), i -> k[i] <= bound)").alias("at"))
    return at.select(*PLACE, "s1", "s2", F.expr(f"array_distinct(transform(at, i -> xxhash64(slice(w, i + 1, {shingle}))))").alias("tokens"))


def line_sets(documents: DataFrame, only: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(lid, t): the distinct shingles of the lines ``only`` (lid, only_id, only_key, only_no)."""
    places = f"sequence(1, greatest(size(w) - {shingle - 1}, 1))"
    each = line_words(documents, only).select("lid", F.expr(f"array_distinct(transform({places}, i -> xxhash64(slice(w, i, {shingle})) & {HASH}L))").alias("t"))
    return each.dropDuplicates(["lid"])


def rarity(sets: DataFrame) -> Column:
    """A literal of ``BUCKETS`` characters: 48 plus twice the binary logarithm of the shingles of a hash bucket in all sets."""
    counts = sets.select(F.explode("t").alias("token")).groupBy(F.expr(f"cast(token & {BUCKETS - 1} as int)").alias("bucket")).count().toArrow()
    table = np.full(BUCKETS, 48, np.uint8)
    table[counts["bucket"].to_numpy()] = 48 + np.minimum(63, 2 * np.log2(counts["count"].to_numpy()))
    return F.lit(table.tobytes())


def ranked(sets: DataFrame, levels: Column) -> DataFrame:
    """(lid, n, prefix): the size of every set and its prefix in the order of the ranked shingles."""
    rank = F.transform("t", lambda h: F.call_function(
        "shiftleft", (F.ascii(F.substring(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1, F.lit(1)).cast("string")) - 48).cast("long"), F.lit(57)).bitwiseOR(h))
    return sets.select("lid", F.size("t").alias("n"), rank.alias("r")).select("lid", "n", F.expr("slice(sort_array(r), 1, n div 5 + 1)").alias("prefix"))


def _similar(met: DataFrame, sets: DataFrame) -> DataFrame:
    """The lines (lid) of pairs (lid, other) whose whole sets are similar enough."""
    both = met.select("lid", "other").distinct().join(sets, "lid").join(sets.toDF("other", "t2"), "other")
    return materialise(both.where("9 * size(array_intersect(t, t2)) >= 4 * (size(t) + size(t2))").select("lid").distinct())


def _repeated(sets: DataFrame) -> DataFrame:
    """The lines (lid) that are similar to one of a smaller number."""
    firsts = materialise(ranked(sets, rarity(sets)))
    prefix = firsts.select(F.posexplode("prefix").alias("pos", "token"), "lid", "n")
    shared = firsts.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("count")).where("count > 1")
    shared = materialise(shared.select("token", (F.col("count") > HOT).alias("hot")))
    lists = materialise(prefix.join(broadcast_if_small(shared, BROADCAST_ROWS), "token").select("token", "hot", "lid", "n", "pos"))

    star = lists.groupBy("token").agg(F.min(F.struct("lid", "n", "pos")).alias("s"))
    star = star.select("token", F.col("s.lid").alias("other"), F.col("s.n").alias("m"), F.col("s.pos").alias("pos2"))
    settled = _similar(lists.join(star, "token").where("other < lid").where(BOUNDS), sets)

    asking = materialise(lists.join(settled, "lid", "left_anti").select("token", "hot", "lid", "n", "pos"))
    others = lists.select("token", "hot", F.col("lid").alias("other"), F.col("n").alias("m"), F.col("pos").alias("pos2"))
    rare = asking.where("not hot").drop("hot").join(others.where("not hot").drop("hot"), "token").where("other < lid").where(BOUNDS)
    asking, others = asking.where("hot").drop("hot"), others.where("hot").drop("hot")
    prefixes = materialise(firsts.select("lid", "prefix").join(lists.where("hot").select("lid").distinct(), "lid", "left_semi"))
    often = asking.join(prefixes, "lid").join(others.join(prefixes.toDF("other", "prefix2"), "other"), "token").where("other < lid").where(BOUNDS).where(ONCE)
    return settled.union(_similar(rare.select("lid", "other").union(often.select("lid", "other")), sets))


def removed_lines(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, gone): the sorted numbers of the lines that go, for documents that lose any."""
    lines = materialise(sieved(documents, shingle))
    tokens = lines.select(*PLACE, "s1", "s2", F.size("tokens").alias("made"), F.explode("tokens").alias("token"))
    # lines of equal words are one here; a shingle that only they share leads to nothing
    apart = materialise(tokens.groupBy("token").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("token"))
    near = tokens.join(broadcast_if_small(apart, BROADCAST_ROWS), "token", "left_semi").groupBy(*PLACE, "s1", "s2", "made").count()
    near = near.where(f"count >= least(made, {SHARED})").groupBy("s1", "s2").agg(F.min(F.expr(LINE)).alias("line"))
    # numbered in the order of the lines, so that everything after this compares and carries numbers only
    near = materialise(near.select("line")).orderBy("line").select(F.monotonically_increasing_id().alias("lid"), "line.*")
    refs = materialise(near.select("lid", F.col("doc_id").alias("only_id"), F.col("text_key").alias("only_key"), F.col("line_no").alias("only_no")))
    gone = _repeated(materialise(line_sets(documents, refs, shingle)))
    gone = materialise(refs.join(gone, "lid", "left_semi").drop("lid"))

    same = F.expr("doc_id <=> only_id and text_key = only_key and line_no = only_no")
    copied = materialise(lines.groupBy("s1", "s2").agg(F.min(F.expr(LINE)).alias("line"), F.count("*").alias("count")).where("count > 1").select("s1", "s2", "line"))
    stay = copied.select("line.*").drop("last").join(gone, same, "left_anti").toDF(*gone.columns)
    copies = lines.select(*PLACE, "s1", "s2").join(broadcast_if_small(copied.drop("line"), BROADCAST_ROWS), ["s1", "s2"], "left_semi").select(*PLACE)
    every = copies.join(stay, same, "left_anti").union(gone)
    return every.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))


def dedup_lines(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``documents`` without the lines that repeat earlier ones; adds n_lines and removed (numbers of the lines that went)."""
    gone = materialise(removed_lines(documents.select("doc_id", "text"), shingle)).toDF("__id", "__key", "__gone")
    rest = columns(others(documents, "text", "n_lines", "removed"))
    joined = documents.select(*rest, "text", F.xxhash64("text").alias("__of")).join(broadcast_if_small(gone, BROADCAST_ROWS), F.expr("doc_id <=> __id and __of = __key"), "left")
    every = joined.withColumn("removed", F.coalesce("__gone", F.array().cast("array<int>")))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.expr("array_join(filter(split(text, '\\n'), (l, i) -> not array_contains(removed, i)), '\\n')"))
    n_lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).otherwise(0).cast("long")
    return every.select(*rest, text.alias("text"), n_lines.alias("n_lines"), "removed")
