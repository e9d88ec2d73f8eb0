"""Rules for document quality as a ledger of bits.

``ledger`` measures every text once and evaluates every rule once: the measurements stay as columns, and each rule that a
text fails sets its bit in the long ``failed``. Everything after that works on the bits alone. A policy is a version with the set of rules
that reject, and a number of further, lesser rules of which several have to fail together; ``verdict`` applies one to a ledger that has
been written, so a new policy needs no second look at a text. ``ablations`` counts documents by their bits (an aggregate that combines in the
tasks; there are at most 2^rules different values), and from these counts alone tells for each rule of a policy how many documents
fail it, how many only it rejects, and how many the policy would keep without it.

Measuring is one pass in Python per text, without a shuffle; texts go one way and numbers come back. Words are runs of other characters than
0x20 and 0x09-0x0D, unchanged. A word is repeated if a window of five words around it is found twice in the text; windows are
compared by exact numbers of their words, not by hashes.

Null texts count as empty: they have no words and fail the rule of least words. Each row gets its own result, so repeated rows, repeated or
null ids stay as they are. Other columns pass through; those named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from protoscan.llm.common import binary_text, columns, others

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", "n_chars", "n_capitals", "n_digits", "n_letters", "n_exclaims", "n_ellipses", "n_bullets", "n_plain_words", "longest_word", "top_word", "n_stutters"]


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements, in whole numbers."""

    name: str
    fails: str


#: The place of a rule is its bit. New rules go to the end; a rule in use keeps its place and its meaning.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("short_words", "10 * word_chars < 25 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "100 * n_capitals > 40 * n_letters"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("repeated_line_chars", "100 * dup_line_chars > 30 * n_chars"),
    Rule("digits", "100 * n_digits > 25 * n_chars"),
    Rule("exclamations", "100 * n_exclaims > 20 * n_words"),
    Rule("few_plain_words", "100 * n_plain_words < 60 * n_words"),
    Rule("ellipses", "n_lines >= 4 and 100 * n_ellipses > 30 * n_lines"),
    Rule("bullets", "n_lines >= 4 and 100 * n_bullets > 90 * n_lines"),
    Rule("one_word", "n_words >= 20 and 100 * top_word > 30 * n_words"),
    Rule("endless_word", "longest_word > 1000"),
    Rule("stutters", "100 * n_stutters > 25 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


def bits(names) -> int:
    return sum(BIT[n] for n in set(names))


BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """Rejected: a text that fails any rule of ``reject``, or at least ``together`` of the rules of ``lesser``."""

    version: str
    reject: tuple[str, ...]
    lesser: tuple[str, ...] = field(default=())
    together: int = 2

    def kept(self, failed: Column, without: int = 0) -> Column:
        """``without``: bits of rules that count as passed."""
        hard = failed.bitwiseAND(F.lit(bits(self.reject) & ~without))
        soft = F.bit_count(failed.bitwiseAND(F.lit(bits(self.lesser) & ~without)))
        return (hard == 0) & (soft < self.together)


POLICIES = {
    policy.version: policy
    for policy in (
        Policy("base", BASE),
        Policy("1", (*BASE, "symbols", "capitals", "repeated_lines", "repeated_line_chars", "few_plain_words", "one_word", "stutters"),
               ("short_words", "long_words", "digits", "exclamations", "ellipses", "bullets", "endless_word")),
    )
}
CURRENT = "1"


def repeated(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in a window of ``size`` words that is found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    one = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    window = one[:n].copy()
    for k in range(1, size):  # the number of a window among those of its length, then with its next word
        window = np.unique(window * len(numbers) + one[k : k + n], return_inverse=True)[1] if k < size - 1 else window * len(numbers) + one[k : k + n]
    _, first, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[first] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _table(which) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(which)] = 1
    return out


#: Of each byte of UTF-8: begins a character, white space, symbol, capital, digit, letter (any beyond ASCII counts as one), exclamation mark.
KINDS = np.stack([
    _table(b for b in range(256) if b & 0xC0 != 0x80), _table(b" \t\n\x0b\x0c\r"), _table(SYMBOLS), _table(range(65, 91)), _table(range(48, 58)),
    _table([*range(65, 91), *range(97, 123), *range(0xC3, 256)]), _table(b"!"),
])
_EDGE = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LETTER = _table([*range(65, 91), *range(97, 123), *range(128, 256)]).astype(bool)


def plain(word: bytes) -> bool:
    """A word of letters, hyphens and apostrophes, with at most two other marks around it."""
    core = word.strip(_EDGE)
    return len(word) - len(core) <= 2 and core.replace(b"-", b"").replace(b"'", b"").isalpha() if word.isascii() else len(word) - len(core) <= 2 and core != b""


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = text.split()
    starts, blanks, symbols, capitals, digits, letters, exclaims = (KINDS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in lines:
        if line in seen:
            dup_lines += 1
            dup_chars += len(line.decode(errors="replace"))
        seen.add(line)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return (
        len(words), starts - blanks, symbols, dup_lines, repeated(words), len(lines), dup_chars, starts, capitals, digits, letters, exclaims,
        sum(x.rstrip().endswith((b"...", "…".encode())) for x in lines), sum(x.lstrip().startswith((b"- ", b"* ", "•".encode())) for x in lines),
        sum(n for w, n in counts.items() if plain(w)), max(map(len, counts), default=0), max(counts.values(), default=0), sum(map(eq, words, words[1:])),
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = list(zip(*(measure(t.as_py()) for t in texts))) or [()] * len(MEASURES)  # one text at a time
        yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in rows], names=MEASURES)


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the measurements and ``failed``, bit i for rule i."""
    rest = columns(others(df, *MEASURES, "failed"))
    # taken apart from the texts before the rules look at it, so that it is made once
    measured = df.select(*rest, _measured(binary_text(text)).alias("__m")).select(*rest, *[F.col(f"__m.{m}").alias(m) for m in MEASURES])
    failed = " + ".join(f"if({rule.fails}, {1 << i}L, 0L)" for i, rule in enumerate(rules))
    return measured.select("*", F.expr(failed).alias("failed"))


def verdict(rows: DataFrame, policy: Policy | str = CURRENT, name: str = "kept") -> DataFrame:
    """A ledger with ``name``: whether the policy keeps the row."""
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    return rows.withColumn(name, chosen.kept(F.col("failed")))


def ablations(rows: DataFrame, policy: Policy | str = CURRENT) -> DataFrame:
    """(version, rule, n, n_failed, n_rejected, n_only, n_kept_without) per rule of the policy, from the bits of a ledger.

    n_rejected: documents that fail the rule and are rejected; n_only: those that would be kept without the rule.
    """
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    counts = rows.groupBy("failed").agg(F.count("*").alias("count"))
    each = []
    for name in dict.fromkeys((*chosen.reject, *chosen.lesser)):
        bit = BIT[name]
        fails = F.col("failed").bitwiseAND(F.lit(bit)) != 0
        kept, without = chosen.kept(F.col("failed")), chosen.kept(F.col("failed"), bit)
        number = lambda c: F.when(c, F.col("count")).otherwise(0)
        each.append(F.struct(F.lit(chosen.version).alias("version"), F.lit(name).alias("rule"), F.col("count").alias("n"), number(fails).alias("n_failed"), number(fails & ~kept).alias("n_rejected"), number(~kept & without).alias("n_only"), number(without).alias("n_kept_without")))
    out = counts.select(F.explode(F.array(*each)).alias("a")).select("a.*")
    return out.groupBy("version", "rule").agg(*[F.sum(c).alias(c) for c in ("n", "n_failed", "n_rejected", "n_only", "n_kept_without")])


def report(documents: DataFrame) -> DataFrame:
    """doc_id, the base measurements, whether the base rules reject the text, and the verdict of the current policy."""
    found = verdict(ledger(documents.select("doc_id", "text")))
    base = F.col("failed").bitwiseAND(F.lit(bits(BASE))) != 0
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed")
