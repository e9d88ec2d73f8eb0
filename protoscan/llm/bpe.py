"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

Texts are cut by the tokenizer's pattern. The distinct words of a batch that the worker has not met
before become (word, position, token) rows, one per byte. A recursive query joins neighbouring
tokens with the merge table and contracts the leftmost pair of the lowest rank of each word, until no
word has a pair left. Words over ``LONG`` bytes contract all non-overlapping places of that pair at
once, from the left; a merge never makes a pair of a lower rank than itself, so the result is the
same, in fewer rounds. Decoding joins ids with the vocabulary and gathers the bytes by an
ordered aggregation.

Spark deals out the documents; there is no shuffle. Encoding and decoding share one pass and one connection per worker. A
worker keeps the words that it has encoded, ``KEPT`` at most, then starts anew, so memory does not grow with the corpus; all
is let go when the worker turns to another operator.

Null texts count as empty and give no ids. Ids unknown to the vocabulary fail on decoding.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from protoscan.llm.common import columns, fields, map_batches, others, worker_state

LONG = 256
KEPT = 500_000
CHUNK_BYTES = 400_000

#: A row knows its place (256 times the number of its word and its first byte) and the place of the token behind it, -1 for none.
ENCODE = """
with recursive step(spot, next, tok, live) as (
    select spot, next, tok, true from chars
    union all
    (with held as (select spot, next, tok from step where live),
     paired as (
        select a.spot, a.next, b.next as after, m.merged, m.merged::bigint * 4294967296 + a.spot as key
        from held a join held b on a.next = b.spot join merges m on m.l = a.tok and m.r = b.tok),
     best as (
        select spot >> 8 as word, (min(key) & 4294967295)::int as here, arg_min(next, key) as gone, arg_min(after, key) as after, arg_min(merged, key) as merged
        from paired group by spot >> 8)
     select h.spot, case when h.spot = b.here then b.after else h.next end, case when h.spot = b.here then b.merged else h.tok end, b.here is not null
     from held h left join best b on h.spot >> 8 = b.word
     where b.gone is null or h.spot <> b.gone)
)
select spot >> 8 as word, tok from step where not live order by spot
"""

ENCODE_LONG = """
with recursive step(word, pos, tok, live) as (
    select word, pos, tok, true from chars
    union all
    (with paired as (
        select s.word, s.pos, s.tok, m.merged
        from (select word, pos, tok, lead(tok) over (partition by word order by pos) as next_tok
              from step where live) s
        left join merges m on m.l = s.tok and m.r = s.next_tok),
     marked as (
        select *, coalesce(merged = min(merged) over (partition by word), false) as hit,
               min(merged) over (partition by word) is not null as more from paired),
     runs as (
        select *, count(case when not hit then 1 end) over (partition by word order by pos) as run from marked),
     chosen as (
        select *, hit and (row_number() over (partition by word, run, hit order by pos)) % 2 = 1 as take from runs)
     select word, pos, case when take then merged else tok end, more
     from (select *, lag(take, 1, false) over (partition by word order by pos) as gone from chosen)
     where not gone)
)
select word, tok from step where not live order by word, pos
"""

DECODE = "select t.doc, list(v.bytes order by t.pos) as bytes from tokens t join vocabulary v on v.id = t.tok group by t.doc"

#: The pattern's classes for texts without letters beyond U+024F, where the standard library knows them; others take ``regex``.
BEYOND = re.compile("[^\x00-\u024f]")
CLASSES = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0", r"\S": "^\t-\r \x85\xa0"}


def narrowed(pattern: str) -> str:
    """``pattern`` with its character classes written out for U+0000 to U+024F."""
    return re.sub(r"\[\^[^\]]*\]|\\p\{[LN]\}|\\[sS]", lambda m: "[^" + "".join(CLASSES[x] for x in re.findall(r"\\p\{[LN]\}|\\s", m[0])) + "]" if m[0][0] == "[" else f"[{CLASSES[m[0]]}]", pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """One worker's connection with its token and merge tables, and the words met so far."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.known: dict[str, bytes] = {}
        self.patterns: dict = {}
        self.db = duckdb.connect()
        for setting in ("threads = 1", "memory_limit = '250MB'", "temp_directory = ''"):  # nothing goes to a local disk
            self.db.execute(f"set {setting}")
        self._table("vocabulary", {"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})

    def close(self) -> None:
        self.known.clear()
        self.db.close()

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from given")
        self.db.unregister("given")

    def _ask(self, name: str, columns: dict, sql: str) -> pa.Table:
        self._table(name, columns)
        return self.db.sql(sql).to_arrow_table()

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each text."""
        out = [b""] * len(packed)
        begin = size = 0
        for i, ids in enumerate(packed):
            size += len(ids) // 4
            if size > 500_000 or i == len(packed) - 1:
                part = packed[begin : i + 1]
                counts = np.array([len(x) // 4 for x in part])
                tokens = np.frombuffer(b"".join(part), "<u4").astype(np.int32)
                got = self._ask("tokens", {"doc": np.repeat(np.arange(begin, i + 1, dtype=np.int32), counts), "pos": np.arange(len(tokens), dtype=np.int32), "tok": tokens}, DECODE)
                lists = got["bytes"].combine_chunks()
                pieces = lists.flatten()
                at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :] if len(pieces) else np.zeros(1, np.int32)
                data, ends = pieces.buffers()[2], lists.value_lengths().to_numpy().cumsum()
                found = 0
                for doc, end in zip(got["doc"].to_pylist(), ends.tolist()):
                    out[doc] = data[int(at[found]) : int(at[end])].to_pybytes()  # the values of a column lie one after the other
                    found = end
                if found != len(tokens):
                    raise ValueError("an id is not in the vocabulary")
                begin, size = i + 1, 0
        return out


    def prepare(self, pattern: str) -> None:
        """What encoding needs besides: the merge table, once, and the pattern in both forms."""
        import regex

        if not self.patterns:
            self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
            splits = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
            columns = zip(*splits) if splits else ((), (), ())
            self._table("merges", {name: pa.array(column, pa.int32()) for name, column in zip(("l", "r", "merged"), columns)})
        if pattern not in self.patterns:
            self.known.clear()
            self.patterns = {pattern: (regex.compile(pattern), re.compile(narrowed(pattern)))}

    def _contract(self, words: list[bytes], sql: str) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
        if sql is ENCODE:
            spot = 256 * word + pos
            next_spot = spot + 1
            next_spot[ends - 1] = -1
            rows = {"spot": spot, "next": next_spot}
        else:
            rows = {"word": word, "pos": pos}
        rows = {name: x.astype(np.int32) for name, x in rows.items()} | {"tok": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]}
        out = self._ask("chars", rows, sql)
        ids = out["tok"].to_numpy().astype("<u4").tobytes()
        cuts = 4 * np.cumsum(np.bincount(out["word"].to_numpy(), minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def learn(self, words: set[str]) -> None:
        if len(self.known) > KEPT:
            self.known.clear()
        groups: tuple[list, list] = ([], [])
        for word in words:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[word] = rank.to_bytes(4, "little")
            else:
                groups[len(raw) > LONG].append((word, raw))
        for many, sql in zip(groups, (ENCODE, ENCODE_LONG)):
            begin = size = 0
            for i, (_, raw) in enumerate(many):
                size += len(raw)
                if size >= CHUNK_BYTES or i == len(many) - 1:
                    part = many[begin : i + 1]
                    self.known.update(zip((w for w, _ in part), self._contract([b for _, b in part], sql)))
                    begin, size = i + 1, 0

    def encode(self, texts: list[str], pattern: str) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        self.prepare(pattern)
        wide, narrow = self.patterns[pattern]
        out, group, size = [], [], 0
        for i, text in enumerate(texts):
            group.append((wide if BEYOND.search(text) else narrow).findall(text))
            size += len(text)
            if size > 1_000_000 or i == len(texts) - 1:
                missing = set().union(*group) - self.known.keys()
                if missing:
                    if len(self.known) > KEPT:
                        missing = set().union(*group)
                    self.learn(missing)
                out += [b"".join(map(self.known.__getitem__, words)) for words in group]
                group, size = [], 0
        return out


def coder(path: str) -> Coder:
    return worker_state(("bpe", path), lambda: Coder(path))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens`` in place of the text column.

    ``path``: a tiktoken rank file that every executor has. ``pattern``: the tokenizer's pattern.
    """
    return _coded(df, path, pattern, text, False)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Like ``encode``, with ``decoded``, the bytes that the ids stand for, in the same pass over the rows."""
    return _coded(df, path, pattern, text, True)


def _coded(df: DataFrame, path: str, pattern: str, text: str, back: bool) -> DataFrame:
    more = ["ids", "n_tokens", *(["decoded"] if back else [])]
    rest = others(df, text.lower(), *more)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(path)
        ids = own.encode([x or "" for x in batch.column("__text").to_pylist()], pattern)
        made = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), *([pa.array(own.decode(ids), pa.binary())] if back else [])]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, *more])

    schema = fields(df, rest, "ids binary, n_tokens bigint" + ", decoded binary" * back)
    return map_batches(df.select(*columns(rest), F.coalesce(F.col(text), F.lit("")).alias("__text")), run, schema, "__text")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of its ``ids``."""
    rest = others(df, "decoded")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(coder(path).decode([x or b"" for x in batch.column(ids).to_pylist()]), pa.binary())], names=[*rest, "decoded"])

    return map_batches(df.select(*columns(rest)), run, fields(df, rest, "decoded binary"), ids)


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    coded = encode_and_decode(documents.select("doc_id", "text"), path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
