"""Registry and the data every query starts from.

The tables hold no DNA, so sequences are made from their keys: the hex digits of md5 texts
are read as letters, the same way in both engines. Contigs are the A, C, G and T letters
of the documents. Interval tracks come from lineitem, sites from orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS_PER_TASK = 1_000_000


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, dealt out where it lies in few row groups, which a few tasks would read.

    A table whose tasks read about the same number of rows is taken as it is: dealing it out would shuffle it at every use.
    For these queries only; the library never repartitions what it is given.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.sparkContext.defaultParallelism
    # rows by task, from the footers
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    spread = sum(rows) >= wanted * max(rows, default=0) / 2
    return df if rows and spread else df.repartition(max(wanted, sum(rows) // ROWS_PER_TASK))


def dna(key: str, n: int, salt: str) -> str:
    """SQL text for ``n`` letters made from a key."""
    pieces = ", ".join(f"md5(concat('{salt}{i}-', cast({key} as string)))" for i in range((n + 31) // 32))
    hexed = f"concat({pieces})" if n > 32 else pieces
    return f"translate(substr({hexed}, 1, {n}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


class Derived:
    """Columns over one table, as SQL both engines read."""

    def __init__(self, source: str, columns: dict[str, str]):
        self.source, self.columns = source, columns

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).selectExpr(*[f"{v} as `{k}`" for k, v in self.columns.items()])

    @property
    def sql(self) -> str:
        columns = ", ".join(f'{v} as "{k}"' for k, v in self.columns.items())
        return f"(select {columns} from {self.source})"


def layered(source: str, *layers: dict[str, str]) -> "Layered":
    return Layered(source, layers)


class Layered(Derived):
    """Like ``Derived``, each layer adding columns that may use those before."""

    def __init__(self, source: str, layers):
        self.source, self.layers = source, layers

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = table(spark, sf_dir, self.source).selectExpr(*[f"{v} as `{k}`" for k, v in self.layers[0].items()])
        for layer in self.layers[1:]:
            out = out.selectExpr("*", *[f"{v} as `{k}`" for k, v in layer.items()])
        return out

    @property
    def sql(self) -> str:
        columns = ", ".join(f'{v} as "{k}"' for k, v in self.layers[0].items())
        text = f"select {columns} from {self.source}"
        for layer in self.layers[1:]:
            columns = ", ".join(f'{v} as "{k}"' for k, v in layer.items())
            text = f"select *, {columns} from ({text})"
        return f"({text})"


def idiv(x: str, n: int) -> str:
    return f"cast(floor({x} / {n}) as bigint)"


# --- sequences -------------------------------------------------------------------
K = "o_orderkey"
RAW_GUIDES = layered(
    "orders",
    {"k": K, "g": dna(K, 20, "g")},
    {"raw": "case cast(k % 6 as int) when 0 then g when 1 then lower(g) when 2 then concat(g, 'CGG')"
            " when 3 then translate(g, 'T', 'U') when 4 then substr(g, 1, 19) else concat(substr(g, 1, 9), 'N', substr(g, 11)) end"},
)
RAW_CONTEXTS = layered(
    "orders",
    {"k": K, "s": dna(K, 224, "c")},
    {"raw": "case cast(k % 6 as int) when 0 then substr(s, 1, 223) when 1 then substr(s, 1, 29) when 2 then lower(substr(s, 1, 29))"
            " when 3 then substr(s, 1, 30) when 4 then substr(s, 1, 28) else concat(substr(s, 1, 14), 'N', substr(s, 16, 14)) end"},
)
LONG = layered("orders", {"k": K, "context": dna(K, 223, "c")}, {"flank": "100", "site": "substr(context, 101, 23)"})
# alternating short and long contexts with their site
SITES = layered(
    "orders",
    {"k": K, "s": dna(K, 223, "c"), "flank": f"cast(case when {K} % 3 = 0 then 100 else 3 end as int)"},
    {"context": "case when flank = 100 then s else substr(s, 1, 29) end"},
    {"site": "substr(context, flank + 1, 23)"},
)
# aligned pairs: shared stretches, own stretches, and a gap on one side by key
ALIGNED = layered(
    "orders",
    {"k": K, "a": dna(K, 24, "g"), "b": dna(K, 24, "h"), "p": f"cast({K} % 19 as int) + 1"},
    {"m": "concat(substr(a, 1, 6), substr(b, 7, 4), substr(a, 11, 3), substr(b, 14, 3), substr(a, 17, 8))"},
    {"aln_rna": "concat(case when k % 3 = 1 then concat(substr(a, 1, p), '-', substr(a, p + 2, 20 - p)) else substr(a, 1, 21) end, 'NGG')",
     "aln_dna": "concat(case when k % 3 = 2 then concat(substr(m, 1, p), '-', substr(m, p + 2, 20 - p)) else substr(m, 1, 21) end, substr(b, 22, 1), 'GG')"},
)
# a guide and the same guide with at most one letter changed, in a 29-letter context
NEAR_PAIRS = layered(
    "orders",
    {"k": K, "g": dna(K, 20, "g"), "f": dna(K, 9, "f"), "p": f"cast({K} % 20 as int) + 1", "x": f"substr('ACGT', cast({idiv(K, 20)} % 4 as int) + 1, 1)"},
    {"site": "concat(substr(g, 1, p - 1), x, substr(g, p + 1), substr(f, 1, 1), 'GG')"},
    {"guide": "g", "context": "concat(substr(f, 2, 3), site, substr(f, 5, 3))", "sgrna": "concat(g, 'NGG')", "flank": "3"},
)
# a guide and an edited copy of it: letters dropped, put in or changed by key
EDITED_PAIRS = layered(
    "orders",
    {"k": K, "g": dna(K, 20, "g"), "f": dna(K, 30, "f"), "p": f"cast({K} % 16 as int) + 2"},
    {"t": "case cast(k % 7 as int)"
          " when 0 then concat(substr(g, 1, p), substr(g, p + 2))"
          " when 1 then concat(substr(g, 1, p), 'A', substr(g, p + 1))"
          " when 2 then concat(substr(g, 1, p), 'CA', substr(g, p + 1, 6), 'T', substr(g, p + 8))"
          " when 3 then concat(substr(g, 1, p), substr(g, p + 3))"
          " when 4 then concat(substr(g, 1, 3), 'G', substr(g, 5, p), substr(g, p + 6))"
          " when 5 then concat(substr(g, 1, p), substr(f, 1, 4), substr(g, p + 5))"
          " else substr(f, 1, 20) end"},
    {"upstream": "right(concat(substr(f, 11, 10), t), 23)"},
    {"guide": "g", "sgrna": "concat(g, 'NGG')", "flank": "3", "context": "concat(upstream, substr(f, 21, 1), 'GG', substr(f, 22, 3))"},
)

# --- contigs -----------------------------------------------------------------------
CONTIGS_SQL = "(select concat('doc', cast(doc_id as string)) as contig, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as seq from documents)"


def contigs(spark: SparkSession, sf_dir: str, source: str = "documents", key: str = "doc_id", prefix: str = "doc") -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(
        f"concat('{prefix}', cast({key} as string)) as contig", "upper(regexp_replace(text, '[^ACGTacgt]', '')) as seq"
    )


# --- loci and tracks ------------------------------------------------------------------
POINTS = layered(
    "orders",
    {"k": K, "chrom": "concat('chr', cast(o_custkey % 7 + 1 as string))", "start": f"{K} * 10 + 7",
     "strand": f"case when o_custkey % 2 = 0 then '+' else '-' end", "cell_type": f"case when {K} % 2 = 0 then 'K562' else 'HEK' end"},
    {"end": "start + 22"},
)
# sparse coordinates, so that most sites have to walk to a track
FAR_POINTS = layered(
    "orders",
    {"k": K, "chrom": "concat('chr', cast(o_custkey % 7 + 1 as string))", "start": f"{K} * 1000 + 20000"},
    {"end": "start + 22"},
)
TRACK = Derived("lineitem", {
    "chrom": "concat('chr', cast(l_linenumber as string))", "start": "l_orderkey * 10", "end": "l_orderkey * 10 + cast(l_quantity as bigint)",
    "track_strand": "case when l_linestatus = 'O' then '+' else '-' end", "replicate": "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end",
    "quantity": "l_quantity", "text_value": "cast(cast(l_quantity as bigint) % 40 as string)",
    "number_value": "cast(cast(l_quantity as bigint) % 4 as double)",
    "load_seq": "l_partkey * 1000000000000 + l_suppkey * 100000000 + l_orderkey",
})
FAR_TRACK = Derived("lineitem", {
    "chrom": "concat('chr', cast(l_linenumber as string))", "start": "l_orderkey * 4000", "end": "l_orderkey * 4000 + cast(l_quantity as bigint)",
    "text_value": "cast(cast(l_quantity as bigint) % 40 as string)", "number_value": "cast(cast(l_quantity as bigint) % 4 as double)",
    "load_seq": "l_partkey * 1000000000000 + l_suppkey * 100000000 + l_orderkey",
})
