"""Genome-track features, the splice fold and expression tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protoscan.fixed import REPEAT_CLASS, REPEAT_FAMILY, SUBCOMPARTMENT
from protoscan.operators import splice, tracks
from workloads.base import FAR_POINTS, FAR_TRACK, POINTS, TRACK, Derived, layered, query, table


def track(spark, d, value: str, source: Derived = TRACK) -> DataFrame:
    df = source.df(spark, d)
    return df.withColumn("value", F.col(value))


def per_base(value: str, by: str = "", source: Derived = TRACK, where: str = "true") -> str:
    """Every covered letter with the value loaded last, the literal reading of an interval map."""
    keys = f"chrom, pos{', ' + by if by else ''}"
    return f"""(select {keys}, arg_max(v, load_seq) as v from (select chrom, load_seq, {value} as v{', ' + by if by else ''}, unnest(range(start, "end" + 1)) as pos from {source.sql} where {where}) group by {keys})"""


def sql_endpoint(value: str, default: str, numeric: bool, points=POINTS, source: Derived = TRACK) -> str:
    s, e = ("nullif(s.v, 0)", "nullif(e.v, 0)") if numeric else ("s.v", "e.v")
    return f"""(with asked as materialized (select chrom, start as pos from {points.sql} union select chrom, "end" as pos from {points.sql}),
pb as materialized (select b.* from {per_base(value, source=source)} b semi join asked using (chrom, pos))
select p.*, coalesce({s}, {e}, {default}) as v from {points.sql} p left join pb s on s.chrom = p.chrom and s.pos = p.start left join pb e on e.chrom = p.chrom and e.pos = p."end")"""


def sql_stepped(value: str, hit: str, step: int, limit: int, numeric: bool, points, source: Derived) -> str:
    """k and the distance walked, by trying every step."""
    left = "l.v is not null and l.v <> 0" if numeric else "l.v is not null"
    default = "0" if numeric else "'0'"
    return f"""(with pb as materialized (select * from {per_base(value, source=source)}),
p as materialized (select * from {sql_endpoint(value, default, numeric, points, source)}),
w as (select p.k, p.chrom, p.start - {step} * j as a, p."end" + {step} * j as b, j from p, range(0, {limit}) t(j) where not ({hit})),
f as (select k, min(j) as j from w left join pb l on l.chrom = w.chrom and l.pos = a left join pb r on r.chrom = w.chrom and r.pos = b where ({left}) or r.v is not null group by k)
select p.k, p.v, case when {hit} then 0 else coalesce({step} * (j + 1), -1) end as distance from p left join f using (k))"""


# --- point lookups -------------------------------------------------------------------------

@query("track_point_lookup", f"select k, v as \"DHS_signalValue\" from {sql_endpoint('text_value', chr(39) + '0' + chr(39), False)}")
def track_point_lookup(spark, d):
    return tracks.endpoint_value(POINTS.df(spark, d), track(spark, d, "text_value"), "DHS_signalValue", "0").select("k", "DHS_signalValue")


@query("track_point_lookup_numeric", f"select k, v as nucleosome_mapping from {sql_endpoint('number_value', '0', True)}")
def track_point_lookup_numeric(spark, d):
    return tracks.endpoint_value(POINTS.df(spark, d), track(spark, d, "number_value"), "nucleosome_mapping", 0.0, numeric=True).select("k", "nucleosome_mapping")


@query("cpg_islands", f"select k, v as cpg from {sql_endpoint('cast(cast(quantity as bigint) * 2 as string)', chr(39) + '0' + chr(39), False)}")
def cpg_islands(spark, d):
    islands = track(spark, d, "quantity").withColumn("value", (F.col("quantity").cast("bigint") * 2).cast("string"))
    return tracks.endpoint_value(POINTS.df(spark, d), islands, "cpg", "0").select("k", "cpg")


@query("housekeeping_membership", f"select k, v as in_housekeeping from {sql_endpoint('1', '0', False)}")
def housekeeping_membership(spark, d):
    return tracks.inside_flag(POINTS.df(spark, d), TRACK.df(spark, d), "in_housekeeping").select("k", "in_housekeeping")


@query("nucleosome_occupancy", f"""
select p.k, coalesce(b.v, 0) as occupancy from {POINTS.sql} p left join {per_base('quantity')} b on b.chrom = p.chrom and b.pos = p."end" - 3""")
def nucleosome_occupancy(spark, d):
    return tracks.value_before_end(POINTS.df(spark, d), track(spark, d, "quantity"), "occupancy").select("k", "occupancy")


_LABELS = ["A1", "A2", "B1", "B2", "B3", "B4", "NA"]
_LABEL_SQL = "case cast(quantity as bigint) % 7 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(_LABELS)) + " end"
_SUB_CODE = "case cast(quantity as bigint) % 7 " + " ".join(f"when {i} then {SUBCOMPARTMENT[x]}" for i, x in enumerate(_LABELS)) + " end"


@query("subcompartments", f"select k, v as genomic_subcompartment from {sql_endpoint(_SUB_CODE, '0', True)}")
def subcompartments(spark, d):
    coded = TRACK.df(spark, d).withColumn("value", tracks.subcompartment_code(F.expr(_LABEL_SQL)))
    return tracks.endpoint_value(POINTS.df(spark, d), coded, "genomic_subcompartment", 0, numeric=True).select("k", "genomic_subcompartment")


_REPEATS = [("SINE", "Alu"), ("LINE?", "L1"), ("LTR", "ERVL-MaLR"), ("Unmasked", "Unmasked"), ("Simple_repeat", "Simple_repeat"), ("Unknown", "Unknown"), ("DNA", "hAT?")]


def _repeat_case(pick) -> str:
    return "case cast(quantity as bigint) % 7 " + " ".join(f"when {i} then {pick(c, f)}" for i, (c, f) in enumerate(_REPEATS)) + " end"


@query("repeat_class", f"""
select a.k, a.v as repeat_class, b.v as repeat_family
from {sql_endpoint(_repeat_case(lambda c, f: REPEAT_CLASS[c.strip('?')]), '0', True)} a
join {sql_endpoint(_repeat_case(lambda c, f: REPEAT_FAMILY[c.strip('?') + '/' + f.strip('?')]), '0', True)} b using (k)""")
def repeat_class(spark, d):
    cls, fam = F.expr(_repeat_case(lambda c, f: f"'{c}'")), F.expr(_repeat_case(lambda c, f: f"'{f}'"))
    codes = {"repeat_class": tracks.repeat_code(cls), "repeat_family": tracks.repeat_code(cls, fam)}
    return tracks.endpoint_numbers(POINTS.df(spark, d), TRACK.df(spark, d), codes).select("k", "repeat_class", "repeat_family")


# --- stepped distances ---------------------------------------------------------------------

@query("track_nearest_step50", f"select k, v as \"DHS_signalValue\", cast(distance as bigint) as \"distance_from_DHS\" from {sql_stepped('text_value', 'p.v <> ' + chr(39) + '0' + chr(39), 50, 100, False, FAR_POINTS, FAR_TRACK)}")
def track_nearest_step50(spark, d):
    got = tracks.dnase_signal(FAR_POINTS.df(spark, d), track(spark, d, "text_value", FAR_TRACK))
    return got.select("k", "DHS_signalValue", "distance_from_DHS")


@query("track_nearest_step1", f"select k, v as nucleosome_mapping, cast(distance as bigint) as length_from_nucleosome from {sql_stepped('number_value', 'p.v <> 0', 1, 1000, True, FAR_POINTS, FAR_TRACK)}")
def track_nearest_step1(spark, d):
    got = tracks.nucleosome_signal(FAR_POINTS.df(spark, d), track(spark, d, "number_value", FAR_TRACK))
    return got.select("k", "nucleosome_mapping", "length_from_nucleosome")


# --- strands and replicates ------------------------------------------------------------------

def sql_strand(value: str, by: str, n: int, own: str, opposite: str, source: Derived = TRACK, where: str = "true", points=POINTS) -> str:
    keys = "track_strand, replicate" if by else "track_strand"
    rep = "replicate" if by else "0"
    return f"""(with pb as materialized (select * from {per_base(value, keys, source, where)}),
h as (select p.k, p.strand = b.track_strand as same, {rep} as rep, max(cast(b.v as double)) as v from {points.sql} p join pb b on b.chrom = p.chrom and (b.pos = p.start - 1) group by all
 union all select p.k, p.strand = b.track_strand as same, {rep} as rep, max(cast(b.v as double)) as v from {points.sql} p join pb b on b.chrom = p.chrom and (b.pos = p."end" + 1) group by all),
m as (select k, same, rep, max(v) as v from h group by all)
select p.k, coalesce(sum(m.v) filter (where same), 0)::double / {n} as "{own}", coalesce(sum(m.v) filter (where not same), 0)::double / {n} as "{opposite}" from {points.sql} p left join m using (k) group by p.k)"""


@query("strand_signal_max_mean", f"select * from {sql_strand('quantity', 'replicate', 3, 'NGG_exon_signalValue', 'opposite_exon_signalValue')}")
def strand_signal_max_mean(spark, d):
    got = tracks.strand_signal(POINTS.df(spark, d), track(spark, d, "quantity"), 3, "NGG_exon_signalValue", "opposite_exon_signalValue")
    return got.select("k", "NGG_exon_signalValue", "opposite_exon_signalValue")


GENES = layered(
    "orders",
    {"accession": "concat('NM_', cast(o_orderkey as string))", "gene": "concat('G', cast(o_custkey as string))", "chrom": "concat('chr', cast(o_custkey % 7 + 1 as string))",
     "strand": "case when o_orderkey % 3 = 0 then '-' else '+' end", "tx_start": "o_orderkey * 9", "tx_end": "o_orderkey * 9 + 25 + o_custkey % 60", "load_seq": "o_orderkey"},
    {"cds_start": "tx_start + 5", "cds_end": "tx_end - 12", "exon_count": "2"},
)


def genes(spark, d) -> DataFrame:
    return GENES.df(spark, d).withColumn("exon_starts", F.expr("array(tx_start, tx_start + 18)")).withColumn("exon_ends", F.expr("array(tx_start + 6, tx_end)"))


EXONS = Derived(f"(select *, unnest([tx_start, tx_start + 18]) as s, unnest([tx_start + 6, tx_end]) as e from {GENES.sql})", {"chrom": "chrom", "start": "s", "end": "e", "track_strand": "strand", "load_seq": "load_seq"})


@query("exon_membership", f"select * from {sql_strand('1', '', 1, 'in_NGG_exon', 'in_opposite_exon', EXONS)}")
def exon_membership(spark, d):
    exons = tracks.gene_intervals(genes(spark, d)).filter("kind = 'exon'")
    return tracks.exon_membership(POINTS.df(spark, d), exons).select("k", "in_NGG_exon", "in_opposite_exon")


def sql_genes() -> str:
    def covered(low: str, high: str) -> str:
        return f'(select distinct chrom, unnest(range({low}, {high} + 1)) as pos from {GENES.sql})'
    return f"""(with tx as materialized (select * from {covered('tx_start', 'tx_end')}), cds as materialized (select * from {covered('cds_start', 'cds_end')})
select p.k, case when a.pos is not null or b.pos is not null then 1 else 0 end as in_tx, case when c.pos is not null or e.pos is not null then 1 else 0 end as in_cds from {POINTS.sql} p
left join tx a on a.chrom = p.chrom and a.pos = p.start left join tx b on b.chrom = p.chrom and b.pos = p."end"
left join cds c on c.chrom = p.chrom and c.pos = p.start + 6 left join cds e on e.chrom = p.chrom and e.pos = p."end" - 6)"""


@query("gene_tx_cds", f"select * from {sql_genes()}")
def gene_tx_cds(spark, d):
    return tracks.gene_membership(POINTS.df(spark, d), tracks.gene_intervals(genes(spark, d)).filter("kind != 'exon'")).select("k", "in_tx", "in_cds")


# dense transcripts, many inside others, in a load order that is not the order of their places
NESTED = Derived(f"(select * replace (tx_start * 2 // 9 as tx_start, tx_start * 2 // 9 + tx_end - tx_start as tx_end, load_seq % 1000 * 100000000 + load_seq as load_seq) from {GENES.sql})", {})


def nested_genes(spark, d) -> DataFrame:
    return GENES.df(spark, d).selectExpr("accession", "gene", "chrom", "strand", "tx_start * 2 div 9 as tx_start", "tx_start * 2 div 9 + tx_end - tx_start as tx_end", "load_seq % 1000 * 100000000 + load_seq as load_seq")


# one transcript of every chromosome and strand at a time, beside all those that were loaded before
_LOADED_SQL = f"""(with recursive o as (select accession, chrom, strand, tx_start as s, tx_end as e, load_seq, row_number() over (partition by chrom, strand order by load_seq) as j from {NESTED.source}),
f(chrom, strand, j, spans) as (select distinct chrom, strand, 0::bigint, []::struct(s bigint, e bigint, q bigint)[] from o
 union all select f.chrom, f.strand, o.j, case when len(list_filter(spans, lambda x: x.s <= o.s and o.s <= x.e)) > 0 and len(list_filter(spans, lambda x: x.s <= o.e and o.e <= x.e)) > 0 then spans
  else list_append(spans, {{'s': o.s, 'e': o.e, 'q': o.load_seq}}) end from f join o on o.chrom = f.chrom and o.strand = f.strand and o.j = f.j + 1),
l as (select chrom, strand, unnest(arg_max(spans, j)) as x from f group by chrom, strand)
select o.* from l join o on o.chrom = l.chrom and o.strand = l.strand and o.load_seq = l.x.q)"""


@query("housekeeping_genes", f"""
with listed as (select distinct chrom, strand, start // 4 as start from {POINTS.sql}), loaded as materialized (select * from {_LOADED_SQL}),
h as (select l.chrom, l.strand, l.start, coalesce(arg_max(g.load_seq, g.load_seq) filter (where g.strand = l.strand), arg_max(g.load_seq, g.load_seq)) as q from listed l join loaded g on g.chrom = l.chrom and l.start between g.s and g.e group by all)
select h.strand as listed_strand, h.start as listed_start, g.accession, g.chrom, g.s as start, g.e as "end" from h join loaded g on g.chrom = h.chrom and g.load_seq = h.q""")
def housekeeping_genes(spark, d):
    listed = POINTS.df(spark, d).selectExpr("chrom", "strand", "start div 4 as start").distinct()
    found = tracks.housekeeping_genes(listed, nested_genes(spark, d), keep_listed=True)
    return found.select("listed_strand", "listed_start", "accession", "chrom", "start", "end")


@query("transcripts_loaded_in_order", f"select accession, chrom, strand, s as start, e as \"end\" from {_LOADED_SQL}")
def transcripts_loaded_in_order(spark, d):
    tx = nested_genes(spark, d).selectExpr("accession", "chrom", "strand as track_strand", "tx_start as start", "tx_end as end", "load_seq")
    return tracks.loaded_in_order(tx).selectExpr("accession", "chrom", "track_strand as strand", "start", "end")


def sql_replicates(stranded: bool, n: int, out: str, points=POINTS, source=TRACK) -> str:
    keys = "track_strand, replicate" if stranded else "replicate"
    match = "and b.track_strand = p.strand" if stranded else ""
    return f"""(with pb as materialized (select * from {per_base('text_value', keys, source)}),
s as (select p.k, b.replicate as rep, b.v from {points.sql} p join pb b on b.chrom = p.chrom and b.pos = p.start {match}),
e as (select p.k, b.replicate as rep, b.v from {points.sql} p join pb b on b.chrom = p.chrom and b.pos = p."end" {match}),
m as (select k, rep, coalesce(s.v, e.v)::double as v from s full join e using (k, rep))
select p.k, coalesce(sum(m.v), 0)::double / {n} as {out} from {points.sql} p left join m using (k) group by p.k)"""


@query("replicate_mean_methylation", f"select * from {sql_replicates(True, 3, 'methylation')}")
def replicate_mean_methylation(spark, d):
    return tracks.replicate_mean(POINTS.df(spark, d), track(spark, d, "text_value"), 3, "methylation", stranded=True).select("k", "methylation")


@query("replicate_mean_histone", f"select * from {sql_replicates(False, 3, 'histone')}")
def replicate_mean_histone(spark, d):
    return tracks.replicate_mean(POINTS.df(spark, d), track(spark, d, "text_value"), 3, "histone").select("k", "histone")


# --- chromosome ends ---------------------------------------------------------------------------
GAPS = Derived("lineitem", {
    "chrom": "concat('chr', cast(l_linenumber as string))",
    "start": "case when l_linestatus = 'O' and l_returnflag = 'R' then 0 else l_orderkey * 10 end",
    "end": "case when l_linestatus = 'O' and l_returnflag = 'R' then l_orderkey % 100 + 50 else l_orderkey * 10 + 40 end",
    "kind": "case when l_returnflag = 'A' then 'centromere' when l_returnflag = 'R' and l_linenumber <> 5 then 'telomere' else 'clone' end",
    "load_seq": "l_partkey * 1000000000000 + l_suppkey * 100000000 + l_orderkey",
})
SIZES_SQL = "(select concat('chr', cast(l_linenumber as string)) as chrom, max(l_orderkey) * 10 + 60000 as length from lineitem group by l_linenumber)"


def sizes(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg((F.max("l_orderkey") * 10 + 60000).alias("length")).selectExpr("concat('chr', cast(l_linenumber as string)) as chrom", "length")


CENTROMERE_SQL = f"""(with c as (select chrom, arg_max(start, load_seq) as c0, arg_max("end", load_seq) as c1 from {GAPS.sql} where kind = 'centromere' group by chrom)
select p.k, cast(case when start between c0 and c1 or "end" between c0 and c1 then 0 else least(abs(start - c1), abs(c0 - "end")) end as bigint) as "Distance_from_centromere" from {POINTS.sql} p left join c using (chrom))"""
TELOMERE_SQL = f"""(with t as (select chrom, arg_max("end", load_seq) filter (where start = 0) as t0, arg_max(start, load_seq) filter (where start <> 0) as t1 from {GAPS.sql} where kind = 'telomere' group by chrom),
s as (select z.chrom, case when t.chrom is null then coalesce((select t0 from t where chrom = 'chr1'), 10000) else coalesce(t0, 0) end as t0,
 case when t.chrom is null then length - coalesce((select t0 from t where chrom = 'chr1'), 10000) else coalesce(t1, length) end as t1 from {SIZES_SQL} z left join t using (chrom))
select p.k, cast(case when "end" <= t0 or start >= t1 then 0 else least(start - t0, t1 - "end") end as bigint) as "Distance_from_telomere" from {POINTS.sql} p left join s using (chrom))"""


@query("centromere_distance", f"select * from {CENTROMERE_SQL}")
def centromere_distance(spark, d):
    return tracks.centromere_distance(POINTS.df(spark, d), GAPS.df(spark, d)).select("k", "Distance_from_centromere")


@query("telomere_distance", f"select * from {TELOMERE_SQL}")
def telomere_distance(spark, d):
    return tracks.telomere_distance(POINTS.df(spark, d), GAPS.df(spark, d), sizes(spark, d)).select("k", "Distance_from_telomere")


# --- all 13 columns ---------------------------------------------------------------------------------

@query("genome_features", f"""
select a.k, "Distance_from_centromere", "Distance_from_telomere", dn.v::double as "DHS_signalValue", dn.distance as "distance_from_DHS", nu.v as nucleosome_mapping, nu.distance as length_from_nucleosome,
 sc.v as genomic_subcompartment, "NGG_exon_signalValue", "opposite_exon_signalValue", "in_NGG_exon", "in_opposite_exon", in_tx, in_cds
from {CENTROMERE_SQL} a join {TELOMERE_SQL} b using (k)
join {sql_stepped('text_value', 'p.v <> ' + chr(39) + '0' + chr(39), 50, 100, False, POINTS, TRACK)} dn using (k)
join {sql_stepped('number_value', 'p.v <> 0', 1, 1000, True, POINTS, TRACK)} nu using (k)
join {sql_endpoint(_SUB_CODE, '0', True)} sc using (k)
join {sql_strand('quantity', 'replicate', 3, 'NGG_exon_signalValue', 'opposite_exon_signalValue')} ex using (k)
join {sql_strand('1', '', 1, 'in_NGG_exon', 'in_opposite_exon', EXONS)} me using (k) join {sql_genes()} ge using (k)""")
def genome_features(spark, d):
    from protoscan.fixed import GENOME_FEATURES

    return add_genome_features(spark, d, POINTS.df(spark, d)).select("k", *GENOME_FEATURES)


def add_genome_features(spark, d, sites: DataFrame) -> DataFrame:
    base = TRACK.df(spark, d)
    return tracks.genome_features(
        sites, gaps=GAPS.df(spark, d), sizes=sizes(spark, d), dnase=base.withColumn("value", F.col("text_value")),
        nucleosomes=base.withColumn("value", F.col("number_value")),
        subcompartments=base.withColumn("value", tracks.subcompartment_code(F.expr(_LABEL_SQL)).cast("double")),
        expression=base.withColumn("value", F.col("quantity")), expression_replicates=3, genes=genes(spark, d), cell_line="HEK293",
    )


# --- tracks of several cell lines -------------------------------------------------------------------
# every other interval belongs to the second line; a third is known without expression, a fourth not at all
_LINE_OF = "case cast(l_suppkey % 2 as int) when 0 then 'HEK293' else 'K56' end"
LINE_TRACK = Derived("lineitem", {**TRACK.columns, "genome": "'hg19'", "cell_line": _LINE_OF})
LINE_POINTS = layered("orders", dict(POINTS.layers[0], genome="'hg19'", cell_line="case cast(o_orderkey % 5 as int) when 0 then 'HEK293' when 1 then 'K56' when 2 then 'mESCs' when 3 then 'U2OS' else null end"), *POINTS.layers[1:])
_REGISTRY = [("hg19", "HEK293", "dnase", 1), ("hg19", "K56", "dnase", 1), ("hg19", "U2OS", "dnase", 1), ("hg19", "HEK293", "expression", 3), ("hg19", "K56", "expression", 2), ("hg19", "mESCs", "expression", 4),
             ("hg19", "HEK293", "methylation", 3), ("hg19", "K56", "methylation", 2), ("hg19", "mESCs", "methylation", 2), ("hg19", "HEK293", "H3K27me", 3), ("hg19", "K56", "H3K27me", 3), ("mm9", "U2OS", "H3K27me", 1)]


def registry(spark):
    return spark.createDataFrame(_REGISTRY, "genome string, cell_line string, mark string, replicates int")


class _Part:
    """One cell line of a source, as SQL."""

    def __init__(self, source, line: str):
        self.sql = f"(select * from {source.sql} where cell_line = '{line}')"


def sql_by_line(of_line, columns: list[str], lines: dict[str, int]) -> str:
    """The rows of every line with data from the plain form of a query; all other points get nulls."""
    parts = " union all ".join(f"select k, {', '.join(columns)} from {of_line(line, n)}" for line, n in lines.items())
    names = ", ".join(f"'{x}'" for x in lines)
    return f"({parts} union all select k, {', '.join('null' for _ in columns)} from {LINE_POINTS.sql} where cell_line is null or cell_line not in ({names}))"


def sql_line_replicates(stranded: bool, n: int, line: str) -> str:
    return sql_replicates(stranded, n, "v", _Part(LINE_POINTS, line), _Part(LINE_TRACK, line))


@query("replicate_mean_by_cell_line", f"""
select a.k, a.v as methylation, b.v as histone from {sql_by_line(lambda x, n: sql_line_replicates(True, n, x), ["v"], {"HEK293": 3, "K56": 2})} a
join {sql_by_line(lambda x, n: sql_line_replicates(False, n, x), ["v"], {"K56": 3})} b using (k)""")
def replicate_mean_by_cell_line(spark, d):
    base = track(spark, d, "text_value", LINE_TRACK)
    got = tracks.replicate_mean_by_line(LINE_POINTS.df(spark, d), base, registry(spark), "methylation", "methylation", stranded=True)
    return tracks.replicate_mean_by_line(got, base, registry(spark), "H3K27me", "histone").select("k", "methylation", "histone")


_EXPRESSED = ['"NGG_exon_signalValue"', '"opposite_exon_signalValue"']


def sql_line_expression(line: str, n: int) -> str:
    return sql_strand("quantity", "replicate", n, "NGG_exon_signalValue", "opposite_exon_signalValue", _Part(LINE_TRACK, line), points=_Part(LINE_POINTS, line))


@query("strand_signal_by_cell_line", f"select * from {sql_by_line(sql_line_expression, _EXPRESSED, {'HEK293': 3, 'K56': 2})}")
def strand_signal_by_cell_line(spark, d):
    got = tracks.strand_signal_by_line(LINE_POINTS.df(spark, d), track(spark, d, "quantity", LINE_TRACK), registry(spark), "expression", "NGG_exon_signalValue", "opposite_exon_signalValue")
    return got.select("k", "NGG_exon_signalValue", "opposite_exon_signalValue")


def sql_line_dnase(line: str, n: int) -> str:
    return f"(select k, v::double as v, distance from {sql_stepped('text_value', 'p.v <> ' + chr(39) + '0' + chr(39), 50, 100, False, _Part(LINE_POINTS, line), _Part(LINE_TRACK, line))})"


@query("genome_features_by_cell_line", f"""
select p.k, dn.v as "DHS_signalValue", dn.distance as "distance_from_DHS", nu.v as nucleosome_mapping, nu.distance as length_from_nucleosome, ex."NGG_exon_signalValue", ex."opposite_exon_signalValue", in_tx, in_cds
from {LINE_POINTS.sql} p join {sql_by_line(sql_line_dnase, ["v", "distance"], {"HEK293": 1, "K56": 1, "U2OS": 1})} dn using (k)
join {sql_stepped('number_value', 'p.v <> 0', 1, 1000, True, POINTS, TRACK)} nu using (k)
join {sql_by_line(sql_line_expression, _EXPRESSED, {'HEK293': 3, 'K56': 2})} ex using (k) join {sql_genes()} ge using (k)""")
def genome_features_by_cell_line(spark, d):
    got = add_line_features(spark, d, LINE_POINTS.df(spark, d))
    return got.select("k", "DHS_signalValue", "distance_from_DHS", "nucleosome_mapping", "length_from_nucleosome", "NGG_exon_signalValue", "opposite_exon_signalValue", "in_tx", "in_cds")


def add_line_features(spark, d, sites: DataFrame) -> DataFrame:
    """All 13 columns for sites with genome and cell_line."""
    lined, base = LINE_TRACK.df(spark, d), TRACK.df(spark, d)
    return tracks.genome_features(
        sites, gaps=GAPS.df(spark, d), sizes=sizes(spark, d), dnase=lined.withColumn("value", F.col("text_value")),
        nucleosomes=base.withColumn("value", F.col("number_value")),
        subcompartments=base.withColumn("value", tracks.subcompartment_code(F.expr(_LABEL_SQL)).cast("double")),
        expression=lined.withColumn("value", F.col("quantity")), genes=genes(spark, d), registry=registry(spark),
    )


# --- expression and splice events -----------------------------------------------------------------------
REGIONS = Derived("lineitem", {
    "accession": "cast(l_orderkey as string)", "chrom": "concat('chr', cast(l_linenumber as string))", "start": "l_orderkey * 10", "end": "l_orderkey * 10 + cast(l_quantity as bigint)",
    "strand": "case when l_linestatus = 'O' then '+' else '-' end", "entrez": "cast(l_partkey as string)", "value": "l_quantity", "load_seq": "l_partkey * 1000000000000 + l_suppkey * 100000000 + l_orderkey",
})


@query("expression_map", f"""
with e as (select cast(c_custkey as string) as entrez, (c_acctbal + c_nationkey + 1) / 3.0::double as expression from customer)
select chrom, start, "end", load_seq, case when expression is null then '-' when strand = '-' then '-' else '+' end as track_strand, coalesce(expression, value) as value from {REGIONS.sql} r left join e using (entrez)""")
def expression_map(spark, d):
    ids = table(spark, d, "customer").selectExpr("cast(c_custkey as string) as entrez", "(c_acctbal + c_nationkey + 1) / 3.0D as expression")
    return tracks.expression_intervals(REGIONS.df(spark, d), ids).select("chrom", "start", "end", "load_seq", "track_strand", "value")


PSL = Derived("lineitem", {
    "accession": "cast(l_partkey as string)", "line": "l_orderkey * 1000 + l_suppkey", "matches": "cast(l_quantity as bigint)", "chrom": "concat('chr', cast(l_linenumber as string))",
    "strand": "case when l_linestatus = 'O' then '+' else '-' end", "base": "l_orderkey * 100",
})


@query("best_alignment_exons", f"""
with b as (select *, row_number() over (partition by accession order by matches desc, line) as rn from {PSL.sql})
select accession, chrom, strand, i as number, base + 30 * i + 1 as start, base + 30 * i + 10 + i as "end" from b, range(0, 3) t(i) where rn = 1""")
def best_alignment_exons(spark, d):
    psl = PSL.df(spark, d).selectExpr("*", "array(base, base + 30, base + 60) as starts", "array(10L, 11L, 12L) as sizes")
    return splice.best_alignments(psl).select("accession", "chrom", "strand", F.posexplode("exons").alias("number", "e")).select("accession", "chrom", "strand", "number", "e.start", "e.end")


FEATURE_TABLE = Derived("lineitem", {"accession": "cast(l_partkey as string)", "type": "case l_returnflag when 'A' then 'CDS' when 'N' then 'exon' else 'gene' end",
                                     "position": "l_orderkey * 1000 + l_suppkey", "location": "concat(cast(l_orderkey as string), '..', cast(l_orderkey + 50 as string))"})


@query("coding_and_exon_features", f"""
select accession, 'CDS' as type, arg_min(location, position) as location from {FEATURE_TABLE.sql} where type = 'CDS' group by accession
union all select accession, 'exon', location from {FEATURE_TABLE.sql} where type = 'exon'""")
def coding_and_exon_features(spark, d):
    rows = FEATURE_TABLE.df(spark, d)
    coding = splice.first_coding_feature(rows).select("accession", F.lit("CDS").alias("type"), "location")
    return coding.unionByName(splice.exon_features(rows).select("accession", F.lit("exon").alias("type"), "location"))


# runs of up to a few rows: the accession changes with the user's block and the hour of the event
EVENTS = layered(
    "events",
    {"line": "event_id", "user": "user_id", "kind": "event_type", "amount": "value"},
    {"accession": "concat('NM_', cast(cast(floor(line / 4) as bigint) % 37 as string))", "entrez": "cast(user as string)", "first": "user % 6 + 1", "second": "(user + line) % 5 + 1",
     "region": "case when line % 11 = 0 then '5 UTR' else 'CDS' end",
     "event_type": "case kind when 'view' then 'exon skipped' when 'signup' then 'intron retention' when 'purchase' then 'exons skipped' when 'error' then 'novel exon' else '---' end",
     "c4": "amount", "c5": "amount + 1", "c6": "amount + 2"},
    {"location": "case cast(line % 5 as int) when 0 then cast(first as string) when 1 then concat(cast(first as string), '<>', cast(second as string)) when 2 then cast(second as string)"
                 " when 3 then concat(cast(second as string), '><', cast(first as string)) else case when line % 35 = 4 then '<<<1' else cast(first as string) end end"},
)
# genes of the splice fold: accessions 0..29 (the others are unknown), 2 to 6 exons
GENE_EXONS_SQL = """(select concat('NM_', cast(c_custkey as string)) as accession, concat('chr', cast(c_nationkey % 7 + 1 as string)) as chrom, case when c_custkey % 2 = 0 then '+' else '-' end as strand,
 c_custkey % 5 + 2 as n, i as number, c_custkey * 1000 + i * 100 as start, c_custkey * 1000 + i * 100 + 50 as "end" from customer, range(1, 8) t(i) where i <= c_custkey % 5 + 2 and c_custkey % 8 <> 7)"""


def splice_genes(spark, d) -> DataFrame:
    kept = table(spark, d, "customer").filter("c_custkey % 8 != 7")
    return kept.selectExpr(
        "concat('NM_', cast(c_custkey as string)) as accession", "concat('chr', cast(c_nationkey % 7 + 1 as string)) as chrom", "case when c_custkey % 2 = 0 then '+' else '-' end as strand",
        "transform(sequence(1L, c_custkey % 5 + 2), i -> struct(c_custkey * 1000 + i * 100 as start, c_custkey * 1000 + i * 100 + 50 as end)) as exons")


@query("splice_fold", f"""
with g as materialized (select * from {GENE_EXONS_SQL}), n as (select distinct accession, n from g),
l as (select v.*, n.n, least(cast(regexp_extract(location, '^([0-9]+)', 1) as bigint), cast(regexp_extract(location, '([0-9]+)$', 1) as bigint)) as low, greatest(cast(regexp_extract(location, '^([0-9]+)', 1) as bigint), cast(regexp_extract(location, '([0-9]+)$', 1) as bigint)) as high
 from {EVENTS.sql} v left join n using (accession) where region = 'CDS' and not location like '<<<%' and not location like '%>>>'),
e as (select *, lag(accession) over (order by line) as before, lag(location) over (order by line) = location and lag(event_type) over (order by line) = event_type and lag(accession) over (order by line) = accession as repeated
 from l where n is null or (event_type <> '---' and high <= n)),
a as (select *, sum(case when before is distinct from accession then 1 else 0 end) over (order by line) as run from e),
u as (select * from a where repeated is distinct from true and n is not null),
runs as (select run, accession, arg_min((c4 + c5 + c6) / 3.0::double, line) as value, arg_max(entrez, line) as entrez from u group by all),
gone as (select distinct run, unnest(range(low, high + 1)) as number from u where high <= n and event_type in ('exon skipped', 'exons skipped')),
kept_in as (select distinct run, low as number from u where high <= n and low < n and event_type in ('intron retention', 'novel exon', 'novel exons'))
select runs.run, accession, 'exon' as type, chrom, g.number, g.start, g."end", strand, entrez, value from runs join g using (accession) left join gone on gone.run = runs.run and gone.number = g.number where gone.run is null
union all
select runs.run, accession, 'intron', g.chrom, g.number, g."end", h."end", g.strand, entrez, value from runs join g using (accession) join kept_in k on k.run = runs.run and k.number = g.number join g h on h.accession = runs.accession and h.number = g.number + 1""")
def splice_fold(spark, d):
    got = splice.fold_events(EVENTS.df(spark, d), splice_genes(spark, d))
    return got.select("run", "accession", "type", "chrom", "number", "start", "end", "strand", "entrez", "value")
