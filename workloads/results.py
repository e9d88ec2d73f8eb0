"""Scoring, result tables, imports, catalogs and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protoscan.fixed import MODEL_INPUTS, PAM_LEN, SEARCH_MAX_EDITS
from protoscan.functions.shape import load_table
from protoscan.operators import align, catalog, features, genome, model, post, scan, search
from protoscan.plans import offtargets, pair_scoring, sequence_scan
from protoscan.sources.pairs import guides_in_text, parse_pairs
from protoscan.sources.sam import parse_hits
from workloads import tracks as track_queries
from workloads.base import CONTIGS_SQL, NEAR_PAIRS, SITES, Derived, contigs, dna, layered, query, table
from workloads.sequence import NEAR_ALIGNED_SQL, shape_table, sql_codes, sql_count, sql_features, sql_gapped, sql_global, sql_rc, sql_scan, sql_scan_context

# --- models -----------------------------------------------------------------------------
# Stand-ins for trained members, made by rule. Leaf values are eighths, so sums are exact.
_NUMERIC = ["pa_score", "mms_cnt", "dna_enthalpy", "nA", "nC", "nT", "nG", "id_pos1", "id_pos2", "id_pos3", "PAM_N_id", "mismatches_1_4", "mismatches_13_16", "wobble_total", "nuc_id_afterPAM1"]
_CUTS = {"pa_score": 19.5, "mms_cnt": 0.5, "dna_enthalpy": 170.0}


def _cut(feature: str, member: int) -> float:
    return _CUTS.get(feature, 0.5 if "mismatch" in feature or "total" in feature else (4.5 if feature.startswith("n") and len(feature) == 2 else 1.5 + member % 3))


def stump_rows(members: int = 10) -> list[tuple]:
    """Members of one split each: (member, tree, node, feature, threshold, left, right, value)."""
    rows = []
    for m in range(members):
        f = _NUMERIC[(m * 7) % len(_NUMERIC)]
        rows += [(m, 0, 0, f, _cut(f, m), 1, 2, None), (m, 0, 1, None, None, None, None, (m % 5) * 2.5), (m, 0, 2, None, None, None, None, 12.5 - m % 4)]
    return rows


def deep_rows(members: int = 10, depth: int = 5) -> list[tuple]:
    """Members of one full tree each; the children of node i are 2i+1 and 2i+2."""
    rows = []
    inner = 2**depth - 1
    for m in range(members):
        for n in range(2 * inner + 1):
            if n < inner:
                f = _NUMERIC[(m * 3 + n * 5) % len(_NUMERIC)]
                rows.append((m, 0, n, f, _cut(f, m + n), 2 * n + 1, 2 * n + 2, None))
            else:
                rows.append((m, 0, n, None, None, None, None, ((n * 13 + m * 7) % 97) / 8.0))
    return rows


def ensemble(spark, rows: list[tuple], mode: str = "noflanking") -> model.TreeEnsemble:
    return model.TreeEnsemble(spark.createDataFrame(rows, model.NODE_SCHEMA), MODEL_INPUTS[mode])


def sql_score(rows: list[tuple]) -> str:
    by_member: dict[int, dict[int, tuple]] = {}
    for r in rows:
        by_member.setdefault(r[0], {})[r[2]] = r

    def branch(nodes: dict[int, tuple], at: int) -> str:
        r = nodes[at]
        if r[3] is None:
            return f"{r[7]}::double"
        return f"case when \"{r[3]}\"::double <= {r[4]}::double then {branch(nodes, r[5])} else {branch(nodes, r[6])} end"

    total = " + ".join(branch(nodes, 0) for nodes in by_member.values())
    return f"least(({total}) / {float(len(by_member))}::double / 8.22::double, 1.0::double)"


def near_features(spark, d) -> DataFrame:
    return features.sequence_features(align.best_placement(NEAR_PAIRS.df(spark, d)), load_table(shape_table(spark)))


@query("ensemble_score", f"select k, {sql_score(stump_rows())} as score from {sql_features(NEAR_ALIGNED_SQL)}")
def ensemble_score(spark, d):
    return model.score(near_features(spark, d), ensemble(spark, stump_rows())).select("k", "score")


@query("ensemble_score_deep", f"select k, {sql_score(deep_rows())} as score from {sql_features(NEAR_ALIGNED_SQL)}")
def ensemble_score_deep(spark, d):
    return model.score(near_features(spark, d), ensemble(spark, deep_rows())).select("k", "score")


_MODE = "case when k % 3 = 0 then 'flanking' else 'noflanking' end"


@query("mode_routing", f"select k, {_MODE} as mode, case when k % 3 = 0 then {sql_score(stump_rows(4))} else {sql_score(stump_rows(10))} end as score from {sql_features(NEAR_ALIGNED_SQL)}")
def mode_routing(spark, d):
    models = {"flanking": ensemble(spark, stump_rows(4)), "noflanking": ensemble(spark, stump_rows(10))}
    return model.score_by_mode(near_features(spark, d).withColumn("mode", F.expr(_MODE)), models).select("k", "mode", "score")


@query("mode_routing_deep", f"select k, {_MODE} as mode, case when k % 3 = 0 then {sql_score(deep_rows(4))} else {sql_score(deep_rows(10))} end as score from {sql_features(NEAR_ALIGNED_SQL)}")
def mode_routing_deep(spark, d):
    models = {"flanking": ensemble(spark, deep_rows(4)), "noflanking": ensemble(spark, deep_rows(10))}
    return model.score_by_mode(near_features(spark, d).withColumn("mode", F.expr(_MODE)), models).select("k", "mode", "score")


@query("rf_train_predict")
def rf_train_predict(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as k", "l_quantity as q", "l_discount as x", "l_tax as t", "l_extendedprice / 10000 as label")
    fitted = model.fit_members(rows, ["q", "x", "t"], "label", members=2, trees=5, depth=4)
    return model.score_with_ml(rows, fitted).select("k", "score")


# --- result tables -------------------------------------------------------------------------
HITS = Derived("lineitem", {
    "guide": "concat('G', cast(l_suppkey % 5 as string))", "chrom": "concat('chr', cast(l_linenumber as string))", "strand": "case when l_linestatus = 'O' then '+' else '-' end",
    "start": "l_orderkey % 1500", "end": "l_orderkey % 1500 + 20 + l_partkey % 5", "score": "floor(l_extendedprice / 1000) / 128", "id": "l_partkey * 1000000000000 + l_suppkey * 100000000 + l_orderkey",
})
_ORDER = 'score desc, chrom, strand, start, "end", guide, id'


@query("dedupe_best", f"""
with a as (select *, row_number() over (partition by guide, chrom, strand, start order by {_ORDER}) as r1 from {HITS.sql}),
b as (select *, row_number() over (partition by guide, chrom, strand, "end" order by {_ORDER}) as r2 from a where r1 = 1)
select guide, chrom, strand, start, "end", score, id from b where r2 = 1""")
def dedupe_best(spark, d):
    return post.drop_duplicates(HITS.df(spark, d), within=["guide"])


@query("rank_by_score", f'select guide, chrom, strand, start, "end", score, id, row_number() over (order by {_ORDER}) as rank from {HITS.sql}')
def rank_by_score(spark, d):
    return post.rank_by_score(HITS.df(spark, d))


@query("rank_per_guide", f'select guide, chrom, strand, start, "end", score, id, row_number() over (partition by guide order by {_ORDER}) as rank from {HITS.sql}')
def rank_per_guide(spark, d):
    return post.rank_by_score(HITS.df(spark, d), within=["guide"])


def sql_decode(code: str) -> str:
    cases = {x + y: a + b for x, a in zip("1234", "ACGT") for y, b in zip("1234", "ACGT")}
    cases |= dict(zip("12340", "ACGTN"))
    return f"case {code} " + " ".join(f"when '{k}' then '{v}'" for k, v in cases.items()) + " end"


@query("decode_codes", f"""
select k, {sql_decode(sql_codes('right(site, 2)'))} as "PAM_2_first", {sql_decode(sql_codes('substr(site, 16, 2)'))} as "PamProximalCouple1", {sql_decode(sql_codes('substr(site, 16, 1)'))} as id_pos5,
 {sql_decode("case when flank > 3 then " + sql_codes('substr(context, flank + 27, 1)') + " else '0' end")} as "nuc_id_afterPAM4" from {SITES.sql}""")
def decode_codes(spark, d):
    coded = features.site_features(SITES.df(spark, d).withColumn("aln_dna", F.col("site")))
    return post.decode_nucleotides(coded).select("k", "PAM_2_first", "PamProximalCouple1", "id_pos5", "nuc_id_afterPAM4")


@query("display_rename", f"select k, {sql_count('context', 'A')} as \"A count\", {sql_count('context', 'C')} as \"nC\" from {SITES.sql}")
def display_rename(spark, d):
    counted = SITES.df(spark, d).select("k", *features.nucleotide_counts("context")).select("k", "nA", "nC")
    return post.rename_for_display(counted, {"nA": "A count", "nT": "T count"})


# --- imports ------------------------------------------------------------------------------------
_CIGARS = "case cast({} % 4 as int) when 0 then '23M' when 1 then '10M1D13M' when 2 then '5M2I16M' else '3S20M' end"
SAM = layered(
    "orders",
    {"k": "o_orderkey", "seq": dna("o_orderkey", 23, "g"), "contig": "cast(o_custkey as string)", "pos": "o_orderkey % 500 + 1"},
    {"text": f"concat('q', cast(k as string), chr(9), case when k % 2 = 0 then '0' else '16' end, chr(9), case when k % 10 = 9 then '*' else contig end, chr(9), case when k % 10 = 9 then '0' else cast(pos as string) end, chr(9), '37', chr(9), {_CIGARS.format('k')}, chr(9), '*', chr(9), '0', chr(9), '0', chr(9), seq, chr(9), 'IIII',"
             f" case when k % 3 = 0 then concat(chr(9), 'XA:Z:', contig, ',+', cast(pos + 7 as string), ',', {_CIGARS.format('(k + 1)')}, ',2;', 'X,-', cast(pos + 90 as string), ',23M,1;') else '' end)"},
)
_SPAN = "list_sum(list_transform(regexp_extract_all({0}, '([0-9]+)[MSD]', 1), lambda x: cast(x as bigint)))"


@query("sam_import", f"""
with r as (select k, string_split(text, chr(9)) as f from {SAM.sql}),
p as (select k, concat('chr', f[3]) as contig, case when (f[2]::int & 16) <> 0 then '-' else '+' end as strand, f[4]::bigint as start, f[6] as cigar, 1 as is_primary from r where not (f[3] = '*' and f[4] = '0')),
x as (select k, string_split(unnest(string_split(substr(f[12], 6), ';')), ',') as a from r where len(f) > 11 and not (f[3] = '*' and f[4] = '0')),
h as (select * from p union all select k, concat('chr', a[1]), left(a[2], 1), substr(a[2], 2)::bigint, a[3], 0 from x where len(a) = 4)
select k, contig, strand, start, start + cast({_SPAN.format('cigar')} as bigint) - 1 as "end", cigar, is_primary from h""")
def sam_import(spark, d):
    got = parse_hits(SAM.df(spark, d).select("k", "text"))
    return got.select("k", "contig", "strand", "start", "end", "cigar", F.col("primary").cast("int").alias("is_primary"))


@query("sam_hit_filter", f"""
with r as (select k, concat('doc', cast(o_custkey as string)) as contig, case when k % 2 = 0 then '+' else '-' end as strand, pos as start, pos + 22 as "end" from (select *, o_orderkey as k, o_orderkey % 500 + 1 as pos from orders)),
c as (select r.*, case when strand = '-' then {sql_rc('substr(seq, cast(start - 100 as int), 223)')} else substr(seq, cast(start - 100 as int), 223) end as context from r join {CONTIGS_SQL} using (contig) where start > 100 and "end" + 100 <= length(seq))
select k, contig, strand, start, "end", substr(context, 101, 23) as site from c where regexp_full_match(substr(context, 122, 2), '[AG]{{2}}')""")
def sam_hit_filter(spark, d):
    hits = table(spark, d, "orders").selectExpr("o_orderkey as k", "concat('doc', cast(o_custkey as string)) as contig", "case when o_orderkey % 2 = 0 then '+' else '-' end as strand", "o_orderkey % 500 + 1 as start", "o_orderkey % 500 + 23 as end")
    around = genome.site_contexts(hits, genome.chunk_contigs(contigs(spark, d)), 100)
    return search.usable_hits(around.withColumn("site", F.substring("context", 101, 23))).select("k", "contig", "strand", "start", "end", "site")


@query("guide_list_parse", """
select distinct upper(unnest(regexp_split_to_array(trim(regexp_replace(trim(regexp_replace(text, '[^A-Za-z ]', ',', 'g')), ',+', ' ', 'g')), '\\s+'))) as guide from conversations""")
def guide_list_parse(spark, d):
    plain = table(spark, d, "conversations").select(F.regexp_replace("text", "[^A-Za-z ]", ",").alias("text"))
    return guides_in_text(plain, "text")


# --- genome search --------------------------------------------------------------------------------

def benchmark_guides(spark, d) -> DataFrame:
    """Guides of all sites in the benchmark passages, which the documents partly repeat."""
    chunks = genome.chunk_contigs(contigs(spark, d, "benchmark", "item_id", "item"))
    return scan.scan_sites(chunks, 0).select(F.left("site", F.lit(20)).alias("guide")).distinct()


_BENCH_SQL = "(select concat('item', cast(item_id as string)) as contig, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as seq from benchmark)"


_GUIDES_SQL = f"""(select distinct left(site, 20) as guide from {sql_scan(0, _BENCH_SQL)})"""


def sql_hits(max_gaps: int = 3, pam_costs: bool = True) -> str:
    """guide, contig, strand, start, end, d (letters before the PAM), pam, edits of all spans within the limits, from the rule.

    Unless ``pam_costs``, the letters of the PAM are free and the guide's own four edits are the only limit.

    Edits are the edit distance. With four edits at most and three gap letters at most the two differ only where
    four gap letters are the one way: those pairs are walked step by step.
    """
    spans = f"range({20 - max_gaps}, {21 + max_gaps})"
    distance = "levenshtein(guide, d)" if max_gaps else "hamming(guide, d)"
    # a span of another length is at most three edits from the one of 20 letters
    rough = f"{distance.split('(')[0]}(guide, right(letters, 20))"
    spent = "length(replace(substr(s, e - 1, 2), 'G', ''))" if pam_costs else "0"
    return f"""(with recursive s as (select contig, '+' as strand, seq as s from {CONTIGS_SQL} union all select contig, '-', {sql_rc('seq')} from {CONTIGS_SQL}),
e as (select contig, strand, s, length(s) as n, unnest(range(3, length(s) + 1)) as e from s),
p as (select contig, strand, n, e, substr(s, greatest(e - 25, 1), least(23, e - 3)) as letters, substr(s, e - 2, 3) as pam, {spent} as spent from e where regexp_full_match(substr(s, e - 1, 2), '[AG]{{2}}')),
near as (select * from {_GUIDES_SQL} g, p where length(letters) >= {20 - max_gaps} and {rough} + 1 + spent <= 5 + {max_gaps}),
w as (select guide, contig, strand, n, e, pam, spent, l, right(letters, l) as d from near, (select unnest({spans}) as l) where l <= length(letters)),
c as (select *, {distance} as edits from w where {distance} + 1 + spent <= 5),
hard as (select row_number() over () as id, * from c where {max_gaps} > 0 and edits = 4 and l % 2 = 0),
walk(id, i, j, gaps, edits) as (select id, 0, 0, 0, 0 from hard union
 select id, walk.i + m.i, walk.j + m.j, gaps + m.gap, walk.edits + case when m.gap = 1 or substr(guide, walk.i + 1, 1) <> substr(d, walk.j + 1, 1) then 1 else 0 end
 from walk join hard h using (id), (values (1, 1, 0), (1, 0, 1), (0, 1, 1)) m(i, j, gap)
 where walk.i + m.i <= 20 and walk.j + m.j <= l and gaps + m.gap <= {max_gaps} and walk.edits + case when m.gap = 1 or substr(guide, walk.i + 1, 1) <> substr(d, walk.j + 1, 1) then 1 else 0 end <= 4),
kept as (select h.* exclude (id) from hard h join (select distinct id, i, j from walk) r using (id) where r.i = 20 and r.j = l union all select * from c where not ({max_gaps} > 0 and edits = 4 and l % 2 = 0))
select guide, contig, strand, case strand when '+' then e - 2 - l else n - e + 1 end as start, case strand when '+' then e else n - (e - 2 - l) + 1 end as "end", d, pam, l, edits from kept)"""


@query("offtarget_search_ungapped", f"""select guide, contig, strand, start, "end", edits from {sql_hits(0, pam_costs=False)}""")
def offtarget_search_ungapped(spark, d):
    return search.search(benchmark_guides(spark, d), genome.chunk_contigs(contigs(spark, d)), max_gaps=0, budget=SEARCH_MAX_EDITS + PAM_LEN)


@query("offtarget_search", f"""select guide, contig, strand, start, "end", edits from {sql_hits()}""")
def offtarget_search(spark, d):
    return search.search(benchmark_guides(spark, d), genome.chunk_contigs(contigs(spark, d)))


_HITS_SQL = f"""(select row_number() over () as k, h.*, case strand when '+' then substr(seq, start - 100, "end" - start + 201) else {sql_rc('substr(seq, start - 100, "end" - start + 201)')} end as context, concat(d, pam) as site, 100 as flank
 from {sql_hits()} h join {CONTIGS_SQL} s using (contig) where start > 100 and "end" + 100 <= length(seq))"""


@query("offtarget_end_to_end", f"""
with h as materialized (select * from {_HITS_SQL}),
t as materialized (select h.*, concat(z.a, 'NGG') as aln_rna, concat(z.b, pam) as aln_dna, z.s / 4.0::double as pa_score from h join {sql_global('(select k, guide as g, d, 23 - l as f from h)')} using (k)),
s as materialized (select t.guide, t.contig as chrom, t.strand, t.start, t."end", t.aln_rna, t.aln_dna, f.pa_score, mms_cnt, total_bulges, {sql_score(stump_rows())} as score from {sql_features('t')} f join (select k, guide, contig, strand, start, "end", aln_rna, aln_dna from t) t using (k)),
one as (select * from s qualify row_number() over (partition by guide, chrom, strand, start order by score desc, "end") = 1),
two as (select * from one qualify row_number() over (partition by guide, chrom, strand, "end" order by score desc, start) = 1)
select *, row_number() over (partition by guide order by score desc, chrom, strand, start, "end") as rank from two""")
def offtarget_end_to_end(spark, d):
    chunks = genome.chunk_contigs(contigs(spark, d))
    report = offtargets.offtarget_report(benchmark_guides(spark, d), chunks, load_table(shape_table(spark)), ensemble(spark, stump_rows(), "flanking"))
    return report.select("guide", "chrom", "strand", "start", "end", "aln_rna", "aln_dna", "pa_score", "mms_cnt", "total_bulges", "score", "rank")


# --- assembly catalog --------------------------------------------------------------------------------
REQUESTS = Derived("orders", {"k": "o_orderkey", "assembly": "concat('asm', cast(o_custkey as string))"})
REFSEQ = Derived("customer", {"assembly": "concat('asm', cast(c_custkey % 400 as string))", "url": "concat('ftp://refseq/', cast(c_custkey as string), '.fa.gz')", "load_seq": "c_custkey"})
PLANTS = Derived("part", {"value": "concat('asm', cast(p_partkey % 700 as string))", "assembly_name": "concat('plant_', cast(p_partkey as string))", "load_seq": "p_partkey"})


@query("assembly_resolve", f"""
with r as (select assembly, arg_min(url, load_seq) as url from {REFSEQ.sql} group by assembly), p as (select value as assembly, arg_min(assembly_name, load_seq) as plant from {PLANTS.sql} group by value)
select k, q.assembly, case when url is not null then 'refseq' when plant is not null then 'plants' else 'ucsc' end as origin,
 coalesce(url, 'ftp://ftp.ensemblgenomes.org/pub/plants/release-44/fasta/' || plant || '/dna/', 'http://hgdownload.cse.ucsc.edu/goldenPath/' || q.assembly || '/bigZips/' || q.assembly || '.fa.gz') as address
from {REQUESTS.sql} q left join r using (assembly) left join p using (assembly)""")
def assembly_resolve(spark, d):
    return catalog.resolve_addresses(REQUESTS.df(spark, d), REFSEQ.df(spark, d), PLANTS.df(spark, d)).select("k", "assembly", "origin", "address")


ASSEMBLIES = Derived("orders", {"assembly": "concat('asm', cast(o_orderkey as string))", "protected": "o_orderstatus = 'F'", "processing": "o_orderkey % 17 = 0",
                                "last_use": "case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) end"})


@query("assembly_evict", f"select assembly from {ASSEMBLIES.sql} where not protected and not processing and (last_use is null or last_use < date '2000-06-01' - 180)")
def assembly_evict(spark, d):
    return catalog.evictable(ASSEMBLIES.df(spark, d), F.lit("2000-06-01").cast("date")).select("assembly")


SCRIPTS = Derived("lineitem", {"script": "cast(l_orderkey as string)", "line": "l_partkey * 1000000000000 + l_suppkey * 100000000 + l_linenumber",
                               "text": "concat('python run.py ', case when l_linenumber % 3 = 0 then '-x ' else '-g ' end, 'hg', cast(l_suppkey as string), ' -n ', cast(l_orderkey as string))"})


@query("usage_backfill", f"""
with s as (select script, arg_max(text, line) as text from {SCRIPTS.sql} group by script)
select distinct regexp_extract(text, '-g (.*?) ', 1) as genome from s where text like '%-g %'""")
def usage_backfill(spark, d):
    return catalog.genomes_in_use(SCRIPTS.df(spark, d))


# --- whole runs ---------------------------------------------------------------------------------------
# guide/context rows of which some are rejected: the near pairs, with short guides and odd contexts mixed in
PAIR_ROWS = layered(
    "orders",
    {"k": "o_orderkey", "g": dna("o_orderkey", 20, "g"), "f": dna("o_orderkey", 9, "f"), "p": "cast(o_orderkey % 20 as int) + 1", "x": "substr('ACGT', cast(cast(floor(o_orderkey / 20) as bigint) % 4 as int) + 1, 1)"},
    {"site": "concat(substr(g, 1, p - 1), x, substr(g, p + 1), substr(f, 1, 1), 'GG')"},
    {"guide_in": "case cast(k % 9 as int) when 1 then lower(g) when 2 then concat(g, 'AGG') when 3 then translate(g, 'T', 'U') when 4 then substr(g, 1, 18) else g end",
     "context": "concat(substr(f, 2, 3), site, substr(f, 5, case when k % 11 = 5 then 2 else 3 end))", "guide": "g", "sgrna": "concat(g, 'NGG')", "flank": "3"},
)
_ACCEPTED_SQL = f"(select * from {PAIR_ROWS.sql} where k % 9 <> 4 and k % 11 <> 5)"
_PAIR_ALIGNED_SQL = f"(select *, sgrna as aln_rna, site as aln_dna, (select count(*) from (select unnest(range(1, 21)) as i) where substr(guide, i, 1) = substr(site, i, 1))::double as pa_score from {_ACCEPTED_SQL})"


@query("pair_scoring_end_to_end", f"""
select k, b.sgrna, b.site, b.aln_rna, b.aln_dna, 'noflanking' as mode, f.pa_score, f.mms_cnt, {sql_score(stump_rows())} as score from {sql_features(_PAIR_ALIGNED_SQL)} f join (select k, sgrna, site, aln_rna, aln_dna from {_PAIR_ALIGNED_SQL}) b using (k)""")
def pair_scoring_end_to_end(spark, d):
    pairs = PAIR_ROWS.df(spark, d).selectExpr("k", "guide_in as guide", "context")
    scored, _ = pair_scoring.score_pairs(pairs, load_table(shape_table(spark)), {"noflanking": ensemble(spark, stump_rows())})
    return scored.select("k", "sgrna", "site", "aln_rna", "aln_dna", "mode", "pa_score", "mms_cnt", "score")


@query("pair_rejects", f"""
select k, case when k % 11 = 5 then 'DNA sequence must be 29 or 223 letters of ACGT' else 'guide must be 20 letters of ACGTU' end as reject_reason from {PAIR_ROWS.sql} where k % 9 = 4 or k % 11 = 5""")
def pair_rejects(spark, d):
    pairs = PAIR_ROWS.df(spark, d).selectExpr("k", "guide_in as guide", "context")
    _, rejected = pair_scoring.score_pairs(pairs, load_table(shape_table(spark)), {})
    return rejected.select("k", "reject_reason")


_SCAN_REL = f"""(select concat(contig, strand, cast(start as string)) as k, contig, strand, start, "end", site, context, 3 as flank, concat(left(site, 20), 'NGG') as aln_rna, site as aln_dna, 20::double as pa_score from {sql_scan_context(3)})"""


@query("sequence_scan_end_to_end", f"""
with t as materialized (select * from {_SCAN_REL}),
s as (select t.contig as chrom, t.strand, t.start, t."end", t.site, {sql_score(stump_rows())} as score from {sql_features('t')} f join (select k, contig, strand, start, "end", site from t) t using (k))
select *, row_number() over (partition by chrom order by score desc, strand, start, "end") as rank from s""")
def sequence_scan_end_to_end(spark, d):
    report = sequence_scan.scan_report(contigs(spark, d), load_table(shape_table(spark)), ensemble(spark, stump_rows()))
    return report.select("chrom", "strand", "start", "end", "site", "score", "rank")


CHROM_PAIRS = layered("orders", {"k": "o_orderkey", "guide": dna("o_orderkey", 20, "g"), "genome": "case when o_orderkey % 4 = 0 then 'mm9' else 'hg19' end", "cell_type": "case cast(o_orderkey % 3 as int) when 0 then '293T' when 1 then 'K562' else 'unheard' end",
                                 "chrom": "cast(o_custkey as string)", "strand": "case when o_orderkey % 2 = 0 then 'plusStrand' else 'minusStrand' end", "start": "case when o_orderkey % 2 = 0 then o_orderkey % 300 + 1 else o_orderkey * 7 % 9000 + 1 end"})
_CHR_CONTIGS = CONTIGS_SQL.replace("'doc'", "'chr'")
# two genomes of the same contig names: the second is the first read backwards
_GENOMES = f"(select 'hg19' as genome, contig, seq from {_CHR_CONTIGS} union all select 'mm9', contig, reverse(seq) from {_CHR_CONTIGS})"


def genomes(spark, d) -> DataFrame:
    first = contigs(spark, d, prefix="chr")
    chunks = lambda df, name: genome.chunk_contigs(df).withColumn("genome", F.lit(name))
    return chunks(first, "hg19").unionByName(chunks(first.withColumn("seq", F.reverse("seq")), "mm9"))


@query("locus_contexts", f"""
with p as (select k, genome, cell_type, concat('chr', chrom) as chrom, case strand when 'plusStrand' then '+' else '-' end as strand, start, start + 22 as "end" from {CHROM_PAIRS.sql}),
c as (select p.*, substr(seq, cast(start - 100 as int), 223) as raw, coalesce(start > 100 and "end" + 100 <= length(seq), false) as whole from p left join {_GENOMES} c on c.contig = p.chrom and c.genome = p.genome)
select k, chrom, strand, start, "end", case when strand = '-' then {sql_rc('raw')} else raw end as context, case when genome = 'hg19' then 'genomic' else 'flanking' end as mode,
 case when genome = 'hg19' then case cell_type when '293T' then 'HEK293' when 'K562' then 'K56' end end as cell_line
from c where whole and (genome <> 'hg19' or cell_type <> 'unheard')""")
def locus_contexts(spark, d):
    got = pair_scoring.locus_contexts(CHROM_PAIRS.df(spark, d), genomes(spark, d)).filter("reject_reason is null")
    return got.select("k", "chrom", "strand", "start", "end", "context", "mode", "cell_line")


@query("locus_scoring_end_to_end")
def locus_scoring_end_to_end(spark, d):
    chunks = genomes(spark, d)
    models = {"genomic": ensemble(spark, stump_rows(), "genomic"), "flanking": ensemble(spark, stump_rows(4), "flanking")}
    scored, _ = pair_scoring.score_loci(
        CHROM_PAIRS.df(spark, d), chunks, load_table(shape_table(spark)), models, lambda sites: track_queries.add_line_features(spark, d, sites),
    )
    return scored.select("k", "chrom", "strand", "start", "end", "mode", "aln_rna", "aln_dna", "pa_score", "chromosome_number", "Distance_from_centromere", "in_tx", "score")


# pair files as lines: two of each layout, a line of text above each header, and what follows it
_FILE_LINES = layered(
    "orders",
    {"k": "o_orderkey", "g": dna("o_orderkey", 20, "g"), "f": dna("o_orderkey", 9, "f"), "q": "cast(o_orderkey % 20 as int) + 1", "c": "cast(o_custkey as string)",
     "strand": "case when o_orderkey % 3 = 0 then 'minusStrand' else 'plusStrand' end", "start": "case when o_orderkey % 11 = 3 then 'here' else cast(o_orderkey % 300 + 1 as string) end"},
    {"guide": "case cast(k % 9 as int) when 1 then lower(g) when 2 then concat(g, 'AGG') when 4 then substr(g, 1, 18) else g end",
     "context": "concat(substr(f, 2, 3), substr(g, 1, q - 1), 'C', substr(g, q + 1), substr(f, 1, 1), 'GG', substr(f, 5, case when k % 7 = 5 then 2 else 3 end))"},
    {"file": "concat('file', cast(k % 4 as string))", "line_seq": "k + 10",
     "text": "case when k % 4 < 2 then concat('t', cast(k as string), ',', guide, ',', context) else concat('\"t', cast(k as string), '\",', guide, ',mm9,293T,', c, ',', strand, ',', start) end"},
)
_HEADERS = [("file0", 1, "a remark, target_id included"), ("file0", 2, "target_id,sgRNA,dna_seq_29nt"), ("file1", 2, '"target_id",sgRNA,dna_seq_29nt'),
            ("file2", 1, ""), ("file2", 3, "target_id,sgRNA,genome,cell,chromosome,strand,start"), ("file3", 4, "target_id,sgRNA,genome,cell,chromosome,strand,start"), ("file3", 5, "   "), ("file9", 1, "no header here")]


def file_lines(spark, d) -> DataFrame:
    return _FILE_LINES.df(spark, d).select("file", "line_seq", "text").unionByName(spark.createDataFrame(_HEADERS, "file string, line_seq long, text string"))


@query("pair_file_parse", f"""
select file, line_seq, concat('t', cast(k as varchar)) as id, guide, case when k % 4 < 2 then context end as context, case when k % 4 >= 2 then 'mm9' end as genome, case when k % 4 >= 2 then '293T' end as cell_type,
 case when k % 4 >= 2 then c end as chrom, case when k % 4 >= 2 then strand end as strand, case when k % 4 >= 2 then try_cast(start as bigint) end as start from {_FILE_LINES.sql}""")
def pair_file_parse(spark, d):
    return parse_pairs(file_lines(spark, d)).drop("input")


_FILE_PAIRS = f"(select k, g as guide, concat(g, 'NGG') as sgrna, upper(context) as context, 3 as flank, substr(context, 4, 23) as site, left(context, 23) as upstream from {_FILE_LINES.sql} where k % 4 < 2 and k % 9 <> 4 and k % 7 <> 5)"
_FILE_CONTEXTS = f"""(select k, g as guide, concat(g, 'NGG') as sgrna, case when p.strand = 'minusStrand' then {sql_rc('substr(seq, spot - 100, 223)')} else substr(seq, spot - 100, 223) end as context
 from (select *, try_cast(start as integer) as spot from {_FILE_LINES.sql}) p join {_GENOMES} c on c.genome = 'mm9' and c.contig = concat('chr', p.c) where k % 4 >= 2 and k % 9 <> 4 and spot > 100 and spot + 122 <= length(seq))"""
_FILE_LOCI = f"(select *, 100 as flank, substr(context, 101, 23) as site, substr(context, 98, 23) as upstream from {_FILE_CONTEXTS})"


@query("score_pair_file", f"""
with a as materialized (select k, guide, sgrna, context, flank, site, upstream from {_FILE_PAIRS} union all select k, guide, sgrna, context, flank, site, upstream from {_FILE_LOCI}),
t as materialized (select a.*, concat(z.a, 'NGG') as aln_rna, concat(z.b, right(site, 3)) as aln_dna, z.s / 4.0::double as pa_score from a join {sql_gapped('a')} q using (k)),
s as (select t.k, flank, case flank when 100 then {sql_score(stump_rows(4))} else {sql_score(stump_rows())} end as score from {sql_features('t')} f join (select k, flank from t) t using (k))
select file, line_seq, concat('t', cast(k as varchar)) as id, case flank when 100 then 'flanking' else 'noflanking' end as mode, score from s join (select k, file, line_seq from {_FILE_LINES.sql}) l using (k)""")
def score_pair_file(spark, d):
    models = {"noflanking": ensemble(spark, stump_rows()), "flanking": ensemble(spark, stump_rows(4), "flanking")}
    scored, _ = pair_scoring.score_pair_rows(parse_pairs(file_lines(spark, d)), load_table(shape_table(spark)), models, genomes(spark, d))
    return scored.select("file", "line_seq", "input.id", "mode", "score")
