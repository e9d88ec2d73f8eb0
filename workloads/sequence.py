"""Validation, sequence features, alignment and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protoscan.fixed import CHROMOSOME_NUMBER, CELL_LINES, ENTHALPY_TENTHS, SEQUENCE_FEATURES
from protoscan.functions import aligned, seq as S, validate as V
from protoscan.functions.shape import load_table
from protoscan.operators import align, features, genome, metrics, scan
from workloads.base import ALIGNED, CONTIGS_SQL, EDITED_PAIRS, LONG, NEAR_PAIRS, RAW_CONTEXTS, RAW_GUIDES, SITES, contigs, dna, layered, query, table


def sql_rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def sql_codes(s: str) -> str:
    return f"translate(regexp_replace({s}, '[^ACGT]', 'N', 'g'), 'ACGTN', '12340')"


def sql_count(s: str, letter: str) -> str:
    return f"cast(length({s}) - length(replace({s}, '{letter}', '')) as bigint)"


# --- validation ------------------------------------------------------------------------

@query("guide_normalise", f"""
select k, concat(replace(upper(case when length(raw) = 23 and upper(raw) like '%GG' then left(raw, 20) else raw end), 'U', 'T'), 'NGG') as sgrna,
       case when length(raw) = 23 and upper(raw) like '%GG' then 1 else 0 end as was_cut
from {RAW_GUIDES.sql}""")
def guide_normalise(spark, d):
    return RAW_GUIDES.df(spark, d).select("k", V.normalise_guide("raw").alias("sgrna"), V.carries_pam("raw").cast("int").alias("was_cut"))


@query("guide_validate", f"""
with g as (select k, concat(replace(upper(case when length(raw) = 23 and upper(raw) like '%GG' then left(raw, 20) else raw end), 'U', 'T'), 'NGG') as sgrna from {RAW_GUIDES.sql})
select k, case when regexp_matches(sgrna, '^[ACGTU]{{20}}([^ACGTU]|$)') then 1 else 0 end as valid from g""")
def guide_validate(spark, d):
    return RAW_GUIDES.df(spark, d).select("k", V.guide_is_valid(V.normalise_guide("raw")).cast("int").alias("valid"))


@query("context_validate_mode", f"""
select k, case when length(raw) in (29, 223) and regexp_full_match(upper(raw), '[ACGT]*') then 1 else 0 end as valid,
       case when length(raw) = 223 then 'flanking' else 'noflanking' end as mode,
       case when length(raw) = 223 then substr(upper(raw), 101, 23) else substr(upper(raw), 4, length(raw) - 6) end as site
from {RAW_CONTEXTS.sql}""")
def context_validate_mode(spark, d):
    checked = V.check_pairs(RAW_CONTEXTS.df(spark, d).withColumn("guide", F.left("s", F.lit(20))).withColumnRenamed("raw", "context"))
    return checked.select("k", F.col("reject_reason").isNull().cast("int").alias("valid"), "mode", "site")


LOCI = layered(
    "orders",
    {"k": "o_orderkey",
     "raw_chrom": "case cast(o_orderkey % 5 as int) when 0 then concat('Chr', cast(o_custkey % 22 + 1 as string)) when 1 then cast(o_custkey % 22 + 1 as string) when 2 then 'chrX' when 3 then 'y' else 'CHRm' end",
     "raw_strand": "case cast(o_orderkey % 4 as int) when 0 then 'plusStrand' when 1 then 'minusStrand' when 2 then '+' else '-' end",
     "alias": "case cast(o_orderkey % 6 as int) when 0 then '293T' when 1 then 'Hek293' when 2 then 'k562' when 3 then 'U2OS' when 4 then 'hIPS' else o_orderstatus end"},
)
_CELL_CASE = " ".join(f"when '{a}' then '{c}'" for a, c in CELL_LINES.items())
_NUMBER_CASE = " ".join(f"when '{a}' then '{c}'" for a, c in CHROMOSOME_NUMBER.items())


@query("chrom_strand_normalise", f"""
with a as (select k, concat('chr', upper(case when upper(left(raw_chrom, 3)) = 'CHR' then substr(raw_chrom, 4) else raw_chrom end)) as chrom,
  case raw_strand when 'plusStrand' then '+' when 'minusStrand' then '-' else raw_strand end as strand, case alias {_CELL_CASE} end as cell_line from {LOCI.sql})
select *, case substr(chrom, 4) {_NUMBER_CASE} else substr(chrom, 4) end as chromosome_number from a""")
def chrom_strand_normalise(spark, d):
    named = LOCI.df(spark, d).select("k", V.normalise_chromosome("raw_chrom").alias("chrom"), V.normalise_strand("raw_strand").alias("strand"), V.cell_line("alias").alias("cell_line"))
    return named.withColumn("chromosome_number", V.chromosome_number("chrom"))


@query("reverse_complement", f"select k, {sql_rc('context')} as rc from {LONG.sql}")
def reverse_complement(spark, d):
    return LONG.df(spark, d).select("k", S.reverse_complement("context").alias("rc"))


TURNED = layered("orders", {"k": "o_orderkey", "context": dna("o_orderkey", 223, "c")},
                 {"site": "case when k % 2 = 0 then substr(context, 101, 23) else reverse(translate(substr(context, 101, 23), 'ACGT', 'TGCA')) end"})


@query("orient_context", f"select k, case when position(site in context) > 0 then context else {sql_rc('context')} end as oriented from {TURNED.sql}")
def orient_context(spark, d):
    return TURNED.df(spark, d).select("k", S.orient_to_site("context", "site").alias("oriented"))


# --- sequence features -------------------------------------------------------------------

@query("nucleotide_counts", f"select k, {sql_count('context', 'A')} as \"nA\", {sql_count('context', 'C')} as \"nC\", {sql_count('context', 'T')} as \"nT\", {sql_count('context', 'G')} as \"nG\" from {SITES.sql}")
def nucleotide_counts(spark, d):
    return SITES.df(spark, d).select("k", *features.nucleotide_counts("context"))


@query("gc_content", f"select k, (length(context) - length(replace(replace(context, 'C', ''), 'G', '')))::double / length(context) as gc from {SITES.sql}")
def gc_content(spark, d):
    return SITES.df(spark, d).select("k", S.gc_content("context").alias("gc"))


_PAIR_TABLE = "(values " + ", ".join(f"('{p}', {v})" for p, v in ENTHALPY_TENTHS.items()) + ") as e(pair, tenths)"


def sql_enthalpy(rel: str, column: str) -> str:
    """Key and tenths of one text column, pair by pair."""
    return f"""(select k, cast(sum(tenths) as bigint) as tenths from (select k, unnest(list_transform(range(1, length({column})), lambda i: substr({column}, i, 2))) as pair from {rel}) join {_PAIR_TABLE} using (pair) group by k)"""


@query("enthalpy", f"""
select s.k, s.tenths / 10.0::double as dna_enthalpy, c.tenths / 10.0::double as extended_dna_enthalpy
from {sql_enthalpy(SITES.sql, 'site')} s join {sql_enthalpy(SITES.sql, 'context')} c using (k)""")
def enthalpy(spark, d):
    return SITES.df(spark, d).select("k", S.enthalpy("site").alias("dna_enthalpy"), S.enthalpy("context").alias("extended_dna_enthalpy"))


@query("pam_codes", f"select k, {sql_codes('right(site, 2)')} as \"PAM_2_first\", {sql_codes('substr(site, 21, 1)')} as \"PAM_N_id\", {sql_codes('left(site, 1)')} as last_nucleotide from {SITES.sql}")
def pam_codes(spark, d):
    return SITES.df(spark, d).select("k", *features.pam_codes("site", "site"))


@query("proximal_couples", "select k, " + ", ".join(f"{sql_codes(f'substr(site, {16 + i}, 2)')} as \"PamProximalCouple{i + 1}\"" for i in range(4)) + f" from {SITES.sql}")
def proximal_couples(spark, d):
    return SITES.df(spark, d).select("k", *features.proximal_couples("site"))


@query("position_ids", "select k, " + ", ".join(f"{sql_codes(f'substr(site, {16 + i}, 1)')} as id_pos{5 - i}" for i in range(5)) + f" from {SITES.sql}")
def position_ids(spark, d):
    return SITES.df(spark, d).select("k", *features.position_ids("site"))


def sql_after_pam(i: int) -> str:
    code = sql_codes(f"substr(context, flank + {24 + i}, 1)")
    return code if i < 3 else f"case when flank > 3 then {code} else '0' end"


@query("after_pam_codes", "select k, " + ", ".join(f"{sql_after_pam(i)} as \"nuc_id_afterPAM{i + 1}\"" for i in range(5)) + f" from {SITES.sql}")
def after_pam_codes(spark, d):
    return SITES.df(spark, d).select("k", *features.after_pam_codes("context", "flank"))


# --- shape ---------------------------------------------------------------------------------
# A stand-in for the pentamer table: values in sixteenths, so sums are exact in any order.
SHAPE_RULES = {"mgw": ("4 + (c * 7 % 64) / 16e0",), "prot": ("(c * 11 % 128) / 16e0 - 6",), "roll": ("(c * 5 % 96) / 16e0 - 3", "(c * 13 % 96) / 16e0 - 3"), "helt": ("30 + (c * 3 % 80) / 16e0", "30 + (c * 17 % 80) / 16e0")}


def shape_table(spark) -> DataFrame:
    letters = "concat(" + ", ".join(f"substr('ACGT', cast(floor(c / {4 ** (4 - i)}) as int) % 4 + 1, 1)" for i in range(5)) + ")"
    return spark.range(1024).withColumnRenamed("id", "c").selectExpr(f"{letters} as pentamer", *[f"array({', '.join(f'cast({r} as double)' for r in rules)}) as {n}" for n, rules in SHAPE_RULES.items()])


def sql_shape(rel: str) -> str:
    """Key and the eight shape features of ``context`` around ``flank``."""
    code = "list_sum([ (position(substr(context, flank - 3 + j + q, 1) in 'ACGT') - 1) * cast(pow(4, 4 - q) as bigint) for q in range(0, 5)])"
    return f"""(with p as (select k, j, cast({code} as bigint) as c from (select k, context, flank, unnest(range(1, 26)) as j from {rel})),
v as (select k, j, {', '.join(f'cast({r} as double) as {n}{i}' for n, rules in SHAPE_RULES.items() for i, r in enumerate(rules))} from p),
n as (select *, lead(roll0) over w as roll_next, lead(helt0) over w as helt_next from v window w as (partition by k order by j))
select k, min(mgw0) as "min_MGW_N",
 (sum(case when j = 1 then helt0 else 0 end) + sum(case when helt_next is null then helt1 else (helt1 + helt_next) / 2 end)) / 26 as "avg_HelT_NG",
 (sum(case when j = 1 then roll0 else 0 end) + sum(case when roll_next is null then roll1 else (roll1 + roll_next) / 2 end)) / 26 as "avg_Roll_NG",
 sum(prot0) / 25 as "avg_ProT_N",
 max(case when j = 23 then mgw0 end) as "MGW_NxxGxxG", max(case when j = 23 then (helt1 + helt_next) / 2 end) as "HelT_NxxGGxx",
 max(case when j = 23 then (roll1 + roll_next) / 2 end) as "Roll_NxxGGxx", max(case when j = 23 then prot0 end) as "ProT_NxxGxxG"
from n group by k)"""


@query("dna_shape", f"select * from {sql_shape(SITES.sql)}")
def dna_shape(spark, d):
    return features.shape_columns(SITES.df(spark, d), load_table(shape_table(spark))).select("k", *SEQUENCE_FEATURES[-8:])


# --- aligned pairs ------------------------------------------------------------------------------

def sql_columns(rel: str, drop_pam: bool = True) -> str:
    """One row per alignment column before the PAM: k, i (1-based), q (from the PAM), r, d."""
    cut = " - 3" if drop_pam else ""
    return f"(select k, i, length(aln_dna) - 2 - i as q, substr(aln_rna, i, 1) as r, substr(aln_dna, i, 1) as d from (select k, aln_rna, aln_dna, unnest(range(1, length(aln_dna) + 1{cut})) as i from {rel}))"


_MM = "r <> d and r <> '-' and d <> '-'"


@query("aligned_mismatches", f"select k, count(*) filter (where {_MM}) as mismatches, count(*) filter (where r = d) as matches from {sql_columns(ALIGNED.sql)} group by k")
def aligned_mismatches(spark, d):
    spacer = aligned.protospacer(aligned.operations("aln_rna", "aln_dna"))
    return ALIGNED.df(spark, d).withColumn("ops", spacer).select("k", aligned.mismatch_count("ops").alias("mismatches"), aligned.match_count("ops").alias("matches"))


@query("bulge_counts", f"select k, {sql_count('aln_dna', '-')} as rna_bulges, {sql_count('aln_rna', '-')} as dna_bulges, (select count(*) from (select unnest(range(1, length(aln_dna) - 2)) as i) where substr(aln_rna, i, 1) = '-' or substr(aln_dna, i, 1) = '-') as total_bulges from {ALIGNED.sql}")
def bulge_counts(spark, d):
    ops = ALIGNED.df(spark, d).withColumn("ops", aligned.operations("aln_rna", "aln_dna"))
    return ops.select("k", aligned.count_in("ops", "D").alias("rna_bulges"), aligned.count_in("ops", "I").alias("dna_bulges"), aligned.bulge_count(aligned.protospacer("ops")).alias("total_bulges"))


_QUARTETS = [("mismatches_1_4", 1, 4), ("mismatches_5_8", 5, 8), ("mismatches_9_12", 9, 12), ("mismatches_13_16", 13, 16), ("mismatches_17_end", 17, 99)]


def sql_quartets() -> str:
    return ", ".join(f"count(*) filter (where {_MM} and q between {a} and {b}) as {n}" for n, a, b in _QUARTETS)


@query("mismatch_quartets", f"select k, {sql_quartets()} from {sql_columns(ALIGNED.sql)} group by k")
def mismatch_quartets(spark, d):
    spaced = ALIGNED.df(spark, d).withColumn("ops", aligned.protospacer(aligned.operations("aln_rna", "aln_dna")))
    return spaced.select("k", *aligned.quartet_mismatches("ops"))


_TYPES = [("wobble_total", "concat(r, d) in ('TC', 'GA')"), ("YY_total", "r in ('C', 'T') and d in ('G', 'A')"),
          ("RR_total", "r in ('G', 'A') and d in ('T', 'C')"), ("Tv_total", "concat(r, d) in ('AG', 'CT')")]
_CLASS_CASE = "case when r = d then '0' when r = '-' or d = '-' then '-1' when concat(r, d) in ('TC', 'GA') then '1' when r in ('G', 'A') and d in ('T', 'C') then '2' when r in ('C', 'T') and d in ('G', 'A') then '3' when concat(r, d) in ('AG', 'CT') then '4' else '-2' end"


def sql_types() -> str:
    return ", ".join(f"count(*) filter (where {c}) as \"{n}\"" for n, c in _TYPES)


@query("mismatch_types", f"select k, {sql_types()} from {sql_columns(ALIGNED.sql)} group by k")
def mismatch_types(spark, d):
    spaced = ALIGNED.df(spark, d).withColumn("ops", aligned.protospacer(aligned.operations("aln_rna", "aln_dna")))
    return spaced.select("k", *aligned.mismatch_types("ops"))


_NAMES = "case {} when '0' then 'match' when '-1' then 'indel' when '1' then 'wobble' when '2' then 'RR transition' when '3' then 'YY transition' when '4' then 'transversion' end"


@query("mismatch_class_names", f"""
with c as (select k, q, {_CLASS_CASE} as cls from {sql_columns(ALIGNED.sql)})
select k, {', '.join(f'max(case when q = {p} then {_NAMES.format("cls")} end) as "MM_in_site_{p}"' for p in range(20, 0, -1))} from c group by k""")
def mismatch_class_names(spark, d):
    from protoscan.operators.post import decode_mismatch_classes

    spaced = ALIGNED.df(spark, d).withColumn("ops", aligned.protospacer(aligned.operations("aln_rna", "aln_dna")))
    return decode_mismatch_classes(spaced.select("k", *[aligned.mismatch_class_at("ops", p).alias(f"MM_in_site_{p}") for p in range(20, 0, -1)]))


def sql_runs(rel: str) -> str:
    """Key and the number of non-match runs that a match follows."""
    return f"(select k, count(*) filter (where r = d and lag_differs) as runs from (select k, i, r, d, lag(r <> d) over (partition by k order by i) as lag_differs from {sql_columns(rel)}) group by k)"


@query("inconsistency_runs", f"""
select a.k, runs as continuous_inconsistencies_cnt, case when runs > 0 then (mms + {sql_count('aln_dna', '-')} + {sql_count('aln_rna', '-')})::double / runs else 0::double end as continuous_inconsistencies_length
from {ALIGNED.sql} a join {sql_runs(ALIGNED.sql)} r using (k) join (select k, count(*) filter (where {_MM}) as mms from {sql_columns(ALIGNED.sql)} group by k) m using (k)""")
def inconsistency_runs(spark, d):
    return features.alignment_counts(ALIGNED.df(spark, d).select("k", "aln_rna", "aln_dna")).select("k", "continuous_inconsistencies_cnt", "continuous_inconsistencies_length")


_LAST20 = f"(select k, right(aln_rna, 20) as aln_rna, right(aln_dna, 20) as aln_dna from {ALIGNED.sql})"


@query("pa_rescore", f"""
select k, sum(case when r = '-' or d = '-' then -1.25::double when r = d then 1::double else 0::double end) as pa_score,
 (select sum(case when r = '-' or d = '-' then -1.25::double when r = d then 1::double else 0::double end) from {sql_columns(_LAST20)} s where s.k = t.k) as pa_score_17
from {sql_columns(ALIGNED.sql)} t group by k""")
def pa_rescore(spark, d):
    return ALIGNED.df(spark, d).select("k", aligned.rescore("aln_rna", "aln_dna").alias("pa_score"), aligned.rescore(F.right("aln_rna", F.lit(20)), F.right("aln_dna", F.lit(20))).alias("pa_score_17"))


# --- alignment ----------------------------------------------------------------------------------

@query("align_ungapped", f"""
select k, sgrna as aln_rna, site as aln_dna, (select count(*) from (select unnest(range(1, 21)) as i) where substr(guide, i, 1) = substr(site, i, 1))::double as pa_score from {NEAR_PAIRS.sql}""")
def align_ungapped(spark, d):
    return align.best_placement(NEAR_PAIRS.df(spark, d)).select("k", "aln_rna", "aln_dna", "pa_score")


def sql_gapped(rel: str) -> str:
    """Best placement by dynamic programming in SQL: the best of the seven frames."""
    preference = "case f when 3 then 7 when 4 then 6 when 2 then 5 when 5 then 4 when 1 then 3 when 6 then 2 else 1 end"
    frames = f"(select k, guide as g, f, substr(upstream, f + 1) as d from (select k, guide, upstream, unnest(range(0, 7)) as f from {rel}))"
    return f"(select k, max_by(z, z.s * 10 + {preference}) as z, max_by(f, z.s * 10 + {preference}) as frame from {sql_global(frames)} group by k)"


def sql_global(rel: str) -> str:
    """k, f and z (score times four, aligned texts) of a guide g of 20 letters and d of 23 - f letters; one CTE per guide letter.

    A cell holds score times four and both aligned texts for a surplus s of site letters and
    at most g gaps. Steps are preferred diagonal, then site letter alone, then guide letter alone.
    """
    cells = [(g, s) for s in range(-3, 4) for g in range(abs(s), 4)]

    def name(g: int, s: int) -> str:
        return f"c{g}{'m' if s < 0 else 'p'}{abs(s)}"

    ctes = [f"f as materialized (select k, f, g, d from {rel})"]
    for j in range(21):
        prev = "f" if j == 0 else f"r{j - 1}"
        previous_names = set() if j == 0 else {name(*c) for c in cells if j - 1 + c[1] >= 0}
        have: dict[str, str] = {}
        lines = []
        stage = prev
        # cells with a surplus depend on cells of the same row, so they go surplus by surplus
        for s in range(-3, 4):
            if j + s < 0:
                continue
            new = []
            for g in range(abs(s), 4):
                options = []
                if j > 0 and j + s > 0 and name(g, s) in previous_names:
                    x = f"o{name(g, s)}" if j else name(g, s)
                    options.append(f"{{'s': {x}.s + case when substr(g, {j}, 1) = substr(d, {j + s}, 1) then 4 else 0 end, 'o': 3, 'a': concat({x}.a, substr(g, {j}, 1)), 'b': concat({x}.b, substr(d, {j + s}, 1))}}")
                if g and name(g - 1, s - 1) in have:
                    x = name(g - 1, s - 1)
                    options.append(f"{{'s': {x}.s - 5, 'o': 2, 'a': concat({x}.a, '-'), 'b': concat({x}.b, substr(d, {j + s}, 1))}}")
                if g and j and name(g - 1, s + 1) in previous_names:
                    x = f"o{name(g - 1, s + 1)}"
                    options.append(f"{{'s': {x}.s - 5, 'o': 1, 'a': concat({x}.a, substr(g, {j}, 1)), 'b': concat({x}.b, '-')}}")
                if j == 0 and s == 0:
                    options = ["{'s': 0, 'o': 3, 'a': '', 'b': ''}"]
                if not options:
                    continue
                best = options[0] if len(options) == 1 else f"list_max([{', '.join(options)}])"
                new.append((name(g, s), best))
            if new:
                cte = f"r{j}s{s + 3}"
                lines.append(f"{cte} as materialized (select *, {', '.join(f'{b} as {n}' for n, b in new)} from {stage})")
                stage = cte
                have.update({n: n for n, _ in new})
        ctes += lines
        if j < 20:
            ctes.append(f"r{j} as materialized (select k, f, g, d, {', '.join(f'{n} as o{n}' for n in have)} from {stage})")
        else:
            ctes.append(f"r{j} as materialized (select * from {stage})")
    last = "case f " + " ".join(f"when {f} then {name(3, 3 - f)}" for f in range(7)) + " end"
    return f"(with {', '.join(ctes)} select k, f, {last} as z from r20)"


@query("align_gapped", f"""
select p.k, concat(z.a, 'NGG') as aln_rna, concat(z.b, substr(context, 24, 3)) as aln_dna, z.s / 4.0::double as pa_score, frame
from {EDITED_PAIRS.sql} p join {sql_gapped(EDITED_PAIRS.sql)} q using (k)""")
def align_gapped(spark, d):
    return align.best_placement(EDITED_PAIRS.df(spark, d)).select("k", "aln_rna", "aln_dna", "pa_score", "frame")


# --- the whole feature vector -------------------------------------------------------------------------

def sql_features(rel: str) -> str:
    """k and the 48 features of identity-frame pairs with aln_rna, aln_dna, site, context, flank, pa_score."""
    counts = f"(select k, count(*) filter (where {_MM}) as mms_cnt, {sql_quartets()}, {sql_types()} from {sql_columns(rel)} group by k)"
    bare = "replace(aln_dna, '-', '')"
    parts = [
        "pa_score", f"{sql_count('aln_dna', '-')} + {sql_count('aln_rna', '-')} as total_bulges", f"{sql_count('aln_dna', '-')} as rna_bulges", f"{sql_count('aln_rna', '-')} as dna_bulges",
        f"{sql_codes('right(site, 2)')} as \"PAM_2_first\"", f"{sql_codes('substr(site, length(site) - 2, 1)')} as \"PAM_N_id\"", f"{sql_codes(f'left({bare}, 1)')} as last_nucleotide",
        "mms_cnt", "runs as continuous_inconsistencies_cnt",
        f"case when runs > 0 then (mms_cnt + {sql_count('aln_dna', '-')} + {sql_count('aln_rna', '-')})::double / runs else 0::double end as continuous_inconsistencies_length",
        *[n for n, _, _ in _QUARTETS], *[f'"{n}"' for n, _ in _TYPES],
        *[f"{sql_codes(f'substr(site, length(site) - {7 - i}, 2)')} as \"PamProximalCouple{i + 1}\"" for i in range(4)],
        *[f"{sql_codes(f'substr(site, length(site) - {7 - i}, 1)')} as id_pos{5 - i}" for i in range(5)],
        "(length(context) - length(replace(replace(context, 'C', ''), 'G', '')))::double / length(context) as \"extended_genomic_GC_content\"",
        "es.tenths / 10.0::double as dna_enthalpy", "ec.tenths / 10.0::double as extended_dna_enthalpy",
        *[f"{sql_count(bare, x)} as \"n{x}\"" for x in "ACTG"],
        *[f"{sql_after_pam(i)} as \"nuc_id_afterPAM{i + 1}\"" for i in range(5)],
        *[f'sh."{n}"' for n in SEQUENCE_FEATURES[-8:]],
    ]
    return f"""(select b.k, {', '.join(parts)} from {rel} b join {counts} c using (k) join {sql_runs(rel)} u using (k)
join {sql_enthalpy(rel, 'site')} es using (k) join {sql_enthalpy(rel, 'context')} ec using (k) join {sql_shape(rel)} sh using (k))"""


NEAR_ALIGNED_SQL = f"""(select *, sgrna as aln_rna, site as aln_dna, (select count(*) from (select unnest(range(1, 21)) as i) where substr(guide, i, 1) = substr(site, i, 1))::double as pa_score from {NEAR_PAIRS.sql})"""


@query("feature_vector_48", f"select * from {sql_features(NEAR_ALIGNED_SQL)}")
def feature_vector_48(spark, d):
    placed = align.best_placement(NEAR_PAIRS.df(spark, d))
    return features.sequence_features(placed, load_table(shape_table(spark))).select("k", *SEQUENCE_FEATURES)


# --- scans and regions -------------------------------------------------------------------------------

def sql_scan(flank: int, contigs_sql: str = CONTIGS_SQL) -> str:
    def strand(sign: str, seq: str, start: str, end: str) -> str:
        return f"""select contig, '{sign}' as strand, {start} as start, {end} as "end", substr(s, i, 23) as site, length(s) as n from (select contig, {seq} as s, unnest(range(1, length(seq) - 21)) as i from {contigs_sql} where length(seq) >= 23) where regexp_full_match(substr(s, i, 23), '[ACGT]{{20}}.[AG]G')"""
    plus = strand("+", "seq", "i", "i + 22")
    minus = strand("-", sql_rc("seq"), "length(s) - i - 21", "length(s) - i + 1")
    return f"(select * from ({plus} union all {minus}) where start > {flank} and \"end\" <= n - {flank})"


@query("pam_scan_plus", f"select contig, start, \"end\", site from {sql_scan(0)} where strand = '+'")
def pam_scan_plus(spark, d):
    return scan.scan_sites(genome.chunk_contigs(contigs(spark, d)), 0, strands="+").select("contig", "start", "end", "site")


@query("pam_scan_both", f"select contig, strand, start, \"end\", site from {sql_scan(3)}")
def pam_scan_both(spark, d):
    return scan.scan_sites(genome.chunk_contigs(contigs(spark, d)), 3).select("contig", "strand", "start", "end", "site")


def sql_scan_context(flank: int) -> str:
    return f"""(select t.*, case when position(site in window_) > 0 then window_ else {sql_rc('window_')} end as context from
(select h.*, substr(seq, start - {flank}, 23 + 2 * {flank}) as window_ from {sql_scan(flank)} h join {CONTIGS_SQL} c using (contig)) t)"""


@query("ontarget_pairs", f"select contig, strand, start, \"end\", site, context, concat(left(site, 20), 'NGG') as sgrna, 20::double as pa_score from {sql_scan_context(3)}")
def ontarget_pairs(spark, d):
    return scan.as_ontarget_pairs(scan.scan_sites(genome.chunk_contigs(contigs(spark, d)), 3)).select("contig", "strand", "start", "end", "site", "context", "sgrna", "pa_score")


REGIONS = layered("orders", {"k": "o_orderkey", "contig": "concat('doc', cast(o_custkey as string))", "start": "o_orderkey % 4900 - 20", "length": "case when o_orderkey % 3 = 0 then o_custkey * 7 % 5000 + 1 else o_custkey % 223 + 1 end"}, {"end": "start + length - 1"})


@query("region_fetch", f"""
with r as (select k, start, "end", case when start > 0 and length(seq) = 0 then '' else coalesce(substr(seq, cast(greatest(start, 1) as int), cast(greatest("end" - greatest(start, 1) + 1, 0) as int)), '') end as seq
 from {REGIONS.sql} p left join {CONTIGS_SQL} c using (contig))
select k, seq, case when length(seq) = 0 then 'no letters at these coordinates' when length(seq) > 1 and length(seq) < "end" - start + 1 then 'coordinates run past the end of the contig' end as fetch_warning from r""")
def region_fetch(spark, d):
    return genome.fetch_regions(REGIONS.df(spark, d), genome.chunk_contigs(contigs(spark, d))).select("k", "seq", "fetch_warning")


LONG_REGIONS = layered("orders", {"k": "o_orderkey", "contig": "concat('doc', cast(o_custkey as string))", "start": "o_orderkey % 900 + 1"}, {"end": "start + 4999"})


@query("region_fetch_long", f"select k, coalesce(substr(seq, cast(start as int), 5000), '') as seq from {LONG_REGIONS.sql} p left join {CONTIGS_SQL} c using (contig)")
def region_fetch_long(spark, d):
    got = genome.fetch_regions(LONG_REGIONS.df(spark, d), genome.chunk_contigs(contigs(spark, d)))
    return got.select("k", "seq")


HINTS = layered("orders", {"k": "o_orderkey", "contig": "concat('doc', cast(o_custkey as string))", "place": "o_orderkey % 700 + 1", "shift": "o_orderkey % 130",
                           "strand": "case cast(o_orderkey % 3 as int) when 0 then '+' when 1 then '-' end"},
                {"hint_start": "place + shift", "hint_end": "0"})
_WINDOW = "(select h.*, c.seq as whole, substr(c.seq, cast(place as int), 23) as seq, greatest(hint_start - 40, 0) as low, hint_start + 40 as high from {} h join {} c using (contig))"


@query("true_coordinates", f"""
with w as (select *, substr(whole, cast(greatest(low, 1) as int), cast(high - greatest(low, 1) + 1 as int)) as win from {_WINDOW.format(HINTS.sql, CONTIGS_SQL)} where length(whole) >= place + 22),
f as (select *, case when coalesce(strand, '+') = '+' then position(seq in win) else 0 end as fw, case when coalesce(strand, '-') = '-' then position({sql_rc('seq')} in win) else 0 end as rv from w)
select k, case when fw > 0 then low + fw - 1 when rv > 0 then low + rv - 1 end as found_start, case when fw > 0 then low + fw + 21 when rv > 0 then low + rv + 21 end as found_end,
 case when fw > 0 then '+' when rv > 0 then '-' end as found_strand from f""")
def true_coordinates(spark, d):
    chunks = genome.chunk_contigs(contigs(spark, d))
    wanted = genome.fetch_regions(HINTS.df(spark, d).withColumn("stop", F.col("place") + 22), chunks, start="place", end="stop").filter(F.length("seq") == 23)
    return genome.true_coordinates(wanted.drop("fetch_warning"), chunks, offset=40).select("k", "found_start", "found_end", "found_strand")


EXTEND = layered("orders", {"k": "o_orderkey", "contig": "concat('doc', cast(o_custkey as string))", "start": "o_orderkey % 500 + 4", "strand": "case when o_orderkey % 2 = 0 then '+' else '-' end", "site": dna("o_orderkey", 23, "g")}, {"end": "start + 22"})


@query("five_prime_extension", f"""
with w as (select k, site, case when strand = '-' then {sql_rc('substr(seq, cast(start as int), 26)')} else substr(seq, cast(start as int) - 3, 26) end as extended from {EXTEND.sql} p left join {CONTIGS_SQL} c using (contig))
select k, coalesce(extended, '') as extended, case when coalesce(substr(extended, 4), '') = site then 1 else 0 end as consistent from w""")
def five_prime_extension(spark, d):
    got = genome.five_prime_extension(EXTEND.df(spark, d), genome.chunk_contigs(contigs(spark, d)))
    return got.select("k", "extended", F.col("consistent").cast("int").alias("consistent"))


# --- statistics over sequences ----------------------------------------------------------------------

@query("column_entropy", f"""
with c as (select p, letter, count(*) as n from (select unnest(range(1, 21)) as p, guide from (select {dna('o_orderkey', 20, 'g')} as guide from orders)) t, lateral (select substr(guide, p, 1) as letter) group by p, letter),
t as (select p, sum(n) as total from c group by p)
select c.p as position, round(-sum(n * log2(n / total)), 6) as entropy from c join t using (p) group by c.p""")
def column_entropy(spark, d):
    guides = RAW_GUIDES.df(spark, d).select(F.col("g").alias("seq"))
    return metrics.column_entropy(guides).select("position", F.round("entropy", 6).alias("entropy"))


@query("mean_column_entropy", f"""
with c as (select p, letter, count(*) as n from (select unnest(range(1, 21)) as p, guide from (select {dna('o_orderkey', 20, 'g')} as guide from orders)) t, lateral (select substr(guide, p, 1) as letter) group by p, letter),
t as (select p, sum(n) as total from c group by p)
select round(-sum(n * log2(n / total)) / 20, 6) as mean_entropy, (select count(*) from orders) as sequences from c join t using (p)""")
def mean_column_entropy(spark, d):
    guides = RAW_GUIDES.df(spark, d).select(F.col("g").alias("seq"))
    return metrics.mean_column_entropy(guides).select(F.round("mean_entropy", 6).alias("mean_entropy"), "sequences")


@query("error_metrics", """
with p as (select l_extendedprice as o, l_quantity * 1000 as p from lineitem),
r as (select o, p, rank() over (order by o) + (count(*) over (partition by o) - 1) / 2.0 as ro, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp from p)
select round(sqrt(avg((p - o) * (p - o))), 4) as rmse, round(pow(corr(o, p), 2), 6) as squared_pearson, round(pow(corr(ro, rp), 2), 6) as squared_spearman from r""")
def error_metrics(spark, d):
    pairs = table(spark, d, "lineitem").selectExpr("l_extendedprice as o", "l_quantity * 1000 as p")
    simple = pairs.agg(F.round(metrics.rmse(F.col("o"), F.col("p")), 4).alias("rmse"), F.round(metrics.squared_pearson(F.col("o"), F.col("p")), 6).alias("squared_pearson"))
    ranked = metrics.squared_spearman(pairs, "o", "p")
    return simple.withColumn("_one", F.lit(1)).join(ranked.withColumn("_one", F.lit(1)), "_one").select("rmse", "squared_pearson", F.round("squared_spearman", 6).alias("squared_spearman"))


@query("list_statistics", "select l_returnflag as flag, round(avg(l_quantity), 6) as mean, round(var_pop(l_quantity), 6) as variance, round(stddev_pop(l_quantity), 6) as deviation, sum(l_quantity * l_quantity) as sum_of_squares from lineitem group by l_returnflag")
def list_statistics(spark, d):
    got = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(*metrics.describe(F.col("l_quantity")))
    return got.select("flag", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "deviation")], "sum_of_squares")
