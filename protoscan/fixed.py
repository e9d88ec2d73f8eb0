"""Fixed values that decide what the results mean.

Everything here is a lookup table, constant or column list whose value must not
change; the logic that uses them lives elsewhere.
"""

# --- fixed values: site geometry -------------------------------------------
GUIDE_LEN = 20
PAM_LEN = 3
SITE_LEN = GUIDE_LEN + PAM_LEN
SHORT_FLANK = 3
LONG_FLANK = 100
SHORT_CONTEXT = SITE_LEN + 2 * SHORT_FLANK
LONG_CONTEXT = SITE_LEN + 2 * LONG_FLANK

# --- fixed values: alignment scores ----------------------------------------
MATCH = 1.0
MISMATCH = 0.0
GAP = -1.25
MAX_GAPS = 3

# --- fixed values: off-target search ---------------------------------------
SEARCH_MAX_EDITS = 4
SEARCH_MAX_GAPS = 3
#: Edits over guide and PAM together; the PAM's N counts as one.
SEARCH_BUDGET = 5

# --- fixed values: nucleotide codes ----------------------------------------
NUCLEOTIDE_CODE = {"A": "1", "C": "2", "G": "3", "T": "4", "N": "0"}

# --- fixed values: Breslauer dinucleotide enthalpy, in tenths ----------------
ENTHALPY_TENTHS = {
    "AA": 91, "AC": 65, "AG": 78, "AT": 86,
    "CA": 58, "CC": 110, "CG": 119, "CT": 78,
    "GA": 56, "GC": 111, "GG": 110, "GT": 65,
    "TA": 60, "TC": 56, "TG": 58, "TT": 91,
}

# --- fixed values: score rescaling ------------------------------------------
SCORE_DIVISOR = 8.22
SCORE_CAP = 1.0
ENSEMBLE_MEMBERS = 10

# --- fixed values: cell-line aliases -----------------------------------------
CELL_LINES = {
    "293": "HEK293", "293T": "HEK293", "HEK293": "HEK293", "Hek293": "HEK293", "HEK": "HEK293",
    "hIPS": "hIPS", "U2OS": "U2OS",
    "K56": "K56", "k56": "K56", "K562": "K56", "k562": "K56",
    "invitro": "invitro", "A549": "A549", "mESCs": "mESCs", "negatives": "negatives", "EL4": "EL4",
}

# --- fixed values: chromosome numbers ----------------------------------------
CHROMOSOME_NUMBER = {"X": "23", "Y": "24", "M": "25"}

# --- fixed values: 3-D subcompartment categories ------------------------------
SUBCOMPARTMENT = {"A1": 1, "A2": 2, "B1": 3, "B2": 4, "B3": 5, "B4": 6, "NA": 0}

# --- fixed values: repeat class and class/family categories -------------------
REPEAT_CLASS = {
    "repClass": 1, "Unknown": 2, "srpRNA": 3, "DNA": 4, "Other": 5, "scRNA": 6, "rRNA": 7, "LINE": 8,
    "snRNA": 9, "SINE": 10, "RC": 11, "Simple_repeat": 12, "Satellite": 13, "tRNA": 14,
    "Low_complexity": 15, "LTR": 16, "RNA": 17, "Retroposon": 18, "Unmasked": 0,
}
REPEAT_FAMILY = {
    "DNA/DNA": 1, "DNA/hAT": 2, "DNA/hAT-Ac": 3, "DNA/hAT-Blackjack": 4, "DNA/hAT-Charlie": 5,
    "DNA/hAT-Tag1": 6, "DNA/hAT-Tip100": 7, "DNA/Merlin": 8, "DNA/MuDR": 9, "DNA/MULE-MuDR": 10,
    "DNA/PIF-Harbinger": 11, "DNA/PiggyBac": 12, "DNA/TcMar": 13, "DNA/TcMar-Mariner": 14,
    "DNA/TcMar-Pogo": 15, "DNA/TcMar-Tc2": 16, "DNA/TcMar-Tigger": 17, "LINE/CR1": 18, "LINE/Dong-R4": 19,
    "LINE/L1": 20, "LINE/L2": 21, "LINE/Penelope": 22, "LINE/RTE": 23, "LINE/RTE-BovB": 24,
    "LINE/RTE-X": 25, "Low_complexity/Low_complexity": 26, "LTR/LTR": 27, "LTR/ERV": 28, "LTR/ERV1": 29,
    "LTR/ERVK": 30, "LTR/ERVL": 31, "LTR/ERVL-MaLR": 32, "LTR/Gypsy": 33, "Other/Other": 34,
    "RC/Helitron": 35, "Retroposon/SVA": 36, "RNA/RNA": 37, "rRNA/rRNA": 38, "Satellite/Satellite": 39,
    "Satellite/acro": 40, "Satellite/centr": 41, "Satellite/telo": 42, "scRNA/scRNA": 43,
    "Simple_repeat/Simple_repeat": 44, "SINE/SINE": 45, "SINE/5S-Deu-L2": 46, "SINE/Alu": 47,
    "SINE/Deu": 48, "SINE/MIR": 49, "SINE/tRNA": 50, "SINE/tRNA-Deu": 51, "SINE/tRNA-RTE": 52,
    "snRNA/snRNA": 53, "srpRNA/srpRNA": 54, "tRNA/tRNA": 55, "Unknown/Unknown": 66, "Unmasked/Unmasked": 0,
}

# --- fixed values: mismatch-class names ---------------------------------------
MISMATCH_CLASS_NAME = {
    "0": "match", "-1": "indel", "1": "wobble",
    "2": "RR transition", "3": "YY transition", "4": "transversion",
}

# --- fixed values: feature columns, in model order ----------------------------
SEQUENCE_FEATURES = [
    "pa_score", "total_bulges", "rna_bulges", "dna_bulges",
    "PAM_2_first", "PAM_N_id", "last_nucleotide", "mms_cnt",
    "continuous_inconsistencies_cnt", "continuous_inconsistencies_length",
    "mismatches_1_4", "mismatches_5_8", "mismatches_9_12", "mismatches_13_16", "mismatches_17_end",
    "wobble_total", "YY_total", "RR_total", "Tv_total",
    "PamProximalCouple1", "PamProximalCouple2", "PamProximalCouple3", "PamProximalCouple4",
    "id_pos5", "id_pos4", "id_pos3", "id_pos2", "id_pos1",
    "extended_genomic_GC_content", "dna_enthalpy", "extended_dna_enthalpy",
    "nA", "nC", "nT", "nG",
    "nuc_id_afterPAM1", "nuc_id_afterPAM2", "nuc_id_afterPAM3", "nuc_id_afterPAM4", "nuc_id_afterPAM5",
    "min_MGW_N", "avg_HelT_NG", "avg_Roll_NG", "avg_ProT_N",
    "MGW_NxxGxxG", "HelT_NxxGGxx", "Roll_NxxGGxx", "ProT_NxxGxxG",
]
GENOME_FEATURES = [
    "Distance_from_centromere", "Distance_from_telomere",
    "DHS_signalValue", "distance_from_DHS",
    "nucleosome_mapping", "length_from_nucleosome", "genomic_subcompartment",
    "NGG_exon_signalValue", "opposite_exon_signalValue",
    "in_NGG_exon", "in_opposite_exon", "in_tx", "in_cds",
]
CODED_FEATURES = [
    "PAM_2_first", "PAM_N_id", "last_nucleotide",
    "PamProximalCouple1", "PamProximalCouple2", "PamProximalCouple3", "PamProximalCouple4",
    "id_pos5", "id_pos4", "id_pos3", "id_pos2", "id_pos1",
    "nuc_id_afterPAM1", "nuc_id_afterPAM2", "nuc_id_afterPAM3", "nuc_id_afterPAM4", "nuc_id_afterPAM5",
]
MODEL_INPUTS = {
    "genomic": ["chromosome_number"] + SEQUENCE_FEATURES + GENOME_FEATURES,
    "flanking": SEQUENCE_FEATURES,
    "noflanking": SEQUENCE_FEATURES,
}
SCORE = "score"

#: The cell lines for which a mark has no data. Their value is null, never 0.
NO_DATA = {
    "methylation": ("mESCs",),
    "expression": ("mESCs",),
    "H3K4me": ("U2OS",),
    "H3K27me": ("HEK293", "U2OS", "mESCs"),
    "H3K36me": ("HEK293", "mESCs"),
    "H3K9me": ("HEK293", "hIPS", "mESCs"),
}
