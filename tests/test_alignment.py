import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from protoscan.operators import align, search


def every_alignment(a, b, gaps):
    """All alignments with at most ``gaps`` gap columns, as (score times four, aligned a, aligned b)."""
    @lru_cache(None)
    def go(i, j, left):
        if i == len(a) and j == len(b):
            return [(0, "", "")]
        out = []
        if i < len(a) and j < len(b):
            out += [(s + 4 * (a[i] == b[j]), a[i] + x, b[j] + y) for s, x, y in go(i + 1, j + 1, left)]
        if left:
            if j < len(b):
                out += [(s - 5, "-" + x, b[j] + y) for s, x, y in go(i, j + 1, left - 1)]
            if i < len(a):
                out += [(s - 5, a[i] + x, "-" + y) for s, x, y in go(i + 1, j, left - 1)]
        return out

    return go(0, 0, gaps)


def preferred(a, b, gaps):
    """Best alignment; ties go, from the right end, to diagonal, then a gap in a, then a gap in b."""
    def steps(x, y):
        return [0 if p != "-" and q != "-" else 1 if p == "-" else 2 for p, q in zip(reversed(x), reversed(y))]

    found = every_alignment(a, b, gaps)
    top = max(s for s, _, _ in found)
    return min(((x, y, s) for s, x, y in found if s == top), key=lambda t: steps(t[0], t[1]))


def codes(texts):
    return np.array([list(t.encode()) for t in texts], dtype=np.uint8)


@pytest.mark.parametrize("alphabet", ["AC", "ACGT"])
def test_trace_equals_full_enumeration(alphabet):
    rng = random.Random(len(alphabet))
    for shape in [(7, 7), (7, 6), (6, 8), (7, 4), (5, 8)]:
        pairs = [("".join(rng.choice(alphabet) for _ in range(shape[0])), "".join(rng.choice(alphabet) for _ in range(shape[1]))) for _ in range(25)]
        g, d, s = align.trace(codes([p[0] for p in pairs]), codes([p[1] for p in pairs]))
        for i, (a, b) in enumerate(pairs):
            assert (g[i], d[i], int(s[i])) == preferred(a, b, 3)


def test_frame_scores_equal_single_frames():
    rng = np.random.default_rng(4)
    g, d = (rng.choice(np.frombuffer(b"ACGT", dtype=np.uint8), size=(200, n)) for n in (20, 23))
    scores = align.frame_scores(g, d)
    for frame in range(7):
        assert (scores[:, frame] == align.trace(g, d[:, frame:])[2]).all()


def test_placement_prefers_the_ungapped_frame_and_never_opens_with_a_guide_gap(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        g = "".join(rng.choice("ACGT") for _ in range(20))
        up = list("".join(rng.choice("ACGT") for _ in range(3)) + g)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(up))
            up[at:at + 1] = rng.choice([[], [rng.choice("ACGT")], [up[at], rng.choice("ACGT")]])
        up = ("ACG" + "".join(up))[-23:]
        rows.append((i, g + "NGG", up + "TGG" + "ACG", 3))
    got = align.best_placement(spark.createDataFrame(rows, "k int, sgrna string, context string, flank int")).collect()
    assert len(got) == 300
    for r in got:
        guide, up = r.sgrna[:20], r.context[:23]
        scores = {f: align.trace(codes([guide]), codes([up[f:]]))[2][0] / 4 for f in range(7)}
        best = max(scores.values())
        assert r.pa_score == best and scores[r.frame] == best
        assert r.frame == min((f for f in scores if scores[f] == best), key=align.FRAME_PREFERENCE.index)
        assert not r.aln_rna.startswith("-")
        assert r.aln_rna.replace("-", "") == r.sgrna and r.aln_dna.replace("-", "") == r.context[r.frame:26]


def test_identical_rows_and_nulls_pass_through(spark):
    rows = [(i, "ACGTACGTACGTACGTACGTNGG", "TTTACGTACGAACGTACTTACGTAGGCCC", 3) for i in range(2000)] + [(9999, None, None, 3)]
    got = align.best_placement(spark.createDataFrame(rows, "k int, sgrna string, context string, flank int"))
    assert got.count() == 2001
    assert got.filter("sgrna is not null").select("aln_rna", "aln_dna", "pa_score").distinct().count() == 1
    assert got.filter("sgrna is null and aln_rna is null").count() == 1


def test_align_whole_takes_each_span(spark):
    rng = random.Random(12)
    rows = []
    for i, n in enumerate([17, 18, 19, 20, 21, 22, 23, 24, 16]):
        g = "".join(rng.choice("ACGT") for _ in range(20))
        rows.append((i, g + "NGG", (g + "ACGT")[:n] + "AGG"))
    got = {r.k: r for r in align.align_whole(spark.createDataFrame(rows, "k int, sgrna string, site string")).collect()}
    for k, sgrna, site in rows:
        if abs(len(site) - 23) > 3:
            assert got[k].aln_rna is None
        else:
            g, d, s = align.trace(codes([sgrna[:20]]), codes([site[:-3]]))
            assert (got[k].aln_rna, got[k].aln_dna, got[k].pa_score) == (g[0] + "NGG", d[0] + site[-3:], s[0] / 4)


def fewest_edits(guide, site, gaps=3):
    @lru_cache(None)
    def go(i, j, left):
        if i == 0 and j == 0:
            return 0
        best = 99
        if i and j:
            best = go(i - 1, j - 1, left) + (guide[i - 1] != site[j - 1])
        if left and i:
            best = min(best, go(i - 1, j, left - 1) + 1)
        if left and j:
            best = min(best, go(i, j - 1, left - 1) + 1)
        return best

    return go(len(guide), len(site), gaps)


def test_search_equals_brute_force(spark):
    from protoscan.operators.genome import chunk_contigs

    rng = random.Random(21)
    guides = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(4)]
    parts = []
    for i in range(60):
        s = list(rng.choice(guides))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(s))
            s[at:at + 1] = rng.choice([[], [rng.choice("ACGT")], [s[at], rng.choice("ACGT")]])
        s = "".join(s) + rng.choice(["AGG", "CAG", "TGA", "TCC"])
        if i % 2:
            s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        parts.append(s + "".join(rng.choice("ACGT") for _ in range(9)))
    # a site at the very start and one at the very end, one with an N three letters out, both strands
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seq = guides[0] + "TGG" + "ACGTACGT" * 4 + "".join(parts) + "NN" + guides[1][1:] + "CGGA" + "N" + guides[2] + "AGG" + flip(guides[3] + "TGG") + "N" + "ACGTACGT" * 4 + flip(guides[1] + "AGG")
    chunks = chunk_contigs(spark.createDataFrame([("c", seq), ("tiny", guides[2] + "CGG"), ("none", "ACG"), ("", ""), ("edge", "A" * 100 + flip(guides[0] + "AGG") + "CC")], "contig string, seq string"), size=64, halo=64)
    contigs = {"c": seq, "tiny": guides[2] + "CGG", "edge": "A" * 100 + flip(guides[0] + "AGG") + "CC"}
    asked = spark.createDataFrame([(g,) for g in guides + guides[:1]], "guide string")
    want = set()
    for name, plus in contigs.items():
        for strand, s in (("+", plus), ("-", flip(plus))):
            for end in range(20, len(s) + 1):
                if set(s[end - 2:end]) <= set("AG"):
                    for n in range(17, 24):
                        span = s[end - 3 - n:end - 3] if end - 3 - n >= 0 else ""
                        if span and set(span) <= set("ACGT"):
                            for g in guides:
                                edits = fewest_edits(g, span)
                                if edits <= 4 and edits + 1 + s[end - 2:end].count("A") <= 5:
                                    first = end - 3 - n + 1
                                    want.add((g, name, strand, first, end, edits) if strand == "+" else (g, name, strand, len(s) - end + 1, len(s) - first + 1, edits))
    for list_size in (100, 2):
        got = [(r.guide, r.contig, r.strand, r.start, r.end, r.edits) for r in search.search(asked, chunks, list_size=list_size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (guides[0], "c", "+", 1, 23, 0) in want and (guides[2], "tiny", "+", 1, 23, 0) in want and (guides[0], "c", "+", 2, 23, 1) in want
    ungapped = search.search(asked, chunks, max_gaps=0).collect()
    assert {(r.guide, r.contig, r.strand, r.start, r.end) for r in ungapped} <= {x[:5] for x in want}
    assert all(r.end - r.start == 22 for r in ungapped) and any(r.start == 1 for r in ungapped)


def test_guide_index_loses_nothing(monkeypatch):
    from protoscan.operators import guide_index

    rng = np.random.default_rng(12)
    guides = rng.integers(0, 4, (40, 20)).astype(np.uint8)
    windows, have = rng.integers(0, 4, (3000, 23)).astype(np.uint8), np.full(3000, 23)
    for i in range(2000):  # edited copies
        w = guides[rng.integers(40)].tolist()
        for _ in range(rng.integers(0, 6)):
            at = int(rng.integers(len(w)))
            w[at:at + 1] = [[], [int(rng.integers(4))], [w[at], int(rng.integers(4))]][rng.integers(3)]
        w = (rng.integers(0, 4, 23).tolist() + w)[-23:]
        windows[i] = w
    have[::7] = 18
    windows[::7, :5] = guide_index.BAD
    limits = rng.integers(-1, 5, 3000)
    monkeypatch.setattr(guide_index, "PAIRS_AT_ONCE", 100)
    for gaps in (0, 2, 3):
        index = guide_index.GuideIndex(guides, 4, gaps)
        got = set(zip(*(x.tolist() for x in index.hits(windows, have, limits))))
        w, g = np.divmod(np.arange(3000 * 40), 40)
        want = set()
        for surplus, edits in guide_index.edit_table(guides[g], windows[w], gaps).items():
            fits = np.flatnonzero((edits <= limits[w]) & (have[w] >= 20 + surplus))
            want |= set(zip(w[fits].tolist(), g[fits].tolist(), [20 + surplus] * len(fits), edits[fits].tolist()))
        assert got == want and len(want) > 300
    tested = sum(len(guide_index.GuideIndex(guides, 4, 3).candidates(windows[2000:], have[2000:], k)) for k in (2, 3, 4))
    assert tested < 0.02 * 3 * 1000 * 40  # random windows meet few guides
