import random

from pyspark.sql import functions as F

from protoscan.operators import genome, splice
from protoscan.sources import genome as genome_files, lines, pairs, sam, sinks, tables


def write(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_pair_files_of_both_layouts_below_a_preamble(spark, tmp_path):
    write(tmp_path, "p/a.csv", 'made by hand\n\ntarget_id,sgRNA,dna_seq_29nt\n1,GAGTCCTAGCAGAAGAAGAA,CCTGAGTCCGAGCAGAAGAAGAAGGGCTC\n2,"ACGT",AC\n')
    write(tmp_path, "p/b.csv", "target_id,sgRNA,genome,cell,chr,strand,start\n7,ACGU,hg19,293T,Chr7,plusStrand,101\n")
    got = {r.id: r for r in pairs.read_pairs(spark, str(tmp_path / "p")).collect()}
    assert sorted(got) == ["1", "2", "7"]
    assert got["1"].context == "CCTGAGTCCGAGCAGAAGAAGAAGGGCTC" and got["1"].genome is None
    assert got["2"].guide == "ACGT"
    assert (got["7"].genome, got["7"].cell_type, got["7"].chrom, got["7"].strand, got["7"].start, got["7"].context) == ("hg19", "293T", "Chr7", "plusStrand", 101, None)


def test_csv_guard(spark, tmp_path):
    good = write(tmp_path, "good.csv", "a,b,c\n1,2,3\n4,5,6\n")
    bad = write(tmp_path, "bad.csv", "")
    assert pairs.looks_like_csv(spark, good) and not pairs.looks_like_csv(spark, bad)


def test_guide_lists(spark):
    df = spark.createDataFrame([(" acgt,, TTT\tacgt\nggg ",), ("GGG",)], "t string")
    assert sorted(r.guide for r in pairs.guides_in_text(df, "t").collect()) == ["ACGT", "GGG", "TTT"]


def test_delimited_records(spark, tmp_path):
    path = write(tmp_path, "r.txt", "a,1;b,2;c\n3")
    assert [r.text for r in lines.read_lines(spark, path, ";").orderBy("line_seq").collect()] == ["a,1", "b,2", "c\n3"]


def test_fasta_over_many_splits(spark, tmp_path):
    rng = random.Random(5)
    seqs = {"chr1": 2_600_000, "chr2": 40, "chr3": 900_001, "chrM": 61}
    text = {c: "".join(rng.choices("ACGTacgtN", k=n)) for c, n in seqs.items()}
    body = "".join(f">{c} some words\n" + "\n".join(s[i:i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in text.items())
    path = write(tmp_path, "g.fa", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        chunks = genome_files.read_fasta(spark, path)
        assert genome_files.read_fasta_lines(spark, path).rdd.getNumPartitions() >= 1
        assert lines.read_lines(spark, path).select("block").distinct().count() >= 3
        genome_files.write_genome(chunks, str(tmp_path / "genome"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    stored = spark.read.parquet(str(tmp_path / "genome"))
    want = genome.chunk_contigs(spark.createDataFrame(list(text.items()), "contig string, seq string"))
    columns = ["contig", "contig_length", "chunk", "chunk_start", "core_length", "seq"]
    assert stored.count() == want.count()
    assert stored.select(columns).exceptAll(want.select(columns)).count() == 0


def test_plain_sequence_and_fasta_dictionary(spark, tmp_path):
    path = write(tmp_path, "s.txt", "\n acgtNN \n")
    assert [r.seq for r in genome_files.read_sequence(spark, path).collect()] == ["ACGTNN"]
    fa = write(tmp_path, "d.fa", "> one chr1\nACG\n> two chr2\nTTT\nGGG\n")
    assert {r.identifier: r.seq for r in genome_files.fasta_dictionary(spark, fa).collect()} == {"> one ": "ACG", "> two ": "GGG"}


def test_alignment_table(spark, tmp_path):
    rows = ["@HD\tx", "q\t16\t7\t100\t37\t20M3S\t*\t0\t0\tACGT\tIIII\tXT:A:U\tXA:Z:3,+50,10M2D11M,2;X,-9,23M,0;", "r\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII"]
    got = sorted((r.query, r.contig, r.strand, r.start, r.end, r.primary) for r in sam.read_hits(spark, write(tmp_path, "h.sam", "\n".join(rows) + "\n")).collect())
    assert got == [("q", "chr3", "+", 50, 72, False), ("q", "chr7", "-", 100, 122, True), ("q", "chrX", "-", 9, 31, False)]


def test_annotation_tables(spark, tmp_path):
    peak = "#bin\tchrom\n585\tchr1\t10\t20\tn\t0\t.\t7.5\t1\t2\t3\n585\tchr1_random\t10\t20\tn\t0\t.\t7.5\t1\t2\t3\n"
    got = tables.read_track(spark, write(tmp_path, "dhs.txt", peak), "dnase").collect()
    assert [(r.chrom, r.start, r.end, r.value) for r in got] == [("chr1", 10, 20, "7.5")]
    nuc = tables.read_track(spark, write(tmp_path, "n.bed", "chr2\t1\t5\t0.5\nchrX\t3\t4\t0\n"), "nucleosomes").orderBy("load_seq").collect()
    assert [(r.chrom, r.value) for r in nuc] == [("chr2", 0.5), ("chrX", 0.0)]
    sub = tables.read_track(spark, write(tmp_path, "s.bed", "header\nchr1\t0\t9\tB3\nchr1\t10\t19\tNA\n"), "subcompartments").orderBy("start").collect()
    assert [r.value for r in sub] == [5.0, 0.0]
    rep = tables.read_repeats(spark, write(tmp_path, "r.txt", "\t".join("abcde") + "\tchr1\t5\t9\tx\ty\tz\tSINE?\tAlu\n"), with_family=True).collect()
    assert [(r.start, r.end, r.value) for r in rep] == [(5, 9, 47)]
    gene = "#h\n1\tNM_1\tchr1\t-\t10\t90\t20\t80\t2\t10,50,\t30,90,\t0\tGEN\tcmpl\tcmpl\t0,\n"
    row = tables.read_genes(spark, write(tmp_path, "refGene.txt", gene)).head()
    assert (row.accession, row.strand, row.tx_end, row.exon_starts, row.exon_ends, row.gene) == ("NM_1", "-", 90, [10, 50], [30, 90], "GEN")
    gap = tables.read_gaps(spark, write(tmp_path, "gap.txt", "1\tchr1\t0\t9\t1\tN\t9\ttelomere\tno\n1\tchr1\t50\t60\t1\tN\t9\tcentromere\tno\n1\tchr1\t70\t80\t1\tN\t9\tclone\tno\n")).orderBy("start").collect()
    assert [(r.start, r.kind) for r in gap] == [(0, "telomere"), (50, "centromere")]
    assert [(r.chrom, r.length) for r in tables.read_chromosome_sizes(spark, write(tmp_path, "sizes", "chr1\t500\nchrUn_7\t9\n")).collect()] == [("chr1", 500)]
    expr = tables.read_expression(spark, write(tmp_path, "ge.csv", "h\n77,a,b,c,1,2,6\n")).collect()
    assert [(r.entrez, r.expression) for r in expr] == [("77", 3.0)]
    catalog = tables.read_catalog(spark, write(tmp_path, "c.csv", "assembly name,url\nA,u1\nA,u2\n"))
    assert catalog.columns[:2] == ["assembly_name", "url"]


def test_splice_files(spark, tmp_path):
    def event(kind, location, accession, region="CDS"):
        cells = ["x"] * 24
        cells[4:7] = ["1", "2", "3"]
        cells[11], cells[12], cells[20], cells[21], cells[23] = "77", kind, location, region, accession
        return "\t".join(f'"{c}"' for c in cells)

    text = "\n".join([
        event("exon skipped", "2", "NM_1"), event("exon skipped", "2", "NM_1"), event("intron retention", "1<>2", "NM_1"), event("exon skipped", "9", "NM_1"),
        event("exon skipped", "1", "NM_2"), event("exons skipped", "<<<1", "NM_2"), event("novel exon", "3", "NM_2"), event("exon skipped", "1", "NM_1", "5 UTR"), event("---", "1", "NM_1"),
    ]) + "\n"
    head = "psLayout\n\nmatch\n  \n-----\n"
    psl = lambda m, strand: "\t".join([str(m)] + ["0"] * 7 + [strand, "q", "9", "0", "9", "chr5", "99", "0", "99", "3", "10,10,10,", "0,", "100,200,300,"]) + "\n"
    write(tmp_path, "blat/NM_1/out.psl", head + psl(5, "-") + psl(9, "+") + psl(9, "-"))
    write(tmp_path, "blat/NM_2/out.psl", head + psl(1, "-"))
    genes = splice.best_alignments(tables.read_psl(spark, str(tmp_path / "blat" / "*" / "out.psl")))
    assert {r.accession: r.strand for r in genes.collect()} == {"NM_1": "+", "NM_2": "-"}
    events = tables.read_splice_events(spark, write(tmp_path, "e.tsv", text))
    got = sorted((r.run, r.accession, r.type, r.start, r.end, r.value) for r in splice.fold_events(events, genes).collect())
    assert got == [
        (1, "NM_1", "exon", 101, 110, 2.0), (1, "NM_1", "exon", 301, 310, 2.0), (1, "NM_1", "intron", 110, 210, 2.0),
        (2, "NM_2", "exon", 201, 210, 2.0), (2, "NM_2", "exon", 301, 310, 2.0),
    ]  # a run of nothing but an empty event gives nothing
    assert splice.fold_events(events, genes, flush_last=False).filter("run = 2").count() == 0
    sinks.write_regions(splice.fold_events(events, genes), str(tmp_path / "regions"))
    back = tables.read_included_regions(spark, str(tmp_path / "regions" / "*.csv"))
    assert back.count() == 5 and back.filter("type = 'intron'").head().end == 210


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("G1", 1, 0.25, ["w1", "w2"]), ("G2", 1, 1.0, [])], "guide string, rank int, score double, warnings array<string>")
    sinks.write_ranked(df, str(tmp_path / "ranked"), per_guide="guide")
    back = spark.read.option("header", True).csv(str(tmp_path / "ranked"))
    assert sorted((r.guide, r.score) for r in back.collect()) == [("G1", "0.25"), ("G2", "1.0")]
    sinks.write_scores(df, str(tmp_path / "scores"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).filter("warnings = 'w1 w2'").count() == 1
    sinks.write_loci(df, str(tmp_path / "loci"))
    assert spark.read.parquet(str(tmp_path / "loci")).count() == 2
    assert [r.score for r in sinks.for_display(df).orderBy("guide").collect()] == ["0.25", "1.00"]
    track = spark.createDataFrame([("chr2", 5, 9, "x", 0)], "chrom string, start bigint, end bigint, value string, load_seq bigint")
    sinks.write_track(track, str(tmp_path / "track"))
    assert spark.read.parquet(str(tmp_path / "track")).count() == 1


def test_pair_file_to_scores_and_back(spark, shape, tmp_path):
    from protoscan.operators.genome import chunk_contigs
    from protoscan.plans import pair_scoring
    from workloads.results import ensemble, stump_rows

    rng = random.Random(44)
    seqs = {g: "".join(rng.choice("ACGT") for _ in range(600)) for g in ("mm9", "rn4")}
    write(tmp_path, "p/a.csv", 'note\ntarget_id,sgRNA,dna_seq_29nt\n1,GAGTCCTAGCAGAAGAAGAA,cctGAGTCCGAGCAGAAGAAGAAGGGCTC\n2,"ACGT",AC\n')
    write(tmp_path, "p/b.csv", "target_id,sgRNA,genome,cell,chr,strand,start\n" + "".join(f"{i},GAGTCCTAGCAGAAGAAGAA,{g},K562,{c},plusStrand,{s}\n" for i, (g, c, s) in enumerate([("mm9", "7", 150), ("rn4", "Chr7", "150"), ("mm9", "7", 590), ("xx1", "7", 150), ("mm9", "7", "?")], 10)))
    store = str(tmp_path / "store")
    for g, seq in seqs.items():
        genome_files.write_genome(chunk_contigs(spark.createDataFrame([("chr7", seq)], "contig string, seq string")), store, g)
    chunks = genome_files.read_genomes(spark, store)
    models = {"noflanking": ensemble(spark, stump_rows()), "flanking": ensemble(spark, stump_rows(4), "flanking")}
    scored, rejected = pair_scoring.score_pair_file(spark, str(tmp_path / "p"), shape, models, chunks)
    done, lost = {r.input.id: r for r in scored.collect()}, {r.input.id: r for r in rejected.collect()}
    assert set(done) == {"1", "10", "11"} and set(lost) == {"2", "12", "13", "14"}
    assert done["1"].mode == "noflanking" and done["10"].mode == "flanking" and all(r.score is not None for r in done.values())
    assert done["1"].input.context == "cctGAGTCCGAGCAGAAGAAGAAGGGCTC" and done["11"].input.chrom == "Chr7" and lost["14"].input.start == "?"
    placed = pair_scoring.locus_contexts(pairs.read_pairs(spark, str(tmp_path / "p/b.csv")), chunks)
    contexts = {r.id: r.context for r in placed.filter("reject_reason is null").collect()}
    assert contexts == {"10": seqs["mm9"][49:272], "11": seqs["rn4"][49:272]}  # each row from its own genome
    sinks.write_pair_scores(scored, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["id", "guide", "context", "genome", "cell_type", "chrom", "strand", "start", "score"] and {r.id for r in back.collect()} == set(done)


def test_ranked_files_keep_their_order(spark, tmp_path):
    rows = [(f"G{i % 3}", i // 3 + 1, i / 7) for i in range(300)]
    random.Random(3).shuffle(rows)
    sinks.write_ranked(spark.createDataFrame(rows, "guide string, rank int, score double").repartition(8), str(tmp_path / "r"), per_guide="guide")
    for guide in ("G0", "G1", "G2"):
        files = sorted((tmp_path / "r" / f"guide={guide}").glob("*.csv"))
        ranks = [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
        assert ranks == list(range(1, 101)) and len(files) <= 2


def test_chunks_of_another_size_are_refused(spark):
    import pytest

    chunks = genome.chunk_contigs(spark.createDataFrame([("c", "ACGT" * 300)], "contig string, seq string"), size=128, halo=64)
    asked = spark.createDataFrame([("c", 200, 220), ("c", 5, 1000)], "contig string, start long, end long")
    assert sorted(len(r.seq) for r in genome.fetch_regions(asked, chunks, size=128, halo=64).collect()) == [21, 996]
    for size, halo in ((256, 64), (128, 32)):
        with pytest.raises(Exception, match="was not cut with"):
            genome.fetch_regions(asked, chunks, size=size, halo=halo).collect()
