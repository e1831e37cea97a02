"""Readers on small files written by the test, and reading back what the sinks write."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from omicframe.operators.grid import columns_as_groups, replicates_by_row, replicates_by_x
from omicframe.sinks import tables as sink
from omicframe.sources import cohort_files as cf
from omicframe.sources import fcs, gene_tables, grid, sequence_files


def test_cohort_files(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps([{"project_id": "P-A", "n_genes": 2, "n_samples": 3, "n_tumor": 2}]))
    assert cf.read_cohort_index(spark, str(tmp_path / "index.json")).collect()[0]["n_tumor"] == 2
    meta = {
        "project_id": ["P-A"], "n_genes": [2], "n_samples": [3], "gene_ids": ["G1.2", "G2"], "gene_names": ["one", ""],
        "sample_ids": ["s1", "s2", "s3"], "sample_conditions": ["Tumor", "Tumor", "Normal"], "patient_ids": ["p1", "p2", "p3"],
        "vital_status": [["Dead"], None, "Alive"], "days_to_death": [[12], None, None], "days_to_last_follow_up": [None, 7, 9],
        "age_at_diagnosis": [1, 2, 3], "gender": ["f", "m", None],
    }
    plain = {**meta, "project_id": "P-B", "n_genes": 2, "n_samples": 3, "vital_status": ["Dead", None, "Alive"]}
    for name, m in (("P-A", meta), ("P-B", plain)):
        (tmp_path / f"{name}_meta.json").write_text(json.dumps(m))
        np.arange(6, dtype="<f4").tofile(tmp_path / f"{name}_matrix.bin")
    genes, samples = cf.read_cohort_meta(spark, str(tmp_path / "*_meta.json"))
    assert genes.count() == 4 and genes.where("gene_idx = 1 and gene_name = ''").count() == 2
    for p in ("P-A", "P-B"):
        s = [tuple(r) for r in samples.where(F.col("project_id") == p).orderBy("sample_idx").select("condition", "vital_status", "days_to_death", "days_to_last_follow_up").collect()]
        assert s == [("Tumor", "Dead", 12, None), ("Tumor", None, None, 7), ("Normal", "Alive", None, 9)]
    m = cf.read_matrix(spark, str(tmp_path / "*_matrix.bin"), str(tmp_path / "*_meta.json"), block_genes=1)
    got = {(r["project_id"], r["gene_idx"], r["sample_idx"]): r["value"] for r in m.collect()}
    assert len(got) == 12 and got[("P-B", 1, 2)] == 5.0 and got[("P-A", 0, 1)] == 1.0
    out = str(tmp_path / "store")
    sink.write_cohort(m, genes, samples, out)
    sink.write_cohort(m.where("project_id = 'P-A'").withColumn("value", F.col("value") * 0), genes.where("project_id = 'P-A'"), samples.where("project_id = 'P-A'"), out)
    back = spark.read.parquet(f"{out}/expression")
    assert back.count() == 12 and back.where("project_id = 'P-A'").agg(F.sum("value")).collect()[0][0] == 0
    assert back.where("project_id = 'P-B'").agg(F.sum("value")).collect()[0][0] == 15


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("TP53, BRCA1\tEGFR;tp53\r\n\n BRCA1 ,ENSG1\n")
    got = [r["id"] for r in cf.read_id_list(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()]
    assert got == ["TP53", "BRCA1", "EGFR", "tp53", "ENSG1"]


def test_gene_tables(spark, tmp_path):
    (tmp_path / "h.txt").write_text(
        "HGNC_ID\tSymbol\tname\tlocus_type\tlocation\talias_symbol\tprev_symbol\tentrez_id\tensembl_gene_id\n"
        'HGNC:1\tA1\t"alpha one"\tprotein\t1p\tX1| X2 \tX1|OLD\t11\tENSG1\n'
        "HGNC:2\t\tnone\t\t\t\t\t\t\n"
    )
    h = gene_tables.import_hgnc(spark, str(tmp_path / "h.txt")).collect()
    assert len(h) == 1 and h[0]["aliases"] == ["X1", "X2", "OLD"] and h[0]["full_name"] == "alpha one" and h[0]["hgnc_id"] == "HGNC:1"
    with gzip.open(tmp_path / "n.gz", "wt") as f:
        f.write("#tax_id\tGeneID\tSymbol\tSynonyms\tdbXrefs\tchromosome\tdescription\ttype_of_gene\n")
        f.write("10090\t5\tTrp53\tp53|bbl\tMGI:MGI:98834|Ensembl:ENSMUSG00000059552\t11\t-\tprotein-coding\n")
        f.write("10090\t6\t-\t-\t-\t-\t-\t-\n")
    n = gene_tables.import_gene_info(spark, str(tmp_path / "n.gz"), "ENSMUSG").collect()
    assert len(n) == 1 and n[0]["ensembl_id"] == "ENSMUSG00000059552" and n[0]["aliases"] == ["p53", "bbl"] and n[0]["full_name"] is None
    db = {"Info": {"species": "human", "geneCount": 2, "LastUpdate": "2024-01-02T03:04:05"}, "genes": [{"symbol": "S1", "ensemblId": "E1", "Aliases": ["q"]}, {"Symbol": "S2"}]}
    (tmp_path / "db.json").write_text(json.dumps(db))
    genes, info = gene_tables.read_gene_db(spark, str(tmp_path / "db.json"))
    g = genes.orderBy("gene_ord").collect()
    assert [r["symbol"] for r in g] == ["S1", "S2"] and g[0]["ensembl_id"] == "E1" and g[0]["aliases"] == ["q"]
    assert info.collect()[0]["species"] == "human" and info.collect()[0]["gene_count"] == 2
    sink.write_gene_db(genes, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert '"Symbol":"S2"' in text and "null" not in text
    back, head = gene_tables.read_gene_db(spark, str(tmp_path / "out" / "part*"))
    assert sorted(map(str, back.drop("gene_ord").collect())) == sorted(map(str, genes.drop("gene_ord").collect()))
    assert head.collect()[0]["gene_count"] == 2


def test_gene_db_values_are_not_changed(spark, tmp_path):
    db = {"INFO": {"Species": "a : \"b\": c"}, "Genes": [{"FullName": "~5KB Protein", "Aliases": ["~B", 'say "X": y'], "Symbol": "S{1}"}]}
    (tmp_path / "db.json").write_text(json.dumps(db))
    genes, info = gene_tables.read_gene_db(spark, str(tmp_path / "db.json"))
    g = genes.collect()[0]
    assert (g["full_name"], g["aliases"], g["symbol"]) == ("~5KB Protein", ["~B", 'say "X": y'], "S{1}")
    assert info.collect()[0]["species"] == 'a : "b": c'
    sink.write_gene_db(genes.limit(0), str(tmp_path / "none"), "human", "1")
    none, head = gene_tables.read_gene_db(spark, str(tmp_path / "none" / "part*"))
    assert none.count() == 0 and head.collect()[0]["gene_count"] == 0 and head.collect()[0]["sources"] == "HGNC"


def test_a_short_matrix_is_an_error(spark, tmp_path):
    meta = {"project_id": "P", "n_genes": 3, "n_samples": 2, "gene_ids": ["a", "b", "c"], "gene_names": ["", "", ""], "sample_ids": ["s", "t"]}
    (tmp_path / "P_meta.json").write_text(json.dumps(meta))
    np.arange(4, dtype="<f4").tofile(tmp_path / "P_matrix.bin")
    with pytest.raises(Exception, match="has 16 bytes, not 24"):
        cf.read_matrix(spark, str(tmp_path / "*_matrix.bin"), str(tmp_path / "*_meta.json")).collect()


def _fcs(path, kind, order, bits, rows, extra=(), total=None):
    n = len(rows[0])
    keys = {"$PAR": n, "$TOT": len(rows) if total is None else total, "$BYTEORD": order, "$DATATYPE": kind}
    for i in range(n):
        keys |= {f"$P{i + 1}B": bits, f"$P{i + 1}N": f"FL{i + 1}-A", f"$P{i + 1}R": 1000}
    keys |= {"$P1S": "Marker", **dict(extra)}
    text = "/" + "/".join(f"{k}/{v}" for k, v in keys.items()) + "/"
    mark = "<" if order.startswith("1") else ">"
    code = {"F": "f", "D": "d", "I": {16: "H", 32: "I"}[bits]}[kind] if kind == "I" else {"F": "f", "D": "d"}[kind]
    data = b"".join(struct.pack(f"{mark}{n}{code}", *r) for r in rows)
    start = 58
    d0 = start + len(text.encode())
    head = f"FCS3.0    {start:>8}{d0 - 1:>8}{d0:>8}{d0 + len(data) - 1:>8}{0:>8}{0:>8}"
    path.write_bytes(head.encode() + text.encode() + data)


@pytest.mark.parametrize("kind,bits", [("F", 32), ("D", 64), ("I", 16), ("I", 32)])
@pytest.mark.parametrize("order", ["1,2,3,4", "4,3,2,1"])
def test_fcs(spark, tmp_path, kind, bits, order):
    rows_ = [(1, 2, 3), (400, 999, 2000)] if kind == "I" else [(1.5, -2.0, float("nan")), (400.25, 5000.0, float("inf"))]
    _fcs(tmp_path / "a.fcs", kind, order, bits, rows_, [("$SPILLOVER", "2,FL1-A,marker2,100,5,10,100")], total=9)
    _fcs(tmp_path / "b.fcs", kind, order, bits, rows_, [("SPILL", "3,FL1-A")])
    events, params, spill = fcs.read_fcs(spark, str(tmp_path / "*.fcs"))
    got = [list(r["values"]) for r in events.where("file = 'a.fcs'").orderBy("event_id").collect()]
    assert got == ([[1, 2, 3], [400, 999, 1000]] if kind == "I" else [[1.5, -2.0, 0.0], [400.25, 1000.0, 0.0]])
    p = params.where("file = 'a.fcs'").orderBy("idx").collect()
    assert [r["label"] for r in p] == ["Marker", "FL2-A", "FL3-A"] and p[0]["max_range"] == 1000
    s = spill.collect()
    assert len(s) == 1 and s[0]["channels"] == ["FL1-A", "marker2"] and s[0]["matrix"] == [[100.0, 5.0], [10.0, 100.0]]


def test_fasta_and_enzymes(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">one x\nacgtN\nTTaa\n>two\r\nGG-CC\r\n")
    got = {r["name"]: r["sequence"] for r in sequence_files.read_fasta(spark, str(tmp_path / "s.fa")).collect()}
    assert got == {"one x": "ACGTTTAA", "two": "GGCC"}
    (tmp_path / "s.fa").write_text(">seq1 A->G mutant\nAC>GT\nTT\n>empty\n>last > one\nGGG")
    (tmp_path / "t.fa").write_text("acgt\nNNAC\n>named\nTTT\n")
    (tmp_path / "u.fa").write_text("ggcc\n")
    got = sorted(tuple(r) for r in sequence_files.read_fasta(spark, str(tmp_path / "*.fa")).collect())
    assert got == [("", "ACGTAC"), ("", "GGCC"), ("empty", ""), ("last > one", "GGG"), ("named", "TTT"), ("seq1 A->G mutant", "ACGTTT")]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7")  # many splits, several in a task
    try:
        assert sorted(tuple(r) for r in sequence_files.read_fasta(spark, str(tmp_path / "*.fa")).collect()) == got
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "e.txt").write_text("# list\n\nEcoRI;gaattc;1;5\nbad;line\nNo;AC;x;1\n BamHI ; GGATCC;1;5\necori;AAAAAA;0;0\n")
    t = sequence_files.read_enzymes(spark, str(tmp_path / "e.txt"))
    assert [tuple(r) for r in t.collect()] == [("BamHI", "GGATCC", 1, 5), ("EcoRI", "GAATTC", 1, 5)]


GB = """LOCUS       XX0001   60 bp    DNA     circular SYN 01-JAN-2000
DEFINITION  Cloning vector pTEST-1, complete
            sequence.
ACCESSION   XX0001
FEATURES             Location/Qualifiers
     source          1..60
                     /organism="Cloning vector pORG-2"
     promoter        complement(<5..>14)
                     /note="T7 promoter"
     CDS             join(20..25,
                     30..40)
                     /gene="bla"
                     /product="beta-lactamase with
                     a long name"
     misc_feature    50
                     /label="first"
                     /label=pUC ori
     rep_origin      1^2
ORIGIN
        1 acgtacgtac gtacgtacgt acgtacgtac gtacgtacgt acgtacgtac gtacgtacgt
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GB)
    (tmp_path / "b.gb").write_text("not a record")
    seqs, feats = sequence_files.read_genbank(spark, str(tmp_path / "*.gb"))
    s = seqs.collect()
    assert len(s) == 1 and s[0]["name"] == "pORG-2" and s[0]["size"] == 60 and s[0]["is_circular"]
    assert s[0]["description"] == "Cloning vector pTEST-1, complete sequence" and s[0]["category"] == "E. coli Expression"
    f = {r["name"]: (r["type"], r["start"], r["end"], r["is_reverse"]) for r in feats.collect()}
    assert f == {
        "T7 promoter": ("Promoter", 4, 14, True),
        "bla": ("Resistance", 19, 40, False),
        "pUC ori": ("Origin", 49, 50, False),
    }


TX = """LOCUS       NG_1   50 bp
ACCESSION   NG_1
FEATURES             Location/Qualifiers
     gene            1..40
                     /gene="ABC"
     mRNA            complement(join(3..10,21..30))
                     /gene="ABC"
                     /product="abc, transcript variant 2"
                     /transcript_id="NM_2.1"
     CDS             complement(join(5..10,21..24))
                     /transcript_id="NM_2.1"
     mRNA            join(1..10,31..40)
                     /transcript_id="NM_1.1"
ORIGIN
        1 aaaaaccccc gggggttttt aaaaaccccc gggggttttt aaaaaccccc
//
"""


def test_transcripts(spark, tmp_path):
    (tmp_path / "g.gb").write_text(TX)
    tx, exons, parts = sequence_files.read_transcripts(spark, str(tmp_path / "g.gb"))
    t = tx.collect()
    assert [r["transcript_id"] for r in t] == ["NM_1.1", "NM_2.1"] and t[1]["label"] == "Variant 2" and t[0]["label"] == "Isoform 2"
    assert t[1]["gene"] == "ABC" and t[1]["accession"] == "NG_1" and len(t[1]["template"]) == 28
    minus = exons.where("seq_id like '%NM_2.1'").orderBy("exon").collect()
    assert [(r["start"], r["end"]) for r in minus] == [(1, 10), (21, 28)]
    coding = parts.where("seq_id like '%NM_2.1'").orderBy("part").collect()
    assert [(r["start"], r["end"]) for r in coding] == [(7, 10), (21, 26)]
    assert parts.where("seq_id like '%NM_1.1'").count() == 0


def test_grids(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("1\t2\t4\n1\t6\tx\nb\t1\t1\n\t\t\n2\t9\t9\n")
    g = grid.read_grid(spark, str(tmp_path / "g.tsv"), ["X_0", "Y0_0", "Y1_0"])
    by_x = {(r["series"], r["x_label"]): (r["n"], r["mean"]) for r in replicates_by_x(g).collect()}
    assert by_x == {(0, "1"): (2, 4.0), (1, "1"): (1, 4.0), (0, "2"): (1, 9.0), (1, "2"): (1, 9.0)}
    text = {(r["series"], r["x_label"]): r["x"] for r in replicates_by_x(g, True).collect()}
    assert text[(0, "b")] == 1.0 and text[(0, "2")] == 2.0
    by_row = [(r["x_label"], r["series"], r["mean"]) for r in replicates_by_row(g, allow_text_x=True).orderBy("row_id", "series").collect()]
    assert by_row == [("1", 0, 2.0), ("1", 1, 4.0), ("1", 0, 6.0), ("b", 0, 1.0), ("b", 1, 1.0)]
    bars = {r["series"]: (r["n"], r["mean"]) for r in columns_as_groups(g).collect()}
    assert bars == {0: (4, 4.5), 1: (3, 14 / 3)}
    (tmp_path / "s.tsv").write_text("1\t5\t2\t4\n2\t7\t\t0\n3\tz\t1\t1\n")
    s = grid.read_grid(spark, str(tmp_path / "s.tsv"), ["X_0", "Y0_Mean", "Y0_SD", "Y0_N"])
    got = [(r["x"], r["mean"], r["sd"], r["n"], r["sem"]) for r in replicates_by_row(s, "summary").orderBy("row_id").collect()]
    assert got == [(1.0, 5.0, 2.0, 4, 1.0), (2.0, 7.0, 0.0, 1, 0.0)]
    flipped = grid.read_grid(spark, str(tmp_path / "g.tsv"), ["A", "B", "C", "D", "E"], transpose=True)
    assert [tuple(r)[1:] for r in flipped.orderBy("row_id").collect()] == [("1", "1", "b", "", "2"), ("2", "6", "1", "", "9"), ("4", "x", "1", "", "9")]


def _read(folder):
    return [line for p in sorted(folder.glob("part-*.csv")) for line in p.read_text().splitlines()]


def test_csv_sinks(spark, tmp_path):
    d = spark.createDataFrame([("g2", "E2", 1.5, 0.5, 0.30103, 0.6, 2.0, 0.5), ("g1", "E1", -2.0, 1e-12, 12.0, 2e-12, 1.0, 3.0)],
        "gene_name string, gene_id string, log2_fold_change double, p_value double, neg_log10_p double, fdr double, mean_1 double, mean_2 double")
    sink.write_differential(d.coalesce(1), str(tmp_path / "v"))
    lines = _read(tmp_path / "v")
    assert lines[0].startswith("Gene,GeneID,Log2FC") and lines[1] == "g1,E1,-2.0000,1.0000E-012,12.0000,2.0000E-012,Down,1.0000,3.0000,false"
    c = spark.createDataFrame([(1, "a", 'say "x"', "OK", False), (1, "a", "b", "Alt 2", True)], "pos int, input string, symbol string, status string, is_alternate boolean")
    for extra in ("ensembl_id", "entrez_id", "hgnc_id", "full_name", "biotype"):
        c = c.withColumn(extra, F.lit(None).cast("string"))
    sink.write_conversion(c, str(tmp_path / "c"))
    assert [x for x in _read(tmp_path / "c") if "Input" not in x] == ['"a","OK","say ""x""","","","","",""']
    m = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.25), ("b", "a", 0.25), ("b", "b", 1.0)], "feature_1 string, feature_2 string, r double")
    sink.write_square_matrix(m, str(tmp_path / "m"), ["a", "b"])
    assert "a,1.0000,0.2500" in _read(tmp_path / "m")
    k = spark.createDataFrame([("Low", 0, 1.0, 2, 0, 0), ("High", 30, 0.5, 2, 1, 0), ("High", 0, 1.0, 2, 0, 0)], "side string, time int, survival double, at_risk int, events int, censored int")
    sink.write_km(k.coalesce(1), str(tmp_path / "k"))
    assert [x for x in _read(tmp_path / "k") if not x.startswith("Group")] == ["High,0,0.0,1.0000,2,0,0", "High,30,1.0,0.5000,2,1,0", "Low,0,0.0,1.0000,2,0,0"]
    b = spark.createDataFrame([("X", "g", 3, 1.0, 0.1, 4, 2.0, 0.2, 0.01, 0.02)], "cancer string, gene string, n_1 int, mean_1 double, sd_1 double, n_2 int, mean_2 double, sd_2 double, p_value double, fdr double")
    sink.write_box_summary(b, str(tmp_path / "b"))
    assert "X,g,3,1.0000,0.1000,4,2.0000,0.2000,1.0000E-002,2.0000E-002" in _read(tmp_path / "b")
    s = spark.createDataFrame([("s1", 1.0, 2.0, "Tumor")], "sample string, x double, y double, condition string")
    sink.write_pairs(s, str(tmp_path / "p"), "TP53", "MYC")
    assert set(_read(tmp_path / "p")) == {"SampleID,TP53,MYC,Condition", "s1,1.0000,2.0000,Tumor"}
    e = spark.createDataFrame([(1, "g", "E", -0.5, 0.001, 0.01, "negative", 9)], "rank int, gene_name string, gene_id string, r double, p_value double, fdr double, direction string, n int")
    sink.write_coexpression(e, str(tmp_path / "e"))
    assert "1,g,E,-0.500000,0.500000,1.0000E-003,1.0000E-002,negative,9" in _read(tmp_path / "e")
    g = spark.createDataFrame([("f", "Scatter", "a / b", "g1", 1234, 12.345, "All Events", "")], "file string, view string, parameters string, gate string, n_in_gate long, pct_of_positive double, parent string, details string")
    sink.write_gate_stats(g, str(tmp_path / "g"))
    assert any(x.startswith('"f","Scatter","a / b","g1","1,234","12.3') for x in _read(tmp_path / "g"))
    u = spark.createDataFrame([(1, 100, 122, 2, "ACGT", "AGG", "+", 50.0, True)], "seq_id int, position int, position_end int, exon int, guide string, pam string, strand string, gc double, is_recommended boolean")
    sink.write_guides(u, str(tmp_path / "u"))
    assert "1,100-122,2,ACGT,AGG,+,50%,True,," in _read(tmp_path / "u")
    r = spark.createDataFrame([(1, 1, "AC", "GT", 60.0, 61.0, 1.0, 300, 88.25)], "template_id int, rank int, f_sequence string, r_sequence string, f_tm double, r_tm double, tm_diff double, product int, score double")
    sink.write_primer_pairs(r, str(tmp_path / "r"))
    assert any(x.startswith("1,AC,GT,60.0,61.0,1.0,300,88.") for x in _read(tmp_path / "r"))


def test_count_pipeline(spark):
    from omicframe.operators.cohort import preprocess_counts

    data = [("G1.1", "TS-1-a-01", 10), ("G1.2", "TS-1-a-01", 13), ("G1.1", "TS-2-b-01", 8), ("G1.2", "TS-2-b-01", 9), ("G2.1", "TS-1-a-01", 100),
            ("G2.1", "TS-2-b-01", 50), ("G3.1", "TS-1-a-01", 1), ("G3.1", "TS-2-b-01", 2), ("G2.1", "XX", 5), ("G1.1", "XX", 7), ("G1.2", "XX", 7)]
    counts = spark.createDataFrame([(g, s, float(v)) for g, s, v in data], "gene string, sample string, value double")
    samples = spark.createDataFrame([("TS-1-a-01", "Primary Tumor"), ("TS-2-b-01", "Solid Tissue Normal")], "sample string, sample_type string")
    clinical = spark.createDataFrame([("TS-1-a", "Dead", 5)], "patient_id string, vital_status string, days_to_death int")
    fact, genes, dim = preprocess_counts(counts, samples, clinical, "P")
    assert [r["gene_id"] for r in genes.orderBy("gene_idx").collect()] == ["G1", "G2"]
    d = dim.orderBy("sample_idx").collect()
    assert [(r["condition"], r["vital_status"]) for r in d] == [("Tumor", "Dead"), ("Normal", None)]
    # merged counts: G1 12 (11.5 half-even), 8 (8.5 half-even); G2 100, 50 -> median of log ratios per sample
    import math

    logs = {s: [math.log(v) for v in vs] for s, vs in {"a": (12, 100), "b": (8, 50)}.items()}
    mean = [(x + y) / 2 for x, y in zip(logs["a"], logs["b"])]
    factor = {s: math.exp(sum(v - m for v, m in zip(logs[s], mean)) / 2) for s in logs}
    got = {(r["gene_idx"], r["sample_idx"]): r["value"] for r in fact.collect()}
    assert got[(0, 0)] == pytest.approx(12 / factor["a"], rel=1e-6) and got[(1, 1)] == pytest.approx(50 / factor["b"], rel=1e-6)
