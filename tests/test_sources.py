import json
import random
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

from amrspark import fixed
from amrspark.operators import features as FE
from amrspark.operators import groups as G
from amrspark.plans import analysis
from amrspark.sources import chunks, fasta, store, tables
from amrspark.streaming import ingest

HEADER = "\t".join(tables.HIT_FILE_COLUMNS)


def hit(symbol, subtype="AMR", cls="BETA-LACTAM", sub="BETA-LACTAM", method="EXACTX", kind="AMR", **kw):
    row = {
        "Name": "n", "Protein id": "NA", "Contig id": "c1", "Start": "10", "Stop": "90",
        "Strand": "+", "Element symbol": symbol, "Element name": "name", "Scope": "core",
        "Type": kind, "Subtype": subtype, "Class": cls, "Subclass": sub, "Method": method,
        "% Coverage of reference": "100.00", "% Identity to reference": "99.5",
    }
    row.update(kw)
    return "\t".join(row.get(c, "NA") for c in tables.HIT_FILE_COLUMNS)


@pytest.fixture
def hit_folder(tmp_path):
    folder = tmp_path / "hits"
    folder.mkdir()
    one = [
        hit("blaSHV-11"), hit("blaTEM-1"), hit("blaTEM-1", **{"Contig id": "c2"}),
        hit("gyrA_S83Y", "POINT", method="POINTX"),
        hit("ompK35_K292QfsTer17", "POINT_DISRUPT", method="POINTX"),
        hit("fieF", "METAL", kind="STRESS"),
    ]
    (folder / "573.10001.tsv").write_text("\n".join([HEADER, *one]) + "\n")
    (folder / "573.10002.tsv").write_text(HEADER + "\n")
    three = [
        hit("blaKPC-3", method="PARTIAL_CONTIG_ENDX", sub="CARBAPENEM"),
        hit("newGene-1", cls="NA", sub="NA"), hit("blaSHV-12", cls="NA", sub="NA"),
        hit("blaTEM-1", sub="NA"),
    ]
    (folder / "573.10003.tsv").write_text("\n".join([HEADER, *three]) + "\n")
    (folder / "573.10004.tsv").write_text("\n".join([HEADER, hit("x"), hit("y", method="ODD")]) + "\n")
    return str(folder)


def test_hits_to_vectors(spark, hit_folder, tmp_path):
    hits, genomes = tables.read_hits(spark, hit_folder)
    assert genomes.count() == 4
    good, rejected = tables.validated_hits(hits)
    assert [(r["genome_id"], r["error"], r["n_bad"]) for r in rejected.collect()] == [("573.10004", "method", 1)]
    catalog = spark.createDataFrame(
        [
            ("blaSHV-12", "blaSHV", "BETA-LACTAM", "CEFIDEROCOL/CEPHALOSPORIN", 1),
            ("blaSHV-12", "blaSHV", "OTHER", "OTHER", 2),
            ("", "blaTEM-1", "BETA-LACTAM", "BETA-LACTAM", 3),
            ("newGene-1", "x", "", "S", 4),
        ],
        "allele string, gene_family string, class string, subclass string, ord int",
    )
    filled = FE.fill_from_catalog(good, *FE.catalog_lookups(catalog, ["ord"]))
    vectors = {
        r["genome_id"]: r
        for r in FE.feature_vectors(FE.gene_calls(filled), genomes, "2026-05-15.1").collect()
    }
    one = vectors["573.10001"]
    assert set(one["gene_presence"]) == {"blaSHV-11", "blaTEM-1"}
    assert one["gene_hit_count"]["blaTEM-1"] == 2
    assert set(one["point_mutations"]) == {"gyrA_S83Y", "ompK35_K292QfsTer17"}
    assert set(one["point_mutation_disrupt"]) == {"ompK35_K292QfsTer17"}
    empty = vectors["573.10002"]
    assert empty["gene_presence"] == {} and empty["unmapped_class_genes"] == []
    three = vectors["573.10003"]
    assert three["partial_contig_end_genes"] == ["blaKPC-3"]
    assert three["unmapped_class_genes"] == ["newGene-1"]
    assert three["gene_drug_subclass"]["blaSHV-12"] == "CEFIDEROCOL/CEPHALOSPORIN"
    assert three["gene_drug_subclass"]["blaTEM-1"] == "BETA-LACTAM"


def test_stream_ingest_resumes(spark, hit_folder, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.ingest_folder(spark, hit_folder, out, check)
    assert ingest.stored(spark, out, "genomes").count() == 3
    first = ingest.stored(spark, out).count()
    assert first == 4 + 4
    with open(f"{hit_folder}/573.10009.tsv", "w") as fh:
        fh.write("\n".join([HEADER, hit("armA", cls="AMINOGLYCOSIDE", sub="GENTAMICIN")]) + "\n")
    ingest.ingest_folder(spark, hit_folder, out, check)
    ingest.ingest_folder(spark, hit_folder, out, check)
    assert ingest.stored(spark, out).count() == first + 1
    assert ingest.stored(spark, out, "genomes").count() == 4
    assert spark.read.parquet(f"{out}/rejected").count() == 1
    todo = spark.createDataFrame([("573.10001",), ("573.10010",)], "genome_id string")
    assert [r[0] for r in ingest.unfinished(todo, ingest.stored(spark, out, "genomes")).collect()] == ["573.10010"]


FASTA = {
    "ok": ">c1 first > contig\nACGT\nacgtN\n>c2\nGGGG\r\nCC\n",
    "empty": "",
    "text": "hello\nworld\n",
    "dup": ">a\nACGT\n>b\nAC\n>a\nACGT\n",
    "protein": ">a\nACGT\n>b x\nMKLVE\n",
    "ambiguous": ">a\nNNNN\n",
    "noid": ">\nACGT\n",
    "noseq": ">a\n>b\nACGT\n",
}


@pytest.fixture
def assemblies(tmp_path):
    for name, body in FASTA.items():
        folder = tmp_path / "fna" / name
        folder.mkdir(parents=True)
        (folder / f"{name}.fna").write_bytes(body.encode())
    return str(tmp_path / "fna")


def test_assembly_qc(spark, assemblies):
    records = fasta.read_records(spark, assemblies)
    names = spark.createDataFrame([(n,) for n in FASTA], "genome_id string")
    qc = {r["genome_id"]: r for r in fasta.assembly_qc(records, names, min_total=4).collect()}
    assert (qc["ok"]["n_contigs"], qc["ok"]["total_length"], qc["ok"]["error"]) == (2, 15, None)
    errors = {n: r["error"] for n, r in qc.items()}
    assert errors == {
        "ok": None, "empty": "no_records", "text": "no_records", "dup": "duplicate_id",
        "protein": "not_nucleotide", "ambiguous": "all_ambiguous", "noid": "missing_id",
        "noseq": "empty_sequence",
    }
    strict = {r["genome_id"]: r["error"] for r in fasta.assembly_qc(records, min_total=100).collect()}
    assert strict["ok"] == "total_length"
    many = {r["genome_id"]: r["error"] for r in fasta.assembly_qc(records, max_contigs=1).collect()}
    assert many["ok"] == "too_many_contigs" and many["dup"] == "too_many_contigs"
    ids = [r["contig_id"] for r in fasta.contigs(records).where("genome_id = 'ok'").orderBy("ord").collect()]
    assert ids == ["c1", "c2"]


def test_records_of_split_files(spark, tmp_path):
    """Contigs longer than a split, several files in a task, text before the first record."""
    rng = random.Random(1)
    files = {}
    for f in range(6):
        contigs = [(f"c{i} >x" if i % 2 else f"c{i}", "".join(rng.choices("ACGT", k=rng.choice([0, 70, 900, 30_000])))) for i in range(9)]
        lines = ["\n".join(s[i : i + 60] for i in range(0, len(s), 60)) for _, s in contigs]
        body = "".join(f">{h}\n{x}\n" for (h, _), x in zip(contigs, lines))
        files[f"g{f}"] = contigs
        (tmp_path / f"g{f}.fna").write_text(("junk\n" if f == 2 else "") + body)
    (tmp_path / "none.fna").write_text("junk only\n")
    (tmp_path / "twice.fna").write_text(">>a\nAC\n>>b\nGT\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            records = fasta.read_records(spark, str(tmp_path))
            plan = records._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
            got = {}
            for r in records.orderBy("genome_id", "ord").collect():
                got.setdefault(r["genome_id"], []).append((r["header"], "".join(r["body"].split())))
            assert got.pop("twice") == [(">a", "AC"), (">b", "GT")]
            assert got == files
            qc = {r["genome_id"]: r["n_contigs"] for r in fasta.assembly_qc(records).collect()}
            assert qc == {**{g: 9 for g in files}, "twice": 2}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_inventory_skips_empty_files(spark, assemblies):
    found = {r["genome_id"] for r in fasta.inventory(spark, assemblies).collect()}
    assert found == set(FASTA) - {"empty"}


def test_truncation_rule_order(spark):
    measured = spark.createDataFrame(
        [("a", 0, 0), ("b", 5, 100), ("c", 3, 100), ("d", 3, 102), ("e", 3, 101), ("f", 3, 7)],
        "genome_id string, n_contigs long, total_length long",
    )
    expected = spark.createDataFrame(
        [("a", "3", "100"), ("b", "4", "100"), ("c", "4", "100"), ("d", "3", "100"), ("e", "3", "100"), ("f", "x", None)],
        "genome_id string, contigs string, genome_length string",
    )
    out = fasta.truncation_problems(measured, expected, ceiling=5)
    assert {r["genome_id"]: r["problem"] for r in out.collect()} == {
        "a": "empty", "b": "at_ceiling", "c": "contig_count", "d": "length", "e": None, "f": None,
    }


def test_genomes_sent_again(spark, hit_folder, tmp_path):
    """Only the newest state counts: other calls, none, rejected, or sound after all."""
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.ingest_folder(spark, hit_folder, out, check)

    def state(root):
        calls = ingest.stored(spark, root).groupBy("genome_id").agg(F.sort_array(F.collect_list("gene"))).collect()
        sets = [{r["genome_id"] for r in ingest.stored(spark, root, t).collect()} for t in ("genomes", "rejected")]
        return {r[0]: r[1] for r in calls}, *sets

    calls, genomes, rejected = state(out)
    assert set(calls) == {"573.10001", "573.10003"} and rejected == {"573.10004"}
    later = tmp_path / "hits" / "later"
    later.mkdir()
    again = {"573.10001": [], "573.10003": [hit("armA", method="ODD")], "573.10004": [hit("armA")]}
    for name, rows in again.items():
        (later / f"{name}.tsv").write_text("\n".join([HEADER, *rows]) + "\n")
    ingest.ingest_folder(spark, hit_folder, out, check)
    want = ({"573.10004": ["armA"]}, {"573.10001", "573.10002", "573.10004"}, {"573.10003"})
    assert state(out) == want
    target = str(tmp_path / "compact")
    ingest.compact(spark, out, target)
    assert state(target) == want
    last = tmp_path / "hits" / "last"
    last.mkdir()
    (last / "573.10003.tsv").write_text("\n".join([HEADER, hit("sul1")]) + "\n")
    ingest.ingest_folder(spark, hit_folder, target, check)
    assert state(target)[0] == {"573.10003": ["sul1"], "573.10004": ["armA"]}


def test_writers_at_once_get_their_own_versions(spark, tmp_path):
    root = str(tmp_path / "models")
    tables_of = [{"scores": spark.createDataFrame([(i,)], "i int")} for i in range(4)]
    with ThreadPool(4) as pool:
        versions = pool.map(lambda t: store.save(spark, root, "drug/one", t), tables_of)
    assert sorted(versions) == [1, 2, 3, 4]
    for i, v in enumerate(versions):
        assert store.load(spark, root, "drug/one", "scores", v).first()["i"] == i
    # A version that was claimed but never finished is not seen, and not used again.
    assert store._claim(spark, f"{root}/claims/{store._folder('drug/one')}", 5) == 5
    assert store.current(store.registry(spark, root)).first()["version"] == 4
    assert store.save(spark, root, "drug/one", tables_of[0]) == 6


def test_claims_at_once_are_distinct(spark, tmp_path):
    with ThreadPool(8) as pool:
        claimed = pool.map(lambda _: store._claim(spark, str(tmp_path / "claims"), 1), range(48), chunksize=1)
    assert sorted(claimed) == list(range(1, 49))


def test_jsonl_chunks(spark, tmp_path):
    def line(i, t):
        return json.dumps({"chunk_id": i, "gene_family": "f", "drugs": ["meropenem"], "text": t, "source": "s"})

    (tmp_path / "a.jsonl").write_text("\n".join([line("1", "first"), "", line("2", "two"), line("1", "late")]) + "\n")
    (tmp_path / "b.jsonl").write_text(line("2", "other file") + "\n" + line("3", "three") + "\n")
    got = {r["chunk_id"]: r["text"] for r in chunks.read_jsonl(spark, str(tmp_path)).collect()}
    assert got == {"1": "first", "2": "two", "3": "three"}
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        chunks.read_jsonl(spark, str(tmp_path)).collect()


def test_metadata_and_groups(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(
        "genome_id\tgenome_name\ttaxon_id\tmlst\n"
        "1\ta\t573\tkpneumoniae.258\n2\ta\t573\tMLST.klebsiella.258\n3\ta\t573\t\n"
        "4\ta\t573\tmalformed-value\n5\ta\t573\tmlst.x.1.2\n"
    )
    meta = tables.read_metadata(spark, str(tmp_path / "m.tsv"))
    got = {r["genome_id"]: (r["mlst_scheme"], r["mlst_st"]) for r in meta.collect()}
    assert got == {"1": ("kpneumoniae", 258), "2": ("klebsiella", 258), "3": (None, None), "4": (None, None), "5": (None, None)}
    genomes = spark.createDataFrame([("1",), ("3",), ("9",)], "genome_id string")
    groups = {r["genome_id"]: r["grp"] for r in G.assign_groups(genomes, meta, ["genome_id"]).collect()}
    assert groups == {"1": "st:kpneumoniae:258", "3": "singleton:3", "9": "singleton:9"}
    plain = meta.drop("mlst", "mlst_scheme", "mlst_st")
    assert G.with_mlst(plain).where("mlst_st is not null").count() == 0


def test_store_versions_are_numeric(spark, tmp_path):
    root = str(tmp_path / "store")
    table = spark.createDataFrame([(1,)], "x int")
    for n in range(1, 12):
        assert store.save(spark, root, "meropenem", {"model": table.withColumn("n", F.lit(n))}) == n
    store.save(spark, root, "gentamicin", {}, status="insufficient_data", reason="few")
    assert store.load(spark, root, "meropenem", "model").first()["n"] == 11
    now = {r["antibiotic"]: r["version"] for r in store.current(store.registry(spark, root)).collect()}
    assert now == {"meropenem": 11, "gentamicin": 1}
    names = spark.createDataFrame([("a", "v2"), ("a", "v10"), ("a", "draft")], "antibiotic string, version string")
    assert store.latest(names).first()["version"] == "v10"
    with pytest.raises(LookupError):
        store.load(spark, root, "other", "model")


def test_build_dataset(spark, tmp_path, assemblies):
    lab = "Laboratory Method"
    rows = [
        ["ok", "K p", "573", "meropenem", "R", lab, "MIC", "<=1", "1", "mg/L", "CLSI", "2015"],
        ["ok", "K p", "573", "SXT", "S", lab, "MIC", "1", "1", "mg/L", "", ""],
        ["z", "K p", "573", "SXT", "S", lab, "MIC", "1", "1", "mg/L", "", ""],
        ["z", "K p", "573", "SXT", "R", "Computational Method", "MIC", "1", "1", "mg/L", "", ""],
    ]
    (tmp_path / "t.tsv").write_text("\n".join(["\t".join(fixed.TEST_COLUMNS), *["\t".join(r) for r in rows]]) + "\n")
    (tmp_path / "m.tsv").write_text("genome_id\tgenome_name\ttaxon_id\tmlst\nok\ta\t573\tk.1\nz\ta\t573\t\n")
    labels = analysis.build_dataset(
        spark, str(tmp_path / "t.tsv"), str(tmp_path / "out"), metadata_path=str(tmp_path / "m.tsv"), assemblies=assemblies
    )
    got = {(r["genome_id"], r["antibiotic"]): (r["sir"], r["has_fasta"]) for r in labels.collect()}
    assert got == {
        ("ok", "meropenem"): ("Resistant", True),
        ("ok", "trimethoprim-sulfamethoxazole"): ("Susceptible", True),
        ("z", "trimethoprim-sulfamethoxazole"): ("Susceptible", False),
    }
    text = spark.read.json(str(tmp_path / "out" / "dataset_manifest.json")).first()["manifest"]
    doc = json.loads(text)
    assert doc["counts"]["raw_rows"] == 4 and doc["counts"]["lab_rows"] == 3
    assert doc["counts"]["missing_fraction"] == 0.5
    assert doc["evidence_vocabulary"] == {lab: 3, "Computational Method": 1}
    assert len(doc["per_drug"]) == 2
    tables.write_tsv(labels, ("genome_id", "pmid"), str(tmp_path / "tsv"))
    assert tables.read_strings(spark, str(tmp_path / "tsv")).columns == ["genome_id", "pmid"]
