import gzip

import numpy as np
import pytest

from repset import workflow
from repset.__main__ import main, parser
from repset.collection import is_fasta, of_fasta
from repset.operators import filters, linkage, pairs, ranges, scaffolds, score, sketch, taxonomy, warn
from repset.sources import fasta, programs, tables
from repset.sources.workspace import Workspace


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_and_bins(spark, tmp_path):
    a = _write(tmp_path / "a.fa", ">s1 first\nACGT\nAC\n>s2\nAAAA\n>empty\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">s2\nGG\n>s3\r\nC C\n")
    b = str(tmp_path / "b.fa.gz")
    got = {tuple(r) for r in fasta.lengths(spark, [a, b]).collect()}
    assert got == {("a.fa", "s1", 6), ("a.fa", "s2", 4), ("a.fa", "empty", 0), ("b.fa.gz", "s2", 2), ("b.fa.gz", "s3", 2)}
    assert {tuple(r) for r in fasta.genome_info(spark, [a]).collect()} == {("a.fa", 10, 6)}
    bins = fasta.scaffold_bins(spark, [a, b])
    assert {r[0]: r[1] for r in bins.collect()} == {"s1": "a.fa", "s2": "b.fa.gz", "s3": "b.fa.gz", "empty": "a.fa"}
    fasta.write_bins(fasta.records(spark, [a]), bins, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("bin = 'a.fa' AND value = '>s1 first'").count() == 1
    fasta.without(fasta.records(spark, [a]), bins.where("scaffold = 's1'").withColumnRenamed("scaffold", "id"), str(tmp_path / "cut"))
    assert spark.read.text(str(tmp_path / "cut")).where("value LIKE '>s1%'").count() == 0
    assert [r[0] for r in fasta.list_items(spark, [_write(tmp_path / "list.txt", f"{a}\n{b}\n")]).orderBy("genome").collect()] == ["a.fa", "b.fa.gz"]


def test_delta(spark, tmp_path):
    d = _write(tmp_path / "x.delta", "/r /q\nNUCMER\n>r1 q1 100 200\n1 51 60 10 2 2 0\n5\n-3\n0\n60 90 1 31 0 0 0\n0\n>r2 q2 50 60\n1 20 1 20 1 1 0\n0\n")
    assert [tuple(r)[1:] for r in tables.delta_totals(spark, d).collect()] == [(99, 3, 96 / 99)]
    assert {(r["r_scaff"], r["r_len"], r["q_end"], r["errors"]) for r in tables.delta_alignments(spark, d).collect()} == {("r1", 100, 10, 2), ("r1", 100, 31, 0), ("r2", 50, 20, 1)}


def test_tool_tables(spark, tmp_path):
    m = _write(tmp_path / "m.tsv", "/p/a.fa\t/p/b.fa\t0.25\t1e-3\t3/10\n")
    assert [tuple(r) for r in tables.sketch_table(spark, m).collect()] == [("a.fa", "b.fa", 0.25, 0.75)]
    f = _write(tmp_path / "f.txt", "/p/a.fa /p/b.fa 98.5 80 100\n")
    assert [tuple(r) for r in tables.fragment_ani(spark, f).collect()] == [("a.fa", "b.fa", 0.985, 0.8)]
    t = _write(tmp_path / "t", "2\n/p/a.fa\t100\n/p/b.fa\t90\t100\n")
    af = _write(tmp_path / "t.af", "2\n/p/a.fa\t100\t70\n/p/b.fa\t60\t100\n")
    got = {(r[0], r[1]): (round(r[2], 6), round(r[3], 6)) for r in tables.triangle_pairs(spark, t, af).collect()}
    assert got == {("a.fa", "a.fa"): (1, 1), ("b.fa", "b.fa"): (1, 1), ("a.fa", "b.fa"): (0.9, 0.7), ("b.fa", "a.fa"): (0.9, 0.6)}
    g = _write(tmp_path / "g", "GENOME1\tGENOME2\tANI(1->2)\tANI(2->1)\tAF(1->2)\tAF(2->1)\na.fna\tb.fna\t98\t97\t0.5\t0.6\n")
    assert {tuple(r) for r in tables.gene_ani(spark, g).collect()} == {("b", "a", 0.98, 0.6), ("a", "b", 0.97, 0.6)}
    n = _write(tmp_path / "n", "#Q_id\tS_id\tal_len\tqry_len\ttrg_len\tp_inden\nx\ty\t80\t100\t200\t90\nx\tz\t50\t100\t100\t99\n")
    hits = tables.gene_hit_table(spark, n).selectExpr("1 AS query", "2 AS reference", "*")
    assert [tuple(r) for r in tables.gene_hits(hits).collect()] == [(1, 2, 90.0, 0.8)]
    s = _write(tmp_path / "s", "/r /q\nNUCMER\n\n[P1]\t[SUB]\n5\tA\tC\t7\t1\t1\t9\t9\t1\t1\tr1\tq1\n")
    assert [tuple(r)[1:] for r in tables.snps(spark, s).collect()] == [(5, "A", "C", 7, "r1", "q1")]
    q = _write(tmp_path / "q", "genome\tcompleteness\tcontamination\n/p/a.fa\t90\t1\n")
    assert [tuple(r) for r in tables.quality_table(spark, q).collect()] == [("a.fa", 90.0, 1.0)]
    with pytest.raises(KeyError):
        tables.quality_table(spark, _write(tmp_path / "q2", "genome,completeness\na,1\n"))
    w = _write(tmp_path / "w", "a.fa\t2.5\nzz\t1\na.fb\tx\n")
    items = spark.createDataFrame([("a.fa",), ("a.fb",)], "genome string")
    assert [tuple(r) for r in tables.extra_weights(spark, w, items, "genome").collect()] == [("a.fa", 2.5)]
    rep = tables.taxon_report(spark, _write(tmp_path / "rep", "name\ttaxID\ttaxRank\tgenomeSize\tnumReads\nE\t7\tspecies\t1\t3\n"))
    h = tables.taxon_hits(spark, _write(tmp_path / "h", "readID\ttaxID\tscore\nsc_1_4\t7\t300\n"), rep)
    assert [tuple(r) for r in h.collect()] == [("sc_1_4", "sc_1", 7, 300.0, "E", "species")]


def test_scaffold_chain(spark):
    s = spark.createDataFrame([("1:a", "1", 0), ("2:b", "2", 1), ("3:c", "3", 2), ("3:a", "3", 2), ("4:d", "4", 3)], "scaffold string, file string, priority int")
    p = spark.createDataFrame([("2:b", "1:a", 0.9, 1.0), ("3:c", "2:b", 0.9, 1.0), ("4:d", "3:c", 0.5, 0.95), ("3:a", "1:a", 0.9, 0.99), ("1:a", "2:b", 1.0, 1.0), ("4:d", "1:a", 0.4, 1.0)], "new string, old string, coverage double, ani double")
    done = scaffolds.dereplicate(s, p)
    assert {r["scaffold"] for r in done.where("removed").collect()} == {"2:b", "4:d", "3:a"}
    assert {r["scaffold"] for r in scaffolds.dereplicate(s, p, ignore_same=True).where("removed").collect()} == {"2:b", "4:d"}
    assert {tuple(r) for r in scaffolds.report(done).collect()} == {("1", 0, 1), ("2", 1, 1), ("3", 1, 2), ("4", 1, 1)}
    assert scaffolds.dereplicate(s, p.where("ani > 2")).where("removed").count() == 0


def test_snp_rows_and_splits(spark):
    s = spark.createDataFrame([(1, "r", 5, "q"), (2, "r", 5, "q"), (1, "r", 6, "q")], "rl long, r_scaff string, ql long, q_scaff string")
    assert [(r["rl"], r["ql"]) for r in scaffolds.snp_rows(s).collect()] == [(1, 5)]
    a = spark.createDataFrame([("s", 100, 2500), ("t", 0, 5)], "key string, start long, end long")
    x = spark.createDataFrame([("s", 100), ("s", 1099), ("s", 2499), ("s", 2500), ("t", 3)], "key string, x long")
    got = scaffolds.split_ani(ranges.splits(x, a, 1000)).orderBy("key", "split")
    assert [(r["key"], r["split"], r["split_start"], r["split_end"], r["n"], r["length"], round(r["ani"], 9)) for r in got.collect()] == [("s", 0, 100, 1100, 2, 1000, 0.998), ("s", 2, 2100, 2500, 1, 400, 0.9975), ("t", 0, 0, 5, 1, 5, 0.8)]
    assert ranges.require_one_range(x.where("x <> 2500"), a, 1000).count() == 4
    with pytest.raises(ValueError):
        ranges.require_one_range(x, a, 1000)
    with pytest.raises(ValueError):
        ranges.require_one_range(x.where("x < 2500"), a.union(spark.createDataFrame([("s", 90, 101)], a.schema)), 1000)


def test_taxonomy(spark):
    h = spark.createDataFrame([(1, "P", "a", 300.0), (1, "P", "b", 300.0), (1, "P", None, 300.0), (1, "Q", "c", 9.0)], "item long, phylum string, species string, score double")
    t = taxonomy.by_share(h, ["phylum", "species"], 50)
    assert {(r["rank"], r["name"], round(r["confidence"], 3), r["best"]) for r in t.collect()} == {("phylum", "P", 100.0, True), ("species", "a", 33.333, False)}
    items = spark.createDataFrame([(1,)], "item long")
    assert taxonomy.attach(items, t, "item").first()["taxonomy"] == "P"
    with pytest.raises(ValueError):
        taxonomy.attach(items.union(items.selectExpr("item + 1")), t, "item")


def test_warnings_and_scaling(spark):
    h = spark.createDataFrame([(1, 0.051), (1, 0.049), (1, 0.2)], "block long, height double")
    assert sorted(r["message"].split(": ")[1].split(" (")[0] for r in warn.edges(h, 0.05).collect()) == ["almost not split", "almost split"]
    p = spark.createDataFrame([(1, 1, 1.0, 1.0), (2, 1, 0.99, 0.9), (1, 2, 0.985, 0.9), (3, 1, 0.999, 0.1)], "query long, reference long, ani double, coverage double")
    items = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    assert [tuple(r) for r in warn.alike(p, items, coverage=0.25).collect()] == [(2, 1, 0.99)]
    assert warn.self_distance(p.selectExpr("7 AS block", "*")).first()["dist"] == 1e-4
    at = np.array([[0.0, 0], [3, 0], [0, 4]])
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    x = linkage.scaled(d)
    assert np.allclose(np.linalg.norm(x[:, None] - x[None], axis=2), d)


def test_workflow(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    near = words.copy()
    near[200] = "other"
    far = [f"v{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "short"), (5, " ".join(reversed(far))), (6, None)]
    items = spark.createDataFrame(rows, "item long, text string")
    quality = spark.createDataFrame([(1, 80.0, 0.0), (2, 99.0, 0.0), (3, 90.0, 0.0), (4, 90.0, 0.0), (5, 10.0, 0.0)], "item long, completeness double, contamination double")
    work = Workspace(spark, f"file://{tmp_path}/w")
    assert work.get("clusters") is None
    best = workflow.dereplicate(work, items, quality, workflow.Params(length=100, warn=True))
    assert {(r["item"], r["secondary_cluster"]) for r in best.collect()} == {(2, "1_1"), (3, "3_0")}
    assert {r["item"]: r["primary_cluster"] for r in work.get("clusters").collect()} == {1: 1, 2: 1, 3: 3}
    assert work.arguments()["length"] == 100
    with pytest.raises(IndexError):
        workflow.dereplicate(Workspace(spark, f"file://{tmp_path}/w2"), items, quality.where("item > 1"), workflow.Params(length=100))
    items.write.parquet(f"{tmp_path}/items")
    main(["dereplicate", f"file://{tmp_path}/cli", "-g", f"{tmp_path}/items", "--item", "item", "-l", "100", "--ignoreQuality"])
    assert {r["item"] for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/cli/csv/winners").collect()} == {2, 3, 5}
    with pytest.raises(ValueError):
        workflow.Params(skip_primary=True, skip_secondary=True)
    assert parser().parse_args(["compare", "w", "-g", "x"]).primary == 0.9


def _text(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, 10**6, n)]


def _edited(words, *at):
    return " ".join("other" if i in at else w for i, w in enumerate(words))


def test_tables_are_used_again_only_for_the_same_items_and_settings(spark, tmp_path):
    a, b = _text(400, 1), _text(400, 2)
    rows = [(1, " ".join(a)), (2, _edited(a, 200)), (3, " ".join(b)), (4, _edited(b, *range(0, 400, 40)))]
    items = spark.createDataFrame(rows, "item long, text string")
    names = lambda t: {r["item"]: r["secondary_cluster"] for r in t.collect()}
    work = Workspace(spark, f"file://{tmp_path}/w")
    p = workflow.Params(primary=0.99, method="single")
    assert names(workflow.compare(work, items, p)) == {1: "1_1", 2: "1_1", 3: "3_0", 4: "4_0"}
    mark = work.mark("pairs")
    workflow.compare(work, items, p)
    assert work.mark("pairs") == mark
    loose = workflow.Params(primary=0.8, secondary=0.9, method="single")
    fresh = names(workflow.compare(Workspace(spark, f"file://{tmp_path}/w2"), items, loose))
    assert names(workflow.compare(work, items, loose)) == fresh and fresh[3] == fresh[4] == "3_1"
    more = items.union(spark.createDataFrame([(5, " ".join(a))], items.schema))
    assert names(workflow.compare(work, more, loose))[5] == "1_1"


@pytest.mark.parametrize("kind", ["average", "greedy", "multiround", "low_ram", "centroid", "tertiary"])
def test_flows(spark, tmp_path, kind):
    a, b = _text(600, 3), _text(500, 4)
    rows = [(1, " ".join(a)), (2, _edited(a, 100)), (3, _edited(a, 100, 400)), (7, " ".join(b)), (8, _edited(b, 50)), (9, " ".join(_text(300, 5)))]
    items = spark.createDataFrame(rows, "item long, text string")
    p = workflow.Params(length=100, ignore_quality=True, method=kind if kind in ("average", "centroid") else "average", low_ram=kind == "low_ram", greedy=kind == "greedy", multiround=kind == "multiround", chunk=2, tertiary=kind == "tertiary", warn=True)
    work = Workspace(spark, f"file://{tmp_path}/w")
    best = workflow.dereplicate(work, items, p=p)
    got = {}
    for r in work.get("clusters").collect():
        got.setdefault(r["secondary_cluster"], set()).add(r["item"])
    assert set(map(frozenset, got.values())) == {frozenset({1, 2, 3}), frozenset({7, 8}), frozenset({9})}
    assert {r["item"] for r in best.collect()} >= {9} and best.count() == 3
    assert ("9_1" if kind == "greedy" else "9_0") in got
    assert {(r["item"], r["members"]) for r in work.get("report").collect()} == {(r["item"], len(got[r["secondary_cluster"]])) for r in best.collect()}
    if kind == "average":
        again = workflow.adjust_cluster(work, 1, "single", 0.9999)
        assert again.count() == 5
        assert workflow.compare_winners(work, workflow.of_texts(items)).count() >= 1


def test_genomes(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("ACGT"), 60_000))
    near = list(base)
    for i in rng.choice(60_000, 300, replace=False):
        near[i] = "ACGT"["ACGT".index(near[i]) - 1]
    flip = base[::-1].translate(str.maketrans("ACGT", "TGCA")).lower()
    far = "".join(rng.choice(list("ACGT"), 60_000))
    paths = []
    for name, s in (("a.fa", base), ("b.fa", "".join(near)), ("c.fna", flip), ("d.fa", far)):
        lines = [s[i : i + 80] for i in range(0, 30_000, 80)], [s[i : i + 80] for i in range(30_000, 60_000, 80)]
        paths.append(_write(tmp_path / name, "".join(f">{name}_{k} x\n" + "\n".join(part) + "\n" for k, part in enumerate(lines))))
    listed = _write(tmp_path / "all.txt", "\n".join(paths) + "\n")
    assert is_fasta(spark, listed) and is_fasta(spark, paths[0])
    c = of_fasta(spark, [listed])
    assert {(r["name"], r["length"], r["n50"]) for r in c.items.collect()} == {(n, 60_000, 30_000) for n in ("a.fa", "b.fa", "c.fna", "d.fa")}
    name = {r["item"]: r["name"] for r in c.items.collect()}
    pairs_ = {frozenset((name[r["item1"]], name[r["item2"]])): r["dist"] for r in sketch.sketch_pairs(c.sketches(21, 1000), "item", 1000, 21).collect()}
    assert pairs_[frozenset(("a.fa", "c.fna"))] < 1e-3  # the other strand, but for the cut between its records
    assert abs(pairs_[frozenset(("a.fa", "b.fa"))] - 0.005) < 0.002
    assert frozenset(("a.fa", "d.fa")) not in pairs_
    main(["dereplicate", f"file://{tmp_path}/w", "-g", *paths, "--ignoreQuality", "-sa", "0.99"])
    work = Workspace(spark, f"file://{tmp_path}/w")
    got = {}
    for r in work.get("clusters").collect():
        got.setdefault(r["secondary_cluster"], set()).add(name[r["item"]])
    assert sorted(map(sorted, got.values())) == [["a.fa", "b.fa", "c.fna"], ["d.fa"]]


def test_golden_pairs_of_delta_files(spark, tmp_path):
    golden = [("T2", "TX", 2711407, 31034, 0.9885542819650462, 0.8589975916195203), ("T2", "YI6", 2960585, 990, 0.9996656066284197, 0.976984999643603), ("YI6", "TX", 2635575, 28993, 0.9889993644650598, 0.8697325834035128)]
    for q, r, n, e, *_ in golden:
        _write(tmp_path / f"{q}_vs_{r}.delta.filtered", f"/a/x /b/y\nNUCMER\n>r1 q1 9 9\n1 {n - 99} 1 {n - 99} {e - 1} 0 0\n12\n-3\n0\n200 300 5 105 1 0 0\n0\n")
    _write(tmp_path / "T2_vs_none.delta.filtered", "/a/x /b/y\nNUCMER\n")
    lengths = spark.createDataFrame([("T2", 3263835), ("TX", 3156478), ("YI6", 3030328), ("none", 10)], "item string, length long")
    got = {(r["query"], r["reference"]): r for r in tables.delta_pairs(spark, f"file://{tmp_path}/*.delta.filtered", lengths).collect()}
    for q, r, n, e, ani, cov in golden:
        x = got[q, r]
        assert x["similarity_errors"] == e and x["alignment_length"] == n
        assert abs(x["ani"] - ani) < 1e-9 and abs(x["coverage"] - cov) < 1e-9
    assert got["T2", "none"]["ani"] == 0 and got["T2", "none"]["coverage"] == 0
    assert abs(pairs.aligned(spark.createDataFrame([("T2", "TX", 2711407, 31034)], "query string, reference string, alignment_length long, similarity_errors long"), lengths, "total").first()["coverage"] - 2 * 2711407 / (3263835 + 3156478)) < 1e-12


def test_files_by_bin_chunks_and_programs(spark, tmp_path):
    p = _write(tmp_path / "g.fa", ">s1 a\nAC\nGT\n>s2\nAAAA\n>s3\nCCCCCCCCC\n>s4\nGG\n")
    found = fasta.records(spark, p)
    bins = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("s3", "x")], "scaffold string, bin string")
    assert fasta.write_bin_files(found, bins, f"file://{tmp_path}/bins") == 2
    assert (tmp_path / "bins" / "x.fa").read_text() == ">s1 a\nACGT\n>s3\nCCCCCCCCC\n"
    assert {(r["id"], r["chunk"]) for r in fasta.chunks(found, 8).collect()} == {("s1", 0), ("s2", 0), ("s3", 1), ("s4", 2)}
    assert {tuple(r) for r in fasta.gene_genomes(spark, p).collect()} == {(f"s{i}", "g.fa") for i in (1, 2, 3, 4)}
    assert {(r["program"], r["works"]) for r in programs.report(spark, {"true": [], "no-such-program": []}).collect()} == {("true", True), ("no-such-program", False)}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    got = programs.run_each(rows, lambda r: ["echo", r["v"]] if r["k"] == 1 else ["no-such-program"]).collect()
    assert {(r["k"], r["code"], r["out"]) for r in got} == {(1, 0, "a\n"), (2, -1, "")}


def test_quality_tables(spark):
    q = spark.createDataFrame([("/a/x.fa", 0.5, 0.0), ("y.fa", 1.0, 0.0)], "genome string, completeness double, contamination double")
    assert [r[0] for r in filters.base_names(q, "genome").collect()] == ["x.fa", "y.fa"]
    assert [r["column"] for r in filters.suspicious(q).collect()] == ["completeness"]
    info = spark.createDataFrame([("y.fa", 7, 3)], "genome string, length long, n50 long")
    assert {tuple(r) for r in filters.with_sizes(q, info, "genome").select("genome", "length", "n50").collect()} == {("/a/x.fa", None, None), ("y.fa", 7, 3)}
    assert filters.with_sizes(info, info, "genome", fill=True) is info
    s = spark.createDataFrame([(1, 90.0, 10.0, 100, 50.0), (2, 90.0, 10.0, 100, None)], "item long, completeness double, contamination double, n50 long, strain_heterogeneity double").selectExpr("*", "1000L AS length")
    w = score.Weights(1, 1, 1, 0, 0, 0)
    assert {r["score"] for r in score.scored(s, w).collect()} == {80.0}  # one value is missing, so it counts for none
    assert score.scored(s.where("item = 1"), w).first()["score"] == 85.0


def test_near_pairs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sketch, "HOT", 3)
    rng = np.random.default_rng(7)
    hot = [f"{h:015x}" for h in range(1, 400, 9)]
    rows = []
    for i in range(60):
        own = [f"{int(h):015x}" for h in rng.integers(0, 1 << 59, 40)]
        if i % 3:
            own = rows[-1][1][: int(rng.integers(20, 40))] + own[:5]
        rows.append((i, sorted({*own, *(hot[: int(rng.integers(0, len(hot)))] if i % 2 else [])})[:48]))
    s = spark.createDataFrame(rows, "item long, hs array<string>")
    every = {(r["item1"], r["item2"], r["shared"], r["size"]) for r in sketch.sketch_pairs(s, "item", 48, 5).where("round(dist, 12) <= 0.1").collect()}
    near = {(r["item1"], r["item2"], r["shared"], r["size"]) for r in sketch.near_pairs(s, "item", 48, 5, 0.1).collect()}
    assert near == every and len(every) > 10
