"""Functions, operators, sources, tables and streams of the core library."""

import math

import pytest
from pyspark.sql import functions as F

from spanforge.functions import counts as C
from spanforge.functions import text as X
from spanforge.operators import flow, joins, program, scan, stats, tracks
from spanforge.operators.flow import Flow
from spanforge.operators.table import Catalog, View
from spanforge.sources import locations
from spanforge.sources import text as files
from spanforge.streaming import counts as streaming

PARTS = "array<struct<s:bigint,e:bigint>>"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vector(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_count_modes(spark):
    got = [value(spark, C.count(m, F.lit(6), F.lit(3), F.lit(0.5))) for m in ("All", "Weight", "Divide", "Unique", "CollapseAll", "CollapseUnique", "No")]
    assert got == [6, 3, 2, 0, 1, 0, 0]


def test_vectors(spark):
    v = vector(8, 2, 0)
    assert value(spark, C.downsample("Logsc", v)) == [3, 0.75, 0] and value(spark, C.downsample("Max", v)) == [1, 0.25, 0]
    assert value(spark, C.downsample("Digital", v)) == [1, 1, 0] and value(spark, C.downsample("Min", v)) == [4, 1, 0]
    assert value(spark, C.cumulative(v)) == [8, 10, 10] and value(spark, C.decumulate(vector(8, 10, 10))) == [8, 2, 0]
    assert value(spark, C.quantile(vector(4, 1, 3, 2), 0.5)) == 2.5 and value(spark, C.trimmed_mean(vector(0, 1, 2, 100), 0.25)) == 1.5
    names = {n: value(spark, f(vector(1, 2, 4))) for n, f in C.VECTOR.items()}
    assert names["Median"] == 2 and names["Product"] == 8 and math.isclose(names["GeometricMean"], 2) and names["Mad"] == 1 and math.isclose(names["Variance"], 7 / 3)
    assert [value(spark, C.bin_fixed(F.lit(x), 0.0, 1.0, 100)) for x in (-5.0, 0.5, 7.0, -0.001)] == [-1, 50, 100, 0]
    assert [value(spark, C.bin_boundaries(F.lit(x), [1, 5])) for x in (0.0, 1.0, 9.0)] == [-1, 0, 1]


def test_text(spark):
    s = lambda x: F.lit(x)
    assert value(spark, X.translate_codons(s("ATGAAATG"))) == "MK" and value(spark, X.translate_codons(s("ATGNNNTA"))) == "MX" and value(spark, X.translate_codons(s(""))) == ""
    assert value(spark, X.reverse_complement(s("AACG"))) == "CGTT" and value(spark, X.gc_content(s("GGCA"))) == 0.75
    assert value(spark, X.kmer_entropy(s("ACGT"), 1)) == 2 and math.isclose(value(spark, X.kmer_entropy(s("AACC"), 2)), 1.584962500721156)
    assert value(spark, X.hamming(s("ACGT"), s("AGGA"))) == 2 and value(spark, X.hamming(s("AC"), s("ACG"))) == 3
    assert value(spark, X.common_prefix(s("abcx"), s("abd"))) == 2 and value(spark, X.is_orf(s("ATGAAATGA"))) and not value(spark, X.is_orf(s("ATGTGATGA")))
    assert value(spark, X.leading_number(s("-12ab"))) == -12 and value(spark, X.trailing_number(s("ab12"))) == 12 and value(spark, X.leading_number(s("x"))) is None
    assert value(spark, X.is_numeric(s("1.5e3"))) and not value(spark, X.is_int(s("1.5"))) and X.iupac_pattern("ANR") == "A[ACGT][AG]"
    assert value(spark, X.camel_case(s("two_words here"))) == "TwoWordsHere" and value(spark, X.poly_a_tail(s("CGAAA"))) == 3


def test_scan_equals_window(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 500).alias("pos"), (F.col("id") % 11 - 5).alias("v"))
    got = {(r.k, r.pos): (r.s, r.m, r.n) for r in scan.next_row(scan.running(scan.running(df, ["k"], "pos", [], F.col("v"), "s", bucket=16), ["k"], "pos", [], F.col("v"), "m", "max", False, 16), ["k"], "pos", "v", "n", 16).collect()}
    for k in (0, 1):
        total, top = 0, None
        rows = sorted((r.pos, r.v) for r in df.where(f"k = {k}").collect())
        for i, (p, v) in enumerate(rows):
            total += v
            assert got[k, p] == (total, top, rows[i + 1][1] if i + 1 < len(rows) else None)
            top = v if top is None else max(top, v)


def test_clusters_with_ties(spark):
    rows = [("1", "+", s, s + 5) for s in (0, 0, 0, 3, 8, 8, 20, 25, 25)] * 3
    df = spark.createDataFrame(rows, "ref string, strand string, s long, e long").repartition(5)
    assert sorted((r.s, r.e, r.n) for r in tracks.clusters(df).collect()) == [(0, 8, 12), (8, 13, 6), (20, 25, 3), (25, 30, 6)]
    assert sorted((r.s, r.e, r.n) for r in tracks.clusters(df, touching=True).collect()) == [(0, 13, 18), (20, 30, 9)]
    assert sorted((r.s, r.e) for r in tracks.clusters(df, tolerance=8).collect()) == [(0, 30)]


def region_frame(spark, rows):
    return spark.createDataFrame(rows, f"id long, ref string, strand string, parts {PARTS}")


@pytest.mark.parametrize("width", [4, 1024])
def test_overlap_joins(spark, width):
    a = region_frame(spark, [(1, "1", "+", [(0, 10), (20, 30)]), (2, "1", "-", [(5, 8)]), (3, "2", "+", [(0, 4)]), (4, "1", "+", []), (1, "1", "+", [(0, 10), (20, 30)])])
    b = region_frame(spark, [(10, "1", "+", [(12, 18)]), (11, "1", "+", [(9, 21)]), (12, "1", "-", [(0, 100)]), (13, "1", "+", [(2, 4)])])
    pairs = lambda **k: sorted((r.l.id, r.r.id) for r in joins.overlap(a, b, width=width, **k).collect())
    assert pairs() == [(1, 11), (1, 11), (1, 13), (1, 13), (2, 12)]
    assert pairs(mode="bounds") == [(1, 10)] * 2 + [(1, 11)] * 2 + [(1, 13)] * 2 + [(2, 12)]
    assert pairs(mode="contained") == [(2, 12)] and pairs(mode="containing") == [(1, 13)] * 2
    assert pairs(strand="antisense") == [(1, 12), (1, 12)]
    assert pairs(strand="unspecific") == [(1, 11), (1, 11), (1, 12), (1, 12), (1, 13), (1, 13), (2, 12)]
    assert sorted(r.id for r in joins.overlap(a, b, "semi", width=width).collect()) == [1, 1, 2]
    assert sorted(r.id for r in joins.overlap(a, b, "anti", width=width).collect()) == [3, 4]
    assert sorted((r.id, r.n) for r in joins.overlap(a, b, "count", width=width).collect()) == [(1, 2), (1, 2), (2, 1), (3, 0), (4, 0)]
    left = sorted((r.l.id, r.r.id if r.r else -1) for r in joins.overlap(a, b, "left", width=width).collect())
    assert left == [(1, 11), (1, 11), (1, 13), (1, 13), (2, 12), (3, -1), (4, -1)]


def test_nearest(spark):
    a = region_frame(spark, [(1, "1", "+", [(50, 60)])])
    b = region_frame(spark, [(10, "1", "+", [(30, 40)]), (11, "1", "+", [(35, 40)]), (12, "1", "+", [(65, 70)]), (13, "1", "+", [(0, 5)])])
    near = lambda side, d: sorted((r.r.id, r.distance) for r in joins.nearest(a, b, side, d, "id").collect())
    assert near("left", 20) == [(10, 10), (11, 10)] and near("right", 20) == [(12, 5)] and near("any", 20) == [(12, 5)] and near("left", 5) == []


def test_lookup_and_zip(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="not unique"):
        joins.unique_lookup(df, ["k"]).collect()
    with pytest.raises(Exception, match="differ in length"):
        flow.positional_zip(["k"], spark.range(3).toDF("k"), spark.range(2).toDF("k")).collect()
    assert [r.i for r in tracks.numbered(spark.range(100).toDF("k"), [F.desc("k")], None, "i").orderBy(F.desc("k")).collect()] == list(range(100))


def test_flow(spark):
    f = Flow(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (2, 1, "c")], "k long, t long, v string"))
    assert sorted((r.k, r.t) for r in f.unique_adjacent(["k"], ["t"], "v").df.collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    assert sorted(r.run for r in f.multiplex_runs(["k"], ["t"], "v").df.collect()) == [1, 1, 1, 2, 3]
    assert sorted((r.t, tuple(r.previous)) for r in f.filter("k = 1").previous(2, ["k"], ["t"], "t").df.collect()) == [(1, ()), (2, (1,)), (3, (2, 1)), (4, (3, 2))]
    with pytest.raises(Exception, match="not in order"):
        f.check_order(["k"], [F.desc("t")], "t").df.collect()
    with pytest.raises(Exception, match="no v"):
        f.require(F.col("v").isNotNull(), "no v").df.collect()
    assert f.iff(False, lambda g: g.head(1)).df.count() == 5 and f.checkpoint().df.count() == 5 and f.remove_nulls("v").df.count() == 4


def test_program(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x"], 5), ("b", ["y"], 3), ("a", [], 1)], "g string, tags array<string>, n long")
    p = program.Program().gate("n > 0").add("g_set", F.array("g")).add("tag", F.col("tags"), "n > 1")
    got = {(r.g_set, r.tag): r.c for r in p.statistic(df, program.Statistic(["g_set", "tag"], {"c": F.col("n")})).collect()}
    assert got == {("a", "x,y"): 5, ("b", "y"): 3, ("a", ""): 1}
    got = {r.tag: r.c for r in p.statistic(df, program.Statistic(["tag"], {"c": F.col("n")}, unfold=["tag"])).collect()}
    assert got == {"x": 5, "y": 8}
    got = {r.g_set: r.c for r in p.statistic(df, program.Statistic(["g_set"], {"c": F.col("n")}, min_fraction=0.5)).collect()}
    assert got == {"a": 6, "other": 3}
    assert [value(spark, program.frame(F.lit(x))) for x in (-1, 4)] == [2, 1]


def test_view_and_catalog(spark, tmp_path):
    t = spark.range(25).withColumn("v", F.col("id") % 3)
    v = View(t, page_size=10).where("v = 0").order_by(F.desc("id"))
    assert [r.id for r in v.page(1, 3).iterate().collect()] == [21, 18] and v.size() == 9
    assert [r.id for r in v.where("id < 4", "OR").iterate().collect()] == [24, 21, 18, 15, 12, 9, 6, 3, 2, 1, 0]
    assert v.where("id = 1", "NEW").size() == 1 and v.page_checked(-5, 99).iterate().count() == 9
    assert [r.id for r in View(t, page_size=10).order_by("id").last().iterate().collect()] == [20, 21, 22, 23, 24]
    assert View(t, page_size=10).order_by("id").first().next().window == (10, 20) and View(t).page(10, 20).prev().window == (0, 10)
    assert sorted(r.id for r in v.page(0, 2).delete().collect()) == [i for i in range(25) if i not in (24, 21)]
    assert v.delete().count() == 16
    c = Catalog(spark, str(tmp_path / "cat"))
    assert not c.contains("t") and c.create_or_open("t", t).count() == 25
    assert c.delete("t", F.col("id") < 5) == 2 and c.open("t").count() == 20 and c.open("t", 1).count() == 25
    assert c.update("t", F.col("id") == 7, v=F.lit(9)) == 3 and c.open("t").where("v = 9").count() == 1
    c.insert("t", t.limit(2))
    assert c.open("t").count() == 22 and c.versions("t") == [1, 2, 3]
    c.drop("t")
    assert not c.contains("t")
    with pytest.raises(KeyError):
        c.open("t")


def test_stats(spark):
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.2)], "i long, p double")
    assert [round(r.q, 6) for r in stats.benjamini_hochberg(p, "p", ["i"]).orderBy("i").collect()] == [0.04, 0.053333, 0.053333, 0.2]
    s = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.7, True), (0.1, False)], "x double, y boolean")
    assert math.isclose(stats.roc_auc(s, "x", "y").first().auc, 5.5 / 6)
    f = stats.fisher_exact(spark.createDataFrame([(3, 1, 1, 3), (0, 0, 0, 0)], "a long, b long, c long, d long"), "a", "b", "c", "d").collect()
    assert math.isclose(f[0].p, 0.4857142857, abs_tol=1e-9) and f[1].p == 1
    assert math.isclose(stats.beta_cdf(2, 3, 0.4), 0.5248) and math.isclose(stats.beta_cdf(2, 3, stats.beta_quantile(2, 3, 0.3)), 0.3)
    ec = spark.createDataFrame([(["a"], 30), (["b"], 10), (["a", "b"], 40)], "members array<string>, n long")
    assert {r.m: round(r.pi, 2) for r in stats.em_proportions(ec).collect()} == {"a": 0.75, "b": 0.25}
    u = spark.createDataFrame([("k", "AAA")] * 9 + [("k", "AAT")] * 2 + [("k", "CCC")], "k string, u string")
    assert stats.collapse_umis(u, ["k"], "u").first().umis == 3 and stats.collapse_umis(u, ["k"], "u", correct=True).first().umis == 2


def test_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return files.load(spark, str(tmp_path / name))

    bed = put("a.bed", "track x\nchr1\t100\t400\tr1\t0\t+\t100\t400\t0\t2\t50,100\t0,200\nchrM\t1\t2\n").collect()
    assert [(r.ref, r.strand, [tuple(p) for p in r.parts]) for r in bed] == [("1", "+", [(100, 150), (300, 400)]), ("MT", "", [(1, 2)])]
    gtf = put("a.gtf", 'chr1\ts\texon\t101\t200\t.\t-\t.\tgene_id "g"; transcript_id "t";\nchr1\ts\texon\t301\t400\t.\t-\t.\tgene_id "g"; transcript_id "t";\nchr1\ts\tCDS\t151\t200\t.\t-\t.\tgene_id "g"; transcript_id "t";\n').collect()
    assert [(r.ref, r.strand, [tuple(p) for p in r.parts], r.coding_start, r.coding_end) for r in gtf] == [("1", "-", [(100, 200), (300, 400)], 150, 200)]
    gff = put("a.gff3", "##gff\n1\ts\tgene\t5\t9\t.\t+\t.\tID=g1;Name=x y\n").first()
    assert (gff.type, [tuple(p) for p in gff.parts], gff.attributes) == ("gene", [(4, 9)], {"ID": "g1", "Name": "x y"})
    peak = put("a.narrowPeak", "chr2\t5\t9\tp\t10\t.\t1.5\t2\t3\t1\n").first()
    assert (peak.ref, peak.signal, peak.summit, [tuple(p) for p in peak.parts]) == ("2", 1.5, 1, [(5, 9)])
    loc = put("a.locations", "1+:100-200|300-400\tnote\nX:5\n").collect()
    assert [(r.ref, r.strand, [tuple(p) for p in r.parts], r.rest) for r in loc] == [("1", "+", [(100, 200), (300, 400)], "note"), ("X", "", [(5, 6)], None)]
    csv = put("a.csv", "# c\na;b;c\n1;2.5;x\n2;3;y z\n")
    assert csv.dtypes == [("a", "int"), ("b", "double"), ("c", "string")] and [tuple(r) for r in csv.collect()] == [(1, 2.5, "x"), (2, 3.0, "y z")]
    assert files.sniff(["1,2", "3,4"]) == (",", False, ["int", "int"]) and files.sniff(['"a,b"\t1']) == ("\t", False, ["string", "int"])
    fasta = put("a.fa", ">one first\nACG\nT\n>two\nGG\n").collect()
    assert [(r.name, r.sequence) for r in fasta] == [("one", "ACGT"), ("two", "GG")]
    assert [(r.chunk, r.bases) for r in files.sequence_chunks(files.load(spark, str(tmp_path / "a.fa")).where("name = 'one'"), 3).collect()] == [(0, "ACG"), (1, "T")]
    fastq = put("a.fastq", "@r1\nAC\n+\nII\n@r2\nGT\n+\n@I\n").orderBy("name").collect()
    assert [(r.name, r.sequence, r.quality) for r in fastq] == [("r1", "AC", "II"), ("r2", "GT", "@I")]
    gb = put("a.gb", "LOCUS x\nACCESSION   NC_1\nFEATURES             Location/Qualifiers\n     gene            complement(join(5..9,\n                     20..30))\n                     /gene=\"x\"\n     CDS             7\nORIGIN\n1 acgt\n//\n").collect()
    assert [(r.accession, r.type, r.strand, [tuple(p) for p in r.parts]) for r in gb] == [("NC_1", "gene", "-", [(4, 9), (19, 30)]), ("NC_1", "CDS", "+", [(6, 7)])]
    with pytest.raises(ValueError, match="no reader"):
        files.load(spark, "x.unknown")


def test_sinks(spark, tmp_path):
    df = region_frame(spark, [(1, "1", "+", [(100, 150), (300, 400)]), (2, "2", "-", [(5, 6)])])
    files.write_bed(df, str(tmp_path / "o.bed"), name=F.col("id"))
    back = files.read_bed(spark, str(tmp_path / "o.bed")).orderBy("ref").collect()
    assert [(r.name, r.strand, [tuple(p) for p in r.parts]) for r in back] == [("1", "+", [(100, 150), (300, 400)]), ("2", "-", [(5, 6)])]
    files.write_gtf(df.select("*", F.lit("g").alias("gene_id"), F.col("id").cast("string").alias("transcript_id")), str(tmp_path / "o.gtf"))
    assert [[tuple(p) for p in r.parts] for r in files.read_gtf(spark, str(tmp_path / "o.gtf")).orderBy("ref").collect()] == [[(100, 150), (300, 400)], [(5, 6)]]
    files.write_locations(df, str(tmp_path / "o.locations"))
    assert files.read_locations(spark, str(tmp_path / "o.locations")).count() == 2
    files.write_regions(df, str(tmp_path / "regions"))
    assert [r.id for r in files.scan_regions(spark, str(tmp_path / "regions"), "1+:140-310").collect()] == [1] and files.scan_regions(spark, str(tmp_path / "regions"), "1+:160-170").count() == 0
    files.write_bedgraph(tracks.coverage(df, F.lit(1)), str(tmp_path / "o.bg"))
    assert spark.read.text(str(tmp_path / "o.bg")).count() == 3
    assert locations.parse_location("chr1+:1,000-2000|3000") == ("1", "+", [(1000, 2000), (3000, 3001)]) and locations.parse_location("X")[2][0][0] == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.sql("SELECT timestamp_seconds(1700000000 + id * 400) ts, concat('t', id % 3) event_type, id % 5 user_id FROM range(200)")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = streaming.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.event_type): r.n for r in spark.table("counts").collect()}
    assert got == {(r.window.start, r.event_type): r.n for r in streaming.windowed_counts(events).collect()}
    q = streaming.running_statistic(stream, ["event_type"], "user_id").writeStream.outputMode("complete").format("memory").queryName("stat").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_type: r.n for r in spark.table("stat").collect()} == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert streaming.session_clusters(events, ["user_id"], "40 minutes").count() == 5
