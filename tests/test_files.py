"""Readers, writers, the stream, the pipelines over files, and the registration of queries."""

import gzip
import random
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry
from intervane import __main__ as command
from intervane.errors import ArgumentError, MissingData, NoData
from intervane.operators.packages import work_chunks
from intervane.session import _shared_folder, cut_lineage, written
from intervane.sources import interval_files as files
from intervane.sources import interval_sinks as sinks
from intervane.streaming.fragments import LINES, reject_rates, stream_lines, stream_parsed


def test_fragment_files(spark, tmp_path):
    (tmp_path / "s1.bed").write_text("#head\nchr1\t1\t9\tAA\nchr2\t5\t7\tBB\n#mid\nchr1\t9\t4\tCC\n")
    with gzip.open(tmp_path / "s2.bed.gz", "wt") as f:
        f.write("chr1\t2\t3\tDD\n")
    paths = [str(tmp_path / "s1.bed"), str(tmp_path / "s2.bed.gz")]
    got = sorted(tuple(r) for r in files.read_fragments(spark, paths).collect())
    assert got == [("s1", "chr1", 1, 9, "AA", 8), ("s1", "chr1", 9, 4, "CC", -5), ("s1", "chr2", 5, 7, "BB", 2), ("s2", "chr1", 2, 3, "DD", 1)]
    assert {r["sample"] for r in files.read_fragments(spark, paths, barcode=r"s(2)\.bed").collect()} == {"2"}
    assert files.read_lines(spark, paths).count() == 6
    region = files.region_scan(files.read_fragments(spark, paths), "chr1", 3, 100).collect()
    assert sorted(r["length"] for r in region) == [1, 5, 8]


def test_small_tables(spark, tmp_path):
    (tmp_path / "three.bed").write_text("chr1\t1\t9\nchr1\t1\t9\n")
    assert files.read_fragments(spark, str(tmp_path / "three.bed"), 3).select("name").distinct().count() == 2
    (tmp_path / "sizes").write_text("chr2  200\n\nchr1\t100\nchr9 5\n")
    used = spark.createDataFrame([("chr1",), ("chr2",)], "seqname STRING")
    assert [tuple(r) for r in files.read_chrom_sizes(spark, str(tmp_path / "sizes"), used).collect()] == [("chr1", 100), ("chr2", 200)]
    (tmp_path / "x.bedgraph").write_text("track type=bedGraph\nchr1\t0\t10\t1.5\n")
    assert [tuple(r) for r in files.read_bedgraph(spark, str(tmp_path / "x.bedgraph")).collect()] == [("chr1", 0, 10, 1.5)]
    (tmp_path / "black.bed").write_text("chr1\t0\t10\tlow\n")
    assert files.read_blacklist(spark, str(tmp_path / "black.bed")).count() == 1
    assert files.read_intervals(spark, str(tmp_path / "black.bed"), named=False).columns == ["seqname", "start_", "end_"]
    (tmp_path / "genes.gtf").write_text('#x\n1\ts\tgene\t5\t9\t.\t-\t.\tgene_id "G1"; gene_name "abc";\n')
    row = files.read_annotation(spark, str(tmp_path / "genes.gtf")).first()
    assert (row["seqname"], row["gene_name"], row["transcript_id"], row["stranded_start"], row["stranded_end"]) == ("chr1", "abc", None, 9, 5)


def test_sinks(spark, tmp_path):
    called = spark.createDataFrame([("c1", "chr1", 1, 9, 2.0, 5, 8, "n", 16.0), ("c2", "chr1", 3, 9, 2.0, 5, 6, "m", 12.0)], "track STRING, seqname STRING, start_ INT, end_ INT, mean DOUBLE, summit INT, length INT, name STRING, auc DOUBLE")
    sinks.write_peaks(called, called.select("seqname", "start_", "end_", "mean"), str(tmp_path / "p"))
    assert [tuple(r) for r in files.read_intervals(spark, f"{tmp_path}/p/c2_summits.bed").collect()] == [("chr1", 5, 6, "m")]
    cuts = spark.createDataFrame([(1, "chr1", 7, "AC")], "cut_id INT, seqname STRING, location INT, barcode STRING")
    likelihoods = spark.createDataFrame([(1, -1.0, -2.0, 0.7, 0.3)], "cut_id INT, log_c1 DOUBLE, log_c2 DOUBLE, marginal_c1 DOUBLE, marginal_c2 DOUBLE")
    sinks.write_events(likelihoods, cuts, str(tmp_path / "e"))
    assert spark.read.csv(f"{tmp_path}/e/events_c2.bed", sep="\t").first()[5] == "0.3"
    sinks.write_bedgraph(called, str(tmp_path / "g"), "mean")
    assert files.read_bedgraph(spark, str(tmp_path / "g")).count() == 2
    made = spark.createDataFrame([("chr1", 0, i, 0.3) for i in range(9)], "seqname STRING, interval INT, k INT, memory DOUBLE")
    n = sinks.write_packages(work_chunks(made, 1.0), str(tmp_path / "w"))
    assert n >= 3 and sinks.read_packages(spark, str(tmp_path / "w")).count() == 9
    with pytest.raises(NoData):
        sinks.read_packages(spark, str(tmp_path / "w"), workchunk=10**9)
    fit = spark.createDataFrame([("a", "c1", 0, 1.0)], "workchunk STRING, comp STRING, k INT, w DOUBLE")
    sinks.write_fit(fit, str(tmp_path / "f"), '{"iterations": 8}')
    assert sinks.read_fit(spark, str(tmp_path / "f"), fit).first()["settings"] == '{"iterations": 8}'
    with pytest.raises(MissingData):
        sinks.read_fit(spark, str(tmp_path / "f"), spark.createDataFrame([("b",)], "workchunk STRING"))


def test_stream(spark, tmp_path):
    rows = [(1, "a", 1, "chr1\t1\t5", "2024-01-01 00:00:00"), (2, "a", 2, "chr1\t1", "2024-01-01 01:00:00"), (2, "a", 2, "chr1\t1", "2024-01-01 02:00:00")]
    lines = spark.createDataFrame(rows, LINES.replace("TIMESTAMP", "STRING")).withColumn("received_at", __import__("pyspark.sql.functions", fromlist=["x"]).to_timestamp("received_at"))
    lines.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a", "s", 3)], "file_name STRING, sample STRING, n_columns INT")
    sizes = spark.createDataFrame([("chr1", 10)], "seqname STRING, size_ BIGINT")
    stream = stream_parsed(stream_lines(spark, str(tmp_path / "in")), known, sizes)
    query = stream.writeStream.format("memory").queryName("parsed_lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["line_id"], r["reason"]) for r in spark.table("parsed_lines").collect()) == [(1, None), (2, "column_count")]
    rates = reject_rates(lines.selectExpr("file_name", "received_at", "CASE WHEN line_id = 2 THEN 'x' END AS reason")).first()
    assert (rates["n_lines"], rates["n_failing"]) == (3, 2)


def test_written_tables(spark):
    for keep in (cut_lineage, written):
        assert keep(spark.range(5)).count() == 5


def test_registration(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p2_found", "p4_found"} <= set(queries)
    assert entry.entry(spark).count() > 0


def test_commands(spark, tmp_path):
    """The commands over files, from fragments to packages, peaks, likelihoods and tracks."""
    rng = random.Random(4)
    for sample, (place, length) in {"c1": (20_000, 70), "c2": (21_500, 210)}.items():
        lines = []
        for i in range(400):
            start = int(rng.gauss(place, 250))
            lines.append(f"chr1\t{start}\t{start + length + rng.randint(-9, 9)}\tB{i}\n")
        (tmp_path / f"{sample}.bed").write_text("".join(lines))
    (tmp_path / "chosen.bed").write_text("chr1\t19000\t20500\n")
    (tmp_path / "sizes").write_text("chr1 22000\n")
    at = lambda name: str(tmp_path / name)
    command.main(["prep", at("c1.bed"), at("c2.bed"), "--out", at("all"), "--interval-overlap", "500"])
    command.main(["prep", at("c1.bed"), at("c2.bed"), "--out", at("some"), "--interval-overlap", "500", "--region-padding", "0", "--selection-bed", at("chosen.bed"), "--bc-from-file", "(c1)[.]bed"])
    whole, part = (sinks.read_packages(spark, at(name)).agg({"ncuts": "sum"}).first()[0] for name in ("all", "some"))
    assert whole == 1600 and 0 < part <= 800
    command.main(["peaks", at("c1.bed"), at("c2.bed"), at("peaks"), "--c2-smooth", "0"])
    assert files.read_intervals(spark, at("peaks/c1_peaks.bed")).count() >= 1
    command.main(["events", at("c1.bed"), at("c2.bed"), at("peaks"), at("events")])
    scores = spark.read.csv(at("events/events_c1.bed"), sep="\t", schema="seqname STRING, at BIGINT, after BIGINT, barcode STRING, score DOUBLE, share DOUBLE").collect()
    assert len(scores) == 1600 and all(r["share"] is None or 0 <= r["share"] <= 1 for r in scores)
    command.main(["tracks", at("c1.bed"), at("c2.bed"), at("sizes"), at("tracks"), "--region", "chr1:20,000-21,000"])
    bins = files.read_bedgraph(spark, at("tracks/c1.bedgraph")).collect()
    assert bins and all(19_900 <= r["start_"] <= 21_000 and r["end_"] <= 22_000 for r in bins)


def test_intermediate_data_needs_a_shared_folder_on_a_cluster():
    kept = {}
    context = SimpleNamespace(getCheckpointDir=lambda: kept.get("at"), setCheckpointDir=lambda x: kept.update(at=x), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ArgumentError):
        _shared_folder(SimpleNamespace(sparkContext=context))
    context.getConf = lambda: {"spark.checkpoint.dir": "hdfs://shared"}
    assert _shared_folder(SimpleNamespace(sparkContext=context)) == "hdfs://shared"
