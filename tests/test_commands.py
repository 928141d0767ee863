import random

from pyspark.sql import functions as F

from strandloom import cli
from strandloom.operators import consensus, overlaps, sketch
from strandloom.sources import fastx
from strandloom.streaming import stream_sessions, stream_shimmers
from tests.test_assembly import P, dna, tiles


def test_commands_from_files_to_contigs(spark, tmp_path):
    rng = random.Random(7)
    genome = dna(rng, 12_000)
    rows = tiles(rng, genome, 3000, 300) + [(99, "short", "ACGT")]
    (tmp_path / "reads.fa").write_text("".join(f">{n}\n{s}\n" for _, n, s in rows))
    (tmp_path / "reads.lst").write_text(f"{tmp_path}/reads.fa\n")
    opts = ["-w", "24", "-k", "25", "-r", "3", "--least_file", "0"]
    run = lambda *args: cli.main([*map(str, args), *opts], spark)
    at = lambda name: str(tmp_path / name)
    run("build-sdb", at("reads.lst"), at("sdb"))
    reads = spark.read.parquet(at("sdb"))
    assert sorted((r["rid"], r["name"]) for r in reads.collect()) == [(k, n) for k, n, _ in rows[:-1]]
    run("build-idx", at("sdb"), at("idx"))
    assert spark.read.parquet(at("idx")).select("chunk").distinct().count() == 8
    run("ovlp", at("sdb"), at("idx"), at("ovlp"))
    run("ovlp-ec", at("sdb"), at("ovlp"), at("ec"))
    assert spark.read.parquet(at("ec")).count() > 20
    run("dp-graph", at("ovlp"), at("graph"))
    run("graph", at("ovlp"), at("graph1"))
    run("layout", at("graph"), at("sdb"), at("ctg"))
    best = max(spark.read.parquet(at("ctg")).collect(), key=lambda r: len(r["seq"]))
    assert len(best["seq"]) > 6000
    (tmp_path / "ids").write_text("5\n2\n")
    run("getreads", at("sdb"), at("ids"), at("two"))
    assert sorted(r["name"] for r in fastx.read_fasta(spark, at("two")).collect()) == ["r2", "r5"]
    run("asm", at("reads.lst"), at("asm"), "--fast", "--keep")
    rows = lambda name: sorted(tuple(r) for r in spark.read.parquet(at(name)).collect())
    assert rows("asm/graph/layout") == rows("graph/layout") and rows("asm/contigs") == rows("ctg")
    primary = spark.read.parquet(at("ctg")).where("tag = 'P'").collect()
    assert sorted((r["name"], r["seq"]) for r in fastx.read_fasta(spark, at("asm/contigs_m.fa")).collect()) == sorted((r["ctg"], r["seq"]) for r in primary)
    assert all(r["ctg"].startswith("ctg0") and r["ctg"].endswith("_P") for r in primary)
    relations = [r["value"].split(" ")[0] for r in spark.read.text(at("asm/resolved.rel")).collect()]
    assert relations.count("P") + relations.count("A") == spark.read.parquet(at("asm/resolved")).count()
    assert spark.read.text(at("graph/utg.gfa")).where("value like 'H%'").count() == 1
    fastx.delete(spark, at("asm/graph"))
    assert not (tmp_path / "asm/graph").exists()
    assert spark.read.parquet(at("asm/summary")).collect()[0]["longest"] > 6000
    assert spark.read.parquet(at("asm/resolved")).count() == spark.read.parquet(at("asm/contigs")).count()
    ovlp = spark.read.parquet(at("ovlp"))
    lines = [r["value"].split(" ") for r in spark.read.text(at("ovlp.ovlp")).collect()]
    assert [x[0] for x in lines[:2]] == ["R0", "O"] and sum(x[0] == "O" for x in lines) == ovlp.count()
    blocks, here = {}, []
    for x in lines:
        here.append(x)
        if x == ["-"]:
            blocks[int(here[0][1])], here = here, []
    assert not here and len(blocks) == spark.read.parquet(at("sdb")).count()
    for rid, block in blocks.items():
        kinds, found = [x[0] for x in block], [x for x in block if x[0] == "O"]
        assert kinds[0] == "R0" and set(kinds[1:-2]) <= {"O"} and all(int(x[1]) == rid for x in found)
        if found:
            assert block[-2][:2] == ["R1", str(rid)] and block[-2][2] == block[-2][3] and int(block[-2][4]) == len(found)
    assert sorted(parsed(overlaps.parse_overlaps(spark.read.text(at("ovlp.ovlp"))))) == sorted(parsed(ovlp))
    assert sorted((r["name"].split(" ")[0], r["seq"]) for r in fastx.read_fasta(spark, at("ec.fa")).collect()) == sorted((r["name"], r["seq"]) for r in spark.read.parquet(at("ec")).collect())
    graph_at = spark.read.parquet(at("graph/unitigs"))
    lines = [r["value"].split(" ") for r in fastx.unitig_lines(graph_at, graph_at).collect()]
    heads = [x for x in lines if x[0] == "UTG"]
    assert lines[0][0] == "UTG" and all(int(x[4]) == sum(y[0] == "N" and y[1] == x[1] for y in lines) and x[5] == "1" for x in heads)
    lines = [r["value"].split(" ") for r in spark.read.text(at("graph/layout.dat")).collect()]
    assert lines[0][0] in "PAD" and {len(x) for x in lines if x[0] == "E"} == {10}
    laid = spark.read.parquet(at("graph/layout"))
    assert sum(int(x[5]) for x in lines if x[0] in "PAD") == sum(x[0] == "E" for x in lines) == laid.count() - laid.select("component", "path").distinct().count()
    assert {"LN", "SB", "SE", "TG"} <= {t[:2] for r in spark.read.text(at("graph/utg.gfa")).where("value like 'S%'").collect() for t in r["value"].split("\t")}


def parsed(ovlp):
    return [(r["rid0"], r["rid1"], r["strand1"], r["d_left"], r["bgn0"], r["end1"], r["dist"]) for r in ovlp.collect()]


def test_contigs_are_polished(spark):
    rng = random.Random(8)
    true = dna(rng, 3000)
    draft = true[:1000] + ("A" if true[1000] != "A" else "C") + true[1001:]
    contigs = spark.createDataFrame([("c", draft), ("bare", dna(rng, 2000))], "ctg string, seq string")
    tiles_ = spark.createDataFrame([("c", k, true[k : k + 2600]) for k in range(0, 400, 80)], "ctg string, bgn int, seq string")
    out = consensus.polished_contigs(contigs, tiles_).collect()
    assert [r["ctg"] for r in out] == ["c"] and true[900:1100] in out[0]["seq"] and out[0]["seq"].upper()[5:2900] == true[5:2900]
    assert out[0]["seq"][:50].islower() and 0 < out[0]["low"] < 0.6


def test_offsets_and_masks():
    rng = random.Random(9)
    a = dna(rng, 800)
    found = sketch.sketch_offset(a.encode(), a[150:].encode())
    assert found and found[0] - found[1] == 150 and sketch.sketch_offset(b"", a.encode()) is None
    assert sketch.mask_intervals(b"acGTAnCC") == [(2, 5), (6, 8)] and sketch.mask_intervals(b"") == []


def test_streams(spark, tmp_path):
    rng = random.Random(10)
    reads = spark.createDataFrame([(k, dna(rng, 700)) for k in range(4)], "rid long, seq string")
    reads.write.parquet(str(tmp_path / "in"))
    stream = stream_shimmers(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")), P)
    q = stream.writeStream.format("memory").queryName("mm").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("mm").count() == sketch.shimmers(reads, P).count() > 0
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:10:00"), (2, "2024-01-03 00:00:00")], "u long, t string").withColumn("t", F.col("t").cast("timestamp"))
    events.write.parquet(str(tmp_path / "ev"))
    sessions = stream_sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), ["u"], "t", "1 hour", "10 minutes")
    q = sessions.writeStream.format("memory").queryName("ss").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["u"], r["count"]) for r in spark.table("ss").collect()) == [(1, 1), (1, 2), (2, 1)]
