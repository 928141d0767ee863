import gzip
import random

from pyspark.sql import functions as F

from strandloom.operators import catalog, contig_map, sketch
from strandloom.params import Params
from strandloom.plans import assemble
from strandloom.sources import fastx

P = Params(w=24, k=25, r=3)


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def tiles(rng, genome, length, step, name=0):
    out = []
    for k, at in enumerate(range(0, len(genome) - length + 1, step)):
        piece = genome[at : at + length]
        out.append((name + k, f"r{name + k}", turned(piece) if rng.random() < 0.5 else piece))
    return out


def test_a_genome_is_put_together(spark):
    rng = random.Random(1)
    genome = dna(rng, 16_000)
    reads = spark.createDataFrame(tiles(rng, genome, 3000, 350), "rid long, name string, seq string")
    contigs = assemble.assemble(reads, P).collect()
    assert contigs
    longest = max((c["seq"] for c in contigs), key=len)
    assert len(longest) > 9000 and (longest in genome or turned(longest) in genome)


def test_read_correction(spark):
    rng = random.Random(2)
    genome = dna(rng, 4000)
    rows = tiles(rng, genome, 3000, 100)
    k, name, seq = rows[4]
    bad = seq[:1500] + ("A" if seq[1500] != "A" else "C") + seq[1501:]
    rows[4] = (k, name, bad)
    reads = spark.createDataFrame(rows, "rid long, name string, seq string")
    ovlp = assemble.find_overlaps(reads, P)
    out = {r["rid"]: r["seq"] for r in assemble.correct(reads, ovlp, P).collect()}
    assert len(out) >= 8 and bad[1400:1600] not in out[k] and seq[1400:1600] in out[k]
    assert all(s in genome or turned(s) in genome for s in out.values())


def test_duplicates_and_relations(spark):
    rng = random.Random(3)
    a, b = dna(rng, 6000), dna(rng, 5000)
    reference = spark.createDataFrame([(0, "a", a)], "rid long, name string, seq string")
    wrong = list(a[500:5500])  # no interval spans one edit, and the rest is aligned without a difference
    wrong[2500] = "A" if wrong[2500] != "A" else "C"
    rows = [(0, "same", a), (1, "inside", a[500:5500]), (2, "edited", "".join(wrong)), (3, "other", b), (4, "mixed", b[:2000].lower() + b[2000:]), (5, "holes", b[:100] + "n" + b[100:]), (6, "turned", turned(a)[400:5600])]
    target = spark.createDataFrame(rows, "rid long, name string, seq string")
    p = Params(w=24, k=25, r=2)
    kept = {r["name"]: r["seq"] for r in contig_map.drop_duplicates(reference, target, p).collect()}
    assert set(kept) == {"same", "other", "mixed"} and kept["mixed"] == b[2000:]
    both = spark.createDataFrame([(0, "p", a), (1, "a", a[1000:4500]), (2, "q", b)], "rid long, name string, seq string")
    got = {r["name"]: (r["kind"], r["partner"]) for r in assemble.resolve(both, p).collect()}
    assert got == {"p": ("P", None), "a": ("A", 0), "q": ("P", None)}


def naive_chains(rows):
    """Links of each interval to the 25 after it in its pair, and connected members."""
    out, pairs = set(), {}
    for r in rows:
        pairs.setdefault((r[0], r[3]), []).append(r)
    for items in pairs.values():
        items.sort(key=lambda r: (r[1], r[2], r[4], r[5], r[6]))
        if len(items) < 4:
            continue
        label, linked = list(range(len(items))), set()
        diag = lambda r: r[1] + r[4] if r[6] else r[1] - r[4]
        for _ in items:
            for i, x in enumerate(items):
                for j in range(i + 1, min(len(items), i + 26)):
                    y = items[j]
                    if x[1] != y[1] and x[6] == y[6] and y[1] - x[1] < 100_000 and abs(diag(x) - diag(y)) / abs(y[1] - x[1]) < 0.2:
                        label[i] = label[j] = min(label[i], label[j])
                        linked |= {i, j}
        out |= {(*items[i], label[i]) for i in linked}
    return sorted(out)


def test_chains_match_a_loop(spark):
    rng = random.Random(4)
    rows = set()
    for pair in range(4):
        at = 0
        for _ in range(30):
            at += rng.randrange(50, 900)
            o = rng.randrange(2)
            b1 = (40_000 - at if o else at) + rng.choice([0, 3, 5000])
            rows.add((0, at, at + 40, pair, b1, b1 + 40, o))
    rows |= {(1, 5, 9, 1, 5, 9, 0), (1, 25, 29, 1, 25, 29, 0)}
    df = spark.createDataFrame(sorted(rows), "sid0 long, b0 int, e0 int, sid1 long, b1 int, e1 int, orient int")
    got = contig_map.chains(df)
    assert sorted(tuple(r) for r in got.collect()) == naive_chains(rows)
    kept = contig_map.unique_chains(got)
    assert kept.count() <= got.count() and contig_map.linear_hits(kept.withColumn("deltas", F.lit(0))).count() > 0


def test_chains_shuffle_the_intervals_once(spark):
    """A pair's chains are found where its rows meet, across the ends of batches too."""
    rows = {(a, 100 * k, 100 * k + 40, 5, 100 * k + 3 * (k % 40 == 0), 100 * k + 40, 0) for a in range(3) for k in range(90)}
    df = spark.createDataFrame(sorted(rows), "sid0 long, b0 int, e0 int, sid1 long, b1 int, e1 int, orient int")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = contig_map.chains(df)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(tuple(r) for r in got.collect()) == naive_chains(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def test_fastx_files(spark, tmp_path):
    rng = random.Random(5)
    seqs = [dna(rng, 700) for _ in range(120)]
    plain = "".join(f">s{k} more words\r\n{s[:300]}\r\n{s[300:]}\r\n" for k, s in enumerate(seqs))
    quality = "".join(f"@s{k}\n{s}\n+\n{'@' + 'I' * 699}\n" for k, s in enumerate(seqs))
    (tmp_path / "a.fa").write_text(plain)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(quality.encode()))
    (tmp_path / "small.fa").write_text(">x\nACGT\n")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    (tmp_path / "list.txt").write_text("\n".join(paths) + "\n")
    assert fastx.file_list(spark, str(tmp_path / "list.txt")) == paths
    for least, files in ((0, 3), (65_536, 1)):
        got = fastx.read_fastx(spark, paths, least).collect()
        assert len({r["file"] for r in got}) == files
    got = fastx.read_fastx(spark, paths[:2], 0).collect()
    for end in ("a.fa", "b.fq.gz"):
        mine = sorted((r["ord"], r["name"], r["seq"]) for r in got if r["file"].endswith(end))
        assert mine == [(k, f"s{k}", s) for k, s in enumerate(seqs)]
    assert fastx.read_fastx(spark, paths[1:2], 0, drop_last=True).count() == 119
    assert sorted((r["name"], r["seq"]) for r in fastx.read_fasta(spark, paths[0]).collect()) == sorted((f"s{k}", s) for k, s in enumerate(seqs))


def test_files_in_many_splits(spark, tmp_path):
    rng = random.Random(13)
    seqs = [dna(rng, rng.choice([1, 50, 700, 5000])) for _ in range(90)]
    fastq = "".join(f"@s{k} x\n{s}\n+\n{'@' * len(s)}\n" for k, s in enumerate(seqs))
    fasta = "".join(f">s{k}\n{s}\n" for k, s in enumerate(seqs))
    texts = {"a.fq": fastq, "b.fq": fastq.replace("\n", "\r\n"), "c.fa": fasta, "d.fq": fastq[: fastq.rindex("+")], "one.fq": fastq[: fastq.index("@s1 ")]}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "e.txt").write_bytes(gzip.compress(fastq.encode()))
    (tmp_path / "f.fa.gz").write_bytes(gzip.compress(fasta.encode()))
    want = {name: len(seqs) for name in ("a.fq", "b.fq", "c.fa", "e.txt", "f.fa.gz")} | {"d.fq": len(seqs) - 1, "one.fq": 1}
    try:
        for size in ("3000b", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10b")
            assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > 20
            got = fastx.read_fastx(spark, [str(tmp_path / n) for n in want], 0).collect()
            for name, n in want.items():
                mine = sorted((r["ord"], r["name"], r["seq"]) for r in got if r["file"].endswith("/" + name))
                assert mine == [(k, f"s{k}", s) for k, s in enumerate(seqs[:n])], name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert fastx.read_fastx(spark, [str(tmp_path / "a.fq")], 1 << 30).collect() == []


def test_catalogue_and_writers(spark, tmp_path):
    rows = [(3 * k, f"n{k}", "ACGT" * (100 + 10 * k)) for k in range(20)]
    reads = spark.createDataFrame(rows, "ord long, name string, seq string")
    cat = catalog.read_catalog(reads, 500)
    kept = [(n, len(s)) for _, n, s in rows if len(s) >= 500]
    want, at = [], 0
    for k, (n, length) in enumerate(kept):
        want.append((k, n, length, at))
        at += length
    assert sorted(tuple(r) for r in cat.collect()) == want
    catalog_path = str(tmp_path / "catalog")
    fastx.catalog_lines(cat).write.text(catalog_path)
    assert sorted(tuple(r) for r in fastx.read_catalog_lines(spark, catalog_path).collect()) == want
    named = reads.withColumnRenamed("ord", "rid")
    fastx.write_fasta(named, str(tmp_path / "fa"), fastx.read_header())
    assert sorted((r["name"], r["seq"]) for r in fastx.read_fasta(spark, str(tmp_path / "fa")).collect()) == sorted((n, s) for _, n, s in rows)
    found = catalog.read_lookup(named, spark.createDataFrame([(9, 0), (3, 1)], "rid long, ord long")).collect()
    assert [r["rid"] for r in found] == [9, 3]
    assert [r["seq"] for r in fastx.subsequence(named, "n1", 2, 6).collect()] == ["GTAC"] and fastx.subsequence(named, "n1", 2, 10**6).collect() == []
    assert [r["seq"] for r in fastx.subsequence(named, 3, 2, 6).collect()] == ["GTAC"]
    lens = spark.createDataFrame([(x,) for x in (10, 10, 5, 5, 200_000)], "len long")
    assert tuple(catalog.assembly_summary(lens).collect()[0]) == (200_030, 200_000, 200_000, 200_000, 5, 1)
    iv = spark.createDataFrame([(0, 1, 2, 3, 4, 5, 1)], "sid0 long, b0 int, e0 int, sid1 long, b1 int, e1 int, orient int")
    assert [tuple(r) for r in fastx.parse_intervals(fastx.interval_lines(iv)).collect()] == [(0, 1, 2, 3, 4, 5, 1)]
    edges = spark.createDataFrame([(2, 5, 7)], "v long, w long, weight long")
    assert fastx.edge_lines(edges).collect()[0]["value"] == "G 000000001:0 000000002:1 7"
    paths = spark.createDataFrame([(0, 2, 0, 0), (0, 2, 2, 1), (2, 4, 2, 0), (2, 4, 4, 1)], "begin long, second long, node long, ord long")
    lens = spark.createDataFrame([(0, 700), (1, 900), (2, 800)], "rid long, len int")
    joins = spark.createDataFrame([(0, 2, 600), (2, 4, 500)], "v long, w long, weight long")
    lines = [r["value"].split("\t") for r in fastx.gfa_lines(paths, lens, joins, paths.where("begin = 2")).collect()]
    assert lines[0] == ["H", "VN:Z:1.0"] and lines[-1] == ["L", "0_2", "+", "2_4", "+", "900M"]
    assert lines[1] == ["S", "0_2", "*", "LN:i:1000", "RB:i:0", "SB:i:0", "RE:i:1", "SE:i:0", "NC:i:2", "TG:i:0"] and lines[4][1:] == ["2_4", "*", "LN:i:1200", "RB:i:1", "SB:i:0", "RE:i:2", "SE:i:0", "NC:i:2", "TG:i:1"]
    assert lines[2:4] == [["N", "0_2", "0", "0", "0"], ["N", "0_2", "1", "0", "700"]] and len(lines) == 8
    assert sketch.shimmers(named, P).where("pos < 0").count() == 0


def test_pieces_are_even_on_a_crowded_column(spark):
    rng = random.Random(11)
    at = sorted({10**12 + rng.randrange(10**5) for _ in range(4000)} | {rng.randrange(10**18) for _ in range(40)})
    rows = spark.createDataFrame([(x, x % 50) for x in at], "ord long, len long")
    pieces = [r["count"] for r in catalog._pieces(rows, "ord", 500).groupBy("piece_").count().collect()]
    assert len(pieces) > 6 and max(pieces) <= 2 * sum(pieces) / len(pieces)
    found = catalog.running_start(catalog.dense_ids(rows, "ord", most=500), most=500).collect()
    want, start = [], 0
    for k, x in enumerate(at):
        want.append((x, k, start))
        start += x % 50
    assert sorted((r["ord"], r["rid"], r["start"]) for r in found) == want
    assert catalog.running_start(catalog.dense_ids(rows.limit(0), "ord")).collect() == []


def test_interval_query_matches_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(3), b := rng.randrange(20_000), b + rng.randrange(0, 9000)) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, sid long, bgn long, end long")
    got = sorted((r["i_id"], r["q_id"]) for r in contig_map.interval_query(df, df).collect())
    real = [r for r in rows if r[2] < r[3]]
    assert got == sorted((a[0], b[0]) for a in real for b in real if a[1] == b[1] and a[2] < b[3] and a[3] > b[2])


def test_polished_contigs_have_fewer_errors(spark):
    rng = random.Random(11)
    genome = dna(rng, 12_000)
    rows = []
    for k, name, seq in tiles(rng, genome, 3000, 150):
        bases = list(seq)
        for i in rng.sample(range(40, len(bases) - 40), 2):
            bases[i] = rng.choice("ACGT".replace(bases[i], ""))
        rows.append((k, name, "".join(bases)))
    reads = spark.createDataFrame(rows, "rid long, name string, seq string")
    p = Params(w=24, k=25, r=3, tol=0.02)
    words = {s[i : i + 21] for s in (genome, turned(genome)) for i in range(len(genome) - 20)}

    def wrong(polish):
        seq = max((c["seq"].upper() for c in assemble.assemble(reads, p, polish=polish).collect()), key=len)
        assert len(seq) > 8000
        return sum(seq[i : i + 21] not in words for i in range(len(seq) - 20)) / len(seq)

    raw, better = wrong(False), wrong(True)
    assert better < raw / 3 and raw > 0.003
