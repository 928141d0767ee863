"""FASTA and FASTQ files as DataFrames, and writers of the pipeline's text formats."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.catalog import dense_ids
from strandloom.operators.overlaps import overlap_line
from strandloom.plans.lineage import cut_lineage

#: Files under this size are skipped unless asked for.
LEAST_FILE = 65_536
READS = "file string, ord long, name string, seq string"


def parse_fastx(data: bytes, drop_last: bool = False) -> Iterator[tuple[str, str]]:
    """(name, sequence) of the records; gzip and the format are recognised by the first bytes.

    drop_last: a FASTQ file's last record is left out, as the original programs do.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data[:1] == b"@":
        lines = data.replace(b"\r", b"").split(b"\n")
        records = [(lines[i][1:], lines[i + 1]) for i in range(0, len(lines) - 3, 4) if lines[i].startswith(b"@")]
        for head, seq in records[: -1 if drop_last else None]:
            yield head.partition(b" ")[0].decode(), seq.decode()
        return
    for record in data.split(b">")[1:]:
        head, _, body = record.partition(b"\n")
        yield head.strip().partition(b" ")[0].decode(), body.translate(None, b"\r\n").decode()


def _sniffed(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, str, bool]]:
    """(path, size, kind: ">" or "@" or other, whether gzipped) of each file, by its first bytes."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        stream = fs.open(path)
        first, zipped = stream.read(), False
        if first == 0x1F and stream.read() == 0x8B:
            stream.seek(0)
            stream = jvm.java.util.zip.GZIPInputStream(stream)
            first, zipped = stream.read(), True
        stream.close()
        out.append((name, fs.getFileStatus(path).getLen(), chr(max(first, 0)), zipped))
    return out


def _in_order(spark: SparkSession, paths: list[str], sep: str | None = None) -> DataFrame:
    """(file, no, value, n): the pieces of text files between separators, their numbers in the file, and how many it has.

    Files are split among tasks; the pieces of each split are counted first, and a split's numbers begin after those of
    the splits before it.
    """
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = (rows.where("trim(value) <> ''") if sep else rows).withColumn("at", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_file = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "block", (before - F.col("first")).alias("shift"), F.sum("n").over(of_file).alias("n"))
    return rows.join(F.broadcast(offsets), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("no"), "value", "n")


def _fasta_fields(value: Column) -> tuple[Column, Column]:
    """(name, sequence) of the text between two record marks."""
    return F.regexp_extract(value, r"^\s*([^\s]+)", 1), F.regexp_replace(F.regexp_replace(value, r"^[^\n]*\n", ""), r"\s", "")


def _fastq(spark: SparkSession, paths: list[str], drop_last: bool) -> DataFrame:
    lines = _in_order(spark, paths)
    last = F.floor((F.col("n") - 3) / 4) - (1 if drop_last else 0)  # the last record with three lines or four
    used = lines.where("no % 4 < 2").where(F.floor(F.col("no") / 4) <= last).select("file", "no", "value")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a head whose sequence hasn't come
        for batch in batches:
            out = []
            for file, no, value in zip(*(batch.column(c).to_pylist() for c in ("file", "no", "value")), strict=True):
                if no % 4 == 0:
                    if held:
                        out.append((*held, None))
                    held = (file, no // 4, value[1:].partition(" ")[0]) if value.startswith("@") else None
                elif held and held[:2] == (file, no // 4):
                    out.append((*held, value))
                    held = None
                else:
                    out.append((file, no // 4, None, value))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "ord", "name", "seq"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, None), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "ord", "name", "seq"])

    found = cut_lineage(used.mapInArrow(pair, READS))
    whole = found.where("name is not null and seq is not null")
    # a record that two splits share, at most one a split
    halves = found.where("name is null or seq is null").groupBy("file", "ord").agg(F.max("name").alias("name"), F.max("seq").alias("seq"))
    return whole.unionByName(halves.where("name is not null and seq is not null"))


def _whole_files(spark: SparkSession, paths: list[str], drop_last: bool) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(parse_fastx(content, drop_last))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["file", "ord", "name", "seq"]
                )

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(parse, READS)


def read_fastx(spark: SparkSession, paths: list[str], least_file: int = LEAST_FILE, drop_last: bool = False) -> DataFrame:
    """Records (file, ord, name, seq) of the files, in any store that Spark reads.

    Plain files are split among tasks at any size, gzipped ones are streamed by a task each.  Only gzipped files whose
    names don't end in .gz are read as a whole, up to 2 GB.
    """
    files = [f for f in _sniffed(spark, paths) if f[1] >= least_file]
    hidden = [name for name, _, _, zipped in files if zipped and not name.endswith(".gz")]
    plain = {kind: [name for name, _, k, _ in files if k == kind and name not in hidden] for kind in ">@"}
    parts = []
    if plain[">"]:
        rows = _in_order(spark, plain[">"], ">")
        name, seq = _fasta_fields(F.col("value"))
        parts.append(rows.select("file", F.col("no").alias("ord"), name.alias("name"), seq.alias("seq")))
    if plain["@"]:
        parts.append(_fastq(spark, plain["@"], drop_last))
    if hidden:
        parts.append(_whole_files(spark, hidden, drop_last))
    out = parts[0] if parts else spark.createDataFrame([], READS)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records (name, seq) of plain or gzipped FASTA; large plain files are split among tasks at record marks."""
    text = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head, body = _fasta_fields(F.col("value"))
    return text.select(head.alias("name"), body.alias("seq"))


def file_list(spark: SparkSession, path: str) -> list[str]:
    """Paths in a text file, one a line."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def fasta_lines(rows: DataFrame, header: Column, seq: str = "seq") -> DataFrame:
    return rows.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(rows: DataFrame, path: str, header: Column, seq: str = "seq") -> None:
    fasta_lines(rows, header, seq).write.text(path)


def read_header() -> Column:
    """The header of a read: name and id in nine digits."""
    return F.concat_ws(" ", "name", F.lpad(F.col("rid").cast("string"), 9, "0"))


def catalog_lines(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.format_string("%09d %s %d %d", "rid", "name", "len", "start").alias("value"))


def read_catalog_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="rid long, name string, len int, start long")


def edge_lines(edges: DataFrame) -> DataFrame:
    """Graph edges: read and strand of both ends, and the weight."""
    return edges.select(F.format_string("G %09d:%d %09d:%d %d", F.shiftright("v", 1), F.col("v") % 2, F.shiftright("w", 1), F.col("w") % 2, "weight").alias("value"))


def _text(rows: DataFrame, *order: str, together: str | None = None) -> DataFrame:
    """The lines (value) in order over all files; `together`: rows with the same value of it stay in one file."""
    return rows.repartitionByRange(*((together,) if together else order)).sortWithinPartitions(*order).select("value")


def gfa_lines(paths: DataFrame, lens: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """GFA of unitigs (begin, second, node, ord): a segment for each path with its nodes, links where one begins as another ends.

    A segment tells its length (first read, then what each read adds beyond its overlap), both ends, the number of nodes
    and whether it is kept; N lines where each node's own part begins.  Paths also link where one ends at the other strand
    of another's end.
    """
    key = ["begin", "second"]
    name = F.concat_ws("_", F.col("begin").cast("string"), F.col("second").cast("string")).alias("name")
    order = Window.partitionBy(*key).orderBy("ord")
    steps = paths.select(*key, name, "node", "ord").withColumn("before", F.lag("node").over(order))
    steps = steps.join(lens.select(F.col("rid"), F.col("len").cast("long").alias("len")), F.shiftright("node", 1) == F.col("rid"))
    steps = steps.join(edges.select(F.col("v").alias("before"), F.col("w").alias("node"), "weight"), ["before", "node"], "left")
    adds = F.when(F.col("before").isNull(), F.col("len")).otherwise(F.col("len") - F.coalesce("weight", F.lit(0)))
    placed = steps.withColumn("adds", adds).withColumn("start", F.coalesce(F.sum("adds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = placed.groupBy(*key, "name").agg(F.max_by("node", "ord").alias("end"), F.count("*").alias("n"), F.sum("adds").cast("long").alias("size"))
    seg = ends.join(kept.select(*key, F.lit(1).alias("tag")).distinct(), key, "left").withColumn("tag", F.coalesce("tag", F.lit(0)))
    line = lambda part, ord_, value: (F.lit(part).alias("part"), *key, ord_.cast("long").alias("ord"), value.alias("value"))
    segment = F.format_string("S\t%s\t*\tLN:i:%d\tRB:i:%d\tSB:i:%d\tRE:i:%d\tSE:i:%d\tNC:i:%d\tTG:i:%d", "name", "size", F.shiftright("begin", 1), F.col("begin") % 2, F.shiftright("end", 1), F.col("end") % 2, "n", "tag")
    node = F.format_string("N\t%s\t%d\t%d\t%d", "name", F.shiftright("node", 1), F.col("node") % 2, F.col("start").cast("long"))
    a, b = ends.alias("a"), ends.alias("b")
    link = lambda met, sign: met.select(F.col("a.begin").alias("begin"), F.col("a.second").alias("second"), F.col("a.name").alias("x"), F.col("b.name").alias("y"), F.lit(sign).alias("s"), F.col("a.end").alias("node"))
    onward = link(a.join(b, F.col("a.end") == F.col("b.begin")), "+")
    facing = link(a.join(b, F.col("a.end") == F.col("b.end").bitwiseXOR(F.lit(1))).where("a.name <> b.name"), "-")
    links = onward.union(facing).join(lens.select("rid", "len"), F.shiftright("node", 1) == F.col("rid"))
    head = paths.sparkSession.createDataFrame([(0, 0, 0, 0, "H\tVN:Z:1.0")], "part int, begin long, second long, ord long, value string")
    rows = head.union(seg.select(*line(1, F.lit(-1), segment))).union(placed.select(*line(1, F.col("ord"), node)))
    rows = rows.union(links.select(*line(2, F.lit(0), F.format_string("L\t%s\t+\t%s\t%s\t%dM", "x", "y", "s", "len"))))
    return _text(rows, "part", *key, "ord", "value")


def relation_lines(relations: DataFrame) -> DataFrame:
    return relations.select(F.format_string("S %d %d %d %d %d %.4f %.4f", "rid0", "rid1", "shared", "s0", "s1", "r0", "r1").alias("value"))


def interval_lines(intervals: DataFrame) -> DataFrame:
    return intervals.select(F.concat_ws(" ", F.lit("M"), "sid0", "b0", "e0", "sid1", "b1", "e1", "orient", F.lit(0)).alias("value"))


def parse_intervals(lines: DataFrame) -> DataFrame:
    parts = F.split("value", " ")
    names = ("sid0", "b0", "e0", "sid1", "b1", "e1", "orient")
    return lines.where(F.col("value").startswith("M ")).select(*[parts[i + 1].cast("long" if n.startswith("sid") else "int").alias(n) for i, n in enumerate(names)])


def subsequence(contigs: DataFrame, key: str | int, bgn: int, end: int) -> DataFrame:
    """Bases [bgn, end) of the contig of this name, or of this rid; no row if it is unknown or too short."""
    if bgn < 0 or end < bgn:
        raise ValueError("need 0 <= bgn <= end")
    column = "name" if isinstance(key, str) else "rid"
    return contigs.where((F.col(column) == key) & (F.length("seq") >= end)).select("name", F.substring("seq", bgn + 1, end - bgn).alias("seq"))


def overlap_blocks(ovlp: DataFrame, stats: DataFrame) -> DataFrame:
    """Overlaps as text, a block for each read, which stays in one file: R0 with lookups, O lines by d_left, R1 with clusters, tries and overlaps (of reads with clusters), a dash."""
    key = lambda part: (F.col("rid"), F.lit(part).alias("part"))
    none = [F.lit(0).alias(c) for c in ("d_left", "rid1", "strand1")]
    counts = stats.join(ovlp.groupBy(F.col("rid0").alias("rid")).agg(F.count("*").alias("n")), "rid", "left")
    last = F.format_string("R1 %d %d %d %d", "rid", "clusters", "tries", F.coalesce("n", F.lit(0)))
    rows = stats.select(*key(0), *none, F.format_string("R0 %d %d %d", "rid", "lookups", "overlimit").alias("value"))
    rows = rows.union(ovlp.withColumn("rid", F.col("rid0")).select(*key(1), "d_left", "rid1", "strand1", overlap_line().alias("value")))
    rows = rows.union(counts.where("clusters > 0").select(*key(2), *none, last.alias("value"))).union(stats.select(*key(3), *none, F.lit("-").alias("value")))
    return _text(rows, "rid", "part", "d_left", "rid1", "strand1", together="rid")


def layout_lines(layout: DataFrame, edges: DataFrame) -> DataFrame:
    """Layout paths as text: a header with the tag, both ends and the edges, then an E line for each edge.

    E: path, both nodes, where the aligned range begins on each, differences, and differences at markers.  Paths are
    numbered as contigs are.
    """
    paths = layout.groupBy("component", "path", "tag").agg(F.min_by("node", "ord").alias("first"), F.max_by("node", "ord").alias("end"), (F.count("*") - 1).alias("n")).withColumn("ord", F.col("component") * (1 << 20) + F.col("path"))
    numbered = dense_ids(paths, "ord", "number").drop("ord")
    order = Window.partitionBy("component", "path").orderBy("ord")
    steps = layout.withColumn("next", F.lead("node").over(order)).where("next is not null").join(numbered.select("component", "path", "number"), ["component", "path"])
    placed = steps.join(edges.select(F.col("v").alias("node"), F.col("w").alias("next"), "from0", "from1", "dist", "dist_c"), ["node", "next"])
    node = lambda c: (F.shiftright(c, 1), F.col(c) % 2)
    line = F.format_string("E %d %d %d %d %d %d %d %d %d", "number", *node("node"), *node("next"), "from0", "from1", "dist", "dist_c")
    head = F.format_string("%s %d %d:%d %d %d:%d %d", "tag", "number", *node("first"), "n", *node("end"), "n")
    rows = numbered.select("number", F.lit(-1).alias("ord"), head.alias("value")).union(placed.select("number", "ord", line.alias("value")))
    return _text(rows, "number", "ord")


def unitig_lines(unitigs: DataFrame, kept: DataFrame) -> DataFrame:
    """Unitigs as text: UTG with its name, both ends, the number of nodes and whether it is kept; an N line for each node."""
    key = ["begin", "second"]
    ends = unitigs.groupBy(*key).agg(F.max_by("node", "ord").alias("end"), F.count("*").alias("n"))
    marked = ends.join(kept.select(*key, F.lit(1).alias("tag")).distinct(), key, "left").withColumn("tag", F.coalesce("tag", F.lit(0)))
    name = F.concat_ws("_", F.col("begin").cast("string"), F.col("second").cast("string"))
    node = lambda c: (F.shiftright(c, 1), F.col(c) % 2)
    head = F.format_string("UTG %s %d:%d %d:%d %d %d", name, *node("begin"), *node("end"), "n", "tag")
    rows = marked.select(*key, F.lit(-1).cast("long").alias("ord"), head.alias("value")).union(unitigs.select(*key, F.col("ord").cast("long"), F.format_string("N %s %d:%d", name, *node("node")).alias("value")))
    return _text(rows, *key, "ord")


def write_shimmers(mm: DataFrame, path: str, chunks: int) -> None:
    """The sketch as Parquet, partitioned by the chunk of the read; as many tasks write a chunk as its rows ask for."""
    rows = mm.withColumn("chunk", F.pmod("rid", F.lit(chunks)).cast("int"))
    rows.hint("rebalance", "chunk").write.partitionBy("chunk").parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
