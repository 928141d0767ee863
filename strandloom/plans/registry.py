"""Queries of the sequence-overlap operators over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import align, candidates, catalog, consensus, contig_map, graph, overlaps, sketch
from strandloom.params import TEXT_PARAMS, Params
from strandloom.plans import assemble, sql
from strandloom.plans.lineage import cut_lineage
from strandloom.plans.register import QUERIES, SQL, query as _query, table as _table

#: Parameters for the short benchmark texts.
SHORT_PARAMS = Params(w=5, k=15, r=2)
P = TEXT_PARAMS

def _seconds():
    """Seconds of a time without zone since 1970, whatever the session's zone."""
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


def _reads(spark: SparkSession, sf_dir: str, least: int = 500) -> DataFrame:
    return catalog.document_reads(_table(spark, sf_dir, "documents").select("doc_id", "text"), least)


def _mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.shimmers(_reads(spark, sf_dir), P)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.shimmer_pairs(_mm(spark, sf_dir))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.pair_hits(sketch.read_pairs(_reads(spark, sf_dir), P), P)


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads, their pairs, their copies); making the reads of texts is costly, so they are stored."""
    reads = cut_lineage(_reads(spark, sf_dir))
    return reads, sketch.read_pairs(reads, P), candidates.copies(reads)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs, same = _stored(spark, sf_dir)
    return candidates.pair_clusters(pairs, P, same)


def _top_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The clusters that reads try to align, and the reads."""
    reads, pairs, same = _stored(spark, sf_dir)
    return candidates.top_group_clusters(candidates.group_clusters(pairs, P, same), same, P), reads


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, pairs, same = _stored(spark, sf_dir)
    return overlaps.from_clusters(candidates.pair_clusters(pairs, P, same), reads)


def _group_overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The overlaps of one of equal reads, which the others have alike, and the copies."""
    reads, pairs, same = _stored(spark, sf_dir)
    return overlaps.from_clusters(candidates.group_clusters(pairs, P, same), reads), same


# ---- catalogue and scalar functions


@_query(sql.query([sql.reads()], "SELECT row_number() OVER (ORDER BY rid) - 1 AS rid, 'doc' || rid AS name, length(seq) AS len, (sum(length(seq)) OVER (ORDER BY rid) - length(seq))::BIGINT AS start FROM reads"))
def read_catalog(spark, sf_dir):
    """Dense ids, lengths and offsets of the reads."""
    return catalog.read_catalog(_reads(spark, sf_dir, 0).withColumnRenamed("rid", "ord")).withColumn("len", F.col("len").cast("long"))


@_query(sql.query([sql.reads(least=0)], "SELECT rid, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5, md5(translate(seq, 'ACGT', '0123')) AS codes_md5, length(seq) AS len FROM reads"))
def strands(spark, sf_dir):
    """Reverse complements and 2-bit codes, as digests."""
    return _reads(spark, sf_dir, 0).select("rid", F.md5(S.reverse_complement(F.col("seq"))).alias("rc_md5"), F.md5(S.base_codes(F.col("seq"))).alias("codes_md5"), F.length("seq").cast("long").alias("len"))


@_query(sql.query([sql.reads(least=0), "runs AS (SELECT rid, unnest(regexp_extract_all(seq, 'AA+|CC+|GG+|TT+')) AS run FROM reads)"], "SELECT left(run, 1) AS base, length(run) AS len, count(*) AS n, count(DISTINCT rid) AS n_reads FROM runs GROUP BY ALL"))
def homopolymer_runs(spark, sf_dir):
    """How often each base stands in a run of each length."""
    runs = _reads(spark, sf_dir, 0).select("rid", F.explode(S.homopolymer_runs(F.col("seq"))).alias("run"))
    return runs.groupBy(F.substring("run", 1, 1).alias("base"), F.length("run").cast("long").alias("len")).agg(F.count("*").alias("n"), F.countDistinct("rid").alias("n_reads"))


@_query(sql.query([sql.reads(least=0)], "SELECT row_number() OVER (ORDER BY l.doc_id) - 1 AS ord, l.doc_id AS rid, 'doc' || l.doc_id AS name, md5(seq) AS seq_md5 FROM labels l JOIN reads r ON r.rid = l.doc_id"))
def read_lookup(spark, sf_dir):
    """Reads of a list of ids, here of the labelled documents, with their place in the list."""
    ids = catalog.dense_ids(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("rid")), "rid", "ord")
    return catalog.read_lookup(_reads(spark, sf_dir, 0), ids).select("ord", "rid", "name", F.md5("seq").alias("seq_md5"))


@_query(
    sql.query(
        [sql.reads()],
        "SELECT lang, total, longest, n50, n90, n, n_long FROM (SELECT lang, sum(len)::BIGINT AS total, max(len) AS longest, max(len) FILTER (run * 100 > total_ * 50) AS n50, max(len) FILTER (run * 100 > total_ * 90) AS n90, count(*) AS n, count(*) FILTER (len > 100000) AS n_long "
        "FROM (SELECT lang, length(seq) AS len, sum(length(seq)) OVER (PARTITION BY lang ORDER BY length(seq) DESC RANGE UNBOUNDED PRECEDING) AS run, sum(length(seq)) OVER (PARTITION BY lang) AS total_ FROM reads JOIN documents ON doc_id = rid) GROUP BY lang)",
    )
)
def n50_summary(spark, sf_dir):
    """Assembly statistics of the reads of each language."""
    docs = _table(spark, sf_dir, "documents")
    lens = docs.select("lang", F.length(S.text_to_sequence(F.col("text"))).cast("long").alias("len")).where("len >= 500")
    return catalog.assembly_summary(lens, "len", ["lang"])


@_query(sql.query([sql.reads()], "SELECT (rid % 7)::INT AS chunk, count(*) AS n, sum(length(seq))::BIGINT AS bases FROM reads GROUP BY 1"))
def read_chunks(spark, sf_dir):
    """Reads and bases of each of seven chunks by id."""
    return _reads(spark, sf_dir).groupBy(catalog.chunk_of(F.col("rid"), 7).alias("chunk")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).cast("long").alias("bases"))


# ---- sketches


@_query(sql.query([sql.reads(), *sql.kmers(P.k)], "SELECT rid, count(*) AS n, sum(strand)::BIGINT AS n_reverse, min(mhash) AS low, max(mhash) AS high, sum(mhash % 1000003)::BIGINT AS check_sum FROM mers GROUP BY rid"))
def kmer_hashes(spark, sf_dir):
    """Canonical k-mers of each read: number, strands, extremes and a checksum of the hashes."""
    mers = sketch.kmers(_reads(spark, sf_dir), P.k)
    return mers.groupBy("rid").agg(F.count("*").alias("n"), F.sum("strand").alias("n_reverse"), F.min("mhash").alias("low"), F.max("mhash").alias("high"), F.sum(F.col("mhash") % 1000003).alias("check_sum"))


@_query(sql.query([sql.reads(), *sql.shimmers(P)], "SELECT rid, pos, strand, mhash FROM mm_l0"))
def minimizers(spark, sf_dir):
    """Level-0 minimizers."""
    return sketch.shimmers(_reads(spark, sf_dir), P, 0).select("rid", "pos", "strand", "mhash")


@_query(sql.query([sql.reads(), *sql.shimmers(P)], "SELECT rid, pos, strand, mhash FROM mm_l1"))
def shimmers_r1(spark, sf_dir):
    """Minimizers of minimizers, by windows over the level-0 rows."""
    return sketch.reduce_native(sketch.shimmers(_reads(spark, sf_dir), P, 0), P.r).select("rid", "pos", "strand", "mhash")


@_query(sql.query([sql.reads(), *sql.shimmers(P)], "SELECT * FROM mm"))
def shimmers_r2(spark, sf_dir):
    """The sketch: two reductions."""
    return _mm(spark, sf_dir)


@_query(sql.query([sql.reads(), *sql.shimmers(P), sql.pairs()], "SELECT rid, h0, p0, st0, h1, p1, st1, span FROM sp"))
def shimmer_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@_query(sql.query([sql.reads(), *sql.shimmers(P), sql.pairs(), *sql.hits(P)], "SELECT * FROM counts"))
def pair_postings(spark, sf_dir):
    """Posting lists with two entries or more."""
    return candidates.posting_counts(_pairs(spark, sf_dir))


# ---- candidates


@_query(sql.query([sql.reads(), *sql.shimmers(P), sql.pairs(), *sql.hits(P)], "SELECT * FROM hits"))
def pair_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@_query(sql.query(sql.to_clusters(P), "SELECT * FROM clusters"))
def hit_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@_query(sql.query(sql.to_clusters(P), f'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid0 ORDER BY "count" DESC, rid1, strand, bgn)::INT AS rank FROM clusters) WHERE rank <= {P.max_tries}'))
def top_clusters(spark, sf_dir):
    return _top_clusters(spark, sf_dir)[0].drop("one0", "one1")


@_query(
    sql.query(
        [
            *sql.to_clusters(P),
            "look AS (SELECT rid, h0, h1 FROM sp WHERE h0 <> h1 UNION ALL SELECT rid, h1, h0 FROM sp WHERE h0 <> h1)",
            f"l AS (SELECT rid, count(*) AS lookups, count(*) FILTER (postings >= {P.max_postings}) AS overlimit FROM look JOIN counts USING (h0, h1) GROUP BY rid)",
            "c AS (SELECT rid0 AS rid, count(*) AS clusters FROM clusters GROUP BY rid0)",
        ],
        f"SELECT rid, coalesce(lookups, 0) AS lookups, coalesce(overlimit, 0) AS overlimit, coalesce(clusters, 0) AS clusters, least(coalesce(clusters, 0), {P.max_tries})::BIGINT AS tries FROM (SELECT DISTINCT rid FROM sp) LEFT JOIN l USING (rid) LEFT JOIN c USING (rid)",
    )
)
def read_overlap_stats(spark, sf_dir):
    _, pairs, same = _stored(spark, sf_dir)
    pairs = cut_lineage(pairs)
    return candidates.read_stats(pairs, candidates.clusters_of_reads(candidates.group_clusters(pairs, P, same), same), P)


@_query(
    sql.query(
        [
            "t AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec FROM events)",
            "g AS (SELECT user_id, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) > 3600 THEN 1 ELSE 0 END AS opens FROM t)",
            "r AS (SELECT user_id, sec, sum(opens) OVER (PARTITION BY user_id ORDER BY sec RANGE UNBOUNDED PRECEDING) AS run FROM g)",
        ],
        'SELECT user_id, min(sec) AS bgn, max(sec) AS "end", count(*) AS "count" FROM r GROUP BY user_id, run',
    )
)
def gap_sessions(spark, sf_dir):
    """The cluster rule on event times: sessions of a user with gaps of an hour at most."""
    events = _table(spark, sf_dir, "events").select("user_id", _seconds().alias("at"))
    return candidates.gap_sessions(events, ["user_id"], "at", 3600)


# ---- overlap algebra and read filters

_CLASS = "CASE WHEN d_left > 0 AND d_right > 0 THEN 'right' WHEN d_left < 0 AND d_right < 0 THEN 'left' WHEN d_left > 0 AND d_right < 0 THEN 'contains1' WHEN d_left < 0 AND d_right > 0 THEN 'contained0' ELSE 'tie' END"


@_query(sql.query(sql.overlaps(P), f"SELECT rid0, rid1, strand1, len0, len1, d_left, d_right, {_CLASS} AS class FROM ov"))
def overlap_classes(spark, sf_dir):
    rows = _overlaps(spark, sf_dir)
    return rows.select("rid0", "rid1", "strand1", "len0", "len1", "d_left", "d_right", overlaps.overlap_class(F.col("d_left"), F.col("d_right")).alias("class"))


_DEAD = [
    "side1 AS (SELECT rid0, max((d_right > 0)::INT) AS r, max((d_left < 0)::INT) AS l FROM ov GROUP BY rid0)",
    "dead1 AS (SELECT rid0 FROM side1 WHERE r = 0 OR l = 0)",
    "side2 AS (SELECT rid0, max((d_right > 0)::INT) AS r, max((d_left < 0)::INT) AS l FROM ov WHERE rid1 NOT IN (SELECT rid0 FROM dead1) GROUP BY rid0)",
    "dead AS (SELECT DISTINCT rid0 AS rid FROM ov WHERE rid0 NOT IN (SELECT rid0 FROM side2 WHERE r = 1 AND l = 1))",
]


@_query(sql.query([*sql.overlaps(P), *_DEAD], "SELECT rid FROM dead"))
def dead_ends(spark, sf_dir):
    rows, same = _group_overlaps(spark, sf_dir)
    return candidates.each_copy(overlaps.dead_ends(cut_lineage(rows.select("rid0", "rid1", "d_left", "d_right"))), same, "rid")


@_query(sql.query([*sql.overlaps(P), "m AS (SELECT rid0, len0, coalesce(min(d_left) FILTER (d_right > 0), 2147483647) AS l, coalesce(max(d_right) FILTER (d_left < 0), -2147483648) AS r FROM ov GROUP BY rid0, len0)"], "SELECT rid0 AS rid FROM m WHERE len0::BIGINT + r < l"))
def chimeras(spark, sf_dir):
    rows, same = _group_overlaps(spark, sf_dir)
    return candidates.each_copy(overlaps.chimeras(rows.withColumn("dist_c", F.lit(0))), same, "rid")


@_query(sql.query([*sql.overlaps(P), *_DEAD], "SELECT DISTINCT CASE WHEN d_left > 0 THEN rid1 ELSE rid0 END AS rid FROM ov WHERE ((d_left > 0 AND d_right < 0) OR (d_left < 0 AND d_right > 0)) AND rid0 NOT IN (SELECT rid FROM dead) AND rid1 NOT IN (SELECT rid FROM dead)"))
def contained_reads(spark, sf_dir):
    rows, same = _group_overlaps(spark, sf_dir)
    rows = cut_lineage(rows.select("rid0", "rid1", "d_left", "d_right"))
    return candidates.each_copy(overlaps.contained_reads(rows, overlaps.dead_ends(rows)), same, "rid")


def _dovetails(spark, sf_dir):
    """Order lines as stand-ins for overlaps: rows of dist, dist_c and lengths."""
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_suppkey").alias("rid0"), F.col("l_orderkey").alias("rid1"), F.col("l_linenumber").alias("strand1"), F.lit(0).alias("bgn0"), (F.col("l_quantity") * 100).cast("int").alias("end0"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("d_left"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("d_right"), (F.col("l_tax") * 100).cast("int").alias("dist"), (F.col("l_discount") * 100).cast("int").alias("dist_c"),
    ).groupBy("rid0", "rid1", "strand1", "bgn0", "d_left", "d_right").agg(F.max("end0").alias("end0"), F.min("dist").alias("dist"), F.min("dist_c").alias("dist_c"))


@_query(
    sql.query(
        [
            "d AS (SELECT l_suppkey AS rid0, l_orderkey AS rid1, l_linenumber AS strand1, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS d_left, max((l_quantity * 100)::INT) AS end0, min(trunc(l_tax * 100)::INT) AS dist, min(trunc(l_discount * 100)::INT) AS dist_c FROM lineitem GROUP BY ALL)",
            "r AS (SELECT *, CASE WHEN d_left > 0 THEN 'right' ELSE 'left' END AS side, row_number() OVER (PARTITION BY rid0, d_left ORDER BY end0 DESC, rid1, strand1)::INT AS rank FROM d)",
            "t AS (SELECT *, CASE WHEN dist = 0 THEN 0 WHEN dist_c = 0 THEN 1 WHEN dist_c < 5 THEN 2 END AS tier FROM r WHERE rank <= 6)",
            "u AS (SELECT *, min(tier) OVER (PARTITION BY rid0, side) AS least FROM t WHERE tier IS NOT NULL)",
        ],
        "SELECT rid0, rid1, strand1, side, rank, tier, end0 FROM u WHERE tier = least",
    )
)
def best_n_per_side(spark, sf_dir):
    return overlaps.best_n_per_side(_dovetails(spark, sf_dir), 6).select("rid0", "rid1", "strand1", "side", "rank", "tier", "end0")


@_query(
    sql.query(
        [
            "iv AS (SELECT user_id, epoch_us(ts) // 1000000 AS bgn, epoch_us(ts) // 1000000 + (trunc(value * 60))::BIGINT AS \"end\" FROM events)",
            "ev AS (SELECT user_id, bgn AS pos, 0 AS kind FROM iv UNION ALL SELECT user_id, \"end\", 3 FROM iv)",
        ],
        "SELECT user_id, pos, kind, sum(CASE kind WHEN 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY pos * 4 + kind RANGE UNBOUNDED PRECEDING)::BIGINT AS depth FROM ev",
    )
)
def coverage_sweep(spark, sf_dir):
    """Depth of the users' event intervals (as long as `value` minutes) at each opening and closing."""
    iv = _intervals(spark, sf_dir)
    events = iv.select("user_id", F.col("bgn").alias("pos"), F.lit(0).alias("kind")).union(iv.select("user_id", "end", F.lit(3)))
    return overlaps.coverage_sweep(events, ["user_id"], "pos")


def _intervals(spark, sf_dir):
    at = _seconds()
    return _table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("bgn"), (at + (F.col("value") * 60).cast("long")).alias("end"))


_IV = "iv AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS bgn, epoch_us(ts) // 1000000 + (trunc(value * 60))::BIGINT AS \"end\" FROM events)"


@_query(sql.query([_IV], 'SELECT a.event_id AS event0, b.event_id AS event1, a.user_id AS user_id, least(a."end", b."end") - greatest(a.bgn, b.bgn) AS shared FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.bgn < b."end" AND a."end" > b.bgn WHERE a.bgn < a."end" AND b.bgn < b."end"'))
def interval_query(spark, sf_dir):
    """Pairs of a user's event intervals that overlap."""
    iv = _intervals(spark, sf_dir)
    found = contig_map.interval_query(iv, iv, sid="user_id").where("i_event_id < q_event_id")
    return found.select(F.col("i_event_id").alias("event0"), F.col("q_event_id").alias("event1"), F.col("i_user_id").alias("user_id"), (F.least("i_end", "q_end") - F.greatest("i_bgn", "q_bgn")).alias("shared"))


# ---- contig maps and haplotype relations


@_query(
    sql.query(
        [
            sql.reads(), *sql.shimmers(P),
            "used AS (SELECT rid, mhash FROM mm WHERE mhash IN (SELECT mhash FROM mm GROUP BY mhash HAVING count(*) BETWEEN 2 AND 10))",
            "sh AS (SELECT a.rid AS rid0, b.rid AS rid1, count(*) AS shared FROM used a JOIN used b USING (mhash) WHERE a.rid <> b.rid GROUP BY ALL)",
            "sz AS (SELECT rid, count(*) AS s FROM mm GROUP BY rid)",
        ],
        "SELECT rid0, rid1, shared, a.s AS s0, b.s AS s1, shared / a.s AS r0, shared / b.s AS r1 FROM sh JOIN sz a ON a.rid = rid0 JOIN sz b ON b.rid = rid1",
    )
)
def sketch_containment(spark, sf_dir):
    return contig_map.sketch_containment(_mm(spark, sf_dir))


@_query(SQL["sketch_containment"].replace("SELECT rid0, rid1, shared, a.s AS s0", "SELECT rid0, rid1 FROM (SELECT *, row_number() OVER (PARTITION BY rid0 ORDER BY shared DESC, rid1) AS k FROM (SELECT rid0, rid1, shared, a.s AS s0") + ") WHERE r0 > 0.5 AND s1 > s0) WHERE k = 1")
def resolve_associates(spark, sf_dir):
    return contig_map.associates(contig_map.sketch_containment(_mm(spark, sf_dir)))


@_query(
    sql.query(
        [
            sql.reads(name="docs_r", least=0), sql.reads("benchmark", "item_id", name="items_r", least=0), *sql.shimmers(SHORT_PARAMS, "docs_r", "ma"), *sql.shimmers(SHORT_PARAMS, "items_r", "mb"), sql.pairs("ma", "pa"), sql.pairs("mb", "pb_all"),
            "pb AS (SELECT * FROM pb_all WHERE (h0, h1) IN (SELECT (h0, h1) FROM pb_all GROUP BY h0, h1 HAVING count(*) <= 32))",
        ],
        "SELECT a.rid AS sid0, a.p0 AS b0, a.p1 AS e0, b.rid AS sid1, b.p0 AS b1, b.p1 AS e1, 0 AS orient FROM pa a JOIN pb b ON a.h0 = b.h0 AND a.h1 = b.h1 AND a.st0 = b.st0 AND a.st1 = b.st1 UNION ALL "
        "SELECT a.rid, a.p0, a.p1, b.rid, b.p0, b.p1, 1 FROM pa a JOIN pb b ON a.h1 = b.h0 AND a.h0 = b.h1 AND a.st0 <> b.st1 AND a.st1 <> b.st0",
    )
)
def contig_intervals(spark, sf_dir):
    """Interval map of the documents against the benchmark items."""
    return contig_map.interval_map(*_short(spark, sf_dir))


def _short(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rid"), S.text_to_sequence(F.col("text")).alias("seq"))
    return sketch.shimmers(_reads(spark, sf_dir, 0), SHORT_PARAMS), sketch.shimmers(items, SHORT_PARAMS)


# ---- string graph, on graphs made of orders


def _part_graph(spark, sf_dir):
    """Parts of one order, from the smaller to the larger key, weighted by the number of orders."""
    lines = _table(spark, sf_dir, "lineitem").where("l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    pairs = lines.select(F.explode("parts").alias("v"), "parts").select("v", F.explode(F.expr("filter(parts, x -> x > v)")).alias("w"))
    return pairs.groupBy("v", "w").agg(F.count("*").alias("weight"))


_PARTS = [
    "lp AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)",
    "e AS MATERIALIZED (SELECT a.l_partkey AS v, b.l_partkey AS w, count(*) AS weight FROM lp a JOIN lp b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)",
]
_DEGREES = [
    "o AS (SELECT v AS node, count(*) AS n_out FROM e GROUP BY v)",
    "i AS (SELECT w AS node, count(*) AS n_in FROM e GROUP BY w)",
    "deg AS MATERIALIZED (SELECT node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM o FULL JOIN i USING (node))",
    "ed AS (SELECT e.*, a.n_in AS v_in, a.n_out AS v_out, b.n_in AS w_in, b.n_out AS w_out FROM e JOIN deg a ON a.node = v JOIN deg b ON b.node = w)",
    "spurs AS (SELECT v, w FROM ed WHERE (v_in = 0 AND w_in >= 2 AND w_out >= 1) OR (w_out = 0 AND v_out >= 2 AND v_in >= 1))",
]
_WITNESS = "wit AS MATERIALIZED (SELECT DISTINCT a.v, b.w FROM e a JOIN e b ON a.w = b.v)"


@_query(sql.query([*_PARTS, *_DEGREES], "SELECT * FROM deg"))
def node_degrees(spark, sf_dir):
    return graph.degrees(_part_graph(spark, sf_dir))


@_query(sql.query([*_PARTS, *_DEGREES, _WITNESS], "SELECT e.v, e.w, e.weight FROM e ANTI JOIN (SELECT v, w FROM wit UNION ALL SELECT v, w FROM spurs) x ON e.v = x.v AND e.w = x.w"))
def transitive_reduction(spark, sf_dir):
    return graph.transitive_reduction(_part_graph(spark, sf_dir))


@_query(sql.query([*_PARTS, *_DEGREES], "SELECT * FROM spurs"))
def spur_edges(spark, sf_dir):
    return graph.spur_edges(_part_graph(spark, sf_dir))


@_query(sql.query([*_PARTS, *_DEGREES], "SELECT v, w, weight FROM ed WHERE weight < 2 AND v_out >= 2 AND v_in >= 1 AND w_out >= 1 AND w_in >= 2"))
def bridge_candidates(spark, sf_dir):
    return graph.bridge_candidates(_part_graph(spark, sf_dir), 2)


@_query(sql.query(_PARTS, "SELECT v, w, weight FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY weight DESC, w) AS k FROM e) WHERE k = 1"))
def best_links(spark, sf_dir):
    return graph.best_links(_part_graph(spark, sf_dir))


@_query(sql.query(_PARTS, "SELECT v, w, weight FROM (SELECT *, rank() OVER (PARTITION BY v ORDER BY weight DESC) AS a, rank() OVER (PARTITION BY w ORDER BY weight DESC) AS b FROM e) WHERE a = 1 AND b = 1"))
def strongest_links(spark, sf_dir):
    return graph.strongest_links(_part_graph(spark, sf_dir))


def _customer_links(spark, sf_dir):
    """A customer's nation-mates by account balance: to the next and, from the best of each segment, to the one after."""
    c = _table(spark, sf_dir, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    nxt = c.select(F.col("c_custkey").alias("v"), F.lead("c_custkey").over(w).alias("w"), F.lead("c_custkey", 2).over(w).alias("w2"), "c_mktsegment", F.lead("c_mktsegment", 2).over(w).alias("m2"))
    return nxt.where("w is not null").select("v", "w").union(nxt.where("w2 is not null and c_mktsegment = m2").select("v", "w2")).withColumn("weight", F.lit(1))


_CUSTOMERS = [
    "n AS (SELECT c_custkey AS v, lead(c_custkey) OVER x AS w, lead(c_custkey, 2) OVER x AS w2, c_mktsegment AS m, lead(c_mktsegment, 2) OVER x AS m2 FROM customer WINDOW x AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey))",
    "e AS MATERIALIZED (SELECT v, w FROM n WHERE w IS NOT NULL UNION ALL SELECT v, w2 FROM n WHERE w2 IS NOT NULL AND m = m2)",
    "o AS (SELECT v AS node, count(*) AS n_out FROM e GROUP BY v)",
    "i AS (SELECT w AS node, count(*) AS n_in FROM e GROUP BY w)",
    "inn AS MATERIALIZED (SELECT node FROM o JOIN i USING (node) WHERE n_in = 1 AND n_out = 1)",
    "walk AS (SELECT v AS begin, w AS second, w AS node, 1::BIGINT AS ord FROM e WHERE v NOT IN (SELECT node FROM inn) UNION ALL SELECT begin, second, e.w, ord + 1 FROM walk JOIN e ON e.v = walk.node WHERE walk.node IN (SELECT node FROM inn))",
]


@_query(sql.query(_CUSTOMERS, "SELECT begin, second, node, ord FROM walk UNION ALL SELECT v, w, v, 0 FROM e WHERE v NOT IN (SELECT node FROM inn)", recursive=True))
def unitigs(spark, sf_dir):
    return graph.unitigs(_customer_links(spark, sf_dir))


@_query(
    "WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS v, 1000000000 + l_orderkey AS w FROM lineitem), b AS MATERIALIZED (SELECT v, w FROM e UNION ALL SELECT w, v FROM e), "
    "cc(node, component) USING KEY (node) AS (SELECT DISTINCT v, v FROM b UNION SELECT u.node, min(x.component) FROM recurring.cc u JOIN b ON b.v = u.node JOIN cc x ON x.node = b.w WHERE x.component < u.component GROUP BY u.node) "
    "SELECT node, component FROM cc"
)
def graph_components(spark, sf_dir):
    """Connected components of suppliers and orders linked by order lines."""
    lines = _table(spark, sf_dir, "lineitem")
    return graph.components(lines.select(F.col("l_suppkey").alias("v"), (F.col("l_orderkey") + 1_000_000_000).alias("w")).distinct())


# ---- alignment and consensus, compared with brute force in the tests


@_query()
def overlap_alignments(spark, sf_dir):
    """Aligned overlaps of the document reads."""
    return align.align_groups(*_top_clusters(spark, sf_dir), P, min_len=200).drop("deltas")


@_query()
def marked_overlaps(spark, sf_dir):
    """The best overlap of each pair with its marker statistics."""
    aligned = cut_lineage(align.align_groups(*_top_clusters(spark, sf_dir), P, min_len=200))
    return overlaps.with_markers(aligned.drop("deltas"), align.delta_rows(aligned))


@_query()
def corrected_reads(spark, sf_dir):
    """Reads rewritten by the votes of their compatible neighbours."""
    reads = _reads(spark, sf_dir)
    return consensus.corrected_reads(marked_overlaps(spark, sf_dir), reads, P.tol, min_len=200, least=200)


def _document_tiles(spark, sf_dir, length=1000, step=250):
    """Each different document of 4,000 bases or more as reads that overlap, every other one reversed."""
    texts = _reads(spark, sf_dir, 4000).groupBy("seq").agg(F.min("rid").alias("doc"))
    tiles = texts.select("doc", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - length, F.lit(step))).alias("at"))
    piece = F.substring(F.col("seq"), F.col("at") + 1, F.lit(length))
    number = F.col("doc") * 100_000 + (F.col("at") / step).cast("long")
    return tiles.select(number.alias("rid"), F.concat_ws("_", "doc", "at").alias("name"), F.when(F.col("at") / step % 2 == 1, S.reverse_complement(piece)).otherwise(piece).alias("seq"))


@_query()
def assembled_documents(spark, sf_dir):
    """Contigs of the documents' overlapping reads."""
    return assemble.assemble(cut_lineage(_document_tiles(spark, sf_dir)), P, min_len=200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strandloom.plans import algebra  # noqa: F401  registers more queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from strandloom.plans import algebra  # noqa: F401

    return dict(SQL)
