from itertools import groupby

import pytest
from tests.oracle import SF, database, same_rows

from strandloom.plans import registry

SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    plan = same_rows(spark, QUERIES[name], SQL[name])
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def common(a, b):
    """Length of the longest common subsequence, by bits."""
    places = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return (full & ~v).bit_count()


def test_alignments_are_sound(spark):
    """Aligned ranges without runs of a base are as far apart as the alignment says, or nearer where its band missed the best."""
    seqs = {r["rid"]: r["seq"] for r in registry._reads(spark, SF).collect()}
    exact, rows = 0, QUERIES["overlap_alignments"](spark, SF).collect()
    for r in rows:
        a, b = seqs[r["rid0"]], seqs[r["rid1"]]
        if r["strand1"]:
            b = b.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        assert (r["len0"], r["len1"]) == (len(a), len(b)) and r["d_right"] == r["d_left"] + len(b) - len(a)
        x, y = ("".join(c for c, _ in groupby(s)) for s in (a[r["bgn0"] : r["end0"] + 1], b[r["bgn1"] : r["end1"] + 1]))
        best = len(x) + len(y) - 2 * common(x, y)
        assert best <= r["dist"] <= 2 * best and min(r["end0"] - r["bgn0"], r["end1"] - r["bgn1"]) >= 200
        exact += best == r["dist"]
    assert len(rows) >= 20 and exact >= len(rows) / 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"assembled_documents", "overlap_alignments"}))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_documents_are_put_together(spark):
    texts = [r["seq"] for r in registry._reads(spark, SF, 4000).collect()]
    texts += [t[::-1].translate(str.maketrans("ACGT", "TGCA")) for t in texts]
    contigs = [r["seq"] for r in QUERIES["assembled_documents"](spark, SF).collect()]
    right = sum(any(c in t for t in texts) for c in contigs)
    assert len(contigs) > 3 and right >= 0.9 * len(contigs)
    whole = sum(len(t) for t in set(texts)) / 2
    assert sum(map(len, contigs)) > 0.3 * whole


def test_queries_have_rows_to_decide_on():
    empty = {name for name, text in SQL.items() if not database().execute(f"SELECT 1 FROM ({text}) LIMIT 1").fetchall()}
    assert empty <= {"contained_reads", "haplotype_markers", "marked_pairs"}


def test_scans_read_what_they_need(spark):
    plan = QUERIES["shimmers_r2"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_shuffles_start_in_proportion_to_the_table(spark, monkeypatch):
    """A larger table gets more partitions for adaptive execution to start with, a smaller one read later no fewer."""
    from strandloom.plans import register

    name = register._INITIAL
    try:
        spark.conf.unset(name)
        monkeypatch.setattr(register, "PIECE", 1 << 12)
        register.table(spark, SF, "lineitem")
        most = int(spark.conf.get(name))
        assert most > 20
        register.table(spark, SF, "nation")
        assert int(spark.conf.get(name)) == most
    finally:
        spark.conf.unset(name)


def test_reads_of_overlaps_are_made_once(spark, monkeypatch):
    """Reads are made of the texts once; lengths, copies and sketches come from the stored ones."""
    made = []
    monkeypatch.setattr(registry, "_reads", lambda *a, whole=registry._reads: made.append(1) or whole(*a))
    plan = QUERIES["overlap_classes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "regexp_replace" not in plan
