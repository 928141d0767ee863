"""Pieces of DuckDB SQL that say what the sequence operators do, for comparison with their results."""

from __future__ import annotations

from strandloom.functions.hashing import HASH_BITS, ROUNDS
from strandloom.params import Params

_WRAP = "18446744073709551615::UHUGEINT"


def reads(source: str = "documents", key: str = "doc_id", text: str = "text", least: int = 500, name: str = "reads") -> str:
    seq = f"translate(regexp_replace(lower({text}), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{('ACGT' * 7)[:26]}')"
    return f"{name} AS MATERIALIZED (SELECT {key} AS rid, {seq} AS seq FROM {source} WHERE length({seq}) >= {least})"


def _mix(source: str, name: str, columns: tuple[str, ...], others: str) -> list[str]:
    """CTEs that replace the columns by their 64-bit mix."""
    out = []

    def step(expression: str) -> None:
        before = f"{name}_{len(out)}" if out else source
        out.append(f"{name}_{len(out) + 1} AS (SELECT {others}, {', '.join(expression.format(x=c) + f' AS {c}' for c in columns)} FROM {before})")

    step(f"(({_WRAP} - {{x}}::UHUGEINT) + (({{x}}::UHUGEINT * {1 << 21}) & {_WRAP})) & {_WRAP}")
    for kind, *shifts in ROUNDS:
        if kind == "xor":
            step(f"xor({{x}}, {{x}} // {1 << shifts[0]})")
        else:
            step("(" + " + ".join(["{x}", *(f"(({{x}} * {1 << s}) & {_WRAP})" for s in shifts)]) + f") & {_WRAP}")
    return out


def kmers(k: int, source: str = "reads", name: str = "mers") -> list[str]:
    """CTEs up to one of k-mers: rid, pos, strand, mhash.  Words of k bits are made by doubling, from words of k' bits."""
    w = "OVER (PARTITION BY rid ORDER BY p)"
    out = [
        f"{name}_c AS (SELECT rid, unnest(range(len(l)))::INT AS p, unnest(l) AS c FROM (SELECT rid, string_split(seq, '') AS l FROM {source}))",
        f"{name}_w1 AS (SELECT rid, p, (c IN ('C', 'T'))::BIGINT AS f0, (c IN ('G', 'T'))::BIGINT AS f1, (c NOT IN ('C', 'T'))::BIGINT AS r0, (c NOT IN ('G', 'T'))::BIGINT AS r1 FROM {name}_c)",
    ]
    n = 1
    while n < k:
        m = min(n, k - n)  # the m bits before the newest n
        part = lambda c, f: f"lag({c}, {n}, 0::BIGINT) {w}" if m == n else (f"(lag({c}, {n}, 0::BIGINT) {w} & {(1 << m) - 1})" if f else f"(lag({c}, {n}, 0::BIGINT) {w} >> {n - m})")  # noqa: B023, E731
        forward = ", ".join(f"{c} | ({part(c, True)} << {n}) AS {c}" for c in ("f0", "f1"))
        back = ", ".join(f"({c} << {m}) | {part(c, False)} AS {c}" for c in ("r0", "r1"))
        out.append(f"{name}_w{n + m} AS (SELECT rid, p, {forward}, {back} FROM {name}_w{n})")
        n += m
    out.append(f"{name}_s AS (SELECT rid, p AS pos, (r0 < f0)::INT AS strand, CASE WHEN r0 < f0 THEN r0 ELSE f0 END AS a, CASE WHEN r0 < f0 THEN r1 ELSE f1 END AS b FROM {name}_w{k} WHERE p >= {k} AND (f0 <> r0 OR f1 <> r1))")
    mixed = _mix(f"{name}_s", f"{name}_h", ("a", "b"), "rid, pos, strand")
    out += mixed
    out.append(f"{name} AS MATERIALIZED (SELECT rid, pos, strand, (xor(a, b) & {(1 << HASH_BITS) - 1})::BIGINT AS mhash FROM {mixed[-1].split(' ')[0]})")
    return out


def shimmers(p: Params, source: str = "reads", name: str = "mm") -> list[str]:
    w = "PARTITION BY rid ORDER BY pos ROWS BETWEEN"
    out = kmers(p.k, source, f"{name}_mers")
    out += [
        f"{name}_a AS (SELECT *, min(mhash) OVER ({w} {p.w - 1} PRECEDING AND CURRENT ROW) AS least FROM {name}_mers WHERE pos >= {max(p.k, p.w)})",
        f"{name}_l0 AS MATERIALIZED (SELECT rid, pos, strand, mhash FROM (SELECT *, max(least) OVER ({w} CURRENT ROW AND {p.w - 1} FOLLOWING) AS best FROM {name}_a) WHERE mhash = best)",
    ]
    for k in (1, 2):
        least = f"CASE WHEN row_number() OVER (PARTITION BY rid ORDER BY pos) >= {p.r} THEN min(mhash) OVER ({w} {p.r - 1} PRECEDING AND CURRENT ROW) END"
        out += [
            f"{name}_b{k} AS (SELECT *, {least} AS least FROM {name}_l{k - 1})",
            f"{name}_l{k} AS MATERIALIZED (SELECT rid, pos, strand, mhash FROM (SELECT *, max(least) OVER ({w} CURRENT ROW AND {p.r - 1} FOLLOWING) AS best FROM {name}_b{k}) WHERE mhash = best)",
        ]
    return [*out, f"{name} AS (SELECT rid, pos, strand, {p.k}::INT AS span, mhash FROM {name}_l2)"]


def pairs(source: str = "mm", name: str = "sp") -> str:
    w = "OVER (PARTITION BY rid ORDER BY pos)"
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT rid, mhash AS h0, pos AS p0, strand AS st0, lead(mhash) {w} AS h1, lead(pos) {w} AS p1, lead(strand) {w} AS st1, span FROM {source}) WHERE h1 IS NOT NULL)"


def hits(p: Params) -> list[str]:
    return [
        "counts AS MATERIALIZED (SELECT h0, h1, count(*) AS postings FROM sp GROUP BY h0, h1 HAVING count(*) >= 2)",
        f"ix AS MATERIALIZED (SELECT sp.* FROM sp JOIN counts USING (h0, h1) WHERE postings < {p.max_postings})",
        "fwd AS (SELECT a.rid AS rid0, b.rid AS rid1, false AS rev, a.p0 - b.p0 AS off FROM sp a JOIN ix b ON a.h0 = b.h0 AND a.h1 = b.h1 AND a.rid <> b.rid WHERE a.h0 <> a.h1)",
        "rvs AS (SELECT a.rid AS rid0, b.rid AS rid1, true AS rev, a.p1 + b.p0 - a.span + 1 AS off FROM sp a JOIN ix b ON a.h1 = b.h0 AND a.h0 = b.h1 AND a.rid <> b.rid WHERE a.h0 <> a.h1)",
        "hits AS MATERIALIZED (SELECT * FROM fwd UNION ALL SELECT * FROM rvs)",
    ]


def clusters(p: Params) -> list[str]:
    return [
        f"g1 AS (SELECT *, CASE WHEN off - lag(off) OVER (PARTITION BY rid0, rid1, rev ORDER BY off) > {p.gap} THEN 1 ELSE 0 END AS opens FROM hits)",
        "g2 AS (SELECT *, sum(opens) OVER (PARTITION BY rid0, rid1, rev ORDER BY off RANGE UNBOUNDED PRECEDING) AS run FROM g1)",
        f'clusters AS MATERIALIZED (SELECT rid0, rid1, rev::INT AS strand, min(off) AS bgn, max(off) AS "end", count(*) AS "count" FROM g2 GROUP BY rid0, rid1, rev, run HAVING count(*) >= {p.min_hits})',
    ]


def to_clusters(p: Params) -> list[str]:
    return [reads(), *shimmers(p), pairs(), *hits(p), *clusters(p)]


def overlaps(p: Params) -> list[str]:
    return [
        *to_clusters(p),
        "lens AS (SELECT rid, length(seq)::INT AS len FROM reads)",
        "ov1 AS (SELECT rid0, rid1, strand AS strand1, a.len AS len0, b.len AS len1, CASE WHEN strand = 1 THEN bgn - b.len ELSE bgn END AS d_left, count FROM clusters JOIN lens a ON a.rid = rid0 JOIN lens b ON b.rid = rid1)",
        "ov AS MATERIALIZED (SELECT *, d_left + len1 - len0 AS d_right FROM ov1)",
    ]


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}"
