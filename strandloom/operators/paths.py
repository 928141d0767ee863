"""Edge-disjoint heavy paths through reduced string graphs: the rule, for a component in memory.

`path_rounds` does the same by joins, for components of any size.  Both work on the chains of a component (maximal
unbranched runs of nodes) and on its vertices, the ends of chains; a node is rid * 2 + strand.

One round: h(v), the score of the best path from vertex v, is found from the ends backwards: a chain gives one for each
node (minus one for the strand of a read that comes second where both strands hang together) and the score of its end, or
ends inside where that is better.  Where nothing is left to find (a cycle), the vertex farthest from the begins goes as far
as what is found lets it.  Begins without incoming edges (in a component without any, its smallest vertex) take their
paths, the highest score first, then the smallest begin; a path stops where a better one goes on, where it would use the
other strand of a chain that a better one or itself uses, and behind a vertex that branches: a way off, on either strand,
goes on for more than BRANCH nodes without meeting a read of the path, searched chain by chain.  What paths use goes, on
both strands, and the next round begins, until no path is found.
"""

from __future__ import annotations

from collections import defaultdict

#: Reads that make a branch a true one, and edges that make a path a contig or a primary one.
BRANCH, SHORT, PRIMARY = 1024, 3, 8

Chain = tuple[int, int]


def chains_of(edges: set[tuple[int, int]]) -> dict[Chain, list[int]]:
    """(first, second node) -> nodes of each chain; a cycle without vertices is one chain from its smallest node to itself."""
    out, into = defaultdict(list), defaultdict(list)
    for v, w in sorted(edges):
        out[v].append(w)
        into[w].append(v)
    inner = {v for v in out if len(out[v]) == 1 and len(into[v]) == 1}
    found, seen = {}, set()

    def run(v: int, w: int) -> None:
        nodes = [v, w]
        while nodes[-1] in inner and nodes[-1] != v:
            nodes.append(out[nodes[-1]][0])
        found[v, w] = nodes
        seen.update(nodes[:-1])

    for v in list(out):
        for w in out[v] if v not in inner else ():
            run(v, w)
    for v in sorted(inner):
        if v not in seen:
            run(v, out[v][0])
    return found


class Round:
    """Scores, choices and paths of one round."""

    def __init__(self, chains: dict[Chain, list[int]], branch: int):
        self.chains, self.branch = chains, branch
        self.out, self.into = defaultdict(list), defaultdict(int)
        for c in sorted(chains):
            self.out[c[0]].append(c)
            self.into[chains[c][-1]] += 1
        self.vertices = sorted({x for n in chains.values() for x in (n[0], n[-1])})
        self.twin = {c: (n[-1] ^ 1, n[-2] ^ 1) for c, n in chains.items()}
        label = self._labels()
        self.second_vertex = {v: False for v in self.vertices}
        self.second_chain = dict.fromkeys(chains, False)
        if any(label.get(v ^ 1) == label[v] for v in self.vertices):
            level = self._scored()
            both = lambda v: label.get(v ^ 1) == label[v]
            self.second_vertex = {v: both(v) and (level[v], -v) < (level.get(v ^ 1, 0), -(v ^ 1)) for v in self.vertices}
            key = {c: (level.get(n[0] ^ 1, 0), c) for c, n in chains.items()}
            self.second_chain = {c: both(c[0]) and self.twin[c] in key and key[c] > key[self.twin[c]] for c in chains}
        self._scored()
        self._claimed()

    def _labels(self) -> dict[int, int]:
        root = {v: v for v in self.vertices}

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        for n in self.chains.values():
            a, b = find(n[0]), find(n[-1])
            root[max(a, b)] = min(a, b)
        return {v: find(v) for v in self.vertices}

    def seeds(self) -> list[int]:
        return [v for v in self.vertices if self.out[v] and not self.into[v]] or [v for v in self.vertices if self.out[v]][:1]

    def _far(self) -> dict[int, int]:
        far, front = dict.fromkeys(self.seeds(), 0), self.seeds()
        while front:
            front = sorted({e for v in front for c in self.out[v] if (e := self.chains[c][-1]) not in far})
            far |= {e: max(far.values()) + 1 for e in front}
        return far

    def part(self, c: Chain) -> tuple[int, int]:
        """(score, inner nodes) of the best path that ends inside the chain."""
        k = len(self.chains[c]) - 2
        return (k // 2, k // 2) if self.twin[c] == c else (0, 0) if self.second_chain[c] else (k, k)

    def _scored(self) -> dict[int, int]:
        """The round of decision of each vertex; sets score, choice (chain, whole or inner nodes) of each."""
        self.score = {v: 0 for v in self.vertices if not self.out[v]}
        self.choice, level, turn, far = {}, dict.fromkeys(self.score, 0), 0, None
        open_ = [v for v in self.vertices if self.out[v]]
        while open_:
            turn += 1
            now = [v for v in open_ if all(self.chains[c][-1] in self.score or self.chains[c][-1] == v for c in self.out[v])]
            if not now:
                far = far if far is not None else self._far()
                now = [max(open_, key=lambda v: (far.get(v, -1), -v))]
            new = {}
            for v in now:
                best = []
                for c in self.out[v]:
                    end, k, (part, inner) = self.chains[c][-1], len(self.chains[c]) - 2, self.part(c)
                    value, whole = part, False
                    if end in self.score and self.twin[c] != c:
                        full = (-k if self.second_chain[c] else k) + (-1 if self.second_vertex[end] else 1) + self.score[end]
                        value, whole = (full, True) if full >= part else (part, False)
                    best.append((value, -c[1], whole, inner, c))
                value, _, whole, inner, c = max(best)
                new[v] = max(value, 0)
                if value > 0:
                    self.choice[v] = (c, whole, inner)
            self.score |= new
            level |= dict.fromkeys(new, turn)
            decided = set(now)
            open_ = [v for v in open_ if v not in decided]
        return level

    def way(self, seed: int) -> list[tuple[Chain, bool, int]]:
        """The whole best path of a begin: (chain, whole, inner nodes)."""
        out, v = [], seed
        while v in self.choice:
            out.append(self.choice[v])
            if not self.choice[v][1]:
                break
            v = self.chains[self.choice[v][0]][-1]
        return out

    def _claimed(self) -> None:
        """Paths of the begins, in order, as far as no better path goes on."""
        taken, self.paths = set(), {}
        for s in sorted(self.seeds(), key=lambda s: (-self.score[s], s)):
            self.paths[s] = []
            for step in self.way(s):
                if step[0][0] in taken:
                    break
                taken.add(step[0][0])
                self.paths[s].append(step)

    def leaves(self, v: int, reads: set[int], chains: set[Chain]) -> bool:
        """Whether a way off a path (reads of its vertices, its chains on both strands) goes on for long without meeting it."""
        if len(self.out[v]) < 2:
            return False
        inner = lambda c: len(self.chains[c]) - 2
        for first in self.out[v]:
            if first in chains if inner(first) else first[1] >> 1 in reads:
                continue
            count, front, seen = 0, [first], {v}
            while front:
                ends = {self.chains[c][-1] for c in front if count + inner(c) <= self.branch} - seen
                if any(inner(c) and c in chains for c in front) or any(e >> 1 in reads for e in ends):
                    break
                count += sum(inner(c) for c in front) + len(ends)
                if count > self.branch:
                    return True
                seen |= ends
                front = [c for e in ends for c in self.out[e]]
        return False

    def cut(self) -> list[tuple[int, list[tuple[Chain, bool, int]]]]:
        """(begin, steps) of the paths, cut where they branch or meet the other strand of a used chain."""
        used, out = set(), []
        for s, steps in self.paths.items():
            way = self.way(s)
            reads = {s >> 1} | {self.chains[c][-1] >> 1 for c, whole, _ in way if whole}
            on = {x for c, _, _ in way for x in (c, self.twin[c])}
            own, mine = [], set()
            for c, whole, inner in steps:
                if self.twin[c] in used or self.twin[c] in mine:
                    break
                own.append((c, whole, inner))
                mine.add(c)
                end = self.chains[c][-1]
                if whole and (self.leaves(end, reads, on) or self.leaves(end ^ 1, reads, on)):
                    break
            used |= mine
            out.append((s, own))
        return out


def paths_of(edges: list[tuple[int, int]], branch: int = BRANCH) -> list[tuple[str, list[int]]]:
    """(tag, nodes) of the paths, by rounds, then by score.

    P: PRIMARY edges or more; A: shorter ones that begin on a read of a P path and meet it again; D: other shorter ones;
    the shortest are left out.  A read belongs to the first P path that has it, of this round or before.
    """
    left, out, owner = {(v, w) for v, w in edges if v != w}, [], {}
    while left:
        this, found = Round(chains_of(left), branch), []
        for _, steps in this.cut():
            nodes = [x for c, whole, inner in steps for x in this.chains[c][: -1 if whole else inner + 1]]
            if steps and steps[-1][1]:
                nodes.append(this.chains[steps[-1][0]][-1])
            if len(nodes) > 1:
                found.append(nodes)
        if not found:
            break
        kept = [n for n in found if len(n) > SHORT]
        for i, nodes in enumerate(kept):
            for v in nodes if len(nodes) > PRIMARY else ():
                owner.setdefault(v >> 1, len(out) + i)
        for nodes in kept:
            start = owner.get(nodes[0] >> 1)
            touches = start is not None and any(owner.get(v >> 1) == start for v in nodes[1:])
            out.append(("P" if len(nodes) > PRIMARY else "A" if touches else "D", nodes))
        for nodes in found:
            for v, w in zip(nodes, nodes[1:], strict=False):
                left -= {(v, w), (w ^ 1, v ^ 1)}
    return out
