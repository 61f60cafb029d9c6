"""Transcript assembly from spliced alignments: one splice graph per bundle and strand, heaviest paths first.

Bundles come from ``intervals.number_islands``, so a group is one stretch of
overlapping reads. Reads with the same blocks are counted before they are
grouped: a deep bundle costs what its different reads cost.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.intervals import number_islands

SCHEMA = "chrom string, bundle long, strand string, tx int, cov double, exons array<struct<start:long,end:long>>"


def paths(fragments: list[tuple[tuple[tuple[int, int], ...], float]], least_cov: float, least_len: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """(coverage, exons) of the transcripts that fragments (blocks, weight) spell.

    Nodes are the covered stretches, cut at junctions. The path that
    carries the most fragments is taken first: a longest-path pass over the
    nodes in order, where an edge carries the fragments that span it. What it
    explains is taken off, until no node's coverage reaches ``least_cov``; every
    path takes a fragment off for good, so that is after as many as there are.
    """
    covered: list[list[int]] = []
    for s, e in sorted(x for b, _ in fragments for x in b):
        if covered and s <= covered[-1][1] + 1:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    cuts = {p for lo, hi in covered for p in (lo, hi + 1)}
    for blocks, _ in fragments:
        cuts |= {s for s, _ in blocks[1:]} | {e + 1 for _, e in blocks[:-1]}
    cuts = sorted(cuts)
    gaps = {hi + 1 for _, hi in covered}
    nodes = [(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if lo not in gaps]

    def node_path(blocks):
        out = []
        for s, e in blocks:
            k = max(j for j, (a, _) in enumerate(nodes) if a <= s)
            while k < len(nodes) and nodes[k][0] <= e:
                out.append(k)
                k += 1
        return out

    frags = [[node_path(b), b, w] for b, w in fragments]
    found = []
    for _ in range(len(frags) + 1):
        base, edge = [0.0] * len(nodes), {}
        for p, blocks, w in frags:
            if w <= 1e-9:
                continue
            for k in p:
                lo, hi = nodes[k]
                base[k] += w * sum(max(0, min(e + 1, hi) - max(s, lo)) for s, e in blocks)
            for a, b in zip(p, p[1:], strict=False):
                edge[a, b] = edge.get((a, b), 0.0) + w
        cov = [x / (hi - lo) for x, (lo, hi) in zip(base, nodes, strict=True)]
        if not any(c > 0 for c in cov) or max(cov) < least_cov:
            break
        # start from the deepest node and follow the heaviest edges both ways
        seed = max(range(len(nodes)), key=lambda k: (cov[k], -k))
        path = [seed]
        while nxt := [(w, -b, b) for (a, b), w in edge.items() if a == path[-1]]:
            path.append(max(nxt)[2])
        while prv := [(w, a, a) for (a, b), w in edge.items() if b == path[0]]:
            path.insert(0, max(prv)[2])
        on = set(path)
        inner = [edge[a, b] for a, b in zip(path, path[1:], strict=False)]
        length = sum(nodes[k][1] - nodes[k][0] for k in path)
        depth = sum(cov[k] * (nodes[k][1] - nodes[k][0]) for k in path) / length
        flow = min([depth, *inner]) if inner else depth
        exons: list[tuple[int, int]] = []
        for k in path:
            lo, hi = nodes[k]
            if exons and exons[-1][1] + 1 == lo:
                exons[-1] = (exons[-1][0], hi - 1)
            else:
                exons.append((lo, hi - 1))
        if flow >= least_cov and length >= least_len:
            found.append((flow, exons))
        # fragments within the path give up their share; at least one edge or node runs empty
        share = min(1.0, flow / max(1e-9, max(cov[k] for k in path))) if inner else 1.0
        tight = min(zip(path, path[1:], strict=False), key=lambda x: edge[x]) if inner else None
        for f in frags:
            if set(f[0]) <= on and (len(f[0]) == 1 or all(b in on and path.index(b) == path.index(a) + 1 for a, b in zip(f[0], f[0][1:], strict=False))):
                f[2] *= 1 - share
                if tight and any(x == tight for x in zip(f[0], f[0][1:], strict=False)):
                    f[2] = 0.0
        if tight:
            frags = [f for f in frags if not any(x == tight for x in zip(f[0], f[0][1:], strict=False))]
        else:
            frags = [f for f in frags if not set(f[0]) <= on]
    else:
        raise RuntimeError("paths of a bundle do not come to an end")
    return found


def assemble(reads: DataFrame, gap: int = 50, least_cov: float = 2.5, least_len: int = 200, least_junction: int = 1) -> DataFrame:
    """Transcripts of ``id, chrom, strand, blocks array<struct<start,end>>, weight``.

    Junctions under ``least_junction`` reads go with the reads that use them.
    Names are the place of a transcript in its bundle by coverage.
    """
    spliced = reads.where("size(blocks) > 1").select("id", "chrom", "strand", "weight", F.posexplode("blocks").alias("k", "b"), "blocks")
    used = spliced.where("k > 0").select("id", "chrom", "strand", "weight", F.col("blocks")[F.col("k") - 1]["end"].alias("donor"), F.col("b.start").alias("acceptor"))
    weak = used.groupBy("chrom", "strand", "donor", "acceptor").agg(F.sum("weight").alias("n")).where(F.col("n") < least_junction)
    bad = used.join(weak, ["chrom", "strand", "donor", "acceptor"], "left_semi").select("id").distinct()
    good = reads.join(bad, "id", "left_anti")
    ranged = good.withColumn("start", F.col("blocks")[0]["start"]).withColumn("end", F.element_at("blocks", -1)["end"])
    same = ranged.groupBy("chrom", "strand", "blocks", "start", "end").agg(F.sum("weight").alias("weight"), F.min("id").alias("id"))
    bundled = number_islands(same, gap, ["chrom", "strand"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        frags = [(tuple((int(b["start"]), int(b["end"])) for b in r.blocks), float(r.weight)) for r in pdf.sort_values("id").itertuples()]
        rows = [(str(pdf.chrom.iloc[0]), int(pdf.island.iloc[0]), pdf.strand.iloc[0], k + 1, cov, [{"start": s, "end": e} for s, e in exons]) for k, (cov, exons) in enumerate(sorted(paths(frags, least_cov, least_len), key=lambda x: (-x[0], x[1])))]
        return pd.DataFrame(rows, columns=["chrom", "bundle", "strand", "tx", "cov", "exons"])

    return bundled.groupBy("chrom", "strand", "island").applyInPandas(one, SCHEMA)
