"""Multiple alignments, phasing and target regions beside plain versions."""

import itertools
import random

import numpy as np
import pytest
from helixframe.operators import multialign, phasing, targets

BLOCKS = "array<struct<a:long,b:long,length:long>>"


def mutated(rnd, base):
    """A copy with indels, and the pairs of bases that stay together."""
    out, pairs = [], []
    for i, c in enumerate(base):
        if rnd.random() < 0.05:
            out += rnd.choices("ACGT", k=rnd.randrange(1, 4))
        if rnd.random() < 0.06 and 3 < i < len(base) - 3:
            continue
        pairs.append((i, len(out)))
        out.append(c)
    return "".join(out), pairs


def runs(pairs):
    out = []
    for x, y in pairs:
        if out and (x, y) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1][2] += 1
        else:
            out.append([x, y, 1])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed", range(15))
def test_alignments_read_back_out_of_the_merged_layout(seed):
    """Trees of any shape, with turned members: bases aligned in a pair share a column, and no others of the pair between its ends."""
    rnd = random.Random(seed)
    n = rnd.randrange(2, 9)
    length = {k: rnd.randrange(20, 60) for k in range(n)}
    tree = []
    for k in range(1, n):
        j = rnd.randrange(k)
        # aligned bases: two increasing lists of places
        m = rnd.randrange(1, min(length[j], length[k]))
        pairs = list(zip(sorted(rnd.sample(range(length[j]), m)), sorted(rnd.sample(range(length[k]), m)), strict=True))
        tree.append((j, k, length[j], length[k], rnd.random() < 0.5, runs(pairs)))
    rnd.shuffle(tree)
    whole = multialign.build(tree)
    assert set(whole.columns) == set(range(n)) and not whole.turned[0]
    for k, c in whole.columns.items():
        assert len(c) == length[k] and (np.diff(c) > 0).all()
    for a, b, a_len, b_len, reverse, blocks in tree:
        assert whole.turned[a] ^ whole.turned[b] == reverse
        x, y = whole.columns[a], whole.columns[b]
        if whole.turned[a]:
            x, y = -x[::-1], -y[::-1]
        want = {(s + i, t + i) for s, t, m in blocks for i in range(m)}
        first, last = blocks[0], blocks[-1]
        got = {(int(i), int(np.searchsorted(y, x[i]))) for i in range(first[0], last[0] + last[2]) if x[i] in set(y[first[1] : last[1] + last[2]].tolist())}
        assert got == want


def test_forest_layout_and_consensus(spark):
    rnd = random.Random(4)
    base = "".join(rnd.choices("ACGT", k=80))
    copies = {k: mutated(rnd, base) for k in range(1, 7)}
    rows = [(k, 0, k, 80, len(s), False, 10.0 - k, runs(p)) for k, (s, p) in copies.items()]
    # worse alignments that close circles, and another cluster
    rows += [(20, 1, 2, len(copies[1][0]), len(copies[2][0]), False, 0.5, [(0, 0, 3)]), (21, 5, 5, 9, 9, False, 99.0, [(0, 0, 9)]), (30, 100, 101, 4, 4, True, 1.0, [(0, 0, 4)])]
    df = spark.createDataFrame(rows, f"id long, a long, b long, a_len int, b_len int, reverse boolean, score double, blocks {BLOCKS}")
    forest = multialign.best_forest(df)
    assert sorted((r.id, r.cluster) for r in forest.collect()) == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (30, 100)]
    out = multialign.merged_layouts(forest)
    held = {r.seq: r for r in out.collect()}
    assert held[101].turned and not held[100].turned and list(held[101].columns) == [0, 1, 2, 3]
    text = {0: base, **{k: s for k, (s, _) in copies.items()}}
    seqs = spark.createDataFrame(list(text.items()), "seq long, bases string")
    lines = multialign.gapped(out, seqs)
    wide = {r.seq: (r.first, r.gapped) for r in lines.collect()}
    for k, (first, line) in wide.items():
        assert line.replace("-", "") == text[k] and first == held[k].columns[0] and [first + i for i, c in enumerate(line) if c != "-"] == list(held[k].columns)
    got = {r.col: (r.base, r.n, r.depth) for r in multialign.consensus(lines).collect()}
    for col in range(max(f + len(w) for f, w in wide.values())):
        here = [w[col - f] for f, w in wide.values() if f <= col < f + len(w)]
        best = min(set(here), key=lambda c: (-here.count(c), c == "-", c))
        assert got[col] == (best, here.count(best), len(here))


def plain_clip(line, clip):
    """Clip at the end of a list of scores, walked outwards."""
    if not clip:
        return clip
    inside = [i for i in range(len(line) - clip) if line[i] == 1]
    if not inside:
        return clip
    at = best = inside[-1]
    score = most = 1
    for i in range(at + 1, len(line)):
        score += line[i]
        if score > most:
            most, best = score, i
        if score <= multialign.DROP:
            break
    return len(line) - 1 - best


def test_refined_clips(spark):
    rnd = random.Random(7)
    cons = rnd.choices("ACGT", k=60)
    columns = spark.createDataFrame([(1, k, c) for k, c in enumerate(cons)], "cluster long, col long, base string")
    rows, want = [], {}
    for k in range(40):
        first, n = rnd.randrange(0, 20), rnd.randrange(5, 40)
        line = [c if rnd.random() < rnd.choice([0.3, 0.95]) else rnd.choice("ACGT-") for c in cons[first : first + n]]
        left, right = rnd.randrange(0, n // 2), rnd.randrange(0, n // 2)
        rows.append((1, k, first, "".join(line), left, right))
        score = [0 if c == "-" else 1 if c == x else -3 for c, x in zip(line, cons[first:], strict=False)]
        want[k] = (plain_clip(score[::-1], left), plain_clip(score, right))
    df = spark.createDataFrame(rows, "cluster long, seq long, first long, gapped string, clip_left int, clip_right int")
    assert {r.seq: (r.clip_left, r.clip_right) for r in multialign.refine_clips(df, columns).collect()} == want


@pytest.mark.parametrize("seed", range(12))
def test_haplotype_beside_all_haplotypes(seed):
    rnd = np.random.default_rng(seed)
    sites, width = int(rnd.integers(1, 11)), int(rnd.integers(2, 6))
    counts = [np.zeros(1 << width, np.int64)]
    for k in range(1, sites):
        low = min(k + 1, width)
        masks = [int(m) | 1 for m in rnd.integers(0, 1 << low, 6) if bin(int(m) | 1).count("1") > 1]
        counts.append(phasing.pattern_counts(np.array(masks, np.int64), np.array([int(rnd.integers(0, 1 << low)) & m for m in masks], np.int64), rnd.integers(1, 9, len(masks)), width))
    full = (1 << width) - 1

    def score(h):
        total = 0
        for k in range(sites):
            x = sum(h[k - i] << i for i in range(min(k + 1, width)))
            total += counts[k][x] + counts[k][full - x]
        return total

    got = phasing.best_haplotype(counts, width)
    assert len(got) == sites and got[0] == 0 and score(got) == max(score(h) for h in itertools.product((0, 1), repeat=sites))


def test_planted_haplotypes(spark):
    """Reads of five sites with 3 % slips over two planted haplotypes: no switch within a block."""
    rnd = random.Random(11)
    truth = [rnd.randrange(2) for _ in range(200)]
    calls = []
    for r in range(1500):
        side, first = rnd.randrange(2), rnd.randrange(196)
        if 96 <= first < 100:
            continue  # nothing joins the sites before and after 99
        calls += [(r, "c", 10 * k, (truth[k] ^ side) ^ (rnd.random() < 0.03)) for k in range(first, first + 5) if rnd.random() < 0.9]
    calls += [(9000, "c", 5, 0), (9000, "c", 5, 1), (9001, "c", None, 1), (9002, "c", 70, 2), (9003, None, 70, 1), (9004, "lone", 3, 1)]
    df = spark.createDataFrame([(r, c, p, int(a)) for r, c, p, a in calls], "read long, chrom string, pos long, allele int")
    alleles = phasing.site_alleles(df)
    found = phasing.phase(alleles, 5)
    rows = sorted(found.where("chrom = 'c'").collect(), key=lambda r: r.site)
    assert len(rows) == 200 and [r.block for r in rows] == [1] * 100 + [2] * 100
    flips = [r.haplotype ^ t for r, t in zip(rows, truth, strict=True)]
    switches = sum(a != b for part in (flips[:100], flips[100:]) for a, b in itertools.pairwise(part))
    assert switches == 0
    assert [tuple(r) for r in found.where("chrom = 'lone'").collect()] == [("lone", 1, 1, 0)]
    phased = phasing.assign_reads(alleles, found)
    assert phased.where("phase is null").count() < 0.02 * phased.count()
    assert phasing.phase(phasing.site_alleles(df.limit(0))).collect() == []


def plain_states(kind, emission, transition):
    f, back = [0, 0], []
    for c in kind:
        new, came = [], []
        for s in (0, 1):
            a, b = f[0] + transition[0][s], f[1] + transition[1][s]
            came.append(0 if a > b else 1)
            new.append(max(a, b) + emission[s][c])
        f = new
        back.append(came)
    s, out = (0 if f[0] > f[1] else 1), []
    for came in reversed(back):
        out.append(s)
        s = came[s]
    return out[::-1]


@pytest.mark.parametrize("bin_size", [1, 7, 1000])
def test_targets_beside_one_pass(spark, bin_size):
    rnd = random.Random(bin_size)
    rows, want = [], []
    for chrom in range(12):
        kind = []
        for _ in range(rnd.randrange(1, 12)):
            kind += rnd.choices([0, 1, 2], rnd.choice([(9, 1, 0), (1, 1, 3), (3, 3, 1)]), k=rnd.randrange(1, 15))
        while kind and kind[-1] == 0:
            kind.pop()
        rows += [(str(chrom), p, k) for p, k in enumerate(kind, 1) if k] + [(str(chrom), p, 1) for p, k in enumerate(kind, 1) if k == 2]
        state = plain_states(kind, ((0, 0, 0), (-2, 1, 2)), ((0, -5), (-1, 0)))
        for s, group in itertools.groupby(enumerate(state, 1), key=lambda x: x[1]):
            own = [p for p, _ in group]
            want += [(str(chrom), own[0], own[-1])] if s else []
    df = spark.createDataFrame(rows + [(None, 3, 2), ("0", None, 2), ("0", -4, 2)], "chrom string, pos long, kind int")
    got = targets.target_regions(df, ((0, 0, 0), (-2, 1, 2)), ((0, -5), (-1, 0)), bin_size)
    assert sorted((r.chrom, r.start, r.end) for r in got.collect()) == sorted(want)


def test_target_bins_are_worked_on_in_batches(spark):
    df = spark.range(40).selectExpr("cast(id % 20 as string) AS chrom", "id * 7 + 1 AS pos", "2 AS kind")
    got = targets.target_regions(df, ((0, 0, 0), (-2, 1, 2)), ((0, -5), (-1, 0)), 8)
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    whole = targets.target_regions(df, ((0, 0, 0), (-2, 1, 2)), ((0, -5), (-1, 0)), 1 << 12)
    assert got.collect() and {tuple(r) for r in got.collect()} == {tuple(r) for r in whole.collect()}
