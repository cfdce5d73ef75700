import re

import numpy as np
import pytest
import xxhash

from lumenfold.llm import simhash
from lumenfold.llm.graph import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "a b c", "A b\tc\nd É e", "x " * 500])
def test_fingerprint(text):
    assert simhash.majority(simhash.shingle_hashes(text)) == plain_fingerprint(text)


@pytest.mark.parametrize("tile,refine", [(4096, 65536), (8, 65536), (8, 20), (4096, 4)])
def test_links_keep_components(spark, tile, refine):
    """Random fingerprints, a dense ball and a chain, through single tiles, tile pairs and second bands."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    centre = int(rng.integers(0, 2**63))
    fps += [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))]
    chain = int(rng.integers(0, 2**63))
    for k in range(0, 60, 3):
        chain ^= 7 << k
        fps.append(chain)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile, refine=refine).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3 for r in found)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(found or [(0, 0)], "a long, b long")).collect()}
    expected = plain_components(fps)
    unsigned = lambda x: x & (2**64 - 1)
    group = lambda roots: sorted(sorted(unsigned(k) for k in roots if roots[k] == r) for r in set(roots.values()))
    assert [g for g in group(got) if len(g) > 1] == [g for g in group(expected) if len(g) > 1]


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " tail"), (1, "other text here"), (2, "")]
    out = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in out.items()} == {i: plain_fingerprint(t) for i, t in rows}
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        least[roots[plain_fingerprint(t)]] = min(i, least.get(roots[plain_fingerprint(t)], 99))
    assert {k: v[1] for k, v in out.items()} == {i: least[roots[plain_fingerprint(t)]] for i, t in rows}


def test_components_of_a_star_and_a_path(spark):
    links = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{1000 + i: 1000 for i in range(61)}}


@pytest.mark.parametrize("radius,tile", [(7, 4096), (7, 8), (12, 16)])
def test_links_of_other_radii(spark, radius, tile):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in range(2, 16) for _ in range(6)})
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), radius=radius, tile=tile).collect()
    got = {frozenset((r["a"] & (2**64 - 1), r["b"] & (2**64 - 1))) for r in found}
    assert all((max(p) ^ min(p)).bit_count() <= radius for p in got)
    roots = {f: f for f in fps}
    for p in got:
        a, b = (roots[x] for x in p)
        roots = {f: a if r == b else r for f, r in roots.items()}
    expected = plain_components(fps, radius)
    assert all((roots[x] == roots[y]) == (expected[x] == expected[y]) for x in fps for y in fps)


def test_stage_against_all_pairs(spark):
    """Near copies by exact Jaccard of five-word shingles; most of these pairs differ by more than three bits."""
    rng, rows = np.random.default_rng(8), []
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 4000, 300)]
        for _ in range(4):
            own = list(words)
            for at in rng.integers(0, 300, int(rng.integers(0, 10))):
                own[at] = f"v{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(100, ""), (101, None), (102, "one two"), (103, "ONE two"), (104, "one two three")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    root = {i: i for i, _ in rows}
    far = 0
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and (x == y or len(x & y) >= 0.8 * len(x | y)):
                fps = [simhash.majority(simhash.shingle_hashes(dict(rows)[k])) for k in (i, j)]
                far += (fps[0] ^ fps[1]).bit_count() > 3
                root = {k: root[i] if r == root[j] else r for k, r in root.items()}
    assert far > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.simhash_stage(spark, docs, "").collect()}
    assert kept == {min(k for k in root if root[k] == r) for r in set(root.values())}
