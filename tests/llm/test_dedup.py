"""Exact dedup, near-dedup, line dedup: brute force, edge cases, collisions, very common values."""

import hashlib
import random
import re
from collections import defaultdict

import edge
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rulewright.llm import components, exact_dedup, line_dedup, near_copies, near_tree, simhash_vptree as sv

WS = " \t\n\x0b\x0c\r"


def brute_exact(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(f"[{WS}]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, i))
    return groups


def check_exact(rows, out):
    groups = brute_exact(rows)
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(groups)
    by = defaultdict(list)
    for r in out:
        by[r.text_sha256].append(r)
    for text, members in groups.items():
        got = by[hashlib.sha256(text.encode()).hexdigest()]
        best = min(members)
        assert {r.group_size for r in got} == {len(members)} and len(got) == len(members)
        assert {r.keep_id for r in got} == {None if best[1] else best[2]}
        assert [r.doc_id for r in got if r.kept] == [None if best[1] else best[2]]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.crc32(c.cast("binary")) % 3])
def test_exact_with_sound_and_colliding_digests(spark, digest):
    df = edge.docs(spark, [(20 + i, "copy  of a text" + " " * (i % 3), "en", "hot") for i in range(40)])
    check_exact(df.collect(), exact_dedup.dedup_exact(spark, df, digest).collect())


def test_exact_over_many_micro_batches(spark):
    df = edge.docs(spark).repartition(6)
    a = exact_dedup.dedup_exact(spark, df, files_per_trigger=1)
    check_exact(df.collect(), a.collect())


@pytest.mark.parametrize("weak", [False, True])
def test_crawls_go_on_from_kept_state(spark, tmp_path, weak):
    import zlib

    digest = (lambda c: F.crc32(c.cast("binary")) % 3) if weak else exact_dedup.sha256_hex
    state, seen = f"file://{tmp_path}/state", []
    crawls = [edge.docs(spark), edge.docs(spark, [(30 + i, "copy  of a text" + " " * (i % 3), "en", "hot") for i in range(9)]), edge.empty(spark), edge.docs(spark, [(50, "same  same ", "en", "x"), (51, "new", "en", "x"), (52, "copy of a text", "en", "x")]).filter("doc_id >= 50")]
    for k, df in enumerate(crawls):
        path = f"file://{tmp_path}/crawl {k}"
        df.repartition(2).write.parquet(path)
        new = spark.read.parquet(path).collect()
        seen += new
        norm = lambda t: re.sub(f"[{WS}]", "", t or "")
        key = (lambda t: zlib.crc32(norm(t).encode()) % 3) if weak else norm
        touched = {key(r.text) for r in new}
        for _ in range(2 if k == 1 else 1):
            check_exact([r for r in seen if key(r.text) in touched], exact_dedup.dedup_crawl(spark, path, state, digest).collect())


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """A crawl whose stream fails after it has been added is finished by the next call."""
    state, path = f"file://{tmp_path}/state", f"file://{tmp_path}/c"
    edge.docs(spark).repartition(4).write.parquet(path)
    want, real = edge.docs(spark).collect(), exact_dedup.stream_state
    try:
        exact_dedup.stream_state = lambda *a, **k: 1 / 0
        with pytest.raises(ZeroDivisionError):
            exact_dedup.dedup_crawl(spark, path, state)
    finally:
        exact_dedup.stream_state = real
    check_exact(want, exact_dedup.dedup_crawl(spark, path, state, files_per_trigger=1).collect())


def test_exact_keeps_columns_and_empty_tables(spark):
    kept = exact_dedup.keep_first_copies(spark, edge.docs(spark))
    assert kept.columns == edge.docs(spark).columns
    assert kept.count() == len(brute_exact(edge.docs(spark).collect()))
    assert exact_dedup.dedup_exact(spark, edge.empty(spark)).count() == 0


def brute_fingerprint(text):
    w = [x for x in re.split(f"[{WS}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, near):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def check_simhash(rows, out):
    fps = [brute_fingerprint(r.text) for r in rows]
    root = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: None)
    for k, r in zip(root, rows, strict=True):
        ids = [x for x in (least[k], r.doc_id) if x is not None]
        least[k] = min(ids, default=None)
    want = sorted(repr((r.doc_id, f"{f:016x}", least[k])) for r, f, k in zip(rows, fps, root, strict=True))
    assert want == sorted(repr((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id)) for r in out)


def test_simhash_edges(spark):
    df = edge.docs(spark)
    check_simhash(df.collect(), sv.simhash_groups(df).collect())
    assert sv.simhash_groups(edge.empty(spark)).count() == 0
    assert sv.keep_one_of_each_group(edge.empty(spark)).count() == 0
    kept = sv.keep_one_of_each_group(df)
    assert kept.columns == df.columns and kept.filter("doc_id = 7").count() == 1


def test_simhash_of_real_documents(spark, sf_dir):
    df = edge.real(spark, sf_dir)
    check_simhash(df.collect(), sv.simhash_groups(df).collect())


def balls(seed, n, spread):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in set(rng.integers(0, 64, int(rng.integers(1, spread))).tolist()))) for b in base for _ in range(8)]
    return np.unique(np.concatenate([base, np.array(near, np.uint64)]))


def test_trees_find_every_pair():
    points = balls(1, 120, 5)
    want = sv._Clusters(len(points))
    want.join(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3))
    assert (sv.shard_clusters(points, points[:0], leaf=8, block=16) == want.label).all()
    for depth in (1, 3, 5):
        shard, ix, home = sv.route(points, sv.top_tree(points[::3], depth))
        assert np.bincount(ix[home], minlength=len(points)).tolist() == [1] * len(points)
        got = sv._Clusters(len(points))
        for s in np.unique(shard):
            h, g = ix[(shard == s) & home], ix[(shard == s) & ~home]
            label = sv.shard_clusters(points[h], points[g], leaf=8)
            both = np.concatenate([h, g])
            got.join(both, both[label])
        assert (got.label == want.label).all()


def test_points_at_one_distance_are_one_leaf():
    points = np.array([1 << i for i in range(64)], np.uint64)
    assert len(set(sv.shard_clusters(points, points[:0], leaf=4).tolist())) == 1


def test_links_through_many_shards(spark):
    points = balls(2, 150, 5)
    fps = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    stars = {r.u: r.v for r in components.components(sv.near_links(fps, sample=256, per_shard=64)).collect()}
    root = brute_components(points.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    signed = points.view(np.int64).tolist()
    groups = defaultdict(list)
    for k, x in zip(root, signed, strict=True):
        groups[k].append(x)
    for members in groups.values():
        assert {stars.get(x, x) for x in members} == {min(members)}


def test_components_of_long_paths(spark):
    path = [(i + 1, i) for i in range(70)] + [(100, 99), (5, 2)]
    random.Random(3).shuffle(path)
    out = components.components(spark.createDataFrame(path, "u long, v long")).collect()
    assert {(r.u, r.v) for r in out} == {*((i, 0) for i in range(1, 71)), (100, 99)}


def brute_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WS))
    docs = defaultdict(set)
    ident = lambda r: 2**63 - 1 if r.doc_id is None else r.doc_id
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 10:
                docs[key(line)].add(ident(r))
    keep = lambda r, line: len(docs.get(key(line), ())) < 2 or min(docs[key(line)]) == ident(r)
    return [(r.doc_id, len((r.text or "").split("\n")), [x for x in (r.text or "").split("\n") if keep(r, x)]) for r in rows]


@pytest.mark.parametrize("per_copy", [16_384, 3])
def test_lines(spark, monkeypatch, per_copy):
    monkeypatch.setattr(line_dedup, "PER_COPY", per_copy)
    extra = [(100 + i, f"Shared LINE of text \r\nonly {i} here\n\nshared line of text\n{'x' * i}", "en", "s") for i in range(30)]
    df = edge.docs(spark, extra)
    want = sorted(repr((i, n, n - len(kept), "\n".join(kept))) for i, n, kept in brute_lines(df.collect()))
    assert want == sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept)) for r in line_dedup.dedup_lines(df).collect())
    assert line_dedup.dedup_lines(edge.empty(spark)).count() == 0
    assert line_dedup.dedup_lines(df, min_copies=20).filter("n_dropped > 0").count() == sum(n > len(k) for _, n, k in brute_lines([r for r in df.collect() if "shared line" in (r.text or "").lower()]))


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        h = line_dedup.PerfectHash.build(keys)
        assert sorted(h(keys).tolist()) == list(range(len(keys)))


def test_index_survives_bytes_and_rejects_strangers():
    rng = np.random.default_rng(5)
    h1, h2 = rng.integers(0, 2**64, 1000, dtype=np.uint64), rng.integers(0, 2**64, 1000, dtype=np.uint64)
    index = line_dedup.LineIndex.from_bytes(line_dedup.LineIndex.build(h1, h2, np.arange(1000) + 2, np.arange(1000)).to_bytes())
    assert not index.elsewhere(h1, h2, np.arange(1000)).any()
    assert index.elsewhere(h1, h2, np.arange(1000) + 1).all()
    assert not index.elsewhere(h2, h1, np.arange(1000) + 1).any()
    assert (index.elsewhere(h1, h2, np.arange(1000) + 1, 500) == (np.arange(1000) + 2 >= 500)).all()


# Near copies by wide fingerprints.
def brute_sketch(text):
    """The 256 bits and the keys of the bands, with plain integers."""
    def stir(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD % 2**64
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
        return x ^ x >> 33

    w = [x for x in re.split(f"[{WS}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    h = {xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, len(w) - 4))}
    wide = [sum(stir((x + (k + 1) * 0x9E3779B97F4A7C15) % 2**64) << 64 * k for k in range(4)) for x in h]
    bits = sum(1 << b for b in range(256) if 2 * sum(x >> b & 1 for x in wide) > len(h))
    odd = near_copies._ODD.tolist()
    least = [stir((min((x * a + b) % 2**64 for x in h) + k) % 2**64) for k, (a, b) in enumerate(zip(*odd, strict=True))]
    return bits, {stir((sum(least[5 * t : 5 * t + 5]) + t) % 2**64) for t in range(16)}


def brute_near_copies(rows):
    """The smallest id of each group."""
    sketches = [brute_sketch(r.text) for r in rows]
    root = brute_components(sketches, lambda a, b: (a[0] ^ b[0]).bit_count() <= 48 and not a[1].isdisjoint(b[1]))
    groups = defaultdict(set)
    for k, r in zip(root, rows, strict=True):
        groups[k].add(r.doc_id)
    return {min(g, key=lambda x: (x is None, x)) for g in groups.values()}


def prose(seed, n=300):
    rng = random.Random(seed)
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(words, edits, seed):
    out, rng = list(words), random.Random(seed)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("chunk", [4096, 7])
def test_near_copies_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies.near_links, "__defaults__", (near_copies.RADIUS, chunk))
    shared = prose(99, 250)
    texts = [prose(k) for k in range(6)]
    texts += [edited(prose(0), 4, s) for s in range(40)] + [edited(prose(1), 14, s) for s in range(20)]
    texts += [shared + prose(200 + k, 40) for k in range(12)] + [edited(shared + prose(200, 40), 3, s) for s in range(12)]
    df = edge.docs(spark, [(1000 + k, " ".join(t), "en", "z") for k, t in enumerate(texts)])
    kept = near_copies.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == brute_near_copies(df.collect())
    assert near_copies.keep_one_of_each_group(edge.empty(spark)).count() == 0


def test_near_copies_of_similarity_are_caught(spark):
    """Pairs of a Jaccard similarity of 0.8 to 0.85, and others under 0.4."""
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, close = [], 0
    for k in range(120):
        base = prose(5000 + k)
        other = next(t for s in range(99) if 0.8 <= jaccard(sets(base), sets(t := edited(base, 7, s))) <= 0.85)
        far = next(t for s in range(99) if jaccard(sets(base), sets(t := edited(base, 45, s))) < 0.4)
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(other)), (3 * k + 2, " ".join(far))]
    rep = {r.doc_id: r.rep for r in near_copies.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = sum(rep[3 * k] == rep[3 * k + 1] for k in range(120))
    assert close >= 0.93 * 120 and all(rep[3 * k] != rep[3 * k + 2] for k in range(120))


def test_wide_trees_find_every_pair():
    """Whole clusters of 256-bit points: dealt to shards, and inside one, at a radius that prunes and at the stage's own."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, (60, 4), dtype=np.uint64)
    fps = np.repeat(centres, 40, axis=0)
    for _ in range(16):
        fps[np.arange(len(fps)), rng.integers(0, 4, len(fps))] ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
    for radius in (6, near_copies.RADIUS):
        d = sum(np.bitwise_count(fps[:, k][:, None] ^ fps[:, k][None, :]).astype(int) for k in range(4))
        links = {(a, b) for a, b in zip(*np.nonzero(d <= radius), strict=True) if a < b}
        shard, ix, home = sv.route(fps, sv.top_tree(fps[::3], 4), radius)
        homes = dict(zip(ix[home].tolist(), shard[home].tolist(), strict=True))
        places = set(zip(shard.tolist(), ix.tolist(), strict=True))
        assert len(homes) == int(home.sum()) == len(fps)
        assert all((homes[a], b) in places or (homes[b], a) in places for a, b in links)
        found = sv._Clusters(len(fps))
        near_tree.tree_links(fps.T.copy(), np.arange(1500), np.arange(1500, len(fps)), True, found, radius, leaf=16)
        root = list(range(len(fps)))
        for a, b in sorted(links):
            if a < 1500 and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        assert found.label.tolist() == root


@pytest.mark.parametrize(("per_shard", "chunk"), [(8192, 32768), (8, 5)])
def test_no_link_of_near_copies_is_lost(spark, monkeypatch, per_shard, chunk):
    """Links within the radius hold whatever else two texts share: some of these have no min-hash band in common."""
    monkeypatch.setattr(near_tree, "PER_SHARD", per_shard)
    monkeypatch.setattr(near_tree, "MAX_CHUNKS", 10**6)
    monkeypatch.setattr(near_tree.near_links, "__defaults__", (near_copies.RADIUS, chunk))
    texts, apart = [], 0
    for k in range(120):
        base = prose(9000 + k)
        other = edited(base, 11, k)
        a, b = brute_sketch(" ".join(base)), brute_sketch(" ".join(other))
        apart += (a[0] ^ b[0]).bit_count() <= 48 and a[1].isdisjoint(b[1])
        texts += [base, other]
    assert apart > 0
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(None, None), (1000, ""), (1001, " ")]
    root = brute_components([brute_sketch(t)[0] for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 48)
    want = defaultdict(set)
    for k, (i, _) in zip(root, rows, strict=True):
        want[k].add(i)
    got = defaultdict(set)
    for r in near_tree.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.rep].add(r.doc_id)
    assert {frozenset(g) for g in want.values()} == {frozenset(g) for g in got.values()}
