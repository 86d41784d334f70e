"""Exact, near and passage duplicates."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from folioforge.llm import block_naming, simhash, suffix_dedup
from folioforge.llm.components import components


def test_exact_duplicates(odd, odd_rows, none):
    got = block_naming.exact_duplicates(odd, block_bytes=16).collect()
    groups = defaultdict(list)
    for r in odd_rows:
        groups[r[1] or ""].append(r[0])
    size = {hashlib.sha256(t.encode()).hexdigest(): len(ids) for t, ids in groups.items()}
    keep = {
        hashlib.sha256(t.encode()).hexdigest(): max((i for i in ids if i is not None), default=None)
        for t, ids in groups.items()
    }
    assert len(got) == len(odd_rows)
    for r in got:
        assert r["group_size"] == size[r["text_sha256"]] and r["keep_id"] == keep[r["text_sha256"]]
    # One row stays of each text, also where the largest id is there twice.
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(size.keys())
    assert block_naming.exact_duplicates(none).count() == 0


def test_exact_duplicates_by_block_size(spark):
    """Texts that differ in their last block, in their length or at a block's edge."""
    texts = ["a" * n for n in range(0, 70, 7)] + ["a" * 63 + "b", "a" * 16 + "b" * 16, "b" * 16 + "a" * 16]
    rows = [(i, t) for i, t in enumerate(texts * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = block_naming.exact_duplicates(df, block_bytes=16)
    assert {r["group_size"] for r in got.collect()} == {40}
    kept = block_naming.drop_copies(df, block_bytes=16)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r["text"] for r in kept.collect()) == sorted(texts)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    edges += [(300, 300), (7, 3)]
    parent = list(range(301))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, odd_rows, none):
    got = Counter((r["doc_id"], r["fingerprint"]) for r in simhash.linked(odd).collect())
    assert got == Counter((r[0], f"{plain_fingerprint(r[1]):016x}") for r in odd_rows if r[0] != 8) + Counter(
        {x: n for x, n in got.items() if x[0] == 8}
    )
    assert simhash.fingerprint("") == 0 and simhash.fingerprint("A b") == plain_fingerprint("a b")
    rows = {r["doc_id"]: r["component_id"] for r in simhash.linked(odd).collect()}
    assert rows[1] == rows[2] == 1 and rows[4] == rows[3] == rows[5] == 3
    assert simhash.linked(none).count() == 0


@pytest.mark.parametrize("bits", [1, 2])
def test_links_reach_all_close_fingerprints(spark, bits):
    """Dense balls overflow their buckets; sparse ones don't."""
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        center = rng.getrandbits(64)
        for _ in range(150):
            x = center
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    found = simhash.links(df, bits).collect()
    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= bits
    roots = {r["node"] % 2**64: r["root"] for r in components(simhash.links(df, bits)).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits and find(a) != find(b):
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    ours = defaultdict(set)
    for v in values:
        groups[find(v)].add(v)
        ours[roots.get(v, ("alone", v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_near_duplicates(spark, odd, none, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows, want = [], []
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((len(rows), " ".join(base)))
        want.append(len(rows) - 1)
        for _ in range(g % 4):
            copy = list(base)
            for _ in range(4):  # J = 0.87 and more
                copy[rng.randrange(300)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
        far = list(base)
        for i in range(0, 300, 20):  # well below 0.8
            far[i] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(far)))
        want.append(len(rows) - 1)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    kept = simhash.drop_near_duplicates(spark.read.parquet(path))
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert simhash.drop_near_duplicates(none).count() == 0
    left = Counter(r["doc_id"] for r in simhash.drop_near_duplicates(odd).collect())
    # Texts without words stay, one of the copies of the first text stays.
    assert left[3] == left[4] == left[5] == 1 and left[1] + left[2] + left[6] == 1


def stretched(seed, kind):
    """A text and a copy edited in one stretch, Jaccard similarity 0.8 to 0.85."""
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(3000)]

    def draw(n):
        return rng.choices([f"z{k}" for k in range(3000)], weights, k=n)

    base = draw(rng.randrange(100, 500))
    n = len(base)
    if kind == "append":
        return " ".join(base), " ".join(base + draw(int(n * 0.235)))
    if kind == "cut":
        return " ".join(base), " ".join(base[: n - int(n * 0.185)])
    return " ".join(base), " ".join(base[: n - int(n * 0.1)] + draw(int(n * 0.1)))


def kept_of(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    return sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.read.parquet(path)).collect())


def test_near_duplicates_by_stretches(spark, tmp_path):
    """Appended, cut and replaced stretches: no pair is missed, whatever its fingerprints."""
    texts = [t for kind in ("append", "cut", "replace") for seed in range(40) for t in stretched(seed, kind)]
    # Kinds have the same seeds, so three copies of each first text.
    assert kept_of(spark, str(tmp_path / "d.parquet"), texts) == list(range(0, 80, 2))


def test_near_duplicates_of_a_template(spark, tmp_path):
    """Pairs of copies among many texts that share half their words, so that buckets are large."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for g in range(150):
        own = [f"g{g}w{i}" for i in range(30)]
        mixed = [w for i, t in enumerate(template) for w in ([t, own[i // 2]] if i % 2 else [t])]
        texts.append(" ".join(mixed))
    shared = [f"s{i}" for i in range(200)]
    for g in range(150):
        base = shared + [f"h{g}w{i}" for i in range(64)]
        copy = base[:-20] + [f"c{g}w{i}" for i in range(20)]
        texts += [" ".join(base), " ".join(copy)]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    want = [i for i, r in enumerate(root) if i == r]
    assert len(want) == 300
    assert kept_of(spark, str(tmp_path / "d.parquet"), texts) == want


def test_close_fingerprints_meet_first(spark, monkeypatch, tmp_path):
    """Near duplicates go by fingerprints first, through the blocks that ``links`` joins on."""
    rng = random.Random(4)
    base = [f"k{i}" for i in range(600)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[1:]), " ".join(base)]
    texts += [" ".join(rng.choices(base, k=50)) for _ in range(20)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    met = components(simhash._close_rows(simhash._worded(docs))).collect()
    fp = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and (fp[a] ^ fp[b]).bit_count() <= 2:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    of = {r["node"]: r["root"] for r in met}
    assert root[:4] != [0, 1, 2, 3] and [of.get(i, i) for i in range(len(texts))] == root
    asked = []
    close = simhash._close_rows
    monkeypatch.setattr(simhash, "_close_rows", lambda *a: asked.append(1) or close(*a))
    assert simhash.drop_near_duplicates(docs).count() == 21 and asked


def test_pairs_of_a_large_group(spark, monkeypatch, tmp_path):
    """Edited copies of one text, about half of the pairs similar: their pairs used to grow with
    the square of the group."""
    rng = random.Random(9)
    base = [f"m{i}" for i in range(250)]
    texts = []
    for g in range(120):
        copy = list(base)
        for i in rng.sample(range(250), rng.choice([2, 4, 9])):
            copy[i] = f"e{g}x{i}"
        texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root, similar = list(range(120)), 0
    for b in range(120):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                similar += 1
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert 1000 < similar < 6000
    made, cut = [], simhash.cut_lineage

    def counted(df, name):
        out = cut(df, name)
        made.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(simhash, "cut_lineage", counted)
    assert kept_of(spark, str(tmp_path / "d.parquet"), texts) == [i for i, r in enumerate(root) if i == r]
    assert sum(made) < 120 * 15


def test_pairs_meet_once(spark, tmp_path):
    """Two rows that share many shingles used to be a row of the join for each of them."""
    shared = 40
    rows = [(t, r, 300, t, r) for t in range(shared) for r in (1, 2)]
    rows += [(100 + t, r, 300, t, r) for t in range(3) for r in (2, 3)]
    open_ = spark.createDataFrame(rows, "token long, _row long, size int, place int, root long")
    same = [0] * simhash.PARITY_LONGS
    parities = spark.createDataFrame([(r, same) for r in (1, 2, 3)], "_row long, parities array<long>")
    pairs = simhash._all_pairs(open_, parities, 0.8)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (2, 3)]
    plan = pairs._jdf.queryExecution().executedPlan()
    made, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if re.search("HashJoin|SortMergeJoin", name) and "ea#" in node.simpleString(1000):
            made.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert made == [2]


def test_stars_are_those_that_may_be_similar(spark):
    """Rows that share a shingle but are too unlike in size or parities were compared as sets."""
    star = "struct<by:long,row:long,root:long,size:int,place:int>"
    one = [(0, 1, 1, 300, 0)]
    rows = [(2, 2, 300, 0, one), (3, 3, 100, 0, one), (4, 4, 300, 0, one), (5, 1, 300, 0, one)]
    open_ = spark.createDataFrame(rows, f"_row long, root long, size int, place int, stars array<{star}>")
    same, other = [0] * simhash.PARITY_LONGS, [-1] * simhash.PARITY_LONGS
    of = [(1, same), (2, same), (3, same), (4, other), (5, same)]
    parities = spark.createDataFrame(of, "_row long, parities array<long>")
    assert [tuple(r) for r in simhash._stars(open_, parities, 0.8).collect()] == [(1, 2)]


def test_parities_lose_no_similar_pair():
    rng = np.random.default_rng(1)
    for n in (5, 60, 900, 5000):
        whole = np.unique(rng.integers(0, 1 << 32, 2 * n, dtype=np.uint64).astype(np.uint32))
        for share in (0.5, 0.8, 0.95):
            a, b = whole[: int(len(whole) * (1 + share) / 2)], whole[int(len(whole) * (1 - share) / 2) :]
            odd = sum(int(x).bit_count() for x in (simhash._parities(a) ^ simhash._parities(b)).view(np.uint64))
            assert odd <= len(np.setxor1d(a, b))


def plain_cleaned(texts):
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if often[d[i : i + 200]] > 1:
                hit[i : i + 200] = True
        kept = bytes(b for b, h in zip(d, hit, strict=False) if not h)
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((len(d), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_passages(spark):
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choice("abcdefghij é") for _ in range(n))

    passages = [noise(n) for n in (199, 200, 201, 260, 330, 450, 900)]
    texts = []
    for k in range(60):
        p = rng.choice(passages)
        cut = p[rng.randrange(30) : len(p) - rng.randrange(30)]
        texts.append(noise(rng.randrange(250)) + rng.choice([p, cut]) + noise(rng.randrange(250)))
    texts += [None, "", "x" * 199, "y" * 200, "z" * 201, "q" * 5000, "ab" * 700, "is onhe. " * 100 + noise(50)]
    texts += [texts[3], texts[3], passages[6] + passages[6], passages[5][100:] + passages[5][:350]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in suffix_dedup.cleaned(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_cleaned(texts)


def test_passages_of_odd_rows(odd, odd_rows, none):
    got = suffix_dedup.cleaned(odd, keep_text=True).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((r[0], len((r[1] or "").encode())) for r in odd_rows)
    for r in got:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])
    assert suffix_dedup.cleaned(none).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(2)
    items = [
        (bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))), b"", i, i, 1) for i in range(500)
    ]
    for k in (1, 2, 3, 7):
        runs = [suffix_dedup.front_coded(sorted(items[i::k])) for i in range(k)]
        out = list(suffix_dedup.merged(runs))
        strings = [x[0] for _, x in out]
        assert strings == sorted(x[0] for x in items)
        assert sorted(x[2] for _, x in out) == list(range(500))
        for (_, a), (shared, b) in zip(out, out[1:], strict=False):
            n = 0
            while n < min(len(a[0]), len(b[0])) and a[0][n] == b[0][n]:
                n += 1
            assert shared == n


def test_long_text_in_slices(monkeypatch):
    data = bytes(random.Random(1).choices(b"abcdef", k=5000)) + b"ab" * 600
    whole = suffix_dedup.suffix_places(data)
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    assert suffix_dedup.suffix_places(data) == whole
