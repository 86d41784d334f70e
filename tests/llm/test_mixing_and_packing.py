"""Mixing, packing and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folioforge.llm import mixing, packing


def plain_targets(sizes):
    """Sources in order with their sizes: shares by weight 1, 2, 3, at most three times each."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 3 * sizes[s] for s in above}
        open_ -= above
        if not open_:
            return target


def test_mixing(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for s, n in (("b", 700), ("a", 40), (None, 20), ("é", 30), ("Z", 15), ("", 5)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randrange(1, 60)), s) for i in range(n)]
    rows += [(9000, None, "a"), (9001, "", "empty"), (None, "x y", "a")] + [(1, "same words here", "b")] * 200
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    ordered = {s: sizes[s] for s in sorted((s for s in sizes if s is not None))} | {None: sizes[None]}
    targets, taken, largest = plain_targets(ordered), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 3 * largest[s]
    again = Counter((r["doc_id"], r["size"], r["copies"]) for r in mixing.copies(docs).collect())
    assert again == Counter((r["doc_id"], r["size"], r["copies"]) for r in got)
    mixed = Counter(tuple(r) for r in mixing.mix(docs).collect())
    assert sum(mixed.values()) == sum(r["copies"] for r in got)
    assert sum(len((t or "").split()) * n for (_, t, _), n in mixed.items()) == sum(taken.values())


def test_mixing_odd_rows(odd, odd_rows, none):
    assert Counter(r["doc_id"] for r in mixing.copies(odd).collect()) == Counter(r[0] for r in odd_rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.copies(none).count() == mixing.mix(none).count() == 0


def check_packing(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing(odd, odd_rows, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in odd_rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 or min(len(ids), 64)
        starts = [0, *range(first, len(ids), 64)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[(r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = packing.packed(odd, capacity=64, keep_ids=True)
    rows = got.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    n = check_packing(rows, 64)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 64) + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(got).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"] :].startswith(r["ids"])
    assert packing.packed(none).count() == 0


def test_ids_are_those_of_the_unmodified_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._encoder(packing.TOKENIZER)
    end = "<|endoftext|>"
    assert tokenizer.encode(f"abc {end} def", add_special_tokens=False).ids == [39305, 220, 50256, 825]
    for text in (f"{end} a", f"abc {end} def", f"a\n{end}", end * 3, f" {end} {end[:-1]} {end.upper()}", "x " * 2046 + end + " y" * 3000, end * 5000, " " * 5000 + end, " " * 5000, "  x​", "a" * 30_000, "日本語𝄞\u0000", "I'm we'LL 1234567"):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array([*ids, 0], "<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = [64, 2048, 2048, 7][seed]
    lengths = np.minimum(rng.geometric([0.05, 0.002, 0.01, 0.3][seed], [500, 20_000, 300, 50][seed]), capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    used = np.zeros_like(counts)
    made = packing.plan(counts)
    for times, parts in made:
        assert times > 0 and sum(parts) <= capacity
        np.add.at(used, parts, times)
    assert (used == counts).all()
    bound = math.ceil(lengths.sum() / capacity)
    assert sum(t for t, _ in made) <= bound * 1.02 + 2
    assert packing.plan(np.zeros(capacity + 1, int)) == []


def test_special_token_around_cuts(spark, tmp_path):
    """Cuts fall before, at and after the added token, which stays one id."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" x" * (2047 + d) + "<|endoftext|>" + " y" * 2048 for d in (-2, -1, 0, 1)] + ["<|endoftext|>"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = defaultdict(list)
    for r in packing.packed(spark.read.parquet(path)).collect():
        got[r["doc_id"]].append((r["piece"], r["length"], r["ids_crc32"]))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert ids.count(50256) == 1
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [(0, first)] + [(a, a + 2048) for a in range(first, len(ids), 2048)]
        want = [(n, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(cuts)]
        assert sorted(got[i]) == want


def test_patterns_of_every_residue():
    """Three lengths that only fill a sequence together, whatever they are modulo 8."""
    for a, b in [(700, 701), (681, 682), (3, 1001), (500, 777), (6, 7)]:
        counts = np.zeros(2049, int)
        for n in (a, b, 2048 - a - b):
            counts[n] += 1000
        made = packing.plan(counts)
        assert sum(t for t, _ in made) == 1000, (a, b, made[:3])


def test_pack_wants_pieces_that_fit(spark):
    df = spark.createDataFrame([(1, 9)], "piece int, length long")
    with pytest.raises(ValueError):
        packing.pack(df, ["piece"], 8)


def test_pipeline(spark, tmp_path):
    """Every stage against what it has to do, on its own input."""
    rng = random.Random(12)
    vocabulary = ["the", "of", "and", "to", "in"] * 30 + [f"word{i}" for i in range(900)]
    rows, kinds = [], {}

    def add(text, kind, source="a"):
        kinds[len(rows)] = kind
        rows.append((len(rows), text, "en", source, len(text or "")))

    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(120)]
        add(" ".join(base), "clean", "ab"[i % 2])
        if i % 4 == 0:
            add(rows[-1][1], "copy")
        if i % 5 == 0:
            base[60] = "changed"
            add(" ".join(base), "near")
    add(None, "bad")
    add("$$$ ### " * 100, "bad")
    add("too short", "bad")
    folder = tmp_path / "documents.parquet"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(folder))
    docs, seen = spark.read.parquet(str(folder)), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name.replace(" ", ""))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append(docs.collect())
        if name != "packing":
            assert docs.columns == before.columns
    ids = [[r["doc_id"] for r in s] for s in seen]
    assert set(ids[0]) == {i for i, k in kinds.items() if k != "bad"}
    by_text = defaultdict(list)
    for i in ids[0]:
        by_text[rows[i][1]].append(i)
    assert sorted(ids[1]) == sorted(max(v) for v in by_text.values())
    assert len(ids[2]) == 40
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 3
    assert Counter(r["doc_id"] for r in seen[4] if r["piece"] == 0) == Counter(ids[3])
    check_packing(seen[4], packing.CAPACITY)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
