"""Language models and boosted trees."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from folioforge.llm import boosted_quality, language_id
from folioforge.llm.rows import held_out


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in [*range(40), -7, None]], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", held_out(df["doc_id"])).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in got}


def corpus(rng, n):
    """Two languages of syllables that overlap in part."""
    kinds = {"aa": ["ba", "lo", "mi", "ra", "tu"], "bb": ["ba", "sch", "ung", "ö", "kei"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(kinds))
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
        rows.append((i, " ".join(words).capitalize() + "!", lang))
    return rows


def test_language(spark):
    rows = corpus(random.Random(4), 400)
    odd = [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "balomi", None), (None, "tumira", "aa"), (1003, "中文字", "aa"), (1004, "ra " * 300_000, "aa")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    got = language_id.identify(df, language_id.fit(df)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    seen = {r["doc_id"]: r for r in got}
    assert sum(seen[i]["lang_pred"] == lang for i, lang in truth.items()) >= 0.98 * len(truth)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "bb", "und") for r in got)
    assert [seen[i]["lang_pred"] for i in (1000, 1001)] == ["und", "und"]
    assert seen[1002]["lang_pred"] == "aa" and seen[1003]["rejected"] and not seen[1004]["rejected"]
    assert seen[None]["lang_pred"] == "aa" and not seen[None]["held_out"]
    # The held-out fold's labels don't matter.
    other = df.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'xx' ELSE lang END AS lang")
    again = {r["doc_id"]: r["score"] for r in language_id.identify(df, language_id.fit(other)).collect()}
    assert again == {k: r["score"] for k, r in seen.items()}


def test_language_without_rows(spark, none, odd, odd_rows):
    nothing = language_id.fit(none)
    assert language_id.identify(none, nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(odd, language_id.fit(odd)).count() == len(odd_rows)


def test_language_learns_from_all_but_the_sample(spark, tmp_path):
    """Rows of the calibration fold that are not drawn are counted, and so are languages that
    are only in the sample."""
    folds = {i: zlib.crc32(str(i).encode()) % 5 for i in range(400)}
    rows = corpus(random.Random(6), 400)
    fold = [i for i in folds if folds[i] == language_id.CALIBRATION_FOLD]
    rare = set(fold[:3])
    rows = [(i, "xyzzy plugh " * 20, "cc") if i in rare else (i, t, lang) for i, t, lang in rows]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert {got[i] for i in rare} == {"cc"}
    # With no calibration rows, every row outside the held-out fold is counted.
    model = language_id.fit(docs, calibration_rows=0)
    learned = [(t, lang) for i, t, lang in rows if folds[i] != 0]
    for k, lang in enumerate(model.languages):
        runs = np.concatenate([language_id.runs_of(language_id.characters(t)) for t, own in learned if own == lang])
        assert set(model.models[k].own[4].keys) == set(language_id.hashes(runs))
    assert model.limits is None


def test_language_counts_are_not_cut(spark, tmp_path):
    """A language with over a million different runs beside one with few keeps them all."""
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rows = [(i, "".join(letters[k] for k in rng.integers(0, 3000, 2_000)), "zh") for i in range(1_000)]
    rows.append((-1, "balo mira tulo", "aa"))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    model = language_id.fit(spark.read.parquet(path), calibration_rows=0)
    learned = [t for i, t, lang in rows if lang == "zh" and zlib.crc32(str(i).encode()) % 5 > 1]
    kinds = np.unique(np.concatenate([language_id.hashes(language_id.runs_of(language_id.characters(t))) for t in learned]))
    assert len(kinds) > 1_000_000
    assert np.isin(kinds, model.models[model.languages.index("zh")].own[4].keys).all()


def test_runs_beyond_the_table_cost_the_same(monkeypatch):
    rows = corpus(random.Random(2), 40)
    counts = Counter((lang, "".join(map(chr, r))) for _, t, lang in rows for r in language_id.runs_of(language_id.characters(t)))
    df = pd.DataFrame([(lang, run, n) for (lang, run), n in counts.items()], columns=["lang", "run", "n"])
    codes = language_id.characters(rows[0][1])
    whole = language_id.build(df).costs(codes)
    monkeypatch.setattr(language_id, "TABLE_CELLS", 100)
    part = language_id.build(df)
    assert len(part.table.keys) == 50 and part.costs(codes) == pytest.approx(whole, rel=1e-5)


def test_models_are_distributions():
    rows = corpus(random.Random(1), 60)
    runs = np.concatenate([language_id.runs_of(language_id.characters(t)) for _, t, _ in rows])
    kinds, counts = np.unique(runs, axis=0, return_counts=True)
    letters = np.unique(kinds)
    model = language_id.KneserNey(kinds, counts, len(letters) + 1)
    contexts = [runs[0][:3], np.array([1, 2, 3], np.uint64), np.array([5, 6, ord("b")], np.uint64)]
    for c in contexts:
        every = np.array([[*c, x] for x in letters], np.uint64)
        unseen = model.probability(np.array([[*c, 99999]], np.uint64))[0]
        assert model.probability(every).sum() + unseen == pytest.approx(1)


def test_characters_and_slices(monkeypatch):
    text = "Ab, cÖ  12 d\n"
    assert "".join(map(chr, language_id.characters(text))) == "   ab cö d "
    monkeypatch.setattr(language_id, "SLICE", 2)
    codes = language_id.characters(text)
    parts = np.concatenate([language_id.runs_of(p) for p in language_id.slices(codes)])
    assert (parts == language_id.runs_of(codes)).all()


def plain_score(model, x):
    total = model.base
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > t[node] else 1)
        total += leaf[node - len(f)]
    return 1 / (1 + np.exp(-total))


def test_trees_fit_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(boosted_quality.FEATURES)))
    y = ((x[:, 3] > 0.3) ^ (x[:, 7] > 0)).astype(float)
    model = boosted_quality.fit(x[:2000], y[:2000])
    scores = model.scores(x[2000:])
    assert ((scores > 0.5) == y[2000:]).mean() > 0.97
    assert scores[:50] == pytest.approx([plain_score(model, r) for r in x[2000:2050]])
    assert len(model.scores(x[:0])) == 0
    same = boosted_quality.fit(np.ones((50, 3)), np.ones(50))
    assert (same.scores(np.ones((2, 3))) > 0.9).all()


def test_statistics():
    s = dict(zip(boosted_quality.FEATURES, boosted_quality.statistics("Aa aa aa\nAa aa aa\n#é"), strict=True))
    assert s["repeated_lines"] == pytest.approx(1 / 3) and s["symbols"] == pytest.approx(1 / 21)
    assert s["most_frequent"] == pytest.approx(4 / 7) and s["upper"] == pytest.approx(2 / 21)
    assert boosted_quality.statistics("") == [0.0] * len(boosted_quality.FEATURES)


def test_quality(spark, odd, odd_rows, none):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        words = [f"w{rng.randrange(999)}" for _ in range(60)]
        rows.append((i, " ".join(words) if good else " ".join(w + "$$$" for w in words), i))
        labels.append((i, int(good), 0))
    labels += [(5, None, 0), (None, 1, 0), (5, labels[5][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = boosted_quality.fit_quality(docs, marks)
    got = boosted_quality.score(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    truth = {i: q for i, q, _ in labels[:300]}
    assert len(got) == 300 and len(held) > 20
    assert all(r["predicted"] == truth[r["doc_id"]] for r in held)
    # A bounded sample is drawn from labels of the other folds only.
    assert 20 <= boosted_quality.training_sample(docs, marks, 50).count() <= 100
    flipped = pd.DataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q in truth.items()], columns=["doc_id", "quality", "toxic"])
    again = boosted_quality.fit_quality(docs, spark.createDataFrame(flipped))
    assert (again.leaf == model.leaf).all()
    assert Counter(r["doc_id"] for r in boosted_quality.score(odd, model).collect()) == Counter(r[0] for r in odd_rows)
    assert boosted_quality.score(none, boosted_quality.fit_quality(none, marks)).count() == 0
