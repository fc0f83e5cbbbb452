"""Near copies, repeats, mixing, nearest neighbours, toxicity and the pipeline, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import jaccard_join, mixing, nearest, substring_dedup, toxicity
from riskweave.llm.queries import QUERIES
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_links(texts, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall(lowered(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("x"))


def same_as_brute(spark, texts):
    got = sorted(jaccard_join.similar_documents(frame(spark, texts).repartition(3)).select("doc_id", "n_shingles", "component_id").collect())
    sizes, comps = brute_links(texts)
    assert [r[1] for r in got] == sizes
    assert [r[2] for r in got] == comps


def test_near_copies_of_documents(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").select("text").collect()]
    same_as_brute(spark, texts)


@pytest.mark.parametrize("length", [6, 14, 30, 90])
def test_near_copies_at_the_border(spark, length):
    """Copies with a few words changed, so that similarities lie on both sides of the border."""
    rng = random.Random(length)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(length)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, length // 30))):
                copy[rng.randrange(length)] = rng.choice(["q", "r", "s"])
            texts.append(" ".join(copy[: length - rng.randint(0, 2)]))
    same_as_brute(spark, texts)


@pytest.mark.parametrize("open_pairs,block", [(0, 2_048), (1_000, 8)], ids=["rounds", "blocks"])
def test_a_large_group_of_near_copies(spark, monkeypatch, open_pairs, block):
    """Settled by rounds with one member each, or cut into blocks whose pairs are tasks of their own."""
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 3)
    monkeypatch.setattr(jaccard_join, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"y{i}_{k}" for k in range(5)) for i in range(30)]
    same_as_brute(spark, texts)


def test_block_pairs_meet_every_open_pair_once(spark, monkeypatch):
    """A group of 900 members of all sizes, half in one component: every pair that sizes and histograms allow, no more."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    rng = np.random.default_rng(5)
    n = rng.integers(1, 400, 900)
    comp = np.where(rng.random(900) < 0.5, 0, rng.integers(1, 400, 900))
    hist = np.zeros((900, jaccard_join.BUCKETS), dtype=np.uint8)
    hist[:, :20] = (n[:, None] + rng.integers(0, 20, (900, 20))) // 20
    rows = [(g, i, int(comp[i]), int(n[i]), hist[i].tobytes()) for g, members in ((7, range(900)), (8, range(20))) for i in members]
    frame = spark.createDataFrame(rows, "g long, x long, c long, n long, histogram binary").repartition(5)
    blocks = jaccard_join._blocked(frame).groupBy("k").agg(F.count(F.lit(1)).alias("m")).collect()
    assert max(r["m"] for r in blocks) <= 4 * 64  # two blocks each, dealt by a hash
    got = sorted(map(tuple, jaccard_join._open_pairs(frame, 80, 900).collect()))
    small, large = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    apart = np.abs(hist[:, None].astype(int) - hist).sum(axis=2)
    fits = (small * 100 >= large * 80) & (apart * 180 <= (n[:, None] + n) * 20) & (comp[:, None] != comp)
    want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(fits)) if i < j)
    assert got == want and len(want) > 1_000


def test_near_copies_of_odd_rows(spark):
    rows = [(3, "A b c d e f g"), (1, "a B c d e f g"), (1, "a B c d e f g"), (7, None), (8, "  \t"), (9, "one two"), (4, "One\x0btwo"), (None, "one two"), (12, "zz"), (12, "yy"), (15, "yy")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, 1), (1, 3, 1), (7, 0, 7), (8, 0, 8), (9, 1, 4), (4, 1, 4), (None, 1, 4), (12, 1, 12), (15, 1, 12)}
    assert jaccard_join.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_repeats(docs, window=20):
    seen, out = {}, {}
    for i, text in docs:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "documents"])
def test_repeats_equal_brute_force(spark, letters):
    if letters == "documents":
        rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    else:
        rng = random.Random(len(letters))
        rows = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))) for i in range(-20, 20)]
        block = " ".join(f"w{k}" for k in range(60))
        rows += [(50 + i, f"p{i} {block} " + " ".join(f"u{i}_{k}" for k in range(30)) + f"\n{block}") for i in range(5)]
        rows += [(90, None), (91, " \n"), (92, "q " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(1, text), (1, text), (2, text + " end"), (None, text)]
    got = sorted(((r["doc_id"], r["n_removed"], r["tag"]) for r in substring_dedup.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit("t")), carry=["tag"]).collect()), key=repr)
    assert got == sorted([(1, 0, "t"), (1, 0, "t"), (2, 25, "t"), (None, 25, "t")], key=repr)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    from riskweave.llm import words

    rng = random.Random(2)
    block = " ".join(rng.choice(["x", "y", f"w{k % 7}"]) for k in range(80))
    texts = pa.array([f"{rng.random()} {block} {rng.random()}" for _ in range(20)])
    w = words.split(texts)
    places, name, level = substring_dedup.anchors(w)
    hashes = substring_dedup.window_hashes(w, places)
    by_window = {}
    for h, n in zip(hashes, name):
        assert by_window.setdefault(h, n) == n
    assert level.max() >= 1 and len(set(name)) < len(places)


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    words_of = {"a": [f"a{k}" for k in range(40)], "b": [f"b{k}" for k in range(40)], "c": [f"c{k}" for k in range(40)]}
    rows, labels = [], []
    for i in range(600):
        d = "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c"
        rows.append((i, " ".join(rng.choice(words_of[d]) for _ in range(rng.randint(5, 60)))))
        if i % 2:
            labels.append((i, d))
    rows += [(1000, None), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit(-1))
    known = spark.createDataFrame([*labels, (None, "a"), (5, None)], "doc_id long, domain string")
    got = mixing.mix_to_targets(docs, known, {"a": 0.2, "b": 0.3, "c": 0.5, "absent": 0.4}).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all()
    taken = (got.rate * got.n_tokens).groupby(got.domain).sum() / got.n_tokens.sum()
    assert taken["a"] == pytest.approx(0.2, abs=0.02) and taken["b"] == pytest.approx(0.3, abs=0.02) and taken["c"] == pytest.approx(0.5, abs=0.02)
    plain = mixing.mix_to_targets(docs, known.limit(0), {"a": 1.0}).toPandas()
    assert (plain.rate == 1).all() and len(plain) == len(rows)
    assert mixing.mix_to_targets(docs.limit(0), known, {"a": 1.0}).count() == 0


def test_projected_steps_keep_rates_at_zero_or_above(spark):
    members = [(10, np.array([1.0, 0.0]).tobytes()), (10, np.array([0.5, 0.5]).tobytes()), (10, np.array([0.0, 1.0]).tobytes())]
    df = spark.createDataFrame([(t, bytearray(p)) for t, p in members], "n_tokens long, p binary")
    steps = mixing.fit_rates(df, np.array([0.95, 0.05]))
    r = mixing._rates(np.array([[1, 0], [0.5, 0.5], [0, 1.0]]), steps)
    assert (r >= 0).all()
    assert 10 * r @ np.array([1, 0.5, 0]) == pytest.approx(28.5, rel=0.01)


def test_neighbours_reach_the_recall_and_handle_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 150)
    monkeypatch.setattr(nearest, "LEAF", 16)
    monkeypatch.setattr(nearest, "BLOCK", 30)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 12)) * rng.uniform(0.5, 2, (1500, 1))
    x[300:700] = x[299]  # a vector with very many copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 12), (5003, [float("nan")] * 12), (5004, [None] * 12), (5005, [1.0] * 11), (None, [1.0] * 12), (0, rows[0][1]), (5006, [float("inf")] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(5)
    got = nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0).toPandas()
    queries = np.arange(0, 1500, 20)
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    found = 0
    for q, scores in zip(queries, s):
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, x[mine.vec_id] @ x[q]) and (np.diff(mine.score) <= 1e-12).all()
        best = np.lexsort((np.arange(len(scores)), -np.round(scores, 9)))[:20]
        found += len(set(best) & set(mine.vec_id))
    assert found / (20 * len(queries)) >= 0.9
    assert set(got.query_id) == set(queries)
    few = nearest.nearest_neighbours(df.filter("vec_id < 5"), F.col("vec_id") == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4]
    assert nearest.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_chi_square_stop():
    q = nearest.chi_square_quantile(0.95)
    draws = np.random.default_rng(1).chisquare(nearest.PROJECTIONS, 200_000)
    assert abs((draws <= q).mean() - 0.95) < 0.003


def test_toxicity_on_documents_held_out(spark):
    got = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert got.score.between(0, 1).all()
    hits = both.predicted == 1
    assert (both.toxic[hits] == 1).mean() > 0.95
    # measured 0.77 here (0.98 on five times the labels): some labelled texts hold none of the telling words
    assert (both.predicted[both.toxic == 1] == 1).mean() > 0.7
    rank, bad = both.score.rank().to_numpy(), both.toxic.to_numpy() == 1
    assert (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()) > 0.9


def test_toxicity_never_uses_held_out_labels_and_takes_odd_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = " ".join(rng.choice("red green blue cyan pink".split()) + str(rng.randint(0, 9)) for _ in range(20)) + (" Vilest! grubix" if bad else "")
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (901, ""), (None, "grubix vilest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("votes", F.lit(1))
    known = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    a = toxicity.score_toxicity(docs, known).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True)
    held = toxicity.held_out(F.col("doc_id"))
    flipped = known.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = toxicity.score_toxicity(docs, flipped).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True)
    assert np.allclose(a.score, b.score) and len(a) == len(rows)
    first = a[a.doc_id < 400]
    assert ((first.doc_id % 5 == 0) == (first.predicted == 1)).all()
    assert (a[a.doc_id >= 900].predicted == 0).all() and (a[a.doc_id.isna()].predicted == 1).all()
    none = toxicity.score_toxicity(docs, known.limit(0)).toPandas()
    assert (none.score == 0).all() and len(none) == len(rows)
    assert toxicity.score_toxicity(docs.limit(0), known).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    names = set(docs.columns)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = corpus_pipeline.cut_lineage(stage(spark, kept, SF_DIR))
        if k < 4:
            assert set(kept.columns) == names
        rows = kept.collect()
        if k == 1:
            survivors = {r["doc_id"]: r["text"] for r in rows}
            order = sorted(survivors)
            _, comps = brute_links([survivors[i] for i in order])
            assert comps == list(range(len(order)))  # nothing linked is left
            assert all(before[i] == t for i, t in survivors.items())
        if k == 2:
            want = brute_repeats(sorted(survivors.items()))
            assert {r["doc_id"]: (r["text"] or "").split() for r in rows} == {i: w[2].split() for i, w in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert {r["doc_id"] for r in rows} <= set(survivors)
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(rows)


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y", "en", "s", 3)]
    kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.cut_lineage(stage(spark, kept, SF_DIR))
    assert kept.count() >= 3


def test_lexicon_counts_a_text_once_and_keeps_every_entry_that_passes(spark):
    rng = random.Random(4)
    rows = [(" ".join(f"w{rng.randint(0, 500)}" for _ in range(10)), 0) for _ in range(600)]
    rows += [(f"grubix w{i} t{i}", 1) for i in range(60)]
    hot = " ".join(f"hotword{k}" for k in range(120))
    labelled = spark.createDataFrame(rows + [(hot, 1)] * 500, "text string, toxic int")
    found, base = toxicity.mine_lexicon(labelled)
    assert base == pytest.approx(61 / 661, abs=0.01)
    assert set(found) >= entries_of("grubix") and not set(found) & entries_of("hotword7")
    # 300 words that all pass
    many = rows[:600] + [(" ".join(f"vile{k}" for k in range(300)) + f" u{i}", 1) for i in range(60)]
    found, _ = toxicity.mine_lexicon(spark.createDataFrame(many, "text string, toxic int"))
    assert all(entries_of(f"vile{k}") & set(found) for k in range(300)) and len(found) > 256


def entries_of(word):
    import pyarrow as pa

    return set(toxicity._entries(pa.array([word]))[1])


def test_moments_in_blocks_give_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} " + ("grubix vilest" if i % 5 == 0 else "fine")) for i in range(300)], "doc_id long, text string")
    known = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    whole = toxicity.score_toxicity(docs, known).toPandas().sort_values("doc_id")
    monkeypatch.setattr(toxicity, "CELLS", 40)
    parts = toxicity.score_toxicity(docs, known).toPandas().sort_values("doc_id")
    assert np.allclose(whole.score.to_numpy(), parts.score.to_numpy(), atol=1e-6)


@pytest.mark.parametrize("tenths", [5, 6, 7])
def test_toxicity_learns_from_labels_that_are_mostly_toxic(spark, tenths):
    rng = random.Random(tenths)
    rows, labels = [], []
    for i in range(600):
        bad = i % 10 < tenths
        text = " ".join(rng.choice("red green blue cyan pink".split()) + str(rng.randint(0, 9)) for _ in range(20))
        rows.append((i, text + (" grubix vilest" if bad else "")))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    assert ((got.doc_id % 10 < tenths) == (got.predicted == 1)).all()


def test_repeats_of_null_ids_and_of_one_id_with_several_texts(spark):
    passage, clean = (" ".join(f"{c}{k}" for k in range(30)) for c in "pc")
    for doc_id in (None, 7):
        rows = [(1, passage), (doc_id, passage + " end"), (doc_id, clean), (doc_id, clean + " tail"), (doc_id, clean)]
        got = [(r["doc_id"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(
            spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
        assert (doc_id, 30, "end") in got and (1, 0, passage) in got
        # clean words stay in one of the two texts; equal rows stay alike
        left = sorted(((n, t) for i, n, t in got if i == doc_id and "end" != t), key=repr)
        assert left in (sorted([(0, clean), (0, clean), (30, "tail")], key=repr), sorted([(30, ""), (30, ""), (0, clean + " tail")], key=repr))


def test_a_rare_domain_is_in_the_sample(spark):
    rows = [(i, " ".join(f"{'rare' if i >= 400 else 'ab'[i % 2]}{(i * 7 + k) % 9}" for k in range(12)), "r" if i >= 400 else "ab"[i % 2]) for i in range(403)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.train_classifier(df.select("doc_id", "text"), df.select("doc_id", "domain"), 12)
    assert model.domains == ["a", "b", "r"]
    assert mixing.sample_quotas({"a": 100, "r": 1}, 10) == {"a": 9, "r": 1}
    assert mixing.sample_quotas({"a": 5, "r": 1}, 10) == {"a": 5, "r": 1}


def test_toxicity_calibrates_on_labelled_rows_of_a_large_corpus(spark, monkeypatch):
    seen = []
    plain = toxicity.LabelModel.calibrate
    monkeypatch.setattr(toxicity.LabelModel, "calibrate", lambda m, x, y: (seen.append(len(y)), plain(m, x, y))[1])
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w', id % 7, IF(id % 4 = 0, ' grubix', ' fine')) AS text")
    known = docs.filter("doc_id < 90").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    toxicity.score_toxicity(docs, known, sample_rows=60).count()
    assert 50 <= seen[0] <= 60
