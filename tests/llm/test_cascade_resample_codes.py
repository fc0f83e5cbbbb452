"""Quality cascade, importance resampling and vector codes, against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import quality_cascade as qc
from riskweave.llm import target_resample as tr
from riskweave.llm import vector_codes as vc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one two three", "a b c d e f g h i j k", "a b c d e " * 6, "x " * 40, "Line one here\n" * 5 + "Line two here\n\n",
    "### $$$ word *** other &&& thing ### $$$ ||| <<< >>>", "SHOUT!! AT!! ME!! NOW!! AND!! THEN!! AGAIN!! FOR!! EVER!! MORE!! SO!!",
    "Äpfel und Öl sind für die Küche nützlich\nund auch für den Garten manchmal gut\x0bja", "漢字 " * 12 + "かな", "\x00\x01 bad � " * 6 + "w v u t",
    "1 2 3 4 5 6 7 8 9 10 11 12", "Lorem ipsum dolor sit amet and more words of no use here",
]


def plain_measures(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_echo_words": sum(a == b for a, b in zip(w, w[1:])),
    }


def plain_count(what, text, measures):
    if what in measures:
        return measures[what]
    plain = {
        rf"{qc._WORD}*\p{{L}}{qc._WORD}*": lambda: sum(any(c.isalpha() for c in w) for w in WORD.findall(text)),
        r"\p{Lu}": lambda: sum(c.isupper() for c in text), r"\p{L}": lambda: sum(c.isalpha() for c in text),
        r"\p{Nd}": lambda: sum(c.isdecimal() for c in text),
    }
    return plain[what]() if what in plain else len(re.findall(what.replace(r"\x{FFFD}", "�"), text))


def plain_kept(text):
    m = plain_measures(text)
    if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]:
        return True, False
    for rule in qc.RULES:
        count, over = 100 * plain_count(rule.count, text, m), plain_count(rule.over, text, m)
        if (rule.most is not None and count > rule.most * over) or (rule.least is not None and count < rule.least * over):
            return False, False
    return False, True


def random_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["word", "Other", "x", "###", "!!", "\n", "1234", "été", "ÉTÉ", "…", "- ", "...", "the"]
    return [rng.choice([" ", "  ", "\t"]).join(rng.choices(parts[: rng.randint(2, 13)], k=rng.randint(1, 60))) for _ in range(n)]


def test_measures_and_verdicts(spark):
    texts = TEXTS + random_texts(300)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1))
    got = {r["doc_id"]: r for r in qc.judge_quality(rows.repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = plain_measures(text)
        assert {k: got[i][k] for k in want} == want, (text, got[i])
        assert (got[i]["base_failed"], got[i]["kept"]) == plain_kept(text), (text, got[i])
        assert (got[i]["rejected_by"] is not None) == (not got[i]["base_failed"] and not got[i]["kept"])


def test_order_changes_no_verdict(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS + random_texts(100, 2))), "doc_id long, text string")
    forward = qc.judge_quality(rows, planned=False).select("doc_id", "kept").collect()
    backward = qc.judge_quality(rows, tuple(reversed(qc.RULES)), planned=False).select("doc_id", "kept").collect()
    planned = qc.judge_quality(rows).select("doc_id", "kept").collect()
    assert sorted(forward) == sorted(backward) == sorted(planned)


def test_greedy_order_takes_rejections_per_second_of_what_is_left():
    a, b, c, d = (qc.Rule(n, "n_words", "n_lines", most=1) for n in "abcd")
    # a rejects four, dear; b three of them, cheap; c one more, dearer than a's remainder is worth; d none
    verdicts = [0b0011, 0b0011, 0b0011, 0b0001, 0b0100, 0]
    assert qc.greedy_order([a, b, c, d], verdicts, [4.0, 1.0, 2.0, 0.1]) == [b, c, a, d]


def test_rules_after_a_rejection_do_not_run():
    texts = pa.array(["### " * 20 + "w " * 3, "plain words " * 10])
    seen = []

    class Spy(qc.Rule):
        pass

    measured = qc.measure(texts)
    old = qc.rejects
    try:
        qc.rejects = lambda rule, t, m: (seen.append((rule.name, len(t))), old(rule, t, m))[1]
        first = qc.cascade([qc.RULES[0], Spy("late", r"\p{Lu}", r"\p{L}", most=50)], texts, measured, np.array([True, True]))
    finally:
        qc.rejects = old
    assert first.tolist() == [0, -1] and seen == [("symbols", 2), ("late", 1)]


def test_cascade_of_nothing_nulls_repeats_and_a_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert qc.judge_quality(empty).count() == 0
    long = " ".join("w" + str(i).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(300_000))
    rows = spark.createDataFrame([(None, long), (None, long), (3, None)], "doc_id long, text string")
    got = qc.judge_quality(rows).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["kept"]) for r in got) == [(False, 0, False), (True, 300_000, True), (True, 300_000, True)]


def test_two_rules_of_one_name(spark):
    with pytest.raises(ValueError):
        qc.judge_quality(spark.createDataFrame([(1, "a")], "doc_id long, text string"), (qc.RULES[0], qc.RULES[0]))


# resampling

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text, most):
    w = FEATURE.findall(lowered(text))
    return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, most, buckets, percent, least):
    def hist(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, most)[1])

    s, t = hist(x for _, x in docs), hist(target)
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for doc_id, text in docs:
        w, feats = plain_features(text, most)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in (zlib.crc32(f.encode()) % buckets for f in feats))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(w), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i for i, r in enumerate(able[: len(able) * percent // 100], start=1)}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (3, 97), (2, 100_000)])
def test_resample_equals_plain_computation(spark, most, buckets):
    rng = random.Random(most)
    vocabulary = ["Alpha", "beta", "GAMMA", "été", "x1", "漢字", "don't", "a-b", "\x80\x81", "\U0001F600z"]
    docs = [(i * 7, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(200)]
    docs += [(5000, None), (5001, ""), (None, "alpha beta " * 15)]
    target = [" ".join(rng.choices(vocabulary[:4], k=30)) for _ in range(20)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = tr.resample(frame.repartition(3), aims, most=most, buckets=buckets, percent=30, least_words=10)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target, most, buckets, 30, 10)


def test_ranks_of_ties_and_repeated_rows(spark):
    rows = spark.createDataFrame([(i % 3, 5) for i in range(900)], "doc_id long, score long").repartition(5)
    got = tr.ranked(rows, F.desc("score"), F.asc("doc_id")).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 901))
    assert all(r["rank"] in range(300 * r["doc_id"] + 1, 300 * r["doc_id"] + 301) for r in got)


def test_resample_of_nothing_and_of_a_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "word " * 200_000), (1, "word " * 200_000), (2, "b")], "doc_id long, text string")
    assert tr.resample(empty, some).count() == 0
    got = sorted((r["doc_id"], r["n_features"], r["rank"] is None) for r in tr.resample(some, empty, percent=50).collect())
    assert got == [(1, 200_000, False), (1, 200_000, True), (2, 1, True)]


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    sizes = Counter(len(v) for _, v, _ in kept)
    length = max(sizes, key=lambda n: (sizes[n], n))
    kept = [r for r in kept if len(r[1]) == length]
    width = -(-length // parts)
    cut = [
        [[math.floor(Fraction(x) * scale) for x in (list(v) + [0.0] * (parts * width - length))[p * width : (p + 1) * width]] for p in range(parts)]
        for _, v, _ in kept
    ]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, list(kept[i][1])))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def away(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (away(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = assign()
    errors = [sum(away(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], code, error, by_label[r[2]]) for r, code, error in zip(kept, codes, errors)), key=repr), digest


def same_codes(spark, rows, **kw):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("error", F.lit("x")).withColumn("codes", F.lit(1))
    coded, books = vc.compress(frame.repartition(3), **kw)
    want, digest = plain_codes(rows, **{k: v for k, v in kw.items() if k != "width"})
    got = sorted(((r["vec_id"], list(r["codes"]), r["error"], r["label_error"]) for r in coded.collect()), key=repr)
    assert got == want
    assert books.digest() == digest


@pytest.mark.parametrize("width", [None, 1, 300, 100_000])
def test_codes_equal_plain_computation(spark, width):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    rows = [(int(i), (centres[i % 5] + 0.1 * rng.normal(size=16)).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    same_codes(spark, rows, rounds=3, width=width)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5] * 10, 1), (1, [0.5] * 10, 1), (1, [0.25] * 10, 1), (None, [0.1 * i for i in range(10)], None), (2, None, 1), (3, [nan] + [0.0] * 9, 1),
        (4, [inf] + [0.0] * 9, 1), (5, [None] + [0.0] * 9, 1), (6, [1.0, 2.0], 1), (7, [], 1), (8, [-0.3] * 10, None), (9, [0.0] * 10, 2),
    ]
    same_codes(spark, rows, entries=4)
    same_codes(spark, rows[4:6])
    same_codes(spark, [(1, [], 1), (2, [], 1)], rounds=1)


def test_huge_components_stay_within_a_long(spark):
    rows = [(i, [(-1.0) ** i * 1e30] * 8, 1) for i in range(40)] + [(50, [0.0] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, _ = vc.compress(frame, rounds=0, entries=2)
    got = {r["vec_id"]: r["error"] for r in coded.collect()}
    assert got[0] == got[1] == 0 and 0 < got[50] < 1 << 63


def test_labels_joined_with_salts(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, float(i % 3), 0.5], None if i % 2 else i % 4) for i in range(200)]
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 0)
    same_codes(spark, rows, parts=2, entries=3, rounds=2)


def test_cells_keep_every_nearest_entry():
    rng = np.random.default_rng(9)
    for size, width in ((1, 3), (2, 10), (4, 25)):
        entries = rng.integers(-40, 40, size=(12, size))
        entries[5] = entries[2]  # equal entries: the lower index wins
        x = rng.integers(-60, 60, size=(4000, size))
        grid = vc.GridCells(entries, width)
        found, error = grid.nearest(x)
        all_gaps = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(found, all_gaps.argmin(axis=1)) and np.array_equal(error, all_gaps.min(axis=1))
        assert grid._masks.mean() < 1  # some entries were ruled out
        again, _ = grid.nearest(x)
        assert np.array_equal(found, again) and len(grid._masks) == len(np.unique(x // width, axis=0))


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(vc, "CACHE_BYTES", 2_000)
    x = np.arange(-500, 500).reshape(-1, 2)
    entries = x[::100]
    grid = vc.GridCells(entries, 7)
    found = np.concatenate([grid.nearest(x[i : i + 10])[0] for i in range(0, len(x), 10)])
    assert np.array_equal(found, ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1))
    assert len(grid._rows) <= grid.most_cells + 10


def test_empty_table(spark):
    coded, books = vc.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
