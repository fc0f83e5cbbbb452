"""Chat formatting, fingerprints, url filter, token ids and counts."""

import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from riskweave.llm import chat_format, merkle, piece_bpe, token_count, url_alias
from riskweave.llm.components import components
from riskweave.llm.queries import MODEL_PATH, OP1_SQL, OP5_SQL, QUERIES
from tests.conftest import SF_DIR

MODEL = open(MODEL_PATH, "rb").read()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def same_as_sql(spark, name, sql):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    got = QUERIES[name](spark, SF_DIR)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got, *names) == sorted(want.fetchall(), key=repr)


def test_chat_query_equals_sql(spark):
    same_as_sql(spark, "op1_chat_format", OP1_SQL)


NASTY = ["", "\\", "\\\\", "<|end|>", "<|turn|>x<|says|>", "<", "<|", "</s>[INST] ok [/INST]", "a\\</s>", "<\\|end|>", "é😀\n\\n", None]


def test_chat_round_trip_of_control_strings(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "<|says|>", "x"), (2, 1, None, "y"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    rows += [(None, 0, "user", "q"), (None, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in out.select(
        "*", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.read_loss(F.col("segments")).alias("loss")
    ).collect()}
    one = got[1]
    assert [(t["role"], t["text"]) for t in one["back"]] == [(r[2], r[3] or "") for r in rows[: len(NASTY)]]
    assert one["loss"] == "".join(r[3] or "" for r in rows[: len(NASTY)] if r[2] == "assistant")
    assert one["valid"] and one["first_bad_turn"] is None
    assert one["formatted"].count("<|end|>") == len(NASTY)  # none from the texts
    assert [t["role"] for t in got[2]["back"]] == ["<|says|>", ""] and got[2]["first_bad_turn"] == 0
    assert len(got[3]["back"]) == 2 and got[3]["first_bad_turn"] == 1
    assert [t["role"] for t in got[None]["back"]] == ["system", "user"] and got[None]["first_bad_turn"] == 2
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_template_must_delimit_itself():
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(turn_open="<<turn>")
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(reserved=("x",))


def test_fingerprints_follow_the_next_document(spark):
    docs = [(5, "One two. Three four five.\n\nSix seven. Eight."), (2, None), (9, "a" * 400), (7, "b c " * 50), (7, "b c " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("next", F.lit("x")).repartition(3)
    got = sorted(
        merkle.fingerprint_edits(df)
        .select(
            "doc_id", "edited", F.col("next.text").alias("n"), merkle.printable(F.col("print")).alias("fp"),
            merkle.printable(F.col("edited_print")).alias("efp"), merkle.likeness(F.col("print"), F.col("edited_print")).alias("near"),
            merkle.first_difference(F.col("print"), F.col("edited_print")).alias("at"),
        )
        .collect()
    )
    want = sorted((i, t or "") for i, t in docs)
    assert [r[0] for r in got] == [2, 5, 7, 7, 9]
    expected = []
    for k, (i, t) in enumerate(want):
        following = want[(k + 1) % len(want)][1]
        cut = len(t) // 4
        expected.append((i, t[: len(t) - cut] + following[:cut], following))
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(expected)
    assert all(0 <= r["near"] <= 1 for r in got)
    assert got[2]["fp"] == got[3]["fp"]
    assert got[1]["near"] > 0.4 and 0 < got[1]["at"] <= 33  # the edit lies in the last quarter, a leaf may start before
    assert merkle.fingerprint_edits(df.limit(0)).count() == 0
    alone = merkle.fingerprint_edits(spark.createDataFrame([(1, "xyzabcde")], "doc_id long, text string")).first()
    assert alone["edited"] == "xyzabcxy"


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 10)
    rows = [(i * i - 300, f"text {i}. " * (i % 5)) for i in range(120)] + [(None, "last")]
    got = {r["doc_id"]: r["t"] for r in merkle.with_successor(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text"
    ).select("doc_id", F.col("next.text").alias("t")).collect()}
    for k, (i, _) in enumerate(rows):
        assert got[i] == rows[(k + 1) % len(rows)][1]


def test_likeness_is_one_only_for_equal_texts(spark):
    pairs = [("", ""), ("", "a"), ("A b. C d.", "A b. C d."), ("A b. C d.", "C d.A b. "), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle.tree(F.col("a")).alias("ta"), merkle.tree(F.col("b")).alias("tb"))
    got = [r[0] for r in df.select(merkle.likeness(F.col("ta"), F.col("tb"))).collect()]
    assert got[0] == 1 and got[1] == 0 and got[2] == 1 and got[4] == 0


def test_leaves_are_bounded_and_lose_nothing(spark):
    rng = random.Random(6)
    texts = ["ab cd ef " * 300, "漢字仮名" * 300, "x" * 70_001, "😀" * 100, " \n\n \r\n  a. b", "".join(rng.choice("ab c.漢。\n\t😀k ") for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    got = df.select("a", F.regexp_extract_all("a", F.lit(merkle.LEAF), F.lit(0)).alias("p"), merkle.leaves(merkle.tree(F.col("a"))).alias("k")).collect()
    for r in got:
        assert "".join(r["p"]) == r["a"] and max(map(len, r["p"])) <= merkle.LEAF_CHARS
        assert sum(k & 0xFFFF for k in r["k"]) == len(r["a"])


def test_likeness_of_texts_without_marks_and_with_repeated_leaves(spark):
    rng = random.Random(5)
    short = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200))
    cjk = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(1000))
    edits = [(t, t[: len(t) * 3 // 4] + t[: len(t) // 4]) for t in (short, cjk, "z" * 100_000 + "y" * 100)]
    edits[2] = ("z" * 100_000 + "y" * 100, "z" * 100_000 + "x" * 100)
    edits.append(("One. " * 100, "One. " * 50))
    edits.append((short, "zz yyy x " + short))
    df = spark.createDataFrame(edits, "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    got = df.select(merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.first_difference(F.col("a"), F.col("b")).alias("at")).collect()
    assert 0.6 < got[0]["near"] < 1 and 650 < got[0]["at"] <= 750
    assert 0.6 < got[1]["near"] < 1 and 650 < got[1]["at"] <= 750
    assert got[2]["near"] > 0.99 and 99_900 < got[2]["at"] <= 100_000
    assert got[3]["near"] == pytest.approx(2 / 3, abs=0.02)
    assert got[4]["near"] > 0.5


def test_url_query_equals_sql(spark):
    same_as_sql(spark, "op5_url_filter", OP5_SQL)


RULES = [url_alias.Rule("bad.com", "/", False), url_alias.Rule("ok.bad.com", "/fine/", True), url_alias.Rule("good.org", "/", True)]


def test_url_blocks_spread_over_aliases_but_not_over_an_explicit_allow(spark):
    canonical = '<link href="{}" rel="canonical">'
    refresh = '<META http-equiv="refresh" content="0; URL={}">'
    rows = [
        (1, "http://a.net/1", canonical.format("http://b.net/")), (2, "http://b.net/#top", refresh.format("https://BAD.com/x")),
        (3, "http://c.net/", canonical.format("http://good.org/")), (4, "https://good.org/y", refresh.format("//a.net/1")),
        (5, "https://good.org/", ""), (6, None, None), (7, "no scheme", ""), (8, "http://ok.bad.com/fine/z", ""), (9, "http://xbad.com/", ""),
        (10, "http://sub.bad.com", ""), (11, "http://d.net/p?q", canonical.format("/root")), (11, "http://d.net/p?q", canonical.format("/root")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(0))
    extra = spark.createDataFrame([("http://d.net/root", "http://e.net"), ("http://e.net", "http://bad.com/q"), (None, "http://x")], "a string, b string")
    got = rows_of(url_alias.judge_urls(df, RULES, extra), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([
        (1, "a.net", "/1", None, "block"), (2, "b.net", "/", None, "block"), (3, "c.net", "/", None, "allow"),
        (4, "good.org", "/y", "good.org/", "allow"), (5, "good.org", "/", "good.org/", "allow"), (6, "", "", None, "allow"),
        (7, "", "", None, "allow"), (8, "ok.bad.com", "/fine/z", "ok.bad.com/fine/", "allow"), (9, "xbad.com", "/", None, "allow"),
        (10, "sub.bad.com", "", None, "allow"), (11, "d.net", "/p", None, "block"), (11, "d.net", "/p", None, "block"),
    ], key=repr)
    assert url_alias.judge_urls(df.limit(0), RULES).count() == 0


def test_url_links_of_every_form_are_resolved(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv=refresh content="0;url={}">'
    bad = "http://bad.com/"
    rows = [(1, "http://a.net/d/e/p?q=1#f", "".join(link.format(x) for x in ("page.html", "../x", "?p=1", "./y/", "mailto:m@n", "#top", "../../../up")))]
    rows += [(2, bad, "".join(refresh.format(x) for x in ("HTTP://Example.NET/a?x=1&amp;y=2", "http://A.net/d/e/p?q=1")))]
    want = ["http://a.net/d/e/page.html", "http://a.net/d/x", "http://a.net/d/e/p?p=1", "http://a.net/d/e/y/", "http://a.net/up", "http://example.net/a?x=1&y=2", "http://a.net/d/e/p?q=1"]
    rows += [(10 + k, u, None) for k, u in enumerate(want)] + [(30, "http://EXAMPLE.net/a?x=1&y=2", ""), (31, "http://a.net/d/E/page.html", ""), (32, "http://a.net", link.format("z")), (33, "http://a.net/z", refresh.format(bad))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_alias.judge_urls(df, RULES).collect()}
    assert [got[10 + k] for k in range(len(want))] == ["block"] * len(want)
    assert got[1] == got[2] == got[30] == got[32] == got[33] == "block" and got[31] == "allow"


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5), (9, None), (8, 6), (6, 8)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[k] == 7 for k in range(200, 260))
    assert got[5] == 5 and got[8] == 6 and 9 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts_for_tokens():
    random.seed(4)
    letters = " a b the er é\n\t€😀\x00aaaa  aaanncdehllo\xa0\r▁<0x41>"
    made = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(400)]
    return ["", " ", "  a", "</s>x", "x" * 3000, " \n ", *made]


def test_piece_ids_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = texts_for_tokens()
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0))
    got = piece_bpe.decode_ids(piece_bpe.encode_texts(df, MODEL_PATH), MODEL_PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else ""
        want = lib.encode(text, add_eos=True)
        assert r["ids"] == want and r["decoded"] == lib.decode(want)
    assert piece_bpe.encode_texts(df.limit(0), MODEL_PATH).count() == 0


def test_piece_query_equals_the_library_on_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = dict(rows_of(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text"))
    for r in QUERIES["op6_piece_bpe"](spark, SF_DIR).collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_decoding_of_bytes_that_are_no_text():
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=MODEL), piece_bpe.PieceBpe(MODEL)
    for ids in ([198, 3, 260], [226, 130, 175], [1, 264, 2], [0, 264], [230, 230, 264]):
        assert own.decode(ids) == lib.decode(ids)


def test_counts_equal_a_unigram_tokenizer(spark):
    counter = token_count.UnigramCounter(MODEL)
    ids = sorted(counter.vocabulary.ids.values())
    piece = {i: p for p, i in counter.vocabulary.ids.items()}
    scores = [(piece[i], token_count.zipf_score(r)) for r, i in enumerate(ids, 1)]
    top = max(s for _, s in scores)
    table = [("<unk>", top), *[(f"<0x{b:02X}>", top) for b in range(256)], *scores]
    lib = Tokenizer(models.Unigram(table, unk_id=0, byte_fallback=True))
    texts = [t.replace("▁", "") for t in texts_for_tokens()]
    texts += [r[0] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (0, "")]
    got = token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), MODEL_PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] >= 0 else ""
        want = len(lib.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
        assert r["n_tokens"] == want
    assert public_tokenizers.path("piece_bpe_32k.model") == MODEL_PATH


LINKED = [
    # (url, html, verdict): each page but the allowed ones is an alias of a blocked page
    ("http://a.example/1", '<link data-href="http://x.example/" rel=canonical href="http://bad.net/1">', "block"),
    ("http://a.example/2", '<link rel="alternate canonical" href="http://bad.net/1">', "block"),
    ("http://a.example/3", '<link title="a > b" rel="canonical" href="http://bad.net/1">', "block"),
    ("http://a.example/4", '<base href="http://bad.net/dir/"><link rel="canonical" href="page">', "block"),
    ("http://bad.net/dir/page", "", "block"),
    ("http://a.example/5", "<link rel=canonical href=http://c.example:80>", "allow"),
    ("http://c.example/", '<LINK HREF="http://C.example/#top" REL="Canonical"><meta content="0; URL=\'http://d.example\'" http-equiv="Refresh">', "allow"),
    ("http://a.example/6", '<!-- <link rel="canonical" href="http://bad.net/1"> -->', "allow"),
    ("http://a.example/7", '<link title="x rel=canonical href=http://bad.net/1" rel="next" href="http://bad.net/1">', "allow"),
    ("http://a.example/8", '<meta name="refresh" content="0;url=http://bad.net/1">', "allow"),
    ("https://e.example:443/x", '<meta http-equiv=refresh content="5;url=http://bad.net/1">', "block"),
    ("https://e.example/y", '<link rel="canonical" href="x">', "block"),
    ("http://a.example/9", "<link rel=canonical href='http://bad.net/1' " + "\"" * 4_001, "allow"),
    ("http://a.example/10", "<link " + "a='1' " * 100_000 + ">" + "<link rel=canonical href=//bad.net/1>", "block"),
    (None, "<link rel=canonical href=http://bad.net/1>", "allow"),
    ("http://a.example/11", None, "allow"),
]


def test_links_are_read_by_attribute(spark):
    rows = [(i, u, h) for i, (u, h, _) in enumerate(LINKED)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = (url_alias.Rule("net", "/", allow=False),)
    got = {r["page_id"]: r["verdict"] for r in url_alias.judge_urls(pages, rules).collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(LINKED)}


def test_ports_and_empty_paths_are_one_node(spark):
    urls = ["http://c.example", "http://c.example/", "HTTP://C.example:80/", "http://c.example:/", "http://c.example/#x"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(url_alias.node_of(F.col("u")).alias("n")).distinct().collect()
    assert [r["n"] for r in got] == ["http://c.example/"]
    other = spark.createDataFrame([("https://c.example:80/",), ("http://c.example?q=1",)], "u string").select(url_alias.node_of(F.col("u")).alias("n"))
    assert [r["n"] for r in other.collect()] == ["https://c.example:80/", "http://c.example/?q=1"]
