"""The registered queries of this package, with SQL where it can express them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    chat_format, jaccard_join, merkle, mixing, nearest, piece_bpe, quality_cascade, substring_dedup, target_resample, token_count,
    toxicity, url_alias, vector_codes,
)
from riskweave.session import prepare

#: Where the vocabulary file lies; a deployment names its own.
MODEL_PATH = os.environ.get("PIECE_BPE_MODEL", public_tokenizers.path("piece_bpe_32k.model"))

RULES = (
    url_alias.Rule("net", "/", allow=False),
    url_alias.Rule("example.net", "/en/", allow=True),
    url_alias.Rule("example.com", "/de/", allow=False),
    url_alias.Rule("org", "/fr/", allow=True),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat_format.ChatTemplate()
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(
        f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text "
        f"UNION ALL SELECT -7L, 1L, 'assistant', '{said}'"
    )
    chats = chat_format.format_chats(rows.unionByName(more), template)
    turns = chat_format.read_turns(F.col("formatted"), template)
    listed = F.array_join(
        F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = chat_format.read_loss(F.col("segments"), template)
    return (
        chats.withColumn("_turns", turns)
        .withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(listed, 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat_format.ChatTemplate().controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP1_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), walked AS (
  SELECT *,
    lag(role) OVER w AS before,
    lead(role) OVER w AS after,
    length('<|turn|>') + length('<|says|>') + length('<|end|>')
      + length({_sql_escaped("role")}) + length({_sql_escaped("text")}) AS formatted
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars,
  bool_and(
    CASE role WHEN 'system' THEN before IS NULL
      WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
      WHEN 'assistant' THEN before IS NOT NULL AND before = 'user' ELSE false END
    AND (after IS NOT NULL OR role = 'assistant')
  ) AS valid
FROM walked GROUP BY conv_id
"""


#: Target shares of tokens: language, and quality within each.
TARGETS = {
    f"{lang}/{quality}": share * part
    for lang, share in (("en", 0.50), ("de", 0.20), ("fr", 0.18), ("es", 0.12))
    for quality, part in ((1, 0.85), (0, 0.15))
}


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of documents; labelled rows give language and quality as the domain."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    domain = F.concat_ws("/", "lang", "quality")
    labelled = docs.select("doc_id", "lang").join(labels, "doc_id").filter("lang IS NOT NULL AND quality IS NOT NULL")
    return mixing.mix_to_targets(docs, labelled.select("doc_id", domain.alias("domain")), TARGETS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, _table(spark, sf_dir, "documents"), sf_dir)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.fingerprint_edits(_table(spark, sf_dir, "documents"))
    own, edited, following = F.col("print"), F.col("edited_print"), F.col("next.print")
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        merkle.printable(own).alias("fingerprint"),
        merkle.printable(edited).alias("edited_fingerprint"),
        merkle.likeness(own, edited).alias("near_edited"),
        merkle.likeness(own, following).alias("near_next"),
        merkle.first_difference(own, edited).alias("edit_at"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_alias.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _sql_rule(host: str, path: str) -> str:
    rules = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    whens = " ".join(
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.name}'"
        for r in rules
    )
    return f"CASE {whens} END"


_SQL_HOST = "translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_PATH = "coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
_SQL_NODE = "regexp_replace({u}, '(?s)#.*$', '')"
_BLOCKS = ", ".join(f"'{r.name}'" for r in RULES if not r.allow)

OP5_SQL = f"""
WITH RECURSIVE links AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS link FROM pages
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM pages
), edges AS (
  SELECT {_SQL_NODE.format(u="url")} AS a, {_SQL_NODE.format(u="link")} AS b FROM (
    SELECT url, CASE
      WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
      WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link
      WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link END AS link
    FROM links WHERE link <> '' AND contains(url, '://')
  ) WHERE link IS NOT NULL
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), nodes AS (SELECT DISTINCT a AS node FROM both_ways
), bad AS (
  SELECT node FROM (SELECT node, {_sql_rule(_SQL_HOST.format(u="node"), _SQL_PATH.format(u="node"))} AS rule FROM nodes)
  WHERE rule IN ({_BLOCKS})
  UNION
  SELECT b FROM bad JOIN both_ways ON a = node
), judged AS (
  SELECT page_id, host, path, {_sql_rule("host", "path")} AS rule, node FROM (
    SELECT page_id, {_SQL_HOST.format(u="url")} AS host, {_SQL_PATH.format(u="url")} AS path, {_SQL_NODE.format(u="url")} AS node FROM pages)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({_BLOCKS}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"))


def piece_digests(docs: DataFrame) -> DataFrame:
    """Digests of the ids of every whole text and of the text decoded from them."""
    decoded = piece_bpe.encode_and_decode(docs, MODEL_PATH)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), MODEL_PATH)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"))


def op11_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_echo_words"
    )


_SQL_WORD = r"[^\x20\x09-\x0D]"


def _sql_rejects(rule: quality_cascade.Rule) -> str:
    def count(what: str) -> str:
        return what if what in quality_cascade.MEASURES else f"len(regexp_extract_all(text, '{what}'))"

    sides = []
    if rule.most is not None:
        sides.append(f"100 * {count(rule.count)} > {rule.most} * {count(rule.over)}")
    if rule.least is not None:
        sides.append(f"100 * {count(rule.count)} < {rule.least} * {count(rule.over)}")
    return " OR ".join(sides)


OP11_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS MATERIALIZED (
  SELECT *, regexp_extract_all(text, '{_SQL_WORD}+') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_SQL_WORD}')) AS lines
  FROM texts
), windows AS (
  SELECT r, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM split)
), covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 5)) AS i
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), measured AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echo_words
  FROM split LEFT JOIN (SELECT r, count(*) AS n_repeat_words FROM covered GROUP BY r) USING (r)
), judged AS (
  SELECT * EXCLUDE chars, coalesce(chars, 0) AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {" OR ".join(f"({_sql_rejects(rule)})" for rule in quality_cascade.RULES)}) AS kept, n_lines, n_echo_words
FROM judged
"""


def op12_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte; the table of its 256 remainders follows from the polynomial.
OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), remainders AS MATERIALIZED (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), said AS MATERIALIZED (
  SELECT r, true AS ours, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc_id
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
  UNION ALL
  SELECT NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL FROM benchmark
), spoken AS MATERIALIZED (
  SELECT r, ours, unnest(w) AS word FROM said
), walk AS (
  SELECT word, hex(encode(word)) AS h, 0 AS i, 4294967295 AS c FROM (SELECT DISTINCT word FROM spoken)
  UNION ALL
  SELECT word, h, i + 1, xor(c // 256, t[xor(c % 256,
      (16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT) + 1])
  FROM walk, remainders WHERE 2 * i < length(h)
), buckets AS MATERIALIZED (
  SELECT word, xor(c, 4294967295) % 10000 AS b FROM walk WHERE 2 * i = length(h)
), counted AS (
  SELECT b, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t FROM spoken JOIN buckets USING (word) GROUP BY b
), gains AS MATERIALIZED (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted
), weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM spoken JOIN buckets USING (word) JOIN gains USING (b) WHERE ours GROUP BY r
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((list_reduce(list_transform(string_split(sha256('2024:' || doc_id)[1:8], ''),
      lambda x: (instr('0123456789abcdef', x) - 1)::BIGINT), lambda a, x: 16 * a + x) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM said LEFT JOIN weights USING (r) WHERE ours
), listed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM listed
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _op13_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    def assigned(i: int) -> str:
        gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return (
            f"near{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({gap} * {entries} + e) AS m "
            f"FROM parts JOIN book{i} USING (p) GROUP BY r, p)"
        )

    steps = []
    for i in range(rounds):
        steps += [
            assigned(i),
            f"sums{i} AS (SELECT p, m % {entries} AS e, pos, floor(sum(x[pos])::DOUBLE / count(*))::BIGINT AS c "
            f"FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS pos FROM near{i}) GROUP BY ALL)",
            f"book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM book{i} b "
            f"LEFT JOIN (SELECT p, e, list(c ORDER BY pos) AS c FROM sums{i} GROUP BY p, e) n USING (p, e))",
        ]
    joined = ",\n".join([*steps, assigned(rounds)])
    return f"""
WITH clean AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM clean, range({parts}) t(p)
), book0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {entries}
),
{joined}
, coded AS (
  SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM clean JOIN coded USING (r)
"""


OP13_SQL = _op13_sql()

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_merkle_fingerprints": op4_merkle_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_piece_bpe": op6_piece_bpe,
    "op7_nearest": op7_nearest,
    "op8_token_count": op8_token_count,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_quality_cascade": op11_quality_cascade,
    "op12_target_resample": op12_target_resample,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE = {
    "op1_chat_format": OP1_SQL,
    "op5_url_filter": OP5_SQL,
    "op11_quality_cascade": OP11_SQL,
    "op12_target_resample": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
