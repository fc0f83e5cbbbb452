"""Quality rules as a short-circuit cascade.

A rule compares two counts of a text: it rejects when ``100 * count`` is above ``most`` times, or below ``least``
times, the count named ``over``. Counts are base measures or the matches of a pattern. A text leaves the cascade at
the first rule that rejects it, so later rules never see it. ``plan_cascade`` times every rule on a bounded sample
and takes, again and again, the rule that rejects most of the sample texts still left per second; rules that reject
what others reject already come late. The order changes the cost, never the verdict.

Base measures are worked out for every whole text: words, their code points, symbols, lines with a word, those equal
to an earlier line, words inside five-word windows that stand twice or more (windows are compared as 64-bit
hashes within one text), and words equal to the word before them.

Null and empty texts have no words, so the base test rejects them; repeated rows are judged each for itself, null ids
stay null; a very long text is one value of one task, counted in linear time; an empty table gives an empty table;
only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import words
from riskweave.llm.ship import shipped

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words")
SYMBOLS = "#*$%&|<>"
#: Words in a window; fewest words; most percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Rows on which the order of the rules is estimated.
SAMPLE_ROWS = 2_000

_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``100 * count`` leaves ``least`` to ``most`` times the count ``over``.

    ``count`` and ``over`` are measures of this module or RE2 patterns whose matches are counted.
    """

    name: str
    count: str
    over: str
    most: int | None = None
    least: int | None = None


#: Thresholds in percent, as published for web corpora; none depends on a language.
RULES = (
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("echoed words", "n_echo_words", "n_words", most=30),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=50),
    Rule("word length", "word_chars", "n_words", most=1500, least=200),
    Rule("words with a letter", rf"{_WORD}*\p{{L}}{_WORD}*", "n_words", least=60),
    Rule("capitals", r"\p{Lu}", r"\p{L}", most=50),
    Rule("shouting", r"[!?]{2,}", "n_words", most=10),
    Rule("digits", r"\p{Nd}", "word_chars", most=50),
    Rule("bullets", r"(?m)^[ \t]*[-•‣●*]", "n_lines", most=90),
    Rule("open lines", r"(?m)(?:…|\.\.\.)[ \t\r]*$", "n_lines", most=30),
    Rule("placeholders", r"(?i)\blorem ipsum\b", "n_words", most=0),
    Rule("broken characters", r"[\x00-\x08\x0E-\x1F\x{FFFD}]", "word_chars", most=1),
)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags of each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
#: Bytes that begin a code point which is no white space.
_OPENS = np.array([(b < 0x80 or b >= 0xC0) and b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def _repeated_words(split: words.Words) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n, total = len(split.first) - 1, len(split.hashes)
    found = np.zeros(n, dtype=np.int64)
    if total < WINDOW:
        return found
    text = split.text_of
    at = np.flatnonzero(text[: total - WINDOW + 1] == text[WINDOW - 1 :])
    key = text[at].astype(np.uint64) + np.uint64(1)
    for j in range(WINDOW):
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + split.hashes[at + j])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    steps = np.zeros(total + 1, dtype=np.int32)
    begins = at[order[twice]]
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + WINDOW, -1)
    return _per_text(np.cumsum(steps[:-1]) > 0, split.first)


def _echoed_words(split: words.Words) -> np.ndarray:
    """Words of each text that equal the word before them."""
    echo = np.zeros(len(split.hashes), dtype=bool)
    if len(echo):
        text = split.text_of
        echo[1:] = (split.hashes[1:] == split.hashes[:-1]) & (text[1:] == text[:-1])
    return _per_text(echo, split.first)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base measures of some texts."""
    n = len(texts)
    split = words.split(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if body is None else np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lines, repeated = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts.to_pylist()):
        wordy = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")]
        lines[i], repeated[i] = len(wordy), len(wordy) - len(set(wordy))
    found = (
        np.diff(split.first), _per_text(_OPENS[data], offsets), _per_text(_IS_SYMBOL[data], offsets), lines, repeated,
        _repeated_words(split), _echoed_words(split),
    )
    return dict(zip(MEASURES, found))


def base_fails(measured: dict[str, np.ndarray]) -> np.ndarray:
    """Texts of few words or of mostly repeated words."""
    n = measured["n_words"]
    return (n < LEAST_WORDS) | (100 * measured["n_repeat_words"] > MOST_REPEATED * n)


def _count(what: str, texts: pa.Array, measured: dict[str, np.ndarray]) -> np.ndarray:
    if what in measured:
        return measured[what]
    return pc.count_substring_regex(texts, what).to_numpy(zero_copy_only=False).astype(np.int64)


def rejects(rule: Rule, texts: pa.Array, measured: dict[str, np.ndarray]) -> np.ndarray:
    """Which of some texts a rule rejects."""
    count, over = 100 * _count(rule.count, texts, measured), _count(rule.over, texts, measured)
    out = np.zeros(len(texts), dtype=bool)
    if rule.most is not None:
        out |= count > rule.most * over
    if rule.least is not None:
        out |= count < rule.least * over
    return out


def cascade(rules: Sequence[Rule], texts: pa.Array, measured: dict[str, np.ndarray], left: np.ndarray) -> np.ndarray:
    """For each text the number of the first rule that rejects it, -1 where none does; only texts ``left`` are judged."""
    first = np.full(len(texts), -1, dtype=np.int32)
    rows = np.flatnonzero(left)
    for number, rule in enumerate(rules):
        if not len(rows):
            break
        patterns = rule.count not in measured or rule.over not in measured
        some = texts.take(pa.array(rows)) if patterns else pa.nulls(len(rows))
        bad = rejects(rule, some, {k: v[rows] for k, v in measured.items()})
        first[rows[bad]] = number
        rows = rows[~bad]
    return first


def greedy_order(rules: Sequence[Rule], verdicts: Sequence[int], seconds: Sequence[float]) -> list[Rule]:
    """Rules by rejections per second among sample texts that earlier ones leave.

    Bit i of a verdict is set where rule i rejects that text. Rules without a rejection come last, cheap ones first;
    ties keep the given order.
    """
    left, todo, order = list(verdicts), list(range(len(rules))), []
    while todo:
        gains = {i: sum(v >> i & 1 for v in left) for i in todo}
        best = min(todo, key=lambda i: (-gains[i] / max(seconds[i], 1e-9), seconds[i] if not gains[i] else 0.0, i))
        todo.remove(best)
        order.append(rules[best])
        left = [v for v in left if not v >> best & 1]
    return order


def plan_cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """The rules in the order that a sample of at most ``sample_rows`` texts suggests.

    Only one number and the rules' times per sample row reach the driver.
    """
    texts = docs.select(docs[text].cast("string").alias("text")).filter("text IS NOT NULL")
    total = texts.count()
    if total == 0:
        return list(rules)
    share = min(1.0, 2 * sample_rows / total)
    chosen = texts.filter(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 0):
                column = part.column(0)
                measured = measure(column)
                verdict = np.zeros(len(column), dtype=np.int64)
                spent = []
                for i, rule in enumerate(rules):
                    start = time.process_time()
                    verdict |= rejects(rule, column, measured).astype(np.int64) << i
                    spent.append((time.process_time() - start) / len(column))
                verdict[base_fails(measured)] = -1  # never reach the cascade
                yield pa.RecordBatch.from_arrays([pa.array(verdict), pa.array([spent] * len(column))], ["verdict", "spent"])

    rows = shipped(chosen).limit(sample_rows).mapInArrow(run, "verdict long, spent array<double>").collect()
    seconds = np.array([r["spent"] for r in rows]).mean(axis=0) if rows else np.zeros(len(rules))
    return greedy_order(rules, [r["verdict"] for r in rows if r["verdict"] >= 0], seconds.tolist())


def judge_quality(
    docs: DataFrame, rules: Sequence[Rule] = RULES, *, doc_id: str = "doc_id", text: str = "text", planned: bool = True
) -> DataFrame:
    """(doc_id, the measures, base_failed, kept, rejected_by) of every whole text.

    ``rejected_by`` names the rule that ended a text's way through the cascade (null: none, or the base test did).
    ``planned=False`` keeps the given order of the rules.
    """
    if len({rule.name for rule in rules}) != len(rules) or len(rules) > 62:
        raise ValueError("rules need different names, 62 at most")
    order = plan_cascade(docs, rules, text=text) if planned else list(rules)
    names = pa.array([rule.name for rule in order], pa.string())
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", *MEASURES, "base_failed", "kept", "rejected_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                texts = part.column(1)
                measured = measure(texts)
                failed = base_fails(measured)
                first = cascade(order, texts, measured, ~failed)
                by = names.take(pa.array(first, mask=first < 0)) if len(names) else pa.nulls(len(first), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(measured[m]) for m in MEASURES), pa.array(failed), pa.array(~failed & (first < 0)), by],
                    columns,
                )

    return shipped(rows).mapInArrow(
        run, f"doc_id {kind}, {', '.join(m + ' long' for m in MEASURES)}, base_failed boolean, kept boolean, rejected_by string"
    )
