"""Substring dedup by recompression: every repeat of ``WINDOW`` words is found, all but its first place removed.

A text is a row of symbols, at first its words. A round names maximal runs of one symbol, then pairs of neighbours
of which the first is of the left class and the second of the right class. Names are hashes of what they stand
for and classes are bits of names, so all tasks agree on them without a shared dictionary, and equal passages get
equal symbols except near their ends. For each symbol the words are tracked on which its forming depended; a
window may use the symbols whose words all lie inside it, and takes as its anchor, from the highest round that
has one, the longest (then by hash, then leftmost). Equal windows so have the same anchor, wherever they stand.

Windows are dealt to tasks by their anchor's name, in runs that share an anchor (a shared name reveals a possible
repeat), and compared there by a 64-bit hash of their words (which verifies it); all but the first place, by
document id and position, are removed. Windows repeated within a slice of a few megabytes are settled before the
shuffle, so copies without number do not meet in one task.

Words are runs without white space, unchanged; windows are judged on the input. Null text has no words. A document is
an id with a text, in the order of ids and then of a 64-bit hash of the text: equal rows are one document and remove
nothing from each other, rows of one id with different texts are several. Null ids come last, by their texts. Ids are integers. An empty table gives
an empty table; of further columns only those named in ``carry`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import words
from riskweave.llm.ship import shipped, tidy
from riskweave.llm.words import mix

WINDOW = 20
ROUNDS = 3
#: Bytes of windows for one task of the comparison.
TASK_BYTES = 8_000_000
_LAST = (1 << 63) - 1


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b + np.uint64(salt))


class _Symbols:
    """Names of one round with the words each covers and the words its forming depended on."""

    def __init__(self, name, start, end, low, high, text):
        self.name, self.start, self.end, self.low, self.high, self.text = name, start, end, low, high, text


def _name_runs(x: _Symbols, turn: int) -> _Symbols:
    n = len(x.name)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (x.name[1:] != x.name[:-1]) | (x.text[1:] != x.text[:-1])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], n) - 1
    length = last - at + 1
    name = np.where(length > 1, _pair(x.name[at], length.astype(np.uint64), 2 * turn + 1), x.name[at])
    text = x.text[at]
    # that a run ends is seen at its neighbours; past the ends of a text lies a word no window has
    low, high = x.start[at] - 1, x.end[last] + 1
    joined = text[1:] == text[:-1]
    low[1:] = np.where(joined, x.low[last[:-1]], low[1:])
    high[:-1] = np.where(joined, x.high[at[1:]], high[:-1])
    low, high = np.minimum(low, x.low[at]), np.maximum(high, x.high[last])
    return _Symbols(name, x.start[at], x.end[last], low, high, text)


def _name_pairs(x: _Symbols, turn: int) -> _Symbols:
    n = len(x.name)
    right = (mix(x.name ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(17)) & np.uint64(1) == 1
    joined = np.zeros(n, dtype=bool)
    joined[:-1] = x.text[1:] == x.text[:-1]
    opens = np.zeros(n, dtype=bool)
    opens[:-1] = ~right[:-1] & right[1:] & joined[:-1]
    closes = np.zeros(n, dtype=bool)
    closes[1:] = opens[:-1]
    low, high = x.low.copy(), x.high.copy()
    alone_left = ~right & ~opens  # it looked to the right
    alone_right = right & ~closes  # it looked to the left
    ahead, behind = np.append(x.high[1:], 0), np.append(0, x.low[:-1])
    after = joined
    before = np.append(False, joined[:-1])
    high = np.where(alone_left, np.where(after, ahead, x.end + 1), high)
    low = np.where(alone_right, np.where(before, behind, x.start - 1), low)
    at = np.flatnonzero(~closes)
    last = at + opens[at]
    name = np.where(opens[at], _pair(x.name[at], x.name[last], 2 * turn + 2), x.name[at])
    return _Symbols(name, x.start[at], x.end[last], low[at], high[last], x.text[at])


def _best_in(priority: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Leftmost place of the highest priority in each range lo..hi."""
    out = np.empty(len(lo), dtype=np.int64)
    width = hi - lo + 1
    table = np.arange(len(priority))
    step = 1
    while True:
        here = (width >= step) & (width < 2 * step)
        if here.any():
            a, b = table[lo[here]], table[hi[here] - step + 1]
            out[here] = np.where(priority[a] >= priority[b], a, b)
        if not (width >= 2 * step).any():
            return out
        a, b = table[: len(table) - step], table[step:]
        table = np.where(priority[a] >= priority[b], a, b)
        step *= 2


def anchors(w: words.Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, name, level) of each window: the word it starts at, its anchor's name and the anchor's round."""
    total = len(w.hashes)
    text = w.text_of
    places = np.flatnonzero(text[: total - window + 1] == text[window - 1 :]) if total >= window else np.zeros(0, dtype=np.int64)
    if not len(places):
        return places, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8)
    index = np.arange(total)
    levels = [_Symbols(w.hashes, index, index + 1, index, index + 1, text)]
    for turn in range(rounds):
        levels.append(_name_pairs(_name_runs(levels[-1], turn), turn))
    name = np.zeros(len(places), dtype=np.uint64)
    level = np.full(len(places), -1, dtype=np.int8)
    left = np.arange(len(places))
    for k in range(rounds, -1, -1):
        if not len(left):
            break
        x = levels.pop()  # the highest round left; earlier ones are freed as the loop goes down
        at = places[left]
        # low and high never fall from one symbol to the next, so the symbols inside a window are neighbours
        below = np.cumsum(np.bincount(x.low + 1, minlength=total + 2))  # below[v]: low < v
        upto = np.cumsum(np.bincount(x.high, minlength=total + 2))  # upto[v]: high <= v
        lo, hi = below[at], upto[at + window] - 1
        inside = lo <= hi
        got, lo, hi = left[inside], lo[inside], hi[inside]
        priority = (np.minimum(x.end - x.start, 31).astype(np.uint64) << np.uint64(58)) | (mix(x.name) >> np.uint64(6))
        chosen = _best_in(priority, lo, hi)
        name[got], level[got] = x.name[chosen], k
        left = left[~inside]
    return places, name, level


def window_hashes(w: words.Words, places: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hashes of the word sequences of windows."""
    sums = np.zeros(len(places), dtype=np.uint64)
    for k in range(window):
        sums = sums * np.uint64(0x9FB21C651E98DF25) + w.hashes[places + k]
    return mix(sums)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers by significance, which shuffle compression likes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(breaks)
    return at, np.diff(np.append(at, len(breaks)))


def _emit(part: pa.RecordBatch, buckets: int, window: int) -> pa.RecordBatch | None:
    """Rows (bucket, docs, keys, starts, counts, hashes) for the comparison, from rows (id, key of the text, text); no
    hashes: windows already settled here."""
    part = part.take(pc.sort_indices(part, sort_keys=[("_id", "ascending"), ("_key", "ascending")]))
    ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
    w = words.split(part.column(2))
    places, name, _ = anchors(w, window)
    if not len(places):
        return None
    hashes = window_hashes(w, places, window)
    text = w.text_of[places]
    start = places - w.first[text]
    order = np.argsort(hashes, kind="stable")  # by id and place within equal hashes
    same = np.zeros(len(order), dtype=bool)
    same[1:] = hashes[order][1:] == hashes[order][:-1]
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    twin = (ids[text[order]] == ids[text[head]]) & (keys[text[order]] == keys[text[head]]) & (start[order] == start[head])
    later = np.zeros(len(order), dtype=bool)
    later[order] = same & ~twin
    home = (mix(name) % np.uint64(buckets)).astype(np.int64)
    rows = []
    for settled in (False, True):
        take = np.flatnonzero(later == settled)
        if not len(take):
            continue
        breaks = np.ones(len(take), dtype=bool)
        breaks[1:] = (np.diff(take) != 1) | (np.diff(text[take]) != 0) | (home[take][1:] != home[take][:-1])
        if settled:  # any task can pass these on
            breaks[1:] = (np.diff(take) != 1) | (np.diff(text[take]) != 0)
        at, count = _runs(breaks)
        by = np.argsort(home[take[at]], kind="stable")
        at, count = at[by], count[by]
        first = take[at]
        goes = home[first]
        cut, size = _runs(np.append(True, goes[1:] != goes[:-1]))
        for c, k in zip(cut, size):
            f, n = first[c : c + k], count[c : c + k]
            seen = b""
            if not settled:
                seen = hashes[np.repeat(f - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())].tobytes()
            rows.append((goes[c], _planes(ids[text[f]]), _planes(keys[text[f]]), _planes(start[f].astype(np.int32)), _planes(n.astype(np.int32)), seen))
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
        ["bucket", "docs", "keys", "starts", "counts", "hashes"],
    )


def _merged(d: np.ndarray, q: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (id, key, start, count) in order, those that touch made one."""
    order = np.lexsort((s, q, d))
    d, q, s, n = d[order], q[order], s[order], n[order]
    breaks = np.ones(len(d), dtype=bool)
    breaks[1:] = (d[1:] != d[:-1]) | (q[1:] != q[:-1]) | (s[1:] > s[:-1] + n[:-1])
    at, _ = _runs(breaks)
    reach = np.maximum.reduceat(s + n, at)
    return d[at], q[at], s[at], (reach - s[at]).astype(np.int32)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _key, spans): one row for each document, with its runs of windows to remove as pairs of start and count."""
    held = [tuple(_from_planes(x, kind) for x, kind in zip(row, (np.int64, np.int64, np.int32, np.int32)))
            for batch in batches for row in zip(*[x.to_pylist() for x in batch.columns[1:]])]
    if not held:
        return
    d, q, s, n = _merged(*(np.concatenate(x) for x in zip(*held)))
    pairs = np.stack([s, n], axis=1).astype(np.int32)
    cut, size = _runs(np.append(True, (d[1:] != d[:-1]) | (q[1:] != q[:-1])))
    for a in range(0, len(cut), 10_000):
        own = cut[a : a + 10_000]
        spans = [pairs[c : c + k].tobytes() for c, k in zip(own, size[a : a + 10_000])]
        yield pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(q[own]), pa.array(spans, pa.binary())], ["_id", "_key", "spans"])


def _compare(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    """(home, docs, keys, starts, counts): runs of windows to remove, packed by a hash of their documents."""
    docs, keys, starts, hashes, gone = [], [], [], [], []
    for batch in batches:
        for _, d, q, s, n, h in zip(*[c.to_pylist() for c in batch.columns]):
            d, q, s, n = _from_planes(d, np.int64), _from_planes(q, np.int64), _from_planes(s, np.int32), _from_planes(n, np.int32)
            if not h:
                gone.append((d, q, s, n))
                continue
            docs.append(np.repeat(d, n))
            keys.append(np.repeat(q, n))
            starts.append((np.repeat(s - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())).astype(np.int32))
            hashes.append(np.frombuffer(h, dtype=np.uint64))
    if docs:
        d, q, s, h = np.concatenate(docs), np.concatenate(keys), np.concatenate(starts), np.concatenate(hashes)
        docs.clear(), keys.clear(), starts.clear(), hashes.clear()
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        alike = np.zeros(len(h), dtype=bool)
        alike[1:] |= same
        alike[:-1] |= same
        order = order[alike]  # only windows that occur again
        d, q, s, h = d[order], q[order], s[order], h[order]
        order = np.lexsort((s, q, d, h))
        d, q, s, h = d[order], q[order], s[order], h[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = h[1:] != h[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
        later = (d != d[head]) | (q != q[head]) | (s != s[head])
        d, q, s = d[later], q[later], s[later]
        if len(d):
            gone.append((d, q, s, np.ones(len(d), dtype=np.int32)))
    if not gone:
        return
    d, q, s, n = _merged(*(np.concatenate(x) for x in zip(*gone)))
    home = (mix(d.view(np.uint64) ^ mix(q.view(np.uint64))) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    d, q, s, n, home = d[order], q[order], s[order], n[order], home[order]
    cut, size = _runs(np.append(True, home[1:] != home[:-1]))
    packed = [[_planes(np.ascontiguousarray(x[c : c + k])) for c, k in zip(cut, size)] for x in (d, q, s.astype(np.int32), n)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(home[cut]), *[pa.array(x, pa.binary()) for x in packed]], ["home", "docs", "keys", "starts", "counts"]
    )


def kept_words(texts: pa.Array, spans: Sequence[bytes | None], window: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts of the words no span covers, joined by one space, with the numbers of words and of removed words."""
    w = words.split(texts)
    total = len(w.hashes)
    edge = np.zeros(total + 1, dtype=np.int64)
    for i, found in enumerate(spans):
        if found:
            p = np.frombuffer(found, dtype=np.int32).reshape(-1, 2).astype(np.int64)
            limit = w.first[i + 1]
            np.add.at(edge, np.minimum(w.first[i] + p[:, 0], limit), 1)
            np.add.at(edge, np.minimum(w.first[i] + p[:, 0] + p[:, 1] - 1 + window, limit), -1)
    gone = np.cumsum(edge[:-1]) > 0
    n_words = np.diff(w.first)
    before = np.append(0, np.cumsum(gone))
    removed = before[w.first[1:]] - before[w.first[:-1]]
    keep = np.flatnonzero(~gone)
    text = w.text_of[keep]
    final = np.append(text[1:] != text[:-1], True) if len(keep) else np.zeros(0, dtype=bool)
    size = w.end[keep] - w.start[keep] + ~final
    ends = np.cumsum(size)
    padded = np.append(w.data, np.uint8(0x20))
    out = padded[np.repeat(w.start[keep] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    out[ends[~final] - 1] = 0x20
    per_text = np.append(0, ends)[np.searchsorted(text, np.arange(len(n_words) + 1))]
    joined = pa.StringArray.from_buffers(len(n_words), pa.py_buffer(per_text.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))
    return joined, n_words, removed


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), window: int = WINDOW
) -> DataFrame:
    """(doc_id, n_words, n_removed, text, and the columns of ``carry``): each text without the words of repeats."""
    shipped(docs)
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(docs[doc_id].cast("long"), F.lit(_LAST)).alias("_id"), docs[text].cast("string").alias("_text"),
        F.xxhash64(docs[text].cast("string")).alias("_key"),
        docs[doc_id].alias("_doc"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 3 // 2 // TASK_BYTES))
    buckets = 2 * tasks

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 2):
                out = _emit(part, buckets, window)
                if out is not None:
                    yield out

    dealt = rows.select("_id", "_key", "_text").mapInArrow(
        emit, "bucket long, docs binary, keys binary, starts binary, counts binary, hashes binary"
    ).repartition(tasks, "bucket")
    found = dealt.mapInArrow(lambda batches: _compare(batches, tasks), "home long, docs binary, keys binary, starts binary, counts binary")
    spans = found.repartition(tasks, "home").mapInArrow(tidy(_gather), "_id long, _key long, spans binary").withColumnRenamed("spans", "_spans")
    named = [f"_c{i}" for i in range(len(carry))]
    joined = rows.join(spans, ["_id", "_key"], "left").select("_doc", "_text", "_spans", *named)
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                kept, n, removed = kept_words(part.column(1), part.column(2).to_pylist(), window)
                columns = [part.column(0), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *part.columns[3:]], ["_doc", "n_words", "n_removed", "_text", *named]
                )

    schema = f"_doc {kinds['_doc']}, n_words long, n_removed long, _text string" + "".join(f", {c} {kinds[c]}" for c in named)
    out = joined.mapInArrow(tidy(rebuild), schema)
    return out.select(
        F.col("_doc").alias("doc_id"), "n_words", "n_removed", F.col("_text").alias("text"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )
