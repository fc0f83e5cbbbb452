"""N-gram Jaccard join: exact links between shingle sets by universe partition and the pigeonhole principle.

Sets are put into bands by size. In a band every shingle belongs, by its hash, to one of m segments. Two sets with
Jaccard similarity of at least ``delta`` differ in at most H = (1 - delta) / (1 + delta) * (sum of sizes) shingles,
so of any H + 1 segments one holds equal subsets. A set indexes the subset of each of its band's segments and
probes the H + 1 cheapest ones in its own and the next lower band: those whose subset has a shingle that is not
frequent, fuller ones first, those of frequent shingles only next, empty ones last. In the bands of small sets,
where segments may be empty, one-deletion neighbourhoods are indexed too, and a probe that also takes them counts
for two segments. Candidates are verified on the whole sets.

Equal sets form one class, of which one document stands for all. Each has a histogram of its shingles over
``BUCKETS`` hash classes: the distance of two histograms never exceeds the difference of the sets, so pairs whose
histograms differ too much are left out before whole sets are sent for. Large candidate groups are not expanded
into pairs at once: each group is compared with one of its members, what is linked is connected, and only members
still in other components go on, as long as that settles most of what is open. What is left is compared pair by
pair, so no link is lost. A group of more than ``BLOCK`` members is cut into blocks by size and a salt; every pair of
blocks whose sizes can still reach ``delta`` is a row key of its own, and members of a group's largest component meet
only the others, so no task holds a group.

Words are runs without white space, A-Z lower-cased. Fewer than five words make one shingle; a document without
words (null or blank text) is empty and linked with nothing. Repeated rows keep their rows; rows of one id are one
document. A null id gets the component of its copies, else null. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm import words
from riskweave.llm.components import components
from riskweave.llm.ship import shipped, tidy
from riskweave.llm.words import mix
from riskweave.session import cut_lineage

SHINGLE = 5
PERCENT = 80
#: Bands up to this size also index one-deletion neighbourhoods.
DELETION_SIZE = 32
#: Frequent shingles steer the choice of segments only; so many are sent to the workers (eight bytes each).
FREQUENT, FREQUENT_FROM = 20_000, 24
#: Groups up to this many sets give all their pairs at once.
SMALL_GROUP = 8
#: Pairs per row that may stay open after a round for the rest to be compared; a further round must halve them.
OPEN_PAIRS = 1_000
#: Members of a group that are compared in one task.
BLOCK = 2_048
#: Hash classes of the histograms that rule out pairs.
BUCKETS = 256
#: Classes added up for coarse histograms.
COARSE = 8
#: Bytes of signatures for one task, and ids of candidates that may be broadcast; more are joined.
TASK_BYTES, BROADCAST_IDS = 8_000_000, 500_000

_PROBE, _INDEX = np.uint64(1), np.uint64(2)
_FLAGS = np.uint64(3)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first, shingles): distinct shingle hashes of each text, ascending within the text."""
    w = words.split(texts, lower=True)
    n = np.diff(w.first)
    h, total = w.hashes, len(w.hashes)
    text_of = w.text_of
    found, owner = [], []
    if total >= SHINGLE:
        m = total - SHINGLE + 1
        s = np.zeros(m, dtype=np.uint64)
        for k in range(SHINGLE):
            s = s * np.uint64(0x9FB21C651E98DF25) + h[k : k + m]
        inside = text_of[:m] == text_of[SHINGLE - 1 :]
        found.append(mix(s[inside]))
        owner.append(text_of[:m][inside])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    for length in range(1, SHINGLE):
        rows = short[n[short] == length]
        s = np.full(len(rows), np.uint64(length)) * np.uint64(0xA24BAED4963EE407)
        for k in range(length):
            s = s * np.uint64(0x9FB21C651E98DF25) + h[w.first[rows] + k]
        found.append(mix(s))
        owner.append(rows)
    if not found:
        return np.zeros(len(n) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    s, o = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    s, o = s[fresh], o[fresh]
    return np.searchsorted(o, np.arange(len(n) + 1)), s


def _set_keys(first: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; empty sets have zeros."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x6A09E667F3BCC909):
        sums = np.zeros(len(s) + 1, dtype=np.uint64)
        np.cumsum(mix(s ^ np.uint64(salt)), out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.uint64(1)))
    return out[0] & ~_FLAGS, out[1]


@lru_cache(maxsize=4)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest size, allowed difference and segments of each band. A set's partners lie in its own
    band, the one below or the one above."""
    lo, hi = [], []
    at = 1
    while at < 1 << 40:
        top = at if at < 5 else at * 3 // 2
        lo.append(at)
        hi.append(top)
        at = top + 1
    low, high = np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64)
    most = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
    need = most + 1
    slack = np.where(high < 5, 0, need // 10 + np.sqrt(need).astype(np.int64) // 2 + 1)
    return low, high, most, need + slack


def _scheme(first, s, rows, band, probe_only, percent, keys, frequent):
    """Signatures and class keys (flags in the low bits) of the given sets in the given bands."""
    _, high, _, segments = bands(percent)
    size = np.diff(first)[rows]
    m = segments[band]
    base = np.concatenate([[0], np.cumsum(m)])
    token_row = np.repeat(np.arange(len(rows)), size)
    starts = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)])[:-1], size)
    t = s[starts + np.arange(len(token_row))]
    salt = (band[token_row] + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    scrambled = mix(t ^ salt)
    slot = base[token_row] + ((scrambled >> np.uint64(32)) * m[token_row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    value = mix(t + np.uint64(0x632BE59BD9B4E019))
    total = int(base[-1])
    subset = np.zeros(total, dtype=np.uint64)
    np.add.at(subset, slot, value)
    count = np.bincount(slot, minlength=total)
    common = np.zeros(len(t), dtype=bool)
    if len(frequent):
        at = np.searchsorted(frequent, t)
        common = frequent[np.minimum(at, len(frequent) - 1)] == t
    rare = np.bincount(slot[~common], minlength=total)
    row = np.repeat(np.arange(len(rows)), m)
    segment = np.arange(total) - base[row]
    place = mix(((band[row] + 1).astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64))
    signature = mix(subset + place)

    # allocation: the cheapest segments until enough differences are covered
    top = np.minimum(high[band], size)
    need = (size + top) * (100 - percent) // (100 + percent) + 1
    cost = np.where(rare > 0, -np.minimum(rare, 1000), np.where(count > 0, 10_000 - np.minimum(count, 1000), 100_000))
    order = np.lexsort((cost, row))
    rank = np.empty(total, dtype=np.int64)
    rank[order] = np.arange(total) - base[row[order]]
    probe = rank < need[row]
    small = high[band] <= DELETION_SIZE
    twice = np.zeros(total, dtype=bool)
    if small.any():
        filled = np.bincount(row, weights=rare > 0, minlength=len(rows)).astype(np.int64)
        missing = np.where(small, np.maximum(0, need - filled), 0)
        raised = np.minimum(missing, filled)  # so many probes also take neighbourhoods and count for two
        twice = (rank < raised[row]) & (rare > 0)
        probe = rank < (need - raised)[row]
    flags = np.where(probe, _PROBE, np.uint64(0))
    if not probe_only:
        flags = flags | _INDEX
    keep = flags > 0
    sigs, owners = [signature[keep]], [keys[rows[row[keep]]] | flags[keep]]
    # one-deletion neighbourhoods: indexed for every small set, probed where a segment counts for two
    tokens = np.flatnonzero(small[token_row])
    if len(tokens):
        own = np.where(twice[slot[tokens]], _PROBE, np.uint64(0))
        if not probe_only:
            own = own | _INDEX
        take = own > 0
        tokens, own = tokens[take], own[take]
        sigs.append(mix(subset[slot[tokens]] - value[tokens] + place[slot[tokens]]))
        owners.append(keys[rows[token_row[tokens]]] | own)
    return np.concatenate(sigs), np.concatenate(owners)


def signatures(first: np.ndarray, s: np.ndarray, percent: int = PERCENT, frequent: np.ndarray | None = None):
    """All signatures of some sets and, with each, its set's class key with flags."""
    frequent = np.zeros(0, dtype=np.uint64) if frequent is None else frequent
    low, high, _, _ = bands(percent)
    size = np.diff(first)
    keys, _ = _set_keys(first, s)
    rows = np.flatnonzero(size > 0)
    _, once = np.unique(keys[rows], return_index=True)  # copies in one slice count once
    rows = rows[once]
    band = np.searchsorted(high, size[rows])
    own = _scheme(first, s, rows, band, False, percent, keys, frequent)
    down = (band > 0) & (-(-size[rows] * percent // 100) <= high[np.maximum(band - 1, 0)])
    lower = _scheme(first, s, rows[down], band[down] - 1, True, percent, keys, frequent)
    return np.concatenate([own[0], lower[0]]), np.concatenate([own[1], lower[1]])


def candidates(sig: np.ndarray, owner: np.ndarray):
    """Pairs within small groups, and the members of large ones, of rows that share a signature."""
    key, flags = owner & ~_FLAGS, owner & _FLAGS
    order = np.lexsort((key, sig))
    sig, key, flags = sig[order], key[order], flags[order]
    fresh = np.ones(len(sig), dtype=bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(fresh)
    flags = np.bitwise_or.reduceat(flags, at) if len(at) else flags
    sig, key = sig[at], key[at]
    edge = np.ones(len(sig), dtype=bool)
    edge[1:] = sig[1:] != sig[:-1]
    begin = np.flatnonzero(edge)
    size = np.diff(np.append(begin, len(sig)))
    probed = np.bitwise_or.reduceat(flags, begin) & _PROBE if len(begin) else flags
    live = (size > 1) & (probed > 0)
    width = np.repeat(np.where(live, size, 0), size)
    lefts, rights = [], []
    for off in range(1, SMALL_GROUP):
        a = np.flatnonzero((width[:-off] > off) & (width[:-off] <= SMALL_GROUP) & (sig[:-off] == sig[off:])) if len(sig) > off else np.zeros(0, dtype=np.int64)
        b = a + off
        fits = ((flags[a] & _PROBE) > 0) & ((flags[b] & _INDEX) > 0) | ((flags[b] & _PROBE) > 0) & ((flags[a] & _INDEX) > 0)
        lefts.append(key[a[fits]])
        rights.append(key[b[fits]])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    if len(left):
        pairs = np.unique(np.stack([left, right], axis=1), axis=0)
        left, right = pairs[:, 0], pairs[:, 1]
    big = width > SMALL_GROUP
    members = key[big]
    group_of = np.cumsum(edge)[big]
    # groups of the same members are one group
    names = np.zeros(0, dtype=np.uint64)
    if len(members):
        cut = np.flatnonzero(np.concatenate([[True], group_of[1:] != group_of[:-1]]))
        name = mix(np.add.reduceat(mix(members), cut))
        names = np.repeat(name, np.diff(np.append(cut, len(members))))
    return left, right, names, members


def _profile(docs: DataFrame) -> DataFrame:
    """(kind, doc_id, n, k1, k2): kind 0 has size and class keys of each document, kind 1 counts of shingles that are
    frequent in some slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                first, s = shingle_sets(part.column(1))
                k1, k2 = _set_keys(first, s)
                n = np.diff(first)
                seen, times = np.unique(s, return_counts=True)
                often = np.flatnonzero(times >= 3)
                often = often[np.argsort(-times[often], kind="stable")[:1024]]
                ids = pa.concat_arrays([part.column(0), pa.nulls(len(often), part.column(0).type)])
                kind = np.concatenate([np.zeros(len(n), dtype=np.int32), np.ones(len(often), dtype=np.int32)])
                columns = [
                    pa.array(kind),
                    ids,
                    pa.array(np.concatenate([n, times[often]]).astype(np.int64)),
                    pa.array(np.concatenate([k1, seen[often]]).view(np.int64)),
                    pa.array(np.concatenate([k2, np.zeros(len(often), dtype=np.uint64)]).view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "n", "k1", "k2"])

    return docs.mapInArrow(tidy(run), f"kind int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, k1 long, k2 long")


def _candidate_rows(docs: DataFrame, frequent: np.ndarray, shingles: int, percent: int) -> DataFrame:
    """(g, a, b): g 0 for a pair of class keys, else a group and one of its members."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent)  # at most FREQUENT values
    tasks = max(1, -(-shingles * 16 // TASK_BYTES))
    buckets = 2 * tasks  # from bytes alone: a slice makes one blob for each

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                sig, owner = signatures(*shingle_sets(part.column(1)), percent, known.value)
                home = (sig % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                home = home[order]
                rows = np.stack([sig[order], owner[order]], axis=1)
                cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else []
                blobs = [rows[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(home)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home[cut] if len(home) else home, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "rows"]
                )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for b in batches for x in b.column(1).to_pylist()]
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        left, right, names, members = candidates(rows[:, 0], rows[:, 1])
        g = np.concatenate([np.zeros(len(left), dtype=np.uint64), names])
        b = np.concatenate([right, np.zeros(len(names), dtype=np.uint64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.view(np.int64)) for x in (g, np.concatenate([left, members]), b)], ["g", "a", "b"]
        )

    blobs = docs.mapInArrow(tidy(emit), "bucket long, rows binary").repartition(tasks, "bucket")
    return blobs.mapInArrow(tidy(match), "g long, a long, b long")


def _histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((mix(s) >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of histograms, at most the differences of the sets."""
    return np.abs(a.astype(np.int16) - b).sum(axis=-1, dtype=np.int64)


def _sets_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, n, set, histogram): the shingles of the documents that are candidates."""
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)  # its size was just checked
    rows = docs.join(needed, docs["doc_id"] == needed["id"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                first, s = shingle_sets(part.column(1))
                sets = [s[a:b] for a, b in zip(first[:-1], first[1:])]
                columns = [part.column(0), pa.array(np.diff(first)), pa.array([x.tobytes() for x in sets], pa.binary())]
                columns.append(pa.array([_histogram(x) for x in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set", "histogram"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n long, set binary, histogram binary")


def _fitting(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that sizes and histograms do not rule out."""
    a = sets.select(F.col("doc_id").alias("x"), F.col("n").alias("_nx"), F.col("histogram").alias("_hx"))
    b = sets.select(F.col("doc_id").alias("y"), F.col("n").alias("_ny"), F.col("histogram").alias("_hy"))
    near = F.least("_nx", "_ny") * 100 >= F.greatest("_nx", "_ny") * percent
    rows = pairs.join(a, "x").join(b, "y").filter(near).select("x", "y", "_nx", "_ny", "_hx", "_hy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                hx, hy = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS) for i in (4, 5))
                keep = _apart(hx, hy) * (100 + percent) <= n * (100 - percent)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["x", "y"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"x {kind}, y {kind}")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, shared, united) of pairs of ids, from the whole sets."""
    xs = sets.select(F.col("doc_id").alias("x"), F.col("set").alias("_sx"))
    ys = sets.select(F.col("doc_id").alias("y"), F.col("set").alias("_sy"))
    both = pairs.join(xs, "x").join(ys, "y").select("x", "y", "_sx", "_sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, united = [], []
            for p, q in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(p.as_buffer(), dtype=np.uint64), np.frombuffer(q.as_buffer(), dtype=np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                n = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(a) else 0
                shared.append(n)
                united.append(len(a) + len(b) - n)
            columns = [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(united, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["x", "y", "shared", "united"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(tidy(run), f"x {kind}, y {kind}, shared long, united long")


def _pivot_pairs(groups: DataFrame, turn: int) -> DataFrame:
    """(x, y): every member of a group with the one that is first by a hash of this turn."""
    first = groups.groupBy("g").agg(F.min_by("x", F.xxhash64("x", F.lit(turn))).alias("_p"))
    both = groups.join(first, "g").filter("x <> _p")
    return both.select(F.least("x", "_p").alias("x"), F.greatest("x", "_p").alias("y"))


def _met(a: tuple, b: tuple | None, percent: int) -> tuple[list, list]:
    """Pairs of members (ids, components, sizes, histograms) in different components that sizes and histograms allow:
    between two blocks, or (``b`` None) within one. Coarse histograms rule out most pairs first."""

    def by_size(block: tuple) -> tuple:
        order = np.argsort(block[2], kind="stable")
        ids, comp, n, hist = (x[order] for x in block)
        return ids, comp, n, hist, hist.reshape(len(ids), -1, COARSE).sum(axis=2, dtype=np.int16)

    first = by_size(a)
    second = first if b is None else by_size(b)
    ids, comp, n, hist, coarse = second
    low = np.searchsorted(n, -(-first[2] * percent // 100)) if b is not None else np.arange(1, len(n) + 1)
    high = np.searchsorted(n, first[2] * 100 // percent, side="right")
    left, right = [], []
    for i in range(len(first[0])):
        mine, c, size, own, rough = (x[i] for x in first)
        part = slice(low[i], high[i])
        most = (n[part] + size) * (100 - percent)
        at = np.flatnonzero((comp[part] != c) & (np.abs(coarse[part] - rough).sum(axis=1) * (100 + percent) <= most))
        if len(at):
            at = at[_apart(hist[part][at], own) * (100 + percent) <= most[at]]
            left.append(np.minimum(ids[part][at], mine))
            right.append(np.maximum(ids[part][at], mine))
    return left, right


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (k, side, x, c, n, histogram) from rows (g, x, c, n, histogram): ``k`` names a whole group of up to ``BLOCK``
    members (side 0) or a pair of blocks of a larger one (sides 0 and 1, or 0 alone for a block with itself).

    Blocks part a group by size, so that partners lie in one band or in neighbours, by whether a member is of the
    group's largest component, and by a salt.
    """
    sizes = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("_m"))
    whole = sizes.groupBy("g").agg(F.sum("_m").alias("_all"), F.max_by("c", F.struct("_m", "c")).alias("_mass"))
    rows = rows.join(whole, "g")
    small = rows.filter(F.col("_all") <= BLOCK).select(
        F.xxhash64("g", F.lit(-1)).alias("k"), F.lit(0).alias("side"), "x", "c", "n", "histogram"
    )
    large = rows.filter(F.col("_all") > BLOCK).withColumns(
        # sizes of partners differ by a factor of 1.25 at most, so less than one band
        {"_band": F.floor(F.log("n") / F.lit(float(np.log(1.2501)))).cast("int"), "_other": F.col("c") != F.col("_mass")}
    )
    name = lambda band, other: F.concat(band.cast("string"), F.when(other, "o").otherwise("m"))
    counts = large.groupBy("g", "_band", "_other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_k"))
    # one entry per band of sizes, at most some dozens
    known = counts.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("_band"), F.col("_other")), "_k"))).alias("_blocks"))
    large = large.join(known, "g")
    own = F.try_element_at("_blocks", name(F.col("_band"), F.col("_other")))
    salt = F.pmod(F.xxhash64("x", F.lit("block")), own)

    def against(step: int, other: bool, first: bool | None) -> Column:
        """Keys with the blocks ``step`` bands up; ``first``: whether this side is named first (None: by salt)."""
        to = name(F.col("_band") + step, F.lit(other))
        many = F.coalesce(F.try_element_at("_blocks", to), F.lit(0).cast("long"))
        mine = F.concat(name(F.col("_band"), F.col("_other")), F.lit(":"), salt.cast("string"))

        def key(t: Column) -> Column:
            theirs = F.concat(to, F.lit(":"), t.cast("string"))
            ahead = F.lit(first) if first is not None else salt <= t
            name_of = F.when(ahead, F.concat_ws("|", mine, theirs)).otherwise(F.concat_ws("|", theirs, mine))
            return F.struct(F.xxhash64("g", name_of).alias("k"), F.when(ahead, 0).otherwise(1).alias("side"))

        return F.when(many > 0, F.transform(F.sequence(F.lit(0).cast("long"), many - 1), key)).otherwise(F.array().cast("array<struct<k:bigint,side:int>>"))

    others = F.concat(against(0, True, None), against(1, True, True), against(-1, True, False), *[against(d, False, True) for d in (-1, 0, 1)])
    mass = F.concat(*[against(d, True, False) for d in (-1, 0, 1)])
    dealt = large.withColumn("_to", F.explode(F.when(F.col("_other"), others).otherwise(mass)))
    return small.unionByName(dealt.select("_to.k", "_to.side", "x", "c", "n", "histogram"))


def _open_pairs(rows: DataFrame, percent: int, largest: int) -> DataFrame:
    """All pairs of the groups still to compare, from rows (g, x, c, n, histogram); ``largest``: members of the largest."""

    def of(table: pa.Table) -> pa.RecordBatch:
        k, side, x, c, n = (table.column(i).to_numpy() for i in range(5))
        hist = np.frombuffer(b"".join(table.column(5).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS)
        cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        left, right = [x[:0]], [x[:0]]
        for a, b in zip(cut, np.append(cut[1:], len(k))):
            middle = a + int(np.searchsorted(side[a:b], 1))
            first, second = ((x[p:q], c[p:q], n[p:q], hist[p:q]) for p, q in ((a, middle), (middle, b)))
            # a key of two blocks of which one has no row has nothing to compare
            found = _met(first, second if len(second[0]) else None, percent) if len(first[0]) else ([], [])
            left += found[0]
            right += found[1]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["x", "y"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of the last key seen, which may go on: two blocks at most
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[batch.num_rows - 1].as_py()
            start = int(np.searchsorted(batch.column(0).to_numpy(), last))
            if start == 0 and waiting and waiting[-1].column(0)[0].as_py() == last:
                waiting.append(batch)
                continue
            if waiting or start:
                yield of(pa.Table.from_batches([*waiting, batch.slice(0, start)]))
            waiting = [batch.slice(start)]
        if waiting:
            yield of(pa.Table.from_batches(waiting))

    kind = rows.schema["x"].dataType.simpleString()
    whole = rows.select(F.col("g").alias("k"), F.lit(0).alias("side"), "x", "c", "n", "histogram")
    dealt = (whole if largest <= BLOCK else _blocked(rows)).repartition("k").sortWithinPartitions("k", "side")
    return dealt.mapInArrow(tidy(stream), f"x {kind}, y {kind}").distinct()


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, c) after more links, by the components of the few components they touch."""
    x = comp.select(F.col("id").alias("x"), F.col("c").alias("_cx"))
    y = comp.select(F.col("id").alias("y"), F.col("c").alias("_cy"))
    edges = cut_lineage(links.join(x, "x").join(y, "y").filter("_cx <> _cy").select("_cx", "_cy").distinct())
    if edges.isEmpty():
        return comp
    merged = components(edges, "_cx", "_cy").withColumnsRenamed({"node": "c", "component": "_new"})
    return cut_lineage(comp.join(merged, "c", "left").select("id", F.coalesce("_new", "c").alias("c")))


def _started(ids: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, c) of ids by their first links."""
    found = components(links, "x", "y").withColumnsRenamed({"node": "id", "component": "_new"})
    return cut_lineage(ids.join(found, "id", "left").select("id", F.coalesce("_new", "id").alias("c")))


def _settle(pairs: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, c): components of all candidates, from candidate pairs and large candidate groups."""

    def linked(p: DataFrame) -> DataFrame:
        # stored first: ruling out and verifying in one task would take two Python workers for it
        found = _verified(cut_lineage(p), sets.select("doc_id", "set"))
        return cut_lineage(found.filter((F.col("shared") * 100 >= F.col("united") * percent) & (F.col("united") > 0)).select("x", "y"))

    comp = _started(sets.select(F.col("doc_id").alias("id")).distinct(), linked(_fitting(pairs.unionByName(_pivot_pairs(groups, 0)).distinct(), sets, percent)))
    traits = sets.select(F.col("doc_id").alias("x"), "n", "histogram")
    turn, before = 0, None
    while True:
        turn += 1
        named = groups.join(comp.withColumnRenamed("id", "x"), "x")
        torn = named.groupBy("g", "c").agg(F.count(F.lit(1)).alias("_m")).groupBy("g").agg(
            F.sum("_m").alias("_n"), (F.pow(F.sum("_m").cast("double"), 2) - F.sum(F.pow(F.col("_m").cast("double"), 2))).alias("_open")
        )
        torn = cut_lineage(torn.filter("_open > 0"))
        left = torn.agg(F.sum("_n").alias("n"), F.sum("_open").alias("open"), F.max("_n").alias("most")).first()
        if not left["n"]:
            return comp
        groups = named.join(torn, "g", "left_semi").select("g", "x", "c")
        settled = left["open"] <= OPEN_PAIRS * left["n"] or (before is not None and left["open"] * 2 > before)
        if settled:
            rows = groups.join(traits, "x")
            return _joined(comp, linked(_open_pairs(rows, percent, left["most"])))
        before = left["open"]
        groups = cut_lineage(groups)
        pivots = _pivot_pairs(groups, turn).distinct()
        comps = groups.select("x", "c").distinct()
        apart = pivots.join(comps, "x").join(comps.withColumnsRenamed({"x": "y", "c": "_d"}), "y").filter("c <> _d")
        comp = _joined(comp, linked(_fitting(apart.select("x", "y"), sets, percent)))
        groups = groups.select("g", "x")


def similar_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): one row per row of ``docs``. ``class_id`` is the smallest id with
    the same shingles, ``component_id`` the smallest id reachable by links of at least ``percent`` hundredths."""
    rows = shipped(docs).select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    profile = cut_lineage(_profile(rows))
    frequent = (
        profile.filter("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_FROM)
        .orderBy(F.desc("n"), "k1").limit(FREQUENT).select("k1").toPandas()["k1"].to_numpy(dtype=np.int64)
    )
    sets = profile.filter("kind = 0").select("doc_id", "n", "k1", "k2")
    full = sets.filter("n > 0")
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    classes = cut_lineage(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n")))
    named = classes.filter("class_id IS NOT NULL")
    found = cut_lineage(_candidate_rows(rows, np.sort(frequent.view(np.uint64)), shingles, percent))

    a = named.select(F.col("k1").alias("a"), F.col("class_id").alias("_x"))
    b = named.select(F.col("k1").alias("b"), F.col("class_id").alias("_y"))
    pairs = found.filter("g = 0").select("a", "b").distinct().join(a, "a").join(b, "b")
    pairs = pairs.select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).filter("x <> y").distinct()
    groups = found.filter("g <> 0").select("g", "a").distinct().join(a, "a").select("g", F.col("_x").alias("x")).distinct()
    pairs, groups = cut_lineage(pairs), cut_lineage(groups)
    needed = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id")))
    needed = cut_lineage(needed.unionByName(groups.select(F.col("x").alias("id"))).distinct())
    held = cut_lineage(_sets_of(rows, needed))
    settled = _settle(pairs, groups, held, percent)

    classed = sets.join(classes.select("k1", "k2", "class_id"), ["k1", "k2"], "left")
    classed = classed.withColumn("class_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
    # rows of one id with different texts hold their classes together
    repeated = classed.groupBy("doc_id").agg(F.min("class_id").alias("_a"), F.max("class_id").alias("_b")).filter("doc_id <> _b OR _a <> _b")
    torn = repeated.filter("_a <> _b").select("doc_id")
    ties = classed.join(torn, "doc_id", "left_semi").select(F.col("doc_id").alias("x"), F.col("class_id").alias("y")).filter("x <> y")
    joined = settled.withColumnsRenamed({"id": "class_id", "c": "_c"})
    ties = cut_lineage(ties)
    if not ties.isEmpty():
        links = settled.filter("id <> c").select(F.col("id").alias("x"), F.col("c").alias("y"))
        joined = components(links.unionByName(ties), "x", "y").withColumnsRenamed({"node": "class_id", "component": "_c"})
    return classed.join(joined, "class_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("_c", "class_id").alias("component_id")
    )
