"""Boosted trees on rows that stay packed as bin codes, for tables of more than one training partition.

The rounds are those of Spark's ``GBTClassifier``: thresholds at weighted quantiles (all rows count, not a sample), logistic
loss, splits by the gain in weighted variance, a bag of rows for every tree and a choice of features for every node. What
differs is how rows are kept. Each feature is turned into its bin once. Features of a block of rows are then put together
into a few joint codes, as long as no more than ``MOST_CODES`` combinations of their bins occur in the block; sums over
joint codes are exact sums over the bins of every feature in them, so a level of a tree adds up a few columns instead of
all features. A block stays in the worker of its task for ten trees: tasks run side by side (barrier mode) and add up their
sums per node, feature and bin at every level by small files, so that all come to the same tree without a job a level.
Where executors come and go, or the shared folder is no path of the file system, every level is a job.
"""

from __future__ import annotations

import os
import sys
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, RDD, SparkContext, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_root

# workers need not be able to import the package: functions of this module travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block: one set of joint codes.
BLOCK_ROWS = 1_200_000
#: Rows of a packed chunk, rows worked on at once, joint codes of a column, points of a quantile summary, rows summarised at once.
CHUNK_ROWS, STEP_ROWS, MOST_CODES, SUMMARY_POINTS, SUMMARY_ROWS = 8_192, 1 << 16, 1_024, 4_096, 1 << 18
#: Levels of a tree at most: its inner nodes are the bits of a word.
MOST_DEPTH = 6
#: Values of a feature that are looked up rather than sorted.
FEW_VALUES = 256
#: Summaries of a task that are merged into one when there are so many.
SUMMARIES = 32
#: Trees of a job, after which the state of the rows is written to the shared folder.
CHECKPOINT_TREES = 10
#: Seconds a task waits for the sums of another.
EXCHANGE_SECONDS = 900
#: Gains that differ by less than this share are equal; the first feature is taken.
SAME_GAIN = 1e-10
EPSILON = sys.float_info.epsilon


@dataclass
class Tree:
    """Sums (rows, weight, weighted target, weighted square) of every node by (level, place), and the splits of inner nodes."""

    sums: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    splits: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)  # feature, last bin on the left, gain

    def prediction(self, node: tuple[int, int]) -> float:
        _, weight, total, _ = self.sums[node]
        return float(total / weight) if weight else 0.0

    def path(self, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Feature and last left bin of every place of the first levels; -1 where rows stop (they pass on to the left)."""
        out = []
        for level in range(levels):
            chosen = [self.splits.get((level, at), (-1, 0, 0.0)) for at in range(2**level)]
            out.append((np.array([c[0] for c in chosen]), np.array([c[1] for c in chosen])))
        return out

    def values(self, depth: int) -> np.ndarray:
        """Prediction at every place below the last level."""
        out = np.empty(2**depth)
        for at in range(2**depth):
            level, place = 0, 0
            while (level, place) in self.splits:
                level, place = level + 1, at >> (depth - level - 1)
            out[at] = self.prediction((level, place))
        return out


# --- candidate thresholds ---------------------------------------------------------------------------


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by row, label, weight) of a batch, checked as Spark's learner does."""
    x = np.empty((width, batch.num_rows))
    for i in range(width):
        x[i] = batch.column(i).to_numpy(zero_copy_only=False)
    y, w = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (width, width + 1))
    if np.isnan(x).any():
        raise ValueError("a feature is not a number")
    if not ((y == 0) | (y == 1)).all():
        raise ValueError("labels must be 0 or 1")
    if not ((w >= 0) & (w < np.inf)).all():
        raise ValueError("weights must be finite and not negative")
    return x, y, w


def _distinct(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values with their weights; few of them are looked up, many are sorted."""
    some = np.unique(values[:: max(1, len(values) // 1_024)])
    while 0 < len(some) <= FEW_VALUES:
        at = np.minimum(np.searchsorted(some, values), len(some) - 1)
        other = values[some.take(at) != values]
        if not len(other):
            return some, np.bincount(at, weights, len(some))
        some = np.union1d(some, other)
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts], np.add.reduceat(weights, starts)


def _merged(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; of more than ``SUMMARY_POINTS`` the last of each equal share of the weight."""
    values, weights = _distinct(values, weights)
    total = weights.sum()
    if len(values) <= SUMMARY_POINTS or not total:
        return values, weights
    upto = np.cumsum(weights)
    cell = np.floor(upto * (SUMMARY_POINTS / total))
    last = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True])
    return values[last], np.diff(upto[last], prepend=0.0)


def _summaries(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        pending, found = [], [[] for _ in range(width)]

        def summarise():
            w = np.concatenate([p[2] for p in pending])
            for f in range(width):
                found[f].append(_merged(np.concatenate([p[0][f] for p in pending]), w))
                if len(found[f]) >= SUMMARIES:
                    found[f] = [_merged(*map(np.concatenate, zip(*found[f])))]
            pending.clear()

        for batch in batches:
            if batch.num_rows:
                pending.append(_columns(batch, width))
            if sum(len(p[2]) for p in pending) >= SUMMARY_ROWS:
                summarise()
        if pending:
            summarise()
        if not found[0]:
            return
        for f in range(width):
            values, weights = _merged(*map(np.concatenate, zip(*found[f])))
            yield pa.RecordBatch.from_pydict({"feature": [f], "v": [values.tobytes()], "w": [weights.tobytes()]})

    return run


def thresholds_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between distinct values: all of them if there are few, else those nearest to equal shares of the weight."""
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2.0
    stride = float(weights.sum()) / bins
    upto, out, target = np.cumsum(weights), [], stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append((values[i - 1] + values[i]) / 2.0)
            target += stride
    return np.array(out)


def candidate_thresholds(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Ascending thresholds per feature, from all rows; summaries are merged by feature where the rows are."""

    def finished(table: pa.Table) -> pa.Table:
        v, w = (np.concatenate([np.frombuffer(x) for x in table.column(c).to_pylist()]) for c in ("v", "w"))
        cuts = thresholds_of(*_distinct(v, w), bins)
        return pa.table({"feature": table.column("feature")[:1].cast(pa.int64()), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    found = rows.mapInArrow(_summaries(width), "feature long, v binary, w binary")
    cuts = {r["feature"]: np.frombuffer(r["cuts"]) for r in found.groupBy("feature").applyInArrow(finished, "feature long, cuts binary").collect()}
    return [cuts.get(f, np.empty(0)) for f in range(width)]


# --- packed rows ------------------------------------------------------------------------------------


def _packed(cuts: Sequence[np.ndarray], side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of bins, feature by feature, with weights whose sign is that of the label (-1 or 1)."""

    def run(batches):
        task, number, pending, held = TaskContext.get().partitionId(), 0, [], 0

        def chunks(rows: int):
            nonlocal number, held
            bins, signed = np.concatenate([p[0] for p in pending], axis=1), np.concatenate([p[1] for p in pending])
            pending.clear()
            at = 0
            while held - at >= rows:
                part = slice(at, at + rows)
                yield pa.RecordBatch.from_pydict({
                    "side": [side], "task": [task], "number": [number], "n": [rows],
                    "bins": [bins[:, part].tobytes()], "signed": [signed[part].tobytes()],
                })
                at, number = at + rows, number + 1
            if at < held:
                pending.append((bins[:, at:], signed[at:]))
            held -= at

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = _columns(batch, len(cuts))
            bins = np.empty(x.shape, np.uint8)
            for f, c in enumerate(cuts):
                bins[f] = np.searchsorted(c, x[f]) if len(c) > 1 else x[f] > c[0] if len(c) else 0
            pending.append((bins, np.where(y == 1, w, -w)))
            held += batch.num_rows
            if held >= CHUNK_ROWS:
                yield from chunks(CHUNK_ROWS)
        if held:
            yield from chunks(held)

    return run


def joint_codes(bins: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, list[tuple[list[int], np.ndarray]]]:
    """(codes by column and row, per column its features and the bins every code stands for).

    A feature joins the first column that has at most ``MOST_CODES`` combinations with it among these rows.
    """
    columns: list[list] = []
    for f, size in enumerate(sizes):
        for column in columns:
            codes, members, stands = column
            joint = codes.astype(np.intp) * size + bins[f]
            seen = np.bincount(joint, minlength=len(stands) * size) > 0
            if seen.sum() <= MOST_CODES:
                kept = np.flatnonzero(seen)
                column[0] = (np.cumsum(seen) - 1).astype(np.uint16)[joint]
                members.append(f)
                column[2] = np.column_stack([stands[kept // size], (kept % size).astype(np.uint8)])
                break
        else:
            columns.append([bins[f].astype(np.uint16), [f], np.arange(size, dtype=np.uint8)[:, None]])
    return np.stack([c[0] for c in columns]), [(c[1], c[2]) for c in columns]


def _blocks(sizes: Sequence[int], seed: int, share: float) -> Callable[[Iterator], Iterator[tuple]]:
    """The chunks of a partition as one list of blocks, with no trees and losses yet."""

    def block(rows):
        bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(len(sizes), r["n"]) for r in rows], axis=1)
        signed = np.concatenate([np.frombuffer(r["signed"]) for r in rows])
        kinds, kind = np.unique(signed, return_inverse=True)
        codes, columns = joint_codes(bins, sizes)
        chunks = [(r["task"], r["number"], r["n"]) for r in rows if not r["side"]]
        # rows to fit come first, then unseen rows; the sums of their trees start at 0
        return {
            "chunks": chunks, "fit": sum(c[2] for c in chunks), "codes": codes, "columns": columns,
            "kinds": kinds if len(kinds) <= 256 else None, "signed": kind.astype(np.uint8) if len(kinds) <= 256 else signed,
            "margin": np.zeros(len(signed)), "bag": _bag(chunks, 0, seed, share),
        }

    def run(rows):
        rows, some, out = sorted(rows, key=lambda r: (r["task"], r["number"], r["side"]), reverse=True), [], []
        while rows:
            some.append(rows.pop())
            if not rows or sum(r["n"] for r in some) >= BLOCK_ROWS:
                out.append(block(sorted(some, key=lambda r: (r["side"], r["task"], r["number"]))))
                some = []
        yield out, [], []

    return run


# --- levels and rounds, on workers ------------------------------------------------------------------


def _bag(chunks: Sequence[tuple[int, int, int]], number: int, seed: int, share: float) -> np.ndarray | None:
    """Bits of the rows in the bag of tree ``number``; they follow from the rows' chunks, in whichever block those are."""
    if share >= 1:
        return None
    drawn = [np.random.default_rng([seed, number, task, chunk]).random(n) for task, chunk, n in chunks]
    return np.packbits(np.concatenate([*drawn, np.empty(0)]) < share)


def _weighed(block: dict, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, label as -1 or 1) of some rows."""
    signed, kinds = block["signed"][rows], block["kinds"]
    if kinds is None:
        return np.abs(signed), np.where(signed < 0, -1.0, 1.0)
    return np.abs(kinds).take(signed), np.where(kinds < 0, -1.0, 1.0).take(signed)


def _turns(block: dict, path: list) -> list[np.ndarray | None]:
    """Per column and code the inner nodes, as bits, where a row with that code goes right."""
    home = {f: (c, i) for c, (members, _) in enumerate(block["columns"]) for i, f in enumerate(members)}
    out: list = [None] * len(block["columns"])
    for level, (features, bins) in enumerate(path):
        for at, (f, last) in enumerate(zip(features.tolist(), bins.tolist())):
            if f >= 0:
                column, member = home[f]
                stands = block["columns"][column][1]
                if out[column] is None:
                    out[column] = np.zeros(len(stands), np.uint64)
                out[column] |= (stands[:, member] > last).astype(np.uint64) << np.uint64(2**level - 1 + at)
    return out


def _places(block: dict, part: slice, turns: list, levels: int) -> np.ndarray:
    """The place of some rows after ``levels`` levels: one look at each column, then a bit a level."""
    codes, one = block["codes"][:, part], np.uint64(1)
    right = np.zeros(codes.shape[1], np.uint64)
    for column, bits in enumerate(turns):
        if bits is not None:
            right |= bits.take(codes[column])
    at = np.zeros(codes.shape[1], np.uint64)
    for _ in range(levels):
        turn = right >> at
        turn &= one
        at <<= one
        at += one
        at += turn
    at -= np.uint64(2**levels - 1)
    return at.view(np.int64)


def _level(sizes: Sequence[int], path: list, slots: np.ndarray, number: int) -> Callable[[dict], np.ndarray]:
    """Sums (rows, weight, weighted target, weighted square) of a block by measured node and bin, all features side by side.

    ``slots`` numbers the measured nodes by place, others have -1.
    """
    offsets, nodes = np.concatenate([[0], np.cumsum(sizes)]), int((slots >= 0).sum())

    def run(block):
        turns, end, widths = _turns(block, path), block["fit"], [len(stands) for _, stands in block["columns"]]
        held = [np.zeros((4, nodes * width)) for width in widths]
        bag = None if block["bag"] is None else np.unpackbits(block["bag"], count=end).view(bool)
        for at in range(0, end, STEP_ROWS):
            part = slice(at, min(at + STEP_ROWS, end))
            if path:
                slot = slots.take(_places(block, part, turns, len(path)))
                inside = slot >= 0
                if bag is not None:
                    inside &= bag[part]
                rows = np.flatnonzero(inside)
                slot = slot.take(rows)
            else:
                rows = np.arange(part.stop - at) if bag is None else np.flatnonzero(bag[part])
                slot = np.zeros(len(rows), np.int64)
            codes = [c[part].take(rows) for c in block["codes"]]
            rows += at
            w, y = _weighed(block, rows)
            target = y
            if number:
                target = block["margin"].take(rows)
                target *= y
                target *= 2.0
                np.exp(target, out=target)
                target += 1.0
                np.divide(y, target, out=target)
                target *= 4.0
            wt = w * target
            square = wt * target
            for code, sums, width in zip(codes, held, widths):
                index = slot * width
                index += code
                sums[0] += np.bincount(index, minlength=sums.shape[1])
                for s, values in ((1, w), (2, wt), (3, square)):
                    sums[s] += np.bincount(index, values, sums.shape[1])
        out = np.zeros((4, nodes, offsets[-1]))
        for (members, stands), sums in zip(block["columns"], held):
            for i, f in enumerate(members):
                index = (np.arange(nodes)[:, None] * sizes[f] + stands[:, i]).reshape(-1)
                for s in range(4):
                    out[s, :, offsets[f] : offsets[f + 1]] = np.bincount(index, sums[s], nodes * sizes[f]).reshape(nodes, sizes[f])
        return out

    return run


def _loss(block: dict) -> np.ndarray:
    """Weighted logistic loss of the unseen rows, and their weight."""
    unseen = slice(block["fit"], len(block["margin"]))
    w, y = _weighed(block, unseen)
    return np.array([(2.0 * w * np.logaddexp(0.0, -2.0 * y * block["margin"][unseen])).sum(), w.sum()])


def _advanced(block: dict, path: list, values: np.ndarray) -> np.ndarray:
    """The sums of trees of the block's rows with those of one more."""
    turns, margin = _turns(block, path), block["margin"].copy()
    for at in range(0, len(margin), STEP_ROWS):
        part = slice(at, at + STEP_ROWS)
        margin[part] += values.take(_places(block, part, turns, len(path)))
    return margin


# --- rounds: all tasks add up their sums at every level and come to the same tree -------------------


def _variance(sums: np.ndarray) -> np.ndarray:
    _, weight, total, square = sums
    weight = np.where(weight > 0, weight, np.nan)
    return np.nan_to_num((square - total * total / weight) / weight)


def best_splits(sums: np.ndarray, sizes: Sequence[int], allowed: np.ndarray, min_rows: int) -> list[tuple[int, int, float, np.ndarray] | None]:
    """Per node (feature, last bin on the left, gain, sums on the left), or None where nothing is gained.

    ``sums`` is (4, nodes, bins of all features), ``allowed`` (nodes, features).
    """
    nodes, ends = sums.shape[1], np.cumsum(sizes)
    total = sums[:, :, : sizes[0]].sum(axis=2)
    parent, best = _variance(total), [(0.0, None)] * nodes
    for f, size in enumerate(sizes):
        if size < 2:
            continue
        left = np.cumsum(sums[:, :, ends[f] - size : ends[f] - 1], axis=2)
        right = total[:, :, None] - left
        heavy = np.where(total[1] > 0, total[1], 1.0)[:, None]
        gain = parent[:, None] - left[1] / heavy * _variance(left) - right[1] / heavy * _variance(right)
        gain = np.where((left[0] >= min_rows) & (right[0] >= min_rows) & allowed[:, f, None], gain, -np.inf)
        at = gain.argmax(axis=1)
        for node in range(nodes):
            g = gain[node, at[node]]
            if g > best[node][0] * (1 + SAME_GAIN):
                best[node] = (g, (f, int(at[node]), float(g), left[:, node, at[node]]))
    return [b[1] for b in best]


def _grown(measure: Callable[[list, np.ndarray], np.ndarray], sizes: Sequence[int], number: int, params: dict) -> Tree:
    """One tree; ``measure`` gives the sums of the measured nodes by path and slots (``_level``) over all rows.

    Of two sister nodes the one with fewer rows is measured; sums of the other are what is left of their parent's.
    """
    draws = np.random.default_rng([params["seed"], number])
    tree, width = Tree(), len(sizes)
    some = max(1, int(np.ceil(params["column_share"] * width)))
    known: dict[int, np.ndarray] = {}  # sums of the open nodes of the level above
    measured, opened = [0], [0]
    for level in range(params["depth"]):
        slots = np.full(2**level, -1)
        slots[measured] = np.arange(len(measured))
        sums = measure(tree.path(level), slots)
        above, known = known, {}
        for place, own in zip(measured, np.moveaxis(sums, 1, 0)):
            known[place] = own
            if level:
                rest = above[place // 2] - own
                known[place ^ 1] = np.where(rest[0] > 0, rest, 0.0)
        if level == 0:
            tree.sums[0, 0] = known[0][:, : sizes[0]].sum(axis=1)
        allowed = np.ones((len(opened), width), bool)
        if some < width:
            allowed[:] = False
            for node in range(len(opened)):
                allowed[node, draws.choice(width, some, replace=False)] = True
        splits = best_splits(np.stack([known[at] for at in opened], axis=1), sizes, allowed, params["min_rows_per_leaf"])
        measured, following = [], []
        for at, split in zip(opened, splits):
            if split is None:
                continue
            *chosen, left = split
            tree.splits[level, at] = tuple(chosen)
            sisters = (2 * at, left), (2 * at + 1, tree.sums[level, at] - left)
            for place, child in sisters:
                tree.sums[level + 1, place] = child
            wanted = [place for place, child in sisters if abs(float(_variance(child[:, None])[0])) >= EPSILON]
            if level + 1 < params["depth"] and wanted:
                following += wanted
                measured.append(min(sisters, key=lambda s: s[1][0])[0])
        opened = following
        if not opened:
            break
    return tree


def _added_up(folder: str, part: int, parts: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that adds up its argument over all tasks, which call it equally often, by files of a folder all see.

    (A barrier's own exchange takes a second a call.) A file goes when all tasks have come to the next call.
    """
    step = 0

    def over_all(own: np.ndarray) -> np.ndarray:
        nonlocal step
        mine, total, until = f"{folder}/{step}-{part}", np.zeros(own.shape), time.monotonic() + EXCHANGE_SECONDS
        own.tofile(f"{mine}.part")
        os.replace(f"{mine}.part", mine)
        for other in range(parts):
            while not os.path.exists(f"{folder}/{step}-{other}"):
                if time.monotonic() > until:
                    raise TimeoutError(f"no sums of task {other} in {EXCHANGE_SECONDS} seconds")
                time.sleep(0.002)
            total += np.fromfile(f"{folder}/{step}-{other}").reshape(own.shape)
        if step:
            os.remove(f"{folder}/{step - 1}-{part}")
        step += 1
        return total

    return over_all


def _rounds(sizes: Sequence[int], params: dict, first: int, most: int, folder: str) -> Callable[[Iterator], Iterator[tuple]]:
    """Blocks of a partition after ``most`` more trees, with those trees and the loss on the unseen rows after each."""

    def run(partition):
        blocks, context = next(iter(partition))[0], BarrierTaskContext.get()
        # a folder for this attempt, the same for all tasks
        own = f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}"
        os.makedirs(own, exist_ok=True)
        over_all = _added_up(own, context.partitionId(), len(context.getTaskInfos()))
        trees, losses = [], []
        for number in range(first, first + most):
            tree = _grown(lambda path, slots: over_all(_measured(blocks, sizes, path, slots, number)), sizes, number, params)
            blocks = _next(blocks, tree, number, params)
            trees.append(_plain(tree))
            losses.append(_mean_loss(over_all(_losses(blocks))))
        yield blocks, trees, losses

    return run


def _measured(blocks: list[dict], sizes: Sequence[int], path: list, slots: np.ndarray, number: int) -> np.ndarray:
    level = _level(sizes, path, slots, number)
    return sum((level(block) for block in blocks), np.zeros((4, int((slots >= 0).sum()), sum(sizes))))


def _losses(blocks: list[dict]) -> np.ndarray:
    return sum((_loss(block) for block in blocks), np.zeros(2))


def _mean_loss(sums: np.ndarray) -> float:
    return float(sums[0] / sums[1]) if sums[1] else float("nan")


def _next(blocks: list[dict], tree: Tree, number: int, params: dict) -> list[dict]:
    """The blocks with a tree's values added and the bag of the tree after it."""
    path, values = tree.path(params["depth"]), (params["rate"] if number else 1.0) * tree.values(params["depth"])
    return [
        {**block, "margin": _advanced(block, path, values), "bag": _bag(block["chunks"], number + 1, params["seed"], params["row_share"])}
        for block in blocks
    ]


def _plain(tree: Tree) -> tuple[dict, dict]:
    """Sums and splits; where trees are read, the class need not be known."""
    return {at: tuple(sums.tolist()) for at, sums in tree.sums.items()}, tree.splits


def _told(state: tuple) -> tuple:
    return state[1:]


def _side_by_side(state: RDD, sizes: Sequence[int], params: dict, first: int, most: int, folder: str) -> tuple[RDD, list[Tree], list[float]]:
    """State of the rows after ``most`` more trees, those trees and losses: one job of tasks that wait for each other."""
    state = state.barrier().mapPartitions(_rounds(sizes, params, first, most, folder)).persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    told = state.map(_told).collect()
    if any(t[0] != told[0][0] for t in told):
        raise RuntimeError("tasks did not come to the same trees")
    return state, [Tree({at: np.array(s) for at, s in sums.items()}, splits) for sums, splits in told[0][0]], told[0][1]


def _job_by_job(state: RDD, sizes: Sequence[int], params: dict, first: int, most: int) -> tuple[RDD, list[Tree], list[float]]:
    """The same with a job for every level, where tasks cannot wait for each other."""
    trees, losses, kept = [], [], []
    for number in range(first, first + most):
        now = state

        def measure(path, slots, number=number, now=now):
            return sum(now.map(lambda held: _measured(held[0], sizes, path, slots, number)).collect())

        trees.append(_grown(measure, sizes, number, params))
        state = now.map(lambda held, tree=trees[-1], number=number: (_next(held[0], tree, number, params), [], [])).persist(StorageLevel.MEMORY_AND_DISK)
        if len(trees) == most:
            state.checkpoint()
        losses.append(_mean_loss(sum(state.map(lambda held: _losses(held[0])).collect())))
        for old in kept:
            old.unpersist()
        kept = [state]
    return state, trees, losses


def exchange_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path of the file system, or None where it is none or executors come and go."""
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    scheme, _, path = shared_root(spark).rpartition(":")
    return "/" + path.lstrip("/") if scheme in ("", "file") and path.startswith("/") else None


def concurrent_tasks(spark: SparkSession) -> int:
    """Tasks that run at the same time."""
    own = spark.sparkContext._jsc.sc()
    return max(1, own.maxNumConcurrentTasks(own.resourceProfileManager().defaultResourceProfile()))


def _delete(sc: SparkContext, at: str | None) -> None:
    """Delete a folder of the shared folder."""
    if at:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _drop(rows: RDD) -> None:
    rows.unpersist()
    _delete(rows.ctx, rows.getCheckpointFile())


def boosted_rounds(
    train: DataFrame, unseen: DataFrame | None, width: int, parts: int, params: dict, bins: int, settled: Callable[[list[float]], bool],
) -> tuple[list[Tree], list[np.ndarray], list[float]]:
    """(trees, thresholds per feature, loss on the unseen rows after each tree).

    Frames hold ``width`` features, label and weight. They are read twice: for the thresholds and to be packed. Rounds
    end when all trees are fitted or ``settled`` says of the losses so far that later trees cannot count; it is asked every
    ``CHECKPOINT_TREES`` trees, when the rows' sums of trees are stored. Side by side, ``parts`` tasks must be able to run at once.
    """
    sc, cuts = train.sparkSession.sparkContext, candidate_thresholds(train, width, bins)
    sizes = [len(c) + 1 for c in cuts]
    kind = "side long, task long, number long, n long, bins binary, signed binary"
    chunks = train.mapInArrow(_packed(cuts, 0), kind)
    if unseen is not None:
        chunks = chunks.unionByName(unseen.mapInArrow(_packed(cuts, 1), kind))
    state = chunks.repartition(parts).rdd.mapPartitions(_blocks(sizes, params["seed"], params["row_share"]))
    trees: list[Tree] = []
    losses: list[float] = []
    stored: list[RDD] = []
    shared = exchange_folder(train.sparkSession)
    folder = f"{shared}/riskweave-steps/{uuid.uuid4().hex}"
    try:
        while len(trees) < params["trees"]:
            most = min(CHECKPOINT_TREES, params["trees"] - len(trees))
            grow = _job_by_job if shared is None else partial(_side_by_side, folder=folder)
            state, grown, lost = grow(state, sizes, params, len(trees), most)
            stored.append(state)
            while len(stored) > 1:
                _drop(stored.pop(0))
            for tree, loss in zip(grown, lost):
                trees.append(tree)
                if unseen is not None:
                    losses.append(loss)
                    if settled(losses):
                        return trees, cuts, losses
        return trees, cuts, losses
    finally:
        for rows in stored:
            _drop(rows)
        if shared is not None:
            _delete(sc, f"file://{folder}")


# --- Spark's model ----------------------------------------------------------------------------------


_NODES = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long,
gain: double, leftChild: int, rightChild: int,
split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


def _node_rows(tree: Tree, cuts: Sequence[np.ndarray]) -> list[tuple]:
    """The nodes of a tree as Spark stores them, numbered from the root, left before right."""
    rows: list[tuple] = []

    def add(at: tuple[int, int]) -> int:
        number, sums = len(rows), tree.sums[at].tolist()
        rows.append(())
        gain, left, right, split = -1.0, -1, -1, (-1, [], -1)
        if at in tree.splits:
            feature, last, gain = tree.splits[at]
            split = (feature, [float(cuts[feature][last])], -1)
            left, right = (add((at[0] + 1, 2 * at[1] + i)) for i in (0, 1))
        impurity = float(_variance(tree.sums[at][:, None])[0])
        rows[number] = (number, tree.prediction(at), impurity, sums[1:], int(sums[0]), gain, left, right, split)
        return number

    add((0, 0))
    return rows


def spark_model(spark: SparkSession, learner: GBTClassifier, trees: Sequence[Tree], cuts: Sequence[np.ndarray], rate: float) -> GBTClassificationModel:
    """The trees as a model of Spark with the parameters of ``learner``.

    A model of as many bare trees is stored, its table of nodes is replaced, and it is loaded: to make the nodes one by
    one from here takes minutes.
    """
    sc = spark.sparkContext
    ml, regression = sc._jvm.org.apache.spark.ml, sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    none = sc._gateway.new_array(sc._gateway.jvm.double, 3)
    bare = ml.tree.LeafNode(0.0, 0.0, sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(none, 0))
    made, weights = sc._gateway.new_array(regression, len(trees)), sc._gateway.new_array(sc._gateway.jvm.double, len(trees))
    for i in range(len(trees)):
        made[i], weights[i] = regression(bare, len(cuts)), 1.0 if i == 0 else rate
    model = GBTClassificationModel(ml.classification.GBTClassificationModel(learner.uid, made, weights, len(cuts), 2))
    learner._copyValues(model)
    model._transfer_params_to_java()
    at = f"{shared_root(spark)}/riskweave-steps/{uuid.uuid4().hex}"
    try:
        model.write().save(at)
        rows = [(i, row) for i, tree in enumerate(trees) for row in _node_rows(tree, cuts)]
        spark.createDataFrame(rows, _NODES, verifySchema=False).coalesce(1).write.mode("overwrite").parquet(f"{at}/data")
        return GBTClassificationModel.load(at)
    finally:
        _delete(sc, at)
