"""Toxicity by weak supervision.

Voters are lexicon entries (words, and beginnings of words of four to seven bytes) that training labels show to go
with toxic texts far more often than chance allows for the number of entries tried, and a few patterns (capitals,
exclamation marks, repeated marks). A voter votes "toxic" or abstains. A generative model with a hidden label
estimates each voter's rates under either label from the votes of all documents by expectation and maximisation;
documents with a training label keep it. It also measures how voters correlate given the label: votes that go
together count as fewer votes. Its posterior labels train a logistic classifier on votes and patterns, which
gives the scores.

Labels come from rows of the label table whose ``crc32(doc_id as text) mod 3`` is not 1 (the largest label of a
repeated id; null labels are none). Lexicon mining and the classifier's fit take bounded samples by a hash of the
id (``SAMPLE_ROWS``); mining counts each distinct text once and keeps every entry that passes. Vote counts and correlations cover all documents. Null text counts as empty: no votes, the
base score. A null id counts as not held out and unlabelled. Repeated rows score alike. Without labels of both
kinds nothing can be learned: every score is 0. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm import words
from riskweave.llm.mixing import vector_sums
from riskweave.llm.ship import shipped, tidy
from riskweave.session import cut_lineage

#: Labelled rows from which the lexicon is mined, and rows the classifier is fitted on.
SAMPLE_ROWS = 20_000
#: The beginnings of words that are tried, in bytes.
BEGINNINGS = (4, 5, 6, 7)
#: Numbers a task or the driver unpacks from votes at a time, as the lexicon has no fixed length.
CELLS = 4_000_000
#: Rounds of expectation and maximisation.
ROUNDS = 5
#: A text counts as toxic from this score.
THRESHOLD = 0.7
PATTERNS = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _entries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, entry hash) of all words and beginnings of words."""
    w = words.split(texts, lower=True, marks=True)
    text = w.text_of
    owners, found = [text], [w.hashes]
    for size in BEGINNINGS:
        at, h = w.prefix_hashes(size)
        owners.append(text[at])
        found.append(h)
    return np.concatenate(owners), np.concatenate(found)


def _patterns(texts: pa.Array) -> np.ndarray:
    """Votes of the patterns: many capitals, many exclamation marks, runs of marks."""
    out = np.zeros((len(texts), PATTERNS), dtype=np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.as_buffer(), dtype=np.uint8) if t.is_valid else np.zeros(0, dtype=np.uint8)
        if len(raw):
            capitals = np.count_nonzero((raw >= 65) & (raw <= 90))
            shout = raw == 33
            marks = shout | (raw == 63) | (raw == 42)
            out[i] = (capitals * 4 > len(raw), np.count_nonzero(shout) * 100 > len(raw), np.count_nonzero(marks[1:] & marks[:-1]) > 2)
    return out


def _votes(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Voters by text, true or false: the lexicon in order, then the patterns."""
    out = np.zeros((len(texts), len(lexicon) + PATTERNS), dtype=bool)
    if len(lexicon):
        order = np.argsort(lexicon)
        known = lexicon[order]
        owner, h = _entries(texts)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        out[owner[hit], order[at[hit]]] = 1
    out[:, len(lexicon) :] = _patterns(texts)
    return out


def mine_lexicon(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """(entries, share of toxic texts) from rows (text, toxic): entries far more frequent in toxic texts.

    A text counts once, however many copies it has, with the largest of its labels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 0):
                owner, h = _entries(part.column(0))
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.lexsort((owner, h))
                owner, h = owner[order], h[order]
                fresh = np.ones(len(h), dtype=bool)
                fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                owner, h = owner[fresh], h[fresh]
                kinds, at = np.unique(h, return_index=True)
                bad = np.add.reduceat(toxic[owner], at) if len(at) else at
                n = np.diff(np.append(at, len(h)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array(n.astype(np.int64))], ["entry", "bad", "n"]
                )

    labelled = cut_lineage(labelled.groupBy("text").agg(F.max("toxic").alias("toxic")))
    rows, toxic = labelled.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not rows or not toxic or toxic == rows:
        return np.zeros(0, dtype=np.uint64), 0.0
    base = toxic / rows
    counts = cut_lineage(labelled.select("text", "toxic").mapInArrow(tidy(count), "entry long, bad long, n long").groupBy("entry").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n")
    ))
    tried = counts.filter("n > 1").count()
    rate = F.least(F.col("bad") / F.col("n"), F.lit(1 - 1e-9))
    # exponent of the chance that a harmless entry does as well
    gain = F.col("n") * (rate * F.log(rate / base) + (1 - rate) * F.log((1 - rate) / (1 - base)))
    chosen = (
        counts.filter((F.col("bad") > 1) & (rate > max(0.5, min(2 * base, (1 + base) / 2))))
        .withColumn("gain", gain).filter(F.col("gain") > float(np.log(max(2, tried)) + 1))
        .orderBy(F.desc("gain"), "entry").select("entry").collect()
    )
    return np.array([r[0] for r in chosen], dtype=np.int64).view(np.uint64), base


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(inputs, target: np.ndarray, ridge: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Ridge logistic weights for soft targets, by damped Newton steps; ``inputs(a, b)`` makes rows a to b."""
    step_rows = max(1, CELLS // len(ridge))
    parts = [(a, min(a + step_rows, len(target))) for a in range(0, len(target), step_rows)]

    def loss(b: np.ndarray) -> float:
        out = 0.5 * ridge @ (b * b)
        for i, j in parts:
            z = inputs(i, j) @ b
            out += np.logaddexp(0, z).sum() - target[i:j] @ z
        return float(out)

    now = loss(beta)
    for _ in range(40):
        bend, slope = np.diag(ridge), -ridge * beta
        for i, j in parts:
            x = inputs(i, j)
            p = _sigmoid(x @ beta)
            bend = bend + (x * (p * (1 - p))[:, None]).T @ x
            slope = slope + x.T @ (target[i:j] - p)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-4 and loss(beta + size * step) > now:
            size /= 2
        beta = beta + size * step
        now, before = loss(beta), now
        if before - now < 1e-7 * max(1.0, abs(before)):
            break
    return beta


class LabelModel:
    """Rates of each vote under either label, and how much a vote counts beside those it goes with."""

    def __init__(self, voters: int, base: float):
        self.base = base
        self.toxic = np.full(voters, 0.2)
        self.clean = np.full(voters, 0.002)
        self.weight = np.ones(voters)
        self.scale = np.array([0.0, 1.0])

    def logit(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.toxic / self.clean) * self.weight
        no = np.log((1 - self.toxic) / (1 - self.clean)) * self.weight
        return np.log(self.base / (1 - self.base)) + no.sum() + votes @ (yes - no)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] + self.scale[1] * self.logit(votes))

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """Sharing weights makes posteriors timid: offset and scale are set on labelled rows."""
        if len(labels):
            x = np.stack([np.ones(len(logits)), logits], axis=1)
            self.scale = _logistic(lambda a, b: x[a:b], np.clip(labels, 0.005, 0.995), np.array([1e-3, 1e-3]), np.array([0.0, 1.0]))

    def update(self, n: float, bad: float, votes: np.ndarray, bad_votes: np.ndarray) -> None:
        good = n - bad
        self.base = float(np.clip((bad + 1) / (n + 2), 1e-4, 0.999))
        self.toxic = np.clip((bad_votes + 0.1) / (bad + 1), 1e-4, 0.999)
        self.clean = np.clip((votes - bad_votes + 0.1) / (good + 100), 1e-6, 0.999)

    def correlate(self, bad: float, moments: np.ndarray, at: int = 0) -> None:
        """Votes that go together given a toxic label share one vote's weight; the moments of voters from ``at`` on."""
        mean, own = self.toxic, slice(at, at + len(moments))
        cov = moments / max(bad, 1.0) - np.outer(mean[own], mean)
        scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        rho = np.clip(cov / np.outer(scale[own], scale), 0, 1)
        rho[np.arange(len(rho)), at + np.arange(len(rho))] = 1
        rho[rho < 0.1] = 0  # chance
        self.weight[own] = 1 / rho.sum(axis=1)


def _parts(batch: pa.RecordBatch, voters: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, as many at a time as unpack to ``CELLS`` numbers."""
    most = max(1, CELLS // voters)
    for a in range(0, batch.num_rows, most):
        yield batch.slice(a, most)


def _unpacked(batch: pa.RecordBatch, at: int, voters: int) -> np.ndarray:
    held = b"".join(batch.column(at).to_pylist())
    width = (voters + 7) // 8
    return np.unpackbits(np.frombuffer(held, dtype=np.uint8).reshape(-1, width), axis=1, count=voters).astype(np.float64)


def _labels_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _believed(model: LabelModel, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(labels), model.posterior(votes), np.clip(labels, 0.005, 0.995))


def fit_label_model(voted: DataFrame, voters: int, base: float) -> LabelModel:
    """Expectation and maximisation over all rows (votes, label)."""
    model = LabelModel(voters, base)
    block = max(1, CELLS // voters)  # voters whose moments a task holds
    for turn in range(ROUNDS):
        # correlations are measured once the rates have settled on the labelled rows, a block of voters a pass
        blocks = range(0, voters, block) if turn == 1 else [None]
        shared = []
        for lo in blocks:

            def partial(batches: Iterator[pa.RecordBatch], model=model, lo=lo, first=turn == 0) -> list[np.ndarray]:
                one = np.zeros(2 + 2 * voters)
                two = None if lo is None else np.zeros((min(block, voters - lo), voters))
                for part in (p for batch in batches for p in _parts(batch, voters)):
                    v, y = _unpacked(part, 0, voters), _labels_of(part, 1)
                    if first:  # starting rates come from the labelled rows alone
                        v, y = v[~np.isnan(y)], y[~np.isnan(y)]
                    p = _believed(model, v, y)
                    one += np.concatenate([[len(p), p.sum()], v.sum(axis=0), p @ v])
                    if two is not None:
                        two += (v[:, lo : lo + len(two)] * p[:, None]).T @ v
                return [one] if two is None else [one, *two]

            found = vector_sums(voted.select("votes", "label"), partial)
            shared.append((lo, found[1:]))
        n, bad = found[0][:2]
        model.update(n, bad, found[0][2 : 2 + voters], found[0][2 + voters :])
        for lo, moments in shared:
            if lo is not None:
                model.correlate(bad, np.stack(moments), lo)
    return model


def _features(votes: np.ndarray, lexicon: int) -> np.ndarray:
    hits = votes[:, :lexicon].sum(axis=1, keepdims=True)
    return np.concatenate([np.ones((len(votes), 1)), np.log1p(hits), hits > 0, votes], axis=1)


def fit_classifier(votes: np.ndarray, target: np.ndarray, lexicon: int, penalty: float = 1.0) -> np.ndarray:
    """Logistic weights for posterior labels, by Newton steps."""
    ridge = np.full(votes.shape[1] + 3, penalty)
    ridge[0] = 1e-3
    return _logistic(lambda a, b: _features(votes[a:b], lexicon), target, ridge, np.zeros(len(ridge)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shipped(docs)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    known = (
        labels.select(labels[doc_id].alias("_id"), labels[label].cast("int").alias("label")).filter("_id IS NOT NULL AND label IS NOT NULL")
        .filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("label").alias("label"))
    )
    known = cut_lineage(known)
    # at most sample_rows ids, by a hash
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    mined = cut_lineage(rows.join(sample, rows["doc_id"] == sample["_id"]).select("text", F.col("label").alias("toxic")))
    lexicon, base = mine_lexicon(mined)
    kind = rows.schema["doc_id"].dataType.simpleString()
    if not base:
        return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    voters = len(lexicon) + PATTERNS
    spark = docs.sparkSession
    lexicon_sent = spark.sparkContext.broadcast(lexicon)  # eight bytes an entry

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for x in words.slices(batch, 1) for p in _parts(x, voters)):
                packed = np.packbits(_votes(part.column(1), lexicon_sent.value), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["doc_id", "votes"]
                )

    voted = rows.mapInArrow(tidy(vote), f"doc_id {kind}, votes binary")
    voted = cut_lineage(voted.join(known, voted["doc_id"] == known["_id"], "left").select("doc_id", "votes", "label"))
    model = fit_label_model(voted, voters, base)

    # the same number of rows at every size, chosen by a hash; equal ids by their votes
    chosen = (F.xxhash64("doc_id", F.lit(7)), "doc_id", "votes")
    rows_fit = voted.orderBy(*chosen).limit(sample_rows).select("votes", F.col("label").cast("double")).toArrow().combine_chunks()
    # labelled rows of their own for offset and scale, as few of the rows above may have a label
    held = voted.filter("label IS NOT NULL").orderBy(*chosen).limit(sample_rows)
    held = held.select("votes", F.col("label").cast("double")).toArrow().combine_chunks()
    if held.num_rows:
        batch = held.to_batches()[0]
        model.calibrate(np.concatenate([model.logit(_unpacked(p, 0, voters)) for p in _parts(batch, voters)]), _labels_of(batch, 1))
    if rows_fit.num_rows:
        batch = rows_fit.to_batches()[0]
        target = np.concatenate([_believed(model, _unpacked(p, 0, voters), _labels_of(p, 1)) for p in _parts(batch, voters)])
        v = np.concatenate([_unpacked(p, 0, voters).astype(bool) for p in _parts(batch, voters)])
        beta = fit_classifier(v, target, len(lexicon))
    else:
        beta = np.zeros(3 + voters)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, voters):
                x = _features(_unpacked(part, 1, voters), len(lexicon))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sigmoid(x @ beta))], ["doc_id", "score"])

    scored = voted.select("doc_id", "votes").mapInArrow(tidy(score), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
