"""Mixing sources to target weights by soft membership.

A classifier trained on a labelled table gives every document a distribution over domains. Rates (how often a
document is taken, not negative) are then fitted so that the expected tokens of each domain, the sum of rate times
tokens times membership, match targets: projected-gradient least squares over all documents. Residuals are weighted
by the inverse of the domains' second moments and rates by the inverse of their tokens, which makes one unclipped
step exact; clipping at zero needs a few more. A rate follows from the steps so far, so a step is one pass that
sums a vector, and no task or driver holds more than that.

The classifier's word statistics and fit use about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id, of each
domain its share but a part of an equal share at least; intercepts make up for domains taken more often than others;
posteriors, moments and sums cover all documents. Null text counts as empty: no tokens, posteriors of the base
shares. Repeated rows are rated alike; null ids and null domains label nothing. Without labelled rows there are no
domains and every rate is one. Targets of domains that have no labelled row are left out and the rest scaled up.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import words
from riskweave.llm.ship import shipped, tidy
from riskweave.session import cut_lineage

#: Labelled rows the classifier is fitted on; hashed word classes; domains at most (more is an error).
SAMPLE_ROWS, WORD_CLASSES, MOST_DOMAINS = 20_000, 1 << 15, 64
#: Groups of tasks whose vectors are added first.
FAN = 32
#: Steps at most, and the relative residual at which they end.
STEPS, ENOUGH = 40, 1e-4


def vector_sums(rows: DataFrame, partial) -> list[np.ndarray]:
    """Sums over all tasks of the vectors that ``partial`` makes of each task's batches.

    Added in two levels, so that a group holds a vector of every ``FAN``-th task, or ``FAN`` vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = partial(batches)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(vectors)), pa.int64()), pa.array([v.astype(np.float64).tobytes() for v in vectors], pa.binary())], ["i", "v"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("v").to_pylist())
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    sent = rows.mapInArrow(tidy(run), "i long, v binary").withColumn("t", F.spark_partition_id() % FAN)
    fewer = sent.groupBy("i", "t").applyInArrow(add, "i long, v binary")
    found = fewer.groupBy("i").applyInArrow(add, "i long, v binary").collect()
    return [np.frombuffer(bytes(r["v"]), dtype=np.float64) for r in sorted(found, key=lambda r: r["i"])]


def _likelihoods(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text and their mean log-likelihoods by domain (zeros for no words)."""
    w = words.split(texts, lower=True, marks=True)
    n = np.diff(w.first)
    out = np.zeros((len(n), table.shape[1]))
    full = np.flatnonzero(n)
    if len(full):
        scores = table[(w.hashes & np.uint64(len(table) - 1)).astype(np.int64)]
        out[full] = np.add.reduceat(scores, w.first[full], axis=0) / n[full, None]
    return n, out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class DomainClassifier:
    """Mean word log-likelihoods by domain, turned into posteriors by a multinomial logistic layer."""

    def __init__(self, domains: list[str], table: np.ndarray):
        self.domains, self.table = domains, table
        self.beta = np.zeros((len(domains) + 1, len(domains)))

    def _inputs(self, likelihoods: np.ndarray, n: np.ndarray) -> np.ndarray:
        centred = likelihoods - likelihoods.mean(axis=1, keepdims=True)
        return np.concatenate([np.ones((len(n), 1)), centred * np.sqrt(np.minimum(n, 400))[:, None]], axis=1)

    def fit(self, likelihoods: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int = 300) -> None:
        x = self._inputs(likelihoods, n)
        scale = np.maximum(x.std(axis=0), 1e-6)
        scale[0] = 1
        x = x / scale
        target = np.eye(len(self.domains))[y]
        beta, momentum = np.zeros_like(self.beta), np.zeros_like(self.beta)
        for _ in range(rounds):
            ahead = beta + 0.9 * momentum
            slope = x.T @ (_softmax(x @ ahead) - target) / len(x) + 1e-4 * ahead
            momentum = 0.9 * momentum - 0.5 / len(self.domains) ** 0.5 * slope
            beta = beta + momentum
        self.beta = beta / scale[:, None]

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, likelihoods = _likelihoods(texts, self.table)
        return n, _softmax(self._inputs(likelihoods, n) @ self.beta)


def sample_quotas(counts: Mapping[str, int], sample_rows: int) -> dict[str, int]:
    """Rows to take of each domain: all if they fit, else its share, at least half of an equal share (or all it has)."""
    total = sum(counts.values())
    if total <= sample_rows:
        return dict(counts)
    least = max(1, sample_rows // (2 * len(counts)))
    return {d: min(n, max(least, n * sample_rows // total)) for d, n in counts.items()}


def train_classifier(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DomainClassifier | None:
    """From documents (doc_id, text) and labels (doc_id, domain)."""
    known = labelled.select(labelled["doc_id"].alias("_id"), labelled["domain"].cast("string").alias("domain"))
    known = known.filter("_id IS NOT NULL AND domain IS NOT NULL").groupBy("_id").agg(F.min("domain").alias("domain"))
    known = cut_lineage(known.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi"))
    counts_of = {r[0]: r[1] for r in known.groupBy("domain").count().orderBy("domain").limit(MOST_DOMAINS + 1).collect()}
    if not counts_of:
        return None
    if len(counts_of) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    domains, total = sorted(counts_of), sum(counts_of.values())
    taken = sample_quotas(counts_of, sample_rows)
    sample = known
    if total > sample_rows:
        order = (F.xxhash64("_id"), "_id")
        parts = [known.filter(F.col("domain") == d).orderBy(*order).limit(taken[d]) for d in domains]
        sample = reduce(DataFrame.unionByName, parts)
    sample = F.broadcast(cut_lineage(sample))  # at most 1.5 times sample_rows rows and one a domain
    rows = cut_lineage(docs.join(sample, docs["doc_id"] == sample["_id"]).select("text", "domain"))
    place = {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        out = np.zeros((len(domains), WORD_CLASSES))
        for batch in batches:
            for part in words.slices(batch, 0):
                w = words.split(part.column(0), lower=True, marks=True)
                own = np.array([place[d] for d in part.column(1).to_pylist()], dtype=np.int64)
                slot = own[w.text_of] * WORD_CLASSES + (w.hashes & np.uint64(WORD_CLASSES - 1)).astype(np.int64)
                out += np.bincount(slot, minlength=out.size).reshape(out.shape)
        return list(out)

    counts = np.stack(vector_sums(rows, count)) + 0.5
    table = np.log(counts / counts.sum(axis=1, keepdims=True))
    table = np.ascontiguousarray((table - table.mean(axis=0)).T.astype(np.float32))
    model = DomainClassifier(domains, table)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 0):
                n, likelihoods = _likelihoods(part.column(0), table)
                y = pa.array([place[d] for d in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [y, pa.array(n.astype(np.int64)), pa.array([r.tobytes() for r in likelihoods], pa.binary())], ["y", "n", "x"]
                )

    fitted = rows.mapInArrow(tidy(measure), "y long, n long, x binary").toArrow().sort_by([("y", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(fitted.column("x").to_pylist()), dtype=np.float64).reshape(-1, len(domains))
    model.fit(x, fitted.column("n").to_numpy(), fitted.column("y").to_numpy())
    model.beta[0] += np.log([counts_of[d] / taken[d] for d in domains])
    return model


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def fit_rates(members: DataFrame, shares: np.ndarray) -> list[np.ndarray]:
    """Steps that take rates of one to rates whose domain totals match ``shares`` of all tokens.

    ``members`` has (tokens, membership: bytes of doubles)."""
    d = len(shares)

    def batch_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        p = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float64).reshape(-1, d)
        return batch.column(0).to_numpy().astype(np.float64), p

    def moments(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        out = np.zeros((d, d))
        for t, p in map(batch_of, batches):
            out += (p * t[:, None]).T @ p
        return list(out)

    gram = np.stack(vector_sums(members, moments))
    total = gram.sum()  # memberships add up to one
    if total <= 0:
        return []
    target = shares * total
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []
    for _ in range(STEPS):

        def totals(batches: Iterator[pa.RecordBatch], so_far=tuple(steps)) -> list[np.ndarray]:
            out = np.zeros(d)
            for t, p in map(batch_of, batches):
                out += (t * _rates(p, list(so_far))) @ p
            return [out]

        off = vector_sums(members, totals)[0] - target
        if np.abs(off).sum() <= ENOUGH * total:
            break
        steps.append(inverse @ off)
    return steps


def mix_to_targets(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], *, doc_id: str = "doc_id", text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(doc_id, n_tokens, domain, membership, rate): the likeliest domain with its posterior, and the rate."""
    shipped(docs)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    model = train_classifier(rows, labelled, sample_rows)
    shares = np.array([max(0.0, float(targets.get(x, 0.0))) for x in model.domains]) if model else np.zeros(0)
    if not model or shares.sum() <= 0:
        words_of = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
        return rows.select(
            "doc_id", words_of.cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"),
            F.lit(None).cast("double").alias("membership"), F.lit(1.0).alias("rate"),
        )
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MOST_DOMAINS x WORD_CLASSES numbers at most

    def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 1):
                n, p = sent.value.posteriors(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array([r.tobytes() for r in p], pa.binary())],
                    ["doc_id", "n_tokens", "p"],
                )

    members = cut_lineage(rows.mapInArrow(tidy(member), f"doc_id {kind}, n_tokens long, p binary"))
    steps = fit_rates(members.select("n_tokens", "p"), shares / shares.sum())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.domains, dtype=object)
        for batch in batches:
            if batch.num_rows:
                p = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float64).reshape(-1, len(names))
                best = p.argmax(axis=1)
                columns = [pa.array(names[best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(_rates(p, steps))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_tokens", "domain", "membership", "rate"])

    return members.mapInArrow(tidy(rate), f"doc_id {kind}, n_tokens long, domain string, membership double, rate double")


def draws(rate, doc_id):
    """How often a document is taken: the whole part of its rate, and once more with the rest as the chance, by a hash."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate).cast("int") + F.when(chance < rate - F.floor(rate), 1).otherwise(0)
