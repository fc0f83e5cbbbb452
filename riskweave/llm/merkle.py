"""Document fingerprints: a Merkle tree over sections and paragraphs, in built-in functions only.

A text is cut into sections (behind blank lines), those into paragraphs (lines), those into leaves
(behind sentence marks and long words, else behind other words by their last letter, at most ``LEAF_CHARS``
characters), without losing a character. A leaf's digest is the SHA-256 of
its text, an inner node's that of its children's digests, so equal roots mean equal texts and a differing
root leads down to the leaves that were edited. The fingerprint is the root and the leaves (32 bits of
hash and the length, 16 hex digits a leaf with its separator at most), with ``/`` between paragraphs and
``//`` between sections.

Null text counts as empty; the empty text has a root and no leaves. Rows are kept as they are, repeated
ones too. Only the named columns are read, so further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a leaf at most; from half of it on a leaf may end behind more words.
LEAF_CHARS = 64
#: Cuts: behind a blank line, behind a line.
SECTION = r"(?<=\n[ \t\r]{0,4}\n)(?=[^\n])"
PARAGRAPH = r"(?<=\n)(?=[^\n])"
#: A leaf: up to a sentence mark (full-width ones need no space) or a word of ten or more characters, else up to a
#: word that ends in one of some letters and digits, else as long as may be.
_STRONG = r"(?<=[.!?,;:|]\s)(?=\S)|(?<=\S{10}\s)(?=\S)|(?<=[\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF1A}\x{FF1B}\x{FF1F}])|\z"
_WEAK = r"(?<=[cdghkmpwyCDGHKMPWY5-9]\s)(?=\S)"
LEAF = (
    rf"(?s).{{1,{LEAF_CHARS}}}?(?:{_STRONG})|.{{{LEAF_CHARS // 2},{LEAF_CHARS}}}?{_WEAK}|.{{{LEAF_CHARS}}}"
)
#: Documents in a range of ids that one task pairs with their successors, and the most ranges; beyond
#: that ranges grow, and the window over a range spills.
RANGE_ROWS, MOST_RANGES = 5_000, 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _cut(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def _node(children: Column) -> Column:
    """A node's digest and what lies below, from children of the same form."""
    return _let(
        children,
        lambda c: F.struct(
            F.sha2(F.array_join(F.transform(c, lambda x: x["d"]), ""), 256).alias("d"),
            F.transform(c, lambda x: x["k"]).alias("k"),
        ),
    )


def tree(text: Column) -> Column:
    """Struct of ``root`` (hex) and ``tree``: sections of paragraphs of leaves, a leaf being hash and length in a long."""
    def leaf(piece: Column) -> Column:
        mark = F.xxhash64(piece).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(
            F.sha2(piece, 256).alias("d"),
            (F.shiftleft(mark, 16).bitwiseOR(F.length(piece).cast("long"))).alias("k"),
        )

    def paragraph(line: Column) -> Column:
        return _node(F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), leaf))

    def section(part: Column) -> Column:
        return _node(F.transform(_cut(part, PARAGRAPH), paragraph))

    sections = F.transform(_cut(F.coalesce(text, F.lit("")), SECTION), section)
    return _let(_node(sections), lambda n: F.struct(n["d"].alias("root"), n["k"].alias("tree")))


def leaves(fingerprint: Column) -> Column:
    """All leaves of a tree, in order."""
    return F.flatten(F.flatten(fingerprint["tree"]))


def printable(fingerprint: Column) -> Column:
    """The tree as a string: root, then the leaves in hex."""
    def line(keys: Column) -> Column:
        return F.array_join(F.transform(keys, lambda k: F.lower(F.hex(k))), ".")

    def part(lines: Column) -> Column:
        return F.array_join(F.transform(lines, line), "/")

    return F.concat(fingerprint["root"], F.lit(":"), F.array_join(F.transform(fingerprint["tree"], part), "//"))


def _weight(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a + k.bitwiseAND(F.lit(0xFFFF).cast("long")))


def _shared(a: Column, b: Column) -> Column:
    """Weight of the leaves two lists have in common, each as often as both have it: one walk over both in order."""
    both = F.sort_array(F.concat(
        F.transform(a, lambda k: F.shiftleft(k, 1)), F.transform(b, lambda k: F.shiftleft(k, 1).bitwiseOR(F.lit(1).cast("long")))
    ))
    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        key, own = F.shiftright(x, 1), x.bitwiseAND(F.lit(1).cast("long")) == 0
        free = F.when(acc["k"] == key, acc["free"]).otherwise(zero)  # leaves of the first list not yet met
        met = ~own & (free > 0)
        return F.struct(
            key.alias("k"), F.when(own, free + 1).when(met, free - 1).otherwise(free).alias("free"),
            F.when(met, acc["w"] + key.bitwiseAND(F.lit(0xFFFF).cast("long"))).otherwise(acc["w"]).alias("w"),
        )

    start = F.struct(F.lit(-1).cast("long").alias("k"), zero.alias("free"), zero.alias("w"))
    return F.aggregate(both, start, step, lambda acc: acc["w"])


def likeness(a: Column, b: Column) -> Column:
    """Share of the characters of two trees that lie in leaves of both (a repeated leaf as often as both have it): 1
    for equal roots, 0 if nothing is shared. Twice the shared weight over the sum of both."""
    def share(keys: Column) -> Column:
        total = _weight(keys["a"]) + _weight(keys["b"])
        return F.when(total > 0, 2.0 * _shared(keys["a"], keys["b"]) / total).otherwise(F.lit(0.0))

    keys = F.struct(leaves(a).alias("a"), leaves(b).alias("b"))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.least(_let(keys, share), F.lit(1.0)))


def first_difference(a: Column, b: Column) -> Column:
    """Code points before the first leaf in which two trees differ; null if the roots are equal."""
    pairs = F.arrays_zip(leaves(a).alias("x"), leaves(b).alias("y"))
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("same")),
        lambda acc, p: F.when(
            acc["same"] & p["x"].eqNullSafe(p["y"]),
            F.struct((acc["n"] + p["x"].bitwiseAND(F.lit(0xFFFF).cast("long"))).alias("n"), F.lit(True).alias("same")),
        ).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("same"))),
        lambda acc: acc["n"],
    )
    return F.when(a["root"] != b["root"], walked)


def with_successor(docs: DataFrame, order: str, text: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, own columns of ``carry``, ``next``: a struct of the next document's text and carry).

    The order is by id (nulls last), then text; the last document is followed by the first. Ids are cut into
    ranges at approximate quantiles, so texts are shuffled once and no task holds more than a range; a copy
    of the first document of the following range closes each range. With a single document it follows itself.
    """
    carry = carry or {}
    base = docs.select(F.col(order).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = base.select(F.col("doc_id").cast("double").alias("_at"))
    known = ids.filter("_at IS NOT NULL")
    ranges = max(1, min(MOST_RANGES, -(-known.count() // RANGE_ROWS)))
    cuts: list[float] = []
    if ranges > 1:
        cuts = known.approxQuantile("_at", [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges))
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    tagged = base.withColumn("_at", F.col("doc_id").cast("double"))
    if len(edges) > 2:
        tagged = Bucketizer(splits=edges, inputCol="_at", outputCol="_b", handleInvalid="keep").transform(tagged)
        tagged = tagged.withColumn("_b", F.coalesce("_b", F.lit(float(len(edges)))))
    else:
        tagged = tagged.withColumn("_b", F.when(F.col("_at").isNull(), 1.0).otherwise(0.0))
    tagged = tagged.drop("_at").withColumn("_b", F.col("_b").cast("int"))

    # one row per range, at most MOST_RANGES + 1
    firsts = tagged.groupBy("_b").agg(F.min("doc_id").alias("_first"))
    around = Window.orderBy("_b")
    follow = firsts.select(
        "_b",
        F.coalesce(F.lead("_b").over(around), F.first("_b").over(around)).alias("_nb"),
    ).join(firsts.select(F.col("_b").alias("_nb"), "_first"), "_nb")
    heads = (
        tagged.withColumnRenamed("_b", "_nb")
        .join(F.broadcast(firsts.select(F.col("_b").alias("_nb"), "_first")), "_nb")  # bounded, as above
        .filter(F.col("doc_id").eqNullSafe(F.col("_first")))
        .groupBy("_nb")
        .agg(F.min("text").alias("text"))
    )
    closing = follow.join(heads, "_nb").select(F.col("_first").alias("doc_id"), "text", "_b", F.lit(True).alias("_close"))
    rows = tagged.withColumn("_close", F.lit(False)).unionByName(closing).repartition("_b")
    rows = rows.select("*", *[c.alias(f"_c_{n}") for n, c in carry.items()])
    w = Window.partitionBy("_b").orderBy("_close", F.col("doc_id").asc_nulls_last(), "text")
    own = [F.col(f"_c_{n}").alias(n) for n in carry]
    return (
        rows.withColumn("next", F.lead(F.struct("text", *own)).over(w))
        .filter(~F.col("_close"))
        .select("doc_id", "text", *own, "next")
    )


def fingerprint_edits(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, its successor's and an edited form: the last quarter of the code points gives way
    to as many (or all) from the start of the next document."""
    paired = with_successor(docs, order, text, {"print": tree(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    return paired.withColumn("edited", edited).withColumn("edited_print", tree(F.col("edited")))
