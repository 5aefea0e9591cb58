"""What a set of filters removes, in every order of applying them, from coalition counts alone.

A document fails some of the filters; that set is its mask. Documents are counted by part and
mask, so whatever their number a part is one row of 2**k counts. The removal game of a part
gives every coalition of filters the documents that at least one of its filters removes:
its worth v(S) is all documents less those whose mask has nothing in common with S.

Hart and Mas-Colell's potential is P(empty) = 0 and P(S) = (v(S) + sum of P(S less i) over i in
S) / |S|; the Shapley value of a filter is P(all) - P(all but it). Here Q(S) = |S|! P(S), which
stays a whole number: Q(S) = (|S| - 1)! v(S) + sum of Q(S less i). What a filter removes at a
step of an order is the worth of the coalition up to it less the worth of the one before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: More filters would make the orders, k! of them, the larger part of the result.
MOST_FILTERS = 7


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that depend on a text alone; a text without words fails A only."""
    # UTF-8 has A-Z in single bytes, so bytes that go are characters that go
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def document_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, digest, mask) of each document; bit i of the mask is failing the i-th condition of ``text_failures``.

    The text itself goes no further than the scan. NULL text is empty, NULL part is "".
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(text_failures(body).values())]
    mask = reduce(lambda a, b: a + b, bits)
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), mask.alias("mask"))


def with_flags(masks: DataFrame, labels: DataFrame, flags: Mapping[str, Column], key: str = "doc_id") -> DataFrame:
    """Equal documents as one row: (key, part, digest, mask, n) and a 0/1 column per flag that some label row of the key sets.

    Documents without a key have no labels; they get keys of their own for the join, so that
    they don't meet in one task.
    """
    counted = masks.groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("label_key"))
    known = known.agg(*(F.max(F.when(set_by, 1).otherwise(0)).alias(name) for name, set_by in flags.items()))
    own = counted.withColumn("join_key", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))))
    joined = own.join(known, own["join_key"] == known["label_key"], "left")
    return joined.select(*counted.columns, *(F.coalesce(name, F.lit(0)).alias(name) for name in flags))


def with_copies(rows: DataFrame, flags: Sequence[str], bit: int) -> DataFrame:
    """Counts (part, mask, n, flags) with ``bit`` added to the mask of every text that a smaller key has too.

    All copies of a text share its mask, so it is enough to count them by text and part and to
    keep the documents of the smallest key apart: those, and documents without a key, are no
    copies. A text with any number of copies is one row per part after the partial sums.
    """
    amounts = ["n", *flags]
    weigh = lambda a: F.col("n") if a == "n" else F.col("n") * F.col(a)
    keyed = [F.sum(F.when(F.col("key").isNotNull(), weigh(a)).otherwise(0)).alias(f"keyed_{a}") for a in amounts]
    free = [F.sum(F.when(F.col("key").isNull(), weigh(a)).otherwise(0)).alias(f"free_{a}") for a in amounts]
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", *(weigh(a).alias(a) for a in amounts))))
    by_part = rows.groupBy("digest", "part").agg(F.first("mask").alias("mask"), *keyed, *free, first.alias("first"))
    # one row per text and part is left, so a text's rows are as many as the parts it is in
    each = by_part.withColumn("key", F.min("first.key").over(Window.partitionBy("digest")))
    is_first = F.coalesce(F.col("first.key") == F.col("key"), F.lit(False))
    alone = [(F.col(f"free_{a}") + F.when(is_first, F.col(f"first.{a}")).otherwise(0)).alias(a) for a in amounts]
    copies = [(F.col(f"keyed_{a}") - F.when(is_first, F.col(f"first.{a}")).otherwise(0)).alias(a) for a in amounts]
    both = F.array(F.struct(F.col("mask"), *alone), F.struct((F.col("mask") + bit).alias("mask"), *copies))
    counts = each.select("part", F.explode(both).alias("c")).select("part", "c.*")
    return counts.groupBy("part", "mask").agg(*(F.sum(a).alias(a) for a in amounts))


def worth(counts: Column, filters: int) -> Column:
    """v of every coalition, in the order of their bits, from the counts by mask."""
    own = lambda s: F.aggregate(F.transform(counts, lambda c, m: F.when(m.bitwiseAND(s) != 0, c).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), own)


def potentials(v: Column, filters: int) -> Column:
    """Q of every coalition, each from those with one filter less, which come before it."""
    members = lambda s: reduce(lambda a, b: a + b, (F.shiftright(s, i).bitwiseAND(1) for i in range(filters)))
    before = F.array(*(F.lit(factorial(max(0, n - 1))).cast("long") for n in range(filters + 1)))

    def step(known: Column, s: Column) -> Column:
        less = [F.when(F.shiftright(s, i).bitwiseAND(1) == 1, F.get(known, s - (1 << i))).otherwise(0) for i in range(filters)]
        return F.concat(known, F.array(F.get(before, members(s)) * F.get(v, s) + reduce(lambda a, b: a + b, less)))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), step)


def audit(counts: DataFrame, names: str, lost: Mapping[str, str]) -> DataFrame:
    """One row per part, order of the filters and step, from counts by (part, mask).

    ``counts`` has part, mask, n and the columns named in ``lost``; each of those gives a column of what
    the step removes of it. ``names`` has one letter per filter, bit 0 first. kept, removed,
    redundant and unique_fails are documents of the part; shapley is the filter's removals
    summed over all orders, k! times its Shapley value. A part without documents has no
    rows, so an empty table gives none. All parts are aggregated by mask before their rows meet.
    """
    k, every = len(names), (1 << len(names)) - 1
    if not 1 <= k <= MOST_FILTERS or len(set(names)) != k:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters with a letter each are needed, not {names!r}")
    at_mask = lambda a, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(a))), F.lit(0)).cast("long")
    arrays = counts.groupBy("part").agg(*(F.array(*(at_mask(a, m) for m in range(every + 1))).alias(a) for a in ["n", *lost]))
    games = arrays.select("part", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("documents"), *(worth(F.col(a), k).alias(a) for a in ["n", *lost]))
    games = games.withColumn("q", potentials(F.col("n"), k))
    steps = []
    for order in permutations(range(k)):
        gone = 0
        for j, i in enumerate(order):
            steps.append(("".join(names[x] for x in order), j + 1, 1 << i, gone, gone | 1 << i))
            gone |= 1 << i
    # constant rows of the plan, not a table to join with
    rows = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"w":{w},"a":{a},"b":{b}}}' for o, s, w, a, b in steps) + "]"), "array<struct<o:string,s:int,w:int,a:int,b:int>>")
    each = games.select("*", F.inline(rows))
    single = F.col("w")
    here = lambda a: F.get(F.col(a), F.col("b")) - F.get(F.col(a), F.col("a"))
    return each.select(
        "part",
        F.col("o").alias("filter_order"),
        F.col("s").alias("step"),
        (F.col("documents") - F.get("n", F.col("b"))).alias("kept"),
        here("n").alias("removed"),
        (F.get("n", single) - here("n")).alias("redundant"),
        (F.get("n", F.lit(every)) - F.get("n", every - single)).alias("unique_fails"),
        *(here(a).alias(name) for a, name in lost.items()),
        (F.get("q", F.lit(every)) - k * F.get("q", every - single)).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of filters A to E over whole texts: short, repetitive, loud, with marks, copied.

    Repeated rows are documents of their own, with one key: none is a copy of the other. Copies
    are texts with equal SHA-256. A document whose key occurs several times in ``labels`` is
    good (or toxic) if any of those rows says so; NULL labels say nothing. Other columns are not read.
    """
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    rows = with_flags(document_masks(docs, key, text, part), labels, flags, key)
    return audit(with_copies(rows, list(flags), 1 << 4), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
