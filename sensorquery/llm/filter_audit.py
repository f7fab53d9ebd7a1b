"""Audit of how filters interact: what each removes, alone and after others, and its Shapley share.

Every document gets one bit per filter that it fails, so all that a part of the corpus can tell about
the filters is a table of 32 cells, one per set of failed filters. What a coalition of filters removes
is a sum of cells, and a step of an order removes the difference of two coalitions. The Shapley values
come from the 32 coalitions by constrained least squares: minimise the squared error of an additive
model weighted by the Shapley kernel (k - 1) / (C(k, s) s (k - s)), subject to the values adding up to
what all filters remove together. The normal equations are solved in rationals, so the result is exact.

The filters, with the words ``[^\\x20\\x09-\\x0D]+`` of the whole text: A fewer than 200 words; B fewer
than half of the words distinct; C more than 3 per cent of the code points in A-Z; D any of ``#$%&*|``;
E the text of a smaller ``doc_id`` anywhere in the table. All run inside the JVM.

Null texts are empty texts: they fail A, not B or C (0 is not less than 0), and E after the first. Rows
that share an id are counted each; with the same text neither has the smaller id. A row without an id
has no smaller one and is none: it never fails E nor makes another fail it. Repeated label rows of one
id count once, a 1 before a 0; documents without a label lose nothing good or toxic. An empty table has
no parts and gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.session import ship_functions

LEAST_WORDS = 200
COUNTED = ("n", "good", "toxic")


def text_filters() -> dict[str, Callable[[Column], Column]]:
    """Failure conditions that look at one text."""

    def words(text: Column) -> Column:
        return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def capitals(text: Column) -> Column:
        return F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    return {
        "A": lambda t: F.size(words(t)) < LEAST_WORDS,
        "B": lambda t: 100 * F.size(F.array_distinct(words(t))) < 50 * F.size(words(t)),
        "C": lambda t: 100 * capitals(t) > 3 * F.length(t),
        "D": lambda t: t.rlike(r"[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, bit i for filter i.

    Equal texts fail the same text filters, so E needs the least id per digest (SHA-256 of the text) and
    no join back: rows are summed per digest and part first, with the rows of the least id kept apart.
    A text that a third of all rows hold is pre-aggregated in every task.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(fails(text), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_filters().values())]
    seen = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(part, F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("digest"), reduce(lambda a, b: a.bitwiseOR(b), bits).alias("mask"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = seen.join(told, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    sums = [F.sum(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    each = marked.groupBy("digest", "part", "id").agg(F.first("mask").alias("mask"), *sums)
    known = F.col("id").isNotNull()
    held = each.groupBy("digest", "part").agg(
        F.first("mask").alias("mask"), F.min(F.when(known, F.struct("id", *COUNTED))).alias("least"),
        *[F.sum(F.when(known, F.col(c)).otherwise(0)).alias(c) for c in COUNTED],
        *[F.sum(F.when(known, 0).otherwise(F.col(c))).alias(f"free_{c}") for c in COUNTED])
    first = held.groupBy("digest").agg(F.min("least.id").alias("first_id"))
    own = F.col("least.id") == F.col("first_id")
    split = held.join(first, "digest")
    kept = [(F.when(own, F.col(f"least.{c}")).otherwise(0) + F.col(f"free_{c}")).alias(c) for c in COUNTED]
    again = [(F.col(c) - F.when(own, F.col(f"least.{c}")).otherwise(0)).alias(c) for c in COUNTED]
    repeat = 1 << len(bits)
    both = F.array(
        F.struct("mask", *[x.alias(f"{c}") for x, c in zip(kept, COUNTED)]),
        F.struct((F.col("mask") + repeat).alias("mask"), *[x.alias(f"{c}") for x, c in zip(again, COUNTED)]))
    cells = split.select("part", F.inline(both))
    return cells.where("n > 0").groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTED])


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """Gauss-Jordan elimination in rationals."""
    n = len(right)
    rows = [[Fraction(x) for x in r] + [Fraction(y)] for r, y in zip(matrix, right)]
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[-1] for r in rows]


def shapley_values(removed: list[int], filters: int) -> list[Fraction]:
    """Shapley values of the game ``removed`` (one value per coalition, as a bit mask), by the kernel-
    weighted least squares whose solution they are, under the constraint that they sum to the whole.

    Stationarity: sum over coalitions of w z (z.x - v) + multiplier = 0; the last row is the constraint.
    """
    size = filters + 1
    matrix = [[Fraction(0)] * size for _ in range(size)]
    right = [Fraction(0)] * size
    for coalition in range(1, (1 << filters) - 1):
        inside = [i for i in range(filters) if coalition >> i & 1]
        s = len(inside)
        weight = Fraction(filters - 1, comb(filters, s) * s * (filters - s))
        for i in inside:
            right[i] += weight * (removed[coalition] - removed[0])
            for j in inside:
                matrix[i][j] += weight
    for i in range(filters):
        matrix[i][filters] = matrix[filters][i] = Fraction(1)
    right[filters] = Fraction(removed[-1] - removed[0])
    return solve(matrix, right)[:filters]


def _reports(names: str):
    """From the cells of a part, one row per order and step."""
    k = len(names)
    full = (1 << k) - 1
    orders = [("".join(p), [names.index(x) for x in p]) for p in permutations(names)]
    factorial = len(orders)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                table = {c: [0] * (full + 1) for c in COUNTED}
                for cell in row["cells"]:
                    for c in COUNTED:
                        table[c][cell["mask"]] += cell[c]
                # Documents that a coalition removes: those whose failed filters meet it.
                gone = {c: [sum(v for mask, v in enumerate(t) if mask & s) for s in range(full + 1)] for c, t in table.items()}
                total = sum(table["n"])
                failing = [gone["n"][1 << i] for i in range(k)]
                share = [int(x * factorial) for x in shapley_values(gone["n"], k)]
                for name, order in orders:
                    before = 0
                    for step, i in enumerate(order, 1):
                        after = before | 1 << i
                        lost = {c: gone[c][after] - gone[c][before] for c in COUNTED}
                        out.append({
                            "part": row["part"], "filter_order": name, "step": step, "kept": total - gone["n"][after],
                            "removed": lost["n"], "redundant": failing[i] - lost["n"], "unique_fails": table["n"][1 << i],
                            "good_lost": lost["good"], "toxic_lost": lost["toxic"], "shapley": share[i]})
                        before = after
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
                + [(c, pa.int64()) for c in _COUNTS]))

    return run


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """One row per part, order of the filters and step, with what that step keeps and removes.

    ``part`` is a column of ``docs``, by default ``lang``. ``shapley`` is the filter's Shapley value times
    the number of orders: what it removes, summed over all orders.
    """
    cells = failure_cells(docs, labels, F.col("lang") if part is None else part)
    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("cells"))
    return per_part.mapInArrow(_reports("".join(text_filters()) + "E"), _REPORT)


ship_functions(__name__)
