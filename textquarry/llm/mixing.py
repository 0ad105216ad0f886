"""Operator 2, mixing sources to target weights by entropy balancing.

Targets: the words of all sources together are shared out by weight; a source's target stops at
MOST_COPIES times its words, and the excess goes to the others by weight until none is above.

Rates: of all document rates w (how often a document is taken, at most MOST_COPIES) that give each
source its target, those of least relative entropy to taking everything once are
w = min(MOST_COPIES, exp(lambda * z)), z a document's words over its source's mean; lambda, one number a
source, solves the convex dual. Newton iterations find it: each is one aggregation over the documents'
sizes, combined in the tasks, that gives every source the value and slope of its constraint; steps
that leave the bracket known so far are replaced by bisection.

Copies: floor(w + u + shifts), between 0 and MOST_COPIES, u a hash of doc_id in [0, 1). The shifts of each
source are read from histograms of words by the shift at which they change, so that the words taken
come as near to the target as whole documents and STEPS bins allow. Each histogram is summed up, and its best bin found, by windows of
at most 2 * STEPS rows a source. A source of very few documents can miss by much of its target, as copies are whole.

Only a few numbers for each source come to the driver; they go back as a broadcast table up to MOST_BROADCAST
sources, beyond that as an ordinary side of a join.

Defined results: a null text has size 0 and takes nothing; null is a source, last in order; a source
without words has target 0; repeated rows count each, and get the same copies; an empty table gives
an empty result; other columns aren't read, or kept whatever their names (`with_copies`); of two sources of one
weight and equal words neither is preferred, order being by code point; a null doc_id has one hash for all such rows, so they
get copies by their sizes alone; a text of any length is one row, and its words are counted in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh, keep

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
MOST_BROADCAST = 100_000
ROUNDS = 60
NEAR = 1e-9
STEPS = 2048
SHIFTS = 3
SPACED_WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> dict[str | None, float]:
    """The target of each source, given its words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, left, out = set(order), float(sum(sizes.values())), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * share for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
        left = float(sum(sizes.values())) - sum(out.values())
        free -= full
    return out


def _rate(lam: F.Column, most: int) -> F.Column:
    return F.least(F.lit(float(most)), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(50.0), lam * F.col("z")))))


def _with(df: DataFrame, values: dict[str | None, tuple[float, ...]], names: str, kind: str = "left") -> DataFrame:
    """df with columns (names) of each source's values."""
    schema = ", ".join(["_s string", *(f"{n} double" for n in names.split())])
    rows = df.sparkSession.createDataFrame([(s, *map(float, v)) for s, v in values.items()], schema)
    return df.join(F.broadcast(rows) if len(values) <= MOST_BROADCAST else rows, df.source.eqNullSafe(rows._s), kind).drop("_s")


def balance(sized: DataFrame, sizes: dict, wanted: dict, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Lambda of each source: Newton iterations on the dual, a bracket for each held on the driver."""
    low, high, lam = ({s: v for s in wanted if sizes[s]} for v in (-math.inf, math.inf, 0.0))
    lam |= {s: math.inf for s in lam if wanted[s] >= most * sizes[s] * (1 - NEAR)}
    lam |= {s: -math.inf for s in lam if wanted[s] <= 0}
    open_ = {s for s in lam if math.isfinite(lam[s])}
    for _ in range(ROUNDS):
        if not open_:
            break
        rows = _with(sized.where("size > 0"), {s: (lam[s],) for s in open_}, "lam", "inner")
        w = _rate(F.col("lam"), most)
        found = rows.groupBy("source").agg(F.sum(w * F.col("size")).alias("value"), F.sum(F.when(F.col("lam") * F.col("z") < math.log(most), w * F.col("size") * F.col("z")).otherwise(0.0)).alias("slope")).collect()
        for r in found:
            s, gap = r.source, r.value - wanted[r.source]
            if abs(gap) <= 1e-7 * wanted[s]:
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - gap / r.slope if r.slope > 0 else math.inf if gap < 0 else -math.inf
            if not low[s] < step < high[s] or abs(step - lam[s]) > 4 + abs(lam[s]):
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = lam[s] * 2 - 1 if gap > 0 and lam[s] <= 0 else lam[s] * 2 + 1 if gap < 0 and lam[s] >= 0 else 0.0
                    if not low[s] < step < high[s]:
                        step = lam[s] - 1 if gap > 0 else lam[s] + 1
                else:
                    step = (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-12 * max(1.0, abs(lam[s])):
                open_.discard(s)
            lam[s] = step
    return {s: round(v, 9) if math.isfinite(v) else v for s, v in lam.items()}


@dataclass
class Plan:
    """What decides the copies: of each source its numbers."""

    most: int
    sizes: dict[str | None, int]
    mean: dict[str | None, float]
    wanted: dict[str | None, float]
    lam: dict[str | None, float]
    shifts: list[tuple[dict, dict]]  # of each round, the size up to which documents are shifted, and by how much

    def place(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, source, size) with rate and place: its whole part is the number of copies."""
        rows = _with(docs, {s: (self.mean[s], self.lam[s], self.wanted[s], self.sizes[s]) for s in self.sizes}, "mean lam target source_size")
        rows = rows.withColumn("z", F.col("size") / F.col("mean")).withColumn("rate", F.when(F.col("size") == 0, 0.0).otherwise(_rate(F.col("lam"), self.most)))
        place = F.col("rate") + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        if self.shifts:
            rows = _with(rows, {s: tuple(x[s] for pair in self.shifts for x in pair) for s in self.sizes}, " ".join(f"most{k} shift{k}" for k in range(len(self.shifts))))
            for k in range(len(self.shifts)):
                place = place + F.when(F.col("size") <= F.col(f"most{k}"), F.col(f"shift{k}")).otherwise(0.0)
        copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(self.most), F.greatest(F.lit(0), F.floor("place"))).cast("int"))
        return rows.withColumn("place", place).withColumn("copies", copies).withColumn("source_size", F.col("source_size").cast("long")).withColumn("taken", F.col("size") * F.col("copies"))

    def shift(self, docs: DataFrame, limit: dict, off: dict) -> None:
        """Adds a round: the shift, a multiple of 1 / STEPS in (-1, 1), of all documents of a source up to its limit that brings its words nearest to the target."""
        rows = _with(self.place(docs.where("size > 0")).select("source", "size", "place"), {s: (limit[s],) for s in self.sizes}, "most").where("size <= most")
        # a document gains a copy as the shift passes each k - place
        bins = rows.select("source", "size", F.explode(F.array(*((F.lit(float(k)) - F.col("place") for k in range(1, self.most + 1))))).alias("left"))
        bins = bins.select("source", "size", F.greatest(F.ceil(F.col("left") * STEPS), F.lit(1 - STEPS)).cast("int").alias("bin")).where(f"bin < {STEPS}")
        sums = bins.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        edge = docs.sparkSession.createDataFrame([(s, 1 - STEPS, 0) for s in self.sizes], "source string, bin int, words long")
        own = Window.partitionBy("source")
        total, until = F.sum("words").over(own.orderBy("bin", "words").rowsBetween(Window.unboundedPreceding, 0)), F.coalesce(F.lead("bin").over(own.orderBy("bin", "words")), F.lit(STEPS))
        now = F.sum(F.when(F.col("bin") <= 0, F.col("words")).otherwise(0)).over(own)
        steps = sums.unionByName(edge).select("source", "bin", total.alias("total"), until.alias("until"), now.alias("now")).where("until > bin")
        steps = _with(steps, {s: (off.get(s, math.nan), self.wanted[s]) for s in self.sizes}, "gap target")
        # of the shifts from bin to until, which all have the same words, the least
        spot = F.when((F.col("bin") <= 0) & (F.col("until") > 0), 0).when(F.col("bin") > 0, F.col("bin")).otherwise(F.col("until") - 1)
        gap = F.when(F.isnan("gap"), F.col("target") - F.col("now")).otherwise(F.col("gap"))
        steps = steps.select("source", spot.alias("spot"), (gap - (F.col("total") - F.col("now"))).alias("left"))
        best = steps.groupBy("source").agg(F.min(F.struct(F.abs("left"), F.abs("spot"), F.col("spot"), F.col("left"))).alias("b")).select("source", "b.spot", "b.left").collect()
        shifts = dict.fromkeys(self.sizes, 0.0)
        for r in best:
            shifts[r.source], off[r.source] = r.spot / STEPS, r.left
        self.shifts.append((dict(limit), shifts))


def _words() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int) -> Plan:
    """The plan for docs(doc_id, source, size)."""
    found = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")).collect()
    sizes = {r.source: r["size"] for r in found}
    mean = {r.source: r["size"] / r.n if r.n else 1.0 for r in found}
    wanted = targets(sizes, weights, most)
    sized = _with(docs, {s: (m,) for s, m in mean.items()}, "mean").select("doc_id", "source", "size", (F.col("size") / F.col("mean")).alias("z"))
    lam = balance(sized, sizes, wanted, most)
    plan = Plan(most, sizes, mean, wanted, {s: max(-1e6, min(1e6, lam.get(s, 0.0))) for s in sizes}, [])
    limit, off = dict.fromkeys(sizes, 2.0**62), {}
    for _ in range(SHIFTS if sizes else 0):
        plan.shift(docs, limit, off)
        limit = {s: abs(off.get(s, 0.0)) for s in sizes}
    return plan


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words().alias("size"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, rate, copies, taken."""
    docs = keep(_docs(documents))
    return _plan(docs, weights, most).place(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def with_copies(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """All columns of documents, then size, source_size, target, copies, taken (with underlines ahead where a name is taken)."""
    own = ("size", "source_size", "target", "copies", "taken")
    placed = _plan(keep(_docs(documents)), weights, most).place(documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words().alias("size")))
    return placed.select(*(F.col("row")[c].alias(c) for c in documents.columns), *(F.col(c).alias(n) for c, n in zip(own, fresh(documents.columns, *own), strict=True)))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "size", "source_size", "target", "taken")
