"""Scoring and searching the lattice of full-domain generalisations.

Rows are scanned once into a frequency set; every lattice node is an aggregate over that set.
A node is a number in mixed radix, one digit per attribute, so the nodes of a whole lattice are an
``explode(sequence)`` and never a driver-built table.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import band, band_code, code_leaves, grid_leaves
from veilspark.operators.classes import generalise_all, suppress_small
from veilspark.operators.metrics import PENALISED, scale_of
from veilspark.operators.taxonomy import value_paths
from veilspark.runtime import materialise, spread
from veilspark.spec import QI, STAR, names

# Searches score lattices up to this size in one job; the scores are the same either way.
PREFETCH_NODES = 5_000
# Frequency sets above this size are rolled up before scoring.
ROLLUP_ROWS = 100_000
# Nodes are scored from a set rolled up for them when that has at most one row for so many of the set it is made of.
ROLLUP_GAIN = 8
# An attribute is rolled up to levels that leave at most one cell for so many of the last such level.
STOP_GAIN = 16

# Rows times nodes that one aggregate takes: a task holds the classes of all its nodes at once.
NODE_ROWS = 4_000_000

# Corners of boxes of the lattice that a job of the exact search scores, where so many are left.
BOXES = 24

MODELS = ("granularity", "intensity", "discernibility", "entropy", "groupsize")
#: Column that tells the frequency sets of a family apart.
SET = "_set"


class Lattice:
    """Node numbering of the generalisation lattice of some attributes."""

    def __init__(self, qis: list[QI]):
        self.qis = qis
        self.radix = [q.top_level + 1 for q in qis]
        self.size = math.prod(self.radix)
        self.strides = [math.prod(self.radix[j + 1:]) for j in range(len(qis))]

    @property
    def top(self) -> int:
        return self.size - 1

    def levels(self, node: int) -> list[int]:
        return [(node // s) % r for s, r in zip(self.strides, self.radix)]

    def node(self, levels: list[int]) -> int:
        return sum(level * s for level, s in zip(levels, self.strides))

    def level(self, node: Column, j: int) -> Column:
        return F.pmod(F.floor(node / F.lit(self.strides[j])), F.lit(self.radix[j])).cast("int")

    def nests(self, j: int, fine: int, coarse: int) -> bool:
        """Every cell of attribute j at level ``fine`` lies within one at level ``coarse``."""
        q = self.qis[j]
        if q.is_category or fine in (0, coarse) or coarse == q.top_level:
            return fine <= coarse
        a, b = (round(q.widths[level - 1] * 10**q.decimals) for level in (fine, coarse))
        # the last band takes what is left over, so counts of bands have to agree as well
        last = [max(1, round(q.grid_units / w)) - 1 for w in (a, b)]
        return fine < coarse and b % a == 0 and last[1] * b // a <= last[0]

    def finer(self, node: int) -> list[int]:
        """Direct specialisations: one attribute one level down."""
        return [node - s for s, level in zip(self.strides, self.levels(node)) if level > 0]


def frequency_set(df: DataFrame, qis: list[QI], by: list[str] = []) -> DataFrame:
    """Distinct attribute combinations of the raw rows with their counts, written once."""
    return materialise(df.groupBy(*by, *names(qis)).agg(F.count(F.lit(1)).alias("n")))


def with_paths(df: DataFrame, qis: list[QI]) -> DataFrame:
    """Adds per attribute an array ``p0, p1, ..`` over levels of (generalised value, share of the domain)."""
    out = df
    for j, q in enumerate(qis):
        name = f"p{j}"
        if q.is_category:
            table = value_paths(q.tax).select(F.col("value").alias(q.name), F.col("path").alias(name))
            out = q.tax.lookup(out, table, q.name, "left")
            gone = F.struct(F.lit(STAR).alias("node"), F.lit(1.0).alias("share"))
            missing = F.array(*[gone for _ in range(q.top_level + 1)])
            out = out.withColumn(name, F.coalesce(name, missing))
        else:
            value = F.col(q.name).cast("double")
            cells = [band(value, q, level) for level in range(q.top_level + 1)]
            out = out.withColumn(name, F.array(*[
                # a NULL counts as lost, as it does in the metrics
                F.struct(c.alias("node"), F.coalesce(grid_leaves(c, q) / F.lit(q.domain_size), F.lit(1.0)).alias("share"))
                for c in cells
            ]))
    return out


def with_codes(df: DataFrame, qis: list[QI]) -> DataFrame:
    """As ``with_paths``, but the cells of numbers are whole numbers and their shares are left to ``code_leaves``:
    nothing is written out as text for rows that are only counted."""
    out = with_paths(df, [q if q.is_category else replace(q, widths=()) for q in qis])
    return out.withColumns({
        f"p{j}": F.array(*[band_code(F.col(q.name).cast("double"), q, level) for level in range(q.top_level + 1)])
        for j, q in enumerate(qis) if not q.is_category})


@dataclass(frozen=True)
class Facts:
    """What a lattice node costs, in sums that do not depend on the scale of a score."""

    score: float
    cost: float
    gone: int
    gone_share: float
    floor_squares: float


class Scorer:
    """Scores lattice nodes of one frequency set, or of a family of them told apart by ``SET``.

    The sets are generalised once, to paths of cells. Large ones are rolled up as far as the nodes asked for
    allow, where that makes them much smaller, so a node is computed from a small table that still holds it.
    A job scores any number of nodes of all sets. ``k`` is one class size and ``model`` one loss, or one per set.
    """

    def __init__(self, freq: DataFrame, qis: list[QI], k: int | dict[str, int],
                 model: str | dict[str, str] = "granularity", rollup_rows: int = ROLLUP_ROWS):
        self.qis, self.lattice, self.model, self.m = qis, Lattice(qis), model, len(qis)
        self.known: dict[tuple[str, int], Facts] = {}
        if SET not in freq.columns:
            freq = freq.withColumn(SET, F.lit(""))
        paths = materialise(with_codes(spread(freq, SET, *names(qis)), qis).select(SET, "n", *[f"p{j}" for j in range(self.m)]))
        levels = [(j, level) for j in range(self.m) for level in range(self.lattice.radix[j])]
        share = lambda j, level: F.sum(F.col("n") * self._cell(j, F.lit(level))[1])
        # what bands hold is known without looking, see _cells
        counted = [(j, level) for j, level in levels if level == 0 or qis[j].is_category]
        facts = paths.groupBy(SET).agg(
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("combos"),
            F.array(*[share(j, level) for j, level in levels]).alias("shares"),
            F.array(*[F.approx_count_distinct(self._cell(j, F.lit(level))[0]) for j, level in counted]).alias("cells")).collect()
        self.rows = {r[SET]: r["rows"] for r in facts}
        #: per set, attribute and level: the share sum of all rows, nothing suppressed
        self.shares = {r[SET]: {jl: x for jl, x in zip(levels, r["shares"])} for r in facts}
        self.k = k if isinstance(k, dict) else {s: k for s in self.rows} or {"": k}
        combos = sum(r["combos"] for r in facts)
        #: sets rolled up to a level of every attribute, with their counted rows
        self.tables: dict[tuple[int, ...], tuple[DataFrame, int]] = {(0,) * self.m: (paths, combos)}
        self.wide, self.rollup_rows = None, rollup_rows
        if combos > rollup_rows:
            cells = {jl: max(r["cells"][i] for r in facts) for i, jl in enumerate(counted)}
            self.cells = [[self._cells(j, level, cells) for level in range(self.lattice.radix[j])] for j in range(self.m)]
            self.wide = max(range(self.m), key=lambda j: self.cells[j][0])
            self.stops = []
            for mine in self.cells:
                stops = [0]
                for level, n in enumerate(mine):
                    if n * STOP_GAIN <= mine[stops[-1]]:
                        stops.append(level)
                self.stops.append(stops)

    def _cell(self, j: int, level: Column) -> tuple[Column, Column]:
        """(cell, share of the domain) of attribute j at a level."""
        q, cell = self.qis[j], F.get(f"p{j}", level)
        if q.is_category:
            return cell["node"], cell["share"]
        usual, last, end = zip(*[code_leaves(q, i) for i in range(q.top_level + 1)])
        at = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), level)
        leaves = F.when(cell == at(last, "bigint"), at(end, "bigint")).otherwise(at(usual, "bigint"))
        # a NULL counts as lost, as it does in the metrics
        return cell, F.when(cell.isNull(), F.lit(1.0)).otherwise(leaves / F.lit(q.domain_size))

    def _cells(self, j: int, level: int, counted: dict[tuple[int, int], int]) -> int:
        """How many paths of attribute j are left from a level on, at most (counts of categories are estimates)."""
        q = self.qis[j]
        if (j, level) in counted:
            return max(counted[j, level], 1)
        # every end of a band of a level above may cut one more
        return min(counted[j, 0], sum(max(1, round(q.grid_units / round(w * 10**q.decimals))) for w in q.widths[level - 1:]) or 1)

    def _source(self, levels: tuple[int, ...]) -> tuple[int, ...]:
        """Levels of the smallest table made so far that holds a node."""
        return min((t for t in self.tables if all(a <= b for a, b in zip(t, levels))), key=lambda t: self.tables[t][1])

    def _table(self, levels: tuple[int, ...]) -> DataFrame:
        """The sets with every attribute generalised to a level."""
        if levels not in self.tables:
            below = self._source(levels)
            # the whole path that is left: a band need not lie within one band of the level above
            paths = [
                F.slice(f"p{j}", at + 1, self.lattice.radix[j]).alias(f"p{j}") if at > below[j] else F.col(f"p{j}")
                for j, at in enumerate(levels)]
            merged = self.tables[below][0].groupBy(SET, *paths).agg(F.sum("n").alias("n"))
            lowest = {f"p{j}": F.concat(F.array_repeat(F.get(f"p{j}", F.lit(0)), at), f"p{j}")
                      for j, at in enumerate(levels) if at > below[j]}
            made = materialise(merged.withColumns(lowest) if lowest else merged)
            self.tables[levels] = made, made.count()
        return self.tables[levels][0]

    def _holding(self, levels: tuple[int, ...]) -> tuple[int, ...]:
        """Levels of the table to score a node from, made for it where that is much smaller than the others."""
        if self.wide is not None:
            # what is left without the single values of the widest attribute can only be known by counting
            if levels[self.wide]:
                self._table(tuple(int(j == self.wide) for j in range(self.m)))
            near = tuple(max(stop for stop in stops if stop <= at) for stops, at in zip(self.stops, levels))
            most = len(self.rows) * math.prod(mine[at] for mine, at in zip(self.cells, near))
            rows = self.tables[self._source(near)][1]
            if near not in self.tables and rows > self.rollup_rows and most * ROLLUP_GAIN <= rows:
                self._table(near)
        return self._source(levels)

    def _classes_of(self, paths: DataFrame, ids: Column) -> DataFrame:
        """(set, node, g0.., cnt, share): equivalence classes of the nodes."""
        m = self.m
        each = paths.select("*", F.explode(ids).alias("node"))
        cells = [self._cell(j, self.lattice.level(F.col("node"), j)) for j in range(m)]
        share = sum((c for _, c in cells), F.lit(0.0))
        return (
            each.select(SET, "node", "n", *[c.alias(f"g{j}") for j, (c, _) in enumerate(cells)], share.alias("share"))
            .groupBy(SET, "node", *[f"g{j}" for j in range(m)])
            .agg(F.sum("n").alias("cnt"), F.first("share").alias("share")))

    def classes(self, nodes: list[int] | None) -> DataFrame:
        """Classes of the nodes, or of all nodes, in every set."""
        lattice, w = self.lattice, self.wide
        parts: list[tuple[DataFrame, Column]] = []
        if nodes is not None:
            held: dict[tuple[int, ...], list[int]] = {}
            for i in nodes:
                held.setdefault(self._holding(tuple(lattice.levels(i))), []).append(i)
            for at, mine in held.items():
                table, each = self._table(at), max(1, NODE_ROWS // max(self.tables[at][1], 1))
                parts += [(table, F.array(*[F.lit(i).cast("bigint") for i in mine[x:x + each]])) for x in range(0, len(mine), each)]
        elif w is None:
            parts = [(self._table((0,) * self.m), F.sequence(F.lit(0).cast("bigint"), F.lit(lattice.size - 1).cast("bigint")))]
        else:
            stride, radix = lattice.strides[w], lattice.radix[w]
            for level in range(radix):
                # numbers of the other attributes' levels, with this attribute's level put between
                others = F.sequence(F.lit(0).cast("bigint"), F.lit(lattice.size // radix - 1).cast("bigint"))
                ids = F.transform(others, lambda c: F.floor(c / stride) * (stride * radix) + level * stride + F.pmod(c, F.lit(stride)))
                parts.append((self._table(tuple(level if j == w else 0 for j in range(self.m))), ids))
        return reduce(DataFrame.unionByName, [self._classes_of(*part) for part in parts])

    def scores(self, models: list[str], nodes: list[int] | None = None) -> DataFrame:
        """One row per set and node: quality after suppressing classes below k (lower is better), the
        suppressed share, levels, and the sums the exact search bounds with."""
        classes, lattice, m = self.classes(nodes), self.lattice, self.m
        if len(self.rows) <= 1:
            (k, n), = [(self.k[s], n) for s, n in self.rows.items()] or [(next(iter(self.k.values())), 0)]
            classes = classes.withColumn("_k", F.lit(k)).withColumn("_rows", F.lit(float(n)))
        else:
            sets = classes.sparkSession.createDataFrame(
                [(s, self.k[s], float(n)) for s, n in self.rows.items()], f"{SET} string, _k int, _rows double")
            # one row per set
            classes = classes.join(F.broadcast(sets), SET)
        kept, size = F.col("cnt") >= F.col("_k"), F.col("cnt").cast("double")
        facts = classes.groupBy(SET, "node").agg(
            F.first("_k").alias("_k"), F.first("_rows").alias("_rows"),
            F.sum(F.when(kept, 0.0).otherwise(size)).alias("_gone"),
            F.sum(F.when(kept, size * F.col("share")).otherwise(0.0)).alias("_loss"),
            F.sum(F.when(kept, 0.0).otherwise(size * F.col("share"))).alias("_gone_share"),
            F.sum(F.when(kept, size * size).otherwise(0.0)).alias("_squares"),
            F.sum(size * F.greatest(size, F.col("_k"))).alias("_floor_squares"),
            F.count_if(kept).alias("_kept_classes"))
        if "entropy" in models:
            # numbers are codes; their highest level is the only one that is suppressed
            text = lambda j, q: F.col(f"g{j}") if q.is_category else F.when(
                lattice.level(F.col("node"), j) == q.top_level, F.lit(STAR)).otherwise(F.col(f"g{j}").cast("string"))
            cells = F.explode(F.array(*[
                F.struct(F.lit(j).alias("j"), text(j, q).alias("g")) for j, q in enumerate(self.qis)])).alias("_c")
            per_value = classes.filter(kept).select(SET, "node", "cnt", "_rows", cells).groupBy(SET, "node", "_c.j", "_c.g").agg(
                F.sum("cnt").cast("double").alias("c"), F.first("_rows").alias("_rows"))
            star = F.col("g") == STAR
            per_node = per_value.groupBy(SET, "node").agg(
                F.sum(F.when(star, F.col("c") * F.col("_rows")).otherwise(F.col("c") * F.col("c"))).alias("_entropy"))
            facts = facts.join(per_node, [SET, "node"], "left")
        rows = F.col("_rows")
        levels = [lattice.level(F.col("node"), j) for j in range(m)]
        height = sum((lv / F.lit(q.top_level) for lv, q in zip(levels, self.qis)), F.lit(0.0))
        sums = {
            "granularity": F.col("_loss") + F.col("_gone") * m,
            "intensity": height * (rows - F.col("_gone")) + F.col("_gone") * m,
            "discernibility": F.col("_squares") + F.col("_gone") * rows,
        }
        if "entropy" in models:
            sums["entropy"] = F.coalesce("_entropy", F.lit(0.0)) + F.col("_gone") * rows * m
        cols = {x: sums[x] / scale_of(x, F.col("_k"), rows, m) for x in models if x in PENALISED}
        if "groupsize" in models:
            groups = F.col("_kept_classes") + F.when(F.col("_gone") > 0, 1).otherwise(0)
            sums["groupsize"] = cols["groupsize"] = rows / groups
        return facts.select(
            SET, "node", *[cols[x].alias(x) for x in models],
            F.try_divide(F.col("_gone"), rows).alias("suppressed_share"), F.array(*levels).alias("levels"),
            sums[models[0]].alias("_cost"), "_gone", "_gone_share", "_floor_squares")

    def fetch(self, wanted: dict[str, set[int]] | None) -> None:
        """Facts of the nodes wanted in any set, one job; of all nodes when None."""
        nodes = None if wanted is None else sorted({
            i for s, mine in wanted.items() for i in mine if (s, i) not in self.known})
        if nodes == []:
            return
        model_of = self.model if isinstance(self.model, dict) else {s: self.model for s in self.rows}
        for r in self.scores(sorted({model_of[s] for s in self.rows}), nodes).collect():
            self.known[r[SET], r["node"]] = Facts(
                r[model_of[r[SET]]], r["_cost"], int(r["_gone"]), r["_gone_share"], r["_floor_squares"])

    def value(self, node: int, name: str = "") -> float:
        """Score of a fetched node, larger is better."""
        return -self.known[name, node].score

    def suppressed(self, node: int, name: str = "") -> float:
        return self.known[name, node].gone / self.rows[name]

    def bound(self, low: list[int], high: list[int], name: str = "") -> tuple[float, float]:
        """(score, suppressed share) that no node between two corners, ``high`` fetched, can go below.

        Suppressed rows stay suppressed when cells get finer, as long as cells nest; and a kept row of a
        node costs at least its share there, its class at least k rows.
        """
        f, rows, k, m = self.known[name, self.lattice.node(high)], self.rows[name], self.k[name], self.m
        tops = [q.top_level for q in self.qis]
        nested = all(self.lattice.nests(j, level, high[j]) for j in range(m) for level in range(low[j], high[j]))
        gone, gone_share = (f.gone, f.gone_share) if nested else (0, 0.0)
        if self.model == "granularity":
            base = sum(min(self.shares[name][j, level] for level in range(low[j], high[j] + 1)) for j in range(m))
            cost = base + gone * m - gone_share
        elif self.model == "intensity":
            cost = rows * sum(x / t for x, t in zip(low, tops)) + gone * (m - sum(x / t for x, t in zip(high, tops)))
        elif self.model == "discernibility":
            under = self.known.get((name, self.lattice.node(low)))
            finer = under and all(self.lattice.nests(j, low[j], level) for j in range(m) for level in range(low[j], high[j] + 1))
            cost = (under.floor_squares if finer else rows * min(k, rows)) + gone * max(rows - k, 0)
        elif self.model == "entropy":
            cost = m * (rows * min(k, rows) + gone * max(rows - k, 0))
        else:
            cost = rows / ((rows - gone) / max(k, 1) + 1)
        scale = f.cost / f.score if f.score else 1.0
        return cost / scale, gone / rows


def score_lattice(
    freq: DataFrame, qis: list[QI], k: int, models: list[str] | None = None, nodes: list[int] | None = None,
    rollup_rows: int = ROLLUP_ROWS,
) -> DataFrame:
    """Quality of lattice nodes after suppressing classes below ``k``; lower is better.

    Columns ``node``, one per model, ``suppressed_share``, ``levels``. All nodes are scored when
    ``nodes`` is None.
    """
    models = list(models or MODELS)
    if set(models) - set(MODELS):
        raise ValueError(f"unknown models {sorted(set(models) - set(MODELS))}")
    scores = Scorer(freq, qis, k, models[0], rollup_rows).scores(models, nodes)
    return scores.select("node", *models, "suppressed_share", "levels")


def within_limit(scores: DataFrame, suppression_limit: float) -> DataFrame:
    """Nodes whose suppressed share is allowed."""
    return scores.filter(F.col("suppressed_share") <= suppression_limit)


def best_node(scores: DataFrame, model: str = "granularity", suppression_limit: float = 1.0) -> DataFrame:
    """The allowed node of least loss; ties go to the smaller node number."""
    return within_limit(scores, suppression_limit).agg(
        F.min_by(F.struct("node", "levels", model, "suppressed_share"),
                 F.struct(F.round(model, 9), "node")).alias("_b")).select("_b.*")


def _best_first(scorer: Scorer, limit: float, steps: int) -> int:
    """Search from the top: expand the best node seen, a batch of specialisations per job."""
    lattice = scorer.lattice
    open_nodes, seen = {lattice.top}, {lattice.top}
    best, best_score = lattice.top, -math.inf
    for _ in range(steps):
        if not open_nodes:
            break
        look_ahead(scorer, {"": open_nodes})
        pivot = max(open_nodes, key=lambda i: (scorer.value(i), -i))
        open_nodes.remove(pivot)
        value = scorer.value(pivot)
        if scorer.suppressed(pivot) <= limit and value > best_score:
            best, best_score = pivot, value
        fresh = set(lattice.finer(pivot)) - seen
        seen |= fresh
        open_nodes |= fresh
    return best


def look_ahead(scorer: Scorer, wanted: dict[str, set[int]], depth: int = 2) -> None:
    """Score missing nodes together with the specialisations a search will want next."""
    lattice = scorer.lattice
    missing = {s: {i for i in mine if (s, i) not in scorer.known} for s, mine in wanted.items()}
    if not any(missing.values()):
        return
    if lattice.size <= PREFETCH_NODES:
        return scorer.fetch(None)
    layer = missing
    for _ in range(depth):
        layer = {s: {f for node in mine for f in lattice.finer(node)} for s, mine in layer.items()}
        if len(set().union(*missing.values(), *layer.values())) > 500:
            break
        missing = {s: mine | layer[s] for s, mine in missing.items()}
    scorer.fetch(missing)


def exact_node(scorer: Scorer, limit: float = 1.0, boxes: int = BOXES) -> int:
    """The allowed node of least loss, ties to the smaller number, by branch and bound.

    The lattice is cut into boxes between two corners. A box's coarsest corner is scored; what is
    suppressed there is suppressed in the whole box, and the finest corner bounds what generalising
    costs, so ``Scorer.bound`` says what no node of the box can beat. Boxes that cannot win are dropped
    unscored, the others are halved along the attribute that lifts the bound most, the most promising
    first and at least ``boxes`` corners in one job. The driver holds open boxes, never the lattice.
    """
    lattice = scorer.lattice
    if not scorer.rows:
        return lattice.top
    both = scorer.model == "discernibility"  # its bound needs the finest corner as well
    best, shares = (math.inf, lattice.top), scorer.shares[""]

    def look(nodes: set[int]) -> None:
        nonlocal best
        scorer.fetch({"": nodes})
        for i in nodes:
            if scorer.suppressed(i) <= limit:
                best = min(best, (round(-scorer.value(i), 9), i))

    look({i for _, i in scorer.known})  # what an earlier search has scored

    def cut(low: list[int], high: list[int]) -> int:
        wide = [j for j in range(len(low)) if low[j] < high[j]]
        loose = [j for j in wide if not all(lattice.nests(j, level, high[j]) for level in range(low[j], high[j]))]

        def lift(j: int) -> tuple[float, int]:
            least = lambda lo, hi: min(shares[j, level] for level in range(lo, hi + 1))
            return least((low[j] + high[j]) // 2 + 1, high[j]) - least(low[j], high[j]), high[j] - low[j]

        return max(loose or wide, key=lift)

    heap: list[tuple[float, list[int], list[int]]] = []

    def push(low: list[int], high: list[int]) -> None:
        score, share = scorer.bound(low, high)
        if low != high and share <= limit and round(score, 9) - 2e-9 <= best[0]:
            heapq.heappush(heap, (score, low, high))

    def halve(pieces: list) -> list:
        out = []
        for low, high in pieces:
            if low == high:
                out.append((low, high))
                continue
            j = cut(low, high)
            middle = (low[j] + high[j]) // 2
            out += [(low, [*high[:j], middle, *high[j + 1:]]), ([*low[:j], middle + 1, *low[j + 1:]], high)]
        return out

    work = [([0] * len(lattice.radix), [r - 1 for r in lattice.radix])]
    while work:
        # halved until a job has enough to score: jobs cost more than the few nodes too many
        corners = lambda: [c for box in work for c in (box if both else box[1:]) if ("", lattice.node(c)) not in scorer.known]
        work = halve(work)
        while len(corners()) < boxes and any(low != high for low, high in work):
            work = halve(work)
        look({lattice.node(c) for c in corners()})
        for box in work:
            push(*box)
        work = []
        while heap and len(work) < boxes:
            score, low, high = heapq.heappop(heap)
            if round(score, 9) - 2e-9 > best[0]:
                break
            work.append((low, high))
    return best[1]


def optimal_k_anonymity(
    df: DataFrame, qis: list[QI], k: int = 5, suppression_limit: float = 1.0, model: str = "granularity",
    steps: int = 300, search: str = "exact",
) -> tuple[list[int], DataFrame]:
    """Levels of the best k-anonymous node and its release.

    ``search="exact"`` finds the optimum without scoring nodes that cannot be it. ``"best_first"`` stops
    after ``steps`` expansions and may miss the optimum.
    """
    if search not in ("exact", "best_first"):
        raise ValueError(f"unknown search {search!r}")
    scorer = Scorer(frequency_set(df, qis), qis, k, model)
    if not scorer.rows:
        node = scorer.lattice.top
    elif search == "exact":
        node = exact_node(scorer, suppression_limit)
    else:
        node = _best_first(scorer, suppression_limit, steps)
    levels = scorer.lattice.levels(node)
    return levels, suppress_small(generalise_all(df, qis, levels), qis, k)


def search_noise(seed: str, step: int, node: int) -> float:
    """Gumbel noise of one node in one draw, from the same hash as the noise on cells."""
    digest = hashlib.md5(f"{seed}|search|{step}|{node}".encode()).hexdigest()
    return -math.log(-math.log((int(digest[:13], 16) + 0.5) / (1 << 52)))


@dataclass(frozen=True)
class Search:
    """One private search: its budget, how many nodes it expands, and its seed."""

    eps: float
    steps: int
    seed: str


def dp_searches(scorer: Scorer, searches: dict[str, Search]) -> dict[str, list[int]]:
    """Levels found by a differentially private search in every set, all searches side by side.

    Every step expands the current node into its direct specialisations and draws the next one
    among all unexpanded nodes by the exponential mechanism on the score, which is scaled so that
    one row changes it by at most 1. A last draw picks the result among the visited nodes. The
    budget is shared equally by all draws. Only node scores reach the driver, and a step of all
    searches is one job, or none when the nodes are known.
    """
    if "groupsize" in (scorer.model.values() if isinstance(scorer.model, dict) else [scorer.model]):
        raise ValueError("one row can move the mean group size by any amount: not a score for a private search")
    lattice = scorer.lattice
    steps = {s: min(x.steps, lattice.size - 1) for s, x in searches.items()}
    pivot = {s: lattice.top for s in searches}
    visited, seen = {s: [lattice.top] for s in searches}, {s: {lattice.top} for s in searches}
    open_nodes: dict[str, list[int]] = {s: [] for s in searches}

    def draw(s: str, step: int, nodes: list[int]) -> int:
        # a set without rows has no scores: every node is as good
        unit = searches[s].eps / (steps[s] + 1) / 2
        weight = lambda i: (scorer.value(i, s) * unit if s in scorer.rows else 0.0) + search_noise(searches[s].seed, step, i)
        return max(nodes, key=lambda i: (weight(i), -i))

    known = lambda names: {s: set(open_nodes[s]) for s in names if s in scorer.rows}
    for step in range(max(steps.values(), default=0)):
        active = [s for s in searches if step < steps[s] and pivot[s] is not None]
        for s in active:
            fresh = [i for i in lattice.finer(pivot[s]) if i not in seen[s]]
            seen[s].update(fresh)
            open_nodes[s] = sorted(set(open_nodes[s]) | set(fresh))
        look_ahead(scorer, known(active))
        for s in active:
            pivot[s] = draw(s, step, open_nodes[s]) if open_nodes[s] else None
            if pivot[s] is not None:
                open_nodes[s].remove(pivot[s])
                visited[s].append(pivot[s])
    look_ahead(scorer, {s: set(visited[s]) for s in searches if s in scorer.rows})
    return {s: lattice.levels(draw(s, steps[s], sorted(visited[s]))) for s in searches}


def dp_search(
    freq: DataFrame, qis: list[QI], k: int, eps_search: float, steps: int, seed: str,
    model: str = "granularity",
) -> list[int]:
    """``dp_searches`` for one set."""
    return dp_searches(Scorer(freq, qis, k, model), {"": Search(eps_search, steps, seed)})[""]


def cells_at(qis: list[QI], levels: str) -> list[Column]:
    """Cells of rows from ``with_paths``, generalised to the array column ``levels`` as ``generalise`` does."""
    out = []
    for j, q in enumerate(qis):
        level = F.get(levels, F.lit(j))
        # taken from a transform: a field taken straight from the path is read below the outer join that
        # filled it in, where the fill for unknown values is lost
        cell = F.get(F.transform(f"p{j}", lambda x: x["node"]), level)
        if q.is_category:
            raw = F.col(q.name).cast("string")
            # a hierarchy's values stay themselves at its lowest level, and NULL stays NULL below the top
            cell = F.when(level >= q.top_level, F.lit(STAR)).when((level == 0) | raw.isNull(), raw).otherwise(cell)
        out.append(cell.alias(q.name))
    return out
