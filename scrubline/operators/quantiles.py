"""Exact linear quantiles by repeated narrowing.

The built-in ``percentile`` brings every distinct value of a column into one
reducer.  Here a quantile sketch of bounded size names two values around the
wanted rank, one counting pass locates the rank between them, and the next
round looks only at what lies strictly inside.  Each pass is one aggregate
with map-side combine over the needed columns; no row is shuffled.  A round
leaves about 6/accuracy of the rows, however many repeat the same value,
because both bracket ends are counted apart.  When a bracket holds few enough
rows, its content is sorted: every (group, column, bracket) by itself, so that
many columns are sorted by many tasks, and only answers come to the driver.

With ``by`` all passes are shared by the groups of that column, which are few:
their constants stand in the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_table

ACCURACY = 10_000
SMALL_BRACKET = 50_000


@dataclass
class _Rank:
    """Search for the value at sorted position ``rank`` of one column of a group."""
    group: object
    column: str
    rank: int
    inside: int              # rows strictly between low and high
    below: int = 0           # rows at or under low
    low: float | None = None
    high: float | None = None
    answer: float | None = None

    def fraction(self) -> float:
        return (self.rank - self.below) / max(self.inside - 1, 1)

    def narrow(self, a: float, b: float, n_under: int, n_a: int,
               n_mid: int, n_b: int) -> None:
        """Take the part around a <= b that holds the rank."""
        position = self.rank - self.below
        if position < n_under:
            self.high, self.inside = a, n_under
        elif position < n_under + n_a:
            self.answer = a
        elif position < n_under + n_a + n_mid:
            self.low, self.high = a, b
            self.below, self.inside = self.below + n_under + n_a, n_mid
        elif position < n_under + n_a + n_mid + n_b:
            self.answer = b
        else:
            taken = n_under + n_a + n_mid + n_b
            self.low = b
            self.below, self.inside = self.below + taken, self.inside - taken


#: Per group of one column: the bracket, and the two values that cut it.
_Slot = dict


def per_group(by: str | None, values: dict, dtype: str = "double") -> Column:
    """The group's own constant; null for groups without one."""
    known = {g: v for g, v in values.items() if v is not None}
    if by is None:
        return F.lit(known.get(None)).cast(dtype)
    if not known:
        return F.lit(None).cast(dtype)
    pairs = [F.lit(x) for g, v in known.items() for x in (g, v)]
    return F.try_element_at(F.create_map(*pairs), F.col(by)).cast(dtype)


class _Search:
    """The data and all ranks that are still open."""

    def __init__(self, data: DataFrame, by: str | None, small: int):
        self.data, self.by, self.small = data, by, small

    def agg(self, columns: list[Column]) -> dict:
        """One aggregate: ``{group: row}``."""
        if self.by is None:
            return {None: tuple(self.data.agg(*columns).first())}
        return {r[0]: tuple(r)[1:] for r in self.data.groupBy(self.by).agg(*columns).collect()}

    def inside(self, x: Column, slot: _Slot) -> Column:
        """``x`` where it lies in its group's bracket, else null."""
        low = per_group(self.by, {g: r.low for g, r in slot.items()})
        high = per_group(self.by, {g: r.high for g, r in slot.items()})
        cond = x.isNotNull()
        if any(r.low is not None for r in slot.values()):
            cond = cond & F.coalesce(x > low, F.lit(True))
        if any(r.high is not None for r in slot.values()):
            cond = cond & F.coalesce(x < high, F.lit(True))
        if self.by is not None:
            cond = cond & F.coalesce(F.col(self.by).isin(list(slot)), F.lit(False))
        return F.when(cond, x)

    def slots(self, ranks: list[_Rank]) -> list[_Slot]:
        """Ranks as one list of brackets for each column, shared by the groups."""
        found: dict[str, list[_Slot]] = {}
        for r in ranks:
            slots = found.setdefault(r.column, [])
            for slot in slots:
                other = slot.get(r.group)
                if other is None or (other.low, other.high) == (r.low, r.high):
                    slot.setdefault(r.group, r)
                    break
            else:
                slots.append({r.group: r})
        return [s for slots in found.values() for s in slots]

    def narrow(self, x: dict[str, Column], cuts: list[tuple[_Rank, float, float]]) -> None:
        """One counting pass that tells each rank's place relative to a <= b."""
        wanted: list[dict] = []  # group -> (rank, a, b), of one column each
        places: dict[tuple, int] = {}
        taken: list[int] = []
        for r, a, b in cuts:
            key = (r.group, r.column, r.low, r.high, a, b)
            if key not in places:
                free = (i for i, w in enumerate(wanted)
                        if r.group not in w and next(iter(w.values()))[0].column == r.column)
                places[key] = next(free, len(wanted))
                if places[key] == len(wanted):
                    wanted.append({})
                wanted[places[key]][r.group] = (r, a, b)
            taken.append(places[key])
        if not wanted:
            return
        columns = []
        for i, place in enumerate(wanted):
            column = next(iter(place.values()))[0].column
            v = self.inside(x[column], {g: r for g, (r, _, _) in place.items()})
            a = per_group(self.by, {g: c for g, (_, c, _) in place.items()})
            b = per_group(self.by, {g: c for g, (_, _, c) in place.items()})
            columns.append(F.array(F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)),
                                   F.count_if((v == b) & (a != b))).alias(f"n{i}"))
        counted = self.agg(columns)
        for (r, a, b), i in zip(cuts, taken, strict=True):
            r.narrow(a, b, *counted[r.group][i])

    def round(self, x: dict[str, Column], ranks: list[_Rank]) -> None:
        """Answer the ranks in small brackets, sketch inside the others."""
        few = [r for r in ranks if r.inside <= self.small]
        if few:
            self.sort_out(x, few)
        big = self.slots([r for r in ranks if r.inside > self.small])
        if not big:
            return
        around = {}
        for i, slot in enumerate(big):
            around[i] = {}
            for r in ranks:
                if r.answer is None and r.group in slot and r.column == slot[r.group].column and (
                        r.low, r.high) == (slot[r.group].low, slot[r.group].high):
                    around[i].setdefault(r.group, []).append(r)
        # the sketch is asked for the ranks of all groups; each takes its own
        asked = [sorted({f for part in around[i].values() for r in part for f in _around(r.fraction())})
                 for i in range(len(big))]
        row = self.agg([F.percentile_approx(self.inside(x[next(iter(s.values())).column], s), asked[i], ACCURACY)
                        .alias(f"s{i}") for i, s in enumerate(big)])
        cuts = []
        for i, groups in around.items():
            for g, part in groups.items():
                values = dict(zip(asked[i], row[g][i], strict=True))
                cuts += [(r, *[values[f] for f in _around(r.fraction())]) for r in part]
        self.narrow(x, cuts)

    def sort_out(self, x: dict[str, Column], ranks: list[_Rank]) -> None:
        """Each small bracket is sorted by itself; only the asked places come back."""
        slots = self.slots(ranks)
        parts = [F.struct(F.lit(i).alias("slot"), self.inside(x[next(iter(s.values())).column], s).alias("x"))
                 for i, s in enumerate(slots)]
        group = F.col(self.by).cast("string") if self.by else F.lit("")
        cells = self.data.select(group.alias("g"), F.explode(F.filter(F.array(*parts), lambda p: p["x"].isNotNull()))
                                 .alias("p")).select("g", "p.slot", "p.x")
        place = F.row_number().over(Window.partitionBy("g", "slot").orderBy("x")) - 1
        asked, wanted = {}, []
        for r in ranks:
            i = next(k for k, s in enumerate(slots) if r.group in s and s[r.group].column == r.column
                     and (s[r.group].low, s[r.group].high) == (r.low, r.high))
            key = ("" if self.by is None else str(r.group), i, r.rank - r.below)
            asked.setdefault(key, []).append(r)
        wanted = small_table(self.data.sparkSession, list(asked), "g string, slot int, place int")
        found = cells.withColumn("place", place).join(F.broadcast(wanted), ["g", "slot", "place"])
        for row in found.collect():
            for r in asked[row["g"], row["slot"], row["place"]]:
                r.answer = row["x"]


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float] | dict[str, list[float]],
                    small: int = SMALL_BRACKET, by: str | None = None) -> dict:
    """``{name: value per prob}`` with linear interpolation between ranks; with
    ``by``, ``{group: {name: ...}}`` of every group that has rows.

    ``columns`` are numeric expressions; nulls and infinities are ignored.
    ``probs`` may be a list for each of them.
    """
    if not columns:
        return {}
    names = list(columns)
    probs = _of_columns(columns, probs)
    x = {n: F.col(f"q{i}") for i, n in enumerate(names)}
    data = df.select(*([by] if by else []), *[
        F.when(F.abs(columns[n].cast("double")) < float("inf"), columns[n].cast("double"))
        .alias(f"q{i}") for i, n in enumerate(names)
    ])
    search = _Search(data, by, small)
    # The first pass counts and already sketches around the probabilities.
    around = {n: [f for p in probs[n] for f in _around(p)] for n in names}
    opening = search.agg([F.count(x[n]).alias(f"n{i}") for i, n in enumerate(names)]
                         + [F.percentile_approx(x[n], around[n], ACCURACY).alias(f"s{i}") for i, n in enumerate(names)])
    ranks: dict[tuple, _Rank] = {}
    cuts: list[tuple[_Rank, float, float]] = []
    total = {}
    for g, row in opening.items():
        for i, n in enumerate(names):
            total[g, n] = row[i]
            for j, p in enumerate(probs[n]):
                spot = p * (row[i] - 1)
                for r in {math.floor(spot), math.ceil(spot)} if row[i] else ():
                    if (g, n, r) not in ranks:
                        ranks[g, n, r] = _Rank(g, n, r, row[i])
                        if row[i] > small:
                            cuts.append((ranks[g, n, r], *row[len(names) + i][2 * j:2 * j + 2]))
    search.narrow(x, cuts)
    while open_ranks := [r for r in ranks.values() if r.answer is None]:
        search.round(x, open_ranks)

    def at(g, n: str, p: float) -> float | None:
        if not total[g, n]:
            return None
        spot = p * (total[g, n] - 1)
        lower, upper = ranks[g, n, math.floor(spot)].answer, ranks[g, n, math.ceil(spot)].answer
        return lower + (upper - lower) * (spot - math.floor(spot))

    found = {g: {n: [at(g, n, p) for p in probs[n]] for n in names} for g in opening}
    return found if by else found[None]


def _around(fraction: float) -> list[float]:
    margin = 2.0 / ACCURACY
    return [max(0.0, fraction - margin), min(1.0, fraction + margin)]


def _of_columns(columns: dict, probs: list[float] | dict[str, list[float]]) -> dict[str, list[float]]:
    return probs if isinstance(probs, dict) else dict.fromkeys(columns, probs)


def quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float] | dict[str, list[float]],
              approximate: bool = False, by: str | None = None) -> dict:
    """Exact quantiles, or one sketch pass when ``approximate``; grouped with ``by``."""
    if not approximate:
        return exact_quantiles(df, columns, probs, by=by)
    probs = _of_columns(columns, probs)
    wanted = [F.percentile_approx(F.when(F.abs(c) < float("inf"), c), probs[n], ACCURACY).alias(f"q{i}")
              for i, (n, c) in enumerate(columns.items())]
    found = _Search(df, by, 0).agg(wanted)
    named = {g: {n: list(v) if v else [None] * len(probs[n]) for n, v in zip(columns, row)}
             for g, row in found.items()}
    return named if by else named[None]
