"""Pairs of close 64-bit hashes by multi-index hashing that adapts to how many there are.

The bits are dealt into parts. With a threshold of t = m * r + a bits (a < m) over m parts, two hashes
that close differ by r bits at most in one of the first a + 1 parts, or by r - 1 in
one of the others. In such a part both are sent to all values within a radius of
their own, the radii adding up to the part's, and meet in an equi join. The number
of parts follows the counts: few hashes take many narrow parts with few values, many take wide parts
with more values, so that neither values nor chance meetings a hash get many (see ``plan``).

What meets is counted once: in the first part where the pair is close enough, and
there in the one value to which the left hash flips its lowest differing bits.
A bucket that many hashes share (hashes of real photos are far from random) is dealt again
by the bits that its part doesn't hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.membership import may_hold

FULL = 64

#: Meetings that cost as much as a value sent.
MEETINGS = 2

#: Values of a hash in one part, at most.
MOST_VALUES = 2048

#: Hashes of a bucket from which it is dealt again by other bits.
HOT = 2048

#: Times that buckets are dealt, at most.
LEVELS = 3

#: Values sent that a task joins, on average.
ROWS = 400_000


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    radius: int
    left: int  # the radius within which left hashes are sent; right ones are within the rest

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))


def _signed(x: int) -> int:
    return x - (1 << FULL) if x >> (FULL - 1) else x


def ball(width: int, radius: int) -> int:
    """Values within a radius of one of so many bits."""
    return sum(comb(width, i) for i in range(radius + 1))


def plan(left: int, right: int, threshold: int, bits: tuple[int, ...] = tuple(range(FULL))) -> list[Part]:
    """The parts that cost least for so many hashes on either side: values sent, and chance meetings among random hashes."""
    best: tuple[float, list[Part]] = (float("inf"), [])
    for m in range(1, min(threshold + 1, len(bits)) + 1):
        r, a = divmod(threshold, m)
        cost, parts = 0.0, []
        for j in range(m):
            own, radius = bits[j::m], r if j <= a else r - 1
            if radius < 0:
                continue
            width, radius = len(own), min(radius, len(own))
            sent, split = min((left * ball(width, s) + right * ball(width, radius - s), s) for s in range(radius + 1))
            split = radius - radius // 2 if left == right else split
            if max(ball(width, split), ball(width, radius - split)) > MOST_VALUES:
                cost = float("inf")
            cost += sent + left * right * ball(width, radius) / 2**width / MEETINGS
            parts.append(Part(own, radius, split))
        best = min(best, (cost, parts), key=lambda c: c[0])
    return best[1] or [Part(tuple(bits), 0, 0)]


#: Part numbers of each level so far, and the parts that its rows are dealt into next.
Paths = dict[tuple[int, ...], list[Part]]


def _case(paths: Paths, of) -> str:
    """What of(parts) says for the rows of each path (columns p0, p1 ... of a prefix)."""
    if list(paths) == [()]:
        return of(paths[()], "")
    whens = (f"WHEN {' AND '.join(f'{{0}}p{n} = {j}' for n, j in enumerate(path))} THEN {of(parts, '{0}')}" for path, parts in paths.items())
    return f"CASE {' '.join(whens)} END"


def _sent(hashes: DataFrame, paths: Paths, level: int, left: bool) -> DataFrame:
    """hashes with part and value (p and k of the level) of all values within the side's radius."""

    def values(parts: list[Part], _: str) -> str:
        arrays = []
        for j, part in enumerate(parts):
            flips = [sum(1 << b for b in chosen) for n in range((part.left if left else part.radius - part.left) + 1) for chosen in combinations(part.bits, n)]
            listed = ", ".join(f"{_signed(x)}L" for x in flips)
            arrays.append(f"transform(array({listed}), x -> named_struct('p{level}', {j}, 'k{level}', (hash & {part.mask}L) ^ x))")
        return f"concat({', '.join(arrays)})"

    return hashes.select("*", F.expr(f"inline({_case(paths, values)})".replace("{0}", "")))


def _met_here(paths: Paths, level: int) -> str:
    """Of rows a and b that met: whether this is their first part, and the value that the left one reaches by its lowest differing bits."""

    def rule(parts: list[Part], _: str) -> str:
        rules = []
        for j, part in enumerate(parts):
            x = f"((a.hash ^ b.hash) & {part.mask}L)"
            rest = x
            for _ in range(part.left):
                rest = f"({rest} & coalesce(try_subtract({rest}, 1L), {(1 << (FULL - 1)) - 1}L))"  # the lowest bit goes
            earlier = [f"bit_count((a.hash ^ b.hash) & {p.mask}L) > {p.radius}" for p in parts[:j]]
            rules.append(f"WHEN {j} THEN {' AND '.join([*earlier, f'((a.hash & {part.mask}L) ^ a.k{level}) = ({x} ^ {rest})'])}")
        return f"CASE a.p{level} {' '.join(rules)} END"

    return _case(paths, rule).replace("{0}", "a.")


def _tasks(rows: int) -> int:
    return -(-rows // ROWS) or 1


def _values(parts: list[Part]) -> tuple[int, int]:
    """Values that a left and a right hash are sent to."""
    return sum(ball(len(p.bits), p.left) for p in parts), sum(ball(len(p.bits), p.radius - p.left) for p in parts)


def _spread(hashes: DataFrame, values: int) -> DataFrame:
    """hashes over as many tasks as their values fill: a small file, read by one task, may hold hashes for millions of them."""
    return hashes.repartition(_tasks(values), "hash") if values > ROWS else hashes


def _joined(left: DataFrame, right: DataFrame, levels: int, rules: list[str], tasks: int) -> DataFrame:
    """Both sides are dealt over so many tasks and merged. Spark would judge a side by the size of the hashes before they are sent to their values, and gather it in the driver."""
    names = [f"{c}{n}" for n in range(levels) for c in "pk"]
    keys = [f"a.{c} = b.{c}" for c in names]
    return left.repartition(tasks, *names).alias("a").join(right.repartition(tasks, *names).alias("b").hint("merge"), F.expr(" AND ".join([*keys, *rules])))


def _met(left: DataFrame, right: DataFrame, sizes: tuple[int, int], threshold: int, rules: list[str], hot: int, sieve: bool = False) -> list[DataFrame]:
    """The meetings that count, of rows a and b, by level: buckets that aren't crowded meet at once, the others are dealt again, LEVELS times at most."""
    everything = tuple(range(FULL))
    paths: Paths = {(): plan(*sizes, threshold, everything)}
    rest = {(): everything}
    out = []
    rows = [n * v for n, v in zip(sizes, _values(paths[()]))]
    left, right = (_spread(x, n) for x, n in zip((left, right), rows))
    for level in range(LEVELS):
        a, b = _sent(left, paths, level, True), _sent(right, paths, level, False)
        names = [f"{c}{n}" for n in range(level + 1) for c in "pk"]
        if sieve and not level:
            b = b.where(may_hold(a.select(*names), [F.col(n) for n in names], rows[0]))
        rules = [*rules, _met_here(paths, level)]
        rest = {(*path, j): tuple(x for x in rest[path] if x not in part.bits) for path, parts in paths.items() for j, part in enumerate(parts)}
        crowds = {}
        if sizes[1] > hot and level < LEVELS - 1:
            crowded = b.groupBy(*names).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > hot)
            largest = crowded.groupBy(*names[::2]).agg(F.max("n_").alias("n_"), F.sum("n_").alias("rows_")).collect()
            # in buckets with no more bits left than the threshold, everything is close
            crowds = {path: (r["n_"], r["rows_"]) for r in largest if len(rest[path := tuple(r[: level + 1])]) > threshold}
        if not crowds:
            return [*out, _joined(a, b, level + 1, rules, _tasks(sum(rows)))]
        chosen = F.expr(" OR ".join("(" + " AND ".join(f"p{n} = {j}" for n, j in enumerate(path)) + ")" for path in crowds))
        marks = crowded.where(chosen).select(*names)
        out.append(_joined(a.join(marks, names, "left_anti"), b.join(marks, names, "left_anti"), level + 1, rules, _tasks(sum(rows))))
        left, right = a.join(marks, names, "left_semi"), b.join(marks, names, "left_semi")
        share = rows[0] / max(1, rows[1])  # left rows of a bucket for each right one
        paths = {path: plan(n, n, threshold, rest[path]) for path, (n, _) in crowds.items()}
        rows = [sum(int(crowds[path][1] * of * _values(parts)[side]) for path, parts in paths.items()) for side, of in enumerate((share, 1))]
    return out


def _pairs(met: list[DataFrame], threshold: int) -> DataFrame:
    d = F.bit_count(F.col("a.hash").bitwiseXOR(F.col("b.hash")))
    found = [x.where(d <= threshold).select(F.col("a.hash").alias("a"), F.col("b.hash").alias("b"), d.alias("distance")) for x in met]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near(hashes: DataFrame, threshold: int, hot: int = HOT) -> DataFrame:
    """a, b and distance of all different hashes (column hash, distinct) at most threshold bits apart, exactly; a < b."""
    n = hashes.count()
    return _pairs(_met(hashes, hashes, (n, n), threshold, ["a.hash < b.hash"], hot), threshold)


def near_between(few: DataFrame, many: DataFrame, threshold: int, hot: int = HOT) -> DataFrame:
    """a of few and b of many (each distinct), and distance, at most threshold bits apart, equal ones too. Hashes of many that can't meet any of few are told in the scan, so they aren't shuffled."""
    sizes = few.count(), many.count()
    return _pairs(_met(few, many, sizes, threshold, [], hot, sieve=True), threshold)


def meetings(hashes: DataFrame, threshold: int) -> int:
    """Rows that meet in the join of ``near`` before its rules, where no bucket is crowded."""
    n = hashes.count()
    paths: Paths = {(): plan(n, n, threshold)}
    return _joined(_sent(hashes, paths, 0, True), _sent(hashes, paths, 0, False), 1, ["a.hash < b.hash"], _tasks(n * sum(_values(paths[()])))).count()
