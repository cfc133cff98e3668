"""One-to-one matching of points on a line, taken in order, to the nearest free partner."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.operators.ordered import Lane, Scan, islands, scan
from strideframe.sources.stage import durable


class _Pool:
    """Partners behind the current point that nobody has taken, the nearest on top; of one place the first by order."""

    def __init__(self):
        self.places: list[tuple[int, deque]] = []

    def add(self, partner: tuple) -> None:
        if self.places and self.places[-1][0] == partner[0]:
            self.places[-1][1].append(partner)
        else:
            self.places.append((partner[0], deque([partner])))

    def top(self) -> tuple | None:
        return self.places[-1][1][0] if self.places else None

    def take(self) -> tuple:
        taken = self.places[-1][1].popleft()
        if not self.places[-1][1]:
            self.places.pop()
        return taken

    def rest(self) -> Iterator[tuple]:
        for _, waiting in self.places:
            yield from waiting


def _pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Partner pairs of one group of ``(place, is_seeker, order, lower, upper, reach, id)`` in order of place, partners first.

    A seeker waits until the next partner ahead of it is known; those that wait are settled in their order, so each
    sees what the ones before have left.
    """
    pool, waiting = _Pool(), deque()

    def behind(seeker):
        top = pool.top()
        return top is not None and (seeker[3] is None or top[5] is None or top[5] >= seeker[3])

    for row in rows:
        if row[1]:
            waiting.append(row)
            continue
        taken = False
        while waiting and not taken:
            seeker = waiting.popleft()
            ahead = seeker[4] is None or row[0] <= seeker[4]
            if behind(seeker) and not (ahead and row[0] - seeker[0] < seeker[0] - pool.top()[0]):
                yield seeker, pool.take()
            elif ahead:
                yield seeker, row
                taken = True
            else:
                yield seeker, None
        if not taken:
            pool.add(row)
    for seeker in waiting:
        yield seeker, pool.take() if behind(seeker) else None
    for partner in pool.rest():
        yield None, partner


def match_nearest(seekers: DataFrame, partners: DataFrame, lane: Lane) -> DataFrame:
    """Pairs of seekers and partners of the same group: the lane's keys, ``seeker`` and ``partner`` (structs of ``at, tie, id``).

    seekers: keys, at, tie, id, lower, upper; partners: keys, at, tie, id, reach. Seekers take, in order of (at, tie), the
    nearest partner that is still free, of two at the same distance the earlier one, of several at one place the one of
    least tie. A partner behind must reach ``lower`` and one ahead must lie by ``upper``; null is no bound. Neither
    ``reach`` nor ``lower`` may fall as ``at`` grows, and ``lower`` is at or before the seeker's place. Whoever stays
    alone has a row with the other side null. Null places match nothing.

    Each pick depends on the earlier ones, but only as far as free partners are scarce. A seeker claims its nearest
    partner; where the claims so far leave no surplus, counted from either side, no pick crosses, whatever is picked. The
    surplus is a running sum less its running minimum, so the cuts come from running aggregates, and each part between
    two cuts is a sorted stream of its own, that keeps only free partners and waiting seekers. Part after part can lie on
    any task; only where seekers outnumber partners throughout does a part grow to its whole group.
    """
    keys = list(lane.keys)
    placed = lane.ordered("at", "kind", "tie")
    s = durable(seekers.select(*keys, F.col("at").cast("bigint"), F.col("tie").cast("bigint"), F.col("id").cast("string"), F.col("lower").cast("bigint"), F.col("upper").cast("bigint")))
    p = durable(partners.select(*keys, F.col("at").cast("bigint"), F.col("tie").cast("bigint"), F.col("id").cast("string"), F.col("reach").cast("bigint")))
    at_place = p.where("at IS NOT NULL").groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("room"), F.max("reach").alias("reach"))

    mark = "CASE WHEN kind = 0 THEN named_struct('at', at, 'reach', reach) END"
    both = at_place.withColumns({"kind": F.lit(0), "tie": F.lit(None).cast("bigint")}).unionByName(s.where("at IS NOT NULL").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = scan(both, placed, {"__left": Scan("last", mark), "__right": Scan("last", mark, backward=True)}).where("kind = 1")
    left = F.expr("__left IS NOT NULL AND (lower IS NULL OR __left.reach IS NULL OR __left.reach >= lower)")
    right = F.expr("__right IS NOT NULL AND (upper IS NULL OR __right.at <= upper)")
    nearer = F.expr("at - __left.at <= __right.at - at")
    claim = F.when(left & (~right | nearer), F.col("__left.at")).when(right, F.col("__right.at"))
    claimed = durable(both.select(*s.columns, claim.alias("claim")))

    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    renamed = [F.col(k).alias(f"__{k}") for k in keys]
    claims = claimed.where("claim IS NOT NULL").groupBy(*renamed, "claim").agg(F.count(F.lit(1)).alias("n"))
    along = lane.ordered("at")
    places = at_place.join(claims, [*same, F.col("at") == F.col("claim")], "left").select(*keys, "at", (F.coalesce("n", F.lit(0)) - F.col("room")).alias("net"))
    places = scan(places, along, {"__s": Scan("sum", "net"), "__t": Scan("sum", "net", backward=True)})
    places = scan(places, along, {"__m": Scan("min", "__s"), "__n": Scan("min", "__t", backward=True)})
    places = scan(places, along, {"__open": Scan("last", "__s - least(0, __m)", exclusive=True)})
    places = islands(places, along, "coalesce(__open, 0) = 0 AND __t - least(0, __n) = 0", "part").select(*renamed, F.col("at").alias("__at"), "part")

    def parted(df: DataFrame, column: str) -> DataFrame:
        return df.join(places, [*same, F.col(column) == F.col("__at")], "left").drop("__at", *[f"__{k}" for k in keys])

    nobody = F.lit(None)
    rows = parted(claimed, "claim").where("claim IS NOT NULL").select(*keys, "part", "at", F.lit(True).alias("seeks"), "tie", "lower", "upper", nobody.cast("bigint").alias("reach"), "id")
    rows = rows.unionByName(parted(p.where("at IS NOT NULL"), "at").select(*keys, "part", "at", F.lit(False).alias("seeks"), "tie", nobody.cast("bigint").alias("lower"), nobody.cast("bigint").alias("upper"), "reach", "id"))
    order = [*keys, "part", "at", "seeks", "tie", "id"]
    rows = rows.repartition(*keys, "part").sortWithinPartitions(*order)

    side = "struct<at: bigint, tie: bigint, id: string>"
    shape = T.StructType([s.schema[k] for k in keys])
    kinds = [pa.struct([("at", pa.int64()), ("tie", pa.int64()), ("id", pa.string())])] * 2
    width = len(keys)

    def run(batches):
        held = None  # the running group's pairs come out as its rows come in

        def stream():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        source = stream()
        ahead = next(source, None)

        def group(name):
            nonlocal ahead
            while ahead is not None and ahead[: width + 1] == name:
                row = ahead
                ahead = next(source, None)
                # at, seeks, tie, lower, upper, reach, id
                yield row[width + 1 :]

        def table(found):
            columns = [list(x) for x in zip(*[name[:width] for name, _, _ in found], strict=True)]
            face = lambda x: x and {"at": x[0], "tie": x[2], "id": x[6]}
            sides = [pa.array([face(x[k]) for x in found], kinds[k - 1]) for k in (1, 2)]
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, key_kinds, strict=True)], *sides], [*keys, "seeker", "partner"])

        found = []
        while ahead is not None:
            held = ahead[: width + 1]
            for seeker, partner in _pairs(group(held)):
                found.append((held, seeker, partner))
                if len(found) >= 10_000:
                    yield table(found)
                    found = []
        if found:
            yield table(found)

    from pyspark.sql.pandas.types import to_arrow_type

    key_kinds = [to_arrow_type(f.dataType) for f in shape.fields]
    declared = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields], f"seeker {side}", f"partner {side}"])
    matched = rows.mapInArrow(run, declared)
    one = F.struct("at", "tie", "id")
    alone = claimed.where("claim IS NULL").unionByName(s.where("at IS NULL").withColumn("claim", F.lit(None).cast("bigint")))
    alone = alone.select(*keys, one.alias("seeker"), F.lit(None).cast(side).alias("partner"))
    lost = p.where("at IS NULL").select(*keys, F.lit(None).cast(side).alias("seeker"), one.alias("partner"))
    return matched.unionByName(alone).unionByName(lost)
