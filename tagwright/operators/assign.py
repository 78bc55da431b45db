"""From a cleaned I/O list to cabinets, boards and channels.

Everything but the packing is relational. Hot spares are dealt round robin by arithmetic; demand is one aggregation; the packing of
junction boxes into cabinets is sequential by nature and runs in a grouped map per run, on one row of fourteen numbers per box.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.tables import placed, stored

BASES = ("AI", "AO", "DI", "DO")
KINDS = ("Barrier", "Terminal", "Relay")
COUNTERS = [f"{k}_{b}" for k in KINDS for b in BASES]
KIND_OF = [k for k in KINDS for _ in BASES]
# Channels to a board, the default plan, and limits of cabinets by (type, direction): rail terminals, then the share of
# the cabinet that a board of each kind takes, in the order of COUNTERS.
CHANNELS = {"Barrier": 16, "Terminal": 16, "Relay": 32}
PLAN = [("Type 1", "REAR", 2, 1), ("Type 1", "FRONT", 2, 2), ("Type 2", "REAR", 2, 3), ("Type 2", "FRONT", 2, 4), ("Type 3", "REAR", 2, 5), ("Type 3", "FRONT", 2, 6)]
LIMITS = {
    ("Type 1", "REAR"): (800, (20, 20, 12.5, 12.5, 20, 20, 12.5, 12.5, 25, 25, 33.3, 33.3)),
    ("Type 1", "FRONT"): (800, (14.2, 14.2, 10, 10, 14.2, 14.2, 7.1, 8.3, 14.2, 14.2, 16.6, 16.6)),
    ("Type 2", "FRONT"): (800, (14.2, 14.2, 10, 10, 14.2, 14.2, 7.1, 8.3, 14.2, 14.2, 16.6, 16.6)),
    ("Type 2", "REAR"): (800, (14.2, 14.2, 20, 20, 14.2, 14.2, 7.1, 8.3, 14.2, 14.2, 16.6, 16.6)),
    ("Type 3", "REAR"): (800, (16.6, 16.6, 10, 10, 20, 20, 10, 10, 20, 20, 25, 25)),
    ("Type 3", "FRONT"): (800, (14.2, 14.2, 20, 20, 14.2, 14.2, 7.1, 8.3, 14.2, 14.2, 16.6, 16.6)),
}


@dataclass
class Config:
    spare_ratio: float = 0.20
    label_overhead: int = 2
    prefixes: dict = field(default_factory=lambda: {"IS": "IS-A-", "NIS": "NIS-B-"})
    directions: bool = True
    channels: dict = field(default_factory=lambda: dict(CHANNELS))
    plan: list = field(default_factory=lambda: list(PLAN))
    limits: dict = field(default_factory=lambda: dict(LIMITS))
    max_boards: float = 100  # 100: limits are shares of a cabinet; else they are numbers of boards

    def with_overrides(self, overrides: dict | None) -> Config:
        """Known keys replace the defaults; limits may be keyed 'type|direction'."""
        for k, v in (overrides or {}).items():
            if k == "limits":
                v = {tuple(p.strip() for p in key.split("|", 1)) if isinstance(key, str) else tuple(key): of for key, of in v.items()}
            if hasattr(self, k):
                setattr(self, k, {**getattr(self, k), **v} if k == "channels" else v)
        return self


def base_io(c: Column) -> Column:
    return F.when(F.length(c) == 3, F.left(c, F.lit(2))).otherwise(c)


def demands(signals: DataFrame, config: Config | None = None) -> DataFrame:
    """One row per box: safety of its first signal in master order, rail_load, and the twelve channel counters. A box has few signals, so they
    are dealt by box once, and neither step after that deals them again."""
    config = config or Config()
    order = F.struct("rank_io", "rank_safety", "rank_location", "seq")
    per = signals.repartition("jb").groupBy("jb", "io").agg(F.count("*").alias("n"), F.count_if(F.col("src") == "SC").alias("sc"), F.min_by("location", order).alias("place"), F.min(F.struct(*order_columns(order), "safety")).alias("first"))
    base = base_io(F.col("io"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    box = per.groupBy("jb").agg(
        F.min("first")["safety"].alias("safety"),
        (2 * F.sum("n") + F.sum("sc") + config.label_overhead).alias("rail_load"),
        *(n(base == b).alias(f"all_{b}") for b in BASES),
        *(n((base == b) & (F.col("place") == "MCC")).alias(f"Relay_{b}") for b in BASES),
    )
    kind = lambda b, safe: F.when((F.col("safety") == "IS") == safe, F.col(f"all_{b}")).otherwise(0)
    return box.select("jb", "safety", "rail_load", *(kind(b, True).alias(f"Barrier_{b}") for b in BASES), *(kind(b, False).alias(f"Terminal_{b}") for b in BASES), *(f"Relay_{b}" for b in BASES))


def order_columns(order: Column) -> list[str]:
    return ["rank_io", "rank_safety", "rank_location", "seq"]


def terminal_state(signals: DataFrame) -> DataFrame:
    """Per box the highest terminal number of both columns and the first format of each."""
    order = F.struct("rank_io", "rank_safety", "rank_location", "seq")
    t = signals.select("jb", order.alias("o"), X.terminal_parts(F.col("terminal_1")).alias("a"), X.terminal_parts(F.col("terminal_2")).alias("b"))
    none = F.struct(F.lit("T").alias("prefix"), F.lit(1).alias("width"))
    form = lambda c: F.coalesce(F.min_by(F.when(F.col(c).isNotNull(), F.struct(f"{c}.prefix", f"{c}.width")), F.when(F.col(c).isNotNull(), F.col("o"))), none)
    return t.groupBy("jb").agg(F.coalesce(F.greatest(F.max("a.number"), F.max("b.number")), F.lit(0)).alias("last"), form("a").alias("form1"), form("b").alias("form2"))


def spares_wanted(signals: DataFrame, config: Config | None = None) -> DataFrame:
    """(io, safety, needed): the spares that each group of signals asks for."""
    ratio = (config or Config()).spare_ratio
    return signals.groupBy("io", "safety").agg(F.ceil(F.count("*") * F.lit(ratio)).alias("needed"))


#: What a hot spare has from the first signal of its kind in its box.
FIRST = ("location", "src", "rank_io", "rank_safety", "rank_location")


def spare_slots(signals: DataFrame, config: Config | None = None, first: bool = False) -> DataFrame:
    """(io, safety, jb, spares, k): needed spares dealt round robin over the group's boxes in the order of their first signals; with first
    also r, what their spares have from these. One aggregation of the signals gives all of it."""
    ratio = (config or Config()).spare_ratio
    own = F.min(F.struct("rank_location", "seq", *(c for c in FIRST if c != "rank_location")) if first else F.struct("rank_location"))
    boxes = signals.groupBy("io", "safety", "jb").agg(own.alias("r"), F.count("*").alias("n")).withColumn("at", F.col("r.rank_location"))
    place = placed(boxes, ["io", "safety"], ["at", "jb"], "k")
    n = place.groupBy("io", "safety").agg(F.count("*").alias("boxes"), F.ceil(F.sum("n") * F.lit(ratio)).alias("needed"))
    dealt = place.join(F.broadcast(n), ["io", "safety"])  # a row for each pair of normal spellings: sixteen at most
    spares = (F.floor(F.col("needed") / F.col("boxes")) + F.when(F.col("k") <= F.col("needed") % F.col("boxes"), 1).otherwise(0)).cast("bigint")
    return dealt.select("io", "safety", "jb", spares.alias("spares"), "k", *([F.struct(*(f"r.{c}" for c in FIRST)).alias("r")] if first else [])).filter("spares > 0")


def capped_slots(signals: DataFrame, run: Column, config: Config | None = None) -> DataFrame:
    """(run, io, safety, jb, spares): as spare_slots, but no box takes more spares than its largest spare_count, which all groups of a run,
    in order, use up together. One task per run, over one row for each group and box."""
    ratio = (config or Config()).spare_ratio
    order = F.min(F.struct("rank_location", "jb"))
    per = signals.withColumn("run", run.cast("bigint")).groupBy("run", "io", "safety", "jb").agg(F.count("*").alias("n"), order["rank_location"].alias("place"), F.max(F.greatest(F.coalesce("spare_count", F.lit(0)), F.lit(0))).alias("cap"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made: list[tuple] = []
        for key, own in groupby(rows, key=itemgetter(0)):
            groups: dict[tuple[str, str], list[tuple[str, int]]] = {}
            room: dict[str, int] = {}
            for _, io, safety, _, jb, n, cap in own:
                groups.setdefault((io, safety), []).append((jb, n))
                room[jb] = max(room.get(jb, 0), int(cap))
            wanted = [(name, [jb for jb, _ in boxes], math.ceil(sum(n for _, n in boxes) * ratio)) for name, boxes in groups.items()]
            made += [(key, *name, jb, n) for name, jb, n in hot_spares_capped(room, wanted)]
            if len(made) > BATCH:
                yield _slots_batch(made)
                made = []
        if made:
            yield _slots_batch(made)

    ordered = per.select("run", "io", "safety", "place", "jb", "n", "cap").repartition("run").sortWithinPartitions("run", "io", "safety", "place", "jb")
    return ordered.mapInArrow(dealt, "run bigint, io string, safety string, jb string, spares bigint")


def _slots_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["run", "io", "safety", "jb", "spares"])


#: Packed rows to a batch, at least.
BATCH = 10_000
#: Spare rows come after all signals of their box in the master order.
AFTER_SIGNALS = 1 << 61


def with_hot_spares(signals: DataFrame, config: Config | None = None, slots: DataFrame | None = None, terminals: bool = True) -> DataFrame:
    """The signals and their hot spares, with signal_type ACTIVE and HOT_SPARE; spares have a seq beyond all signals, by round. Without
    terminals both lack these columns."""
    own = ["seq", "tag", "jb", "io", "safety", "location", *(["terminal_1", "terminal_2"] if terminals else []), "src", "rank_io", "rank_safety", "rank_location"]
    spares = hot_spares(signals, config, slots, terminals).withColumn("seq", F.lit(AFTER_SIGNALS) + F.col("round"))
    return signals.select(*own, F.lit("ACTIVE").alias("signal_type")).unionByName(spares.select(*own, "signal_type"))


def hot_spares(signals: DataFrame, config: Config | None = None, slots: DataFrame | None = None, terminals: bool = True) -> DataFrame:
    """The spare rows: one per slot, with terminals that go on after the box's highest, two by two, groups in order. slots: those of
    spare_slots, or of capped_slots. Where nobody asks for the terminals, the boxes' numbers need not be looked for."""
    if slots is None:
        slots = spare_slots(signals, config, first=True)
    else:
        first = signals.groupBy("io", "safety", "jb").agg(F.min_by(F.struct(*FIRST), F.struct("rank_location", "seq")).alias("r"))
        slots = slots.join(first, ["io", "safety", "jb"])
    each = slots.withColumn("round", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("spares"))))
    made = ["io", "safety", "jb", "round", "r.*", F.lit("HOT_SPARE").alias("tag"), F.lit("HOT_SPARE").alias("signal_type")]
    if not terminals:
        return each.select(*made)
    nth = F.row_number().over(Window.partitionBy("jb").orderBy("io", "safety", "round"))
    out = each.withColumn("nth", nth).join(terminal_state(signals), "jb")
    at = F.col("last") + 2 * F.col("nth") - 1
    return out.select(*made, X.terminal(F.col("form1.prefix"), at, F.col("form1.width")).alias("terminal_1"), X.terminal(F.col("form2.prefix"), at + 1, F.col("form2.width")).alias("terminal_2"))


def hot_spares_capped(capacity: dict[str, int], groups: list[tuple[str, list[str], int]]) -> list[tuple[str, str, int]]:
    """(group, box, spares) when each box has a capacity that all groups, in order, use up together. Sequential: the data are one number per
    box and group. A box leaves the round when its capacity is spent; a group ends when it has its number or no box has any left."""
    left, out = dict(capacity), []
    for name, boxes, needed in groups:
        got = dict.fromkeys(boxes, 0)
        while needed > 0 and (live := [b for b in boxes if left.get(b, 0) > got[b]]):
            whole = min(needed // len(live), min(left[b] - got[b] for b in live))
            for b in live:
                got[b] += whole
            needed -= whole * len(live)
            if not whole:
                for b in live[:needed]:
                    got[b] += 1
                needed -= min(needed, len(live))
        for b, n in got.items():
            left[b] = left.get(b, 0) - n
            if n:
                out.append((name, b, n))
    return out


def limits_of(config: Config, kind: str, direction: str) -> tuple[float, tuple] | None:
    """Rail limit and limits of a cabinet; a single-sided one without its own takes its type's front, else rear."""
    sides = [direction, *(["FRONT", "REAR"] if direction == "SINGLE" else [])]
    return next((config.limits[kind, s] for s in sides if (kind, s) in config.limits), None)


def pool(config: Config) -> list[tuple[str, str, float, tuple]]:
    """Planned cabinets in order of priority: (type, direction, rail limit, limits)."""
    out = []
    for kind, direction, quantity, _ in sorted(config.plan, key=lambda p: p[3]):
        known = limits_of(config, kind, direction)
        if known is None:
            raise ValueError(f"no limits for {kind} {direction}")
        out += [(kind, direction, *known)] * int(quantity)
    return out


#: Counters that a cabinet's limits look at: of its own safety (NIS, IS), and relays.
COUNTED = ((*range(4, 8), *range(8, 12)), (*range(4), *range(8, 12)))


class _Cabinet:
    def __init__(self, name: str, safety: str, kind: str, direction: str, rail: float, limits: tuple, config: Config):
        self.name, self.safety, self.kind, self.direction, self.rail, self.limits, self.config = name, safety, kind, direction, rail, limits, config
        self.load, self.channels, self.room = 0, [0] * len(COUNTERS), [config.channels[k] for k in KIND_OF]

    def boards(self, channels: list[int]) -> list[int]:
        return [-(-n // int(c)) if c > 0 else int(n > 0) for n, c in zip(channels, self.room, strict=True)]

    def fits(self, safety: str, load: int, channels: list[int]) -> bool:
        if safety != self.safety or (self.rail > 0 and self.load + load > self.rail):
            return False
        boards = self.boards([a + b for a, b in zip(self.channels, channels, strict=True)])
        counted = COUNTED[safety == "IS"]
        if self.config.max_boards == 100:
            return sum(boards[k] * self.limits[k] for k in counted) <= 100 + 1e-9
        return all(boards[k] <= int(self.limits[k]) for k in counted) and sum(boards[k] for k in counted) <= self.config.max_boards

    def add(self, load: int, channels: list[int]) -> None:
        self.load += load
        self.channels = [a + b for a, b in zip(self.channels, channels, strict=True)]


def pack(boxes: list[tuple[str, str, int, list[int]]], config: Config | None = None, planned: list[tuple] | None = None) -> list[tuple[str, str, int, str, str]]:
    """First fit by falling load, over open cabinets, then the pool. boxes: (jb, safety, rail load, counters).
    Returns (jb, cabinet, place in the order of assignment, cabinet type, direction). planned: pool(config), where many runs share it."""
    config = config or Config()
    counted = Config(channels=config.channels, max_boards=999)  # cabinets beyond the plan are limited by numbers of boards
    left, opened, numbers, out = pool(config) if planned is None else list(planned), [], {"IS": 0, "NIS": 0}, []
    ranked = sorted(sorted(boxes, key=lambda b: b[0]), key=lambda b: -(b[2] + sum(b[3][:8])))
    for place, (jb, safety, load, channels) in enumerate(ranked):
        cabinet = next((c for c in opened if c.fits(safety, load, channels)), None)
        if cabinet is None:
            numbers[safety] += 1
            base = f"{config.prefixes[safety]}{numbers[safety]:02d}"
            trial = lambda p: _Cabinet(base + ({"REAR": "R", "FRONT": "F"}.get(p[1], "") if config.directions else ""), safety, *p, config)  # noqa: E731, B023
            at = next((k for k, p in enumerate(left) if trial(p).fits(safety, load, channels)), None)
            if at is not None:
                cabinet = trial(left.pop(at))
            elif left:  # nothing planned holds it: an overflow cabinet, whose first box is not checked
                cabinet = _Cabinet(f"{base}-OVERFLOW", safety, "OVERFLOW", "", 9999, (999.0,) * 12, counted)
            else:
                cabinet = _Cabinet(base, safety, "DEFAULT", "", 1000, (999.0,) * 12, counted)
                if not cabinet.fits(safety, load, channels):
                    raise ValueError(f"{jb} fits no cabinet")
            opened.append(cabinet)
        cabinet.add(load, channels)
        out.append((jb, cabinet.name, place, cabinet.kind, cabinet.direction))
    return out


def cabinets(demand: DataFrame, run: Column, config: Config | None = None) -> DataFrame:
    """(run, jb, cabinet, place, cabinet_type, direction): packing. A run is packed by one task, from its boxes sorted side by side; many small
    runs share a task and its batches."""
    config = config or Config()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made: list[tuple] = []
        planned = None
        for key, boxes in groupby(rows, key=itemgetter(0)):
            planned = pool(config) if planned is None else planned
            made += [(key, *box) for box in pack([(jb, safety, int(load), [int(n) for n in counts]) for _, jb, safety, load, *counts in boxes], config, planned)]
            if len(made) > BATCH:
                yield _packed_batch(made)
                made = []
        if made:
            yield _packed_batch(made)

    named = demand.select(run.cast("bigint").alias("run"), "jb", "safety", "rail_load", *COUNTERS)
    return named.repartition("run").sortWithinPartitions("run").mapInArrow(packed, "run bigint, jb string, cabinet string, place bigint, cabinet_type string, direction string")


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["run", "jb", "cabinet", "place", "cabinet_type", "direction"])


def even_split(i: Column, n: Column, capacity: Column) -> tuple[Column, Column]:
    """(board from 0, channel from 1) of the i-th (from 0) of n signals, spread evenly over the fewest boards, the first ones one fuller."""
    boards = F.greatest(F.ceil(n / capacity), F.lit(1))
    size, rest = F.floor(n / boards), n % boards
    big = rest * (size + 1)
    board = F.when(i < big, F.floor(i / (size + 1))).otherwise(rest + F.floor((i - big) / F.greatest(size, F.lit(1))))
    start = F.when(board < rest, board * (size + 1)).otherwise(big + (board - rest) * size)
    return board.cast("bigint"), (i - start + 1).cast("bigint")


def channel_limit(config: Config, board_type: Column, base: Column) -> Column:
    """Channels to a board: by the board's full name if the configuration has it, else by its kind."""
    out = F.lit(16)
    for kind in ("Barrier", "Terminal"):
        for b in BASES:
            n = config.channels.get(f"{kind} Board ({b})", config.channels.get(kind, 16))
            out = F.when((board_type == f"{kind} Board") & (base == b), n).otherwise(out)
    return out.cast("bigint")


def allocate(signals: DataFrame, packed: DataFrame, config: Config | None = None) -> DataFrame:
    """Channels of every signal: cabinet, board, channel, capacity and relay flag. signals: as cleaned; packed: jb, cabinet. Signals of a
    cabinet and kind go on in master order: by ranks, box, and their own order."""
    s = signals.join(packed.select("jb", "cabinet"), "jb")
    s = s.withColumn("base", base_io(F.col("io"))).withColumn("board_type", F.concat(F.when(F.col("cabinet").startswith("IS"), "Barrier").otherwise("Terminal"), F.lit(" Board")))
    order = Window.partitionBy("cabinet", "base").orderBy("rank_io", "rank_safety", "rank_location", "jb", "seq")
    group = Window.partitionBy("cabinet", "base")
    s = s.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(group), "relay": F.first("location").over(order) == "MCC", "capacity": channel_limit(config or Config(), F.col("board_type"), F.col("base"))})
    board, channel = even_split(F.col("i"), F.col("n"), F.col("capacity"))
    s = s.withColumns({"board_no": board + 1, "channel": channel})
    return s.withColumn("board", F.concat("board_type", F.lit(" ("), "base", F.lit(")-"), F.lpad(F.col("board_no").cast("string"), 2, "0")))


def backfill(allocated: DataFrame) -> DataFrame:
    """SPARE channels up to a board's capacity, each like the board's last row, without terminals."""
    last = allocated.groupBy("cabinet", "board").agg(F.max("channel").alias("used"), F.max("capacity").alias("capacity"), F.max_by(F.struct("io", "safety", "location", "jb"), "channel").alias("r"))
    free = last.filter(F.col("used") < F.col("capacity"))
    return free.select("cabinet", "board", F.explode(F.sequence(F.col("used") + 1, "capacity")).alias("channel"), "r.*", F.lit("SPARE").alias("tag"), F.lit("SPARE").alias("signal_type"))


def cabinet_stats(allocated: DataFrame) -> DataFrame:
    """Boards, signals, active ones and hot spares, backfilled channels and fill share of each cabinet and board type."""
    hot = F.count_if(F.col("signal_type") == "HOT_SPARE")
    per = allocated.groupBy("cabinet", "board_type", "base").agg(F.countDistinct("board").alias("boards"), F.count("*").alias("signals"), hot.alias("hot"), F.max("capacity").alias("capacity"))
    room = F.col("boards") * F.col("capacity")
    return per.select("cabinet", "board_type", "base", "boards", "signals", (F.col("signals") - F.col("hot")).alias("active"), "hot", (room - F.col("signals")).alias("spare"), F.bround(100 * F.col("signals") / room, 2).alias("fill"))


def usage(demand: DataFrame, packed: DataFrame, config: Config | None = None) -> DataFrame:
    """One row per cabinet: type, direction, boxes, rail terminals used and allowed, boards of each kind, share of the rail and of the pool
    of boards in use, and the factor that limits it: the pool if its share is the larger. demand and packed: jb, and packed of one run."""
    config = config or Config()
    known = {(k, d): limits_of(config, k, d) for k in dict.fromkeys(k for k, _ in config.limits) for d in ("REAR", "FRONT", "SINGLE")}
    known = {side: of for side, of in known.items() if of}
    rail = {side: limit for side, (limit, _) in known.items()} | {("OVERFLOW", ""): 9999, ("DEFAULT", ""): 1000}
    sums = packed.join(demand, "jb").groupBy("cabinet", "cabinet_type", "direction").agg(F.count("*").alias("boxes"), F.min("safety").alias("safety"), F.sum("rail_load").alias("rail_used"), *(F.sum(c).alias(c) for c in COUNTERS))
    kind = F.concat_ws("|", "cabinet_type", "direction")
    lookup = F.create_map(*(F.lit(x) for (k, d), v in rail.items() for x in (f"{k}|{d}", int(v))))
    boards = lambda c: F.when(F.col(c) > 0, F.ceil(F.col(c) / config.channels[c.split("_")[0]])).otherwise(0)
    out = sums.withColumn("rail_limit", F.element_at(lookup, kind)).withColumns({f"boards_{c}": boards(c) for c in COUNTERS})
    own = [c for c in COUNTERS if not c.startswith("Relay")]
    counts = F.col("cabinet_type").isin("OVERFLOW", "DEFAULT") | F.lit(config.max_boards != 100)
    shares = F.lit(0.0)
    for (k, d), (_, limits) in known.items():
        one = sum((F.col(f"boards_{c}") * float(limits[COUNTERS.index(c)]) for c in COUNTERS), F.lit(0.0))
        shares = F.when((F.col("cabinet_type") == k) & (F.col("direction") == d), one).otherwise(shares)
    number = sum((F.col(f"boards_{c}") for c in COUNTERS), F.lit(0))
    most = F.when(F.col("cabinet_type").isin("OVERFLOW", "DEFAULT"), 999.0).otherwise(float(config.max_boards))
    out = out.withColumns({"rail_share": F.when(F.col("rail_limit") > 0, F.col("rail_used") / F.col("rail_limit")).otherwise(0.0), "pool_share": F.when(counts, number / most).otherwise(shares / 100)})
    label = F.when(F.col("pool_share") > F.col("rail_share"), F.concat(F.when(counts, "COUNT").otherwise("PERCENT_PER_BOARD"), F.format_string(" Pool (%.1f%%)", 100 * F.col("pool_share")))).otherwise(F.format_string("Rail (%.1f%%)", 100 * F.col("rail_share")))
    return out.select("cabinet", "cabinet_type", "direction", "boxes", "rail_used", "rail_limit", *(f"boards_{c}" for c in [*own, *(c for c in COUNTERS if c not in own)]), "rail_share", "pool_share", label.alias("limiting_factor"))


def run_all(io_clean: DataFrame, run: str, config: Config | None = None) -> Iterator[tuple[str, DataFrame]]:
    """The whole run by name: signals with hot spares, demand, packing, channels, spare channels, and the cabinets' use. run: the column
    that says which run a row belongs to; the boxes of a run are packed in one task. Steps that later ones read several times are written."""
    io_clean = stored(io_clean)
    signals = stored(with_hot_spares(io_clean, config))
    demand = stored(demands(signals, config).join(io_clean.select("jb", run).repartition("jb").distinct(), "jb"))
    packed = stored(cabinets(demand, F.col(run), config).withColumn("cabinet", F.concat("cabinet", F.lit("#"), F.col("run").cast("string"))))
    allocated = stored(allocate(signals, packed, config))
    yield from (("signals", signals), ("demand", demand), ("packed", packed), ("allocated", allocated), ("spare", backfill(allocated)), ("usage", usage(demand.drop(run), packed, config)))
