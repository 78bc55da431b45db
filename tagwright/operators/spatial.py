"""Operators on where spans stand on a page: cables next to motor cables, cables in parts, words inside spans, fragments of a row.

spans: pdf, page, seq, x, y, w, h, text, confidence, and kind and token once classified. Every join is within a page and within cells or
bands of it, so no page needs more than its own rows and no two spans meet that lie further apart than the operator reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.tables import stored
from . import match
from .catalogue import Catalogue, cable_description, example_list

PAGE = ["pdf", "page"]
#: The same for sorting: Spark compares the first column's first bytes before all else, and many documents' names begin alike.
NUMBER_FIRST = PAGE[::-1]
# Windows around a motor cable in which its cable is looked for, one after the other (to the left, to the right, up and down);
# how much a step down and a place above it weigh; how far parts of a cable may be from it and from each other; the slack of a span's box,
# the words of an identifier, and how far and how many fragments follow one another.
WINDOWS = [(40, 180, 100), (120, 300, 130), (220, 380, 170)]
DOWN, ABOVE = 3, 40
NEAR_X, NEAR_Y, NEAR_SIZES = 220, 180, 10
BAND, BAND_HEIGHTS, GAP = 30, 1.5, 180
SLACK, WORDS = 2, 8
FOLLOWERS, OVERLAP, GAP_HEIGHTS = 7, 0.5, 1.5
#: Sides of the cells of a page.
CELL, BAND_CELL = 256, 64


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def nearest_cables(spans: DataFrame, cables: DataFrame | None = None) -> DataFrame:
    """For each motor cable the cable of the first window that holds one, by weighted distance, then the shorter text, then reading order:
    pdf, page, seq, motor, cable_seq, cable, window, distance. Windows widen, so a pair's first window is known without asking the others,
    and one join does for all: the least of (window, distance, length, order)."""
    cables = spans.filter("kind = 'Cable'") if cables is None else cables
    rise = max(y for _, _, y in WINDOWS)
    m = spans.filter("kind = 'MC'").select(*PAGE, "seq", F.col("token").alias("motor"), F.col("x").alias("mx"), F.col("y").alias("my"))
    m = m.withColumn("cell", _cells(F.col("my") - rise, F.col("my") + rise, CELL))
    c = cables.select(*PAGE, F.col("seq").alias("cable_seq"), F.col("token").alias("cable"), F.length("text").alias("size"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.floor(F.col("y") / CELL).alias("cell"))
    dx, dy = F.col("cx") - F.col("mx"), F.abs(F.col("cy") - F.col("my"))
    within = None
    for k, (left, right, y) in enumerate(WINDOWS, 1):
        holds = (dx >= -left) & (dx <= right) & (dy <= y)
        within = F.when(holds, k) if within is None else within.when(holds, k)
    distance = F.abs(dx) + DOWN * dy + F.when(F.col("cy") < F.col("my"), ABOVE).otherwise(0)
    met = m.join(c, [*PAGE, "cell"]).withColumns({"window": within, "distance": distance}).filter("window is not null")
    best = met.groupBy(*PAGE, "seq", "motor").agg(F.min(F.struct("window", "distance", "size", "cy", "cx", "cable_seq", "cable")).alias("b"))
    return best.select(*PAGE, "seq", "motor", "b.cable_seq", "b.cable", "b.window", "b.distance")


def split_cables(spans: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Cables whose count and unit stand in two spans of one row near a motor cable: pdf, page, seq, other_seq, cable, text, x, y, w, h,
    confidence, each box and cable once. seq is the span on the left. A span meets only those in its band of the page."""
    m = spans.filter("kind = 'MC'").select(*PAGE, F.col("seq").alias("motor_seq"), F.col("x").alias("mx"), F.col("y").alias("my"),
                                           F.greatest(F.lit(NEAR_X), NEAR_SIZES * F.col("w")).alias("rx"), F.greatest(F.lit(NEAR_Y), NEAR_SIZES * F.col("h")).alias("ry"))
    m = m.withColumn("cell", _cells(F.col("my") - F.col("ry"), F.col("my") + F.col("ry"), CELL))
    s = spans.select(*PAGE, "seq", "x", "y", "w", "h", "text", "confidence", F.floor(F.col("y") / CELL).alias("cell"))
    near = s.join(m, [*PAGE, "cell"]).filter((F.abs(F.col("x") - F.col("mx")) <= F.col("rx")) & (F.abs(F.col("y") - F.col("my")) <= F.col("ry")))
    near = near.select(*PAGE, "motor_seq", "seq", "x", "y", "w", "h", "text", "confidence")
    band = lambda h: F.greatest(F.lit(BAND), BAND_HEIGHTS * h)
    a = near.withColumn("band", _cells(F.col("y") - band(F.col("h")), F.col("y") + band(F.col("h")), BAND_CELL))
    names = ["seq", "x", "y", "w", "h", "text", "confidence"]
    b = near.select(*PAGE, "motor_seq", *(F.col(c).alias(f"o_{c}") for c in names), F.floor(F.col("y") / BAND_CELL).alias("band"))
    # Each pair once, the span further left (then earlier) first.
    first = (F.col("x") < F.col("o_x")) | ((F.col("x") == F.col("o_x")) & (F.col("seq") < F.col("o_seq")))
    met = a.join(b, [*PAGE, "motor_seq", "band"]).filter(first & (F.abs(F.col("y") - F.col("o_y")) <= band(F.least("h", "o_h"))) & (F.col("o_x") - F.col("x") - F.col("w") <= GAP))
    joined = met.withColumn("both", F.concat_ws(" ", "text", "o_text")).withColumn("cable", cable_description(F.col("both"), catalogue)).filter("cable is not null")
    x, y = F.col("x"), F.least("y", "o_y")
    made = joined.select(*PAGE, "seq", F.col("o_seq").alias("other_seq"), "cable", F.upper("both").alias("text"), x.alias("x"), y.alias("y"), (F.col("o_x") + F.col("o_w") - x).alias("w"),
                         (F.greatest(F.col("y") + F.col("h"), F.col("o_y") + F.col("o_h")) - y).alias("h"), F.least("confidence", "o_confidence").alias("confidence"))
    each = made.groupBy(*PAGE, "cable", "x", "y", "w", "h").agg(F.min(F.struct("seq", "other_seq", "text", "confidence")).alias("f"))
    return each.select(*PAGE, "f.seq", "f.other_seq", "cable", "f.text", "x", "y", "w", "h", "f.confidence")


def prefixed(token: Column, prefix: str, digit: bool) -> Column:
    """Whether a token goes on after the prefix, not with a letter if the prefix ends in a letter or digit, and (digit) holds a digit."""
    after = F.substring(token, len(prefix) + 1, 1)
    out = token.startswith(prefix) & (after != "")
    if prefix[-1:].isalnum():
        out = out & ~after.rlike("[A-Za-z]")
    return out & token.rlike("[0-9]") if digit else out


def best_motors(spans: DataFrame, catalogue: Catalogue) -> DataFrame:
    """One motor cable for each page that has some: pdf, page, motor. Those that begin with an example of the catalogue take part (with a
    digit, if any of the page's has one); the best is most like the first example with what follows the box's own example in the page's box
    (the first by name), then has the most digits, the most separators, the shortest and the last name."""
    motors, boxes = example_list(catalogue.motors) or [], example_list(catalogue.boxes) or []
    any_of = lambda t, digit: F.coalesce(*(F.when(prefixed(t, p, digit), True) for p in motors), F.lit(False)) if motors else F.lit(False)
    t = F.col("motor")
    m = spans.filter("kind = 'MC'").select(*PAGE, X.code_token(F.col("token")).alias("motor")).distinct().withColumns({"strict": any_of(t, True), "loose": any_of(t, False)})
    m = m.withColumn("some", F.max("strict").over(Window.partitionBy(*PAGE))).filter(F.when(F.col("some"), F.col("strict")).otherwise(F.col("loose")))
    box = spans.filter("kind = 'JB'").groupBy(*PAGE).agg(F.min("token").alias("box"))
    goes_on = [F.when(F.col("box").startswith(p) & (F.length("box") > len(p)), F.concat(F.lit(motors[0]), F.substring("box", len(p) + 1, 1000))) for p in boxes] if motors else []
    wanted = F.coalesce(*goes_on, F.lit(None).cast("string"))
    m = m.join(box, PAGE, "left").withColumn("wanted", wanted)
    like = F.when(F.col("wanted").isNull(), 0.0).otherwise(match.indel_ratio(t, F.coalesce("wanted", F.lit(""))))
    count = lambda kind: F.length(F.regexp_replace(t, f"[^{kind}]", ""))
    score = F.struct(like.alias("like"), count("0-9").alias("digits"), count("_.-").alias("separators"), (-F.length(t)).alias("short"), t.alias("motor"))
    return m.withColumn("score", score).groupBy(*PAGE).agg(F.max("score").alias("s")).select(*PAGE, "s.motor")


def words_inside(spans: DataFrame, words: DataFrame, slack: int = SLACK) -> DataFrame:
    """(pdf, page, seq, word_seq and the word's x, y, w, h, text, confidence) of the words whose boxes lie in a span's box, give or take the
    slack. A span is in all the cells that its box touches, a word in that of its corner, so they meet once."""
    inner = [F.col(c).alias(f"s_{c}") for c in ("x", "y", "w", "h")]
    s = spans.select(*PAGE, "seq", *inner)
    s = s.withColumn("cx", _cells(F.col("s_x") - slack, F.col("s_x") + F.col("s_w") + slack, CELL)).withColumn("cy", _cells(F.col("s_y") - slack, F.col("s_y") + F.col("s_h") + slack, CELL))
    w = words.select(*PAGE, F.col("seq").alias("word_seq"), "x", "y", "w", "h", "text", "confidence", F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy"))
    inside = (F.col("x") >= F.col("s_x") - slack) & (F.col("y") >= F.col("s_y") - slack) & (F.col("x") + F.col("w") <= F.col("s_x") + F.col("s_w") + slack) & (F.col("y") + F.col("h") <= F.col("s_y") + F.col("s_h") + slack)
    return s.join(w, [*NUMBER_FIRST, "cx", "cy"]).filter(inside).select(*PAGE, "seq", "word_seq", "x", "y", "w", "h", "text", "confidence")


@lru_cache(1 << 16)
def _key(text: str | None) -> str:
    return "".join((text or "").upper().split()).replace("_", "").replace("-", "")


def found_runs(candidates: list[str], keys: list[str], most: int = WORDS) -> list[tuple[int, int]] | None:
    """For each candidate, once, the first run (from, to) of at most ``most`` free words whose keys spell it; None unless all are found."""
    used: set[int] = set()
    out = []
    for candidate in dict.fromkeys(candidates):
        wanted, found = _key(candidate), None
        for i in range(len(keys)):
            spelt = ""
            for j in range(i, min(len(keys), i + most)):
                spelt += keys[j]
                if j in used or not wanted.startswith(spelt):
                    break
                if spelt == wanted:
                    found = (i, j + 1)
                    break
            if found:
                break
        if not found:
            return None
        used.update(range(*found))
        out.append(found)
    return out


def dealt_words(candidates: list[str], words: list[tuple[int, int, int, int, float, str]], most: int = WORDS) -> list[tuple[int, int, int, int, float, str]] | None:
    """The words (y, x, w, h, confidence, text, in reading order) with those of each candidate put together; None unless every candidate is
    found. A candidate takes the first run of at most ``most`` free words that spells it, separators aside."""
    runs = found_runs(candidates, [_key(w[5]) for w in words], most)
    if runs is None or not words:
        return None
    out = []
    for candidate, (i, j) in zip(dict.fromkeys(candidates), runs, strict=True):
        run = words[i:j]
        y, x = min(w[0] for w in run), min(w[1] for w in run)
        out.append((y, x, max(w[1] + w[2] for w in run) - x, max(w[0] + w[3] for w in run) - y, min(w[4] for w in run), candidate))
    used = {k for run in runs for k in range(*run)}
    return sorted([*out, *(w for k, w in enumerate(words) if k not in used)], key=lambda w: w[:2])


def _boxes(columns: dict[str, pa.Array], low: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
    """x, y, w, h and least confidence of what the rows from low to high, side by side, have together."""
    v = {n: columns[n].to_numpy(zero_copy_only=False) for n in ("x", "y", "w", "h", "confidence")}
    over = lambda f, a: f.reduceat(np.append(a, a[-1:]), np.stack([low, high], 1).ravel())[::2]
    x, y = over(np.minimum, v["x"]), over(np.minimum, v["y"])
    return {"x": x, "y": y, "w": over(np.maximum, v["x"] + v["w"]) - x, "h": over(np.maximum, v["y"] + v["h"]) - y, "confidence": over(np.fmin, v["confidence"])}


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where rows differ from the one before, and their number at the end."""
    new = np.ones(len(columns[0]) + 1, bool)
    new[1:-1] = False
    for c in columns:
        a, b = c[1:], c[:-1]
        differs = pc.fill_null(pc.not_equal(a, b), True)
        new[1:-1] |= pc.and_not(differs, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches that end with a group, and where groups start. A group is held until the next one begins."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is None:
            rest, held = held, []
        else:
            last = int(_starts([batch[c] for c in by])[-2])
            if held and not last and len(_starts([pa.concat_arrays([held[-1][c][-1:], batch[c][:1]]) for c in by])) == 2:
                held.append(batch)
                continue
            rest, held = [*held, batch.slice(0, last)], [batch.slice(last)]
        rest = [r for r in rest if r.num_rows]
        if rest:
            rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            yield rows, _starts([rows[c] for c in by])


def _batch(schema: pa.Schema, columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    made = (columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], from_pandas=True) for f in schema)
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)


def _split(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Spans, each followed by its words in reading order: what split_spans gives for them."""
    for rows, starts in _whole_groups(batches, [*PAGE, "seq"]):
        is_span = pc.is_null(rows["word_seq"]).to_numpy(zero_copy_only=False)
        keys = [_key(t) for t in rows["text"].to_pylist()]
        candidates = rows["candidates"].to_pylist()
        words_from = starts[:-1] + np.add.reduceat(is_span, starts[:-1], dtype=np.int64)
        low, high, owner, text, stay = [], [], [], [], []
        place = iter(range(len(rows), 1 << 62))  # candidates' texts come after the rows' in what is taken from
        made: list[str] = []
        for start, middle, end in zip(starts[:-1].tolist(), words_from.tolist(), starts[1:].tolist(), strict=True):
            for span in range(start, middle):
                runs = found_runs(candidates[span], keys[middle:end]) if candidates[span] and middle < end else None
                if runs is None:
                    stay.append(span)
                    continue
                used = set()
                for candidate, (i, j) in zip(dict.fromkeys(candidates[span]), runs, strict=True):
                    used.update(range(i, j))
                    low.append(middle + i)
                    high.append(middle + j)
                    made.append(candidate)
                    text.append(next(place))
                free = [middle + k for k in range(end - middle) if k not in used]
                low += free
                high += [k + 1 for k in free]
                text += free
                owner += [span] * (len(runs) + len(free))
        kept = rows.take(pa.array(stay, pa.int64()))
        yield _batch(schema, {n: kept[n] for n in schema.names if n != "part"} | {"part": np.zeros(len(stay), np.int32)})
        if owner:
            columns = {n: rows[n] for n in rows.schema.names}
            of = np.array(owner)
            box = _boxes(columns, np.array(low), np.array(high))
            order = np.lexsort((np.arange(len(of)), box["x"], box["y"], of))
            of = of[order]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            part = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
            texts = pa.concat_arrays([rows["text"], pa.array(made, rows["text"].type)]).take(pa.array(np.array(text)[order]))
            yield _batch(schema, {n: rows[n].take(pa.array(of)) for n in (*PAGE, "seq")} | {n: v[order] for n, v in box.items()} | {"text": texts, "part": part})


def split_spans(spans: DataFrame, words: DataFrame, candidates: str = "candidates", alone: str = "alone") -> DataFrame:
    """spans with those that hold several identifiers split into their words: pdf, page, seq, part, x, y, w, h, text, confidence. The column
    ``candidates`` has a span's identifiers, ``alone`` says that the whole text is one. A span with identifiers that its words don't spell
    stays as it is. Each span and the words inside it come side by side in one stream, and no more than a batch and a span are held."""
    ints, box = ["x", "y", "w", "h"], ["x", "y", "w", "h", "text", "confidence"]
    several = (F.size(candidates) > 0) & ~F.col(alone)
    inside = words_inside(spans.filter(several), words)
    by = [F.col("y").alias("by_y"), F.col("x").alias("by_x")]  # words are in order by what their boxes are before these are whole numbers
    inside = inside.select(*PAGE, "seq", *by, "word_seq", *(F.col(c).cast("int").alias(c) for c in ints), "text", F.col("confidence").cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("candidates"))
    none = lambda c: F.lit(None).cast(inside.schema[c].dataType).alias(c)
    own = spans.select(*PAGE, "seq", none("by_y"), none("by_x"), none("word_seq"), *box, F.when(several, F.col(candidates)).cast("array<string>").alias("candidates"))
    rows = own.unionByName(inside).repartition(*PAGE, "seq")
    rows = rows.sortWithinPartitions(F.xxhash64(*PAGE, "seq"), *PAGE, "seq", F.col("word_seq").isNotNull(), "by_y", "by_x", "word_seq", *ints[2:], "confidence", "text")
    rows = rows.select(*PAGE, "seq", "word_seq", *box, "candidates")
    out = T.StructType([*(rows.schema[c] for c in (*PAGE, "seq")), T.StructField("part", T.IntegerType()), *(rows.schema[c] for c in box)])
    return rows.mapInArrow(partial(_split, schema=to_arrow_schema(out)), out)


def joined_fragments(spans: DataFrame, refs: DataFrame, known: str = "known") -> DataFrame:
    """spans with fragments of a row put together where together they belong to the family of a reference: pdf, page, seq, last_seq, x, y, w,
    h, text, confidence. The column ``known`` says that a span holds an identifier by itself; it neither starts nor joins a run.

    In reading order each span may be followed by up to seven: each overlaps its predecessor's height by half and begins close after it. The
    shortest run that spells a member wins, and the spans of a run don't start another.

    Families ask for digits, not for certain ones, so a run's texts count by their shapes, with 0 for every digit, and a span by the shapes of
    its runs, the shortest first. Of these there are few however many spans there are; they are held against the families, and the spans of a
    page then come in one stream with the length of the run that each may start."""
    order = Window.partitionBy(*NUMBER_FIRST).orderBy("y", "x", "seq")
    after = lambda c: F.lead(c).over(order)
    box = ["x", "y", "w", "h", "text", "confidence"]
    gap, high = after("x") - F.col("x") - F.col("w"), F.greatest("h", after("h"))
    over = F.least(F.col("y") + F.col("h"), after("y") + after("h")) - F.greatest(F.col("y"), after("y"))
    goes_on = ~after(known) & (over >= OVERLAP * F.least("h", after("h"))) & (gap >= -SLACK) & (gap <= GAP_HEIGHTS * high)
    rows = spans.select(*PAGE, "seq", *box, F.col(known).alias("known"), F.coalesce(goes_on, F.lit(False)).alias("goes_on"))
    ahead = order.rowsBetween(0, FOLLOWERS)
    rows = rows.withColumns({"texts": F.collect_list(F.coalesce("text", F.lit(""))).over(ahead), "on": F.collect_list("goes_on").over(order.rowsBetween(0, FOLLOWERS - 1))})
    stop = F.array_position("on", F.lit(False))
    size = F.when(stop > 0, stop).otherwise(F.size("on") + 1).cast("int")
    shape = lambda k: F.translate(F.upper(F.trim(F.array_join(F.slice("texts", F.lit(1), k), " "))), "123456789", "0" * 9)
    starts = F.coalesce(~F.col("known"), F.lit(False)) & F.col("goes_on")
    rows = rows.withColumn("shapes", F.when(starts, F.transform(F.sequence(F.lit(2), F.when(starts, size).otherwise(2)), shape))).select(*PAGE, "seq", *box, "shapes")
    every = stored(rows.filter("shapes is not null").select("shapes").distinct())
    each = every.select("shapes", F.posexplode("shapes").alias("k", "text"))
    fits = each.join(match.members(each.select("text"), refs, "text"), "text", "left_semi")
    lengths = stored(fits.groupBy("shapes").agg((F.min("k") + 2).alias("k")))
    # The place asks for whole pages in order, however the lengths were joined.
    rows = rows.join(lengths, "shapes", "left").select(*PAGE, "seq", *box, "k", F.row_number().over(order).alias("at")).sortWithinPartitions(*NUMBER_FIRST, "y", "x", "seq")
    out = T.StructType([*(rows.schema[c] for c in (*PAGE, "seq")), T.StructField("last_seq", rows.schema["seq"].dataType), *(rows.schema[c] for c in box)])
    return rows.mapInArrow(partial(_joined, schema=to_arrow_schema(out)), out)


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Spans of whole pages in order with the length k of the run that each may start: what joined_fragments gives for them."""
    for rows, starts in _whole_groups(batches, PAGE):
        k = pc.fill_null(rows["k"], 0).to_numpy()
        low, high, free = [], [], 0
        for at in np.flatnonzero(k).tolist():
            if at >= free:
                free = at + int(k[at])
                low.append(at)
                high.append(free)
        inner = np.zeros(len(rows) + 1, np.int64)
        np.add.at(inner, low, 1)
        np.add.at(inner, high, -1)
        kept = rows.filter(pa.array(np.cumsum(inner)[:-1] == 0))
        yield _batch(schema, {n: kept["seq" if n == "last_seq" else n] for n in schema.names})
        if low:
            first, last = pa.array(low), pa.array(np.array(high) - 1)
            words = rows["text"].to_pylist()
            made = {n: rows[n].take(first) for n in (*PAGE, "seq")} | {"last_seq": rows["seq"].take(last)} | _boxes({n: rows[n] for n in rows.schema.names}, np.array(low), np.array(high))
            yield _batch(schema, made | {"text": pa.array([" ".join(words[a:b]) for a, b in zip(low, high, strict=True)], pa.string())})
