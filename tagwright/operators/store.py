"""Projects, runs, presets, issues and exports as snapshots: every change maps old tables to new ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def get_or_create(projects: DataFrame, names: DataFrame) -> DataFrame:
    """projects (name, hash) with one new row for each wanted name that neither name nor hash is there for."""
    wanted = names.select(F.trim("name").alias("name")).distinct().withColumn("hash", F.sha2("name", 256))
    new = wanted.join(projects.select("name"), "name", "left_anti").join(projects.select("hash"), "hash", "left_anti")
    return projects.unionByName(new.select("name", "hash"))


def with_status(runs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Runs with new statuses; the first start and the first end keep their time. changes: id, new_status."""
    j = runs.join(changes, "id", "left")
    started = F.when(F.col("new_status") == "RUNNING", F.coalesce("started_at", now)).otherwise(F.col("started_at"))
    ended = F.when(F.col("new_status").isin("DONE", "FAILED"), F.coalesce("finished_at", now)).otherwise(F.col("finished_at"))
    return j.select("id", F.coalesce("new_status", "status").alias("status"), started.alias("started_at"), ended.alias("finished_at"))


def persisted(stored: DataFrame, run_rows: DataFrame) -> DataFrame:
    """Stored rows with those of the runs at hand replaced."""
    return stored.join(run_rows.select("run_id").distinct(), "run_id", "left_anti").unionByName(run_rows.select(*stored.columns))


def issues(classes: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of classes of issues; a key that an earlier class has is suppressed in later ones."""
    ranked = [c.withColumn("__rank", F.lit(k)) for k, c in enumerate(classes)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    least = every.groupBy(*key).agg(F.min("__rank").alias("__least"))
    return every.join(least, key).filter("__rank = __least").drop("__rank", "__least")


def deduplicated_warnings(warnings: DataFrame) -> DataFrame:
    """One warning per type, item and document without regard to case; the first in order of page."""
    key = [F.upper(F.col(c)) for c in ("warning", "item", "pdf")]
    return warnings.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy("page"))).filter("__k = 1").drop("__k")


def composed_columns(inputs: list[str], template: list[str], keys: list[str], defaults: list[str]) -> list[str]:
    """Columns of an export: the input's, then the template's, then the rows' own, each once; the defaults where there are none."""
    return list(dict.fromkeys([*inputs, *template, *keys])) or list(defaults)


def exported(rows: DataFrame, columns: list[str], canonical: dict[str, str]) -> DataFrame:
    """Rows in order with the wanted columns: from the values map, else from the canonical field."""
    value = lambda c: X.first_of(F.try_element_at("values", F.lit(c)), *([F.col(canonical[c])] if c in canonical else []))
    return rows.select("row_index", *(F.coalesce(value(c), F.lit("")).alias(c) for c in columns))


def without(presets: DataFrame, ids: DataFrame, user: str | None = None) -> DataFrame:
    """Presets less those deleted; with a user only that user's own can be."""
    gone = ids.select("id") if user is None else ids.select("id").join(presets.filter(F.col("user") == user).select("id"), "id", "left_semi")
    return presets.join(gone, "id", "left_anti")


def visible(presets: DataFrame, user: str, admin: bool = False) -> DataFrame:
    return presets if admin else presets.filter(F.col("user") == user)


def annotation_rectangle(x: Column, y: Column, w: Column, h: Column, dpi: Column) -> Column:
    """Points from pixels."""
    pt = lambda c: c * F.lit(72.0).cast("double") / dpi
    return F.struct(pt(x).alias("x0"), pt(y).alias("y0"), pt(x + w).alias("x1"), pt(y + h).alias("y1"))


def label_place(box: Column, size: Column, page_width: Column, page_height: Column, height: float = 10.0) -> Column:
    """Where a label goes: above its box, below it near the top edge, inside the page."""
    above = box["y0"] - height
    y = F.when(above < 0, box["y1"]).otherwise(above)
    return F.struct(F.greatest(F.lit(0.0), F.least(box["x0"], page_width - size)).alias("x"), F.greatest(F.lit(0.0), F.least(y, page_height - height)).alias("y"))


#: Colours of kinds.
COLOURS = {"JB": "0000FF", "MC": "800080", "SPARE": "FFA500", "Tag": "00AA00", "Cable": "A52A2A"}


def annotation_plan(spans: DataFrame, dpi: int = 300) -> DataFrame:
    """Rectangle, colour and label of every known span; of the cables of a page only the one with most digits."""
    rank = F.row_number().over(Window.partitionBy("pdf", "page", F.col("kind") == "Cable").orderBy(F.desc(F.length(F.regexp_replace("token", "[^0-9]", ""))), "token", "y", "x", "seq"))
    s = spans.filter("kind <> 'Unknown'").withColumn("k", rank).filter("kind <> 'Cable' or k = 1")
    return s.select("pdf", "page", "kind", "token", X.lookup(F.col("kind"), COLOURS).alias("colour"), annotation_rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(dpi)).alias("box"))


def json_columns(rows: DataFrame, defaults: list[str], raw: str = "raw_json") -> DataFrame:
    """(place, name): the columns of rows kept as JSON objects, the default ones first in their order, then all others by name. Texts that
    are no object, and null, give none."""
    found = rows.select(F.explode(F.map_keys(F.from_json(raw, "map<string,string>"))).alias("name")).distinct()
    first = rows.sparkSession.createDataFrame(list(enumerate(defaults)), "at int, name string")
    every = found.join(first, "name", "full")
    return every.select((F.row_number().over(Window.orderBy(F.coalesce("at", F.lit(len(defaults))), "name")) - 1).alias("place"), "name")  # one row for each column


def json_values(rows: DataFrame, columns: list[str], raw: str = "raw_json") -> DataFrame:
    """rows with a text column for each of the names, blank where a row's object lacks it."""
    values = F.from_json(raw, "map<string,string>")
    return rows.withColumn("__values", values).withColumns({c: F.coalesce(F.try_element_at("__values", F.lit(c)), F.lit("")) for c in columns}).drop("__values")


def nested(rows: DataFrame, inner: str, raw: str = "raw_json") -> DataFrame:
    """rows with outer, middle and the fields of ``inner`` (a struct type) for each entry of a JSON object of objects of such structs."""
    one = rows.select(*(c for c in rows.columns if c != raw), F.explode(F.from_json(raw, f"map<string,map<string,{inner}>>")).alias("outer", "__m"))
    two = one.select(*(c for c in one.columns if c != "__m"), F.explode("__m").alias("middle", "__s"))
    return two.select(*(c for c in two.columns if c != "__s"), "__s.*")


# Fixed value: the user who sees everything.
ADMIN = "admin"


def owned_projects(projects: DataFrame, runs: DataFrame, user: str, unstarted: bool = False) -> DataFrame:
    """projects (id) in which the user has started a run (project_id, initiated_by); with ``unstarted`` also those without any. An admin has all."""
    if user.strip().lower() == ADMIN:
        return projects
    own = runs.groupBy("project_id").agg(F.max(F.coalesce(F.col("initiated_by") == user, F.lit(False))).alias("__own"))
    j = projects.join(own, projects["id"] == own["project_id"], "left")
    return j.filter(F.coalesce("__own", F.lit(unstarted))).select(*(projects[c] for c in projects.columns))


def owned_runs(runs: DataFrame, user: str) -> DataFrame:
    return runs if user.strip().lower() == ADMIN else runs.filter(F.trim("initiated_by") == user)


def permitted(artifacts: DataFrame, runs: DataFrame, user: str) -> DataFrame:
    """artifacts (run_id) of the runs that the user may see; an admin sees also those whose run is gone."""
    if user.strip().lower() == ADMIN:
        return artifacts
    return artifacts.join(owned_runs(runs, user).select(F.col("id").alias("run_id")), "run_id", "left_semi")


def audit(log: DataFrame, user: str | None = None, action: str | None = None, since: Column | None = None, most: int = 100) -> DataFrame:
    """The latest entries (id, user_id, action, created) that meet every condition given, newest first, larger ids first on ties."""
    for name, wanted in (("user_id", user), ("action", action)):
        log = log if wanted is None else log.filter(F.col(name) == wanted)
    log = log if since is None else log.filter(F.col("created") >= since)
    return log.orderBy(F.desc("created"), F.desc("id")).limit(most)


def linked(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """issues with row_id, the first stored row of the same tag, whatever its case, document and page; null if there is none."""
    key = lambda df: df.withColumn("__tag", F.upper("tag"))
    first = key(rows).groupBy("__tag", "pdf", "page").agg(F.min("id").alias("row_id"))
    return key(issues).join(first, ["__tag", "pdf", "page"], "left").select(*issues.columns, "row_id")


def patched(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """issues with the new statuses of changes (id, new_status); one that is resolved keeps its time, or takes that of its creation. Of several
    changes of an id the last by name holds, so an issue stays one row."""
    j = issues.join(changes.groupBy("id").agg(F.max("new_status").alias("new_status")), "id", "left")
    done = F.when(F.col("new_status") == "RESOLVED", F.coalesce("resolved_at", "created_at")).otherwise(F.col("resolved_at"))
    return j.withColumns({"status": F.coalesce("new_status", "status"), "resolved_at": done}).select(*issues.columns)


def with_values(rows: DataFrame, values: str, names: dict[str, list[str]]) -> DataFrame:
    """rows whose columns take the first value, not blank, of their names in a map; else they keep their own, trimmed, and null is blank."""
    held = lambda c, of: X.first_of(*(F.try_element_at(values, F.lit(n)) for n in of), F.col(c))
    return rows.withColumns({c: F.trim(F.coalesce(held(c, of), F.lit(""))) for c, of in names.items()})
