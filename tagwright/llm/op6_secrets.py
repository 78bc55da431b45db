"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds are found by patterns: ``assign`` (a keyword, a separator and a value of six or more characters), ``access`` (AKIA and at
least sixteen more) and ``hex`` (24 or more digits). Besides there are parts of credentials that mean little alone: identifiers
(shorter access keys, client or user names that are assigned), secrets (long runs that mix cases and digits) and endpoints (URLs,
hosts with ports). An interval join within scopes (the same row, at most ``SCOPE`` code points apart) reports a weak identifier only
near a secret, a weak secret only near an identifier, an endpoint only near both; base finds count as parts too. Intervals are joined
by buckets of SCOPE positions, with a semi join, so neither a long text nor a crowded one yields pairs.

Patterns run without recursion and in time linear in the text, whatever it holds: repeated groups are possessive, and an endpoint is only
tried where one can start. Spans are laid end to end in blocks of ``BLOCK`` matches, so a text with many matches costs no more for each.

Positions are code points, ends exclusive. n_assign, n_access and n_hex count the base spans; spans lists these and the added ones
(kinds id, secret, endpoint, in this order after the base kinds), by start, then kind. Weak parts that touch a base span are not
reported. Null texts count as empty. Rows are kept apart by a row number, so ids may be null or repeated. Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Code points within which parts belong together; buckets have the same width.
SCOPE = 256
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
WEAK_ID = r"""(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}|(?i:client_id|access_key_id|user_?name|user_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
WEAK_SECRET = "[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}"""
#: The same matches for Spark: no step back, and a host starts after the last match (and a dot) or where no part of a host comes before.
ENDPOINT_LINEAR = r"""https?://[^\s"'<>]{4,}+|(?:\G|(?<=\G\.)|(?<![A-Za-z0-9-])(?<![A-Za-z0-9-]\.))[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}+"""
#: Kind, pattern, a cheap test that a text must pass, group that a match's worth is judged by, SQL test of that group (x).
KINDS = [
    ("assign", ASSIGN, "(?i)(?:passw(?:or)?d|secret|token|api_?key)", 2, "length(x) >= 6"),
    ("access", ACCESS, "AKIA", 0, "true"),
    ("hex", HEX, "[0-9a-f]{24}", 0, "true"),
    ("id", WEAK_ID, "A(?:KI|SI|RO|ID)A[A-Z0-9]{8}|(?i:client_id|access_key_id|user_?name|user_?id|login)", 0, "true"),
    ("secret", WEAK_SECRET, "[A-Za-z0-9+/_=-]{20}", 0, "x rlike '[0-9]' and x rlike '[A-Z]' and x rlike '[a-z]'"),
    ("endpoint", ENDPOINT, "://|[A-Za-z0-9]:[0-9]", 0, "true"),
]
BASE = 3
LINEAR = {"endpoint": ENDPOINT_LINEAR}
#: Matches to a block of spans.
BLOCK = 256
_SPAN = "struct<start:int,kind:int,end:int>"


def _spans(name: str, kind: int, test: str) -> tuple[Column, Column]:
    """Spans of the matches m_<name>, whose worth is judged by x_<name>, from the lengths of what lies between them, g_<name>. Blocks of
    matches are laid out from 0 first, then moved by what the blocks before them take."""
    worth = test.replace("x ", f"v.x_{name} ").replace("(x)", f"(v.x_{name})")
    block = f"""aggregate(arrays_zip(slice(g_{name}, k * {BLOCK} + 1, {BLOCK}), slice(m_{name}, k * {BLOCK} + 1, {BLOCK}), slice(x_{name}, k * {BLOCK} + 1, {BLOCK})),
        named_struct('at', 0, 'out', cast(array() as array<{_SPAN}>)),
        (a, v) -> named_struct('at', a.at + length(v['0']) + coalesce(length(v['1']), 0), 'out', case when v['1'] is not null and ({worth.replace(f"v.x_{name}", "v['2']")})
            then array_append(a.out, named_struct('start', a.at + length(v['0']), 'kind', {kind}, 'end', a.at + length(v['0']) + length(v['1']))) else a.out end))"""
    blocks = f"transform(sequence(0, cast(floor((size(m_{name}) - 1) / {BLOCK}) as int)), k -> {block})"
    offsets = f"aggregate(b_{name}, cast(array(0) as array<int>), (o, b) -> array_append(o, element_at(o, -1) + b.at))"
    placed = f"flatten(transform(arrays_zip(b_{name}, {offsets}), z -> case when z['b_{name}'] is null then cast(array() as array<{_SPAN}>) else transform(z['b_{name}'].out, s -> named_struct('start', s.start + z['1'], 'kind', s.kind, 'end', s.end + z['1'])) end))"
    return F.expr(f"case when size(m_{name}) = 0 then cast(array() as array<{_SPAN}>) else {placed} end"), F.expr(f"case when size(m_{name}) > 0 then {blocks} end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, written to the shared folder: rid, key, base and weak (spans)."""
    found = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    nothing = F.array().cast("array<string>")
    found = found.select("*", *(F.col("t").rlike(test).alias(f"h_{n}") for n, _, test, _, _ in KINDS))
    got = lambda n, value: F.when(F.col(f"h_{n}"), value).otherwise(nothing)
    found = found.select("rid", "key", *(c for n, p, _, group, _ in KINDS for c in (
        got(n, F.regexp_extract_all("t", F.lit(LINEAR.get(n, p)), F.lit(0))).alias(f"m_{n}"),
        got(n, F.regexp_extract_all("t", F.lit(LINEAR.get(n, p)), F.lit(group))).alias(f"x_{n}"),
        got(n, F.split("t", LINEAR.get(n, p), -1)).alias(f"g_{n}"))))
    of = {n: _spans(n, k, test) for k, (n, _, _, _, test) in enumerate(KINDS)}
    found = found.select("*", *(blocks.alias(f"b_{n}") for n, (_, blocks) in of.items()))
    found = found.select("rid", "key", *(spans.alias(n) for n, (spans, _) in of.items()))
    return cut(found.select("rid", "key", F.array_sort(F.concat(*(n for n, *_ in KINDS[:BASE]))).alias("base"), F.concat(*(n for n, *_ in KINDS[BASE:])).alias("weak")))


def _buckets(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width).cast("int"), F.floor(high / width).cast("int"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, added): the weak spans clear of base ones that have the parts they need within scope."""
    names = [n for n, *_ in KINDS]
    all_parts = found.filter(F.size("weak") > 0).select("rid", F.inline(F.concat("base", "weak")))
    cells = all_parts.withColumn("bucket", F.explode(_buckets(F.col("start"), F.col("end") - 1, scope)))
    weak, base = cells.filter(F.col("kind") >= BASE).alias("w"), cells.filter(F.col("kind") < BASE).alias("b")
    clash = weak.join(base, (F.col("w.rid") == F.col("b.rid")) & (F.col("w.bucket") == F.col("b.bucket")) & (F.col("b.start") < F.col("w.end")) & (F.col("w.start") < F.col("b.end")), "left_semi")
    parts = all_parts.join(clash.select("rid", "start", "kind", "end").distinct(), ["rid", "start", "kind", "end"], "left_anti")
    role = F.when(F.col("kind").isin(names.index("access"), names.index("id")), "id").when(F.col("kind") == names.index("endpoint"), "endpoint").otherwise("secret")
    parts = cut(parts.select("rid", "start", "kind", "end", role.alias("role")))
    needs = F.when(F.col("role") == "id", F.array(F.lit("secret"))).when(F.col("role") == "secret", F.array(F.lit("id"))).otherwise(F.array(F.lit("id"), F.lit("secret")))
    weak = parts.filter(F.col("kind") >= BASE).select("rid", "start", "kind", "end", F.size(needs).alias("n"), F.explode(needs).alias("need"))
    weak = weak.select("*", F.explode(_buckets(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope, scope)).alias("bucket")).alias("w")
    other = parts.select("rid", "role", "start", "end", F.explode(_buckets(F.col("start"), F.col("end") - 1, scope)).alias("bucket")).alias("o")
    near = (F.col("o.start") < F.col("w.end") + scope) & (F.col("o.end") > F.col("w.start") - scope)
    met = weak.join(other, (F.col("w.rid") == F.col("o.rid")) & (F.col("w.bucket") == F.col("o.bucket")) & (F.col("w.need") == F.col("o.role")) & near, "left_semi")
    met = met.select("rid", "start", "kind", "end", "n", "need").distinct().groupBy("rid", "start", "kind", "end", "n").agg(F.count("*").alias("met")).filter("met = n")
    return met.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(n) for n, *_ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = scan(docs, id_col, text_col)
    both = found.join(linked(found, scope), "rid", "left")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return both.select(F.col("key").alias(id_col), *(number(k).alias(f"n_{n}") for k, (n, *_) in enumerate(KINDS[:BASE])), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_linked"))


def _oracle() -> str:
    """The same rows in SQL without Spark's functions: positions from the lengths of matches and of what lies between them."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, regexp_extract_all(t, {quoted(p)}, 0) AS m, regexp_extract_all(t, {quoted(p)}, {group}) AS x, string_split_regex(t, {quoted(p)}) AS g FROM d"
        for k, (_, p, _, group, _) in enumerate(KINDS)
    )
    name = "[" + ", ".join(f"'{n}'" for n, *_ in KINDS) + "][kind + 1]"
    joined = f"string_agg({name} || ':' || st || ':' || en, ',' ORDER BY st, kind, en)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
p AS (SELECT rid, kind, x[i] AS v, length(m[i]) AS size, CAST(coalesce(list_sum(list_transform(g[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS st FROM e),
q AS (SELECT rid, kind, st, st + size AS en FROM p WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 4 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') ELSE true END),
parts AS (SELECT *, CASE WHEN kind IN (1, 3) THEN 'id' WHEN kind = 5 THEN 'endpoint' ELSE 'secret' END AS role FROM q WHERE kind < {BASE} OR NOT EXISTS (SELECT 1 FROM q b WHERE b.rid = q.rid AND b.kind < {BASE} AND b.st < q.en AND q.st < b.en)),
near AS (SELECT DISTINCT w.rid, w.kind, w.st, w.en, o.role FROM parts w JOIN parts o ON w.rid = o.rid AND w.kind >= {BASE} AND o.role <> w.role AND o.role <> 'endpoint' AND o.st < w.en + {SCOPE} AND o.en > w.st - {SCOPE}),
linked AS (SELECT rid, kind, st, en FROM near GROUP BY rid, kind, st, en HAVING count(DISTINCT role) = CASE kind WHEN 5 THEN 2 ELSE 1 END),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, {joined} AS spans FROM q WHERE kind < {BASE} GROUP BY rid),
al AS (SELECT rid, {joined} AS spans, count(*) FILTER (kind >= {BASE}) AS n FROM (SELECT rid, kind, st, en FROM q WHERE kind < {BASE} UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(al.spans, '') AS spans, coalesce(al.n, 0) AS n_linked
FROM d LEFT JOIN b ON d.rid = b.rid LEFT JOIN al ON d.rid = al.rid
"""


ORACLE_SQL = _oracle()
