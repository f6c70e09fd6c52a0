"""EXPLAIN texts to tables: lines, nodes with their place in the tree, one row of nodes a plan.

Everything is native expressions. Lines meet by plan once (one shuffle on plan_id); the tree is found within a plan's array of nodes: a node's
parent is the nearest node above with a smaller indent, the first node counting as outside all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansmith.plans import vocabulary as V

_DECIMAL = r"(\d+(?:\.\d*)?|\.\d+)"
# What stands in parentheses behind a node (the input's format): the words are fixed, numbers are read by _DECIMAL.
COST = rf"\(cost={_DECIMAL}\.\.{_DECIMAL} rows={_DECIMAL} width=(\d+)\)"
ANY_COST = r"\(cost=\.\*.*?\)"
TIMES = rf"actual time={_DECIMAL}\.\.{_DECIMAL} rows={_DECIMAL} loops={_DECIMAL}"
ROWS = rf"actual rows={_DECIMAL} loops={_DECIMAL}"
PREDICTED = rf"p-time={_DECIMAL} p-rows={_DECIMAL}"
NOT_RUN = r"Actual time: (never executed|unknown)"
LABEL = r"^([\p{L}\p{N} _\-/.]+):(.*)$"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])



def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).cast("double")


def short_methods(spark: SparkSession) -> None:
    """The JVM interprets methods of more than 8000 bytes, so stages with such a one are generated by operator, in short ones. It stays so for the session."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > 8000:
        spark.conf.set(name, 8000)


def lines(plans: DataFrame, *keep: str) -> DataFrame:
    """plan_id, line_no, indent, kind (node, property, summary, blank, header, separator), label, value, trimmed of each line of explain_text.
    keep: columns of the plan to carry."""
    short_methods(plans.sparkSession)
    raw = plans.select("plan_id", *keep, F.posexplode(F.split("explain_text", "\r?\n")).alias("pos", "raw"))
    work = F.when(F.col("raw").startswith("--?"), F.substr("raw", F.lit(4))).otherwise(F.col("raw"))
    known = "|".join([t for names in V.CATEGORIES.values() for t in names] + V.UNKNOWN_NODES + ["Streaming", "Vector Streaming"])
    t, body = F.col("trimmed"), F.regexp_replace("trimmed", r"^->\s*", "")
    cost = t.rlike(COST) | t.rlike(ANY_COST)
    labelled = t.contains(":") & ~t.contains("(cost=") & ~t.contains("(actual") & F.substring_index(t, ":", 1).rlike(r"^[\p{L}\p{N} _\-/]*$")
    summary = t.rlike("^(" + "|".join(V.SUMMARY_LABELS) + ")[: ]") & t.contains(":")
    kind = (
        F.when(t == "", "blank")
        .when(t == "QUERY PLAN", "header")
        .when(t.startswith("---"), "separator")
        .when(summary, "summary")
        .when(cost | (~labelled & body.rlike(f"^({known})")), "node")
        .otherwise("property")
    )
    out = raw.select("plan_id", *keep, (F.col("pos") + 1).alias("line_no"), work.alias("work")).withColumn("trimmed", F.trim("work"))
    out = out.withColumn("indent", F.length("work") - F.length(F.ltrim("work"))).withColumn("kind", kind)
    fits = F.col("kind").isin("property", "summary") & t.rlike(LABEL)
    return out.withColumn("label", F.when(fits, F.trim(F.regexp_extract(t, LABEL, 1))).when(F.col("kind") == "property", "Raw")).withColumn(
        "value", F.when(fits, F.trim(F.regexp_extract(t, LABEL, 2))).when(F.col("kind") == "property", t)
    )


def _node_columns(df: DataFrame, *keep: str) -> DataFrame:
    """What a node's line says. keep: columns to carry."""
    t = F.col("trimmed")
    child = t.startswith("->")
    body = F.regexp_replace("trimmed", r"^->\s*", "")
    name = F.trim(F.regexp_replace(body, rf"({COST}|{ANY_COST}).*$", ""))
    name = F.regexp_replace(F.ltrim(name), r"^[0-9]*[- ]*", "")
    df = df.withColumn("text", name)
    plain = F.regexp_replace("text", r" using \S*", "")
    df = df.withColumn("plain", plain)
    p, found = F.col("plain"), None
    for j in V.JOIN_TYPES:
        label = F.lit(j.replace(" ", ""))
        inside = F.struct(F.trim(F.substring_index(p, f" {j} ", 1)).alias("name"), F.nullif(F.regexp_extract(F.substr(p, F.instr(p, f" {j} ") + len(j) + 1), r" on (\S+)", 1), F.lit("")).alias("relation"), label.alias("join_type"))
        last = F.struct(F.trim(F.substr(p, F.lit(1), F.length(p) - len(j) - 1)).alias("name"), F.lit(None).cast("string").alias("relation"), label.alias("join_type"))
        found = (F if found is None else found).when(p.contains(f" {j} "), inside).when(p.endswith(f" {j}"), last)
    nothing = F.lit(None).cast("string")
    on = F.struct(F.trim(F.substring_index(p, " on ", 1)).alias("name"), F.regexp_extract(p, r" on \s*(\S+)", 1).alias("relation"), nothing.alias("join_type"))
    parts = found.when(p.rlike(r" on \s*\S"), on).otherwise(F.struct(p.alias("name"), nothing.alias("relation"), nothing.alias("join_type")))
    moved = F.upper(F.trim(F.regexp_extract("text", r"^(?:Vector )?Streaming[^(]*\(type:\s*([^)]*)\)", 1)))
    stream = F.when(F.col("text").rlike(r"^Streaming[^(]*\(type:"), "Streaming").when(F.col("text").rlike(r"^Vector Streaming[^(]*\(type:"), "VectorStreaming")
    df = df.withColumn("parts", parts).withColumn("stream", stream)
    node_type = F.coalesce("stream", _map(V.variants())[F.col("parts.name")], F.col("parts.name"))
    run = F.when(t.rlike(NOT_RUN), F.struct(*[F.lit(x).alias(n) for x, n in ((0.0, "startup"), (0.0, "time"), (0.0, "rows"), (1.0, "loops"), (False, "executed"))]))
    run = run.when(t.rlike(TIMES), F.struct(*[_number(t, TIMES, i + 1).alias(n) for i, n in enumerate(("startup", "time", "rows", "loops"))], F.lit(True).alias("executed")))
    run = run.when(t.rlike(ROWS), F.struct(F.lit(0.0).alias("startup"), F.lit(0.0).alias("time"), _number(t, ROWS, 1).alias("rows"), _number(t, ROWS, 2).alias("loops"), F.lit(True).alias("executed")))
    has = t.rlike(COST)
    costs = [F.when(has, _number(t, COST, i + 1)).alias(n) for i, n in enumerate(("startup_cost", "total_cost", "plan_rows"))]
    return df.select(
        "plan_id", "line_no", "indent", F.when(child, F.greatest(F.floor(F.col("indent") / 2), F.lit(1))).otherwise(0).cast("int").alias("indent_level"), *keep,
        node_type.alias("node_type"), F.when(F.col("stream").isNotNull(), F.coalesce(_map(V.STREAMING)[moved], moved)).alias("streaming"),
        F.when(F.col("stream").isNull(), F.col("parts.relation")).alias("relation"), F.when(F.col("stream").isNull(), F.col("parts.join_type")).alias("join_type"),
        *costs, F.when(has, F.regexp_extract(t, COST, 4).cast("int")).alias("width"),
        F.when(has & t.rlike(PREDICTED), _number(t, PREDICTED, 1)).alias("pred_time"), F.when(has & t.rlike(PREDICTED), _number(t, PREDICTED, 2)).alias("pred_rows"),
        run.alias("run"),
    )


#: A property's first value by its label; the properties that are numbers or sizes.
def first(label: str, of: str = "props") -> str:
    return f"try_element_at(filter({of}, p -> p.label = '{label}'), 1).value"


def last(label: str, of: str = "props") -> str:
    return f"try_element_at(filter({of}, p -> p.label = '{label}'), -1).value"


def kilobytes(text: str) -> str:
    """A size with kB, MB or GB (or plain kB) as a number of kB."""
    n = f"try_cast(regexp_replace({text}, '(kB|MB|GB)$', '') AS double)"
    return f"{n} * CASE WHEN {text} LIKE '%MB' THEN 1024D WHEN {text} LIKE '%GB' THEN 1048576D ELSE 1D END"


_TYPED = {
    "removed": f"try_cast(trim({first('Rows Removed by Filter')}) AS double)",
    "filter": first("Filter"),
    "sort_key": first("Sort Key"),
    "sort_method": first("Sort Method"),
    "sort_disk": f"nullif(trim(regexp_extract({last('Sort Method')}, 'Disk:(.*)', 1)), '')",
    "hash_batches": f"try_cast(regexp_extract({last('Buckets')}, 'Batches: *([0-9]+)', 1) AS bigint)",
    "hash_memory": f"nullif(regexp_extract({last('Buckets')}, 'Memory Usage: ([^ ]+)', 1), '')",
    "partitions": last("Selected Partitions"),
}
#: For each node the places of all nodes above it, nearest first, among the plan's nodes before it; es: their indents.
_ANCESTORS = """transform(es, (e, i) -> aggregate(reverse(sequence(0, i)), named_struct('m', e, 'a', cast(array() as array<int>)),
    (acc, j) -> if(es[j] < acc.m, named_struct('m', es[j], 'a', concat(acc.a, array(j))), acc), acc -> acc.a))"""


def widened(plans: DataFrame, *more: str) -> DataFrame:
    """Adds fields, expressions over ns and a node n, to every node."""
    fields = plans.schema["ns"].dataType.elementType.names
    return plans.withColumn("ns", F.expr(f"transform(ns, n -> struct({', '.join([f'n.{x} AS {x}' for x in fields] + list(more))}))"))


def parse(plans: DataFrame) -> DataFrame:
    """One row a plan with nodes: plan_id, total_runtime, peak_memory, ns (nodes in order of lines).

    A text with several plans counts for its first one: what follows a summary line or a rule line behind the first node, from the next header
    or the next node without an indent on, is left out (``parse_each`` takes all). A plan without a node gives no row (see ``parse_status``);
    lines before the first node belong to none.
    """
    return _parsed(_blocks(lines(plans)).where("block <= 1").drop("block"))


def parse_each(plans: DataFrame) -> DataFrame:
    """As ``parse``, but a row for every plan of a text: plan_id is a struct of the text's plan_id and the plan's number, from 1."""
    return _parsed(_blocks(lines(plans)).withColumn("plan_id", F.struct("plan_id", F.greatest("block", F.lit(1)).alias("number"))).drop("block"))


def parse_status(plans: DataFrame) -> DataFrame:
    """plan_id and status (ok, empty, no plan) of every text."""
    found = lines(plans).groupBy("plan_id").agg(F.count_if(F.col("kind") == "node").alias("n"), F.count_if(F.col("kind") != "blank").alias("full"))
    return found.select("plan_id", F.when(F.col("n") > 0, "ok").when(F.col("full") == 0, "empty").otherwise("no plan").alias("status"))


def _opens() -> Column:
    """Of a line that can start a plan: h for a header, n for a node that isn't a child."""
    root = (F.col("kind") == "node") & ~F.col("trimmed").startswith("->") & ~F.col("trimmed").rlike(r"^\d+ --")
    return F.when(F.col("kind") == "header", "h").when(root & (F.col("indent") <= 1), "n")


def _blocks(told: DataFrame) -> DataFrame:
    """Adds block, the number of the plan in its text, from 1 (0 before the first): a header starts one, and so does a node that isn't a child."""
    w = Window.partitionBy("plan_id").orderBy("line_no")
    opens = _opens()
    last = F.last(opens, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # a node opens a plan unless a header has just done so
    return told.withColumn("block", F.sum(F.when((opens == "h") | ((opens == "n") & F.coalesce(last == "n", F.lit(True))), 1).otherwise(0)).over(w))


def _parsed(told: DataFrame) -> DataFrame:
    w = Window.partitionBy("plan_id").orderBy("line_no")
    numbered = told.withColumn("node_no", F.sum(F.when(F.col("kind") == "node", 1).otherwise(0)).over(w))
    kept = numbered.where("kind in ('node', 'property', 'summary')")
    prop = F.when(F.col("kind") == "property", F.struct("line_no", "label", "value"))
    told = F.when(F.col("kind") == "summary", F.struct("line_no", "label", "value"))
    groups = kept.groupBy("plan_id", "node_no").agg(
        F.min(F.when(F.col("kind") == "node", F.struct("line_no", "indent", "trimmed"))).alias("node"),
        F.transform(F.array_sort(F.collect_list(prop)), lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"))).alias("props"),
        F.collect_list(told).alias("summary"),
    )
    nodes = _node_columns(groups.select("plan_id", "node_no", "node.*", "props", "summary"), "node_no", "props", "summary")
    typed = nodes.withColumns({k: F.expr(v) for k, v in _TYPED.items()})
    peak = F.expr(f"coalesce(try_cast(regexp_replace(trim({last('Peak Memory')}), 'kB$', '') AS double), {kilobytes('hash_memory')}, {kilobytes('sort_disk')})")
    typed = typed.withColumn("peak_kb", peak).withColumn("ord", (F.col("node_no") - 1).cast("int"))
    typed = typed.withColumn("e", F.when(F.col("ord") == 0, -1).otherwise(F.col("indent"))).drop("node_no")
    fields = ["ord", *[c for c in typed.columns if c not in ("plan_id", "ord", "summary")]]
    # lines before a plan's first node have a row without line_no, which counts for its summary lines only
    own = F.when(F.col("line_no").isNotNull(), F.struct(*fields))
    whole = typed.groupBy("plan_id").agg(F.array_sort(F.collect_list(own)).alias("ns"), F.flatten(F.collect_list("summary")).alias("s")).where(F.size("ns") > 0)
    whole = whole.withColumn("es", F.expr("transform(ns, n -> n.e)")).withColumn("up", F.expr(_ANCESTORS))
    whole = widened(whole, "up[n.ord] AS ancestors", "get(up[n.ord], 0) AS parent", "size(up[n.ord]) + 1 AS depth")

    def value(label):
        return F.expr(f"split(try_element_at(filter(array_sort(s), x -> lower(x.label) = '{label.lower()}'), -1).value, ' ')[0]")

    names = {"total_runtime": "Total runtime", "peak_memory": "Peak Memory", "planner_runtime": "Planner runtime", "plan_size": "Plan size", "executor_start": "Executor Start", "executor_run": "Executor Run", "executor_end": "Executor End", "total_network": "Total Network"}
    return whole.select("plan_id", "ns", *[value(v).try_cast("double").alias(k) for k, v in names.items()], F.expr("try_element_at(filter(array_sort(s), x -> lower(x.label) = 'query id'), -1).value").alias("query_id"))


#: From an array `lines` to its plan's facts, none without a node. A step binds a name by a lambda, so that no step is computed for each line. cut:
#: the line at which a second plan starts (see _blocks). A node's last sort method counts.
_OUTLINE = """transform(transform(filter(transform(transform(array(lines),
    x -> named_struct('x', x, 'cut', aggregate(filter(x, l -> l.opens IS NOT NULL), named_struct('block', 0, 'last', CAST(NULL AS STRING), 'cut', 2147483647),
        (a, l) -> named_struct('block', a.block + if(l.opens = 'h' OR coalesce(a.last = 'n', true), 1, 0), 'last', l.opens,
            'cut', if(a.block = 1 AND (l.opens = 'h' OR coalesce(a.last = 'n', true)), l.line_no, a.cut)), a -> a.cut))),
    s -> named_struct('x', filter(s.x, l -> l.line_no < s.cut), 'first', get(filter(s.x, l -> l.node AND l.line_no < s.cut), 0))),
    s -> s.first IS NOT NULL),
    s -> named_struct('first', s.first, 'told', try_element_at(filter(s.x, l -> l.runtime IS NOT NULL), -1).runtime, 'x', filter(s.x, l -> l.line_no >= s.first.line_no),
        't', filter(s.x, l -> l.line_no >= s.first.line_no AND l.text IS NOT NULL))),
    s -> named_struct('runtime', coalesce(try_cast(split(s.told, ' ')[0] AS double), s.first.time),
        'disk', aggregate(s.x, named_struct('all', 0D, 'own', 0D), (a, l) -> named_struct('all', a.all + if(l.node, a.own, 0D), 'own', if(l.node, 0D, coalesce(l.disk, a.own))), a -> a.all + a.own),
        'outline', array_join(transform(s.t, (l, i) -> CASE WHEN i = 0 THEN l.text WHEN l.node THEN concat('\\n', l.text) WHEN s.t[i - 1].node THEN l.text ELSE concat(';', l.text) END), '')))"""


def outlines(plans: DataFrame, conditions: list[str], *keep: str) -> DataFrame:
    """plan_id, keep, runtime (as parse's total_runtime, or else the first node's time), disk (kB of all sorts) and outline (analytics.outline of the
    nodes) of each text's first plan, if it has nodes: the same as from parse, but lines go straight to their plan and no node is put together.
    plan_id must be unique. conditions: the labels of properties that an outline has."""
    node, prop = F.col("kind") == "node", F.col("kind") == "property"
    l = lines(plans, *keep).withColumn("opens", _opens()).withColumn("trimmed", F.when(node, F.col("trimmed")))
    runtime = F.when((F.col("kind") == "summary") & (F.lower("label") == "total runtime"), F.col("value"))
    method = F.when(prop & (F.col("label") == "Sort Method"), F.col("value"))
    l = l.withColumns({"runtime": runtime, "method": method, "condition": F.when(prop & F.col("label").isin(conditions), F.concat("label", F.lit("="), "value"))})
    n = _node_columns(l, *keep, "kind", "opens", "runtime", "method", "condition")
    head = F.concat_ws("|", "node_type", F.coalesce("streaming", F.lit("")), F.coalesce("relation", F.lit("")), F.lit(""))
    disk = F.expr("if(method IS NULL, NULL, coalesce(try_cast(regexp_replace(nullif(trim(regexp_extract(method, 'Disk:(.*)', 1)), ''), 'kB$', '') AS double), 0D))")
    line = F.struct("line_no", "opens", node.alias("node"), F.when(node, head).otherwise(F.col("condition")).alias("text"), disk.alias("disk"), F.col("run.time").alias("time"), "runtime")
    # what isn't needed is left out here: a filter would be pushed down and tell lines' kinds again
    needed = F.when(node | F.coalesce("opens", "runtime", "method", "condition").isNotNull(), line)
    p = n.groupBy("plan_id", *keep).agg(F.array_sort(F.collect_list(needed)).alias("lines"))
    return p.select("plan_id", *keep, F.inline(F.expr(_OUTLINE)))


#: What a node tells the nodes around it.
_THIN = ("ord", "parent", "ancestors")


def nodes(parsed: DataFrame, *told: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a node with kids, sub (all below) and above (all above, nearest first), of which each has ord, parent, ancestors and what ``told`` names
    (fields or expressions over a node n). keep: columns of the plan to carry."""
    thin = ", ".join([f"n.{x} AS {x}" for x in _THIN] + list(told))
    p = parsed.select("plan_id", "ns", *keep, F.expr(f"transform(ns, n -> struct({thin}))").alias("thin"))
    around = """transform(thin, n -> struct(filter(thin, k -> k.parent = n.ord) AS kids, filter(thin, d -> array_contains(d.ancestors, n.ord)) AS sub,
        transform(n.ancestors, a -> thin[a]) AS above))"""
    return p.select("plan_id", *keep, F.explode(F.arrays_zip("ns", F.expr(around).alias("around"))).alias("x")).select("plan_id", *keep, "x.ns.*", "x.around.*")
