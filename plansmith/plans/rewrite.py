"""Updates that compute a value from their own table by a correlated subquery, rewritten to one grouped subquery in FROM."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from plansmith.registry import query

_HEAD = re.compile(r"^\s*UPDATE\s+([\w.\"]+)(?:\s+(?:AS\s+)?(?!SET\b)(\w+))?\s+SET\s+", re.I)


@dataclass(frozen=True)
class SelfUpdate:
    """An update whose column takes a subquery over its own table."""

    table: str
    alias: str
    column: str
    value: str  #: what the subquery selects
    source: str  #: what it reads, and as what
    keys: tuple[str, ...]  #: columns that tie it to the updated row
    inner: str  #: its other conditions
    outer: str  #: the update's own condition


def _closing(text: str, at: int) -> int:
    depth, quoted = 0, False
    for i in range(at, len(text)):
        if text[i] == "'":
            quoted = not quoted
        elif not quoted:
            depth += (text[i] == "(") - (text[i] == ")")
            if depth == 0:
                return i
    return -1


def detect(sql: str) -> SelfUpdate | None:
    """The first assignment of a parenthesised subquery that reads the updated table; None if there is none or it isn't tied by equal columns."""
    head = _HEAD.match(sql)
    if not head:
        return None
    table, alias = head[1], head[2] or head[1].split(".")[-1]
    for found in re.finditer(r"(\w+)\s*=\s*\(\s*(?=SELECT\b)", sql[head.end() :], re.I):
        open_at = head.end() + found.end() - 1
        open_at = sql.rindex("(", 0, open_at + 1)
        close = _closing(sql, open_at)
        body = re.match(r"\s*SELECT\s+(.*?)\s+FROM\s+([\w.\"]+)(?:\s+(?:AS\s+)?(?!WHERE\b)(\w+))?(?:\s+WHERE\s+(.*))?$", sql[open_at + 1 : close], re.I | re.S)
        if close < 0 or not body or body[2].split(".")[-1].lower() != table.split(".")[-1].lower():
            continue
        inside = body[3] or body[2]
        keys, rest = [], []
        for c in re.split(r"\s+AND\s+", body[4] or "", flags=re.I):
            tie = re.fullmatch(r"\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*", c)
            if tie and {tie[1], tie[3]} == {inside, alias} and tie[2] == tie[4]:
                keys.append(tie[2])
            elif c.strip():
                rest.append(c.strip())
        if not keys:
            continue
        after = re.match(r"\s*WHERE\s+(.*?);?\s*$", sql[close + 1 :], re.I | re.S)
        return SelfUpdate(table, alias, found[1], body[1], f"{body[2]} {inside}", tuple(keys), " AND ".join(rest), after[1] if after else "")
    return None


def to_update_from(u: SelfUpdate) -> str:
    """UPDATE … FROM with the subquery grouped by the columns that tie it."""
    inside = u.source.split()[-1]
    keys = ", ".join(f"{inside}.{k}" for k in u.keys)
    where = f" WHERE {u.inner}" if u.inner else ""
    ties = " AND ".join(f"{u.alias}.{k} = sub.{k}" for k in u.keys)
    target = u.table if u.alias == u.table.split(".")[-1] else f"{u.table} {u.alias}"
    return f"UPDATE {target} SET {u.column} = sub.value FROM (SELECT {keys}, {u.value} AS value FROM {u.source}{where} GROUP BY {keys}) sub WHERE {ties}" + (f" AND ({u.outer})" if u.outer else "")


def rewritten(sql: str | None) -> str | None:
    found = detect(sql) if sql else None
    return to_update_from(found) if found else None


_BEFORE = "UPDATE emp e SET pay = (SELECT avg(x.pay) FROM emp x WHERE x.dept = e.dept AND x.old = 0) WHERE e.pay IS NULL"
_AFTER = "UPDATE emp e SET pay = sub.value FROM (SELECT x.dept, avg(x.pay) AS value FROM emp x WHERE x.old = 0 GROUP BY x.dept) sub WHERE e.dept = sub.dept AND (e.pay IS NULL)"


@query(f"SELECT * FROM (VALUES (1, '{_AFTER}'), (2, NULL)) AS t(sql_id, rewrite)")
def rewrite_self_update(spark, sf_dir):
    rows = spark.createDataFrame([(1, _BEFORE), (2, "UPDATE emp SET pay = 1 WHERE k = 2")], "sql_id int, sql string")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rewritten(x) for x in b.column(1).to_pylist()], pa.string())], ["sql_id", "rewrite"])

    return rows.mapInArrow(run, "sql_id int, rewrite string").select("sql_id", F.col("rewrite"))
