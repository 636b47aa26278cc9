"""Read-only SQL under a policy: Spark's own parser reads the text, and the policy judges the plan it gives.

Names are judged by scope. A WITH gives its names to its own query and to the definitions that come after each; a definition
does not see itself (recursion aside) or those after it, and sub-queries see what holds where they stand. A name that no
definition gives in its scope is a table, and must be allowed. The allowed tables are registered under names that no one
else has, and reach the query as definitions around it: the caller's own views stay as they are, and whatever else the session
holds can't be meant.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

MOST_ROWS, MOST_MS = 500, 30_000


class PolicyError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return max(low, min(high, default if value is None else value))


#: Parts of a parsed query that only read and shape rows.
NODES = frozenset(
    """Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit
    Offset OneRowRelation Pivot Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedOrdinal UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedWith Unpivot Window WithCTE WithWindowDefinition""".split()
)
#: Functions a query may call: they read nothing but their arguments.
FUNCTIONS = frozenset(
    """abs any any_value approx_count_distinct approx_percentile array array_agg array_contains array_distinct array_join array_max array_min array_size array_sort
    ascii avg bigint bool_and bool_or boolean btrim bround cast ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws
    contains corr count count_if covar_pop covar_samp cume_dist current_date date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc
    datediff day dayofmonth dayofweek dayofyear decimal dense_rank double element_at endswith every exp explode extract filter find_in_set first first_value
    flatten float floor format_number format_string from_json from_unixtime get get_json_object greatest hour if ifnull initcap instr int isnan isnotnull isnull
    json_array_length lag last last_day last_value lcase lead least left length levenshtein like ln locate log log10 log2 lower lpad ltrim make_date
    map map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between named_struct next_day nth_value ntile nullif nvl nvl2
    overlay percent_rank percentile percentile_approx pmod posexplode position pow power quarter rank regexp_count regexp_extract regexp_extract_all
    regexp_like regexp_replace regexp_substr regr_r2 regr_slope repeat replace reverse right rlike round row_number rpad rtrim second sequence sha1 sha2 sign
    signum size slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring substring_index sum
    timestamp to_char to_date to_number to_timestamp transform translate trim trunc try_add try_cast try_divide try_element_at try_multiply try_subtract
    try_sum try_to_number ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear when year""".split()
)


#: Functions whose result is as long as an argument says: the argument that says it (from 0), a whole number in the text.
SIZED = {"repeat": 1, "lpad": 1, "rpad": 1}
LONGEST = 10_000


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())] if seq is not None else []


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _whole(e) -> int | None:
    """A whole number written in the text."""
    if _kind(e) == "UnaryMinus":
        n = _whole(e.child())
        return None if n is None else -n
    if _kind(e) != "Literal":
        return None
    text = str(e.toString())
    return int(text) if text.lstrip("-").isdigit() else None


def _oversized(name: str, arguments: list) -> bool:
    if name in SIZED:
        n = _whole(arguments[SIZED[name]]) if len(arguments) > SIZED[name] else None
        return n is None or n > LONGEST
    if name == "sequence":
        ends = [_whole(a) for a in arguments]
        return None in ends or len(ends) < 2 or abs(ends[1] - ends[0]) / max(1, abs(ends[2]) if len(ends) > 2 else 1) >= LONGEST
    return False


class _Parts:
    """Of a parsed query: names of the tables it reads, kinds of its nodes, names of its functions, and those of its
    functions whose results may be of any size."""

    def __init__(self, plan, case_sensitive: bool = False):
        self.tables, self.kinds, self.functions, self.oversized = set(), set(), set(), set()
        self.key = (lambda name: name) if case_sensitive else str.lower
        self._visit(plan, frozenset())

    def _visit(self, plan, scope: frozenset[str]) -> None:
        stack = [(plan, scope)]
        while stack:
            node, names = stack.pop()
            kind = _kind(node)
            self.kinds.add(kind)
            if kind == "UnresolvedRelation":
                parts = _items(node.multipartIdentifier())
                if len(parts) > 1 or self.key(parts[0]) not in names:
                    self.tables.add(".".join(parts))
            if kind == "UnresolvedWith":
                for definition in _items(node.cteRelations()):
                    own = self.key(definition._1())
                    stack.append((definition._2(), names | {own} if node.allowRecursion() else names))
                    names = names | {own}
            # The definitions of a WITH are inner children too: they have been seen, each in its scope.
            inner = [] if kind == "UnresolvedWith" else _items(node.innerChildren())
            stack += [(c, names) for c in [*_items(node.children()), *inner] if hasattr(c, "nodeName")]
            walk = _items(node.expressions()) if hasattr(node, "expressions") else []
            while walk:
                e = walk.pop()
                name = _kind(e)
                if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                    stack.append((e.plan(), names))
                if name in ("UnresolvedFunction", "UnresolvedGenerator"):
                    full = ".".join(p.lower() for p in _items(e.nameParts() if name == "UnresolvedFunction" else e.name().nameParts()))
                    self.functions.add(full)
                    if _oversized(full, _items(e.arguments() if name == "UnresolvedFunction" else e.children())):
                        self.oversized.add(full)
                walk += _items(e.children())


def check(spark: SparkSession, sql: str, allowed: set[str]) -> None:
    """Exactly one query of allowed parts, functions and tables; each refusal has its code."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise PolicyError("invalid_sql", str(e).split("\n")[0]) from None
    except Exception as e:
        raise PolicyError("invalid_sql", str(e).split("\n")[0]) from None
    parts = _Parts(plan, spark.conf.get("spark.sql.caseSensitive", "false") == "true")
    if any(k.endswith("TableValuedFunction") for k in parts.kinds):
        raise PolicyError("function_not_allowed", "table function")
    if odd := sorted(parts.kinds - NODES):
        raise PolicyError("not_read_only", ", ".join(odd))
    if odd := sorted(parts.functions - FUNCTIONS):
        raise PolicyError("function_not_allowed", ", ".join(odd))
    if parts.oversized:
        raise PolicyError("unbounded_function", ", ".join(sorted(parts.oversized)))
    known = {parts.key(name) for name in allowed}
    if outside := sorted(t for t in parts.tables if parts.key(t) not in known):
        raise PolicyError("relation_not_allowed", ", ".join(outside))


def rows_within(df: DataFrame, milliseconds: int | None = None) -> list:
    """Collect a limited result; its jobs are cancelled when the time is over."""
    context = df.sparkSession.sparkContext
    tag = f"governed-{uuid.uuid4().hex}"
    timer = threading.Timer(clamp(milliseconds, 1, MOST_MS, MOST_MS) / 1000, context.cancelJobsWithTag, [tag])
    context.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if not timer.is_alive():
            raise PolicyError("timeout") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def governed_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """The query's rows, limited; `tables` are all it may read, by names of one part. A query without rows of its own order
    may give any `limit` of its rows."""
    check(spark, sql, set(tables))
    views = {name: f"governed_{uuid.uuid4().hex}" for name in tables}
    for name, rows in tables.items():
        rows.createOrReplaceTempView(views[name])
    around = ", ".join(f"`{name.replace('`', '``')}` AS (SELECT * FROM {view})" for name, view in views.items())
    # The text has been parsed alone, so its brackets and comments end within it; a comment to the line's end stops there.
    wrapped = f"WITH {around} SELECT * FROM (\n{sql.strip().rstrip(';')}\n)" if views else sql
    try:  # the plan is made here: the views are not needed after it
        return spark.sql(wrapped).limit(clamp(limit, 1, MOST_ROWS, 100))
    except ParseException as e:
        raise PolicyError("invalid_sql", str(e).split("\n")[0]) from None
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
