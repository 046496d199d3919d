"""The read-only gate of the query escape hatch.

A query is parsed before anything of it runs, and every part of its plan must be on a list: kinds of plan nodes, functions,
and relations, which are ``nodes``, ``edges`` and what the query names itself. So nothing can write, set, call into the JVM,
start a script, or read a file or table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators.neighbours import limited

# Words that write, and procedures that only read.
WRITES = [r"\bCREATE\b", r"\bDELETE\b", r"\bDETACH\b", r"\bSET\b", r"\bREMOVE\b", r"\bMERGE\b", r"\bDROP\b", r"\bFOREACH\b", r"\bLOAD\s+CSV\b", r"\bCOPY\b"]
READ_ONLY_CALLS = ("db.", "show_", "table_", "current_setting", "table_info", "query_fts_index")

#: Kinds of plan nodes that only read.
PLANS = set("""Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Union Intersect Except Distinct SubqueryAlias OneRowRelation UnresolvedRelation
UnresolvedWith WithWindowDefinition UnresolvedHaving UnresolvedInlineTable UnresolvedSubqueryColumnAliases Generate Pivot Unpivot Tail Sample UnresolvedTVFAliases""".split())
#: Functions of rows, groups and windows: nothing that sees files, sessions, clocks, classes or other programs.
FUNCTIONS = set("""abs acos any any_value approx_count_distinct array array_agg array_append array_compact array_contains array_distinct array_except array_insert array_intersect array_join array_max
array_min array_position array_prepend array_remove array_repeat array_size array_sort array_union arrays_overlap arrays_zip ascii avg bigint bit_and bit_count bit_length bit_or bit_xor bool_and bool_or
boolean btrim cast cbrt ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if crc32 cume_dist date day dense_rank double element_at
elt endswith every exists exp explode explode_outer filter find_in_set first first_value flatten float floor forall format_number format_string get greatest hash hex if ifnull initcap inline instr int isnan
isnotnull isnull json_array_length kurtosis lag last last_value lcase lead least left len length levenshtein ln locate log log10 log2 lower lpad ltrim map map_concat map_contains_key map_entries
map_filter map_from_arrays map_from_entries map_keys map_values max max_by md5 mean median min min_by mod mode month named_struct not nth_value ntile nullif nvl nvl2 octet_length overlay percent_rank
percentile pmod posexplode posexplode_outer position positive pow power quarter rank reduce regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regexp_substr repeat replace reverse right
round row_number rpad rtrim sequence sha sha1 sha2 shiftleft shiftright sign sin size skewness slice some sort_array soundex split split_part sqrt startswith std stddev string struct substr substring
substring_index sum tan to_json transform transform_keys transform_values translate trim try_add try_cast try_divide try_element_at try_sum typeof ucase unhex upper var_pop var_samp variance when xxhash64 year
zip_with""".split())
RELATIONS = {"nodes", "edges"}


def mutation_keyword(query: str) -> str | None:
    """The first word by which a graph query would write, or None; comments don't count."""
    text = re.sub(r"//[^\n]*", " ", re.sub(r"/\*[\s\S]*?\*/", " ", query))
    hits = [(m.start(), m[0].upper()) for p in WRITES if (m := re.search(p, text, re.I))]
    hits += [(m.start(), f"CALL {m[1]}") for m in re.finditer(r"\bCALL\s+(\w+(?:\.\w+)?)", text, re.I) if not m[1].lower().startswith(READ_ONLY_CALLS)]
    return min(hits)[1] if hits else None


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def objection(spark: SparkSession, sql: str) -> str | None:
    """What in ``sql`` isn't on the lists, or None where all of it only reads the graph. Nothing of it runs."""
    try:
        top = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return "it can't be parsed as one query"
    plan_class, named = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"), set()
    seen, queue = [], [top]
    while queue:  # first the names that the query gives to parts of itself
        at = queue.pop()
        kind = at.getClass().getSimpleName()
        seen.append((kind, at))
        if kind == "UnresolvedWith":
            named |= {alias.alias().lower() for alias in _each(at.innerChildren())}
            queue += _each(at.innerChildren())
        queue += _each(at.children())
        if plan_class.isInstance(at):
            queue += _each(at.expressions())
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery") and hasattr(at, "plan"):
            queue.append(at.query() if kind == "InSubquery" else at.plan())
    for kind, at in seen:
        if plan_class.isInstance(at):
            if kind not in PLANS:
                return f"{kind} isn't allowed"
            if kind == "UnresolvedRelation":
                parts = [str(x) for x in _each(at.multipartIdentifier())]
                if len(parts) != 1 or parts[0].lower() not in RELATIONS | named:
                    return f"no table is called {'.'.join(parts)}"
        elif kind == "UnresolvedFunction":
            parts = [str(x) for x in _each(at.nameParts())]
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                return f"the function {'.'.join(parts)} isn't allowed"
        elif kind == "UnresolvedGenerator":
            if str(at.name().funcName()).lower() not in FUNCTIONS:
                return f"the function {at.name().funcName()} isn't allowed"
        elif not at.getClass().getName().startswith(("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.analysis.")) or "Reflection" in kind or kind in ("UnresolvedTableValuedFunction", "ExpressionWithUnresolvedIdentifier", "Parameter"):
            return f"{kind} isn't allowed"
    return None


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """Whether ``sql`` is a query of the graph that only reads."""
    return objection(spark, sql) is None


def run_query(spark: SparkSession, sql: str, nodes: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """A read-only SQL query over ``{nodes}`` and ``{edges}``, at most ``limit`` rows. A ValueError if it does anything else."""
    return checked(spark, sql, nodes, edges).limit(max(1, limit))


def checked(spark: SparkSession, sql: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    against = objection(spark, sql.replace("{nodes}", "nodes").replace("{edges}", "edges"))
    if against or re.search(r"\{(?!nodes\}|edges\})", sql):
        raise ValueError(f"only queries that read nodes and edges are allowed: {against or 'a brace names something else'}")
    used = {k: v for k, v in (("nodes", nodes), ("edges", edges)) if "{" + k + "}" in sql}
    return spark.sql(sql, **used)


@dataclass(frozen=True)
class Result:
    """Rows of a query, as many as the limit at most, and whether there were more."""

    rows: DataFrame
    truncated: bool
    limit: int

    def table(self) -> str:
        """The rows as text in columns, in order of their names; '' where there are none."""
        names = sorted(self.rows.columns)
        rows = [["" if x is None else str(x) for x in (r[c] for c in names)] for r in self.rows.collect()]  # up to the limit
        if not rows:
            return ""
        wide = [max(len(r[i]) for r in [names, *rows]) for i in range(len(names))]
        return "".join("  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() + "\n" for r in [names, *rows])


def query_result(spark: SparkSession, sql: str, nodes: DataFrame, edges: DataFrame, limit: int = 500) -> Result:
    """``run_query`` with whether rows were left out."""
    rows, more = limited(checked(spark, sql, nodes, edges), limit)
    return Result(rows, more, max(1, limit))
