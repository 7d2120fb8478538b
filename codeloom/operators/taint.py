"""Untrusted data through functions and files. Each function is summed up by what it hands on: which parameters reach its result,
which reach a sink, which sources reach its result. Summaries are joined with the calls of the functions, round by round, until
nothing is new; only what the last round found is joined again, so recursion ends. Calls are resolved by the symbol table. What
no file defines, constructors included, hands its arguments on; starred arguments and closures are not followed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Tables
from . import symbols

SEVERITY = {"sql": "critical", "command": "critical", "file": "high", "pickle": "high"}
_REACH = ("file_id", "scope", "origin", "place", "call", "key")


def _of(found: DataFrame, kind: str) -> DataFrame:
    return found.filter((F.col("analyzer") == "flows") & (F.col("kind") == kind))


def local_flows(found: DataFrame) -> DataFrame:
    """_REACH and `result` (the call whose result flows, else null). Sources and sinks carry their file. place is r, k|... or null,
    in which case call and key say whose argument it is."""
    came, to = F.split("name", "[|]"), F.split("detail", "[|]")
    first = F.substring("name", 1, 1)
    origin = F.when(first == "p", F.col("name")).when(first == "s", F.concat_ws("|", F.lit("s"), "file_id", came[1], came[2]))
    place = F.when(F.col("detail") == "r", F.col("detail")).when(to[0] == "k", F.concat_ws("|", F.lit("k"), "file_id", to[1], to[2], to[3]))
    argument = to[0] == "a"
    return _of(found, "flow").select(
        "file_id", "scope", origin.alias("origin"), F.when(first == "c", came[1]).alias("result"), place.alias("place"), F.when(argument, to[1]).alias("call"), F.when(argument, to[2]).alias("key")
    ).distinct()


def calls_of(resolved: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, scope, call, to_file, to_scope (null: not a function of the files)."""
    own = symbols.own_calls(resolved, found, symbols.ancestors(resolved)).select("file_id", "scope", F.col("place").alias("call"), F.col("target_file").alias("own_file"), F.col("target").alias("own"))
    calls = resolved.filter("role = 'call'").select("file_id", "scope", F.col("place").alias("call"), "target_file", "target", F.col("target_role").isin("function", "method").alias("known"))
    both = calls.hint("merge").join(own, ["file_id", "scope", "call"], "left")
    pick = lambda a, b: F.coalesce(F.when(F.col("known"), F.col(a)), F.col(b))
    return both.select("file_id", "scope", "call", pick("target_file", "own_file").alias("to_file"), pick("target", "own").alias("to_scope"))


def reach(found: DataFrame) -> DataFrame:
    """_REACH over all functions: every parameter and source with every place that it reaches, through any calls."""
    stored = Tables()
    resolved = symbols.resolve(symbols.references(found).filter("role in ('call', 'base')"), found)
    calls = stored(calls_of(resolved, found), "calls")
    flows = stored(local_flows(found), "flows")
    parameters = stored(_of(found, "parameter").select(F.col("file_id").alias("to_file"), F.col("scope").alias("to_scope"), F.col("name").alias("key"), F.concat(F.lit("p|"), "detail").alias("parameter")).distinct(), "parameters")
    # what comes out of a call goes on from there
    onward = flows.filter("result is not null").select("file_id", "scope", F.col("result").alias("at"), "place", "call", "key")
    unknown = calls.filter("to_scope is null").select("file_id", "scope", "call")
    # a call by something else than a name is in no reference, and is as unknown
    nameless = flows.filter("call is not null").select("file_id", "scope", "call").distinct().hint("merge").join(calls, ["file_id", "scope", "call"], "left_anti")
    unknown = stored(unknown.unionByName(nameless), "unknown")
    called = calls.filter("to_scope is not null")

    def enter(arguments: DataFrame) -> DataFrame:
        """file_id, scope, origin, call, and the function and parameter that an argument becomes."""
        return arguments.filter("call is not null").hint("merge").join(called, ["file_id", "scope", "call"]).hint("merge").join(parameters, ["to_file", "to_scope", "key"]).select("file_id", "scope", "origin", "call", "to_file", "to_scope", "parameter")

    def leave(out: DataFrame) -> DataFrame:
        """out: file_id, scope, origin, call of results that carry the origin."""
        return out.select("file_id", "scope", "origin", F.col("call").alias("at")).distinct().hint("merge").join(onward, ["file_id", "scope", "at"]).select(*_REACH)

    def summary(rows: DataFrame, kind: str) -> DataFrame:
        of = rows.select(F.col("file_id").alias("to_file"), F.col("scope").alias("to_scope"), F.col("origin").alias("parameter"), "place")
        return of.filter(F.col("parameter").startswith("p|") & (F.col("place") == "r" if kind == "r" else F.col("place").startswith("k|")))

    on = ["to_file", "to_scope", "parameter"]
    every = new = stored(flows.filter("origin is not null").select(*_REACH), "reach")
    entered = stored(enter(new), "entered")
    first = True
    while first or not new.isEmpty():
        fresh = entered if first else stored(enter(new), "entered")
        entered = entered if first else stored(entered.unionByName(fresh), "entered")
        pairs = [(fresh, every)] + ([] if first else [(entered, new)])
        results = reduce(DataFrame.unionByName, [a.hint("merge").join(summary(b, "r"), on).select("file_id", "scope", "origin", "call") for a, b in pairs])
        passed = new.filter("call is not null").hint("merge").join(unknown, ["file_id", "scope", "call"]).select("file_id", "scope", "origin", "call")
        brought = new.filter("place = 'r' and origin like 's|%'").select(F.col("file_id").alias("to_file"), F.col("scope").alias("to_scope"), "origin").hint("merge").join(called, ["to_file", "to_scope"]).select("file_id", "scope", "origin", "call")
        no = F.lit(None).cast("string")
        sunk = [a.hint("merge").join(summary(b, "k"), on).select("file_id", "scope", "origin", "place", no.alias("call"), no.alias("key")) for a, b in pairs]
        found_now = reduce(DataFrame.unionByName, [leave(results.unionByName(passed).unionByName(brought)), *sunk]).distinct()
        known = every.select("file_id", "scope", "origin", "place", "call", "key", F.lit(True).alias("known"))
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in _REACH]
        new = stored(found_now.alias("n").hint("merge").join(known.alias("o"), reduce(lambda a, b: a & b, same), "left_anti"), "new")
        every = stored(every.unionByName(new), "reach")
        first = False
    stored.drop(keep=every)
    return every


def flows(found: DataFrame) -> DataFrame:
    """source_file, source_line, source, sink_file, sink_line, sink, kind, severity of every source that reaches a sink, found: the
    facts of the detectors `symbols` and `flows`."""
    hit = reach(found).filter("origin like 's|%' and place like 'k|%'").select("origin", "place").distinct()
    s, k = F.split("origin", "[|]"), F.split("place", "[|]")
    severity = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return hit.select(
        s[1].alias("source_file"), s[2].cast("int").alias("source_line"), s[3].alias("source"), k[1].alias("sink_file"), k[3].cast("int").alias("sink_line"), k[4].alias("sink"), k[2].alias("kind"), severity[k[2]].alias("severity")
    )


def issues(found: DataFrame) -> DataFrame:
    """The flows as findings at the sink, in the form of engine.issues."""
    title = F.concat(F.upper("kind"), F.lit(" injection vulnerability"))
    detail = F.concat("source", F.lit(" in "), "source_file", F.lit(":"), F.col("source_line").cast("string"))
    return flows(found).select(F.col("sink_file").alias("file_id"), F.lit("security").alias("analyzer"), "severity", F.concat(F.lit("TAINT_"), F.upper("kind")).alias("rule_id"), title.alias("title"), F.col("sink_line").alias("line_number"), detail.alias("detail")).distinct()
