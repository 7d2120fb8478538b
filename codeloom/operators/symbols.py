"""Names resolved over files: what a written name stands for, classes and their ancestors, coupling by resolved class, overrides
that break their base. Everything is an equi-join of facts (detect/symbols.py); rounds go on until no name moves any more, and
each round's result is written, so a plan never grows with the length of a chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Tables

#: Written names that start from the object itself
OWN = ("self", "cls")


def _of(found: DataFrame, kind: str) -> DataFrame:
    return found.filter((F.col("analyzer") == "symbols") & (F.col("kind") == kind))


def modules(found: DataFrame) -> DataFrame:
    """file_id, module. Of files with one module name, the one with the least file_id stands for it."""
    return _of(found, "module").groupBy(F.col("name").alias("module")).agg(F.min("file_id").alias("file_id"))


def definitions(found: DataFrame) -> DataFrame:
    """file_id, module, name (dotted, within the module), role (class, method, function), line_number, and of functions required,
    total, open, raises. Of several definitions of a name, the last one counts."""
    last = _of(found, "definition").groupBy("file_id", "name").agg(F.max_by(F.struct(F.col("title").alias("role"), "line_number", "detail"), "seq").alias("d"))
    part = lambda k, kind: F.element_at(F.split("d.detail", ","), k).cast(kind)
    shape = [part(1, "int").alias("required"), part(2, "int").alias("total"), part(3, "int").cast("boolean").alias("open"), part(4, "int").cast("boolean").alias("raises")]
    return last.hint("merge").join(modules(found), "file_id").select("file_id", "module", "name", "d.role", "d.line_number", *shape)


def aliases(found: DataFrame) -> DataFrame:
    """module, name ("*": every name of the target), target (absolute). Of several imports of a name, the last one counts; imports
    within functions count for the whole module."""
    each = _of(found, "alias").hint("merge").join(modules(found), "file_id")
    star = each.filter("name = '*'").select("module", "name", F.col("detail").alias("target")).distinct()
    return each.filter("name <> '*'").groupBy("module", "name").agg(F.max_by("detail", "seq").alias("target")).unionByName(star)


def references(found: DataFrame) -> DataFrame:
    """file_id, module, scope, role (base, call, annotation), place, line_number, written."""
    own = _of(found, "reference").hint("merge").join(modules(found), "file_id")
    return own.select("file_id", "module", "scope", F.col("title").alias("role"), F.col("detail").alias("place"), "line_number", F.col("name").alias("written"))


def _head(name: str):
    return F.substring_index(name, ".", 1)


def _around(name: str):
    """The dotted name without its last part."""
    return F.expr(f"substring_index({name}, '.', size(split({name}, '[.]')) - 1)")


def _below(name: str, head):
    """What follows the head, with its dot; empty if nothing does."""
    return F.expr(f"substring({name}, length({head}) + 1)")


def _prefixes(name: str):
    parts = F.split(name, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def _lookup(names: DataFrame, known: DataFrame) -> DataFrame:
    """names (key, absolute) with at (the longest prefix that is a module, null if none is) and rest (what follows it)."""
    each = names.select("key", "absolute", F.explode(_prefixes("absolute")).alias("module"))
    longest = each.hint("merge").join(known.select("module"), "module").groupBy("key", "absolute").agg(F.max_by("module", F.length("module")).alias("at"))
    return names.hint("merge").join(longest, ["key", "absolute"], "left").withColumn("rest", F.when(F.col("at").isNotNull(), F.expr("substring(absolute, length(at) + 2)")))


def resolve(refs: DataFrame, found: DataFrame) -> DataFrame:
    """refs (references(), or part of them) with target_file, target_module, target and target_role (class, method, function,
    module), or, of what no file defines, `external`, the absolute name. A name is looked up in its module: what that defines,
    then what it imports, then what its star imports bring. Imported names are followed through modules that import them
    in turn; names that lead back to themselves are external. self.x is looked up in the class around it and its ancestors."""
    stored = Tables()
    known, defined, imported = stored(modules(found), "modules"), stored(definitions(found), "definitions"), stored(aliases(found), "aliases")
    refs = stored(refs.withColumn("key", F.xxhash64("file_id", "scope", "role", "place", "written")), "references")
    here = refs.select("key", "module", "scope", "written").distinct()
    top = defined.filter("instr(name, '.') = 0").select("module", F.col("name").alias("head"), F.lit(True).alias("local"))
    named = imported.filter("name <> '*'").select("module", F.col("name").alias("head"), "target")
    start = here.withColumn("head", _head("written")).hint("merge").join(top, ["module", "head"], "left").hint("merge").join(named, ["module", "head"], "left")
    own = F.col("head").isin(*OWN) & F.contains("written", F.lit("."))
    first = F.when(F.col("local"), F.concat_ws(".", "module", "written")).when(F.col("target").isNotNull(), F.concat(F.col("target"), _below("written", "head")))
    start = start.filter(~own).select("key", "module", "written", first.alias("absolute"))
    stars = imported.filter("name = '*'").select("module", "target")
    by_star = start.filter("absolute is null").hint("merge").join(stars, "module").select("key", F.concat_ws(".", "target", "written").alias("absolute"))
    plain = start.filter("absolute is null").select("key", F.col("written").alias("absolute"))
    frontier = stored(start.filter("absolute is not null").select("key", "absolute").unionByName(by_star).unionByName(plain), "frontier")
    seen, done = [frontier], []
    while not frontier.isEmpty():
        at = _lookup(frontier, known)
        hit = at.filter("at is not null").hint("merge").join(defined.select(F.col("module").alias("at"), F.col("name").alias("rest"), "file_id", "role"), ["at", "rest"], "left")
        hit = hit.hint("merge").join(known.select(F.col("module").alias("at"), F.col("file_id").alias("module_file")), "at", "left")
        hit = hit.withColumn("role", F.when(F.col("rest") == "", "module").otherwise(F.col("role"))).withColumn("file_id", F.when(F.col("rest") == "", F.col("module_file")).otherwise(F.col("file_id")))
        hit = stored(hit.select("key", "at", "rest", "file_id", "role"), "hits")
        done.append(hit.filter("role is not null").select("key", F.col("file_id").alias("target_file"), F.col("at").alias("target_module"), F.col("rest").alias("target"), F.col("role").alias("target_role")))
        left = hit.filter("role is null").withColumn("head", _head("rest"))
        through = left.hint("merge").join(named.withColumnRenamed("module", "at"), ["at", "head"]).select("key", F.concat(F.col("target"), _below("rest", "head")).alias("absolute"))
        over = left.hint("merge").join(stars.withColumnRenamed("module", "at"), "at").select("key", F.concat_ws(".", "target", "rest").alias("absolute"))
        frontier = stored(through.unionByName(over).distinct().hint("merge").join(reduce(DataFrame.unionByName, seen), ["key", "absolute"], "left_anti"), "frontier")
        seen.append(frontier)
    # a star may bring a name twice
    ends = reduce(DataFrame.unionByName, done).groupBy("key").agg(F.min(F.struct("target_file", "target_module", "target", "target_role")).alias("t")).select("key", "t.*")
    outside = start.select("key", F.coalesce("absolute", "written").alias("external"))
    out = refs.hint("merge").join(ends, "key", "left").hint("merge").join(outside, "key", "left")
    missing = F.col("target_role").isNull()
    return stored.last(out.withColumn("external", F.when(missing, F.coalesce("external", "written"))).drop("key"), "resolved")


def bases(resolved: DataFrame) -> DataFrame:
    """file_id, name (a class), base_file, base, external: one row per written base."""
    own = resolved.filter("role = 'base'")
    return own.select("file_id", F.col("scope").alias("name"), F.when(F.col("target_role") == "class", F.col("target_file")).alias("base_file"), F.when(F.col("target_role") == "class", F.col("target")).alias("base"), "external")


def ancestors(resolved: DataFrame) -> DataFrame:
    """file_id, name, ancestor_file, ancestor, depth (1: a base): every class from which a class inherits, by its nearest way. A
    class that inherits from itself is left out of its own ancestors."""
    stored = Tables()
    direct = stored(bases(resolved).filter("base is not null").select("file_id", "name", F.col("base_file").alias("ancestor_file"), F.col("base").alias("ancestor")).distinct(), "bases")
    up = direct.select(F.col("file_id").alias("ancestor_file"), F.col("name").alias("ancestor"), F.col("ancestor_file").alias("next_file"), F.col("ancestor").alias("next"))
    frontier, depth = direct.withColumn("depth", F.lit(1)), 1
    rounds = [frontier]
    while not frontier.isEmpty():
        depth += 1
        further = frontier.hint("merge").join(up, ["ancestor_file", "ancestor"]).select("file_id", "name", F.col("next_file").alias("ancestor_file"), F.col("next").alias("ancestor")).distinct()
        every = reduce(DataFrame.unionByName, rounds)
        frontier = stored(further.hint("merge").join(every, ["file_id", "name", "ancestor_file", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "ancestors")
        rounds.append(frontier)
    return stored.last(reduce(DataFrame.unionByName, rounds).filter("not (file_id = ancestor_file and name = ancestor)"), "ancestors")


def own_calls(resolved: DataFrame, found: DataFrame, above: DataFrame) -> DataFrame:
    """file_id, scope, place, target_file, target: calls of self.x and cls.x, by the class around them or its nearest ancestor that
    defines x."""
    calls = resolved.filter("role = 'call' and external is not null and (written like 'self.%' or written like 'cls.%')")
    calls = calls.filter("size(split(written, '[.]')) = 2").select("file_id", "scope", "place", F.substring_index("written", ".", -1).alias("called"), _around("scope").alias("name")).filter("name <> ''")
    own = definitions(found).filter("role = 'class'").select("file_id", "name", F.col("file_id").alias("in_file"), F.col("name").alias("in_class"), F.lit(0).alias("depth"))
    every = own.unionByName(above.select("file_id", "name", F.col("ancestor_file").alias("in_file"), F.col("ancestor").alias("in_class"), "depth"))
    methods = definitions(found).filter("role = 'method'").select(F.col("file_id").alias("in_file"), _around("name").alias("in_class"), F.substring_index("name", ".", -1).alias("called"), F.col("name").alias("target"))
    near = calls.hint("merge").join(every, ["file_id", "name"]).hint("merge").join(methods, ["in_file", "in_class", "called"])
    best = near.groupBy("file_id", "scope", "place").agg(F.min(F.struct("depth", F.col("in_file").alias("target_file"), "target")).alias("b"))
    return best.select("file_id", "scope", "place", "b.target_file", "b.target")


def coupling(resolved: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, name (every class), coupled (distinct other classes of the files that it inherits from, calls or is given),
    outside (distinct first parts of names that no file defines, builtins included)."""
    classes = definitions(found).filter("role = 'class'").select("file_id", "name")
    around = F.explode(_prefixes("scope")).alias("name")  # what a method uses, its class uses
    uses = resolved.filter("scope <> ''").select("file_id", around, "target_file", "target", "target_role", "external", "written").hint("merge").join(classes, ["file_id", "name"])
    other = (F.col("target_role") == "class") & ~((F.col("target_file") == F.col("file_id")) & (F.col("target") == F.col("name")))
    root = F.when(F.col("external").isNotNull() & ~_head("written").isin(*OWN), _head("external"))
    counts = uses.groupBy("file_id", "name").agg(F.count_distinct(F.when(other, F.struct("target_file", "target"))).alias("coupled"), F.count_distinct(root).alias("outside"))
    return classes.hint("merge").join(counts, ["file_id", "name"], "left").select("file_id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("coupled", "outside")))


def broken_overrides(found: DataFrame, above: DataFrame) -> DataFrame:
    """file_id, name (a method), line_number, base_file, base, reason: methods that cannot stand in for the one they override, that
    of the nearest ancestor: they raise NotImplementedError where it does not ("refused"), must be given more than it must
    ("demands"), or take less than it takes ("rejects")."""
    own = definitions(found).filter("role = 'method'").withColumn("cls", _around("name")).withColumn("method", F.substring_index("name", ".", -1)).filter("method not in ('__init__', '__new__')")
    higher = own.select(F.col("file_id").alias("ancestor_file"), F.col("cls").alias("ancestor"), "method", F.struct(F.col("name").alias("base"), F.col("required").alias("r"), F.col("total").alias("t"), F.col("open").alias("o"), F.col("raises").alias("n")).alias("up"))
    pairs = own.hint("merge").join(above.withColumnRenamed("name", "cls"), ["file_id", "cls"]).hint("merge").join(higher, ["ancestor_file", "ancestor", "method"])
    nearest = pairs.groupBy("file_id", "name", "line_number", "required", "total", "open", "raises").agg(F.min_by(F.struct("ancestor_file", "up"), F.struct("depth", "ancestor_file", "ancestor")).alias("b"))
    reason = F.when(F.col("raises") & ~F.col("b.up.n"), "refused").when(F.col("required") > F.col("b.up.r"), "demands").when(~F.col("open") & (F.col("b.up.o") | (F.col("total") < F.col("b.up.t"))), "rejects")
    return nearest.select("file_id", "name", "line_number", F.col("b.ancestor_file").alias("base_file"), F.col("b.up.base").alias("base"), reason.alias("reason")).filter("reason is not null")


def envied(resolved: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """file_id, name (a method or function), parameter, target_file, target, touched, own: those that touch a parameter, whose
    annotation is a class of the files, more than `most` times and more often than self."""
    touched = _of(found, "touch").select("file_id", "scope", "name", F.col("value").cast("long").alias("touched"))
    given = resolved.filter("role = 'annotation' and target_role = 'class'").select("file_id", "scope", F.col("place").alias("name"), "target_file", "target")
    own = touched.filter("name = 'self'").select("file_id", "scope", F.col("touched").alias("own"))
    both = given.hint("merge").join(touched, ["file_id", "scope", "name"]).hint("merge").join(own, ["file_id", "scope"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return both.filter(F.col("touched") > F.greatest("own", F.lit(most))).select("file_id", F.col("scope").alias("name"), F.col("name").alias("parameter"), "target_file", "target", "touched", "own")
