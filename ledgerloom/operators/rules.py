"""Rules a user writes about the columns of a table, and the repairs that would satisfy them.

A rule is compiled to a column: only numbers, the table's variables, + - * / ( ) and abs, round, int are allowed.
Division by zero and unknown values give null.
"""

from __future__ import annotations

import ast
import re
from itertools import count

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import digit_edits
from ledgerloom.runtime import cut

FUNCTIONS = {"abs": F.abs, "round": F.round, "int": lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")}


def compile_rule(text: str, columns: dict[str, Column]) -> Column:
    """The column a rule's expression stands for; ValueError if it uses anything not allowed."""

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in columns:
            return columns[node.id].cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -walk(node.operand) if isinstance(node.op, ast.USub) else walk(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Div):
                return F.try_divide(a, b)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1 and not node.keywords:
            return FUNCTIONS[node.func.id](walk(node.args[0]))
        raise ValueError(f"not allowed in a rule: {text!r}")

    try:
        return walk(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not a rule: {text!r}") from e


def variables(text: str) -> set[str]:
    return {n.id for n in ast.walk(ast.parse(text.strip(), mode="eval")) if isinstance(n, ast.Name)} - set(FUNCTIONS)


def weight(lhs: str, rhs: str) -> float:
    """What a rule counts: the fewer variables it has, the more."""
    return 1 / max(1, len(variables(lhs) | variables(rhs)))


def violated(delta: Column, operator: str, tol: float) -> Column:
    """Whether lhs - rhs breaks a rule; an operator not known is '='."""
    return {">=": delta < -tol, "<=": delta > tol}.get(operator, F.abs(delta) > tol)


def number_rule(text: str, values: dict[str, Column], tol: float = 1e-6) -> Column:
    """A rule on numbered columns such as '1+2=4': whether it holds, false where a value is no number, null if it is malformed."""
    sides = text.split("=")
    if len(sides) != 2:
        return F.lit(None).cast("boolean")
    named = [re.sub(r"\b(\d+)\b", r"v\1", s) for s in sides]
    try:
        a, b = (compile_rule(s, {f"v{k}": c for k, c in values.items()}) for s in named)
    except ValueError:
        return F.lit(None).cast("boolean")
    return F.coalesce(F.abs(a - b) <= tol, F.lit(False))


def violations(rows: DataFrame, rules: list[dict], keys: list[str]) -> DataFrame:
    """(rule, keys..., delta) of every row that breaks a rule. A rule is {name, lhs, operator, rhs, tol}.

    All rules are checked in one scan; rows whose values don't allow a rule are left out.
    """
    cols = {c: F.col(c) for c in rows.columns}
    checks = []
    for r in rules:
        delta = compile_rule(r["lhs"], cols) - compile_rule(r["rhs"], cols)
        checks.append(F.when(violated(delta, r.get("operator", "="), r.get("tol", 0.0)), F.struct(F.lit(r["name"]).alias("rule"), delta.alias("delta"))))
    return rows.select(*keys, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("v")).select("v.rule", *keys, "v.delta")


def violation_counts(rows: DataFrame, rules: list[dict], keys: list[str]) -> DataFrame:
    """(rule, n, total_delta)."""
    return violations(rows, rules, keys).groupBy("rule").agg(F.count("*").alias("n"), F.sum("delta").alias("total_delta"))


def wide(cells: DataFrame, row: str, variable: str, value: str, names: list[str]) -> DataFrame:
    """Cells of (row, variable, value) as one row per `row`; of repeated cells one value, the greatest."""
    return cells.where(F.col(variable).isin(names)).groupBy(row).pivot(variable, names).agg(F.max(value))


def _deltas(columns: dict[str, Column], rules: list[dict]) -> list[Column]:
    # Repairs read what is missing as 0, unlike the report of violations.
    zero = {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()}
    return [compile_rule(r["lhs"], zero) - compile_rule(r["rhs"], zero) for r in rules]


def single_edits(rows: DataFrame, rules: list[dict], keys: list[str], names: list[str]) -> DataFrame:
    """(keys..., variable, old, new, broken, fixed, reduction): every one-digit edit of a row that breaks a rule, with what it does.

    Only rows in violation are expanded, each into its own edits, so the work is local to a row.
    """
    cols = {n: F.col(n) for n in names}
    now = _deltas(cols, rules)
    bad = [F.coalesce(violated(d, r.get("operator", "="), r.get("tol", 0.0)), F.lit(False)) for d, r in zip(now, rules)]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    text = {n: F.coalesce(F.col(n).cast("bigint").cast("string"), F.lit("0")) for n in names}
    options = F.concat(*[F.transform(F.coalesce(digit_edits(text[n]), F.array().cast("array<string>")), _option(n, text[n])) for n in names])
    e = rows.where(any_bad).select(*keys, *names, F.explode(options).alias("e"))
    after_cols = {n: F.when(F.col("e.variable") == n, F.col("e.new").cast("double")).otherwise(F.col(n).cast("double")) for n in names}
    after = _deltas(after_cols, rules)
    was = [F.coalesce(violated(d, r.get("operator", "="), r.get("tol", 0.0)), F.lit(False)) for d, r in zip(_deltas(cols, rules), rules)]
    is_ = [F.coalesce(violated(d, r.get("operator", "="), r.get("tol", 0.0)), F.lit(False)) for d, r in zip(after, rules)]
    total = lambda xs: sum((x.cast("int") for x in xs[1:]), xs[0].cast("int"))
    broken, fixed = total([~w & i for w, i in zip(was, is_)]), total([w & ~i for w, i in zip(was, is_)])
    gain = [(F.abs(F.coalesce(n, F.lit(0.0))) - F.abs(F.coalesce(a, F.lit(0.0)))) * weight(r["lhs"], r["rhs"]) for n, a, r in zip(_deltas(cols, rules), after, rules)]
    return e.select(*keys, F.col("e.variable").alias("variable"), F.col("e.old").alias("old"), F.col("e.new").alias("new"), broken.alias("broken"), fixed.alias("fixed"), F.round(sum(gain[1:], gain[0]), 6).alias("reduction"))


def _option(name: str, old: Column):
    return lambda e: F.struct(F.lit(name).alias("variable"), old.alias("old"), e.alias("new"))


def best_edits(rows: DataFrame, rules: list[dict], keys: list[str], names: list[str], top: int = 8, hierarchy: dict[str, int] | None = None) -> DataFrame:
    """The best edits of each row: none newly broken first, then most fixed, then most of the difference taken away, then variables that stand highest in `hierarchy`."""
    ranks = F.coalesce(*[F.when(F.col("variable") == n, F.lit(k)) for n, k in (hierarchy or {}).items()], F.lit(0))
    w = W.partitionBy(*keys).orderBy("broken", F.col("fixed").desc(), F.col("reduction").desc(), ranks.desc(), "variable", "new")
    return single_edits(rows, rules, keys, names).where("fixed > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def fewest_edits(rows: DataFrame, rules: list[dict], keys: list[str], names: list[str], depth: int = 4, states: int = 15_000) -> DataFrame:
    """(keys..., edits): for each row in violation the fewest one-digit edits that satisfy all rules, as JSON, null if none is found within the bounds.

    The bounds are those of one row's search; no row is left out. At most `states` states are carried on to the next edit, every edit of
    those is tested.
    """
    import json

    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + ", edits string"
    for r in rules:
        compile_rule(r["lhs"], {n: F.col(n) for n in names}), compile_rule(r["rhs"], {n: F.col(n) for n in names})
    plain = [(r["lhs"], r["rhs"], r.get("operator", "="), r.get("tol", 0.0), variables(r["lhs"]) | variables(r["rhs"])) for r in rules]

    def search(batches):
        import pandas as pd

        code = [(compile(a, "<rule>", "eval"), compile(b, "<rule>", "eval"), op, tol, vs) for a, b, op, tol, vs in plain]
        safe = {"__builtins__": {}, "abs": abs, "round": round, "int": int}

        def broken(v):
            out = []
            for a, b, op, tol, vs in code:
                try:
                    d = eval(a, safe, v) - eval(b, safe, v)  # noqa: S307 - checked by compile_rule
                except ZeroDivisionError:
                    continue
                if d < -tol if op == ">=" else d > tol if op == "<=" else abs(d) > tol:
                    out.append(vs)
            return out

        def holds(v):
            for a, b, op, tol, _ in code:
                try:
                    d = eval(a, safe, v) - eval(b, safe, v)  # noqa: S307 - checked by compile_rule
                except ZeroDivisionError:
                    continue
                if d < -tol if op == ">=" else d > tol if op == "<=" else abs(d) > tol:
                    return False
            return True

        def neighbours(s):
            for i in range(len(s) + 1):
                for d in "0123456789":
                    yield s[:i] + d + s[i:]
                    if i < len(s) and s[i] != d:
                        yield s[:i] + d + s[i + 1 :]
                if i < len(s) and len(s) > 1:
                    yield s[:i] + s[i + 1 :]

        for b in batches:
            rows_out = []
            for rec in b.to_dict("records"):
                start = {n: float(rec[n] or 0) if rec[n] == rec[n] and rec[n] is not None else 0.0 for n in names}
                if not broken(start):
                    continue
                seen, layer, answer = {tuple(start.values())}, [(start, [])], None
                for _ in range(depth):
                    nxt = []
                    for v, path in layer:
                        # Whatever satisfies all rules edits a variable of each broken one, so those of one rule are enough.
                        for n in sorted(min(broken(v), key=len)):
                            for s in neighbours(str(int(v[n]))):
                                if s != "0" and s.startswith("0"):
                                    continue
                                w = v | {n: float(s)}
                                key = tuple(w.values())
                                if key in seen:
                                    continue
                                if holds(w):
                                    answer = [*path, {"variable": n, "old": int(v[n]), "new": int(s)}]
                                    break
                                # The bound is on the states that are carried on; those of this layer are tested all the same.
                                if len(seen) < states:
                                    seen.add(key)
                                    nxt.append((w, [*path, {"variable": n, "old": int(v[n]), "new": int(s)}]))
                            if answer:
                                break
                        if answer:
                            break
                    if answer:
                        break
                    layer = nxt
                rows_out.append([rec[k] for k in keys] + [json.dumps(answer) if answer else None])
            yield pd.DataFrame(rows_out, columns=[*keys, "edits"])

    return rows.select(*keys, *names).mapInPandas(search, schema)


def batch_clean(rows: DataFrame, rules: list[dict], keys: list[str], names: list[str], min_fix: int = 2) -> tuple[DataFrame, DataFrame]:
    """The rows after repeated best edits, and the audit (round, keys..., variable, old, new, fixed).

    Each round applies to every row the edits that fix as many rules as the best of all rows does and break none, one per row, and ends
    below `min_fix`. As every edit fixes more than it breaks, rounds come to an end. They are cut by checkpoint, so a lost executor costs one round.
    """
    if min_fix < 1:
        raise ValueError("an edit must fix at least one rule")
    audit, cur = None, rows
    for k in count(1):
        edits = cut(best_edits(cur, rules, keys, names, 1).where((F.col("broken") == 0) & (F.col("fixed") >= min_fix)))
        most = edits.agg(F.max("fixed")).first()[0]
        if most is None:
            break
        take = edits.where(F.col("fixed") == most)
        log = take.select(F.lit(k).alias("round"), *keys, "variable", "old", "new", "fixed")
        audit = log if audit is None else audit.unionByName(log)
        ch = take.select(*keys, F.col("variable").alias("__v"), F.col("new").alias("__n"))
        j = cur.join(ch, keys, "left")
        for n in names:
            j = j.withColumn(n, F.when(F.col("__v") == n, F.col("__n").cast(dict(rows.dtypes)[n])).otherwise(F.col(n)))
        cur = cut(j.drop("__v", "__n").select(*rows.columns))
    if audit is None:
        kinds = dict(rows.dtypes)
        audit = rows.sparkSession.createDataFrame([], "round int, " + ", ".join(f"{c} {kinds[c]}" for c in keys) + ", variable string, old string, new string, fixed int")
    return cur, audit


def crawl_shift(counts: DataFrame, group: list[str], position: str, n: str) -> DataFrame:
    """(group..., best_position, before, after): where a column's line counts would fit the row majority if one line were taken out.

    `counts` has the lines of each cell by element and position. For every position of an element the mismatches before it and, shifted by
    one, after it are prefix sums, so all shifts of an element are judged by one window.
    """
    major = counts.groupBy(position, n).agg(F.count("*").alias("__c")).groupBy(position).agg(F.max_by(F.col(n), F.struct("__c", (-F.col(n)).alias("x"))).alias("__m"))
    c = counts.join(major, position)
    w = W.partitionBy(*group).orderBy(position)
    c = c.withColumn("__bad", (F.col(n) != F.col("__m")).cast("int")).withColumn("__next", F.lead(n).over(w))
    c = c.withColumn("__shift_bad", F.coalesce((F.col("__next") != F.col("__m")).cast("int"), F.lit(1)))
    before = F.sum("__bad").over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.sum("__shift_bad").over(w.rowsBetween(0, W.unboundedFollowing))
    c = c.withColumn("__total", F.sum("__bad").over(W.partitionBy(*group))).withColumn("__cost", F.coalesce(before, F.lit(0)) + after)
    best = c.groupBy(*group).agg(F.min(F.struct("__cost", F.col(position).alias("p"))).alias("b"), F.max("__total").alias("before"))
    return best.where("b.__cost < before").select(*group, F.col("b.p").alias("best_position"), "before", F.col("b.__cost").alias("after"))


def crawl_repairs(rows: DataFrame, rules: list[dict], group: list[str], order: list[str], names: list[str], lines: DataFrame) -> DataFrame:
    """(group..., position, variables, direction, before, after, gain): where a column of a lattice element slipped against the others, the best gain first.

    `lines` is (group..., variable, lines): what a column's cell had in print. A column with fewer lines than most gets a nought put in, one with more
    loses a line; the rest of it shifts by one. The place that leaves the fewest broken rules is taken, the first of several. A row is judged with the
    column's own value, a nought, the value before and the value behind it, so that prefix sums give every place at once.
    """
    usual = lines.groupBy(*group, "lines").agg(F.count("*").alias("__n")).groupBy(*group).agg(F.max_by("lines", F.struct("__n", "lines")).alias("__u"), F.sum("__n").alias("__all"))
    off = lines.join(usual.where("__all > 1 and __u > 0"), group).withColumn("__d", F.col("lines") - F.col("__u")).where("__d <> 0").select(*group, "variable", "__d")
    by, w = W.partitionBy(*group), W.partitionBy(*group).orderBy(*order)
    base = rows.select(*group, *order, *[F.col(n).cast("double").alias(n) for n in names])
    plain = {n: F.col(n) for n in names}

    def broken(columns: dict[str, Column]) -> Column:
        checks = [F.coalesce(violated(compile_rule(r["lhs"], columns) - compile_rule(r["rhs"], columns), r.get("operator", "="), r.get("tol", 0.0)), F.lit(False)).cast("bigint") for r in rules]
        return sum(checks[1:], checks[0])

    r = base.withColumn("__p", F.row_number().over(w)).withColumn("__size", F.count("*").over(by)).withColumn("__b", broken(plain))
    for n in names:
        r = r.withColumn(f"__prev_{n}", F.lag(n).over(w)).withColumn(f"__next_{n}", F.lead(n).over(w))
    each = [F.struct(F.lit(n).alias("variable"), F.col(n).isNotNull().alias("filled"), broken(plain | {n: F.lit(0.0)}).alias("nought"), broken(plain | {n: F.col(f"__prev_{n}")}).alias("prev"), broken(plain | {n: F.col(f"__next_{n}")}).alias("next")) for n in names]
    long = r.select(*group, "__p", "__size", "__b", F.explode(F.array(*each)).alias("e")).select(*group, "__p", "__size", "__b", "e.*").join(off, [*group, "variable"])
    wv = W.partitionBy(*group, "variable").orderBy("__p")
    upto = F.coalesce(F.sum("__b").over(wv.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest_down = F.coalesce(F.sum("prev").over(wv.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    rest_up = F.sum("next").over(wv.rowsBetween(0, W.unboundedFollowing))
    after = F.when(F.col("__d") < 0, upto + F.col("nought") + rest_down).when(F.col("filled"), upto + rest_up)
    tried = long.withColumn("__after", after).withColumn("__before", F.sum("__b").over(W.partitionBy(*group, "variable"))).where("__size > 1 and __after is not null")
    best = tried.groupBy(*group, "variable").agg(F.min(F.struct("__after", "__p")).alias("b"), F.max("__before").alias("before"), F.max("__d").alias("__d")).where("b.__after < before")
    out = best.groupBy(*group, F.col("b.__p").alias("position"), F.when(F.col("__d") < 0, "down").otherwise("up").alias("direction")).agg(F.sort_array(F.collect_list("variable")).alias("variables"), F.max("before").alias("before"), F.min("b.__after").alias("after"))
    return out.withColumn("gain", F.col("before") - F.col("after")).orderBy(F.col("gain").desc(), *group, "position")
