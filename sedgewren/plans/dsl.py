"""Factor expressions: text to columns.

The grammar is Python's expression syntax, parsed by the standard library; names are panel fields and calls are the functions of
`sedgewren.functions.factor`. Equal sub-expressions that use a window become one column, and all windows of one depth go into one
select, so expressions evaluated together share scans, exchanges and sorts.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import factor as f

#: Other names of functions and fields.
ALIASES = {
    "delta": "ts_delta", "delay": "ts_shift", "ts_delay": "ts_shift", "correlation": "ts_corr", "covariance": "ts_cov", "ts_covariance": "ts_cov",
    "stddev": "ts_std", "ts_std_dev": "ts_std", "ts_arg_max": "ts_argmax", "ts_arg_min": "ts_argmin", "av_diff": "ts_av_diff", "wma": "decay_linear", "sma": "ts_mean",
}
FIELD_ALIASES = {"cap": "total_mv", "market_cap": "total_mv", "margin_balance": "borrow_money_bal", "margin_buy_amount": "purch_borrow_money", "short_balance": "sec_lending_bal"}


@dataclass(frozen=True)
class Function:
    """build gets columns, and plain numbers where `numbers` says so. window: the argument that is a number of rows. staged: build also
    gets a function that makes intermediate columns. across: its windows are dates, not codes."""

    build: Callable[..., Column]
    arity: tuple[int, ...]
    numbers: tuple[int, ...] = ()
    window: int | None = None
    windowed: bool = True
    extra_rows: int = 0
    staged: bool = False
    across: bool = False


def _ts(build, columns: int = 1, **kw) -> Function:
    return Function(build, (columns + 1,), (columns,), columns, **kw)


def _plain(build, arity: int, numbers: tuple[int, ...] = ()) -> Function:
    return Function(build, (arity,), numbers, windowed=False)


FUNCTIONS: dict[str, Function] = {
    "rank": Function(f.rank, (1,), across=True),
    "zscore": Function(f.zscore, (1,), across=True),
    "group_rank": Function(f.rank, (2,), across=True),
    "group_zscore": Function(f.zscore, (2,), across=True),
    "scale": Function(f.scale, (1,), across=True),
    "indneutralize": Function(f.indneutralize, (2,), across=True),
    "sign": _plain(F.signum, 1),
    "sign_power": _plain(f.sign_power, 2, (1,)),
    "tanh": _plain(F.tanh, 1),
    "sigmoid": _plain(f.sigmoid, 1),
    "clip": _plain(f.clip, 3, (1, 2)),
    "log": _plain(f.log, 1),
    "abs": _plain(F.abs, 1),
    "sqrt": _plain(f.sqrt, 1),
    "exp": _plain(F.exp, 1),
    "power": _plain(f.power, 2),
    "max": _plain(f.greater, 2),
    "min": _plain(f.lesser, 2),
    "where": _plain(f.where, 3),
    "trade_when": _plain(f.trade_when, 3),
    "ts_mean": _ts(f.ts_mean),
    "ts_std": _ts(f.ts_std),
    "ts_max": _ts(f.ts_max),
    "ts_min": _ts(f.ts_min),
    "ts_sum": _ts(f.ts_sum),
    "ts_shift": _ts(f.ts_shift, extra_rows=1),
    "ts_delta": _ts(f.ts_delta, extra_rows=1),
    "ts_rank": _ts(f.ts_rank),
    "ts_argmax": _ts(f.ts_argmax),
    "ts_argmin": _ts(f.ts_argmin),
    "ts_corr": _ts(f.ts_corr, 2),
    "ts_cov": _ts(f.ts_cov, 2),
    "ts_av_diff": _ts(f.ts_av_diff),
    "ts_zscore": _ts(f.ts_zscore),
    "decay_linear": _ts(f.decay_linear),
    "ema": _ts(f.ema, staged=True),
    "product": _ts(f.product),
    "rsi": _ts(f.rsi, extra_rows=1),
    "macd": Function(lambda fast, slow: fast - slow, (1, 3), (1, 2)),
    "obv": Function(f.obv, (2,)),
    "boll_mid": _ts(f.ts_mean),
    "boll_upper": Function(lambda x, n, k=2.0: f.boll(x, n, k), (2, 3), (1, 2), 1),
    "boll_lower": Function(lambda x, n, k=2.0: f.boll(x, n, -k), (2, 3), (1, 2), 1),
    "atr": Function(f.atr, (4,), (3,), 3, extra_rows=1),
}
OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**", ast.BitXor: "**"}
COMPARISONS = {ast.Gt: "gt", ast.Lt: "lt", ast.GtE: "ge", ast.LtE: "le", ast.Eq: "eq", ast.NotEq: "ne"}


class ExpressionError(ValueError):
    """An expression that the language doesn't have."""


def parse(text: str) -> ast.expr:
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e
    _checked(tree)
    return tree


def _checked(node: ast.AST) -> None:
    match node:
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            fn = FUNCTIONS.get(ALIASES.get(name, name))
            if fn is None:
                raise ExpressionError(f"no function {name}")
            if len(args) not in fn.arity:
                raise ExpressionError(f"{name} takes {' or '.join(map(str, fn.arity))} arguments, not {len(args)}")
            for i in fn.numbers:
                if i < len(args):
                    number(args[i])
            if fn.window is not None and (number(args[fn.window]) < 1 or number(args[fn.window]) % 1):
                raise ExpressionError(f"{name} needs a whole number of rows")
        case ast.Name() | ast.Constant(value=int() | float()):
            return
        case ast.BinOp(op=op) if type(op) in OPERATORS:
            pass
        case ast.UnaryOp(op=ast.USub() | ast.UAdd() | ast.Not()) | ast.BoolOp() | ast.IfExp():
            pass
        case ast.Compare(ops=[op]) if type(op) in COMPARISONS:
            pass
        case _:
            raise ExpressionError(f"not in the language: {ast.unparse(node)}")
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.expr) and not (isinstance(node, ast.Call) and child is node.func):
            _checked(child)


def number(node: ast.expr) -> float:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -number(node.operand)
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
        return node.value
    raise ExpressionError(f"a number is needed, not {ast.unparse(node)}")


def field(name: str) -> Column:
    """A panel field, or one derived from others."""
    if m := re.fullmatch(r"adv(\d+)", name):
        return f.ts_mean(F.col("volume"), int(m[1]))
    derived = {
        "returns": lambda: f.divide(F.col("close"), f.ts_shift(F.col("close"), 1)) - 1,
        "vwap": lambda: f.divide(F.col("amount"), F.col("volume")),
        "day": lambda: F.dayofmonth(f.DATE),
        "weekday": lambda: F.weekday(f.DATE),
        "month": lambda: F.month(f.DATE),
    }
    return derived[name]() if name in derived else F.col(FIELD_ALIASES.get(name, name))


#: Panel fields behind derived ones.
SOURCES = {"returns": {"close"}, "vwap": {"amount", "volume"}, "day": set(), "weekday": set(), "month": set()}


def names(node: ast.AST) -> set[str]:
    called = {id(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and id(n) not in called}


def fields(text: str) -> set[str]:
    """The panel columns that an expression reads."""
    out: set[str] = set()
    for name in names(parse(text)):
        out |= {"volume"} if re.fullmatch(r"adv\d+", name) else SOURCES.get(name, {FIELD_ALIASES.get(name, name)})
    return out


def functions(text: str) -> list[str]:
    """Functions used, with their plain names, in order of appearance."""
    calls = [n for n in ast.walk(parse(text)) if isinstance(n, ast.Call)]
    return [ALIASES.get(n.func.id, n.func.id) for n in sorted(calls, key=lambda n: n.col_offset)]


def reach(text: str) -> int:
    """Earlier rows of a code that the windows of one level need, if every earlier level is at hand; running functions need the last."""

    def of(node: ast.AST) -> int:
        inner = max((of(c) for c in ast.iter_child_nodes(node)), default=0)
        if isinstance(node, ast.Name):
            return int(m[1]) - 1 if (m := re.fullmatch(r"adv(\d+)", node.id)) else int(node.id == "returns")
        if not isinstance(node, ast.Call):
            return inner
        fn = FUNCTIONS[ALIASES.get(node.func.id, node.func.id)]
        if fn.window is None or fn.staged:
            return max(inner, int(node.func.id in ("obv", "macd", "ema")))
        return max(inner, int(number(node.args[fn.window])) - 1 + fn.extra_rows)

    return of(parse(text))


def lookback(text: str) -> int:
    """Earlier rows of a code that a value depends on: windows add up where they are nested."""

    def of(node: ast.AST) -> int:
        inner = max((of(c) for c in ast.iter_child_nodes(node)), default=0)
        if isinstance(node, ast.Name):
            return int(m[1]) - 1 if (m := re.fullmatch(r"adv(\d+)", node.id)) else int(node.id == "returns")
        if not isinstance(node, ast.Call):
            return inner
        name = ALIASES.get(node.func.id, node.func.id)
        fn = FUNCTIONS[name]
        if name in ("ema", "macd"):
            n = max([26, *(int(number(a)) for a in node.args[1:])]) if name == "macd" else int(number(node.args[1]))
            return inner + f.EMA_REACH * n - 1
        return inner if fn.window is None else inner + int(number(node.args[fn.window])) - 1 + fn.extra_rows

    return of(parse(text))


def depth(text: str) -> int:
    def of(node: ast.AST) -> int:
        return isinstance(node, ast.Call) + max((of(c) for c in ast.iter_child_nodes(node)), default=0)

    return of(parse(text))


def signature(text: str) -> str:
    """Canonical text: constants and windows are left out, monotone wrappers too, and arguments of commutative operators are sorted."""

    def of(node: ast.AST) -> str:
        match node:
            case ast.Constant():
                return ""
            case ast.Name(id=name):
                return FIELD_ALIASES.get(name, name)
            case ast.UnaryOp(operand=x):
                return of(x)
            case ast.Call(func=ast.Name(id=name), args=args):
                name = ALIASES.get(name, name)
                parts = [x for x in map(of, args) if x]
                if name in ("rank", "zscore", "scale", "sigmoid", "tanh", "sign_power") and len(parts) == 1:
                    return parts[0]
                return f"{name}({','.join(sorted(parts) if name in ('max', 'min', 'ts_corr', 'ts_cov') else parts)})"
            case ast.BinOp(left=a, op=op, right=b):
                parts = [x for x in (of(a), of(b)) if x]
                sign = OPERATORS[type(op)]
                return parts[0] if len(parts) == 1 else f"({sign.join(sorted(parts) if sign in '+*' else parts)})"
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                return f"({of(a)} {COMPARISONS[type(op)]} {of(b)})"
            case ast.BoolOp(op=op, values=vs):
                return "(" + (" and " if isinstance(op, ast.And) else " or ").join(sorted(map(of, vs))) + ")"
            case ast.IfExp(test=t, body=a, orelse=b):
                return f"where({of(t)},{of(a)},{of(b)})"
        return ast.unparse(node)

    return of(parse(text))


def normalised(text: Column) -> Column:
    """A column of expressions without blanks, in lower case."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def shape(text: Column) -> Column:
    """A column of expressions with # for every number that is an argument: what structural twins share."""
    return F.regexp_replace(normalised(text), r"([(,])-?[0-9]+(\.[0-9]+)?", "$1#")


def smoothness(text: Column) -> dict[str, Column]:
    """How often a normalised expression smooths, branches, bends and multiplies."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return {
        "smooth": count(r"(ts_mean|ts_rank|ts_zscore|decay_linear|ema|sma|wma)\("), "branches": count(r"where\("),
        "nonlinear": count(r"(tanh|sigmoid|sign_power)\("), "products": count(r"\*"),
    }


#: Columns of a tail: whether a row is an earlier one, and whether it is its code's last of those; what earlier rows' columns are kept as.
OLD, LAST, KEPT = "__old", "__last", "__kept"
#: Levels of one partitioning: columns along codes have even multiples of it and what follows, columns across dates odd ones.
PHASE = 1000


class Plan:
    """Columns for expressions; windowed sub-expressions are named by level. Whatever can be computed by code comes before what is computed
    by date, and so on in turn, so that rows change their partitioning as seldom as they can.

    With the plan of the whole as `base`, columns are those of a tail: its rows lie behind each code's last earlier ones, for which every
    shared column has the value that was kept."""

    def __init__(self, base: Plan | None = None) -> None:
        self.named: dict[str, tuple[str, int]] = {}
        self.levels: dict[int, list[tuple[str, Column]]] = {}
        self.kept: list[str] = []
        self.base = base
        self.inside = 0

    def share(self, key: str, column: Column, level: int, inner: bool = False, across: bool = False) -> tuple[Column, int]:
        """inner: a step of the next shared column, which earlier rows need not have."""
        if key not in self.named:
            if level // PHASE % 2 != across:
                level = (level // PHASE + 1) * PHASE
            self.named[key] = (f"__{len(self.named)}", level)
            name = self.named[key][0]
            if self.base and not inner and name in self.base.kept:
                column = F.when(F.col(OLD), F.col(KEPT + name)).otherwise(column)
            self.levels.setdefault(level, []).append((name, column))
        name, level = self.named[key]
        if self.inside and not inner:
            self.keep(name)
        return F.col(name), level + 1

    def keep(self, name: str) -> None:
        """A tail's windows read earlier values of this column."""
        if name not in self.kept:
            self.kept.append(name)

    def argument(self, node: ast.expr, windowed: bool) -> tuple[Column, int]:
        self.inside += windowed
        try:
            return self.column(node)
        finally:
            self.inside -= windowed

    def running(self, key: str, column: Column, level: int) -> tuple[Column, int]:
        """A shared column that goes on from its own last value."""
        out = self.share(key, column, level)
        self.keep(self.named[key][0])
        return out

    def resumed(self, key: str, column: Column) -> Column:
        """What a running function reads: in a tail, its own last value stands for all earlier rows."""
        if not self.base:
            return column
        return F.when(~F.col(OLD), column).when(F.col(LAST), F.col(KEPT + self.base.named[key][0]))

    def column(self, node: ast.expr) -> tuple[Column, int]:
        """The column and the first level at which it can be computed."""
        match node:
            case ast.Constant(value=v):
                return F.lit(float(v)), 0
            case ast.Name(id=name):
                return self.share(name, field(name), 0) if re.fullmatch(r"adv\d+|returns", name) else (field(name), 0)
            case ast.UnaryOp(op=op, operand=x):
                c, at = self.column(x)
                return (-c if isinstance(op, ast.USub) else ~c if isinstance(op, ast.Not) else c), at
            case ast.BinOp(left=a, op=op, right=b):
                (x, i), (y, j) = self.column(a), self.column(b)
                sign = OPERATORS[type(op)]
                made = f.divide(x, y) if sign == "/" else f.power(x, y) if sign == "**" else x + y if sign == "+" else x - y if sign == "-" else x * y
                return made, max(i, j)
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                (x, i), (y, j) = self.column(a), self.column(b)
                return {"gt": x > y, "lt": x < y, "ge": x >= y, "le": x <= y, "eq": x == y, "ne": x != y}[COMPARISONS[type(op)]], max(i, j)
            case ast.BoolOp(op=op, values=vs):
                parts = [self.column(v) for v in vs]
                out = parts[0][0]
                for c, _ in parts[1:]:
                    out = out & c if isinstance(op, ast.And) else out | c
                return out, max(at for _, at in parts)
            case ast.IfExp(test=t, body=a, orelse=b):
                (c, i), (x, j), (y, k) = self.column(t), self.column(a), self.column(b)
                return f.where(c, x, y), max(i, j, k)
            case ast.Call(func=ast.Name(id=name), args=args):
                fn, key = FUNCTIONS[ALIASES.get(name, name)], ast.unparse(node)
                if name == "macd":  # two means, shared with others of the same
                    fast, slow = args[1:] or (ast.Constant(12), ast.Constant(26))
                    (x, i), (y, j) = (self.column(ast.Call(ast.Name("ema"), [args[0], n], [])) for n in (fast, slow))
                    return self.share(key, fn.build(x, y), max(i, j))
                values, at = [], 0
                for i, a in enumerate(args):
                    if i in fn.numbers:
                        n = number(a)
                        values.append(int(n) if i == fn.window else n)
                    else:
                        c, level = self.argument(a, fn.windowed)
                        values.append(c)
                        at = max(at, level)
                running = name in ("obv", "ema")
                if name == "obv" and self.base:
                    return self.running(key, F.sum(self.resumed(key, f.obv_step(*values))).over(f.along()), at)
                if fn.staged:
                    values[0] = self.resumed(key, values[0])

                    def staged(name: str, c: Column) -> Column:
                        nonlocal at
                        made, at = self.share(f"{name} of {key}", c, at, inner=True)
                        return made

                    values.append(staged)
                made = fn.build(*values)
                if running:
                    return self.running(key, made, at)
                return self.share(key, made, at, across=fn.across) if fn.windowed else (made, at)
        raise ExpressionError(f"not in the language: {ast.unparse(node)}")


def evaluate(panel: DataFrame, expressions: dict[str, str], keep: tuple[str, ...] = (f.CODE, f.DATE)) -> DataFrame:
    """keep and one column per expression, over all rows of the panel."""
    plan, out = Plan(), {}
    for name, text in expressions.items():
        out[name] = plan.column(parse(text))[0]
    df = panel
    for level in sorted(plan.levels):
        df = df.select("*", *[c.alias(n) for n, c in plan.levels[level]])
    return df.select(*keep, *[c.alias(n) for n, c in out.items()])


def evaluate_window(panel: DataFrame, expressions: dict[str, str], start: str, end: str, calendar: DataFrame | None = None) -> DataFrame:
    """Values of the dates from start to end. Time-series functions see all rows before; the output is trimmed afterwards."""
    return evaluate(panel.where(F.col(f.DATE) <= F.lit(end).cast("date")), expressions).where(F.col(f.DATE) >= F.lit(start).cast("date"))
