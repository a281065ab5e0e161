"""The expression algebra: one tree, read as a Spark column, a value, exact partial derivatives, text, or a trace.

Absence is NULL (None on the driver). Arithmetic and the branches of ``select`` pass it on; ``min`` and ``max`` skip
it; ``or_`` is the way out. Comparisons and conditions may not be written over what may be absent: that is an error
when the tree is built. A division by zero is absent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Absent(TypeError):
    """A comparison over an expression that may be absent."""


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()
    value: float | int | None = None

    @property
    def maybe(self) -> bool:
        """Whether the expression may be absent where its variables are present."""
        if self.op in ("const", "var", "lt", "present"):
            return False
        if self.op == "absent":
            return True
        if self.op == "or":
            return self.args[1].maybe
        if self.op in ("min", "max"):
            return all(a.maybe for a in self.args)
        if self.op == "select":
            return any(a.maybe for a in self.args[1:])
        return any(a.maybe for a in self.args)

    def __add__(self, o) -> Expr:
        return Expr("+", (self, lift(o)))

    def __sub__(self, o) -> Expr:
        return Expr("-", (self, lift(o)))

    def __mul__(self, o) -> Expr:
        return Expr("*", (self, lift(o)))

    def __truediv__(self, o) -> Expr:
        return Expr("/", (self, lift(o)))

    def __neg__(self) -> Expr:
        return Expr("neg", (self,))

    def __radd__(self, o) -> Expr:
        return lift(o) + self

    def __rsub__(self, o) -> Expr:
        return lift(o) - self

    def __rmul__(self, o) -> Expr:
        return lift(o) * self

    def __rtruediv__(self, o) -> Expr:
        return lift(o) / self


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Expr("const", value=float(x))


def var(i: int) -> Expr:
    return Expr("var", value=i)


constant, absent = lift, Expr("absent")


def _one(op: str):
    return lambda x: Expr(op, (lift(x),))


square, abs_, sqrt, exp = (_one(o) for o in ("square", "abs", "sqrt", "exp"))


def present(x) -> Expr:
    return Expr("present", (lift(x),))


def min_(a, b) -> Expr:
    return Expr("min", (lift(a), lift(b)))


def max_(a, b) -> Expr:
    return Expr("max", (lift(a), lift(b)))


def lt(a, b) -> Expr:
    a, b = lift(a), lift(b)
    if a.maybe or b.maybe:
        raise Absent("a comparison may not be written over an expression that may be absent; use or_")
    return Expr("lt", (a, b))


def gt(a, b) -> Expr:
    return lt(b, a)


def powi(x, n: int) -> Expr:
    return Expr("powi", (lift(x),), n)


def select(c, a, b) -> Expr:
    c = lift(c)
    if c.maybe:
        raise Absent("a condition may not be absent; use or_")
    return Expr("select", (c, lift(a), lift(b)))


def or_(x, fallback) -> Expr:
    return Expr("or", (lift(x), lift(fallback)))


def sum_(*terms) -> Expr:
    return reduce(lambda a, b: a + b, map(lift, terms))


# reading: a value


def _value(e: Expr, a: list) -> float | None:
    match e.op:
        case "min" | "max":
            got = [x for x in a if x is not None]
            return (min if e.op == "min" else max)(got) if got else None
        case "present":
            return float(a[0] is not None)
        case "or":
            return a[1] if a[0] is None else a[0]
    if any(x is None for x in a):
        return None
    try:
        match e.op:
            case "+":
                return a[0] + a[1]
            case "-":
                return a[0] - a[1]
            case "*":
                return a[0] * a[1]
            case "/":
                return a[0] / a[1]
            case "neg":
                return -a[0]
            case "lt":
                return float(a[0] < a[1])
            case "square":
                return a[0] * a[0]
            case "abs":
                return abs(a[0])
            case "sqrt":
                return math.sqrt(a[0])
            case "exp":
                return math.exp(a[0])
            case "powi":
                p = math.prod([a[0]] * abs(e.value))
                return p if e.value >= 0 else 1 / p
    except (ZeroDivisionError, ValueError, OverflowError):
        return None
    raise ValueError(e.op)


def evaluate(e: Expr, env) -> float | None:
    match e.op:
        case "const":
            return e.value
        case "var":
            return env[e.value]
        case "absent":
            return None
        case "select":
            return evaluate(e.args[1] if evaluate(e.args[0], env) else e.args[2], env)
    return _value(e, [evaluate(x, env) for x in e.args])


# reading: a Spark column


def to_column(e: Expr, env) -> Column:
    """Built-in functions only, so the expression stays inside generated code."""
    match e.op:
        case "const":
            return F.lit(e.value)
        case "var":
            return env[e.value].cast("double")
        case "absent":
            return F.lit(None).cast("double")
    a = [to_column(x, env) for x in e.args]
    match e.op:
        case "+":
            return a[0] + a[1]
        case "-":
            return a[0] - a[1]
        case "*":
            return a[0] * a[1]
        case "/":
            return F.try_divide(a[0], a[1])
        case "neg":
            return -a[0]
        case "min":
            return F.least(*a)
        case "max":
            return F.greatest(*a)
        case "lt":
            return (a[0] < a[1]).cast("double")
        case "present":
            return a[0].isNotNull().cast("double")
        case "square":
            return a[0] * a[0]
        case "abs":
            return F.abs(a[0])
        case "sqrt":
            return F.when(a[0] >= 0, F.sqrt(a[0]))
        case "exp":
            return F.exp(a[0])
        case "powi":
            p = reduce(lambda x, y: x * y, [a[0]] * abs(e.value), F.lit(1.0))
            return p if e.value >= 0 else F.try_divide(F.lit(1.0), p)
        case "select":
            return F.when(a[0] != 0, a[1]).otherwise(a[2])
        case "or":
            return F.coalesce(*a)
    raise ValueError(e.op)


def to_struct(slots: dict[str, Expr], env) -> Column:
    """Several expressions over one environment, a slot each."""
    return F.struct(*[to_column(e, env).alias(name) for name, e in slots.items()])


# reading: derivatives


def diff(e: Expr, i: int) -> Expr:
    """The exact derivative by variable ``i``, as another tree. Absent at the kink of ``abs``."""
    d = lambda x: diff(x, i)
    a = e.args
    match e.op:
        case "var":
            return lift(1.0 if e.value == i else 0.0)
        case "absent":
            return absent
        case "const" | "lt" | "present":
            return lift(0.0)
        case "+" | "-":
            return Expr(e.op, (d(a[0]), d(a[1])))
        case "*":
            return d(a[0]) * a[1] + a[0] * d(a[1])
        case "/":
            return (d(a[0]) * a[1] - a[0] * d(a[1])) / square(a[1])
        case "neg":
            return -d(a[0])
        case "square":
            return 2.0 * a[0] * d(a[0])
        case "abs":
            if simplify(d(a[0])) == lift(0.0):
                return lift(0.0)
            return select(Expr("lt", (lift(0), a[0])), d(a[0]), select(Expr("lt", (a[0], lift(0))), -d(a[0]), absent))
        case "sqrt":
            return d(a[0]) / (2.0 * e)
        case "exp":
            return e * d(a[0])
        case "powi":
            return float(e.value) * powi(a[0], e.value - 1) * d(a[0])
        case "select":
            return Expr("select", (a[0], d(a[1]), d(a[2])))
        case "or":
            return Expr("select", (present(a[0]), d(a[0]), d(a[1])))
        case "min" | "max":  # a tie is the right operand's
            first = Expr("lt", a if e.op == "min" else a[::-1])
            return Expr("select", (present(a[0]), Expr("select", (present(a[1]), Expr("select", (first, d(a[0]), d(a[1]))), d(a[0]))), d(a[1])))
    raise ValueError(e.op)


def simplify(e: Expr) -> Expr:
    """Folds constants and drops zeros and ones."""
    a = tuple(simplify(x) for x in e.args)
    e = Expr(e.op, a, e.value)
    if a and all(x.op == "const" for x in a) and e.op != "select":
        v = _value(e, [x.value for x in a])
        return absent if v is None else lift(v)
    is_ = lambda x, v: x.op == "const" and x.value == v
    match e.op:
        case "+":
            return a[1] if is_(a[0], 0) else a[0] if is_(a[1], 0) else e
        case "-":
            return a[0] if is_(a[1], 0) else simplify(-a[1]) if is_(a[0], 0) else e
        case "*":
            if any(is_(x, 0) for x in a):
                return lift(0.0)
            return a[1] if is_(a[0], 1) else a[0] if is_(a[1], 1) else e
        case "/":
            return lift(0.0) if is_(a[0], 0) else a[0] if is_(a[1], 1) else e
        case "neg":
            return a[0].args[0] if a[0].op == "neg" else e
        case "select":
            if a[0].op == "const":
                return a[1] if a[0].value else a[2]
            return a[1] if a[1] == a[2] else e
        case "powi":
            return lift(1.0) if e.value == 0 else a[0] if e.value == 1 else e
    return e


def gradient(e: Expr, env, n: int) -> list[float | None]:
    """Partials at a point. At the kink of ``abs`` the subgradient 0 is taken."""
    return [0.0 if (v := evaluate(diff(e, i), env)) is None and evaluate(e, env) is not None else v for i in range(n)]


# reading: text


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def infix(e: Expr, names=None) -> str:
    t = [infix(x, names) for x in e.args]
    match e.op:
        case "const":
            return _number(e.value)
        case "var":
            return names[e.value] if names else f"x{e.value}"
        case "+" | "-" | "*" | "/":
            return f"({t[0]} {e.op} {t[1]})"
        case "neg":
            return f"-{t[0]}"
        case "square":
            return f"{t[0]}^2"
        case "powi":
            return f"{t[0]}^{e.value}"
        case "abs":
            return f"|{t[0]}|"
        case "lt":
            return f"({t[0]} < {t[1]})"
        case "select":
            return f"({t[0]} ? {t[1]} : {t[2]})"
        case "absent":
            return "absent"
    return f"{e.op}({', '.join(t)})"


def latex(e: Expr, names=None) -> str:
    t = [latex(x, names) for x in e.args]
    match e.op:
        case "const":
            return _number(e.value)
        case "var":
            return names[e.value] if names else f"x_{{{e.value}}}"
        case "+" | "-":
            return rf"\left({t[0]} {e.op} {t[1]}\right)"
        case "*":
            return rf"{t[0]} \cdot {t[1]}"
        case "/":
            return rf"\frac{{{t[0]}}}{{{t[1]}}}"
        case "neg":
            return f"-{t[0]}"
        case "square":
            return f"{t[0]}^{{2}}"
        case "powi":
            return f"{t[0]}^{{{e.value}}}"
        case "abs":
            return rf"\left|{t[0]}\right|"
        case "sqrt":
            return rf"\sqrt{{{t[0]}}}"
        case "exp":
            return rf"e^{{{t[0]}}}"
        case "lt":
            return rf"\left[{t[0]} < {t[1]}\right]"
        case "select":
            return rf"\begin{{cases}} {t[1]} & {t[0]} \\ {t[2]} & \text{{else}} \end{{cases}}"
        case "absent":
            return r"\varnothing"
    return rf"\operatorname{{{e.op}}}\left({', '.join(t)}\right)"


def trace(e: Expr, env, names=None, depth: int = 0) -> list[str]:
    """The tree with the value of every node, one a line, the branch taken only."""
    v = evaluate(e, env)
    head = infix(e, names) if e.op in ("const", "var") else e.op
    out = [f"{'  ' * depth}{head} = {'absent' if v is None else _number(v)}"]
    below = e.args if e.op != "select" else (e.args[0], e.args[1] if evaluate(e.args[0], env) else e.args[2])
    if e.op == "or":
        below = e.args[:1] if evaluate(e.args[0], env) is not None else e.args
    for x in below:
        out += trace(x, env, names, depth + 1)
    return out
