"""Mathematical equality of answers with three values: equal, different, not provable (null).

Solution sets are tokenised in Spark and compared in exact arithmetic over
a whitelisted grammar: numbers, names, + - * / **, unary signs, sqrt and parentheses. Values are
quotients of polynomials with rational coefficients over names and square roots of square-free
integers. What does not parse, or is too large, is null.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Limits:
    """Safety limits, which a caller may set and which go to the workers with the comparison.

    Beyond them an answer is held for a person, never graded wrong.
    """

    length: int = 200  #: of a text
    power: int = 64  #: largest exponent
    terms: int = 400  #: most terms of a polynomial
    squares: int = 10**10  #: largest number that is searched for squares


LIMITS = Limits()
# What names an answer, as in `x =`, and what stands for an operator or a constant in answers.
NAMED, NAMES_NEXT = r"^[a-zA-Z](?U)\w*=", r"\s+(?=[a-zA-Z](?U)\w*=)"
SIGNS = (("×", "*"), ("÷", "/"), ("−", "-"), ("π", "pi"), ("^", "**"), (" ", ""))

Term = tuple[tuple[str, int], ...]
Poly = dict[Term, Fraction]


def solution_set(answers: Column) -> Column:
    """Parts of an array of answers: split at commas and before `name=`, signs unified, `name=` dropped; null if none."""

    def one(text: Column) -> Column:
        out = F.regexp_replace(text, NAMES_NEXT, ",")
        for old, new in SIGNS:
            out = F.replace(out, F.lit(old), F.lit(new))
        return F.transform(F.split(out, ","), lambda p: F.regexp_replace(p, NAMED, ""))

    parts = F.filter(F.flatten(F.transform(F.filter(answers, lambda a: a.isNotNull()), one)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


class Unclear(Exception):
    """Not provable either way."""


def _mul(a: Poly, b: Poly, limits: Limits) -> Poly:
    out: Poly = {}
    for x, m in a.items():
        for y, n in b.items():
            powers: dict[str, int] = dict(x)
            factor = m * n
            for name, k in y:
                powers[name] = powers.get(name, 0) + k
            for name in [s for s in powers if s.startswith("sqrt:")]:
                whole, powers[name] = divmod(powers[name], 2)
                factor *= Fraction(int(name[5:])) ** whole
            term = tuple(sorted((s, k) for s, k in powers.items() if k))
            out[term] = out.get(term, Fraction(0)) + factor
    if len(out) > limits.terms:
        raise Unclear
    return _merged_roots({t: c for t, c in out.items() if c}, limits)


def _merged_roots(p: Poly, limits: Limits) -> Poly:
    """Products of roots as one root."""
    out: Poly = {}
    for term, c in p.items():
        roots = [int(s[5:]) for s, _ in term if s.startswith("sqrt:")]
        if len(roots) > 1:
            inside = 1
            for r in roots:
                inside *= r
            outer, free = _square_free(inside, limits)
            rest = [(s, k) for s, k in term if not s.startswith("sqrt:")]
            term, c = tuple(sorted([*rest, *([(f"sqrt:{free}", 1)] if free > 1 else [])])), c * outer
        out[term] = out.get(term, Fraction(0)) + c
    return {t: c for t, c in out.items() if c}


def _add(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for t, c in b.items():
        out[t] = out.get(t, Fraction(0)) + sign * c
    return {t: c for t, c in out.items() if c}


def _square_free(n: int, limits: Limits) -> tuple[int, int]:
    """a, b with n = a * a * b and b square-free."""
    if n > limits.squares:
        raise Unclear
    a, d = 1, 2
    while d * d <= n:
        while n % (d * d) == 0:
            n //= d * d
            a *= d
        d += 1
    return a, n


Ratio = tuple[Poly, Poly]
_ONE: Poly = {(): Fraction(1)}


def _value(node: ast.AST, limits: Limits) -> Ratio:
    if isinstance(node, ast.Expression):
        return _value(node.body, limits)
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        number = Fraction(str(node.value))
        return ({(): number} if number else {}), _ONE
    if isinstance(node, ast.Name):
        return {((node.id, 1),): Fraction(1)}, _ONE
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        top, bottom = _value(node.operand, limits)
        return (top if isinstance(node.op, ast.UAdd) else _add({}, top, -1)), bottom
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "sqrt" and len(node.args) == 1 and not node.keywords:
        return _root(_value(node.args[0], limits), limits)
    if isinstance(node, ast.BinOp):
        a, b = _value(node.left, limits), _value(node.right, limits)
        if isinstance(node.op, ast.Add):
            return _add(_mul(a[0], b[1], limits), _mul(b[0], a[1], limits)), _mul(a[1], b[1], limits)
        if isinstance(node.op, ast.Sub):
            return _add(_mul(a[0], b[1], limits), _mul(b[0], a[1], limits), -1), _mul(a[1], b[1], limits)
        if isinstance(node.op, ast.Mult):
            return _mul(a[0], b[0], limits), _mul(a[1], b[1], limits)
        if isinstance(node.op, ast.Div):
            if not b[0]:
                raise Unclear
            return _mul(a[0], b[1], limits), _mul(a[1], b[0], limits)
        if isinstance(node.op, ast.Pow):
            return _power(a, b, limits)
    raise Unclear


def _number(x: Ratio) -> Fraction:
    """A ratio that is a rational number."""
    top, bottom = x
    if set(top) - {()} or set(bottom) - {()}:
        raise Unclear
    return top.get((), Fraction(0)) / bottom[()]


def _root(x: Ratio, limits: Limits) -> Ratio:
    number = _number(x)
    if number < 0:
        raise Unclear
    outer, free = _square_free(number.numerator * number.denominator, limits)
    scale = Fraction(outer, number.denominator)
    if not number:
        return {}, _ONE
    return {((f"sqrt:{free}", 1),) if free > 1 else (): scale}, _ONE


def _power(a: Ratio, b: Ratio, limits: Limits) -> Ratio:
    k = _number(b)
    if k == Fraction(1, 2):
        return _root(a, limits)
    if k.denominator != 1 or abs(k) > limits.power:
        raise Unclear
    if k < 0:
        if not a[0]:
            raise Unclear
        a = (a[1], a[0])
    out: Ratio = (_ONE, _ONE)
    for _ in range(abs(int(k))):
        out = (_mul(out[0], a[0], limits), _mul(out[1], a[1], limits))
        if any(max(c.numerator.bit_length(), c.denominator.bit_length()) > 4096 for p in out for c in p.values()):
            raise Unclear
    return out


@lru_cache(maxsize=50_000)
def parsed(text: str, limits: Limits = LIMITS) -> Ratio | None:
    """A text as a quotient of polynomials; null if it is none, or too large."""
    if len(text) > limits.length or "//" in text:
        return None
    try:
        return _value(ast.parse(text, mode="eval"), limits)
    except (Unclear, SyntaxError, ValueError, RecursionError, MemoryError, ZeroDivisionError):
        return None


def same(a: Ratio, b: Ratio, limits: Limits = LIMITS) -> bool | None:
    try:
        return not _add(_mul(a[0], b[1], limits), _mul(b[0], a[1], limits), -1)
    except Unclear:
        return None


def same_sets(got: list[str] | None, want: list[str] | None, limits: Limits = LIMITS) -> bool | None:
    """Do two lists match one to one? Null if a part does not parse or a match is not provable."""
    if got is None or want is None or not len(got) or not len(want):
        return None
    left, right = [parsed(x, limits) for x in got], [parsed(x, limits) for x in want]
    if None in left or None in right:
        return None
    if len(left) != len(right):
        return False
    for x in left:
        answers = [same(x, y, limits) for y in right]
        if True in answers:
            del right[answers.index(True)]
        else:
            return None if None in answers else False
    return True


#: Between the parts of a set on the way to a worker; no part holds it.
BETWEEN = "\x1f"


@lru_cache(maxsize=100_000)
def _same_parts(got: str, want: str, limits: Limits) -> bool | None:
    return same_sets(got.split(BETWEEN), want.split(BETWEEN), limits)


# What columns compare, spaces left out: with or without a name, a whole number, a decimal or a short product, or one over a whole number or such a product in
# parentheses; of so few digits that the products of tops and bottoms below fit 38.
_WHOLE = r"(?:0|[1-9]\d{0,4})"
_SHORT = rf"{_WHOLE}(?:\*{_WHOLE}){{0,2}}"
_PLAIN = rf"^(?:[a-zA-Z](?U)\w*(?-U)=)?(?:[+-]?(?:0|[1-9]\d{{0,7}})(?:\.\d{{1,4}})?|[+-]?{_SHORT}|\({_SHORT}\))(?:/(?:{_WHOLE}|\({_SHORT}\)))?$"
_AROUND = r"^[a-zA-Z](?U)\w*=|[()+]"


def _product(factors: Column) -> Column:
    one = lambda k: F.coalesce(F.get(factors, F.lit(k)).cast("long"), F.lit(1).cast("long"))
    return F.when(F.size(factors) > 1, (one(0) * one(1) * one(2)).cast("decimal(19,4)")).otherwise(F.get(factors, F.lit(0)).cast("decimal(19,4)"))


def with_plain_equality(df: DataFrame, student: str, answer: str, out: str, limits: Limits = LIMITS) -> DataFrame:
    """df with a column out: are two arrays of one plain number each equal? Null where one is something else.

    Step by step, so that nothing is worked out twice: the text, the number in it, its top and bottom.
    """
    own = "_" + max([*df.columns, out], key=len)
    names = {f"{x}{k}": f"{own}_{x}{k}" for x in ("text", "number", "top", "bottom") for k in (1, 2)}
    col = lambda x: F.col(names[x])
    for k, given in ((1, student), (2, answer)):
        df = df.withColumn(names[f"text{k}"], F.when(F.size(given) == 1, F.replace(F.get(F.col(given), F.lit(0)), F.lit(" "), F.lit(""))))
    both = col("text2").rlike(_PLAIN) & col("text1").rlike(_PLAIN) & (F.greatest(F.length(names["text1"]), F.length(names["text2"])) <= limits.length)
    df = df.withColumn(names["number1"], F.when(both, F.split(F.regexp_replace(col("text1"), _AROUND, ""), "/")))
    df = df.withColumn(names["number2"], F.when(col("number1").isNotNull(), F.split(F.regexp_replace(col("text2"), _AROUND, ""), "/")))
    df = df.withColumns({names[f"{x}{k}"]: F.split(F.get(col(f"number{k}"), F.lit(at)), r"\*") for k in (1, 2) for at, x in enumerate(("top", "bottom"))})
    df = df.withColumns({names[f"top{k}"]: _product(col(f"top{k}")) for k in (1, 2)} | {names[f"bottom{k}"]: F.when(col(f"bottom{k}").isNull(), F.lit(1)).otherwise(_product(col(f"bottom{k}"))).cast("decimal(15,0)") for k in (1, 2)})
    told = F.when((col("bottom1") != 0) & (col("bottom2") != 0), col("top1") * col("bottom2") == col("top2") * col("bottom1"))
    return df.withColumn(out, told).drop(*names.values())


def _algebra(limits: Limits) -> Callable[[Column, Column], Column]:
    def equal(got: pd.Series, want: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _same_parts(a, b, limits) for a, b in zip(got, want, strict=True)], dtype="object")

    return F.pandas_udf(equal, "boolean")


def with_equality(df: DataFrame, student: str, answer: str, out: str, limits: Limits = LIMITS) -> DataFrame:
    """df with a column out: are two array columns of answers the same solution set? Row by row where they are, without a shuffle; null if either is.

    Plain numbers are compared by columns; only what is left is taken apart and goes to workers, which remember the pairs that they have compared.
    """
    plain = "_" + max([*df.columns, out], key=len)
    left = F.col(plain).isNull() & F.col(student).isNotNull() & F.col(answer).isNotNull()
    listed = lambda c: F.when(left, F.array_join(F.transform(solution_set(F.col(c)), lambda p: F.translate(p, BETWEEN, "")), BETWEEN))
    told = with_plain_equality(df, student, answer, plain, limits)
    return told.withColumn(out, F.coalesce(F.col(plain), _algebra(limits)(listed(student), listed(answer)))).drop(plain)
