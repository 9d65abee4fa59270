"""PDF functions compiled to column expressions."""

from __future__ import annotations

import re
from functools import reduce
from math import prod
from operator import mul

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .colour import clamp


def _interval(x: Column, bounds: tuple[float, float]) -> Column:
    return clamp(x, bounds[0], bounds[1])


def _range(out: list[Column], bounds: list[tuple[float, float]] | None) -> list[Column]:
    if not bounds:
        return out
    out = [*out, *[out[-1]] * (len(bounds) - len(out))][: len(bounds)]
    return [_interval(x, b) for x, b in zip(out, bounds)]


def exponential(x: Column, n: float, c0=(0.0,), c1=(1.0,), domain=(0.0, 1.0), bounds=None) -> list[Column]:
    """Type 2: c0 + x ** n * (c1 - c0)."""
    x = _interval(x, domain)
    return _range([F.lit(float(a)) + F.pow(x, F.lit(float(n))) * F.lit(float(b - a)) for a, b in zip(c0, c1)], bounds)


def stitching(x: Column, parts, limits: list[float], encode: list[tuple[float, float]], domain=(0.0, 1.0), bounds=None) -> list[Column]:
    """Type 3: parts are functions of a column; limits divide the domain, and the last part holds its end."""
    x = _interval(x, domain)
    edges = [domain[0], *limits, domain[1]]
    done = []
    for f, low, high, (a, b) in zip(parts, edges, edges[1:], encode):
        done.append(f(F.lit(float(a)) if high == low else F.lit(float(a)) + (x - low) * ((b - a) / (high - low))))
    out = []
    for values in zip(*done):
        chosen = values[-1]
        for limit, value in reversed(list(zip(limits, values))):
            chosen = F.when(x < limit, value).otherwise(chosen)
        out.append(chosen)
    return _range(out, bounds)


def sampled(x: Column, samples: list[float], domain=(0.0, 1.0), encode=None, decode=(0.0, 1.0), high: float = 255.0) -> Column:
    """Type 0 with one input and output: linear between samples."""
    top = len(samples) - 1
    a, b = encode or (0.0, float(top))
    x = _interval(x, domain)
    at = clamp(F.lit(float(a)) + (x - domain[0]) * ((b - a) / (domain[1] - domain[0])), 0.0, float(top))
    table = F.array(*[F.lit(float(s)) for s in samples])
    below = F.floor(at).cast("int")
    low, up = F.get(table, below), F.get(table, F.least(below + 1, F.lit(top)))
    return decode[0] + (low + (at - below) * (up - low)) * ((decode[1] - decode[0]) / high)


def sampled_grid(xs: list[Column], samples: list[float], sizes: list[int], outputs: int = 1, domain=None, encode=None, decode=None, high: float = 255.0, bounds=None) -> list[Column]:
    """Type 0 with several inputs and outputs: multilinear between the corners around a point, with up to 16 inputs; beyond that the sample at the lower corner.

    samples hold the outputs of a place together, and the first input's places follow each
    other. Corners are a fold over their numbers, so the plan grows with the inputs, not with 2 ** inputs.
    """
    n = len(sizes)
    domain, decode = domain or [(0.0, 1.0)] * n, decode or [(0.0, 1.0)] * outputs
    encode = encode or [(0.0, size - 1.0) for size in sizes]
    steps = [prod(sizes[:d]) for d in range(n)]
    table = F.lit(np.asarray(samples, float))
    at = []
    for x, (a, b), (c, d), size in zip(xs, domain, encode, sizes):
        place = F.lit(float(c)) if a == b else c + (_interval(x, (a, b)) - a) * ((d - c) / (b - a))
        at.append(clamp(place, 0.0, size - 1.0))

    def output(places: Column, o: int) -> Column:
        low = [F.floor(F.get(places, F.lit(d))).cast("int") for d in range(n)]
        part = [F.get(places, F.lit(d)) - low[d] for d in range(n)]
        sample = lambda index: F.get(table, index * outputs + o)

        def corner(total: Column, k: Column) -> Column:
            up = [F.shiftright(k, d).bitwiseAND(F.lit(1)) == 1 for d in range(n)]
            weight = reduce(mul, [F.when(u, p).otherwise(1 - p) for u, p in zip(up, part)])
            index = sum((F.when(u, F.least(w + 1, F.lit(size - 1))).otherwise(w) * step for u, w, size, step in zip(up, low, sizes, steps)), F.lit(0))
            return total + weight * sample(index)

        found = F.aggregate(F.sequence(F.lit(0), F.lit(2**n - 1)), F.lit(0.0), corner) if n <= 16 else sample(sum((w * step for w, step in zip(low, steps)), F.lit(0)))
        return decode[o][0] + found * ((decode[o][1] - decode[o][0]) / high)

    def once(o: int) -> Column:
        return F.get(F.transform(F.array(F.array(*at)), lambda places: output(places, o)), F.lit(0))

    return _range([once(o) for o in range(outputs)], bounds)


def _safe(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def _truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _bits(a: Column, b: Column, how: str) -> Column:
    return getattr(a.cast("long"), how)(b.cast("long")).cast("double")


_UNARY = {
    "abs": F.abs, "neg": lambda a: -a, "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"),
    "round": lambda a: F.round(a, 0), "truncate": _truncate, "cvi": _truncate, "cvr": lambda a: a, "sqrt": lambda a: F.when(a < 0, F.lit(0.0)).otherwise(F.sqrt(a)),
    "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)), "ln": lambda a: _safe(F.ln(a)), "log": lambda a: _safe(F.log10(a)),
}
_BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: _safe(F.try_divide(a, b)),
    "idiv": lambda a, b: _safe(_truncate(F.try_divide(_truncate(a), _truncate(b)))), "mod": lambda a, b: _safe(F.try_mod(_truncate(a), _truncate(b))),
    "exp": lambda a, b: _safe(F.pow(a, b)), "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
}
_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_LOGIC = {"and": ("__and__", "bitwiseAND"), "or": ("__or__", "bitwiseOR"), "xor": (None, "bitwiseXOR")}


def parse_program(text: str) -> list:
    """Nested lists of numbers and operators of a type 4 program; raises ValueError where braces do not match."""
    stack: list[list] = [[]]
    for token in re.findall(r"[{}]|[^\s{}]+", text):
        if token == "{":
            stack.append([])
        elif token == "}":
            done = stack.pop()
            if not stack:
                raise ValueError("unmatched brace")
            stack[-1].append(done)
        else:
            try:
                stack[-1].append(float(token))
            except ValueError:
                stack[-1].append(token)
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise ValueError("a program is one pair of braces")
    return stack[0][0]


def _constant(x) -> int:
    if not isinstance(x, float):
        raise ValueError("counts of copy, index and roll must be constants")
    return int(x)


class _Flag(tuple):
    """A boolean column on the stack."""


def _column(x) -> Column:
    if isinstance(x, _Flag):
        return x[0].cast("double")
    return F.lit(x) if isinstance(x, float) else x


def _run(program: list, stack: list) -> list:
    """The stack after a program: floats are constants, columns numbers, flags booleans."""
    i = 0
    while i < len(program):
        op = program[i]
        i += 1
        if isinstance(op, (float, list)):
            stack.append(op)
        elif op in ("true", "false"):
            stack.append(_Flag((F.lit(op == "true"),)))
        elif op == "pop":
            stack.pop()
        elif op == "dup":
            stack.append(stack[-1])
        elif op == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif op == "copy":
            n = _constant(stack.pop())
            stack += stack[len(stack) - n :]
        elif op == "index":
            stack.append(stack[-1 - _constant(stack.pop())])
        elif op == "roll":
            by, n = _constant(stack.pop()), _constant(stack.pop())
            if n:
                top = stack[len(stack) - n :]
                by %= n
                stack[len(stack) - n :] = top[n - by :] + top[: n - by]
        elif op in ("if", "ifelse"):
            other = stack.pop() if op == "ifelse" else []
            then = stack.pop()
            test = stack.pop()
            test = test[0] if isinstance(test, _Flag) else _column(test) != 0
            yes, no = _run(then, list(stack)), _run(other, list(stack))
            if len(yes) != len(no):
                raise ValueError("branches leave stacks of different heights")
            stack = [a if a is b else _Flag((F.when(test, a[0]).otherwise(b[0]),)) if isinstance(a, _Flag) and isinstance(b, _Flag) else F.when(test, _column(a)).otherwise(_column(b)) for a, b in zip(yes, no)]
        elif op == "not":
            x = stack.pop()
            stack.append(_Flag((~x[0],)) if isinstance(x, _Flag) else F.bitwise_not(_column(x).cast("long")).cast("double"))
        elif op in _LOGIC:
            b, a = stack.pop(), stack.pop()
            if isinstance(a, _Flag) and isinstance(b, _Flag):
                stack.append(_Flag((a[0] != b[0] if op == "xor" else getattr(a[0], _LOGIC[op][0])(b[0]),)))
            else:
                stack.append(_bits(_column(a), _column(b), _LOGIC[op][1]))
        elif op == "bitshift":
            by, a = _constant(stack.pop()), _column(stack.pop()).cast("int")
            stack.append((F.shiftleft(a, by) if by >= 0 else F.shiftright(a, -by)).cast("double"))
        elif op in _UNARY:
            stack.append(_UNARY[op](_column(stack.pop())))
        elif op in _BINARY:
            b, a = _column(stack.pop()), _column(stack.pop())
            stack.append(_BINARY[op](a, b))
        elif op in _COMPARE:
            b, a = _column(stack.pop()), _column(stack.pop())
            stack.append(_Flag((_COMPARE[op](a, b),)))
        else:
            raise ValueError(f"unsupported operator {op}")
    return stack


def calculator(text: str, inputs: list[Column], domain: list[tuple[float, float]], bounds: list[tuple[float, float]]) -> list[Column]:
    """Type 4: the program compiled to one expression per output; stack operators vanish at compile time."""
    stack = _run(parse_program(text), [_interval(x, d) for x, d in zip(inputs, domain)])
    return [_interval(_column(x), b) for x, b in zip(stack[len(stack) - len(bounds) :], bounds)]
