"""A small LaTeX expression parser and numeric identity testing.

Expressions become trees of tuples; numbers stay exact fractions while they can.
Two expressions are the same if they agree at fixed pseudo-random points
(complex ones included), which decides identities of elementary functions
without a computer algebra system.
"""

from __future__ import annotations

import cmath
import math
import random
import re
from fractions import Fraction

Node = tuple

FUNCTIONS = {"sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "ln", "log", "exp", "lg"}
SKIP = {"left", "right", "displaystyle", "quad", "qquad", ",", ";", ":", "!", " ", "big", "Big", "bigl", "bigr", "Bigl", "Bigr", "limits"}
LEX = re.compile(r"\s+|\\([a-zA-Z]+|.)|(\d+\.?\d*|\.\d+)|([a-zA-Z])|(.)", re.S)


class ParseError(ValueError):
    pass


def lex(text: str) -> list[tuple[str, str]]:
    out = []
    for m in LEX.finditer(text):
        command, number, letter, other = m.groups()
        if command is not None:
            if command not in SKIP:
                out.append(("cmd", command))
        elif number is not None:
            out.append(("num", number))
        elif letter is not None:
            out.append(("sym", letter))
        elif other is not None:
            out.append(("op", other))
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens = lex(text)
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *want: tuple[str, str]) -> bool:
        if self.peek() in want:
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(("op", op)):
            raise ParseError(f"{op} expected")

    def parse(self) -> Node:
        node = self.sum()
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]}")
        return node

    def sum(self) -> Node:
        sign = self.sign()
        node = self.product()
        node = ("neg", node) if sign < 0 else node
        while self.peek() in (("op", "+"), ("op", "-"), ("op", "−")):
            minus = self.peek()[1] != "+"
            self.at += 1
            sign = self.sign() * (-1 if minus else 1)
            right = self.product()
            node = ("add", node, ("neg", right) if sign < 0 else right)
        return node

    def sign(self) -> int:
        s = 1
        while self.peek() in (("op", "+"), ("op", "-"), ("op", "−")):
            s *= 1 if self.peek()[1] == "+" else -1
            self.at += 1
        return s

    def product(self) -> Node:
        node = self.power()
        while True:
            if self.take(("op", "*"), ("cmd", "cdot"), ("cmd", "times"), ("op", "×"), ("op", "·")):
                sign = self.sign()
                right = self.power()
                node = ("mul", node, ("neg", right) if sign < 0 else right)
            elif self.take(("op", "/"), ("cmd", "div"), ("op", "÷")):
                node = ("div", node, self.power())
            elif self.starts_atom():
                node = ("mul", node, self.power())
            else:
                return node

    def starts_atom(self) -> bool:
        kind, value = self.peek()
        return kind in ("num", "sym") or kind == "cmd" and value not in ("end", "cup", "in", "pm", "right", "}") or kind == "op" and value in "([{|" and value != "|"

    def power(self) -> Node:
        base = self.atom()
        while True:
            if self.take(("op", "^")):
                base = ("pow", base, self.group())
            elif self.take(("op", "!")):
                base = ("fact", base)
            elif self.take(("op", "'")):
                base = ("var", str(base[1]) + "'") if base[0] == "var" else base
            else:
                return base

    def group(self) -> Node:
        """An argument: a braced group, or one token."""
        if self.take(("op", "{")):
            node = self.sum()
            self.need("}")
            return node
        if self.peek() in (("op", "-"), ("op", "+")):
            sign = self.sign()
            node = self.atom()
            return ("neg", node) if sign < 0 else node
        kind, value = self.peek()
        if kind == "num" and len(value) > 1 and "." not in value:  # a bare argument is one digit
            self.tokens[self.at : self.at + 1] = [("num", value[0]), ("num", value[1:])]
        return self.atom()

    def raw_group(self) -> str:
        if not self.take(("op", "{")):
            kind, value = self.peek()
            self.at += 1
            return ("\\" + value) if kind == "cmd" else value
        depth, out = 1, []
        while depth:
            kind, value = self.peek()
            if kind == "end":
                raise ParseError("unclosed group")
            self.at += 1
            depth += (kind, value) == ("op", "{")
            depth -= (kind, value) == ("op", "}")
            if depth:
                out.append(("\\" + value) if kind == "cmd" else value)
        return "".join(out)

    def subscript(self, name: str) -> str:
        if self.take(("op", "_")):
            name += "_" + self.raw_group()
        return name

    def atom(self) -> Node:
        kind, value = self.peek()
        if kind == "end":
            raise ParseError("unexpected end")
        self.at += 1
        if kind == "num":
            return ("num", Fraction(value if not value.endswith(".") else value[:-1]))
        if kind == "sym":
            name = self.subscript(value)
            return ("e",) if name == "e" else ("var", name)
        if kind == "op":
            if value in "([{":
                node = self.sum()
                self.need({"(": ")", "[": "]", "{": "}"}[value])
                return node
            if value == "|":
                node = self.sum()
                self.need("|")
                return ("abs", node)
            if value == "π":
                return ("pi",)
            if value == "√":
                return ("pow", self.group(), ("num", Fraction(1, 2)))
            if value == "∞":
                return ("inf",)
            raise ParseError(f"unexpected {value}")
        return self.command(value)

    def command(self, value: str) -> Node:
        if value in ("frac", "dfrac", "tfrac"):
            top = self.group()
            return ("div", top, self.group())
        if value == "sqrt":
            root: Node = ("num", Fraction(2))
            if self.take(("op", "[")):
                root = self.sum()
                self.need("]")
            return ("pow", self.group(), ("div", ("num", Fraction(1)), root))
        if value == "pi":
            return ("pi",)
        if value == "infty":
            return ("inf",)
        if value in ("{", "}"):
            raise ParseError("set braces")
        if value in ("mathrm", "text", "operatorname", "mathbf", "vec", "hat", "bar", "boldsymbol", "overline", "mathit"):
            name = self.raw_group()
            return ("e",) if name == "e" else ("var", self.subscript(value + ":" + name if value in ("vec", "hat", "bar", "overline") else name))
        if value in FUNCTIONS:
            base = None
            power = None
            if value == "log" and self.take(("op", "_")):
                base = self.group()
            if self.take(("op", "^")):
                power = self.group()
            if value == "log" and base is None and self.take(("op", "_")):
                base = self.group()
            if self.take(("op", "(")):
                inner = self.sum()
                self.need(")")
            else:
                inner = self.power()
                while self.starts_atom() and self.peek()[0] in ("num", "sym") or self.peek()[0] == "cmd" and self.peek()[1] in ("pi", "alpha", "beta", "theta", "phi", "omega"):
                    inner = ("mul", inner, self.power())
            node: Node = ("fn", "log10" if value == "lg" else value, inner) if base is None else ("div", ("fn", "ln", inner), ("fn", "ln", base))
            if power == ("neg", ("num", Fraction(1))) and value in ("sin", "cos", "tan"):
                return ("fn", "arc" + value, inner)
            return ("pow", node, power) if power is not None else node
        if value.isalpha():
            return ("var", self.subscript("\\" + value))
        raise ParseError(f"unknown \\{value}")


def parse(text: str) -> Node:
    return Parser(text).parse()


def variables(node: Node) -> set[str]:
    if node[0] == "var":
        return {node[1]}
    return set().union(*(variables(x) for x in node[1:] if isinstance(x, tuple))) if len(node) > 1 else set()


_FN = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh,
    "tanh": cmath.tanh, "ln": cmath.log, "log": cmath.log, "log10": cmath.log10, "exp": cmath.exp, "cot": lambda z: 1 / cmath.tan(z), "sec": lambda z: 1 / cmath.cos(z),
    "csc": lambda z: 1 / cmath.sin(z),
}


def value(node: Node, env: dict[str, complex]):
    """Exact fraction while every step is rational, complex otherwise."""
    kind = node[0]
    if kind == "num":
        return node[1]
    if kind == "var":
        return env[node[1]]
    if kind == "pi":
        return math.pi
    if kind == "e":
        return math.e
    if kind == "inf":
        return math.inf
    a = value(node[1], env) if kind != "fn" else None
    if kind == "neg":
        return -a
    if kind == "abs":
        return abs(a)
    if kind == "fact":
        if isinstance(a, Fraction) and a.denominator == 1 and 0 <= a <= 170:
            return Fraction(math.factorial(int(a)))
        raise ValueError("factorial")
    if kind == "fn":
        return _FN[node[1]](complex(value(node[2], env)))
    b = value(node[2], env)
    if kind in ("add", "mul", "div"):
        if not (isinstance(a, Fraction) and isinstance(b, Fraction)):
            a, b = complex(a), complex(b)
        return a + b if kind == "add" else a * b if kind == "mul" else a / b
    if isinstance(a, Fraction) and isinstance(b, Fraction) and b.denominator == 1 and abs(b) <= 400:
        return a ** int(b)
    if abs(complex(b)) > 1e6:
        raise OverflowError("power")
    return complex(a) ** complex(b)


def number(node: Node) -> float:
    """The real value of an expression without variables."""
    v = complex(value(node, {}))
    if abs(v.imag) > 1e-9 * max(1.0, abs(v.real)) or v != v:
        raise ValueError("not a real number")
    return v.real


def sample_points(names: set[str], n: int = 30) -> list[dict[str, complex]]:
    """Variables may be any numbers, so points are positive, of either sign, and complex in all quadrants: what holds for positive ones only is no identity."""
    rng = random.Random(20240229)
    order = sorted(names)
    size = lambda: rng.uniform(0.3, 2.7)
    signed = lambda: size() * rng.choice((-1, 1))
    kinds = (lambda: complex(size()), lambda: complex(signed()), lambda: complex(signed(), signed()))
    return [{v: kinds[i % 3]() for v in order} for i in range(n)]


def differences(a: Node, b: Node) -> list[tuple[complex, complex]]:
    """Values of both at the sample points where both are defined."""
    out = []
    for env in sample_points(variables(a) | variables(b)):
        try:
            x, y = complex(value(a, env)), complex(value(b, env))
        except (ValueError, ZeroDivisionError, OverflowError):
            continue
        if x == x and y == y and abs(x) < 1e200 and abs(y) < 1e200:
            out.append((x, y))
    return out


def same(a: Node, b: Node, tolerance: float = 1e-9) -> bool:
    if a == b:
        return True
    points = differences(a, b)
    return len(points) >= 2 and all(abs(x - y) <= tolerance * max(1.0, abs(x), abs(y)) for x, y in points)


def integer_multiple(a: Node, b: Node) -> bool:
    """a = k b or b = k a for one nonzero integer k, everywhere."""
    points = differences(a, b)
    if len(points) < 2:
        return False
    if all(abs(x) < 1e-12 and abs(y) < 1e-12 for x, y in points):
        return True
    for swap in (False, True):
        ratios = [(y / x if swap else x / y) for x, y in points if (x if swap else y) != 0]
        if len(ratios) >= 2:
            k = round(ratios[0].real)
            if k and all(abs(r - k) < 1e-7 * abs(k) for r in ratios):
                return True
    return False
