r"""Equality of formulas, tested at points.

A formula is read by operator precedence into a postfix program, with stacks of its own, so depth costs no recursion. Two formulas are equal if
they agree at seeded points: exactly modulo large primes where only arithmetic and whole powers occur (a wrong agreement has a chance below 1e-30), at
complex points to nine digits where roots, logarithms or angles do. Two equations are equal if their sides' differences keep one ratio at all points.

Reads numbers, letters (with a subscript), ``\pi``, ``+ - * / ^``, ``\cdot \times \div``, products without a sign, ``\frac``, ``\sqrt`` with or without an index, ``\sin \cos \tan \log \ln``
with powers, inverses and bases, and brackets. Anything else (lists, factorials, two signs in a row) is no formula.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable
from fractions import Fraction
from zlib import crc32

PRIMES = ((1 << 61) - 1, (1 << 89) - 1)
POINTS, LEAST = 6, 3
#: Bits of a constant that is kept exactly, as exponents must be.
EXACT_BITS = 256
DIGITS = 1e-9

_TOKEN = re.compile(r"\s+|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<command>\\[A-Za-z]+)|(?P<letters>[A-Za-z]+)|(?P<sign>[-+*/^()\[\]{}_])")
_FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log10}
_INVERSES = {"sin": cmath.asin, "cos": cmath.acos, "tan": cmath.atan}
_SIGNS = {r"\cdot": "*", r"\times": "*", r"\div": "/"}
#: Binding of signs; products without a sign bind tighter than a function, and those tighter than a written sign.
_BINDS = {"+": 1, "-": 1, "neg": 2, "*": 3, "/": 3, "call": 4, "times": 5, "^": 6}
_CLOSERS = {"(": ")", "[": "]", "{": "}"}

Step = tuple  # ("number", Fraction) | ("name", text) | (sign,) | ("call", function)


class NotAFormula(ValueError):
    pass


class _NeedsPoints(Exception):
    """Exact evaluation can't express a step."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise NotAFormula(text[at])
        at = m.end()
        if m.lastgroup == "letters" and m[0] not in _FUNCTIONS and m[0] != "sqrt":
            out += [("name", c) for c in m[0]]
        elif m.lastgroup in ("letters", "command"):
            name = m[0].removeprefix("\\")
            out.append(("sign", _SIGNS[m[0]]) if m[0] in _SIGNS else ("name", "pi") if name == "pi" else ("command", name))
        elif m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens = _tokens(text)
        self.at = 0
        self.program: list[Step] = []
        self.signs: list[tuple] = []  # pending signs and open brackets
        self.operand = False  # whether an operand has just ended

    def peek(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise NotAFormula("end")
        self.at += 1
        return self.tokens[self.at - 1]

    # signs

    def reduce(self, least: float) -> None:
        while self.signs and self.signs[-1][0] in _BINDS and _BINDS[self.signs[-1][0]] >= least:
            s = self.signs.pop()
            self.program.append(s if s[0] == "call" else ("*",) if s[0] == "times" else s)

    def sign(self, s: str) -> None:
        if not self.operand:
            if s in "+-" and self.signs[-1:] == [("^",)] and (self.peek() or ("",))[0] == "number":  # the sign of an exponent without braces
                self.push(("number", Fraction(s + self.take()[1])))
                return
            if s not in "+-" or (self.signs and self.signs[-1][0] in _BINDS):
                raise NotAFormula(s)  # a sign stands first or behind a bracket
            if s == "-":
                self.signs.append(("neg",))
                return
            return
        self.reduce(_BINDS[s] + (0.5 if s == "^" else 0))  # powers bind from the right
        self.signs.append((s,))
        self.operand = False

    def begin(self, function: bool = False) -> None:
        """Before an operand: a product without a sign."""
        if self.operand:
            s = "*" if function else "times"
            self.reduce(_BINDS[s])
            self.signs.append((s,))
            self.operand = False

    def push(self, step: Step) -> None:
        self.program.append(step)
        self.operand = True

    # brackets: what an open one does when it closes

    def open(self, closer: str, then: tuple = ()) -> None:
        self.begin()
        self.signs.append(("(", closer, then))

    def close(self, closer: str) -> None:
        if not self.operand:
            raise NotAFormula("empty")
        self.reduce(0)
        if not self.signs or self.signs[-1][1] != closer:
            raise NotAFormula(closer)
        _, _, then = self.signs.pop()
        if not then:
            return
        if then[0] == "root":
            self.program += [("number", Fraction(1, then[1])), ("^",)]
        elif then[0] == "call":
            self.program.append(then)
        elif then[0] == "above":
            self.operand = False
            self.argument(("below",))
        else:  # below a fraction's bar
            self.program.append(("/",))

    def argument(self, then: tuple) -> None:
        """A group, or a single digit or letter, behind a command."""
        kind, x = self.take()
        if x == "{":
            self.signs.append(("(", "}", then))
        elif kind == "number" and x.isdecimal():
            if len(x) > 1:  # one digit is the argument, the others follow
                self.at -= 1
                self.tokens[self.at] = (kind, x[1:])
            self.signs.append(("(", "one", then))
            self.push(("number", Fraction(int(x[0]))))
            self.close("one")
        elif kind == "name":
            self.signs.append(("(", "one", then))
            self.push(("name", x))
            self.close("one")
        else:
            raise NotAFormula(x)

    def whole(self) -> int:
        """A whole number, alone or in braces, with or without a minus."""
        kind, x = self.take()
        if x == "{":
            n = self.whole()
            if self.take()[1] != "}":
                raise NotAFormula("}")
            return n
        if x == "-":
            return -self.whole()
        if kind != "number" or not x.isdecimal() or len(x) > 18:
            raise NotAFormula(x)
        return int(x)

    def command(self, name: str) -> None:
        if name == "frac":
            self.begin()
            self.argument(("above",))
        elif name == "sqrt":
            self.begin()
            index = 2
            if self.peek() == ("sign", "["):
                self.take()
                index = self.whole()
                if self.take()[1] != "]" or index < 1:
                    raise NotAFormula("index")
            if self.peek() == ("sign", "("):
                self.take()
                self.signs.append(("(", ")", ("root", index)))
            else:
                self.argument(("root", index))
        elif name in _FUNCTIONS:
            self.begin(function=True)
            f, power = _FUNCTIONS[name], 1
            while self.peek() in (("sign", "_"), ("sign", "^")):
                if self.take()[1] == "_":
                    base = self.whole()
                    if name != "log" or base < 2:
                        raise NotAFormula("base")
                    f = _log_to(base)
                else:
                    power = self.whole()
            if power == -1 and name in _INVERSES:
                f, power = _INVERSES[name], 1
            if self.peek() in (("sign", "("), ("sign", "{")):  # brackets end the argument
                self.signs.append(("(", _CLOSERS[self.take()[1]], ("call", f, power)))
            else:
                self.signs.append(("call", f, power))
        else:
            raise NotAFormula(name)

    def read(self) -> list[Step]:
        while self.at < len(self.tokens):
            kind, x = self.take()
            if kind == "number":
                if self.operand and self.tokens[self.at - 2][0] == "number" and self.program[-1][0] == "number":
                    raise NotAFormula(x)
                if len(x) > 4000:
                    raise NotAFormula("digits")
                self.begin()
                self.push(("number", Fraction(x)))
            elif kind == "name":
                self.begin()
                self.push(("name", x + self.subscript()))
            elif kind == "command":
                self.command(x)
            elif x in _CLOSERS:
                self.open(_CLOSERS[x])
            elif x in ")]}":
                self.close(x)
            elif x == "_":
                raise NotAFormula(x)
            else:
                self.sign(x)
        if not self.operand:
            raise NotAFormula("end")
        self.reduce(0)
        if self.signs:
            raise NotAFormula("open")
        return self.program

    def subscript(self) -> str:
        if self.peek() != ("sign", "_"):
            return ""
        self.take()
        kind, x = self.take()
        parts = []
        if x == "{":
            while (t := self.take())[1] != "}":
                if t[0] not in ("name", "number"):
                    raise NotAFormula(t[1])
                parts.append(t[1])
        elif kind in ("name", "number"):
            parts.append(x)
        else:
            raise NotAFormula(x)
        return "_" + "".join(parts)


def _log_to(base: int) -> Callable[[complex], complex]:
    return lambda z: cmath.log(z) / math.log(base)


def _seed(name: str, point: int) -> int:
    return crc32(f"{point}:{name}".encode()) << 32 | crc32(f"{name}:{point}".encode())


def _kept(f: Fraction | None) -> Fraction | None:
    return f if f is not None and f.numerator.bit_length() + f.denominator.bit_length() <= EXACT_BITS else None


def _exact(program: list[Step], point: int, p: int) -> int | None:
    """The value modulo p; None where it is divided by zero. Constants are carried exactly as long as they are short, for exponents."""
    stack: list[tuple[int, Fraction | None]] = []
    for step in program:
        op = step[0]
        if op == "number":
            f = step[1]
            stack.append((f.numerator * pow(f.denominator, -1, p) % p, _kept(f)))
        elif op == "name":
            stack.append((_seed(step[1], point) % p, None))
        elif op == "neg":
            a, x = stack.pop()
            stack.append((-a % p, None if x is None else -x))
        elif op == "call":
            raise _NeedsPoints
        else:
            (b, y), (a, x) = stack.pop(), stack.pop()
            both = x is not None and y is not None
            if op == "^":
                if y is None or y.denominator != 1:
                    raise _NeedsPoints
                e = y.numerator
                if e < 0 and not a:
                    return None
                short = x is not None and abs(e) * max(x.numerator.bit_length(), x.denominator.bit_length()) <= EXACT_BITS and (x or e >= 0)
                stack.append((pow(a, e % (p - 1), p) if a else int(not e), _kept(x**e) if short else None))
            elif op == "/":
                if not b:
                    return None
                stack.append((a * pow(b, -1, p) % p, _kept(x / y) if both and y else None))
            elif op == "*":
                stack.append((a * b % p, _kept(x * y) if both else None))
            else:
                stack.append(((a + b if op == "+" else a - b) % p, _kept(x + y if op == "+" else x - y) if both else None))
    return stack[0][0]


def _complex(program: list[Step], point: int) -> complex | None:
    """The value at a complex point; None where it isn't defined or too large."""
    stack: list[complex] = []
    try:
        for step in program:
            op = step[0]
            if op == "number":
                stack.append(complex(step[1]))
            elif op == "name":
                h = _seed(step[1], point)
                stack.append(complex(math.pi) if step[1] == "pi" else cmath.rect(0.6 + (h % 1009) / 1009, 2.6 * ((h >> 20) % 1013) / 1013 - 1.3 + (math.pi if h & 1 else 0)))
            elif op == "neg":
                stack.append(-stack.pop())
            elif op == "call":
                stack.append(step[1](stack.pop()) ** step[2])
            else:
                b, a = stack.pop(), stack.pop()
                stack.append(a**b if op == "^" else a / b if op == "/" else a * b if op == "*" else a + b if op == "+" else a - b)
    except (ArithmeticError, ValueError):
        return None
    z = stack[0]
    return z if cmath.isfinite(z) else None


class Formula:
    """A text as a program, with its values at the points."""

    def __init__(self, text: str):
        self.program = _Reader(text).read()
        self.constant = all(s[0] != "name" or s[1] == "pi" for s in self.program)
        self._exact: list[int | None] | None = None
        self._points: list[complex | None] | None = None

    def exact(self) -> list[int | None] | None:
        if self._exact is None:
            try:
                self._exact = [_exact(self.program, point, p) for p in PRIMES for point in range(2)]
            except _NeedsPoints:
                self._exact = []
        return self._exact or None

    def points(self) -> list[complex | None]:
        if self._points is None:
            self._points = [_complex(self.program, k) for k in range(1 if self.constant else POINTS)]
        return self._points


def formula(text: str) -> Formula | None:
    try:
        return Formula(text)
    except (NotAFormula, ArithmeticError, IndexError):
        return None


def _near(a: complex, b: complex, least: float) -> bool:
    return abs(a - b) <= DIGITS * max(abs(a), abs(b)) + least


def _common(a: Formula, b: Formula) -> list[tuple[complex, complex]]:
    """Values at the points where both have one; a constant has the same at all."""
    x, y = a.points(), b.points()
    n = max(len(x), len(y))
    x, y = (v * n if len(v) == 1 else v for v in (x, y))
    return [(u, v) for u, v in zip(x, y, strict=True) if u is not None and v is not None]


def equal(a: Formula, b: Formula) -> bool:
    """Whether two formulas are the same function, or constants that agree to nine digits."""
    x, y = a.exact(), b.exact()
    if x and y:
        pairs = [(u, v) for u, v in zip(x, y, strict=True) if u is not None and v is not None]
        if pairs and all(u == v for u, v in pairs):
            return True
        if not (a.constant and b.constant):
            return False
    some, constant = _common(a, b), a.constant and b.constant
    return len(some) >= (1 if constant else LEAST) and all(_near(u, v, 1e-20 if constant else 1e-12) for u, v in some)


def proportional(a: Formula, b: Formula) -> bool:
    """Whether one is the other times a constant other than zero."""
    x, y = a.exact(), b.exact()
    if x and y:
        pairs = [(u, v, k) for k, (u, v) in enumerate(zip(x, y, strict=True)) if u and v]
        if len(pairs) < len(x):  # zero at a random point is zero
            return False
        each = len(x) // len(PRIMES)
        return all((u * y[k - k % each] - x[k - k % each] * v) % PRIMES[k // each] == 0 for u, v, k in pairs)
    some = _common(a, b)
    if len(some) < (1 if a.constant and b.constant else LEAST) or not all(abs(u) > 1e-12 and abs(v) > 1e-12 for u, v in some):
        return False
    return all(_near(u / v, some[0][0] / some[0][1], 0.0) for u, v in some)
