"""Values along paths and structured reduction: hand-made cases, and random programs that are run."""

import ast
import random

import pytest

from codeloom.detect import cfg, engine, values


def found(code, kind="PATH_DIVISION"):
    return [f.line_number for f in values.detect(engine.parse("a", "a.py", code)) if f.kind == "issue" and f.name == kind]


DIVISIONS = {
    "def f(n):\n    if n:\n        return 1 / n\n    else:\n        return 2 / n\n": [5],
    "def f(n):\n    if n == 0:\n        return 0\n    return 1 / n\n": [],
    "def f(n):\n    if n > 0 and 1 / n:\n        pass\n    return 1 / n\n": [4],
    "def f(n):\n    if not n or 1 // n:\n        pass\n": [],
    "def f(n):\n    return 1 / n if n else n / n\n": [2],
    "def f(a):\n    n = len(a)\n    return 1 / n\n": [3],
    "def f(a):\n    n = len(a) + 1\n    return 1 / n\n": [],
    "def f(a):\n    n = max(len(a), 1)\n    return 1 % n\n": [],
    "def f(a):\n    n = a or 1\n    return 1 % n\n": [],
    "def f(a):\n    for i in range(1, a):\n        1 / i\n    for j in range(5):\n        1 / j\n": [5],
    "def f(a):\n    i = 1\n    while i < 10:\n        1 / i\n        i += 1\n    return 1 / i\n": [],
    "def f(a):\n    i = 10\n    while i > -10:\n        1 / i\n        i -= 1\n": [4],
    "def f(a):\n    i = 3\n    while True:\n        if i == 0:\n            break\n        1 / i\n        i -= 1\n": [],
    "def f(n):\n    try:\n        n = 0\n        g()\n        n = 1\n    except E:\n        1 / n\n    return 1 / n\n": [7, 8],
    "def f(n):\n    assert n\n    return 1 / n\n": [3],
    "def f(n):\n    n = 0\n    n /= n\n": [3],
    "def f(n):\n    'a%s' % n\n": [],
    "def f(n):\n    if 0 < n < 5:\n        return 1 / n\n": [],
    "def f(n):\n    if n != 0:\n        1 / n\n    if n >= 0:\n        1 / n\n    if 0 > n:\n        1 / n\n": [5],
    "def f(n):\n    [1 / n for k in n]\n    [1 / k for k in n if k]\n": [2],
    "n = 2\ndef f():\n    global n\n    n = 0\n1 / n\n": [5],
    "def f(n):\n    if (m := n):\n        return 1 / m\n": [],
    "def f(n):\n    return\n    1 / n\n": [],
}


@pytest.mark.parametrize("code", DIVISIONS)
def test_divisions(code):
    assert found(code) == DIVISIONS[code]


NULLS = {
    "def f(a=None):\n    return a.b\n": [2],
    "def f(a=None):\n    if a is None:\n        a = []\n    return a[0]\n": [],
    "def f(a=None):\n    if a is not None:\n        return a.b\n    return a.b\n": [4],
    "def f(a=None):\n    if a:\n        return a.b\n": [],
    "def f(a=None):\n    return a and a.b\n": [],
    "def f(a=None):\n    return a is None or a.b\n": [],
    "def f(a=None):\n    a = a or {}\n    return a['k']\n": [],
    "def f(c):\n    x = None\n    if c:\n        x = g()\n    return x.y\n": [5],
    "def f(c):\n    x = None\n    for k in c:\n        x = k\n    return x.y\n": [5],
    "def f(a):\n    return a.b\n": [],
    "def f(*, a=None):\n    if not isinstance(a, str):\n        return 1\n    return a.b\n": [],
    "def f(a=None):\n    if a == None:\n        raise E\n    return a.b\n": [],
    "def f(a=None):\n    while a is not None:\n        a = a.next\n": [],
}


@pytest.mark.parametrize("code", NULLS)
def test_nulls(code):
    assert found(code, "PATH_NONE") == NULLS[code]


def test_overflow():
    assert found("a = 2000000 * 3\nb = 10 ** 30\nc = 4000000000 * 4000000000\nd = x * 10 ** 30\n", "PATH_OVERFLOW") == [2, 3, 4]


def program(rng):
    """Statements over three names, with divisions, branches and loops; it always ends."""
    lines, divisions = [], []

    def expr():
        return rng.choice([rng.choice("abc"), str(rng.randrange(-3, 4)), f"{rng.choice('abc')} + {rng.randrange(-2, 3)}", f"{rng.choice('abc')} - {rng.choice('abc')}", f"{rng.choice('abc')} * {rng.randrange(-2, 3)}", f"max({rng.choice('abc')}, {rng.randrange(-1, 3)})", f"{rng.choice('abc')} or {rng.randrange(3)}", f"abs({rng.choice('abc')})", f"({rng.choice('abc')} if {rng.choice('abc')} > 0 else {rng.randrange(3)})"])

    def test():
        x = rng.choice("abc")
        return rng.choice([x, f"not {x}", f"{x} {rng.choice(['<', '<=', '>', '>=', '==', '!='])} {rng.randrange(-2, 3)}", f"{x} > 0 and {rng.choice('abc')} != 0", f"{x} == 0 or {rng.choice('abc')} < 1", f"{x} < {rng.choice('abc')}"])

    def body(pad, depth, loop):
        lines.append(f"{pad}pass")
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(9 if depth < 3 else 4)
            if kind < 2:
                lines.append(f"{pad}{rng.choice('abc')} = {expr()}")
            elif kind < 4:
                lines.append(f"{pad}log({len(lines) + 1}, 7 // {rng.choice('abc')})")
                divisions.append(len(lines))
            elif kind < 6:
                lines.append(f"{pad}if {test()}:")
                body(pad + " ", depth + 1, loop)
                if rng.random() < 0.6:
                    lines.append(f"{pad}else:")
                    body(pad + " ", depth + 1, loop)
            elif kind == 6:
                lines.append(f"{pad}for {rng.choice('abc')} in range({rng.randrange(-2, 2)}, {rng.randrange(1, 4)}):")
                body(pad + " ", depth + 1, True)
            elif kind == 7:
                lines.append(f"{pad}while tick() and ({test()}):")
                body(pad + " ", depth + 1, True)
            elif loop:
                lines.append(f"{pad}{rng.choice(['break', 'continue'])}")
                break
    body(" ", 0, False)
    return "def f(a, b, c):\n" + "\n".join(lines) + "\n"


def test_no_division_by_zero_is_missed():
    """Random programs are run on many inputs: a line that divides by zero is reported. And many divisions are cleared."""
    rng, divided, cleared = random.Random(11), 0, 0
    for _ in range(400):
        code = program(rng)
        reported = set(found(code))
        places = {n.lineno for n in ast.walk(ast.parse(code)) if isinstance(n, ast.BinOp) and isinstance(n.op, ast.FloorDiv)}
        cleared += len(places - reported)
        for _ in range(12):
            left = [30]

            def tick():
                left[0] -= 1
                return left[0] > 0

            space = {"tick": tick, "log": lambda *_: None}
            exec(code, space)
            try:
                space["f"](*(rng.randrange(-2, 3) for _ in range(3)))
            except ZeroDivisionError as e:
                line = e.__traceback__.tb_next.tb_lineno
                divided += 1
                assert line in reported, code
    assert divided > 300 and cleared > 40


def essential(code):
    return cfg.essential(ast.parse(code).body[0])


STRUCTURED = [
    "def f(a):\n  pass\n",
    "def f(a):\n  if a:\n    b()\n  elif c:\n    d()\n  else:\n    e()\n  for x in a:\n    if x:\n      y()\n  while a:\n    for q in a:\n      z()\n  return 1\n",
    "def f(a):\n  if a:\n    return 1\n  return 2\n",
    "def f(a):\n  for x in a:\n    if x:\n      continue\n    y()\n",
    "def f(a):\n  try:\n    b()\n  except E:\n    c()\n  except G:\n    pass\n  else:\n    d()\n  finally:\n    e()\n",
    "def f(a):\n  while True:\n    b()\n    if c:\n      break\n",
    "def f(a):\n  match a:\n    case 1:\n      b()\n    case 2:\n      c()\n    case _:\n      d()\n",
    "def f(a):\n  with a:\n    for x in a:\n      with x:\n        if y:\n          z()\n",
]
UNSTRUCTURED = {
    "def f(a):\n  for x in a:\n    if x:\n      break\n    y()\n": 3,
    "def f(a):\n  for x in a:\n    if x:\n      return x\n    y()\n  return 2\n": 3,
    "def f(a):\n  for x in a:\n    for y in x:\n      if y:\n        break\n      if z:\n        break\n    w()\n": 4,
}


def test_essential_complexity():
    """Jumps out of loops raise it, nesting does not; a chain of thousands of branches is reduced."""
    assert [essential(c) for c in STRUCTURED] == [1] * len(STRUCTURED)
    assert {c: essential(c) for c in UNSTRUCTURED} == UNSTRUCTURED
    assert essential("def g(k):\n    if k == 0:\n        pass\n" + "".join(f"    elif k == {i}:\n        pass\n" for i in range(1_500))) == 1


def test_essential_does_not_depend_on_what_is_structured_around_it():
    for code, n in ((c, essential(c)) for c in UNSTRUCTURED if "return" not in c):
        body = "\n".join("  " + line for line in code.split("\n")[1:] if line)
        assert essential(f"def f(a):\n  if q:\n{body}\n    pass\n  else:\n    w()\n  v()\n") == n
