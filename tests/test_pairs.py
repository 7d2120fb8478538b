"""Pairs over all files against comparing all with all, and many rules against one at a time."""

import random
import re
import time
from itertools import combinations

from codeloom.detect import engine, test_code as tests_of_file
from codeloom.operators import many_rules, rules, similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(3)
    names = {"".join(rng.choice("ab_é") for _ in range(rng.randrange(1, 12))) for _ in range(300)} | {"get_user_name", "get_user_names", "set_user_name", "get_usr_nme", "x" * 60, "x" * 61, "x" * 58 + "y"}
    for most in (1, 2, 3):
        want = {(a, b, k) for a, b in combinations(sorted(names), 2) if min(len(a), len(b)) > 3 and (k := distance(a, b)) <= min(most, min(len(a), len(b)) // 3)}
        got = similar.similar_names(spark.createDataFrame([(n,) for n in [*names, None, *list(names)[:20]]], "name string"), most)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and want


def test_duplicated_tests_against_all_pairs(spark):
    rng = random.Random(4)
    statements = ["assert x", "work()", "y = 1", "for k in y:\n        work(k)", "self.assertEqual(a, b)", "with q as z:\n        pass", "if a and b:\n        return"]
    codes = []
    for _ in range(40):
        body = [rng.choice(statements[: 3 + rng.randrange(5)]) for _ in range(rng.randrange(1, 9))]
        codes.append("".join(f"def test_{k}():\n" + "".join(f"    {s}\n" for s in (body if rng.random() < 0.5 else body[:-1] + [rng.choice(statements)])) for k in range(rng.randrange(1, 4))))
    files = spark.createDataFrame([(str(k), f"tests/test_{k}.py", c) for k, c in enumerate(codes)], "file_id string, path string, code string")
    members, pairs = similar.duplicated_tests(similar.shapes(engine.facts(files, "test_shapes")))
    own = {(r.file_id, r.name): r["class"] for r in members.collect()}
    shapes = {}
    for k, code in enumerate(codes):
        for f in tests_of_file.shapes(engine.parse(str(k), "a.py", code)):
            shapes[str(k), f.name] = frozenset(f.detail.split(" "))
    assert own.keys() == shapes.keys()
    assert all((own[a] == own[b]) == (shapes[a] == shapes[b]) for a, b in combinations(own, 2))
    by_class = {own[k]: s for k, s in shapes.items()}
    want = {(a, b, len(by_class[a] & by_class[b]), len(by_class[a] | by_class[b])) for a, b in combinations(sorted(by_class), 2) if 100 * len(by_class[a] & by_class[b]) >= 80 * len(by_class[a] | by_class[b])}
    assert {(r["class"], r["other"], r["shared"], r["all"]) for r in pairs.collect()} == want and len(want) > 5
    assert similar.duplicated_tests(similar.shapes(engine.facts(files.limit(0), "test_shapes")))[1].count() == 0


PATTERNS = [
    "foo", "fo+o", "(foo|bar)baz", "(?:foo)+bar", "[fb]oo", "a?bcd", "a*bcd", "x{2,3}yz", "(?i)FooBar", "^import os", r"eval\s*\(", r"\bpass\w+", "a.c", "(ab)?cd", "ab(?!c)d", "(?=ab)cd", "", ".*", "a|bc", "(a(bc)d)e", r"\.env", "é+x", "(?i:ss)t", "a(?i:b)c",
]


def test_a_literal_is_in_every_match():
    rng = random.Random(5)
    pieces = ["foo", "bar", "baz", "o", "f", "abc", "bcd", "xx", "yz", "FOOBAR", "import os", "eval (", "pass", "word", "a", "b", "c", "d", "cd", ".env", "éx", "ss", "ſt", "K", "e", " ", "ſſt", "İ"]
    literals = {p: many_rules.literal_of(p) for p in PATTERNS}
    assert literals["(foo|bar)baz"] == "baz" and literals["(?i)FooBar"] == "foobar" and literals["(a(bc)d)e"] == "abcde" and literals["a|bc"] == literals[""] == literals[".*"] == ""
    matched = 0
    for _ in range(3_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        for p, literal in literals.items():
            for flags in (re.ASCII, 0):
                if re.search(p, text, flags):
                    matched += 1
                    assert literal in many_rules.folded(text), (p, text)
    assert matched > 5_000


def test_same_hits_as_one_rule_at_a_time(spark):
    rng = random.Random(6)
    words = ["foo", "bar", "eval(", "os.system(x)", "TODO", "todo", "#", " ", "\t", "-", "password = 'a'", "\n", "\n", "\n", ""]  # the JVM's word and line ends differ outside ASCII and at \\r
    codes = ["".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(120)] + ["", "\n", None]
    given = [{"id": f"r{k}", "pattern": p, "severity": "high"} for k, p in enumerate(["foo", "fo+", r"eval\s*\(", r"(?i)todo", "^#", r"os\.(system|popen)", "bar$", "x|y", "[ae]v", r"\bbar\b"])] + [{"id": "e", "pattern": "foo", "excludes": ["bar", "#"]}]
    files = spark.createDataFrame([(str(k), c) for k, c in enumerate(codes)], "file_id string, code string")
    from codeloom.sources.tables import lines

    want = sorted(map(tuple, rules.regex_hits(lines(files.filter("code is not null")), given).select("rule_id", "severity", "file_id", "line_no", "hit").collect()))
    got = sorted(map(tuple, many_rules.many_hits(files, given).collect()))
    assert got == want and len(want) > 300


def test_a_thousand_rules_cost_little_more_than_ten():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = "\n".join(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(12)) for _ in range(4_000))
    given = [{"id": str(k), "pattern": rf"\b{''.join(rng.choice(letters) for _ in range(7))}\s*\("} for k in range(1_000)]

    def took(n):
        matcher = many_rules.Matcher(given[:n])
        began = time.process_time()
        for _ in range(3):
            list(matcher.hits(text))
        return time.process_time() - began

    took(10)
    assert took(1_000) < 3 * took(10)
