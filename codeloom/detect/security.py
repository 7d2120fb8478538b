"""Security: secrets, weak cryptography, injection, misconfiguration, taint."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from .source import Fact, Source, apart, attribute_tail, children, dotted, walk

NAME = "security"
#: Fixed values. Secrets, searched without regard to case in the whole text
SECRETS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "aws_secret_key": r"aws_secret[^=]*=\s*['\"][^'\"]{30,}['\"]",
    "github_token": r"gh[ps]_[a-zA-Z0-9]{36}",
    "generic_api_key": r"api[_-]?key['\"\s]*[:=]\s*['\"][a-zA-Z0-9_\-]{20,}['\"]",
    "generic_secret": r"secret['\"\s]*[:=]\s*['\"][^'\"]{8,}['\"]",
    "password": r"password['\"\s]*[:=]\s*['\"][^'\"]{4,}['\"]",
    "private_key": r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "jwt_token": r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}",
    "slack_token": r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}-[a-zA-Z0-9]{24,}",
    "stripe_key": r"sk_live_[a-zA-Z0-9]{24,}",
}
#: Fixed values. Words that make a secret a placeholder
PLACEHOLDERS = ("example", "test", "demo", "sample", "placeholder", "your_key_here", "insert_key", "replace_me", "xxx")
#: Fixed values. Parts of a call's name, in any case, and how bad they are; calls that are not random enough
WEAK = {"md5": "high", "sha1": "high", "des": "critical", "rc4": "critical", "rc2": "critical"}
PREDICTABLE = ("random.random", "random.randint", "random.choice")
#: Fixed values. Weakness, pattern, title
INJECTIONS = (
    ("CWE-89", r"execute\s*\([^)]*[\"'].*%s", "SQL injection via string formatting"),
    ("CWE-89", r"execute\s*\([^)]*\+", "SQL injection via string concatenation"),
    ("CWE-89", r"cursor\.execute\s*\([^)]*f[\"']", "SQL injection via f-string"),
    ("CWE-78", r"os\.system\s*\([^)]*\+", "Command injection via concatenation"),
    ("CWE-78", r"subprocess\.(call|run|Popen)\s*\([^)]*shell\s*=\s*True", "Shell injection risk"),
    ("CWE-78", r"os\.popen\s*\(", "Deprecated os.popen with injection risk"),
    ("CWE-94", r"eval\s*\(", "Code injection via eval()"),
    ("CWE-94", r"exec\s*\(", "Code injection via exec()"),
    ("CWE-94", r"__import__\s*\(", "Dynamic import injection risk"),
)
DEBUG, UNSAFE_OPEN = re.compile(r"DEBUG\s*=\s*True", re.I), re.compile(r"open\s*\([^)]*\+")
#: Fixed values. Where untrusted data comes in, where it must not go, and what makes it safe
SOURCES = ("input", "raw_input", "sys.argv", "request.args", "request.form", "request.data", "request.json", "request.cookies", "request.headers", "flask.request", "django.request", "os.environ.get", "environ.get")
SINKS = {
    "sql": ("execute", "executemany", "raw", "cursor.execute"),
    "command": ("os.system", "subprocess.call", "subprocess.run", "subprocess.Popen", "os.popen", "eval", "exec"),
    "file": ("open", "file", "os.open", "Path"),
    "pickle": ("pickle.loads", "pickle.load", "cPickle.loads"),
}
SANITIZERS = ("escape", "html.escape", "quote", "quote_plus", "validate", "sanitize", "clean", "strip_tags")
#: Fixed values. Category of each rule's prefix in the two catalogues
OWASP = {"TAINT_": "A04_Injection", "SECRET_": "A05_Cryptographic_Failures", "CRYPTO_": "A05_Cryptographic_Failures", "CWE-": "A04_Injection", "OWASP_A01": "A01_Broken_Access_Control", "OWASP_A02": "A02_Security_Misconfiguration"}
CWE = {"TAINT_SQL": "CWE-89", "TAINT_COMMAND": "CWE-78", "SECRET_": "CWE-798", "CRYPTO_": "CWE-327", "CWE-89": "CWE-89", "CWE-78": "CWE-78", "CWE-94": "CWE-94"}

_SECRETS = {kind: re.compile(p, re.I) for kind, p in SECRETS.items()}
_INJECTIONS = tuple((rule, re.compile(p, re.I), title) for rule, p, title in INJECTIONS)


def _issue(rule: str, severity: str, title: str, line: int, detail: str | None = None) -> Fact:
    return Fact(NAME, "issue", rule, severity, title, line, detail=detail)


def line_of(code: str, at: int) -> int:
    return code.count("\n", 0, at) + 1


def secrets(source: Source) -> Iterator[Fact]:
    for kind, pattern in _SECRETS.items():
        for m in pattern.finditer(source.code):
            line = line_of(source.code, m.start())
            low = m[0].lower()
            if not any(w in low for w in PLACEHOLDERS) and not source.lines[line - 1].strip().startswith("#"):
                shown = m[0] if len(m[0]) <= 50 else m[0][:50] + "..."
                yield _issue(f"SECRET_{kind.upper()}", "critical", f"Hardcoded {kind.replace('_', ' ')}", line, shown)


def cryptography(source: Source) -> Iterator[Fact]:
    for call in source.of(ast.Call):
        name = dotted(call)
        for part, severity in WEAK.items():
            if part in name.lower():
                yield _issue("CRYPTO_WEAK_CRYPTO", severity, f"Weak cryptographic algorithm {part.upper()} detected", call.lineno)
        if name in PREDICTABLE:
            yield _issue("CRYPTO_INSECURE_RANDOM", "medium", "Use secrets module for cryptographic randomness", call.lineno)


def injections(source: Source) -> Iterator[Fact]:
    for rule, pattern, title in _INJECTIONS:
        for m in pattern.finditer(source.code):
            yield _issue(rule, "critical", title, line_of(source.code, m.start()))


def misconfiguration(source: Source) -> Iterator[Fact]:
    """One issue for the first debug flag of a file, on its own line; one for each open() of a sum."""
    if m := DEBUG.search(source.code):
        yield _issue("OWASP_A02_001", "high", "Debug mode enabled in production", line_of(source.code, m.start()))
    for m in UNSAFE_OPEN.finditer(source.code):
        yield _issue("OWASP_A01_001", "high", "Potential path traversal vulnerability", line_of(source.code, m.start()))


def taint(source: Source) -> Iterator[Fact]:
    """Flows from a source to a sink within a scope (a function or the module), over assignments in the order of the lines.
    Names take over what is assigned to them; sums, formatting, subscripts and calls pass it on, sanitizers stop it. A name
    that is assigned something clean is clean again. A sink's name is equal to a call's name or to its last parts."""
    ends = lambda name, known: any(name == k or name.endswith("." + k) for k in known)

    def dirty(node: ast.AST, names: set[str]) -> bool:
        stack = [node]
        while stack:
            at = stack.pop()
            if isinstance(at, ast.Name):
                if at.id in names:
                    return True
            elif isinstance(at, ast.Call):
                name = dotted(at)
                if ends(name, SANITIZERS):
                    continue
                if ends(name, SOURCES):
                    return True
                stack += [*at.args, *(k.value for k in at.keywords), *([at.func.value] if isinstance(at.func, ast.Attribute) else [])]
            elif isinstance(at, ast.Attribute):
                if ends(attribute_tail(at), SOURCES):
                    return True
                stack.append(at.value)
            elif not isinstance(at, (ast.Lambda, *ast_scopes)):
                stack += [c for c in children(at) if isinstance(c, ast.expr)]
        return False

    for scope in (source.tree, *source.functions):
        names: set[str] = set()
        for node in sorted(_own_nodes(scope), key=lambda n: (n.lineno, n.col_offset)):
            if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and node.value is not None:
                now = dirty(node.value, names)
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    for t in walk(target):
                        if isinstance(t, ast.Name):
                            if now:
                                names.add(t.id)
                            elif not isinstance(node, ast.AugAssign):
                                names.discard(t.id)
            elif isinstance(node, ast.Call):
                name = dotted(node)
                for kind, sinks in SINKS.items():
                    if ends(name, sinks):
                        for argument in node.args:
                            if dirty(argument, names):
                                yield _issue(f"TAINT_{kind.upper()}", "critical" if kind in ("sql", "command") else "high", f"{kind.upper()} injection vulnerability", node.lineno, name)


ast_scopes = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _own_nodes(scope: ast.AST) -> Iterator[ast.AST]:
    stack = list(scope.body)
    while stack:
        node = stack.pop()
        if isinstance(node, (*ast_scopes, ast.Lambda)):
            if isinstance(node, ast.ClassDef):
                stack.extend(node.body)
            continue
        if hasattr(node, "lineno"):
            yield node
        stack.extend(children(node))


detect = apart(NAME, taint, secrets, cryptography, injections, misconfiguration)
#: What needs no tree
in_text = apart(NAME, secrets, injections, misconfiguration)
