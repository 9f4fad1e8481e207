"""Shell commands that programs run: Python by its syntax tree with known values of names, JavaScript by its tokens.

Files are chosen in the JVM by type, name and the calls they may hold; only their contents go to Python, a batch at a time, and come
back as rows of commands, which the text rules then read as scripts (`command_findings`). A file that can't be parsed gives no rows.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.text_rules import Rule, scan

# Calls that run commands, wrappers of such calls, programs whose argument lists are commands, shells and their flags.
SUBPROCESS = ("run", "call", "check_call", "check_output", "Popen")
OS_EXEC = ("execv", "execve", "execvp", "execvpe")
WRAPPER_NAMES = ("docker_exec", "exec_command", "execute_command", "run_command")
WRAPPER_METHODS = ("execute", "exec", "run_command", "_call")
JS_CALLS = ("exec", "execSync", "executeInTerminal", "execFile", "execFileSync", "execa", "runStreamedCommand", "sendText", "spawn", "spawnSync")
JS_BUILDERS = ("getUvPathCommand",)
SHELLS = ("bash", "sh", "zsh", "dash")
POWERSHELLS = ("powershell", "powershell.exe", "pwsh", "pwsh.exe")
FETCHERS = ("curl", "wget", "gh", "aria2", "aria2c")
INSTALLERS = ("pip", "pip3", "npm", "brew", "winget")
CLOUD = ("az", "az.cmd", "az.exe")
JS_SUFFIXES = (".js", ".mjs", ".cjs", ".ts", ".mts", ".jsx", ".tsx")
TEST_FOLDERS = ("test", "tests", "testing", "testdata", "unittest", "unittests")

COMMAND = "path string, line_number int, command string, origin string, matched string"
#: What a file must hold somewhere to be parsed.
PY_HINTS = ("system", "subprocess", "exec", "run_command", "_call", "RunCmd")


class _Module:
    """The calls and loops of a Python module, and what its names may hold."""

    def __init__(self, tree: ast.Module):
        nodes = list(ast.walk(tree))
        self.calls = [n for n in nodes if isinstance(n, ast.Call) and n.args]
        self.loops = [n for n in nodes if isinstance(n, ast.For) and isinstance(n.target, ast.Name) and isinstance(n.iter, ast.Name)]
        given = [(name, n) for n in nodes if isinstance(n, ast.Assign | ast.AnnAssign) and n.value for name in _targets(n)]
        self.constants = {name: n.value.value for name, n in given if isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)}
        self.texts, self.lists, self.shells = defaultdict(list), {}, {}
        for name, n in given:
            if text := self.text(n.value):
                self.texts[name].append((n.lineno, text, "literal"))
        for name, n in given:
            if isinstance(n.value, ast.List | ast.Tuple):
                if each := [(e.lineno, text, "literal") for e in n.value.elts if (text := self.text(e))]:
                    self.lists[name] = each
                if inner := self.in_shell(n.value):
                    self.shells[name] = inner

    def text(self, node: ast.expr) -> str:
        """The string that an expression is, names in it put in where they are known; empty if it is none."""
        match node:
            case ast.Constant(value=str(s)):
                return s
            case ast.JoinedStr(values=parts):
                return "".join(p.value if isinstance(p, ast.Constant) else self.named(p.value) for p in parts)
            case ast.Call(func=ast.Attribute(value=inner, attr="strip" | "lstrip" | "rstrip" as how), args=[], keywords=[]):
                return getattr(self.text(inner), how)()
        return ""

    def named(self, node: ast.expr) -> str:
        return (self.constants.get(node.id) or f"${node.id}") if isinstance(node, ast.Name) else "${...}"

    def token(self, node: ast.expr) -> str:
        """One argument of an argument list; empty if nothing of it is known."""
        match node:
            case ast.Constant(value=str()) | ast.JoinedStr():
                return self.text(node)
            case ast.Name():
                return self.named(node)
            case ast.BinOp(op=ast.Add(), left=a, right=b):
                a, b = self.token(a), self.token(b)
                return f"{a}${{{b[1:]}}}" if a.startswith("$") and b.startswith("$") else a + b
            case ast.Attribute(value=ast.Name(id="sys"), attr="executable"):
                return "python"
        return ""

    def argv(self, node: ast.expr) -> str:
        """An argument list of an installer, fetcher or cloud program, as one command; else empty."""
        words = [t for e in node.elts if (t := self.token(e))] if isinstance(node, ast.List | ast.Tuple) else []
        least = {**dict.fromkeys(INSTALLERS + FETCHERS, 2), **dict.fromkeys(CLOUD, 3)}.get(words[0]) if words else None
        if words[:2] == ["python", "-m"] and words[2:3] in (["pip"], ["pip3"]):
            least = 4
        return " ".join(words) if least and len(words) >= least else ""

    def in_shell(self, node: ast.List | ast.Tuple) -> list:
        """The commands that an argument list hands to a shell."""
        first = self.token(node.elts[0]).lower() if node.elts else ""
        flags = ("-c",) if first in SHELLS else ("-c", "-command", "/c") if first in POWERSHELLS else ()
        at = next((k for k, e in enumerate(node.elts[:-1]) if self.token(e).lower() in flags), None) if flags else None
        return [] if at is None else self.value(node.elts[at + 1], node.lineno)

    def value(self, node: ast.expr, line: int) -> list:
        """The commands that an argument stands for."""
        if text := self.text(node):
            return [(line, text, "literal")]
        if isinstance(node, ast.List | ast.Tuple):
            return self.in_shell(node) or ([(line, words, "argv")] if (words := self.argv(node)) else [])
        return self.texts.get(node.id, []) if isinstance(node, ast.Name) else []

    def of_call(self, call: ast.Call) -> list:
        first, line = call.args[0], call.lineno
        match call.func:
            case ast.Attribute(value=ast.Name(id="os"), attr="system"):
                return [(line, text, "literal")] if (text := self.text(first)) else []
            case ast.Attribute(value=ast.Name(id="subprocess"), attr=how) if how in SUBPROCESS:
                if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in call.keywords):
                    return [(line, text, "literal")] if (text := self.text(first)) else []
                match first:
                    case ast.Call(func=ast.Attribute(value=inner, attr="split"), args=[], keywords=[]):
                        return [(line, text, "argv")] if (text := self.text(inner)) else []
                    case ast.Name(id=name):
                        return self.shells.get(name, [])
                    case ast.List() | ast.Tuple():
                        return self.value(first, line)
            case ast.Attribute(value=ast.Name(id="os"), attr=how) if how in OS_EXEC:
                match call.args[1:2]:
                    case [ast.Name(id=name)]:
                        return self.shells.get(name, [])
                    case [ast.List() | ast.Tuple() as argv]:
                        return self.in_shell(argv)
            case func if _wraps(func) or _run_cmd(func):
                words = [t for a in call.args if (t := self.token(a))]
                if _run_cmd(func) and self.token(first) in FETCHERS and len(words) > 1:
                    return [(line, " ".join(words), "argv")]
                given = [v for a in call.args for v in ([a] if not isinstance(a, ast.Dict) else [v for k, v in zip(a.keys, a.values, strict=True) if isinstance(k, ast.Constant) and k.value == "command"])]
                return [c for v in given + [k.value for k in call.keywords if k.arg == "command"] for c in self.value(v, line)]
        return []

    def of_loop(self, loop: ast.For) -> list:
        """The commands of a list that a loop hands on to a wrapper, by its variable or names given from it."""
        known, names = self.lists.get(loop.iter.id, []), {loop.target.id}
        uses = lambda n: any(isinstance(x, ast.Name) and x.id in names for x in ast.walk(n))
        for n in ast.walk(loop) if known else ():
            if isinstance(n, ast.Assign | ast.AnnAssign) and n.value and uses(n.value):
                names.update(_targets(n))
            elif isinstance(n, ast.Call) and _wraps(n.func) and any(map(uses, [*n.args, *(k.value for k in n.keywords)])):
                return known
        return []


def _targets(node: ast.Assign | ast.AnnAssign) -> list[str]:
    return [t.id for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]


def _wraps(func: ast.expr) -> bool:
    return isinstance(func, ast.Name) and func.id in WRAPPER_NAMES or isinstance(func, ast.Attribute) and func.attr in WRAPPER_METHODS


def _run_cmd(func: ast.expr) -> bool:
    return "RunCmd" in (getattr(func, "id", ""), getattr(func, "attr", ""))


def python_commands(source: str) -> list[tuple[int, str, str]]:
    """(line, command, origin) of the commands that a Python module runs, by line; no module, no rows."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = _Module(ast.parse(source))
            found = {c for n in module.calls for c in module.of_call(n)} | {c for n in module.loops for c in module.of_loop(n)}
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return sorted(found)


_JS = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>\.\.\.|=>|[=!]==?|.)""", re.S)
_JS_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


def _js_tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of the names, numbers, strings (without quotes and backslashes) and signs; comments and white space are left out."""
    out, at, line = [], 0, 1
    while at < len(source):
        m = _JS.match(source, at)
        kind, text = m.lastgroup, m[0]
        # a slash after a value divides, elsewhere it opens a regular expression
        if text == "/" and (not out or out[-1][0] == "op" and out[-1][1] not in ")]}" or out[-1][1] == "return") and (r := _JS_REGEX.match(source, at)):
            kind, text, m = "regex", r[0], r
        if kind == "string":
            out.append((kind, text[0] + re.sub(r"(?s)\\(.)", r"\1", text[1:-1]), line))
        elif kind != "skip":
            out.append((kind, text, line))
        line += text.count("\n")
        at = m.end()
    return out


def _js_arguments(tokens: list, at: int) -> list[list] | None:
    """The tokens of each argument of a call whose bracket is before at; None if it is never closed."""
    args, depth = [[]], 1
    for t in tokens[at:]:
        if t[0] == "op" and t[1] in "([{":
            depth += 1
        elif t[0] == "op" and t[1] in ")]}":
            depth -= 1
            if not depth:
                return args
        if depth == 1 and t[1] == "," and t[0] == "op":
            args.append([])
        else:
            args[-1].append(t)
    return None


def _js_words(tokens: list, names: bool) -> list[str]:
    """The strings of an argument list in order, with names as variables or left out with template strings; what is spread is left out."""
    out, before = [], ""
    for kind, text, _ in tokens:
        if before != "...":
            if kind == "string" and (names or text[0] != "`"):
                out.append(text[1:])
            elif kind == "name" and names and text not in ("true", "false", "null", "undefined"):
                out.append("$" + text)
        before = text if kind == "op" else ""
    return out


def _js_argv(args: list[list]) -> str:
    """The command of a call of a program with a list of arguments; empty if the program is none of those known."""
    first, strings = args[0], _js_words(args[1], names=False)
    said = first[0][1][1:].lower() if first and first[0][0] == "string" else ""
    if not said:
        whole = "".join(t[1] for t in first).lower()
        said = next((p for p in ("npm", "brew", "winget", *SHELLS, *FETCHERS) if p in whole), "")
    if not strings:
        return ""
    if said in SHELLS:
        return next((b for a, b in zip(strings, strings[1:], strict=False) if a == "-c"), "")
    if said in FETCHERS:
        return " ".join([said, *_js_words(args[1], names=True)])
    if said in ("npm", "brew", "winget"):
        at = next((k for k, s in enumerate(strings) if s == "install" or s == "i" and said == "npm"), None)
        return "" if at is None else " ".join([said, *strings[at:]])
    return ""


def _js_literal(tokens: list) -> str:
    """The string at the start of some tokens, with those added to it."""
    out = tokens[0][1][1:]
    for plus, more in zip(tokens[1::2], tokens[2::2], strict=False):
        if plus[1] != "+" or plus[0] != "op" or more[0] != "string":
            break
        out += more[1][1:]
    return out


def javascript_commands(source: str) -> list[tuple[int, str, str]]:
    """(line, command, origin) of the commands that a script runs, by line: literals, argument lists, and names given a string before."""
    tokens, known, found = _js_tokens(source), defaultdict(list), set()
    sign = lambda k, s: k < len(tokens) and tokens[k][0] == "op" and tokens[k][1] == s
    kind = lambda k: tokens[k][0] if 0 <= k < len(tokens) else ""
    for k, (what, text, line) in enumerate(tokens):
        if what == "op" and text == "=":
            at = k + 1 + sign(k + 1, "(")
            if kind(at) == "name" and tokens[at][1] in JS_BUILDERS and sign(at + 1, "("):
                at += 2
            if kind(at) == "string":
                start = k - 1
                while start > 0 and tokens[start][2] == line and not (kind(start) == "op" and tokens[start][1] in ":;={}(),"):
                    start -= 1
                name = start - 1 if sign(start, ":") else k - 1
                if kind(name) == "name":
                    known[tokens[name][1]].append((tokens[at][2], tokens[at][1][1:], "literal"))
        elif what == "name" and text in JS_CALLS and sign(k + 1, "("):
            args = _js_arguments(tokens, k + 2)
            if args and len(args) > 1 and (command := _js_argv(args)):
                found.add((line, command, "argv"))
            elif kind(k + 2) == "string":
                if command := _js_literal(args[0] if args else tokens[k + 2 : k + 3]):
                    found.add((line, command, "literal"))
            elif kind(k + 2) == "name":
                found.update(c for c in known[tokens[k + 2][1]] if c[1])
    return sorted(found)


def is_test_source(path: Column) -> Column:
    """Whether a path is that of a test, by its folders or its name."""
    low, name = F.lower(path), F.element_at(F.split(path, "/"), -1)
    named = F.lower(name).rlike(r"^test_|_test\.py$|\.test\.ts$|\.spec\.") | name.rlike(r"^(?:test|Test)[-_.A-Z0-9].*\.(?:[cm]?[jt]sx?|py)$")
    return F.concat(F.lit("/"), low).rlike(f"/(?:{'|'.join(TEST_FOLDERS)})/") | named


def _rows(find: Callable[[str], list]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [c.split()[0] for c in COMMAND.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                lines = content.split("\n")
                rows = [(path, n, command, origin, lines[n - 1].strip()[:200] if n <= len(lines) else command[:200]) for n, command, origin in find(content)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return each


def source_commands(files: DataFrame) -> DataFrame:
    """files: (path, file_type, content). One row per command that a program among them runs: path, line_number, command, origin, matched.

    Read are source_code files of Python and JavaScript that are no tests. Origin is literal for a string and argv for an
    argument list; matched is the line, cut to 200 characters. Null contents give no rows, repeated files repeated rows.
    """
    some = files.where((F.col("file_type") == "source_code") & F.col("content").isNotNull() & ~is_test_source(F.col("path"))).select("path", "content")
    holds = lambda hints: F.greatest(*(F.contains("content", F.lit(h)) for h in hints))
    low = F.lower("path")
    python = some.where(low.endswith(".py") & holds(PY_HINTS)).mapInPandas(_rows(python_commands), COMMAND)
    scripts = some.where(low.rlike(r"\.(?:" + "|".join(s[1:] for s in JS_SUFFIXES) + ")$") & holds(JS_CALLS)).mapInPandas(_rows(javascript_commands), COMMAND)
    return python.unionByName(scripts)


def command_findings(commands: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """What the text rules find in commands, each read as a script of its own; line_number is that of the command in its file."""
    at = F.concat(F.col("line_number").cast("string"), F.lit("\n"), "path")
    found = scan(commands.select(at.alias("path"), F.lit("script").alias("file_type"), F.col("command").alias("content")), rules)
    line = F.substring_index("path", "\n", 1)
    return found.select(F.substr("path", F.length(line) + 2).alias("path"), F.lit("source_code").alias("file_type"), line.cast("int").alias("line_number"), "rule_order", "rule", "category", "severity", "matched", "dependency", "nth")
