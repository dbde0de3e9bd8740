"""Source files to classes, functions, imports and calls.

Python goes through its own syntax tree; JavaScript through a scan of its tokens;
Java files keep their row with empty lists, and so do files that can't be parsed.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Files that a task holds as Python objects at once, and the lines of a function's body that are shown.
FILES, BODY = 200, 50
_EMPTY = {"classes": [], "functions": [], "imports": [], "function_calls": [], "function_to_function_calls": []}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _preorder(node: ast.AST) -> Iterator[ast.AST]:
    for child in ast.iter_child_nodes(node):
        yield child
        yield from _preorder(child)


def _called(node: ast.Call) -> str | None:
    return node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None


def parse_python(source: str) -> dict:
    """Imports are names as they stand: modules and imported names, without relative modules and what is renamed."""
    tree = ast.parse(source)
    out = {k: [] for k in _EMPTY}
    for node in _preorder(tree):
        if isinstance(node, ast.ClassDef):
            out["classes"].append({"name": node.name, "line": node.lineno})
        elif isinstance(node, _FUNCTIONS):
            out["functions"].append({"name": node.name, "line": node.lineno})
            callees = dict.fromkeys(name for x in _preorder(node) if isinstance(x, ast.Call) and (name := _called(x)))
            out["function_to_function_calls"] += [{"caller": node.name, "callee": c} for c in callees]
        elif isinstance(node, ast.Import):
            out["imports"] += [a.name for a in node.names if not a.asname]
        elif isinstance(node, ast.ImportFrom):
            out["imports"] += [node.module] * (node.level == 0 and bool(node.module)) + [a.name for a in node.names if not a.asname and a.name != "*"]
        elif isinstance(node, ast.Call) and (name := _called(node)):
            out["function_calls"].append(name)
    return out


_JS = re.compile(
    r"""[ \t\r\f\v]+|//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$][\w$]*|\n|.""",
    re.DOTALL,
)
_JS_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.DOTALL)
_JS_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
# What a regular expression, rather than a division, follows.
_JS_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % > ~ ^ return typeof case in of delete void throw new do else yield await instanceof".split())
# Words before a parenthesis that call nothing.
_JS_WORDS = frozenset("if for while switch catch function return typeof await new super import with delete void in of case do else yield throw async".split())


def _javascript_tokens(source: str) -> list[tuple[str, int]]:
    """(token, line) without comments and white space. What stands in a template literal's braces is code; the rest of it is one token."""
    out: list[tuple[str, int]] = []
    line, at, text, braces = 1, 0, False, []
    while at < len(source):
        if text:
            m = _JS_TEMPLATE.match(source, at)
            line, at, text = line + m[0].count("\n"), m.end(), False
            if source.startswith("${", at):
                braces.append(0)
                at += 2
            else:
                at += 1
            continue
        m = _JS.match(source, at)
        if m[0] == "/" and (not out or out[-1][0] in _JS_BEFORE_REGEX):
            m = _JS_REGEX.match(source, at) or m
        t, at = m[0], m.end()
        if braces and t in "{}":
            if t == "}" and not braces[-1]:
                braces.pop()
                text = True
                continue
            braces[-1] += 1 if t == "{" else -1
        text = t == "`"
        if not t.isspace() and not t.startswith(("//", "/*")):
            out.append((t, line))
        line += t.count("\n")
    return out


def parse_javascript(source: str) -> dict:
    """Declared functions, imports with a string, and calls of names and of members."""
    tokens = _javascript_tokens(source)
    # Where the string or semicolon is that ends a statement begun at each token.
    ends = [len(tokens)] * (len(tokens) + 1)
    for i in range(len(tokens) - 1, -1, -1):
        ends[i] = i if tokens[i][0] == ";" or tokens[i][0][0] in "\"'" else ends[i + 1]
    out = {k: [] for k in _EMPTY}
    open_functions: list[tuple[str, int, dict]] = []
    depth, pending = 0, None
    for i, (t, at) in enumerate(tokens):
        after = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        before = tokens[i - 1][0] if i else ""
        if t == "function" and re.match(r"[A-Za-z_$]", after) or t == "function" and after == "*":
            name = tokens[i + 2][0] if after == "*" and i + 2 < len(tokens) else after
            if before in ("", ";", "}", "{", ")", "async", "export", "default") or tokens[i - 1][1] < at:
                out["functions"].append({"name": name, "line": at})
                pending = name
        elif t == "{":
            depth += 1
            if pending and before == ")":
                open_functions.append((pending, depth, {}))
                pending = None
        elif t == "}":
            if open_functions and open_functions[-1][1] == depth:
                name, _, callees = open_functions.pop()
                out["function_to_function_calls"] += [{"caller": name, "callee": c} for c in callees]
            depth -= 1
        elif t == "import" and before != "." and after != "(":
            if ends[i] < len(tokens) and tokens[ends[i]][0] != ";":
                out["imports"].append(tokens[ends[i]][0][1:-1])
        elif after == "(" and re.match(r"[A-Za-z_$]", t) and t not in _JS_WORDS and before not in ("function", "*"):
            out["function_calls"].append(t)
            for _, _, callees in open_functions:
                callees[t] = None
    return out


def parse_source(language: str, source: str | None) -> dict:
    """The parse of one file; empty lists where there is no parser or no valid source."""
    try:
        if language == "python":
            return parse_python(source or "")
        if language == "javascript":
            return parse_javascript(source or "")
    except (SyntaxError, ValueError, RecursionError):
        pass
    return dict(_EMPTY)


def parse(files: DataFrame) -> DataFrame:
    """Parsed files of (path, language, content), see ``schemas.PARSED``."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, FILES):
                rows = batch.slice(a, FILES).to_pylist()
                out = [{"file": r["path"], "language": r["language"], **parse_source(r["language"], r["content"])} for r in rows]
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return files.select("path", "language", F.col("content").cast("string").alias("content")).mapInArrow(run, schemas.PARSED)


_ITEM = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())]))
_ARROW = pa.schema([("file", pa.string()), ("language", pa.string()), ("classes", _ITEM), ("functions", _ITEM), ("imports", pa.list_(pa.string())), ("function_calls", pa.list_(pa.string())), ("function_to_function_calls", pa.list_(pa.struct([("caller", pa.string()), ("callee", pa.string())])))])


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The edge and node tables in parsed files: classes, functions (a name's last line in a file), imports, calls."""
    each = lambda c: parsed.select("file", F.posexplode(c).alias("pos", "x"))
    return {
        "classes": each("classes").groupBy("file", F.col("x.name").alias("name")).agg(F.max_by("x.line", "pos").alias("line")),
        "functions": each("functions").groupBy("file", F.col("x.name").alias("name")).agg(F.max_by("x.line", "pos").alias("line")),
        "imports": each("imports").select("file", "pos", F.col("x").alias("module")),
        "file_calls": each("function_calls").select("file", F.col("x").alias("callee")).distinct(),
        "function_calls": each("function_to_function_calls").select("file", "x.caller", "x.callee").distinct(),
    }


def body(content: Column, start: Column, most: int = BODY) -> Column:
    """A function's lines from line ``start`` on, up to the next line that is no comment and not indented more; at most ``most`` lines."""
    rest = F.slice(F.split(content, "\n"), start, F.lit(1_000_000_000))
    indent = lambda s: F.length(s) - F.length(F.ltrim(s))
    ends = F.transform(rest, lambda s, i: (i > 0) & (F.trim(s) != "") & ~F.ltrim(s).startswith("#") & ~F.ltrim(s).startswith("//") & (indent(s) <= indent(F.element_at(rest, 1))))
    stop = F.array_position(ends, True).cast("int")
    n = F.when(stop > 0, stop - 1).otherwise(F.size(rest))
    text = F.array_join(F.slice(rest, 1, F.least(n, F.lit(most))), "\n")
    return F.when((start < 1) | (F.size(rest) < 1), F.lit(None).cast("string")).when(n > most, F.concat(text, F.lit("\n... (truncated)"))).otherwise(text)


@F.udtf(returnType="kind string, pos int, name string, line int, callee string")
class ParseSource:
    """The parse of one file as rows: ``class`` and ``function`` with their lines, ``import``, ``call``, and ``edge`` from a function to its callee, each kind numbered by ``pos``."""

    def eval(self, language: str, content: str):
        found = parse_source(language, content)
        for kind, key in (("class", "classes"), ("function", "functions")):
            for pos, x in enumerate(found[key]):
                yield kind, pos, x["name"], x["line"], None
        for kind, key in (("import", "imports"), ("call", "function_calls")):
            for pos, name in enumerate(found[key]):
                yield kind, pos, name, None, None
        for pos, x in enumerate(found["function_to_function_calls"]):
            yield "edge", pos, x["caller"], None, x["callee"]


def register(spark: SparkSession, name: str = "parse_source") -> None:
    """Make the parser a table function of SQL: ``FROM files, LATERAL parse_source(language, content)``."""
    spark.udtf.register(name, ParseSource)
