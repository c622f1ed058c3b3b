"""Symbols, references and the call graph of source files."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_frames
from .joins import first_match

# How definitions look in languages that are not parsed.
DEFINITIONS = {
    "rust": (r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*(fn|struct|enum|trait|type|mod)[ \t]+([A-Za-z_]\w*)",),
    "go": (r"(?m)^(func|type)[ \t]+(?:\([^)]*\)[ \t]*)?([A-Za-z_]\w*)",),
    "javascript": (r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(function|class)\*?[ \t]+([A-Za-z_$][\w$]*)", r"(?m)^[ \t]*(?:export[ \t]+)?(const)[ \t]+([A-Za-z_$][\w$]*)[ \t]*=[ \t]*(?:async[ \t]*)?\("),
    "java": (r"(?m)^[ \t]*(?:public|private|protected|static|final|abstract|sealed|[ \t])*(class|interface|enum|record)[ \t]+([A-Za-z_]\w*)", r"(?m)^[ \t]+(?:public|private|protected|static|final|synchronized|[ \t])*()[\w<>\[\], ?]+[ \t]+([A-Za-z_]\w*)[ \t]*\([^;{}]*\)[^;{}]*\{"),
}
_CALL = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*)[ \t]*\(")
_NOT_CALLED = frozenset("if for while switch match return fn func function catch def class elif with assert await new in and or not print sizeof typeof".split())
_BRANCH = re.compile(r"\b(?:if|elif|for|while|case|catch|except|match|when)\b|&&|\|\||\?(?![.?])")


def _python(text: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    out = []

    def walk(node, scope):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                out.append(("def", kind, ".".join([*scope, child.name]), child.lineno, child.end_lineno))
                walk(child, [*scope, child.name])
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        out.append(("ref", "call", name, child.lineno, child.lineno))
                walk(child, scope)

    walk(tree, [])
    return out


def _by_pattern(text: str, lang: str) -> list[tuple]:
    out, spots = [], set()
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    from bisect import bisect_right

    line = lambda i: bisect_right(starts, i)
    defs = []
    for p in DEFINITIONS.get(lang, ()):
        for m in re.finditer(p, text):
            defs.append((m.start(2), m[1] or "method", m[2]))
            spots.add(m.start(2))
    defs.sort()
    for k, (at, kind, name) in enumerate(defs):
        end = line(defs[k + 1][0]) - 1 if k + 1 < len(defs) else len(starts)
        out.append(("def", "function" if kind in ("fn", "func", "function", "const", "method") else kind, name, line(at), max(end, line(at))))
    for m in _CALL.finditer(text):
        if m[1] not in _NOT_CALLED and m.start(1) not in spots:
            out.append(("ref", "call", m[1], line(m.start(1)), line(m.start(1))))
    return out


def extract_symbols(files: DataFrame, id_col: str = "file_id", lang: str = "language", text: str = "content") -> DataFrame:
    """``file_id, what, kind, name, start_line, end_line``: definitions (``def``) and calls (``ref``).

    Python is parsed, other known languages are scanned by patterns; texts that do not parse, null texts
    and other languages give nothing.  Works where the rows are read.
    """
    known = ["python", *DEFINITIONS]
    rows = files.where(F.lower(lang).isin(known) & F.col(text).isNotNull()).select(F.col(id_col).alias("file_id"), F.lower(lang).alias("l"), F.col(text).alias("t"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, g, t in b.itertuples(index=False):
                try:
                    found = _python(t) if g == "python" else _by_pattern(t, g)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                out += [(i, *x) for x in found]
            yield pd.DataFrame(out, columns=["file_id", "what", "kind", "name", "start_line", "end_line"])

    return map_frames(rows, look, f"file_id {rows.schema['file_id'].dataType.simpleString()}, what string, kind string, name string, start_line int, end_line int")


def call_graph(symbols: DataFrame, files: DataFrame, id_col: str = "file_id", project: str = "project_id") -> DataFrame:
    """Calls resolved to functions: ``caller, callee, phase, calls``, named ``file:name``.

    The caller is the innermost function around the call.  A name is looked for in the same file (0), then in
    the project (1); the smallest of several targets is taken, and what stays unresolved has a null callee.
    """
    from .joins import innermost

    f = files.select(F.col(id_col).alias("file_id"), F.col(project).alias("project_id")).distinct()
    defs = symbols.where("what = 'def' and kind = 'function'").join(f, "file_id").withColumn("short", F.element_at(F.split("name", r"\."), -1)).withColumn("node", F.concat_ws(":", F.col("file_id").cast("string"), F.col("name")))
    refs = symbols.where("what = 'ref'").join(f, "file_id").select("file_id", "project_id", F.col("name").alias("short"), F.col("start_line").alias("line")).withColumn("rid", F.concat_ws(":", F.col("file_id").cast("string"), F.col("line").cast("string"), "short"))
    refs = refs.groupBy("rid", "file_id", "project_id", "short", "line").agg(F.count(F.lit(1)).alias("calls"))
    ranges = defs.select("file_id", F.col("node").alias("caller"), "start_line", "end_line")
    inside = innermost(refs.select("rid", "file_id", "line"), ranges, "file_id", "rid", "line", "start_line", "end_line", "caller")
    done = first_match(refs, "rid", [(defs.select("file_id", "short", "node"), ["file_id", "short"], "node"), (defs.select("project_id", "short", "node"), ["project_id", "short"], "node")], "callee")
    return done.join(inside, "rid").groupBy("caller", "callee", "phase").agg(F.sum("calls").alias("calls"))


def function_metrics(symbols: DataFrame, files: DataFrame, id_col: str = "file_id", text: str = "content") -> DataFrame:
    """``file_id, name, lines, branches``: size and branch count (plus one) of every function."""
    d = symbols.where("what = 'def' and kind = 'function'").select("file_id", "name", "start_line", "end_line")
    t = files.where(F.col(text).isNotNull()).select(F.col(id_col).alias("file_id"), F.split(text, "\n").alias("ls"))
    body = F.array_join(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    n = F.size(F.regexp_extract_all(body, F.lit(_BRANCH.pattern), F.lit(0)))
    return d.join(t, "file_id").select("file_id", "name", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), (n + 1).alias("branches"))


def identifier_entropy(files: DataFrame, id_col: str, text: str) -> DataFrame:
    """Entropy in bits of each file's identifiers: ``id, identifiers, entropy``."""
    w = files.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    t = w.groupBy("id").agg(F.sum("n").alias("t"))
    p = w.join(t, "id").withColumn("p", F.col("n") / F.col("t"))
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("identifiers"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
