"""Definitions, imports, calls and heritage of source files as one table of tagged rows.

Python is read with its own parser; the other languages by line patterns for what stands at the head of a definition, an
import or a call, with the end of a definition found by counting brackets outside of strings and comments. One pass over a
file gives all kinds; consumers filter by ``kind``.
"""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file string, language string, kind string, label string, name string, detail string, startLine long, endLine long, exported boolean"

_BLANK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_WORD = r"[A-Za-z_$][\w$]*"
_NOT_CALLS = frozenset("if for while switch return catch function func fn match loop else new sizeof typeof await super assert in do with foreach using lock".split())
#: language -> (label, pattern, pattern of what makes it exported)
DEFINITIONS = {
    "typescript": (("Class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_WORD})"), ("Interface", rf"^[ \t]*(?:export\s+)?interface\s+({_WORD})"), ("Function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_WORD})"), ("Function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+({_WORD})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\([^()\n]*\)|{_WORD})\s*(?::[^=\n]+)?=>"), ("Method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*({_WORD})\s*\([^()\n]*\)\s*(?::[^{{;\n]+)?\{{")),
    "java": (("Class", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|enum|record)\s+({_WORD})"), ("Interface", rf"^[ \t]*(?:(?:public|private|protected|static)\s+)*@?interface\s+({_WORD})"), ("Method", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^<>\n]*>[ \t]+)?[\w.]+(?:<[^;(){{}}\n]*>)?(?:\[\])*[ \t]+({_WORD})\s*\([^()\n]*\)\s*(?:throws [\w., ]+)?[{{;]")),
    "csharp": (("Class", rf"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|struct|record|enum)\s+({_WORD})"), ("Interface", rf"^[ \t]*(?:(?:public|private|protected|internal)\s+)*interface\s+({_WORD})"), ("Method", rf"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|async|abstract|sealed)\s+)*[\w<>\[\],.?]+\s+({_WORD})\s*\([^()\n]*\)\s*(?:[{{;]|=>|$)")),
    "go": (("Function", rf"^func\s+({_WORD})"), ("Method", rf"^func\s+\([^()]*\)\s*({_WORD})"), ("Interface", rf"^type\s+({_WORD})\s+interface\b"), ("Class", rf"^type\s+({_WORD})\s+struct\b")),
    "rust": (("Function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+)*fn\s+({_WORD})"), ("Class", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+({_WORD})"), ("Interface", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+({_WORD})")),
    "c": (("Function", rf"^(?:static\s+|inline\s+|extern\s+|const\s+)*[A-Za-z_][\w \t*]*?[ \t*]+\**({_WORD})\s*\([^;{{}}]*\)\s*\{{"), ("Class", rf"^[ \t]*(?:typedef\s+)?(?:struct|union|enum)\s+({_WORD})\s*\{{")),
    "cpp": (("Class", rf"^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct|enum(?:\s+class)?)\s+({_WORD})[^;(]*\{{"), ("Function", rf"^(?:static\s+|inline\s+|constexpr\s+|virtual\s+)*[A-Za-z_][\w:<>,&* \t]*?[ \t*&]+({_WORD}(?:::~?{_WORD})*)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{"), ("Method", rf"^[ \t]+(?:static\s+|inline\s+|virtual\s+|explicit\s+)*[A-Za-z_][\w:<>,&* \t]*?[ \t*&]+({_WORD})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:override\s*)?\{{")),
}
DEFINITIONS["javascript"] = DEFINITIONS["typescript"]
IMPORTS = {
    "typescript": r"^\s*(?:import|export)\b[^'\"\n;]*?(?:from\s*)?['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "csharp": r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$",
    "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);", "c": r"^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]", "cpp": r"^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]",
}
IMPORTS["javascript"] = IMPORTS["typescript"]
HERITAGE = {
    "typescript": (("extends", rf"class\s+({_WORD})[^{{\n]*?\bextends\s+({_WORD})"), ("implements", rf"class\s+({_WORD})[^{{\n]*?\bimplements\s+({_WORD})")),
    "java": (("extends", rf"class\s+({_WORD})[^{{\n]*?\bextends\s+({_WORD})"), ("implements", rf"class\s+({_WORD})[^{{\n]*?\bimplements\s+({_WORD})")),
    "csharp": (("extends", rf"(?:class|struct)\s+({_WORD})\s*:\s*({_WORD})"),), "rust": (("trait-impl", rf"impl(?:<[^>]*>)?\s+()({_WORD})(?:<[^>]*>)?\s+for\s+{_WORD}"),),
    "cpp": (("extends", rf"(?:class|struct)\s+({_WORD})\s*(?:final\s*)?:\s*(?:public|private|protected|virtual|\s)*({_WORD})"),),
}
HERITAGE["javascript"] = HERITAGE["typescript"]
_CALL = re.compile(rf"(?<![\w$])({_WORD})\s*\(")
_COMPILED = {lang: [(label, re.compile(p, re.M)) for label, p in ps] for lang, ps in DEFINITIONS.items()}
_IMPORTS = {lang: re.compile(p, re.M) for lang, p in IMPORTS.items()}
_HERITAGE = {lang: [(k, re.compile(p)) for k, p in ps] for lang, ps in HERITAGE.items()}
_EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust"}


def _exported(lang: str, name: str, head: str) -> bool:
    if lang in ("typescript", "javascript"):
        return "export" in head
    if lang == "python":
        return not name.startswith("_")
    if lang in ("java", "csharp"):
        return "public" in head
    if lang == "go":
        return name[:1].isupper()
    if lang == "rust":
        return head.lstrip().startswith("pub")
    return "static" not in head


def _end(text: str, at: int) -> int:
    """Offset of the bracket that closes the first one after ``at``, or of the end of the line."""
    i = text.find("{", at)
    line = text.find("\n", at)
    line = len(text) if line < 0 else line
    if i < 0 or ";" in text[at:i]:
        return line
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, i):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(text)


def parse_python(text: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    inside = {id(c) for n in ast.walk(tree) if isinstance(n, ast.ClassDef) for c in n.body}
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            label = "Class" if isinstance(n, ast.ClassDef) else "Method" if id(n) in inside else "Function"
            yield "definition", label, n.name, None, n.lineno - 1, (n.end_lineno or n.lineno) - 1, _exported("python", n.name, "")
            for b in getattr(n, "bases", []):
                base = b.attr if isinstance(b, ast.Attribute) else getattr(b, "id", None)
                if base:
                    yield "heritage", "extends", n.name, base, n.lineno - 1, n.lineno - 1, None
        elif isinstance(n, ast.Import):
            for a in n.names:
                yield "import", None, a.name, None, n.lineno - 1, n.lineno - 1, None
        elif isinstance(n, ast.ImportFrom):
            yield "import", None, "." * n.level + (n.module or ""), ",".join(a.name for a in n.names), n.lineno - 1, n.lineno - 1, None
        elif isinstance(n, ast.Call):
            f = n.func
            name = f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", None)
            if name:
                yield "call", None, name, None, n.lineno - 1, n.lineno - 1, None


def parse_other(text: str, lang: str):
    bare = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def line(at: int) -> int:
        from bisect import bisect_right

        return bisect_right(starts, at) - 1

    heads = set()
    for label, p in _COMPILED[lang]:
        for m in p.finditer(bare):
            name, at = m.group(1), m.start(1)
            if at in heads or name in _NOT_CALLS:
                continue
            heads.add(at)
            yield "definition", label, name, None, line(at), line(_end(bare, m.start())), _exported(lang, name, m.group())
    for m in _IMPORTS[lang].finditer(text):
        yield "import", None, next(g for g in m.groups() if g), None, line(m.start()), line(m.end()), None
    for kind, p in _HERITAGE.get(lang, ()):
        for m in p.finditer(bare):
            yield "heritage", kind, m.group(1) or None, m.group(2), line(m.start()), line(m.start()), None
    for m in _CALL.finditer(bare):
        if m.group(1) not in _NOT_CALLS and m.start(1) not in heads:
            yield "call", None, m.group(1), None, line(m.start()), line(m.start()), None


def _run(batches):
    for pdf in batches:
        rows = []
        for path, text in zip(pdf["path"], pdf["content"]):
            lang = _EXTENSIONS.get(str(path).rpartition(".")[2].lower())
            if lang is None or not text:
                continue
            try:
                found = list(parse_python(text) if lang == "python" else parse_other(text, lang))
            except (SyntaxError, ValueError, RecursionError):
                found = [("unparsed", None, None, None, 0, 0, None)]
            rows.extend((path, lang, *r) for r in found)
        yield pd.DataFrame(rows, columns=["file", "language", "kind", "label", "name", "detail", "startLine", "endLine", "exported"])


def parse(files: DataFrame) -> DataFrame:
    """Tagged rows of all files (path, content): definition, import, call, heritage, or unparsed."""
    return files.select("path", "content").mapInPandas(_run, SCHEMA)


def enclosing(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls with the innermost definition around their line ('' outside of all): every definition gives one row a line."""
    from pyspark.sql import functions as F

    d = definitions.select("file", F.col("name").alias("caller"), F.col("startLine").alias("s"), F.explode(F.sequence("startLine", "endLine")).alias("startLine"))
    best = d.groupBy("file", "startLine").agg(F.max_by("caller", "s").alias("caller"))
    return calls.join(best, ["file", "startLine"], "left").select("file", "name", "startLine", F.coalesce("caller", F.lit("")).alias("caller"))
