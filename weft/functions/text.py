"""Column functions over ids, paths and texts; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.fixed import ENTRY_NAMES, STOP_WORDS, TEST_PATHS, UTILITY_NAMES

#: Extension -> language (fixed values of the data model).
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "cs": "csharp", "go": "go", "rs": "rust",
}
#: Folders that a scan leaves out (own choice of the usual ones).
IGNORED_FOLDERS = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", "coverage", "third_party", "deps", "generated")
#: Folder names that say nothing about a community (fixed values of the data model).
GENERIC_FOLDERS = ("src", "lib", "core", "utils", "common", "shared", "helpers")


def make_id(label: Column, key: Column) -> Column:
    return F.concat_ws(":", label, key)


def label_of(node_id: Column) -> Column:
    """The label in an id; communities and processes are known by their prefix."""
    return F.when(node_id.startswith("comm_"), "Community").when(node_id.startswith("proc_"), "Process").otherwise(F.substring_index(node_id, ":", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def short_path(path: Column, segments: int = 3) -> Column:
    return F.substring_index(path, "/", -segments)


def ancestors(path: Column) -> Column:
    """Array of the folders above a path, from the top down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normal_path(path: Column) -> Column:
    """A path with '.' and '..' resolved; '..' above the top stays out."""
    parts = F.split(path, "/")
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(up, "/")


def language_of(path: Column) -> Column:
    """Language by extension, null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[ext]


def ignored(path: Column) -> Column:
    """Whether a scan leaves a path out: an ignored or hidden folder, or a generated or minified name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED_FOLDERS])) | path.rlike(r"(^|/)\.[^/]") | F.lower(path).rlike(r"\.(min|bundle|generated|gen|pb)\.[a-z]+$")


def slashes(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.translate(path, "\\", "/")


def is_test(path: Column, kind: str = "impact") -> Column:
    """Whether a path is one of a test, by the rules for impact, entry points ('entry') or the report of dependants."""
    p = F.lower(path) if kind == "report" else slashes(F.lower(path))
    out = None
    for how, what in TEST_PATHS[kind]:
        c = p.contains(what) if how == "has" else p.endswith(what)
        out = c if out is None else out | c
    return out


def is_utility(path: Column) -> Column:
    p = F.lower(path)
    return p.contains("/utils/") | p.contains("/util/") | p.contains("/helpers/") | p.contains("/common/") | p.contains("/shared/") | p.rlike(r"(^|/)(utils|helpers|util)\.[a-z]+$")


def capitalised(s: Column) -> Column:
    """First letter up, the rest as it is."""
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def sanitised_id(s: Column) -> Column:
    return F.lower(F.substring(F.regexp_replace(s, "[^A-Za-z0-9]", "_"), 1, 20))


def slug(s: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def truncated(s: Column, most: int) -> Column:
    """At most ``most`` characters and '...'; cut at the last space if that lies beyond 80 % of them."""
    head = F.substring(s, 1, most)
    last = F.lit(most) - F.instr(F.reverse(head), " ")
    at = F.when((F.instr(F.reverse(head), " ") > 0) & (last > F.lit(most * 0.8)), last).otherwise(F.lit(most))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(head.substr(F.lit(1), at.cast("int")), F.lit("...")))


def cleaned(s: Column) -> Column:
    """Line ends as \\n, at most two in a row, no blanks at line ends, trimmed."""
    t = F.regexp_replace(s, "\r\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(t, r"[ \t]+\n", "\n"))


def sanitised_text(s: Column) -> Column:
    """CRLF as \\n and no control characters but tab and newline."""
    return F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def is_binary(s: Column) -> Column:
    """More than a tenth of the first 1000 characters are control characters (a defined window of the check)."""
    head = F.substring(s, 1, 1000)
    odd = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0E-\x1F\x7F]", ""))
    return (F.length(head) > 0) & (odd * 10 > F.length(head))


def snippet(content: Column, start: Column, end: Column, around: int = 2, most: int = 5000) -> Column:
    """Lines start-around..end+around (from 0) of a file, cut at ``most`` characters with a note."""
    lines = F.split(content, "\n")
    a = F.greatest(start - around, F.lit(0))
    b = F.least(end + around, F.size(lines) - 1)
    text = F.array_join(F.slice(lines, (a + 1).cast("int"), F.greatest(b - a + 1, F.lit(0)).cast("int")), "\n")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... [truncated]"))).otherwise(text)


def tokens(text: Column) -> Column:
    """Search tokens: lower case, split at everything but ASCII letters, digits and '_', of two characters or more."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: F.length(t) > 1)


def framework_factor(path: Column) -> Column:
    """How much a path speaks for an entry point, the first rule that fits (fixed rules of the data model)."""
    p = F.lower(F.concat(F.lit("/"), path))
    return (
        F.when(p.rlike(r"/pages/.*\.(tsx|ts|jsx|js)$") & ~p.contains("/_") & ~p.contains("/api/"), 3.0)
        .when(p.rlike(r"/app/.*page\.(tsx|ts|jsx|js)$") | p.rlike(r"/pages/api/") | p.rlike(r"/app/.*route\.(ts|js)$"), 3.0)
        .when(p.endswith("views.py") | p.rlike(r"controller\.java$") | p.rlike(r"controller\.cs$"), 3.0)
        .when(p.endswith("/main.go") | p.endswith("/main.rs") | p.endswith("/main.c") | p.endswith("/main.cpp"), 3.0)
        .when(p.contains("/routes/") | p.contains("/controllers/") | p.contains("/handlers/") | p.contains("/routers/") | p.contains("/bin/") | p.endswith("/app.c") | p.endswith(".razor"), 2.5)
        .when(p.endswith("urls.py") | p.rlike(r"/app/.*layout\.(tsx|ts)$") | p.contains("/api/") & p.endswith(".py"), 2.0)
        .when(p.contains("/services/") & p.endswith(".java") | p.rlike(r"/api/index\.(ts|js)$"), 1.8)
        .otherwise(1.0)
    )


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


ENTRY_NAME, UTILITY_NAME = _any(ENTRY_NAMES["*"]), _any(UTILITY_NAMES)


def name_factor(name: Column, language: Column | None = None) -> Column:
    """0.3 for a helper's name, 1.5 for that of an entry point of any language or the node's own, else 1."""
    out = F.when(name.rlike(UTILITY_NAME), 0.3).when(name.rlike(ENTRY_NAME), 1.5)
    if language is not None:
        for lang, patterns in ENTRY_NAMES.items():
            if lang != "*":
                out = out.when((language == lang) & name.rlike(_any(patterns)), 1.5)
    return out.otherwise(1.0)


def name_tokens(text: Column) -> Column:
    """Search tokens of names: parts between blanks and punctuation, each camel-case part and the whole in lower case, without
    stop words and single characters."""
    raw = F.split(text, r"""[\s\-_./\\(){}\[\]<>:;,!?'"]+""")
    parts = F.flatten(F.transform(raw, lambda t: F.array_distinct(F.concat(F.split(F.lower(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2")), " "), F.array(F.lower(t))))))
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def risk(n: Column) -> Column:
    """Risk by the number of flows that change."""
    return F.when(n == 0, "low").when(n <= 5, "medium").when(n <= 15, "high").otherwise("critical")


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(x * 100, digits))
