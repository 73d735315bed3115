"""Source files that nobody on the project wrote by hand: generated, minified or bundled, copied from outside, or data.

Copies: the stream of tokens of every file, without comments and with numbers and strings by class, is hashed in windows
and thinned by winnowing, once with names kept and once with names by class, so that renamed copies keep their
fingerprints. A file is a copy if its named fingerprints largely recur in several unrelated repositories, if a good part of
either kind is in one known outside file, or if it lies among the dependencies that a project keeps (``kept_outside``), as a
library that no table knows and one repository has leaves no other trace. The other kinds are measured on the token stream:
how much of it repeats itself (generated), how short its names and how rare its white space are (minified), and whether it
has any statement (data).
"""

from __future__ import annotations

import json
import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import checkpointed

from .lexing import KEYWORD, PATTERNS, classes_of, kws, language_of, tokens

#: Tokens per window with names kept, for one known file and for all repositories (the more files there are, the more
#: short windows recur by chance), and with names by class; and windows per winnowing step.
NAMED, WIDE, SHAPED, W = 16, 32, 40, 8
#: A fingerprint recurs if it is in so many repositories; a file is a copy if this share of its fingerprints recurs.
REPOS, SHARE = 4, 0.6
#: The share of fingerprints in one known file that makes a copy of it, and the number that there must be of those with
#: names and of those without, as short files of one language look alike without names.
KNOWN, LEAST, LEAST_SHAPED = 0.4, 4, 10
#: A file is generated if this share of its windows of ``UNIT`` token classes stood in it before.
REPEATED, UNIT = 0.36, 24
#: Parts of the recurring fingerprints' join, so that one in a third of all files isn't one task's work.
SALTS = 4
#: Most fingerprints of known files that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000

_P = 0x9E3779B97F4A7C15
#: Powers of ``_P`` and of its inverse modulo 2^64, as many as the longest file so far has tokens.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POWERS[0]) < n:
        m = len(_POWERS[0])
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
                _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * np.uint64(pow(base, m, 1 << 64))])
    return _POWERS[0][:n], _POWERS[1][:n]


class _Tokens(dict):
    """Token text of one language -> (hash with its name kept, 0 for what is no token; 1 if it is a name of two characters or
    less); filled as tokens appear, emptied when it holds ``bound`` texts."""

    def __init__(self, lang: str, bound: int = 200_000):
        super().__init__()
        self.table, self.bound = classes_of(lang), bound

    def __missing__(self, t: str) -> tuple[int, int]:
        if len(self) >= self.bound:
            self.clear()
        c = self.table[t]
        h = 0
        if c and c != "\n":
            raw = (c if c in ("N", "S", "R") else t).encode("utf-8", "surrogatepass")
            h = (crc32(raw) * 0x100000001 ^ crc32(raw, 0x5BD1E995) << 16) & 0xFFFFFFFFFFFFFFFF or 1
        r = self[t] = (h, int(c in ("I", "U") and len(t) <= 2))
        return r


_TOKENS: dict[str, _Tokens] = {}


def _tokens_of(lang: str) -> _Tokens:
    if lang not in _TOKENS:
        _TOKENS[lang] = _Tokens(lang)
    return _TOKENS[lang]


def _winnow(hs: list[int] | np.ndarray, k: int) -> np.ndarray:
    """Distinct least hashes of each run of ``W`` windows of k tokens; nothing for fewer than k tokens."""
    if len(hs) < k:
        return np.empty(0, np.int64)
    h = np.array(hs, dtype=np.uint64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        # the sum of a window times powers, from running sums
        up, down = _powers(len(h))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(29))) * up, dtype=np.uint64)])
        win = (sums[k:] - sums[:-k]) * down[:n]
        win ^= win >> np.uint64(31)
        win *= np.uint64(0xBF58476D1CE4E5B9)
        win ^= win >> np.uint64(27)
    if n > W:
        win = np.lib.stride_tricks.sliding_window_view(win, W).min(axis=1)
    return np.unique(win).view(np.int64)


def fingerprints(text: str, lang: str, toks: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed window hashes of a file with names kept, with names by class, and wide ones with names kept; a file shorter
    than a window has none."""
    toks = tokens(text, lang) if toks is None else toks
    known = _tokens_of(lang)
    named = [h for t in toks if (h := known[t][0])]
    codes = np.frombuffer(classes(toks, lang).encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        shaped = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        shaped ^= shaped >> np.uint64(32)
    return _winnow(named, NAMED), _winnow(shaped, SHAPED), _winnow(named, WIDE)


def classes(toks: list[str], lang: str) -> str:
    """The token classes of a file without line ends; names in capitals are names."""
    return "".join(map(classes_of(lang).__getitem__, toks)).replace("\n", "").replace("U", "I")


#: Notes of generators in the comments at the head of a file, in several languages (fixed values).
_NOTE = re.compile(
    r"code generated by|@generated\b|auto-?generated (?:file|code|by|from)|autogenerated file|generated (?:by|from|with) \S+|(?:created|made|written|produced|built) automatically by|automatically (?:generated|created|produced)"
    r"|machine-(?:made|generated)|(?:do not|don't|never) (?:edit|modify|change)|changes will be (?:overwritten|lost)|produced by the \S+ (?:compiler|generator|tool)"
    r"|(?:this|the) file (?:is|was|has been) (?:auto\w*[- ])?(?:generated|emitted|compiled)|regenerated? (?:with|by|using)|(?:manual|hand)[- ](?:edits|changes) (?:will be|are|get) (?:lost|overwritten|discarded)|(?:edits|changes) (?:are|get|will be) (?:lost|overwritten|discarded)|do not (?:touch|alter|modify) this file"
    r"|nicht (?:bearbeiten|von hand ändern)|ne pas (?:modifier|éditer)|no (?:editar|modificar)|não (?:edite|editar|modificar)|не (?:редактируйте|редактировать|изменяйте вручную)|不要(?:手动)?(?:编辑|修改)|編集しない"
    r"|automatisch (?:erzeugt|generiert|erstellt)|(?:produit|généré|créé) automatiquement|(?:creado|generado|producido) (?:de forma automática|automáticamente)|(?:criado|gerado|produzido) (?:de forma automática|automaticamente)"
    r"|сгенерирован|создан автоматически|自动生成|請勿編輯|请勿(?:编辑|修改)|自動生成",
    re.I,
)
#: What bundlers leave in a file: names of their run time, and the comment that points to the map of lines (fixed values).
_BUNDLER = frozenset("__webpack_require__ __webpack_modules__ webpackJsonp __esModule parcelRequire".split())
_MAP = re.compile(r"(?://|/\*)[#@]\s*sourceMappingURL=")
_HEAD = re.compile(r"\A(?:\s*(?://[^\n]*|#(?!\s*(?:include|define|if|ifndef|ifdef|pragma)\b)[^\n]*|/\*[\s\S]*?\*/|--[^\n]*))+")
#: A head note that begins with another project's name and version and goes on with its terms.
_BANNER = re.compile(r"\A[\s*!#/]*[A-Za-z@][\w.@/-]* v?\d+\.\d+(?:\.\d+)?\b[^\n]*(?:licen[cs]e|\bMIT\b|\bBSD\b|\bpermissive\b|copyright|\(c\)|©)", re.I)
#: Folders that hold other projects' code only, and those that do so by custom, with a folder for each library (fixed values).
#: Modules of one's own may have a name of the second kind, and repositories too, so that a file right in one is no copy.
_OUTSIDE = re.compile(
    r"(?:^|[/\\:])(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|Pods|Carthage|Godeps|third[_-]?party|3rd[_-]?party|ThirdParty|vendored|_vendor)[/\\]"
    r"|[/\\](?:vendor|deps|extern)[/\\]+[^/\\]+[/\\]"
)
_SPACE = re.compile(r"\s")
_HEXDUMP = re.compile(r"[0-9a-fA-F]{2,8}(?:[ \t:]+[0-9a-fA-F]{2,8})*[ \t]*\r?(?:\n|\Z)")
_POINTER = re.compile(r"\Aversion https?://\S+\s+oid \w+:[0-9a-f]{32,}\s+size \d+\s*\Z")
_MARKUP = re.compile(r"\A(?:<\?xml\b|<svg\b|%PDF-|GIF8[79]a)", re.I)
_STATEMENTS = frozenset(kws("if else for while return switch case try catch throw function func fn def interface impl trait match loop new delete lambda with yield await"))


def shape(text: str, lang: str, toks: list[str] | None = None) -> str | None:
    """'generated', 'minified' or 'data' by the form of the file, 'copied' by another project's banner at its head, else None."""
    body = text.strip()
    if not body:
        return None
    lines = [x for x in body.split("\n") if x.strip()]
    if _blob(body, lines):
        return "data"
    toks, table = tokens(text, lang) if toks is None else toks, classes_of(lang)
    cls = classes(toks, lang)
    if _values_only(body, cls, toks, table, lang):
        return "data"
    if len(cls) >= 60 and _minified(body, lines, toks, table, lang):
        return "minified"
    head = _HEAD.match(text)
    if head and _NOTE.search(head.group()) and text[head.end() :].strip():
        return "generated"
    if repeated(cls) >= REPEATED:
        return "generated"
    if head and _BANNER.search(head.group()):
        return "copied"
    return None


def kept_outside(path: str) -> bool:
    """Whether a path or id lies in a folder for the code of other projects, by whole folder names in their usual case."""
    return _OUTSIDE.search(path) is not None


def repeated(cls: str) -> float:
    """The share of windows of ``UNIT`` token classes that stood in the file before; 0 for files of less than two windows."""
    n = len(cls) - UNIT + 1
    if n <= UNIT:
        return 0.0
    return 1.0 - len({cls[j : j + UNIT] for j in range(n)}) / n


def _blob(body: str, lines: list[str]) -> bool:
    """Whether a file is no code of any language but a pointer, dump, mark-up, rows of columns or table of values under a source's name."""
    if _POINTER.match(body) or _MARKUP.match(body):
        return True
    if _HEXDUMP.fullmatch(lines[0].strip() + "\n") and sum(map(len, lines)) >= 32 and all(_HEXDUMP.fullmatch(x.strip() + "\n") for x in lines) and not all(x.strip().isalpha() for x in lines):
        return True
    if len(lines) >= 4 and not any(c in "(){}=;<>" for c in body):
        for mark in "\t,|":
            if lines[0].count(mark) >= 2 and len({x.count(mark) for x in lines}) == 1:
                return True
    if body[0] in "[{" and body[-1] in "]}" and len(body) > 40:
        try:
            json.loads(body)
            return True
        except (ValueError, RecursionError):
            pass
    return False


def _values_only(body: str, cls: str, toks: list[str], table: dict[str, str], lang: str) -> bool:
    """Whether a file has values and names for them, but no statement, function or call."""
    if not _STATEMENTS.isdisjoint(cls) or "I(" in cls or lang in ("javascript", "typescript") and "f" in cls:
        return False
    values = cls.count("N") + cls.count("S")
    strings = [t for t in toks if table[t] == "S"]
    long = sum(map(len, strings))
    names = sum(c == "I" or c >= KEYWORD for c in cls)
    if values >= 12 and (values + cls.count(",") >= 0.6 * len(cls) or values >= 0.3 * len(cls) and names <= 1.2 * values):
        return True
    return long >= 0.8 * len(body) and long > 160 and 1 <= names <= 6


def _minified(body: str, lines: list[str], toks: list[str], table: dict[str, str], lang: str) -> bool:
    if not _BUNDLER.isdisjoint(toks) or "sourceMappingURL" in body and any(_MAP.match(t) for t in toks if not table[t]):
        return True
    known, names = _tokens_of(lang), sum(table[t] in ("I", "U") for t in toks)
    short = sum([known[t][1] for t in toks])
    if len(body) <= 60 * len(lines) and short < 0.6 * names:
        return False
    strings = spaces = 0
    for t in toks:
        if (c := table[t]) in ("S", "R") or not c and len(t) > 1:
            strings += len(t)
            spaces += len(_SPACE.findall(t))
        elif not c:
            strings += 1
    rest = len(body) - strings
    if rest < 150:
        return False
    space = (len(_SPACE.findall(body)) - spaces) / rest
    width = rest / len(lines)
    if lang != "python" and (width > 110 and space < 0.11 or width > 60 and space < 0.08):
        return True
    return names >= 30 and (short >= 0.75 * names or short >= 0.6 * names and space < 0.12)


SCANNED = "seq long, id string, repo string, shape string, named array<long>, shaped array<long>, wide array<long>"


def _scan(batches):
    for pdf in batches:
        shapes, named, shaped, wide = [], [], [], []
        for i, c in zip(pdf["id"], pdf["content"]):
            lang = language_of(i)
            s, prints = None, ([], [], [])
            if lang is not None and c is not None and c.strip():
                toks = tokens(c, lang)
                s = shape(c, lang, toks) or ("copied" if kept_outside(i) else None)
                if s is None or s == "copied":
                    prints = fingerprints(c, lang, toks)
            shapes.append(s)
            named.append(prints[0])
            shaped.append(prints[1])
            wide.append(prints[2])
        yield pdf[["seq", "id", "repo"]].assign(shape=shapes, named=named, shaped=shaped, wide=wide)


def _known(batches):
    langs = {"typescript": "typescript", "javascript": "javascript"}
    for pdf in batches:
        rows = []
        for key, name, lang, c in zip(pdf["key"], pdf["fileName"], pdf["language"], pdf["content"]):
            lang = language_of(name) or langs.get(str(lang).lower()) or (str(lang).lower() if str(lang).lower() in PATTERNS else None)
            if lang and c:
                for kind, fps in enumerate(fingerprints(c, lang)[:2]):
                    rows.extend((fp, kind, key) for fp in fps.tolist())
        yield pd.DataFrame(rows, columns=["fp", "kind", "key"]).astype({"fp": "int64", "kind": "int32", "key": "int64"})


def classify_origin(files: DataFrame, known: DataFrame | None = None, repos: int = REPOS, share: float = SHARE) -> DataFrame:
    """(seq, id, repo, origin, recurrent_share, known_share): origin is generated, minified, data, copied or None for hand-written.

    ``files`` has seq, id, repo, content of source files; ``known`` has fileName, language, content of outside files.
    Null, empty and blank contents have origin None. What lies among a project's dependencies (``kept_outside``) is copied,
    also where no other file is like it, unless it has one of the other forms. A repository that is null counts as one
    repository of its own.
    ``recurrent_share`` is the part of a file's wide fingerprints that ``repos`` repositories have, ``known_share`` the
    largest part of its fingerprints of either kind that one known file has.
    """
    scanned = checkpointed(files.select("seq", "id", "repo", "content").mapInPandas(_scan, SCANNED))
    bare = scanned.where("shape is null or shape = 'copied'")
    prints = bare.select("seq", F.coalesce("repo", F.lit("")).alias("repo"), F.explode("wide").alias("fp"))
    # repositories per fingerprint: distinct pairs first, so that a fingerprint of every file costs one row a repository
    frequent = prints.groupBy("fp", "repo").agg(F.lit(1).alias("one")).groupBy("fp").agg(F.count("*").alias("repos")).where(F.col("repos") >= repos).select("fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = prints.select("seq", "fp", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int").alias("salt"))
    hits = salted.join(frequent, ["fp", "salt"], "left_semi").groupBy("seq").agg(F.count("*").alias("recurrent"))
    sizes = [F.greatest(F.size(c), F.lit(1)).alias(n) for c, n in (("named", "total"), ("shaped", "forms"), ("wide", "spans"))]
    out = scanned.select("seq", "id", "repo", "shape", *sizes).join(hits, "seq", "left")
    if known is None:
        out = out.withColumn("named_hits", F.lit(0)).withColumn("shaped_hits", F.lit(0))
    else:
        out = out.join(_known_hits(bare, known), "seq", "left")
    recurrent = F.coalesce("recurrent", F.lit(0))
    a, b = F.coalesce("named_hits", F.lit(0)), F.coalesce("shaped_hits", F.lit(0))
    copied = (recurrent >= LEAST) & (recurrent >= share * F.col("spans")) | (a >= LEAST) & (a >= KNOWN * F.col("total")) | (b >= LEAST_SHAPED) & (b >= KNOWN * F.col("forms"))
    origin = F.when(F.col("shape").isNotNull(), F.col("shape")).when(copied, F.lit("copied"))
    return out.select("seq", "id", "repo", origin.alias("origin"), (recurrent / F.col("spans")).alias("recurrent_share"), F.greatest(a / F.col("total"), b / F.col("forms")).alias("known_share"))


def _known_hits(bare: DataFrame, known: DataFrame) -> DataFrame:
    """(seq, named_hits, shaped_hits): the most fingerprints of each kind that a file has in common with one known file."""
    outside = checkpointed(known.select(F.xxhash64("fileName", "language", "content").alias("key"), "fileName", "language", "content").mapInPandas(_known, "fp long, kind int, key long").distinct())
    both = bare.select("seq", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("named").alias("fps")), F.struct(F.lit(1).alias("kind"), F.col("shaped").alias("fps")))).alias("x"))
    both = both.select("seq", "x.kind", F.explode("x.fps").alias("fp"))
    side = F.broadcast(outside) if outside.count() <= BROADCAST else outside
    per = both.join(side, ["fp", "kind"]).groupBy("seq", "kind", "key").agg(F.count("*").alias("n"))
    return per.groupBy("seq").agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"{name}_hits") for k, name in enumerate(("named", "shaped"))])
