"""Lexers of nine languages that turn a file into a string of one-character token classes.

A file is cut by a single compiled pattern (``findall``), and every distinct token text is
classified once per process and kept in a bounded dictionary. Parsers and fingerprints then
work on the class string, where equal shapes of code are equal strings and can be remembered.

Classes: I name, U name in capitals (C and C++), N number, S string or character, R regular expression literal, X no token of the
language; punctuation stands for itself; operators share a class per precedence level (see
``OPERATORS``); a keyword has a private character, ``kw(word)``.
"""

from __future__ import annotations

import re

#: Extension of a source file -> language.
EXTENSIONS = {
    ".js": "javascript", ".ts": "typescript", ".py": "python", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust",
}

#: Operator -> class; what is not here and not a bracket or separator is no token.
OPERATORS = {
    "||": "o", "??": "o", "&&": "n", "|": "|", "^": "^", "&": "&", "==": "q", "!=": "q", "===": "q", "!==": "q",
    "<": "<", ">": ">", "<=": "r", ">=": "r", "<=>": "r", "<<": "s", ">>>": "s", "+": "+", "-": "+", "*": "*", "/": "/", "%": "/", "//": "/",
    "**": "w", "!": "!", "~": "~", "=": "=", "=>": "f", "->": "m", "::": "c", "..": "e", "...": "e", "..=": "e", "++": "i", "--": "i",
    ":=": "d", "<-": "h", "?.": ".", "->*": "m", ".*": ".", "&^": "*", "@": "@", "#": "#", "?": "?", "$": "$",
}
_ASSIGN = re.compile(r"(?:[-+*/%&|^]|<<|>>>?|\*\*|//|&&|\|\||\?\?|&\^|@)=")

#: Classes from here on are keywords.
KEYWORD = chr(0xE000)
_KEYWORDS: dict[str, str] = {}


def kw(word: str) -> str:
    """The private class character of a keyword."""
    if word not in _KEYWORDS:
        _KEYWORDS[word] = chr(ord(KEYWORD) + len(_KEYWORDS))
    return _KEYWORDS[word]


def kws(words: str) -> str:
    return "".join(kw(w) for w in words.split())


#: Words that a language keeps for itself; contextual words are listed apart, as they also serve as names.
WORDS = {
    "javascript": "if else for while do return break continue switch case default try catch finally throw function class extends new delete typeof instanceof in void this super var let const import export null true false yield await async static debugger with",
    "python": "if elif else for while return break continue pass def class import from as with try except finally raise lambda global nonlocal assert del yield await async and or not in is None True False",
    "java": "if else for while do return break continue switch case default try catch finally throw throws class interface enum extends implements new instanceof void this super import package null true false static public private protected final abstract synchronized native transient volatile strictfp assert int long short byte char float double boolean",
    "c": "if else for while do return break continue switch case default goto struct union enum typedef sizeof static const extern inline volatile register restrict void int long short char float double signed unsigned _Bool",
    "cpp": "if else for while do return break continue switch case default goto struct union enum typedef sizeof static const extern inline volatile register void int long short char float double signed unsigned bool class public private protected virtual namespace using template typename new delete this try catch throw operator friend explicit constexpr consteval constinit mutable auto true false nullptr static_cast dynamic_cast const_cast reinterpret_cast noexcept decltype thread_local static_assert co_return co_await co_yield alignas",
    "csharp": "if else for foreach while do return break continue switch case default try catch finally throw class interface enum struct new is as in out ref params void this base using namespace null true false static public private protected internal readonly const abstract virtual override sealed extern unsafe volatile event delegate operator implicit explicit lock checked unchecked fixed goto typeof sizeof stackalloc int long short byte char float double bool string object decimal uint ulong ushort sbyte",
    "go": "if else for return break continue switch case default goto fallthrough func var const type struct interface map chan go defer select range package import",
    "rust": "if else for while loop return break continue match fn let mut const static struct enum trait impl mod use pub crate self Self super where as in ref move unsafe extern true false async await dyn type",
}
CONTEXTUAL = {
    "javascript": "of get set from as",
    "python": "match case type",
    "java": "record var yield sealed permits non",
    "c": "",
    "cpp": "override final",
    "csharp": "get set init add remove var record where yield async await partial when and or not select from let orderby group into join on equals by ascending descending nameof global required file with",
    "go": "",
    "rust": "union macro_rules",
}
WORDS["typescript"] = WORDS["javascript"]
CONTEXTUAL["typescript"] = CONTEXTUAL["javascript"] + " type interface enum namespace module declare abstract readonly public private protected implements keyof is infer unique asserts satisfies override global accessor"
for _l in WORDS:
    kws(WORDS[_l] + " " + CONTEXTUAL[_l])

_CONFLICT = r"^(?:<{7}|\|{7}|>{7}|={7})(?![<>=|])[^\n]*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_CHAR = r"'(?:[^'\\\n]|\\(?:u\{?[0-9a-fA-F]+\}?|x[0-9a-fA-F]+|[0-7]{1,3}|.))'"
_BLOCK = r"//[^\n]*|/\*[\s\S]*?\*/|/\*"
_NUM = r"\d(?:\w|(?<=[eEpP])[+-](?=\d)|\.(?=\d)|(?<=\d)'(?=\d))*(?:\.(?![\w.])|\.[fFlLdD]\b)?|\.\d(?:\w|(?<=[eE])[+-](?=\d))*"
_RE = r"(?:&&|\|\||\?\?|[=!]==?|=>|[=(,:\[!?{};+*%~^<>&|-]|\breturn\b|\btypeof\b|\bcase\b)\s*/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_TICK = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`"
_OPS = r"===|!==|\?\?=|\*\*=|&&=|\|\|=|<<=|>>>=|>>=|\.\.\.|\.\.=|&\^=|//=|<=>|\.\.|&\^|=>|->|::|\+\+|--|:=|<-|\?\.|[-+*/%&|^=!<>@]=|&&|\|\||\?\?|<<|\*\*"
_OPS_PLAIN = _OPS.replace(r"|\*\*=", "").replace(r"|\*\*", "")
_PYOPS = r"\*\*=|//=|<<=|>>=|\.\.\.|->|:=|[-+*/%&|^=!<>@]=|<<|\*\*|//"
_PYSTR = r"(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_PRE = r"^[ \t]*#(?:[^\n\\/]|\\\r?\n|\\|/(?!\*))*"
_NAME = r"[^\W\d]\w*"
_DNAME = r"(?:[^\W\d]|\$)[\w$]*"


def _pattern(*parts: str) -> re.Pattern[str]:
    return re.compile("|".join([_CONFLICT, *parts, r"\S"]), re.M)


PATTERNS = {
    "javascript": _pattern(r"\A#![^\n]*", r"\n", _BLOCK, _TICK, _DQ, _SQ, _RE, "#?" + _DNAME, _NUM, _OPS),
    "typescript": _pattern(r"\A#![^\n]*", r"\n", _BLOCK, _TICK, _DQ, _SQ, _RE, "#?" + _DNAME, _NUM, _OPS),
    "java": _pattern(_BLOCK, r'"""[\s\S]*?"""', _DQ, _CHAR, _DNAME, _NUM, _OPS_PLAIN),
    "c": _pattern(_PRE, _BLOCK, r"(?:u8|[uUL])?" + _DQ, r"[uUL]?" + _SQ, _NAME, _NUM, _OPS_PLAIN),
    "cpp": _pattern(_PRE, _BLOCK, r'(?:u8|[uUL])?R"\w{0,16}\([\s\S]*?\)\w{0,16}"', r"(?:u8|[uUL])?" + _DQ, r"(?:u8|[uUL])?" + _SQ, _NAME, _NUM, _OPS_PLAIN),
    "csharp": _pattern(_PRE, _BLOCK, r'\$*"""[\s\S]*?"""', r'(?:\$@|@\$|@)"(?:[^"]|"")*"', r"\$?" + _DQ, _CHAR, "@?" + _NAME, _NUM, _OPS_PLAIN),
    "go": _pattern(r"\n", _BLOCK, r"`[^`]*`", _DQ, _CHAR, _NAME, _NUM, _OPS_PLAIN),
    "rust": _pattern(r"//[^\n]*", r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/|/\*", r'(?:br|cr|r)"[^"]*"|(?:br|cr|r)#"[\s\S]*?"#|(?:br|cr|r)##"[\s\S]*?"##', r'[bc]?"(?:[^"\\]|\\[\s\S])*"', r"b?" + _CHAR, r"'[^\W\d]\w*", r"(?:r#)?" + _NAME, r"\d(?:\w|(?<=[eE])[+-](?=\d))*(?:\.\d\w*|\.(?![\w.]))?", _OPS_PLAIN),
    "python": _pattern(_PYSTR, r"(?:\r?\n[ \t\f]*(?:#[^\n]*)?)+", r"#[^\n]*", r"\\\r?\n", _NAME, _NUM, _PYOPS),
}

_SUFFIX = {"javascript": "n?", "typescript": "n?", "python": "[jJ]?", "java": "[lLfFdD]?", "c": "[uUlLfF]{0,3}", "cpp": "(?:[uUlLfFzZ]{0,3}|_?[a-z]\\w*)", "csharp": "(?:[uU]?[lL]?[uU]?|[fFdDmM])", "go": "i?", "rust": "(?:[iuf](?:8|16|32|64|128|size))?"}
_NUMBERS = {lang: re.compile(r"(?:0[xX][\da-fA-F_']+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_']+|0[oO][0-7_]+|(?:\d[\d_']*)?\.?(?:\d[\d_']*)?(?:[eE][+-]?[\d_]+)?)" + x + r"\Z") for lang, x in _SUFFIX.items()}
_HEXLIKE = {lang: re.compile(r"0[xX][\da-fA-F_]+(?:[uU]?[lL]{0,2}|n|[iu]\d+|[iu]size)?\Z") for lang in _SUFFIX}


#: Names that are macros by custom; in C and C++ they may stand where the grammar has no name.
_MACRO = re.compile(r"[A-Z][A-Z0-9_]{2,}\Z|__\w+\Z")


class Classes(dict):
    """Token text -> class string of one language, filled as tokens appear; emptied when it holds ``bound`` texts."""

    def __init__(self, lang: str, bound: int = 200_000):
        super().__init__()
        self.lang, self.bound = lang, bound
        words = set((WORDS[lang] + " " + CONTEXTUAL[lang]).split())
        self.words = {w: kw(w) for w in words}

    def __missing__(self, t: str) -> str:
        if len(self) >= self.bound:
            self.clear()
        c = self[t] = self.classify(t)
        return c

    def classify(self, t: str) -> str:
        lang, c = self.lang, t[0]
        if t in self.words:
            return self.words[t]
        if len(t) > 6 and c in "<=>|" and t[:7] == c * 7:
            return "X"
        if lang == "python":
            if c in "\r\n":
                return "\n"
            if c == "#" or c == "\\" and len(t) > 1:
                return ""
            if c in "\"'" or t[-1] in "\"'" and len(t) > 1:
                return "X" if len(t) == 1 else "S"
        else:
            if c == "\n":
                return "\n"
            if c == "/" and t[:2] in ("//", "/*"):
                return "X" if t == "/*" else ""
            if c == "#" and lang in ("c", "cpp", "csharp"):
                return ""
            if t.startswith("#!"):
                return ""
            if lang == "rust" and c == "'" and t[-1] != "'":
                return "X" if t == "'" else "L"
            if t[-1] in "\"'`":
                return "X" if len(t) == 1 else "S"
            if lang in ("javascript", "typescript") and "/" in t and not OPERATORS.get(t) and not _ASSIGN.fullmatch(t) and t != "/":
                head = t[: t.index("/")].strip()
                return self[head] + "R"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return "N" if _NUMBERS[lang].match(t) or _HEXLIKE[lang].match(t) else "X"
        if lang in ("c", "cpp") and _MACRO.match(t):
            return "U"
        if c.isalpha() or c == "_" or t == "$" and lang in ("javascript", "typescript", "java") or c in "$#@" and t[1:].isidentifier() or ord(c) > 127 and c.isidentifier():
            return "I"
        if c in "()[]{};,.:" and len(t) == 1:
            return c
        if _ASSIGN.fullmatch(t):
            return "A"
        return OPERATORS.get(t, "X")


_CLASSES: dict[str, Classes] = {}


def classes_of(lang: str) -> Classes:
    if lang not in _CLASSES:
        _CLASSES[lang] = Classes(lang)
    return _CLASSES[lang]


def language_of(path: str | None) -> str | None:
    """Language of a node id or path by its extension, None if it is no source file."""
    if not path or "." not in path:
        return None
    return EXTENSIONS.get(path[path.rindex(".") :])


def tokens(text: str, lang: str) -> list[str]:
    return PATTERNS[lang].findall(text)


def class_string(text: str, lang: str) -> str:
    return "".join(map(classes_of(lang).__getitem__, tokens(text, lang)))


def offsets(text: str, lang: str) -> list[tuple[int, str]]:
    """(offset, token) for each character of the class string; only for files that have errors to place."""
    table, out = classes_of(lang), []
    for m in PATTERNS[lang].finditer(text):
        for _ in table[m.group()]:
            out.append((m.start(), m.group()))
    return out
