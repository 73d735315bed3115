"""Natural language inside code: comments, docstrings and string literals, their sentences, languages and shares.

One regular expression of the delimiter family finds comments and literals of any language with ``//``, ``/* */``, ``#``
and quotes; adjacent comment lines are merged, escapes decoded, and each phrase is classified by the distance of its
n-grams to ranked profiles, with rejection. The profiles are fitted on a sample of labelled documents of a fixed expected size.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexing import language_of

LANGS = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja")
#: Expected number of labelled documents per language that the profiles are fitted on; all where there are fewer.
SAMPLE = 250
#: Ranked n-grams per profile, and frequent short words.
RANKS, COMMON = 600, 60
#: Mean rank distance (1 is the most) above which a phrase is rejected.
REJECT = 0.80
MIN_WORDS, MIN_CHARS = 4, 8

#: Closed-class words that every profile starts from (fixed values).
FUNCTION_WORDS = {
    "en": "the a an of to in on for with and or not is are was be has have it this that your you we by as at from if please must",
    "de": "der die das ein eine den dem des und oder nicht ist sind wird im mit von zu auf für bei aus wenn sich bitte",
    "fr": "le la les un une des du de et ou ne pas est sont sur dans pour avec par au aux il ce cette qui que",
    "es": "el la los las un una del de y o a no es son en con por para al se que su lo está",
    "pt": "o a os as um uma do da dos de e ou não é são em no na com por para ao se que seu",
    "ru": "и в не на с по для из к от до или это как что при если без за о у же то все",
}

_RE_LITERAL = r"(?<=[=(,:\[!&|?;])[ \t]*/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_FAMILY = (
    r'(?P<doc>(?:[rRbBuUfF]{0,2})"""[\s\S]*?(?:"""|\Z)|(?:[rRbBuUfF]{0,2})\'\'\'[\s\S]*?(?:\'\'\'|\Z))'
    r"|(?P<block>/\*[\s\S]*?(?:\*/|\Z))"
    r"|(?P<line>//[^\n]*)"
    r"|(?P<str>`[^`]*(?:`|\Z)"
    r'|"(?:[^"\\\n]|\\[\s\S])*(?:"|$)'
    r"|%s)"
)
_HASH = r"|(?P<hash>#[^\n]*)"
_LINE_HASH = r"|(?P<hash>^[ \t]*#(?![ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line|region|endregion|nullable)\b)(?!\[|!)[^\n]*)"
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_CHARACTER = r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'"
PATTERNS = {
    "python": re.compile((_FAMILY % _SINGLE).replace(r"(?P<line>//[^\n]*)", r"(?P<line>^[ \t]*//[^\n]*)") + _HASH, re.M),
    "script": re.compile((_FAMILY % _SINGLE) + _LINE_HASH + r"|(?P<re>" + _RE_LITERAL + ")", re.M),
    "brace": re.compile((_FAMILY % _CHARACTER) + _LINE_HASH, re.M),
}
FAMILY = {"python": "python", "javascript": "script", "typescript": "script"}

_ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|((?:\\x[0-9a-fA-F]{2})+)|((?:\\[0-3][0-7]{2})+)|\\([nrt\"'`\\0])")
_ENTITY = re.compile(r"&#(?:x([0-9a-fA-F]{1,6})|(\d{1,7}));")
_LATIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NOT_WORDS = re.compile(r"`[^`\n]*`|\w+://\S+|\S+@\S+\.\S+|[\w.-]*[/\\][\w./\\-]+|\b\w*[_\d]\w*\b|\b[a-z]+[A-Z]\w*|\w+(?:\.\w+)+|\w+\([^)]*\)|%[-\d.]*[a-zA-Z]|\{[^}]*\}|<[^>\n]*>")
_SQL = re.compile(r"\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH)\b.*\b(?:FROM|INTO|SET|TABLE|VALUES|AS)\b")
_KEYBLOCK = re.compile(r"-----(?:BEGIN|END) [A-Z ]+-----|[A-Za-z0-9+/=]{32,}")
_HAN, _KANA, _CYR = re.compile(r"[\u3400-\u9fff]"), re.compile(r"[\u3040-\u30ff]"), re.compile(r"[\u0400-\u04ff]")
_CJK_RUN = re.compile(r"[\u3400-\u9fff\u3040-\u30ff\u3005\u30fc、，,]+")
_END = re.compile(r"(?<=[.!?;:。！？；])\s+|(?<=[。！？；])|\n{2,}")
#: A line of words only, which can go on with the phrase before it.
_CONTINUES = re.compile(r"[^\W\d_]+(?:[ ,'’-]+[^\W\d_]+)*[.!?。！？]?")
_DECOR = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*+|//+[/!]?|#+[:!]?|--+)?[ \t]*|[ \t]*\*+/[ \t]*$")


def _decode(s: str) -> str:
    if "\\" not in s and "&#" not in s:
        return s

    def one(m: re.Match[str]) -> str:
        a = m.group(1) or m.group(2) or m.group(3)
        if a:
            n = int(a, 16)
            return chr(n) if n < 0x110000 else " "
        if m.group(4) or m.group(5):
            b = bytes.fromhex(m.group(4).replace("\\x", "")) if m.group(4) else bytes(int(x, 8) for x in m.group(5).split("\\")[1:])
            try:
                return b.decode("utf-8")
            except UnicodeDecodeError:
                return b.decode("latin-1")
        c = m.group(6)
        return {"n": "\n", "r": "\n", "t": " ", "0": " "}.get(c, c)

    s = _ESCAPE.sub(one, s)
    if "&#" in s:
        s = _ENTITY.sub(lambda m: chr(min(int(m.group(1), 16) if m.group(1) else int(m.group(2)), 0x10FFFF)), s)
    try:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    except UnicodeError:
        return s


def extract(text: str, lang: str) -> list[tuple[str, str]]:
    """(kind, text) of the comments, docstrings and literals of a file; neighbouring line comments are one text."""
    out: list[tuple[str, list[str]]] = []
    last_end = -1
    for m in PATTERNS[FAMILY.get(lang, "brace")].finditer(text):
        kind = m.lastgroup
        if kind == "re" or kind is None:
            continue
        t = m.group()
        if kind in ("line", "hash"):
            if last_end >= 0 and out and out[-1][0] == "comment" and not text[last_end : m.start()].strip() and text.count("\n", last_end, m.start()) <= 1:
                out[-1][1].append(t)
            else:
                out.append(("comment", [t]))
            last_end = m.end()
            continue
        last_end = -1
        if kind == "block":
            out.append(("block", [t]))
        elif len(t) >= 6:
            t = t.lstrip("rRbBuUfF")
            t = t[3:-3] if kind == "doc" else t[1:-1] if t[-1:] == t[0] else t[1:]
            out.append(("literal", [t if kind == "doc" and "\\" not in t else _decode(t)]))
    return [(k, "\n".join(v)) for k, v in out]


class Profiles:
    """Ranked n-gram profiles with the frequent short words of each language; small, and sent with the task."""

    def __init__(self, ranks: dict[str, dict[str, int]], common: dict[str, frozenset[str]]):
        self.ranks, self.common = ranks, common
        self.latin = [x for x in ranks if x not in ("ru", "zh", "ja")]
        self.words: dict[str, tuple] = {}
        self.seen: dict[str, str | None] = {}

    def __getstate__(self):
        return {"ranks": self.ranks, "common": self.common}

    def __setstate__(self, d):
        self.__init__(d["ranks"], d["common"])

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Profiles:
        """rows: (language, text). A word counts once a text for the frequent words, each n-gram as often as it stands."""
        grams = {x: Counter() for x in LANGS}
        df, texts = {x: Counter() for x in LANGS}, Counter()
        for lang, text in rows:
            if lang not in grams or not text:
                continue
            words = [w.lower() for w in _LATIN.findall(_NOT_WORDS.sub(" ", text))]
            texts[lang] += 1
            df[lang].update({w for w in words if len(w) <= 6})
            for w in words:
                grams[lang].update(_grams(w))
        ranks = {x: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda z: (-z[1], z[0]))[:RANKS])} for x, c in grams.items() if c}
        foreign = {w for x in ("zh", "ja", "ru") for w, n in df[x].items() if w.isascii() and n >= 0.003 * texts[x]}  # words of code, in texts of any language
        common = {x: frozenset(w for w, n in sorted(df[x].items(), key=lambda z: (-z[1], z[0]))[:COMMON] if n >= 0.02 * texts[x] and w not in foreign) | frozenset(FUNCTION_WORDS.get(x, "").split()) for x in ranks}
        return cls(ranks, common)

    def _word(self, w: str) -> tuple:
        """The number of a word's n-grams, per Latin language their summed rank distance, and its weight as a frequent word:
        1 if it is one of this language only, less if of several, 0 if of none."""
        v = self.words.get(w)
        if v is None:
            if len(self.words) > 200_000:
                self.words.clear()
            g = _grams(w)
            v = self.words[w] = (len(g), tuple(sum(self.ranks[x].get(y, RANKS) for y in g) for x in self.latin), tuple((w in self.common[x]) / max(1, sum(w in self.common[y] for y in self.latin)) for x in self.latin))
        return v

    def phrase(self, s: str) -> str | None:
        """Language of a phrase, or None if it is too short or no natural language."""
        if s in self.seen:
            return self.seen[s]
        if len(self.seen) > 300_000:
            self.seen.clear()
        r = self.seen[s] = self._phrase(s)
        return r

    def _phrase(self, s: str) -> str | None:
        if len(s) < 8 or _SQL.search(s):
            return None
        s = _NOT_WORDS.sub(" ", _KEYBLOCK.sub(" ", s))
        kana, han = len(_KANA.findall(s)), len(_HAN.findall(s))
        if kana + han >= MIN_CHARS:
            longest = max((len(x) for x in _CJK_RUN.findall(s)), default=0)
            if longest >= MIN_CHARS or kana + han >= 2 * MIN_CHARS:
                return "ja" if kana * 8 >= kana + han else "zh"
            return None
        words = [w.lower() for w in _LATIN.findall(s)]
        if len(words) < MIN_WORDS or s.count(",") * 2 > len(words) or s.count(" ") < MIN_WORDS - 1:
            return None
        if sum(bool(_CYR.search(w)) for w in words) * 2 > len(words):
            known = self.common.get("ru", frozenset())
            total, n = sum(sum(self.ranks["ru"].get(y, RANKS) for y in _grams(w)) for w in words) if "ru" in self.ranks else 0, sum(len(_grams(w)) for w in words)
            return "ru" if not self.ranks.get("ru") or total / n / RANKS < REJECT or any(w in known for w in words) else None
        n, dist, common, frequent = 0, [0] * len(self.latin), [0.0] * len(self.latin), [0] * len(self.latin)
        seen = set()
        for w in words:
            k, d, c = self._word(w)
            n += k
            for i, x in enumerate(d):
                dist[i] += x
            if w not in seen:
                seen.add(w)
                for i, x in enumerate(c):
                    common[i] += x
                    frequent[i] += x > 0
        if not n:
            return None
        best = min(range(len(dist)), key=lambda i: dist[i] - RANKS * 12 * common[i], default=None)
        if best is None or dist[best] / n / RANKS > REJECT or frequent[best] < max(1, len(words) // 8):
            return None
        return self.latin[best]


def _short(s: str) -> bool:
    return 0 < len(_HAN.findall(s)) + len(_KANA.findall(s)) < MIN_CHARS


def _grams(w: str) -> list[str]:
    w = f"_{w}_"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def phrases(text: str, lang: str, model: Profiles) -> dict[str, tuple[int, int]]:
    """language -> (phrases, characters of phrases) of a file."""
    out: dict[str, list[int]] = {}

    def add(x: str, s: str) -> None:
        e = out.setdefault(x, [0, 0])
        e[0] += 1
        e[1] += len(s)

    for kind, t in extract(text, lang):
        if len(t) < 8:
            continue
        if kind != "literal":
            lines = [_DECOR.sub("", x).strip() for x in t.split("\n")]
        else:
            lines = [x.strip() for x in t.split("\n")]
        if len(lines) == 1:
            for s in _END.split(lines[0]):
                x = model.phrase(s.strip())
                if x:
                    add(x, s)
            continue
        rest: list[tuple[str, str | None]] = []  # with the language it is counted in
        joined: list[str] = []
        for line in lines:  # a line that starts small goes on with the phrase of the one before
            if joined and joined[-1] and line and joined[-1][-1] not in ".!?:;。！？" and (line[0].islower() or _short(joined[-1])):
                joined[-1] += " " + line
            else:
                joined.append(line)
        for line in joined:
            whole = [s.strip() for s in _END.split(line)]
            found = [(s, model.phrase(s)) for s in whole]
            if any(x for _, x in found):
                for s, x in found:
                    if x:
                        add(x, s)
                rest.append((line if len(whole) == 1 else whole[-1], found[-1][1]))
            else:
                rest.append((line, None))
        # phrases that only become long enough over several lines, and short lines that go on with a counted one
        text_, at = " ".join(s for s, _ in rest), 0
        places = []
        for s, x in rest:
            places.append((at, at + len(s), x))
            at += len(s) + 1
        at = 0
        for m in [*_END.finditer(text_), None]:
            a, b = at, m.start() if m else len(text_)
            at = m.end() if m else b
            s = text_[a:b].strip()
            x = model.phrase(s)
            if not x:
                continue
            parts = [(text_[max(a, c) : min(b, d)], y) for c, d, y in places if c < b and a < d]
            counted = {y for _, y in parts if y}
            if not counted:
                add(x, s)
                continue
            new = sum(len(p) for p, y in parts if not y and (x not in counted or _CONTINUES.fullmatch(p)))
            e = out.setdefault(x, [0, 0])
            e[0] += x not in counted
            e[1] += new
    return {x: (a, b) for x, (a, b) in out.items()}


def fit_profiles(documents: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from about ``sample`` documents of each label; labels are cleaned to their first two letters, others ignored.

    A hash of its id takes each document with probability ``sample`` / documents of its label, so that ``sample`` is the
    expected size and not a bound.
    """
    lang = F.lower(F.split("lang", "[-_]")[0])
    d = documents.select(lang.alias("lang"), "text", F.abs(F.xxhash64("doc_id")).alias("h")).where(lang.isin(*LANGS) & F.col("text").isNotNull())
    total = F.greatest(F.count("*"), F.lit(1))
    cut = d.groupBy("lang").agg((F.lit(float(sample)) / total).alias("p"))
    rows = d.join(F.broadcast(cut), "lang").where(F.col("h") % 1_000_003 < F.col("p") * 1_000_003).select("lang", "text").collect()
    return Profiles.fit([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["text"]))])


def languages_in_code(files: DataFrame, model: Profiles) -> DataFrame:
    """(id, lang, phrases, chars, file_chars, share) of each file and language with at least one phrase.

    ``files`` has id and content; rows with null content or no source extension give nothing, repeated rows of an id
    count once, by their largest values. ``share`` is the part of the file's characters that the phrases hold.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for i, c in zip(pdf["id"], pdf["content"]):
                lang = language_of(i)
                if lang and c:
                    n = len(c)
                    rows.extend((i, x, a, b, n) for x, (a, b) in phrases(c, lang, model).items())
            yield pd.DataFrame(rows, columns=["id", "lang", "phrases", "chars", "file_chars"])

    out = files.select("id", "content").mapInPandas(run, "id string, lang string, phrases long, chars long, file_chars long")
    out = out.groupBy("id", "lang").agg(*[F.max(c).alias(c) for c in ("phrases", "chars", "file_chars")])
    return out.withColumn("share", F.least(F.lit(1.0), F.col("chars") / F.col("file_chars")))
