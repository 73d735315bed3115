"""Texts that were cut off before their end, by a backward character n-gram model.

The model reads characters backward from a place in a text. For the last ``LEVELS[-1]`` characters and each shorter tail of
them it counts over the whole corpus how often the tail stands before a border (sentence end, line end, end of text) and how
often the text goes on; the ratio of the two, smoothed from the shortest tail to the longest, is the log-odds that a text may
end there. A text whose end is far likelier to be gone on with is cut. The threshold moves with how often texts of the same
language and source are cut.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tails that are counted, in characters.
LEVELS = (1, 2, 3, 4, 6, 9, 12)
#: Log-odds below which an end is a cut, and how far a language and source may move it.
THRESHOLD, SHIFT = -2.6, 1.0
#: The same for texts with a sign of the cut in sources where the sign means one.
SIGNED = 0.0
#: The same for texts that say they were cut or end in an open code span.
SAID = 2.0
#: Most rows of a table that is broadcast, by count, and the parts of a key where both sides are shuffled.
BROADCAST, SALTS = 100_000, 4
#: Tails up to so many characters are few, and each is asked for by many longer ones.
SHORT = 3
#: Weight of the shorter tail against the counts of a longer one, and the share of borders at no tail at all.
PRIOR, BASE = 4.0, 0.02

_BORDER = ".!?。！？\n"
_SIGN = re.compile(r"[ \t]*(?:\.{2,}|…|\[(?:\.\.\.|…)\]|\(\.\.\.\))[ \t]*\Z")
#: Words that say a text was cut (fixed values).
_SAID = re.compile(r"[ \t]*[\[(<{](?:truncated|more|continued|cont\.?|cut|cut off|snip|snipped|read more|see more|gekürzt|tronqué|truncado|cortado|обрезано|截断|省略)[\])>}][ \t]*\Z", re.I)
#: Runs of white space in a line that aren't one plain space.
_SPACES = re.compile(r"(?: ?[^\S\n ]|  )[^\S\n]*")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_TABLE_ROW = re.compile(r"^\|.*\|$", re.M)
_PATH, _CALL = r"|\b[\w.-]+(?:/[\w.-]+)+\.\w{1,4}\b", r"|\b\w+\(\)"
#: Complete codes, links, references and numbers; paths and calls are looked for only in texts that have their signs.
_WHOLE = {(p, c): re.compile(r"```[^`]*```|`[^`\n]*`|https?://\S*[\w/]" + _PATH * p + _CALL * c + r"|#\d+|\d+") for p in (False, True) for c in (False, True)}
_REFERENCES = re.compile(r"(?:[ \t]*[(（]?(?:```x```|`x`|u://x|x/x\.x|x\(\)|#0)[)）]?)+\Z")
#: A title or field line: a short list of plain words after its key, where only a cut inside a word can be seen.
_TITLE = re.compile(r"(?:\A|\n)(?:\w+(?:\([\w./-]+\))?!?: |:\w+[^:\n]{0,40}: |#+ )[a-z0-9_-]+(?: [a-z0-9_-]+){0,3}\Z")
_QUOTES = re.compile(r"[\"'”’»)\]】」』*_ ]+\Z")


def _stand_in(m: re.Match[str]) -> str:
    x = m.group()
    if x.startswith("```"):
        return "```x```"
    if x[0] == "`":
        return "`x`"
    if "://" in x:
        return "u://x"
    if x[-1] == ")":
        return "x()"
    return "x/x.x" if "/" in x else "#0" if x[0] == "#" else "0"


def normal(text: str) -> str:
    """Composed letters, plain spaces and line ends; complete codes, links, references and numbers as one stand-in each."""
    t = text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    t = _SPACES.sub(" ", t.replace("\r\n", "\n").replace("\r", "\n")).strip()
    if "|" in t:
        t = _TABLE_ROW.sub("|x|", t)
    return _WHOLE["/" in t, "()" in t].sub(_stand_in, t)


def _at_end(pattern: re.Pattern[str], t: str) -> re.Match[str] | None:
    """A sign of a cut ends a text and is short, so the search starts close to the end."""
    return pattern.search(t, max(0, len(t) - 64))


def tail_of(text: str | None) -> tuple[str, str, str]:
    """(state, tail, tail before references at the end): 'whole' ends at a border, 'blank' has nothing, 'broken' ends inside a
    character; the others are for the model: 'open', 'said' with words for the cut, 'span' in an open code span, and 'title'
    for the part of it that tells whether a word goes on."""
    if text is None:
        return "blank", "", ""
    t = normal(text)
    if not t:
        return "blank", "", ""
    if t[-1] == "\ufffd":
        return "broken", "", ""
    said = _at_end(_SAID, t)
    if said:
        s = t[: said.start()].rstrip()
        return ("whole", "", "") if not s or s[-1] in ".!?。！？" else ("said", ("\n" + s)[-LEVELS[-1] :], "")
    signed = _at_end(_SIGN, t)
    s = t[: signed.start()].rstrip() if signed else t
    if not s:
        return "blank", "", ""
    bare = _QUOTES.sub("", s)
    if s[-1] in _BORDER or bare and bare[-1] in ".!?。！？":
        return "whole", "", ""
    if s.count("```") % 2 or s[s.rfind("\n") + 1 :].replace("```", "").count("`") % 2:
        return "span", ("\n" + s)[-LEVELS[-1] :], ""
    tail = ("\n" + s)[-LEVELS[-1] :]
    if _TITLE.search(s):
        return "title", tail, ""
    before = _REFERENCES.sub("", s).rstrip()
    if before == s:
        return "open", tail, ""
    if not before or before[-1] in _BORDER or before[-1] in ":：":
        return "whole", "", ""
    return "open", tail, ("\n" + before)[-LEVELS[-1] :]


#: Code point -> what follows a tail with it: 1 a border, 2 a letter, 0 another character; made when it is first asked for.
_KINDS: list[np.ndarray] = []
#: Characters that are counted together; a longer text is counted in slices that overlap by a tail.
CHUNK = 1 << 21
_POWERS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(LEVELS[-1])]


def _kinds() -> np.ndarray:
    if not _KINDS:
        _KINDS.append(np.array([1 if (c := chr(i)) in _BORDER else 2 if c.isalpha() else 0 for i in range(0x110000)], np.uint8))
    return _KINDS[0]


def body_of(text: str) -> str:
    """The text as its places are counted: normal, without a sign of a cut at its end, after a line end."""
    s = normal(text)
    for sign in (_SAID, _SIGN):
        signed = _at_end(sign, s)
        if signed:
            s = s[: signed.start()].rstrip()
    return "\n" + s


def places(bodies: list[tuple[str, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tails, kinds, counts): every place of the bodies as its longest tail and the kind of what follows; places after a border
    are none. Of each body as many characters as the number beside it are only context. Windows are told apart by 64 bits."""
    k = LEVELS[-1]
    pad = "\0" * k
    text = pad + pad.join(b for b, _ in bodies)
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[a]
    ok = a != 0
    ok[2:] &= (a[1:-1] != 0) & (a[:-2] != 0) & (kind[1:-1] != 1)
    ok[:k] = False
    at = k
    for b, skip in bodies:
        if skip:
            ok[at : at + skip] = False
        at += len(b) + k
    ends = np.flatnonzero(ok)
    with np.errstate(over="ignore"):
        wide = a.astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(a) - k + 1, np.uint64)
        for j, p in enumerate(_POWERS):
            h += wide[j : len(a) - k + 1 + j] * np.uint64(p)
        h = h[ends - k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h & ~np.uint64(3)) | kind[ends].astype(np.uint64)
    _, first, counts = np.unique(h, return_index=True, return_counts=True)
    at_ = ends[first]
    return [text[e - k : e].lstrip("\0") for e in at_.tolist()], kind[at_], counts


def _slices(body: str):
    """A body in slices that are counted alone: (characters, how many of them are context)."""
    k = LEVELS[-1]
    for a in range(0, len(body), CHUNK):
        lo = max(0, a - k)
        yield body[lo : a + CHUNK], a - lo


def _count(batches):
    waiting, held = [], 0

    def flush():
        tails, kind, n = places(waiting)
        return pd.DataFrame({"tail": tails, "n": n, "b": np.where(kind == 1, n, 0), "w": np.where(kind == 2, n, 0)})

    for pdf in batches:
        for t in pdf["text"]:
            for part in _slices(body_of(t)):
                waiting.append(part)
                held += len(part[0])
                if held >= CHUNK:
                    yield flush()
                    waiting, held = [], 0
    if waiting:
        yield flush()


def _tails(batches):
    for pdf in batches:
        st = [tail_of(t) for t in pdf["text"]]
        signed = [isinstance(t, str) and _at_end(_SIGN, t.rstrip()) is not None for t in pdf["text"]]
        yield pdf.drop(columns="text").assign(state=[x[0] for x in st], tail=[x[1] for x in st], before=[x[2] for x in st], signed=signed)


def _shorter(column: str):
    return F.explode(F.array(*[F.when(F.length(column) >= k, F.struct(F.lit(k).alias("k"), F.right(F.col(column), F.lit(k)).alias("t"))) for k in LEVELS]))


def _met(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join by a key that many rows of the left may have: the right is broadcast if it is small by count, else both sides
    are shuffled by key and salt. ``few`` has distinct keys and is checkpointed."""
    if few.limit(BROADCAST + 1).count() <= BROADCAST:
        return many.join(F.broadcast(few), key, how)
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"], how).drop("salt")


def find_truncated(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, lang, source, state, log_odds, cut) of every document.

    ``documents`` has doc_id, text, lang, source. Null and blank texts have state 'blank' and are never cut; texts that end
    at a sentence or line end are 'whole'; ends inside a character ('broken') are cut. Languages
    are cleaned to two lower-case letters, null and unknown ones are 'und'; a null source is one of its own.
    """
    from weft.session import checkpointed

    lang = F.coalesce(F.regexp_extract(F.lower("lang"), r"^([a-z]{2})(?:[-_]|$)", 1), F.lit(""))
    docs = documents.select("doc_id", F.when(lang == "", "und").otherwise(lang).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counted = docs.where("text is not null").select("text").mapInPandas(_count, "tail string, n long, b long, w long").groupBy("tail").agg(*[F.sum(c).alias(c) for c in "nbw"])
    ends = checkpointed(docs.withColumn("h", F.xxhash64("text")).mapInPandas(_tails, "doc_id long, lang string, source string, h long, state string, tail string, before string, signed boolean"))
    # the end of a text is a border too; equal texts count once
    open_ends = ends.where("tail <> ''").select("h", "tail").distinct().groupBy("tail").agg(F.count("*").alias("n"))
    sums = [F.sum(c).alias(c) for c in "nbw"]
    table = checkpointed(counted.unionByName(open_ends.select("tail", "n", F.col("n").alias("b"), F.lit(0).cast("long").alias("w"))).select(_shorter("tail").alias("x"), "n", "b", "w").where("x is not null").groupBy(F.col("x.t").alias("t")).agg(*sums))
    # a text's own end is left out of its evidence; it counted only for the tail with the references
    wanted = open_ends.select("tail", F.lit(1).alias("own")).unionByName(ends.where("before <> ''").select(F.col("before").alias("tail"), F.lit(0).alias("own"))).groupBy("tail").agg(F.max("own").alias("own"))
    asked = wanted.select("tail", "own", _shorter("tail").alias("x")).where("x is not null").select("tail", "own", F.col("x.k").alias("k"), F.col("x.t").alias("t"))
    # each short tail is the end of many others; a long one of few
    short = _met(asked.where(F.col("k") <= SHORT), table.where(F.length("t") <= SHORT), "t")
    found = short.unionByName(asked.where(F.col("k") > SHORT).join(table.where(F.length("t") > SHORT), "t").select(*short.columns))
    steps = found.groupBy("tail").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("n") - F.col("own")).alias("n"), (F.col("b") - F.col("own")).alias("b"), "w"))).alias("steps"))

    def odds(good, base):
        p = F.aggregate("steps", F.lit(base), lambda acc, s: F.when(s["n"] <= 0, acc).otherwise((F.greatest(good(s), F.lit(0)) + PRIOR * acc) / (s["n"] + PRIOR)))
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))

    scored = checkpointed(steps.select("tail", odds(lambda s: s["b"], BASE).alias("border"), odds(lambda s: s["n"] - s["w"], 0.2).alias("word")))
    ahead = scored.select(F.col("tail").alias("before"), F.col("border").alias("border2"))
    value = F.when(F.col("state").isin("open", "said", "span"), F.greatest(F.coalesce("border", F.lit(0.0)), F.coalesce("border2", F.lit(-99.0)))).when(F.col("state") == "title", F.greatest(F.coalesce("border", F.lit(0.0)), F.coalesce("word", F.lit(0.0))))
    # most texts end at a border and are asked nothing
    keep = ["doc_id", "lang", "source", "state", "signed", "log_odds"]
    alone = ends.where("tail <> '' and before = ''").drop("before")
    both = ends.where("tail <> '' and before <> ''")
    none = F.lit(None).cast("double")
    out = _met(alone, scored, "tail", "left").withColumn("border2", none).withColumn("log_odds", value).select(*keep)
    out = out.unionByName(_met(_met(both, scored, "tail", "left"), ahead, "before", "left").withColumn("log_odds", value).select(*keep))
    out = checkpointed(out.unionByName(ends.where("tail = ''").withColumn("log_odds", none).select(*keep)))
    # how often a language and source is cut moves its threshold
    low = (F.col("state") == "broken") | (F.col("log_odds") < F.when(F.col("state").isin("said", "span"), SAID).otherwise(threshold))
    groups = checkpointed(out.where("state <> 'blank'").groupBy("lang", "source").agg(F.sum(low.cast("int")).alias("c"), F.count("*").alias("m")))
    # where most texts that end in dots are cut, dots are the sign of a cut and not a way of speaking
    dots = checkpointed(out.where("signed and state = 'open'").groupBy("source").agg((F.avg(low.cast("double")) > 0.5).alias("dots_cut")))
    share = groups.agg(((F.coalesce(F.sum("c"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("m"), F.lit(0)) + 20.0)).alias("share")).scalar()
    own = (F.coalesce("c", F.lit(0)) + 20 * share) / (F.coalesce("m", F.lit(0)) + 20.0)
    more = F.log(own / (1 - own)) - F.log(share / (1 - share))
    moved = F.lit(threshold) + 0.5 * F.greatest(F.lit(-SHIFT), F.least(F.lit(SHIFT), more))
    limit = F.when(F.col("state").isin("said", "span"), F.lit(SAID)).when(F.col("signed") & F.coalesce("dots_cut", F.lit(False)), F.lit(SIGNED)).otherwise(moved)
    cut = (F.col("state") == "broken") | F.coalesce(F.col("log_odds") < limit, F.lit(False))
    place = F.xxhash64("lang", "source")
    known = groups.select(place.alias("place"), F.col("lang").alias("l"), F.col("source").alias("s"), "c", "m")
    met = _met(out.withColumn("place", place), known, "place", "left").withColumn("c", F.when((F.col("l") == F.col("lang")) & (F.col("s") == F.col("source")), F.col("c"))).withColumn("m", F.when(F.col("c").isNotNull(), F.col("m")))
    return _met(met, dots, "source", "left").select("doc_id", "lang", "source", "state", "log_odds", cut.alias("cut"))
