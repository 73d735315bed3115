"""Credentials in source and configuration text, and their redaction in place.

Every quoted or configured value, login in a URL, token of a header, last word of a remark and body of a key block is
measured by its characters per subword under a public vocabulary: natural text and identifiers have many, random strings,
mangled words and passwords few. How few it must have depends on the context (``LIMITS``): least under a neutral name, more
under a name that speaks of a credential. Context rules then drop placeholders, references to where a secret is kept,
public keys, digests and ids. Redaction keeps every offset: it puts ``*`` for each character of the secret and leaves
quotes, escapes, line ends and the rest as they are. The work grows with the length of a text, whatever is in it.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from .tokenizing import TOKENIZERS, encoding

#: A value with fewer characters per subword than this is unnatural in its context; words and paths have 3.5 and more.
UNNATURAL = 2.3
LIMITS = {"named value": 4.0, "login call": 4.0, "url login": 4.5, "header": 4.0, "remark": 3.5, "label": 2.6, "private key": 2.6, "unnatural value": UNNATURAL}
#: Shortest value that counts by unnaturalness alone, without a telling name.
LONG = 16

_CORE = re.compile(
    r"passwor[dt]|passwd|passphrase|pass(?![a-z])|pwd|secret|token|cred(?:ential)?s?(?![a-z])|api[_.-]?key|apikey|(?:access|private|secret|signing|encryption|master|auth|account|shared|client|ssh|license)[_.-]?key"
    r"|kennwort|mot[_.-]?de[_.-]?passe|contrase(?:ñ|n)a|senha(?![a-z])|парол|密码|密碼|口令|パスワード|비밀번호",
    re.I,
)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+", re.U)
#: Last words of a name that make it speak about a credential instead of holding it.
_ABOUT = frozenset("field hint name label url uri path file dir policy length size count limit ttl expiry header head type kind id ids prefix pattern regex column param prompt help text message msg mode host level title error".split())
_ASSIGN = re.compile(r"""["'\])]*(?:\s*:\s*(?:&?\s*(?:'\w+\s+)?(?:mut\s+)?[A-Za-z_][\w.<>\[\]]*))?(?:\s*\[\s*\])?\s*(?::=|=>|=|:)[ \t]*""")
_QUOTE = re.compile(r"""(?:[rRbBuUfF$@L]{0,2})(\"\"\"|"|'|`)""")
_CONFIG_VALUE = re.compile(r"(?:#(?=\S)|[^\s#;,\"'`(){}\[\]])[^\r\n]*?(?=[ \t]*(?:\r?$|\s#|,\r?$))", re.M)
_CONCAT = re.compile(r"""[ \t]*(?:\+|\.|\.\.)?[ \t]*(?:\r?\n[ \t]*(?:\+[ \t]*)?)?(?=["'])""")
_CALL = re.compile(r"""(?:[\w.]|::|\(\))+\((?:[ \t]*["'][\w.-]*["'][ \t]*,)[ \t]*(?=["'`])""")

_PLACEHOLDER = re.compile(
    r"""<[^>]*>|\$\{[^}]*\}|\$\([^)]*\)|\{\{[^}]*\}\}|\{[\w.]*\}|%\([^)]*\)s|%\w+%|\$[A-Za-z_]\w*|@[\w.]+@|\[[^\]]*\]|__\w+__
    |(?:.*[^a-z])?(?:change[-_ ]?(?:me|it)|replace[-_ ]?(?:me|this)|place[-_ ]?holder|example|dummy|redacted|removed|fill[-_ ]?in|not[-_ ]?set|todo|fixme|insert|tbd|n/a)(?:[^a-z].*)?
    |your[-_ ].*|my[-_ ](?:password|secret|token|key)|enter[-_ ].*|\*+|[xX]{3,}|\.+|-+|_+|\?+|0+|none|null|nil|true|false|undefined|empty|optional|required
    |(?:file|vault|env|ref|ssm|secret|secrets|keyring|keychain|op|sops|arn|aws|gcp|kms|azurekv|projects)[:/].*|os\.(?:environ|getenv).*|process\.env.*|(?:System\.)?getenv.*|/?(?:var/)?run/secrets.*""",
    re.I | re.X,
)
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:[:/][\w./-]*)?\Z")
#: A call that takes a user and a secret.
_LOGIN = re.compile(r"""\b\w*(?:[lL]og_?[iI]n|[aA]uthenticate|[sS]ign_?[iI]n|[bB]asic_?[aA]uth)\w*\(\s*(["'`])[^"'`\n]*\1\s*,\s*(?=["'`])""")
_CONCAT_CALL = re.compile(r"""concat!?\(\s*(?=["'])""")
#: What may stand between a name and the literal that serves when the environment has no value.
_FALLBACK = re.compile(r"""[\w.:\[\]()\t "'!?-]*?(?:\|\||\?\?|\?:|\bor\b|\.unwrap_or(?:_else)?\((?:\|_?\|)?|\.get_or_insert\(|\bdefault\()[ \t]*(?=["'`])""")
_IDENTITY = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+\Z")
_DIGEST = re.compile(r"(?:sha\d*|md5|blake\w*|crc\w*|h1)[-:=]", re.I)
_ABOUT_DIGEST = frozenset("sha sha1 sha256 sha384 sha512 md5 hash digest checksum commit revision rev integrity uuid guid etag fingerprint sum icon data image oid version nonce public sri lock ref blob chunk".split())
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s/:@\"'`<>]*):([^\s/@\"'`]+)@[^\s\"'`]+")
_AUTH = re.compile(r"\b(Basic|Bearer|Token|Digest)[ \t]+([A-Za-z0-9+/=_.~*-]{8,})", re.I)
_KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINE = re.compile(r"[A-Za-z0-9+/=]{16,}")
#: What a block of known ends is read by: escapes, header lines, quotes, and runs of base64 of any length.
_KEY_PIECE = re.compile(r"""\\+(?:u[0-9a-fA-F]{4}|[\s\S])|(?:Version|Comment|Charset|Hash):[ \t][^\r\n\\"']*|[A-Za-z][A-Za-z-]*:[ \t]+[^\s\\"']*|(?P<quote>["'])|(?P<run>[+/=]*[A-Za-z0-9][A-Za-z0-9+/=]*)""")
_PEM_ANY = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
#: Strings and configured values long enough to be judged by their subwords.
_LONE = re.compile(r"""(["'`])([A-Za-z0-9+/=_.~!@#$%^&*-]{16,})\1""")
_LONE_CONFIG = re.compile(r"""^[ \t]*(?:[#;]+[ \t]*|//[ \t]*)?(?:export[ \t]+|-[ \t]+)?["']?([A-Za-z_][\w.-]*)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9+/=_.~-]{16,})["']?,?[ \t]*\r?$""", re.M)
#: First characters of pictures, fonts, archives and documents in base64.
_MEDIA = re.compile(r"iVBORw0KGgo|/9j/|R0lGODlh|UklGR|d09G[RM]|T1RUTw|AAEAAAA|UEsDB|H4sI|JVBERi|PHN2Zy|PD94bWw|AAAAHGZ0eX|SUQz|T2dnUw|TVqQ|AGFzbQ")
#: A short comment, and what its words before the last must say for the last to be a credential: a word for one, or only
#: the name of a person's or machine's place (fixed values).
_COMMENT = re.compile(r"(?:^|[ \t;{}])(?://+|#+|--|;+|/?\*+)[ \t]*((?:[^\s\"'`=]+[ \t]+){1,5})(?:=[ \t]*)?[\"'`]?([^\s\"'`()<>]{6,})[\"'`]?[ \t]*(?:\*/)?[ \t]*\r?$", re.M)
_SAYS = re.compile(r"\b(?:pw|pwd|pass|passwd|password|passwort|passphrase|login|logins|creds?|credentials?|secret|token|apikey|api[ _-]key|kennwort|senha|contraseña|mot de passe|пароль|密码|密碼|パスワード)\b:?[ \t]*(?:is|was|for|ist|war|est|es|é)?:?[ \t]*\Z", re.I)
_PLACE = re.compile(r"(?:old |new |the |on )?(?:staging|stage|prod|production|live|dev|development|test|testing|local|demo|sandbox|preprod|qa|uat|root|admin|backup)(?: (?:server|box|db|host|user|account|access))?:[ \t]*\Z", re.I)


@lru_cache(maxsize=100_000)
def characters_per_subword(value: str, folder: str) -> float:
    return len(value) / max(1, len(encoding(folder).encode_ordinary(value)))


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def telling_name(name: str) -> bool:
    """Whether a name holds a credential by its words: its last word is one, or one of a foreign name is in it."""
    words = [w for w in _words(name) if not w.isdigit()]
    if not words or words[-1] in _ABOUT:
        return False
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if last in ("password", "passwort", "passwd", "passphrase", "pass", "pwd", "secret", "secrets", "cred", "creds", "credential", "credentials", "apikey", "token", "passe", "kennwort", "senha"):
        return last != "token" or len(words) > 1
    if last == "key":
        return before in ("api", "access", "private", "secret", "signing", "encryption", "master", "auth", "account", "shared", "client", "ssh", "license")
    return bool(re.search(r"kennwort|passwor[dt]|mot_?de_?passe|contrase[ñn]a|senha|парол|密码|密碼|口令|パスワード", "_".join(words)))


def placeholder(value: str, folder: str = TOKENIZERS) -> bool:
    """Whether a value only stands for one; a word like ``tbd`` inside a long random value is chance."""
    v = value.strip()
    if not v:
        return True
    return _PLACEHOLDER.fullmatch(v) is not None and not (len(v) >= LONG and v[0].isalnum() and re.search(r"\d", v) and characters_per_subword(v, folder) < 1.8)


def _mixed(v: str) -> bool:
    """Letters of both cases or letters with digits, spread as in random text."""
    kinds = [bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]")]
    return sum(kinds) >= 2


def unnatural(value: str, folder: str = TOKENIZERS, context: str = "unnatural value") -> bool:
    """Whether a value has fewer characters per subword than its context allows."""
    return characters_per_subword(value, folder) < LIMITS[context]


def _random(value: str, folder: str) -> bool:
    return len(value) >= LONG and _mixed(value) and unnatural(value, folder)


def _of_digest(words: list[str]) -> bool:
    """Whether a name's last word speaks of a digest or id, or any of a public value."""
    words = [w for w in words if not w.isdigit() or len(w) == 3]
    while words and words[-1].isdigit() and not (len(words) > 1 and words[-2] in ("sha", "md")):
        words.pop()
    return bool(words) and (words[-1] in _ABOUT_DIGEST or words[-1].isdigit() or "public" in words or "sha" in words)


def _name_before(text: str, quote: int) -> str | None:
    """The name that a literal, whose quote is at ``quote``, is assigned to; None where it isn't an assigned value."""
    i = quote
    while i > 0 and quote - i < 2 and text[i - 1] in "rRbBuUfF$@L" and not (i > 1 and (text[i - 2].isalnum() or text[i - 2] == "_")):
        i -= 1

    def blanks(j: int) -> int:
        while j > 0 and text[j - 1] in " \t":
            j -= 1
        return j

    def run(j: int, extra: str) -> int:
        while j > 0 and (text[j - 1].isalnum() or text[j - 1] in extra):
            j -= 1
        return j

    i = blanks(i)
    if text[max(0, i - 2) : i] in (":=", "=>"):
        i, typed = i - 2, False
    elif i > 0 and text[i - 1] in "=:":
        typed = text[i - 1] == "="
        i -= 1
    else:
        return None
    i = blanks(i)
    while i > 1 and text[i - 1] == "]" and (j := blanks(i - 1)) and text[j - 1] == "[":
        i = blanks(j - 1)
    if typed:  # name: type = value
        j = run(i, "_.<>[]")
        k = blanks(j)
        if text[max(0, k - 3) : k] == "mut":
            k = blanks(k - 3)
        if k > 0 and text[k - 1] == "c" and text[max(0, k - 7) : k] == "'static":
            k = blanks(k - 7)
        if k > 0 and text[k - 1] == "&":
            k = blanks(k - 1)
        if k > 0 and text[k - 1] == ":" and j < i and text[max(0, k - 2) : k] != "::":
            i = blanks(k - 1)
    while i > 0 and text[i - 1] in "\"'])":
        i -= 1
    j = run(i, "_$.-")
    while j < i and not (text[j].isalpha() or text[j] in "_$"):
        j += 1
    return text[j:i] or None


class _Spans:
    """Spans taken so far, none of which overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


class _Calls:
    """Whether the statement before a place speaks of a login or credential; each statement is searched once."""

    word = re.compile(r"(?i)login|auth|connect|sign|token|secret|password|key|bearer")

    def __init__(self, text: str):
        self.text = text
        self.breaks: list[int] | None = None
        self.first: dict[int, int] = {}

    def __call__(self, quote: int) -> bool:
        text, i = self.text, quote
        while i > 0 and text[i - 1] in " \t":
            i -= 1
        if i == 0 or text[i - 1] not in "(,":
            return False
        if self.breaks is None:
            self.breaks = [m.start() for m in re.finditer(r"[\n;{}]", text)]
        k = bisect_right(self.breaks, quote)
        if k not in self.first:
            m = self.word.search(text, self.breaks[k - 1] if k else 0, self.breaks[k] if k < len(self.breaks) else len(text))
            self.first[k] = m.end() if m else len(text) + 1
        return self.first[k] <= quote


def _read_string(text: str, at: int, joint: str = "+") -> tuple[list[tuple[int, int]], str, int] | None:
    """Parts (start, end) of the string literal at ``at`` with what is joined to it, its value and its end."""
    parts, value = [], []
    while True:
        m = _QUOTE.match(text, at)
        if not m:
            break
        q, start = m.group(1), m.end()
        end = start
        n = len(text)
        while True:
            end = text.find(q, end)
            if end < 0 or len(q) == 1 and q != "`" and "\n" in text[start:end]:
                return None if not parts else (parts, "".join(value), parts[-1][1] + 1)
            back = end - 1
            while back >= start and text[back] == "\\":
                back -= 1
            if (end - 1 - back) % 2 == 0 or q == "`":
                break
            end += 1
            if end >= n:
                return None
        parts.append((start, end))
        value.append(text[start:end])
        at = end + len(q)
        if joint != "+":
            while at < len(text) and text[at] in ", \t\r\n":
                at += 1
            if not _QUOTE.match(text, at):
                break
            continue
        j = _CONCAT.match(text, at)
        if not j or ("+" not in j.group() and "\n" not in j.group() and j.group().strip() != "."):
            break
        at2 = j.end()
        if not _QUOTE.match(text, at2):
            break
        at = at2
    return (parts, "".join(value), at) if parts else None


def _key_runs(text: str, begin: int, at: int, stop: int) -> list[tuple[int, int]]:
    """Spans of the key's characters between the end ``at`` of the BEGIN line and ``stop``, a last line of any length too.

    Header lines and escapes are left. Of a block in quoted literals, short runs count within the quotes only.
    """
    q = text[begin - 1 : begin]
    literals = q in ("'", '"') and text[max(0, begin - 3) : begin] != q * 3
    within = q if literals else ""
    out = []
    for m in _KEY_PIECE.finditer(text, at, stop):
        if m["run"]:
            if within or not literals or len(m["run"]) >= LONG:
                out.append(m.span())
        elif m["quote"] and literals:
            within = m["quote"] if not within else "" if within == m["quote"] else within
    return out


def find_secrets(text: str, folder: str = TOKENIZERS, config: bool = False) -> list[tuple[str, list[tuple[int, int]]]]:
    """All credentials of a text as (kind, parts): parts are the (start, end) spans of the secret characters, in order.

    ``config`` says that values may stand unquoted (every extension that is no source file).
    """
    found: list[tuple[str, list[tuple[int, int]]]] = []
    taken, blocked = _Spans(), _Spans()
    free, called = taken.free, _Calls(text)

    def take(kind: str, parts: list[tuple[int, int]]) -> None:
        found.append((kind, parts))
        taken.add(parts[0][0], parts[-1][1])

    if "-----BEGIN" in text:
        begins = list(_PEM_ANY.finditer(text))
        for m, after in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
            private = _KEY_BEGIN.match(text, m.start())
            if not private:
                e = text.find("-----END", m.end(), after)
                if e > 0:
                    blocked.add(m.start(), e)
                continue
            end = _KEY_END.search(text, m.end(), after)
            stop = end.start() if end else after
            lines = [(x.start(), x.end()) for x in _KEY_LINE.finditer(text, m.end(), stop)]
            if not end:  # cut block: lines that follow at once
                kept, at = [], m.end()
                for a, b in lines:
                    if text.count("\n", at, a) > 1:
                        break
                    kept.append((a, b))
                    at = b
                lines = kept
            if lines and text.count("\n", m.end(), lines[0][0]) <= 4 and any(unnatural(text[a:b], folder, "private key") for a, b in lines[:4]):
                if end:
                    lines = _key_runs(text, m.start(), m.end(), stop)
                found.append(("private key", [(m.start(), m.end()), *lines]))
                taken.add(m.start(), end.end() if end else lines[-1][1])
    if "://" in text and "@" in text:
        for m in _URL.finditer(text):
            if not placeholder(m.group(2), folder) and free(*m.span(2)) and unnatural(m.group(2), folder, "url login"):
                take("url login", [m.span(2)])
    if "asic" in text or "earer" in text or "uthorization" in text:
        for m in _AUTH.finditer(text):
            v = m.group(2)
            if placeholder(v, folder) or not free(*m.span(2)):
                continue
            if m.group(1).lower() == "basic":
                try:
                    if b":" not in base64.b64decode(v + "=" * (-len(v) % 4), validate=True):
                        continue
                except ValueError:
                    continue
            elif not (_random(v, folder) or len(v) >= LONG and _mixed(v) and re.search(r"\d", v) and unnatural(v, folder, "header")):
                continue
            take("header", [m.span(2)])
    for m in _CORE.finditer(text):
        a, b = m.span()
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_$.-"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in "_$.-"):
            b += 1
        name = text[a:b]
        g = _ASSIGN.match(text, b)
        if not g or not telling_name(name):
            continue
        at = g.end()
        c = _CALL.match(text, at)
        if c:
            at = c.end()
        s = _read_string(text, at)
        if not s and (j := _CONCAT_CALL.match(text, at)):
            s = _read_string(text, j.end(), ",")
        if not s and not c and not config and (c := _FALLBACK.match(text, at)):
            s = _read_string(text, c.end())
        if s:
            parts, value, _ = s
        elif config and not c:
            v = _CONFIG_VALUE.match(text, at)
            if not v:
                continue
            parts, value = [v.span()], v.group()
        else:
            continue
        if placeholder(value, folder) or not free(parts[0][0], parts[-1][1]):
            continue
        low = value.lower()
        if low == name.lower() or low.replace("_", "").replace("-", "") == re.sub(r"[^a-z]", "", name.lower()) or telling_name(value) and not re.search(r"\d", value) and _is_identifier(value):
            continue
        if " " in value and len(value.split()) >= 3 and characters_per_subword(value, folder) > 3:
            continue  # a sentence about a credential
        if _URL.search(value) or "://" in value or not unnatural(value, folder, "named value"):
            continue
        take("named value", [p for p in parts if p[1] > p[0]])
    if "og" in text or "uth" in text or "ign" in text:
        for m in _LOGIN.finditer(text):
            s = _read_string(text, m.end())
            if s and not placeholder(s[1], folder) and free(s[0][0][0], s[0][-1][1]) and unnatural(s[1], folder, "login call"):
                take("login call", [p for p in s[0] if p[1] > p[0]])
    for pattern, unquoted in ((_LONE, False), *(((_LONE_CONFIG, True),) if config else ())):
        for m in pattern.finditer(text):
            a, b = m.span(2)
            v = m.group(2)
            if not _mixed(v) or not free(a, b) or not blocked.free(a, b):
                continue
            if _IDENTITY.match(v) or _HEX.match(v) or _DIGEST.match(v) or placeholder(v, folder) or _HOST.match(v) and not _prefixed(v):
                continue
            if unquoted:
                name = m.group(1)
            else:
                name = _name_before(text, a - 1)
                if name is None:
                    # the first argument of a call can be a credential too, a bare line of a block of data can't
                    if not called(a - 1):
                        continue
                    name = ""
            words = _words(name)
            if _of_digest(words) and not telling_name(name) and not _prefixed(v):
                continue
            if not (_random(v, folder) or _prefixed(v)) or not re.search(r"\d", v) and not re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", v):
                continue
            if len(v) > 120 and _MEDIA.match(v):
                continue
            s = _read_string(text, a - 1) if not unquoted else None
            take("unnatural value", s[0] if s else [(a, b)])
    for m in _COMMENT.finditer(text):
        before, v = m.group(1), m.group(2)
        context = "remark" if _SAYS.search(before) else "label" if _PLACE.match(before) else None
        if context is None or not free(*m.span(2)) or not _secret_word(v) or placeholder(v, folder):
            continue
        if unnatural(v, folder, context):
            take("remark", [m.span(2)])
    found.sort(key=lambda x: x[1][0])
    return found


_IDENT = re.compile(r"[A-Za-z_][A-Za-z_.-]*\Z")


def _is_identifier(v: str) -> bool:
    return _IDENT.match(v) is not None


def _prefixed(v: str) -> bool:
    """A short lower-case issuer prefix, a separator and a random tail, or the fixed form of common key ids."""
    m = re.match(r"(?:[a-z]{2,8}(?:_[a-z]{2,6})?[_-]|[a-z]{2,6}\.v\d\.)([A-Za-z0-9_-]{16,})\Z|(A[A-Z]{1,3}[A-Z0-9]{16,18})\Z|(eyJ[\w-]+\.[\w-]+\.[\w-]*)\Z", v)
    if not m:
        return False
    tail = m.group(1)
    return tail is None or bool(re.search(r"\d", tail) and re.search(r"[A-Z]", tail) and re.search(r"[a-z]", tail) or re.fullmatch(r"[0-9a-f]{20,}", tail))


def _secret_word(v: str) -> bool:
    """Letters with digits or signs between them, but no path, address, number with a unit, version, id or digest."""
    if not re.search(r"[^\W\d_]", v) or not re.search(r"[\d!#%*@$&^+~]", v):
        return False
    if "://" in v or v.count("/") > 1 and not re.search(r"[+=]", v) or re.fullmatch(r"v?\d+(?:[.-]\w+)*|[\w-]+\.\w{1,4}(?::\d+)?|[\w.+-]+@[\w-]+\.[\w.]+|#?\d+|[A-Za-z]+-\d{1,4}", v):
        return False
    return not (_IDENTITY.match(v) or _HEX.match(v) or _DIGEST.match(v) or _HOST.match(v))


def lines_of(text: str, found: list[tuple[str, list[tuple[int, int]]]]) -> list[int]:
    """Line, from 1 and ended by "\\n", on which each credential begins."""
    out, at, line = [], 0, 1
    for _, parts in found:
        a = parts[0][0]
        line += text.count("\n", at, a)
        at = a
        out.append(line)
    return out


def redact(text: str, found: list[tuple[str, list[tuple[int, int]]]]) -> str:
    """The text with each secret character replaced by ``*``; the same length, other characters untouched."""
    out, at = [], 0
    spans = sorted(p for kind, parts in found for p in (parts[1:] if kind == "private key" else parts))
    for a, b in spans:
        if b <= at:
            continue
        a = max(a, at)
        out.append(text[at:a])
        out.append("".join(c if c in "\r\n\\" else "*" for c in text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out)
