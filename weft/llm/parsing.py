"""Syntax check of nine languages: recursive-descent statements, precedence-climbing expressions, panic-mode recovery.

The parsers read class strings (see ``lexing``). A simple statement or header is parsed once per process for each shape
and remembered by its class string, so the work per file follows its number of distinct shapes, not its length.
An error is (index into the class string, message); after one, the parser skips to the next statement border and goes on.
"""

from __future__ import annotations

import re

from .lexing import CONTEXTUAL, KEYWORD, kw, kws


class Fail(Exception):
    """A syntax error at a token."""


#: Class -> binding power of a binary operator; all but assignment climb to the right operand with one more.
BASE_POWER = {"=": 1, "A": 1, "o": 4, "n": 5, "|": 6, "^": 7, "&": 8, "q": 9, "<": 10, ">": 10, "r": 10, "s": 11, "+": 12, "*": 13, "/": 13, "w": 14}
CLOSE = {"(": ")", "[": "]", "{": "}"}
MEMO_BOUND = 200_000
_PAIR = re.compile(r"[()\[\]{}]")


class Parser:
    """What the languages with braces share. A language sets its words, powers, statements and primaries."""

    lang = ""
    prefix = "!+*&~i"
    postfix = "i"
    power = BASE_POWER
    wordops = ""
    ternary = True
    newlines = False
    STATEMENT = ""
    memo: dict[tuple[str, str], bool] = {}

    def __init__(self, s: str, keep: bool = True):
        self.breaks: set[int] = set()
        if self.newlines and "\n" in s:
            s = self.layout(s)
        self.s, self.i, self.keep = s + "\0\0\0", 0, keep
        self.errors: list[tuple[int, str]] = []
        self.depth = 0
        self.names = "IU" + kws(CONTEXTUAL[self.lang])

    def layout(self, s: str) -> str:
        parts, at = s.split("\n"), 0
        for p in parts:
            at += len(p)
            self.breaks.add(at)
        return "".join(parts)

    # -- small steps
    def fail(self, what: str = "unexpected token"):
        raise Fail(self.i, what)

    def at(self, cs: str) -> bool:
        return self.s[self.i] in cs

    def eat(self, c: str) -> bool:
        if self.s[self.i] == c:
            self.i += 1
            return True
        return False

    def need(self, c: str, what: str | None = None) -> None:
        if self.s[self.i] != c:
            self.fail(what or f"expected {c if c < KEYWORD else 'keyword'}")
        self.i += 1

    def name(self) -> None:
        if self.s[self.i] not in self.names:
            self.fail("expected a name")
        self.i += 1

    def attempt(self, f, *a) -> bool:
        at = self.i
        try:
            f(*a)
            return True
        except Fail:
            self.i = at
            return False

    def close_of(self, i: int) -> int:
        """Index of the bracket that closes the one at i, or -1."""
        stack = []
        for m in _PAIR.finditer(self.s, i):
            c = m.group()
            if c in "([{":
                stack.append(CLOSE[c])
            elif not stack or stack.pop() != c:
                return -1
            elif not stack:
                return m.start()
        return -1

    # -- program and recovery
    def program(self) -> list[tuple[int, str]]:
        try:
            while self.s[self.i] != "\0":
                self.guarded(self.top)
                if self.s[self.i] == "}":
                    self.errors.append((self.i, "unmatched }"))
                    self.i += 1
        except RecursionError:
            self.errors.append((self.i, "nested too deeply to parse"))
        return self.errors

    def guarded(self, f) -> None:
        """Runs a statement; on an error notes it and panics to the next border."""
        at, depth = self.i, self.depth
        try:
            f()
        except Fail as e:
            if not self.keep:
                raise
            self.depth = depth
            where, what = e.args
            self.errors.append((where, "unexpected end of file" if self.s[where] == "\0" else "no token of the language" if self.s[where] == "X" else what))
            self.i = max(self.i, at)
            level = 0
            while (c := self.s[self.i]) != "\0":
                if c == "{":
                    level += 1
                elif c == "}":
                    if level == 0:
                        break
                    level -= 1
                    if level == 0:
                        self.i += 1
                        break
                elif c == ";" and level == 0:
                    self.i += 1
                    break
                self.i += 1
            if self.i == at:
                self.i += self.s[at] != "\0" and self.s[at] != "}"

    _simple = re.compile(r"[^;{}\0]*;")

    def remembered(self, kind: str, f) -> bool:
        """Parses a simple statement that ends with the next ';' by looking up its shape; False if it isn't one."""
        m = self._simple.match(self.s, self.i)
        if m is None or self.breaks and not self.quiet(self.i, m.end()) or kw("if") in m.group():
            return False  # an else could follow an if
        key = (kind, m.group())
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO_BOUND:
                self.memo.clear()
            p = type(self)(key[1], keep=False)
            p.newlines = False
            try:
                getattr(p, f)()
                known = p.i == len(key[1])
            except (Fail, RecursionError):
                known = False
            self.memo[key] = known
        if known:
            self.i = m.end()
        return known

    def quiet(self, a: int, b: int) -> bool:
        return not any(a < x < b for x in self.breaks) if len(self.breaks) < b - a else not any(x in self.breaks for x in range(a + 1, b))

    def top(self) -> None:
        self.statement()

    def block(self) -> None:
        self.need("{")
        while self.s[self.i] not in "}\0":
            self.guarded(self.statement)
        self.need("}", "unclosed {")

    def end(self) -> None:
        self.need(";", "expected ;")

    def parens(self) -> None:
        self.need("(")
        self.expr()
        while self.eat(","):
            self.expr()
        self.need(")", "unclosed (")

    # -- expressions
    def expr(self, least: int = 0) -> None:
        self.unary()
        s, power = self.s, self.power
        while True:
            c = s[self.i]
            p = power.get(c)
            if p is not None:
                if p < least:
                    return
                self.i += 1
                if c == ">" and s[self.i] == ">":
                    self.i += 1
                    if s[self.i] == ">":
                        self.i += 1
                    if s[self.i] == "=" or s[self.i] == "r":
                        self.i += 1
                elif c == ">" and s[self.i] == "r":
                    self.i += 1
                self.operand(c, p if p <= 1 else p + 1)
            elif c == "?" and self.ternary and least <= 3:
                self.i += 1
                self.expr(1)
                self.need(":", "expected : of ?")
                self.expr(1)
            elif c in self.wordops and least <= 10:
                self.i += 1
                self.wordop(c)
            else:
                return

    def operand(self, op: str, p: int) -> None:
        self.expr(p)

    def wordop(self, c: str) -> None:
        self.expr(11)

    def unary(self) -> None:
        while self.s[self.i] in self.prefix:
            self.i += 1
        self.primary()
        self.post()

    def post(self) -> None:
        s = self.s
        while True:
            c = s[self.i]
            if c == "(":
                self.i += 1
                self.args(")")
            elif c == "[":
                self.i += 1
                self.args("]")
            elif c in ".m":
                self.i += 1
                self.member()
            elif c in self.postfix:
                self.i += 1
            elif not self.more(c):
                return

    def more(self, c: str) -> bool:
        return False

    def member(self) -> None:
        if self.s[self.i] not in self.names and self.s[self.i] < KEYWORD:
            self.fail("expected a member")
        self.i += 1

    def args(self, close: str) -> None:
        """Expressions up to a closing bracket; a comma may end them."""
        while not self.eat(close):
            self.arg()
            if not self.eat(","):
                self.need(close, f"expected {close}")
                return

    def arg(self) -> None:
        self.expr(1)

    def primary(self) -> None:
        if self.s[self.i] in "INSR" or self.s[self.i] in self.names:
            self.i += 1
        elif self.s[self.i] == "(":
            self.parens()
        else:
            self.fail("expected an expression")

    # -- what most languages have
    def angle(self) -> None:
        """Type arguments <...>."""
        self.need("<")
        while True:
            if self.eat(">"):
                return
            self.type()
            if not self.eat(","):
                break
        self.need(">", "expected >")

    def type(self) -> None:
        self.name()

    def if_statement(self) -> None:
        self.i += 1
        self.parens()
        self.statement()
        if self.eat(kw("else")):
            self.statement()

    def switch_body(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.eat(kw("default")):
                pass
            elif self.eat(kw("case")):
                self.case_label()
            elif self.at("\0"):
                self.fail("unclosed {")
            else:
                self.fail("expected case")
            if not self.eat("f") and not self.eat("m"):
                self.need(":", "expected :")
            while self.s[self.i] not in "}\0" and not self.at(kws("case default")):
                self.guarded(self.statement)

    def case_label(self) -> None:
        self.expr(2)
        while self.eat(","):
            self.expr(2)

    def do_statement(self) -> None:
        self.i += 1
        self.statement()
        self.need(kw("while"), "expected while")
        self.parens()
        self.end()


K = kw


class JavaScript(Parser):
    lang = "javascript"
    newlines = True
    prefix = "!+~i" + kws("typeof void delete await")
    power = BASE_POWER
    wordops = kws("instanceof in")
    ts = False
    nocolon = False

    def end(self) -> None:
        if self.eat(";") or self.at("}\0") or self.i in self.breaks:
            return
        self.fail("expected ;")

    def statement(self) -> None:
        c = self.s[self.i]
        if c in "I;" + kws("const let var return") + K("throw") and self.remembered(self.lang, "plain"):
            return
        self.plain()

    def plain(self) -> None:
        s, c = self.s, self.s[self.i]
        if c == "{":
            self.block()
        elif c == ";":
            self.i += 1
        elif c in kws("const let var"):
            if c == K("const") and s[self.i + 1] == K("enum") and self.ts:
                self.i += 1
                return self.statement()
            self.variables()
            self.end()
        elif c == K("function") or c == K("async") and s[self.i + 1] == K("function") and self.i + 1 not in self.breaks:
            self.function()
        elif c in K("class") + "@":
            self.classdef()
        elif c == K("if"):
            self.if_statement()
        elif c == K("for"):
            self.i += 1
            self.eat(K("await"))
            self.need("(")
            if self.at(kws("const let var")):
                self.i += 1
                self.binding()
                if not self.at(kws("of in")):
                    self.binding_rest()
                    while self.eat(","):
                        self.binding()
                        self.binding_rest()
            elif not self.at(";"):
                self.expr()
                while self.eat(","):
                    self.expr()
            if self.at(kws("of in")):
                self.i += 1
                self.expr()
            elif self.s[self.i] != ")":
                self.need(";", "expected ; in for")
                if not self.at(";"):
                    self.sequence()
                self.need(";", "expected ; in for")
                if not self.at(")"):
                    self.sequence()
            self.need(")", "expected )")
            self.statement()
        elif c == K("while") or c == K("with"):
            self.i += 1
            self.parens()
            self.statement()
        elif c == K("do"):
            self.i += 1
            self.statement()
            self.need(K("while"), "expected while")
            self.parens()
            self.eat(";")
        elif c == K("return"):
            self.i += 1
            if not (self.at(";}\0") or self.i in self.breaks):
                self.sequence()
            self.end()
        elif c == K("throw"):
            self.i += 1
            self.sequence()
            self.end()
        elif c in kws("break continue"):
            self.i += 1
            if self.s[self.i] in self.names and self.i not in self.breaks:
                self.i += 1
            self.end()
        elif c == K("debugger"):
            self.i += 1
            self.end()
        elif c == K("switch"):
            self.i += 1
            self.parens()
            self.switch_body()
        elif c == K("try"):
            self.i += 1
            self.block()
            if self.eat(K("catch")):
                if self.eat("("):
                    self.binding()
                    self.need(")")
                self.block()
                if self.eat(K("finally")):
                    self.block()
            else:
                self.need(K("finally"), "expected catch")
                self.block()
        elif c == K("import") and s[self.i + 1] not in "(.":
            self.imports()
        elif c == K("export"):
            self.exports()
        elif s[self.i + 1] == ":" and c in self.names:
            self.i += 2
            self.statement()
        elif self.ts and self.ts_statement(c):
            pass
        else:
            self.sequence()
            self.end()

    def ts_statement(self, c: str) -> bool:
        return False

    def case_label(self) -> None:
        self.expr(1)

    def sequence(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def imports(self) -> None:
        self.i += 1
        if self.ts:
            if self.s[self.i] == K("type") and self.s[self.i + 1] not in K("from") + ",":
                self.i += 1
        if not self.eat("S"):
            if self.s[self.i] in self.names:
                self.i += 1
                if self.ts and self.eat("="):
                    self.expr()
                    return self.end()
                if not self.eat(",") and not self.at(K("from")):
                    self.fail("expected from")
            if self.eat("*"):
                self.need(K("as"), "expected as")
                self.name()
            elif self.at("{"):
                self.specifiers()
            self.need(K("from"), "expected from")
            self.need("S", "expected a module name")
        if self.at(K("with")):
            self.i += 1
            self.primary()
        self.end()

    def specifiers(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.s[self.i] == K("type") and self.s[self.i + 1] not in ",}" + K("as"):
                self.i += 1
            self.key_word()
            if self.eat(K("as")):
                self.key_word()
            if not self.eat(","):
                self.need("}")
                return

    def key_word(self) -> None:
        if self.s[self.i] in "IS" or self.s[self.i] >= KEYWORD:
            self.i += 1
        else:
            self.fail("expected a name")

    def exports(self) -> None:
        self.i += 1
        if self.eat(K("default")):
            if self.at(kws("function class async") + "@") or self.ts and self.at(kws("abstract interface")):
                if self.at(K("async")) and self.s[self.i + 1] != K("function"):
                    self.expr()
                    return self.end()
                if self.ts and self.at(kws("abstract interface")):
                    self.ts_statement(self.s[self.i])
                elif self.at(K("function") + K("async")):
                    self.function(False)
                else:
                    self.classdef()
            else:
                self.expr()
                self.end()
        elif self.eat("*"):
            if self.eat(K("as")):
                self.key_word()
            self.need(K("from"), "expected from")
            self.need("S")
            self.end()
        elif self.at("{") or self.ts and self.at(K("type")) and self.s[self.i + 1] == "{":
            self.eat(K("type")) if self.ts else None
            self.specifiers()
            if self.eat(K("from")):
                self.need("S")
            self.end()
        elif self.ts and self.eat("="):
            self.expr()
            self.end()
        elif self.at(kws("const let var function async class") + "@") or self.ts and self.at(kws("interface type enum namespace module declare abstract import")):
            self.statement()
        else:
            self.fail("nothing to export")

    def variables(self) -> None:
        self.i += 1
        while True:
            self.binding()
            self.binding_rest()
            if not self.eat(","):
                return

    def binding_rest(self) -> None:
        if self.eat("="):
            self.expr(1)

    def binding(self) -> None:
        if self.s[self.i] in self.names:
            self.i += 1
        elif self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("e")
                self.binding()
                if self.eat("="):
                    self.expr(1)
                if not self.at("]"):
                    self.need(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("e"):
                    self.binding()
                else:
                    if self.eat("["):
                        self.expr()
                        self.need("]")
                    elif self.at("N"):
                        self.i += 1
                    else:
                        self.key_word()
                    if self.eat(":"):
                        self.binding()
                    if self.eat("="):
                        self.expr(1)
                if not self.at("}"):
                    self.need(",")
        else:
            self.fail("expected a name")
        if self.ts:
            self.annotation()

    def annotation(self) -> None:
        pass

    def function(self, named: bool = True) -> None:
        self.eat(K("async"))
        self.need(K("function"))
        self.eat("*")
        if self.s[self.i] in self.names:
            self.i += 1
        elif named:
            self.fail("expected a name")
        self.signature()
        self.body()

    def body(self) -> None:
        self.block()

    def signature(self) -> None:
        self.need("(", "expected parameters")
        while not self.eat(")"):
            while self.at("@"):
                self.decorator()
            self.eat("e")
            self.modifiers()
            self.binding()
            if self.eat("="):
                self.expr(1)
            if not self.eat(","):
                self.need(")", "unclosed parameters")
                break

    def modifiers(self) -> None:
        pass

    def decorator(self) -> None:
        self.need("@")
        self.unary()

    def classdef(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.ts:
            self.eat(K("export"))
            self.eat(K("default"))
            self.eat(K("abstract"))
        self.need(K("class"), "expected class")
        if self.s[self.i] in self.names and not (self.ts and self.at(K("implements"))):
            self.i += 1
        self.heritage()
        self.need("{", "expected a class body")
        while not self.eat("}"):
            if self.at("\0"):
                self.fail("unclosed {")
            self.guarded(self.class_member)

    def heritage(self) -> None:
        if self.eat(K("extends")):
            self.unary()

    def class_member(self) -> None:
        if self.eat(";"):
            return
        while self.at("@"):
            self.decorator()
        nxt = lambda: self.s[self.i + 1] not in "(=;}:?!<"
        mods = kws("static async get set") + self.member_words()
        while self.s[self.i] in mods and nxt() and self.i + 1 not in (self.breaks if self.at(kws("get set static")) else ()):
            self.i += 1
        if self.at("{"):
            return self.block()
        self.eat("*")
        self.property_name()
        self.member_rest()

    def member_words(self) -> str:
        return K("accessor") if self.ts else ""

    def property_name(self) -> None:
        if self.s[self.i] in "ISN" or self.s[self.i] >= KEYWORD:
            self.i += 1
        elif self.eat("["):
            self.expr(1)
            self.need("]")
        else:
            self.fail("expected a member")

    def member_rest(self) -> None:
        if self.at("("):
            self.signature()
            self.block()
        else:
            if self.eat("="):
                self.expr(1)
            self.end()

    def primary(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in "NSR" or c in kws("this super null true false"):
            self.i += 1
        elif c == K("async") and (s[self.i + 1] in K("function") or s[self.i + 1] in self.names and s[self.i + 2] == "f" or s[self.i + 1] == "(" and self.is_arrow(self.i + 1)):
            if s[self.i + 1] == K("function"):
                return self.function(False)
            self.i += 1
            self.primary()
        elif c in self.names:
            self.i += 1
            if self.eat("f"):
                self.arrow_body()
        elif c == "(":
            if self.is_arrow(self.i):
                self.signature()
                self.arrow_return()
                self.need("f")
                self.arrow_body()
            else:
                self.parens()
        elif c == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("e")
                self.expr(1)
                if not self.at("]"):
                    self.need(",", "expected ,")
        elif c == "{":
            self.object()
        elif c == K("function"):
            self.function(False)
        elif c in K("class") + "@":
            self.classdef()
        elif c == K("new"):
            self.i += 1
            if self.eat("."):
                return self.member()
            self.primary()
            while self.at(".["):
                if self.eat("."):
                    self.member()
                else:
                    self.i += 1
                    self.args("]")
            self.type_args()
        elif c == K("import"):
            self.i += 1
            if self.eat("."):
                self.member()
        elif c == K("yield"):
            self.i += 1
            self.eat("*")
            if not self.at(")]};,:\0") and self.i not in self.breaks:
                self.expr(1)
        else:
            self.fail("expected an expression")

    def type_args(self) -> None:
        pass

    def arrow_return(self) -> None:
        pass

    def arrow_body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.expr(1)

    def is_arrow(self, i: int) -> bool:
        j = self.close_of(i)
        return j > 0 and self.s[j + 1] == "f"

    def object(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.eat("e"):
                self.expr(1)
            else:
                nxt = self.s[self.i + 1]
                while self.s[self.i] in kws("get set async") and nxt not in ",:(}=":
                    self.i += 1
                    nxt = self.s[self.i + 1]
                star = self.eat("*")
                plain = self.s[self.i] in self.names
                self.property_name()
                if self.at("(") or self.ts and self.at("<"):
                    self.type_params()
                    self.signature()
                    self.arrow_return()
                    self.block()
                elif self.eat(":"):
                    self.expr(1)
                elif not plain or star:
                    self.fail("expected :")
                elif self.eat("="):
                    self.expr(1)
            if not self.at("}"):
                self.need(",", "expected ,")

    def type_params(self) -> None:
        pass

    def args(self, close: str) -> None:
        while not self.eat(close):
            self.eat("e")
            self.expr(1)
            if close == "]":
                while self.eat(","):
                    self.expr(1)
            if not self.eat(","):
                self.need(close, f"expected {close}")
                return

    def more(self, c: str) -> bool:
        if c == "S" and self.s[self.i - 1] in "I)" and self.i not in self.breaks:  # tagged template
            self.i += 1
            return True
        return False

    def post(self) -> None:
        s = self.s
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                if self.at("([") or self.ts and self.at("<"):
                    continue
                self.member()
            elif c == "(":
                self.i += 1
                self.args(")")
            elif c == "[":
                self.i += 1
                self.args("]")
            elif c == "i":
                if self.i in self.breaks:
                    return
                self.i += 1
            elif not self.more(c):
                return


class TypeScript(JavaScript):
    lang = "typescript"
    ts = True

    def wordop(self, c: str) -> None:
        if c in kws("as satisfies"):
            if self.eat(K("const")):
                return
            self.type()
        else:
            self.expr(11)

    wordops = kws("instanceof in as satisfies")
    prefix = "!+~i" + kws("typeof void delete await")

    def annotation(self) -> None:
        self.eat("?") or self.eat("!")
        if self.eat(":"):
            self.type()

    def modifiers(self) -> None:
        while self.s[self.i] in kws("public private protected readonly override") and self.s[self.i + 1] not in ",):=?":
            self.i += 1

    def signature(self) -> None:
        self.type_params()
        if self.at("(") and self.s[self.i + 1] == K("this"):
            self.i += 2
            self.annotation()
            if not self.eat(","):
                self.need(")")
                return self.arrow_return_colon()
            while not self.eat(")"):
                self.eat("e")
                self.binding()
                if self.eat("="):
                    self.expr(1)
                if not self.eat(","):
                    self.need(")")
                    break
        else:
            super().signature()
        self.arrow_return_colon()

    def arrow_return_colon(self) -> None:
        if self.eat(":"):
            self.type()

    def body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.end()

    def type_params(self) -> None:
        if self.eat("<"):
            while not self.eat(">"):
                self.eat(K("const"))
                self.eat(K("in"))
                self.name()
                if self.eat(K("extends")):
                    self.type()
                if self.eat("="):
                    self.type()
                if not self.eat(","):
                    self.need(">")
                    return

    def type(self) -> None:
        self.eat("|") or self.eat("&")
        self.type_atom()
        while self.at("|&"):
            self.i += 1
            self.type_atom()
        if self.s[self.i] == K("extends") and self.i not in self.breaks:
            self.i += 1
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def type_atom(self) -> None:
        s = self.s
        while s[self.i] in kws("keyof typeof readonly infer unique asserts") and s[self.i + 1] not in ".|&,;)>]}=:{[\0" or s[self.i] in kws("keyof readonly") and s[self.i + 1] in "([{":
            self.i += 1
        if self.eat(K("abstract")) and not self.at(K("new")):
            self.i -= 1
        c = s[self.i]
        if c == K("new"):
            self.i += 1
            self.type_params()
            super().signature()
            self.need("f")
            self.type()
        elif c == "<":
            self.type_params()
            super().signature()
            self.need("f")
            self.type()
        elif c == "(":
            j = self.close_of(self.i)
            if j > 0 and s[j + 1] == "f":
                JavaScript.signature(self)
                self.need("f")
                self.type()
            else:
                self.i += 1
                self.type()
                self.need(")")
        elif c == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("e")
                if s[self.i] in self.names and s[self.i + 1] == ":":
                    self.i += 2
                elif s[self.i] in self.names and s[self.i + 1 : self.i + 3] == "?:":
                    self.i += 3
                self.type()
                self.eat("?")
                if not self.at("]"):
                    self.need(",")
        elif c == "{":
            self.members()
        elif c in "SN" or c in kws("void null this true false"):
            self.i += 1
        elif c == "+" and s[self.i + 1] == "N":
            self.i += 2
        elif c == K("import"):
            self.i += 1
            self.parens()
            while self.eat("."):
                self.member()
            if self.at("<"):
                self.angle()
        elif c in self.names:
            self.i += 1
            while self.eat("."):
                self.member()
            if self.at("<") and self.i not in self.breaks:
                self.angle()
            if self.s[self.i] == K("is") and self.i not in self.breaks:
                self.i += 1
                self.type()
        else:
            self.fail("expected a type")
        if self.eat(K("is")):
            self.type()
        while self.at("[") and self.i not in self.breaks:
            self.i += 1
            if not self.at("]"):
                self.type()
            self.need("]")

    def members(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.eat(";") or self.eat(","):
                continue
            if self.at("+"):
                self.i += 1
            while self.s[self.i] in kws("readonly get set static") and self.s[self.i + 1] not in "(:?;,}<":
                self.i += 1
            if self.at("(<"):
                self.type_params()
                JavaScript.signature(self)
                self.arrow_return_colon()
            elif self.at(K("new")) and self.s[self.i + 1] in "(<":
                self.i += 1
                self.type_params()
                JavaScript.signature(self)
                self.arrow_return_colon()
            else:
                if self.at("[") and self.s[self.i + 1] in self.names and self.s[self.i + 2] in ":" + kws("in"):
                    self.i += 2
                    self.i += 1
                    self.type()
                    if self.eat(K("as")):
                        self.type()
                    self.need("]")
                else:
                    self.property_name()
                self.eat("+")
                self.eat("?")
                if self.at("(<"):
                    self.type_params()
                    JavaScript.signature(self)
                self.arrow_return_colon()
            if not (self.eat(";") or self.eat(",") or self.at("}") or self.i in self.breaks):
                self.fail("expected ;")

    def ts_statement(self, c: str) -> bool:
        s, nxt = self.s, self.s[self.i + 1]
        if self.i + 1 in self.breaks and c not in K("enum"):
            return False
        if c == K("interface") and nxt in self.names:
            self.i += 2
            self.type_params()
            if self.eat(K("extends")):
                self.type_atom()
                while self.eat(","):
                    self.type_atom()
            self.members()
        elif c == K("type") and nxt in self.names:
            self.i += 2
            self.type_params()
            self.need("=")
            self.type()
            self.end()
        elif c == K("enum") and nxt in self.names:
            self.i += 2
            self.need("{")
            while not self.eat("}"):
                self.property_name()
                if self.eat("="):
                    self.expr(1)
                if not self.at("}"):
                    self.need(",")
        elif c in kws("namespace module global") and (nxt in self.names or nxt in "S{"):
            self.i += 1
            if not self.eat("S") and not self.at("{"):
                self.name()
                while self.eat("."):
                    self.name()
            if self.at("{"):
                self.block()
            else:
                self.end()
        elif c == K("declare") and (nxt >= KEYWORD):
            self.i += 1
            self.statement()
        elif c == K("abstract") and nxt == K("class"):
            self.classdef()
        else:
            return False
        return True

    def heritage(self) -> None:
        self.type_params()
        if self.eat(K("extends")):
            self.unary()
            if self.at("<"):
                self.angle()
        if self.eat(K("implements")):
            self.type_atom()
            while self.eat(","):
                self.type_atom()

    def member_words(self) -> str:
        return kws("public private protected readonly abstract declare override accessor")

    def member_rest(self) -> None:
        self.eat("?") or self.eat("!")
        if self.at("(<"):
            self.signature()
            self.body()
        else:
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr(1)
            self.end()

    def property_name(self) -> None:
        if self.at("[") and self.s[self.i + 1] in self.names and self.s[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
        else:
            super().property_name()

    def is_arrow(self, i: int) -> bool:
        j = self.close_of(i)
        if j < 0:
            return False
        if self.s[j + 1] == "f":
            return True
        if self.s[j + 1] != ":":
            return False
        at, ok = self.i, False
        try:
            self.i = i
            JavaScript.signature(self)
            if self.eat(":"):
                self.type()
                ok = self.at("f")
        except Fail:
            pass
        self.i = at
        return ok

    def arrow_return(self) -> None:
        self.arrow_return_colon()

    def type_args(self) -> None:
        if self.at("<"):
            self.attempt(self.angle)

    def primary(self) -> None:
        if self.at("<"):
            if not self.attempt(self.generic_arrow):
                self.fail("expected an expression")
            return
        super().primary()

    def generic_arrow(self) -> None:
        self.type_params()
        self.signature()
        self.need("f")
        self.arrow_body()

    def more(self, c: str) -> bool:
        if c == "!" and self.i not in self.breaks:
            self.i += 1
            return True
        if c == "<":
            at = self.i
            if self.attempt(self.angle) and self.at("(S"):
                return True
            self.i = at
        return super().more(c)


class Typed(Parser):
    """Java and C#: modifiers, types before names, casts, declarations told from expressions by trying a type."""

    prims = ""
    mods = ""

    def primitive(self) -> bool:
        return self.s[self.i] in self.prims

    def cast(self) -> None:
        """A parenthesised expression or a cast."""
        at = self.i
        try:
            self.parens()
        except Fail as e:
            self.i = at + 1
            try:
                self.type()
                while self.eat("&"):
                    self.type()
                self.need(")")
            except Fail:
                raise e from None
            return self.unary()
        if self.s[self.i] in "INS(!~" or self.s[self.i] in kws("new this"):
            self.unary()

    def array_init(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.array_init() if self.at("{") else self.expr(1)
            if not self.eat(","):
                self.need("}", "unclosed {")
                return

    def declarators(self) -> None:
        while True:
            self.name()
            while self.at("[") and self.s[self.i + 1] == "]":
                self.i += 2
            if self.eat("="):
                self.array_init() if self.at("{") else self.expr(1)
            if not self.eat(","):
                return

    def declaration(self) -> bool:
        """A local declaration 'type name', if there is one here."""
        at = self.i
        if not self.attempt(self.type) or self.s[self.i] not in self.names or self.s[self.i + 1] not in "=;,:[)" + K("in"):
            self.i = at
            return False
        return True

    def chain(self) -> None:
        """Expression statement."""
        self.expr()
        self.end()


class Java(Typed):
    lang = "java"
    prims = kws("int long short byte char float double boolean void var")
    mods = kws("public private protected static final abstract synchronized native transient volatile strictfp default sealed non")
    wordops = K("instanceof")

    def wordop(self, c: str) -> None:
        self.eat(K("final"))
        self.type()
        if self.at("("):
            self.parens()
        elif self.s[self.i] in self.names:
            self.i += 1

    def type(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.s[self.i] in self.prims:
            self.i += 1
        elif self.eat("?"):
            if self.at(kws("extends super")):
                self.i += 1
                self.type()
        else:
            self.name()
            if self.at("<"):
                self.angle()
            while self.at(".") and self.s[self.i + 1] in self.names:
                self.i += 2
                if self.at("<"):
                    self.angle()
        while self.at("[") and self.s[self.i + 1] == "]":
            self.i += 2
        self.eat("e")

    def annotation(self) -> None:
        self.need("@")
        self.name()
        while self.at(".") and self.s[self.i + 1] in self.names:
            self.i += 2
        if self.eat("("):
            while not self.eat(")"):
                self.array_init() if self.at("{") else self.annotation_value()
                if not self.at(")"):
                    self.need(",")

    def annotation_value(self) -> None:
        if self.s[self.i] in self.names and self.s[self.i + 1] == "=":
            self.i += 2
        if self.at("{"):
            self.array_init()
        else:
            self.expr(1)

    def qualified(self) -> None:
        self.name()
        while self.eat("."):
            if self.eat("*"):
                return
            self.name()

    def top(self) -> None:
        while self.at("@") and self.s[self.i + 1] != K("interface"):
            self.annotation()
        if self.eat(";"):
            return
        if self.eat(K("package")):
            self.qualified()
            self.end()
        elif self.eat(K("import")):
            self.eat(K("static"))
            self.qualified()
            self.end()
        else:
            self.modifiers()
            if not self.typedef():
                self.fail("expected a type declaration")

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.s[self.i + 1] != K("interface"):
                self.annotation()
            elif self.s[self.i] in self.mods and not (self.at(K("non")) and self.s[self.i + 1] != "+"):
                if self.eat(K("non")):
                    self.i += 1
                self.i += 1
            else:
                return

    def typedef(self) -> bool:
        c = self.s[self.i]
        if c in kws("class interface enum") or c == "@" and self.s[self.i + 1] == K("interface") or c == K("record") and self.s[self.i + 1] in self.names and self.s[self.i + 2] in "(<":
            self.i += 1 + (c == "@")
            self.name()
            if self.at("<"):
                self.type_params()
            if c == K("record"):
                self.params()
            while self.at(kws("extends implements permits")):
                self.i += 1
                self.type()
                while self.eat(","):
                    self.type()
            self.need("{", "expected a body")
            if c == K("enum"):
                while self.s[self.i] in self.names or self.at("@"):
                    while self.at("@"):
                        self.annotation()
                    self.name()
                    if self.eat("("):
                        self.args(")")
                    if self.at("{"):
                        self.i += 1
                        self.class_body()
                    if not self.eat(","):
                        break
                if not self.at("}"):
                    self.need(";")
            self.class_body()
            return True
        return False

    def type_params(self) -> None:
        self.need("<")
        while True:
            self.name()
            if self.eat(K("extends")):
                self.type()
                while self.eat("&"):
                    self.type()
            if not self.eat(","):
                break
        self.need(">")

    def class_body(self) -> None:
        while not self.eat("}"):
            if self.at("\0"):
                self.fail("unclosed {")
            self.guarded(self.class_member)

    def class_member(self) -> None:
        if self.remembered("java member", "plain_member"):
            return
        self.plain_member()

    def plain_member(self) -> None:
        if self.eat(";"):
            return
        self.modifiers()
        if self.at("{"):
            return self.block()
        if self.typedef():
            return
        if self.at("<"):
            self.type_params()
        if self.s[self.i] in self.names and self.s[self.i + 1] in "({":
            self.i += 1
        else:
            self.type()
            if self.s[self.i + 1] != "(":
                self.declarators()
                return self.end()
            self.name()
        if self.at("("):
            self.params()
        while self.at("[") and self.s[self.i + 1] == "]":
            self.i += 2
        if self.eat(K("throws")):
            self.type()
            while self.eat(","):
                self.type()
        if self.eat(K("default")):
            self.annotation_value()
        if self.at("{"):
            self.block()
        else:
            self.end()

    def params(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.modifiers()
            self.type()
            if self.eat(K("this")):
                pass
            else:
                self.name()
            while self.at("[") and self.s[self.i + 1] == "]":
                self.i += 2
            if not self.eat(","):
                self.need(")", "unclosed parameters")
                return

    def statement(self) -> None:
        if self.s[self.i] not in "{}" and self.remembered("java", "plain"):
            return
        self.plain()

    def plain(self) -> None:
        s, c = self.s, self.s[self.i]
        if c == "{":
            self.block()
        elif c == ";":
            self.i += 1
        elif c == K("if"):
            self.if_statement()
        elif c == K("for"):
            self.i += 1
            self.need("(")
            if not self.at(";"):
                self.modifiers()
                if self.declaration():
                    if s[self.i + 1] == ":":
                        self.i += 2
                        self.expr()
                        self.need(")")
                        return self.statement()
                    self.declarators()
                else:
                    self.expr()
                    while self.eat(","):
                        self.expr()
            self.need(";", "expected ; in for")
            if not self.at(";"):
                self.expr()
            self.need(";", "expected ; in for")
            if not self.at(")"):
                self.expr()
                while self.eat(","):
                    self.expr()
            self.need(")", "expected )")
            self.statement()
        elif c == K("while"):
            self.i += 1
            self.parens()
            self.statement()
        elif c == K("do"):
            self.do_statement()
        elif c in kws("return throw") or c == K("yield") and s[self.i + 1] not in "=.(":
            self.i += 1
            if not (c == K("return") and self.at(";")):
                self.expr()
            self.end()
        elif c in kws("break continue"):
            self.i += 1
            if self.s[self.i] in self.names:
                self.i += 1
            self.end()
        elif c == K("switch"):
            self.i += 1
            self.parens()
            self.switch_body()
        elif c == K("try"):
            self.i += 1
            resources = self.eat("(")
            while resources and not self.eat(")"):
                self.modifiers()
                if self.declaration():
                    self.name()
                    self.need("=")
                self.expr()
                if not self.eat(";"):
                    self.need(")")
                    break
            self.block()
            caught = False
            while self.eat(K("catch")):
                caught = True
                self.need("(")
                self.modifiers()
                self.type()
                while self.eat("|"):
                    self.type()
                self.name()
                self.need(")")
                self.block()
            if self.eat(K("finally")):
                self.block()
            elif not caught and not resources:
                self.fail("expected catch")
        elif c == K("synchronized") and s[self.i + 1] == "(":
            self.i += 1
            self.parens()
            self.block()
        elif c == K("assert"):
            self.i += 1
            self.expr()
            if self.eat(":"):
                self.expr()
            self.end()
        elif c in self.names and s[self.i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            at = self.i
            self.modifiers()
            if self.typedef():
                return
            if self.declaration():
                self.declarators()
                self.end()
            elif self.i > at:
                self.fail("expected a declaration")
            else:
                self.chain()

    def case_label(self) -> None:
        while True:
            if self.at(kws("default null")):
                self.i += 1
            elif not self.attempt(self.pattern):
                self.expr(3) if self.s[self.i + 1] != "m" else self.primary_only()
            if not self.eat(","):
                return

    def primary_only(self) -> None:
        self.i += 1

    def pattern(self) -> None:
        self.type()
        if self.at("("):
            self.parens()
        else:
            self.name()

    def primary(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in "NS" or c in kws("this super null true false"):
            self.i += 1
            if self.eat("c"):
                self.method_name()
        elif c in self.names:
            self.i += 1
            if self.eat("m"):
                return self.lambda_body()
            if self.at("<"):
                at = self.i
                if not (self.attempt(self.angle) and self.at("c")):
                    self.i = at
            while self.at("[") and s[self.i + 1] == "]":
                self.i += 2
            if self.eat("c"):
                self.method_name()
        elif c in self.prims:
            self.type()
            if self.eat("c"):
                return self.method_name()
            self.need(".")
            self.need(K("class"))
        elif c == "(":
            j = self.close_of(self.i)
            if j > 0 and s[j + 1] == "m":
                if not self.attempt(self.params):
                    self.i += 1
                    while not self.eat(")"):
                        self.name()
                        if not self.at(")"):
                            self.need(",")
                self.need("m")
                self.lambda_body()
            else:
                self.cast()
        elif c == K("new"):
            self.i += 1
            while self.at("@"):
                self.annotation()
            if s[self.i] in self.prims:
                self.i += 1
            else:
                self.name()
                while True:
                    if self.at("<"):
                        self.angle()
                    if not (self.at(".") and s[self.i + 1] in self.names):
                        break
                    self.i += 2
            if self.at("["):
                while self.eat("["):
                    if not self.at("]"):
                        self.expr()
                    self.need("]")
                if self.at("{"):
                    self.array_init()
            else:
                self.need("(", "expected arguments")
                self.args(")")
                if self.eat("{"):
                    self.class_body()
        elif c == K("switch"):
            self.i += 1
            self.parens()
            self.switch_body()
        else:
            self.fail("expected an expression")

    def method_name(self) -> None:
        if not self.eat(K("new")):
            self.name()

    def lambda_body(self) -> None:
        self.block() if self.at("{") else self.expr(1)

    def post(self) -> None:
        s = self.s
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                if self.at("<"):
                    self.angle()
                if self.at(K("new")):
                    self.primary()
                else:
                    self.member()
            elif c == "(":
                self.i += 1
                self.args(")")
            elif c == "[":
                self.i += 1
                self.expr()
                self.need("]")
            elif c == "i":
                self.i += 1
            elif c == "c":
                self.i += 1
                self.method_name()
            else:
                return


class CSharp(Typed):
    lang = "csharp"
    prims = kws("int long short byte char float double bool string object decimal uint ulong ushort sbyte void var")
    mods = kws("public private protected internal static readonly const abstract virtual override sealed extern unsafe volatile new async partial ref required fixed file event")
    prefix = "!+*&~i^" + kws("await")
    wordops = kws("is as")
    postfix = "i!"

    def wordop(self, c: str) -> None:
        if c == K("as"):
            return self.type()
        while self.eat(K("not")):
            pass
        if self.at("<>r{"):
            self.pattern()
        elif not self.attempt(self.type):
            self.expr(11)
        if self.at("{"):
            self.pattern()
        if self.s[self.i] in self.names and self.s[self.i] not in kws("and or"):
            self.i += 1
        while self.at(kws("and or")):
            self.i += 1
            self.wordop(K("is"))

    def pattern(self) -> None:
        if self.at("{("):
            j = self.close_of(self.i)
            if j < 0:
                self.fail("unclosed pattern")
            self.i = j + 1
        else:
            self.i += 1
            self.expr(11)

    def type(self) -> None:
        self.eat(K("ref"))
        self.eat(K("readonly"))
        if self.s[self.i] in self.prims:
            self.i += 1
        elif self.at("("):
            self.i += 1
            while True:
                self.type()
                if self.s[self.i] in self.names:
                    self.i += 1
                if not self.eat(","):
                    break
            self.need(")")
        else:
            self.name()
            if self.eat("c"):
                self.name()
            if self.at("<"):
                self.angle()
            while self.at(".") and self.s[self.i + 1] in self.names:
                self.i += 2
                if self.at("<"):
                    self.angle()
        self.eat("?")
        while self.at("*"):
            self.i += 1
        while self.at("[") and self.s[self.i + 1] in "],":
            self.i += 1
            while self.eat(","):
                pass
            self.need("]")
            self.eat("?")

    def angle(self) -> None:
        self.need("<")
        while self.at(",>"):
            if self.eat(">"):
                return
            self.i += 1
        while True:
            self.eat(K("in"))
            self.eat(K("out"))
            self.type()
            if not self.eat(","):
                break
        self.need(">", "expected >")

    def attributes(self) -> None:
        while self.at("["):
            j = self.close_of(self.i)
            if j < 0:
                self.fail("unclosed [")
            self.i = j + 1

    def qualified(self) -> None:
        self.name()
        if self.at("<"):
            self.angle()
        while self.eat(".") or self.eat("c"):
            self.name()
            if self.at("<"):
                self.angle()

    def top(self) -> None:
        self.attributes()
        if self.eat(";") or self.at("\0"):
            return
        if self.at(K("using")) and self.s[self.i + 1] != "(" or self.at(K("global")) and self.s[self.i + 1] == K("using"):
            self.eat(K("global"))
            self.i += 1
            self.eat(K("static"))
            self.qualified()
            if self.eat("="):
                self.type()
            return self.end()
        if self.eat(K("namespace")):
            self.qualified()
            if self.eat(";"):
                return
            self.need("{")
            while not self.eat("}"):
                if self.at("\0"):
                    self.fail("unclosed {")
                self.guarded(self.top)
            return
        at = self.i
        self.modifiers()
        if not self.typedef():
            self.i = at
            self.statement()

    def modifiers(self) -> None:
        while self.s[self.i] in self.mods and self.s[self.i + 1] not in "=;,)":
            self.i += 1

    def constraints(self) -> None:
        while self.eat(K("where")):
            self.name()
            self.need(":")
            while True:
                if self.at(kws("class struct new")):
                    self.i += 1
                    self.eat("?")
                    if self.eat("("):
                        self.need(")")
                else:
                    self.type()
                if not self.eat(","):
                    break

    def typedef(self) -> bool:
        c = self.s[self.i]
        if c in kws("class struct interface enum") or c == K("record") and (self.s[self.i + 1] in self.names or self.s[self.i + 1] in kws("class struct")):
            self.i += 1
            if c == K("record"):
                self.eat(K("class"))
                self.eat(K("struct"))
            self.name()
            if self.at("<"):
                self.angle()
            if self.at("("):
                self.params()
            if self.eat(":"):
                while True:
                    self.type()
                    if self.eat("("):
                        self.args(")")
                    if not self.eat(","):
                        break
            self.constraints()
            if self.eat(";"):
                return True
            self.need("{", "expected a body")
            if c == K("enum"):
                while not self.eat("}"):
                    self.attributes()
                    self.name()
                    if self.eat("="):
                        self.expr(1)
                    if not self.at("}"):
                        self.need(",")
            else:
                while not self.eat("}"):
                    if self.at("\0"):
                        self.fail("unclosed {")
                    self.guarded(self.class_member)
            self.eat(";")
            return True
        if c == K("delegate"):
            self.i += 1
            self.type()
            self.name()
            if self.at("<"):
                self.angle()
            self.params()
            self.constraints()
            self.end()
            return True
        return False

    def params(self, close: str = ")") -> None:
        self.i += 1
        while not self.eat(close):
            self.attributes()
            while self.at(kws("ref out in params this")):
                self.i += 1
            self.type()
            self.name()
            if self.eat("="):
                self.expr(1)
            if not self.eat(","):
                self.need(close, "unclosed parameters")
                return

    def class_member(self) -> None:
        if self.remembered("cs member", "plain_member"):
            return
        self.plain_member()

    def plain_member(self) -> None:
        self.attributes()
        if self.eat(";"):
            return
        self.modifiers()
        if self.typedef():
            return
        if self.at("~"):
            self.i += 1
        if self.at(kws("implicit explicit")):
            self.i += 1
            self.need(K("operator"))
            self.type()
        elif self.s[self.i] in self.names and self.s[self.i + 1] == "(":
            self.i += 1
        else:
            if self.at(K("var")):
                self.fail("var is no type of a field")
            self.type()
            if self.eat(K("operator")):
                while not self.at("(\0"):
                    self.i += 1
            elif self.at(K("this")):
                self.i += 1
                self.params("]")
            else:
                self.name()
                while self.eat(".") or self.at("<"):
                    if self.at("<"):
                        self.angle()
                    elif self.at(K("this")):
                        self.i += 1
                        self.params("]")
                        break
                    else:
                        self.name()
                        if self.at("<"):
                            self.angle()
        if self.at("("):
            self.params()
            if self.eat(":"):
                self.i += 1
                self.need("(")
                self.args(")")
            self.constraints()
            if self.eat("f"):
                self.expr()
                return self.end()
            return self.block() if self.at("{") else self.end()
        if self.eat("f"):
            self.expr()
            return self.end()
        if self.eat("{"):
            while not self.eat("}"):
                self.attributes()
                self.modifiers()
                if not self.at(kws("get set init add remove")):
                    self.fail("expected get or set")
                self.i += 1
                if self.eat("f"):
                    self.expr()
                    self.end()
                elif self.at("{"):
                    self.block()
                else:
                    self.end()
            if self.eat("="):
                self.expr()
                self.end()
            return
        self.i -= 1
        self.declarators()
        self.end()

    def statement(self) -> None:
        if self.s[self.i] not in "{}" and self.remembered("cs", "plain"):
            return
        self.plain()

    def plain(self) -> None:
        s, c = self.s, self.s[self.i]
        if c == "{":
            self.block()
        elif c == ";":
            self.i += 1
        elif c == K("if"):
            self.if_statement()
        elif c == K("for"):
            self.i += 1
            self.need("(")
            if not self.at(";"):
                if self.declaration():
                    self.declarators()
                else:
                    self.expr()
                    while self.eat(","):
                        self.expr()
            self.need(";", "expected ; in for")
            if not self.at(";"):
                self.expr()
            self.need(";", "expected ; in for")
            if not self.at(")"):
                self.expr()
                while self.eat(","):
                    self.expr()
            self.need(")", "expected )")
            self.statement()
        elif c == K("foreach") or c == K("await") and s[self.i + 1] == K("foreach"):
            self.eat(K("await"))
            self.i += 1
            self.need("(")
            self.type()
            if self.s[self.i] in self.names:
                self.i += 1
            self.need(K("in"), "expected in")
            self.expr()
            self.need(")")
            self.statement()
        elif c in kws("while lock fixed") or c == K("using") and s[self.i + 1] == "(":
            self.i += 1
            self.need("(")
            if self.declaration():
                self.declarators()
            else:
                self.expr()
            self.need(")")
            self.statement()
        elif c == K("using") or c == K("await") and s[self.i + 1] == K("using"):
            self.eat(K("await"))
            self.i += 1
            if not self.declaration():
                self.fail("expected a declaration")
            self.declarators()
            self.end()
        elif c in kws("checked unchecked unsafe") and s[self.i + 1] == "{":
            self.i += 1
            self.block()
        elif c == K("do"):
            self.do_statement()
        elif c in kws("return throw"):
            self.i += 1
            if not self.at(";"):
                self.expr()
            self.end()
        elif c == K("yield") and s[self.i + 1] in kws("return break"):
            self.i += 2
            if not self.at(";"):
                self.expr()
            self.end()
        elif c in kws("break continue"):
            self.i += 1
            self.end()
        elif c == K("goto"):
            self.i += 1
            self.eat(K("case"))
            if not self.eat(K("default")):
                self.expr()
            self.end()
        elif c == K("switch"):
            self.i += 1
            self.parens()
            self.switch_body()
        elif c == K("try"):
            self.i += 1
            self.block()
            caught = False
            while self.eat(K("catch")):
                caught = True
                if self.eat("("):
                    self.type()
                    if self.s[self.i] in self.names:
                        self.i += 1
                    self.need(")")
                if self.eat(K("when")):
                    self.parens()
                self.block()
            if self.eat(K("finally")):
                self.block()
            elif not caught:
                self.fail("expected catch")
        elif c in self.names and s[self.i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            at = self.i
            self.attributes()
            self.modifiers()
            if self.declaration():
                self.declarators()
                return self.end()
            if self.attempt(self.local_function):
                return
            self.i = at
            self.chain()

    def local_function(self) -> None:
        self.type()
        self.name()
        if self.at("<"):
            self.angle()
        if not self.at("("):
            self.fail("no function")
        self.params()
        self.constraints()
        if self.eat("f"):
            self.expr()
            self.end()
        else:
            keep, self.keep = self.keep, False
            try:
                self.block()
            finally:
                self.keep = keep

    def case_label(self) -> None:
        if not self.attempt(self.case_pattern):
            self.expr(4)
        if self.eat(K("when")):
            self.expr(2)

    def case_pattern(self) -> None:
        self.wordop(K("is"))
        if not self.at(":" + K("when")):
            self.fail("no pattern")

    def arg(self) -> None:
        if self.s[self.i] in self.names and self.s[self.i + 1] == ":":
            self.i += 2
        if self.at(kws("ref out in")):
            self.i += 1
            at = self.i
            if not (self.attempt(self.type) and self.s[self.i] in self.names and (self.eat(self.s[self.i]) or True)):
                self.i = at
                self.expr(1)
            return
        self.eat("e")
        self.expr(1)

    def primary(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in "NS" or c in kws("this base null true false"):
            self.i += 1
        elif c in self.names:
            if c == K("async") and s[self.i + 1] in self.names + "(":
                self.i += 1
                return self.primary()
            self.i += 1
            if self.eat("f"):
                return self.lambda_body()
            self.eat("c") and self.name()
            if self.at("<"):
                at = self.i
                if not (self.attempt(self.angle) and self.at("(.,);]}:")):
                    self.i = at
        elif c in self.prims:
            self.i += 1
            self.eat("?")
            while self.at("[") and s[self.i + 1] == "]":
                self.i += 2
        elif c == "(":
            j = self.close_of(self.i)
            if j > 0 and s[j + 1] == "f":
                if not self.attempt(self.params):
                    self.i += 1
                    while not self.eat(")"):
                        self.name()
                        if not self.at(")"):
                            self.need(",")
                self.need("f")
                self.lambda_body()
            else:
                self.cast()
        elif c == "[":
            self.i += 1
            self.args("]")
        elif c == K("new"):
            self.i += 1
            if self.at("{"):
                return self.init()
            if self.eat("("):
                self.args(")")
            elif self.at("["):
                while self.eat("["):
                    self.args("]")
                return self.init()
            else:
                if s[self.i] in self.prims:
                    self.i += 1
                else:
                    self.qualified()
                self.eat("?")
                if self.eat("("):
                    self.args(")")
                else:
                    while self.eat("["):
                        while self.eat(","):
                            pass
                        if not self.at("]"):
                            self.expr()
                            while self.eat(","):
                                self.expr()
                        self.need("]")
            if self.at("{"):
                self.init()
        elif c in kws("typeof sizeof default checked unchecked"):
            self.i += 1
            if self.eat("("):
                if not self.attempt(self.type) or not self.at(")"):
                    self.expr()
                self.need(")")
        elif c == K("stackalloc"):
            self.i += 1
            self.type()
        elif c == K("throw"):
            self.i += 1
            self.expr()
        elif c == K("delegate"):
            self.i += 1
            if self.at("("):
                self.params()
            self.block()
        elif c == K("from") or c == K("ref"):
            self.i += 1
            self.expr()
        else:
            self.fail("expected an expression")

    def init(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.at("["):
                self.i += 1
                self.args("]")
                self.need("=")
            if self.at("{"):
                self.init()
            else:
                self.expr()
                if self.at("{"):
                    self.init()
            if not self.eat(","):
                self.need("}", "unclosed {")
                return

    def lambda_body(self) -> None:
        self.block() if self.at("{") else self.expr(1)

    def more(self, c: str) -> bool:
        if c == "?" and self.s[self.i + 1] == "[":
            at = self.i
            self.i += 2
            try:
                self.args("]")
                if not self.at(":"):
                    return True
            except Fail:
                pass
            self.i = at
        elif c == K("switch"):
            self.i += 1
            j = self.close_of(self.i) if self.at("{") else -1
            if j < 0:
                self.fail("unclosed switch")
            self.i = j + 1
            return True
        elif c == K("with") and self.s[self.i + 1] == "{":
            self.i += 1
            self.init()
            return True
        return False

    def member(self) -> None:
        super().member()
        if self.at("<"):
            at = self.i
            if not (self.attempt(self.angle) and self.at("(.,);]}:=")):
                self.i = at

    def array_init(self) -> None:
        self.init()
