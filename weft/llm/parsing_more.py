"""Parsers of C, C++, Go, Rust and Python on the base of ``parsing``, and ``check_syntax`` for all nine languages."""

from __future__ import annotations

import re
import sys
from contextlib import contextmanager

from .lexing import KEYWORD, class_string, kw, kws, offsets
from .parsing import BASE_POWER, MEMO_BOUND, CSharp, Fail, Java, JavaScript, Parser, TypeScript

K = kw


class C(Parser):
    lang = "c"
    prims = kws("void int long short char float double signed unsigned _Bool")
    specs = kws("static const extern inline volatile register restrict typedef")
    scope = False

    def specifiers(self) -> bool:
        """Declaration specifiers with a type in them; a type name counts only where a declarator follows."""
        s, typed = self.s, False
        while True:
            c = s[self.i]
            if c in self.specs:
                self.i += 1
                if c == K("extern") and self.at("S"):
                    self.i += 1
            elif c in self.prims:
                self.i += 1
                typed = True
            elif c in kws("struct union enum") or self.scope and c in kws("class typename"):
                self.i += 1
                self.attributes()
                self.record(c)
                typed = True
            elif c == "U" and self.macro(typed):
                pass
            elif not typed and c in self.names + ("c" if self.scope else ""):
                self.type_name()
                typed = True
            else:
                return typed

    def macro(self, typed: bool) -> bool:
        """Steps over a macro among specifiers, with its arguments, if a type or declarator still follows."""
        j = self.i + 1
        if self.s[j] == "(":
            j = self.close_of(j) + 1
            if j == 0:
                return False
        nxt = self.s[j]
        if nxt in self.names + "*&c" + self.prims + self.specs + kws("struct union enum") and not (typed and nxt in "*&") and not (not typed and nxt in "*&" or not typed and nxt in self.names and self.s[j + 1] in "=;,[()"):
            self.i = j
            return True
        return False

    def attributes(self) -> None:
        while self.at("[") and self.s[self.i + 1] == "[":
            j = self.close_of(self.i)
            if j < 0:
                self.fail("unclosed [")
            self.i = j + 1

    def type_name(self) -> None:
        self.name()

    def record(self, c: str) -> None:
        if self.s[self.i] in self.names:
            self.type_name()
        elif not self.at("{"):
            self.fail("expected a name or body")
        if c == K("enum"):
            if self.eat(":"):
                self.type()
            if self.eat("{"):
                while not self.eat("}"):
                    self.name()
                    if self.eat("="):
                        self.expr(1)
                    if not self.at("}"):
                        self.need(",", "expected ,")
            return
        self.bases()
        if self.at("{"):
            self.i += 1
            while not self.eat("}"):
                if self.at("\0"):
                    self.fail("unclosed {")
                self.guarded(self.member_declaration)

    def bases(self) -> None:
        pass

    def member_declaration(self) -> None:
        if self.remembered(self.lang + " member", "plain_declaration"):
            return
        self.plain_declaration()

    def type(self) -> None:
        """A type name as in casts, sizeof and arguments."""
        if not self.specifiers():
            self.fail("expected a type")
        while self.at("*&n" + self.specs):
            self.i += 1
        while self.at("(") and self.s[self.i + 1] in "*)&":
            j = self.close_of(self.i)
            if j < 0:
                self.fail("unclosed (")
            self.i = j + 1
            if self.at("("):
                self.i += 1
                self.parameters()
        while self.eat("["):
            if not self.at("]"):
                self.expr()
            self.need("]")

    def declarator(self, abstract: bool = False) -> None:
        s = self.s
        while self.at("*&n^" + self.specs):
            self.i += 1
        self.eat("e")
        if self.at("(") and s[self.i + 1] in "*&^" + self.names + "(" and not abstract or self.at("(") and s[self.i + 1] in "*^&":
            self.i += 1
            self.declarator()
            self.need(")")
        elif s[self.i] in self.names + "c" or self.scope and self.at("~" + K("operator")):
            self.declared_name()
        elif self.at("[") and self.scope and self.binding_list():
            pass
        elif not abstract:
            self.fail("expected a declarator")
        while True:
            if self.at("("):
                at = self.i
                self.i += 1
                try:
                    self.parameters()
                except Fail as e:
                    if not self.scope:
                        raise
                    self.i = at + 1
                    try:
                        self.args(")")
                    except Fail:
                        raise e from None
                self.after_parameters()
            elif self.at("[") and self.s[self.i + 1] != "[":
                self.i += 1
                while self.at(self.specs):
                    self.i += 1
                if not self.at("]"):
                    self.expr()
                self.need("]")
            elif self.at("U"):
                self.i += 1
            else:
                break
        self.attributes()

    def binding_list(self) -> bool:
        self.i += 1
        while not self.eat("]"):
            self.name()
            if not self.at("]"):
                self.need(",")
        return True

    def declared_name(self) -> None:
        self.name()

    def after_parameters(self) -> None:
        pass

    def parameters(self) -> None:
        if self.eat(")"):
            return
        while True:
            if self.eat("e"):
                self.need(")")
                return
            self.attributes()
            if not self.specifiers():
                self.fail("expected a parameter")
            self.declarator(abstract=True)
            if self.eat("="):
                self.initial()
            if not self.eat(","):
                self.need(")", "unclosed parameters")
                return

    def initial(self) -> None:
        if self.at("{"):
            self.braces()
        else:
            self.expr(1)

    def braces(self) -> None:
        self.need("{")
        while not self.eat("}"):
            while self.at(".["):
                if self.eat("."):
                    self.name()
                else:
                    self.i += 1
                    self.expr()
                    self.need("]")
                if not self.at(".["):
                    self.need("=")
                    break
            self.initial()
            self.eat("e")
            if not self.eat(","):
                self.need("}", "unclosed {")
                return

    def top(self) -> None:
        self.declaration()

    def declaration(self) -> None:
        if self.remembered(self.lang + " decl", "plain_declaration"):
            return
        self.plain_declaration()

    def plain_declaration(self) -> None:
        if self.eat(";"):
            return
        if self.at(K("extern")) and self.s[self.i + 1 : self.i + 3] == "S{":
            self.i += 3
            while not self.eat("}"):
                if self.at("\0"):
                    self.fail("unclosed {")
                self.guarded(self.top)
            return
        self.attributes()
        start = self.i
        if not self.specifiers():
            self.fail("expected a declaration")
        if self.eat(";"):
            return
        if self.i == start + 1 and self.s[start] in "IU" and self.at("("):  # a macro on a line of its own
            j = self.close_of(self.i)
            if j > 0 and self.s[j + 1] not in ";{":
                self.i = j + 1
                return
            self.i = start
        self.declarators(True)

    def declarators(self, function: bool) -> None:
        first = True
        while True:
            self.declarator()
            if self.eat(":"):
                self.expr(2)
            if first and function and (self.at("{:") or self.at(K("try")) or self.s[self.i] in self.prims):
                return self.function_body()
            if self.eat("="):
                if self.scope and self.at("N" + kws("default delete")):
                    self.i += 1
                    if not self.at(",;"):
                        self.i -= 1
                        self.initial()
                else:
                    self.initial()
            elif self.scope and self.at("{"):
                self.braces()
            first = False
            if not self.eat(","):
                break
        self.end()

    def function_body(self) -> None:
        self.block()

    def statement(self) -> None:
        if self.s[self.i] not in "{}" and self.remembered(self.lang, "plain"):
            return
        self.plain()

    def plain(self) -> None:
        s, c = self.s, self.s[self.i]
        if c == "U" and s[self.i + 1] == "(":  # a macro call that needs no ';'
            j = self.close_of(self.i + 1)
            if j > 0 and s[j + 1] in "IU{}" + self.prims + self.specs + kws("if for while return switch do"):
                self.i = j + 1
                return
        if c == "{":
            self.block()
        elif c == ";":
            self.i += 1
        elif c == K("if"):
            self.i += 1
            self.eat(K("constexpr")) if self.scope else None
            self.condition()
            self.statement()
            if self.eat(K("else")):
                self.statement()
        elif c == K("for"):
            self.i += 1
            self.need("(")
            if not self.eat(";"):
                at = self.i
                if self.scope and self.attempt(self.range_for):
                    return self.statement()
                self.i = at
                self.simple()
            if not self.at(";"):
                self.expr()
            self.need(";", "expected ; in for")
            if not self.at(")"):
                self.sequence()
            self.need(")", "expected )")
            self.statement()
        elif c == K("while"):
            self.i += 1
            self.condition()
            self.statement()
        elif c == K("do"):
            self.do_statement()
        elif c == K("switch"):
            self.i += 1
            self.condition()
            self.statement()
        elif c == K("case"):
            self.i += 1
            self.expr(4)
            if self.eat("e"):
                self.expr(4)
            self.need(":", "expected :")
            if not self.at("}"):
                self.statement()
        elif c == K("default") and s[self.i + 1] == ":":
            self.i += 2
            if not self.at("}"):
                self.statement()
        elif c == K("return"):
            self.i += 1
            if not self.at(";"):
                self.braces() if self.at("{") else self.sequence()
            self.end()
        elif c in kws("break continue"):
            self.i += 1
            self.end()
        elif c == K("goto"):
            self.i += 1
            self.eat("*")
            self.expr()
            self.end()
        elif c in self.names and s[self.i + 1] == ":" and s[self.i + 2] != ":":
            self.i += 2
            if not self.at("}"):
                self.statement()
        elif not self.special(c):
            self.simple()

    def special(self, c: str) -> bool:
        return False

    def condition(self) -> None:
        self.parens()

    def range_for(self) -> None:
        if not self.specifiers():
            self.fail("no range")
        self.declarator()
        self.need(":")
        self.initial()
        self.need(")")

    def sequence(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def simple(self) -> None:
        """A declaration or an expression, up to its ';'."""
        at = self.i
        c = self.s[at]
        if c in self.prims + self.specs + kws("struct union enum"):
            return self.plain_declaration()
        try:
            if not self.specifiers():
                self.fail()
            if not (self.at("*&n" + self.specs) or self.s[self.i] in self.names):
                self.fail()
            self.declarators(False)
            return
        except Fail:
            self.i = at
        self.sequence()
        self.end()

    def primary(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in "N" or c in self.names:
            self.i += 1
            if c == "U" and self.at("INU"):  # a macro before an operand, such as a cast
                return self.unary()
            if c in "IU":
                while self.at("S"):  # a macro between string parts
                    self.i += 1
        elif c == "S":
            while self.at("SIU"):
                self.i += 1
        elif c == "(":
            at = self.i
            if s[at + 1] == "{":
                self.i += 1
                self.block()
                return self.need(")")
            try:
                self.parens()
                if self.at("IN(S!~") and not self.at("("):
                    self.unary()
                elif self.at("{"):
                    self.braces()
            except Fail as e:
                self.i = at + 1
                try:
                    self.type()
                    self.need(")")
                except Fail:
                    raise e from None
                if self.at("{"):
                    self.braces()
                else:
                    self.unary()
        elif c == K("sizeof"):
            self.i += 1
            self.eat("e")
            if self.at("("):
                at = self.i
                self.i += 1
                if not (self.attempt(self.type) and self.eat(")")):
                    self.i = at
                    self.unary()
            else:
                self.unary()
        else:
            self.fail("expected an expression")

    def arg(self) -> None:
        at = self.i
        try:
            self.initial()
            if self.at(",)]"):
                return
            self.fail("expected ,")
        except Fail as e:
            self.i = at
            try:
                self.type()
            except Fail:
                raise e from None


class Cpp(C):
    lang = "cpp"
    scope = True
    prims = kws("void int long short char float double signed unsigned bool auto")
    specs = kws("static const extern inline volatile register typedef virtual friend explicit constexpr consteval constinit mutable thread_local")
    prefix = "!+*&~in" + kws("co_await")
    wordops = ""

    def type_name(self) -> None:
        self.eat("c")
        self.eat(K("typename"))
        while True:
            self.name()
            if self.at("<"):
                self.template_args()
            if not (self.at("c") and (self.s[self.i + 1] in self.names or self.s[self.i + 1] == K("template"))):
                return
            self.i += 1
            self.eat(K("template"))

    def specifiers(self) -> bool:
        if self.at(K("decltype")):
            self.i += 1
            self.parens()
            return True
        if self.at(K("alignas")):
            self.i += 1
            self.parens()
        return super().specifiers()

    def template_args(self) -> None:
        at = self.i
        self.need("<")
        while not self.eat(">"):
            start = self.i
            if not (self.attempt(self.template_type) and self.at(",>e")):
                self.i = start
                self.expr(11)
            self.eat("e")
            if not self.eat(","):
                if not self.eat(">"):
                    self.i = at
                    self.fail("expected >")
                return

    def template_type(self) -> None:
        self.type()
        if self.at("("):
            self.i += 1
            self.parameters()

    def bases(self) -> None:
        self.eat(K("final"))
        if self.eat(":"):
            while True:
                while self.at(kws("public private protected virtual")):
                    self.i += 1
                self.type_name()
                self.eat("e")
                if not self.eat(","):
                    break

    def top(self) -> None:
        s, c = self.s, self.s[self.i]
        if c == K("namespace") or c == K("inline") and s[self.i + 1] == K("namespace"):
            self.eat(K("inline"))
            self.i += 1
            while self.s[self.i] in self.names or self.at("c"):
                self.i += 1
            if self.eat("="):
                self.type_name()
                return self.end()
            self.need("{")
            while not self.eat("}"):
                if self.at("\0"):
                    self.fail("unclosed {")
                self.guarded(self.top)
        else:
            self.declaration()

    def plain_declaration(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in kws("public private protected") and s[self.i + 1] == ":":
            self.i += 2
        elif c == K("template"):
            self.i += 1
            if self.at("<"):
                self.i += 1
                while not self.eat(">"):
                    if self.at(K("template")):
                        self.i += 1
                        self.template_args()
                    if self.at(kws("typename class")):
                        self.i += 1
                        self.eat("e")
                        if self.s[self.i] in self.names:
                            self.i += 1
                        if self.eat("="):
                            self.type()
                    else:
                        self.specifiers()
                        self.declarator(abstract=True)
                        if self.eat("="):
                            self.expr(11)
                    if not self.at(">"):
                        self.need(",")
            self.declaration()
        elif c == K("using"):
            self.i += 1
            self.eat(K("namespace"))
            self.eat(K("typename"))
            self.type_name()
            if self.eat("="):
                self.type()
                if self.at("("):
                    self.i += 1
                    self.parameters()
            self.end()
        elif c == K("static_assert"):
            self.i += 1
            self.parens()
            self.end()
        elif c == K("namespace"):
            self.top()
        else:
            start = self.i
            while self.at(self.specs):
                self.i += 1
            # constructors, destructors and conversion operators have no type
            if self.at("~" + K("operator")) or s[self.i] in self.names and self.special_name():
                if not self.at("~"):
                    self.skip_name()
                else:
                    self.i += 1
                    self.name()
                if self.at("("):
                    self.i += 1
                    if self.attempt(self.parameters):
                        self.after_parameters()
                        if self.at("{:") or self.at(K("try")):
                            return self.function_body()
                        if self.eat("="):
                            self.i += 1
                        if self.eat(";"):
                            return
            self.i = start
            super().plain_declaration()

    def special_name(self) -> bool:
        at = self.i
        ok = self.attempt(self.skip_name) and self.at("(")
        self.i = at
        return ok

    def skip_name(self) -> None:
        if not self.at(K("operator")):
            self.type_name()
            if self.at("c"):
                self.i += 1
                if self.at("~"):
                    self.i += 1
                    return self.name()
        if self.at(K("operator")):
            self.operator_name()

    def operator_name(self) -> None:
        self.i += 1
        if self.at("("):
            self.i += 2
        elif self.at("["):
            self.i += 2
        elif self.at(kws("new delete")):
            self.i += 1
            if self.at("["):
                self.i += 2
        elif self.at("S"):
            self.i += 2
        elif self.s[self.i] in self.names or self.s[self.i] in self.prims + self.specs:
            self.type()
        else:
            while not self.at("(\0"):
                self.i += 1

    def declared_name(self) -> None:
        if self.at("~"):
            self.i += 1
        self.skip_name()
        self.eat("e")

    def after_parameters(self) -> None:
        while True:
            if self.at(kws("const volatile override final") + "&n"):
                self.i += 1
            elif self.at(K("noexcept")):
                self.i += 1
                if self.at("("):
                    self.parens()
            elif self.at("m"):
                self.i += 1
                self.type()
            else:
                return

    def function_body(self) -> None:
        self.eat(K("try"))
        if self.eat(":"):
            while True:
                self.type_name()
                if self.eat("("):
                    self.args(")")
                else:
                    self.braces()
                self.eat("e")
                if not self.eat(","):
                    break
        self.block()
        while self.eat(K("catch")):
            self.catch()

    def catch(self) -> None:
        self.need("(")
        if self.eat("e"):
            self.need(")")
        else:
            self.parameters()
        self.block()

    def special(self, c: str) -> bool:
        if c == K("try"):
            self.i += 1
            self.block()
            if not self.at(K("catch")):
                self.fail("expected catch")
            while self.eat(K("catch")):
                self.catch()
        elif c in kws("using template static_assert namespace class"):
            self.plain_declaration()
        elif c == K("throw"):
            self.i += 1
            if not self.at(";"):
                self.expr()
            self.end()
        elif c in kws("co_return co_yield"):
            self.i += 1
            if not self.at(";"):
                self.expr()
            self.end()
        else:
            return False
        return True

    def condition(self) -> None:
        self.need("(")
        at = self.i
        if not (self.attempt(self.condition_declaration) and self.at(");")):
            self.i = at
            self.sequence()
        if self.eat(";"):
            self.sequence()
        self.need(")", "unclosed (")

    def condition_declaration(self) -> None:
        if not self.specifiers():
            self.fail()
        self.declarator()
        self.need("=")
        self.initial()

    def primary(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in self.names or c == "c":
            at = self.i
            self.eat("c")
            while True:
                if self.at(K("operator")):
                    return self.operator_name()
                if self.at("~"):
                    self.i += 1
                self.name()
                if self.at("<"):
                    lt = self.i
                    if not (self.attempt(self.template_args) and (self.at("(){},;c.:[]=?&+*|nq") or self.at("oem"))):
                        self.i = lt
                if self.at("c"):
                    self.i += 1
                    self.eat(K("template"))
                    continue
                break
            if self.i == at + 1 and c == "U" and self.at("INU"):
                return self.unary()
            if self.i == at + 1 and c in "IU":
                while self.at("S"):
                    self.i += 1
            if self.at("{"):
                self.braces()
        elif c in kws("this true false nullptr"):
            self.i += 1
        elif c in self.prims:
            self.type()
            if self.at("{"):
                self.braces()
            elif self.at("("):
                self.i += 1
                self.args(")")
        elif c in kws("static_cast dynamic_cast const_cast reinterpret_cast"):
            self.i += 1
            self.template_args()
            self.parens()
        elif c == "[":
            self.i += 1
            while not self.eat("]"):
                if self.at("&=*"):
                    self.i += 1
                if self.s[self.i] in self.names or self.at(K("this")):
                    self.i += 1
                self.eat("e")
                if self.eat("="):
                    self.expr(1)
                if not self.at("]"):
                    self.need(",")
            if self.at("<"):
                self.template_args()
            if self.eat("("):
                self.parameters()
            while self.at(kws("mutable constexpr noexcept")):
                self.i += 1
            self.after_parameters()
            self.block()
        elif c == K("new"):
            self.i += 1
            if self.at("("):
                self.parens()
            if not self.specifiers():
                self.fail("expected a type")
            while self.at("*"):
                self.i += 1
            while self.eat("["):
                self.expr()
                self.need("]")
            if self.eat("("):
                self.args(")")
            elif self.at("{"):
                self.braces()
        elif c == K("delete"):
            self.i += 1
            if self.eat("["):
                self.need("]")
            self.unary()
        elif c == K("throw"):
            self.i += 1
            if not self.at(";)"):
                self.expr()
        elif c in kws("noexcept decltype"):
            self.i += 1
            self.parens()
        elif c == K("typename"):
            self.type()
            self.braces() if self.at("{") else None
        else:
            super().primary()

    def member(self) -> None:
        self.eat(K("template"))
        if self.at("~"):
            self.i += 1
        if self.at(K("operator")):
            return self.operator_name()
        super().member()
        if self.at("<"):
            at = self.i
            if not (self.attempt(self.template_args) and self.at("(")):
                self.i = at

    def args(self, close: str) -> None:
        while not self.eat(close):
            self.arg()
            self.eat("e")
            if not self.eat(","):
                self.need(close, f"expected {close}")
                return


class Go(Parser):
    lang = "go"
    newlines = True
    ternary = False
    prefix = "!+*&^h"
    postfix = ""
    power = {"o": 4, "n": 5, "q": 6, "<": 6, ">": 6, "r": 6, "+": 7, "|": 7, "^": 7, "*": 8, "/": 8, "s": 8, "&": 8}
    _auto = re.compile(r"(?<=[INSi)\]}" + kws("break continue fallthrough return") + r"])\n")

    def layout(self, s: str) -> str:
        return self._auto.sub(";", s).replace("\n", "")

    def __init__(self, s: str, keep: bool = True):
        super().__init__(s, keep)
        self.plain_brace = True

    def end(self) -> None:
        if self.eat(";") or self.at("})\0"):
            return
        self.fail("expected end of statement")

    def top(self) -> None:
        if self.eat(";"):
            return
        c = self.s[self.i]
        if c == K("package"):
            if self.i:
                self.fail("package clause after code")
            self.i += 1
            self.name()
            self.end()
            if not self.errors:
                return
        elif self.i == 0:
            self.i += 1
            raise Fail(0, "expected package")
        elif c == K("import"):
            self.i += 1
            self.group(self.import_spec)
        elif c == K("func"):
            self.i += 1
            if self.eat("("):
                self.params()
            self.name()
            if self.at("["):
                self.type_params()
            self.signature()
            if self.at("{"):
                self.block()
            self.end()
        elif c in kws("var const type"):
            self.declaration()
        else:
            self.fail("expected a declaration")

    def import_spec(self) -> None:
        if self.s[self.i] in self.names or self.at("."):
            self.i += 1
        self.need("S", "expected an import path")

    def group(self, f) -> None:
        if self.eat("("):
            while not self.eat(")"):
                f()
                self.end()
            self.end()
        else:
            f()
            self.end()

    def declaration(self) -> None:
        c = self.s[self.i]
        self.i += 1
        self.group(self.type_spec if c == K("type") else self.var_spec)

    def var_spec(self) -> None:
        self.name()
        while self.eat(","):
            self.name()
        if not self.at("=;)"):
            self.type()
        if self.eat("="):
            self.list()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.s[self.i + 1] in self.names and self.s[self.i + 2] != "]":
            at = self.i
            if not self.attempt(self.type_params):
                self.i = at
        self.eat("=")
        self.type()

    def type_params(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.name()
            while self.eat(","):
                self.name()
            self.constraint()
            if not self.at("]"):
                self.need(",")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def list(self) -> None:
        self.expr()
        while self.eat(","):
            self.expr()

    def type(self) -> None:
        s, c = self.s, self.s[self.i]
        if c == "*":
            self.i += 1
            self.type()
        elif c == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif c == "[":
            self.i += 1
            if not self.at("]"):
                if not self.eat("e"):
                    self.expr()
            self.need("]")
            self.type()
        elif c == K("map"):
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif c == K("chan") or c == "h":
            self.i += 1
            self.eat(K("chan")) if c == "h" else self.eat("h")
            self.type()
        elif c == K("func"):
            self.i += 1
            self.signature()
        elif c == K("struct"):
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                self.end()
        elif c == K("interface"):
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if s[self.i] in self.names and s[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        elif c in self.names:
            self.i += 1
            if self.eat("."):
                self.name()
            if self.at("[") and s[self.i + 1] != "]":
                at = self.i
                self.i += 1
                if not self.attempt(self.type_list):
                    self.i = at
        else:
            self.fail("expected a type")

    def type_list(self) -> None:
        self.type()
        while self.eat(","):
            self.type()
        self.need("]")

    def field(self) -> None:
        if self.eat("*"):
            self.type()
        elif self.s[self.i + 1] in ";.S}":
            self.type()
        else:
            self.name()
            while self.eat(","):
                self.name()
            self.type()
        self.eat("S")

    def signature(self) -> None:
        self.need("(", "expected parameters")
        self.params()
        if self.eat("("):
            self.params()
        elif self.s[self.i] in "*[h" + self.names or self.at(kws("map chan func struct interface")):
            self.type()

    def params(self) -> None:
        while not self.eat(")"):
            self.eat("e")
            self.type()
            if self.eat("e") or not self.at(",)"):
                self.type()
            if not self.eat(","):
                self.need(")", "unclosed parameters")
                return

    _simple = re.compile(r"[^;{}\0]*;")

    def statement(self) -> None:
        if self.s[self.i] in self.names + K("return") and self.remembered("go", "plain"):
            return
        self.plain()

    def plain(self) -> None:
        s, c = self.s, self.s[self.i]
        if c == ";":
            self.i += 1
        elif c == "{":
            self.block()
            self.end()
        elif c in kws("var const type"):
            self.declaration()
        elif c == K("if"):
            self.if_statement()
            self.end()
        elif c == K("for"):
            self.i += 1
            self.header()
            self.block()
            self.end()
        elif c == K("switch"):
            self.i += 1
            self.header()
            self.need("{")
            self.clauses()
        elif c == K("select"):
            self.i += 1
            self.need("{")
            self.clauses()
        elif c == K("return"):
            self.i += 1
            if not self.at(";}"):
                self.list()
            self.end()
        elif c in kws("break continue goto fallthrough"):
            self.i += 1
            if self.s[self.i] in self.names:
                self.i += 1
            self.end()
        elif c in kws("go defer"):
            self.i += 1
            self.expr()
            self.end()
        elif c in self.names and s[self.i + 1] == ":":
            self.i += 2
            self.eat(";")
            if not self.at("}"):
                self.statement()
        else:
            self.simple()
            self.end()

    def clauses(self) -> None:
        while not self.eat("}"):
            if self.eat(K("default")):
                pass
            elif self.eat(K("case")):
                self.case_item()
                while self.eat(","):
                    self.case_item()
            else:
                self.fail("expected case")
            self.need(":", "expected :")
            while not self.at("}\0" + kws("case default")):
                self.guarded(self.statement)
        self.end()

    def case_item(self) -> None:
        at = self.i
        try:
            self.simple()
            if self.at(":,"):
                return
            self.fail("expected :")
        except Fail as e:
            self.i = at
            try:
                self.type()
            except Fail:
                raise e from None

    def if_statement(self) -> None:
        self.need(K("if"))
        self.header()
        self.block()
        if self.eat(K("else")):
            if self.at(K("if")):
                self.if_statement()
            else:
                self.block()

    def header(self) -> None:
        """Up to two semicolons of an if, for or switch; a '{' here opens the body, not a literal."""
        before, self.plain_brace = self.plain_brace, False
        if not self.at("{;"):
            self.simple()
        for _ in range(2):
            if self.eat(";") and not self.at("{;"):
                self.simple()
        self.plain_brace = before

    def simple(self) -> None:
        if self.at(K("range")):
            self.i += 1
            return self.expr()
        self.list()
        if self.at("=Ad"):
            self.i += 1
            if self.eat(K("range")):
                self.expr()
            else:
                self.list()
        elif self.at("ih"):
            self.i += 1
            if self.s[self.i - 1] == "h":
                self.expr()

    def primary(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in "NS":
            self.i += 1
        elif c in self.names:
            self.i += 1
        elif c == "(":
            before, self.plain_brace = self.plain_brace, True
            self.i += 1
            at = self.i
            try:
                self.expr()
                self.need(")", "unclosed (")
            except Fail as e:
                self.i = at
                try:
                    self.type()
                    self.need(")")
                except Fail:
                    raise e from None
            self.plain_brace = before
        elif c == K("func"):
            self.i += 1
            self.signature()
            if self.at("{"):
                before, self.plain_brace = self.plain_brace, True
                self.block()
                self.plain_brace = before
        elif c in "[" + kws("map chan struct interface"):
            self.type()
            if self.at("{"):
                self.literal()
        else:
            self.fail("expected an expression")

    def literal(self) -> None:
        before, self.plain_brace = self.plain_brace, True
        self.need("{")
        while not self.eat("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                self.need("}", "unclosed {")
                break
        self.plain_brace = before

    def element(self) -> None:
        self.literal() if self.at("{") else self.expr()

    def post(self) -> None:
        s = self.s
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat(K("type")):
                        self.type()
                    self.need(")")
                else:
                    self.name()
            elif c == "(":
                before, self.plain_brace = self.plain_brace, True
                self.i += 1
                while not self.eat(")"):
                    self.argument()
                    self.eat("e")
                    if not self.eat(","):
                        self.need(")", "expected )")
                        break
                self.plain_brace = before
            elif c == "[":
                before, self.plain_brace = self.plain_brace, True
                self.i += 1
                while not self.eat("]"):
                    if not self.at(":"):
                        self.argument()
                    if not (self.eat(":") or self.eat(",")):
                        self.need("]")
                        break
                self.plain_brace = before
            elif c == "{" and self.plain_brace and s[self.i - 1] in "I]":
                self.literal()
            else:
                return

    def argument(self) -> None:
        at = self.i
        try:
            self.expr()
        except Fail as e:
            self.i = at
            try:
                self.type()
            except Fail:
                raise e from None


class Rust(Parser):
    lang = "rust"
    ternary = False
    prefix = "!+*&n"
    postfix = "?"
    power = BASE_POWER | {"e": 3}

    def __init__(self, s: str, keep: bool = True):
        super().__init__(s, keep)
        self.names += kws("self Self super crate")
        self.plain_brace = True

    def attributes(self) -> None:
        while self.at("#") and self.s[self.i + 1] in "[!":
            j = self.i + 1 + (self.s[self.i + 1] == "!")
            if self.s[j] != "[":
                self.fail("expected [")
            j = self.close_of(j)
            if j < 0:
                self.fail("unclosed [")
            self.i = j + 1

    def top(self) -> None:
        self.attributes()
        if self.at("\0"):
            return
        if not self.item():
            self.fail("expected an item")

    def visibility(self) -> None:
        if self.eat(K("pub")) and self.at("(") and self.s[self.i + 1] in kws("crate super self in"):
            self.i = self.close_of(self.i) + 1

    def item(self) -> bool:
        s = self.s
        at = self.i
        self.visibility()
        c = s[self.i]
        if c == K("use"):
            self.i += 1
            self.use_tree()
            self.end()
        elif c == K("mod"):
            self.i += 1
            self.name()
            if not self.eat(";"):
                self.need("{")
                while not self.eat("}"):
                    if self.at("\0"):
                        self.fail("unclosed {")
                    self.guarded(self.top)
        elif c in kws("struct union") and s[self.i + 1] in self.names and s[self.i + 2] in "{(<;" + K("where"):
            self.i += 2
            self.generics()
            self.where()
            if self.eat("("):
                while not self.eat(")"):
                    self.attributes()
                    self.visibility()
                    self.type()
                    if not self.at(")"):
                        self.need(",")
                self.where()
                self.end()
            elif not self.eat(";"):
                self.fields()
        elif c == K("enum"):
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            while not self.eat("}"):
                self.attributes()
                self.name()
                if self.at("{"):
                    self.fields()
                elif self.eat("("):
                    while not self.eat(")"):
                        self.visibility()
                        self.type()
                        if not self.at(")"):
                            self.need(",")
                if self.eat("="):
                    self.expr()
                if not self.at("}"):
                    self.need(",")
        elif c == K("type"):
            self.i += 1
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            if self.eat("="):
                self.type()
            self.where()
            self.end()
        elif c in kws("const static") and (s[self.i + 1] in self.names or s[self.i + 1] == K("mut")) :
            self.i += 1
            self.eat(K("mut"))
            self.name()
            self.need(":", "expected a type")
            self.type()
            if self.eat("="):
                self.expr()
            self.end()
        elif c == K("trait") or c == K("unsafe") and s[self.i + 1] == K("trait"):
            self.eat(K("unsafe"))
            self.i += 1
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            self.members()
        elif c == K("impl") or c == K("unsafe") and s[self.i + 1] == K("impl"):
            self.eat(K("unsafe"))
            self.i += 1
            self.generics()
            self.eat("!")
            self.type()
            if self.eat(K("for")):
                self.type()
            self.where()
            self.members()
        elif c == K("extern") and s[self.i + 1] == K("crate"):
            self.i += 2
            self.name()
            if self.eat(K("as")):
                self.name()
            self.end()
        elif c == K("extern") and (s[self.i + 1] == "{" or s[self.i + 1 : self.i + 3] == "S{"):
            self.i += 1
            self.eat("S")
            self.members()
        elif c == K("macro_rules") and s[self.i + 1] == "!":
            self.i += 2
            self.name()
            self.tree()
            self.eat(";")
        elif c in kws("fn const async unsafe extern") and self.is_fn():
            while not self.eat(K("fn")):
                self.i += 1
            self.name()
            self.generics()
            self.need("(", "expected parameters")
            while not self.eat(")"):
                self.attributes()
                if self.at("&") or self.at(kws("self mut")):
                    a = self.i
                    self.eat("&")
                    self.eat("L")
                    self.eat(K("mut"))
                    if self.eat(K("self")):
                        if self.eat(":"):
                            self.type()
                        if not self.at(")"):
                            self.need(",")
                        continue
                    self.i = a
                self.pattern()
                self.need(":", "expected a type")
                self.type()
                if not self.at(")"):
                    self.need(",", "unclosed parameters")
            if self.eat("m"):
                self.type()
            self.where()
            if not self.eat(";"):
                self.block()
        else:
            self.i = at
            if c in self.names and s[self.i + 1] == "!" and not self.inner:
                self.i += 2
                self.tree()
                self.eat(";")
                return True
            return False
        return True

    inner = 0

    def is_fn(self) -> bool:
        j = self.i
        while self.s[j] in kws("const async unsafe extern") or self.s[j] == "S":
            j += 1
        return self.s[j] == K("fn")

    def use_tree(self) -> None:
        self.eat("c")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                while not self.eat("}"):
                    self.use_tree()
                    if not self.at("}"):
                        self.need(",")
                return
            self.name()
            if not self.eat("c"):
                break
        if self.eat(K("as")):
            self.name()

    def fields(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.attributes()
            self.visibility()
            self.name()
            self.need(":", "expected a type")
            self.type()
            if not self.at("}"):
                self.need(",", "expected ,")

    def members(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.at("\0"):
                self.fail("unclosed {")
            self.guarded(self.top)

    def generics(self) -> None:
        if self.eat("<"):
            while not self.eat(">"):
                self.attributes()
                if self.eat("L"):
                    if self.eat(":"):
                        while self.eat("L"):
                            self.eat("+")
                else:
                    self.eat(K("const"))
                    self.name()
                    if self.eat(":"):
                        self.bounds()
                    if self.eat("="):
                        self.type()
                if not self.at(">"):
                    self.need(",")

    def where(self) -> None:
        if self.eat(K("where")):
            while not self.at("{;\0"):
                if not self.eat("L"):
                    if self.eat(K("for")):
                        self.generics()
                    self.type()
                self.need(":")
                self.bounds()
                if not self.eat(","):
                    break

    def bounds(self) -> None:
        while True:
            if self.eat("L"):
                pass
            elif self.at("?") or self.at("(") or self.s[self.i] in self.names + "c" or self.at(kws("for")):
                self.eat("?")
                if self.eat(K("for")):
                    self.generics()
                self.type()
            if not self.eat("+"):
                return

    def type(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in "&n":
            self.i += 1
            self.eat("L")
            self.eat(K("mut"))
            self.type()
        elif c == "*":
            self.i += 1
            if not self.at(kws("const mut")):
                self.fail("expected const or mut")
            self.i += 1
            self.type()
        elif c == "(":
            self.i += 1
            while not self.eat(")"):
                self.type()
                if self.at("+"):
                    self.i += 1
                    self.bounds()
                if not self.at(")"):
                    self.need(",")
        elif c == "[":
            self.i += 1
            self.type()
            if self.eat(";"):
                self.expr()
            self.need("]")
        elif c in kws("dyn impl"):
            self.i += 1
            self.bounds()
        elif c in kws("fn unsafe extern"):
            while not self.eat(K("fn")):
                self.i += 1
                self.eat("S")
                if not self.at(kws("fn unsafe extern")):
                    self.fail("expected fn")
            self.need("(")
            while not self.eat(")"):
                if s[self.i] in self.names and s[self.i + 1] == ":":
                    self.i += 2
                self.type()
                if not self.at(")"):
                    self.need(",")
            if self.eat("m"):
                self.type()
        elif c == "!":
            self.i += 1
        elif c == K("for"):
            self.i += 1
            self.generics()
            self.type()
        elif c == "<":
            self.i += 1
            self.type()
            if self.eat(K("as")):
                self.type()
            self.need(">")
            while self.eat("c"):
                self.segment()
        elif c in self.names or c == "c":
            self.eat("c")
            self.segment()
            while self.eat("c"):
                if self.at("<"):
                    self.angle()
                else:
                    self.segment()
            if self.at("!"):
                self.i += 1
                self.tree()
        else:
            self.fail("expected a type")

    def segment(self) -> None:
        self.name()
        if self.at("<"):
            self.angle()
        elif self.at("(") and self.s[self.i - 1] == "I" and self.typed_call:
            self.i += 1
            while not self.eat(")"):
                self.type()
                if not self.at(")"):
                    self.need(",")
            if self.eat("m"):
                self.type()

    typed_call = True

    def angle(self) -> None:
        self.need("<")
        while not self.eat(">"):
            if self.eat("L"):
                pass
            elif self.at("N{S") or self.at(kws("true false")):
                self.block() if self.at("{") else self.eat(self.s[self.i])
            else:
                self.type()
                if self.eat("="):
                    self.type()
                elif self.eat(":"):
                    self.bounds()
            if not self.at(">"):
                self.need(",", "expected >")

    def tree(self) -> None:
        """A token tree of a macro."""
        if not self.at("([{"):
            self.fail("expected a token tree")
        j = self.close_of(self.i)
        if j < 0:
            self.fail("unclosed macro")
        m = re.search("X", self.s[self.i : j])
        if m:
            self.i += m.start()
            self.fail("no token of the language")
        self.i = j + 1

    def block(self) -> None:
        before, self.plain_brace = self.plain_brace, True
        self.inner += 1
        try:
            self.need("{", "expected {")
            while self.s[self.i] not in "}\0":
                self.guarded(self.statement)
            self.need("}", "unclosed {")
        finally:
            self.plain_brace = before
            self.inner -= 1

    def statement(self) -> None:
        if self.s[self.i] in self.names + kws("let return") and self.remembered("rust", "inner_plain"):
            return
        self.plain()

    def inner_plain(self) -> None:
        self.inner = 1
        self.plain()

    def plain(self) -> None:
        self.attributes()
        s, c = self.s, self.s[self.i]
        if c == ";":
            self.i += 1
        elif c == K("let"):
            self.i += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expr()
                if self.eat(K("else")):
                    self.block()
            self.end()
        elif self.item():
            pass
        else:
            at = self.i
            self.expr_statement()
            if self.eat(";") or self.at("}"):
                return
            if s[self.i - 1] == "}" and (s[at] in kws("if match while for loop unsafe async") + "{L" or s[at + 1] == "!"):
                return
            self.fail("expected ;")

    def expr_statement(self) -> None:
        c = self.s[self.i]
        if c in kws("if match while for loop") + "{" or c == K("unsafe"):
            self.primary()
            if self.at(".?"):
                self.post()
                self.climb()
            else:
                return
        self.expr()

    def climb(self) -> None:
        while self.s[self.i] in self.power:
            self.i += 1
            self.expr(1)

    def expr(self, least: int = 0) -> None:
        if self.at("e"):  # ..b
            self.i += 1
            if not self.at(")]};,{\0"):
                self.expr(4)
            return
        super().expr(least)
        while self.at(K("as")):
            self.i += 1
            before, self.typed_call = self.typed_call, False
            self.type()
            self.typed_call = before
            while self.s[self.i] in self.power and self.power[self.s[self.i]] >= least:
                op = self.s[self.i]
                self.i += 1
                if op == ">" and self.at(">"):
                    self.i += 1
                self.operand(op, self.power[op] + (self.power[op] > 1))

    def operand(self, op: str, p: int) -> None:
        if op == "e" and (self.at(")]};,\0") or self.at("{") and not self.plain_brace):
            return
        self.expr(p)

    def unary(self) -> None:
        while self.s[self.i] in self.prefix:
            self.i += 1
            if self.s[self.i - 1] in "&n":
                self.eat(K("mut"))
                if self.at(K("const")):
                    self.i += 1
        self.primary()
        self.post()

    def condition(self) -> None:
        before, self.plain_brace = self.plain_brace, False
        while True:
            if self.eat(K("let")):
                self.pattern()
                self.need("=")
                self.expr(6)
            else:
                self.expr()
            if not self.eat("n"):
                break
        self.plain_brace = before

    def primary(self) -> None:
        s, c = self.s, self.s[self.i]
        if c in "NS" or c in kws("true false"):
            self.i += 1
        elif c in self.names or c in "c<":
            if c == "<":
                self.type()
            else:
                self.eat("c")
                self.name()
            while self.at("c"):
                self.i += 1
                if self.at("<"):
                    self.angle()
                else:
                    self.name()
            if self.at("!") and s[self.i + 1] in "([{":
                self.i += 1
                self.tree()
            elif self.at("{") and self.plain_brace and self.struct_follows():
                self.struct_literal()
        elif c == "(":
            before, self.plain_brace = self.plain_brace, True
            self.i += 1
            while not self.eat(")"):
                self.expr()
                if not self.at(")"):
                    self.need(",", "unclosed (")
            self.plain_brace = before
        elif c == "[":
            before, self.plain_brace = self.plain_brace, True
            self.i += 1
            while not self.eat("]"):
                self.expr()
                if self.eat(";"):
                    self.expr()
                if not self.at("]"):
                    self.need(",", "unclosed [")
            self.plain_brace = before
        elif c == "{":
            self.block()
        elif c in kws("unsafe async"):
            self.i += 1
            self.eat(K("move"))
            if self.at("|o"):
                self.primary()
            else:
                self.block()
        elif c == K("if"):
            self.i += 1
            self.condition()
            self.block()
            if self.eat(K("else")):
                if self.at(K("if")):
                    self.primary()
                else:
                    self.block()
        elif c == K("match"):
            self.i += 1
            self.condition()
            self.need("{")
            before, self.plain_brace = self.plain_brace, True
            while not self.eat("}"):
                self.attributes()
                self.pattern()
                if self.eat(K("if")):
                    self.condition()
                    self.plain_brace = True
                self.need("f", "expected =>")
                braced = self.at("{")
                self.expr()
                if not self.eat(",") and not self.at("}") and not braced:
                    self.fail("expected ,")
            self.plain_brace = before
        elif c == K("while"):
            self.i += 1
            self.condition()
            self.block()
        elif c == K("for"):
            self.i += 1
            self.pattern()
            self.need(K("in"), "expected in")
            self.condition()
            self.block()
        elif c == K("loop"):
            self.i += 1
            self.block()
        elif c == "L":
            self.i += 1
            self.need(":")
            self.primary()
        elif c in "|o" or c == K("move"):
            self.eat(K("move"))
            if not self.eat("o"):
                self.need("|")
                while not self.eat("|"):
                    self.pattern_single()
                    if self.eat(":"):
                        self.type()
                    if not self.at("|"):
                        self.need(",")
            if self.eat("m"):
                self.type()
                self.block()
            else:
                self.expr()
        elif c in kws("return break"):
            self.i += 1
            self.eat("L")
            if not self.at(";})],\0") and not (self.at("{") and not self.plain_brace):
                self.expr()
        elif c == K("continue"):
            self.i += 1
            self.eat("L")
        else:
            self.fail("expected an expression")

    def struct_follows(self) -> bool:
        s, j = self.s, self.i + 1
        return s[j] == "}" or s[j] in self.names + "N" and s[j + 1] in ":,}" or s[j] == "e" or s[j] == "#"

    def struct_literal(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.attributes()
            if self.eat("e"):
                self.expr()
            else:
                if not self.eat("N"):
                    self.name()
                if self.eat(":"):
                    self.expr()
            if not self.at("}"):
                self.need(",", "expected ,")

    def post(self) -> None:
        s = self.s
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                if self.at("N") or self.at(K("await")):
                    self.i += 1
                else:
                    self.name()
                    if self.at("c"):
                        self.i += 1
                        self.angle()
            elif c == "(":
                before, self.plain_brace = self.plain_brace, True
                self.i += 1
                self.args(")")
                self.plain_brace = before
            elif c == "[":
                before, self.plain_brace = self.plain_brace, True
                self.i += 1
                self.expr()
                self.need("]")
                self.plain_brace = before
            elif c == "?":
                self.i += 1
            else:
                return

    def arg(self) -> None:
        self.expr()

    def pattern(self) -> None:
        self.eat("|")
        self.pattern_single()
        while self.eat("|"):
            self.pattern_single()

    def pattern_single(self) -> None:
        s = self.s
        while self.at("&n"):
            self.i += 1
        while self.at(kws("ref mut")):
            self.i += 1
        c = s[self.i]
        if c in "(" or c == "[":
            self.i += 1
            close = ")" if c == "(" else "]"
            while not self.eat(close):
                self.pattern()
                if not self.at(close):
                    self.need(",")
            return
        if c == "e":
            self.i += 1
            if self.at("NSI+"):
                self.pattern_single()
            return
        if c == "+" or c in "NS" or c in kws("true false"):
            self.eat("+")
            self.i += 1
        elif c in self.names or c in "c<":
            before, self.typed_call = self.typed_call, False
            if c == "<":
                self.type()
            else:
                self.eat("c")
                self.name()
            while self.eat("c"):
                if self.at("<"):
                    self.angle()
                else:
                    self.name()
            self.typed_call = before
            if self.at("!") and s[self.i + 1] in "([{":
                self.i += 1
                self.tree()
            elif self.eat("("):
                while not self.eat(")"):
                    self.pattern()
                    if not self.at(")"):
                        self.need(",")
            elif self.at("{"):
                self.i += 1
                while not self.eat("}"):
                    self.attributes()
                    if not self.eat("e"):
                        while self.at(kws("ref mut")):
                            self.i += 1
                        if not self.eat("N"):
                            self.name()
                        if self.eat(":"):
                            self.pattern()
                    if not self.at("}"):
                        self.need(",")
            elif self.eat("@"):
                self.pattern_single()
        else:
            self.fail("expected a pattern")
        if self.eat("e") and self.at("NSI+" + K("true")):
            self.eat("+")
            self.i += 1


class Python(Parser):
    """One logical line of Python; ``python_errors`` checks how lines are laid out."""

    lang = "python"
    ternary = False
    prefix = "+~" + K("not")
    postfix = ""
    power = {"o": 2, "|": 6, "^": 7, "&": 8, "q": 5, "<": 5, ">": 5, "r": 5, "s": 9, "+": 10, "*": 11, "/": 11, "@": 11, "w": 13}

    def expr(self, least: int = 0) -> None:
        """A test; 'not', comparisons, 'and', 'or', a conditional, a lambda or ':='."""
        if least == 0 and self.at(K("lambda")):
            return self.lambda_()
        self.unary()
        s, power = self.s, self.power
        while True:
            c = s[self.i]
            if c in power and power[c] >= least and c != "o":
                self.i += 1
                if c == ">" and s[self.i] == ">":
                    self.i += 1
                self.expr(power[c] + (c != "w"))
            elif c in kws("and or") and least <= 3:
                self.i += 1
                if self.at(K("lambda")):
                    return self.lambda_()
                self.expr(4 if c == K("and") else 3)
            elif c in kws("in is") and least <= 5:
                self.i += 1
                if c == K("is"):
                    self.eat(K("not"))
                self.expr(6)
            elif c == K("not") and s[self.i + 1] == K("in") and least <= 5:
                self.i += 2
                self.expr(6)
            elif c == K("if") and least == 0 and not self.nocond:
                self.i += 1
                self.expr(2)
                self.need(K("else"), "expected else")
                return self.expr()
            elif c == "d" and least == 0:
                self.i += 1
                return self.expr()
            else:
                return

    nocond = False

    def unary(self) -> None:
        while self.s[self.i] in self.prefix:
            if self.at(K("not")):
                self.i += 1
                return self.expr(4) if not self.at(K("not")) else self.unary()
            self.i += 1
        self.eat(K("await"))
        self.primary()
        self.post()

    def lambda_(self) -> None:
        self.i += 1
        self.parameters(":", False)
        self.expr()

    def primary(self) -> None:
        s, c = self.s, self.s[self.i]
        if c == "S":
            while self.at("S"):
                self.i += 1
        elif c == "N" or c in self.names or c in kws("None True False"):
            self.i += 1
        elif c == "e":
            self.i += 1
        elif c == "(":
            self.i += 1
            if self.at(K("yield")):
                self.yield_()
                return self.need(")")
            self.items(")")
        elif c == "[":
            self.i += 1
            self.items("]")
        elif c == "{":
            self.i += 1
            self.braces()
        else:
            self.fail("expected an expression")

    def star(self) -> None:
        if self.eat("*"):
            self.expr(6)
        else:
            self.expr()

    def items(self, close: str) -> None:
        first = True
        while not self.eat(close):
            before, self.nocond = self.nocond, False
            self.star()
            self.nocond = before
            if first and self.at(kws("for async")):
                self.comprehension()
                self.need(close, f"unclosed {close}")
                return
            first = False
            if not self.eat(","):
                self.need(close, f"expected {close}")
                return

    def braces(self) -> None:
        first = True
        before, self.nocond = self.nocond, False
        while not self.eat("}"):
            if self.eat("w"):
                self.expr(6)
            else:
                self.star()
                if self.eat(":"):
                    self.expr()
            if first and self.at(kws("for async")):
                self.comprehension()
                self.need("}", "unclosed {")
                break
            first = False
            if not self.eat(","):
                self.need("}", "expected }")
                break
        self.nocond = before

    def comprehension(self) -> None:
        while self.at(kws("for async if")):
            if self.eat(K("if")):
                before, self.nocond = self.nocond, True
                self.expr()
                self.nocond = before
                continue
            self.eat(K("async"))
            self.need(K("for"))
            self.targets()
            self.need(K("in"), "expected in")
            before, self.nocond = self.nocond, True
            self.expr()
            self.nocond = before

    def targets(self) -> None:
        while True:
            self.eat("*")
            self.expr(6)
            if not self.eat(",") or self.at(K("in") + "="):
                return

    def post(self) -> None:
        s = self.s
        while True:
            c = s[self.i]
            if c == ".":
                self.i += 1
                self.name()
            elif c == "(":
                self.i += 1
                first = True
                before, self.nocond = self.nocond, False
                while not self.eat(")"):
                    if self.eat("*") or self.eat("w"):
                        self.expr()
                    else:
                        self.expr()
                        if self.eat("="):
                            self.expr()
                        elif first and self.at(kws("for async")):
                            self.comprehension()
                    first = False
                    if not self.eat(","):
                        self.need(")", "expected )")
                        break
                self.nocond = before
            elif c == "[":
                self.i += 1
                before, self.nocond = self.nocond, False
                if self.at("]"):
                    self.fail("expected an index")
                while not self.eat("]"):
                    if not self.at(":"):
                        self.star()
                    for _ in range(2):
                        if self.eat(":") and not self.at(":,]"):
                            self.expr()
                    if not self.eat(","):
                        self.need("]", "expected ]")
                        break
                self.nocond = before
            else:
                return

    def list(self) -> None:
        self.star()
        while self.eat(","):
            if self.at(";=)\0:A"):
                return
            self.star()

    def yield_(self) -> None:
        self.i += 1
        if self.eat(K("from")):
            self.expr()
        elif not self.at(");=\0"):
            self.list()

    def parameters(self, close: str, typed: bool = True) -> None:
        while not self.eat(close):
            if self.eat("/"):
                pass
            elif self.at("*w"):
                bare = self.eat("*")
                if not bare:
                    self.i += 1
                if not bare or not self.at("," + close):
                    self.name()
                    if typed and self.eat(":"):
                        self.star()
            else:
                self.name()
                if typed and self.eat(":"):
                    self.expr()
                if self.eat("="):
                    self.expr()
            if not self.eat(","):
                self.need(close, "unclosed parameters")
                return

    def line(self) -> str:
        """Parses the logical line; returns what it opens: '' for none, else the word before its ':'."""
        s, c = self.s, self.s[self.i]
        if c == "@":
            self.i += 1
            self.expr()
            self.stop()
            return "@"
        if c == K("async") and s[self.i + 1] in kws("def for with"):
            self.i += 1
            c = s[self.i]
        if c == K("def"):
            self.i += 1
            self.name()
            if self.eat("["):
                self.type_params()
            self.need("(", "expected (")
            self.parameters(")")
            if self.eat("m"):
                self.expr()
            return self.suite("def")
        if c == K("class"):
            self.i += 1
            self.name()
            if self.eat("["):
                self.type_params()
            if self.at("("):
                self.post()
            return self.suite("class")
        if c in kws("if elif while"):
            self.i += 1
            self.expr()
            return self.suite("elif" if c == K("elif") else "if" if c == K("if") else "while")
        if c == K("for"):
            self.i += 1
            self.targets()
            self.need(K("in"), "expected in")
            self.list()
            return self.suite("for")
        if c == K("with"):
            self.i += 1
            at = self.i
            if not (self.eat("(") and self.attempt(self.with_items, ")") and self.at(":")):
                self.i = at
                self.with_items(":")
                self.i -= 1
            return self.suite("with")
        if c == K("try"):
            self.i += 1
            return self.suite("try")
        if c == K("except"):
            self.i += 1
            self.eat("*")
            if not self.at(":"):
                self.expr()
                while self.eat(","):
                    self.expr()
                if self.eat(K("as")):
                    self.name()
            return self.suite("except")
        if c in kws("else finally"):
            self.i += 1
            return self.suite("else" if c == K("else") else "finally")
        if c == K("match") and s[self.i + 1] not in "=.,:)A[;\0" and s[-4] == ":":
            at = self.i
            self.i += 1
            if self.attempt(self.list) and s[self.i] == ":" and s[self.i + 1] == "\0":
                return "match"
            self.i = at
        if c == K("case") and s[self.i + 1] not in "=.,:)A\0" and s[-4] == ":":
            at = self.i
            self.i += 1
            if self.attempt(self.case) and s[self.i] == ":":
                return self.suite("case")
            self.i = at
        self.simples()
        return ""

    def type_params(self) -> None:
        while not self.eat("]"):
            self.eat("*") or self.eat("w")
            self.name()
            if self.eat(":"):
                self.expr()
            if self.eat("="):
                self.expr()
            if not self.at("]"):
                self.need(",")

    in_case = False

    def case(self) -> None:
        self.in_case = True
        self.case_pattern()
        while self.eat(","):
            if not self.at(":" + K("if")):
                self.case_pattern()
        self.in_case = False
        if self.eat(K("if")):
            self.expr()

    def case_pattern(self) -> None:
        self.eat("*")
        self.expr(6)
        if self.eat(K("as")):
            self.name()

    def with_items(self, close: str) -> None:
        while True:
            self.expr()
            if self.eat(K("as")):
                self.star_target()
            if self.eat(close):
                return
            self.need(",", "expected ,")
            if self.eat(close):
                return

    def star_target(self) -> None:
        self.expr(6)

    def suite(self, word: str) -> str:
        self.need(":", "expected :")
        if self.at("\0"):
            return word
        self.simples()
        return "." + word

    def stop(self) -> None:
        if not self.at("\0"):
            self.fail("unexpected token")

    def simples(self) -> None:
        while True:
            self.simple()
            if self.eat(";"):
                if self.at("\0"):
                    return
                continue
            return self.stop()

    def simple(self) -> None:
        c = self.s[self.i]
        if c in kws("pass break continue"):
            self.i += 1
        elif c == K("return"):
            self.i += 1
            if not self.at(";\0"):
                self.list()
        elif c == K("raise"):
            self.i += 1
            if not self.at(";\0"):
                self.expr()
                if self.eat(K("from")):
                    self.expr()
        elif c in kws("global nonlocal"):
            self.i += 1
            self.name()
            while self.eat(","):
                self.name()
        elif c == K("del"):
            self.i += 1
            self.list()
        elif c == K("assert"):
            self.i += 1
            self.expr()
            if self.eat(","):
                self.expr()
        elif c == K("import"):
            self.i += 1
            while True:
                self.dotted()
                if self.eat(K("as")):
                    self.name()
                if not self.eat(","):
                    return
        elif c == K("from"):
            self.i += 1
            dots = False
            while self.at(".e"):
                self.i += 1
                dots = True
            if not (dots and self.at(K("import"))):
                self.dotted()
            self.need(K("import"), "expected import")
            if self.eat("*"):
                return
            close = self.eat("(")
            while True:
                self.name()
                if self.eat(K("as")):
                    self.name()
                if not self.eat(","):
                    break
                if close and self.at(")"):
                    break
            if close:
                self.need(")")
        elif c == K("type") and self.s[self.i + 1] in self.names and self.s[self.i + 2] in "=[":
            self.i += 2
            if self.eat("["):
                self.type_params()
            self.need("=")
            self.expr()
        else:
            first = self.i
            self.yield_() if self.at(K("yield")) else self.list()
            if self.at("=A:") and not self.assignable(first):
                self.fail("cannot assign to this")
            if self.eat("A"):
                self.yield_() if self.at(K("yield")) else self.list()
                return
            if self.eat(":"):
                self.expr()
                if self.eat("="):
                    self.yield_() if self.at(K("yield")) else self.list()
                return
            while self.eat("="):
                self.yield_() if self.at(K("yield")) else self.list()

    def assignable(self, first: int) -> bool:
        """Whether what was just parsed can stand left of '=': it ends as a name, index, tuple or list."""
        return self.s[self.i - 1] in self.names + ")],"

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()


_LINES: dict[str, tuple[str, int, str]] = {}
_DEPTH: dict[str, int] = {}
_CONTINUES = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except", "try"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}


def python_line(line: str) -> tuple[str, int, str]:
    """(what the line opens, -1 or the place of its error, message), remembered by shape."""
    known = _LINES.get(line)
    if known is None:
        if len(_LINES) >= MEMO_BOUND:
            _LINES.clear()
        p = Python(line)
        try:
            known = (p.line(), -1, "")
        except Fail as e:
            c = p.s[e.args[0]]
            known = ("", e.args[0], "no token of the language" if c == "X" else "unexpected end of line" if c == "\0" else e.args[1])
        except RecursionError:
            known = ("", 0, "nested too deeply to parse")
        _LINES[line] = known
    return known


_BRACKET = re.compile(r"[()\[\]{}]")


def python_errors(text: str, s: str, toks: list[str], table) -> list[tuple[int, str]]:
    """Errors of a Python file: s its class string with one '\\n' per line break."""
    indents = [0]
    for t in toks:
        if t[0] in "\r\n":
            tail = t[t.rindex("\n") + 1 :]
            if "#" in tail:
                tail = "-"
            indents.append(-1 if tail == "-" else tail)
    errors: list[tuple[int, str]] = []
    lines = s.split("\n")
    stack: list[str] = [""]
    opened: list[tuple[str, str]] = []  # (indent, word) of block openers whose block may still go on
    expect = ""  # the opener that needs an indented block
    at = 0
    k, n = 0, len(lines)
    while k < n:
        line, ind, start = lines[k], indents[k] if k < len(indents) else "", at
        at += len(line) + 1
        k += 1
        net = _DEPTH.get(line)
        if net is None:
            if len(_DEPTH) >= MEMO_BOUND:
                _DEPTH.clear()
            net = _DEPTH[line] = line.count("(") + line.count("[") + line.count("{") - line.count(")") - line.count("]") - line.count("}")
        if net > 0:
            parts = [line]
            while net > 0 and k < n:
                parts.append(lines[k])
                net += lines[k].count("(") + lines[k].count("[") + lines[k].count("{") - lines[k].count(")") - lines[k].count("]") - lines[k].count("}")
                at += len(lines[k]) + 1
                k += 1
            line = "".join(parts)
        if not line:
            continue
        if k - 1 == 0 and start == 0:
            head = text[: len(text) - len(text.lstrip(" \t\f"))]
            ind = head
        if ind == 0 or ind == -1:
            ind = ""
        word, bad, what = python_line(line)
        if bad >= 0:
            errors.append((start + bad, "unexpected end of file" if start + bad >= len(s.rstrip("\n")) else what))
        # layout
        if expect:
            if len(ind) > len(stack[-1]) and ind.startswith(stack[-1]):
                stack.append(ind)
            else:
                errors.append((start, f"expected an indented block after {expect}"))
            expect = ""
        elif ind != stack[-1]:
            if ind.startswith(stack[-1]) and len(ind) > len(stack[-1]):
                errors.append((start, "unexpected indent"))
                stack.append(ind)
        while len(stack) > 1 and len(ind) < len(stack[-1]):
            stack.pop()
        if ind != stack[-1]:
            errors.append((start, "indentation matches no outer level"))
        key = word.lstrip(".")
        while opened and len(opened[-1][0]) > len(ind):
            opened.pop()
        before = opened.pop()[1] if opened and opened[-1][0] == ind else ""
        if key in _CONTINUES and before not in _CONTINUES[key]:
            errors.append((start, f"{key} without its statement"))
        elif before == "try" and key not in ("except", "finally"):
            errors.append((start, "expected except or finally"))
        elif before == "@" and key not in ("def", "class", "@"):
            errors.append((start, "decorator without a definition"))
        if key:
            opened.append((ind, key))
        if word and word[0] != "." and word != "@":
            expect = word
    if expect:
        errors.append((len(s), f"expected an indented block after {expect}"))
    if opened and opened[-1][1] in ("try", "@"):
        errors.append((len(s), "unexpected end of file"))
    return errors


PARSERS = {"javascript": JavaScript, "typescript": TypeScript, "java": Java, "csharp": CSharp, "c": C, "cpp": Cpp, "go": Go, "rust": Rust}


@contextmanager
def deep(tokens: int):
    """Lets a parser recurse as far as so many tokens can nest; Python's own calls take no C stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(before + 16 * tokens)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def check_syntax(text: str, lang: str) -> list[tuple[int, str]]:
    """All errors of a file as (line from 1, message), in the order found; empty if it parses."""
    from .lexing import classes_of, tokens

    if lang == "python":
        toks, table = tokens(text.lstrip("﻿"), lang), classes_of(lang)
        s = "".join(map(table.__getitem__, toks))
        with deep(len(s)):
            errors = python_errors(text, s, toks, table)
    else:
        s = class_string(text.lstrip("﻿"), lang)
        p = PARSERS[lang](s)
        with deep(len(s)):
            errors = p.program()
        if p.newlines and errors:  # places in the string without line breaks -> with them
            if lang == "go":
                s = Go._auto.sub(";", s)
            kept = [i for i, c in enumerate(s) if c != "\n"]
            errors = [(kept[e] if e < len(kept) else len(s), m) for e, m in errors]
    if not errors:
        return []
    places = offsets(text.lstrip("﻿"), lang)
    out, last, line = [], 0, 1
    for e, m in sorted(errors, key=lambda x: x[0]):
        o = places[e][0] if e < len(places) else len(text)
        if o >= last:
            line += text.count("\n", last, o)
            last = o
        else:
            line = 1 + text.count("\n", 0, o)
            last = o
        if e < len(places) and m == "no token of the language" and places[e][1][:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||"):
            m = "merge conflict marker"
        out.append((line, m))
    return out
