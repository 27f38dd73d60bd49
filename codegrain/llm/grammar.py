"""Grammars of C (up to C17, with K&R definitions) and C++20, as far as syntax alone goes.

A text becomes a string with one character per token, its kind, so names and values play no
part. Statements are cut out by brackets and keywords; what is left between them, declarations,
expressions and headers, is parsed by recursive descent. These short kind strings repeat all
over a corpus, so their verdicts are cached and most statements cost one lookup.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

# The keywords by the kind they get. C and C++ share the first group.
SHARED = {
    "T": "void char short int long float double signed unsigned", "Q": "const volatile", "G": "static extern register inline typedef",
    "S": "struct union", "N": "enum", "I": "if", "E": "else", "W": "while", "D": "do", "F": "for", "X": "switch", "K": "case", "L": "default",
    "B": "break continue", "J": "goto", "R": "return", "Z": "sizeof",
}
ONLY_C = {"T": "_Bool _Complex _Imaginary", "Q": "restrict _Atomic", "G": "auto _Noreturn _Thread_local", "Z": "_Alignof", "U": "_Static_assert", "l": "_Alignas", "g": "_Generic"}
ONLY_CPP = {
    "T": "bool wchar_t char8_t char16_t char32_t", "G": "thread_local mutable virtual explicit friend constexpr consteval constinit", "A": "auto", "S": "class",
    "Z": "alignof typeid", "U": "static_assert", "l": "alignas", "t": "try", "h": "catch", "w": "throw", "e": "new", "d": "delete", "n": "true false nullptr this",
    "m": "template", "y": "typename", "o": "operator", "u": "using", "p": "namespace", "a": "public private protected",
    "x": "static_cast dynamic_cast const_cast reinterpret_cast", "f": "noexcept", "r": "decltype", "z": "asm", "q": "concept requires", "k": "co_await co_yield", "R": "co_return",
    "b": "and_eq or_eq xor_eq not_eq xor bitor or", "\x03": "and", "!": "not compl", "&": "bitand",
}
# Punctuators by kind. b: binary operators; P: ++ and --; \x01: ->; \x02: assignments but =; \x03: &&; \x04: ::.
PUNCTUATORS = {
    "->": "\x01", "++": "P", "--": "P", "&&": "\x03", "...": "V", "~": "!", "!": "!", "-": "+", "+": "+", "/": "b", "%": "b", "|": "b", "^": "b", "==": "b", "!=": "b", "<=": "b", ">=": "b",
    "||": "b", "<<": "b", "*": "*", "&": "&", "=": "=", "?": "?", ":": ":", ",": ",", ";": ";", "(": "(", ")": ")", "{": "{", "}": "}", "[": "[", "]": "]", ".": ".",
    "+=": "\x02", "-=": "\x02", "*=": "\x02", "/=": "\x02", "%=": "\x02", "&=": "\x02", "|=": "\x02", "^=": "\x02", "<<=": "\x02", ">>=": "\x02",
}
IN_C = {"<": "b", ">": "b", ">>": "b", "::": "::"}
IN_CPP = {"<": "<", ">": ">", ">>": ">>", "::": "\x04", "<=>": "b", ".*": "b", "->*": "b"}

TOKEN = re.compile(
    r"""/\*(?:.*?\*/)?|//[^\n]*|(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|$)|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|$)|[^\W\d]\w*"""
    r"""|\.?\d(?:[eEpP][+-]|'?[\w.])*|->\*|->|\+\+|--|<<=|>>=|<=>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|<<|>>|::|\.\.\.|\.\*|\S""",
    re.S,
)
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9]\d*)(?:[uU](?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?)?$|(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?[fFlL]?$|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+[fFlL]?$")
CPP_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9]\d*|\d+\.\d*|\.\d+|\d+\.?\d*[eE][+-]?\d+)(?:[a-zA-Z_]\w*)?$")
BAD = "\x00"
RAW_STRING = re.compile(r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\(.*?\)\1"', re.S)


class Kinds(dict):
    """Token to kind; what is not known yet is classified once."""

    def __init__(self, cpp: bool) -> None:
        super().__init__(PUNCTUATORS | (IN_CPP if cpp else IN_C))
        self.cpp = cpp
        for group in (SHARED, ONLY_CPP if cpp else ONLY_C):
            for kind, names in group.items():
                self.update(dict.fromkeys(names.split(), kind))
        self.fixed = len(self)

    def __missing__(self, token: str) -> str:
        c = token[0]
        if token.startswith("/*") and len(token) > 3 or token.startswith("//"):
            return ""
        q = token[-1]
        if c in "\"'uUL" and q in "\"'" and len(token) > 1 and (c in "\"'" or "\"" in token or "'" in token):
            start = token.index(q)
            kind = BAD if start == len(token) - 1 else "s" if q == '"' else "c" if len(token) - start > 2 else BAD
        elif c.isalpha() or c == "_":
            kind = "i" if token.replace("'", "").isidentifier() and '"' not in token and "'" not in token else BAD
        elif c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            t = token.replace("'", "") if self.cpp else token
            kind = "n" if NUMBER.match(t) or self.cpp and CPP_NUMBER.match(t) else BAD
        else:
            kind = BAD
        if len(self) > 200_000:  # names are unbounded: begin again
            keep = list(self.items())[: self.fixed]
            self.clear()
            self.update(keep)
        self[token] = kind
        return kind


DIRECTIVES = {"define", "undef", "include", "include_next", "line", "error", "pragma", "warning", "ident", "import", "assert", "unassert", "sccs"}
LITERAL_OR_COMMENT = re.compile(r"""/\*(?:.*?\*/)?|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)
DIRECTIVE = re.compile(r"[ \t\f\v]*#[ \t]*(\w*)(.*)")


def first_branches(text: str) -> str | None:
    """The text with directives removed and only the first branch of each conditional; None if they do not nest."""
    text = LITERAL_OR_COMMENT.sub(lambda m: m.group() if m.group()[0] in "\"'" or len(m.group()) == 2 else " " + "\n" * m.group().count("\n"), text)
    out: list[str] = []
    stack: list[list] = []  # [reads this branch, saw else]
    for line in text.split("\n"):
        m = DIRECTIVE.match(line)
        reading = all(s[0] for s in stack)
        if not m:
            if reading:
                out.append(line)
            continue
        name, rest = m.group(1), m.group(2).strip()
        if name in ("if", "ifdef", "ifndef"):
            if reading and not rest:
                return None
            stack.append([True, False])
        elif name in ("elif", "else", "elifdef", "elifndef"):
            if not stack or stack[-1][1]:
                return None
            stack[-1] = [False, name == "else"]
        elif name == "endif":
            if not stack:
                return None
            stack.pop()
        elif reading and (name not in DIRECTIVES and name or not name and rest or name in ("define", "include", "undef") and not rest):
            return None
    return None if stack else "\n".join(out)


DEEP = 200


def nesting(s: str) -> int | None:
    """How deep brackets are nested in a string of tokens; None if they do not match."""
    open_, deepest = [], 0
    for c in s:
        if c in "([{":
            open_.append(c)
            deepest = max(deepest, len(open_))
        elif c in ")]}" and (not open_ or open_.pop() + c not in ("()", "[]", "{}")):
            return None
    return None if open_ else deepest


class Syntax:
    """One language; ``valid(text)`` is the verdict."""

    def __init__(self, cpp: bool) -> None:
        self.cpp = cpp
        self.kinds = Kinds(cpp)
        size = 1 << 17
        self.simple = lru_cache(size)(lambda s, declare: self._simple(s, declare))
        self.condition = lru_cache(size)(self._condition)
        self.for_header = lru_cache(size)(self._for_header)
        self.external = lru_cache(size)(self._external)
        self.function_head = lru_cache(size)(self._function_head)
        self.case_label = lru_cache(size)(lambda s: (leaf := Leaf(self, s)).conditional(0) == len(s))
        self.catch_head = lru_cache(size)(lambda s: s == "V" or Leaf(self, s).parameter(0) == len(s))

    def kinds_of(self, text: str) -> str | None:
        """The kinds of a text's tokens, or None if it cannot be cut into tokens."""
        text = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
        if "\\\n" in text:
            text = text.replace("\\\n", "")
        if self.cpp and 'R"' in text:
            text = RAW_STRING.sub('""', text)
        if "#" in text:
            text = first_branches(text)
            if text is None:
                return None
        s = "".join(map(self.kinds.__getitem__, TOKEN.findall(text)))
        return None if BAD in s else s

    def valid(self, text: str) -> bool:
        s = self.kinds_of(text)
        depth = None if s is None else nesting(s)
        if depth is None:
            return False
        if depth > DEEP:
            s = self.flattened(s)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000 + 60 * nesting(s)))
        try:
            return Unit(self, s).translation_unit()
        except RecursionError:  # lambdas within lambdas, thousands deep
            return False

    def flattened(self, s: str) -> str:
        """Tokens with every expression within more than DEEP brackets checked from the inside and made one number.

        So the depth of expressions and initializers has no limit; that of blocks has none as it is.
        """
        out: list[str] = []
        opened: list[int] = []
        blocks = [0]  # for each open bracket how many within it are no expressions; these make it none either
        for c in s:
            if c in ")]}":
                start = opened.pop() + 1
                if not blocks.pop() and len(opened) >= DEEP and Leaf(self, inner := "".join(out[start:])).expression(0) == len(inner):
                    if c == "}" and out[opened[-1]] == "{":  # a list within a list
                        out[start - 1:] = "n"
                        continue
                    out[start:] = out[start:] if len(inner) == 1 else "n"
                else:
                    blocks[-1] += len(out) > start
            elif c in "([{":
                opened.append(len(out))
                blocks.append(0)
            out.append(c)
        return "".join(out)

    # The parts of statements that hold no statement of their own.

    def _simple(self, s: str, declare: bool) -> bool:
        """An expression statement or, where allowed, a declaration, without its semicolon."""
        if not s:
            return True
        leaf = Leaf(self, s)
        return leaf.expression(0) == len(s) or declare and leaf.declaration(0)

    def _condition(self, s: str) -> bool:
        leaf = Leaf(self, s)
        if s and leaf.expression(0) == len(s):
            return True
        if not self.cpp:
            return False
        at = leaf.semicolon(0)
        if at >= 0:
            return self.simple(s[:at], True) and self._condition(s[at + 1:])
        return leaf.declaration(0, condition=True)

    def _for_header(self, s: str) -> bool:
        leaf = Leaf(self, s)
        a = leaf.semicolon(0)
        b = leaf.semicolon(a + 1) if a >= 0 else -1
        if a < 0 or self.cpp and b < 0:  # for (init; declaration : range)
            if not self.cpp:
                return False
            if a >= 0 and not self.simple(s[:a], True):
                return False
            return leaf.range_for(a + 1)
        if b < 0 or leaf.semicolon(b + 1) >= 0:
            return False
        return self.simple(s[:a], True) and (a + 1 == b or self._condition(s[a + 1:b])) and (b + 1 == len(s) or leaf.expression(b + 1) == len(s))

    def _external(self, s: str) -> bool:
        """A declaration outside functions, without its semicolon."""
        if not s:
            return self.cpp
        leaf = Leaf(self, s)
        return leaf.declaration(0)

    def _function_head(self, s: str) -> bool:
        return Leaf(self, s).function_head(0) == len(s)


BRACKET = re.compile(r"[(){}\[\]]")
STOP = re.compile(r"[;({\[)}\]]")
CLOSER = {"(": ")", "[": "]", "{": "}"}


def mates(s: str) -> dict[int, int] | None:
    """Where each opening bracket closes; None if brackets do not match."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for m in BRACKET.finditer(s):
        c = m.group()
        if c in "([{":
            stack.append(m.start())
        elif not stack or CLOSER[s[stack[-1]]] != c:
            return None
        else:
            out[stack.pop()] = m.start()
    return None if stack else out


class Unit:
    """Statements and external declarations over a kind string; positions in, positions out, -1 for failure."""

    def __init__(self, g: Syntax, s: str) -> None:
        self.g, self.s, self.cpp = g, s + "\x05", g.cpp
        self.mate = mates(s)

    def end_of_simple(self, i: int) -> int:
        """The position of the semicolon that ends what begins at ``i``, or -1."""
        s, mate = self.s, self.mate
        while True:
            m = STOP.search(s, i)
            if m is None:
                return -1
            i = m.start()
            c = s[i]
            if c == ";":
                return i
            if i not in mate:
                return -1
            i = mate[i] + 1

    def translation_unit(self) -> bool:
        if self.mate is None:
            return False
        i, n = 0, len(self.s) - 1
        if not n:
            return False
        while i < n:
            i = self.external(i)
            if i < 0:
                return False
        return True

    def external(self, i: int) -> int:
        s, mate, g = self.s, self.mate, self.g
        c = s[i]
        if self.cpp:
            if c == ";":
                return i + 1
            if c == "m" and s[i + 1] == "<":
                j = Leaf(g, s[:-1]).angle(i + 1)
                return self.external(j) if j > 0 else -1
            if c == "p" or c == "G" and s[i + 1] == "p":
                i += c == "G"
                j = i + 1
                while s[j] in "i\x04G":
                    j += 1
                if s[j] == "{":
                    return self.members(j + 1, mate[j]) if j in mate else -1
                e = self.end_of_simple(j)
                return e + 1 if s[j] == "=" and e > 0 and g.simple(s[j + 1:e], False) else -1
            if c == "u":
                e = self.end_of_simple(i)
                return e + 1 if e > 0 and Leaf(g, s[i:e]).using(0) else -1
            if c == "G" and s[i + 1] == "s":  # extern "C"
                if s[i + 2] == "{":
                    return self.members(i + 3, mate[i + 2])
                return self.external(i + 2)
            if c == "U":
                e = self.end_of_simple(i)
                return e + 1 if e > 0 and g.simple("i" + s[i + 1:e], False) else -1
        elif c == "U":
            e = self.end_of_simple(i)
            return e + 1 if e > 0 and g.simple("i" + s[i + 1:e], False) else -1
        # A function definition, or a declaration up to its semicolon.
        j = i
        while True:
            m = STOP.search(s, j)
            if m is None:
                return -1
            j = m.start()
            c = s[j]
            if c == ";":
                if g.external(s[i:j]):
                    return j + 1
                return self.old_style(i) if not self.cpp else -1
            if j not in mate:
                return -1
            if c == "{" and j > i and g.function_head(s[i:j]):
                e = self.block(j)
                return e
            if c == "{" and self.cpp and s[j - 1] == "t" and g.function_head(s[i:j - 1]):
                return self.handlers(self.block(j))
            j = mate[j] + 1
            if c == "{" and self.cpp and ":" in s[i:j]:
                # A constructor with initializers: its body is the block that ends a valid head.
                while s[j] in ",i\x04<>({":
                    if s[j] == "{" and g.function_head(s[i:j]):
                        return self.block(j)
                    j = mate[j] + 1 if s[j] in "({" else j + 1

    def old_style(self, i: int) -> int:
        """A K&R definition: a head, declarations of its parameters, a body."""
        s, g = self.s, self.g
        j = s.find("(", i)
        while 0 <= j and not g.function_head(s[i:self.mate[j] + 1]):
            j = s.find("(", self.mate[j])
        if j < 0:
            return -1
        j = self.mate[j] + 1
        while s[j] != "{":
            e = self.end_of_simple(j)
            if e < 0 or e == j or not Leaf(g, s[j:e]).declaration(0):
                return -1
            j = e + 1
        return self.block(j)

    def members(self, i: int, end: int) -> int:
        """External declarations up to a closing brace."""
        while i < end:
            if self.cpp and self.s[i] == "a" and self.s[i + 1] == ":":
                i += 2
                continue
            i = self.external(i)
            if i < 0:
                return -1
        return end + 1

    def block(self, i: int) -> int:
        """A compound statement that begins at ``i``."""
        end = self.mate.get(i, -1)
        if end < 0:
            return -1
        i += 1
        while i < end:
            i = self.statement(i, True)
            if i < 0:
                return -1
        return end + 1 if i == end else -1

    def handlers(self, i: int) -> int:
        s, mate = self.s, self.mate
        if i < 0 or s[i] != "h":
            return -1
        while i >= 0 and s[i] == "h":
            if s[i + 1] != "(" or not self.g.catch_head(s[i + 2:mate[i + 1]]):
                return -1
            j = mate[i + 1] + 1
            if s[j] != "{":
                return -1
            i = self.block(j)
        return i

    def parenthesized(self, i: int, check) -> int:
        """A header in parentheses; the position after it."""
        if self.s[i] != "(":
            return -1
        j = self.mate[i]
        return j + 1 if check(self.s[i + 1:j]) else -1

    def statement(self, i: int, declare: bool) -> int:
        s, g = self.s, self.g
        c = s[i]
        if c == "{":
            return self.block(i)
        if c == ";":
            return i + 1
        if c == "i" and s[i + 1] == ":":
            return self.labelled(i + 2)
        if c == "R":
            e = self.end_of_simple(i)
            if e < 0:
                return -1
            v = s[i + 1:e]
            return e + 1 if not v or g.simple(v, False) or self.cpp and v[0] == "{" and g.simple("i" + v, False) else -1
        if c == "I":
            i += self.cpp and s[i + 1] == "G"  # if constexpr
            j = self.parenthesized(i + 1, g.condition)
            j = self.statement(j, self.cpp) if j > 0 else -1
            if j > 0 and s[j] == "E":
                return self.statement(j + 1, self.cpp)
            return j
        if c == "F":
            j = self.parenthesized(i + 1, g.for_header)
            return self.statement(j, self.cpp) if j > 0 else -1
        if c in "WX":
            j = self.parenthesized(i + 1, g.condition)
            return self.statement(j, self.cpp) if j > 0 else -1
        if c == "D":
            j = self.statement(i + 1, self.cpp)
            if j < 0 or s[j] != "W":
                return -1
            j = self.parenthesized(j + 1, lambda x: bool(x) and g.simple(x, False))
            return j + 1 if j > 0 and s[j] == ";" else -1
        if c == "K":
            j = i + 1
            depth = 0
            while s[j] not in ";\x05}":
                if s[j] in "([{":
                    j = self.mate[j]
                elif s[j] == "?":
                    depth += 1
                elif s[j] == ":":
                    if not depth:
                        break
                    depth -= 1
                j += 1
            return self.labelled(j + 1) if s[j] == ":" and j > i + 1 and g.case_label(s[i + 1:j]) else -1
        if c == "L":
            return self.labelled(i + 2) if s[i + 1] == ":" else -1
        if c == "B":
            return i + 2 if s[i + 1] == ";" else -1
        if c == "J":
            return i + 3 if s[i + 1] == "i" and s[i + 2] == ";" else -1
        if c == "E" or c in ")]}\x05":
            return -1
        if self.cpp:
            if c == "t":
                return self.handlers(self.block(i + 1)) if s[i + 1] == "{" else -1
            if c in "uU" or c == "p":
                return self.external(i) if declare else -1
        elif c == "U":
            return self.external(i) if declare else -1
        e = self.end_of_simple(i)
        return e + 1 if e > 0 and g.simple(s[i:e], declare) else -1

    def labelled(self, i: int) -> int:
        """What follows a label: a statement; C++ also lets a declaration follow."""
        return self.statement(i, self.cpp)


class Leaf:
    """Recursive descent over the kinds of an expression or a declaration.

    Methods take a position and return the position after what they parsed, or -1. Where a
    text can be read in two ways, the longer reading counts.
    """

    def __init__(self, g: Syntax, s: str) -> None:
        self.g, self.cpp, self.n = g, g.cpp, len(s)
        self.s = s + "\x05\x05\x05"
        self.memo: dict[tuple, int] = {}
        self._mate: dict[int, int] | None = None

    @property
    def mate(self) -> dict[int, int]:
        if self._mate is None:
            self._mate = mates(self.s) or {}
        return self._mate

    def semicolon(self, i: int) -> int:
        """The next semicolon outside brackets, or -1."""
        while True:
            m = STOP.search(self.s, i)
            if m is None:
                return -1
            i = m.start()
            if self.s[i] == ";":
                return i
            if i not in self.mate:
                return -1
            i = self.mate[i] + 1

    def once(self, rule, i: int, *args) -> int:
        key = (rule.__name__, i, *args)
        if key not in self.memo:
            self.memo[key] = rule(i, *args)
        return self.memo[key]

    # Expressions

    def expression(self, i: int, angle: bool = False) -> int:
        i = self.assignment(i, angle)
        while i > 0 and self.s[i] == ",":
            i = self.assignment(i + 1, angle)
        return i

    def assignment(self, i: int, angle: bool = False) -> int:
        return self.once(self._assignment, i, angle)

    def _assignment(self, i: int, angle: bool) -> int:
        s = self.s
        if self.cpp and s[i] == "w":
            j = self.assignment(i + 1, angle)
            return j if j > 0 else i + 1
        if self.cpp and s[i] == "k":
            return self.assignment(i + 1, angle)
        if not self.cpp:  # what is assigned to must be a unary expression
            j = self.unary(i)
            return self.assignment(j + 1) if j > 0 and s[j] in "=\x02" else self.conditional(i)
        j = self.conditional(i, angle)
        if j > 0 and s[j] in "=\x02":
            return self.braces(j + 1) if s[j + 1] == "{" else self.assignment(j + 1, angle)
        return j

    def conditional(self, i: int, angle: bool = False) -> int:
        j = self.binary(i, angle)
        if j > 0 and self.s[j] == "?":
            k = self.expression(j + 1)
            if k < 0 or self.s[k] != ":":
                return -1
            return self.assignment(k + 1, angle) if self.cpp else self.conditional(k + 1, angle)
        return j

    def binary(self, i: int, angle: bool = False) -> int:
        s = self.s
        i = self.unary(i)
        while i > 0:
            c = s[i]
            if c in "b*&+\x03<":
                i = self.unary(i + 1)
            elif c == ">" and not angle:
                i = self.unary(i + (2 if s[i + 1] == ">" else 1))
            else:
                break
        return i

    def unary(self, i: int) -> int:
        return self.once(self._unary, i)

    def _unary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "!+*&P":
            return self.unary(i + 1)
        if c == "(":
            t = self.type_id(i + 1)
            cast = -1
            if t > 0 and s[t] == ")":
                cast = self.postfix(self.braces(t + 1)) if s[t + 1] == "{" else self.unary(t + 1)
            return max(cast, self.postfix(self.primary(i)))
        if c == "Z":
            if s[i + 1] == "V":
                i += 1
            if s[i + 1] == "(":
                t = self.type_id(i + 2)
                whole = t + 1 if t > 0 and s[t] == ")" else -1
                return max(whole, self.unary(i + 1))
            return self.unary(i + 1)
        if self.cpp:
            if c == "e" or c == "\x04" and s[i + 1] == "e":
                return self.new(i + 1 if c == "e" else i + 2)
            if c == "d" or c == "\x04" and s[i + 1] == "d":
                i += 1 + (c == "\x04")
                return self.unary(i + 2 if s[i:i + 2] == "[]" else i)
            if c == "f" and s[i + 1] == "(":
                j = self.expression(i + 2)
                return j + 1 if j > 0 and s[j] == ")" else -1
            if c == "k":
                return self.unary(i + 1)
        return self.postfix(self.primary(i))

    def new(self, i: int) -> int:
        s = self.s
        best = -1
        starts = [i]
        if s[i] == "(" and (j := self.arguments(i)) > 0:  # placement
            starts.append(j)
        for a in starts:
            if s[a] == "(":
                j = self.type_id(a + 1)
                j = j + 1 if j > 0 and s[j] == ")" else -1
            else:
                j = self.specifiers(a)
                while j > 0 and s[j] in "*Q":
                    j += 1
                while j > 0 and s[j] == "[":
                    if s[j + 1] == "]":
                        j += 2
                        continue
                    j = self.expression(j + 1)
                    j = j + 1 if j > 0 and s[j] == "]" else -1
            if j > 0 and s[j] == "(":
                j = self.arguments(j)
            elif j > 0 and s[j] == "{":
                j = self.braces(j)
            best = max(best, j)
        return best

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "nc":
            return i + 1
        if c == "s":
            while s[i] == "s":
                i += 1
            return i
        if c == "(":
            j = self.expression(i + 1)
            return j + 1 if j > 0 and s[j] == ")" else -1
        if not self.cpp:
            if c == "i":
                return i + 1
            if c == "g" and s[i + 1] == "(":
                return self.mate.get(i + 1, -2) + 1 if self.generic(i + 1) else -1
            return -1
        if c in "i\x04":
            j = self.name(i, expression=True)
            return self.maybe_braces(j)
        if c == "T":
            j = i
            while s[j] == "T":
                j += 1
            return self.arguments(j) if s[j] == "(" else self.braces(j) if s[j] == "{" else -1
        if c == "y":
            j = self.name(i + 1)
            return (self.arguments(j) if s[j] == "(" else self.braces(j) if s[j] == "{" else -1) if j > 0 else -1
        if c == "x" and s[i + 1] == "<":
            j = self.type_id(i + 2)
            if j < 0 or s[j] != ">" or s[j + 1] != "(":
                return -1
            j = self.expression(j + 2)
            return j + 1 if j > 0 and s[j] == ")" else -1
        if c == "[":
            return self.closure(i)
        if c == "o":
            return self.operator_name(i)
        if c == "r":
            j = self.specifiers(i)
            return self.arguments(j) if j > 0 and s[j] == "(" else self.braces(j) if j > 0 and s[j] == "{" else j
        return -1

    def maybe_braces(self, j: int) -> int:
        if j > 0 and self.s[j] == "{":
            k = self.braces(j)
            return k if k > 0 else j
        return j

    def generic(self, i: int) -> bool:
        j = self.assignment(i + 1)
        s = self.s
        while j > 0 and s[j] == ",":
            k = j + 2 if s[j + 1] == "L" else self.type_id(j + 1)
            j = self.assignment(k + 1) if k > 0 and s[k] == ":" else -1
        return j > 0 and j == self.mate.get(i)

    def postfix(self, i: int) -> int:
        s = self.s
        while i > 0:
            c = s[i]
            if c == "(":
                i = self.arguments(i)
            elif c == "[":
                j = self.expression(i + 1) if not (self.cpp and s[i + 1] == "{") else self.braces(i + 1)
                i = j + 1 if j > 0 and s[j] == "]" else -1
            elif c in ".\x01":
                if self.cpp:
                    j = i + 1 + (s[i + 1] == "m")
                    i = j + 2 if s[j] == "!" and s[j + 1] == "i" else self.operator_name(j) if s[j] == "o" else self.name(j, expression=True)
                else:
                    i = i + 2 if s[i + 1] == "i" else -1
            elif c == "P":
                i += 1
            else:
                break
        return i

    def arguments(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == ")":
            return i + 1
        while True:
            i = self.braces(i) if self.cpp and s[i] == "{" else self.assignment(i)
            if i > 0 and self.cpp and s[i] == "V":
                i += 1
            if i < 0 or s[i] not in ",)":
                return -1
            i += 1
            if s[i - 1] == ")":
                return i

    def braces(self, i: int) -> int:
        """An initializer list."""
        return self.once(self._braces, i)

    def _braces(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == "}":
            return i + 1 if self.cpp else -1
        while True:
            designated = False
            while s[i] == "." and s[i + 1] == "i" or s[i] == "[" and not self.cpp:
                designated = True
                if s[i] == ".":
                    i += 2
                else:
                    i = self.conditional(i + 1)
                    if i < 0 or s[i] != "]":
                        return -1
                    i += 1
            if designated and not (self.cpp and s[i] == "{"):
                if s[i] != "=":
                    return -1
                i += 1
            i = self.braces(i) if s[i] == "{" else self.assignment(i)
            if i > 0 and self.cpp and s[i] == "V":
                i += 1
            if i < 0 or s[i] not in ",}":
                return -1
            i += 1
            if s[i - 1] == "}":
                return i
            if s[i] == "}":
                return i + 1

    def closure(self, i: int) -> int:
        """A lambda expression; its captures are taken as they are."""
        s = self.s
        if i not in self.mate:
            return -1
        inside = s[i + 1:self.mate[i]]
        if inside and not re.fullmatch(r"(?:[&=]|[*&]?(?:i|n)V?(?:=.+|\(.*\)|\{.*\})?)(?:,(?:[&=]|[*&]?(?:i|n)V?(?:=.+|\(.*\)|\{.*\})?))*", inside):
            return -1
        j = self.mate[i] + 1
        if s[j] == "<":
            j = self.angle(j)
            if j < 0:
                return -1
        if s[j] == "(":
            j = self.parameters(j)
            if j < 0:
                return -1
        while s[j] in "Gf":
            j = self.mate.get(j + 1, -2) + 1 if s[j] == "f" and s[j + 1] == "(" else j + 1
        if s[j] == "\x01":
            j = self.type_id(j + 1)
            if j < 0:
                return -1
        if s[j] != "{" or j not in self.mate:
            return -1
        end = self.mate[j]
        return end + 1 if self.body(s[j:end + 1]) else -1

    def body(self, s: str) -> bool:
        u = Unit(self.g, s)
        return u.mate is not None and u.block(0) == len(s)

    # Names and types

    def angle(self, i: int) -> int:
        """Template arguments or parameters in angle brackets."""
        return self.once(self._angle, i)

    def _angle(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == ">":
            return i + 1
        while True:
            best = -1
            for j in (self.type_id(i), self.parameter(i), self.conditional(i, True), self.template_parameter(i)):
                if j > 0 and s[j] == "V":
                    j += 1
                if j > 0 and s[j] in ",>" and j > best:
                    best = j
            if best < 0:
                return -1
            i = best + 1
            if s[best] == ">":
                return i

    def template_parameter(self, i: int) -> int:
        """typename T = int, class... T, template <...> class T"""
        s = self.s
        if s[i] == "m":
            j = self.angle(i + 1) if s[i + 1] == "<" else -1
            return self.template_parameter(j) if j > 0 else -1
        if s[i] not in "yS":
            return -1
        i += 1 + (s[i + 1] == "V")
        i += s[i] == "i"
        return self.type_id(i + 1) if s[i] == "=" else i

    def name(self, i: int, expression: bool = False) -> int:
        """A name, qualified and with template arguments if there are any."""
        return self.once(self._name, i, expression)

    def _name(self, i: int, expression: bool) -> int:
        s = self.s
        if s[i] == "\x04":
            i += 1
        while True:
            i += s[i] == "m"
            if s[i] == "o":
                return self.operator_name(i)
            if s[i] == "!" and s[i + 1] == "i":
                return i + 2
            if s[i] != "i":
                return -1
            i += 1
            if s[i] == "<":
                j = self.angle(i)
                # Within an expression the bracket opens arguments only if a call, a member or an end follows.
                if j > 0 and (not expression or s[j] in "(\x04{),;}\x05].>="):
                    i = j
            if s[i] != "\x04":
                return i
            i += 1

    def operator_name(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i:i + 2] in ("()", "[]"):
            return i + 2
        if s[i] in "ed":
            i += 1
            return i + 2 if s[i:i + 2] == "[]" else i
        if s[i] == "s":
            return i + 2 if s[i + 1] == "i" else i + 1
        if s[i] in "b*&+\x03<>=\x02!P,\x01":
            return i + 2 if s[i:i + 2] == ">>" else i + 1
        return self.type_id(i)

    def specifiers(self, i: int) -> int:
        """Declaration specifiers: at most one type by name, or keywords."""
        return self.once(self._specifiers, i)

    def _specifiers(self, i: int) -> int:
        s = self.s
        start, typed = i, False
        while True:
            c = s[i]
            if c in "GQ":
                i += 1
                if c == "G" and self.cpp and s[i] == "(":  # explicit(...)
                    i = self.arguments(i)
                    if i < 0:
                        return -1
            elif c == "T":
                if typed == "name":
                    return -1
                typed = "kind"
                i += 1
            elif c == "l" and s[i + 1] == "(":
                t = self.type_id(i + 2)
                e = self.conditional(i + 2)
                j = max(t, e)
                if j < 0 or s[j] != ")":
                    return -1
                i = j + 1
            elif typed:
                break
            elif c == "A" and self.cpp:
                typed = "name"
                i += 1
            elif c == "S":
                i = self.record(i)
                typed = "name"
            elif c == "N":
                i = self.enumeration(i)
                typed = "name"
            elif c == "r" and s[i + 1] == "(":
                j = i + 3 if s[i + 2] == "A" else self.expression(i + 2)
                i = j + 1 if j > 0 and s[j] == ")" else -1
                typed = "name"
            elif c == "y" and self.cpp:
                i = self.name(i + 1)
                typed = "name"
            elif c == "i" or self.cpp and c == "\x04":
                j = self.name(i) if self.cpp else i + 1
                if j > 0 and self.cpp and s[j] == "A":  # a constrained auto
                    j += 1
                i = j
                typed = "name"
            else:
                break
            if i < 0:
                return -1
        return i if i > start and typed else -1

    def record(self, i: int) -> int:
        s = self.s
        i += 1
        named = False
        if s[i] == "l" and s[i + 1] == "(":
            i = self.mate.get(i + 1, -2) + 1
        if s[i] in "i\x04":
            i = self.name(i) if self.cpp else i + 1
            named = True
            if i > 0 and self.cpp and s[i] == "i" and s[i + 1] in "{:":  # final
                i += 1
        if i > 0 and self.cpp and s[i] == ":" and s[i + 1] != ":":
            i += 1
            while True:
                while s[i] in "aG":
                    i += 1
                i = self.name(i)
                if i < 0:
                    return -1
                if s[i] != ",":
                    break
                i += 1
        if i < 0 or s[i] != "{":
            return i if named else -1
        if i not in self.mate:
            return -1
        end = self.mate[i]
        inside = s[i + 1:end]
        if self.cpp:
            u = Unit(self.g, inside)
            return end + 1 if u.mate is not None and u.members(0, len(inside)) == len(inside) + 1 else -1
        at = 0
        while at < len(inside):
            part = Leaf(self.g, inside)
            e = part.semicolon(at)
            if e < 0:
                return -1
            if e == at or not Leaf(self.g, inside[at:e]).declaration(0, member=True):
                return -1
            at = e + 1
        return end + 1 if inside else -1

    def enumeration(self, i: int) -> int:
        s = self.s
        i += 1
        i += self.cpp and s[i] == "S"
        named = s[i] == "i"
        if named:
            i = self.name(i) if self.cpp else i + 1
        if self.cpp and s[i] == ":":
            i = self.specifiers(i + 1)
        if i < 0 or s[i] != "{":
            return i if named else -1
        i += 1
        if self.cpp and s[i] == "}":
            return i + 1
        while True:
            if s[i] != "i":
                return -1
            i += 1
            if s[i] == "=":
                i = self.conditional(i + 1)
                if i < 0:
                    return -1
            if s[i] not in ",}":
                return -1
            i += 1
            if s[i - 1] == "}":
                return i
            if s[i] == "}":
                return i + 1

    def type_id(self, i: int) -> int:
        return self.once(self._type_id, i)

    def _type_id(self, i: int) -> int:
        j = self.specifiers(i)
        return self.declarator(j, "abstract") if j > 0 else -1

    def declarator(self, i: int, kind: str, call: bool = True) -> int:
        """``kind``: named, abstract or either; without ``call`` no parameter list is read."""
        return self.once(self._declarator, i, kind, call)

    def _declarator(self, i: int, kind: str, call: bool) -> int:
        s = self.s
        while True:
            if s[i] == "*" or self.cpp and s[i] in "&\x03":
                i += 1
                while s[i] == "Q":
                    i += 1
            elif self.cpp and s[i] in "i\x04" and (m := re.compile(r"\x04?(?:i\x04)+\*").match(s, i)):
                i = m.end()
            else:
                break
        c = s[i]
        if self.cpp and c == "V" and kind != "named":
            i += 1
            c = s[i]
        if c == "i" or self.cpp and c in "\x04o!":
            if kind == "abstract":
                return i
            i = self.name(i) if self.cpp else i + 1
            if i < 0:
                return -1
        elif c == "(" and (inner := self.nested(i, kind)) > 0:
            i = inner
        elif kind == "named":
            return -1
        while True:
            if s[i] == "[":
                j = i + 1
                while s[j] in "GQ":
                    j += 1
                if s[j] == "*" and s[j + 1] == "]":
                    j += 1
                elif s[j] != "]":
                    j = self.conditional(j) if not self.cpp else self.expression(j)
                if j < 0 or s[j] != "]":
                    # In C++ an attribute or a closure cannot follow here either.
                    return -1 if kind != "abstract" else i
                i = j + 1
            elif s[i] == "(" and call:
                j = self.parameters(i)
                if j < 0:
                    return i
                i = j
                if self.cpp:
                    i = self.after_parameters(i)
                    if i < 0:
                        return -1
            else:
                return i

    def nested(self, i: int, kind: str) -> int:
        """A declarator in parentheses; an abstract one must not be empty or a parameter list."""
        s = self.s
        if kind != "named" and s[i + 1] not in "*([&\x03" and not (kind == "either" and s[i + 1] == "i" and self.specifiers(i + 1) != i + 2):
            if not (kind == "either" and s[i + 1] == "i" and s[i + 2] in ")["):
                return -1
        j = self.declarator(i + 1, kind)
        return j + 1 if j > i + 1 and s[j] == ")" else -1

    def after_parameters(self, i: int) -> int:
        """const, &, noexcept, -> type, override and the like."""
        s = self.s
        while True:
            if s[i] in "Q&\x03":
                i += 1
            elif s[i] == "f":
                i = self.arguments(i + 1) if s[i + 1] == "(" else i + 1
            elif s[i] == "w" and s[i + 1] == "(":
                i = self.arguments(i + 1)
            elif s[i] == "\x01":
                i = self.type_id(i + 1)
            elif s[i] == "i" and s[i + 1] in "{;\x05i=":
                i += 1
            else:
                return i
            if i < 0:
                return -1

    def parameters(self, i: int) -> int:
        return self.once(self._parameters, i)

    def _parameters(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == ")":
            return i + 1
        while True:
            if s[i] == "V":
                return i + 2 if s[i + 1] == ")" else -1
            i = self.parameter(i)
            if i > 0 and self.cpp and s[i] == "V" and s[i + 1] == ")":
                i += 1
            if i < 0 or s[i] not in ",)":
                return -1
            i += 1
            if s[i - 1] == ")":
                return i

    def parameter(self, i: int) -> int:
        s = self.s
        j = self.specifiers(i)
        if j < 0:
            return -1
        best = max(self.declarator(j, "either"), self.declarator(j, "abstract"))
        if best > 0 and self.cpp and s[best] == "=":
            return self.braces(best + 1) if s[best + 1] == "{" else self.assignment(best + 1)
        return best

    # Declarations

    def declaration(self, i: int, member: bool = False, condition: bool = False) -> bool:
        """Whether the rest from ``i`` is a declaration without its semicolon."""
        s = self.s
        if self.cpp and s[i] == "u":
            return self.using(i)
        if self.cpp and s[i] == "A" or self.cpp and s[i] in "QG":
            j = i
            while s[j] in "QG":
                j += 1
            if s[j] == "A":  # a structured binding
                j += 1
                while s[j] in "&\x03":
                    j += 1
                if s[j] == "[" and (m := re.compile(r"\[i(?:,i)*\]").match(s, j)):
                    j = m.end()
                    k = self.assignment(j + 1) if s[j] == "=" else self.braces(j) if s[j] == "{" else self.arguments(j) if s[j] == "(" else -1
                    return k == self.n
        j = self.specifiers(i)
        if j > 0:
            if j == self.n:
                return not condition
            if self.declarators(j, member, condition):
                return True
        if self.cpp and not condition:  # constructors, destructors and conversions have no type
            j = i
            while s[j] in "GQ":
                j += 1
            k = self.declarator(j, "named")
            if k > 0:
                k = self.pure(k)
            return k == self.n and ")" in s[i:k]
        return False

    def pure(self, k: int) -> int:
        """= 0, = default or = delete."""
        s = self.s
        return k + 2 if s[k] == "=" and s[k + 1] in "nLd" else k

    def using(self, i: int) -> bool:
        s = self.s
        if s[i + 1] == "p":
            return self.name(i + 2) == self.n
        if s[i + 1] == "i" and s[i + 2] == "=":
            return self.type_id(i + 3) == self.n
        return self.name(i + 1 + (s[i + 1] in "yN")) == self.n

    def declarators(self, i: int, member: bool, condition: bool) -> bool:
        s = self.s
        for j in self.initialized(i, member):
            if j == self.n:
                return True
            if s[j] == "," and not condition and self.declarators(j + 1, member, condition):
                return True
        return False

    def initialized(self, i: int, member: bool) -> list[int]:
        """Where a declarator with its initializer can end."""
        s = self.s
        out = []
        j = self.declarator(i, "named")
        if (member or self.cpp) and s[i] == ":" and s[i + 1] != ":":
            out.append(self.conditional(i + 1))
        if j > 0:
            if (member or self.cpp) and s[j] == ":":
                out.append(self.conditional(j + 1))
            elif s[j] == "=" and not (member and not self.cpp):
                out.append(self.braces(j + 1) if s[j + 1] == "{" else self.assignment(j + 1))
                if self.cpp:
                    out.append(self.pure(j))
            elif self.cpp and s[j] == "{":
                out.append(self.braces(j))
            else:
                out.append(j)
        if self.cpp:
            k = self.declarator(i, "named", False)
            if k > 0 and s[k] == "(":
                out.append(self.arguments(k))
        return sorted({x for x in out if x > 0}, reverse=True)

    def range_for(self, i: int) -> bool:
        s = self.s
        j = self.specifiers(i)
        if j < 0:
            return False
        k = self.declarator(j, "named")
        if s[j] in "&\x03[" and k < 0:
            while s[j] in "&\x03":
                j += 1
            m = re.compile(r"\[i(?:,i)*\]").match(s, j)
            k = m.end() if m else -1
        if k < 0 or s[k] != ":":
            return False
        e = self.braces(k + 1) if s[k + 1] == "{" else self.expression(k + 1)
        return e == self.n

    def function_head(self, i: int) -> int:
        """Everything of a function definition before its body."""
        s = self.s
        if not self.cpp:
            j = self.specifiers(i)
            k = self.declarator(j, "named") if j > 0 else -1
            if k < 0:
                k = self.declarator(i, "named") if s[i] == "i" and s[i + 1] == "(" else -1
            return k if k == self.n and s[k - 1] == ")" and self.calls(i if j < 0 else j) else -1
        starts = []
        j = self.specifiers(i)
        if j > 0:
            starts.append(j)
        j = i
        while s[j] in "GQ":
            j += 1
        starts.append(j)
        for j in starts:
            k = self.declarator(j, "named")
            if k > 0 and k < self.n and s[k] == ":":
                k = self.member_initializers(k + 1)
            if k == self.n and "(" in s[j:k]:
                return k
        return -1

    def calls(self, i: int) -> bool:
        """Whether a declarator at ``i`` declares a function: its name is followed by parameters."""
        s = self.s
        while s[i] in "*Q":
            i += 1
        if s[i] == "(":
            return True
        return s[i] == "i" and s[i + 1] == "(" and self.mate.get(i + 1) is not None

    def member_initializers(self, i: int) -> int:
        s = self.s
        while True:
            i = self.name(i)
            if i < 0:
                return -1
            i = self.arguments(i) if s[i] == "(" else self.braces(i) if s[i] == "{" else -1
            if i > 0 and s[i] == "V":
                i += 1
            if i < 0 or s[i] != ",":
                return i
            i += 1
