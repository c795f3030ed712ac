"""Names and the literals assigned to them, in source and configuration of any common syntax.

One pass over a text, which stops at characters that mean something: quotes, comments, brackets, tags, operators. What is in a
string or a comment assigns nothing. An operator takes the name before it and the expression after it; the expression is
read once and the pass goes on behind it, so time grows with the text alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

#: Characters of a joined value that are counted as they are; longer values' counts are scaled down to this.
MOST_COUNTED = 1e12
#: Characters kept of a value's ends, in which words that span two parts are found.
EDGE = 24
#: What a literal holds that isn't its own: places filled in at run time, and the frames of keys.
_FILLED = re.compile(r"[$#]?\{\{?[^{}\n]*+\}\}?|\$[A-Za-z_]\w*+|%\([^()\n]*+\)s|-----[A-Z ]++-----")

# Syntax of common languages.
_SPECIAL = re.compile(r"""["'`{}()\[\],;\n=:<>]|/[/*]|\#|--""")
_OPERATOR = re.compile(r"===?|=>|=~|:=|::|[=:]")
_NOT_ASSIGNING = frozenset(["==", "===", "=~", "::"])
_COMPARING = frozenset("=!<>*/%^~&|")
_NAME_REVERSED = re.compile(r"[\w.$@\-]*[A-Za-z_$@]")
_STRING_BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+", re.S) for q in "\"'"}
_TRIPLE_BODY = {q: re.compile(rf"(?:[^{q}\\]|\\.|{q}(?!{q}{q}))*+", re.S) for q in "\"'"}
_BACKTICK_BODY = re.compile(r"(?:[^`\\]|\\.)*+", re.S)
_PREFIX = re.compile(r"(?:[rbfuRBFU]{1,2}|@|\$)(?=[\"'`])")
_PREFIXES = frozenset("rbfuRBFU@$")
_SPACE, _ANY_SPACE = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)*+"), re.compile(r"(?:\s|\\\n)*+")
_BARE = re.compile(r"(?:[A-Za-z0-9+/_.~@!%^*$:=-]|&(?![\w.\-]++=))++")
_REFERENCE = re.compile(r"\$?\{?([A-Za-z_][\w.]*+)\}?|\$\(([A-Za-z_]\w*+)\)|%([A-Za-z_]\w*+)%")
_INTERPOLATED = re.compile(r"[$#]?\{\{?\s*+([A-Za-z_][\w.]*+)\s*+\}\}?|\$([A-Za-z_]\w*+)")
_HEREDOC = re.compile(r"<<<?[-~]?(['\"]?)([A-Za-z_]\w*+)\1")
_INDENT, _FUNCTION = re.compile(r"[ \t]*+"), re.compile(r"[ \t]*+(?:async[ \t]++)?(?:def|class)\b")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:[rbfuRBFU]{1,2})\Z")
_TYPED_REVERSED = re.compile(r"[ \t]++")
_OPENING = {"}": "{", "]": "[", ")": "("}
_LONE_WORD = re.compile(r"^[ \t]*+([A-Za-z_]\w*+)[;,)]*+[ \t]*+$", re.M)
_BLOCK = re.compile(r"[ \t]*+[>|][+-]?\d?[+-]?[ \t]*+(?:#[^\n]*+)?\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)(\n|\Z)")
_JOIN = re.compile(r"\+|\.\.?(?=\s*+[\"'`$A-Za-z_(])|\|\||\?\?|or\b|~|&(?=\s)")
#: Signs and ends of lines that a bare value surely ends at.
_AFTER_BARE = frozenset(["&", "\n", ";", ",", "}", ")", ""])
_BEFORE_JOIN = frozenset(" \t\\|?")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]*+)</\1\s*+>")
_OPENED = re.compile(r"<[A-Za-z_][\w.:-]*+(?=[\s/>])")
#: Last words of functions whose second argument stands in for what the first one names.
_GETTERS = frozenset("get getenv env environ fetch setdefault getproperty getordefault default lookup option".split())
#: Of functions that give back what they are given, in another form.
_WRAPPERS = frozenset("base64 b64decode b64encode decode encode decode64 encode64 secretstr str string bytes bytearray buffer from unhexlify fromhex hex text literal secret sensitive trim".split())
_LABELS = frozenset("name key id".split())
#: Lines and forms that assign without an operator.
_DEFINE = re.compile(r"#[ \t]*+define[ \t]++([A-Za-z_]\w*+)[ \t]++")
_ENV = re.compile(r"[ \t]*+(?:ENV|ARG|setenv)[ \t]++([A-Za-z_]\w*+)[ \t]++(?=[^\s=])")
_LISP = re.compile(r"\((?:def|define|defconst|defonce|defparameter|defvar|setq|set!)[ \t]++([A-Za-z*_][^\s()\"';]*+)\s++")
_ARROW = re.compile(r"<<?-(?=[ \t\"'])")
_BREAK = re.compile(r"[ \t]*+\r?\n[ \t]++(?=[(\"'`]|[rbfuRBFU]{1,2}[\"'])")
#: Methods called on what is known, and elements of it.
_METHODS = re.compile(r"(?:\.[A-Za-z_]\w*+\([^()\n]{0,200}\))++")
_ELEMENT_OF = re.compile(r"([A-Za-z_]\w*+)\[(\d++)\]")
_USER_INFO = re.compile(r"://[^\s/:@\"'`<>]*+:([^\s/@\"'`<>]++)@(?=[\w.-])")
_TYPE_NAMES = frozenset("string str char text varchar bytes".split())
_QUOTED_NEXT = re.compile(r"\s*+[rbfuRBFU]{0,2}[\"'`]")
_CHAINED = re.compile(r"[ \t]*+[=:](?![=>])")
_WORD = re.compile(r"[A-Za-z_$][\w.$]*+")
#: Words that say that a literal stands for one still to come, or is none.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "todo", "none", "null", "xxxx", "****", "redacted", "secret]")


class Value:
    """A literal's place or two joined values. Equal parts of a text are one value, however often they are joined."""

    __slots__ = ("span", "parts", "quoted", "seen", "_counts", "_ends", "_has")

    def __init__(self, span: tuple[int, int] | None, parts: tuple[Value, Value] | None = None, quoted: bool = True):
        self.span, self.parts, self.quoted, self.seen, self._counts, self._ends, self._has = span, parts, quoted, False, None, None, None

    def counts(self, text: str) -> Counter[str]:
        """How often each character is in it, as far as it isn't filled in at run time."""
        if self._counts is None:
            if self.span:
                own = text[slice(*self.span)]
                self._counts = Counter(_FILLED.sub("", own) if self.quoted else own)
            else:
                a, b = (p.counts(text) for p in self.parts)
                total = a + b
                if (n := total.total()) > MOST_COUNTED:
                    total = Counter({c: k * MOST_COUNTED / n for c, k in total.items()})
                self._counts = total
        return self._counts

    def ends(self, text: str) -> tuple[str, str, bool]:
        """First and last characters, and whether the first are all."""
        if self._ends is None:
            if self.span:
                a, b = self.span
                self._ends = (text[a : min(b, a + EDGE)], text[max(a, b - EDGE) : b], b - a <= EDGE)
            else:
                (a, b, short), (c, d, other) = (p.ends(text) for p in self.parts)
                self._ends = ((a + c)[:EDGE] if short else a, (b + d)[-EDGE:] if other else d, short and other and len(a) + len(c) <= EDGE)
        return self._ends

    def has(self, text: str, words: tuple[str, ...]) -> bool:
        """Whether one of some words of up to EDGE lower-case letters is in it."""
        if self._has is None:
            if self.span:
                where = text[slice(*self.span)]
            else:
                where = self.parts[0].ends(text)[1] + self.parts[1].ends(text)[0]
            low = where.lower()
            self._has = any(w in low for w in words) or bool(self.parts) and any(p.has(text, words) for p in self.parts)
        return self._has


def joined(a: Value | None, b: Value | None, text: str) -> Value | None:
    if a is None or b is None:
        return a or b
    value = Value(None, (a, b), a.quoted or b.quoted)
    value.counts(text), value.ends(text), value.has(text, PLACEHOLDERS)  # of parts that have theirs, so no chain of constants is walked
    return value


def places(value: Value) -> list[tuple[int, int]]:
    """Spans of the literals of a value that no earlier call gave."""
    out, todo = [], [value]
    while todo:
        if not (x := todo.pop()).seen:
            x.seen = True
            if x.span:
                out.append(x.span)
            else:
                todo += x.parts
    return out


class _Lexer:
    def __init__(self, text: str, emit: Callable[[str, Value], None]):
        self.text, self.emit = text, emit
        self.constants: dict[str, Value] = {}
        #: Open brackets: kind, names that a getter's default reaches, constants that a scope hides, and the name with the subscript.
        self.brackets: list[tuple[str, list[str], dict[str, Value | None], str | None]] = []
        #: Functions by indent, with the constants that they hide.
        self.indented: list[tuple[int, dict[str, Value | None]]] = []
        #: By kind of quote: up to where none is closed.
        self.dead: dict[str, int] = {}
        self.lone_words: dict[str, list[tuple[int, int]]] | None = None
        self.line = 0
        #: The bracket of a call that an expression ended at, and the names that a default in it reaches; likewise a name that is assigned in its turn.
        self.call: tuple[int, list[str]] | None = None
        self.chain: tuple[int, list[str]] | None = None
        self._hidden: dict[str, Value | None] | None = None
        #: The last run of characters of bare values: from any place in it on, it ends where it ended.
        self.bare_run = (0, 0)

    def bare_end(self, at: int) -> int:
        """Where the characters of a bare value end that begin at a place; each run is read once."""
        if not self.bare_run[0] <= at < self.bare_run[1]:
            m = _BARE.match(self.text, at)
            self.bare_run = (at, m.end() if m else at)
        return self.bare_run[1]

    # constants

    def _hide(self) -> dict[str, Value | None] | None:
        scope = next((b[2] for b in reversed(self.brackets) if b[0] == "{"), None)
        return scope if scope is not None else self.indented[-1][1] if self.indented else None

    def _set(self, name: str, value: Value | None) -> None:
        scope = self._hidden
        if scope is not None and name not in scope:
            scope[name] = self.constants.get(name)
        if value is None:
            self.constants.pop(name, None)
        else:
            self.constants[name] = value

    def _restore(self, hidden: dict[str, Value | None]) -> None:
        for name, value in hidden.items():
            if value is None:
                self.constants.pop(name, None)
            else:
                self.constants[name] = value
        self._hidden = self._hide()

    # strings

    def string(self, at: int) -> tuple[int, int, int] | None:
        """Start and end of what is in the quotes that open at a place, and the place behind them; None where they don't close."""
        text, q = self.text, self.text[at]
        if q != "`" and text.startswith(q * 3, at):
            if self.dead.get(q * 3, -1) < at:
                end = _TRIPLE_BODY[q].match(text, at + 3).end()
                if text.startswith(q * 3, end):
                    return at + 3, end, end + 3
                self.dead[q * 3] = len(text)
        if self.dead.get(q, -1) >= at:
            return None
        end = (_BACKTICK_BODY if q == "`" else _STRING_BODY[q]).match(text, at + 1).end()
        if text.startswith(q, end):
            return at + 1, end, end + 1
        self.dead[q] = end
        return None

    def heredoc(self, at: int) -> tuple[Value | None, int] | None:
        """The lines of a here-document that opens at a place, and the place behind it."""
        if not (m := _HEREDOC.match(self.text, at)):
            return None
        if self.lone_words is None:
            self.lone_words = {}
            for x in _LONE_WORD.finditer(self.text):
                self.lone_words.setdefault(x[1], []).append((x.start(), x.end()))
        ends = self.lone_words.get(m[2], [])
        k = bisect_left(ends, (m.end(), 0))
        if k == len(ends):
            return None
        begin = self.text.find("\n", m.end()) + 1  # there is one, before the line of the word
        return self._lines(begin, ends[k][0]), ends[k][1]

    def _lines(self, at: int, end: int) -> Value | None:
        value = None
        while at < end:
            m = _LINE.match(self.text, at, end)
            a, b = m.start(2), m.start(2) + len(m[2].rstrip())
            value = joined(value, Value((a, b)) if b > a else None, self.text)
            at = m.end()
        return value

    def block(self, at: int) -> tuple[Value | None, int] | None:
        """The lines of a block scalar whose sign stands at a place: those indented deeper than the line of its name."""
        if not (m := _BLOCK.match(self.text, at)):
            return None
        indent, begin, end = len(_LINE.match(self.text, self.line)[1]), m.end(), m.end()
        while end < len(self.text) and ((line := _LINE.match(self.text, end))[2].strip() == "" or len(line[1]) > indent):
            end = line.end()
        return self._lines(begin, end), end

    # expressions

    def expression(self, at: int, names: list[str], bare: bool) -> tuple[Value | None, int]:
        """The value of an expression, None where it isn't made of literals, and the place behind what was read."""
        text, value, depth, known, first = self.text, None, 0, True, True
        if bare and (end := self.bare_end(at)) > at and text[end : end + 1] in _AFTER_BARE and text[at] not in "$%@":
            return self.constants.get(text[at:end]) or Value((at, end), quoted=False), end
        while True:
            at = (_ANY_SPACE if depth else _SPACE).match(text, at).end()
            c = text[at : at + 1]
            if c == "(":
                depth, at = depth + 1, at + 1
                continue
            prefix = _PREFIX.match(text, at) if c in _PREFIXES else None
            quote = prefix.end() if prefix else at
            if text[quote : quote + 1] in ('"', "'", "`") and (found := self.string(quote)):
                a, b, at = found
                part = (self._lines(a, b) if text.find("\n", a, b) >= 0 else Value((a, b))) if b > a else None
                if part and text[quote] != "'" and ("{" in text[a:b] or "$" in text[a:b]):
                    for m in _INTERPOLATED.finditer(text, a, b):
                        part = joined(part, self.constants.get(m[1] or m[2]), text)
                value = joined(value, part, text)
                if m := _METHODS.match(text, at):
                    at = m.end()
            elif (m := _ELEMENT_OF.match(text, at)) and (known_value := self.constants.get(m[0])):
                value, at = joined(value, known_value, text), m.end()
            elif c == "<" and (found := self.heredoc(at)):
                part, at = found
                value = joined(value, part, text)
            elif (m := _REFERENCE.match(text, at)) and (known_value := self.constants.get(m[1] or m[2] or m[3])) and text[m.end() : m.end() + 1] not in ("(", "["):
                value, at = joined(value, known_value, text), m.end()
            elif (m := _WORD.match(text, at)) and (head := self.constants.get(m[0].partition(".")[0])) and (call := _METHODS.match(text, at + m[0].find("."))) and m[0].count(".") == 1:
                value, at = joined(value, head, text), call.end()
            elif (end := self.bare_end(at)) > at and (first or value) and (bare or text[end : end + 1] == "("):
                m, after = _BARE.match(text, at), text[end : end + 1]
                if first and _CHAINED.match(text, m.end()) and _WORD.fullmatch(m[0]):
                    self.chain = (at, names)
                    return None, at
                if after == "(":
                    last = m[0].rpartition(".")[2].rpartition(":")[2].replace("_", "").lower()
                    if last in _WRAPPERS and _QUOTED_NEXT.match(text, m.end() + 1):
                        depth, at = depth + 1, m.end() + 1
                        continue
                    self.call = (m.end(), names if last in _GETTERS else [])
                    return None, m.end()
                at = m.end()
                again = _JOIN.match(text, _SPACE.match(text, at).end()) if after in _BEFORE_JOIN else None
                if again and again[0] in ("||", "??", "or"):
                    known = value is not None
                elif after in ("[", "{") or not first:
                    return None, at
                else:
                    return Value(m.span(), quoted=False), at
            else:
                return (value if known or value else None), at
            first = False
            while depth and text[(end := _ANY_SPACE.match(text, at).end()) : end + 1] == ")":
                depth, at = depth - 1, end + 1
            end = (_ANY_SPACE if depth else _SPACE).match(text, at).end()
            if m := _JOIN.match(text, end):
                at = _ANY_SPACE.match(text, m.end()).end()
            elif value is not None and text[end : end + 1] in ('"', "'", "`"):
                at = end
            else:
                return value, at

    def assign(self, at: int, names: list[str], bare: bool, keeps_bare: bool = False, added: bool = False) -> int:
        if keeps_bare and (m := _BREAK.match(self.text, at)):
            at = m.end()
        value, end = self.expression(at, names, bare)
        if self.chain:  # the value is still to come
            return end
        if value is None and keeps_bare:
            self._elements(at, names[-1].lstrip("$@"))
        if value is not None:
            if added:
                value = joined(self.constants.get(names[-1].lstrip("$@")), value, self.text)
            for name in names:
                self.emit(name, value)
        if keeps_bare or (value is not None and value.quoted):
            for name in names:
                self._set(name.lstrip("$@"), value)
        return end

    def _elements(self, at: int, name: str) -> None:
        """Remember the literals of a list that opens at a place by their numbers, up to the first that is none."""
        at, n = _SPACE.match(self.text, at).end(), 0
        if self.text[at : at + 1] not in ("[", "{", "("):
            return
        at = _ANY_SPACE.match(self.text, at + 1).end()
        while self.text[at : at + 1] in ('"', "'") and (found := self.string(at)):
            a, b, at = found
            self._set(f"{name}[{n}]", Value((a, b)) if b > a else None)
            at = _ANY_SPACE.match(self.text, at).end()
            if self.text[at : at + 1] != ",":
                return
            n, at = n + 1, _ANY_SPACE.match(self.text, at + 1).end()

    def _line_form(self, at: int) -> int:
        """Behind what a line that starts at a place assigns without an operator."""
        if m := _ENV.match(self.text, at) or _DEFINE.match(self.text, at):
            return self.assign(m.end(), [m[1]], True, True)
        return at

    # the pass

    def run(self) -> None:
        text, at, last = self.text, 0, 0
        if _FUNCTION.match(text):
            self.indented.append((len(_INDENT.match(text)[0]), {}))
            self._hidden = self._hide()
        for m in _USER_INFO.finditer(text):
            self.emit("password", Value(m.span(1), quoted=False))
        last = at = self._line_form(0)
        #: hint: the string, or the name with a subscript, that ended last. label: what an open tag is named. named: the same of an object, with its depth and end.
        hint = label = None
        named: tuple[int, int, str] | None = None
        in_tag = False
        while m := _SPECIAL.search(text, at):
            i, c = m.start(), m[0]
            at = i + len(c)
            if c in "=:":
                op = _OPERATOR.match(text, i)[0]
                at, before = i + len(op), text[i - 1 : i]
                name = hint if hint and not text[last:i].strip() else self._name(last, i)
                hint, chain, self.chain = None, self.chain, None
                if op in _NOT_ASSIGNING or not name or before in _COMPARING or (op == ":" and text.startswith("//", at)):
                    last = at
                    continue
                names = chain[1] if chain and chain[0] == last else []
                names.append(name)
                if op == ":" and (found := self.block(at)):
                    value, at = found
                    for x in names if value is not None else ():
                        self.emit(x, value)
                    self.line = last = at
                    continue
                if in_tag and name.lower() in _LABELS:
                    start = _SPACE.match(text, at).end()
                    if text[start : start + 1] in ('"', "'") and (found := self.string(start)):
                        label = text[found[0] : found[1]]
                elif in_tag and label and name.lower() == "value":
                    names = [label]
                elif name.lower() in _LABELS:
                    start = _SPACE.match(text, at).end()
                    own = self.string(start) if text[start : start + 1] in ('"', "'") else _WORD.match(text, start)
                    a, b = own[:2] if isinstance(own, tuple) else own.span() if own else (0, 0)
                    named = (len(self.brackets), b, text[a:b]) if b > a else None
                elif name.lower() == "value" and named and named[0] == len(self.brackets) and text.count("\n", named[1], min(i, named[1] + 400)) <= 1 and i - named[1] < 400:
                    names, named = [named[2]], None
                last = at = max(at, self.assign(at, names, op != ":" or text[at : at + 1] in (" ", "\t", "$"), op != ":", before in ("+", ".")))
                continue
            if c == "\n":
                self.line = at
                if (after := self._line_form(at)) > at:
                    hint, last, at = None, after, after
                    continue
                hint = hint if self.brackets else None
                if self.indented and text[at : at + 1] not in ("\n", "\r", ""):
                    indent = len(_INDENT.match(text, at)[0])
                    while self.indented and indent <= self.indented[-1][0]:
                        self._restore(self.indented.pop()[1])
                if _FUNCTION.match(text, at):
                    self.indented.append((len(_INDENT.match(text, at)[0]), {}))
                    self._hidden = self._hide()
            elif c in "\"'`":
                if not (c == "'" and text[i - 1 : i].isalnum() and not _PREFIXED.search(text, max(0, i - 3), i)) and (found := self.string(i)):
                    hint, at = text[found[0] : found[1]], found[2]
            elif c in ("#", "--", "//", "/*"):
                at = self._after_comment(c, i, at)
            elif c == "<":
                if (m := _ARROW.match(text, i)) and (name := self._name(last, i)):
                    hint, last, at = None, m.end(), m.end()
                    last = at = max(at, self.assign(at, [name], False, True))
                    continue
                if text.startswith("<!--", i):
                    at = self._closed("-->", i, at)
                elif opened := _OPENED.match(text, i):
                    in_tag, label, at = True, None, opened.end()
                    if whole := _ELEMENT.match(text, i):
                        a, b = whole.span(2)
                        inner = text[a:b]
                        a, b = a + len(inner) - len(inner.lstrip()), b - (len(inner) - len(inner.rstrip()))
                        if b > a:
                            self.emit(whole[1], Value((a, b)))
                elif found := self.heredoc(i):
                    self.line = at = found[1]
            elif c == ">":
                in_tag = False
            elif c == "(" and (m := _LISP.match(text, i)):
                self.brackets.append((c, [], {}, None))
                hint = None
                at = max(at, self.assign(m.end(), [m[1]], False, True))
            elif c in "{[(":
                base = (hint if hint and not text[last:i].strip() else self._name(last, i)) if c == "[" else None
                self.brackets.append((c, self.call[1] if self.call and self.call[0] == i else [], {}, base))
                hint = None
                if c == "{":
                    self._hidden = self._hide()
            elif c in "}])":
                base = None
                if self.brackets and self.brackets[-1][0] == _OPENING[c]:
                    *_, hidden, base = self.brackets.pop()
                    named = None if named and named[0] > len(self.brackets) else named
                    if c == "}":
                        self._restore(hidden)
                inner = hint if hint and not text[last:i].strip() else None
                hint = ".".join(x for x in (base, inner) if x) or None if c == "]" else None
            elif c == "," and hint and not text[last:i].strip() and self.brackets and self.brackets[-1][0] == "(":
                at = max(at, self.assign(_ANY_SPACE.match(text, at).end(), [*self.brackets[-1][1], hint], False))
                hint = None
            else:
                hint = None
            last = at

    def _closed(self, sign: str, i: int, at: int) -> int:
        """The place behind a sign, or at where there is none."""
        if self.dead.get(sign, -1) < i:
            if (end := self.text.find(sign, at)) >= 0:
                return end + len(sign)
            self.dead[sign] = len(self.text)
        return at

    def _after_comment(self, c: str, i: int, at: int) -> int:
        if c == "/*":
            return self._closed("*/", i, at)
        before = self.text[i - 1 : i]
        if (before in ("", " ", "\t", "\n") or c == "//" and before in ";{}),") and (c != "--" or self.text[at : at + 1] in (" ", "\t")):
            end = self.text.find("\n", at)
            return len(self.text) if end < 0 else end
        return at

    def _name(self, last: int, i: int) -> str | None:
        """The name that ends at a place, in the gap since the last sign."""
        gap = self.text[last:i].rstrip(" \t?!+.")[::-1]
        m = _NAME_REVERSED.match(gap)
        if m and m[0][::-1].lower() in _TYPE_NAMES and (typed := _TYPED_REVERSED.match(gap, m.end())):
            m = _NAME_REVERSED.match(gap, typed.end()) or m
        return m[0][::-1].lstrip(".-") if m else None


def assignments(text: str, emit: Callable[[str, Value], None]) -> None:
    """Call emit with each name and value that are assigned in a text, in order; constants named before are put in their places."""
    _Lexer(text, emit).run()
