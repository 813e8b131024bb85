"""A small sandboxed template language for conversations, compiled to Python closures.

Text stands for itself. ``{{ value }}`` writes a value, ``{% ... %}`` holds a
statement, ``{# ... #}`` a comment; a ``-`` beside a percent sign or brace
strips the white space next to it. Statements: ``for x in xs`` / ``endfor``,
``if`` / ``elif`` / ``else`` / ``endif``, ``set x = value`` and ``generation``
/ ``endgeneration``, which marks what a model is to learn. Values: strings,
whole numbers, true, false, none, names, members of mappings (``a.b``,
``a['b']``), ``+``, ``~`` (joins as text), comparisons, ``in``, ``not``,
``and``, ``or``, ``x if c else y``, brackets and filters (``x | name``).

The sandbox: templates reach nothing but the mappings and strings they are
given and the filters of ``FILTERS``. There are no calls and no attributes of
Python objects.

The main loop goes over ``messages``. It is run one message at a time, so a
conversation of any length needs no more memory than its longest message. What
stands before the loop is written with the first message, what stands behind
it with the last.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(
    r"\s*(?:(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<sign>==|!=|<=|>=|[<>+~|.\[\]()=]))",
    re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


# Control strings of texts. A backslash goes behind their first character (before a single one), and
# before each backslash, so an escaped text contains no control string and can be read back.
CONTROLS = ("<turn>", "</turn>")


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _text(value: Any) -> str:
    return "" if value is None else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "escape_line": lambda v: escape_line(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v or ""),
}


# Syntax tree


@dataclass
class Literal:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Member:
    of: Any
    key: Any


@dataclass
class Filter:
    of: Any
    name: str


@dataclass
class Operation:
    sign: str
    parts: list


@dataclass
class Write:
    value: Any


@dataclass
class Assign:
    name: str
    value: Any


@dataclass
class Branch:
    cases: list  # (condition, body)


@dataclass
class Loop:
    name: str
    over: Any
    body: list


@dataclass
class Generation:
    body: list


class _Values:
    """Recursive descent over the words of one tag."""

    def __init__(self, source: str):
        self.words: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self, *signs: str) -> bool:
        return bool(self.words) and self.words[0][0] != "string" and self.words[0][1] in signs

    def take(self, *signs: str) -> str | None:
        return self.words.pop(0)[1] if self.peek(*signs) else None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} expected at {self.words[:3]}")

    def name(self) -> str:
        if not self.words or self.words[0][0] != "name":
            raise TemplateError("a name is missing")
        return self.words.pop(0)[1]

    def end(self) -> None:
        if self.words:
            raise TemplateError(f"unexpected {self.words[0][1]!r}")

    def value(self):
        then = self.either()
        if self.take("if"):
            condition = self.either()
            other = self.value() if self.take("else") else Literal(None)
            return Operation("?", [condition, then, other])
        return then

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Operation("or", [left, self.both()])
        return left

    def both(self):
        left = self.negation()
        while self.take("and"):
            left = Operation("and", [left, self.negation()])
        return left

    def negation(self):
        return Operation("not", [self.negation()]) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        while sign := self.take("==", "!=", "<=", ">=", "<", ">", "in", "not"):
            if sign == "not":
                self.need("in")
                left = Operation("not", [Operation("in", [left, self.sum()])])
            else:
                left = Operation(sign, [left, self.sum()])
        return left

    def sum(self):
        left = self.filtered()
        while sign := self.take("+", "~"):
            left = Operation(sign, [left, self.filtered()])
        return left

    def filtered(self):
        value = self.member()
        while self.take("|"):
            value = Filter(value, self.name())
        return value

    def member(self):
        value = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                value = Member(value, Literal(self.name()))
            else:
                value = Member(value, self.value())
                self.need("]")
        return value

    def atom(self):
        if self.take("("):
            value = self.value()
            self.need(")")
            return value
        if not self.words:
            raise TemplateError("a value is missing")
        kind, word = self.words.pop(0)
        if kind == "string":
            return Literal(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Literal(int(word))
        if kind == "name":
            return Literal(_CONSTANTS[word]) if word in _CONSTANTS else Name(word)
        raise TemplateError(f"unexpected {word!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts = _TAG.split(source)
    for i in range(1, len(parts), 2):
        tag = parts[i]
        if tag[2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if tag[-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    body, rest = _body([p for p in parts if p and not p.startswith("{#")], ())
    if rest:
        raise TemplateError(f"unexpected {rest[0]}")
    return body


def _body(parts: list[str], ends: tuple[str, ...]) -> tuple[list, list[str]]:
    out: list = []
    while parts:
        part, parts = parts[0], parts[1:]
        if part.startswith("{{"):
            words = _Values(part[2:-2].strip("-"))
            out.append(Write(words.value()))
            words.end()
        elif part.startswith("{%"):
            words = _Values(part[2:-2].strip("-"))
            word = words.name()
            if word in ends:
                return out, [part, *parts]
            made, parts = _statement(word, words, parts)
            out.append(made)
        else:
            out.append(Write(Literal(part)))
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return out, []


def _closing(parts: list[str]) -> tuple[str, _Values, list[str]]:
    words = _Values(parts[0][2:-2].strip("-"))
    return words.name(), words, parts[1:]


def _statement(word: str, words: _Values, parts: list[str]):
    if word == "set":
        name = words.name()
        words.need("=")
        made = Assign(name, words.value())
    elif word == "for":
        name = words.name()
        words.need("in")
        over = words.value()
        body, parts = _body(parts, ("endfor",))
        parts = _closing(parts)[2]
        made = Loop(name, over, body)
    elif word == "generation":
        body, parts = _body(parts, ("endgeneration",))
        parts = _closing(parts)[2]
        made = Generation(body)
    elif word == "if":
        cases, condition = [], words.value()
        while True:
            body, parts = _body(parts, ("elif", "else", "endif"))
            cases.append((condition, body))
            end, more, parts = _closing(parts)
            if end == "endif":
                break
            condition = more.value() if end == "elif" else Literal(True)
        made = Branch(cases)
    else:
        raise TemplateError(f"unknown statement {word!r}")
    words.end()
    return made, parts


# Constant folding


def fold(node):
    """The node with every constant part computed; never changes what is written."""
    if isinstance(node, list):
        out: list = []
        for made in (fold(n) for n in node):
            if isinstance(made, Branch) and not made.cases:
                continue
            if isinstance(made, Branch) and isinstance(made.cases[0][0], Literal):
                out.extend(made.cases[0][1])
            else:
                out.append(made)
        merged: list = []
        for made in out:
            if isinstance(made, Write) and isinstance(made.value, Literal) and merged:
                last = merged[-1]
                if isinstance(last, Write) and isinstance(last.value, Literal):
                    merged[-1] = Write(Literal(_text(last.value.value) + _text(made.value.value)))
                    continue
            merged.append(made)
        return merged
    if isinstance(node, Write):
        return Write(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Branch):
        cases = [(fold(c), fold(b)) for c, b in node.cases]
        cases = [(c, b) for c, b in cases if not (isinstance(c, Literal) and not c.value)]
        for i, (c, _) in enumerate(cases):
            if isinstance(c, Literal):
                return Branch(cases[: i + 1])
        return Branch(cases)
    if isinstance(node, Filter):
        made = Filter(fold(node.of), node.name)
        return Literal(value(made)({})) if isinstance(made.of, Literal) else made
    if isinstance(node, Member):
        return Member(fold(node.of), fold(node.key))
    if isinstance(node, Operation):
        made = Operation(node.sign, [fold(p) for p in node.parts])
        return Literal(value(made)({})) if all(isinstance(p, Literal) for p in made.parts) else made
    return node


# Closures


def value(node) -> Callable[[dict], Any]:
    """A closure that computes a value from the names in scope."""
    if isinstance(node, Literal):
        constant = node.value
        return lambda scope: constant
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Member):
        of, key = value(node.of), value(node.key)

        def member(scope):
            owner = of(scope)
            return owner.get(key(scope)) if type(owner) is dict else None

        return member
    if isinstance(node, Filter):
        if node.name not in FILTERS:
            raise TemplateError(f"unknown filter {node.name!r}")
        apply, of = FILTERS[node.name], value(node.of)
        return lambda scope: apply(of(scope))
    parts = [value(p) for p in node.parts]
    a, b = parts[0], parts[1] if len(parts) > 1 else None
    return {
        "or": lambda s: a(s) or b(s),
        "and": lambda s: a(s) and b(s),
        "not": lambda s: not a(s),
        "==": lambda s: a(s) == b(s),
        "!=": lambda s: a(s) != b(s),
        "<": lambda s: a(s) < b(s),
        ">": lambda s: a(s) > b(s),
        "<=": lambda s: a(s) <= b(s),
        ">=": lambda s: a(s) >= b(s),
        "in": lambda s: a(s) in (b(s) or ()),
        "+": lambda s: a(s) + b(s),
        "~": lambda s: _text(a(s)) + _text(b(s)),
        "?": lambda s: b(s) if a(s) else parts[2](s),
    }[node.sign]


@dataclass
class Output:
    """Text written so far and the spans (code points) inside generation blocks."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def action(node) -> Callable[[Output, dict], None]:
    if isinstance(node, list):
        steps = [action(n) for n in node]

        def every(out, scope):
            for step in steps:
                step(out, scope)

        return every
    if isinstance(node, Write):
        if isinstance(node.value, Literal):
            constant = _text(node.value.value)
            return lambda out, scope: out.write(constant)
        read = value(node.value)
        return lambda out, scope: out.write(_text(read(scope)))
    if isinstance(node, Assign):
        name, read = node.name, value(node.value)
        return lambda out, scope: scope.__setitem__(name, read(scope))
    if isinstance(node, Generation):
        inner = action(node.body)

        def generation(out, scope):
            start = out.length
            inner(out, scope)
            out.spans.append((start, out.length))

        return generation
    if isinstance(node, Branch):
        cases = [(value(c), action(b)) for c, b in node.cases]

        def branch(out, scope):
            for condition, body in cases:
                if condition(scope):
                    body(out, scope)
                    return

        return branch
    name, over, body = node.name, value(node.over), action(node.body)

    def loop(out, scope):
        for item in over(scope) or ():
            body(out, {**scope, name: item})

    return loop


class Template:
    """A compiled template: ``render`` writes a conversation message by message."""

    def __init__(self, source: str):
        tree = fold(parse(source))
        main = [i for i, n in enumerate(tree) if isinstance(n, Loop) and n.over == Name("messages")]
        if len(main) != 1:
            raise TemplateError("one loop over messages is needed, outside all other statements")
        self.name = tree[main[0]].name
        self.before, self.body, self.after = (
            action(tree[: main[0]]),
            action(tree[main[0]].body),
            action(tree[main[0] + 1 :]),
        )

    def render(self, messages: Iterator[dict], names: dict | None = None) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """For each message its piece of the text and the spans of the piece to learn from.

        Inside the loop ``loop.index``, ``loop.index0``, ``loop.first`` and
        ``loop.last`` tell the place; one message is read ahead for the last.
        """
        scope, ahead = dict(names or {}), next(messages, None)
        index = 0
        while ahead is not None:
            message, ahead = ahead, next(messages, None)
            out = Output()
            if index == 0:
                self.before(out, scope)
            place = {"index": index + 1, "index0": index, "first": index == 0, "last": ahead is None}
            self.body(out, {**scope, self.name: message, "loop": place})
            if ahead is None:
                self.after(out, scope)
            yield "".join(out.parts), out.spans
            index += 1
