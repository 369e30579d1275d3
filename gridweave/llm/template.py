"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% for x in name %} … {% endfor %}   {% if … %} … {% elif … %} … {% else %} … {% endif %}
    {% set name = expression %}   {% generation %} … {% endgeneration %}   {# remark #}

Expressions know strings, whole numbers, names, ``a.b`` on plain mappings, ``+``,
``~``, ``==``, ``!=``, ``in``, ``not``, ``and``, ``or``, brackets and filters
``a | f``.  There are no calls, no indexing and no access to attributes of Python
objects; loops run over one given sequence, which may be an iterator.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[()+~.|]))")
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template's text is not in the language."""


# -- syntax tree ------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Out:
    of: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body)


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Words:
    def __init__(self, text: str):
        self.items, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:]!r}")
            self.items.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] != 2 else None

    def take(self, *words: str) -> str | None:
        if self.peek() in words and self.peek() is not None:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, kind: int) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != kind:
            raise TemplateError("an expression ends early or has an unexpected part")
        self.at += 1
        return self.items[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")


LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "in"), ("+", "~"))


def _expression(w: _Words, level: int = 0):
    if level == len(LEVELS):
        return _filtered(w)
    if level == 2:
        return Op("not", (_expression(w, level),)) if w.take("not") else _expression(w, level + 1)
    left = _expression(w, level + 1)
    while op := w.take(*LEVELS[level]):
        left = Op(op, (left, _expression(w, level + 1)))
    return left


def _filtered(w: _Words):
    if w.take("("):
        node = _expression(w)
        if not w.take(")"):
            raise TemplateError("a bracket is not closed")
    else:
        kind = w.items[w.at][0] if w.at < len(w.items) else 0
        text = w.need(kind if kind in (1, 2, 3) else 3)
        if kind == 1:
            node = Const(int(text))
        elif kind == 2:
            node = Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        else:
            node = Const({"true": True, "false": False}[text]) if text in ("true", "false") else Name(text)
    while True:
        if w.take("."):
            node = Member(node, w.need(3))
        elif w.take("|"):
            node = Filter(node, w.need(3))
        else:
            return node


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    items, at = [], 0
    for m in TAG.finditer(source):
        if m.start() > at:
            items.append(("text", source[at : m.start()]))
        if m[1] is not None:
            items.append(("out", m[1]))
        elif m[2] is not None:
            items.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        items.append(("text", source[at:]))
    stream = iter(items)

    def body(*until: str) -> tuple[tuple, str, str]:
        nodes = []
        for kind, text in stream:
            if kind == "text":
                nodes.append(Out(Const(text)))
            elif kind == "out":
                w = _Words(text)
                nodes.append(Out(_expression(w)))
                w.end()
            else:
                word, _, rest = text.partition(" ")
                if word in until:
                    return tuple(nodes), word, rest
                nodes.append(block(word, rest))
        if until:
            raise TemplateError(f"{' or '.join(until)} is missing")
        return tuple(nodes), "", ""

    def whole(text: str):
        w = _Words(text)
        node = _expression(w)
        w.end()
        return node

    def block(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest!r}")
            return For(m[1], whole(m[2]), body("endfor")[0])
        if word == "if":
            cases, end = [], "elif"
            while end == "elif":
                test = whole(rest)
                inner, end, rest = body("elif", "else", "endif")
                cases.append((test, inner))
            if end == "else":
                cases.append((Const(True), body("endif")[0]))
            return If(tuple(cases))
        if word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"set {rest!r}")
            return Set(m[1], whole(m[2]))
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return body()[0]


# -- folding --------------------------------------------------------------------------

Filters = Mapping[str, Callable[[str], str]]


def _text(x: object) -> str:
    return "" if x is None else str(x)


def _apply(op: str, args: list):
    if op == "not":
        return not args[0]
    a, b = args
    if op == "~":
        return _text(a) + _text(b)
    if op == "+":
        return a + b
    return {"==": a == b, "!=": a != b}[op] if op != "in" else a in b


def fold(node, filters: Filters):
    """The tree with constant parts computed, joined texts, and branches that can't run left out."""
    again = lambda x: fold(x, filters)
    if isinstance(node, tuple):
        out: list = []
        for n in map(again, node):
            flat = n if isinstance(n, tuple) else (n,)
            for x in flat:
                if isinstance(x, Out) and isinstance(x.of, Const):
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].of, Const):
                        out[-1] = Out(Const(_text(out[-1].of.value) + _text(x.of.value)))
                        continue
                    if _text(x.of.value) == "":
                        continue
                out.append(x)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(again, node.args))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_apply(node.op, [a.value for a in args]))
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = again(node.of)
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Member):
        return Member(again(node.of), node.name)
    if isinstance(node, Out):
        return Out(again(node.of))
    if isinstance(node, Set):
        return Set(node.name, again(node.value))
    if isinstance(node, For):
        return For(node.name, again(node.over), again(node.body))
    if isinstance(node, Generation):
        return Generation(again(node.body))
    if isinstance(node, If):
        cases = []
        for test, body in node.cases:
            test = again(test)
            if isinstance(test, Const) and not test.value:
                continue
            cases.append((test, again(body)))
            if isinstance(test, Const):
                break
        if cases and isinstance(cases[0][0], Const):
            return cases[0][1]
        return If(tuple(cases)) if cases else ()
    return node


# -- closures -------------------------------------------------------------------------------

Piece = tuple[str, bool]


def _value(node, filters: Filters) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def name(env, n=node.name):
            if n not in env:
                raise TemplateError(f"unknown name {n!r}")
            return env[n]

        return name
    if isinstance(node, Member):
        of = _value(node.of, filters)

        def member(env, n=node.name):
            x = of(env)
            if type(x) is not dict:
                raise TemplateError(f".{n} of what is not a mapping")
            return x.get(n)

        return member
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(_text(of(env)))
    args = [_value(a, filters) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env: _apply(node.op, [a(env) for a in args])


def _runner(node, filters: Filters, learn: bool = False) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, tuple):
        parts = [_runner(n, filters, learn) for n in node]

        def sequence(env):
            for p in parts:
                yield from p(env)

        return sequence
    if isinstance(node, Out):
        value = _value(node.of, filters)

        def out(env):
            yield _text(value(env)), learn

        return out
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def put(env, n=node.name):
            env[n] = value(env)
            return iter(())

        return put
    if isinstance(node, For):
        over, body = _value(node.over, filters), _runner(node.body, filters, learn)

        def loop(env, n=node.name):
            for x in over(env):
                env[n] = x
                yield from body(env)

        return loop
    if isinstance(node, Generation):
        return _runner(node.body, filters, True)
    cases = [(_value(t, filters), _runner(b, filters, learn)) for t, b in node.cases]

    def choose(env):
        for test, body in cases:
            if test(env):
                yield from body(env)
                return

    return choose


def compile_template(source: str, filters: Filters) -> Callable[..., Iterator[Piece]]:
    """A function from variables to pieces of output, each with whether it is to be learned from.

    Pieces come as the loop over the given sequence goes on, so an iterator of
    messages is rendered in bounded memory.
    """
    run = _runner(fold(parse(source), filters), filters)
    return lambda **names: run(dict(names))
