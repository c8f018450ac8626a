"""Chat formatting by a template compiler.

A small sandboxed template language is parsed to a syntax tree, constants are folded, and the tree becomes
Python closures that render a conversation and record generation markers (the spans under the loss mask).

Language: ``{{ expr }}``; ``{% for x in expr %}..{% endfor %}``; ``{% if expr %}..{% elif expr %}..{% else %}..{% endif %}``;
``{% set x = expr %}``; ``{% generation %}..{% endgeneration %}``; ``{# comment #}``; a ``-`` inside a tag's brace, as in ``{%-`` and
``-}}``, takes away the white space of the template on that side. Expressions: strings, integers, true,
false, none, names, ``a.b`` and ``a['b']`` (keys of mappings only), ``loop.index/index0/first/last``, ``~`` and ``+``, comparisons,
``in``, and/or/not, parentheses, and the filters ``escape upper lower trim length default``. There is no call, no attribute of
a Python object, and no loop but over a given list, so a template ends and reaches nothing outside its context.

``escape`` breaks every control string inside a text with a backslash after its first character and doubles backslashes, so
the text can't hold a control string, and ``unescape`` gives the exact text back.

A template that can't be read or computed raises ``TemplateError``: when it is compiled, as far as it is constant, else for the
conversation at hand.

Defined cases: null roles and texts are empty; a conversation without turns formats as the template has it; a null id is an id
of its own; equal (turn, role, text) rows stay; turns of equal numbers are ordered by role and text. Texts are taken whole,
however long; one conversation has to fit in a task. An empty table gives no rows. Other columns pass through; one named like an
output (``formatted``, ``loss_spans``, in any case) is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import quoted, runs, with_result

CONTROLS = ("<turn>", "<says>", "</turn>", "<end>")
#: Turns as ``<turn>role<says>text</turn>``; what an assistant says is under the loss mask.
TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role | escape }}<says>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}<end>"
)


class TemplateError(ValueError):
    pass


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    text = text.replace("\\", "\\\\")
    return re.sub("|".join(map(re.escape, sorted(controls, key=len, reverse=True))), lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """A doubled backslash is one; a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


# --- parsing ---------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#(?P<note>.*?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~().\[\]|,]))")
_FILTERS: dict[str, Callable] = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len, "default": lambda v, d="": d if v is None else v}
_CONSTANT = {"true": True, "false": False, "none": None}
#: The test of an else arm.
_ELSE = ("const", True)
_WORDS = {"and", "or", "not", "in"}


class _Expr:
    """Recursive descent over one expression; nodes are tuples."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if self.at >= len(self.tokens) or values and self.tokens[self.at][1] not in values:
            raise TemplateError(f"expected {values or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            op = self.take()
            node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek("+", "~"):
            op = self.take()
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.item()
        while self.peek("|"):
            self.take()
            name, args = self.take(), []
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.peek("("):
                self.take()
                while not self.peek(")"):
                    args.append(self.either())
                    if not self.peek(")"):
                        self.take(",")
                self.take(")")
            node = ("filter", name, node, *args)
        return node

    def item(self) -> tuple:
        node = self.atom()
        while self.peek(".", "["):
            if self.take() == ".":
                node = ("get", node, ("const", self.take()))
            else:
                node = ("get", node, self.either())
                self.take("]")
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value not in _WORDS:
            return ("const", _CONSTANT[value]) if value in _CONSTANT else ("name", value)
        if value == "(":
            node = self.either()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> tuple:
    """The syntax tree: a ``block`` of ``text``, ``out``, ``set``, ``for``, ``if`` and ``generation`` nodes."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at, bare = 0, False

    def plain(text: str, trimmed: bool) -> None:
        text = text.lstrip() if bare else text
        text = text.rstrip() if trimmed else text
        if text:
            stack[-1][2].append(("text", text))

    for m in _TAG.finditer(template):
        inside = m[m.lastgroup]
        trims = inside.startswith("-")
        plain(template[at : m.start()], trims)
        at, bare = m.end(), len(inside) > trims and inside.endswith("-")
        inside = inside[trims : len(inside) - bare]
        if m.lastgroup == "out":
            stack[-1][2].append(("out", _Expr(inside).whole()))
        elif m.lastgroup == "tag":
            _tag(inside.strip(), stack)
    plain(template[at:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    return ("block", *stack[0][2])


def _tag(tag: str, stack: list) -> None:
    word, _, rest = tag.partition(" ")
    if word == "for":
        m = re.fullmatch(r"(\w+)\s+in\s+(.*)", rest.strip(), re.S)
        if not m:
            raise TemplateError(f"can't read {tag!r}")
        stack.append(("for", (m[1], _Expr(m[2]).whole()), []))
    elif word == "if":
        stack.append(("if", [[_Expr(rest).whole(), None]], []))
    elif word in ("elif", "else"):
        kind, arms, body = stack.pop()
        if kind != "if" or arms[-1][0] is _ELSE:
            raise TemplateError(f"{word} without if")
        arms[-1][1] = ("block", *body)
        arms.append([_Expr(rest).whole() if word == "elif" else _ELSE, None])
        stack.append(("if", arms, []))
    elif word == "set":
        name, _, value = rest.partition("=")
        stack[-1][2].append(("set", name.strip(), _Expr(value).whole()))
    elif word == "generation":
        if any(x[0] == "generation" for x in stack):
            raise TemplateError("generation inside generation")
        stack.append(("generation", None, []))
    elif word.startswith("end") and len(stack) > 1 and stack[-1][0] == word[3:]:
        kind, head, body = stack.pop()
        body = ("block", *body)
        if kind == "for":
            node = ("for", *head, body)
        elif kind == "if":
            head[-1][1] = body
            node = ("if", *map(tuple, head))
        else:
            node = ("generation", body)
        stack[-1][2].append(node)
    else:
        raise TemplateError(f"can't read {tag!r}")


# --- folding and compiling -------------------------------------------------------------------------------------------

_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _get(box: Any, key: Any) -> Any:
    if isinstance(box, dict):
        return box.get(key)
    if isinstance(box, list) and isinstance(key, int):
        return box[key] if -len(box) <= key < len(box) else None
    raise TemplateError(f"no item {key!r} here")


def fold(node: tuple) -> tuple:
    """The tree with constant parts computed, dead branches gone and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for x in map(fold, node[1:]):
            x = ("text", _text(x[1][1])) if x[0] == "out" and x[1][0] == "const" else x
            for y in x[1:] if x[0] == "block" else (x,):
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("block", *out)
    if kind == "if":
        arms = []
        for test, body in node[1:]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(body)))
            if test[0] == "const":
                break
        return ("block",) if not arms else arms[0][1] if arms[0][0][0] == "const" else ("if", *arms)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "filter":
        node = ("filter", node[1], *map(fold, node[2:]))
        args = node[2:]
    else:
        node = (kind, *map(fold, node[1:]))
        args = node[1:]
    if kind not in ("out", "generation", "get") and all(x[0] == "const" for x in args):
        return ("const", _computed(_value(node), {}))
    return node


def _computed(step: Callable, *args: Any) -> Any:
    """What a closure gives; a value of the wrong kind is the template's error."""
    try:
        return step(*args)
    except TemplateError:
        raise
    except (TypeError, ValueError, AttributeError) as e:
        raise TemplateError(f"can't compute this: {e}") from e


def _value(node: tuple) -> Callable[[dict], Any]:
    """The closure that computes an expression in a context."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda c: value
    if kind == "name":
        name = node[1]
        return lambda c: c.get(name)
    if kind == "get":
        box, key = map(_value, node[1:])
        return lambda c: _get(box(c), key(c))
    if kind == "not":
        inner = _value(node[1])
        return lambda c: not inner(c)
    if kind == "filter":
        f, inner, args = _FILTERS[node[1]], _value(node[2]), [_value(x) for x in node[3:]]
        if node[1] in ("default", "length"):
            return lambda c: f(inner(c), *[a(c) for a in args])
        return lambda c: f(_text(inner(c)), *[a(c) for a in args])
    left, right = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda c: left(c) and right(c)
    if kind == "or":
        return lambda c: left(c) or right(c)
    f = _BINARY[kind]
    return lambda c: f(left(c), right(c))


class _Out:
    """Rendered parts, their length so far, and the generation spans."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _run(node: tuple) -> Callable[[dict, _Out], None]:
    """The closure that renders a node."""
    kind = node[0]
    if kind == "block":
        steps = [_run(x) for x in node[1:]]

        def block(c: dict, out: _Out) -> None:
            for step in steps:
                step(c, out)

        return block
    if kind == "text":
        text = node[1]
        return lambda c, out: out.put(text)
    if kind == "out":
        value = _value(node[1])
        return lambda c, out: out.put(_text(value(c)))
    if kind == "set":
        name, value = node[1], _value(node[2])
        return lambda c, out: c.__setitem__(name, value(c))
    if kind == "if":
        arms = [(_value(t), _run(b)) for t, b in node[1:]]

        def branch(c: dict, out: _Out) -> None:
            for test, body in arms:
                if test(c):
                    body(c, out)
                    return

        return branch
    if kind == "for":
        name, items, body = node[1], _value(node[2]), _run(node[3])

        def each(c: dict, out: _Out) -> None:
            rows = items(c) or []
            if not isinstance(rows, list):
                raise TemplateError("for needs a list")
            for i, x in enumerate(rows):
                body(c | {name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(rows) - 1}}, out)

        return each
    inner = _run(node[1])

    def generation(c: dict, out: _Out) -> None:
        start = out.size
        inner(c, out)
        out.spans.append((start, out.size))

    return generation


def compile_template(template: str = TEMPLATE) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (dicts of role and text) to the formatted text and its loss spans."""
    run = _run(fold(parse(template)))

    def render(messages: list[dict], **context: Any) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        _computed(run, {**context, "messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


_TURN = re.compile(r"<turn>(.*?)<says>(.*?)</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``TEMPLATE`` formatted."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise TemplateError("text between turns")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if formatted[at:] != "<end>":
        raise TemplateError("a turn has no end")
    return found


# --- columns ---------------------------------------------------------------------------------------------------------


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id and ``turns``, sorted by (turn, role, text), nulls first. Null role and text
    are empty; repeated rows stay."""
    one = F.struct(quoted(turn).alias("turn"), F.coalesce(quoted(role), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    return df.groupBy(quoted(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def format_conversations(df: DataFrame, template: str = TEMPLATE, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans`` (start and end, in code points, of each generation).

    The optimizer copies a deterministic function above an aggregate, as ``conversations`` has, into each use of its result, with
    an aggregate and a worker for each; so this one is declared not to be deterministic, and runs once."""
    compile_template(template)  # a wrong template fails here, not in a task

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        render = compile_template(template)
        for part in (x for batch in batches for x in _parts(batch)):
            done = [render([dict(m) for m in x or []]) for x in part.to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.string()), spans], ["formatted", "loss_spans"])

    made = F.arrow_udf(run, "struct<formatted:string,loss_spans:array<struct<start:long,end:long>>>").asNondeterministic()
    return with_result(df, made(quoted(turns)), ["formatted", "loss_spans"])


def _parts(batch: pa.ListArray) -> Iterator[pa.ListArray]:
    """Slices of an array of conversations of a bounded number of bytes of text (or one conversation)."""
    values = batch.values
    size = np.zeros(len(values), np.int64)
    for k in range(values.type.num_fields):
        if pa.types.is_string(values.type.field(k).type) or pa.types.is_large_string(values.type.field(k).type):
            size += pc.fill_null(pc.binary_length(values.field(k)), 0).to_numpy(zero_copy_only=False)
    past = np.concatenate([[0], np.cumsum(size)])
    ends = past[batch.offsets.to_numpy(zero_copy_only=False)]
    for start, end in runs(np.diff(ends)):
        yield batch.slice(start, end - start)


def _both(texts: pa.Array, marks: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    for start, end in runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
        yield texts.slice(start, end - start), marks.slice(start, end - start)


def parse_formatted(formatted: Column, spans: Column) -> Column:
    """Struct of what is read back from formatted text: turns (role, text) and the unescaped text under each span."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marks in (x for batch in batches for x in _both(*batch)):
            turns, loss = [], []
            for t, m in zip(texts.to_pylist(), marks.to_pylist()):
                turns.append([{"role": r, "text": x} for r, x in read_back(t)])
                loss.append([unescape(t[s["start"] : s["end"]]) for s in m])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.StructArray.from_arrays([pa.array(turns, kind), pa.array(loss, pa.list_(pa.string()))], ["turns", "loss"])

    return F.arrow_udf(run, "struct<turns:array<struct<role:string,text:string>>,loss:array<string>>")(formatted, spans)
