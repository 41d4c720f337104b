"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constant parts are folded, and one Python closure is
generated from the tree. The language has text, ``{{ expression }}``, ``{% if %} .. {% elif %} .. {% else %} .. {% endif %}``,
``{% for x in xs %} .. {% endfor %}`` and ``{% generation %} .. {% endgeneration %}``; expressions are names, fields, string
and number constants, ``==``, ``!=``, ``~`` (joining), ``not``, ``and``, ``or`` and the filters ``escape``, ``upper``, ``lower`` and ``trim``.
Nothing else can be reached: a field is looked up in dictionaries only, and there are no calls.

Rendering gives the text and the spans of its generation blocks, in code points of the text.

A conversation may be of any length. Where a template is one loop over the messages between constant texts, runs of turns
are rendered in different tasks: rows are dealt to ranges of (conversation, turn), so one long conversation spreads over
many, and each run gives a part of the formatted text. What reads a conversation as a whole goes through its parts in
order and holds one batch of them.

Defined results: rows of a conversation are ordered by turn, ties by role and then text; null texts and roles are
empty; repeated rows are turns of their own; a null conv_id is a conversation like any other; an empty table gives
conversation -7 alone in the query and nothing in the operator; rows of the table whose conv_id is -7 are turns of that
conversation too; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, text_of

#: Marks of the format; in texts and roles, the escape and the opening bracket of a mark get an escape before them.
ESCAPE, OPEN = "\\", "<|"
TEMPLATE = "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}"
#: Turns and characters of a part, at most (a turn stays whole).
PART_TURNS, PART_CHARS = 64, 1 << 14
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return text.replace(ESCAPE, ESCAPE * 2).replace(OPEN, f"<{ESCAPE}|")


def unescape(text: str) -> str:
    return re.sub(r"<\\\||\\\\", lambda m: OPEN if m[0][0] == "<" else ESCAPE, text) if ESCAPE in text else text


class TemplateError(ValueError):
    pass


@dataclass
class Const:
    value: object


@dataclass
class Name:
    path: list[str]


@dataclass
class Op:
    kind: str
    parts: list


@dataclass
class Out:
    value: object


@dataclass
class If:
    cases: list[tuple[object, list]]


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class Generation:
    body: list = field(default_factory=list)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip}
TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>==|!=|[~|.()]))")


class Expression:
    """Recursive descent: or, and, not, comparison, joining, filters, names."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unreadable: {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at :]}")
        return tree

    def _chain(self, below: Callable, word: str, kind: str):
        parts = [below()]
        while self.peek(word):
            self.next()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Op(kind, parts)

    def either(self):
        return self._chain(self.both, "or", "or")

    def both(self):
        return self._chain(self.negated, "and", "and")

    def negated(self):
        if self.peek("not"):
            self.next()
            return Op("not", [self.negated()])
        left = self.joined()
        if self.peek("==", "!="):
            return Op(self.next()[1], [left, self.joined()])
        return left

    def joined(self):
        return self._chain(self.filtered, "~", "~")

    def filtered(self):
        value = self.atom()
        while self.peek("|"):
            self.next()
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            value = Op("filter " + name, [value])
        return value

    def atom(self):
        kind, text = self.next()
        if kind == "str":
            return Const(text[1:-1])
        if kind == "num":
            return Const(int(text))
        if kind == "name":
            path = [text]
            while self.peek("."):
                self.next()
                path.append(self.next()[1])
            if any(p.startswith("_") for p in path):
                raise TemplateError("names don't start with _")
            return Name(path)
        if text == "(":
            inner = self.either()
            if self.next()[1] != ")":
                raise TemplateError("missing )")
            return inner
        raise TemplateError(f"unexpected {text}")


PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(template: str) -> list:
    root: list = []
    stack: list[tuple[object, list]] = [(None, root)]
    at = 0
    for m in PARTS.finditer(template):
        if template[at : m.start()]:
            stack[-1][1].append(Out(Const(template[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Out(Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "if":
            node = If([(Expression(rest).whole(), [])])
            stack[-1][1].append(node)
            stack.append((node, node.cases[0][1]))
        elif word in ("elif", "else") and isinstance(stack[-1][0], If):
            node = stack.pop()[0]
            node.cases.append((Expression(rest).whole() if word == "elif" else Const(True), []))
            stack.append((node, node.cases[-1][1]))
        elif word == "for":
            name, _, over = rest.partition(" in ")
            if not name.strip().isidentifier() or name.strip().startswith("_"):
                raise TemplateError(f"no loop variable: {rest}")
            node = For(name.strip(), Expression(over).whole(), [])
            stack[-1][1].append(node)
            stack.append((node, node.body))
        elif word == "generation":
            node = Generation()
            stack[-1][1].append(node)
            stack.append((node, node.body))
        elif word.startswith("end") and isinstance(stack[-1][0], {"endif": If, "endfor": For, "endgeneration": Generation}.get(word, ())):
            stack.pop()
        else:
            raise TemplateError(f"unexpected {m[2].strip()}")
    if len(stack) > 1:
        raise TemplateError("a block isn't closed")
    if template[at:]:
        root.append(Out(Const(template[at:])))
    return root


def shown(value: object) -> str:
    return "" if value is None else str(value)


def folded(node):
    """The expression with constant parts computed."""
    if not isinstance(node, Op):
        return node
    parts = [folded(p) for p in node.parts]
    if all(isinstance(p, Const) for p in parts):
        return Const(evaluator(Op(node.kind, parts))({}))
    return Op(node.kind, parts)


def folded_body(nodes: list) -> list:
    """Constant branches taken, adjoining constants joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Out):
            node = Out(folded(node.value))
            if isinstance(node.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(shown(out[-1].value.value) + shown(node.value.value)))
                continue
        elif isinstance(node, For):
            node = For(node.name, folded(node.over), folded_body(node.body))
        elif isinstance(node, Generation):
            node = Generation(folded_body(node.body))
        elif isinstance(node, If):
            cases = []
            for test, body in node.cases:
                test = folded(test)
                if isinstance(test, Const) and not test.value:
                    continue
                cases.append((test, folded_body(body)))
                if isinstance(test, Const):
                    break
            if not cases:
                continue
            if isinstance(cases[0][0], Const):
                out += cases[0][1]
                continue
            node = If(cases)
        out.append(node)
    return out


def evaluator(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        first, *rest = node.path

        def look_up(scope: dict) -> object:
            value = scope.get(first)
            for key in rest:
                value = value.get(key) if isinstance(value, dict) else None
            return value

        return look_up
    parts = [evaluator(p) for p in node.parts]
    if node.kind.startswith("filter "):
        apply, (inner,) = FILTERS[node.kind[7:]], parts
        return lambda scope: apply(shown(inner(scope)))
    if node.kind == "~":
        return lambda scope: "".join(shown(p(scope)) for p in parts)
    if node.kind == "not":
        return lambda scope: not parts[0](scope)
    if node.kind == "and":
        return lambda scope: all(p(scope) for p in parts)
    if node.kind == "or":
        return lambda scope: any(p(scope) for p in parts)
    equal = node.kind == "=="
    return lambda scope: (parts[0](scope) == parts[1](scope)) is equal


class Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def writer(nodes: list) -> Callable[[dict, Output], None]:
    steps: list[Callable[[dict, Output], None]] = []
    for node in nodes:
        if isinstance(node, Out):
            value = evaluator(node.value)
            steps.append(lambda scope, out, value=value: out.write(shown(value(scope))))
        elif isinstance(node, For):

            def loop(scope: dict, out: Output, name=node.name, over=evaluator(node.over), body=writer(node.body)) -> None:
                for item in over(scope) or ():
                    body(scope | {name: item}, out)

            steps.append(loop)
        elif isinstance(node, Generation):

            def marked(scope: dict, out: Output, body=writer(node.body)) -> None:
                start = out.length
                body(scope, out)
                out.spans.append((start, out.length))

            steps.append(marked)
        else:

            def choose(scope: dict, out: Output, cases=[(evaluator(t), writer(b)) for t, b in node.cases]) -> None:
                for test, body in cases:
                    if test(scope):
                        return body(scope, out)

            steps.append(choose)
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def compile_template(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to (text, spans of generation blocks)."""
    render = writer(folded_body(parse(template)))

    def call(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        render({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return call


def roots(node) -> set[str]:
    """Names that a tree looks up, loop variables of its own left out."""
    if isinstance(node, list):
        return set().union(*map(roots, node))
    if isinstance(node, Name):
        return {node.path[0]}
    if isinstance(node, Op):
        return roots(node.parts)
    if isinstance(node, Out):
        return roots(node.value)
    if isinstance(node, If):
        return set().union(*(roots(test) | roots(body) for test, body in node.cases))
    if isinstance(node, For):
        return roots(node.over) | (roots(node.body) - {node.name})
    return roots(node.body) if isinstance(node, Generation) else set()


def compile_by_turn(template: str) -> tuple[str, Callable[[dict], tuple[str, list[tuple[int, int]]]], str]:
    """Text before the messages, a function of one message, text after them; an error if the template isn't one loop over the messages between constant texts."""
    nodes = folded_body(parse(template))
    loops = [i for i, n in enumerate(nodes) if isinstance(n, For) and n.over == Name(["messages"]) and roots(n.body) <= {n.name}]
    if len(loops) != 1 or not all(isinstance(n, Out) and isinstance(n.value, Const) for i, n in enumerate(nodes) if i != loops[0]):
        raise TemplateError("the template isn't one loop over the messages")
    loop = nodes[loops[0]]
    body = writer(loop.body)

    def call(message: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        body({loop.name: message}, out)
        return "".join(out.parts), out.spans

    text = lambda part: "".join(shown(n.value.value) for n in part)
    return text(nodes[: loops[0]]), call, text(nodes[loops[0] + 1 :])


TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans (code points): a row per conversation, which must fit into one; any template."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = compile_template(template)
        for batch in batches:
            done = [call([{"role": t["role"], "text": t["text"]} for t in turns]) for turns in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([[list(s) for s in d[1]] for d in done], pa.list_(pa.list_(pa.int64())))], names=["conv_id", "formatted", "loss_spans"])

    turns = turns_of(conversations).select("conv_id", F.struct("turn", "role", "text").alias("row"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns")).mapInArrow(in_slices(render, 256), "conv_id long, formatted string, loss_spans array<array<long>>")


def formatted_parts(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, place, formatted, loss_spans (code points of the part): runs of turns of conversations of any length, whose parts follow one another by place; without the constant texts around them."""
    compile_by_turn(template)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, call, _ = compile_by_turn(template)
        place, owner, turns, texts, spans, size = TaskContext.get().partitionId() << 40, None, 0, [], [], 0
        out: list[tuple] = []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and (conv != owner or turns >= PART_TURNS or size >= PART_CHARS):
                    out.append((owner, place, "".join(texts), spans))
                    place, turns, texts, spans, size = place + 1, 0, [], [], 0
                made, marked = call({"role": role, "text": text})
                owner = conv
                spans += [[a + size, b + size] for a, b in marked]
                texts.append(made)
                turns, size = turns + 1, size + len(made)
            yield parts(out)
            out = []
        yield parts([(owner, place, "".join(texts), spans)] if turns else [])

    def parts(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))), strict=True)], names=["conv_id", "place", "formatted", "loss_spans"])

    order = ("conv_id", "turn", "role", "text")
    return turns_of(conversations).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(in_slices(render), "conv_id long, place long, formatted string, loss_spans array<array<long>>")


def digested(parts: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What is read back from formatted conversations, part after part."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, _, after = compile_by_turn(template)
        owner, begun = None, False
        turns, said, chars, loss, size = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                if begun and conv != owner:
                    out.append((owner, turns, said.hexdigest(), chars, loss.hexdigest(), size + len(after)))
                if not begun or conv != owner:
                    owner, begun = conv, True
                    turns, said, chars, loss, size = 0, hashlib.sha256(), 0, hashlib.sha256(), len(before)
                for role, words in read_back(text):
                    turns += 1
                    said.update(f"{role}\n{words}\n".encode())
                for a, b in spans:
                    words = unescape(text[a:b])
                    chars += len(words)
                    loss.update(words.encode())
                size += len(text)
            yield rows(out)
        yield rows([(owner, turns, said.hexdigest(), chars, loss.hexdigest(), size + len(after))] if begun else [])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(in_slices(run), schema)


def op5_chat_formatting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    return digested(formatted_parts(rows.union(extra)))
