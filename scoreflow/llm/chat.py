"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that
yield pieces of text with a mark whether they are generated (inside ``{% generation %}``). The language is
sandboxed: literals, names, fields of turns, ``==``, ``!=``, ``and``, ``or``, ``not``, ``+``, brackets and the named
filters; ``for``, ``if``/``elif``/``else``, ``set`` and ``generation`` blocks. No calls, no attributes of objects,
no access to anything but the values handed in.

Rows of a conversation meet in one task, sorted by turn, and are rendered as they stream by; the output
is cut into parts of about ``PART`` characters, so a long conversation is never held whole.

Escaping: inside texts, a backslash goes before every backslash and every control string; inside roles also
before colons, and a line break becomes backslash n. Reading back undoes it.

Defined cases: null texts and roles are empty; turns with equal numbers go by role and text; a null conv_id
is a conversation of its own; repeated rows are turns of their own; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template and its control strings.
OPEN, CLOSE = "###", "</turn>"
TEMPLATE = (
    "{% for turn in turns %}"
    "### {{ turn.role | escape_role }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}"
    "</turn>{{ '\\n' }}"
    "{% endfor %}"
)
PART = 1 << 16
CONTROL = re.compile(rf"\\|{OPEN}|{CLOSE}")
ROLE_CONTROL = re.compile(rf"\\|:|\n|{OPEN}|{CLOSE}")
ESCAPED = re.compile(r"\\(.)", re.S)
# Possessive, so that an unfinished turn fails at once.
TURN = re.compile(rf"{OPEN} ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+){CLOSE}\n", re.S)

FILTERS: dict[str, Callable[[str], str]] = {
    "escape": lambda s: CONTROL.sub(lambda m: "\\" + m[0], s),
    "escape_role": lambda s: ROLE_CONTROL.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], s),
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "capitalize": str.capitalize,
}


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


class TemplateError(ValueError):
    """A template outside the language."""


TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|()+]))""")
BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
WORDS = {"and", "or", "not", "in", "true", "false", "none"}


class Expression:
    """Recursive-descent parser of one expression; trees are tuples whose first item is the kind."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            at = m.end()
            kind = ("string", "number", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.sum()
        while sign := self.take("==", "!="):
            tree = (sign, tree, self.sum())
        return tree

    def sum(self) -> tuple:
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.value()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1] in WORDS:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return tree
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("string", "number"):
            kind, text = self.tokens[self.at]
            self.at += 1
            plain = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S)
            return ("const", int(text) if kind == "number" else plain)
        if word := self.take("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[word])
        tree = ("name", self.name())
        while self.take("."):
            tree = ("field", self.name(), tree)
        return tree


def parse(template: str) -> tuple:
    """Syntax tree: ("list", nodes) of text, out, for, if, set and generation nodes."""
    root: list = []
    stack: list[tuple[str, list, list]] = [("", root, [])]
    at = 0
    for m in BLOCK.finditer(template):
        nodes = stack[-1][1]
        if m.start() > at:
            nodes.append(("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            nodes.append(("out", Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            f = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not f:
                raise TemplateError(f"cannot read for {rest!r}")
            body: list = []
            nodes.append(("for", f[1], Expression(f[2]).whole(), body))
            stack.append(("for", body, []))
        elif word == "if":
            body, arms = [], []
            arms.append((Expression(rest).whole(), body))
            nodes.append(("if", arms))
            stack.append(("if", body, arms))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            body, arms = [], stack[-1][2]
            arms.append((Expression(rest).whole() if word == "elif" else ("const", True), body))
            stack[-1] = ("if" if word == "elif" else "else", body, arms)
        elif word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"cannot read set {rest!r}")
            nodes.append(("set", name.strip(), Expression(value).whole()))
        elif word == "generation":
            body = []
            nodes.append(("generation", body))
            stack.append(("generation", body, []))
        elif word in ("endfor", "endif", "endgeneration") and len(stack) > 1 and word[3:] == stack[-1][0].replace("else", "if"):
            stack.pop()
        else:
            raise TemplateError(f"unexpected block {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(template):
        root.append(("text", template[at:]))
    return ("list", root)


def folded(tree: tuple) -> tuple:
    """The expression with its constant parts computed."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind in ("field", "filter"):
        inner = folded(tree[2])
        if kind == "filter" and inner[0] == "const":
            return ("const", FILTERS[tree[1]](shown(inner[1])))
        return (kind, tree[1], inner)
    parts = [folded(t) for t in tree[1:]]
    if all(p[0] == "const" for p in parts):
        return ("const", expression((kind, *parts))({}))
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def folded_nodes(nodes: list) -> list:
    """Nodes with folded expressions, dead branches left out and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        kind = node[0]
        if kind == "out":
            value = folded(node[1])
            node = ("text", shown(value[1])) if value[0] == "const" else ("out", value)
        elif kind == "for":
            node = ("for", node[1], folded(node[2]), folded_nodes(node[3]))
        elif kind == "set":
            node = ("set", node[1], folded(node[2]))
        elif kind == "generation":
            node = ("generation", folded_nodes(node[1]))
        elif kind == "if":
            arms = []
            for test, body in node[1]:
                test = folded(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, folded_nodes(body)))
                if test[0] == "const":
                    break
            if not arms:
                continue
            if arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    _append(out, inner)
                continue
            node = ("if", arms)
        _append(out, node)
    return out


def _append(out: list, node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node[0] != "text" or node[1]:
        out.append(node)


def shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def expression(tree: tuple) -> Callable[[dict], object]:
    """Closure from the names in sight to the value."""
    kind = tree[0]
    if kind == "const":
        return lambda names, v=tree[1]: v
    if kind == "name":
        return lambda names, n=tree[1]: names.get(n)
    if kind in ("field", "filter"):
        inner = expression(tree[2])
        if kind == "filter":
            return lambda names, f=FILTERS[tree[1]]: f(shown(inner(names)))
        return lambda names, n=tree[1]: v.get(n) if isinstance(v := inner(names), dict) else None
    a = expression(tree[1])
    if kind == "not":
        return lambda names: not a(names)
    b = expression(tree[2])
    return {
        "and": lambda names: a(names) and b(names),
        "or": lambda names: a(names) or b(names),
        "==": lambda names: a(names) == b(names),
        "!=": lambda names: a(names) != b(names),
        "+": lambda names: shown(a(names)) + shown(b(names)),
    }[kind]


Piece = tuple[str, bool]


def renderer(nodes: list, generated: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """Closure that yields (text, generated) pieces."""
    steps = [_step(node, generated) for node in nodes]

    def render(names: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(names)

    return render


def _step(node: tuple, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], generated)
        return lambda names: (piece,)
    if kind == "out":
        value = expression(node[1])
        return lambda names: ((shown(value(names)), generated),)
    if kind == "generation":
        return renderer(node[1], True)
    if kind == "set":
        value = expression(node[2])

        def assign(names: dict) -> Iterator[Piece]:
            names[node[1]] = value(names)
            return iter(())

        return assign
    if kind == "if":
        arms = [(expression(test), renderer(body, generated)) for test, body in node[1]]

        def choose(names: dict) -> Iterator[Piece]:
            for test, body in arms:
                if test(names):
                    return body(names)
            return iter(())

        return choose
    items, body = expression(node[2]), renderer(node[3], generated)

    def loop(names: dict) -> Iterator[Piece]:
        for i, item in enumerate(items(names) or ()):
            own = {**names, node[1]: item, "loop": {"index": i + 1, "index0": i, "first": i == 0}}
            yield from body(own)

    return loop


def compiled(template: str) -> Callable[[dict], Iterator[Piece]]:
    return renderer(folded_nodes(parse(template)[1]))


def _conversations(batches) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its turns) from sorted rows; each must be read to its end before the next."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))

    stream = rows()
    ahead = next(stream, None)

    def turns(key):
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            row, ahead = ahead, None
            ahead = next(stream, None)
            yield {"role": row[1] or "", "text": row[2] or ""}

    while ahead is not None:
        key = ahead[0]
        yield key, turns(key)


PARTS = "conv_id long, part long, text string, generated array<struct<first:long,end:long>>, turns long"


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Parts of each formatted conversation, in order: text, spans under the loss mask, turns read so far.

    The parts of a conversation stand one after another in one partition.
    """
    compiled(template)  # a faulty template fails here, not in a task
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def render(batches):
        write = compiled(template)
        rows: list[tuple] = []
        size = 0

        def batch():
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), span, pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "part", "text", "generated", "turns"]
            )

        for key, turns in _conversations(batches):
            seen = 0

            def counted():
                nonlocal seen
                for turn in turns:
                    seen += 1
                    yield turn

            part = length = 0
            pieces: list[str] = []
            spans: list[dict] = []
            for text, generated in write({"turns": counted()}):
                if length > PART:
                    rows.append((key, part, "".join(pieces), spans, seen))
                    size += length
                    part, length, pieces, spans = part + 1, 0, [], []
                    if size > 16 * PART:
                        yield batch()
                        rows.clear()
                        size = 0
                if generated and text:
                    spans.append({"first": length, "end": length + len(text)})
                pieces.append(text)
                length += len(text)
            for _ in turns:  # a template may leave turns unread
                pass
            rows.append((key, part, "".join(pieces), spans, seen))
            size += length
            if size > 16 * PART or len(rows) > 4000:
                yield batch()
                rows.clear()
                size = 0
        if rows:
            yield batch()

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    spread = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return spread.select("conv_id", "role", "text").mapInArrow(render, PARTS)


READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(parts: DataFrame) -> DataFrame:
    """What the output of ``formatted`` with the standard template says of each conversation."""

    def read(batches):
        done: list[tuple] = []
        state: dict = {}

        def finish():
            if state:
                if state["rest"]:
                    raise ValueError(f"conversation {state['key']}: {state['rest'][:50]!r} is no turn")
                done.append((state["key"], state["n"], state["turns"].hexdigest(), state["loss_chars"],
                             state["loss"].hexdigest(), state["chars"]))
                state.clear()

        def batch():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*done)) or [[] for _ in kinds]
            names = [c.split()[0] for c in READ.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for group in batches:
            for key, part, text, spans in zip(*(group.column(c).to_pylist() for c in ("conv_id", "part", "text", "generated"))):
                if part == 0:
                    finish()
                    state |= {"key": key, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(),
                              "loss_chars": 0, "chars": 0, "rest": ""}
                state["chars"] += len(text)
                for s in spans or []:
                    plain = unescaped(text[s["first"] : s["end"]])
                    state["loss_chars"] += len(plain)
                    state["loss"].update(plain.encode())
                whole, at = state["rest"] + text, 0
                while m := TURN.match(whole, at):
                    state["turns"].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                    state["n"] += 1
                    at = m.end()
                state["rest"] = whole[at:]
            if len(done) > 4000:
                yield batch()
                done.clear()
        finish()
        yield batch()

    return parts.select("conv_id", "part", "text", "generated").mapInArrow(read, READ)
