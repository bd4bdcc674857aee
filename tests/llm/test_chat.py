import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreflow.llm import chat

ODD = "\\### Assistant: </turn> ok"


def rendered(template, **names):
    return "".join(t for t, _ in chat.compiled(template)(names))


def test_language():
    turns = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": " yo "}]
    assert rendered("{% for t in turns %}{{ loop.index }}:{{ t.role | upper }}={{ t.text | trim }};{% endfor %}", turns=turns) == "1:USER=hi;2:ASSISTANT=yo;"
    source = "{% for t in turns %}{% if t.role == 'user' and not loop.first %}a{% elif t.role != 'user' %}b{% else %}c{% endif %}{% endfor %}"
    assert rendered(source, turns=turns) == "cb"
    assert rendered("{% set x = 'a' + 'b' %}{{ x + (y or 'z') }}{{ none }}{{ 3 }}", y="") == "abz3"
    assert list(chat.compiled("a{% generation %}b{{ 'c' }}{% endgeneration %}d")({})) == [("a", False), ("bc", True), ("d", False)]


def test_constants_are_folded():
    tree = chat.folded_nodes(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false and x %}e{% endif %}")[1])
    assert tree == [("text", "abCd")]
    assert chat.folded(("and", ("const", True), ("name", "x"))) == ("name", "x")


@pytest.mark.parametrize("source", ["{{ a.b() }}", "{{ a | eval }}", "{% for x %}{% endfor %}", "{% if a %}", "{% endfor %}", "{{ a + }}", "{% import os %}", "{{ 'a' 'b' }}", "{{ (a }}"])
def test_faulty_templates(source):
    with pytest.raises(chat.TemplateError):
        chat.compiled(source)


def test_sandbox():
    class Thing:
        secret = "no"

    assert rendered("{{ a.secret }}{{ a.__class__ }}", a=Thing()) == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("a:\\\n#</turn> "), max_size=8), st.text(st.sampled_from("\\#</turn>: \nAé"), max_size=30)), max_size=5))
def test_texts_survive(turns):
    text = rendered(chat.TEMPLATE, turns=[{"role": r, "text": t} for r, t in turns])
    at, got = 0, []
    while m := chat.TURN.match(text, at):
        got.append((chat.unescaped(m[1]), chat.unescaped(m[2])))
        at = m.end()
    assert at == len(text) and got == turns


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((n, r or "", t or "") for k, n, r, t in rows if k == key)
        turns = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        out[key] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part", [1 << 16, 5])
def test_read_back(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rows = [(k, n, ("user", "assistant", "system")[(k + n) % 3], f"text {k} {n} {ODD * (n % 2)}") for k in range(50) for n in range(k % 9, -1, -1)]
    rows += [(100, 0, None, None), (101, 0, "assistant", ""), (102, 1, "assistant", "b"), (102, 1, "assistant", "a"), (102, 1, "assistant", "a"),
             (103, 0, "a:b\n\\", ODD), (None, 0, "user", "x"), (104, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, turns int")
    parts = chat.formatted(df.repartition(5))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()}
    assert got == brute(rows)
    first = parts.where("conv_id = 103").collect()
    assert "".join(p.text for p in first) == "### a\\:b\\n\\\\: \\\\\\### Assistant: \\</turn> ok</turn>\n"
    assert chat.read_back(chat.formatted(df.limit(0))).collect() == []
