import json

import pytest
from pyspark.sql import functions as F

from scoreflow.functions import rules
from scoreflow.functions import text as X


def apply(spark, column, data):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def recovered(text):
    """The wanted result: whole text, else from the first to the last brace."""
    for part in (text, text[text.find("{"): text.rfind("}") + 1] if "{" in text else ""):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


RESPONSES = [
    '{"a": "x"}', ' {"a": "x"}\n', 'ok {"a": "x"} bye', '{"a": "x"} bye', "plain", "", "{}", "[]", "[1, 2]", '"text"',
    "12", "-0.5", "007", "true", "null", '{"a": {"b": [1, 2]}} {"c": 1}', "{broken", '}{"a": 1', 'x {"a": "é\\n"} y',
    '{"a": 1}, {"b": 2}', "1, 2", '[{"a": 1}]', "12 apples", '{"a": "brace } inside"} end',
]


def test_recover_json_follows_the_rule(spark):
    got = apply(spark, lambda c: F.to_json(X.recover_json(c)), RESPONSES)
    assert [None if g is None else json.loads(g) for g in got] == [recovered(t) for t in RESPONSES]


def test_usable_response_is_an_object_with_keys(spark):
    got = apply(spark, lambda c: X.is_filled_object(X.recover_json(c)), RESPONSES)
    wanted = [isinstance(recovered(t), dict) and bool(recovered(t)) for t in RESPONSES]
    assert got == wanted


def test_field_text(spark):
    told = '{"s": "x", "n": 5, "d": 1.5, "t": true, "z": null, "l": [1, "a"], "o": {"k": "v"}, "e": ""}'
    fields = {"s": "x", "n": "5", "d": "1.5", "t": "True", "z": "", "l": '[1,"a"]', "o": '{"k":"v"}', "e": "", "absent": "low"}
    for key, wanted in fields.items():
        assert apply(spark, lambda c: X.field_text(X.recover_json(c), key, "low"), [told]) == [wanted]


def test_next_steps(spark):
    data = ['{"b": "x", "a": 2}', '["p", "q"]', "Read more", "", None, "12", '"quoted"', " ", '{"k": null}', "[]"]
    wanted = [["b: x", "a: 2"], ["p", "q"], ["Read more"], [], [], [], [], [" "], ["k: None"], []]
    assert apply(spark, X.next_steps, data) == wanted


def test_normalize_cell(spark):
    data = [None, "  text ", '{"a": 1}', "5", "05", "[1]", "", "true", "5-LOW"]
    wanted = ["", "text", {"a": 1}, 5, "05", [1], "", True, "5-LOW"]
    got = [json.loads(v) for v in apply(spark, lambda c: F.to_json(X.normalize_cell(c)), data)]
    assert got == wanted


def test_lists_and_bullets(spark):
    assert apply(spark, X.split_list, ["a, b,, c ", "", " , "]) == [["a", "b", "c"], [], []]
    assert apply(spark, X.strip_bullets, ["- one\n\n -- two \nthree", ""]) == [["one", "two", "three"], []]


def test_match_modes(spark):
    assert apply(spark, lambda c: X.match_id(c, "trim"), ["\tS1 "]) == ["S1"]
    assert apply(spark, lambda c: X.match_id(c, "ci"), [" s1"]) == ["S1"]
    with pytest.raises(ValueError):
        X.match_id(F.col("x"), "other")


def test_display_rules(spark):
    trends = ["improving", "Going up", "declining", "down", "stable", None, ""]
    assert apply(spark, rules.trend_colour, trends) == ["green", "green", "red", "red", "amber", "amber", "amber"]
    assert apply(spark, rules.trend_caption, trends)[:5] == ["↑ Improving"] * 2 + ["↓ Declining"] * 2 + ["— Stable"]
    scores = ["70", "69.9", "50", "49.9", "x", None]
    colour = lambda c: rules.score_colour(c.try_cast("double"))
    assert apply(spark, colour, scores) == ["green", "amber", "amber", "red", "amber", "amber"]
    percent = lambda c: rules.progress_percent(c.try_cast("double"))
    assert apply(spark, percent, ["120", "55.5", "x"]) == [100.0, 55.5, 0.0]
    levels = ["high", "MEDIUM", "low", "", None, "odd"]
    assert apply(spark, rules.confidence_label, levels) == ["High", "Medium", "Low", "Unknown", "Unknown", "Odd"]
    display = lambda c: rules.confidence_percent(rules.confidence_label(c))
    assert apply(spark, display, levels) == [100, 60, 30, 10, 10, 10]
    assert apply(spark, rules.risk_rank, ["Critical", "high", "Medium", "LOW", "x", None]) == [4, 3, 2, 1, 0, 0]
