"""Text, parsing and similarity rules on hand-made cases, and against plain Python."""

import json
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedloom.functions import parse, similarity
from seedloom.functions import text as t


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalise_and_tokens(spark):
    texts = ["  A b\n\tC ", "Don't stop—é1_x!", None, ""]
    assert column(spark, texts, t.normalise) == ["a b c", "don't stop—é1_x!", None, ""]
    assert column(spark, texts[1:2], t.tokens) == [["don", "'", "t", "stop", "—", "é1_x", "!"]]


def test_trigrams_guard_short_texts(spark):
    assert column(spark, ["ab", "abc", "aaaa", None], t.trigrams) == [[], ["abc"], ["aaa"], None]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Sensitive: <<<My phone is 0123456>>> tail", "My phone is 0123456"),
        ("first line of text\nsecond line", "first line of text"),
        ("\nsecond line only here", None),
        ("short", None),
        ('"quoted text of some length"', "quoted text of some length"),
        ("x" * 501, None),
        ("text with <<< inside it", None),
        ("", None),
        (None, None),
    ],
)
def test_clean_generated(spark, raw, want):
    assert column(spark, [raw], t.clean_generated) == [want]


def test_clean_pair_text_unwraps_twice(spark):
    assert column(spark, ["<<<'<<< a text  of length >>>'>>>", "<<<<<<>>>>>>", None], t.clean_pair_text) == ["a text of length", None, None]


@pytest.mark.parametrize(
    ("text", "reason"),
    [("", "blank"), ("Wait...", "ellipsis"), ('She said "no.', "open_quote"), ("And then,", "open_end"), ("No end", "no_end"), ("(open.", "open_bracket"), ("123.", "no_word"), ("He went to the.", "dangling_word"), ("All is well.", None)],
)
def test_incomplete_rules_in_order(spark, text, reason):
    assert column(spark, [text], t.incomplete_reason) == [reason]


def test_first_person_needs_word_boundaries(spark):
    assert column(spark, ["mine", "éme", "I'm", "Mexico", "our"], lambda c: t.has_word(c, t.FIRST_PERSON)) == [True, False, True, False, True]
    assert column(spark, ["our"], lambda c: t.has_word(c, t.FIRST_PERSON_SINGULAR)) == [False]


def test_instruction_and_short_value(spark):
    assert column(spark, ["Decide whether it is so.", "Decide whether", "Tell whether it is so or not."], t.clean_instruction) == ["Decide whether it is so.", None, None]
    assert column(spark, ["a" * 701, "b" * 700], t.short_value) == ["a" * 697 + "...", "b" * 700]


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure [x] {"a": 1} tail', {"a": 1}), ('{"a": ', None), ("[1, 2] tail", [1, 2]), ("plain", None), ("", None), (None, None), ('{"a":1,"a":2}', {"a": 2})],
)
def test_json_payload(spark, raw, want):
    (found,) = column(spark, [raw], parse.json_payload)
    assert (json.loads(found) if found is not None else None) == want


def test_flags_are_strict(spark):
    raws = ['{"f": true}', '{"f": " TRUE"}', '{"f": 1}', '{"f": null}', "{}"]
    assert column(spark, raws, lambda c: parse.flag(c, "f")) == [True, True, None, None, None]
    assert column(spark, raws, lambda c: parse.flag(c, "f", native=True)) == [True, None, None, None, None]


def test_pairs_of_objects_and_single_lists(spark):
    pair = {"sensitive_text": "My name is Ann Bee.", "nonsensitive_text": "The door is green."}
    raws = [json.dumps(pair), json.dumps([pair]), json.dumps([pair, pair]), json.dumps(pair | {"sensitive_text": 5})]
    assert [r is not None for r in column(spark, raws, parse.generated_pair)] == [True, True, False, False]


def test_instances_and_instructions(spark):
    assert column(spark, ['{"text": "A clean text here."}', '{"body": "A clean text here."}'], parse.instance_text) == ["A clean text here.", None]
    raw = json.dumps({"instructions": ["Decide whether it rains.", "Too short", 7]})
    assert column(spark, [raw, "[]"], parse.instructions) == [["Decide whether it rains."], []]
    ok = {"label_correct": True, "natural": True, "copied_from_support": False, "accept": True}
    assert column(spark, [json.dumps(ok), json.dumps(ok | {"accept": "true"}), json.dumps(ok | {"copied_from_support": True})], parse.accepts_instance) == [True, False, False]


def test_rewrites_of_lists_and_lines(spark):
    raws = ['["a b", " c "]', 'Sure: ["a b", "c"] ok', "1. a b\n- c\n\n2) d"]
    assert column(spark, raws, parse.rewrites) == [["a b", "c"], ["a b", "c"], ["a b", "c", "d"]]


def test_rubric_ids_fall_back_to_the_position(spark):
    raw = json.dumps({"cards": [{"rubric_id": "A"}, 3, {"card_id": "B"}, {"rubric_id": None}]})
    (cards,) = column(spark, [raw], parse.rubric_cards)
    assert [c.rubric_id for c in cards] == ["A", "R2", "B", "R4"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_lcs_equals_the_plain_table(a, b):
    assert similarity.lcs(a, b) == plain_lcs(a, b)


def test_jaccard_equals_python(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices(string.ascii_letters + "  ", k=rng.randrange(0, 30))) for _ in range(40)]
    pairs = list(zip(words, reversed(words), strict=True))
    grams = lambda s: {x[i : i + 3] for x in [re.sub(r"\s+", " ", s).lower()] for i in range(len(x) - 2)}
    want = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) and grams(b) else 0.0 for a, b in pairs]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.x for r in df.select("i", similarity.jaccard_trigrams(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == pytest.approx(want)
