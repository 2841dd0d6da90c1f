"""Tolerant reading of JSON in model responses.

Fences are stripped and members are read inside the JVM; only finding the JSON value in the text goes through a Python
function, batch by batch, because Spark's parser accepts tails, refuses prose before the value and repeated keys.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, clean_instruction, clean_pair_text, let, short_value, strip

PAIR_FLAGS = ["sensitive_label_correct", "nonsensitive_label_correct", "matched_pair", "copied_from_support", "accept"]
INSTANCE_FLAGS = ["label_correct", "natural", "copied_from_support", "accept"]


def without_fences(c: Column) -> Column:
    text = F.regexp_replace(strip(c), f"(?i)^[{SPACE}]*```(?:json)?[{SPACE}]*", "")
    return F.regexp_replace(text, f"[{SPACE}]*```[{SPACE}]*$", "")


def first_json(text: str | None) -> str | None:
    """The first JSON array or object in a text, written anew, or the whole text if it is JSON."""
    if text is None or not text.strip():
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], ensure_ascii=False)
        except ValueError:
            continue
    return None


def _searched(text: pd.Series) -> pd.Series:
    return text.map(first_json, na_action="ignore").astype(object).where(text.notna(), None)


def json_payload(c: Column) -> Column:
    """The JSON value in a response as text, or null; prose before it, fences and a tail after it are dropped."""
    return F.pandas_udf(_searched, "string")(without_fences(c))


def field(payload: Column, name: str) -> Column:
    """A string member of a JSON object; null if it is missing or no string."""
    member = F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant")
    return let(member, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def flag(payload: Column, name: str, native: bool = False) -> Column:
    """A boolean member, unless ``native`` also as the words true and false; numbers are not booleans."""
    member = F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant")

    def read(v: Column) -> Column:
        kind, word = F.schema_of_variant(v), F.lower(strip(F.try_variant_get(v, "$", "string")))
        found = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        return found if native else found.when((kind == "STRING") & word.isin("true", "false"), word == "true")

    return let(member, read)


def generated_pair(payload: Column) -> Column:
    """struct(sensitive_text, nonsensitive_text) of an object, or of a list of one; null unless both texts are clean."""
    value = F.try_parse_json(payload)
    alone = F.size(F.try_variant_get(value, "$", "array<variant>")) == 1
    one = F.coalesce(F.when(alone, F.to_json(F.try_variant_get(value, "$[0]", "variant"))), payload)

    def texts(x: Column) -> Column:
        return F.struct(*(clean_pair_text(field(x, n)).alias(n) for n in ("sensitive_text", "nonsensitive_text")))

    return let(let(one, texts), lambda p: F.when(p["sensitive_text"].isNotNull() & p["nonsensitive_text"].isNotNull(), p))


def pair_verdict(payload: Column) -> Column:
    """struct of the five flags and the reason; null if a flag is missing."""
    read = F.struct(*(flag(payload, n).alias(n) for n in PAIR_FLAGS), short_value(F.coalesce(field(payload, "reason"), F.lit(""))).alias("reason"))

    def whole(verdict: Column) -> Column:
        known = F.lit(True)
        for n in PAIR_FLAGS:
            known = known & verdict[n].isNotNull()
        return F.when(known, verdict)

    return let(read, whole)


def accepts_pair(verdict: Column) -> Column:
    right = verdict["sensitive_label_correct"] & verdict["nonsensitive_label_correct"] & verdict["matched_pair"]
    return F.coalesce(right & ~verdict["copied_from_support"] & verdict["accept"], F.lit(False))


def accepts_instance(payload: Column) -> Column:
    """Of the stricter verifier: all four flags native, three of them true and no copy."""
    label, natural, copied, accept = (flag(payload, n, native=True) for n in INSTANCE_FLAGS)
    return F.coalesce(label & natural & ~copied & accept, F.lit(False))


def instance_text(payload: Column) -> Column:
    return clean_pair_text(field(payload, "text"))


def instructions(payload: Column) -> Column:
    items = F.try_variant_get(F.try_parse_json(payload), "$.instructions", "array<variant>")
    texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", clean_instruction(F.try_variant_get(v, "$", "string"))))
    return F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t.isNotNull())


def string_list(payload: Column, name: str) -> Column:
    """A member as a list of strings: a list's stripped strings that aren't blank, a string as a list of one, else none."""
    member = F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "variant")

    def read(v: Column) -> Column:
        items = F.filter(F.transform(F.try_variant_get(v, "$", "array<string>"), strip), lambda x: x != "")
        alone = F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
        return F.coalesce(alone, items, F.array().cast("array<string>"))

    return let(member, read)


def rewrites(c: Column) -> Column:
    """Texts of a JSON list, of the outermost brackets if the rest is prose, else the lines without bullets and quotes."""
    whole = F.from_json(strip(c), "array<string>", {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(c, r"(?s)(\[.*\])", 1), "array<string>", {"mode": "PERMISSIVE"})
    lines = F.transform(
        F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"),
        lambda x: F.regexp_replace(strip(F.regexp_replace(x, f"^[{SPACE}]*[-*]?[{SPACE}]*\\d*[).:-]?[{SPACE}]*", "")), "^[\"'<>]+|[\"'<>]+$", ""),
    )
    texts = F.coalesce(F.transform(whole, strip), F.transform(inner, strip), lines)
    return F.filter(texts, lambda t: t != "")


def parsed_rubrics(cards: Column, positive: Column, negative: Column, most: Column | int) -> Column:
    """Of the cards of a response those with both conditions and a support of either kind from the context's ids, the
    first of each id, ``most`` at most; supports outside the context drop out."""

    def within(c: Column) -> Column:
        sides = (F.filter(F.coalesce(c[n], F.array().cast("array<string>")), lambda x: F.array_contains(ids, x)).alias(n) for n, ids in (("support_sensitive", positive), ("support_nonsensitive", negative)))
        return F.struct(*(c[n].alias(n) for n in ("position", "rubric_id", "sensitive_condition", "nonsensitive_condition")), *sides)

    def whole(c: Column) -> Column:
        texts = F.coalesce(F.length(c["sensitive_condition"]) > 0, F.lit(False)) & F.coalesce(F.length(c["nonsensitive_condition"]) > 0, F.lit(False))
        return texts & (F.size(c["support_sensitive"]) > 0) & (F.size(c["support_nonsensitive"]) > 0) & (c["rubric_id"] != "")

    def first(kept: Column) -> Column:
        return F.filter(kept, lambda c: F.forall(kept, lambda o: (o["rubric_id"] != c["rubric_id"]) | (o["position"] >= c["position"])))

    return F.slice(let(F.filter(F.transform(cards, within), whole), first), 1, most)


def rubric_cards(payload: Column) -> Column:
    """Array of (position, rubric_id, sensitive_condition, nonsensitive_condition, supports) of a list of cards, or of
    the member ``rubrics`` or ``cards`` of an object. Null members count as missing."""
    value = F.try_parse_json(payload)
    items = F.coalesce(*(F.try_variant_get(value, p, "array<variant>") for p in ("$", "$.rubrics", "$.cards")))

    def text(v: Column, name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    def card(v: Column, i: Column) -> Column:
        key = F.coalesce(F.nullif(strip(text(v, "rubric_id")), F.lit("")), F.nullif(strip(text(v, "card_id")), F.lit("")), F.concat(F.lit("R"), (i + 1).cast("string")))
        supports = [F.transform(F.try_variant_get(v, f"$.{n}", "array<string>"), strip).alias(n) for n in ("support_sensitive", "support_nonsensitive")]
        return F.struct((i + 1).alias("position"), key.alias("rubric_id"), *(short_value(text(v, n)).alias(n) for n in ("sensitive_condition", "nonsensitive_condition")), *supports)

    return F.transform(items, card)
