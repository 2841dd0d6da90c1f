"""Personal information and garbled text on hand-made corpora with known answers."""

import random

import pytest

from seedloom.llm import mojibake, personal_info

GIVEN, FAMILY = "Ann Bela Cora Dirk Emil Fay".split(), "Marlow Norden Ostman Pardoe Quist Rowan".split()
UNLISTED = ["Zorvath", "Yelland"]


def people(spark):
    rows = [(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [("van der Quist", "family"), (None, "given"), ("Rose", "given")]
    return spark.createDataFrame(rows, "name_part string, part_kind string")


def corpus():
    """(text, spans) with spans of (kind, start); the carrier phrases repeat, so that patterns can be learnt."""
    rng, rows = random.Random(4), []

    def add(template, *parts):
        text, spans = "", []
        for piece in template.split("|"):
            if piece.startswith("#"):
                kind, value = parts[int(piece[1:])]
                if kind:
                    spans.append((kind, len(text) + 1))
                text += value
            else:
                text += piece
        rows.append((text, spans))

    for i in range(60):
        g, f = rng.choice(GIVEN), rng.choice([*FAMILY, *UNLISTED])
        name = ("name", f"{g} {f}" if i % 3 else f"{g[0]}. {f}")
        add("the parcel was signed by |#0| (|#1|) while the lights were out.", name, ("email", f"{g.lower()}.{f.lower()}{i}@mail.example"))
        add("please ask |#0| to call |#1| about the green lamp.", name, ("phone", rng.choice(["+44 7700 900", "(555) 010-", "0044 7700 90"]) + f"{i:04d}"))
        add("our clerk wrote the passport no. |#0| on the lamp and went home.", ("id_number", f"X{rng.randrange(10**6, 10**7)}"))
        add("they keep it at |#0| near the lamp.", ("address", f"Flat {i}, {i + 3} Harrow Street" if i % 2 else f"{i} rue Marlin"))
        add("the order no. |#0| with the lamp left the shop.", (None, f"{rng.randrange(10**6, 10**7)}"))
        add("yesterday |#0| Stores sold the lamp to the rose shop.", (None, rng.choice(FAMILY)))
        add("the rose garden opens when the |#0| is done.", (None, "rose"))
    return rows


def found(spark, rows, names=None):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "row_id bigint, text string, kind string")
    spans = personal_info.personal_spans(df, people(spark) if names is None else names)
    return df, spans, {(r.row_id, r.pii_kind, r.start_pos) for r in spans.collect()}


def test_planted_information_is_found(spark):
    rows = corpus()
    _, _, got = found(spark, rows)
    want = {(i, kind, at) for i, (_, spans) in enumerate(rows) for kind, at in spans}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_placeholders_leave_the_rest_unchanged(spark):
    rows = corpus()
    df, spans, _ = found(spark, rows)
    out = {r.row_id: (r.text, r.redacted) for r in personal_info.redacted(df, spans).collect()}
    text, redacted = out[0]
    assert redacted == "the parcel was signed by [NAME] ([EMAIL]) while the lights were out."
    assert len(out) == len(rows) and out[6][0] == out[6][1]


@pytest.mark.parametrize("text", ["me AT: ann dot lee at mail dot example now", "write ann.lee [at] mail[dot]example now", "mailto:ann.lee+x@mail.example if"])
def test_spellings_of_addresses(text):
    e = personal_info.Extractor(frozenset(["me", "now", "write", "if"]), {})
    assert [text[s:].startswith("ann") for g, s, *_ in e.candidates(text) if g == "email"] == [True]


@pytest.mark.parametrize("mail", ["jane ( at ) example.com", "jane@ example.com", "jane ＠ example.com", "jane at example.com", "JANE\nAT\nexample.com", "jané at example.com"])
def test_signs_cover_every_spelling(mail):
    e = personal_info.Extractor(frozenset("write me now if".split()), {"ann": "given", "lee": "family"})
    text = f"write: {mail} now"
    assert [text[s:t] for g, s, t, *_ in e.candidates(text) if g == "email"] == [mail]
    for other in ("find me at ann.lee now", "Jane at ann.lee now", "jane at 10.30 now", "write at example.com now"):
        assert not [c for c in e.candidates(other) if c[0] == "email"]


def test_numbers_in_words_and_escaped_signs():
    e = personal_info.Extractor(frozenset("please ask to call and i live at the lamp shop".split()), {"ann": "given", "bela": "given"})
    text = "please ask Ann to call two one seven five five five zero one"
    assert [(g, text[s:]) for g, s, *_ in e.candidates(text) if g == "number"] == [("number", "two one seven five five five zero one")]
    seeds = [c[5] for c in e.candidates("Ann &amp; Bela live at the lamp; Norden &amp; Sons too") if c[0] == "name"]
    assert seeds == ["name", "name", "firm", "firm"]
    assert [t[1] for t in e.candidates("the lamp.  Ask Ann to call") if t[0] == "name"] == [15]


@pytest.mark.parametrize(
    "spoken",
    [
        "two one two, four four seven, eight nine three one",
        "Five one two, four four seven, eight nine three one",
        "ONE TWO THREE FOUR SIX SEVEN EIGHT",
        "double two triple three one one four six eight",
        "\u017fix one two three four seven eight",
    ],
)
def test_numbers_in_words_without_zero_or_five(spoken):
    e = personal_info.Extractor(frozenset("call me on now".split()), {})
    text = f"call me on {spoken} now"
    assert [text[s:t] for g, s, t, *_ in e.candidates(text) if g == "number"] == [spoken]


def test_handles_amounts_and_dates_are_none():
    e = personal_info.Extractor(frozenset("follow for news it costs on".split()), {"april": "given"})
    kinds = [c[0] for c in e.candidates("follow @lamp_shop for news, it costs 1583.50 on 13 March 2020")]
    assert "email" not in kinds and "number" not in kinds and "address" not in kinds


def test_odd_inputs(spark):
    rows = [(None, []), ("", []), ("   ", []), ("x" * 50_000, []), ("a@b.example " * 3, []), ("a@b.example " * 3, [])]
    _, _, got = found(spark, rows)
    assert {(r, a) for r, k, a in got if k == "email"} == {(r, a) for r in (4, 5) for a in (1, 13, 25)}
    assert found(spark, [])[2] == set()
    assert found(spark, corpus()[:20], people(spark).limit(0))[2]


CLEAN = ["Die Tür ist größer als früher und kostet 5 €.", "L'élève a déjà payé le café à l'entrée.", "El niño pidió una devolución más rápida.", "She said “never mind” — then left the café."]
WRONG = ["cp1252", "mac_roman", "cp437", "cp1250"]


def garbled():
    """(id, text, original) of many clean texts and a few that were read with a wrong encoding."""
    rows = [(i, CLEAN[i % 4], None) for i in range(400)]
    for i in range(40):
        text, wrong = CLEAN[i % 4], WRONG[i // 4 % 4]
        table = mojibake._CHARS[wrong]
        rows.append((1000 + i, "".join(table[b] for b in text.encode("utf-8")), text))
    rows.append((2000, "the caf� is closed", "the café is closed"))
    return rows


def test_garbled_texts_are_found_and_restored(spark):
    rows = garbled()
    df = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id bigint, text string, whole int")
    got = {r.doc_id: (r.restored, r.whole) for r in mojibake.restored_texts(df).collect()}
    assert set(got) == {i for i, _, original in rows if original}
    assert sum(got[i][0] == original for i, _, original in rows if original) >= 39
    assert got[2000] == ("the café is closed", False)


def test_single_byte_encodings(spark):
    text = "Die Tür ist größer als früher"
    wrong = "".join(mojibake._CHARS["mac_roman"][b] for b in text.encode("cp1252"))
    df = spark.createDataFrame([(i, CLEAN[i % 4]) for i in range(200)] + [(500, wrong)], "doc_id bigint, text string")
    got = mojibake.restored_texts(df).collect()
    assert [(r.doc_id, r.restored) for r in got] == [(500, text)]


def test_clean_look_alikes_and_odd_inputs(spark):
    texts = ["Keys marked Ã, Õ and Â are worn", "A SOLUÇÃO É SÃO BENTO", "├── intake.txt", None, "", " ", "plain ascii", "é" * 30_000, "Øystein Hall", "84°, not 33°"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id bigint, text string")
    assert mojibake.restored_texts(df).count() == 0
    assert mojibake.restored_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("wrong", mojibake.READ_AS)
def test_every_channel_is_undone(text, wrong):
    table = mojibake._CHARS[wrong]
    for token in mojibake._TOKEN.findall(text):
        if len(set(table.values())) == 256:
            assert mojibake._undo("".join(table[b] for b in token.encode("utf-8")), (("utf-8", wrong),))[0] == token


#: (what is left of a UTF-8 text read as cp1252 of which one byte was lost, the text); one of each length and place
LOST = [
    ("the cafÃ is closed", "the café is closed"),
    ("we say â€good dayâ€\x9d now", "we say “good day” now"),
    ("the price â\x82 was 5", "the price € was 5"),
    ("sent with ðŸ˜ and love", "sent with 😀 and love"),
    ("sent with ð�˜€ and love", "sent with 😀 and love"),
    ("crÃ?me and more", "crème and more"),
    ("crÃ�me and more", "crème and more"),
]


def test_lost_bytes_keep_the_others(spark):
    clean = ["the café is closed", "we say “good day” now", "the price € was 5", "sent with 😀 and love", "crème and more"]
    rows = [(i, clean[i % len(clean)]) for i in range(300)] + [(1000 + i, t) for i, (t, _) in enumerate(LOST)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.restored, r.whole) for r in mojibake.restored_texts(df).collect()}
    assert got == {1000 + i: (original, False) for i, (_, original) in enumerate(LOST)}


def test_lost_bytes_never_become_what_the_others_exclude():
    for char in "é€😀":
        data = list(char.encode("utf-8"))
        for gone in range(1, len(data)):
            for left in (data[:gone] + data[gone + 1 :], data[:gone] + [mojibake.LOST_BYTE] + data[gone + 1 :]):
                text, formed, lost, partial = mojibake._from_utf8(left)
                assert (text, formed, lost) == (mojibake.REPLACED, 0, 1)
                assert mojibake._agrees(char, partial[0]) and char in mojibake._completions(partial[0])
                assert not mojibake._agrees("à" if char == "é" and gone == 0 else "ж", partial[0])


def test_more_tokens_than_the_table_holds_are_read_by_the_workers(spark, monkeypatch):
    rows = garbled()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    whole = {tuple(r) for r in mojibake.restored_texts(df).select("doc_id", "restored").collect()}
    monkeypatch.setattr(mojibake, "TABLE", 2)
    assert {tuple(r) for r in mojibake.restored_texts(df).select("doc_id", "restored").collect()} == whole
