"""Text read with a wrong character encoding (problem 8): a noisy-channel decoder.

A channel is a chain of (true encoding, wrong encoding) that text may have gone through. Per channel, a token is turned
back into bytes and read anew. A byte of a multi-byte sequence that was lost, dropped or replaced by '?', a space or
U+FFFD, is a wildcard of the lattice, and the bytes that survived say which characters may stand there. Tokens and character pairs, counted over the whole
corpus, score every reading, and a Viterbi search over the tokens of a document chooses where which channel acted.
Counting is repeated once on the decoded corpus, so that garbled forms stop counting as words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Workspace, table

#: Tokens and character pairs of the model, at most: bounds what every worker holds.
MODEL_TOKENS, MODEL_PAIRS = 200_000, 100_000
#: Tokens whose readings every worker holds, at most.
TABLE = 200_000
#: Counts below this are left out of the model: what stands once in the whole corpus is no evidence for its spelling.
LEAST = 2
#: Characters tried for a character of which no byte is left, besides those seen next to its neighbours.
FILL = 120
#: Log-odds of entering, leaving and changing a channel; of one well-formed multi-byte sequence; of one lost byte.
ENTER, LEAVE, CHANGE, FORMED, LOST = -6.0, -1.0, -8.0, 3.0, -4.0

# Encodings that UTF-8 is read as by mistake, and single-byte encodings taken for each other.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp1254", "cp1257"]
SINGLE = ["cp1252", "cp1250", "cp1251", "mac_roman", "iso8859-2", "cp437", "cp850", "koi8-r", "cp866", "iso8859-5"]
REPLACED = "�"
#: a byte of the lattice that may be any
LOST_BYTE = -1

Channel = tuple[tuple[str, str], ...]
CHANNELS: list[Channel] = [
    *((("utf-8", wrong),) for wrong in READ_AS),
    *((("utf-8", a), ("utf-8", b)) for a, b in (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("mac_roman", "mac_roman"), ("cp1250", "cp1250"), ("cp437", "cp437"), ("cp1252", "latin-1"))),
    *((("utf-8", "cp1252"),) * 3,),
    *(((true, wrong),) for true, wrong in product(SINGLE, SINGLE) if true != wrong),
]

#: ASCII letters and anything beyond ASCII; other ASCII means the same in every encoding here, so tokens may end there.
#: A question mark between such characters may be a lost byte.
_TOKEN = re.compile(r"(?<![A-Za-z\x80-\U0010ffff])[A-Za-z\x80-\U0010ffff]*[\x80-\U0010ffff](?:[A-Za-z\x80-\U0010ffff]|(?<=[\x80-\U0010ffff])\?(?=[A-Za-z\x80-\U0010ffff]))*")

_BEYOND = re.compile(r"[^\x00-\x7f]")
#: what is left of a sequence with a lost byte: lead, the bytes after it with wildcards, how many there were
Partial = tuple[int, tuple[int, ...], int]


def _byte_table(encoding: str) -> dict[str, int]:
    """Character to byte; bytes without a character count as the control character of that number, as readers do."""
    table_ = {}
    for b in range(256):
        try:
            char = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            char = chr(b)
        table_.setdefault(char, b)
    return table_


_BYTES = {e: _byte_table(e) for e in {*READ_AS, *SINGLE}}
_CHARS = {e: {b: c for c, b in t.items()} for e, t in _BYTES.items()}


def _from_utf8(data: list[int]) -> tuple[str, int, int, list[Partial | None]] | None:
    """(text, well-formed sequences, lost bytes, what is left of each character marked ``REPLACED``) of a byte string,
    or None if it isn't UTF-8 from which single bytes of sequences were lost.

    A sequence of two, three or four bytes may lack one byte after its lead. It may be missing without a trace, or a
    wildcard or a question mark in its place.
    """
    out, partial, formed, lost, i = [], [], 0, 0, 0
    while i < len(data):
        lead = data[i]
        if 0 <= lead < 0x80:
            out.append(chr(lead))
            i += 1
            continue
        if lead == LOST_BYTE:
            out.append(REPLACED)
            partial.append(None)
            lost += 1
            i += 1
            continue
        need = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
        if not need:
            return None
        tail: list[int] = []
        for b in data[i + 1 : i + 1 + need]:
            if b == 0x3F and LOST_BYTE not in tail:
                b = LOST_BYTE
            if b != LOST_BYTE and not 0x80 <= b < 0xC0:
                break
            tail.append(b)
        known = len(tail) - tail.count(LOST_BYTE)
        if known == need:
            try:
                out.append(bytes([lead, *tail]).decode("utf-8"))
            except UnicodeDecodeError:
                return None
            formed += 1
        elif known == need - 1:
            out.append(REPLACED)
            partial.append((lead, tuple(tail), need))
            lost += 1
        else:
            return None
        i += 1 + len(tail)
    return "".join(out), formed, lost, partial


@lru_cache(maxsize=100_000)
def _agrees(char: str, left: Partial) -> bool:
    """Could a character have left these bytes?"""
    lead, tail, need = left
    own = char.encode("utf-8", "surrogatepass")
    if own[0] != lead or len(own) != need + 1:
        return False
    if len(tail) == need:
        return all(b in (LOST_BYTE, c) for b, c in zip(tail, own[1:], strict=True))
    return any(all(b in (LOST_BYTE, own[1 + i]) for b, i in zip(tail, places, strict=True)) for places in combinations(range(need), len(tail)))


def _completions(left: Partial) -> list[str]:
    """All characters that could have left these bytes, one of which is lost."""
    lead, tail, need = left
    known = [b for b in tail if b != LOST_BYTE]
    places = [tail.index(LOST_BYTE)] if LOST_BYTE in tail else range(need)
    found = []
    for at in places:
        for b in range(0x80, 0xC0):
            try:
                found.append(bytes([lead, *known[:at], b, *known[at:]]).decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return sorted(set(found))


def _undo(token: str, channel: Channel) -> tuple[str, int, int, list[Partial | None]] | None:
    """(original, well-formed sequences, lost bytes, what is left of lost characters) of a token that went through the
    channel; None if it can't have."""
    formed = lost = 0
    partial: list[Partial | None] = []
    for true, wrong in reversed(channel):
        codes = _BYTES[wrong]
        data = []
        for c in token:
            b = LOST_BYTE if c == REPLACED else codes.get(c, ord(c) if ord(c) < 0xA0 else None)
            if b is None:
                return None
            data.append(b)
        if true == "utf-8":
            read = _from_utf8(data)
            if read is None:
                return None
            token, formed, lost, partial = read[0], formed + read[1], lost + read[2], read[3]
        else:
            chars = _CHARS[true]
            token = "".join(REPLACED if b == LOST_BYTE else chars.get(b, chr(b)) for b in data)
            partial = [None] * token.count(REPLACED)
    return token, formed, lost, partial


#: per wrong encoding, the characters beyond ASCII that text read as it can hold
_POSSIBLE = {e: frozenset(c for c in t if ord(c) > 127) | frozenset(map(chr, range(0x80, 0xA0))) | {REPLACED} for e, t in _BYTES.items()}


class Model:
    """Scores of tokens by corpus counts, with character pairs behind them, and the fitting of lost characters."""

    def __init__(self, tokens: dict[str, int], pairs: dict[str, int]) -> None:
        self.total = math.log(sum(tokens.values()) + 1)
        self.tokens = {t: math.log(c) for t, c in tokens.items()}
        self.pairs, self.before, self.chars = pairs, Counter(), Counter()
        for pair, c in pairs.items():
            self.before[pair[0]] += c
            self.chars[pair[1]] += c
        self.all = sum(self.chars.values()) + 1
        self.masks: dict[str, list[tuple[float, str]]] = {}
        for t, c in sorted(self.tokens.items(), key=lambda x: (-x[1], x[0])):
            if REPLACED not in t:
                self.masks.setdefault(_mask(t), []).append((c, t))
        self.usual = [c for c, _ in self.chars.most_common(FILL) if ord(c) > 127 and c != REPLACED]
        self.beside: dict[str, set[str]] = {}
        for pair in pairs:
            for near, c in (pair, pair[::-1]):
                if ord(c) > 127 and c != REPLACED:
                    self.beside.setdefault(near, set()).add(c)
        self.options: dict[Partial, list[str]] = {}
        self.kept: dict[str, tuple[float, list[tuple[int, float, str]]]] = {}

    def _step(self, last: str, c: str) -> float:
        return math.log((self.pairs.get(last + c, 0) + 5 * (self.chars[c] + 0.05) / self.all) / (self.before[last] + 5))

    def score(self, token: str) -> float:
        value = -self.total - 1.0
        last = "^"
        for c in token:
            if ord(c) > 127 or ord(last) > 127:
                value += self._step(last, c)
            last = c
        return max(value, self.tokens.get(token, -math.inf) - self.total)

    def _choices(self, left: Partial | None, near: tuple[str, str]) -> list[str]:
        """Characters that may stand for a lost one: of the corpus, those its bytes agree with, or, if it has none, all
        they agree with; without any byte, those seen next to its neighbours and the most frequent ones."""
        if left is None:
            return [*{*self.usual, *self.beside.get(near[0], ()), *self.beside.get(near[1], ())}]
        if left not in self.options:
            self.options[left] = [c for c in self.chars if ord(c) > 127 and _agrees(c, left)] or _completions(left)
        return self.options[left]

    def fitted(self, token: str, partial: list[Partial | None] | None = None, search: bool = True) -> str | None:
        """The likeliest token with its lost characters filled in, by ``partial`` or by any; without a known one, a Viterbi
        search over pairs, or None. What nothing can stand for stays ``REPLACED``."""
        places = [i for i, c in enumerate(token) if c == REPLACED]
        left = dict(zip(places, partial or [None] * len(places), strict=True))
        for _, known in self.masks.get(_mask(token), ()):
            if all(a == b or i in left and (left[i] is None or _agrees(b, left[i])) for i, (a, b) in enumerate(zip(token, known, strict=True))):
                return known
        if not search:
            return None
        paths = {"^": (0.0, "")}
        for i, c in enumerate(token):
            options = [c]
            if i in left:
                near = token[i - 1] if i else "^", token[i + 1] if i + 1 < len(token) else "$"
                options = self._choices(left[i], near) or options
            paths = {o: max((v + self._step(last, o), path + o) for last, (v, path) in paths.items()) for o in options}
        return max(paths.values())[1]

    def readings(self, token: str) -> tuple[float, list[tuple[int, float, str]]]:
        """Score of a token as it stands, and (channel, score, original) of those other readings of it that the best path
        through a document may take: instead of one that is worse than leaving the channel for this token and
        entering it anew, every path would do better to read the token as it stands."""
        if token in self.kept:
            return self.kept[token]
        plain, found, scored = self.score(token), [], {}
        beyond = frozenset(c for c in token if c > "\x7f")
        possible = {e for e, chars in _POSSIBLE.items() if beyond <= chars}
        for k, channel in enumerate(CHANNELS):
            if channel[-1][1] not in possible:
                continue
            read = _undo(token, channel)
            if not read or read[0] == token:
                continue
            text, formed, lost, partial = read
            key = (text, tuple(partial))
            if key not in scored:
                # a letter that could be a lead with nothing after it is no evidence unless it makes a known word
                bare = any(p and p[2] == 1 and not p[1] for p in partial) and not formed
                original = self.fitted(text, partial, search=not bare) if lost else text
                scored[key] = (-math.inf if original is None else self.score(original), original)
            value, original = scored[key][0] + FORMED * formed + LOST * lost, scored[key][1]
            if value >= plain + ENTER + LEAVE:
                found.append((k, value, original))
        if len(self.kept) > 100_000:
            self.kept.clear()
        self.kept[token] = plain, found
        return self.kept[token]


def _mask(token: str) -> str:
    return _BEYOND.sub(REPLACED, token)


class Readings:
    """The readings of a corpus' tokens: of the tokens that have any, in a table, if that is small enough."""

    def __init__(self, known: dict[str, tuple[float, list[tuple[int, float, str]]]], model: Model | None) -> None:
        self.known, self.model = known, model

    def readings(self, token: str) -> tuple[float, list[tuple[int, float, str]]]:
        found = self.known.get(token)
        if found is None:  # every path reads such a token as it stands, so its score says nothing
            found = (0.0, []) if self.model is None else self.model.readings(token)
        return found


def _decode(tokens: list[str], model: Model | Readings) -> list[tuple[int | None, str]]:
    """(channel or None, original) per token: the best path through clean text and channels."""
    best: dict[int | None, tuple[float, list]] = {None: (0.0, None)}
    for token in tokens:
        plain, others = model.readings(token)
        if not others and len(best) == 1:
            value, path = best[None]
            best = {None: (value + plain, ((None, token), path))}
            continue
        top = max(best.items(), key=lambda x: x[1][0])
        clean = max(((v + (LEAVE if k is not None else 0.0), (k, path)) for k, (v, path) in best.items()), key=lambda x: x[0])
        after: dict[int | None, tuple[float, tuple]] = {None: (clean[0] + plain, ((None, token), clean[1][1]))}
        for k, value, original in others:
            ways = [(top[1][0] + (ENTER if top[0] is None else CHANGE), top[1][1])]
            if None in best:
                ways.append((best[None][0] + ENTER, best[None][1]))
            if k in best:
                ways.append(best[k])
            way = max(ways, key=lambda x: x[0])
            after[k] = (way[0] + value, ((k, original), way[1]))
        best = after
    path, out = max(best.values(), key=lambda x: x[0])[1], []
    while path:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def _count(texts: DataFrame, readings: Readings | None) -> DataFrame:
    """(pair, key, c): counts of tokens beyond ASCII and of their character pairs over all texts, decoded first if there
    are ``readings``."""
    shared = texts.sparkSession.sparkContext.broadcast(readings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            pairs: Counter[str] = Counter()
            for token, c in count.items():
                last = "^"
                for char in token:
                    if ord(char) > 127 or ord(last) > 127:
                        pairs[last + char] += c
                    last = char
            both = [(False, k, v) for k, v in count.items()] + [(True, k, v) for k, v in pairs.items()]
            count.clear()
            pair, key, c = zip(*both, strict=True) if both else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.bool_()), pa.array(key, pa.string()), pa.array(c, pa.int64())], ["pair", "key", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = _TOKEN.findall(text) if text else []
                if tokens and shared.value:
                    tokens = [t for _, t in _decode(tokens, shared.value)]
                count.update(t for t in tokens if not t.isascii())
            if len(count) > 100_000:
                yield flush()
        yield flush()

    return texts.mapInArrow(run, "pair boolean, key string, c bigint").groupBy("pair", "key").agg(F.sum("c").alias("c"))


def _model(counts: DataFrame) -> Model:
    def most(pair: bool, limit: int) -> dict[str, int]:
        rows = counts.filter((F.col("pair") == pair) & (F.col("c") >= LEAST)).orderBy(F.desc("c"), "key").limit(limit)
        return {r.key: r.c for r in rows.select("key", "c").collect()}

    return Model(most(False, MODEL_TOKENS), most(True, MODEL_PAIRS))


def _read_once(work: Workspace, counts: DataFrame, model: Model) -> Readings:
    """The readings of all distinct tokens, each worked out once. If more than ``TABLE`` tokens have any, workers
    read the rest themselves when they meet them, with the same outcome."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, *r) for t in batch.column(0).to_pylist() if (r := shared.value.readings(t))[1]]
            token, plain, others = zip(*rows, strict=True) if rows else ([],) * 3
            ends = [0, *accumulate(map(len, others))]
            k, value, original = zip(*(x for o in others for x in o), strict=True) if rows else ([],) * 3
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((k, pa.int32()), (value, pa.float64()), (original, pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(plain, pa.float64()), *lists], ["token", "plain", "k", "value", "original"])

    spread = counts.filter(~F.col("pair")).select("key", "c").repartition(counts.sparkSession.sparkContext.defaultParallelism, "key").select("key")
    found = work.keep(spread.mapInArrow(run, "token string, plain double, k array<int>, value array<double>, original array<string>"), "readings")
    rows = found.limit(TABLE + 1).collect()
    known = {r.token: (r.plain, list(zip(r.k, r.value, r.original, strict=True))) for r in rows[:TABLE]}
    return Readings(known, model if len(rows) > TABLE else None)


def restored_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored, channels, whole) of the texts that hold a garbled sequence.

    ``restored`` is the text with the damaged tokens decoded, ``channels`` the encodings involved ("lost" for
    replacement characters) and ``whole`` tells that nothing stayed lost or guessed. Null, empty and pure ASCII texts
    are clean; texts are read whole, however long; repeated ids are each reported; an empty table gives an empty
    result. What is garbled only by channels that aren't listed, or beyond reading, is found only if it holds
    replacement characters.
    """
    # files of text are few and large; what follows is all computing, so it is spread over the cores first
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    work = Workspace(df.sparkSession, "mojibake")
    texts = work.keep(texts.repartition(4 * df.sparkSession.sparkContext.defaultParallelism), "texts")
    counts = work.keep(_count(texts.select("text"), None), "counts")
    again = work.keep(_count(texts.select("text"), _read_once(work, counts, _model(counts))), "counts")
    model = _model(again)
    shared = df.sparkSession.sparkContext.broadcast((model, _read_once(work, counts, model)))
    names = [" > ".join(f"{t} as {w}" for t, w in channel) for channel in CHANNELS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, how, whole = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                matches = list(_TOKEN.finditer(text))
                read = _decode([m.group() for m in matches], shared.value[1])
                used, sure, parts, end = set(), True, [], 0
                for m, (k, original) in zip(matches, read, strict=True):
                    token = m.group()
                    if k is None and REPLACED not in token:
                        continue
                    used.add("lost" if k is None else names[k])
                    if k is None:
                        original = shared.value[0].fitted(token)
                        sure = False  # a whole character is lost
                    elif (undone := _undo(token, CHANNELS[k])) and undone[2]:
                        sure = False
                    parts += [text[end : m.start()], original]
                    end = m.end()
                if used:
                    at.append(i)
                    out.append("".join(parts) + text[end:])
                    how.append(sorted(used))
                    whole.append(sure)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(how, pa.list_(pa.string())), pa.array(whole, pa.bool_())], ["id", "restored", "channels", "whole"])

    kind = dict(texts.dtypes)["id"]
    found = texts.mapInArrow(run, f"id {kind}, restored string, channels array<string>, whole boolean")
    return found.withColumnRenamed("id", id_col)


def p8_found(spark, sf_dir):
    return restored_texts(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id")


def p8_restored(spark, sf_dir):
    """The affected documents with their restored text, the encodings involved, and whether all could be regained."""
    return restored_texts(table(spark, sf_dir, "documents", "doc_id", "text"))
