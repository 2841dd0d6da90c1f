"""Near-duplicate groups, batches against history and cross-split overlaps, against brute force on small tables."""

import random
import threading
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seedloom.llm import batch_history, cells, cross_split, fingerprint, near_groups
from seedloom.llm.base import gram_codes, jaccard, normalise

WORDS = "amber brook cedar delta ember fjord grove haven islet jetty knoll larch meadow north orchard pier quarry ridge shore tower under valley willow yard".split()


def similarity(a, b):
    return jaccard(gram_codes(a), gram_codes(b))


def corpus(seed, n):
    """Texts of which some are edits of others, with copies, nulls, blanks, short and repeated texts."""
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(12, 30))) for _ in range(n // 3)]
    out = [None, "", "  ", "ab", "abc", "ABC", "ünïcode   text", "x" * 5000, "x" * 5000]
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 7)):
            kind, at = rng.randrange(4), rng.randrange(len(words))
            if kind == 0:
                words[at] = rng.choice(WORDS)
            elif kind == 1:
                words.insert(at, rng.choice(WORDS))
            elif kind == 2 and len(words) > 5:
                words.pop(at)
            else:
                words[at] = words[at][1:] + "q"
        out.append(" ".join(words).replace(" ", rng.choice([" ", " ", "  ", "\n"])) if rng.random() < 0.9 else " ".join(words).upper())
    return out


def true_groups(texts):
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    codes = {i: gram_codes(t) for i, t in texts.items()}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(codes[a], codes[b]) >= 0.7:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in ids:
        members[root(i)].append(i)
    return {(g, i) for g, m in members.items() if len(m) > 1 for i in m}


def frame(spark, texts, **more):
    rows = [(i, t, 7, *(v[i] for v in more.values())) for i, t in texts.items()]
    return spark.createDataFrame(rows, "row_id bigint, text string, a int" + "".join(f", {k} bigint" for k in more))


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Every block of more than two classes takes the leader path, in slices of three."""
    monkeypatch.setattr(fingerprint, "DIRECT_BLOCK", 2)
    monkeypatch.setattr(fingerprint, "SLICE", 3)
    monkeypatch.setattr(fingerprint, "ONE_TASK", 0)


@pytest.fixture
def long_lists(monkeypatch):
    """The list of shared blocks is too long to be broadcast."""
    monkeypatch.setattr(fingerprint, "SHORT_LIST", 0)


def test_similarity_follows_the_statement():
    assert normalise("A \t B c ") == "a b c "
    assert similarity("abcd", "ABCD") == 1.0 and similarity("ab", "ab") == 0.0 and similarity(None, "abc") == 0.0
    assert similarity("abcd", "abce") == pytest.approx(1 / 3)


def test_fingerprints_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7, 0.9):
        common, extra = rng.integers(0, 2**60, 700), rng.integers(0, 2**60, 600)
        k = int(700 * share)
        a = np.unique(np.concatenate([common[:k], extra[: 350 - k // 2]]))
        b = np.unique(np.concatenate([common[:k], extra[350 - k // 2 :][: 350 - k // 2]]))
        bits = [fingerprint.FINGERPRINT.compute(h, fingerprint.components_and_keys(h)[1]) for h in (fingerprint.hashed_grams(a), fingerprint.hashed_grams(b))]
        apart = sum(int(x ^ y).bit_count() for x, y in zip(bits[0].view(np.uint64), bits[1].view(np.uint64), strict=True))
        assert abs(apart / 192 - (1 - jaccard(a, b)) / 2) < 0.13


def test_pivot_distances_never_exceed_the_distance():
    rng = np.random.default_rng(2)
    for _ in range(50):
        pool = rng.integers(0, 2**60, 400)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        x, y = (batch_history.PIVOT_TABLE.compute(fingerprint.hashed_grams(v), None).view(np.uint64) for v in (a, b))
        lower = sum(int(p ^ q).bit_count() for p, q in zip(x, y, strict=True))
        assert lower <= len(np.setxor1d(a, b))


def test_groups_equal_brute_force(spark):
    texts = dict(enumerate(corpus(1, 150)))
    got = {(r.group_id, r.row_id) for r in near_groups.near_duplicate_groups(frame(spark, texts)).collect()}
    assert got == true_groups(texts)


def test_groups_by_the_leader_path(spark, tiny_blocks):
    texts = dict(enumerate(corpus(2, 150)))
    got = {(r.group_id, r.row_id) for r in near_groups.near_duplicate_groups(frame(spark, texts)).collect()}
    assert got == true_groups(texts)


def test_groups_with_a_long_list_of_blocks(spark, long_lists):
    texts = dict(enumerate(corpus(8, 120)))
    got = {(r.group_id, r.row_id) for r in near_groups.near_duplicate_groups(frame(spark, texts)).collect()}
    assert got == true_groups(texts)


def test_a_hot_group_is_one_group(spark):
    base = " ".join(WORDS)
    texts = {i: f"{base} {WORDS[i % 24]}{i % 7}" for i in range(400)} | {1000 + i: base for i in range(200)}
    got = near_groups.near_duplicate_groups(frame(spark, texts)).collect()
    assert len(got) == 600 and {r.group_id for r in got} == {0}


def test_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id bigint, text string")
    assert near_groups.near_duplicate_groups(empty).count() == 0
    assert near_groups.near_duplicate_groups(frame(spark, {1: None, 2: "", 3: "ab", 4: "ab"})).count() == 0


def true_repeats(texts, batch):
    codes = {i: gram_codes(t) for i, t in texts.items()}
    return {b for b in texts for a in texts if batch[a] is not None and batch[b] is not None and batch[a] < batch[b] and jaccard(codes[a], codes[b]) >= 0.7}


def batched(seed, n):
    texts = dict(enumerate(corpus(seed, n)))
    rng = random.Random(seed)
    return texts, {i: rng.choice([0, 0, 1, 2, 3]) if i else None for i in texts}


def test_repeats_equal_brute_force(spark):
    texts, batch = batched(3, 150)
    got = {r.row_id for r in batch_history.repeats_of_earlier(frame(spark, texts, batch_no=batch)).collect()}
    assert got == true_repeats(texts, batch)


def test_repeats_by_the_leader_path(spark, tiny_blocks):
    texts, batch = batched(4, 150)
    got = {r.row_id for r in batch_history.repeats_of_earlier(frame(spark, texts, batch_no=batch)).collect()}
    assert got == true_repeats(texts, batch)


def test_index_fed_batch_by_batch_gives_the_same(spark, tmp_path):
    texts, batch = batched(5, 100)
    df = frame(spark, texts, batch_no=batch)
    index, found = batch_history.BatchIndex(spark, str(tmp_path / "index")), set()
    assert index.probe(df).count() == 0
    for k in range(4):
        new = df.filter(F.col("batch_no") == k)
        found |= {r.row_id for r in index.probe(new).collect()}
        index.append(new)
    assert found == true_repeats(texts, batch)


def test_index_outlives_its_session_and_takes_several_batches(spark, tmp_path):
    texts, batch = batched(6, 100)
    df, path = frame(spark, texts, batch_no=batch), str(tmp_path / "index")
    first = batch_history.BatchIndex(spark, path, buckets=3)
    assert first.add(df.filter("batch_no = 0")).count() == 0
    for kind in ("cells", "records"):
        spark.sql(f"DROP TABLE {first.name}_{kind}")  # what a new session doesn't know; the files stay
    index = batch_history.BatchIndex(spark, path, buckets=7)
    found = {r.row_id for part in ("batch_no in (1, 2)", "batch_no = 3") for r in index.add(df.filter(part)).collect()}
    assert found == true_repeats(texts, batch) and index.buckets == 3
    index.drop()
    assert index.probe(df).count() == 0


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id bigint, text string, batch_no bigint")
    assert batch_history.repeats_of_earlier(empty).count() == 0


@pytest.mark.parametrize("per_shard", [250_000, 300])
def test_overlaps_equal_brute_force(spark, monkeypatch, per_shard):
    monkeypatch.setattr(cross_split, "SHARD_PASSAGES", per_shard)
    texts = dict(enumerate(corpus(6, 240)))
    train, held = {i: t for i, t in texts.items() if i % 3}, {i: t for i, t in texts.items() if i % 3 == 0}
    got = {(r.train_id, r.eval_id) for r in cross_split.cross_split_overlaps(frame(spark, train), frame(spark, held)).collect()}
    codes = {i: gram_codes(t) for i, t in texts.items()}
    assert got == {(a, b) for a in train for b in held if jaccard(codes[a], codes[b]) >= 0.7}


def test_overlaps_of_nothing(spark):
    empty, some = spark.createDataFrame([], "row_id bigint, text string"), frame(spark, {1: "a text of some length", 2: None})
    assert cross_split.cross_split_overlaps(empty, some).count() == 0
    assert cross_split.cross_split_overlaps(some, empty).count() == 0


def test_copies_on_both_sides_pair_up(spark):
    train, held = frame(spark, dict.fromkeys(range(5), "one and the same text")), frame(spark, dict.fromkeys(range(10, 14), "one and the same text"))
    assert cross_split.cross_split_overlaps(train, held).count() == 20


def test_passages_cover_the_text_and_merge():
    text = "".join(random.Random(1).choices("abcdefgh ", k=250))
    for t in (text, text.replace(" ", "")):
        parts = cross_split.passages(t)
        assert cross_split.coverage(parts, f" {t}") == 1.0 and cross_split.coverage(parts, "") == 0.0
        assert sum(len(p) for _, p in parts) > len(t) / 2
    assert cross_split.coverage([(0, "abcd"), (2, "cdef")], "abcd") == 0.5


def edited(text, kind, rng):
    """A copy with neighbouring words swapped in pairs, or with substitutions of single characters, evenly or anywhere."""
    if kind == "words swapped":
        words = text.split(" ")
        return " ".join(w for i in range(0, len(words), 2) for w in reversed(words[i : i + 2]))
    places = range(7, len(text), 21) if kind == "even substitutions" else rng.sample(range(len(text)), len(text) // 21)
    chars = list(text)
    for at in places:
        chars[at] = rng.choice("0123456789")
    return "".join(chars)


@pytest.mark.parametrize("kind", ["words swapped", "even substitutions", "random substitutions"])
def test_overlaps_of_edited_copies_equal_brute_force(spark, kind):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(6, 14)))
    held = {i: " ".join(word() for _ in range(30)) for i in range(60)}
    train = {1000 + i: edited(text, kind, rng) for i, text in held.items()}
    want = {(a, b) for a, x in train.items() for b, y in held.items() if similarity(x, y) >= 0.7}
    assert len(want) > 40
    assert {(r.train_id, r.eval_id) for r in cross_split.cross_split_overlaps(frame(spark, train), frame(spark, held)).collect()} == want


def test_passages_reach_the_end():
    text = "".join(random.Random(2).choices("abcdefgh ", k=251))
    for t in (text, text.replace(" ", ""), text[:50]):
        assert "".join(p for _, p in cross_split.passages(t)) == f" {t}"


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def test_repeats_shuffle_little_at_a_time(spark, tmp_path):
    rng = random.Random(12)
    some = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(80)]
    texts = {i: " ".join(rng.choices(some, k=40)) for i in range(3000)}
    df = frame(spark, texts, batch_no={i: i % 3 for i in texts})
    index, before, most, done = batch_history.BatchIndex(spark, str(tmp_path / "index")), shuffle_bytes(spark), [0], threading.Event()

    def watch():
        while not done.wait(0.1):
            most.append(shuffle_bytes(spark) - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    index.add(df)
    done.set()
    watcher.join()
    assert max(most) < 350 * len(texts)
    index.drop()


@pytest.mark.parametrize("crowd", [(0, 64, 50_000), (1, 64, 0), (1000, 0, 0)])
def test_repeats_in_crowded_cells_equal_brute_force(spark, monkeypatch, tmp_path, crowd):
    most, kept, few = crowd
    monkeypatch.setattr(cells, "direct", lambda: most)
    monkeypatch.setattr(cells, "KEPT", kept)
    monkeypatch.setattr(cells, "FEW", few)
    monkeypatch.setattr(cells, "CHUNK", 7)
    texts, batch = batched(13, 120)
    df = frame(spark, texts, batch_no=batch)
    index = batch_history.BatchIndex(spark, str(tmp_path / "index"))
    found = {r.row_id for part in ("batch_no < 3", "batch_no = 3") for r in index.add(df.filter(part)).collect()}
    assert found == true_repeats(texts, batch)
    index.drop()


@pytest.mark.parametrize("words", [40, 300])
def test_unlike_texts_are_ruled_out_unread(spark, tmp_path, words):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    common = [word() for _ in range(1500)]
    df = frame(spark, {i: " ".join(rng.choices(common, k=words)) for i in range(200)})
    cross_split._prepared(df, "row_id", "text").coalesce(1).write.parquet(str(tmp_path / "shard"))
    shard, rows = cross_split._Shard((tmp_path / "shard").as_uri(), 0.7), pq.read_table(tmp_path / "shard").sort_by("n")
    pairs = sum(len(records) for _, records in shard.candidates(rows["n"].to_numpy().astype(np.int64), cross_split._bits(rows)))
    assert 200 <= pairs < 300


def test_overlaps_of_texts_of_all_lengths_equal_brute_force(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    held = {i: " ".join(word() for _ in range(rng.choice([1, 4, 70, 80, 150, 400, 900]))) for i in range(60)}
    # edits, and copies of which up to a third is cut off, so that bitmaps of different widths meet
    train = {1000 + i: edited(t, "random substitutions", rng) for i, t in held.items()} | {2000 + i: t[: int(len(t) * rng.uniform(0.66, 1))] for i, t in held.items()}
    want = {(a, b) for a, x in train.items() for b, y in held.items() if similarity(x, y) >= 0.7}
    assert len(want) > 80
    assert {(r.train_id, r.eval_id) for r in cross_split.cross_split_overlaps(frame(spark, train), frame(spark, held)).collect()} == want
