import random

import pytest
from pyspark.sql import functions as F

from quillmesh.llm.bpe import TOKENIZER, Merges, Words, encode
from quillmesh.llm.containers import fill_containers, plan

TEXTS = ["", None, "Hello world", "  a\n\n\tb  ", "naïve café — „Übung“ 中文字 😀 x²½", "<|endoftext|> isn't", "aaaaaaaaaaaaaaaaaaaaaaa", "\x00\x1c\x85 z", "word " * 40_000, "x" * 30_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_words_agree_with_the_pattern():
    words = Words()
    chars = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x10000)]]
    for a in range(0, len(chars), 500):
        text = " a1 ".join(chars[a : a + 500])
        assert words.fast(text) == words.exact(text)


def test_replay_agrees_with_the_library(library):
    merges = Merges(open(TOKENIZER, "rb").read())
    r = random.Random(1)
    words = [" " + "".join(r.choices("abcdeésting ", k=r.randint(1, 14))).strip() for _ in range(2000)]
    for w, ids in zip(words, merges.replay(words)):
        assert ids == library(w) or len(w.split()) > 1


@pytest.mark.parametrize("head", [1, 1 << 17])
def test_encode(spark, library, head):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode(df, "doc_id", "text", head=head).collect()}
    assert got == {i: library(t) for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in encode(df, "doc_id", "text", ids=False, head=head).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


def test_encode_empty(spark):
    assert encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_plan_holds_every_size():
    r = random.Random(5)
    for _ in range(40):
        h = {s: r.randint(1, 50) for s in r.sample(range(1, 65), 20)}
        used = dict.fromkeys(h, 0)
        bins = 0
        for f in plan(h, (64,)):
            assert f.used <= f.window == 64 and f.count > 0
            bins += f.count
            for s, n in f.pattern.items():
                used[s] += n * f.count
        assert used == h
        rooms: list[int] = []
        for s in sorted((s for s, n in h.items() for _ in range(n)), reverse=True):
            i = min((i for i, room in enumerate(rooms) if room >= s), key=rooms.__getitem__, default=None)
            if i is None:
                rooms.append(64 - s)
            else:
                rooms[i] -= s
        assert bins <= len(rooms) + 1


def test_fill(spark):
    r = random.Random(2)
    sizes = [(i, 7 if i % 3 == 0 else r.randint(0, 230)) for i in range(900)] + [(1000, None), (1001, 100), (1002, 1000)]
    rows = fill_containers(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), "doc_id", capacity=100).collect()
    by, held = {}, {}
    for x in rows:
        by.setdefault(x.doc_id, []).append((x.token_start, x.token_end))
        held[x.container_id] = held.get(x.container_id, 0) + x.n_tokens
    assert max(held.values()) <= 100 and len(by) == len(sizes)
    for d, n in sizes:
        spans = sorted(by[d])
        assert spans[0][0] == 0 and spans[-1][1] == (n or 0) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == max(1, -(-(n or 0) // 100))
    assert len(held) <= 1.02 * sum(n or 0 for _, n in sizes) / 100 + 2
    assert fill_containers(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), "doc_id").count() == 0
    assert [x.container_id for x in fill_containers(spark.createDataFrame([(1, 0)], "doc_id bigint, n_tokens bigint"), "doc_id").collect()] == [0]
    assert spark.createDataFrame(rows).groupBy("step_group").agg(F.countDistinct("container_id").alias("n")).agg(F.max("n")).first()[0] <= 9
    tokens: dict[int, int] = {}
    for x in rows:
        tokens[x.step_group] = tokens.get(x.step_group, 0) + x.n_tokens
    assert max(tokens.values()) - min(tokens.values()) <= 100


def test_windows(spark):
    r = random.Random(4)
    sizes = [(i, r.choice([3, 20, 45, 90, 150, 250])) for i in range(700)] + [(2000, 900), (2001, 0)]
    rows = fill_containers(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), "doc_id", windows=(64, 256)).collect()
    held: dict[int, int] = {}
    for x in rows:
        held[x.container_id] = held.get(x.container_id, 0) + x.n_tokens
    window = {x.container_id: x.window for x in rows}
    assert all(n <= window[c] for c, n in held.items()) and set(window.values()) == {64, 256}
    assert len({(x.container_id, x.window) for x in rows}) == len(window)
    # a text is in a container of its window or a longer one
    assert all(x.window == 256 for x in rows if x.n_tokens > 64) and sum(held.values()) == sum(n for _, n in sizes)
    # item by item: the tightest gap of any container, else a new one of the shortest window that holds it
    rooms: list[list[int]] = []
    pieces = [min(256, n - at) for _, n in sizes for at in range(0, n, 256)]
    for n in sorted(pieces, reverse=True):
        gap = min((r for r in rooms if r[0] >= n), default=None)
        if gap is None:
            rooms.append([(64 if n <= 64 else 256) - n, 64 if n <= 64 else 256])
        else:
            gap[0] -= n
    assert sum(window.values()) <= sum(w for _, w in rooms) + 256
