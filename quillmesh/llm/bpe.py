"""Encoding of a whole corpus with a public byte-level BPE vocabulary by corpus-level merge replay.

1. Every text is cut into words by the tokenizer's own pattern and the words are counted over the whole corpus.
2. The most frequent ``head`` words are encoded together, in blocks: all bytes of all words lie in one linked list, an
   inverted index leads from a mergeable pair to its positions, and the merges are applied in rank order, each touching
   only the positions in its list and their neighbours.
3. The texts are encoded by looking words up. ``head`` bounds what is broadcast; words outside it are replayed by the
   same kernel within the batch that holds them, so every text gets its exact ids.

Defined results: a NULL or empty text has no ids (an empty list, 0 tokens); special tokens are never produced, their
strings are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
HEAD = 1 << 17
#: Characters of text whose words are held at once.
SLICE = 1 << 21

# fixed values: the pattern that the vocabulary was made with
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Words:
    """The words of a text by ``PATTERN``.

    The pattern's classes are spelled out for the standard module, which is twice as fast; they cover the Basic
    Multilingual Plane, and a text with a character beyond it takes the pattern as it is.
    """

    def __init__(self) -> None:
        import regex

        self.exact = regex.compile(PATTERN).findall
        chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

        def members(kind: str) -> str:
            runs = [(m.start(), m.end() - 1) for m in regex.finditer(kind + "+", chars)]
            at = lambda i: f"\\u{ord(chars[i]):04x}"
            return "".join(at(a) if a == b else f"{at(a)}-{at(b)}" for a, b in runs)

        letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
        self.fast = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+"
        ).findall

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if text.isascii() or max(text) < "\U00010000" else self.exact(text)


class Merges:
    """Ids of single bytes and, for every mergeable pair of ids, its rank and the id it becomes."""

    def __init__(self, raw: bytes) -> None:
        model = json.loads(raw)["model"]
        vocab = model["vocab"]
        # bytes that print stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_ids = [vocab[shown[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[a], vocab[b]] = len(self.result)
            self.result.append(vocab[a + b])

    def replay(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        byte_ids, rank, result = self.byte_ids, self.rank, self.result
        token: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(token))
            token += [byte_ids[b] for b in w.encode()]
            token.append(-1)  # no pair reaches over the end of a word
        size = len(token)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        index: dict[int, list[int]] = {}
        for i in range(size - 1):
            if (r := rank.get((token[i], token[i + 1]))) is not None:
                index.setdefault(r, []).append(i)
        queue = list(index)
        heapq.heapify(queue)
        pairs = list(rank) if queue else []
        while queue:
            r = heapq.heappop(queue)
            a, b = pairs[r]
            new = result[r]
            for i in sorted(index.pop(r)):
                j = after[i]
                if token[i] != a or token[j] != b:  # an earlier merge took one of the two
                    continue
                token[i], token[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                for at, pair in ((h, (token[h], new) if h >= 0 else None), (i, (new, token[k]))):
                    if pair and (s := rank.get(pair)) is not None:
                        if s in index:
                            index[s].append(at)
                        else:
                            index[s] = [at]
                            heapq.heappush(queue, s)
        out = []
        for i in starts:
            ids = []
            while token[i] != -1:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out


_cache: dict[object, object] = {}


def _once(key: object, make):
    """One value per Python worker."""
    if key not in _cache:
        _cache[key] = make()
    return _cache[key]


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``SLICE`` characters."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(word, n)`` over the whole corpus, pre-aggregated within each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _once("words", Words)
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for part in _slices(batch.column(0).to_pylist()):
                for t in part:
                    seen.update(words(t))
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    return df.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Words with their ids as flat arrays."""

    def __init__(self, words: list[str], ids: list[list[int]]) -> None:
        self.at = {w: i for i, w in enumerate(words)}
        self.length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.fromiter((x for w in ids for x in w), np.int32, int(self.length.sum()))


def encode(
    df: DataFrame, key: str, text: str, *, ids: bool = True, tokenizer: str = TOKENIZER, head: int = HEAD
) -> DataFrame:
    """``(key, ids)``, or with ``ids=False`` ``(key, n_tokens)``, of every row of ``df``."""
    spark = df.sparkSession
    with open(tokenizer, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _once(tokenizer, lambda: Merges(raw.value))
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.record_batch({"word": batch.column(0), "ids": pa.array(merges.replay(words), pa.list_(pa.int32()))})

    frequent = word_counts(df, text).orderBy(F.desc("n"), "word").limit(head)
    # at most `head` rows come to the driver, whatever the corpus
    found = frequent.select("word").repartition(8).mapInArrow(replay, "word string, ids array<int>").toArrow()
    lists = found.column("ids").combine_chunks()
    known = spark.sparkContext.broadcast(
        (found.column("word").to_pylist(), np.asarray(lists.value_lengths()), np.asarray(lists.flatten()))
    )
    token = f"vocabulary-{id(known)}-{spark.sparkContext.applicationId}"

    def vocabulary() -> Vocabulary:
        words, length, flat = known.value
        v = Vocabulary([], [])
        v.at = {w: i for i, w in enumerate(words)}
        v.length, v.flat = length.astype(np.int64), flat
        v.start = np.concatenate([[0], np.cumsum(v.length)])[:-1]
        return v

    def lookup(part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a slice: words per text, tokens per word, ids."""
        words, v = _once("words", Words), _once(token, vocabulary)
        all_words: list[str] = []
        per_text = np.empty(len(part), np.int64)
        for i, t in enumerate(part):
            w = words(t)
            per_text[i] = len(w)
            all_words += w
        get = v.at.get
        at = np.fromiter((get(w, -1) for w in all_words), np.int64, len(all_words))
        length, start, flat = v.length, v.start, v.flat
        rare = np.flatnonzero(at < 0)
        if len(rare):
            own = list(dict.fromkeys(all_words[i] for i in rare))
            extra = Vocabulary(own, _once(tokenizer, lambda: Merges(raw.value)).replay(own))
            at[rare] = [extra.at[all_words[i]] + len(length) for i in rare]
            length, start = np.concatenate([length, extra.length]), np.concatenate([start, extra.start + len(flat)])
            flat = np.concatenate([flat, extra.flat])
        tokens = length[at]
        if not ids:
            return per_text, tokens, flat[:0]
        ends = np.cumsum(tokens)
        total = int(ends[-1]) if len(ends) else 0
        return per_text, tokens, flat[np.repeat(start[at] - (ends - tokens), tokens) + np.arange(total)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in _slices(batch.column(1).to_pylist()):
                per_text, tokens, values = lookup(part)
                ends = np.concatenate([[0], np.cumsum(tokens)])[np.concatenate([[0], np.cumsum(per_text)])]
                keys = batch.column(0).slice(done, len(part))
                done += len(part)
                if ids:
                    result = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                else:
                    result = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([keys, result], ["key", "result"])

    kind = df.select(key).schema[0].dataType.simpleString()
    name = "ids" if ids else "n_tokens"
    out = df.select(key, text).mapInArrow(run, f"key {kind}, result {'array<int>' if ids else 'bigint'}")
    return out.select(F.col("key").alias(key), F.col("result").alias(name))
