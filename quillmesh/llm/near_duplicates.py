"""Near-duplicate documents by a MinHash LSH forest with exact verification.

1. One pass over the texts makes, per document, a digest of its words and the minhashes of its distinct shingles.
   Documents of equal words are one class.
2. Every tree of the forest is labelled with a run of minhashes. The labels are sorted once, those of one shortest useful
   prefix together: a sorted trie, in which the documents under a node lie side by side. Labels that share no such prefix
   with another drop out there; of the rest the matched prefixes are shortened level by level. After every level the
   recall is estimated from the similarities found (each pair stands for 1 / p pairs, p the probability that the forest
   finds it at this level), until it reaches ``RECALL``; the shortest prefix is the one that finds a pair just at the
   threshold with probability ``SURE``.
3. Candidates whose sketches (two bits of each minhash) rule out the threshold by five standard deviations are dropped.
4. The rest is verified on whole shingle sets. These are made only for documents that pass a bitmap, so texts of documents
   without candidates are not shuffled.

Defined results: a NULL title or text counts as empty; a document of fewer than ``min_words`` words has no partner;
case, punctuation and spacing do not count. Words are runs of letters and digits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.pairs import same_key_pairs
from quillmesh.operators.components import connected_components
from quillmesh.session import materialize

TREES = 48
#: Minhashes of a label beyond its shortest prefix.
DEEPER = 1
RECALL = 0.9999
SURE = 0.995
#: Copies that are broadcast; more of them are taken out by a shuffled join.
COPIES = 2_000_000
#: Bits of the bitmap: 16 a document, between these bounds. Beyond the upper one it only lets more texts through.
BITMAP = (1 << 22, 1 << 27)

_words = re.compile(r"[^\W_]+").findall
_hashes: dict[str, int] = {}


def prefix_length(threshold: float, trees: int = TREES, recall: float = SURE) -> int:
    """The longest prefix, of at most 8, with which ``trees`` trees find a pair at the threshold with probability ``recall``."""
    depth = 8
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _word_hash(word: str) -> int:
    import xxhash

    if len(_hashes) > 500_000:
        _hashes.clear()
    h = _hashes[word] = xxhash.xxh64_intdigest(word)
    return h


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words, in order."""
    get = _hashes.get
    h = np.array([get(w) or _word_hash(w) for w in words], np.uint64)
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    titles, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for i, (title, text) in enumerate(zip(titles, texts)):
        yield i, _words(f"{title or ''} {text or ''}".lower())


def _signer(count: int):
    """Minhashes (16 bits of each) of concatenated shingle hashes, by document."""
    r = np.random.default_rng(20_011)
    factor = (r.integers(1, 1 << 32, count, np.uint64) | np.uint64(1)).astype(np.uint32)
    shift = r.integers(0, 1 << 32, count, np.uint64).astype(np.uint32)

    def sign(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(starts), count), np.uint16)
        for i in range(count):
            y = x * factor[i] + shift[i]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[:, i] = np.minimum.reduceat(y, starts) & np.uint32(0xFFFF)
        return out

    return sign


def _packed(minhashes: np.ndarray, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of minhashes by document: a key for each tree and its prefix of ``depth``, the ``DEEPER`` ones after it, the sketch."""
    m = minhashes.reshape(len(minhashes), trees, depth + DEEPER).astype(np.uint64)
    key = np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros(len(m), np.uint64)[:, None]
    for i in range(depth):
        key = (key ^ m[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    rest = np.zeros_like(key)
    for i in range(DEEPER):
        rest = (rest << np.uint64(16)) | m[:, :, depth + i]
    two = (minhashes & 3).astype(np.uint8)
    two = np.pad(two, ((0, 0), (0, -two.shape[1] % 4)))
    return key.astype(np.int64), rest.astype(np.int64), two[:, ::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6


def signatures(df: DataFrame, key: str, title: str, text: str, trees: int, depth: int, shingle: int, min_words: int) -> DataFrame:
    """``(doc, digest, keys, rests, sketch)`` of the documents of at least ``min_words`` words."""
    count = trees * (depth + DEEPER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signer(count)

        def made(ids: list, digests: list, parts: list) -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            keys, rests, sketch = _packed(sign(np.concatenate(parts), starts), trees, depth)
            lists = [pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, trees), pa.int32()), pa.array(x.ravel())) for x in (keys, rests)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests), *lists, pa.array([r.tobytes() for r in sketch])], ["doc", "digest", "keys", "rests", "sketch"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids, digests, parts, size = [], [], [], 0
            for i, words in _texts(batch):
                if len(words) < max(min_words, shingle):
                    continue
                ids.append(keys[i])
                digests.append(md5(" ".join(words).encode()).digest())
                parts.append(shingle_hashes(words, shingle))
                size += len(parts[-1])
                if size > 60_000:  # stays in the processor's cache
                    yield made(ids, digests, parts)
                    ids, digests, parts, size = [], [], [], 0
            if ids:
                yield made(ids, digests, parts)

    src = df.select(F.col(key).cast("bigint"), F.col(title), F.col(text))
    return src.mapInArrow(run, "doc bigint, digest binary, keys array<bigint>, rests array<bigint>, sketch binary")


def _companions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key another row has; one row is held, however many have a key."""
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(0))
        before = np.concatenate([[last is not None and k[0] == last], k[1:] == k[:-1]])
        after = np.concatenate([k[1:] == k[:-1], [False]])
        if held is not None and before[0]:
            yield held
        keep = before | after
        held = None if keep[-1] else batch.slice(batch.num_rows - 1)
        last = k[-1]
        yield batch.filter(pa.array(keep))


def _tries(classes: DataFrame) -> DataFrame:
    """``(key, rest, doc)`` of the labels that share their shortest prefix with another, from one sort of all labels."""
    labels = classes.select("doc", F.explode(F.arrays_zip("keys", "rests")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.rests").alias("rest"), "doc")
    return labels.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_companions, "key bigint, rest bigint, doc bigint")


def _agreement(count: int):
    """Share of equal two-bit values of two sketches, as an estimate of the similarity: a quarter agrees by chance."""
    spare = -count % 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        equal = np.array([sum(not (i >> 2 * j) & 3 for j in range(4)) for i in range(256)], np.uint8)
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            share = (equal[x ^ y].sum(axis=1, dtype=np.int64) - spare) / count
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((share - 0.25) / 0.75)], ["a", "b", "agreement"])

    return run


def _likely(met: DataFrame, sketches: DataFrame, trees: int, depth: int, threshold: float) -> DataFrame:
    """Pairs whose sketches allow the threshold, from prefixes shortened until the estimated recall is reached."""
    count = trees * (depth + DEEPER)
    # of the share that agrees, in units of the similarity
    by_chance = threshold + (1 - threshold) / 4
    slack = 5 * math.sqrt(by_chance * (1 - by_chance) / count) / 0.75
    for more in range(DEEPER, -1, -1):
        node = F.xxhash64("key", F.shiftright("rest", 16 * (DEEPER - more)))
        pairs = same_key_pairs(met.select(node.alias("node"), "doc"), "node", "doc").distinct().toDF("a", "b")
        for s in "ab":
            pairs = pairs.join(sketches.select(F.col("doc").alias(s), F.col("sketch").alias(f"s_{s}")), s)
        found = pairs.select("a", "b", "s_a", "s_b").mapInArrow(_agreement(count), "a bigint, b bigint, agreement double").where(F.col("agreement") >= threshold - slack)
        found = materialize(found, "likely")
        if not more:
            break
        chance = 1 - F.pow(1 - F.pow(F.greatest("agreement", F.lit(threshold)), F.lit(depth + more)), F.lit(trees))
        n, all_ = found.agg(F.count("*"), F.sum(1 / chance)).first()
        if n and n / all_ >= RECALL:
            break
    return found


def _bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Bit ``xxhash64(id) mod size`` of every id, and the size."""
    low, high = BITMAP
    bits = min(high, max(low, 1 << (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc"), F.lit(bits))
    words = ids.select((at / 32).cast("int").alias("word"), F.pow(F.lit(2.0), at % 32).cast("bigint").alias("bit"))
    out = np.zeros(bits // 32, np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return out, bits


def verified_pairs(
    df: DataFrame, key: str, title: str, text: str, threshold: float, shingle: int, min_words: int, trees: int = TREES
) -> tuple[DataFrame, DataFrame]:
    """``(a, b, similarity)`` of similar classes, a class named by its least document; and the members ``(doc, rep)``."""
    spark = df.sparkSession
    depth = prefix_length(threshold, trees)
    signed = materialize(signatures(df, key, title, text, trees, depth, shingle, min_words), "signatures")
    reps = signed.groupBy("digest").agg(F.min("doc").alias("rep"))
    members = materialize(signed.select("doc", "digest").join(reps, "digest").select("doc", "rep"), "members")
    copies = materialize(members.where("doc <> rep").select("doc"), "copies")
    copies = F.broadcast(copies) if copies.count() <= COPIES else copies
    met = materialize(_tries(signed.select("doc", "keys", "rests").join(copies, "doc", "left_anti")), "labels")
    likely = _likely(met, signed.select("doc", "sketch"), trees, depth, threshold)
    ids = likely.select(F.col("a").alias("doc")).union(likely.select("b")).distinct()
    bits, size = _bitmap(ids)
    bitmap = spark.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            at = np.asarray(batch.column(3))
            batch = batch.filter(pa.array((bits[at // 32] >> (at % 32)) & 1 == 1))
            keys = batch.column(0).to_pylist()
            docs, found, n = [], [], 0
            for i, words in _texts(batch):
                docs.append(keys[i])
                found.append(np.unique(shingle_hashes(words, shingle)).astype(np.int64))
                n += len(found[-1])
                if n > 500_000:
                    yield _listed(docs, found)
                    docs, found, n = [], [], 0
            if docs:
                yield _listed(docs, found)

    src = df.select(F.col(key).cast("bigint").alias("doc"), title, text).withColumn("at", F.pmod(F.xxhash64("doc"), F.lit(size)))
    made = materialize(src.mapInArrow(sets, "doc bigint, set array<bigint>"), "shingles")
    checked = likely
    for s in "ab":
        checked = checked.join(made.select(F.col("doc").alias(s), F.col("set").alias(f"set_{s}")), s)
    both = F.size(F.array_intersect("set_a", "set_b"))
    checked = checked.select("a", "b", (both / (F.size("set_a") + F.size("set_b") - both)).alias("similarity"))
    return checked.where(F.col("similarity") >= threshold), members


def _listed(docs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], ["doc", "set"])


def near_duplicate_pairs(df: DataFrame, key: str, title: str, text: str, threshold: float = 0.8, shingle: int = 5, min_words: int = 40) -> DataFrame:
    """``(key_a, key_b)``, a < b, of all similar documents, copies written out."""
    pairs, members = verified_pairs(df, key, title, text, threshold, shingle, min_words)
    m = lambda s: members.select(F.col("doc").alias(f"doc_{s}"), F.col("rep").alias(s))
    across = pairs.join(m("a"), "a").join(m("b"), "b")
    found = across.select(F.least("doc_a", "doc_b").alias("x"), F.greatest("doc_a", "doc_b").alias("y"))
    copies = same_key_pairs(members, "rep", "doc")
    return found.union(copies).toDF(f"{key}_a", f"{key}_b")


def near_duplicate_groups(df: DataFrame, key: str, title: str, text: str, threshold: float = 0.8, shingle: int = 5, min_words: int = 40) -> DataFrame:
    """One row ``(key, group_id, n_links)`` per document: its group (the least key in it) and the similar classes it has."""
    pairs, members = verified_pairs(df, key, title, text, threshold, shingle, min_words)
    pairs = materialize(pairs.select("a", "b"), "similar")
    groups = connected_components(pairs, "a", "b").toDF("rep", "group_id")
    links = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    known = members.join(groups, "rep", "left").join(links, "rep", "left")
    known = known.select(F.col("doc").alias(key), F.coalesce("group_id", "rep").alias("group_id"), "n_links")
    return (
        df.select(F.col(key).cast("bigint").alias(key))
        .join(known, key, "left")
        .select(key, F.coalesce("group_id", key).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
