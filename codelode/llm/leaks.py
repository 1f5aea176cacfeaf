"""Evaluation texts inside training texts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.skew import spread_join
from codelode.session import cut, cut_counted, spread_out

WORD = re.compile(r"[^\W_]+")
#: Words in a window; a shorter item is one window of its own length.
SPAN = 13
#: Items with fewer words than this must occur word for word; longer windows may be an edit away.
LEAST_EDITED = 6
#: Bits of a filter through which documents' keys pass, per key and at most; it is what is
#: broadcast. Items with more keys than fit are searched in several blocks, one filter each.
BITS_PER_KEY, MOST_FILTER_BITS = 64, 1 << 27


@dataclass(frozen=True)
class Plan:
    """How windows are hashed: steps sampled per walk, edits allowed, and the recall asked for.

    Equal windows always meet. How many walks it takes for windows an edit away to meet
    with the target recall is found by ``walks_for``.
    """

    target_recall: float = 0.93
    sample: int = 7
    max_edits: int = 1
    seed: int = 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (a published finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, case folded."""
    return [w.casefold() for w in WORD.findall(text)]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word, number of words per text)."""
    lists = [words(t) for t in texts]
    flat = [w for ws in lists for w in ws]
    codes, kinds = pd.factorize(np.array(flat, dtype=object)) if flat else (np.empty(0, int), np.empty(0, object))
    table = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in kinds), np.uint64, len(kinds))
    return table[codes] if len(kinds) else np.empty(0, np.uint64), np.array([len(ws) for ws in lists], dtype=np.int64)


def walk_keys(hashes: np.ndarray, starts: np.ndarray, lengths: list[int], walks: int, plan: Plan, backward: bool) -> dict[int, np.ndarray]:
    """Per length of window, the keys (starts x walks) of the windows that start there.

    CGK embedding: a walk reads the window's current word into the embedding and then, by a
    random bit of that word at that step, moves on or stays. An edit thus puts two walks
    out of step only from where it is and until they meet again, so that edit distance
    becomes Hamming distance. A key hashes the embedding at a few sampled steps. Walks
    take fewer steps than the window has words, so they end before the window does, whether a
    word was put in or left out; windows are walked from either end (``backward`` draws
    other bits and is given the words in reverse), so an edit near one end leaves the keys
    of the other as they are. All lengths share the walks.
    """
    last = max(lengths)
    keys = {n: np.empty((len(starts), walks), np.uint64) for n in lengths}
    padded = np.concatenate([hashes, np.zeros(last + 1, np.uint64)])
    for walk in range(walks):
        rng = np.random.default_rng([plan.seed, walk, int(backward)])
        coins = _mix(padded ^ np.uint64(rng.integers(1, 2**63)))
        order = rng.permutation(64)
        salt = np.uint64(rng.integers(1, 2**63))
        mine = {n: np.full(len(starts), salt ^ np.uint64(n)) for n in lengths}
        # The first steps read the window's first word in any case, so later ones tell more.
        taken = {n: {int(t) for t in order if t < max(1, n - 1)} if n < LEAST_EDITED else set([int(t) for t in order if t < n - 1][: plan.sample]) for n in lengths}
        at = starts.copy()
        for step in range(max(max(t) for t in taken.values()) + 1):
            here = padded[at]
            for n in lengths:
                if step in taken[n]:
                    mine[n] = _mix(mine[n] * np.uint64(31) + here)
            at += ((coins[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        for n in lengths:
            keys[n][:, walk] = mine[n]
    return keys


def _edited(words: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Copies of each row with one word replaced, left out and put in, at every place in turn."""
    n = words.shape[1]
    fresh = rng.integers(1, 2**63, len(words)).astype(np.uint64)
    at = np.arange(len(words)) % n
    rows = np.arange(len(words))
    swapped = words.copy()
    swapped[rows, at] = fresh
    out = np.stack([np.delete(r, k) for r, k in zip(words, at)])
    put = np.stack([np.insert(r, k, f) for r, k, f in zip(words, at, fresh)])
    return [swapped, out, put]


def walks_for(lengths: list[int], plan: Plan) -> int:
    """The walks from each end with which windows an edit away meet as often as asked.

    Measured on random windows of each length with one word replaced, left out or put in;
    the length, kind of edit and place in the window that meets least decides.
    """
    edited = [n for n in lengths if n >= LEAST_EDITED]
    if not edited or not plan.max_edits:
        return 1
    rng = np.random.default_rng(plan.seed)
    most, cases = 16, []
    for n in edited:
        plain = rng.integers(1, 2**63, (n * 150, n)).astype(np.uint64)
        for other in _edited(plain, rng):
            hit = np.zeros((len(plain), most), bool)
            for backward in (False, True):
                a, b = (x[:, ::-1] if backward else x for x in (plain, other))
                ka, kb = (walk_keys(np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], [n], most, plan, backward)[n] for x in (a, b))
                hit |= ka == kb
            cases.append(np.logical_or.accumulate(hit, axis=1).reshape(-1, n, most).mean(axis=0).min(axis=0))
    worst = np.min(cases, axis=0)
    good = np.flatnonzero(worst >= plan.target_recall)
    if not len(good):
        raise ValueError(f"a recall of {plan.target_recall} takes more than {most} walks; sample fewer steps")
    return int(good[0]) + 1


def edit_distance(a: np.ndarray, b: np.ndarray, slack: int = 0) -> np.ndarray:
    """Row by row, the least edit distance of a to a beginning of b that lacks or exceeds a's length by up to ``slack``."""
    n, m = a.shape[1], b.shape[1]
    before = np.tile(np.arange(m + 1, dtype=np.int16), (len(a), 1))
    for i in range(n):
        row = np.empty_like(before)
        row[:, 0] = i + 1
        for j in range(m):
            row[:, j + 1] = np.minimum(np.minimum(before[:, j + 1], row[:, j]) + 1, before[:, j] + (a[:, i] != b[:, j]))
        before = row
    return before[:, min(max(n - slack, 0), m) : n + slack + 1].min(axis=1)


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, n, win): the distinct windows of each item, as the bytes of their words' hashes; items without words have none."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, counts = hashed(batch["_text"].tolist())
            out, at = [], 0
            for key, count in zip(batch["_item"], counts):
                n = min(SPAN, int(count))
                seen = {hashes[at + i : at + i + n].tobytes() for i in range(count - n + 1)} if n else set()
                out += [(key, n, w) for w in seen]
                at += count
            yield pd.DataFrame(out, columns=["item_id", "n", "win"])

    rows = items.select(F.col(item_id).cast("long").alias("_item"), F.col(text).alias("_text")).dropna()
    return rows.mapInPandas(cut_up, "item_id long, n int, win binary").distinct()


def _rows(windows: list[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint64).reshape(-1, n)


def _keyed(windows: DataFrame, walks: int, plan: Plan) -> DataFrame:
    """(n, win, back, key): each distinct window under each of its keys, read from either end."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("n"):
                rows = _rows(part["win"].to_list(), int(n))
                for back in (False, True):
                    read = np.ascontiguousarray(rows[:, ::-1] if back else rows)
                    k = walk_keys(read.ravel(), np.arange(len(read)) * int(n), [int(n)], walks, plan, back)[int(n)].view(np.int64)
                    yield pd.DataFrame({"n": np.int32(n), "win": [r.tobytes() for r in read], "back": back, "keys": list(k)})

    told = windows.select("n", "win").distinct().mapInPandas(keys, "n int, win binary, back boolean, keys array<long>")
    return told.select("n", "win", "back", F.explode(F.array_distinct("keys")).alias("key"))


def _filter_of(keyed: DataFrame, size: int) -> np.ndarray:
    """The bits set by all keys, as size / 64 words; two bits per key."""
    bits = keyed.select(F.explode(F.array(F.pmod("key", F.lit(size)), F.pmod(F.shiftright("key", 32), F.lit(size)))).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("mask")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return out.view(np.uint64)


def _passes(keys: np.ndarray, mask: np.ndarray) -> np.ndarray:
    signed, size = keys.view(np.int64), len(mask) * 64
    hit = None
    for bit in (signed & (size - 1), (signed >> 32) & (size - 1)):
        ok = (mask[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        hit = ok if hit is None else hit & ok
    return hit


def _chunks(batches: Iterator[pd.DataFrame], limit: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Batches cut so that each holds about ``limit`` characters or one document."""
    for batch in batches:
        group = (batch["_text"].str.len().cumsum() // limit).to_numpy()
        for g in np.unique(group):
            yield batch[group == g]


CANDIDATE = "doc_id long, at long, n int, back boolean, key long, own binary"


def _candidates(documents: DataFrame, keyed: DataFrame, lengths: list[int], walks: int, size: int, plan: Plan) -> DataFrame:
    """Windows of documents whose key passes the filter of these keys: with their place, and the words from there on, one more than the window's."""
    mask = documents.sparkSession.sparkContext.broadcast(_filter_of(keyed, size))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _chunks(batches):
            hashes, counts = hashed(batch["_text"].tolist())
            ids = batch["_doc"].to_numpy()
            for back in (False, True):
                read, sizes, names = (hashes[::-1], counts[::-1], ids[::-1]) if back else (hashes, counts, ids)
                read = np.ascontiguousarray(read)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(read)) - (np.cumsum(sizes) - sizes)[owner]
                left = sizes[owner] - place
                starts = np.arange(len(read))
                padded = np.concatenate([read, np.zeros(SPAN + plan.max_edits + 1, np.uint64)])
                for n, keys in walk_keys(read, starts, lengths, walks, plan, back).items():
                    slack = plan.max_edits if n >= LEAST_EDITED else 0
                    row, walk = np.nonzero(_passes(keys, mask.value) & (left >= n - slack)[:, None])
                    if not len(row):
                        continue
                    # Words behind the document's end are no words of it.
                    own = padded[row[:, None] + np.arange(n + slack)]
                    own[np.arange(n + slack)[None, :] >= left[row][:, None]] = 0
                    at = np.where(back, sizes[owner[row]] - place[row] - n, place[row])
                    yield pd.DataFrame({"doc_id": names[owner[row]], "at": at, "n": np.int32(n), "back": back, "key": keys[row, walk].view(np.int64), "own": [o.tobytes() for o in own]})

    return documents.mapInPandas(probe, CANDIDATE)


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", plan: Plan = Plan(), filter_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, edits, n_windows): documents that hold a window of an item, or nearly.

    edits is the least edit distance in words between a window of the item and a stretch
    of the document that has as many words, or up to ``plan.max_edits`` more or fewer;
    n_windows tells at how many places of the document windows matched. Windows have 13
    words; an item of fewer words is one window, and one of fewer than LEAST_EDITED words
    must occur as it is. Windows at distance 0 are always found, those within
    ``plan.max_edits`` with the plan's target recall. Every window of every document is
    embedded and hashed, with no sample or cap. What is broadcast is a bit filter of
    ``filter_bits`` bits at most; where the items have more keys than fit, they are
    searched in blocks, each against all documents. What passes a filter is joined with the
    items' windows, salted by document, and its edit distance worked out exactly.

    Equal windows of different items, or of items delivered twice, are searched once.
    Documents or items with null ids or texts, or without words, match nothing. Documents
    delivered twice count as one row of the result. Empty tables give no rows.
    """
    per_item = cut(item_windows(items, item_id, text))
    lengths = sorted(r["n"] for r in per_item.select("n").distinct().collect())
    walks = walks_for(lengths, plan)
    keyed, n_keys = cut_counted(_keyed(per_item, walks, plan))
    blocks = max(1, math.ceil(n_keys * BITS_PER_KEY / filter_bits))
    size = 1 << max(16, (n_keys * BITS_PER_KEY // blocks).bit_length())
    rows = documents.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text")).dropna()
    rows = spread_out(rows, "_doc")

    @F.pandas_udf("int")
    def edits(own: pd.Series, win: pd.Series, n: pd.Series) -> pd.Series:
        out, sizes = np.zeros(len(own), np.int32), n.to_numpy()
        for k in np.unique(sizes):
            which = np.flatnonzero(sizes == k)
            slack = plan.max_edits if k >= LEAST_EDITED else 0
            out[which] = edit_distance(_rows(win.iloc[which].to_list(), k), _rows(own.iloc[which].to_list(), k + slack), slack)
        return pd.Series(out)

    near = []
    for block in range(blocks):
        mine = keyed if blocks == 1 else cut(keyed.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block))
        candidates = cut(_candidates(rows, mine, lengths, walks, size, plan)) if lengths else documents.sparkSession.createDataFrame([], CANDIDATE)
        met = spread_join(candidates, mine, ["n", "back", "key"], "inner", ["doc_id", "at"]).select("doc_id", "at", "n", "back", "own", "win").distinct()
        judged = met.select("doc_id", "at", "n", "back", "win", edits("own", "win", "n").alias("edits"))
        near.append(cut(judged.where(F.col("edits") <= F.when(F.col("n") >= LEAST_EDITED, plan.max_edits).otherwise(0))))
    # Windows that were read from behind have their words in reverse.
    both = per_item.withColumn("back", F.lit(False)).unionByName(_reversed(per_item))
    named = spread_join(reduce(DataFrame.unionByName, near), both, ["n", "back", "win"], "inner", ["doc_id", "at"])
    per_window = named.groupBy("doc_id", "item_id", "at").agg(F.min("edits").alias("edits"))
    return per_window.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.count(F.lit(1)).alias("n_windows"))


def _reversed(per_item: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def turned(win: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(w, np.uint64)[::-1].tobytes() for w in win], dtype=object)

    return per_item.select("item_id", "n", turned("win").alias("win"), F.lit(True).alias("back"))
