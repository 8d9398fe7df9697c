"""Passages of many words that repeat, found by super-k-mers.

A window is a run of `WINDOW` words of one text. A word goes when a window that covers it also starts
earlier: in a document with a smaller id, or earlier in the same one. Windows are judged on the input.

How: the minimiser of a window is the least hash of its runs of SEED words. Consecutive windows with one
minimiser travel as one packed string to the bucket of that minimiser, so equal windows meet and a text is
sent about three times over instead of twenty times. Strings that are equal within one batch of documents
are sent once; their later places are known repeats and go on by themselves. In a bucket the windows of all
strings are sorted by a hash, equal neighbours are compared by their bytes, and all but the earliest place
are repeats. A few texts of the corpus serve as dictionary when strings are packed, which changes their size
and nothing else. Buckets are laid out by the bytes of the corpus. Their loads are counted over all documents
first, and a bucket that is far above the mean (a phrase in a large share of all documents) is sent as
single windows, dealt by their own hash to as many buckets as its load asks for. Repeats return as ranges of
words, which are grouped per document and cut from its text.

Defined results: null texts have no words and stay null; texts shorter than a window stay, with one space
between words like all results; rows equal in id and text are one document and get equal results; documents
that share an id are ordered by a hash of their text; a null id comes before all others; an empty table
gives an empty result; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.words import ANSI_WORDS
from lexmill.session import cut_lineage

WINDOW = 20
SEED = 3
#: Windows in one string at most; a run of equal words has one minimiser throughout.
LONGEST = 64
#: Text that one bucket holds on average, and text that is cut at once (one document at least).
BUCKET_BYTES, BATCH_BYTES = 3_000_000, 6_000_000
#: Buckets above this many mean loads are split; so many split buckets can be listed at most.
HOT_LOADS, HOT_LISTED = 4, 1_000_000
#: Strings are packed against this much text of the corpus, so that small packs shrink as well as large ones.
SAMPLE_TEXTS, SAMPLE_CHARS = 200, 3_000
PIECE = 1 << 18
#: Rows of an Arrow batch that are Python objects at once.
ROWS = 256

_P = 0x9E3779B97F4A7C15


def powers_of(x: int, n: int) -> np.ndarray:
    factors = np.full(n, x, "uint64")
    factors[:1] = 1
    return np.cumprod(factors)


_POWERS, _UNDO = powers_of(_P, 2 * PIECE), powers_of(pow(_P, -1, 1 << 64), 2 * PIECE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(table: np.ndarray, n: int) -> np.ndarray:
    return table[:n] if n <= len(table) else powers_of(int(table[1]), n)


def word_table(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a buffer in which single spaces and line feeds stand between words."""
    codes = np.frombuffer(buffer, "uint8")
    gap = np.concatenate([[True], (codes == 32) | (codes == 10), [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    hashes = np.empty(len(starts), "uint64")
    first = 0
    while first < len(starts):  # piece by piece, so that a long text takes little memory beside itself
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + PIECE, "right")), first + 1)
        s, e = starts[first:last] - base, ends[first:last] - base
        n = int(e[-1])
        sums = np.zeros(n + 1, "uint64")
        np.cumsum((codes[base:base + n].astype("uint64") + np.uint64(1)) * powers(_POWERS, n), out=sums[1:])
        hashes[first:last] = mixed((sums[e] - sums[s]) * powers(_UNDO, n + 1)[s] + (e - s).astype("uint64"))
        first = last
    return starts, ends, hashes


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, "uint64")
    out = np.zeros(n, "uint64")
    for k in range(size):
        out = out * np.uint64(_P) + hashes[k:k + n]
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Cut:
    """The super-k-mers of some documents: word of the buffer each starts at, windows, bucket; and the buffer's words."""

    def __init__(self, texts: list[bytes], buckets: int, hot: dict[int, int]):
        joined = [b" ".join(t.split()) for t in texts]
        self.buffer = b"\n".join(joined)
        self.starts, self.ends, hashes = word_table(self.buffer)
        edges = np.cumsum([0, *[len(t) + 1 for t in joined]])
        self.first_word = np.searchsorted(self.starts, edges)
        n = max(len(hashes) - WINDOW + 1, 0)
        left = np.repeat(self.first_word[1:], np.diff(self.first_word))[:n] - np.arange(n)
        at = np.flatnonzero(left >= WINDOW)
        least = sliding_min(run_hashes(hashes, SEED), WINDOW - SEED + 1)[at] if n else np.empty(0, "uint64")
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)])[:len(at)]
        heads = np.flatnonzero(new)
        since = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
        heads = np.flatnonzero(since % LONGEST == 0)
        self.at, self.windows = at[heads], np.diff(np.append(heads, len(at)))
        self.bucket = (least[heads] % np.uint64(buckets)).astype("int64")
        if hot:
            self.split(hashes, buckets, hot)
        self.doc = np.searchsorted(self.first_word, self.at, "right") - 1
        self.hashes = hashes

    def split(self, hashes: np.ndarray, buckets: int, hot: dict[int, int]) -> None:
        """Cut the strings of hot buckets into single windows, dealt by their own hash."""
        parts = np.array([hot.get(b, 0) for b in self.bucket.tolist()], "int64")
        often = parts > 0
        if not often.any():
            return
        n = self.windows[often]
        single = np.repeat(self.at[often], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rest = hashes[single]
        for k in range(1, WINDOW):
            rest = rest * np.uint64(_P) + hashes[single + k]
        part = (mixed(rest) % np.repeat(parts[often], n).astype("uint64")).astype("int64")
        bucket = (part + 1) * buckets + np.repeat(self.bucket[often], n)
        self.at = np.concatenate([self.at[~often], single])
        self.windows = np.concatenate([self.windows[~often], np.ones(len(single), "int64")])
        self.bucket = np.concatenate([self.bucket[~often], bucket])
        order = np.argsort(self.at, kind="stable")
        self.at, self.windows, self.bucket = self.at[order], self.windows[order], self.bucket[order]

    def strings(self) -> list[bytes]:
        return [self.buffer[a:b] for a, b in zip(self.starts[self.at].tolist(), self.ends[self.at + self.windows + WINDOW - 2].tolist())]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """doc_id, row_hash and text of documents in order, each once, up to BATCH_BYTES at a time."""
    rows: dict[tuple[int, int], bytes] = {}
    total = 0

    def sorted_rows():
        keys = sorted(rows)
        return np.array([k[0] for k in keys], "int64"), np.array([k[1] for k in keys], "int64"), [rows[k] for k in keys]

    for batch in sliced(batches):
        for doc_id, row_hash, text in zip(*[batch.column(name).to_pylist() for name in ("doc_id", "row_hash", "text")]):
            if (doc_id, row_hash) not in rows:
                rows[doc_id, row_hash] = text
                total += len(text)
            if total >= BATCH_BYTES:
                yield sorted_rows()
                rows, total = {}, 0
    if rows:
        yield sorted_rows()


def loads(buckets: int):
    """For mapInArrow: bucket and the windows of its different strings, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in batches_of(batches):
            cut = Cut(texts, buckets, {})
            words = np.zeros(len(cut.hashes) + 1, "uint64")
            np.cumsum(cut.hashes * powers(_POWERS, len(cut.hashes)), out=words[1:])
            last = cut.at + cut.windows + WINDOW - 1
            string = mixed((words[last] - words[cut.at]) * powers(_UNDO, len(words))[cut.at] + cut.windows.astype("uint64"))
            _, once = np.unique(string, return_index=True)
            which, inverse = np.unique(cut.bucket[once], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.bincount(inverse, cut.windows[once], len(which)).astype("int64"))],
                                             ["bucket", "windows"])
    return run


class Packer:
    """Packs columns of whole numbers and strings, with a text known to both sides as dictionary."""

    def __init__(self, known: bytes):
        words = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if known else None
        if words:
            words.precompute_compress(level=3)
        self.pack, self.unpack = zstandard.ZstdCompressor(level=3, dict_data=words), zstandard.ZstdDecompressor(dict_data=words)

    def packed(self, doc_id: np.ndarray, others: list[np.ndarray], strings: list[bytes]) -> bytes:
        columns = [np.diff(doc_id, prepend=np.int64(0)), *others]
        numbers = b"".join(np.ascontiguousarray(c, "<i8").view("u1").reshape(-1, 8).T.tobytes() for c in columns)
        return struct.pack("<q", len(doc_id)) + self.pack.compress(numbers + b"\n".join(strings))

    def unpacked(self, blob: bytes) -> tuple[list[np.ndarray], bytes]:
        n, raw = struct.unpack_from("<q", blob)[0], self.unpack.decompress(blob[8:])
        columns = [np.frombuffer(raw, "u1", 8 * n, 8 * n * k).reshape(8, n).T.copy().view("<i8").ravel() for k in range(4)]
        return [np.cumsum(columns[0]), *columns[1:]], raw[32 * n:]


def joined_ranges(doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows in order, with those that meet in one document joined: document, first window, windows."""
    if not len(doc):
        return doc, at, windows
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + windows[:-1])])
    heads = np.flatnonzero(new)
    return doc[heads], at[heads], np.add.reduceat(windows, heads)


def sent(buckets: int, hot: dict[int, int], known):
    """For mapInArrow: bucket and packed strings; known repeats go to buckets below zero. known is a broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Packer(known.value).packed
        for doc_id, row_hash, texts in batches_of(batches):
            cut = Cut(texts, buckets, hot)
            strings = cut.strings()
            seen: dict[bytes, int] = {}
            first = np.fromiter((seen.setdefault(s, k) for k, s in enumerate(strings)), "int64", len(strings))
            again = first != np.arange(len(strings))
            start = cut.at - cut.first_word[cut.doc]
            out_bucket, out = [], []
            doc, at, n = joined_ranges(cut.doc[again], start[again], cut.windows[again])
            if len(doc):
                out_bucket.append(-1 - int(row_hash[doc[0]] % buckets))
                out.append(packed(doc_id[doc], [row_hash[doc], at, n], []))
            kept = np.flatnonzero(~again)
            kept = kept[np.argsort(cut.bucket[kept], kind="stable")]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(cut.bucket[kept]) != 0])) if len(kept) else []
            for a, b in zip(heads, [*heads[1:], len(kept)]):
                some = kept[a:b]
                out_bucket.append(int(cut.bucket[some[0]]))
                out.append(packed(doc_id[cut.doc[some]], [row_hash[cut.doc[some]], start[some], cut.windows[some]], [strings[k] for k in some.tolist()]))
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket[k:k + 64], pa.int64()), pa.array(out[k:k + 64], pa.binary())], ["bucket", "packed"])
    return run


def first_places(buffer: bytes, word: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each window (its first word, in order of place) the first window equal to it, sought by hash and compared by bytes."""
    rolled = hashes[word]
    for k in range(1, WINDOW):
        rolled = rolled * np.uint64(_P) + hashes[word + k]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order]
    heads = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.empty(0, "int64")
    first = np.empty(len(word), "int64")
    first[order] = np.repeat(order[heads], np.diff(np.append(heads, len(same))))
    later = np.flatnonzero(first != np.arange(len(word)))
    if not len(later):
        return first
    a, b = word[later], word[first[later]]
    new = np.concatenate([[True], (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(a)) - 1
    spans = zip(starts[a[at]].tolist(), ends[a[last] + WINDOW - 1].tolist(), starts[b[at]].tolist(), ends[b[last] + WINDOW - 1].tolist())
    if all(buffer[s:e] == buffer[t:f] for s, e, t, f in spans):
        return first
    seen: dict[bytes, int] = {}  # different windows of one hash: by their bytes
    texts = zip(starts[word].tolist(), ends[word + WINDOW - 1].tolist())
    return np.fromiter((seen.setdefault(buffer[s:e], k) for k, (s, e) in enumerate(texts)), "int64", len(word))


def repeated_windows(known):
    """For applyInPandas: ranges of words of one bucket that repeat an earlier place. known is a broadcast."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(known.value)
        found = [packer.unpacked(blob) for blob in rows["packed"]]
        doc_id, row_hash, start, windows = (np.concatenate([f[0][k] for f in found]) for k in range(4))
        if rows["bucket"].iloc[0] < 0:
            return pd.DataFrame({"doc_id": doc_id, "row_hash": row_hash, "start": start, "words": windows + WINDOW - 1})
        buffer = b"\n".join(f[1] for f in found)
        starts, ends, hashes = word_table(buffer)
        held = np.cumsum(np.append(0, windows + WINDOW - 1))[:-1]
        order = np.lexsort((start, row_hash, doc_id))
        n = windows[order]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        string = np.repeat(order, n)
        first = first_places(buffer, held[string] + offset, starts, ends, hashes)
        place = start[string] + offset
        of = string[first]
        again = (first != np.arange(len(first))) & ~((doc_id[string] == doc_id[of]) & (row_hash[string] == row_hash[of]) & (place == place[first]))
        doc = np.cumsum(np.concatenate([[False], (np.diff(doc_id[string]) != 0) | (np.diff(row_hash[string]) != 0)])) if len(string) else string
        some = np.flatnonzero(again)
        _, at, count = joined_ranges(doc[some], place[some], np.ones(len(some), "int64"))
        heads = some[np.cumsum(np.append(0, count))[:-1]] if len(count) else some
        return pd.DataFrame({"doc_id": doc_id[string[heads]], "row_hash": row_hash[string[heads]], "start": at, "words": count + WINDOW - 1})
    return run


def key_of(doc_id: Column) -> Column:
    """The id as it is ordered: null before all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def repeats(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, row_hash and ranges (start, words; may overlap) of the repeated windows of rows (doc_id, row_hash, text in bytes)."""
    rows = rows.filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(total // bucket_bytes))
    hot = {}
    if buckets > 1:
        load = cut_lineage(rows.mapInArrow(loads(buckets), "bucket long, windows long").groupBy("bucket").agg(F.sum("windows").alias("windows")))
        windows = load.agg(F.sum("windows")).first()[0] or 0
        most = max(HOT_LOADS * windows / buckets, windows / HOT_LISTED)
        hot = {r["bucket"]: int(-(-r["windows"] * buckets // windows)) for r in load.filter(F.col("windows") > most).collect()}
    some = rows.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_TEXTS).collect()
    known = rows.sparkSession.sparkContext.broadcast(b" ".join(b" ".join(bytes(r["text"]).split()) for r in some))
    found = rows.mapInArrow(sent(buckets, hot, known), "bucket long, packed binary").groupBy("bucket").applyInPandas(
        repeated_windows(known), "doc_id long, row_hash long, start long, words long")
    return found.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("start", "words")).alias("ranges"))


def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        names = ["doc_id", "text", "ranges"]
        n_words, n_removed, texts = [], [], []
        for text, ranges in zip(*[batch.column(name).to_pylist() for name in names[1:]]):
            words = (text or b"").split()
            kept, done = [], 0
            for at, n in sorted((r["start"], r["words"]) for r in ranges or []):
                kept += words[done:at]
                done = max(done, at + n)
            kept += words[done:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            texts.append(None if text is None else b" ".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                          pa.array(texts, pa.binary())], ["doc_id", "n_words", "n_removed", "text"])


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words that stay, one space between them) of each document."""
    rows = docs.select(F.col(id_column).alias("doc_id"), key_of(F.col(id_column)).alias("key"), F.xxhash64(F.col(text)).alias("row_hash"),
                       F.col(text).cast("binary").alias("text"))
    found = repeats(rows.select(F.col("key").alias("doc_id"), "row_hash", "text"), bucket_bytes).withColumnRenamed("doc_id", "key")
    kind = docs.schema[id_column].dataType.simpleString()
    left = rows.join(found, ["key", "row_hash"], "left").select("doc_id", "text", "ranges")
    return left.mapInArrow(without, f"doc_id {kind}, n_words long, n_removed long, text binary").withColumn("text", F.col("text").cast("string"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that stay."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


REPEATS_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {ANSI_WORDS.format(text="text")} AS ws FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
a AS (SELECT r, i FROM (SELECT r, i, row(doc_id, i) AS place, min(row(doc_id, i)) OVER (PARTITION BY g) AS first FROM g) WHERE place > first),
c AS (SELECT DISTINCT r, i + k AS j FROM a, (SELECT unnest(range({WINDOW})) AS k)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY j) FILTER (c.r IS NULL) AS kept, count(c.r) AS n_removed
      FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) x LEFT JOIN c USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)"""
