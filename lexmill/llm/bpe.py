"""BPE encoding and decoding by tree concatenation.

A text is normalised, cut into pieces (words, digits, runs of marks) and each piece is merged
into tokens. Two things may be long without a place to cut them: a text, and a piece. Both are
halved again and again, the halves are encoded on their own, and each join is mended: the
window around it is encoded anew and grown until its first and last parts agree with what both
sides had there. Halves of long texts are rows of their own, so other tasks encode them at the
same time; joins of a text are then folded pairwise.

Why agreement is enough: pieces are found from left to right without looking back, so equal
cuts stay equal from there on; and a token sequence is the encoding of its text exactly when
each neighbouring pair is, so a window that begins and ends with the tokens of its sides mends
the whole. `AGREE` neighbours must agree, one more than that needs.

Defined results: a null text is the empty text; the empty text has no tokens; equal rows give
equal rows; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
AGREE = 2
#: Texts longer than this many characters are halved into rows of at most so many.
PART_CHARS = 16384
#: A piece with more symbols than this is encoded by halves.
LEAF_SYMBOLS = 256
#: The rank of pairs that are not merged.
NEVER = 1 << 60
#: Words whose tokens a worker remembers, twice as many at most.
REMEMBERED = 250_000

WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else 256 and up in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Remembered(dict):
    """What a function gave for a word. Long words are not kept; when it is full, words not met again until the next time go."""

    def __init__(self, function):
        self.function, self.before = function, {}

    def __missing__(self, word: str) -> str:
        found = self.before.get(word) or self.function(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


class Codec:
    """Vocabulary, merges and pattern of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ids = model["vocab"]
        #: Of a pair of ids, packed into one number: its rank; and the id that the pair of a rank becomes.
        self.rank = {self.ids[a] << 20 | self.ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.splitter = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        pieces = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pieces.replace(r"\s", WHITE), regex.V0)
        self.byte_ids = [self.ids[c] for c in byte_symbols()]
        self.end_ids = [self.ids[c + END] for c in byte_symbols()]
        #: The same pattern for texts of the first 592 characters only, in the faster engine.
        near = [chr(i) for i in range(592)]
        of = lambda kind: "".join(re.escape(c) for c in near if unicodedata.category(c).startswith(kind))
        near_pattern = pieces.replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N")).replace(r"\s", WHITE)
        self.near_pieces = re.compile(near_pattern)
        #: With the white space before each piece: everything but white space is in a piece, so their lengths give its end.
        self.spaced = regex.compile(f"[{WHITE}]*(?:{self.pieces.pattern})", regex.V0)
        self.near_spaced = re.compile(f"[{WHITE}]*(?:{near_pattern})")
        self.white = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
        self.other = re.compile(f"[^{near[0]}-{near[-1]}]").search
        self.numbers = Remembered(lambda word: " ".join(map(str, self.piece(word))))
        self.shown = Remembered(lambda word: self.decode(map(int, self.numbers[word].split(" "))))

    def normal(self, text: str) -> str:
        """NFC and lower case letter by letter (a final sigma is a sigma); no piece holds white space, so that may stay."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """Normalised text between special tokens, and the special tokens themselves (True)."""
        for part in self.splitter.split(text):
            if part:
                yield (part, True) if part in self.special else (self.normal(part), False)

    def merged(self, ids: list[int]) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until no pair can be merged."""
        rank, ids = self.rank.get, list(ids)
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            ids[i] = self.made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NEVER)
        return ids

    def atoms(self, token: int) -> list[int]:
        """The symbols a token was merged from."""
        name = self.tokens[token]
        body, end = (name[:-len(END)], END) if name.endswith(END) and len(name) > len(END) else (name, "")
        return [self.ids[c] for c in body[:-1]] + [self.ids[body[-1] + end]]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring stretches of one piece, from the tokens of each."""
        width = 2 * AGREE
        while True:
            a, b = left[-width:], right[:width]
            window = self.merged([s for t in a + b for s in self.atoms(t)])
            from_start, to_end = len(a) == len(left), len(b) == len(right)
            if (from_start or window[:AGREE] == a[:AGREE]) and (to_end or window[-AGREE:] == b[-AGREE:]) and (
                    len(window) >= 2 * AGREE or from_start and to_end):
                return left[:len(left) - len(a)] + window + right[len(b):]
            width *= 2

    def tree(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= LEAF_SYMBOLS:
            return self.merged(symbols)
        half = len(symbols) // 2
        return self.joined(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def piece(self, word: str) -> list[int]:
        """The tokens of one piece."""
        data = word.encode("utf-8", "surrogatepass")
        return self.tree([self.byte_ids[b] for b in data[:-1]] + [self.end_ids[data[-1]]])

    def cut(self, text: str) -> list[str]:
        """The pieces of a normalised text."""
        return (self.pieces if self.other(text) else self.near_pieces).findall(text)

    def cut_with_steps(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces of a normalised text and how far the end of each lies behind the one before."""
        spaced = (self.spaced if self.other(text) else self.near_spaced).findall(text)
        return [w.lstrip(self.white) for w in spaced], list(map(len, spaced))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, special ones too: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def figures_of(code: Codec, text: str) -> tuple[int, str, str]:
    """Token count and digests of the ids and of the decoded text."""
    numbers, shown = [], []
    for section, special in code.sections(text):
        words = [section] if special else code.cut(section)
        if words:
            numbers.append(str(code.special[section]) if special else " ".join(map(code.numbers.__getitem__, words)))
            shown.append(section if special else " ".join(map(code.shown.__getitem__, words)))
    ids = " ".join(numbers)
    return ids.count(" ") + 1 if ids else 0, sha(ids), sha(" ".join(shown))


def whole_rows(path: str):
    """Encodes texts that are one row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(path)
        for batch in batches:
            rows = [figures_of(code, text) for text in batch["text"]]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array(n, "int64"),
                                "ids_sha256": pd.Series(ids, dtype=object), "decoded_sha256": pd.Series(decoded, dtype=object)})
    return run


def halved(text: str, limit: int) -> list[str]:
    """Leaves of a text halved until none is longer than limit."""
    if len(text) <= limit:
        return [text]
    half = len(text) // 2
    return halved(text[:half], limit) + halved(text[half:], limit)


def leaf_rows(path: str, limit: int):
    """Normalised leaves of long texts: row_no, section, leaf, special, text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(path)
        for batch in batches:
            for row, doc, text in zip(batch["row_no"], batch["doc_id"], batch["text"]):
                found = [(row, doc, s, k, special, leaf) for s, (section, special) in enumerate(code.sections(text))
                         for k, leaf in enumerate([section] if special else halved(section, limit))]
                yield pd.DataFrame(found, columns=["row_no", "doc_id", "section", "leaf", "special", "text"]).astype(
                    {"doc_id": batch["doc_id"].dtype})
    return run


def packed(values: list[int]) -> bytes:
    """Numbers in the fewest whole bytes each, behind the sign of their type."""
    kind = np.min_scalar_type(max(values, default=0))
    return kind.char.encode() + np.array(values, kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], chr(data[0])).astype("int64")


def encoded_leaves(path: str):
    """Adds how far each piece of a leaf lies behind the one before, and the tokens of each, packed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(path)
        for batch in batches:
            steps, counts, ids = [], [], []
            for text, special in zip(batch["text"], batch["special"]):
                words, behind = ([], []) if special else code.cut_with_steps(text)
                parts = list(map(code.numbers.__getitem__, words))
                steps.append(packed(behind))
                counts.append(packed([p.count(" ") + 1 for p in parts]))
                ids.append(packed(list(map(int, " ".join(parts).split()))))
            yield batch.assign(steps=steps, counts=counts, ids=ids)
    return run


class Stretch:
    """A stretch of normalised text with the pieces found in it: where they end, how many tokens each has, and the tokens."""

    def __init__(self, code: Codec, text: str, ends: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.code, self.text, self.ends, self.counts, self.ids = code, text, ends, counts, ids

    def join(self, right: Stretch) -> Stretch:
        """The pieces of both texts together: the window around the join is cut and encoded anew until it agrees with both."""
        offset, text, width = len(self.text), self.text + right.text, 2
        n, m = len(self.ends), len(right.ends)
        while True:
            a, b = max(0, n - width), min(m, width)
            begin, end = int(self.ends[a - 1]) if a else 0, offset + (int(right.ends[b - 1]) if b < m else len(right.text))
            found = [(x.end() + begin, x.group()) for x in self.code.pieces.finditer(text[begin:end])]
            cuts = [e for e, _ in found]
            from_start = a == 0 or cuts[:1] == self.ends[a:a + 1].tolist()
            to_end = b == m or (len(cuts) > 1 and cuts[-2:] == (offset + right.ends[b - 2:b]).tolist())
            if from_start and to_end:
                fresh = [list(map(int, self.code.numbers[w].split(" "))) for _, w in found]
                glue = lambda *parts: np.concatenate([np.asarray(p, "int64") for p in parts])
                return Stretch(self.code, text, glue(self.ends[:a], cuts, offset + right.ends[b:]),
                               glue(self.counts[:a], [len(f) for f in fresh], right.counts[b:]),
                               glue(self.ids[:int(self.counts[:a].sum())], [i for f in fresh for i in f], right.ids[int(right.counts[:b].sum()):]))
            width *= 2


def fold(stretches: list[Stretch]) -> Stretch:
    while len(stretches) > 1:
        pairs = [stretches[i:i + 2] for i in range(0, len(stretches), 2)]
        stretches = [p[0].join(p[1]) if len(p) > 1 else p[0] for p in pairs]
    return stretches[0]


def joined_rows(path: str):
    """All leaves of one text -> its row of figures."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        code = codec(path)
        rows = rows.sort_values(["section", "leaf"])
        ids: list[int] = []
        for _, part in rows.groupby("section", sort=True):
            if part["special"].iloc[0]:
                ids.append(code.special[part["text"].iloc[0]])
                continue
            leaves = [Stretch(code, text, np.cumsum(unpacked(steps)), unpacked(counts), unpacked(numbers)) for text, steps, counts, numbers in zip(
                part["text"], part["steps"], part["counts"], part["ids"])]
            ids += fold(leaves).ids.tolist()
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].tolist(), "n_tokens": [len(ids)],
                             "ids_sha256": [sha(" ".join(map(str, ids)))], "decoded_sha256": [sha(code.decode(ids))]}).astype(
            {"doc_id": rows["doc_id"].dtype})
    return run


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its whole text.

    path: a tokenizer file (byte-level BPE with word ends) that every executor can open.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    figures = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    long = F.char_length("text") > part_chars
    short = rows.filter(~long).mapInPandas(whole_rows(path), figures)
    leaf = f"row_no long, doc_id {kind}, section int, leaf int, special boolean, text string"
    leaves = rows.filter(long).withColumn("row_no", F.monotonically_increasing_id()).mapInPandas(leaf_rows(path, part_chars), leaf)
    spread = leaves.repartition(F.col("row_no"), F.col("section"), F.col("leaf"))
    coded = spread.mapInPandas(encoded_leaves(path), f"{leaf}, steps binary, counts binary, ids binary")
    return short.unionByName(coded.groupBy("row_no").applyInPandas(joined_rows(path), figures))
