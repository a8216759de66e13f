"""BPE encoding and decoding over a trie of distinct words.

For every prefix of a word one number is enough to know its encoding: the last token. It is the only token that ends
there and is compatible with the last token of what precedes it, i.e. the merges would produce the two side by side.
Whether two tokens are compatible follows from undoing their merges from the touching ends inwards. The distinct words
of a batch, sorted, are the trie in depth-first order: the walk keeps the last tokens along the current path, goes back
to where the next word branches off, and so computes the encodings of shared prefixes once. Words seen before come from
a store of at most `STORE_WORDS` words per worker, which is emptied when it is full.

The vocabulary, a file of base64 tokens and ranks, is read on the driver from `path` and broadcast. Texts are cut into
words by the rules of `PATTERN`, over whole arrays of code points; decoding joins the tokens' bytes, and what is given
out has been decoded and compared with its text.

Cases: a null text has null tokens; an empty text has none; whole texts and single words of any length are encoded;
repeated rows are encoded alike; an empty table gives an empty result; other columns of the input don't matter. A
vocabulary that lacks one of the 256 bytes raises ValueError. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .shared import table

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
STORE_WORDS = 1 << 18
_SLICE = 1 << 19


class Vocabulary:
    """Tokens by rank, with the two parts of the last merge of each."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values(), default=-1) + 1
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.longest = max(map(len, ranks))
        self.left, self.right = list(range(n)), list(range(n))
        self.pairs: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self.compatible(a, b):
                    self.left[rank], self.right[rank] = a, b
                    self.pairs[a << 32 | b] = rank
                    break
        self.bytes = [b""] * n
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side: no merge across their border comes before their own."""
        pairs, left, right = self.pairs, self.left, self.right
        before = 1 << 62
        while True:
            joined = pairs.get(a << 32 | b)
            if joined is not None and joined < before:
                return False
            # Undo the later of the two tokens' merges; a merge across the border must come before it to count.
            if a > b:
                before, nxt = a, right[a]
                if nxt != a:
                    a = nxt
                    continue
                before, nxt = b + 1, left[b]
                if nxt == b:
                    return True
                b = nxt
            else:
                before, nxt = b + 1, left[b]
                if nxt != b:
                    b = nxt
                    continue
                before, nxt = a, right[a]
                if nxt == a:
                    return True
                a = nxt


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return Vocabulary({base64.b64decode(p[0]): int(p[1]) for p in pairs if len(p) == 2})


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """For every code point: 0 letter, 1 number, 2 other, 3 white space, as the expressions of PATTERN see it."""
    out = np.full(0x110000, 2, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    for kind, expression in ((0, r"\p{L}"), (1, r"\p{N}"), (3, r"\s")):
        out[np.frombuffer("".join(regex.findall(expression, every)).encode("utf-32-le"), np.uint32)] = kind
    return out


def cuts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin, by the rules of PATTERN, in the code points of texts that begin at `first` (ends included)."""
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # The last white space before a word is cut off from a run; a plain space belongs to the word.
    into = np.flatnonzero(start[1:n] & ~edge[1:n] & (kind[1:] != 3) & (kind[:-1] == 3)) + 1
    start[into - 1] = True
    start[into[points[into - 1] == 32]] = False
    # Contractions: an apostrophe that begins a word, with the letters after it.
    quote = np.flatnonzero((points == 39) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1]]
    one = quote[np.isin(points[quote + 1], [115, 116, 109, 100])]
    two = quote[quote + 2 < n]
    two = two[~edge[two + 2]]
    a, b = points[two + 1], points[two + 2]
    two = two[((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108))]
    start[one + 1] = start[two + 1] = False
    start[one + 2] = start[two + 3] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Encodings of words under one vocabulary, kept between batches.

    Words are found and looked up by their 64-bit hashes in whole arrays; only words that aren't in the store become
    objects. The caller decodes what it gets, so that a collision of hashes can't pass: it calls `exactly` then.
    """

    def __init__(self, vocab: Vocabulary, store_words: int = STORE_WORDS):
        self.vocab, self.most = vocab, store_words
        self.compatible: dict[int, bool] = {}
        self.length = np.array([len(b) for b in vocab.bytes], np.int64)
        self.joined = np.frombuffer(b"".join(vocab.bytes), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tokens, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def walk(self, words: list[bytes]) -> list[list[int]]:
        """The encoding of each of the sorted, distinct words; each prefix that words share is visited once."""
        get, longest, known, compatible = self.vocab.ranks.get, self.vocab.longest, self.compatible, self.vocab.compatible
        length = self.length.tolist()
        path, last, out = b"", [], []
        for w in words:
            shared, most = 0, min(len(path), len(w))
            while shared < most and path[shared] == w[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(w) + 1):
                for at in range(max(0, end - longest), end):
                    t = get(w[at:end])
                    if t is None:
                        continue
                    if at:
                        pair = last[at - 1] << 32 | t
                        ok = known.get(pair)
                        if ok is None:
                            ok = known[pair] = compatible(last[at - 1], t)
                        if not ok:
                            continue
                    last.append(t)
                    break
            path = w
            found, end = [], len(w)
            while end:
                t = last[end - 1]
                found.append(t)
                end -= length[t]
            found.reverse()
            out.append(found)
        return out

    def encode(self, offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, end of each text in them with a 0 before) of the texts data[offs[i]:offs[i + 1]] in UTF-8."""
        if len(self.hashes) > self.most:
            self.clear()
        if len(self.compatible) > self.most:
            self.compatible.clear()
        raw = data[offs[0] : offs[-1]].tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        byte = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=byte[1:])
        first = np.searchsorted(byte, offs - offs[0])
        start = cuts(points, first)
        stop = np.append(start[1:], n)
        power, inverse = kernel.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        h = kernel.mix((total[stop] - total[start]) * inverse[start])
        distinct, one, which = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, distinct)
        if len(self.hashes):
            new = self.hashes[np.minimum(where, len(self.hashes) - 1)] != distinct
        else:
            new = np.ones(len(distinct), bool)
        if new.any():
            words = [raw[a:b] for a, b in zip(byte[start[one[new]]].tolist(), byte[stop[one[new]]].tolist())]
            order = sorted(range(len(words)), key=words.__getitem__)
            made = self.walk([words[k] for k in order])
            at = np.empty(len(words), np.int64)
            at[order] = len(self.ends) - 1 + np.arange(len(words))
            self.tokens = np.concatenate([self.tokens, np.fromiter((t for m in made for t in m), np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(m) for m in made])])
            self.hashes, self.at = np.insert(self.hashes, where[new], distinct[new]), np.insert(self.at, where[new], at)
            where = np.searchsorted(self.hashes, distinct)
        at = self.at[where][which]
        begin, many = self.ends[at], self.ends[at + 1] - self.ends[at]
        stop = np.zeros(len(many) + 1, np.int64)
        np.cumsum(many, out=stop[1:])
        tokens = self.tokens[np.repeat(begin - stop[:-1], many) + np.arange(stop[-1])]
        return tokens, stop[np.searchsorted(start, first)]

    def exactly(self, text: bytes) -> list[int]:
        """The tokens of one text without the store."""
        words = [w.encode() for w in regex.findall(PATTERN, text.decode())]
        distinct = sorted(set(words))
        by = dict(zip(distinct, self.walk(distinct)))
        return [t for w in words for t in by[w]]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of tokens."""
        n = self.length[tokens]
        stop = np.cumsum(n)
        return self.joined[np.repeat(self.begin[tokens] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, held) -> Encoder:
    """The worker's encoder for that vocabulary; it keeps its words from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(held.value)
    return _encoders[path]


def encode(docs: DataFrame, *, path: str = PATH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with n_tokens, tokens and round_trip: whether decoding gave the text's bytes again."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))

    def run(batches):
        bpe = _encoder(path, held)

        def decoded(tokens, ends):
            return bpe.decode(tokens), np.concatenate([[0], np.cumsum(bpe.length[tokens])])[ends]

        for batch in kernel.slices(batches, "__text", _SLICE):
            column = batch.column("__text")
            null = column.is_null().to_numpy(zero_copy_only=False)
            offs, data = kernel.buffers(column)
            tokens, ends = bpe.encode(offs, data)
            again, at = decoded(tokens, ends)
            same = np.ones(len(null), bool)
            if not (np.array_equal(at, offs - offs[0]) and np.array_equal(again, data[offs[0] : offs[-1]])):
                each = [bpe.exactly(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])]
                tokens, ends = np.array([t for e in each for t in e], np.int32), np.cumsum([0, *map(len, each)])
                again, at = decoded(tokens, ends)
                same = np.array([np.array_equal(again[a:b], data[c:d]) for a, b, c, d in zip(at[:-1], at[1:], offs[:-1], offs[1:])], bool)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.concatenate([null, [False]])), pa.array(tokens))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(np.diff(ends), pa.int64(), mask=null), lists, pa.array(same, mask=null)],
                [*keep, "n_tokens", "tokens", "round_trip"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, n_tokens long, tokens array<int>, round_trip boolean")


def decode(rows: DataFrame, *, path: str = PATH) -> DataFrame:
    """(doc_id, text) of rows (doc_id, tokens); bytes that aren't UTF-8 become replacement characters."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        bpe = _encoder(path, held)
        for batch in batches:
            lists = batch.column("tokens")
            null = lists.is_null().to_numpy(zero_copy_only=False)
            offs = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            # A null list has no values in what flatten gives.
            ends = np.concatenate([[0], np.cumsum(np.where(null, 0, np.diff(offs)))])
            data = bpe.decode(tokens)
            at = np.concatenate([[0], np.cumsum(bpe.length[tokens])])[ends]
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(null), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
            try:
                texts = texts.cast(pa.large_string())
            except pa.ArrowInvalid:
                texts = pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.if_else(pa.array(null), None, texts).cast(pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether they decode to it."""
    return encode(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, tokens, round_trip) of every row of docs."""
    return encode(docs, keep=("doc_id", "lang", "source"))
