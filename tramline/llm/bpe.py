"""Byte-pair encoding and decoding by one walk over a trie of the distinct words.

The last token of a prefix's encoding fixes the whole encoding: it is the one vocabulary token that ends
the prefix and whose joint with the last token of what stands before it no merge crosses. Sorting a batch's
distinct words visits their trie depth first; a stack holds the last token of each prefix on the current
path, so a prefix that many words share is worked out once. Encodings of words are kept between batches in
a table of bounded size; it only saves work.

One scan, no shuffle; a text's work grows as its length. The vocabulary is a file of fixed size that each
Python worker reads by itself (its path is a parameter).

Defined cases: null counts as empty (no ids); repeated rows are encoded alike; an empty table gives an
empty result; further columns are not read unless they are asked for. Texts of unusual letters go through
the library's own splitter, as its character tables are newer than Python's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import short_batches, table

SPECIAL = "<|endoftext|>"
#: A worker keeps the encodings of the last so many distinct words, or twice as many; words longer than LONG are not kept.
KEPT_WORDS, LONG = 150_000, 200

_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Characters whose class (letter, digit, space, other) is beyond doubt; the pattern below is for them.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧‰-⁞€]")
_PIECES = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+").findall


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable() -> dict[str, int]:
    """The byte that each character of the vocabulary's file stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _shared(a: bytes, b: bytes) -> int:
    """Length of the longest prefix that two words share, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Vocabulary:
    """Tokens as bytes, the merge that made each, and the encodings found so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        byte = _printable()
        names = doc["model"]["vocab"]
        self.ids = {bytes(byte[c] for c in name): i for name, i in names.items()}
        self.special = next((t["id"] for t in doc["added_tokens"] if t["content"] == SPECIAL), None)
        size = max([*self.ids.values(), self.special or 0]) + 1
        self.tokens = [b""] * size
        for raw, i in self.ids.items():
            self.tokens[i] = raw
        if self.special is not None:
            self.tokens[self.special] = SPECIAL.encode()
        self.longest = max(map(len, self.ids))
        self.halves = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for m in doc["model"]["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, whole = (names[left], names[right]), names[left + right]
            self.merged[pair] = whole
            self.halves[whole] = pair
        self.packed = [pack("<I", i) for i in range(size)]
        self.joints: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.splitter = None
        self.path = path

    def apart(self, a: int, b: int) -> bool:
        """Whether a text encoded as token a, then b, has no merge across their joint.

        The merges are undone from the latest; at each step the tokens beside the joint must not be a
        pair that would have been merged before the step that is undone."""
        key = a << 20 | b
        known = self.joints.get(key)
        if known is None:
            if len(self.joints) > 500_000:
                self.joints.clear()
            known = self.joints[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        before = len(self.tokens) + 1
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            inner_a, inner_b = self.halves[a][1], self.halves[b][0]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (a > b and inner_a != a):
                before, a = a, inner_a
            else:
                before, b = b + 1, inner_b

    def encode_words(self, words: Iterable[str], known: dict[str, bytes]) -> None:
        """Put the ids of new words, as little-endian 32-bit integers, into `known`; memory grows as the longest word."""
        ids, apart, joints, longest, packed = self.ids.get, self.apart, self.joints.get, self.longest, self.packed
        # Of the first i bytes of the current path: last[i], the encoding's last token; back[i], where it begins.
        last, back, before = [-1], [0], b""
        for word in sorted(words):
            raw = word.encode("utf-8", "surrogatepass")
            same = _shared(before, raw)
            del last[same + 1 :], back[same + 1 :]
            for end in range(same + 1, len(raw) + 1):
                # Just one token fits, so the lengths can be tried from the likeliest, the short ones.
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    t = ids(raw[start:end])
                    if t is not None:
                        if start:
                            fits = joints(last[start] << 20 | t)
                            if fits is None:
                                fits = apart(last[start], t)
                            if not fits:
                                continue
                        last.append(t)
                        back.append(start)
                        break
            out, end = [], len(raw)
            while end:
                out.append(packed[last[end]])
                end = back[end]
            known[word] = b"".join(reversed(out))
            before = raw

    def pieces(self, text: str) -> list[str]:
        if _UNUSUAL.search(text) is None:
            return _PIECES(text)
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        special = np.array([self.special or 0], "<u4").tobytes()
        split, new = [], set()
        for text in texts:
            parts = (text or "").split(SPECIAL) if self.special is not None else [text or ""]
            split.append([self.pieces(p) for p in parts])
            for p in split[-1]:
                new.update(p)
        if len(self.known) > KEPT_WORDS:  # the words of the last while stay at hand, the others go
            self.older, self.known = self.known, {}
        new = new.difference(self.known)
        known_before = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in known_before)
        new -= known_before
        long = {w for w in new if len(w) > LONG}
        self.encode_words(new - long, self.known)
        known = self.known
        if long:
            self.encode_words(long, encoded := {})
            known = known | encoded
        return [special.join([b"".join([known[w] for w in p]) for p in parts]) for parts in split]

    def decode(self, raw: bytes | None) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(raw or b"", "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _chunks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[list[str | None]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(text)
        size += len(text or "")
        if size >= chars:
            yield chunk
            chunk, size = [], 0
    yield chunk


def _encoder(path: str, column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            out = [ids for chunk in _chunks(batch[column].to_pylist()) for ids in voc.encode(chunk)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "ids"])

    return run


def _decoder(path: str, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            text = pa.array([voc.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            keep = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], text], names=[*[batch.schema.names[k] for k in keep], "decoded"])

    return run


def _kind(rows: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)


def encode(rows: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """rows with `ids` (binary: little-endian unsigned 32-bit integers) for the text in `column`; other columns pass as they are."""
    rows = short_batches(rows.drop("ids"))
    return rows.mapInArrow(_encoder(path or vocabulary_path(), column), f"{_kind(rows)}ids binary")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with `decoded`, the text of the binary column `ids`, in its place; null ids count as none."""
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decoder(path or vocabulary_path(), rows.columns.index("ids")), f"{_kind(rows.drop('ids'))}decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs).select("doc_id", "ids", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return decode(ids).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
