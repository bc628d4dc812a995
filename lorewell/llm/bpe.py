"""Byte-pair encoding and decoding with forced boundaries (operator 13).

A pair of bytes that stands inside no token of the vocabulary can never be joined by a merge, so a text is cut for certain
between two such bytes. The fragments are encoded independently, each by the merges, and their ids are put behind one another.
Texts are first parted as byte-level vocabularies ask: special tokens, then contractions, letters, digits, other marks, white space.

Work is one pass over the texts without a shuffle. A worker holds the vocabulary, a bounded table of pieces that it has met, and a
batch of texts. It goes through them in slices and merges the pieces of a slice that it does not remember by array steps, all
fragments at once; a run of n bytes that has no letter before white space is one slice, of some 60 n bytes of arrays.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import text_batches

#: Characters of texts that are worked on at once, bytes of pieces that a worker remembers, and what one of them takes besides its bytes.
SLICE, REMEMBERED, PIECE = 1 << 18, 48 << 20, 200
#: Contractions that byte-level vocabularies part from words.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabulary files: printable Latin-1 as it is, the rest from 256 upwards."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    signs = {chr(b): b for b in plain}
    return signs | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of every token by id, merges in order of rank as ids (left, right, joined), ids of single bytes, special tokens, and
    the kind of every code point."""

    tokens: tuple[bytes, ...]
    merges: np.ndarray
    single: np.ndarray
    special: tuple[tuple[str, int], ...]
    kinds: np.ndarray

    @staticmethod
    def read(path: str) -> Vocabulary:
        """From a byte-level vocabulary file in JSON, read by the driver."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        pre = d["pre_tokenizer"]
        if d["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or d["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in d["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take white space or words into account")
        signs, ids = byte_signs(), d["model"]["vocab"]
        special = tuple((t["content"], t["id"]) for t in d["added_tokens"])
        tokens = [b""] * (1 + max(*ids.values(), *(i for _, i in special)))
        for t, i in ids.items():
            tokens[i] = bytes(signs[c] for c in t)
        for t, i in special:
            tokens[i] = t.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        if len(np.unique(merges[:, 2])) < len(merges):
            raise ValueError(f"{path} makes a token in two ways: its merges have no order by rank alone")
        single = np.array([ids[s] for s, _ in sorted(signs.items(), key=lambda x: x[1])], np.int64)
        return Vocabulary(tuple(tokens), merges, single, special, sign_kinds())

    def inside(self) -> np.ndarray:
        """Which pairs of bytes stand side by side in some token of the merges; the others force a cut."""
        out = np.zeros((256, 256), bool)
        made = [self.tokens[i] for i in self.merges[:, 2]]
        data = np.frombuffer(b"".join(made), np.uint8)
        ends = np.cumsum([len(t) for t in made]) if made else np.zeros(0, np.int64)
        both = np.ones(max(0, len(data) - 1), bool)
        both[ends[:-1] - 1] = False
        out[data[:-1][both], data[1:][both]] = True
        return out


#: Kinds of signs.
SPACE, LETTER, DIGIT, OTHER = range(4)


def sign_kinds() -> np.ndarray:
    """The kind of every code point, as the tokenizers library takes it.

    `regex` knows letters and digits of a newer Unicode. Only signs that Python's own, older tables lack can differ, and the library
    itself is asked about these.
    """
    from tokenizers import pre_tokenizers

    parts = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", DIGIT)):
        for start in (*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x800)):
            signs = [ord(c) for c in regex.findall(pattern, "".join(map(chr, range(start, start + 0x800))))]
            kinds[signs] = kind
    for c in np.flatnonzero((kinds == LETTER) | (kinds == DIGIT)).tolist():
        if unicodedata.category(chr(c)) == "Cn" and len(parts("!" + chr(c))) == 1:
            kinds[c] = OTHER
    return kinds


class Encoder:
    """Texts to ids as little-endian 32-bit words, and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.inside = vocabulary.inside()
        self.none = len(vocabulary.merges)
        key = vocabulary.merges[:, 0] * len(vocabulary.tokens) + vocabulary.merges[:, 1]
        self.order = np.argsort(key).astype(np.int32)
        self.keys = key[self.order]
        names = sorted((t for t, _ in vocabulary.special), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(map(regex.escape, names))})") if names else None
        # special tokens are keys of text, pieces are keys of bytes
        self.marks = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary.special}
        self.cut = regex.compile(r"\p{Lu}(?=\s)|\p{Ll}(?=\s)")
        self.known: dict[bytes | str, bytes] = dict(self.marks)
        self.held = 0

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Which code points of a text start a piece.

        A piece is a run of letters, digits or other signs, with one blank before it if there is one; a contraction; or white
        space, of which the last sign before another run stands alone.
        """
        kind = self.v.kinds[codes]
        n = len(codes)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        blank = kind == SPACE
        last = np.flatnonzero(blank[:-1] & ~blank[1:])
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
        mark = np.flatnonzero((codes[:-1] == 39) & start[:-1])
        for contraction in CONTRACTIONS:
            at = mark[mark + len(contraction) <= n] if len(mark) else mark
            for i, c in enumerate(contraction):
                at = at[codes[at + i] == ord(c)]
            start[at + 1] = False
            at = at + len(contraction)
            start[at[at < n]] = True
        return start

    def pieces(self, text: str) -> list[bytes]:
        """What merges never cross, in UTF-8."""
        raw = text.encode("utf-8")
        start = np.flatnonzero(self.starts(np.frombuffer(text.encode("utf-32-le"), np.uint32)))
        if len(raw) != len(text):
            start = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[start]
        at = [*start.tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _slices(self, text: str):
        """Slices of about SLICE characters that end between a letter and white space, where pieces end in any case."""
        i = 0
        while i < len(text):
            j = i + SLICE
            if j < len(text):
                m = self.cut.search(text, j)
                j = m.end() if m else len(text)
            yield text[i:j] if i or j < len(text) else text
            i = j

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, all at once: each is cut where two bytes stand together in no token, and its fragments are merged."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        start = np.ones(len(data), bool)
        start[1:] = ~self.inside[data[:-1], data[1:]]
        start[ends[:-1]] = True
        ids = self.joined(self.v.single[data], start)
        stay = ids >= 0
        raw, at = ids[stay].astype("<u4").tobytes(), [0, *(4 * np.cumsum(stay)[ends - 1]).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.v.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.order[at], self.none)

    def joined(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which ids stay (as -1 for those that a merge has taken), fragment by fragment but all fragments at once.

        A round makes, in every fragment, the merge of the least rank that it has, at all its places from the left. That is the
        order of the merges, as no merge makes room for one of a lesser rank: every token is made by one merge alone.
        """
        out, at, cur = np.full(len(ids), -1, np.int32), np.arange(len(ids)), ids.astype(np.int32)
        rank = np.full(len(ids), self.none, np.int32)
        inner = np.flatnonzero(~start[1:]) if self.none else np.zeros(0, np.int64)
        rank[inner] = self._ranks(cur[inner], cur[inner + 1])
        while len(cur):
            starts = np.flatnonzero(start)
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(cur)))
            live = least < self.none
            if not live.all():
                out[at[~live]] = cur[~live]
                at, cur, rank, start, least = at[live], cur[live], rank[live], start[live], least[live]
                if not len(cur):
                    break
            here = np.flatnonzero(rank == least)
            # overlapping places come from one repeated id: every second of a run of neighbours joins
            if len(here) > 1 and (np.diff(here) == 1).any():
                index = np.arange(len(here))
                run = np.maximum.accumulate(np.where(np.diff(here, prepend=-2) > 1, index, 0))
                here = here[(index - run) % 2 == 0]
            cur[here] = self.v.merges[rank[here], 2]
            stay = np.ones(len(cur), bool)
            stay[here + 1] = False
            here = here - np.arange(len(here))
            at, cur, rank, start = at[stay], cur[stay], rank[stay], start[stay]
            for i in (here, here[~start[here]] - 1):
                rank[i] = self.none
                i = i[i + 1 < len(cur)]
                i = i[~start[i + 1]]
                rank[i] = self._ranks(cur[i], cur[i + 1])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; several short texts are worked on together, a long one slice by slice."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[tuple[int, list]] = []
        size = 0

        def flush() -> None:
            new = list({p for _, pieces in parts for p in pieces if p not in self.known})
            if new:
                self.known.update(zip(new, self.merged(new), strict=True))
                self.held += sum(map(len, new)) + PIECE * len(new)
            for d, pieces in parts:
                out[d].append(b"".join(map(self.known.__getitem__, pieces)))
            parts.clear()
            if self.held > REMEMBERED:
                self.known = dict(self.marks)
                self.held = 0

        for d, text in enumerate(texts):
            for part in self.special.split(text or "") if self.special else [text or ""]:
                if part in self.marks:
                    parts.append((d, [part]))
                    continue
                for piece in self._slices(part):
                    parts.append((d, self.pieces(piece)))
                    size += len(piece)
                    if size >= SLICE:
                        flush()
                        size = 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes | None) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters. An id beyond the vocabulary raises IndexError."""
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


class Tokenizer:
    """Column expressions over a vocabulary that the executors are sent once (a few MB, whatever the data).

    They take iterators, so that Spark runs each by itself: decode() of encode() does not encode twice.
    """

    def __init__(self, spark, path: str):
        self.shared = spark.sparkContext.broadcast(Vocabulary.read(path))
        text_batches(spark)

    def encode(self, text: Column | str) -> Column:
        """Token ids as little-endian unsigned 32-bit words, in binary. Null and empty texts give no bytes."""
        shared = self.shared

        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = Encoder(shared.value)
            for texts in batches:
                yield pa.array(encoder.encode(texts.to_pylist()), pa.binary())

        return F.arrow_udf(ids, "binary")(text)

    def decode(self, ids: Column | str) -> Column:
        """The text of such ids. Null and empty ids give the empty text."""
        shared = self.shared

        def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decoder = Encoder(shared.value)
            for column in batches:
                yield pa.array([decoder.decode(x.as_py()) for x in column], pa.string())

        return F.arrow_udf(texts, "string")(ids)


def n_tokens(ids: Column | str) -> Column:
    """How many ids a binary of encode() holds."""
    return (F.octet_length(ids) / 4).cast("long")


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of a text column as a further column; other columns, whatever their names, and repeated rows stay.

    A null or empty text has no ids; an empty table stays empty. A column that is already named so is replaced.
    """
    return docs.withColumn(ids, Tokenizer(docs.sparkSession, path).encode(F.col(text)))


def decode_documents(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of an ids column as a further column."""
    return rows.withColumn(text, Tokenizer(rows.sparkSession, path).decode(F.col(ids)))


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole document and of what they decode to."""
    import public_tokenizers

    from lorewell.session import table

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return decode_documents(docs, path).select("doc_id", n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
