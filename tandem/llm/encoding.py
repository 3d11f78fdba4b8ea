"""Byte-level BPE encoding and decoding of whole texts (operator 7).

Each text is cut at white space into chunks that no token crosses; a bounded memo in the
Python worker keeps the ids of chunks, and the chunks of a batch that it lacks are merged
together over contiguous rank arrays (bpe.py). Nothing is shuffled: a map over documents.

Defined results: a null text counts as the empty text, which has no ids; the strings of
special tokens inside a text become their ids, as the library does by default; repeated
rows give repeated results; a null doc_id is carried along; very long texts are encoded whole; an
empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import IDS, PairRanks, byte_characters, tokenizer_json, vocabulary_path
from .common import Memo, kept_for_a_stage, mapped, runs

#: Unicode's White_Space characters, and the pre-tokenization pattern of byte-level vocabularies.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: No piece crosses the border of two of these; a space before a word belongs to the word.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Chunks of characters below this one are cut here; other chunks by the library's own pre-tokenizer.
PLAIN_BELOW = "\u0250"
MEMO_ENTRIES, MEMO_CHARS = 250_000, 48

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteLevelBPE:
    """Encoder and decoder of one vocabulary file; made once in a worker."""

    def __init__(self, name: str):
        spec = tokenizer_json(name)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.name = name
        self.ranks = PairRanks([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.byte_ids = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.specials.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.piece = regex.compile(PIECES)
        self.id_names = {i: str(i) for i in self.token_bytes}
        self.memo = Memo(MEMO_ENTRIES)
        self.long: list[str] = []
        self.library = None

    def chunks(self, text: str) -> list[str]:
        """Chunks and, between them, the strings of special tokens."""
        if self.special is None or not self.special.search(text):
            return CHUNK.findall(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.specials else CHUNK.findall(part)
        return out

    def pieces(self, chunk: str) -> list[bytes]:
        if max(chunk) < PLAIN_BELOW:
            return [p.encode() for p in self.piece.findall(chunk)]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(vocabulary_path(self.name)).pre_tokenizer
        raw, out, at = chunk.encode(), [], 0
        for mapped, _ in self.library.pre_tokenize_str(chunk):  # one mapped character for each byte
            out.append(raw[at : at + len(mapped)])
            at += len(mapped)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that the memo lacks, in one batch."""
        words: dict[bytes, bytes] = {}
        whole, parts, memo = [], [], self.memo.young
        for c in self.memo.lacking(chunks):
            if len(c) > MEMO_CHARS:
                self.long.append(c)
            if (c[1:] if c[0] == " " else c).isalpha() and max(c) < PLAIN_BELOW:
                whole.append(c)  # a single piece
            elif c in self.specials:
                memo[c] = np.array([self.specials[c]], dtype=IDS).tobytes()
            else:
                parts.append((c, ps := self.pieces(c)))
                words.update(dict.fromkeys(ps, b""))
        raw = [c.encode() for c in whole]
        words = dict(zip(words, self.ranks.merge([*words], self.byte_ids)))
        memo.update(zip(whole, self.ranks.merge(raw, self.byte_ids)))
        for c, ps in parts:
            memo[c] = b"".join([words[p] for p in ps])

    def forget(self) -> None:
        """Keep the memo within its bounds."""
        self.memo.age(self.long)
        self.long.clear()

    def joined(self, chunks: list[str]) -> list[int]:
        return np.frombuffer(self.memo.joined(chunks), dtype=IDS).tolist()

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        self.learn(set(chunks))
        return self.joined(chunks)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@kept_for_a_stage
def encoder(name: str) -> ByteLevelBPE:
    return ByteLevelBPE(name)


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, ids_sha, text_sha = [], [], []
            for a, z in runs(texts):
                cut = [bpe.chunks(t) for t in texts[a:z]]
                bpe.learn(set().union(*cut))
                for chunks in cut:
                    ids = bpe.joined(chunks)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.id_names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                bpe.forget()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, number of ids, and the digests of the ids and of the text decoded from them."""
    return mapped(docs.select("doc_id", "text"), _digests(vocabulary), SCHEMA)


def encode_texts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and the ids of its whole text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, z in runs(texts):
                ids = [bpe.encode(t) for t in texts[a:z]]
                bpe.forget()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_texts(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and the text of its ids; invalid UTF-8 becomes U+FFFD. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def op7_rank_array_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
