"""Byte-level BPE: encoding to token ids and exact decoding.

The vocabulary is a rank file (base64 token, rank).  The tokenizers library
merges pairs by position in a list of merges, so the list is derived from the
ranks: the last merge of a token is the pair that remains when its bytes are
merged by all lower ranks.  Within a text the pieces of a token can only be
joined in that way, as no merge crosses the token's ends before it is made, so
the library's ids equal those of merging by rank.

Byte b is shown to the library as one character (printable Latin bytes as
themselves, others from U+0100 on); decoding reverses that table id by id, so
tokens that hold part of a character give back their bytes exactly.

Texts are cut before each run of white space that follows something else: no
match of the split pattern crosses such a place.  These pieces recur, so each
worker keeps the ids of those it has met (a bounded table) and hands the
library only new ones.  The result doesn't depend on what is kept.

Nulls: a null text is an empty one (no ids); a null doc_id is kept.  Repeated
rows are encoded each; an empty table gives an empty result.  Very long texts are
encoded whole; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import shared
from .pieces import PieceIds, pieces_after_space
from .words import pieces

#: Unicode's white space beyond ASCII, in UTF-8; texts that have any are encoded whole.
_WIDE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that remain when lower ranks have merged all they can."""
    top, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = top, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], top)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        show = byte_characters()
        name = lambda t: "".join(map(show.__getitem__, t))
        merges = [m for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := last_merge(t, ranks))]
        model = models.BPE({name(t): r for t, r in ranks.items()}, [(name(a), name(b)) for a, b in merges], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        back = {c: b for b, c in show.items()}
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for t in ranks:
            self.bytes_of[ranks[t]] = bytes(map(back.__getitem__, name(t)))
        self.lengths = np.array([len(t) for t in self.bytes_of])
        self.digits = [str(i) for i in range(size)]
        self._pieces = PieceIds(self._ids)

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and end)."""
        odd = [i for i, t in enumerate(texts) if not t.isascii() and _WIDE.search(t)]
        if not odd:
            return self._pieces(*pieces_after_space(texts))
        alone = set(odd)
        ids, at = self._pieces(*pieces_after_space([b"" if i in alone else t for i, t in enumerate(texts)]))
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in odd:
            parts[i] = np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, at = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece.  Pieces that can follow one another go to the library as one text."""
        joins = [i for i, p in enumerate(pieces) if p[0] == " " and not p[-1].isspace()]
        rest = set(range(len(pieces))).difference(joins)
        out: list = [None] * len(pieces)
        groups = [joins[lo : lo + 256] for lo in range(0, len(joins), 256)] + [[i] for i in sorted(rest)]
        for lo in range(0, len(groups), 64):
            some = groups[lo : lo + 64]
            for group, e in zip(some, self.tokenizer.encode_batch_fast(["".join(map(pieces.__getitem__, g)) for g in some], add_special_tokens=False), strict=True):
                ids = e.ids
                if len(group) == 1:
                    out[group[0]] = ids
                    continue
                ends = np.cumsum([len(pieces[i].encode()) for i in group])
                last = (np.searchsorted(self.byte_ends(ids), ends) + 1).tolist()
                for i, a, b in zip(group, [0, *last], last, strict=False):
                    out[i] = ids[a:b]
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of any ids; bytes that are no whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def byte_ends(self, ids) -> np.ndarray:
        """Where each token ends in the text's UTF-8 bytes; it starts where the one before ends."""
        return np.cumsum(self.lengths[np.asarray(ids, np.int64)])


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: Bytes of text that are laid out at once.
_STEP = 1 << 21


def encode(docs: DataFrame, path: str | None = None, offsets: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int> and, if asked for, ends array<long>: each token's end in the UTF-8 bytes."""
    path = path or default_path()

    def run(batch):
        bpe, texts, keys = load(path), shared.texts(batch), batch.column("doc_id")
        for lo, hi in pieces(texts, _STEP):
            ids = bpe.encode(texts[lo:hi])
            yield {"doc_id": keys[lo:hi], "ids": ids} | ({"ends": [bpe.byte_ends(x) for x in ids]} if offsets else {})

    return shared.arrow(shared.keyed(docs, key, text), run, "doc_id long, ids array<int>" + ", ends array<long>" * offsets)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data binary (the exact bytes) and text string of (doc_id, ids); a null ids is empty."""
    path = path or default_path()

    def run(batch):
        bpe, ids = load(path), batch.column("ids").to_pylist()
        data = [bpe.decode_bytes(x or ()) for x in ids]
        yield {"doc_id": batch.column("doc_id"), "data": data, "text": [d.decode("utf-8", "replace") for d in data]}

    return shared.arrow(encoded.select("doc_id", "ids"), run, "doc_id long, data binary, text string")


def digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document n_tokens, the hash of its ids and that of the bytes they decode to."""
    path = path or default_path()

    def run(batch):
        bpe, texts = load(path), shared.texts(batch)
        out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for lo, hi in pieces(texts, _STEP):
            for ids in map(np.ndarray.tolist, bpe.encode(texts[lo:hi])):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
        yield out

    return shared.arrow(shared.keyed(docs, key, text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
