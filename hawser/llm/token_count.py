"""Token counts by a map-side two-tier lookup.

Tier one is a compact table, broadcast once, of the pre-tokens that the vocabulary itself holds whole: a byte-pair
vocabulary lists the frequent words of what it was built from, so no pass over the corpus and no shuffle of
pre-tokens is needed to find them. Tier two is a bounded cache in each Python worker, which keeps what tier one
misses after the tokenizer has encoded it once. Neither tier changes a count: each entry is what the library gives.
Misses of characters that all libraries class alike are merged by tiktoken's implementation of the same vocabulary,
which takes a third of the time a piece; its ids are the same (tests hold them against the library).

A text is cut only where the byte-level pre-tokenizer always cuts: before a single space that a non-space follows,
and around white-space runs. Texts holding a special string of the tokenizer go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Entries of a worker's cache; when it is full it starts again from the broadcast table.
CACHE_ENTRIES = 1 << 19

#: Below this character (Latin, Greek, Cyrillic) the libraries' tables of letters and digits agree; newer ones differ above.
_ALIKE = "\u0530"

_RUN = regex.compile(r"(\s{2,})")
_encoders: dict = {}
#: In the driver, by application and the file's contents: reading the vocabulary anew for each query left some 20 MB behind.
_broadcasts: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def is_byte_level(spec: dict) -> bool:
    """Whether texts may be cut at spaces: byte-level BPE by the usual pattern, no normaliser, no prefix space."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("model", {}).get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    )


def frequent_pieces(spec_json: str) -> dict[str, bytes]:
    """Tier one: the vocabulary's own words (with a leading space), with their ids as little-endian 32-bit bytes.

    The size is bound by the vocabulary: some 30,000 entries of a few bytes for the files in use.
    """
    from tokenizers import Tokenizer

    spec = json.loads(spec_json)
    alphabet, words = byte_alphabet(), []
    for token in spec["model"]["vocab"]:
        try:
            word = bytes(alphabet[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word[:1] == " " and len(word) > 1 and not any(c.isspace() for c in word[1:]):
            words.append(word)
    del spec
    tokenizer, out = Tokenizer.from_str(spec_json), {}
    for at in range(0, len(words), 1000):  # an encoding takes far more memory than its ids, and the driver holds these
        part = words[at : at + 1000]
        out |= {w[1:]: ids_bytes(e.ids) for w, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True)}
    return out


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def merging(spec: dict):
    """tiktoken's encoder of the same vocabulary, or None where ids don't follow the order of merges."""
    import public_tokenizers
    import tiktoken

    alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    tokens = [t for t in vocab if t not in special]
    if None in merged or merged != sorted(merged) or not all(c in alphabet for t in tokens for c in t):
        return None
    ranks = {bytes(alphabet[c] for c in t): vocab[t] for t in tokens}
    return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Pieces(dict):
    """Cache from a piece to its ids' bytes; `lead` is what stands before each piece ("" or a space)."""

    def __init__(self, tokenizer, lead: str, first_tier: dict[str, bytes], limit: int):
        super().__init__(first_tier)
        self.tokenizer, self.lead, self.first_tier, self.limit = tokenizer, lead, first_tier, limit

    def __missing__(self, piece: str) -> bytes:
        last = piece[-1:]
        if last in (".", ",") and len(piece) > 1 and piece[-2].isascii() and piece[-2].isalpha():
            ids = self[piece[:-1]] + self.tokenizer.bare[last]  # a letter and a mark never share a pre-token
        else:
            ids = ids_bytes(self.tokenizer.piece_ids(self.lead + piece))
        if len(self) >= self.limit:
            self.clear()
            self.update(self.first_tier)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, equal to the library's without special tokens around the text."""

    def __init__(self, spec_json: str, first_tier: dict[str, bytes], cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        spec = json.loads(spec_json)
        self.library = Tokenizer.from_str(spec_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.two_tier = is_byte_level(spec)
        self.merging = merging(spec) if self.two_tier else None
        self.bare = _Pieces(self, "", {}, cache_entries)
        self.spaced = _Pieces(self, " ", first_tier, cache_entries)

    def piece_ids(self, piece: str) -> list[int]:
        if self.merging and max(piece) < _ALIKE:
            return self.merging.encode_ordinary(piece)
        return self.library.encode(piece, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.two_tier or any(s in text for s in self.special):
            return ids_bytes(self.library.encode(text, add_special_tokens=False).ids)
        parts = _RUN.split(text)
        if len(parts) == 1:
            return b"".join(self._segment(text, ""))
        out = self._segment(parts[0], "") if parts[0] else []
        for run, segment in zip(parts[1::2], parts[2::2], strict=True):
            if segment:
                out.append(self.bare[run[:-1]])
                out += self._segment(segment, run[-1])
            else:
                out.append(self.bare[run])
        return b"".join(out)

    def _segment(self, text: str, before: str) -> list[bytes]:
        """Of a text without two white-space characters in a row, after the white-space character `before`."""
        spaced, bare, out = self.spaced, self.bare, []
        if before not in ("", " "):
            out.append(bare[before])
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(bare["\n"])
            words = line.split(" ")
            if first := words[0]:
                out.append(spaced[first] if before == " " and not i else bare[first])
            out += map(spaced.__getitem__, words[1:])
        return out


class SharedTokenizer:
    """The tokenizer's file and first tier, broadcast once an application; each worker builds its encoder once."""

    def __init__(self, spark: SparkSession, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, "rb") as f:
            data = f.read()
        known = spark.sparkContext.applicationId, path.endswith(".model"), hashlib.sha256(data).digest()
        if known not in _broadcasts:
            for old in [k for k in _broadcasts if k[0] != known[0]]:
                del _broadcasts[old]
            _broadcasts[known] = spark.sparkContext.broadcast(self._contents(data, known[1]))
        self.shared = _broadcasts[known]
        self.key, self.cache_entries = (spark.sparkContext.applicationId, self.shared._jbroadcast.id(), cache_entries), cache_entries

    @staticmethod
    def _contents(data: bytes, is_model: bool) -> tuple:
        if is_model:
            return "model", data, None
        spec_json = data.decode()
        return "json", spec_json, frequent_pieces(spec_json) if is_byte_level(json.loads(spec_json)) else {}

    def __getstate__(self):
        return {"shared": self.shared, "key": self.key, "cache_entries": self.cache_entries}

    def encoder(self):
        if self.key not in _encoders:
            kind, data, first = self.shared.value
            _encoders.clear()
            _encoders[self.key] = _PieceModel(data) if kind == "model" else Encoder(data, first, self.cache_entries)
        return _encoders[self.key]


class _PieceModel:
    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def ids(self, text: str) -> bytes:
        return ids_bytes(self.library.encode(text, num_threads=1))


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit, computed map-side; no row moves between machines.

    A null or empty text has 0 bytes and 0 tokens. Rows are kept as they are, repeated or not; columns of `docs`
    with these names are replaced.
    """
    shared = SharedTokenizer(docs.sparkSession, tokenizer, cache_entries)

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: pd.Series) -> pd.Series:
        ids = shared.encoder().ids
        return pd.Series([len(ids(t)) >> 2 for t in texts], dtype="int64")

    return docs.withColumns({"n_bytes": F.octet_length(text_or_empty(text)).cast("long"), "n_tokens": n_tokens(text_or_empty(text))}).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")
