"""Byte-level BPE by forced-boundary splitting.

A byte pair that no vocabulary token contains can't be inside a token, so every place where
one occurs is a certain cut. Text is cut at such pairs and the fragments are encoded
independently and concatenated. Two levels of cuts are used:

1. before ASCII white space that follows something else, and before a sign that follows a
   Latin letter. Those pairs are in no token, and the pre-tokenizer's pattern can't look
   across them, so a fragment (white space, then a word) means the same wherever it stands.
   Texts with other white space skip this level.
2. inside each piece of the pre-tokenizer, at every remaining pair that no token contains.

A fragment's ids are remembered as packed bytes in a bounded table, so a text's ids are one
join over its fragments. Ranks and pairs come from the tokenizer file itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import raw_text, slices, tidy

#: Fragments that a worker remembers in each of two generations, at about 200 bytes each. They
#: stay with an idle worker while a job's other stages run. What is forgotten is encoded anew.
REMEMBERED = 120_000
#: White space of either Unicode or Python that isn't in ASCII's 9 to 13 and 32.
OTHER_SPACE = re.compile(
    "["
    + "".join(
        map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
    )
    + "]"
)
#: A fragment: white space, then a Latin word up to white space or a sign, or else all up to white space.
FRAGMENT = re.compile(
    f"[ \\t-\\r]*[A-Za-z{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0xFF)}]+(?=[,.;:!?| \\t-\\r]|\\Z)|[ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+"
)
#: The byte-level pre-tokenizer's pattern (a fixed value of the file format).
_PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_CUT = re.compile(r"\S[ \t-\r]")


def parts(text: str, size: int = 1 << 19) -> Iterator[str]:
    """The whole text in parts, cut only where ASCII white space follows something else."""
    start, n = 0, len(text)
    while start < n:
        cut = _CUT.search(text, start + size) if start + size < n else None
        end = cut.start() + 1 if cut else n
        yield text[start:end]
        start = end


class Memory:
    """Ids by fragment, in two generations: when the young one is full, it replaces the old one."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.young, self.old = most, {}, {}

    def forget(self) -> None:
        """After a task: a worker that waits holds the codec only."""
        self.young, self.old = {}, {}

    def settle(self) -> None:
        """After a batch: long fragments aren't kept, a full generation grows old."""
        if len(self.young) >= self.most:
            self.old, self.young = {f: x for f, x in self.young.items() if len(f) <= 64}, {}


def _refused(spec: dict) -> str | None:
    """Why fragments would not encode as the library encodes whole texts, if so."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return "it isn't byte-level BPE with the usual pattern and without a prefix space"
    if (spec.get("decoder") or {}).get("type", "ByteLevel") != "ByteLevel" or spec.get("normalizer"):
        return "it has a normalizer or another decoder"
    if odd := [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]:
        return f"its model has {odd[0]}"
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        return "its added tokens take in what stands beside them"
    # Adjacent parts that spell a token are merged here by the token's rank, there by listed pairs only. That is the
    # same if listed pairs lead to every token: what else spells one would have merged across its middle before.
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [a + b for a, b in merges]
    plain = Tokenizer(BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
    lost = [t for t, e in zip(made, plain.encode_batch(made, add_special_tokens=False), strict=True) if len(e.ids) != 1]
    return f"its merges don't lead to {lost[0]!r}" if lost or len(set(made)) < len(made) else None


class Codec:
    """Encoder and decoder of one byte-level tokenizer file. Files of another kind are refused, not encoded wrongly."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if why := _refused(spec):
            raise ValueError(f"{path} can't be cut at byte pairs: {why}")
        stand_in = byte_alphabet()
        as_bytes = lambda s: bytes(stand_in[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        tokens = {i: as_bytes(s) for s, i in vocab.items()}
        self.size = max([*tokens, *self.special.values()]) + 1
        self.tokens = [tokens.get(i, b"") for i in range(self.size)]
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        # Single bytes rank before every merge, merges in the order of the file.
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {as_bytes(a + b): 256 + k for k, (a, b) in enumerate(merges)}
        of = {t: i for i, t in tokens.items()}
        self.ids_of_rank = np.zeros(max(ranks.values()) + 1, dtype="<u4")
        for t, r in ranks.items():
            self.ids_of_rank[r] = of[t]
        self._merge = tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        #: The byte pairs that some token contains; every other pair is a certain cut.
        self.inside = {t[k : k + 2] for t in ranks for k in range(len(t) - 1)}
        space, signs = set(b" \t\n\r\x0b\x0c"), set(b",.;:!?|")
        letter = lambda b: b < 0x80 and chr(b).isalpha()
        # From byte 0x80 on, only white-space runs that level 1 leaves out hold such a pair in one piece.
        self.level_1 = not any(b in space and a not in space and a < 0x80 or b in signs and letter(a) for a, b in self.inside)
        self._memory = Memory()
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def forget(self) -> None:
        self._memory.forget()

    def forced(self, piece: bytes) -> list[bytes]:
        """The piece, cut at every byte pair that no token contains."""
        inside, cuts = self.inside, [0]
        cuts += [k for k in range(1, len(piece)) if piece[k - 1 : k + 1] not in inside]
        return [piece[a:b] for a, b in zip(cuts, [*cuts[1:], len(piece)], strict=True)] if len(cuts) > 1 else [piece]

    def _ids(self, fragment: str) -> bytes:
        ranks: list[int] = []
        for piece in _PIECE.findall(fragment):
            for part in self.forced(piece.encode()):
                ranks += self._merge.encode_single_piece(part)
        return self.ids_of_rank[ranks].tobytes()

    def _encode(self, fragment: str) -> bytes:
        ids = self._memory.young[fragment] = self._ids(fragment)
        return ids

    def _plain(self, text: str) -> bytes:
        if not self.level_1 or OTHER_SPACE.search(text):
            return self._ids(text)
        m, encode, out = self._memory, self._encode, []
        for part in parts(text):
            m.settle()
            young, old = m.young.get, m.old.get
            out.append(b"".join([young(f) or old(f) or encode(f) for f in FRAGMENT.findall(part)]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens' strings become their ids."""
        if not self._special or not (found := list(self._special.finditer(text))):
            return self._plain(text)
        out, start = [], 0
        for m in found:
            out += [self._plain(text[start : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            start = m.end()
        return b"".join([*out, self._plain(text[start:])])

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    """One codec a worker process and file; it stays for the tasks that follow."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _run(path: str | None, keep: bool, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path or default_path()), hashlib.sha256
        for batch in slices(batches, "text", 2 << 20):
            ids = [c.encode(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            back = [c.decode(x) for x in ids]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([sha(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([sha(t.encode()).hexdigest() for t in back]),
            }
            if keep:
                columns["ids"] = pa.array(ids, pa.binary())
            if keep and decoded:
                columns["decoded"] = pa.array(back)
            yield pa.RecordBatch.from_pydict(columns)
        c.forget()

    return run


def encode_decode(docs: DataFrame, path: str | None = None, keep: bool = True, decoded: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if `keep`, ids and (if `decoded`) decoded.

    ids holds little-endian unsigned 32-bit integers. Null and empty texts have no ids and the
    digests of nothing. No row moves: it is one pass without a shuffle. `path`: the tokenizer
    file, at the same place on every worker; by default the installed byte-level one, found there.
    Repeated rows each return; an empty table returns no rows; extra columns are not read. Very long
    texts encode whole, part by part at certain cuts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep + ", decoded string" * (keep and decoded)
    return docs.select("doc_id", raw_text().alias("text")).mapInArrow(tidy(_run(path, keep, decoded)), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
