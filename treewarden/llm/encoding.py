"""Byte-level BPE by the tokenizers library, over Arrow batches.

The splitting pattern of these vocabularies never lets a piece run over a single space between two other
characters, so a text can be cut before such spaces (and on both sides of such newlines) and every cut is encoded alone. Cuts repeat: each distinct cut
goes through the library once while it is remembered, and a document is the concatenation of its cuts' ids. That holds for the pattern below only: with any
other one, and where a text has the string of an added token, the whole text goes through the library as it is.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import REMEMBERED

#: Fixed value: the splitting pattern that cuts are right for; tokenizers files name it as ByteLevel with use_regex.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: White space other than single spaces and newlines between other characters, or a NUL: such texts are cut by the expression above.
_ODD = r"[ \n][ \n]|^[ \n]|[ \n]\z|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers. At most about ``most`` cuts are remembered.

    ``cuttable``: whether texts may be cut; ``added``: strings of tokens that the tokenizer finds in a text before it is split; ``special_as_text``: special ones are ordinary text.
    """

    def __init__(self, tokenizer, most: int = 150_000, cuttable: bool = True, added: tuple[str, ...] = (), special_as_text: bool = True):
        self.tokenizer, self.most, self.known = tokenizer, most, {}
        self.cuttable, self.added, self.special_as_text = cuttable, added, special_as_text
        vocabulary = tokenizer.get_vocab()
        self.lengths = np.zeros(1 + max(vocabulary.values()), np.int64)  # bytes of each id
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)

    def _learn(self, new: list[str]) -> None:
        """A space and letters are a piece of their own wherever they stand, so many such cuts go through the library as one text."""
        words, rest = [], []
        for c in new:
            (words if c[0] == " " and c[1:].isalpha() else rest).append(c)
        known = self.known
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            texts = ["".join(some[i : i + 100]) for i in range(0, len(some), 100)]
            ids = np.array(list(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))), "<u4")
            ends = 4 * (1 + np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(c.encode()) for c in some])))
            data, begin = ids.tobytes(), 0
            for c, end in zip(some, ends.tolist(), strict=True):
                known[c] = data[begin:end]
                begin = end
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[c] = array("I", e.ids).tobytes()

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct cuts; those that are new go through the library."""
        if len(self.known) > self.most:  # what these texts have stays
            self.known = {c: self.known[c] for c in words if c in self.known}
        known = self.known
        new = set(words).difference(known, ("",))
        known[""] = b""
        # letters and one mark after them are pieces of their own
        marked = {c for c in new if c[-1] in ",.!?" and c[-2:-1].isalpha()}
        self._learn([c for c in (new - marked) | {x for c in marked for x in (c[:-1], c[-1])} if c not in known])
        for c in marked:
            known[c] = known[c[:-1]] + known[c[-1]]
        return list(map(known.__getitem__, words))

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        self.tokenizer.encode_special_tokens = self.special_as_text
        out = [array("I", e.ids).tobytes() for at in range(0, len(texts), 100) for e in self.tokenizer.encode_batch_fast(texts[at : at + 100], add_special_tokens=False)]
        self.tokenizer.encode_special_tokens = True  # cuts never hold a token's string
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Null is encoded as empty. Texts that can't be cut go through the library whole."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not self.cuttable:
            return self._encode_whole(column.to_pylist())
        holds = np.zeros(len(column), bool)
        for token in self.added:
            holds |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._encode_cuts(column)
        out: list[bytes] = [b""] * len(column)
        for mask, encoded in ((holds, self._encode_whole(column.filter(pa.array(holds)).to_pylist())), (~holds, self._encode_cuts(column.filter(pa.array(~holds))))):
            for i, x in zip(np.flatnonzero(mask).tolist(), encoded, strict=True):
                out[i] = x
        return out

    def _encode_cuts(self, column: pa.Array) -> list[bytes]:
        """A batch's distinct cuts are looked up once; the texts' ids are gathered from them."""
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(pc.replace_substring(pc.replace_substring(column.filter(pa.array(~odd)), "\n", "\0\n\0"), " ", "\0 "), "\0")
        pieces = [plain]
        if odd.any():
            pieces.append(pa.array([_CUT.split(t) for t in column.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string())))
        flat = pa.concat_arrays([p.flatten() for p in pieces]).dictionary_encode()
        counts = np.concatenate([p.value_lengths().to_numpy() for p in pieces])
        if not len(flat):
            return [b""] * len(column)
        found, which = self._lookup(flat.dictionary.to_pylist()), flat.indices.to_numpy()
        sizes = np.array([len(x) for x in found], np.int64) // 4
        begins = np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.cumsum(each)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begins[which] - ends + each, each) + np.arange(ends[-1])]
        last = np.concatenate(([0], ends))[np.cumsum(counts)].tolist()
        encoded = [ids[x:y].tobytes() for x, y in zip([0, *last[:-1]], last, strict=True)]
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        out: list[bytes] = [b""] * len(column)
        for i, x in zip(order.tolist(), encoded, strict=True):
            out[i] = x
        return out


def _quiet():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


@functools.lru_cache(2)
def json_encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The encoder of a tokenizers file. Strings of added tokens in a text become those tokens, as the library has it; with ``special_as_text`` those of special ones are ordinary text."""
    _quiet()
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    cuttable = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer") and told["model"].get("dropout") is None and not told.get("truncation")
    added = tuple(t["content"] for t in told.get("added_tokens", []) if not (special_as_text and t["special"]))
    del told
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return Encoder(tokenizer, cuttable=bool(cuttable), added=added, special_as_text=special_as_text)


def byte_characters() -> dict[int, str]:
    """Byte to character: printable Latin-1 characters stand for themselves, the other bytes follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(2)
def ranks_tokenizer(path: str, pattern: str):
    """A byte-level BPE of the tokenizers library that merges by ranks: every pair of tokens whose concatenation is a token, lowest rank first."""
    _quiet()
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, to_char = read_ranks(path), byte_characters()
    as_text = {token: "".join(map(to_char.__getitem__, token)) for token in ranks}
    merges = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = token[:i], token[i:]
            if left in ranks and right in ranks:
                merges.append((rank, ranks[left], ranks[right], as_text[left], as_text[right]))
    merges.sort()
    tokenizer = Tokenizer(models.BPE(vocab={as_text[t]: r for t, r in ranks.items()}, merges=[(m[3], m[4]) for m in merges], ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


@functools.lru_cache(2)
def ranks_encoder(path: str, pattern: str) -> Encoder:
    return Encoder(ranks_tokenizer(path, pattern), cuttable=pattern == CUTTABLE)


REMEMBERED["encoder"] = [f.cache_clear for f in (json_encoder, read_ranks, ranks_tokenizer, ranks_encoder)]
