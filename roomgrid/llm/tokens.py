"""Byte-level BPE ids of whole Arrow batches.

The vocabulary is a public ``tokenizers`` JSON file of the byte-level kind (its path is a
parameter).  Its splitting pattern lets a piece begin at every space that a non-space
follows, so a text falls into units (a word with its leading space) whose ids do not depend
on their neighbours.  Each distinct unit of a batch is encoded once and the ids are gathered
back; for invented or repetitive prose that is a small share of the text.  Equality with
``tokenizers`` is tested.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from roomgrid.llm import words as W

CHUNK_BYTES = 4 << 20

# first bytes of characters that are certainly no white space
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE0] = True
_SOLID[0xE4:0xF5] = True

# The splitting pattern of byte-level BPE with "use_regex" (fixed value of that format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in keep}
    out.update({chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(keep))})
    return out


class UnitTokenizer:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without prefix space or normaliser is needed")
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        if any(b" " in t for t in self.added):
            raise ValueError("added tokens with spaces are not supported")
        chars, skip = _byte_chars(), {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if i not in skip}
        self.fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for tok, i in ranks.items():
            self.size[i] = len(tok)
        self.whole = Tokenizer.from_file(path)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, number of ids of each row)."""
        buf, offs = W.buffers(col)
        n = len(col)
        if len(buf) == 0:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cut = np.zeros(len(buf), dtype=bool)
        cut[:-1] = (buf[:-1] == 0x20) & _SOLID[buf[1:]]
        begin = offs[:-1][offs[:-1] < offs[1:]]
        inner = np.flatnonzero(cut)
        cut[begin] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        _, at, back = np.unique(W.span_hash(buf, start, end), return_index=True, return_inverse=True)
        us, ue = start[at], end[at]
        plain = np.isin(us, inner, assume_unique=False) if len(inner) else np.zeros(len(us), bool)
        data = buf.tobytes()
        for tok in self.added:       # units that hold an added token go the plain way
            p = data.find(tok)
            while p >= 0:
                u = back[np.searchsorted(start, p, side="right") - 1]
                plain[u] = False
                p = data.find(tok, p + 1)
        size = np.zeros(len(us), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (units, their ids end to end)
        some = np.flatnonzero(plain)
        if len(some):
            length = ue[some] - us[some]
            stop = np.cumsum(length)
            take = np.arange(stop[-1]) + np.repeat(us[some] - (stop - length), length)
            ids = self.fast.encode_to_numpy(buf[take].tobytes().decode())
            size[some] = np.diff(np.searchsorted(np.cumsum(self.size[ids]), stop, side="left") + 1, prepend=0)
            parts.append((some, ids))
        for u in np.flatnonzero(~plain):
            text = data[us[u]:ue[u]]
            if any(t in text for t in self.added):
                ids = np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
            else:
                ids = self.fast.encode_to_numpy(text.decode())
            size[u] = len(ids)
            parts.append((np.array([u]), ids))
        flat = np.concatenate([p[1] for p in parts]).astype(np.uint32)
        order = np.concatenate([p[0] for p in parts])
        first = np.empty(len(us), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        length = size[back]
        stop = np.cumsum(length)
        kind = np.int32 if max(stop[-1], len(flat)) < 1 << 31 else np.int64
        out = flat[np.arange(stop[-1], dtype=kind) + np.repeat((first[back] - (stop - length)).astype(kind), length)]
        row = np.searchsorted(offs, start, side="right") - 1
        return out, np.bincount(row, weights=length, minlength=n).astype(np.int64)
