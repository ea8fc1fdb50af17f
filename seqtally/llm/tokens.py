"""Ids of whole texts by the tokenizers library, with pre-tokens encoded once per worker.

A text's ids are those of its pre-tokens in turn, so each distinct pre-token goes through the
library once and the rest is array lookups.  Texts with code points on which Unicode versions
disagree, and those that hold the string of an added token, go through the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from seqtally.llm.kernels import PieceCache, column_bytes, pretokens, runs


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[bytes, ...]:
    """The strings that the library takes out of a text before it is cut into pre-tokens."""
    return tuple(t.content.encode() for t in _library(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    t = _library(path)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [x.ids for x in t.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]

    return PieceCache(encode)


def encode_column(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with end_id after each, offsets).  A null is an empty text."""
    data, offsets = column_bytes(column)
    cache = _cache(path)
    parts, sizes = [], []
    for i, j in runs(offsets):
        lo = offsets[i]
        d, o = data[lo : offsets[j]], offsets[i : j + 1] - lo
        starts, ends, doc, unsure = pretokens(d, o)
        raw = d.tobytes()
        for mark in _added(path):
            at = raw.find(mark)
            while at >= 0:
                k = int(np.searchsorted(o, at, "right")) - 1
                unsure[k] = True
                at = raw.find(mark, max(at + 1, int(o[k + 1]) - len(mark) + 1))
        flat, size = cache.lookup(d, starts, ends)
        per_doc = np.bincount(doc, weights=size, minlength=j - i).astype(np.int64)
        if unsure.any():
            cut = np.append(0, np.cumsum(per_doc))
            whole = [flat[cut[k] : cut[k + 1]] for k in range(j - i)]
            for k in np.flatnonzero(unsure):
                text = raw[o[k] : o[k + 1]].decode("utf-8", "replace")
                whole[k] = np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
                per_doc[k] = len(whole[k])
            flat = np.concatenate(whole)
        parts.append(np.insert(flat, np.cumsum(per_doc), np.uint32(end_id)))
        sizes.append(per_doc + 1)
    out = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), out
