"""Encoding with the tokenizers library, each piece of the pre-tokenisation pattern once per worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

from modeloom.llm.pieces import PieceCache


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def library_cache(path: str) -> PieceCache:
    """A piece cache over the byte-level BPE tokenizer in the file.

    The tokenizer splits a text by the pattern before it merges anything, so a text's ids
    are those of its pieces in a row, and a piece alone is split no further.  Texts that hold
    the name of a special token are encoded whole, as the library does by default.
    Pieces that begin with a blank and go on with no white space delimit each other; many are
    encoded in one call and told apart by the blank at the head of their first token.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    head = {i for w, i in t.get_vocab().items() if w.startswith("Ġ")}
    run = getattr(t, "encode_batch_fast", t.encode_batch)

    def encode(pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and not p[1].isspace()]
        groups = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        for group, e in zip(groups, run(["".join(pieces[i] for i in g) for g in groups], add_special_tokens=False)):
            ids = e.ids
            begins = [k for k, x in enumerate(ids) if x in head]
            if len(begins) == len(group):
                for i, a, b in zip(group, begins, [*begins[1:], len(ids)]):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, run([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    added = [x.content for x in t.get_added_tokens_decoder().values()]
    whole = re.compile("|".join(map(re.escape, added))) if added else None
    return PieceCache(encode, whole=whole, encode_whole=lambda text: t.encode(text, add_special_tokens=False).ids)
