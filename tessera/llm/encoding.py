"""Token ids of a public byte-level BPE vocabulary, for use inside tasks.

The ids are those of the `tokenizers` library for the vocabulary's .json file.
Where a .tiktoken file of the same name lies beside it, and a text has only
characters below U+0250 (on which both libraries' pre-tokenisers agree), the
same ids come from the faster `tiktoken`; every other text goes to `tokenizers`.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: The pre-tokenisation pattern of the vocabulary (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[^\\x00-ɏ]")
#: A single space between a non-space and an ASCII letter always ends a pre-token.
SAFE = re.compile(r"(?<=\S) (?=[A-Za-z])")


class Encoder:
    """ids(text) and count(text) for one vocabulary file, .json or .model."""

    def __init__(self, path: str):
        self.path, self.fast, self.slow, self.pieces = path, None, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special)

    @property
    def byte_level(self) -> bool:
        return self.fast is not None

    def fast_ids(self, text: str) -> np.ndarray | None:
        """The ids by the fast library, None where it can't give them.

        It raises ValueError where its pattern would have to go back too far, as
        in a run of a million spaces.
        """
        if not self.fast or PLAIN.search(text):
            return None
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return None

    def ids(self, text: str) -> np.ndarray:
        if self.pieces:
            return np.array(self.pieces.encode(text, num_threads=1), dtype=np.uint32)
        found = self.fast_ids(text)
        if found is not None:
            return found.astype(np.uint32, copy=False)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text of one batch."""
        if self.pieces:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        found = map(self.fast_ids, texts)
        out = [-1 if x is None else len(x) for x in found]
        rest = [i for i, n in enumerate(out) if n < 0]
        if rest:
            for i, e in zip(rest, self.slow.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = len(e.ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def safe_pieces(text: str, most: int) -> list[str]:
    """text cut into pieces of about `most` characters at safe boundaries.

    A piece grows past `most` until the next safe boundary, so that the token
    counts of the pieces add up to that of the text.
    """
    out, at = [], 0
    while len(text) - at > most:
        found = SAFE.search(text, at + most)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def byte_bpe_path() -> str:
    """The vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
