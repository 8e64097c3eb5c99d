"""Token ids of texts by a public vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: The string that stands for the end-of-text id of the byte-level vocabularies, and its id.
END_OF_TEXT = {"<|endoftext|>": 50256}
_LOADED: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its uint32 ids, without special tokens added; loaded once in a process.

    A ``.json`` file is run by ``tokenizers``.  A ``.tiktoken`` file of ranks is run by ``tiktoken``, which gives
    the ids of the ``.json`` file of the same name in about a quarter of the time.  In both, the end-of-text
    string inside a text becomes its id.
    """
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            _LOADED[path] = lambda text: np.array(model.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=END_OF_TEXT)
            _LOADED[path] = lambda text: own.encode_to_numpy(text, allowed_special="all")
    return _LOADED[path]


def vocabulary(path: str) -> int:
    """One more than the largest id that ``encoder`` can give."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
    with open(path, "rb") as lines:
        return max([int(line.split()[1]) for line in lines] + list(END_OF_TEXT.values())) + 1


def ids_of(column: pa.Array, path: str, end: int) -> list[np.ndarray]:
    """Ids of each text and then ``end``; of a null only ``end``."""
    encode, last = encoder(path), np.array([end], np.uint32)
    return [np.concatenate((encode(t), last)) if t else last for t in column.to_pylist()]
