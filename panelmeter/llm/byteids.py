r"""Ids of whole texts under a byte-level vocabulary file of the `tokenizers` library.

The ids are those of that library. Where it can be shown that they are the same, they are
computed by `tiktoken`, which needs a quarter of the time and keeps nothing between texts:

* the vocabulary joins bytes in the order of its ids (`ranks` compares its whole list of
  joins), cuts texts by the usual byte-level rule and normalises nothing;
* the text holds none of the vocabulary's special strings;
* both libraries put each of its signs beyond ASCII into the same class (letter, number,
  white space, other). Their Unicode tables may differ, so a sign is tried in both when
  it is first met;
* no run of signs without a space is longer than RUN, since `tiktoken` can fail there.

All other texts go to the library itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# The cutting rule of byte-level vocabularies.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = 50_000
LONG_RUN = re.compile(r"[^ \n]{%d}| {%d}|\n{%d}" % (RUN, RUN, RUN))


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others in order from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each id, if ids are ranks: bytes first, then every join in order. Else None."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if (spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space")
            or not cut.get("use_regex", True) or model.get("type") != "BPE"
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))):
        return None
    signs = byte_signs()
    special = {t["content"] for t in spec.get("added_tokens") or []}
    plain = {w: i for w, i in model["vocab"].items() if w not in special}
    joined = [j if isinstance(j, list) else j.split(" ") for j in model["merges"]]
    order = sorted(plain, key=plain.get)
    if (len(order) != 256 + len(joined) or set(order[:256]) != set(signs)
            or any(w != a + b for w, (a, b) in zip(order[256:], joined))):
        return None
    return {bytes(signs[c] for c in w): i for w, i in plain.items()}


class ByteIds:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # a task has one core
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.same, self.odd, self.fast = set(map(chr, range(128))), set(), None
        if (known := ranks(spec)) is not None:
            import tiktoken
            self.fast = tiktoken.Encoding("own", pat_str=RULE, mergeable_ranks=known, special_tokens={})

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _quick(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _agreed(self, text: str) -> bool:
        """Whether both libraries cut at the same places whatever signs of text meet."""
        for c in set(text) - self.same:
            if c in self.odd:
                return False
            trial = f"a{c}a1{c}1!{c}! {c} {c}{c}\n{c} '{c}"
            (self.same if self._library([trial])[0] == self._quick(trial) else self.odd).add(c)
        return not self.odd or self.odd.isdisjoint(text)

    def _plain(self, text: str) -> bool:
        return (self.fast is not None and not any(s in text for s in self.special)
                and (text.isascii() or self._agreed(text))
                and (len(text) < RUN or not LONG_RUN.search(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [self._quick(t) if self._plain(t) else None for t in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._library([texts[k] for k in rest])):
            out[k] = x
        return out
