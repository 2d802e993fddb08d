"""Token ids by a tokenizer file, with a bounded memory of chunks met before.

Both kinds of tokenizer that are told apart here never join characters over a blank, so texts can be cut at blanks. A
batch's chunks are numbered by a hash table outside Python; only chunks that are new to the batch are looked up, and only
those new to the process are encoded: a word of Latin letters by the tokenizer's model (its normaliser and
pre-tokenizer leave such a word whole), a word with a full stop or comma, or joined to the next by a line feed, from its
parts, which the tokenizers' patterns keep apart too. Texts for which that doesn't hold, and texts with an added token in
them, are encoded whole; tokenizers of other kinds encode whole texts only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space around a blank, or two blanks: the byte-level pattern looks ahead over them. NUL marks first chunks.
_SPACES = r"(?:\pZ|[\x09-\x0d\x1c-\x1f\x{85}])"
_ODD = rf"  |{_SPACES} {_SPACES}|\x00"
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SPACE = re.compile(r"\s")
#: Longer chunks aren't remembered.
_LONG = 48


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class ChunkEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, entries: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        #: Texts of added tokens (special ones too): the tokenizer cuts a text at them before all else.
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.model, self.letters = self.tok.model, _byte_letters()
        first, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        parts = [x.get("type") for x in first.get("normalizers", [])]
        bpe = spec.get("model", {}).get("type") == "BPE" and not spec["model"].get("dropout")
        if bpe and not first and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.mode = "blank"  # a blank goes with the word after it
        elif bpe and parts == ["NFC", "Replace", "Lowercase"] and pre.get("pretokenizers", [{}])[0].get("behavior") == "Removed":
            self.mode = "word"  # blanks are dropped
        else:
            self.mode = "whole"
        #: ids by chunk, in two generations; a chunk without a blank before it is marked by NUL if that matters.
        self.entries, self.new, self.old, self.long = entries, {}, {}, set()
        self.mark = {m: self._ids([m])[0] for m in ".,\n"}
        self.bytes_of = [np.array([k], "<u4").tobytes() for k in range(self.tok.get_vocab_size() + 1)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _word(self, word: str, blank: bool) -> bytes:
        """ids of a word of Latin letters, as the pre-tokenizer would hand it to the model."""
        if self.mode == "word":
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.model.tokenize("Ġ" + word if blank else word)])

    def _know(self, chunk: str) -> bytes:
        """ids of one chunk, remembered."""
        ids = self.new.get(chunk)
        if ids is None:
            ids = self.old.get(chunk)
            if ids is None:
                ids = self._make(chunk)
            self.new[chunk] = ids
            if len(chunk) > _LONG:
                self.long.add(chunk)
        return ids

    def _make(self, chunk: str) -> bytes:
        first = chunk[:1] == "\0"
        body, blank = (chunk[1:] if first else chunk), self.mode == "blank" and not first
        if _WORD.fullmatch(body):
            return self._word(body, blank)
        if body[-1:] in (".", ",") and _WORD.fullmatch(body, 0, len(body) - 1):
            return self._know(chunk[:-1]) + self.mark[body[-1]]
        if self.mode == "blank" and body.count("\n") == 1 and 0 < body.index("\n") < len(body) - 1 and len(_SPACE.findall(body)) == 1:
            a, b = body.split("\n")
            return self._know("\0" * first + a) + self.mark["\n"] + self._know("\0" + b)
        return self._ids([" " + body if blank else body])[0]

    def _learn(self, chunks: list[str]) -> None:
        """Make `new` hold the chunks. The usual kinds, words of A-Z and those with a mark, are done here without calls."""
        new, old, of, tokenize, marks = self.new, self.old.get, self.bytes_of, self.model.tokenize, self.mark
        blank = "Ġ" if self.mode == "blank" else ""
        for c in chunks:
            x = old(c)
            if x is None:
                word = c[:-1] if c[-1:] in (",", ".") else c
                if word.isalpha() and word.isascii():
                    x = None if word is c else new.get(word)
                    if x is None:
                        x = b"".join([of[t.id] for t in tokenize(blank + word if blank else word.lower())])
                        if word is not c:
                            new[word] = x
                    if word is not c:
                        x += marks[c[-1]]
                else:
                    x = self._make(c)
            new[c] = x
            if len(c) > _LONG:
                self.long.add(c)

    def _turn(self) -> None:
        """Begin a new generation when this one is full; chunks too long to keep go at once."""
        for k in self.long:
            self.new.pop(k, None)
        self.long.clear()
        if len(self.new) > self.entries:
            self.old, self.new = self.new, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole" or not texts:
            return self._ids(texts)
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _ODD)
        for x in self.added:
            odd = pc.or_(odd, pc.match_substring(column, x, ignore_case=self.mode == "word"))
        if self.mode == "word":
            column = pc.if_else(pc.string_is_ascii(column), pc.ascii_lower(column), column)
            column = pc.replace_substring(column, "\n", " ")
        else:
            column = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), column, pa.scalar("", pa.large_string()))
        rest = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        out: list[bytes] = [b""] * len(texts)
        if len(rest):
            cut = pc.split_pattern(column.take(pa.array(rest)), " ")
            ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
            numbered = cut.flatten().dictionary_encode()
            chunks = numbered.dictionary.to_pylist()
            self._learn([c for c in chunks if c not in self.new])
            ids = list(map(self.new.__getitem__, chunks))
            pool = np.frombuffer(b"".join(ids), "<u4")
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            starts = np.cumsum(sizes) - sizes
            place = numbered.indices.to_numpy()
            size = sizes[place]
            upto = np.concatenate([[0], np.cumsum(size)])
            flat = pool[np.repeat(starts[place] - upto[:-1], size) + np.arange(upto[-1])]
            raw, bounds = flat.tobytes(), (4 * upto[ends]).tolist()
            for k, i in enumerate(rest.tolist()):
                out[i] = raw[bounds[k] : bounds[k + 1]]
        whole = [i for i, x in enumerate(odd.to_pylist()) if x]
        for i, x in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = x
        self._turn()
        return out


def gathered(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about `size` bytes: the larger a batch, the fewer chunks are new to it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and worker process."""
    return ChunkEncoder(path)
