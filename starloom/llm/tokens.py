"""Whole texts to token ids with a file of the tokenizers library, inside tasks."""

from __future__ import annotations

import array
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import runs

#: Entries that a Python worker remembers (about 200 bytes each) before it starts anew.
MEMO_CHUNKS = 1_000_000
#: Words that go to the library's model in one call.
TOGETHER = 4096
#: Normalizers that leave a Latin letter a letter, at most lower-cased: after them a word is one piece.
PLAIN = {"NFC", "Replace", "Lowercase"}
MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


class ChunkMemo(dict):
    """Word with ASCII letters lowered, or marks, or chunk -> packed ids. A chunk is what stands between spaces and
    line ends."""

    def __init__(self, tokenizer, code: str, by_word: bool) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        super().__init__()
        self.tokenizer, self.code, self.by_word = tokenizer, code, by_word
        # the ByteLevel alphabet: printable bytes stand for themselves, the others for the characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        if by_word:
            self.bare = Tokenizer(tokenizer.model)
            self.bare.pre_tokenizer = WhitespaceSplit()
            suffix = tokenizer.model.end_of_word_suffix
            self.ends = np.zeros(max(tokenizer.get_vocab_size(True), 1), bool)
            if suffix:
                self.ends[[i for x, i in tokenizer.get_vocab(False).items() if x.endswith(suffix)]] = True

    def packed(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember words of Latin letters, a batch of them as one text of the library's model."""
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            raw = [w if w.isascii() else w.lower().encode().decode("latin-1").translate(self.bytes) for w in some]
            ids = np.array(self.bare.encode_batch_fast([" ".join(raw)], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # no suffix tells where words end
                self.update((w, self.packed([x.id for x in self.tokenizer.model.tokenize(r)])) for w, r in zip(some, raw))
                continue
            flat, cuts = ids.astype(self.code).tobytes(), (np.r_[0, stops] * np.dtype(self.code).itemsize).tolist()
            self.update(zip(some, map(flat.__getitem__, map(slice, cuts, cuts[1:]))))

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The packed ids of distinct words, or chunks."""
        if len(self) >= MEMO_CHUNKS:
            self.clear()
        found = list(map(self.get, words))
        lacking = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in lacking:
            word = words[i]
            if self.by_word and word.isalpha() and (word.isascii() or max(word) < "Ā"):
                new.append(word)
            else:
                self[word] = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.learn(new)
        for i in lacking:
            found[i] = self[words[i]]
        return found

    def look_up(self, chunks: pa.Array) -> list[bytes]:
        """The packed ids of distinct chunks. The marks that end a word, after a letter or digit, are one piece."""
        whole = listed(chunks)
        if not self.by_word:
            return self.word_ids(whole)
        coded = pc.ascii_lower(pc.utf8_rtrim(chunks, MARKS)).dictionary_encode()
        words = listed(coded.dictionary)
        index = np.asarray(coded.indices)
        apart = np.array([not w[-1:].isalnum() or w[-1] >= "Ā" for w in words], bool)[index]
        found = list(map(self.word_ids(words).__getitem__, index.tolist()))
        marked = np.flatnonzero(~apart & (np.asarray(pc.binary_length(chunks)) > np.asarray(pc.binary_length(coded.dictionary))[index])).tolist()
        for i in marked:
            chunk = whole[i]
            mark = chunk[len(chunk.rstrip(MARKS)) :]
            if mark not in self:
                self[mark] = self.packed(self.tokenizer.encode(mark, add_special_tokens=False).ids)
            found[i] += self[mark]
        rest = np.flatnonzero(apart).tolist()
        for i, ids in zip(rest, self.word_ids([whole[i] for i in rest])):
            found[i] = ids
        return found


def listed(texts: pa.Array) -> list[str]:
    """Texts without line feeds as a list: one string is split, which is faster than a scalar each."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), pa.scalar("\n", texts.type))[0].as_py().split("\n") if len(texts) else []


class ChunkEncoder:
    """Encodes texts, chunk by chunk where the tokenizer's file allows that.

    A Split pre-tokenizer that drops what it doesn't match, white space among it, makes a text's ids those of its
    chunks, one after another. Under plain normalizers a word of Latin letters is one piece and goes straight to the
    library's model. Other files, and texts with a control string, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.size = max(self.tokenizer.get_vocab_size(True), 1)
        split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) or [{}]
        pattern = (split.get("pattern") or {}).get("Regex", "")
        self.by_chunk = split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert")) and r"[^\s\p{L}\p{N}]+" in pattern
        normal = spec.get("normalizer") or {}
        byte_level = [x["type"] for x in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        by_word = self.by_chunk and byte_level and r"[\p{L}]+" in pattern and spec["model"]["type"] == "BPE" and {x["type"] for x in normal.get("normalizers", [normal])} == PLAIN
        self.control = [x["content"] for x in spec.get("added_tokens", [])]
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.memo = ChunkMemo(self.tokenizer, self.code, by_word)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.code)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i] : offsets[i + 1]]; null texts have none.

        Distinct chunks are found by Arrow; only they are looked up.
        """
        apart = [i for i, x in enumerate(texts) if x.is_valid and any(c in x.as_py() for c in self.control)] if any(pc.any(pc.match_substring(texts, c)).as_py() for c in self.control) else []
        if not self.by_chunk or apart:
            rows = [self.whole(x) if x and (not self.by_chunk or i in set(apart)) else self(texts.slice(i, 1))[0] if x else np.empty(0, self.code) for i, x in enumerate(texts.to_pylist())]
            return np.concatenate([np.empty(0, self.code), *rows]), np.cumsum([0, *map(len, rows)])
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        bounds = np.asarray(lists.offsets).astype(np.int64)
        bounds -= bounds[0]
        found = self.memo.look_up(coded.dictionary)
        size = np.dtype(self.code).itemsize
        length = np.fromiter(map(len, found), np.int64, len(found)) // size
        flat, first = np.frombuffer(b"".join(found), self.code), np.cumsum(length) - length
        index = np.asarray(coded.indices)
        each = length[index]
        upto = np.r_[0, np.cumsum(each)]
        place = np.repeat(first[index] - upto[:-1], each)
        place += np.arange(upto[-1])
        return flat[place], upto[bounds]

    def batches(self, texts: pa.Array, size: int = 12 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, offsets) of runs of texts of about `size` bytes."""
        for at, n in runs(texts, size):
            yield at, *self(texts.slice(at, n))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
