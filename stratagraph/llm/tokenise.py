"""Exact token ids of public tokenizer files.

* byte-level BPE (``ByteEncoder``): the vocabulary of a tokenizers file in the tiktoken library,
  whose ids are the same and come several times faster; texts with very long words or runs of
  white space, where that library takes quadratic time, go through the tokenizers library.
* word BPE (``WordEncoder``): the tokenizers library. A text is cut at spaces and newlines, which
  the file's pre-tokenizer drops, so the ids of a text are the ids of its chunks in a row. Each
  distinct chunk of a call is encoded once; a bounded cache keeps the frequent ones. Chunks that
  the cache lacks are encoded many to a call, with a separator between them that is a token of
  its own; where that can't be told apart, one by one.

A text that holds the string of an added token goes through the tokenizers library whole.

The tests hold both against the tokenizers library over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept in a worker's cache: the first so many that it meets, so the frequent ones.
CACHE = 300_000
#: Longer chunks are encoded each time.
KEPT_CHARS = 48
#: Characters of text encoded together, and chunks joined for one call.
GROUP_CHARS, JOINED = 4_000_000, 256
_SPACE = re.compile(r"\s")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, as it comes: an added token's string inside a text is that token."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What the encoders below assume of a file, as the file says it.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PLAIN_BPE = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
WORD_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def require(path: str, normalizer, pre_tokenizer, suffix: str | None) -> None:
    """Raise unless the file's normaliser, pre-tokenizer and model are those that an encoder is built for."""
    import json

    found = json.loads(load(path).to_str())
    model = {k: v for k, v in found["model"].items() if k not in ("vocab", "merges")}
    want = PLAIN_BPE | {"end_of_word_suffix": suffix}
    odd = [k for k, ok in (("normalizer", json.dumps(found["normalizer"]) == normalizer), ("pre_tokenizer", json.dumps(found["pre_tokenizer"]) == pre_tokenizer), ("model", model == want)) if not ok]
    odd += [t["content"] for t in found["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
    if odd:
        raise ValueError(f"{path}: another {', '.join(odd)} than the encoder is built for")


def added_tokens(tokenizer) -> re.Pattern[str]:
    """Where a lower-cased text may hold an added token's string; such texts go through the library whole."""
    return re.compile("|".join(re.escape(t.content.lower()) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _word_chunks(texts: list[str], uneven: bool) -> pa.ListArray:
    """Latin-1 texts are lower-cased here (they are normal and case maps one to one there); others by the tokenizer."""
    texts = [t.lower() if _latin(t) else t for t in texts]
    return pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")


class ChunkEncoder:
    """Texts to their ids; each distinct chunk of a call is encoded once, frequent ones once for all."""

    def __init__(self, chunks: Callable[[list[str], bool], pa.ListArray]):
        self.chunks, self.cache = chunks, {"": b""}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        raise NotImplementedError

    def _known(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, chunks))
        new = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
        if new:
            learnt = self._learn(new)
            found = [learnt[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return found

    def _keep(self, learnt: dict[str, bytes]) -> None:
        if len(self.cache) < CACHE:
            self.cache.update((k, v) for k, v in learnt.items() if len(k) <= KEPT_CHARS)

    def encode(self, texts: list[str], uneven: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (and the last one's end). uneven: see ``groups``."""
        lists = self.chunks(texts, uneven)
        coded = lists.values.dictionary_encode()
        found = self._known(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        pool = np.frombuffer(b"".join(found), "<u4")
        many = np.fromiter(map(len, found), np.int32, len(found)) // 4
        starts = np.cumsum(many, dtype=np.int32) - many
        length = many[codes]
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        kind = np.int32 if ends[-1] < 2**31 else np.int64
        ids = pool[np.arange(ends[-1], dtype=kind) + np.repeat((starts[codes] - ends[:-1]).astype(kind), length)] if ends[-1] else np.empty(0, "<u4")
        return ids, ends[lists.offsets.to_numpy()]


class WordEncoder(ChunkEncoder):
    """Ids of the tokenizers library for a word BPE file.

    Lower-case Latin-1 words, and the marks after them, are words of their own to the file's
    pre-tokenizer: they go to its BPE model alone. Other chunks go through the whole tokenizer,
    many to a call with a separator between them that is a token of its own.
    """

    SEPARATOR, MARK = " | ", "|"
    WORD = re.compile("([a-zªµºß-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        import json

        split = {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}
        require(path, json.dumps(WORD_NORMAL), json.dumps({"type": "Sequence", "pretokenizers": [split, BYTE_LEVEL | {"use_regex": False}]}), "</w>")
        super().__init__(_word_chunks)
        self.tokenizer = load(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(self.MARK, "isolated")
        self.added = added_tokens(self.tokenizer)
        self.bytes = {b: c for c, b in _byte_of_char().items()}
        self.sep_id = self._ids(self.tokenizer, [self.MARK])[0][0]
        if self._ids(self.model, [self.MARK])[0] != [self.sep_id]:
            raise ValueError("the separator isn't one token")

    def encode(self, texts: list[str], uneven: bool = True) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.added.search(t.lower())]
        if not whole:
            return super().encode(texts, uneven)
        rest = list(texts)
        for i in whole:
            rest[i] = ""
        ids, ends = super().encode(rest, uneven)
        parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in whole:  # one by one: a long text's encoding takes much more memory than its ids
            parts[i] = np.array(self._ids(self.tokenizer, [texts[i]])[0], "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, tokenizer, chunks: list[str], texts: list[str], separator: str, out: dict[str, bytes]) -> list[str]:
        """Encode joined texts and put each chunk's ids in ``out``; the chunks whose ids can't be told apart."""
        at, left = range(0, len(chunks), JOINED), []
        for k, ids in zip(at, self._ids(tokenizer, [separator.join(texts[k : k + JOINED]) for k in at]), strict=True):
            ids, own = np.array(ids, "<u4"), chunks[k : k + JOINED]
            ends = np.flatnonzero(ids == self.sep_id).tolist()
            if len(ends) != len(own) - 1:
                left += own
                continue
            data, start = ids.tobytes(), 0
            for chunk, end in zip(own, [*ends, len(ids)], strict=True):
                out[chunk] = data[4 * start : 4 * end]
                start = end + 1
        return left

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        closed, other, odd, words, out = [], [], [], {}, {}
        for chunk in new:
            if m := self.WORD.fullmatch(chunk):
                body, marks = m.groups()
                if body not in self.cache:
                    words[body] = None
                if marks:
                    closed.append((chunk, body, marks))
            else:
                (odd if self.MARK in chunk or _SPACE.search(chunk) else other).append(chunk)
        plain = list(words)
        mapped = [w if w.isascii() else "".join([self.bytes[b] for b in w.encode()]) for w in plain]
        odd += self._apart(self.model, plain, mapped, self.MARK, out)
        odd += self._apart(self.tokenizer, other, other, self.SEPARATOR, out)
        for chunk, ids in zip(odd, self._ids(self.tokenizer, odd), strict=True):
            out[chunk] = np.array(ids, "<u4").tobytes()
        ends = list({marks for _, _, marks in closed})
        ends = {m: np.array(ids, "<u4").tobytes() for m, ids in zip(ends, self._ids(self.tokenizer, ends), strict=True)}
        cache = self.cache
        out.update((chunk, (out[body] if body in out else cache[body]) + ends[marks]) for chunk, body, marks in closed)
        self._keep(out)
        return out


#: Fixed value: how byte-level BPE files cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a word, or of white space beyond one between two words, that tiktoken may get.
LONG = 400


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write a byte as itself if it prints, else as the next character from U+0100 on."""
    prints = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    def __init__(self, path: str):
        import json

        import tiktoken

        require(path, "null", json.dumps(BYTE_LEVEL), None)
        self.library = load(path)
        of = _byte_of_char()
        self.added = added_tokens(self.library)
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes(map(of.__getitem__, piece)): i for piece, i in self.library.get_vocab(with_added_tokens=True).items() if piece not in special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        words = text.split()
        if self.added.search(text.lower()):
            words = []
        if words and max(map(len, words)) <= LONG and len(text) - sum(map(len, words)) <= len(words) + LONG:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def groups(texts, uneven: Callable[[str], bool] = lambda t: False, most: int = GROUP_CHARS) -> Iterator[tuple[list[int], list[str], bool]]:
    """An Arrow column's texts in lists of about ``most`` characters: (positions, texts, uneven).

    Texts that are uneven come in lists of their own.
    """
    held: dict[bool, tuple[list[int], list[str]]] = {False: ([], []), True: ([], [])}
    size = {False: 0, True: 0}
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        kind = uneven(t)
        held[kind][0].append(i)
        held[kind][1].append(t)
        size[kind] += len(t)
        if size[kind] >= most:
            yield *held[kind], kind
            held[kind], size[kind] = ([], []), 0
    yield from ((*h, kind) for kind, h in held.items() if h[0])
