"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words (white-space marks, then other characters: no piece of the model spans
a mark that follows another character; this is checked on loading). Each distinct word of a
batch is encoded once: all words' characters lie in one flat symbol array, every round finds
each word's best pair with a segmented minimum over pair ranks, merges it simultaneously in
all words (leftmost first; every occurrence of it in a word where that provably equals one at
a time) and compacts the array, until no pair is left. Finished words leave the array.

A long word without a space would take a round per distinct pair. It is cut where no piece spans two
characters, and a round also merges every pair that ranks before whatever its neighbours could ever
make with it (``_bounds``: the least rank of any piece that such a meeting can give). Such a pair is
merged before its neighbours touch it in any order, so the ids stay the library's.

Ranks come from the model's own scores, so the ids equal the library's. Characters outside
the vocabulary become byte pieces. Decoding looks ids up in a table of piece bytes.

Defined results: a null text counts as empty; an empty text has the end id only; repeated
rows each get a row; null ids stay; an empty table gives no rows; extra columns are ignored;
a null id array decodes to an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import id_and_text
from stratagraph.llm.tokenise import ChunkEncoder, groups

MARK = "▁"
_NONE = np.int64(1) << 62
#: Distinct words that go through the merge rounds together.
TOGETHER = 1 << 14
#: Symbols from which a word is cut, and its pairs are compared with their neighbours' bounds.
LONG = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Merge ranks and piece tables of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.unk, self.end = n, sp.unk_id(), sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {self.pieces[i]: i for i in plain}
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids) or sp.normalize("a  Åﬁ ") != f"{MARK}a{MARK}{MARK}Åﬁ{MARK}":
            raise ValueError("only BPE models with byte fallback, marks in front and no normalisation are supported")
        # A rank per id: higher scores merge first; of equal ones (pieces of marks only) the leftmost.
        self.rank = np.full(n, _NONE)
        self.rank[plain] = np.unique([-sp.get_score(i) for i in plain], return_inverse=True)[1]
        # Every way to cut a piece into two pieces is a pair that may merge: key left * n + right, sorted.
        keys, made = [], []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    made.append(i)
        at = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_made = np.array(keys, np.int64)[at], np.array(made, np.int64)[at]
        self.table = self._hashed(self.pair_keys, self.pair_made)
        self.left_bounds, self.right_bounds = self._bounds()
        self.spans = np.unique([ord(a) * 0x110000 + ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)]).astype(np.int64)
        self.bytes = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.run = max((len(p) for p in self.ids if not p.strip(MARK)), default=1)
        many = np.diff(self.encode_words([MARK * k for k in range(3 * self.run)])[1])
        if any(many[k] != 1 + many[k - self.run] for k in range(self.run + 1, 3 * self.run)):
            raise ValueError("long runs of marks can't be cut")
        # A run of marks merges from the left into the longest mark piece, so it may be cut there.
        self.words = re.compile(f"{MARK}{{{self.run}}}(?={MARK}{{{self.run}}})|{MARK}*[^{MARK}]+|{MARK}+")
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.is_control = np.array([sp.is_control(i) for i in range(n)])
        self.marked = np.array([p.startswith(MARK) for p in self.pieces])
        self.width = np.array([len(b) for b in self.bytes])
        self.start, self.pool = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(self.bytes), np.uint8)

    def _bounds(self) -> tuple[tuple, tuple]:
        """Tables of the least rank that a symbol and its neighbour can ever meet in.

        left: (a, r) to the least rank of a piece made of l and r, where l ends with a; right: (l, b)
        to that of l and r, where r starts with b.
        """
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        rank = self.rank.tolist()
        ends = {i: [self.ids[p[k:]] for k in range(len(p)) if p[k:] in self.ids] for p, i in self.ids.items()}
        heads = {i: [self.ids[p[:k]] for k in range(1, len(p) + 1) if p[:k] in self.ids] for p, i in self.ids.items()}
        for key, made in zip(self.pair_keys.tolist(), self.pair_made.tolist(), strict=True):
            lo, hi = divmod(key, self.size)
            least = rank[made]
            for table, keys in ((left, [a * self.size + hi for a in ends[lo]]), (right, [lo * self.size + b for b in heads[hi]])):
                for k in keys:
                    if least < table.get(k, _NONE):
                        table[k] = least
        return tuple(self._hashed(np.fromiter(t.keys(), np.int64, len(t)), np.fromiter(t.values(), np.int64, len(t))) for t in (left, right))

    @classmethod
    def _hashed(cls, wanted: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Pairs in an open-addressing table: numpy looks whole arrays up with a few gathers."""
        bits = int(len(wanted) * 2).bit_length()
        keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, probes = np.arange(len(wanted)), 0
        at = cls._slot(wanted, bits)
        while len(left):
            probes += 1
            free = keys[at] < 0
            keys[at[free]] = wanted[left[free]]
            won = keys[at] == wanted[left]
            values[at[won]] = made[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << bits) - 1)
        return keys, values, bits, probes

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _look(self, table: tuple, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A table's value for each pair of ids, or -1. Ids below 0 are in no pair."""
        keys, values, bits, probes = table
        want = left * self.size + right
        want[(left < 0) | (right < 0)] = -2
        at, out = self._slot(want, bits), np.full(len(want), -1, np.int64)
        open_ = np.arange(len(want))
        for _ in range(probes):
            found = keys[at]
            hit = found == want[open_]
            out[open_[hit]] = values[at[hit]]
            more = ~hit & (found >= 0)
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & ((1 << bits) - 1)
        return out

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair of ids makes, or -1."""
        return self._look(self.table, left, right)

    def _settled(self, symbols: np.ndarray, of: np.ndarray, at: np.ndarray, made: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which pairs at ``at`` rank before all that their neighbours could make of the two or of what they make."""
        before, after = self._neighbour(symbols, of, at, -1), self._neighbour(symbols, of, at, 2)
        out = np.ones(len(at), bool)
        for table, left, right in (
            (self.left_bounds, before, symbols[at]), (self.right_bounds, symbols[at + 1], after), (self.left_bounds, before, made), (self.right_bounds, made, after),
        ):
            bound = self._look(table, left, right)
            out &= (bound < 0) | (rank < bound)
        return out

    def _rank(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.rank[ids], _NONE)

    @staticmethod
    def _neighbour(symbols: np.ndarray, of: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """The symbol ``step`` away in the same word, else -1."""
        where = np.clip(at + step, 0, len(symbols) - 1)
        return np.where((where == at + step) & (of[where] == of[at]), symbols[where], -1)

    def _cut(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Long words in parts that no piece spans: the word of each part, and its length."""
        long = lengths > LONG
        if not long.any():
            return np.arange(len(lengths)), lengths
        starts = np.cumsum(lengths) - lengths
        inside = np.flatnonzero(np.repeat(long, lengths)[1:]) + 1
        pairs = codes[inside - 1].astype(np.int64) * 0x110000 + codes[inside]
        at = np.minimum(np.searchsorted(self.spans, pairs), len(self.spans) - 1)
        parts = np.union1d(starts[lengths > 0], inside[self.spans[at] != pairs])
        return np.searchsorted(starts, parts, "right") - 1, np.diff(np.append(parts, len(codes)))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row and where each word's begin (and the last one's end), by merge rounds."""
        chars = "".join(words)
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, inverse = np.unique(codes, return_inverse=True)
        known = np.array([self.ids.get(chr(c), -1 - k) for k, c in enumerate(distinct)], np.int64)
        symbols = known[inverse]  # characters outside the vocabulary: -1 - position in distinct
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word_of, lengths = self._cut(codes, lengths)
        of = np.repeat(np.arange(len(lengths)), lengths)
        done_of, done_symbols = [], []
        while len(symbols):
            made = np.full(len(symbols), -1, np.int64)
            made[:-1] = self.merged(symbols[:-1], symbols[1:])
            made[:-1][of[:-1] != of[1:]] = -1
            rank = self._rank(made)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(of)))
            live = best < _NONE
            if not live.all():  # words without a pair leave
                stay = np.repeat(live, size)
                done_of.append(of[~stay])
                done_symbols.append(symbols[~stay])
                symbols, of, made, rank, best, size = symbols[stay], of[stay], made[stay], rank[stay], best[live], size[live]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(best, size)
            # In a run of overlapping occurrences every other one, from the left, merges.
            at = np.flatnonzero(chosen)
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1)])
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            # One at a time, a merge may open a better (or as good) pair with a neighbour (which stands merged on
            # the left if its own merge came just before) ahead of the word's next occurrence; such
            # words do only their leftmost merge in this round.
            made_at, word_at = made[at], of[at]
            beside = np.concatenate([[False], (at[1:] == at[:-1] + 2) & (word_at[1:] == word_at[:-1])])
            left = np.where(beside, made_at, self._neighbour(symbols, of, at, -1))
            opened = np.minimum(self._rank(self.merged(left, made_at)), self._rank(self.merged(made_at, self._neighbour(symbols, of, at, 2))))
            leftmost = np.concatenate([[True], word_at[1:] != word_at[:-1]])
            group = np.cumsum(leftmost) - 1
            careful = np.bincount(group, opened <= rank[at]) > 0
            at = at[leftmost | ~careful[group]]
            if size.max() > LONG:
                more = np.flatnonzero((rank < _NONE) & np.repeat(size > LONG, size))
                more = more[self._settled(symbols, of, more, made[more], rank[more])]
                at = np.union1d(at, more)
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, of = symbols[keep], of[keep]
        of = np.concatenate(done_of) if done_of else np.empty(0, np.int64)
        symbols = np.concatenate(done_symbols) if done_symbols else np.empty(0, np.int64)
        order = np.argsort(of, kind="stable")
        of, symbols = word_of[of[order]], symbols[order]
        if len(symbols) and symbols.min() < 0:  # byte pieces
            parts = [np.array([self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")], np.int64) for c in distinct]
            width = np.array([len(p) for p in parts])
            unknown = symbols < 0
            many = np.where(unknown, width[np.where(unknown, -1 - symbols, 0)], 1)
            ids = np.repeat(symbols, many)
            where = np.repeat(unknown, many)
            ids[where] = np.concatenate([parts[k] for k in -1 - symbols[unknown]])
            of, symbols = np.repeat(of, many), ids
        return symbols, np.searchsorted(of, np.arange(len(words) + 1))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """As the library's decode of each list: the first piece loses its leading mark, byte runs become characters."""
        length = self.width[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        data = self.pool[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], length)].tobytes()
        inside = np.concatenate([[0], np.cumsum(self.is_control[ids])])
        out = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if lo < hi and inside[hi - 1] > inside[lo]:  # a control piece before the end may part a byte run
                out.append(self._decode_runs(ids[lo:hi]))
                continue
            own = data[ends[lo] : ends[hi]]
            try:
                out.append((own[1:] if lo < hi and self.marked[ids[lo]] else own).decode())
            except UnicodeDecodeError:
                out.append(self._decode_runs(ids[lo:hi]))
        return out

    def _decode_runs(self, ids: np.ndarray) -> str:
        """Byte runs that aren't UTF-8: each byte that starts no character becomes U+FFFD."""
        out, first, k = [], True, 0
        ids = ids.tolist()
        while k < len(ids):
            if self.is_control[ids[k]]:
                k += 1
                continue
            if not self.is_byte[ids[k]]:
                text = self.bytes[ids[k]].decode()
                out.append(text[1:] if first and self.marked[ids[k]] else text)
                k += 1
            else:
                stop = k
                while stop < len(ids) and self.is_byte[ids[stop]]:
                    stop += 1
                run = b"".join(self.bytes[i] for i in ids[k:stop])
                at = 0
                while at < len(run):
                    for width in (1, 2, 3, 4):
                        try:
                            out.append(run[at : at + width].decode())
                            at += width
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        out.append("�")
                        at += 1
                k = stop
            first = False
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _uneven(text: str) -> bool:
    return text[:1] == " " or "  " in text or MARK in text or "\0" in text


class Encoder(ChunkEncoder):
    """Texts to ids by merge rounds. Words end at marks and at newlines, which no piece holds."""

    def __init__(self, path: str):
        super().__init__(self._words)
        self.model = load(path)
        if any("\n" in p for p in self.model.ids):
            raise ValueError("a piece holds a newline")

    def _words(self, texts: list[str], uneven: bool) -> pa.ListArray:
        if uneven:
            return pa.array([self.model.words.findall(MARK + t.replace(" ", MARK) if t else "") for t in texts], pa.list_(pa.string()))
        marked = pa.array([MARK + t if t else "" for t in texts], pa.string())
        marked = pc.replace_substring(pc.replace_substring(marked, " ", "\0" + MARK), "\n", "\0\n\0")
        return pc.split_pattern(marked, "\0")

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            ids, ends = self.model.encode_words(part)
            data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            out.update((w, data[lo:hi]) for w, lo, hi in zip(part, ends[:-1], ends[1:], strict=True))
        self._keep(out)
        return out


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for own, texts, uneven in groups(batch.column("text"), _uneven):
                ids, at = encoder.encode(texts, uneven)
                ids = np.insert(ids.astype(np.int32), at[1:], encoder.model.end)
                lists = pa.ListArray.from_arrays(pa.array((at + np.arange(len(at))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), lists], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, len(batch), 1024)):
                lists = part.column("ids")
                flat, many = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                out = model.decode(flat, np.concatenate([[0], np.cumsum(many)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(out, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``: the library's ids of each text, closed by the end id."""
    kind = df.schema[id_col].dataType.simpleString()
    return id_and_text(df, id_col, text_col).mapInArrow(_encode(model or default_model()), f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` to ``(doc_id, ids, decoded)``."""
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "ids").mapInArrow(_decode(model or default_model()), f"doc_id {kind}, ids array<int>, decoded string")


def digests(df: DataFrame) -> DataFrame:
    """``(doc_id, ids, decoded)`` to ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
