"""Exact token ids of whole texts, with every distinct word encoded once in a worker.

Both supported tokenizers never let a token span the boundary between a visible character and
the space or line break after it. A text is therefore cut there, each distinct piece is encoded by the
tokenizers library once, and the ids are joined. Texts with white space that this argument
doesn't cover are cut more carefully or encoded whole, so the ids are always those of the library.
"""

from __future__ import annotations

import codecs
import operator
import os
import re
import string
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm import workers

#: A private-use character that marks the ends of pieces encoded together.
MARK = "\ue000"
_PRIVATE = re.compile("[\ue000-\uefff]")
_RUNS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Entries that a worker remembers before it starts again, and characters of the longest piece that it remembers.
MEMO_ENTRIES, MEMO_CHARS = 1_000_000, 64
#: Pieces of at most so many characters come again most often: a worker that starts again keeps them, unless they fill half of its memory.
RECURRING_CHARS = 7


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models write for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_ID = operator.attrgetter("id")
_LETTERS = _byte_letters()
_LETTER_TABLE, _SPACE = "".join(_LETTERS[b] for b in range(256)), _LETTERS[32]


def _as_letters(word: str) -> str:
    """The characters that byte-level models write for the bytes of `word`."""
    return codecs.charmap_decode(word.encode(), "strict", _LETTER_TABLE)[0]


def _plain_word(word: str) -> bool:
    """Only letters of the Latin blocks, which every version of Unicode takes for letters and NFC leaves as they are."""
    return word.isalpha() and (_latin_1(word) or (max(word) < "\u0250" and "\u0130" not in word))


def _latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _open_ended(piece: str) -> bool:
    """Whether the piece may not be cut off behind its last character."""
    return piece == "" or piece[-1].isspace() or unicodedata.category(piece[-1])[0] in "ZC"


class _Memo(dict):
    """Ids of pieces; what is missing is asked for when it is first needed."""

    def __init__(self, ask: Callable):
        super().__init__()
        self.ask = ask

    def __missing__(self, piece):
        return self.ask(piece)


class PieceEncoder:
    """`spaced`: the tokenizer keeps the space before a word (byte-level), else it drops white space."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
        from tokenizers import Tokenizer

        self.entries = MEMO_ENTRIES
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.model = self.tokenizer.model
        self.signs = _Memo(self._sign)
        self.mark_ids = self._one(" " + MARK)
        # the id that holds the mark's first byte (EE): no text without private-use characters has it
        self.mark_at = next(k for k, i in enumerate(self.mark_ids) if "î" in (self.tokenizer.id_to_token(i) or ""))
        self.words: dict = {}  # plain words without a space before them, where the tokenizer keeps that
        self.memo = _Memo(self._learn if spaced else self._learn_alone)
        self.waiting: list = []

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._one(text), dtype="<u4").tobytes()

    def _sign(self, signs: str) -> bytes:
        ids = self.signs[signs] = self._bytes(signs)
        return ids

    def _learn_alone(self, piece: str) -> bytes:
        """As _learn, where spaces are dropped: most pieces that are new to a worker are plain words, perhaps before a comma or full stop, so these take
        the shortest way. The lower-case word is also a piece, so it is remembered as one and not a second time."""
        word, after = piece, None
        if piece[-1:] in (",", "."):
            word, after = piece[:-1], self.signs[piece[-1]]
        word = word.lower()
        if len(piece) > MEMO_CHARS or not (word.isalpha() if word.isascii() else _plain_word(word)):
            self.waiting.append(piece)
            return b""
        ids = self.memo.get(word)
        if ids is None:
            tokens = self.model.tokenize(word if word.isascii() else _as_letters(word))
            ids = self.memo[word] = array("I", map(_ID, tokens)).tobytes()
        if after is not None:
            ids += after
        self.memo[piece] = ids
        return ids

    def _pieces(self, text: str) -> list:
        if _latin_1(text):
            text = text.lower()  # these characters are lower-cased one for one, as the tokenizer does, so words with and without capitals are one piece
        return text.replace("\n", " ").split(" ")

    def _learn(self, piece) -> bytes:
        """Ids of a plain word, perhaps after a line break and before signs of ASCII, which the tokenizer cuts off as one; other pieces wait until they are
        encoded together and stand for nothing until then. A word is remembered as the piece that it is without signs."""
        if isinstance(piece, str) and len(piece) <= MEMO_CHARS:
            word, known, space, before = piece.rstrip(string.punctuation), self.memo, _SPACE, b""
            after = piece[len(word) :]
            if word[:1] == "\n":
                word, known, space, before = word[1:], self.words, "", self.signs["\n"]
            if word.isalpha() if word.isascii() else _plain_word(word):
                ids = known.get(word)
                if ids is None:
                    tokens = self.model.tokenize(space + (word if word.isascii() else _as_letters(word)))
                    ids = known[word] = array("I", map(_ID, tokens)).tobytes()
                if before or after:
                    ids = self.memo[piece] = before + ids + (self.signs[after] if after else b"")
                return ids
        self.waiting.append(piece)
        return b""

    def _learn_waiting(self) -> list:
        """Encodes the pieces that wait; None for those that may not be cut off behind their last character. Returns those not to be remembered."""
        pieces, plain, alone = set(self.waiting), [], []
        self.waiting.clear()
        for p in pieces:
            if isinstance(p, tuple):
                if self.spaced and p[0] and _open_ended(p[0]):
                    self.memo[p] = None
                else:
                    alone.append((p, p[0]))
            elif not self.spaced and p == "":
                self.memo[p] = b""
            elif self.spaced and _open_ended(p):
                self.memo[p] = None
            else:
                chunk = p if self.spaced and p[0] == "\n" else " " + p
                (alone if _PRIVATE.search(p) else plain).append((p, chunk))
        for p, chunk in alone:
            self.memo[p] = self._bytes(chunk)
        groups = [plain[k : k + 2000] for k in range(0, len(plain), 2000)]
        tail, width = " " + MARK, 4 * len(self.mark_ids)
        encoded = self.tokenizer.encode_batch_fast([tail.join(c for _, c in g) + tail for g in groups], add_special_tokens=False)
        for group, one in zip(groups, encoded, strict=True):
            ids = np.array(one.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_ids[self.mark_at]) - self.mark_at
            raw, at = ids.tobytes(), 0
            assert len(ends) == len(group), "pieces encoded together came apart"
            for (p, _), end in zip(group, (4 * ends).tolist(), strict=True):
                self.memo[p] = raw[at:end]
                at = end + width
        return [p for p in pieces if len(p[0] if isinstance(p, tuple) else p) > MEMO_CHARS]

    def _carefully(self, text: str) -> bytes:
        """For runs of white space: cut before each run; encode whole if even that can't be shown to be safe."""
        runs = _RUNS.findall(text)
        if any(_open_ended(r) for r in runs[:-1]) or _PRIVATE.search(text):
            return self._bytes(text)
        known = {r: None for r in runs}
        for r, one in zip(known, self.tokenizer.encode_batch_fast(list(known), add_special_tokens=False), strict=True):
            known[r] = np.array(one.ids, dtype="<u4").tobytes()
        return b"".join(map(known.__getitem__, runs))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        if len(self.memo) + len(self.words) + len(self.signs) > self.entries:
            for memo in (self.memo, self.words, self.signs):
                kept = {p: ids for p, ids in memo.items() if isinstance(p, str) and len(p) <= RECURRING_CHARS}
                memo.clear()
                if len(kept) <= self.entries // 2:
                    memo.update(kept)
        if self.spaced:
            return self._gathered(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        if isinstance(texts, pa.Array):
            texts = texts.to_pylist()
        out, again = [], []
        for k, text in enumerate(texts):
            out.append(self._joined(text or ""))
            if self.waiting and (not again or len(self.waiting) > again[-1][1]):
                again.append((k, len(self.waiting)))
        if again:
            passing = self._learn_waiting()
            for k, _ in again:
                out[k] = self._joined(texts[k] or "")
            for p in passing:
                del self.memo[p]
        return out

    def _gathered(self, texts: pa.Array) -> list[bytes]:
        """Where spaces are kept: Arrow cuts the texts and finds their distinct pieces, each is looked up once, and their ids are taken by position."""
        pieces = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n"), " ")
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(), dtype=np.int64)
        heads = np.concatenate([[0], ends])[:-1]
        coded = pieces.flatten().dictionary_encode()
        known, at = len(coded.dictionary), coded.indices.to_numpy().copy()
        at[heads] += known  # the first piece of a text has no space before it: another key
        used = np.flatnonzero(np.bincount(at, minlength=2 * known))
        spaced = int(np.searchsorted(used, known))
        keys: list = coded.dictionary.take(pa.array(used % max(known, 1))).to_numpy(zero_copy_only=False).tolist()
        del pieces, coded  # these hold a slice's whole text; ids come next
        keys[spaced:] = [(p,) for p in keys[spaced:]]  # a tuple: without a space before it
        found = list(map(self.memo.__getitem__, keys))
        if self.waiting:
            passing = self._learn_waiting()
            for k in [k for k, ids in enumerate(found) if not ids]:
                found[k] = self.memo[keys[k]]
            for p in passing:
                del self.memo[p]
        open_ended = [k for k, ids in enumerate(found) if ids is None]
        for k in open_ended:
            found[k] = b""
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        rank = np.zeros(2 * known, dtype=np.int32)
        rank[used] = np.arange(len(used))
        at = rank[at]
        stops = np.concatenate([[0], np.cumsum(np.diff(bounds)[at])])
        heads, stops = 4 * stops[heads], 4 * stops[ends]
        lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(found), dtype="<u4")))
        del found, keys
        raw = memoryview(np.ascontiguousarray(lists.take(pa.array(at)).flatten().to_numpy())).cast("B")
        out = [raw[a:b].tobytes() for a, b in zip(heads.tolist(), stops.tolist(), strict=True)]
        if open_ended:
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(np.isin(at, open_ended)), "right")).tolist():
                out[k] = self._carefully(texts[k].as_py() or "")
        return out

    def _joined(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self._pieces(text)))


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}
workers.keeps("tokens", _ENCODERS.clear)


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One for each worker and tokenizer, kept between tasks."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = PieceEncoder(path, spaced)
    return _ENCODERS[path, spaced]


def public_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text that a worker splits at a time: in Python, and in Arrow where spaces are kept.
SLICE_CHARS, SPACED_SLICE_CHARS = 2_000_000, 4_000_000


def encoded_slices(batches: Iterator[pa.RecordBatch], name: str, spaced: bool, text: str = "text", entries: int = MEMO_ENTRIES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of bounded size, each with the ids of its texts. `name`: file name of a public tokenizer, or a path; `entries`: pieces that
    a worker remembers, about 200 bytes each."""
    workers.works_for("tokens")
    enc = encoder(name if "/" in name else public_path(name), spaced)
    enc.entries = entries
    for batch in batches:
        column = batch.column(text).cast(pa.large_string())
        sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0)
        at = 0
        while at < len(column):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SPACED_SLICE_CHARS if spaced else SLICE_CHARS)))
            part = batch.slice(at, end - at)
            yield part, enc.encode(column.slice(at, end - at))
            at = end

