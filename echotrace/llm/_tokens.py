"""Whole-text encoding with the tokenizers library, each distinct word once.

A text is cut at places that the tokenizer's own splitting never crosses, each distinct piece is encoded by the library,
and ids are gathered from there; the ids are those of encoding the text at once. Byte-level vocabularies keep the space before
a word, so there only a single space or line break between two characters that aren't white space is a cut; the line break is a
piece of its own. Vocabularies that drop white
space can be cut at any space or line break.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa

from echotrace.llm._common import process_cache
from echotrace.llm._prefix import BASE, OTHER_BASE, inverse_power, mixed, prefix_at

#: Pieces that a worker remembers, and their characters. Beyond them it keeps those that it has met most often.
PIECES, CHARACTERS = 600_000, 9_000_000
_DOUBLED = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
#: A character that is a piece of its own wherever it stands between spaces, and has one id.
_MARK = "\x01"
#: Pieces that are joined to one text for the library.
_JOINED = 200
#: Bytes of a piece that is told from others by its hashes.
LONGEST = 256
#: How the two kinds of vocabulary split a text. Both leave a run of Latin letters (up to U+017F, but for one whose
#: lower case is two characters) and a run of ASCII signs behind it whole, so the vocabulary's model can be asked at once.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_DIRECT = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


class WordEncoder:
    def __init__(self, path: str, keeps_space: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (special_as_text and t.special)]
        self.added = [t.content for t in added if not t.normalized]
        # Those that are looked for in the normalised text, in any case of letters; a text too many only costs time.
        normalized = [re.escape(t.content) for t in added if t.normalized]
        self.normalized = re.compile("|".join(normalized), re.IGNORECASE) if normalized else None
        self.keeps_space = keeps_space
        self.width = self.tokenizer.get_vocab_size()
        # Ids with which a piece begins (the space is part of it), or the id of the mark between two pieces.
        if keeps_space:
            self.opens = np.zeros(self.width, dtype=bool)
            self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        else:
            (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.model = self.tokenizer.model if self._splits_as_known() else None
        self.letters, self.signs, self.line = _byte_letters(), {"": []}, None
        self.whole: set[str] = set()  # texts that hold an added token
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.used, self.characters = np.zeros(1 << 16, dtype=np.uint32), 0, 0
        self.start, self.length, self.seen = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def _holds_added(self, text: str) -> bool:
        return any(x in text for x in self.added) or (self.normalized is not None and self.normalized.search(text) is not None)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text. Where spaces are kept, most begin with one, which is left out; others begin with a line break instead, and a line break itself is a space."""
        if self._holds_added(text):
            self.whole.add(text)
            return ["\n" + text] if self.keeps_space else [text]
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        out = []
        for line in _LINE.split(text) if "\n" in text else [text]:
            parts = _CUT.split(line) if _DOUBLED.search(line) else line.split(" ")
            parts[0] = "\n" + parts[0]
            if out:
                out.append(" ")
            out += parts
        return out

    def _as_written(self, piece: str) -> str:
        if not self.keeps_space:
            return piece
        return "\n" if piece == " " else piece[1:] if piece[:1] == "\n" else " " + piece

    def _splits_as_known(self) -> bool:
        """Whether a run of ASCII letters is one unit for the model, and a run of signs behind it another."""
        made = json.loads(self.tokenizer.to_str())
        normalizer, splitter = made["normalizer"], made["pre_tokenizer"] or {}
        if self.keeps_space:
            return normalizer is None and splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]
        if (normalizer or {}).get("type") != "Sequence" or splitter.get("type") != "Sequence":
            return False
        kinds, parts = [n["type"] for n in normalizer["normalizers"]], splitter["pretokenizers"]
        by_words = [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _WORD_SPLIT} and not parts[1]["use_regex"]
        return kinds == ["NFC", "Replace", "Lowercase"] and by_words and not parts[1]["add_prefix_space"]

    def _by_model(self, pieces: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (letters, signs), all with the space before them or all without, from the model of the vocabulary."""
        tokenize, signs, letters, ids, ends = self.model.tokenize, self.signs, self.letters, [], []
        space = "\u0120" if self.keeps_space else ""
        for word, marks in pieces:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            ids += [t.id for t in tokenize(space + word)]
            if marks:
                if marks not in signs:
                    if len(signs) > 10_000:
                        signs.clear()
                    signs[marks] = [t.id for t in tokenize(marks)]
                ids += signs[marks]
            ends.append(len(ids))
        return np.array(ids, dtype=np.uint32), np.diff(np.array(ends, dtype=np.int64), prepend=0)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pieces that may stand one after another in one text."""
        parts = [pieces[i : i + _JOINED] for i in range(0, len(pieces), _JOINED)]
        texts = ["".join(p) if self.keeps_space else f" {_MARK} ".join([*p, ""]) for p in parts]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        if self.keeps_space:
            return ids, np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
        marks = ids == self.mark
        return ids[~marks], np.diff(np.flatnonzero(marks) - np.arange(int(marks.sum())), prepend=0)

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _may_join(self, piece: str) -> bool:
        if piece in self.whole:
            return False
        if not self.keeps_space:
            return _MARK not in piece
        word = piece[1:]
        return piece[:1] == " " and word != "" and " " not in word and not word[0].isspace() and not word[-1].isspace()

    def _learn(self) -> None:
        known, new = len(self.start), []
        for piece in reversed(self.index):  # the newest come first
            if self.index[piece] < known:
                break
            new.append(piece)
        if not new:
            return
        new.reverse()
        lengths, starts = np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64)
        kinds: dict = {self._by_model: ([], []), self._joined: ([], []), self._alone: ([], [])}
        at, what = kinds[self._by_model]
        for k, (piece, found) in enumerate(zip(new, map(_DIRECT.fullmatch, new), strict=True)):
            if found and self.model is not None:
                word, marks = found.groups()
                at.append(k)
                what.append((word if self.keeps_space else word.lower(), marks))
            else:
                piece = self._as_written(piece)
                how = kinds[self._joined if self._may_join(piece) else self._alone]
                how[0].append(k)
                how[1].append(piece)
        for how, (places, what) in kinds.items():
            for i in range(0, len(places), 20_000):
                at = np.array(places[i : i + 20_000])
                flat, n = how(what[i : i + 20_000])
                if len(n) != len(at):  # not reached by the rules above; the library's answer for each piece is always right
                    flat, n = self._alone(what[i : i + 20_000])
                while self.used + len(flat) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[self.used : self.used + len(flat)] = flat
                lengths[at], starts[at] = n, self.used + np.cumsum(n) - n
                self.used += len(flat)
        self.whole.clear()
        self.start, self.length = np.concatenate([self.start, starts]), np.concatenate([self.length, lengths])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), dtype=np.int64)])
        self.characters += sum(map(len, new))

    def ids_of(self, words: list[str], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and their numbers, not remembered; kinds as in TextEncoder."""
        if self.line is None:
            self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        parts: list = [None] * len(words)
        direct = map(_DIRECT.fullmatch, words) if self.model is not None else [None] * len(words)
        others: dict = {self._joined: ([], []), self._alone: ([], [])}
        tokenize, signs, letters, space = self.model and self.model.tokenize, self.signs, self.letters, "\u0120"
        for k, (word, kind, found) in enumerate(zip(words, kinds, direct, strict=True)):
            if found:
                name, marks = found.groups()
                if not self.keeps_space:
                    name = name.lower()
                if not name.isascii():
                    name = name.encode().decode("latin-1").translate(letters)
                ids = [t.id for t in tokenize(name if kind else space + name)]
                if marks:
                    if marks not in signs:
                        if len(signs) > 10_000:
                            signs.clear()
                        signs[marks] = [t.id for t in tokenize(marks)]
                    ids += signs[marks]
                parts[k] = self.line + ids if kind == 2 else ids
            else:
                piece = (" ", "", "\n")[kind] + word
                how = others[self._joined if self._may_join(piece) else self._alone]
                how[0].append(k)
                how[1].append(piece)
        for how, (places, pieces) in others.items():
            if places:
                flat, n = how(pieces)
                if len(n) != len(pieces):  # not reached by the rules above; the library's answer for each piece is always right
                    flat, n = self._alone(pieces)
                for k, x in zip(places, np.split(flat, np.cumsum(n)[:-1]), strict=True):
                    parts[k] = x.tolist()
        return np.fromiter(chain.from_iterable(parts), dtype=np.uint32), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))

    def _forget(self) -> None:
        """Keeps the pieces met most often, up to half of the limits."""
        order, words, size = np.argsort(-self.seen, kind="stable"), list(self.index), 0
        keep = []
        for i in order[: PIECES // 2].tolist():
            size += len(words[i])
            if self.seen[i] < 2 or size > CHARACTERS // 2:
                break
            keep.append(i)
        at, kept = np.array(keep, dtype=np.int64), len(keep)
        n = self.length[at]
        edges = np.cumsum(n) - n
        ids = self.ids[np.repeat(self.start[at] - edges, n) + np.arange(int(n.sum()))]
        self.index = defaultdict(count(kept).__next__, {words[i]: k for k, i in enumerate(keep)})
        self.ids, self.used = np.concatenate([ids, np.zeros(1 << 16, dtype=np.uint32)]), len(ids)
        self.start, self.length, self.seen = edges, n, self.seen[at] // 2
        self.characters = sum(len(words[i]) for i in keep)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and their numbers."""
        words, lens = [], []
        for text in texts:
            words += (pieces := self.pieces(text))
            lens.append(len(pieces))
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        self._learn()
        self.seen += np.bincount(at, minlength=len(self.seen))
        n = self.length[at]
        edges = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(self.start[at] - edges[:-1], n) + np.arange(edges[-1])]
        ends = edges[np.cumsum(lens, dtype=np.int64)]
        ids = np.insert(ids, ends, np.uint32(end))
        if len(self.index) > PIECES or self.characters > CHARACTERS:
            self._forget()
        return ids, np.diff(ends, prepend=0) + 1


class TextEncoder:
    """Whole texts of an Arrow array to ids. A piece is of kind 0 (a space before it belongs to it), 1 (none does) or 2 (a line break does)."""

    def __init__(self, words: WordEncoder):
        self.words, self.width = words, words.width
        self.index: dict[int, int] = {}
        self.ids, self.seen, self.check = _Arena(np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        odd = words.added or []
        self.heads = {(x.encode()[0], x.encode()[1] if len(x.encode()) > 1 else None) for x in odd}

    def _odd(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may hold other white space or an added token."""
        odd = ((raw >= 9) & (raw <= 13) & (raw != 10)) | ((raw >= 28) & (raw <= 31))
        places = [np.flatnonzero(odd)]
        high = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
        if len(high):
            one, two, three = raw[high], raw[np.minimum(high + 1, len(raw) - 1)], raw[np.minimum(high + 2, len(raw) - 1)]
            white = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
            white |= (one == 0xE1) & (two == 0x9A) & (three == 0x80)
            white |= (one == 0xE2) & (((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))) | ((two == 0x81) & (three == 0x9F)))
            white |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
            places.append(high[white])
        for first, second in self.heads:
            at = np.flatnonzero(raw == first)
            places.append(at if second is None else at[raw[np.minimum(at + 1, len(raw) - 1)] == second])
        out = np.full(len(offsets) - 1, self.words.normalized is not None)
        out[np.searchsorted(offsets, np.concatenate(places), "right") - 1] = True
        return out

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end and kind of each piece, and the number of pieces of each text."""
        white = (raw == 32) | (raw == 10)
        cut = white.copy()
        if self.words.keeps_space and len(raw):
            cut[1:] &= ~white[:-1]
            cut[:-1] &= ~white[1:]
            some = offsets[1:] > offsets[:-1]
            cut[offsets[:-1][some]] = False
            cut[offsets[1:][some] - 1] = False
        cuts = np.flatnonzero(cut)
        upto = np.searchsorted(cuts, offsets)
        start = np.insert(cuts + 1, upto[:-1], offsets[:-1])
        end = np.insert(cuts, upto[1:], offsets[1:])
        kind = np.ones(len(start), dtype=np.int64)
        if self.words.keeps_space:
            kind = np.insert(np.where(raw[cuts] == 32, 0, 2), upto[:-1], 1)
        return start, end, kind, np.diff(upto) + 1

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and their numbers."""
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        odd = self._odd(raw, offsets) if len(texts) else np.zeros(0, dtype=bool)
        found = None if odd.any() else self._plain(raw, offsets, end)
        if found is not None:
            return found
        size = np.diff(offsets)
        plain = self._plain(raw[np.repeat(~odd, size)], np.append(0, np.cumsum(size[~odd])), end) if odd.any() and not odd.all() else None
        if plain is None:
            odd[:] = True
        slow, n_slow = self.words.encode([texts[i].as_py() for i in np.flatnonzero(odd).tolist()], end)
        if plain is None:
            return slow, n_slow
        counts = np.zeros(len(odd), dtype=np.int64)
        counts[odd], counts[~odd] = n_slow, plain[1]
        where, out = np.repeat(odd, counts), np.empty(int(counts.sum()), dtype=np.uint32)
        out[where], out[~where] = slow, plain[0]
        return out, counts

    def _plain(self, raw: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray] | None:
        """None if two pieces share one hash but not the other, or one is too long."""
        start, stop, kind, n_pieces = self._pieces(raw, offsets)
        if (stop - start).max(initial=0) > LONGEST:
            return None
        both, about = np.stack([start, stop], axis=1).ravel(), mixed(((stop - start) * 4 + kind + 1).astype(np.uint64))
        hashes = []
        for base in (BASE, OTHER_BASE):
            prefix = prefix_at(raw, both, base).reshape(-1, 2)
            hashes.append(mixed((prefix[:, 1] - prefix[:, 0]) * inverse_power(start, base)) ^ about)
        distinct, first, of = np.unique(hashes[0], return_index=True, return_inverse=True)
        check = hashes[1][first]
        if (check[of] != hashes[1]).any():
            return None
        slot = self._slots(distinct, check, raw, start[first], stop[first], kind[first])
        if slot is None:
            return None
        self.seen += np.bincount(slot, np.bincount(of, minlength=len(slot)), len(self.seen)).astype(np.int64)
        ids, n = self.ids.take(slot[of])
        ends = np.append(0, np.cumsum(n))[np.cumsum(n_pieces)]
        ids = np.insert(ids, ends, np.uint32(end))
        if len(self.index) > PIECES:
            self._forget()
        return ids, np.diff(ends, prepend=0) + 1

    def _slots(self, distinct: np.ndarray, check: np.ndarray, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: np.ndarray) -> np.ndarray | None:
        """The place of each piece; those that aren't there are learnt. None if one has a known piece's first hash but not its second."""
        hashes, known = distinct.tolist(), len(self.seen)
        slot = np.fromiter(map(self.index.get, hashes, repeat(-1)), dtype=np.int64, count=len(hashes))
        old = slot >= 0
        if (self.check[slot[old]] != check[old]).any():
            return None
        new = np.flatnonzero(~old)
        if len(new):
            words = [raw[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)]
            self.ids.append(*self.words.ids_of(words, kind[new].tolist()))
            slot[new] = known + np.arange(len(new))
            self.index.update(zip((hashes[k] for k in new.tolist()), slot[new].tolist(), strict=True))
            self.seen = np.append(self.seen, np.zeros(len(new), dtype=np.int64))
            self.check = np.append(self.check, check[new])
        return slot

    def _forget(self) -> None:
        """Keeps the pieces met most often, up to half of the limit."""
        hashes = np.fromiter(self.index, dtype=np.uint64, count=len(self.index))
        place = np.fromiter(self.index.values(), dtype=np.int64, count=len(self.index))
        order = np.argsort(-self.seen[place], kind="stable")[: PIECES // 2]
        order = order[self.seen[place[order]] > 1]
        kept = place[order]
        self.index = dict(zip(hashes[order].tolist(), range(len(order)), strict=True))
        self.ids, self.check, self.seen = self.ids.only(kept), self.check[kept], self.seen[kept] // 2


class _Arena:
    """Arrays of different lengths, one after another."""

    def __init__(self, kind):
        self.flat, self.used = np.zeros(1 << 16, dtype=kind), 0
        self.start, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start = np.append(self.start, self.used + np.cumsum(lengths) - lengths)
        self.length = np.append(self.length, lengths)
        self.used += len(flat)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays with these numbers, one after another, and their lengths."""
        n = self.length[at]
        begin = np.append(0, np.cumsum(n))
        return self.flat[np.repeat(self.start[at] - begin[:-1], n) + np.arange(int(begin[-1]))], n

    def only(self, at: np.ndarray) -> _Arena:
        out = _Arena(self.flat.dtype)
        out.append(*self.take(at))
        return out


def encoder(path: str, keeps_space: bool, special_as_text: bool = False) -> TextEncoder:
    """The worker's encoder for a tokenizer file."""
    cache = process_cache("encoders")
    key = (path, special_as_text)
    if key not in cache:
        cache[key] = TextEncoder(WordEncoder(path, keeps_space, special_as_text))
    return cache[key]


def slices(texts: pa.Array, size: int = 1 << 21):
    """Ranges (from, to) of texts with about so many bytes."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    ends, at = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, min(upto, len(texts))
        at = min(upto, len(texts))


def groups(texts: list, characters: int = 1 << 20):
    """Ranges (from, to) of texts with about so many characters."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= characters:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
