"""SentencePiece BPE by a table of last tokens.

A merge-type tokenizer has a property that replaces its queue of merges: a row
of tokens is the encoding of its text if and only if every two neighbours are
the encoding of theirs. For each prefix of a text there is therefore exactly one
token that ends it and fits the token that ends the prefix before. The table
holds this last token for each prefix. An automaton over all pieces names the
tokens that end at a place, and a test of the pair tells which one fits; at the
end the ids are read off backwards. The work is linear in the text, whatever its
merges.

A pair fits if merging its characters gives the pair back, that is, if no merge
ever reaches across its middle. The test walks back in time from the two tokens
to their characters: whichever of the two neighbours was merged last gives way
to its part at the middle, and no pair met on the way may merge before that.
Where the scores inside a token don't fall from merge to merge, the pair is
merged by definition. Verdicts are remembered.

Texts are cut beforehand where no token can lie across: at a space mark that
follows another character, if no piece of the vocabulary holds one inside, and
at line breaks, if no piece holds any. Characters of no piece are written as the
byte pieces of their UTF-8 form.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import sentencepiece

# The mark that stands for a space, and what decoding writes for the unknown piece.
SPACE_MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "


class PieceTokenizer:
    """Ids of whole texts, and texts of ids."""

    #: Chunks and pairs remembered in each of two generations. Longer chunks aren't kept.
    CHUNKS, PAIRS, LONGEST = 150_000, 250_000, 48

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        kinds = [(model.is_byte(i), model.is_control(i), model.is_unknown(i)) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        self.size = size
        self.id_of = {names[i]: i for i in range(size) if not any(kinds[i])}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not kinds[i][0] for i in self.byte_id) or any(model.is_unused(i) for i in range(size)):
            raise ValueError("the model lacks byte pieces or holds unused ones")
        self.letters = {c for p in self.id_of for c in p}
        if not self.letters <= self.id_of.keys():
            raise ValueError("every character of a piece must be a piece")
        self.known, self.known_before = {}, {}
        self.fits, self.fits_before = {}, {}
        self.names = names
        self.width = [len(n) for n in names]
        #: Of each piece that its own characters merge into: the two parts of its last merge.
        self.parts: dict[str, tuple[str, str]] = {}
        #: Pieces whose scores fall from merge to merge.
        self.falling = set(self.letters)
        self.automaton = ahocorasick.Automaton()
        for piece, i in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            if len(piece) > 1:
                halves = self._merge(list(piece), 2)
                if "".join(halves) != piece or len(halves) != 2:
                    continue
                self.parts[piece] = left, right = halves[0], halves[1]
                if {left, right} <= self.falling and self.score[piece] < min(self._time(left), self._time(right)):
                    self.falling.add(piece)
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        inner = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id_of)
        lines = "" if "\n" in self.letters else "\n"
        parts = rf"(?s:.+)" if inner else rf"{SPACE_MARK}+[^{SPACE_MARK}{lines}]*" + (rf"|\n[^{SPACE_MARK}\n]*" if lines else "")
        self.cut = re.compile(parts).findall
        # Decoding: the bytes of each piece, one after the other.
        plain = [bytes([self.byte_id.index(i)]) if kinds[i][0] else self._surface(names[i], kinds[i]) for i in range(size)]
        self.bytes_of = np.frombuffer(b"".join(plain), np.uint8)
        self.length = np.array([len(p) for p in plain], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.silent = np.array([k[1] for k in kinds])
        self.marked = np.array([n.startswith(SPACE_MARK) and not any(k) for n, k in zip(names, kinds)])

    @staticmethod
    def _surface(name: str, kind: tuple[bool, bool, bool]) -> bytes:
        if kind[1]:
            return b""
        return (UNKNOWN_SURFACE if kind[2] else name.replace(SPACE_MARK, " ")).encode()

    def _merge(self, symbols: list[str], least: int = 1) -> list[str]:
        """Merging by definition: the pair of the best score first, the leftmost among equals."""
        score = self.score
        while len(symbols) > least:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        return symbols

    def _time(self, piece: str) -> float:
        """When a piece is merged, falling with time; characters are there from the start."""
        return math.inf if len(piece) == 1 else self.score[piece]

    def fit(self, before: str, token: str) -> bool:
        """Whether the two are the encoding of their text."""
        if before not in self.falling or token not in self.falling:
            return self._merge(list(before + token)) == [before, token]
        score, parts = self.score.get, self.parts
        left, right, until = before, token, -math.inf
        # Until the score named, the two stand side by side; the leftmost of equals is merged first.
        tie = False
        while True:
            across = score(left + right)
            if across is not None and (across > until or tie and across == until):
                return False
            a, b = self._time(left), self._time(right)
            if a == b == math.inf:
                return True
            if a < b:
                left, until, tie = parts[left][1], a, False
            else:
                right, until, tie = parts[right][0], b, True

    def _learn(self, before: int, token: int) -> bool:
        pair = before * self.size + token
        fit = self.fits_before.get(pair)
        if fit is None:
            fit = self.fit(self.names[before], self.names[token])
        if len(self.fits) >= self.PAIRS:
            self.fits, self.fits_before = {}, self.fits
        self.fits[pair] = fit
        return fit

    def last_tokens(self, chunk: str) -> list[int]:
        """The last token of each prefix; -1 stands for a character of no piece."""
        last = [-1] * len(chunk)
        width, size = self.width, self.size
        for end, token in self.automaton.iter(chunk):
            if last[end] >= 0:
                continue
            at = end - width[token]
            # Neither the start nor a character of no piece merges with what follows.
            before = last[at] if at >= 0 else -1
            if before < 0:
                last[end] = token
                continue
            fit = self.fits.get(before * size + token)
            if fit or fit is None and self._learn(before, token):
                last[end] = token
        return last

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a marked text as 16-bit numbers, read backwards from the table."""
        last, end, out, width = self.last_tokens(chunk), len(chunk), [], self.width
        while end:
            token = last[end - 1]
            if token >= 0:
                out.append(token)
                end -= width[token]
            else:
                end -= 1
                out.extend(self.byte_id[b] for b in reversed(chunk[end].encode()))
        return array("H", out[::-1]).tobytes()

    def _remember(self, chunk: str) -> bytes:
        ids = self.known_before.get(chunk) or self.encode_chunk(chunk)
        if len(chunk) <= self.LONGEST:
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without begin or end."""
        if not text:
            return np.empty(0, np.uint16)
        if len(self.known) >= self.CHUNKS:
            self.known, self.known_before = {}, self.known
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        known, learn = self.known.get, self._remember
        return np.frombuffer(b"".join([known(c) or learn(c) for c in self.cut(marked)]), np.uint16)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of ids; bytes that are no UTF-8 become replacement characters one by one."""
        ids = np.asarray(ids, np.int64)
        quiet = self.silent[ids]
        if quiet.any():  # bytes on both sides of a control piece are not read together
            runs = np.split(ids, np.flatnonzero(quiet))
            runs = [r for r in (r[self.silent[r[:1]].sum() :] for r in runs) if len(r)]
        else:
            runs = [ids] if len(ids) else []
        # The space that encoding put in front is taken from the first piece that speaks.
        return "".join(_text(self._bytes(r)[int(k == 0 and self.marked[r[0]]) :].tobytes()) for k, r in enumerate(runs))

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes_of[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1])]


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        out = [data[: e.start].decode()]
        while data := data[e.start :]:
            out.append("�")
            data = data[1:]
            try:
                out.append(data.decode())
                break
            except UnicodeDecodeError as later:
                e = later
                out.append(data[: e.start].decode())
        return "".join(out)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each Python worker; what it remembers is bounded."""
    return PieceTokenizer(path)
