"""A BPE tokenizer of word ends compiled to finite-state transducers.

Two deterministic transducers stand in a cascade.

The **scanner** splits a text into pretokens. It reads classes of code points
and has seven states; its transitions mark where a pretoken begins. Every code
point is a mapping of the states, and all mappings that chunks of text can make
form a small monoid, worked out in advance. A text is cut into chunks; the
mapping of each chunk is composed code point by code point, the mappings of the
chunks are composed by a parallel prefix scan, and the state in which a chunk is
entered follows. All chunks of all texts of a batch advance together.

The **merger** reads the bytes of a pretoken. Its states hold what later merges
can still depend on: the longest tail that begins a longer token, and for each
place in it at which a token may begin, the token before that place and the
number of tokens up to there. A transition carries the change of the number of
tokens, which may be negative, as a merge undoes earlier boundaries; a second
table carries the number if the pretoken ends. States are compiled when first
reached and shared by all words that reach them. The words of a batch that were
not seen before advance together, letter by letter.

That states suffice follows from a property of BPE: a row of tokens is the
encoding of its text if and only if every two neighbours are the encoding of
theirs. So the last token of a prefix is the only one that fits its
predecessor, whatever comes before.

Counts go through both transducers. Where ids are asked for, short words take their
merges by the definition, all words of a batch together: to compile a transition
that one rare word needs costs more than that word's merges, and so does looking
for a word among those remembered.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

# The classes of code points that the pretoken pattern tells apart.
SPACE, LETTER, NUMBER, OTHER, APOSTROPHE, SUFFIX_ONE, SUFFIX_R, SUFFIX_V, SUFFIX_L, SUFFIX_D_OR_E = range(10)
# Code points that are white space in Unicode.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Scanner states.
_START, _LETTERS, _OTHERS, _QUOTE, _QUOTE_R, _QUOTE_V, _QUOTE_L = range(7)
# Marks: nothing, a pretoken begins here, one begins here and one at the code point before.
_NONE, _HERE, _BOTH = range(3)
_STEP = 256
# Parts of a transition in one number: bits of the change of the count and of the token id, and what is added to the change.
_WIDE, _ID, _CHANGE = 10, 16, 512
_MASK, _LAST = (1 << _WIDE) - 1, (1 << _ID) - 1
# Marks the number of a transition at a pretoken's end among the others.
_END = 1 << 62


def _plain(cls: int) -> tuple[int, int]:
    """From a state in which nothing is open."""
    if cls == SPACE:
        return _START, _HERE
    if cls == NUMBER:
        return _START, _HERE
    if cls == OTHER:
        return _OTHERS, _HERE
    if cls == APOSTROPHE:
        return _QUOTE, _HERE
    return _LETTERS, _HERE


def _move(state: int, cls: int) -> tuple[int, int]:
    """Next state and mark. White space is a span of its own, so a mark stands at its start too."""
    letter = cls not in (SPACE, NUMBER, OTHER, APOSTROPHE)
    if state == _LETTERS and letter:
        return _LETTERS, _NONE
    if state == _OTHERS and cls in (OTHER, APOSTROPHE):
        return _OTHERS, _NONE
    if state == _QUOTE:
        if cls in (OTHER, APOSTROPHE):
            return _OTHERS, _NONE
        if cls == SUFFIX_ONE:
            return _START, _NONE
        if cls == SUFFIX_D_OR_E:  # d ends a pretoken at once, e only after r or v
            return _LETTERS, _HERE
        for c, s in ((SUFFIX_R, _QUOTE_R), (SUFFIX_V, _QUOTE_V), (SUFFIX_L, _QUOTE_L)):
            if cls == c:
                return s, _NONE
    if state in (_QUOTE_R, _QUOTE_V) and cls == SUFFIX_D_OR_E:
        return _START, _NONE
    if state == _QUOTE_L and cls == SUFFIX_L:
        return _START, _NONE
    if state in (_QUOTE_R, _QUOTE_V, _QUOTE_L):
        # The apostrophe stood alone; the letter after it began a run.
        if letter:
            return _LETTERS, _BOTH - 3  # only the letter before
        after, _ = _plain(cls)
        return after, _BOTH
    return _plain(cls)


class Scanner:
    """Pretoken spans of normalized text."""

    def __init__(self) -> None:
        letters = "Lu Ll Lt Lm Lo".split()
        numbers = "Nd Nl No".split()
        kind = np.full(0x110000, OTHER, np.uint8)
        for code in range(0x110000):
            c = unicodedata.category(chr(code))
            if c in letters:
                kind[code] = LETTER
            elif c in numbers:
                kind[code] = NUMBER
        kind[WHITE] = SPACE
        kind[ord("'")] = APOSTROPHE
        for chars, cls in (("stmd", SUFFIX_ONE), ("r", SUFFIX_R), ("v", SUFFIX_V), ("l", SUFFIX_L), ("e", SUFFIX_D_OR_E)):
            kind[[ord(c) for c in chars]] = cls
        self.kind = kind
        moves = [[_move(s, c) for c in range(10)] for s in range(7)]
        self.next = np.array([[m[0] for m in row] for row in moves], np.uint8)
        #: By state before and class: a pretoken begins here; one began at the code point before.
        self.here = np.array([[m[1] in (_HERE, _BOTH) for m in row] for row in moves])
        self.back = np.array([[m[1] in (_BOTH, _BOTH - 3) for m in row] for row in moves])
        # The monoid of mappings: closed under composition with the classes.
        identity = tuple(range(7))
        single = [tuple(int(self.next[s, c]) for s in range(7)) for c in range(10)]
        elements, index = [identity], {identity: 0}
        todo = [identity]
        while todo:
            f = todo.pop()
            for g in single:
                h = tuple(g[x] for x in f)
                if h not in index:
                    index[h] = len(elements)
                    elements.append(h)
                    todo.append(h)
        n = len(elements)
        self.apply = np.array(elements, np.uint8)
        self.generator = np.array([index[g] for g in single], np.uint16)
        #: Composition: first the row's mapping, then the column's.
        self.compose = np.array([[index[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint16)
        self.size = n

    def entry_states(self, generators: np.ndarray) -> np.ndarray:
        """State before each code point, starting from nothing open."""
        n = len(generators)
        chunks = -(-n // _STEP)
        padded = np.zeros(chunks * _STEP, np.uint16)
        padded[:n] = generators
        columns = np.ascontiguousarray(padded.reshape(chunks, _STEP).T)
        flat = self.compose.reshape(-1)
        prefix = np.empty((_STEP, chunks), np.uint16)
        acc = np.zeros(chunks, np.uint16)
        for j in range(_STEP):
            prefix[j] = acc
            acc = flat[acc.astype(np.int32) * self.size + columns[j]]
        # Inclusive scan of the chunks' mappings, doubling the reach in each round.
        scan, reach = acc, 1
        while reach < chunks:
            later = flat[scan[:-reach].astype(np.int32) * self.size + scan[reach:]]
            scan = np.concatenate([scan[:reach], later])
            reach *= 2
        entry = np.concatenate([np.zeros(1, np.uint8), self.apply[scan[:-1], _START]])
        return self.apply.reshape(-1)[prefix.astype(np.int32) * 7 + entry].T.reshape(-1)[:n]

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the spans, and whether each is a pretoken (else white space).

        The codes should end in white space, which settles what is open.
        """
        kinds = self.kind[codes]
        before = self.entry_states(self.generator[kinds])
        at = before.astype(np.int32) * 10 + kinds
        begins = self.here.reshape(-1)[at]
        begins[:-1] |= self.back.reshape(-1)[at[1:]]
        starts = np.flatnonzero(begins)
        return starts, kinds[starts] != SPACE


class Moves:
    """Numbers by numbers, many looked up at once: places by a product, linear probes, at most half full."""

    def __init__(self, bits: int = 12) -> None:
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        self.bits, self.size = bits, 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & len(self.keys) - 1
            held = self.keys[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not held yet."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            larger = Moves((2 * (self.size + len(keys))).bit_length())
            used = self.keys >= 0
            larger.put(self.keys[used], self.values[used])
            self.keys, self.values, self.bits = larger.keys, larger.values, larger.bits
        self.size += len(keys)
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            # Of several keys that want a free place the one written last has it.
            self.keys[at[free]] = keys[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = at[todo] + 1 & len(self.keys) - 1
        self.values[at] = values


class Merger:
    """The transducer of merges within a pretoken; compiled as it is used."""

    #: Words that advance together.
    TOGETHER = 4096
    #: Compiled transitions are thrown away and built anew beyond this number. With the words
    #: and verdicts remembered they bound what a worker holds.
    MOST = 400_000
    #: Verdicts on pairs of tokens, which outlive the transitions made from them, up to this number.
    PAIRS = 200_000

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        #: Letters of a token, by id; the mark of a word's end is none.
        self.width = [0] * (max(self.vocab.values()) + 1)
        for t, i in self.vocab.items():
            self.width[i] = len(t.removesuffix(self.suffix))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.width = np.array(self.width)
        #: Rank of the merge that makes a token, and its parts.
        self.made = {a + b: r for r, (a, b) in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        #: Every token has one merge, later than those of its parts.
        self.treelike = len(self.made) == len(merges) and all(max(self.made.get(a, -1), self.made.get(b, -1)) < r for r, (a, b) in enumerate(merges))
        self.open: set[str] = set()
        for t in self.vocab:
            body = t.removesuffix(self.suffix)
            self.open.update(body[:k] for k in range(1, len(body)))
        # A whole-token tail also counts as open: the same bytes may end a word.
        self.fits: dict[tuple[str, str], bool] = {}
        self.itself: dict[str, bool] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        extra = iter(range(256, 512))
        self.letter = [chr(b) if b in set(printable) else chr(next(extra)) for b in range(256)]
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [("", (("", 0),))]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        #: (state << 8 | byte) -> next state, change of the count plus _CHANGE, last token, in one number.
        self.step: dict[int, int] = {}
        #: The same without a next state, if the pretoken ends.
        self.stop: dict[int, int] = {}
        #: Both for words that advance together; ends are marked.
        self.moves = Moves()

    def _full(self) -> bool:
        return len(self.step) + len(self.stop) + self.moves.size > self.MOST

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE by its definition: the best-ranked pair first, the leftmost among equals."""
        rank = self.rank.get
        while len(symbols) > 1:
            ranks = list(map(rank, zip(symbols, symbols[1:])))
            found = [r for r in ranks if r is not None]
            if not found:
                break
            best = min(found)
            where = ranks.index(best)
            a, b = symbols[where], symbols[where + 1]
            if found.count(best) == 1:
                symbols[where : where + 2] = [a + b]
                continue
            out, i = [], 0
            while i < len(symbols):
                if i < len(symbols) - 1 and symbols[i] == a and symbols[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix):
            body = list(token[: -len(self.suffix)])
            body[-1] += self.suffix
            return body
        return list(token)

    def _alone(self, token: str) -> bool:
        known = self.itself.get(token)
        if known is None:
            if not self.treelike:
                known = self.merge(self._symbols(token)) == [token]
            elif token in self.parts:
                a, b = self.parts[token]
                known = self._alone(a) and self._alone(b) and self._apart(a, b, self.made[token])
            else:
                known = len(self._symbols(token)) == 1
            self.itself[token] = known
        return known

    def _apart(self, a: str, b: str, limit: int) -> bool:
        """Whether no merge below ``limit`` joins parts of two neighbouring tokens.

        The later of the two merges that made what stands at the boundary is
        undone, again and again; a pair across it must not have come before.
        """
        rank, made, parts = self.rank.get, self.made.get, self.parts
        made_a, made_b = made(a, -1), made(b, -1)
        while rank((a, b), limit) >= limit:
            if made_a > made_b:
                limit, a = made_a, parts[a][1]
                made_a = made(a, -1)
            elif made_b >= 0:
                # Of two equal pairs the left one comes first.
                limit, b = made_b + 1, parts[b][0]
                made_b = made(b, -1)
            else:
                return True
        return False

    def _follows(self, before: str, token: str) -> bool:
        if not self._alone(token):
            return False
        if not before:
            return True
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) > self.PAIRS:
                self.fits.clear()
            if self.treelike:
                known = self._apart(before, token, len(self.rank))
            else:
                known = self.merge([*self._symbols(before), *self._symbols(token)]) == [before, token]
            self.fits[before, token] = known
        return known

    def _last(self, state: tuple, end: str) -> tuple[int, str]:
        """Change of the count and last token after one more letter."""
        tail, places = state
        whole = tail + end
        for back, (before, count) in zip(self._backs(tail), places):
            token = whole[len(tail) - back :]
            if token in self.vocab and self._follows(before, token):
                return count + 1, token
        raise AssertionError("every single byte is a token")

    @lru_cache(maxsize=1 << 18)  # noqa: B019
    def _backs(self, tail: str) -> tuple[int, ...]:
        """Lengths of the suffixes of ``tail`` that begin a longer token, longest first, and 0."""
        return tuple(len(tail) - s for s in range(len(tail)) if tail[s:] in self.open) + (0,)

    def _compile_step(self, at: int) -> int:
        state = self.states[at >> 8]
        letter = self.letter[at & 255]
        change, token = self._last(state, letter)
        tail, places = state
        longer = tail + letter
        kept = [
            (back + 1, (before, count - change))
            for back, (before, count) in zip(self._backs(tail), places)
            if longer[len(tail) - back :] in self.open
        ]
        new = (longer[len(longer) - kept[0][0] :] if kept else "", (*[p for _, p in kept], (token, 0)))
        n = self.number.get(new)
        if n is None:
            n = self.number[new] = len(self.states)
            self.states.append(new)
        return (n << _WIDE | change + _CHANGE) << _ID | self.vocab[token]

    def _compile_stop(self, at: int) -> int:
        change, token = self._last(self.states[at >> 8], self.letter[at & 255] + self.suffix)
        return change + _CHANGE << _ID | self.vocab[token]

    def encode(self, word: bytes) -> bytes:
        """Token ids of a pretoken, 16 bits each: the last tokens of its prefixes, followed back from the end."""
        if self._full():
            self.reset()
        step, stop, state, lasts = self.step, self.stop, 0, []
        for byte in word[:-1]:
            at = state << 8 | byte
            found = step.get(at)
            if found is None:
                found = step[at] = self._compile_step(at)
            state = found >> _WIDE + _ID
            lasts.append(found & _LAST)
        at = state << 8 | word[-1]
        if at not in stop:
            stop[at] = self._compile_stop(at)
        lasts.append(stop[at] & _LAST)
        out, left = [], len(word)
        while left:
            out.append(lasts[left - 1])
            left -= int(self.width[out[-1]])
        return np.array(out[::-1], np.uint16).tobytes()

    def _advance(self, at: np.ndarray) -> np.ndarray:
        """Transitions by their numbers; what is missing is compiled."""
        found = self.moves.find(at)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, where = np.unique(at[new], return_inverse=True)
            made = np.array([self._compile_stop(k - _END) if k >= _END else self._compile_step(k) for k in keys.tolist()], np.int64)
            self.moves.put(keys, made)
            found[new] = made[where]
        return found

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """``encode`` of short words, all of them advancing together."""
        out = []
        for a in range(0, len(words), self.TOGETHER):
            out += self._encode_some(words[a : a + self.TOGETHER])
        return out

    def _encode_some(self, words: list[bytes]) -> list[bytes]:
        if self._full():
            self.reset()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        # Words of more letters than a place has before it.
        going = np.searchsorted(-sizes, -np.arange(sizes[0] + 1)).tolist()
        lasts = np.empty((sizes[0], len(words)), np.uint16)
        total = np.zeros(len(words), np.int64)
        state = np.zeros(len(words), np.int64)
        for place, (now, later) in enumerate(zip(going, going[1:])):
            at = state[:now] << 8 | letters[begin[:now] + place]
            at[later:] |= _END
            found = self._advance(at)
            lasts[place, :now] = found & _LAST
            total[:now] += (found >> _ID & _MASK) - _CHANGE
            state = found >> _WIDE + _ID
        ends = np.cumsum(total)
        flat, live, left, at = np.empty(ends[-1], np.uint16), np.arange(len(words)), sizes, ends - 1
        while len(live):
            token = lasts[left - 1, live]
            flat[at] = token
            left = left - self.width[token]
            on = left > 0
            live, left, at = live[on], left[on], at[on] - 1
        raw, out = flat.tobytes(), [b""] * len(words)
        ends = (2 * ends).tolist()
        for i, a, b in zip(order.tolist(), [0, *ends], ends):
            out[i] = raw[a:b]
        return out


class Merges:
    """BPE by its definition, of many words at once: in each round every word merges its best-ranked pair."""

    def __init__(self, merger: Merger) -> None:
        vocab, suffix = merger.vocab, merger.suffix
        self.inner = np.array([vocab[x] for x in merger.letter], np.int64)
        self.final = np.array([vocab[x + suffix] for x in merger.letter], np.int64)
        #: Two ids -> rank of their merge and the id it makes, in one number.
        self.pairs = Moves()
        keys = [vocab[a] << _ID | vocab[b] for a, b in merger.rank]
        values = [r << _ID | vocab[a + b] for (a, b), r in merger.rank.items()]
        self.pairs.put(np.array(keys, np.int64), np.array(values, np.int64))
        #: The same by two bytes within a word, and by the two at its end.
        left = np.repeat(self.inner, 256)
        self.within, self.ending = (self._best(left, np.tile(right, 256)) for right in (self.inner, self.final))

    def _best(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.find(left << _ID | right)
        return np.where(found < 0, _END, found)

    def encode(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each); ``letters`` are the words' bytes end to end, no word is empty."""
        if not len(sizes):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        ends = np.cumsum(sizes) - 1
        ids, owner = self.inner[letters], np.repeat(np.arange(len(sizes)), sizes)
        ids[ends] = self.final[letters[ends]]
        # By place: the merge of its id with the next one of its word.
        both = letters[:-1].astype(np.int32) << 8 | letters[1:]
        pair = np.append(self.within[both], _END)
        before = ends[sizes > 1] - 1
        pair[before] = self.ending[both[before]]
        pair[ends] = _END
        done = []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(pair, first)
            best = np.repeat(best, np.diff(first, append=len(ids)))
            going = best < _END
            if not going.all():
                over = ~going
                done.append((owner[over], ids[over].astype(np.uint16)))
                ids, owner, pair, best = ids[going], owner[going], pair[going], best[going]
                if not len(ids):
                    break
            at = np.flatnonzero(pair == best)
            # Of equal pairs that overlap the left one comes first.
            begins = np.diff(at, prepend=-2) != 1
            if not begins.all():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            ids[at] = pair[at] & _LAST
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            at -= np.arange(len(at))
            ids, owner, pair = ids[kept], owner[kept], pair[kept]
            # What stands beside a new id is looked up again.
            beside = np.concatenate([at, at[at > 0] - 1])
            pair[beside] = _END
            beside = beside[beside + 1 < len(ids)]
            beside = beside[owner[beside] == owner[beside + 1]]
            pair[beside] = self._best(ids[beside], ids[beside + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))


def normalize(text: str) -> str:
    """Composed, lower case code point by code point. White space is left as it is, as any of it only separates."""
    if text.isascii():
        return text.lower()
    # A final sigma has no form of its own when code points are lowered one by one.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordTokenizer:
    """Counts and ids of whole texts through the two transducers."""

    # Special tokens and their ids.
    SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
    #: Results kept for words seen before, in each of two generations. Longer words aren't kept.
    REMEMBERED, LONGEST = 170_000, 64

    def __init__(self, path: str) -> None:
        self.scanner = Scanner()
        self.merger = Merger(path)
        self.merges = Merges(self.merger)
        self.encoded, self.encoded_before = {}, {}
        self.special = re.compile("|".join(map(re.escape, self.SPECIAL)))

    def _spans(self, texts: list[str], white: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """``pretokens`` with the bytes of distinct spans end to end, and the place of each and of their end."""
        joined = "\n".join(texts) + "\n"
        lengths = np.array([len(t) for t in texts], np.int64) + 1
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, solid = self.scanner.spans(codes)
        if joined.isascii():
            at = starts
            size = len(codes)
        else:
            width = (codes >= 0x80).view(np.int8) + np.int8(1) + (codes >= 0x800) + (codes >= 0x10000)
            ends = np.cumsum(width, dtype=np.int64)
            at = (ends - width)[starts]
            size = int(ends[-1])
        data = joined.encode("utf-8", "surrogatepass")
        offsets = np.append(at, size).astype(np.int32)
        if not white:
            # What is left is moved together.
            sizes = np.diff(offsets)
            data = np.frombuffer(data, np.uint8)[np.repeat(solid, sizes)]
            starts, offsets = starts[solid], np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes[solid], dtype=np.int32)])
        spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = spans.dictionary_encode()
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        _, bounds, held = coded.dictionary.buffers()
        held = held.to_pybytes() if held else b""
        return held, np.frombuffer(bounds, np.int32, len(coded.dictionary) + 1), coded.indices.to_numpy(), first

    def pretokens(self, texts: list[str], white: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct spans, span -> distinct, text -> first span). White space spans are in it too, unless left out."""
        held, bounds, index, first = self._spans(texts, white)
        # Cut from the bytes at once, as a scalar for each word would cost as much as its lookup.
        bounds = bounds.tolist()
        return [held[a:b] for a, b in zip(bounds, bounds[1:])], index, first

    def _pieces(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, 16 bits each."""
        if len(self.encoded) > self.REMEMBERED:
            self.encoded, self.encoded_before = {}, self.encoded
        known, before = self.encoded, self.encoded_before
        pieces = list(map(known.get, words))
        new = []
        for i in [i for i, ids in enumerate(pieces) if ids is None]:
            w = words[i]
            ids = before.get(w)
            if ids is not None:
                known[w] = pieces[i] = ids
            elif len(w) <= self.LONGEST:
                new.append(i)
            else:
                pieces[i] = self.merger.encode(w)
        found = [words[i] for i in new]
        made = self.merger.encode_all(found)
        known.update(zip(found, made))
        for i, ids in zip(new, made):
            pieces[i] = ids
        return pieces

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        plain = []
        for i, t in enumerate(texts):
            if "<|" in t:
                t, extra[i] = self.special.subn(" ", t)
            plain.append(normalize(t))
        words, index, first = self.pretokens(plain, white=False)
        by_word = np.fromiter(map(len, self._pieces(words)), np.int64, len(words)) // 2
        sums = np.concatenate([[0], np.cumsum(by_word[index])])
        return sums[first[1:]] - sums[first[:-1]] + extra

    def _word_ids(self, held: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each word's first one, number of each word's)."""
        lengths = np.diff(bounds)
        letters, short = np.frombuffer(held, np.uint8, bounds[-1]), lengths <= self.LONGEST
        if short.all():
            flat, size = self.merges.encode(letters, lengths)
            return flat, np.cumsum(size) - size, size
        size = np.empty(len(lengths), np.int64)
        flat, size[short] = self.merges.encode(letters[np.repeat(short, lengths)], lengths[short])
        long = np.flatnonzero(~short)
        pieces = [np.frombuffer(self.merger.encode(held[bounds[i] : bounds[i + 1]]), np.uint16) for i in long]
        size[long] = [len(p) for p in pieces]
        order = np.concatenate([np.flatnonzero(short), long])
        start = np.empty(len(lengths), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([flat, *pieces]), start, size

    def _plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held, bounds, index, first = self._spans([normalize(t) for t in texts], white=False)
        flat, start, size = self._word_ids(held, bounds)
        n = size[index]
        ends = np.cumsum(n)
        # Each span's ids: its word's start, counted on.
        take = np.repeat(start[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return flat[take], np.concatenate([[0], ends])[first]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text i has ids[offsets[i]:offsets[i + 1]]."""
        if not any("<|" in t for t in texts):
            return self._plain_ids(texts)
        parts, marks, owner = [], [], []
        for i, t in enumerate(texts):
            at = 0
            for m in self.special.finditer(t):
                parts.append(t[at : m.start()])
                marks.append(self.SPECIAL[m[0]])
                owner.append(i)
                at = m.end()
            parts.append(t[at:])
            marks.append(-1)
            owner.append(i)
        flat, offsets = self._plain_ids(parts)
        out, sizes = [], np.zeros(len(texts), np.int64)
        for k, (mark, i) in enumerate(zip(marks, owner)):
            out.append(flat[offsets[k] : offsets[k + 1]])
            if mark >= 0:
                out.append(np.array([mark], np.uint16))
            sizes[i] += offsets[k + 1] - offsets[k] + (mark >= 0)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker; its tables grow with use up to their bounds."""
    return WordTokenizer(path)
