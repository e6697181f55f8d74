"""A BPE SentencePiece model in Python: character map, merges, byte fallback, decoding.

Only what a task needs to turn texts into pieces with the original bytes of each:

- `CharacterMap` reads the compiled map of the model (a double array over UTF-8 bytes and the
  replacement strings) and replaces the longest key at each place.
- `PieceModel.normalize` gives the normalized text and, for each of its bytes, the original
  byte where its character began.
- `PieceModel.entry` merges one segment. Segments are cut where no piece of the vocabulary
  could cross, so merging them one by one equals merging the whole text, and each different
  segment is merged once per task.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass

import numpy as np

SPACE = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


class CharacterMap:
    """Longest-prefix replacement of text by a compiled character map."""

    def __init__(self, blob: bytes):
        self.keys: dict[str, str] = {}
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.keys = self._read(np.frombuffer(blob[4: 4 + size], "<u4").astype(np.int64), blob[4 + size:])
        self.longest = max(map(len, self.keys), default=0)
        alone = {k for k in self.keys if len(k) == 1}
        pairs = {k[:2] for k in self.keys if len(k) > 1}
        heads, seconds = {p[0] for p in pairs} - alone, {p[1] for p in pairs}
        parts = [_class(alone)] * bool(alone) + [f"{_class(heads)}(?={_class(seconds)})"] * bool(heads)
        #: places where a key may begin; at all others one character stands for itself
        self.starts = re.compile("|".join(parts)) if parts else None

    @staticmethod
    def _read(units: np.ndarray, strings: bytes) -> dict[str, str]:
        """All keys of the double array with their replacements."""
        offset = (units >> 10) << ((units & (1 << 9)) >> 6)
        label = units & ((1 << 31) | 0xFF)
        letters = np.arange(1, 256)
        found: dict[str, str] = {}
        open_nodes = [(b"", int(offset[0]))]
        while open_nodes:
            key, at = open_nodes.pop()
            to = at ^ letters
            inside = to < len(units)
            for b in letters[inside][label[to[inside]] == letters[inside]].tolist():
                node = at ^ b
                below = node ^ int(offset[node])
                longer = key + bytes([b])
                if units[node] >> 8 & 1:
                    value = int(units[below]) & ((1 << 31) - 1)
                    found[longer.decode()] = strings[value: strings.index(b"\0", value)].decode()
                open_nodes.append((longer, below))
        return found

    def pieces_of(self, text: str):
        """(start, end, replacement) of the longest key at every place that has one, left to right."""
        done = 0
        for hit in self.starts.finditer(text) if self.starts else ():
            at = hit.start()
            if at < done:
                continue
            for n in range(min(self.longest, len(text) - at), 0, -1):
                to = self.keys.get(text[at: at + n])
                if to is not None:
                    done = at + n
                    yield at, done, to
                    break


def _class(characters) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(characters)) + "]"


def char_bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, number of bytes of each character)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begin = np.flatnonzero((raw & 0xC0) != 0x80)
    return raw, np.diff(np.append(begin, len(raw)))


@dataclass
class Normalized:
    text: str
    #: original byte of each normalized byte, and of the end
    origin: np.ndarray


class PieceModel:
    """A model file; raises ValueError for kinds of models that are not read here."""

    CACHED = 800_000  # different segments, and runs in them, kept by a task; beyond, they are forgotten and merged anew

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as formats

        proto = formats.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.rules, training = proto.normalizer_spec, proto.trainer_spec
        if training.model_type != BPE:
            raise ValueError("only BPE models are read")
        kinds = {p.type for p in proto.pieces}
        if kinds & {USER_DEFINED, UNUSED} or training.treat_whitespace_as_suffix:
            raise ValueError("models with own symbols, unused pieces or white space as suffix are not read")
        if proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models with a map for decoding are not read")
        self.map = CharacterMap(proto.normalizer_spec.precompiled_charsmap)
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_surface = training.unk_surface
        self.fallback = training.byte_fallback
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
        #: the bytes of ordinary pieces and byte pieces
        self.spelled = {i: p.piece.replace(SPACE, " ").encode() for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.spelled |= {i: bytes([b]) for i, b in self.byte_of.items()}
        #: neighbours inside a piece
        self.joins = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        self.cut = self._segments()
        self.size_of = [len(p.encode()) for p in self.pieces]
        #: ids of runs made of ordinary pieces
        self.merged: dict[str, tuple[int, ...]] = {}
        self._forget()

    def _segments(self) -> re.Pattern:
        """Segments that no piece crosses: spaces with the word after them, or one lone character."""
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return re.compile(".+", re.S)
        joined = {c for p in long for c in p} - {SPACE}
        return re.compile(f"{SPACE}*{_class(joined)}+|{SPACE}+|.", re.S) if joined else re.compile(f"{SPACE}+|.", re.S)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.kept_ids, self.kept_sizes = array("q"), array("i"), array("i")

    def normalize(self, text: str) -> Normalized:
        """The text as pieces see it, with the original byte of each of its bytes."""
        if not text:
            return Normalized("", np.zeros(1, np.int64))
        parts, chars, bytes_of = [], [], []
        raw, width = char_bytes(text)
        begin = np.cumsum(width) - width
        done = 0
        for low, high, to in self.map.pieces_of(text):
            parts += [text[done:low], to]
            chars += [begin[done:low], np.full(len(to), begin[low])]
            done = high
        parts.append(text[done:])
        chars.append(begin[done:])
        made, where = "".join(parts), np.concatenate(chars)
        end = len(raw)
        if self.rules.remove_extra_whitespaces:
            space = np.fromiter((c == " " for c in made), bool, len(made))
            # of every run of spaces the first one stays, but none at either end
            keep = ~space | np.concatenate([[False], ~space[:-1]])
            ends = space | np.fromiter((c == SPACE and self.rules.escape_whitespaces for c in made), bool, len(made))
            last = int(np.flatnonzero(~ends)[-1]) if not ends.all() else -1
            keep[last + 1:] = False
            if last + 1 < len(made):
                end = int(where[last + 1])
            made, where = "".join(c for c, k in zip(made, keep) if k), where[keep]
            if not made:
                return Normalized("", np.zeros(1, np.int64))
        if self.rules.add_dummy_prefix:
            made = " " + made
            where = np.concatenate([[where[0] if self.rules.remove_extra_whitespaces else 0], where])
        if self.rules.escape_whitespaces:
            made = made.replace(" ", SPACE)
        return Normalized(made, np.append(np.repeat(where, char_bytes(made)[1]), end))

    def merge(self, segment: str) -> list[str]:
        """The pieces of a segment: best scored neighbours first, leftmost of equals."""
        parts = list(segment)
        if len(parts) > 40:
            return self._merge_long(parts)
        score, none = self.scores.get, float("-inf")
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            i = gains.index(best)
            parts[i] += parts.pop(i + 1)
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap and linked neighbours."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n:
                s = self.scores.get(parts[i] + parts[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def runs(self, segment: str) -> list[str]:
        """A segment cut between characters that stand next to each other in no piece."""
        cuts = [i for i, pair in enumerate(zip(segment, segment[1:]), 1) if pair not in self.joins]
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)])] if cuts else [segment]

    def entry(self, segment: str) -> int:
        """The number of a segment whose ids and piece sizes (normalized bytes) are kept."""
        ids: list[int] = []
        sizes: list[int] = []
        for part in self.runs(segment):
            made = self.merged.get(part)
            if made is None:
                pieces = self.merge(part)
                made = tuple(map(self.ids.get, pieces))
                if None in made:
                    spelled = self._spelled_out(pieces)
                    ids += spelled[0]
                    sizes += spelled[1]
                    continue
                self.merged[part] = made
            ids += made
            sizes += map(self.size_of.__getitem__, made)
        number = self.known[segment] = len(self.counts)
        self.counts.append(len(ids))
        self.kept_ids.extend(ids)
        self.kept_sizes.extend(sizes)
        return number

    def _spelled_out(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """Ids and sizes where characters outside the vocabulary are bytes (the last one spans them) or unknown."""
        ids: list[int] = []
        sizes: list[int] = []
        for piece in parts:
            raw = piece.encode()
            known = self.ids.get(piece)
            if known is None and self.fallback:
                ids += [self.byte_ids[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            else:
                ids.append(self.unknown if known is None else known)
                sizes.append(len(raw))
        return ids, sizes

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first original byte, end of original bytes) of the pieces of each text."""
        if len(self.known) > self.CACHED:
            self._forget()
        if len(self.merged) > self.CACHED:
            self.merged.clear()
        forms = [self.normalize(t) for t in texts]
        numbers = []
        for form in forms:
            words = self.cut.findall(form.text)
            get = self.known.get
            found = [get(w) for w in words]
            if None in found:
                found = [self.known[w] if w in self.known else self.entry(w) for w in words]
            numbers.append(np.array(found, np.int64))
        count, ids, sizes = (np.array(x) for x in (self.counts, self.kept_ids, self.kept_sizes))
        first = np.cumsum(count) - count
        out = []
        for form, number in zip(forms, numbers):
            n = count[number]
            ends = np.cumsum(n)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[number] - (ends - n), n)
            got, to = ids[place], np.cumsum(sizes[place])
            if not self.fallback and len(got) > 1:  # unknown characters in a row are one piece
                again = np.append(False, (got[1:] == self.unknown) & (got[:-1] == self.unknown))
                stays = ~again
                to = to[np.append(np.flatnonzero(stays)[1:] - 1, len(got) - 1)]
                got = got[stays]
            out.append((got, form.origin[np.append(0, to[:-1])[: len(got)]], form.origin[to]))
        return out

    def decode(self, ids) -> str:
        """The text of any ids: bytes joined to characters, marks to spaces, the added space gone."""
        try:  # the usual case: ordinary pieces, and bytes that make whole characters
            text = b"".join(map(self.spelled.__getitem__, ids)).decode()
            if not self.rules.remove_extra_whitespaces:
                lead = self.rules.add_dummy_prefix and len(ids) and self.pieces[ids[0]][:1] == SPACE
                return text[1:] if lead else text
        except (KeyError, UnicodeDecodeError):
            pass
        out: list[str] = []
        run = bytearray()
        at_start, strip = True, self.rules.add_dummy_prefix or self.rules.remove_extra_whitespaces
        space_gone = False

        def flush() -> None:
            if run:
                out.append(_characters(bytes(run)))
                run.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(self.byte_of[i])
                continue
            flush()
            if space_gone or any(out):
                at_start = False
            space_gone = False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_surface)
                continue
            piece = self.pieces[i]
            if at_start and strip and piece.startswith(SPACE):
                piece = piece[1:]
                space_gone = not self.rules.remove_extra_whitespaces
            out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


def _characters(raw: bytes) -> str:
    """UTF-8 bytes as text; each byte that is part of no whole character is U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as bad:
        return raw[: bad.start].decode() + "�" + _characters(raw[bad.start + 1:])
