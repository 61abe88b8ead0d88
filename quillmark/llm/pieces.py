"""Encode many texts with few tokenizer calls: cut them into pieces, encode each distinct piece once.

Texts are cut at places where the pre-tokenizers served here end a match, whatever stands
around, so the ids of a text are those of its pieces, joined. Such places are, in UTF-8 bytes,

- before a space or a line end that follows another character than white space,
- behind a single line end between two such characters,
- between an ASCII letter or digit, or a letter of the block Latin-1, and one of `.,!?;:`,
  and between one of these and an ASCII letter or digit.

Where bytes leave doubt, there is no cut. Texts of a batch share most pieces, and a worker
remembers the ids of the pieces that it met last, up to a bound.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that one string holds when it is handed to the tokenizer, and that a generation of known ones holds.
_PIECES_A_STRING, _GENERATION = 256, 1 << 17
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20
_STOPS = b".,!?;:"


def cuts_at_spaces(config: dict) -> bool:
    """Whether the tokenizer's pre-tokenizer ends a match at every cut described above."""
    pre = config.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    if any(p.get("type") == "ByteLevel" and p.get("add_prefix_space") for p in parts):
        return False
    normal = config.get("normalizer") or {}
    if any(p.get("type") not in {"NFC", "Replace", "Lowercase"} for p in normal.get("normalizers", [normal] if normal else [])):
        return False
    if any(set(t["content"]) & set(" \n" + _STOPS.decode()) for t in config.get("added_tokens", [])):
        return False
    first = parts[0]
    return (first.get("type") == "ByteLevel" and first.get("use_regex", True)) or (first.get("type") == "Split" and r"[^\s\p{L}\p{N}]+" in str((first.get("pattern") or {}).get("Regex")))


#: Kinds of bytes: ASCII letters and digits, stops, other ASCII that is printed, space, line end, what lies beyond ASCII; 0 for the rest.
_ALNUM, _STOP, _INK, _SPACE, _LINE, _BEYOND = range(1, 7)
_KIND = np.array([_BEYOND if c >= 128 else _SPACE if c == 32 else _LINE if c == 10 else _STOP if c in _STOPS else _ALNUM if chr(c).isalnum() else _INK if 0x20 < c < 0x7F else 0 for c in range(256)], np.uint8)
#: By the kinds of two neighbours: 1 for a cut between them, 2 and 3 for one that depends on the byte before.
_CUT = np.zeros((8, 8), np.uint8)
_CUT[np.ix_([_ALNUM, _STOP, _INK], [_SPACE, _LINE])] = 1
_CUT[_ALNUM, _STOP] = _CUT[_STOP, _ALNUM] = 1
_CUT[_BEYOND, [_SPACE, _LINE, _STOP]] = 2
_CUT[_LINE, [_ALNUM, _STOP, _INK]] = 3


def cuts(data: np.ndarray) -> np.ndarray:
    """The places, from 1 on, where the UTF-8 bytes may be cut."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    found = _CUT.ravel()[kind[:-1] << 3 | kind[1:]]
    at = np.flatnonzero(found)  # the byte before the cut
    doubt = np.flatnonzero(found[at] > 1)
    here = at[doubt]
    second = np.where(here > 0, data[here - 1], 0)
    # Characters beyond ASCII with these second last bytes may be white space; those behind 0xC3 are letters but for two.
    ink = (_KIND[second] == _BEYOND) & (second != 0x80) & (second != 0x81) & (second != 0x9A) & (second != 0xC2)
    letter = (second == 0xC3) & (data[here] != 0x97) & (data[here] != 0xB7)
    before = _KIND[second]
    alone = (before == _ALNUM) | (before == _STOP) | (before == _INK)
    sure = np.where(found[here] == 3, alone, np.where(kind[here + 1] == _STOP, letter, ink))
    return np.delete(at, doubt[~sure]) + 1


class _Known:
    """Ids of pieces, one behind the other."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rows = np.arange(len(self.at), len(self.at) + len(pieces))
        self.at.update(zip(pieces, rows.tolist()))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size, self.ids = np.concatenate([self.size, sizes]), np.concatenate([self.ids, ids])
        return rows


def gathered(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ids that begin there and have these sizes, joined."""
    ends = np.cumsum(size)
    steps = np.ones(int(ends[-1]) if len(ends) else 0, np.int32 if len(ids) < 1 << 31 else np.int64)
    some = size > 0
    firsts, starts = (ends - size)[some], begin[some]
    if len(firsts):
        steps[firsts] = starts - np.concatenate([[0], starts[:-1] + size[some][:-1] - 1])
    return ids[np.cumsum(steps, dtype=steps.dtype)]


class _Memory:
    """The ids of the pieces met last. A full generation becomes the older one, and that before it is
    forgotten, so two generations and the pieces of one slice are held at most."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = _GENERATION):
        self.encode, self.most = encode, most
        self.young, self.old = _Known(), _Known()

    def find(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids held, and where those of each of the distinct pieces begin and how many they are."""
        if len(self.young.at) > self.most:
            self.young, self.old = _Known(), self.young
        young, old = self.young, self.old
        rows = young.find(pieces)
        if len(missing := np.flatnonzero(rows < 0)):
            wanted = [pieces[i] for i in missing.tolist()]
            before = old.find(wanted)
            known, new = missing[before >= 0], missing[before < 0]
            before = before[before >= 0]
            rows[known] = young.add([pieces[i] for i in known.tolist()], gathered(old.ids, old.begin[before], old.size[before]), old.size[before])
            unknown = [pieces[i] for i in new.tolist()]
            rows[new] = young.add(unknown, *self.encode(unknown))
        return young.ids, young.begin[rows], young.size[rows]


class PieceEncoder:
    """Ids of texts as the tokenizers library gives them, without special tokens of its own."""

    def __init__(self, path: str, generation: int = _GENERATION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.by_piece = cuts_at_spaces(config)
        added = config.get("added_tokens", [])
        self.added = [t["content"] for t in added]
        self._opens = re.compile("[" + re.escape("".join({t["content"][0] for t in added})) + "]") if added else None
        plain = [t for t in added if t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])]
        self._mark = plain[0] if plain else None
        # A space and printed ASCII characters that begin no added token, or letters of the block Latin-1; and the bytes of each id, if a token's characters are bytes.
        printed = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in {t["content"][0] for t in added})
        self._word = re.compile(" [" + re.escape(printed) + "À-ÖØ-öø-ÿ]+")
        self._bytes = None
        if self.by_piece and not config.get("normalizer") and '"ByteLevel"' in json.dumps(config.get("pre_tokenizer")):
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self._bytes = np.zeros(max([*vocabulary.values(), *(t["id"] for t in added)]) + 1, np.int64)
            self._bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._memory = _Memory(self._encode_pieces, generation)

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), np.fromiter(map(len, ids), np.int64, len(ids))

    def _marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces go into one string, with a special token between them."""
        joined = [self._mark["content"].join(pieces[i : i + _PIECES_A_STRING]) for i in range(0, len(pieces), _PIECES_A_STRING)]
        flat, _ = self._encode([x + self._mark["content"] for x in joined])
        ends = np.flatnonzero(flat == self._mark["id"])
        return flat[flat != self._mark["id"]], np.diff(ends, prepend=-1) - 1

    def _chained(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words go into one string as they are, since there is a cut before each one's space; the ids' bytes tell where each ends."""
        ids, _ = self._encode(["".join(words[i : i + _PIECES_A_STRING]) for i in range(0, len(words), _PIECES_A_STRING)])
        ends, at = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words))), np.cumsum(self._bytes[ids])
        last = np.searchsorted(at, ends)
        if len(words) and not (len(ids) == last[-1] + 1 and (at[last] == ends).all()):
            return self._marked(words)
        return ids, np.diff(last, prepend=-1)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece."""
        if self._mark is None or not pieces:
            return self._encode(pieces)
        words = map(self._word.fullmatch, pieces) if self._bytes is not None else repeat(None)
        kinds = np.fromiter([0 if w else 2 if self._opens.search(p) else 1 for w, p in zip(words, pieces)], np.uint8, len(pieces))
        sizes, found = np.empty(len(pieces), np.int64), []
        for kind, way in enumerate((self._chained, self._marked, self._encode)):
            chosen = kinds == kind
            if chosen.all():
                return way(pieces)
            if chosen.any():
                ids, sizes[chosen] = way([pieces[i] for i in np.flatnonzero(chosen).tolist()])
                found.append((kind, ids))
        out, at = np.empty(int(sizes.sum()), np.uint32), np.repeat(kinds, sizes)
        for kind, ids in found:
            out[at == kind] = ids
        return out, sizes

    def _codes(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the piece at each place, and where each text's places begin."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        base = int(offsets[0])
        raw = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
        begins = np.zeros(len(raw) + 1, bool)
        begins[cuts(raw)] = begins[offsets - base] = True  # texts begin pieces of their own
        ends = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw))
        coded = pieces.dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(ends, offsets - base)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), joined, and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return self._encode(texts.to_pylist())
        pieces, codes, offsets = self._codes(texts)
        ids, begin, sizes = self._memory.find(pieces)
        lens = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return gathered(ids, begin[codes], lens), np.diff(ends[offsets])

    def count(self, texts: pa.Array) -> np.ndarray:
        """Each text's number of ids (null: none)."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return self._encode(texts.to_pylist())[1]
        pieces, codes, offsets = self._codes(texts)
        _, _, sizes = self._memory.find(pieces)
        return np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[offsets])


@functools.lru_cache(maxsize=2)
def encoder(path: str, generation: int = _GENERATION) -> PieceEncoder:
    """One encoder for each worker process, tokenizer file and size of its memory."""
    return PieceEncoder(path, generation)
