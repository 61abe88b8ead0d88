"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping windows, with offsets. Two windows are spliced
at a stable common boundary: a place in their overlap where the pre-tokenizer ends a match,
whatever precedes, where both windows begin a token, and from which on their ids agree. Such
places lie before a space or line end that follows another character and, for tokenizers
that do not normalise, also where a run of letters or of digits ends, or begins behind a
sign other than an apostrophe, so texts without spaces have them too. Where the overlap has
no such place, it is widened, at last to the whole rest of the document: a document of one
single run of letters is encoded at once, as its tokens may depend on all of it.

Null and empty texts have 0 tokens; no documents give no rows. Rows are counted one by one,
so repeated rows and repeated ids stay. Other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of
from .pieces import SLICE_BYTES, PieceEncoder, encoder

#: Characters of a window, and of the overlap of two windows before it is widened.
WINDOW, OVERLAP = 16384, 256
#: Ids that must agree behind a boundary, where there are as many.
AGREE = 8
_CUT = regex.compile(r"(?<=\S)(?=[ \n])")
#: For tokenizers without a normaliser, which could join what these places part.
_CUT_RAW = regex.compile(r"(?<=\S)(?=[ \n])|(?<=\p{L})(?=[^\s\p{L}\p{M}])|(?<=\p{N})(?=[^\s\p{N}\p{M}])|(?<=[^\s\p{L}\p{N}\p{M}'])(?=[\p{L}\p{N}])")


class _Window:
    """Ids of text[start:stop] with the offsets of their characters in the whole text."""

    def __init__(self, start: int, stop: int, encoding):
        self.start, self.stop, self.ids = start, stop, encoding.ids
        self.begins = [start + a for a, _ in encoding.offsets]
        self.ends = [start + b for _, b in encoding.offsets]

    def token_at(self, place: int) -> int | None:
        """The token that begins at the place, or, as offsets leave out spaces, behind its space."""
        k = bisect_left(self.begins, place)
        return k if k == 0 or self.ends[k - 1] <= place else None


def _splits_added(text: str, place: int, added: list[str]) -> bool:
    """Whether the place lies inside a string that the tokenizer takes for one of its added tokens."""
    return any(text.find(a, max(0, place - len(a) + 1), place + len(a) - 1) >= 0 for a in added)


def _common(enc: PieceEncoder, text: str, left: _Window, right: _Window, since: int) -> tuple[int, int, int] | None:
    """The first stable common boundary behind `since`, and the left and right window's tokens there."""
    cut = _CUT if enc.tokenizer.normalizer else _CUT_RAW
    for m in cut.finditer(text, max(right.start, since) + 1, left.stop):
        if _splits_added(text, m.start(), enc.added):
            continue
        i, j = left.token_at(m.start()), right.token_at(m.start())
        if i is None or j is None:
            continue
        whole = bisect_left(left.ends, left.stop) - 1  # the last token may have been cut off
        same = min(AGREE, whole - i, len(right.ids) - j)
        if same > 0 and left.ids[i : i + same] == right.ids[j : j + same]:
            return m.start(), i, j
    return None


def resync_ids(enc: PieceEncoder, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[list[int], int, int]:
    """Ids of the text, the number of its windows and how often an overlap was widened."""
    n = len(text)

    def at(start: int, stop: int) -> _Window:
        return _Window(start, min(n, stop), enc.tokenizer.encode(text[start:stop], add_special_tokens=False))

    left = at(0, window + overlap if enc.by_piece else n)
    ids: list[int] = []
    windows, widened, since, taken = 1, 0, 0, 0
    while left.stop < n:
        more, found = overlap, None
        while found is None:
            start = max(left.start + 1, left.stop - more)
            right = at(start, start + window + more)
            if (found := _common(enc, text, left, right, since)) is None:
                widened += 1
                if start == left.start + 1:
                    break
                more *= 2
        if found is None:  # no boundary in the whole window: make it longer
            left = at(left.start, 2 * left.stop - left.start)
            continue
        since, i, j = found
        ids += left.ids[taken:i]
        left, taken, windows = right, j, windows + 1
    return ids + left.ids[taken:], windows, widened


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; n_windows and n_widened say how the text was encoded."""

    def counted(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in slices_of(texts, SLICE_BYTES):
                part = texts.slice(lo, hi - lo)
                huge = pc.greater(pc.utf8_length(part), window).to_numpy(zero_copy_only=False)
                counts = enc.count(pc.if_else(pa.array(huge), "", part))
                windows, widened = np.ones(len(part), np.int64), np.zeros(len(part), np.int64)
                for i in np.flatnonzero(huge):
                    ids, windows[i], widened[i] = resync_ids(enc, part[int(i)].as_py(), window, overlap)
                    counts[i] = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pc.binary_length(part).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit), pa.array(windows), pa.array(widened)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_windows", "n_widened"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_windows long, n_widened long")
