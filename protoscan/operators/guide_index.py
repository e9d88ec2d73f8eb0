"""An index of guides by the edited forms of their halves, and the check of what it finds.

If a guide fits a span with k edits, then its half next to the PAM has at most k // 2 of them, or the
other half at most k - k // 2 - 1. So each half is written out in all its forms of up to that many edits, and a window
of the genome is looked up by a few of its own substrings: the ones that end at the PAM for the near half, and those
that end 10 letters before it, moved by up to the allowed gaps, for the far half. Letters are two bits each, the one
next to the PAM lowest, so that a substring is a shift and a mask. A table has the sorted forms of one length with their guides, and
one flag for every possible text of that length, which most substrings fail.

Only the (window, guide) pairs found this way meet the table of edits, which gives the fewest edits for
every span length at once. The index loses nothing: it is a necessary condition.
"""

from __future__ import annotations

import numpy as np

from protoscan.fixed import GUIDE_LEN

HALF = GUIDE_LEN // 2
FLAGGED = 12
PAIRS_AT_ONCE = 200_000
BAD = 255

_CODE = np.full(256, BAD, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def codes(texts: list[str], width: int) -> np.ndarray:
    """(texts, width): 0 to 3 for A, C, G, T, ``BAD`` for anything else."""
    return _CODE[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)].reshape(len(texts), width)


def packed(letters: np.ndarray) -> np.ndarray:
    """Two bits per letter, the last one lowest; letters that are none count as 0."""
    out = np.zeros(len(letters), np.int64)
    for column in letters.T:
        out = out << 2 | column & 3
    return out


def _one_edit(x: np.ndarray, n: int, gaps: bool) -> dict[int, np.ndarray]:
    """All texts one substitution, deletion or insertion away from texts of ``n`` packed letters, (forms, texts) by length."""
    low = [(1 << 2 * i) - 1 for i in range(n + 1)]
    out = {n: [x & ~(3 << 2 * i) | c << 2 * i for i in range(n) for c in range(4)]}
    if gaps:
        out[n - 1] = [x >> 2 * (i + 1) << 2 * i | x & low[i] for i in range(n)]
        out[n + 1] = [x >> 2 * i << 2 * (i + 1) | c << 2 * i | x & low[i] for i in range(n + 1) for c in range(4)]
    return {length: np.stack(forms) for length, forms in out.items() if forms}


def edited_forms(half: np.ndarray, edits: int, gaps: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(sorted forms, their guides) by length: every text within ``edits`` of a half of each guide."""
    width = 2 * (HALF + edits)

    def distinct(keys: np.ndarray) -> np.ndarray:  # (guide, form) in one number
        return np.unique(keys)

    own = np.arange(len(half), dtype=np.int64) << width
    found = {HALF: own | half}
    for _ in range(edits):
        more: dict[int, list[np.ndarray]] = {n: [keys] for n, keys in found.items()}
        for n, keys in found.items():
            guide, form = keys >> width << width, keys & (1 << width) - 1
            for length, forms in _one_edit(form, n, gaps).items():
                more.setdefault(length, []).append((forms | guide).ravel())
        found = {n: distinct(np.concatenate(keys)) for n, keys in more.items()}
    out = {}
    for n, keys in found.items():
        form, guide = keys & (1 << width) - 1, (keys >> width).astype(np.int32)
        order = np.argsort(form, kind="stable")
        out[n] = form[order], guide[order]
    return out


class GuideIndex:
    """Looks up windows among guides (guides, 20 letters as codes)."""

    def __init__(self, guides: np.ndarray, max_edits: int, max_gaps: int):
        self.guides, self.max_gaps = guides, max_gaps
        near, far = packed(guides[:, HALF:]), packed(guides[:, :HALF])
        self.tables: dict[tuple[str, int], dict] = {}
        for limit in range(max_edits + 1):
            for side, half, edits in (("near", near, limit // 2), ("far", far, limit - limit // 2 - 1)):
                if edits >= 0 and (side, edits) not in self.tables:
                    self.tables[side, edits] = {n: (*table, self._flags(n, table[0])) for n, table in edited_forms(half, edits, max_gaps > 0).items()}

    @staticmethod
    def _flags(n: int, forms: np.ndarray) -> np.ndarray | None:
        if n > FLAGGED:
            return None
        flags = np.zeros(1 << 2 * n, bool)
        flags[forms] = True
        return flags

    def _looked_up(self, whole: np.ndarray, have: np.ndarray, shift: int, n: int, table: tuple) -> np.ndarray:
        """window * guides + guide of the windows whose ``n`` letters, ``shift`` letters before the PAM, are a form."""
        forms, owners, flags = table
        keys = whole >> 2 * shift & (1 << 2 * n) - 1
        ok = have >= shift + n
        at = np.flatnonzero(ok & flags[keys] if flags is not None else ok)
        keys = keys[at]
        first, last = np.searchsorted(forms, keys), np.searchsorted(forms, keys, "right")
        counts = last - first
        total = int(counts.sum())
        places = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(total)
        return np.repeat(at, counts) * len(self.guides) + owners[places]

    def candidates(self, windows: np.ndarray, have: np.ndarray, limit: int) -> np.ndarray:
        """The pairs that may fit within ``limit`` edits, as window * guides + guide; ``have``: usable letters of each window."""
        whole = packed(windows)
        near, far = limit // 2, limit - limit // 2 - 1
        out = [self._looked_up(whole, have, 0, n, table) for n, table in self.tables["near", near].items()]
        if far >= 0:
            for moved in range(-self.max_gaps, self.max_gaps + 1):
                out += [self._looked_up(whole, have, HALF + moved, n, table) for n, table in self.tables["far", far].items()]
        return np.unique(np.concatenate(out))

    def hits(self, windows: np.ndarray, have: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, guide, span, edits) of every span within the window's limit; one row per span length."""
        found = [np.zeros((4, 0), np.int64)]
        for limit in np.unique(limits[limits >= 0]):
            part = np.flatnonzero(limits == limit)
            pairs = self.candidates(windows[part], have[part], int(limit))
            for low in range(0, len(pairs), PAIRS_AT_ONCE):
                w, g = np.divmod(pairs[low : low + PAIRS_AT_ONCE], len(self.guides))
                w = part[w]
                for surplus, edits in edit_table(self.guides[g], windows[w], self.max_gaps, int(limit)).items():
                    fits = np.flatnonzero((edits <= limit) & (have[w] >= GUIDE_LEN + surplus))
                    found.append(np.stack([w[fits], g[fits], np.full(len(fits), GUIDE_LEN + surplus), edits[fits]]))
        return tuple(np.concatenate(found, axis=1))


def edit_table(guide: np.ndarray, dna: np.ndarray, max_gaps: int, limit: int | None = None) -> dict[int, np.ndarray]:
    """Fewest edits of each guide against the last len+surplus letters of its window, per surplus, with at most ``max_gaps`` gaps.

    Rows run from the PAM outwards. Pairs that are beyond ``limit`` halfway are left at a high number.
    """
    n, g_len = guide.shape
    d_len = dna.shape[1]
    alive = np.arange(n)
    here: dict[tuple[int, int], np.ndarray] = {}
    for row in range(g_len + 1):
        if limit is not None and row == g_len // 2 + 2:  # most pairs that share one half only end here
            near = np.minimum.reduce(list(here.values())) <= limit
            alive, guide, dna = alive[near], guide[near], dna[near]
            here = {at: x[near] for at, x in here.items()}
        above, here = here, {}
        for surplus in range(-max_gaps, max_gaps + 1):
            used = row + surplus
            if used < 0 or used > d_len:
                continue
            differs = (guide[:, g_len - row] != dna[:, d_len - used]).view(np.uint8) if row and used else None
            for gaps in range(abs(surplus), max_gaps + 1):
                options = []
                if differs is not None and (gaps, surplus) in above:
                    options.append(above[gaps, surplus] + differs)
                if (gaps - 1, surplus - 1) in here:
                    options.append(here[gaps - 1, surplus - 1] + np.uint8(1))
                if row and (gaps - 1, surplus + 1) in above:
                    options.append(above[gaps - 1, surplus + 1] + np.uint8(1))
                best = options[0] if options else np.zeros(len(alive), dtype=np.uint8)
                for other in options[1:]:
                    best = np.minimum(best, other)
                here[gaps, surplus] = best
    out = {}
    for surplus in range(-max_gaps, max_gaps + 1):
        if (max_gaps, surplus) in here:
            out[surplus] = np.full(n, 100, np.uint8)
            out[surplus][alive] = here[max_gaps, surplus]
    return out
