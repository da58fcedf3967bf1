"""Passages of held-out items in a large corpus, whole or with a few edits.

Texts are reduced to what a reader sees: letters and digits without case,
accents, width, markup and invisible characters, joined without spaces, with the
places where a word begins kept beside them (a line end inside or between words
may be one or not). A passage is ``min_words`` successive words of an item.

By the q-gram lemma, a passage of L characters within k edits of a stretch of a
document shares at least L - q + 1 - k * q of its q-grams with it, all within
k diagonals of each other. Shared q-grams are counted in overlapping bands of
diagonals; bands that meet the bound for an item's easiest passage are looked at
passage by passage (distinct places of the item, within the band), and every
passage that meets its own bound is verified by banded alignment, which gives
its edit distance to the best stretch. Passages without an edit are compared
once more as words. Nothing but these steps decides.

The items are the stated query set: they are indexed in blocks of bounded size,
one of which is broadcast at a time, and every document meets every block, whole.

Defined cases: a null or empty text holds nothing; an item shorter than
``min_words`` words can't be found; a passage too short for the bound gets a
smaller budget, (L - q) // q edits, and one shorter than q none; equal documents
and equal items each give their own rows; a pair is reported once, with its
fewest edits; very long texts are searched whole; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.tokens import spread
from tidemark.session import work_folder

#: Length of a q-gram, edits allowed in a passage, width of a diagonal band (at least 2 * EDITS + 2).
Q, EDITS, BAND = 8, 2, 8
#: Characters of items in one broadcast block (about 60 bytes of index each).
BLOCK_CHARS = 1_000_000
#: Characters of documents that are handled at once (a longer text by itself).
CHUNK_CHARS = 2_000_000
#: Passages that are aligned at once.
ALIGN_ROWS = 4_000

_INLINE = regex.compile(r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", regex.I)
_TAG = regex.compile(r"</?[a-zA-Z!][^<>]*>|<!--.*?-->", regex.S)
_LINK = regex.compile(r"!?\[([^\[\]]*)\]\((?:[^()\s]*)\)")
_HIDDEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_INNER = regex.compile(r"(?<=[\p{L}\p{N}])[*~`]+(?=[\p{L}\p{N}])")
#: Letters that have no decomposition but are read as another letter with a stroke or as two letters.
_FOLD = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})
_LETTER, _SPACE, _END, _HYPHEN = 1, 2, 4, 8


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What every code point is: a letter or digit, a blank, a line end, a hyphen."""
    kinds = np.zeros(0x110000, np.uint8)
    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000], np.int64)
    every = "".join(map(chr, points.tolist()))
    for flag, pattern in ((_LETTER, r"[\p{L}\p{N}]+"), (_SPACE, r"\s+"), (_END, r"[\n\r\x0b\x0c\x85\u2028\u2029]+"), (_HYPHEN, r"[-\u2010\u2011\u00ac]+")):
        for m in regex.finditer(pattern, every):
            kinds[points[m.start() : m.end()]] |= flag
    return kinds


def shown(text: str) -> str:
    """The text without what a reader doesn't see; letters in one form."""
    s = text
    if "&" in s:
        s = html.unescape(s)
    if "<" in s:
        s = _TAG.sub(" ", _INLINE.sub("", s))
    if "](" in s:
        s = _LINK.sub(r"\1", s)
    if not s.isascii():
        s = _HIDDEN.sub("", unicodedata.normalize("NFKD", s.casefold())).lower().translate(_FOLD)
    else:
        s = s.lower()
    if "*" in s or "~" in s or "`" in s:
        s = _INNER.sub("", s)
    return s


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Flat:
    """Shown texts one behind the other: their letters, where each text begins, and where words begin for certain or perhaps."""

    def __init__(self, texts: list[str]):
        codes = _codes("\0".join(texts)) if texts else np.empty(0, np.uint32)
        kinds = _kinds()[codes]
        at = np.flatnonzero(kinds & _LETTER)
        self.letters = codes[at]
        borders = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.starts = np.searchsorted(at, borders)  # one more than there are texts: the end of the last
        self.starts[-1] = len(at)
        n = len(at)
        may, certain = np.ones(n + 1, bool), np.ones(n + 1, bool)
        if n:
            may[1:n] = at[1:] != at[:-1] + 1
            gap = np.flatnonzero(may[1:n]) + 1  # words with something before them
            lo, hi = at[gap - 1] + 1, at[gap]
            count = lambda flag: np.concatenate([[0], np.cumsum((kinds & flag) > 0)])
            ends, blanks = count(_END), count(_SPACE)
            parted = ((kinds[lo] & _HYPHEN) > 0) & (hi - lo > 1) & (blanks[hi] - blanks[lo + 1] == hi - lo - 1)
            certain[1:n] = may[1:n]
            certain[gap[(ends[hi] > ends[lo]) | parted]] = False
            inner = self.starts[(self.starts > 0) & (self.starts < n)]
            may[inner] = certain[inner] = True
        self.may, self.certain = may, certain

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def visible_words(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text as a reader sees them, and of each whether a line end lies before it (so that it may continue the one before)."""
    flat = Flat([shown(text)])
    first = np.flatnonzero(flat.may)
    s = flat.letters.tobytes().decode("utf-32-le", "surrogatepass")
    return [s[a:b] for a, b in zip(first, first[1:])], [not flat.certain[a] for a in first[:-1]]


def _grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all q-grams."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(Q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


class ItemIndex:
    """The q-grams, word starts and passages of one block of items."""

    BITS = 22

    def __init__(self, ids: list, texts: list[str | None], min_words: int):
        self.min_words, self.ids, self.codes, self.first = min_words, [], [], []
        a, b, of, hashes, items, places = [], [], [], [], [], []
        for i, text in zip(ids, texts):
            flat = Flat([shown(text or "")])
            at = np.flatnonzero(flat.may)  # word starts and the end
            if len(at) - 1 < min_words:
                continue
            k = len(self.ids)
            self.ids.append(i)
            self.codes.append(flat.letters)
            self.first.append(flat.may)
            a.append(at[: len(at) - min_words])
            b.append(at[min_words:])
            of.append(np.full(len(at) - min_words, k, np.int64))
            h = _grams(flat.letters)
            hashes.append(h)
            items.append(np.full(len(h), k, np.int64))
            places.append(np.arange(len(h), dtype=np.int64))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        #: passages: the item they are of, where they begin and end, their budget of edits and their bound of shared q-grams
        self.of, self.a, self.b = join(of, np.int64), join(a, np.int64), join(b, np.int64)
        length = self.b - self.a
        self.budget = np.clip((length - Q) // Q, 0, EDITS)
        self.bound = length - Q + 1 - self.budget * Q
        self.tiny = np.flatnonzero(length < Q)
        self.begin_of = np.searchsorted(self.of, np.arange(len(self.ids) + 1))
        usable = np.where(length < Q, np.iinfo(np.int64).max, self.bound)
        self.needed = np.minimum.reduceat(usable, self.begin_of[:-1]) if len(self.ids) else np.empty(0, np.int64)
        flat_hash, order = join(hashes, np.uint64), None
        order = np.argsort(flat_hash, kind="stable")
        self.item, self.place = join(items, np.int64)[order], join(places, np.int64)[order]
        self.hash, self.begin, self.count = np.unique(flat_hash[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - self.BITS)).astype(np.int64)] = True


def _hits(index: ItemIndex, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every shared q-gram as (pair of document and item, place in the item, diagonal); pairs with fewer than any passage of the item needs are left out."""
    none = np.empty(0, np.int64)
    h = _grams(flat.letters)
    at = np.flatnonzero(index.seen[(h >> np.uint64(64 - index.BITS)).astype(np.int64)])
    if not len(at) or not len(index.hash):
        return none, none, none
    slot = np.minimum(np.searchsorted(index.hash, h[at]), len(index.hash) - 1)
    doc = flat.doc(at)
    hit = (index.hash[slot] == h[at]) & (at + Q <= flat.starts[doc + 1])  # no q-gram reaches over the end of a text
    at, slot, doc = at[hit], slot[hit], doc[hit]
    times = index.count[slot]
    entry = np.repeat(index.begin[slot] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    item, place = index.item[entry], index.place[entry]
    at, doc = np.repeat(at, times), np.repeat(doc, times)
    pair = doc * len(index.ids) + item
    _, which, n = np.unique(pair, return_inverse=True, return_counts=True)
    enough = n[which] >= index.needed[item]
    return pair[enough], place[enough], (at - flat.starts[doc] - place)[enough]


def _regions(index: ItemIndex, pair: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Rows (pair, lowest diagonal of the band, passage, shared q-grams above the bound) of the passages that meet their bound within a band."""
    if not len(pair):
        return np.empty((0, 4), np.int64)
    pairs, which = np.unique(pair, return_inverse=True)
    wide, out = int(index.b.max()) + 1, []
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        least, many = int(band.min()), int(band.max() - band.min()) + 1
        if len(pairs) * many * wide >= 1 << 62:
            raise OverflowError("too many documents, items and diagonals at once: lower CHUNK_CHARS or BLOCK_CHARS")
        # one number for pair, band and place, so that a plain sort leaves the distinct places of every band together
        keys = np.sort((which * many + band - least) * wide + place)
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        group = keys // wide
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        n, group = np.diff(np.concatenate([first, [len(keys)]])), group[first]
        item = pairs[group // many] % len(index.ids)
        enough = n >= index.needed[item]
        group, item = group[enough], item[enough]
        if not len(group):
            continue
        # every passage of the item against the places of the band: two searches in the sorted numbers
        per = index.begin_of[item + 1] - index.begin_of[item]
        run = np.repeat(group, per)
        passage = np.repeat(index.begin_of[item] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
        a, b = index.a[passage], index.b[passage]
        found = np.searchsorted(keys, run * wide + np.maximum(b - Q, a), side="right") - np.searchsorted(keys, run * wide + a, side="left")
        more = found - index.bound[passage]
        ok = (more >= 0) & (b - a >= Q)
        out.append(np.stack([pairs[run[ok] // many], (run[ok] % many + least) * BAND - shift, passage[ok], more[ok]], 1))
    return np.concatenate(out) if out else np.empty((0, 4), np.int64)


def _aligned(index: ItemIndex, flat: Flat, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each region the edit distance of its passage to the best stretch of the document within the band, and the diagonal on which it ends."""
    width = BAND + 2 * EDITS
    passage, doc = rows[:, 2], rows[:, 0] // len(index.ids)
    length, low = index.b[passage] - index.a[passage], rows[:, 1] - EDITS
    longest = int(length.max())
    want = np.zeros((len(rows), longest), np.uint32)
    for r, (k, n) in enumerate(zip(passage.tolist(), length.tolist())):
        a = index.a[k]
        want[r, :n] = index.codes[index.of[k]][a : a + n]
    begin, end = flat.starts[doc], flat.starts[doc + 1]
    where = (begin + index.a[passage] + low)[:, None] + np.arange(longest + width)
    inside = (where >= begin[:, None]) & (where < end[:, None])
    strip = np.where(inside, flat.letters[np.clip(where, 0, len(flat.letters) - 1)], 0xFFFFFFFF)
    # rows by length, so that those that are done lie behind; a cost above the budget needn't be exact
    order = np.argsort(-length, kind="stable")
    strip, want, length = strip[order], want[order], length[order]
    cost = np.zeros((width, len(rows)), np.int16)
    strip, want = np.ascontiguousarray(strip.T), np.ascontiguousarray(want.T)
    live = np.searchsorted(-length, -np.arange(longest), side="left")
    for i in range(longest):
        m = int(live[i])
        now = cost[:, :m] + (strip[i : i + width, :m] != want[i, :m])
        np.minimum(now[:-1], cost[1:, :m] + 1, out=now[:-1])  # a character of the passage without counterpart
        for j in range(1, width):  # characters of the document without counterpart
            np.minimum(now[j], now[j - 1] + 1, out=now[j])
        cost[:, :m] = now
    back = np.empty(len(rows), np.int64)
    back[order] = np.arange(len(rows))
    cost = cost.T[back]
    best = cost.argmin(1)
    return cost[np.arange(len(rows)), best], low + best


def _same_words(index: ItemIndex, flat: Flat, doc: int, k: int, diagonal: int) -> bool:
    """Whether a passage that stands on a diagonal letter by letter stands there word by word."""
    a, b = int(index.a[k]), int(index.b[k])
    x = int(flat.starts[doc]) + a + diagonal
    if x < flat.starts[doc] or x + b - a > flat.starts[doc + 1]:
        return False
    first, here = index.first[index.of[k]][a:b], slice(x, x + b - a)
    same = (flat.letters[here] == index.codes[index.of[k]][a:b]).all()
    return bool(same and (~first | flat.may[here]).all() and (~flat.certain[here] | first).all() and flat.may[x + b - a])


def _anywhere(index: ItemIndex, flat: Flat, doc: int, region: np.ndarray, diagonal: int) -> bool:
    """Whether a region's passage stands word by word on the given diagonal, or on another one of its band."""
    k, low = int(region[2]), int(region[1])
    if _same_words(index, flat, doc, k, diagonal):
        return True
    return any(_same_words(index, flat, doc, k, d) for d in range(low - EDITS, low + BAND + EDITS) if d != diagonal)


def leaks(index: ItemIndex, texts: list[str]) -> list[tuple[int, int, int, bool]]:
    """(position of the document, position of the item, fewest edits, whether word by word) for every leak in a list of shown texts."""
    if not index.ids:
        return []
    flat, n = Flat(texts), len(index.ids)
    best: dict[int, int] = {}
    exact: set[int] = set()

    def verify(rows: np.ndarray) -> None:
        for lo in range(0, len(rows), ALIGN_ROWS):
            part = rows[lo : lo + ALIGN_ROWS]
            cost, diagonal = _aligned(index, flat, part)
            for i in np.flatnonzero(cost <= index.budget[part[:, 2]]).tolist():
                pair, c = int(part[i, 0]), int(cost[i])
                best[pair] = min(c, best.get(pair, c))
                if c == 0 and pair not in exact and _anywhere(index, flat, pair // n, part[i], int(diagonal[i])):
                    exact.add(pair)

    # of each pair the most promising region first: where that shows the passage word by word, nothing can be better
    rows = _regions(index, *_hits(index, flat))
    rows = rows[np.lexsort((-rows[:, 3], rows[:, 0]))]
    head = np.ones(len(rows), bool)
    head[1:] = rows[1:, 0] != rows[:-1, 0]
    verify(rows[head])
    rest = rows[~head]
    verify(rest[~np.isin(rest[:, 0], list(exact))])
    for k in index.tiny.tolist():  # a passage shorter than a q-gram shares none: it is looked for as it stands
        want = index.codes[index.of[k]][index.a[k] : index.b[k]].tobytes()
        blob, at = flat.letters.tobytes(), -4
        while (at := blob.find(want, at + 4)) >= 0:
            if at % 4:
                at -= at % 4
                continue
            doc = int(flat.doc(np.array([at // 4]))[0])
            pair, d = doc * n + int(index.of[k]), at // 4 - int(flat.starts[doc]) - int(index.a[k])
            if at // 4 + int(index.b[k] - index.a[k]) <= flat.starts[doc + 1]:
                best[pair] = 0
                if _same_words(index, flat, doc, k, d):
                    exact.add(pair)
    return [(p // n, p % n, c, p in exact) for p, c in sorted(best.items())]


def chunks(sizes: pd.Series) -> pd.Series:
    """A number for each text, the same for neighbours of CHUNK_CHARS together."""
    return sizes.cumsum() // CHUNK_CHARS


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12) -> DataFrame:
    """One row per document and item of which it shows a passage: ids, edits (the fewest, EDITS at most), exact (min_words successive words, none edited)."""
    spark = docs.sparkSession
    queries = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    chars = queries.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    slim = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null"))
    kinds = dict(docs.select(doc_id).dtypes) | dict(items.select(item_id).dtypes)
    schema = f"{item_id} {kinds[item_id]}, {doc_id} {kinds[doc_id]}, edits int, exact boolean"
    if blocks > 1:  # the corpus is brought to its shown form once, for all blocks
        at = work_folder(spark, "shown")

        def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"d": batch["d"], "t": [shown(t) for t in batch["t"]]})

        slim.mapInPandas(show, f"d {kinds[doc_id]}, t string").write.parquet(at)
        slim = spread(spark.read.parquet(at))
    parts = []
    for b in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        rows = block.orderBy("i").collect()  # about BLOCK_CHARS characters
        shared = spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], min_words))

        def search(batches: Iterator[pd.DataFrame], shared=shared, ready=blocks > 1) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                for _, part in batch.groupby(chunks(batch["t"].str.len()), sort=False):
                    ids = part["d"].tolist()
                    found = leaks(index, [t if ready else shown(t) for t in part["t"]])
                    yield pd.DataFrame({item_id: [index.ids[k] for _, k, _, _ in found], doc_id: [ids[d] for d, _, _, _ in found], "edits": [c for _, _, c, _ in found], "exact": [x for *_, x in found]})

        found = slim.mapInPandas(search, schema)
        if blocks == 1:
            return found
        parts.append(work_folder(spark, "leaks"))  # one block's index is alive at a time
        found.write.parquet(parts[-1])
        shared.destroy()
    return spark.read.schema(schema).parquet(*parts)
