"""Texts cut off by field limits or in transfer, and how often each source truncates.

Near-copies come first. A text that does not close a sentence is held against the copies that go
on where it ends. Copies that begin alike meet by their first five-word shingle and a rolling hash
of the beginning, however much was cut; edited copies meet by five-word shingles and min-hash bands
and are aligned word by word from the start. The text whose alignment ends within a word or
sentence of the longer copy was cut. Texts without such a copy are scored by closing terminality:
from all texts, how often the text's last words (three, two, one; names as a class) stand at an
end, and how often a sentence ends after them. A closing word that is hardly seen inside a text but
begins the word that usually follows the same two words is a fragment. In a large table cuts repeat,
so that a closing is no habit for being seen often: one that mostly follows words after which hardly
any text or sentence ends with the next word is a cut. Sources that close sentences
without punctuation are recognised by their own texts and judged by sentence ends; all others need
a closing that is a habit. Texts are cut into words once; all else works on the words' hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

_CJK = "　-鿿"
_TOKEN = re.compile(rf"[^\W\d_{_CJK}]+|\d+|[{_CJK}＀-￯]|[^\w\s]|_")
#: What may stand after a cut: always a sign of one.
_CUT_MARK = re.compile(r"(?:\(more\)|\[\.\.\.\]|\[…\]|Read more|�|<[^<>]{0,40}|&[#\w]{0,8}|\\u?[0-9a-fA-F]{0,4})\s*$")
#: A text that ends inside an open tag or bracket (smileys aside).
_OPEN = re.compile(r"(?:<\w{1,10}>[^<>]{0,20}|(?<![:;=\-\w])\([^()]{0,60})$")
#: Dots that may be a cut or a style.
_DOTS = re.compile(r"(?:…|\.\.\.|&#8230;|&hellip;)\s*$")
_DOTS_AND_SPACE = re.compile(r"(?:\s|…|\.\.\.|&#8230;|&hellip;)+$")
_SIGNED = re.compile(r"\n[ \t]*(?:--|—|–)[ \t]*\S[^\n]{0,80}$")
_CLOSED = re.compile(r"[.!?。！？؟](?:[\"'”’»)\]」』]|\s)*$")
_LONE_DOT = re.compile(r"(?<!\w)(\w+)\.\s*$")
_ENDS = frozenset(".!?。！？…;|")
#: Rates from which a closing counts as a habit (strict sources), as an end or a sentence end (lenient ones).
HABIT, LENIENT_END, LENIENT_SENTENCE = 0.3, 0.02, 0.1
#: A closing word seen this often inside texts, and at an end or before a sentence end at a lower rate than this, ends no sentence.
OFTEN_SEEN, NEVER_LAST = 50, 0.01
#: Texts a rate must rest on besides the judged one; shares of a source's texts that make it lenient.
LEAST_SEEN, LENIENT_SHARE, OPEN_SHARE = 3, 0.03, 0.5
#: Inside texts a fragment is at most so often seen as the longer words in its place.
FRAGMENT_INSIDE = 0.001
#: Words seen this often, after which a text or a sentence ends with the next word at a lower rate than this, lead to no end; a
#: closing of at least so many texts of which this share is led to no end is a cut, unless an end is led to and at least this
#: share of the words in its place are the closing.
LEAD_SEEN, LEAD_END, LED_TEXTS, LED_SHARE, IN_PLACE = 100, 0.05, 10, 0.5, 0.01
SHINGLE, BANDS, BAND_ROWS = 5, 8, 4
#: How far before a text's last word the shingle may end by which edited copies are looked up; the share of its words that may be edited.
TAILS, EDITED = (0, 3, 6), 0.1
#: The share of its words from which on an edited near-copy (similarity 0.8) may go on after the cut one.
TAIL_FROM = 0.8
#: Salts of a beginning that many texts share.
SALTS = 16


@lru_cache(maxsize=200_000)
def _h(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_ENDERS = np.array([_h(t) for t in _ENDS], np.int64)


def read(text: str) -> tuple[list[str], list[str], bool, bool, bool]:
    """Tokens (lower case, numbers as 0), the same with names as one class, and whether the text has a
    cut mark, ends in dots, is closed by sentence punctuation."""
    text = _SIGNED.sub("", text)
    mark, dots = _CUT_MARK.search(text[-200:]), bool(_DOTS.search(text[-200:]))
    hard = bool(mark)
    if mark and _TOKEN.search(text[: max(len(text) - 200, 0) + mark.start()]):  # else the mark would follow the cut word in the statistics
        text = text[: max(len(text) - 200, 0) + mark.start()]
    if dots or hard:
        text = text[:-2000] + _DOTS_AND_SPACE.sub("", text[-2000:])
    hard = hard or bool(_OPEN.search(text[-100:].rstrip()))
    raw = _TOKEN.findall(text)
    low = ["0" if t.isdigit() else t.lower() for t in raw]
    return low, ["Xx" if t[0].isupper() and t[1:].islower() else w for t, w in zip(raw, low, strict=True)], hard, dots, bool(_CLOSED.search(text[-200:]))


def _mix(*parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), 0x51ED270B, np.uint64)
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h.astype(np.int64)


def _keys(low: np.ndarray, names: np.ndarray, start: np.ndarray) -> dict[int, np.ndarray]:
    """Context keys of every position: the last 1, 2, 3 tokens, and 4: the last 3 with names as a class.
    `start` is the position of the token's text begin; tokens before it are empty."""
    at = np.arange(len(low))
    back = lambda x, k: np.where(at - k >= start, x[np.maximum(at - k, 0)], 0)
    one = np.ones(len(low), np.int64)
    return {1: _mix(one, low), 2: _mix(one * 2, back(low, 1), low), 3: _mix(one * 3, back(low, 2), back(low, 1), low), 4: _mix(one * 4, back(names, 2), back(names, 1), names)}


_WORDS = "tokens array<string>, low array<bigint>, names array<bigint>"
_READ = f"id binary, source string, n int, hard boolean, dots boolean, closed boolean, lone boolean, number boolean, word string, k1 bigint, k2 bigint, k3 bigint, k4 bigint, l2 bigint, l3 bigint, before bigint, before1 bigint, first bigint, buckets array<bigint>, {_WORDS}"
#: Odd factor of the positional hash of a beginning.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _lists(n: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(np.append(0, np.cumsum(n)), values).cast(pa.list_(values.type))


def _unlist(col: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lengths of the lists, their values in a row, and for each value the position of its list's begin."""
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n, col.flatten(), np.repeat(np.cumsum(n) - n, n)


def _shingles(low: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in a row, and how many each text has."""
    at = np.flatnonzero(np.arange(len(low)) - start + SHINGLE <= np.repeat(n, n))
    return _mix(*(low[at + k] for k in range(SHINGLE))), np.maximum(n - SHINGLE + 1, 0)


def _min_hashes(shingles: np.ndarray, many: np.ndarray) -> list[list[int]]:
    """Band buckets of each text; none for texts without a shingle."""
    rng = np.random.default_rng(5)
    a = (rng.integers(1, 2**62, BANDS * BAND_ROWS) * 2 + 1).astype(np.uint64)
    full = np.flatnonzero(many)
    out: list[list[int]] = [[] for _ in many]
    if not len(full):
        return out
    s, starts = shingles.astype(np.uint64), (np.cumsum(many) - many)[full]
    with np.errstate(over="ignore"):
        least = np.stack([np.minimum.reduceat((s * c) ^ (s >> np.uint64(29)), starts) for c in a], 1).reshape(len(full), BANDS, BAND_ROWS).astype(np.int64)
    bands = np.stack([_mix(np.full(len(full), band), *(least[:, band, r] for r in range(BAND_ROWS))) for band in range(BANDS)], 1)
    for i, row in zip(full.tolist(), bands.tolist(), strict=True):
        out[i] = row
    return out


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, source, text) -> _READ: the words of each text, its closing, the keys of its last context, its first shingle and band buckets."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            x = b.slice(lo, 2000)
            texts = x.column(2).to_pylist()
            docs = [read(t) for t in texts]
            n = np.array([len(d[0]) for d in docs])
            low = np.array([_h(w) for d in docs for w in d[0]], np.int64)
            names = np.array([_h(w) for d in docs for w in d[1]], np.int64)
            start = np.repeat(np.cumsum(n) - n, n)
            full, last = n > 0, np.cumsum(n) - 1
            at = last[full]
            keys = _keys(low, names, start)
            ks = [np.zeros(len(docs), np.int64) for _ in range(4)]
            for k, out in zip((1, 2, 3, 4), ks, strict=True):
                out[full] = keys[k][at] if len(at) else 0
            leads = [np.zeros(len(docs), np.int64) for _ in range(2)]
            led = np.flatnonzero(n >= 2)
            led = led[~np.isin(low[last[led] - 1], _ENDERS)]  # after a sentence's end any closing may stand
            for k, out in zip((2, 3), leads, strict=True):
                out[led] = keys[k][last[led] - 1]
            before, before1 = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            two, some = np.flatnonzero(n >= 3), np.flatnonzero(n >= 2)
            before[two] = _mix(np.full(len(two), 2), low[last[two] - 2], low[last[two] - 1])
            before1[some] = _mix(np.full(len(some), 1), low[last[some] - 1])
            shingles, many = _shingles(low, start, n)
            first = np.zeros(len(docs), np.int64)
            first[many > 0] = shingles[(np.cumsum(many) - many)[many > 0]]
            dot = [_LONE_DOT.search(t[-60:]) if d[4] else None for t, d in zip(texts, docs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    x.column(0), x.column(1), pa.array(n.astype(np.int32)), *(pa.array([d[i] for d in docs], pa.bool_()) for i in (2, 3, 4)),
                    pa.array([bool(m) and len(m[1]) == 1 and m[1].isupper() for m in dot], pa.bool_()), pa.array([bool(m) and m[1].isdigit() for m in dot], pa.bool_()),
                    pa.array([d[0][-1] if d[0] and d[0][-1].isalpha() else "" for d in docs], pa.string()), *(pa.array(k) for k in (*ks, *leads)), pa.array(before), pa.array(before1), pa.array(first),
                    pa.array(_min_hashes(shingles, many), pa.list_(pa.int64())), _lists(n, pa.array([w for d in docs for w in d[0]], pa.string())), _lists(n, pa.array(low)), _lists(n, pa.array(names)),
                ],
                [c.split()[0] for c in _READ.split(", ")],
            )


_COUNTS = ("n", "last", "ends", "sentence", "next_ends", "next_sentence")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (low, names, hard, dots) -> _COUNTS: how often a context occurs, is last of a text, is an end, is followed by a sentence end,
    and how often the next word is an end or followed by a sentence end."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            x = b.slice(lo, 2000)
            n, low, start = _unlist(x.column(0))
            low, names = low.to_numpy(zero_copy_only=False), x.column(1).flatten().to_numpy(zero_copy_only=False)
            if not len(low):
                continue
            final = np.zeros(len(low), bool)
            final[np.cumsum(n)[n > 0] - 1] = True
            hard, dots = (np.repeat(x.column(i).to_numpy(zero_copy_only=False).astype(bool), n) for i in (2, 3))
            ended = final & ~hard
            sentence = np.where(final, ended & dots, np.isin(np.append(low[1:], 0), _ENDERS))
            next_ends, next_sentence = (np.where(final, False, np.append(c[1:], False)) for c in (ended, sentence))
            u, inv = np.unique(np.concatenate(list(_keys(low, names, start).values())), return_inverse=True)
            cols = [np.bincount(inv, np.tile(c.astype(float), 4), len(u)).astype(np.int64) for c in (np.ones(len(low)), final, ended, sentence, next_ends, next_sentence)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (u, *cols)], ["key", *_COUNTS])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tokens, low) -> (before, next, n, last): the words that follow two words or one, and how often they were last of their text."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            x = b.slice(lo, 2000)
            n, low, start = _unlist(x.column(1))
            low, words = low.to_numpy(zero_copy_only=False), x.column(0).flatten()
            if not len(low):
                continue
            at, alpha = np.arange(len(low)), pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
            final = np.zeros(len(low), bool)
            final[np.cumsum(n)[n > 0] - 1] = True
            two, one = np.flatnonzero((at - 2 >= start) & alpha), np.flatnonzero((at - 1 >= start) & alpha)
            key = np.concatenate([_mix(np.full(len(two), 2), low[two - 2], low[two - 1]), _mix(np.full(len(one), 1), low[one - 1])])
            ok = np.concatenate([two, one])
            _, first, inv = np.unique(_mix(key, low[ok]), return_index=True, return_inverse=True)
            count, last = (np.bincount(inv, w, len(first)).astype(np.int64) for w in (np.ones(len(ok)), final[ok].astype(float)))
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), words.take(pa.array(ok[first])), pa.array(count), pa.array(last)], ["before", "next", "n", "last"])


def _beginnings(low: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each text's beginning up to and with every word, in one pass: words weighed by powers of _BASE."""
    at = np.arange(len(low)) - start
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(at.max(initial=0)) + 1, _BASE))
        total = np.cumsum((low.astype(np.uint64) ^ (low.astype(np.uint64) >> np.uint64(31))) * powers[at])
        return (total - np.where(start > 0, total[np.maximum(start, 1) - 1], np.uint64(0))).astype(np.int64)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, first, low, tokens) of texts of more than SHINGLE words -> (id, first, at, begin, last): the hash of all words but the last."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            x = b.slice(lo, 2000)
            n, low, start = _unlist(x.column(2))
            if not len(n):
                continue
            end = np.cumsum(n) - 1
            begin = _beginnings(low.to_numpy(zero_copy_only=False), start)[end - 1]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array((n - 1).astype(np.int32)), pa.array(begin), x.column(3).flatten().take(pa.array(end))], ["id", "first", "at", "begin", "last"])


def _next_words(words: pa.Array, at: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The words at the positions and those after them ("" at the text's end)."""
    after = words.take(pa.array(np.minimum(at + 1, len(words) - 1)))
    return words.take(pa.array(at)), pc.if_else(pa.array(at < end), after, pa.scalar("", words.type))


def _goings_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (first, low, tokens, lengths) -> (first, at, begin, next, after): the beginnings of the asked lengths and the words that follow them."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            x = b.slice(lo, 2000)
            n, low, start = _unlist(x.column(1))
            many, lengths, _ = _unlist(x.column(3))
            lengths = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), many)
            ok = lengths < n[row]
            row, lengths = row[ok], lengths[ok]
            if not len(row):
                continue
            at = (np.cumsum(n) - n)[row] + lengths
            begin = _beginnings(low.to_numpy(zero_copy_only=False), start)[at - 1]
            following, after = _next_words(x.column(2).flatten(), at, (np.cumsum(n) - 1)[row])
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(row)), pa.array(lengths.astype(np.int32)), pa.array(begin), following, after], ["first", "at", "begin", "next", "after"])


def _tails(asked: bool):  # noqa: ANN202
    """Rows (id, low, tokens) -> the shingles that end 0, 3 or 6 words (TAILS) before a word, with that word's first letter:
    of the last word (id, last, tail), or of every word from TAIL_FROM of the text on, with the hash of the beginning before it (copy, at, begin, tail, next, after)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                x = b.slice(lo, 2000)
                n, low, start = _unlist(x.column(1))
                low, words = low.to_numpy(zero_copy_only=False), x.column(2).flatten()
                if not len(low):
                    continue
                letter = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
                letter = np.array([_h(c) for c in letter.dictionary.to_pylist()], np.int64)[letter.indices.to_numpy(zero_copy_only=False)]
                row, size, end = np.repeat(np.arange(len(n)), n), np.repeat(n, n), np.repeat(np.cumsum(n) - 1, n)
                at, begin = np.arange(len(low)), _beginnings(low, start)
                wanted = at == end if asked else (at - start >= np.floor(size * TAIL_FROM) - 1) & (at < end)
                for back in TAILS:
                    j = np.flatnonzero(wanted & (at - start >= SHINGLE + back))
                    if not len(j):
                        continue
                    tail = pa.array(_mix(np.full(len(j), back), *(low[j - back - SHINGLE + k] for k in range(SHINGLE)), letter[j]))
                    ids = x.column(0).take(pa.array(row[j]))
                    if asked:
                        yield pa.RecordBatch.from_arrays([ids, words.take(pa.array(j)), tail], ["id", "last", "tail"])
                    else:
                        yield pa.RecordBatch.from_arrays([ids, pa.array((j - start[j]).astype(np.int32)), pa.array(begin[j - 1]), tail, *_next_words(words, j, end[j])], ["copy", "at", "begin", "tail", "next", "after"])

    return run


def most_edits(size: Column) -> Column:
    """How many words may be put in or left out in a text of `size` words."""
    return F.greatest(F.lit(2), (size * (2 * EDITED)).cast("int"))


def edits(a: list[str], b: list[str], most: int) -> int:
    """Words put in or left out between two texts (a changed word is both), by Myers' greedy alignment; most + 1 if there are more than `most`."""
    n, m, far = len(a), len(b), {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            far[k] = x
            if k == n - m and x >= n:
                return d
    return most + 1


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, body, begin) -> (id) where the body and the beginning of the longer copy align."""
    for b in batches:
        ok = []
        for x, y in zip(b.column(1), b.column(2), strict=True):
            x, y = (z.values.to_numpy(zero_copy_only=False) for z in (x, y))
            most = max(2, int(2 * EDITED * len(x)))
            for step in (1, -1):  # what both share at either end
                m = min(len(x), len(y))
                differ = np.flatnonzero(x[::step][:m] != y[::step][:m])
                k = int(differ[0]) if len(differ) else m
                x, y = x[::step][k:][::step], y[::step][k:][::step]
            ok.append(edits(x.tolist(), y.tolist(), most) <= most)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_()))], ["id"])


def read_all(texts: DataFrame) -> DataFrame:
    """The texts (id, source, text) cut into words, once, with all that depends on one text alone (_READ); in the checkpoint folder."""
    return cut(texts.mapInArrow(_read_texts, _READ))


def cut_copies(x: DataFrame) -> DataFrame:
    """(id) of the open texts of `read_all` that a copy continues within a word or a sentence.

    Exact beginnings, of any share of the longer copy: an open text's words but the last are looked
    up by hash among the beginnings of the texts with the same first shingle, which are taken at
    the lengths asked for only and reduced to their distinct continuations, so that no pairs of
    texts are formed. Edited beginnings: texts that share a min-hash band and a shingle near the
    cut; all longer copies of a bucket with that shingle are aligned from the start, equal beginnings
    once, unless their length alone asks for too many edits.
    """
    open_ = ~F.col("closed") | F.col("dots")
    long_enough = x.filter(F.col("n") > SHINGLE)
    short = long_enough.filter(open_).select("id", "first", "low", "tokens").mapInArrow(_bodies, "id binary, first bigint, at int, begin bigint, last string")
    lengths = short.groupBy("first").agg(F.collect_set("at").alias("lengths"))  # distinct lengths of one beginning
    lengths = lengths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    longer = long_enough.select("first", "low", "tokens", F.pmod(F.crc32("id"), F.lit(SALTS)).cast("int").alias("salt")).join(lengths, ["first", "salt"])
    going_on = longer.select("first", "low", "tokens", "lengths").mapInArrow(_goings_on, "first bigint, at int, begin bigint, next string, after string").distinct()
    within = (F.col("next") != F.col("last")) | ((F.col("after") != "") & ~F.col("after").isin(*sorted(_ENDS), ",", "0"))
    goes_on = F.col("next").startswith(F.col("last")) & within
    exact = cut(short.join(going_on, ["first", "at", "begin"]).filter(goes_on).select("id").distinct())

    placed = x.filter(F.size("buckets") > 0).select("id", F.explode("buckets").alias("bucket"))
    busy = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
    near = cut(placed.join(busy, "bucket").groupBy("id").agg(F.collect_list("bucket").alias("near")))
    y = long_enough.select("id", "low", "tokens", "n", open_.alias("open")).join(near, "id")
    words = y.select("id", "low", "tokens")
    asked = y.filter("open").join(exact, "id", "left_anti").select("id", "low", "tokens").mapInArrow(_tails(True), "id binary, last string, tail bigint").join(near, "id")
    asked = cut(asked.join(x.select("id", (F.col("n") - 1).alias("size")), "id"))
    holds = words.mapInArrow(_tails(False), "copy binary, at int, begin bigint, tail bigint, next string, after string")
    holds = holds.join(asked.select("tail").distinct(), "tail", "left_semi").join(near.withColumnRenamed("id", "copy"), "copy").withColumn("bucket", F.explode("near"))
    # of the copies that begin alike any will do, but not the asking text itself
    holds = holds.groupBy("bucket", "tail", "next", "after", "at", "begin").agg(F.min("copy").alias("copy"), F.max("copy").alias("other"))
    pairs = asked.select("id", "last", "size", "tail", F.explode("near").alias("bucket")).join(holds, ["bucket", "tail"]).filter(goes_on & (F.abs(F.col("size") - F.col("at")) <= most_edits(F.col("size"))))
    pairs = pairs.withColumn("copy", F.when(F.col("copy") == F.col("id"), F.col("other")).otherwise(F.col("copy"))).filter("id <> copy").groupBy("id", "at", "begin").agg(F.min("copy").alias("copy")).drop("begin")
    low = x.select("id", "n", "low")
    pairs = pairs.join(low.select("id", F.slice("low", 1, F.col("n") - 1).alias("body")), "id").join(low.select(F.col("id").alias("copy"), "low"), "copy")
    edited = pairs.select("id", "body", F.slice("low", 1, F.col("at")).alias("begin")).mapInArrow(_aligned, "id binary")
    return exact.unionByName(edited).distinct()


def judge(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, kind): every text with content and the kind of its closing; `kind` starts with "cut" for truncated texts.

    Sources are compared without outer space and regardless of case; a null source is a source of
    its own. Null, empty and blank texts give no row. Rows with a null or repeated key are judged
    each for itself. Statistics rest on all distinct texts of each source, read whole: a repeated text
    counts once, as it is no more evidence of a habit. Each row has its verdict. An empty table gives an empty result;
    other columns are not read.
    """
    docs = df.select(F.col(key), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("source"), F.col(text).alias("text")).filter(F.col("text").rlike(r"(?U)\S"))
    docs = docs.withColumn("id", F.unhex(F.md5(F.concat("source", F.lit("\n"), "text"))))  # equal texts of a source are judged alike
    distinct = docs.groupBy("id").agg(F.first("source").alias("source"), F.first("text").alias("text"))
    every = read_all(distinct.select("id", "source", "text"))
    ends = every.drop("tokens", "low", "names", "first", "buckets").filter("n > 0")
    counts = every.select("low", "names", "hard", "dots").mapInArrow(_contexts, ", ".join(f"{c} bigint" for c in ("key", *_COUNTS))).groupBy("key").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    keys = ends.select("id", "hard", "dots", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(k).alias("key")) for i, k in enumerate(("k1", "k2", "k3", "k4", "l2", "l3"), 1)])).alias("k")).select("id", "hard", "dots", "k.level", "k.key")
    seen = F.col("n") - 1  # without the text itself
    own_end, own_sentence = F.when(F.col("hard"), 0).otherwise(1), F.when(~F.col("hard") & F.col("dots"), 1).otherwise(0)
    lead = F.struct((F.col("n") - F.col("last") - 1).alias("n"), F.greatest(F.col("next_ends") - own_end, F.col("next_sentence") - own_sentence).alias("ends"))  # without the text itself
    leads = [F.max(F.when((F.col("level") == i) & (lead["n"] >= LEAD_SEEN), F.struct(lead["n"].alias("n"), (lead["ends"] / lead["n"]).alias("e")))).alias(f"lead{i - 3}") for i in (5, 6)]
    found = keys.join(counts, "key").groupBy("id").agg(*leads, *[F.max(F.when(F.col("level") == i, F.struct(seen.alias("n"), F.try_divide(F.col("ends") - own_end, seen).alias("e"), F.try_divide(F.col("sentence"), seen).alias("f"), (F.col("n") - F.col("last")).alias("inside")))).alias(f"r{i}") for i in (1, 2, 3, 4)])

    def first_of(*levels: int):  # noqa: ANN202
        empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1.0).alias("e"), F.lit(-1.0).alias("f"), F.lit(0).cast("bigint").alias("inside"))
        return F.coalesce(*[F.when(F.col(f"r{i}.n") >= LEAST_SEEN, F.col(f"r{i}")) for i in levels], empty)

    found = _safe(found)
    x = cut(ends.join(found, "id", "left"))
    plain = ~F.col("hard") & ~F.col("dots")
    open_ = plain & ~F.col("closed")
    manner = x.groupBy("source").agg(
        F.sum(F.when(plain, 1).otherwise(0)).alias("texts"), F.sum(F.when(open_, 1).otherwise(0)).alias("open"), F.sum(F.when(open_ & (first_of(3, 2)["f"] >= 0.5), 1).otherwise(0)).alias("bare")
    ).select("source", ((F.col("bare") > F.col("texts") * LENIENT_SHARE) | (F.col("open") > F.col("texts") * OPEN_SHARE)).alias("lenient"))
    x = x.join(manner, "source")

    # a closing that stands where hardly any text or sentence ends
    led = F.coalesce("lead3.e", "lead2.e")
    led_to_end = F.coalesce((led >= LEAD_END) & (F.col("r3.n") >= F.col("lead2.n") * IN_PLACE), F.lit(False))
    led_away = x.filter(~F.col("hard") & (F.col("dots") | ~F.col("closed"))).groupBy("k1").agg(F.count(F.lit(1)).alias("closings"), F.count(F.when(led < LEAD_END, 1)).alias("led"))
    led_away = led_away.filter((F.col("led") >= LED_TEXTS) & (F.col("led") >= F.col("closings") * LED_SHARE)).select("k1", F.lit(True).alias("astray"))

    # a closing word that hardly ever goes on after the words before it, while a longer word of this beginning does
    open_end = x.filter(~F.col("hard") & (F.col("word") != "") & (F.col("dots") | ~F.col("closed")))
    asked = open_end.select("before", "word").unionByName(open_end.select(F.col("before1").alias("before"), "word")).filter("before <> 0").distinct()
    follow = every.select("tokens", "low").mapInArrow(_follow, "before bigint, next string, n bigint, last bigint").join(asked.select("before").distinct(), "before", "left_semi").groupBy("before", "next").agg(F.sum("n").alias("n"), F.sum("last").alias("last"))
    same = F.col("next") == F.col("word")
    fragments = cut(
        asked.join(follow, "before").filter(F.col("next").startswith(F.col("word"))).groupBy("before", "word")
        .agg(F.sum(F.when(same, F.col("last")).otherwise(0)).alias("ends"), F.sum(F.when(same, F.col("n") - F.col("last")).otherwise(0)).alias("inside"), F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("longer"))
        .filter((F.col("inside") <= F.col("longer") * FRAGMENT_INSIDE) & (F.col("longer") >= 1) & (F.col("longer") >= F.col("ends"))).select("before", "word")
    )
    copies = cut_copies(every).withColumn("copy", F.lit(True))
    x = x.join(led_away, "k1", "left")
    x = x.join(fragments.withColumn("frag2", F.lit(True)), ["before", "word"], "left").join(copies, "id", "left")
    x = x.join(fragments.select(F.col("before").alias("before1"), "word", F.lit(True).alias("frag1")), ["before1", "word"], "left")
    is_fragment = F.col("frag2").isNotNull() | F.col("frag1").isNotNull()
    strict, lenient, sentence = first_of(3, 4, 2), first_of(3, 2), first_of(3, 4, 2)
    one = F.col("r1.n") >= LEAST_SEEN
    lenient_ok = F.when(lenient["n"] > 0, (lenient["e"] >= LENIENT_END) | (lenient["f"] >= LENIENT_SENTENCE)).otherwise(one & (((F.col("r1.inside") > 0) & (F.col("r1.e") >= HABIT)) | (F.col("r1.f") >= LENIENT_SENTENCE)))  # one word tells little
    broken_number = F.col("number") & (F.col("r3.n") >= 20) & (F.col("r3.e") < 0.005)
    never_last = (F.col("word") != "") & (F.col("r1.n") >= OFTEN_SEEN) & (F.col("r1.e") < NEVER_LAST) & (F.col("r1.f") < NEVER_LAST)
    kind = (
        F.when(F.coalesce("copy", F.lit(False)) & (F.col("dots") | ~F.col("lenient") | ~lenient_ok), "cut: copy goes on")
        .when(F.col("hard"), "cut: mark")
        .when(F.col("closed") & ~F.col("dots"), F.when(F.col("lone") | F.coalesce(broken_number, F.lit(False)), "cut: dot").otherwise("closed"))
        .when(is_fragment, "cut: word")
        .when(F.coalesce(never_last, F.lit(False)), "cut: sentence")
        .when(F.col("astray").isNotNull() & ~led_to_end, "cut: sentence")
        .when(F.col("dots"), F.when((sentence["f"] >= HABIT) | (sentence["e"] >= HABIT), "dots").otherwise("cut: dots"))
        .when(F.col("lenient"), F.when(lenient_ok, "bare").otherwise("cut: sentence"))
        .otherwise(F.when(strict["e"] >= HABIT, "habit").otherwise("cut: sentence"))
    )
    verdict = x.select("id", kind.alias("kind"))
    return docs.select(key, "source", "id").join(verdict, "id").select(key, "source", "kind")


def _safe(found: DataFrame) -> DataFrame:
    """Rates over no other text are no rates."""
    for i in (1, 2, 3, 4):
        r = F.col(f"r{i}")
        found = found.withColumn(f"r{i}", F.when(r["n"] > 0, r))
    return found


def truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key): the texts that lost their end. See `judge`."""
    return judge(df, key, text, source).filter(F.col("kind").startswith("cut")).select(key)


def truncation_report(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source, texts, truncated, share) for each source."""
    j = judge(df, key, text, source)
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.when(F.col("kind").startswith("cut"), 1).otherwise(0)).alias("truncated")).withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
