"""Several values packed in one field: one value per row, in order.

A text is cut into pieces at everything that may be a delimiter; quoted spans are atomic. Whether
a delimiter really divides is decided by expectation-maximisation over the whole column: the
frequencies of values and of value forms are learned from the column's own segmentations, and a
Viterbi pass over the lattice of pieces picks the likeliest segmentation of each text. So
"Docu/Drama" stays one value where "Docu" never stands alone, and "Tamari, Vikgar; Karo, Ansten"
gives two names where single words are no names.

Frequencies are joined to the lattice as a table (they grow with the data); only the handful of
value forms (word counts and delimiters) are collected. How many pieces a value may be joined from
is told by the column itself: as many as a quoted value of at least two texts has. The frequent
values and texts of a column, a bounded number, are met by broadcast, so that no task gets all rows of one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Texts that stand for "nothing here", in lower case.
PLACEHOLDERS = frozenset(["-", "--", "---", "?", ".", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "\\n", "tba", "tbd", "unknown", "[]", "{}"])
#: Additions that follow a name after a delimiter and belong to it.
_ADDITION = re.compile(r"(?:Jr|Sr|[IVX]{1,4}|Ph\.?\s?D|M\.?D|Esq)\.?|\(.*\)", re.S)
_DELIMITER = r"(?:[,;|/\t\n\r\u3001\uff0c\uff1b]|(?<=\s)(?:and|&)(?=\s))"
_BREAK = re.compile(rf"\s*{_DELIMITER}(?:\s*{_DELIMITER})*\s*")
_CLOSED = rf"(?=\s*(?:{_DELIMITER}|(?:and|&)\s|$))"
_QUOTED = [
    (re.compile(rf'"((?:""|\\.|[^"\\])*)"{_CLOSED}', re.S), '""', '"'),
    (re.compile(rf"'((?:''|\\.|[^'\\])*)'{_CLOSED}", re.S), "''", "'"),
    (re.compile(rf"'([^,;|/]*?)'{_CLOSED}", re.S), "''", "'"),
]
_ENCLOSING = {"[": "]", "{": "}"}
#: Pieces that a value may be joined from where quoted values of the column do not show more, besides the additions that follow them.
LEAST_JOINED = 3
#: A value or text counts as frequent from one in so many on; there are no more of them than this.
FREQUENT = 500


def pieces(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, value, quoted) of the pieces of a text; none for blank and placeholder texts. Reads the text once."""
    lo, hi = 0, len(text)

    def trim() -> None:
        nonlocal lo, hi
        while lo < hi and text[lo].isspace():
            lo += 1
        while lo < hi and text[hi - 1].isspace():
            hi -= 1

    trim()
    if text[lo:hi].lower() in PLACEHOLDERS:
        return []
    while hi - lo >= 2 and _ENCLOSING.get(text[lo]) == text[hi - 1]:
        lo, hi = lo + 1, hi - 1
        trim()
    out: list[tuple[int, int, str, bool]] = []
    at = lo
    while at < hi:
        skip = _BREAK.match(text, at, hi)
        if skip and skip.end() > at:
            at = skip.end()
            continue
        if text[at].isspace():
            at += 1
            continue
        for rule, double, plain in _QUOTED if text[at] in "\"'" else ():
            m = rule.match(text, at, hi)
            if m:
                v = m[1].replace(double, plain)
                v = re.sub(r"\\([\"'\\])", r"\1", v).strip()
                if v:
                    out.append((at, m.end(), v, True))
                at = m.end()
                break
        else:
            m = _BREAK.search(text, at, hi)
            end = m.start() if m else hi
            v = text[at:end].strip()
            if v and text[at] in _ENCLOSING and _ENCLOSING[text[at]] == v[-1]:
                v = v[1:-1].strip()
            if v:
                out.append((at, end, v, False))
            at = max(end, at + 1)
    if len(out) == 1 and out[0][2].lower() in PLACEHOLDERS:
        return []
    return out


def form(value: str) -> str:
    """Word counts of the parts of a value and the delimiters between them, such as "2", "1,1" or "2,+"."""
    out = []
    for i, part in enumerate(re.split(rf"\s*({_DELIMITER})\s*", value)):
        if i % 2:
            out.append("&" if part in ("and", "&") else part)
        else:
            out.append("+" if i and _ADDITION.fullmatch(part) else str(min(4, len(part.split()))))
    return "".join(out[:7])


_SPAN = "array<struct<i:int,j:int,value:string,form:string,words:int,single:boolean,quoted:boolean>>"


def quoted_parts(text: str) -> list[int]:
    """Of how many pieces the quoted values of a text would be, were they not quoted."""
    return [len(re.split(_DELIMITER, v)) for _, _, v, quoted in pieces(text) if quoted]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, parts, texts): in how many texts of the batch a quoted value has so many pieces."""
    for b in batches:
        seen: dict[tuple[str, int], int] = {}
        for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for n in set(quoted_parts(t)):
                seen[f, n] = seen.get((f, n), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["field", "parts", "texts"])


def most_joined(texts: DataFrame) -> dict[str, int]:
    """For each field the most pieces that quoted values of at least two distinct texts (field, text) have."""
    counts = texts.filter(F.col("text").rlike("[\"']")).select("field", "text").mapInArrow(_parts, "field string, parts bigint, texts bigint").groupBy("field", "parts").agg(F.sum("texts").alias("texts"))
    return {r["field"]: r["most"] for r in counts.filter("texts > 1").groupBy("field").agg(F.max("parts").alias("most")).collect()}  # a row a field


def _lattice(most: dict[str, int]):  # noqa: ANN202
    return lambda batches: _lattices(batches, most)


def _lattices(batches: Iterator[pa.RecordBatch], most: dict[str, int]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("value", pa.string()), ("form", pa.string()), ("words", pa.int32()), ("single", pa.bool_()), ("quoted", pa.bool_())]))
    for b in batches:
        out = []
        for field, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p = pieces(text)
            joined = max(LEAST_JOINED, most.get(field, 0))
            spans = []
            for i, (start, _, v, quoted) in enumerate(p):
                spans.append({"i": i, "j": i + 1, "value": v, "form": form(v), "words": len(v.split()), "single": True, "quoted": quoted})
                if quoted:
                    continue
                inside = None
                for j in range(i + 1, len(p)):
                    kind_of = text[p[j - 1][1] : p[j][0]].strip()[:1]
                    if p[j][3] or (inside is not None and kind_of != inside):  # a value has one kind of delimiter inside
                        break
                    inside = kind_of
                    if j - i >= joined:
                        if not _ADDITION.fullmatch(p[j][2]):
                            break
                        if j + 1 < len(p) and not p[j + 1][3] and text[p[j][1] : p[j + 1][0]].strip()[:1] == inside and _ADDITION.fullmatch(p[j + 1][2]):
                            continue  # beyond that a value takes all its additions
                    v = text[start : p[j][1]].strip()
                    spans.append({"i": i, "j": j + 1, "value": v, "form": form(v), "words": len(v.split()), "single": False, "quoted": False})
            out.append(spans)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, kind)], ["field", "text", "weight", "spans"])


def best_path(spans: list[dict], least_words: int, forms: dict[str, float], total: float, fresh: float, word: float = 1e-3) -> list[dict]:
    """The likeliest segmentation: spans with `n` (their value's frequency) that follow one another without a gap.

    A value's probability mixes its frequency with that of a new value: the share `fresh` of values
    seen once in the column, times the share of its form, times `word` for each word.
    Values with fewer than `least_words` words are avoided wherever another segmentation exists.
    """
    end = max(s["j"] for s in spans)
    best: list[tuple[float, dict | None]] = [(0.0, None)] + [(-math.inf, None)] * end
    for s in sorted(spans, key=lambda s: (s["i"], s["j"])):
        base = forms.get(s["form"], 0.1 / (total + 1)) * word ** s["words"]
        score = math.log((1 - fresh) * (s["n"] or 0) / (total + 1) + fresh * base)
        if s["words"] < least_words:
            score -= 1e6
        score += best[s["i"]][0]
        if score > best[s["j"]][0]:
            best[s["j"]] = (score, s)
    out, at = [], end
    while at:
        s = best[at][1]
        out.append(s)
        at = s["i"]
    return out[::-1]


def _viterbi(least_words: dict[str, int], forms: dict[str, dict[str, float]], totals: dict[str, float], fresh: dict[str, float]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, spans = b.column(0).to_pylist(), b.column(3).to_pylist()
            chosen = [best_path(s, least_words[f], forms.get(f, {}), totals.get(f, 0.0), fresh.get(f, 0.5)) for f, s in zip(fields, spans, strict=True)]
            kind = pa.list_(pa.struct([("value", pa.string()), ("form", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([[{"value": s["value"], "form": s["form"]} for s in c] for c in chosen], kind)], ["field", "text", "weight", "chosen"])

    return run


def _forms(df: DataFrame) -> tuple[dict[str, dict[str, float]], dict[str, float]]:
    """Shares of the value forms of each field, and each field's number of values: a few hundred rows."""
    rows = df.groupBy("field", "form").agg(F.sum("weight").alias("n")).collect()
    totals: dict[str, float] = {}
    for r in rows:
        totals[r["field"]] = totals.get(r["field"], 0.0) + r["n"]
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r["field"], {})[r["form"]] = r["n"] / totals[r["field"]]
    return out, totals


def meet(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """`left` joined with a table of distinct keys and their weights: at most FREQUENT keys of a
    FREQUENT-th of all weight each go by broadcast, all others by shuffle."""
    total = right.agg(F.sum(weight)).head()[0] or 0
    frequent = F.col(weight) * FREQUENT >= total
    hot = F.broadcast(right.filter(frequent))
    warm = left.join(hot, on)
    return warm.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.filter(~frequent), on, how))


def split_packed(df: DataFrame, key: str, fields: dict[str, int], rounds: int = 20) -> DataFrame:
    """(id, field, pos, value): the values of each packed text column, one per row, pos from 1.

    `fields` maps a column to the least number of words of its values. Enclosing brackets and
    quotes, outer spaces and delimiters are dropped, doubled and escaped quotes made plain; case and
    repeats stay; blank pieces take no position. Null, blank and placeholder texts give no row. A
    row whose key is null keeps it. Equal texts are split once and alike. Empty tables give an
    empty result; columns not named are not read. Texts may be of any length. Without quotes a value
    is joined from at most `most_joined` pieces (LEAST_JOINED, where the column shows no more) and
    all additions (Jr., Ph.D.) that follow the last one. Expectation and maximisation alternate
    until no text is split otherwise than before, at most `rounds` times.
    """
    rows = None
    for f in fields:
        x = df.select(F.col(key).cast("bigint").alias("id"), F.lit(f).alias("field"), F.col(f).alias("text")).filter(F.trim("text") != "")
        rows = x if rows is None else rows.unionByName(x)
    texts = cut(rows.groupBy("field", "text").agg(F.count(F.lit(1)).alias("weight")))
    lattice = cut(texts.mapInArrow(_lattice(most_joined(texts)), f"field string, text string, weight bigint, spans {_SPAN}").filter(F.size("spans") > 0))
    plain = F.forall("spans", lambda s: s["single"])  # no delimiter to decide on
    least = F.create_map(*[F.lit(v) for kv in fields.items() for v in kv])
    known = lattice.filter(plain).select("field", "text", "weight", F.transform("spans", lambda s: F.struct(s["value"].alias("value"), s["form"].alias("form"))).alias("chosen"))
    open_ = lattice.filter(~plain)
    spans = open_.select("field", "text", "weight", F.explode("spans").alias("s")).select("field", "text", "weight", F.col("s.value").alias("value"), "s")
    # at first every piece that can be a value counts as one
    current = lattice.select("field", "weight", F.explode(F.filter("spans", lambda s: s["single"] & (s["quoted"] | (s["words"] >= least[F.col("field")])))).alias("s")).select("field", "weight", "s.value", "s.form")
    chosen, before = None, None
    for _ in range(rounds):
        counts = cut(current.groupBy("field", "value", "form").agg(F.sum("weight").alias("weight")))  # a value has one form but for a quoted one
        forms, totals = _forms(counts)
        counts = counts.groupBy("field", "value").agg(F.sum("weight").alias("n"))
        once = counts.groupBy("field").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"), F.sum("n").alias("n")).collect()  # a row a field
        fresh = {r["field"]: min(0.99, max(1e-4, r["once"] / r["n"])) for r in once}
        scored = meet(spans, counts, ["field", "value"], "n", "left").groupBy("field", "text", "weight").agg(F.collect_list(F.struct("s.i", "s.j", "value", "s.form", "s.words", "n")).alias("spans"))
        chosen = cut(scored.mapInArrow(_viterbi(fields, forms, totals, fresh), "field string, text string, weight bigint, chosen array<struct<value:string,form:string>>"))
        told = chosen.agg(F.sum(F.xxhash64("field", "text", "chosen").cast("decimal(38,0)"))).head()[0]
        if told == before:
            break
        before = told
        current = known.unionByName(chosen).select("field", "weight", F.explode("chosen").alias("c")).select("field", "weight", "c.value", "c.form")
    split = known.unionByName(chosen)
    found = meet(rows, split, ["field", "text"], "weight")
    return found.select("id", "field", F.posexplode("chosen").alias("p", "c")).select("id", "field", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("c.value").alias("value"))
