"""Several values packed in one field, split by a segmentation model learnt from the column itself.

A text is a chain of pieces between *candidate* delimiters; what stands in quotes or round brackets, and
units such as km/h and decimal commas before a unit, hold no candidates. Every run of neighbouring pieces (a *span*) may be one item, and a
division of the text is a path through the lattice of spans. A path's probability is the product of its
items' probabilities and, for every candidate, of the chance that its delimiter divides or doesn't.

The chances come from expectation-maximisation over all distinct texts of the field, weighted by how often
they occur: the E-step runs forward-backward over each lattice, the M-step sums expected item counts. An
item's evidence always leaves out the record at hand (else each would vouch for itself) and backs
off to the item's shape (digits as 9, letters as a), so that values seen once are still divided. Viterbi
then picks the division. Spans, models and texts live in tables joined by item; nothing grows on the
driver but one number for each delimiter of each field.

A text is settled once no span with candidates inside has a chance above ``PRUNE`` left: its pieces are its
items, it goes on speaking as evidence, and later rounds only work on the others. An item's evidence leaves out
one record that holds the text at hand; the other records that hold the same text speak.

All spans over at most ``MAX_INNER`` candidates are in the lattice, so that a text's spans grow with its length, not
its square. Of the longer ones only those can be items that occur as a whole elsewhere, and the text itself: the
first pieces of every long whole text are looked up among the spans of all texts, which finds them by one join.

The rounds end when the expected counts of the texts at work no longer move. A span that keeps candidates inside is believed in only beyond
``DISCOUNT`` occurrences in other texts (absolute discounting): that two lists share a stretch by chance is
no evidence for a value.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spokeline.session import Scratch

MAX_INNER = 3
DISCOUNT = 3.0
PRUNE = 1e-4
#: The rounds end when less than this share of the items at work changes.
SETTLED = 1e-2
#: A span less likely than its pieces by more than this factor (as a log) needs no forward-backward.
HOPELESS = -25.0
HINT = 1e-8
#: Delimiters, quotes and the units that contain a delimiter.
DELIMITERS = ";；,|/\n\r\t·"
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
UNITS = re.compile(r"(?<![A-Za-z])(?:km|mi|m|ft|l)\s*/\s*(?:h|s|min)(?![A-Za-z])", re.I)
#: A comma between a number and one more digit with a unit behind it is a decimal sign: 80,5 km/h.
DECIMAL = re.compile(r"(?<=\d),(?=\d\s*[^\W\d_])")
_CANDIDATE = re.compile(rf"\s*[{re.escape(DELIMITERS)}](?:\s*[{re.escape(DELIMITERS)}])*\s*")
_DIGITS = str.maketrans({c: str(i % 10) for i, c in enumerate("0123456789０１２３４５６７８９")})
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_COMMA = re.compile(r"(?<=\d),(?=\d)")


def _masked(text: str) -> str:
    """The text with every character that can't be a delimiter's replaced by x; same length."""
    out, i = list(text), 0
    while i < len(text):
        close = QUOTES.get(text[i])
        end = -1
        if close:
            end = text.find(close, i + 1)
            while close == '"' and end >= 0 and text[end + 1 : end + 2] == '"':
                end = text.find(close, end + 2)
        elif text[i] == "(":
            end = text.find(")", i + 1)
        if end > i:
            out[i : end + 1] = "x" * (end + 1 - i)
            i = end
        i += 1
    masked = "".join(out)
    for m in UNITS.finditer(masked):
        masked = masked[: m.start()] + "x" * (m.end() - m.start()) + masked[m.end() :]
    return DECIMAL.sub("x", masked)


def clean_item(text: str) -> str:
    """Without outer blanks and enclosing quotes; a doubled quote inside is one."""
    text = text.strip()
    if len(text) >= 2 and QUOTES.get(text[0]) == text[-1]:
        body = text[1:-1]
        if text[0] != '"':
            return body.strip()
        if '"' not in body.replace('""', ""):
            return body.replace('""', '"').strip()
    return text


def pieces(text: str) -> tuple[list[str], list[str]]:
    """The pieces of a text and the delimiter run after each but the last."""
    at, parts, delims = 0, [], []
    for m in _CANDIDATE.finditer(_masked(text)):
        parts.append(text[at : m.start()])
        delims.append(text[m.start() : m.end()])
        at = m.end()
    return [*parts, text[at:]], delims


def item_key(text: str) -> str:
    """What makes two items the same value to the model: case, width of digits and decimal sign don't."""
    return _COMMA.sub(".", clean_item(text).translate(_DIGITS)).casefold()


def shape(key: str) -> str:
    return _item_shape(key)[0]


def _item_shape(key: str) -> tuple[str, float]:
    """The shape of an item, and the log chance of the item among those of its shape: digits and letters drawn evenly."""
    plain, digits = _DIGIT.subn("9", key)
    out, runs = _LETTERS.subn("a", plain)
    letters = len(plain) - len(out) + runs
    return out, -math.log(10) * digits - math.log(20) * letters


@lru_cache(maxsize=200_000)
def _features(text: str) -> tuple[str, str, float]:
    key = item_key(text)
    return (key, *_item_shape(key))


def _chances(keys: list, shapes: list, lengths: list, hard: list, inner: list, own: list, kc: list, kp: list, sc: list, total: float) -> list[float]:
    """Log chance of each span's item from the evidence of the other texts; an empty piece (key None) costs nothing.

    keys, shapes: anything equal for equal items and shapes; lengths: of the shapes.

    own: how often this text itself counts each span; inner: its candidates inside; kc, kp, sc: evidence of the item alone, of the item with
    candidates inside, and of its shape; hard: the log chance of the item among those of its shape.
    """
    alone, packed, alike = defaultdict(float), defaultdict(float), defaultdict(float)
    for key, shape_, within, weight in zip(keys, shapes, inner, own):
        (packed if within else alone)[key] += weight
        alike[shape_] += weight
    out = []
    rarest = math.log(1e-3 / total)
    for key, shape_, length, h, within, c, p, s in zip(keys, shapes, lengths, hard, inner, kc, kp, sc):
        if key is None:
            out.append(0.0)
            continue
        # an unseen shape with candidates inside is worth no more than as many unseen ones without
        rare, known = (within + 1) * rarest - length, s - alike[shape_]
        seen = 0.9 * (max(0.0, c - alone[key]) + max(0.0, p - packed[key] - DISCOUNT)) / total
        whole = seen + 0.1 * (math.exp(rare) + max(0.0, known) / total) * math.exp(h)
        if whole > 1e-250:
            out.append(math.log(whole))
            continue
        best = _plus(rare, math.log(known / total)) if known > 0 else rare
        out.append(best + math.log(0.1) + h)
    return out


def _plus(a: float, b: float) -> float:
    """The log of the sum of two chances given as logs."""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


@lru_cache(maxsize=1000)
def _lattice(n: int) -> list[tuple[int, int]]:
    """All short spans of n pieces, and the whole."""
    short = [(i, j) for i in range(n) for j in range(i, min(n, i + MAX_INNER + 1))]
    return [*short, (0, n - 1)] if n > MAX_INNER + 1 else short


def _sum_logs(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _weights(marks: str, score: dict, chance: dict) -> dict:
    """Log weight of every span: its item, the candidates it keeps and the one that ends it."""
    keeps = [0.0, *accumulate(math.log1p(-chance.get(d, 0.5)) for d in marks)]
    splits = [math.log(chance.get(d, 0.5)) for d in marks]
    return {(i, j): c + keeps[j] - keeps[i] + (splits[j] if j < len(marks) else 0.0) for (i, j), c in score.items()}


def _is_plain(marks: str, score: dict, chance: dict) -> bool:
    """Every span that keeps a candidate is out of reach of the pieces it is made of, whatever stands around it."""
    w, n = _weights(marks, score, chance), len(marks) + 1
    upto = [0.0, *accumulate(w[k, k] for k in range(n))]
    return all(x - (upto[j + 1] - upto[i]) < HOPELESS for (i, j), x in w.items() if i < j)


def posteriors(marks: str, score: dict, chance: dict) -> dict:
    """Chance of each span to be an item, by forward-backward; every single piece must be among the spans."""
    w, n = _weights(marks, score, chance), len(marks) + 1
    starts, ends = defaultdict(list), defaultdict(list)
    for i, j in w:
        starts[i].append(j)
        ends[j].append(i)
    front, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for j in range(n):
        front[j + 1] = _sum_logs([front[i] + w[i, j] for i in ends[j]])
    for i in range(n - 1, -1, -1):
        back[i] = _sum_logs([w[i, j] + back[j + 1] for j in starts[i]])
    return {(i, j): math.exp(min(0.0, front[i] + w[i, j] + back[j + 1] - front[n])) for i, j in w}


def best_path(marks: str, score: dict, chance: dict) -> list[tuple[int, int]]:
    """Viterbi; of equal paths the one with more items."""
    w, n = _weights(marks, score, chance), len(marks) + 1
    ends = defaultdict(list)
    for i, j in w:
        ends[j].append(i)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
    for j in range(n):
        best[j + 1] = max((best[i][0] + w[i, j], i) for i in ends[j])
    path, j = [], n
    while j:
        path.append((best[j][1], j - 1))
        j = best[j][1]
    return path[::-1]


def _span_text(parts: list[str], delims: list[str], i: int, j: int) -> str:
    return "".join(x for k in range(i, j + 1) for x in (parts[k], delims[k] if k < j else ""))


def _mark(delimiter: str) -> str:
    """The character that stands for a run of delimiters."""
    return delimiter.strip()[:1] or delimiter[:1]


#: Spans as texts give them; tables hold ``_NUMBERED``, with numbers in place of keys and shapes.
_SPAN = "field string, id bigint, n bigint, marks string, i int, j int, key string, shape string, hard double, post double"
_NUMBERED = "field string, id bigint, n bigint, marks string, i int, j int, key bigint, shape bigint, len int, hard double, post double, moved double"
_SPAN_ARROW = [("field", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("marks", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.string()), ("shape", pa.string()), ("hard", pa.float64()), ("post", pa.float64())]
_NUMBERED_ARROW = [*_SPAN_ARROW[:6], ("key", pa.int64()), ("shape", pa.int64()), ("len", pa.int32()), ("hard", pa.float64()), ("post", pa.float64()), ("moved", pa.float64())]


def _number(field: str, c: str) -> Column:
    """A 64-bit number for an item or shape of a field, null for the empty one: joins and sorts move it instead of the text."""
    return F.when(F.col(c) != "", F.xxhash64(F.col(field), F.col(c)))


def _numbered(spans: DataFrame) -> DataFrame:
    return spans.select("field", "id", "n", "marks", "i", "j", _number("field", "key").alias("key"), F.xxhash64("field", "shape").alias("shape"), F.length("shape").alias("len"), "hard", "post", F.lit(0.0).alias("moved"))


def _batch(columns: dict[str, list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in schema], names=[c for c, _ in schema])


@lru_cache(maxsize=1000)
def _first_guess(n: int) -> list[float]:
    """Every division equally likely, at little weight: texts without candidates speak first."""
    post = posteriors(";" * (n - 1), dict.fromkeys(_lattice(n), 0.0), {})
    return [HINT * post[s] for s in _lattice(n)]


def _all_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every span of every text."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c, _ in _SPAN_ARROW}
        for field, number, text, n in zip(*[batch[c].to_pylist() for c in ("field", "id", "value", "n")]):
            parts, delims = pieces(text)
            lattice = _lattice(len(parts))
            found = [_features(_span_text(parts, delims, i, j)) for i, j in lattice]
            key, shapes, hard = zip(*found)
            _extend(out, (field, number, n, "".join(map(_mark, delims))), {"i": [x[0] for x in lattice], "j": [x[1] for x in lattice], "key": key, "shape": shapes, "hard": hard, "post": _first_guess(len(parts))})
            if len(out["i"]) > 50_000:
                yield _batch(out, _SPAN_ARROW)
                out = {c: [] for c, _ in _SPAN_ARROW}
        yield _batch(out, _SPAN_ARROW)


def _extend(out: dict[str, list], text: tuple, spans: dict[str, Sequence]) -> None:
    """Add one text's spans to the columns of a batch."""
    size = len(spans["i"])
    for c, v in zip(("field", "id", "n", "marks"), text):
        out[c] += [v] * size
    for c, v in spans.items():
        out[c] += v


def _long_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans ``at`` of texts, which occur as a whole elsewhere."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c, _ in _SPAN_ARROW}
        for field, number, text, n, at in zip(*[batch[c].to_pylist() for c in ("field", "id", "value", "n", "at")]):
            parts, delims = pieces(text)
            found = [_features(_span_text(parts, delims, x["i"], x["j"])) for x in at]
            key, shapes, hard = zip(*found)
            _extend(out, (field, number, n, "".join(map(_mark, delims))), {"i": [x["i"] for x in at], "j": [x["j"] for x in at], "key": key, "shape": shapes, "hard": hard, "post": [HINT * 2.0 ** (x["i"] - x["j"]) for x in at]})
        yield _batch(out, _SPAN_ARROW)


def _beginning(text: str) -> tuple[str | None, int]:
    """The key of the first ``MAX_INNER`` + 1 pieces of a text with more, and how many there are; (None, 0) otherwise.

    What quotes keep together counts as pieces here: unquoted elsewhere, it must be found.
    """
    if sum(map(text.count, DELIMITERS)) <= MAX_INNER:
        return None, 0
    parts, delims = pieces(clean_item(text))
    return (item_key(_span_text(parts, delims, 0, MAX_INNER)), len(parts)) if len(parts) > MAX_INNER + 1 else (None, 0)


def segment_values(values: DataFrame, rounds: int | None = None) -> DataFrame:
    """(field, value, items) of the distinct texts ``values`` (field, value, n).

    Rounds go on until the chances settle, or for ``rounds`` where that is given. Null texts must be left out; texts without candidates are one item each and only give evidence.
    """
    scratch = Scratch(values.sparkSession)

    @F.pandas_udf("many boolean, item string, key string, shape string, beginning string, pieces int")
    def look(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            many = bool(_CANDIDATE.search(_masked(t)))
            rows.append((True, None, "", "", *_beginning(t)) if many else (False, clean_item(t), *_features(t)[:2], *_beginning(t)))
        return pd.DataFrame(rows, columns=["many", "item", "key", "shape", "beginning", "pieces"])

    # spans carry the text's number, given where the texts are written, not the text: a long text has many of them
    looked = values.where(F.col("value").isNotNull()).withColumn("l", look("value"))
    looked = scratch.keep(looked.select("field", "value", F.monotonically_increasing_id().alias("id"), F.col("n").cast("bigint").alias("n"), "l.*"))
    texts = looked.where("many").select("field", "id", "value", "n")
    now = scratch.keep(texts.select("field", "id", "value", "n").mapInArrow(_all_spans, _SPAN).transform(_numbered))
    lengths = scratch.keep(looked.where("beginning is not null").select(_number("field", "beginning").alias("key"), "pieces").distinct())
    if lengths.take(1):
        same = now.where(F.col("j") - F.col("i") == MAX_INNER).select("id", "i", "key", F.length("marks").alias("last")).join(lengths, "key")
        at = same.select("id", "i", (F.col("i") + F.col("pieces") - 1).alias("j"), "last").where("j <= last and not (i = 0 and j = last)")
        at = at.groupBy("id").agg(F.collect_set(F.struct("i", "j")).alias("at"))
        longer = scratch.keep(texts.join(at, "id").select("field", "id", "value", "n", "at").mapInArrow(_long_spans, _SPAN).transform(_numbered))
        now = now.unionAll(longer)

    # how often every item stands alone: in texts without candidates at first, then in all texts by their pieces
    zero, weight, inner = F.lit(0.0), F.col("n") * F.col("post"), F.col("i") < F.col("j")
    singles = looked.where("not many and key <> ''").select("field", _number("field", "key").alias("key"), F.xxhash64("field", "shape").alias("shape"), F.col("n").cast("double").alias("n"))
    plain = scratch.keep(singles.groupBy("key", "shape").agg(F.sum("n").alias("c")))
    all_pieces = now.where("i = j").select("field", "n", F.substr("marks", F.col("i") + 1, F.lit(1)).alias("mark")).groupBy("field", "mark").agg(F.sum("n").alias("n")).collect()
    all_marks = {(r["field"], r["mark"]): r["n"] for r in all_pieces if r["mark"]}
    totals: dict[str, float] = {r["field"]: r["c"] + 1.0 for r in singles.groupBy("field").agg(F.sum("n").alias("c")).collect()}
    for r in all_pieces:
        totals[r["field"]] = totals.get(r["field"], 1.0) + r["n"]
    kept_marks: dict[tuple[str, str], float] = {}

    def grouped(alone: DataFrame, of_shapes: DataFrame | None) -> DataFrame:
        """Every text at work with its spans and their evidence: that of ``alone`` and of the expected counts of ``now``.

        ``of_shapes``: ``alone`` summed by shape, given once the pieces of the texts at work are counted in it.
        """
        counted = of_shapes is not None
        mine = now.where("key is not null").select("key", "shape", F.when(inner, zero).otherwise(weight - F.col("n") if counted else weight).alias("c"), F.when(inner, weight).otherwise(zero).alias("p"))
        mine = mine.groupBy("key", "shape").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
        known = alone.join(mine.select("key"), "key", "left_semi") if counted else alone
        items = known.select("key", "shape", "c", zero.alias("p")).unionAll(mine).groupBy("key", "shape").agg(F.sum("c").alias("kc"), F.sum("p").alias("kp"))
        if counted:
            shapes = mine.groupBy("shape").agg(F.sum("c").alias("kc"), F.sum("p").alias("kp")).join(of_shapes, "shape", "left").select("shape", (F.coalesce("s", zero) + F.col("kc") + F.greatest(F.col("kp") - DISCOUNT, zero)).alias("sc"))
        else:
            shapes = items.groupBy("shape").agg((F.sum("kc") + F.greatest(F.sum("kp") - DISCOUNT, zero)).alias("sc"))
        model = items.join(shapes, "shape").select("key", "kc", "kp", "sc")
        names = ("i", "j", "key", "shape", "len", "hard", "post")
        row = F.struct(*names, *[F.coalesce(c, zero).alias(c) for c in ("kc", "kp", "sc")])
        whole = now.join(model, "key", "left").groupBy("id").agg(F.first("field").alias("field"), F.first("n").alias("n"), F.first("marks").alias("marks"), F.collect_list(row).alias("s"))
        return whole.select("field", "id", "n", "marks", *[F.col(f"s.{c}").alias(c) for c in (*names, "kc", "kp", "sc")])

    def learnt() -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = defaultdict(dict)
        if kept_marks:
            for (field, mark), n in all_marks.items():
                out[field][mark] = min(max((n - kept_marks.get((field, mark), 0.0) + 1.0) / (n + 2.0), 1e-6), 1 - 1e-6)
        return dict(out)

    def lattices(batch: pa.RecordBatch) -> Iterator[tuple]:
        columns = [batch[c].to_pylist() for c in ("field", "id", "n", "marks", "i", "j", "key", "shape", "len", "hard", "post", "kc", "kp", "sc")]
        for field, number, n, marks, i, j, key, shapes, lengths, hard, post, kc, kp, sc in zip(*columns):
            # one record's own counts are left out, the others that hold the same text speak
            chance = _chances(key, shapes, lengths, hard, [b - a for a, b in zip(i, j)], post, kc, kp, sc, totals[field])
            yield field, number, n, marks, dict(zip(zip(i, j), chance)), dict(zip(zip(i, j), zip(key, shapes, lengths, hard, post)))

    alone, of_shapes, pieces_alone, done = plain, None, now.where("i = j and key is not null"), 0
    while rounds is None or done < rounds:
        chances = learnt()

        def expect(batches: Iterator[pa.RecordBatch], chances: dict = chances) -> Iterator[pa.RecordBatch]:
            """The spans, with their new chances, of the texts that aren't settled."""
            for batch in batches:
                out: dict[str, list] = {c: [] for c, _ in _NUMBERED_ARROW}
                for field, number, n, marks, score, items in lattices(batch):
                    chance = chances.get(field, {})
                    if _is_plain(marks, score, chance):
                        continue
                    post = posteriors(marks, score, chance)
                    kept = [s for s, p in post.items() if s[0] == s[1] or p > PRUNE]
                    if len(kept) > len(marks) + 1:
                        moved = n * sum(abs(p - items[s][4]) for s, p in post.items())
                        key, shapes, lengths, hard, _ = zip(*[items[s] for s in kept])
                        spans = {"i": [s[0] for s in kept], "j": [s[1] for s in kept], "key": key, "shape": shapes, "len": lengths, "hard": hard, "post": [post[s] for s in kept], "moved": [moved, *[0.0] * (len(kept) - 1)]}
                        _extend(out, (field, number, n, marks), spans)
                yield _batch(out, _NUMBERED_ARROW)

        seen = Observation()
        step, before = grouped(alone, of_shapes).mapInArrow(expect, _NUMBERED), now
        now = scratch.keep(step.observe(seen, F.sum("moved").alias("moved"), F.sum(F.when(F.col("i") == F.col("j"), F.col("n"))).alias("items")))
        moved, at_work = seen.get["moved"] or 0.0, seen.get["items"] or 0
        kept = now.where("i < j").select("field", F.explode(F.split(F.expr("substr(marks, i + 1, j - i)"), "")).alias("mark"), (F.col("n") * F.col("post")).alias("c"))
        kept_marks = {(r["field"], r["mark"]): r["c"] for r in kept.groupBy("field", "mark").agg(F.sum("c").alias("c")).collect()}
        done += 1
        if not at_work:
            break
        if of_shapes is None:
            alone = scratch.keep(plain.unionAll(pieces_alone.select("key", "shape", F.col("n").cast("double"))).groupBy("key", "shape").agg(F.sum("c").alias("c")))
            of_shapes = scratch.keep(alone.groupBy("shape").agg(F.sum("c").alias("s")))
        scratch.drop(before)
        if moved <= SETTLED * at_work:
            break

    chances = learnt()

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, [i for i, _ in best_path(marks, score, chances.get(f, {}))]) for f, d, _, marks, score, _ in lattices(batch)]
            columns = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int32()))], names=["id", "starts"])

    @F.pandas_udf("array<string>")
    def items_of(value: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for text, begin in zip(value, starts):
            parts, delims = pieces(text)
            begin = range(len(parts)) if begin is None else list(begin)
            found = [clean_item(_span_text(parts, delims, i, j - 1)) for i, j in zip(begin, [*begin[1:], len(parts)])]
            out.append([x for x in found if x])
        return pd.Series(out, dtype="object")

    starts = grouped(alone, of_shapes).mapInArrow(divide, "id bigint, starts array<int>")
    divided = texts.join(starts, "id", "left").select("field", "value", items_of("value", "starts").alias("items"))
    return divided.unionAll(looked.where("not many").select("field", "value", F.filter(F.array("item"), lambda x: x != "")))


def split_values(records: DataFrame, value: str = "value", field: str = "field") -> DataFrame:
    """``records`` with ``items``, the list of values in ``value`` (a null text gives null).

    Empty and blank texts have no items. Equal texts of one field are divided alike, whatever their
    rows. Other columns pass through; one named ``items`` is replaced.
    """
    scratch = Scratch(records.sparkSession)
    counts = records.where(F.col(value).isNotNull()).groupBy(F.col(field).alias("field"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    found = scratch.keep(segment_values(counts))
    found = found.select(F.col("field").alias("__f"), F.col("value").alias("__v"), F.col("items").alias("__items"))

    joined = records.join(found, (F.col(field) == F.col("__f")) & (F.col(value) == F.col("__v")), "left")
    return joined.withColumn("items", F.col("__items")).drop("__f", "__v", "__items")
