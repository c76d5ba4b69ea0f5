"""Reading level of texts by regularised ordinal regression, calibrated to graded texts.

Every text gets features of five kinds, none of them taken from the grades:

* length: mean, quartiles and shares of word lengths, mean log sentence length, log number of words;
* lexical diversity: distinct words in windows of 25 words, so that it doesn't fall with the text's length;
* connectives: words of eight kinds (adding, causal, concessive, temporal, conditional, relative, final, formal), per sentence;
* clause depth (a proxy): inside a sentence every subordinating word opens a level, a bracket one that it closes again, a comma or
  dash half of one; mean and deepest level, and commas and marks per sentence;
* word rarity: negative log of the share of the language's texts that have the word, over the whole corpus: mean, deviation and
  shares by half units.

Which of the languages a text is in is guessed from its function words. All features are centred and scaled within their
language over the whole corpus; the proportional-odds model has common weights for them and their squares, and a
deviation for each language, under L2 penalties (the deviations' is the largest). It is fitted on at most ``TRAIN_ROWS`` ratings (those of lowest hash; the only bounded
step), every rating one row. Corpus counts, scales and predictions cover all texts.

Words are counted once per text, so that the join with the word table moves one row per text and distinct
word; words in more than a thousandth of all rows are joined by broadcast (``join_words``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeline.llm.encode import join_words
from spokeline.session import Scratch

TRAIN_ROWS = 20_000
LEAST_WORDS = 5
PENALTY = 1.0
OWN_PENALTY = 100.0
SQUARE_PENALTY = 30.0
#: Scaled features are squared within these bounds.
FAR = 4.0
WINDOW = 25
#: Frequent words that give a language away.
COMMON = {
    "en": "the a an of and to in is on at with by for from that it as was",
    "de": "der die das und in den dem ein eine einen ist nicht mit von zu auf im am nach des",
    "fr": "le la les et de du des un une est dans pour que à au en par sur",
    "es": "el la los las y de del un una es en que por con para al se su no lo",
    "ru": "и в на не с что по из к от для у за как его это то",
}
LANGUAGES = ("none", *COMMON)
#: Words that join clauses, by kind.
CONNECTIVES = {
    "adding": "and or but und oder aber sondern et ou mais y e o pero sino и или а но да",
    "causal": "because since as weil da denn parce puisque car porque pues потому поскольку ибо так",
    "concessive": "although though however yet despite while whereas obwohl obgleich trotz jedoch dennoch während bien quoique malgré pourtant cependant tandis aunque pese embargo хотя однако несмотря тогда",
    "temporal": "before after when until once during bevor nachdem als bis sobald avant après quand lorsque pendant antes después cuando hasta mientras прежде после когда пока во",
    "conditional": "if unless provided wenn falls sofern si condition menos siempre если коли коль",
    "relative": "which that who whom whose where was der die das welche welcher welches qui que dont où lequel laquelle quien cual cuyo donde что который которая которое которые которых",
    "final": "so that damit sodass pour afin para чтобы",
    "formal": "notwithstanding whence whereby thereby hence thus insofar inasmuch pursuant irrespective lest save therein aforementioned nonetheless ungeachtet gemäß insofern sofern wodurch mithin unbeschadet hiermit nonobstant conformément attendu dès d'où partant pourvu fors empero conforme obstante mediante ende salvo conquanto дабы вопреки согласно посредством поелику тем самым постольку отнюдь разве",
}
LENGTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16)
QUARTERS = (0.25, 0.5, 0.75, 0.9)
RARITIES = tuple(k / 2 for k in range(1, 18))
SURFACE = ("word_length", "sentence_length", "words", "diversity", "commas", "marks", "depth", "mean_depth", "deepest", *CONNECTIVES, *(f"length_at_{q}" for q in QUARTERS), *(f"length_{k}" for k in range(len(LENGTHS) + 1)))
LEXICAL = ("rarity", "rarity_deviation", *(f"rarity_{k}" for k in range(len(RARITIES) + 1)))
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_TOKEN = re.compile(rf"{_WORD}|[.!?…]+(?=\s|$)|\n|[(),;:–—]")
_ENDS, _MARKS = ".!?…\n", "(),;:–—"
_KINDS: dict[str, list[int]] = {}
for _k, _words in enumerate(CONNECTIVES.values()):
    for _w in _words.split():
        _KINDS.setdefault(_w, []).append(_k)
#: Words of any kind but the first open a level of depth.
_OPENING = frozenset(w for w, kinds in _KINDS.items() if any(kinds))
_LANGUAGES_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(COMMON.values(), 1):
    for _w in _words.split():
        _LANGUAGES_OF.setdefault(_w, []).append(_k)


def countable_words(text: str) -> int:
    """Blank-separated words with a letter in them."""
    return sum(any(c.isalpha() for c in w) for w in text.split())


def guess_language(counts: Counter) -> int:
    """The place in ``LANGUAGES`` of the language most of a text's function words belong to; 0 if it has none."""
    votes = [0] * len(LANGUAGES)
    for w in _LANGUAGES_OF.keys() & counts.keys():
        for k in _LANGUAGES_OF[w]:
            votes[k] += counts[w]
    return max(range(len(votes)), key=lambda k: (votes[k], -k)) if any(votes) else 0


def clauses(tokens: list[str]) -> tuple[list[str], list[int], list[float], list[float], int, int]:
    """The words, and of every sentence its length, deepest and mean level; commas and other marks."""
    words: list[str] = []
    lengths: list[int] = []
    deepest: list[float] = []
    means: list[float] = []
    commas = marks = n = 0
    level = top = total = 0.0
    for t in [*tokens, "\n"]:
        if t[0] in _ENDS:
            if n:
                lengths.append(n)
                deepest.append(top)
                means.append(total / n)
            n, level, top, total = 0, 0.0, 0.0, 0.0
            continue
        if t in _MARKS:
            if t == ")":
                level = max(0.0, level - 1)
            else:
                level += 1.0 if t == "(" else 0.5
            commas += t == ","
            marks += t != ","
        else:
            words.append(t)
            n += 1
            if t in _OPENING:
                level += 1.0
            total += level
        if level > top:
            top = level
    return words, lengths, deepest, means, commas, marks


def surface(text: str) -> tuple[list[float], Counter, int]:
    """The SURFACE features of a text, its words with their counts, and its language."""
    words, lengths, deepest, means, commas, marks = clauses(_TOKEN.findall(text.lower()))
    n, s, counts = max(1, len(words)), max(1, len(lengths)), Counter(words)
    by_length = Counter()
    kinds = [0] * len(CONNECTIVES)
    for w, k in counts.items():
        by_length[len(w)] += k
        for kind in _KINDS.get(w, ()):
            kinds[kind] += k
    shares, at, seen = [0.0] * (len(LENGTHS) + 1), [0.0] * len(QUARTERS), 0
    for length in sorted(by_length):
        shares[bisect_right(LENGTHS, length)] += by_length[length] / n
        for i, q in enumerate(QUARTERS):
            if seen < q * n <= seen + by_length[length]:
                at[i] = float(length)
        seen += by_length[length]
    if len(words) <= WINDOW:
        diversity = len(counts) / n**0.5
    else:
        starts = range(0, len(words) - WINDOW + 1, WINDOW)
        diversity = sum(len(set(words[i : i + WINDOW])) for i in starts) / (len(starts) * WINDOW**0.5)
    return [
        sum(x * k for x, k in by_length.items()) / n, sum(float(np.log1p(x)) for x in lengths) / s, float(np.log1p(n)), diversity, commas / s, marks / s,
        sum(deepest) / s, sum(means) / s, float(np.log1p(max(deepest, default=0.0))), *(k / s for k in kinds), *at, *shares,
    ], counts, guess_language(counts)


def text_words(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(row, doc, lang, word, k, f): per text its distinct words with counts, and one row with a null word and the
    surface features f. Texts with fewer than ``LEAST_WORDS`` countable words are left out: they have no level."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[int] = []
            langs: list[int] = []
            words: list[str | None] = []
            counts: list[int] = []
            features: list[list[float] | None] = []

            def out(ids: pa.Array = batch[doc], start: int = start) -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                arrays = [pa.array(np.array(rows, dtype=np.int64) + start), ids.take(at), pa.array(langs, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int32()), pa.array(features, pa.list_(pa.float64()))]
                return pa.RecordBatch.from_arrays(arrays, names=["row", doc, "lang", "word", "k", "f"])

            for i, t in enumerate(batch[text].to_pylist()):
                if not t or countable_words(t) < LEAST_WORDS:
                    continue
                found, bag, lang = surface(t)
                rows += [i] * (len(bag) + 1)
                langs += [lang] * (len(bag) + 1)
                words += [None, *bag]
                counts += [0, *bag.values()]
                features += [found] + [None] * len(bag)
                if len(rows) > 50_000:
                    yield out()
                    rows, langs, words, counts, features = [], [], [], [], []
            yield out()
            start += batch.num_rows

    return docs.select(doc, text).mapInArrow(run, f"row bigint, `{doc}` {kind}, lang int, word string, k int, f array<double>")


def text_features(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc, lang, x): the SURFACE and LEXICAL features of every text long enough to have a level."""
    scratch = Scratch(docs.sparkSession)
    all_rows = scratch.keep(text_words(docs, doc, text))
    base = all_rows.where("word is null").select("row", doc, "lang", "f")
    texts = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    seen = all_rows.where("word is not null").select("row", "lang", "word", "k")
    words = scratch.keep(seen.groupBy("word").agg(F.count("*").alias("n")))
    joined = join_words(seen, words, ["n"], scratch)
    of_language = F.expr("array(" + ",".join(f"{max(1, texts.get(k, 0))}D" for k in range(len(LANGUAGES))) + ")")
    k, rare = F.col("k"), F.col("rare")
    scored = joined.select("row", "k", (-F.ln(F.col("n") / F.get(of_language, F.col("lang")))).alias("rare"))
    bins = F.greatest(F.lit(0), F.least(F.lit(len(RARITIES)), F.floor(rare * 2).cast("int"))).alias("bin")
    scored = scored.select("row", "k", "rare", bins)
    total, mean = F.sum(k), F.sum(k * rare) / F.sum(k)
    spread = F.sqrt(F.greatest(F.sum(k * rare * rare) / total - mean * mean, F.lit(0.0)))
    lexical = scored.groupBy("row").agg(F.array(mean, spread, *[F.sum(F.when(F.col("bin") == i, k).otherwise(0)) / total for i in range(len(RARITIES) + 1)]).alias("r"))
    nothing = F.array_repeat(F.lit(0.0), len(LEXICAL))
    return base.join(lexical, "row", "left").select("row", doc, "lang", F.concat("f", F.coalesce("r", nothing)).alias("x"))


def language_scales(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature in every language, over all texts: a few hundred numbers from each task."""
    d = len(SURFACE) + len(LEXICAL)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(LANGUAGES), 2 * d + 1))
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            rows = np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)
            np.add.at(held, batch["lang"].to_numpy(zero_copy_only=False), rows)
        lang, at = np.nonzero(np.ones_like(held))
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(held.ravel())], names=["lang", "at", "s"])

    held = np.zeros((len(LANGUAGES), 2 * d + 1))
    for r in features.select("lang", "x").mapInArrow(sums, "lang int, at int, s double").groupBy("lang", "at").agg(F.sum("s").alias("s")).collect():
        held[r["lang"], r["at"]] = r["s"]
    n = np.maximum(held[:, :1], 1.0)
    mean = held[:, 1 : d + 1] / n
    deviation = np.sqrt(np.maximum(held[:, d + 1 :] / n - mean * mean, 0.0))
    return mean, np.where(deviation > 1e-9, deviation, 1.0)


class OrdinalModel:
    """Proportional odds: P(level <= c) = sigmoid(cut_c - x.w), with an L2 penalty on w."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cuts: np.ndarray, levels: np.ndarray):
        self.mean, self.scale, self.weights, self.cuts, self.levels = mean, scale, weights, cuts, levels

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float | np.ndarray = PENALTY, steps: int = 60) -> OrdinalModel:
        levels = np.unique(y)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-12, scale, 1.0)
        z, rank = (x - mean) / scale, np.searchsorted(levels, y)
        d, c = z.shape[1], len(levels) - 1
        share = np.clip(np.array([(rank <= k).mean() for k in range(c)]), 1e-3, 1 - 1e-3)
        theta = np.concatenate([np.zeros(d), np.log(share / (1 - share))])
        if not c:
            return cls(mean, scale, theta[:d], theta[d:], levels)

        def loss(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """Penalised negative log-likelihood, its gradient, and the scores of each row."""
            eta = z @ t[:d]
            edges = np.concatenate([[-np.inf], t[d:], [np.inf]])
            with np.errstate(over="ignore"):
                up, lo = (1 / (1 + np.exp(-(edges[rank + k] - eta))) for k in (1, 0))
            p = np.maximum(up - lo, 1e-12)
            gu, gl = up * (1 - up) / p, lo * (1 - lo) / p
            scores = np.zeros((len(z), d + c))
            scores[:, :d] = z * (gu - gl)[:, None]
            for k in range(c):
                scores[:, d + k] = -np.where(rank == k, gu, 0) + np.where(rank == k + 1, gl, 0)
            gradient = scores.sum(axis=0)
            gradient[:d] += penalty * t[:d]
            return -np.log(p).sum() + 0.5 * (penalty * t[:d] ** 2).sum(), gradient, scores

        value, gradient, scores = loss(theta)
        ridge = np.diag(np.concatenate([np.full(d, 1.0) * penalty, np.full(c, 1e-6)]))
        for _ in range(steps):
            # the outer product of scores stands for the Hessian (Fisher scoring), with a line search
            step = np.linalg.solve(scores.T @ scores + ridge, gradient)
            size = 1.0
            while size > 1e-6:
                trial = theta - size * step
                if np.all(np.diff(trial[d:]) > 0) and (new := loss(trial))[0] < value:
                    break
                size /= 2
            else:
                break
            gain, theta = value - new[0], trial
            value, gradient, scores = new
            if gain < 1e-6 * abs(value):
                break
        return cls(mean, scale, theta[:d], theta[d:], levels)

    def column(self, x: Column, lang: Column, mean: np.ndarray, deviation: np.ndarray) -> Column:
        """The most likely level as a SQL expression over the raw features ``x`` of a text in language ``lang``."""
        languages, d = mean.shape
        slopes = self.weights / self.scale
        own_end = d + languages + languages * d
        common, own_start, own, squares = slopes[:d], slopes[d : d + languages], slopes[d + languages : own_end].reshape(languages, d), slopes[own_end:]
        numbers = lambda row: "array(" + ",".join(f"{float(v)!r}D" for v in row) + ")"
        of = lambda table: F.get(F.expr("array(" + ",".join(map(numbers, table)) + ")"), lang)
        z = F.zip_with(F.zip_with(x, of(mean), lambda a, b: a - b), of(deviation), lambda a, b: a / b)
        square = lambda a: F.pow(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), a)), 2.0)
        terms = F.concat(F.zip_with(z, of(common + own), lambda a, b: a * b), F.zip_with(z, F.expr(numbers(squares)), lambda a, b: square(a) * b))
        eta = F.aggregate(terms, F.get(F.expr(numbers(own_start - (self.mean * slopes).sum())), lang), lambda a, b: a + b)
        below = [F.lit(0.0), *[1 / (1 + F.exp(eta - float(c))) for c in self.cuts], F.lit(1.0)]
        chances = [F.struct((b - a).alias("p"), F.lit(int(-level)).alias("l")) for a, b, level in zip(below, below[1:], self.levels)]
        return (-F.array_max(F.array(*chances)).getField("l")).cast("int")


def design(x: np.ndarray, lang: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Scaled features, the language, the features once more in the columns of their language, and their squares."""
    z = (x - mean[lang]) / deviation[lang]
    of = np.eye(len(mean))[lang]
    return np.concatenate([z, of, (of[:, :, None] * z[:, None, :]).reshape(len(z), -1), np.clip(z, -FAR, FAR) ** 2], axis=1)


def reading_levels(docs: DataFrame, grades: DataFrame, doc: str = "doc_id", text: str = "text", level: str = "reading_level", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc, level INT) of every text with at least ``LEAST_WORDS`` countable words.

    Null, empty and shorter texts have no row; repeated rows each have one. Without any grade there is nothing
    to calibrate to: the result is empty.
    """
    scratch = Scratch(docs.sparkSession)
    grades = grades.where(F.col(doc).isNotNull() & F.col(level).isNotNull()).distinct()
    features = scratch.keep(text_features(docs, doc, text))
    rated = features.join(grades.select(F.col(doc).alias("__doc"), F.col(level).alias("__y")), features[doc] == F.col("__doc"))
    sample = rated.orderBy(F.xxhash64("__doc"), "__y").limit(train_rows).select("__y", "lang", "x").toPandas()
    if sample.empty:
        return features.where("false").select(doc, F.lit(0).alias(level))
    mean, deviation = language_scales(features)
    x = design(np.stack(sample["x"].to_numpy()), sample["lang"].to_numpy(), mean, deviation)
    penalty = np.full(x.shape[1], OWN_PENALTY)
    penalty[: mean.shape[1]], penalty[-mean.shape[1] :] = PENALTY, SQUARE_PENALTY
    model = OrdinalModel.fit(x, sample["__y"].to_numpy(), penalty)
    return features.select(doc, model.column(F.col("x"), F.col("lang"), mean, deviation).alias(level))
