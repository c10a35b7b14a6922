"""Toxicity after noisy-channel deobfuscation.

1. A character trigram model is counted over all documents.
2. What looks disguised becomes a lattice: chunks with digits or symbols among letters, letters
   held long or doubled, and runs of at least three units of one or two letters or signs, a third of them single, that
   white space, punctuation or invisible joints spell apart, across chunks and lines. Every sign
   offers the letters it may stand for, a run may be one or two letters, joints may be nothing
   or a word boundary. Viterbi picks the path that is likeliest under the character model and
   the channel's costs; of equal paths the one met first stays, in the order of the lattice.
3. A lexicon of words and word beginnings with log odds, learned from labelled rows, and a
   logistic model on a document's evidence score the restored text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialize

#: Bound of the labelled sample: about so many rows are drawn by a hash of the key.
LABELLED_ROWS = 8000
#: Lexicon entries kept, by weight of evidence; and documents a feature needs among the toxic.
LEXICON = 20_000
MIN_TOXIC = 3
BEGINNINGS = (4, 5, 6)
REMEMBERED = 300_000

#: Letters of the model: a-z, then U+00DF to U+00FF, one code for other letters; 0 is a boundary.
LETTERS = {chr(c): i + 1 for i, c in enumerate([*range(97, 123), *range(0xDF, 0x100)]) if chr(c) != "÷"}
OTHER, V = 60, 64

# What a sign may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
#: Channel costs in nats: a sign read as a letter, as a boundary (a digit: more), a run shortened or kept long, a separator dropped.
AS_LETTER, AS_BOUNDARY, AS_DIGIT, SHORTER, LONG, DROPPED = 0.7, 2.0, 5.0, 0.5, 3.0, 0.3
#: A letter doubled on its own, read as one: plain words hold many such.
DOUBLED = 3.0

#: Visible and invisible signs that may stand between spelled letters, besides white space.
_SEPARATORS = ".-_*~·,/|:;\\^=" + "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_INVISIBLE = _SEPARATORS[-6:]
_SIGNS = re.escape("".join(LEET))
_AFTER_LETTER = re.escape("".join(LEET).replace("!", "").replace("+", "").replace("(", ""))
_JOINT = re.escape(_SEPARATORS)
#: White space and separators between two spelled units, at most.
JOINED = 8
_UNIT = r"(?:[^\W_]|[@$!€£(+|])"
# each alternative takes time in proportion to the chunk, however long it is
_DISGUISED = re.compile(rf"[{_SIGNS}][^\W\d_]|[^\W\d_][{_AFTER_LETTER}]|([^\W\d_])\1\1|([^\W\d_])\2[^\W\d_]*([^\W\d_])\3|[^\W_][{_INVISIBLE}]+[^\W_]|(?:^|[\W_])(?:{_UNIT}[{_JOINT}]){{2,}}{_UNIT}")
#: Units of one or two letters or signs, apart by joints; possessive, so that no text is gone over twice.
_SPELLED = re.compile(rf"(?<![^\s{_JOINT}]){_UNIT}{{1,2}}+(?:[\s{_JOINT}]{{1,{JOINED}}}+{_UNIT}{{1,2}}+(?![^\s{_JOINT}])){{2,}}+")
_UNITS = re.compile(rf"{_UNIT}{{1,2}}+")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_WORDS = re.compile(r"[^\W\d_]+")


def letter_table() -> np.ndarray:
    """Model code of each code point below 0x180; anything above counts as another letter."""
    table = np.full(0x181, OTHER, dtype=np.uint8)
    for c in range(0x181):
        table[c] = LETTERS.get(chr(c), 0 if c < 0xC0 or chr(c) in "×÷" else OTHER)
    return table


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often each letter trigram stands in the lower-cased texts; at most ``V ** 3`` rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = letter_table(), np.zeros(V**3, dtype=np.int64)

        def add(texts: list[str]) -> None:
            points = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), dtype="<u4")
            codes = table[np.minimum(points, 0x180)].astype(np.int32)
            if len(codes) > 2:
                total[:] += np.bincount((codes[:-2] * V + codes[1:-1]) * V + codes[2:], minlength=V**3)

        for batch in batches:
            held, size = [], 0
            for text in batch["text"]:
                if text:
                    held.append(text)
                    size += len(text)
                    if size > 300_000:
                        add(held)
                        held, size = [], 0
            add(held)
        seen = np.flatnonzero(total)
        if len(seen):
            yield pd.DataFrame({"code": seen.astype(np.int32), "n": total[seen]})

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_model(counts: DataFrame) -> np.ndarray:
    """Log probability of the third letter given two; ``counts`` has at most ``V ** 3`` rows."""
    n = np.zeros(V**3)
    found = counts.toPandas()
    n[found["code"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=float)
    n = n.reshape(V * V, V) + 0.05
    return np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """Per place the (letters, cost) it may stand for; a space is a word boundary."""
    places: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(chunk):
        c, j = chunk[i], i + 1
        while j < len(chunk) and chunk[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            if run == 1:
                places.append([(c, 0.0)])
            elif run == 2:
                places.append([(c * 2, 0.0), (c, DOUBLED)])
            else:
                places.append([(c, SHORTER), (c * 2, SHORTER + 0.2), (c * 3, LONG)])
        elif c in LEET:
            gap = [(" ", AS_DIGIT if c.isdigit() else AS_BOUNDARY)] + [("", DROPPED)] * (c in _SEPARATORS)
            if run < 3:
                places += [[(x, AS_LETTER) for x in LEET[c]] + gap] * run
            else:  # held long, as a letter is
                places.append([(x * k, AS_LETTER + fee) for x in LEET[c] for k, fee in ((1, SHORTER), (2, SHORTER + 0.2), (3, LONG))] + gap)
        elif c in _SEPARATORS or c.isspace():
            while j < len(chunk) and chunk[j] not in LEET and (chunk[j] in _SEPARATORS or chunk[j].isspace()):
                j += 1
            places.append([("", DROPPED), (" ", AS_BOUNDARY)])
        else:
            places.append([(" ", 0.0)])
        i = j
    return places


def decode(chunk: str, model: np.ndarray) -> str:
    """Likeliest reading of a disguised chunk: Viterbi over the lattice, a state being the last two letters."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # the cost, and (what came before, letters)
    for place in lattice(chunk):
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (p, q), (cost, said) in best.items():
            for letters, fee in place:
                a, b, c = p, q, cost + fee
                for x in letters:
                    code = LETTERS.get(x, OTHER if x.isalpha() else 0)
                    if code == 0 and b == 0:
                        continue
                    c -= float(model[a * V + b, code])
                    a, b = b, code
                if (a, b) not in now or c < now[a, b][0]:
                    now[a, b] = (c, (said, letters))
        best = now
    _, said = min(((c - float(model[p * V + q, 0]) * (q != 0), said) for (p, q), (c, said) in best.items()), key=lambda x: x[0])
    parts = []
    while said:
        said, letters = said
        parts.append(letters)
    return "".join(reversed(parts)).strip()


def _apart(run: str) -> bool:
    """Is a third of a run's units single? Runs of more pairs are plain short words."""
    units = _UNITS.findall(run)
    return 3 * sum(len(u) == 1 for u in units) >= len(units)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Reader(dict):
    """Words of a chunk after restoration, remembered for repeated chunks."""

    model: np.ndarray = field(default=None)

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        low = chunk.lower()
        words = _WORDS.findall(low)
        if _DISGUISED.search(low) or self.shortens(low):
            words += _WORDS.findall(decode(low, self.model))
        found = tuple(dict.fromkeys(words))
        if len(self) < REMEMBERED and len(chunk) < 40:
            self[chunk] = found
        return found

    def shortens(self, word: str) -> bool:
        """Would Viterbi read some doubled letter of a word as one? Elsewhere both readings cost the same, so three lookups tell."""
        for m in _DOUBLED.finditer(word):
            q, x, y = (LETTERS.get(c, OTHER if c.isalpha() else 0) for c in (word[m.start() - 1 : m.start()], m[1], word[m.end() : m.end() + 1]))
            if self.model[x * V + x, y] + self.model[q * V + x, x] < self.model[q * V + x, y] - DOUBLED:
                return True
        return False

    def words(self, text: str) -> set[str]:
        """Distinct lower-case words of a text as written and as restored."""
        found = {w for chunk in set(text.split()) for w in self[chunk]}
        for run in {m[0].lower() for m in _SPELLED.finditer(text) if _apart(m[0])}:
            found.update(self.spelled(run))
        return found

    def spelled(self, run: str) -> tuple[str, ...]:
        """Words of a run of units spelled apart, remembered under the run, which no chunk equals."""
        key = "\n" + run
        if key in self:
            return self[key]
        words = tuple(dict.fromkeys(_WORDS.findall(decode(run, self.model))))
        if len(self) < REMEMBERED and len(run) < 40:
            self[key] = words
        return words


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    coefficients: tuple[float, ...]

    def evidence(self, words: set[str]) -> tuple[float, float, float]:
        each = [w for x in words if (w := max((self.weights.get(f, 0.0) for f in features(x)), default=0.0)) > 0]
        total = sum(each)
        return (math.log1p(total), max(each, default=0.0), math.log1p(total) - 0.5 * math.log1p(len(words)))

    def score(self, words: set[str]) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.evidence(words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; without both labels a constant low score."""
    if len(y) == 0 or y.min() == y.max():
        return (-4.0 if len(y) == 0 or y.max() == 0 else 4.0, *[0.0] * x.shape[1])
    a, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([1e-6, *[ridge * len(y) / 100] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(key: Column) -> Column:
    """Rows kept away from learning: crc32 of the key's text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = LABELLED_ROWS) -> Lexicon:
    """Lexicon and logistic model from about ``rows`` labelled documents that are not held out.

    The sample is drawn by a hash of the key; its ids, bounded by ``rows``, go to all
    executors. Words are weighed on four fifths of it, the logistic model is fitted on the
    rest, so that words which merely happen to stand in toxic texts are not overrated.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("_tx_id")).agg(F.max(label_col).alias("_tx_y"))
    share = rows / max(1, labels.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("_tx_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = materialize(
        docs.select(F.col(id_col).cast("long").alias("_tx_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "_tx_id").select("_tx_id", "text", F.col("_tx_y").cast("int").alias("y"), (F.pmod(F.xxhash64("_tx_id", F.lit(1)), F.lit(5)) == 0).alias("second")),
        "labelled",
    )

    def seen_in(wanted: frozenset[str] | None):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, seen = Reader(model=model), {}
            for batch in batches:
                for text in batch["text"]:
                    for f in {f for w in reader.words(text) for f in features(w)}:
                        if wanted is None or f in wanted:
                            seen[f] = seen.get(f, 0) + 1
            if seen:
                yield pd.DataFrame({"f": list(seen), "n": np.array(list(seen.values()), dtype=np.int64)})

        return count

    first = sample.where(~F.col("second"))
    totals = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    by_toxic = first.where(F.col("y") == 1).select("text").mapInPandas(seen_in(None), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TOXIC).orderBy(F.desc("n"), "f").limit(5 * LEXICON).collect()
    in_toxic = {f: n for f, n in by_toxic}
    in_clean = dict.fromkeys(in_toxic, 0)
    if in_toxic and clean:
        in_clean |= {f: n for f, n in first.where(F.col("y") == 0).select("text").mapInPandas(seen_in(frozenset(in_toxic)), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    weights = {}
    for f, a in in_toxic.items():
        b = in_clean[f]
        odds = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (clean - b + 0.5))
        z = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds > 2.0 and z > 2.6:
            weights[f] = round(z * odds / 10, 4)
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])
    lexicon = Lexicon(weights, (0.0,) * 4)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model=model)
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([lexicon.evidence(reader.words(t)) for t in batch["text"]], columns=["a", "b", "c"]).assign(y=batch["y"].to_numpy())

    part = sample.where(F.col("second")).select("text", "y").mapInPandas(weigh, "a double, b double, c double, y int").toPandas()
    return Lexicon(weights, fit_logistic(part[["a", "b", "c"]].to_numpy(dtype=float).reshape(-1, 3), part["y"].to_numpy(dtype=float)))


def with_scores(docs: DataFrame, lexicon: Lexicon, model: np.ndarray, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of being toxic in ``score_col`` (replaced if there).

    Null and empty texts hold no evidence and get the score of an empty text. Repeated rows
    score alike, other columns pass unchanged, an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((lexicon, model))  # bounded by LEXICON and V

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, model = shared.value
        reader = Reader(model=model)
        for texts in batches:
            yield pd.Series([lexicon.score(reader.words(t) if t else set()) for t in texts], dtype=float)

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    model = log_model(count_trigrams(docs))
    return learn(docs, labels, model), model


__all__: Sequence[str] = ["count_trigrams", "decode", "held_out", "learn", "log_model", "train", "with_scores"]
