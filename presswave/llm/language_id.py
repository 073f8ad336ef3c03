"""Language identification by hierarchical discrimination.

The family of a text's language is predicted first; then linear support vector machines, one for each pair of
languages of a family, vote on the language within it. Families are told apart in the same way, one machine
for each pair of families. Features are the roots of the shares of hashed letter trigrams (windows of
three characters with a letter in the middle, lower case, blanks in place of other characters) over ``BUCKETS``
buckets, counted over the whole text.

Machines are fitted in tasks, one for each problem, by dual coordinate descent on the squared hinge. Their sample is
bounded: about ``PER_CLASS`` rows for each language, or for each family (parted evenly among its languages), those with the
least hash of doc_id, so it grows with the number of languages, not with the corpus. Only their trigram counts move.
The model, ``BUCKETS`` numbers for each problem, goes to the tasks that score all rows.

The score is the winner's share of its machines' confidence, that of the family times that of the language.

Rows: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing can be learned.
A row learns only if its text has a letter and its lang and doc_id are not null; a null doc_id counts as
the empty decimal, whose remainder is 0, so it is held out. One learned language gets every text with a score of 1.
Extra columns are ignored. Rows that repeat are predicted each. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswave.llm.lookup import slices

BUCKETS, PER_CLASS, FOLDS = 4096, 1024, 5
PARTS = 1 << 40
#: Characters counted at once (the windows of parts overlap), and rows scored at once.
BLOCK, ROWS = 1 << 19, 512
UNKNOWN = "und"
#: Families of languages by their two-letter codes. A code that is not here is a family of its own.
FAMILIES = {
    "Germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "Romance": "ast ca es fr gl it la oc pt rm ro sc",
    "Slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "Baltic": "lt lv",
    "Celtic": "br cy ga gd gv kw",
    "Uralic": "et fi hu se",
    "Turkic": "az ba kk ky tk tr tt ug uz",
    "Indo-Aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "Iranian": "ckb fa ku ps tg",
    "Semitic": "am ar he mt ti",
    "Dravidian": "kn ml ta te",
    "Austronesian": "ceb fil haw id jv mg mi ms sm su tl",
    "Bantu": "ln lg rw sn st sw tn xh yo zu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _part_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts of each text, and its number of letters."""
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    at = np.flatnonzero(letter)
    h = codes[at - 1] * np.uint32(0x9E3779B1) + codes[at] * np.uint32(0x85EBCA77) + codes[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    bucket = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)) % np.uint32(BUCKETS)
    own = owner[at - 1]
    counts = np.bincount(own * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
    return counts, np.bincount(own, minlength=len(texts))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the buckets' shares (float32 rows of length 1, or 0 without a letter) and whether there is a letter."""
    lowered = [x.lower() for x in texts]
    if sum(map(len, lowered)) <= 2 * BLOCK:
        counts, n = _part_counts(lowered)
    else:
        each = [_long_counts(x) for x in lowered]
        counts, n = np.stack([c for c, _ in each]), np.array([k for _, k in each])
    return np.sqrt(counts / np.maximum(1, n)[:, None]).astype(np.float32), n > 0


def _long_counts(text: str) -> tuple[np.ndarray, int]:
    """The counts of one long text, part by part, cut at blanks or, within a word, where the window is seen from one side only."""
    counts, n, begin = np.zeros(BUCKETS, np.int64), 0, 0
    while begin < max(1, len(text)):
        end = begin + BLOCK
        space = text.rfind(" ", begin + 1, end) if end < len(text) else -1
        end = space if space > begin else end
        c, k = _part_counts([text[begin:end]])
        counts, n, begin = counts + c[0], n + int(k[0]), end
    return counts, n


def machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (constant last) of a linear machine with squared hinge for classes -1 and 1, by dual coordinate descent.

    Each class weighs the same, whatever its number of rows.
    """
    z = np.column_stack([x, np.ones(len(x), np.float32)])
    slack = np.where(y > 0, (y > 0).mean(), (y < 0).mean()) / cost
    curve = (z * z).sum(1) + slack
    alpha, w, order = np.zeros(len(y)), np.zeros(z.shape[1], np.float32), np.random.default_rng(0)
    for _ in range(rounds):
        most = 0.0
        for k in order.permutation(len(y)):
            slope = y[k] * float(z[k] @ w) - 1 + slack[k] * alpha[k]
            if alpha[k] == 0 and slope >= 0:
                continue
            new = max(0.0, alpha[k] - slope / curve[k])
            most = max(most, abs(new - alpha[k]))
            w += np.float32((new - alpha[k]) * y[k]) * z[k]
            alpha[k] = new
        if most < tolerance:
            break
    return w


class Model:
    """The problems by level, of families and of the languages of each family, and their machines."""

    def __init__(self, languages: list[str]) -> None:
        families: dict[str, list[str]] = {}
        for x in sorted(languages):
            families.setdefault(FAMILY_OF.get(x, x), []).append(x)
        self.families = dict(sorted(families.items()))
        self.levels = [list(self.families), *self.families.values()]
        self.cuts = np.cumsum([0, *(len(x) * (len(x) - 1) // 2 for x in self.levels)])
        self.weights = np.zeros((self.cuts[-1], BUCKETS + 1), np.float32)

    def roles(self, per_class: int) -> dict[str, list[tuple[int, float, float]]]:
        """For each language the problems it is a sample of: their number, its side, and the rows it gives."""
        found: dict[str, list[tuple[int, float, float]]] = {x: [] for names in self.families.values() for x in names}
        for level, names in enumerate(self.levels):
            for k, pair in enumerate(combinations(names, 2), self.cuts[level]):
                for name, side in zip(pair, (-1.0, 1.0), strict=True):
                    members = [name] if level else self.families[name]
                    for x in members:
                        found[x].append((int(k), side, per_class / len(members)))
        return found

    def vote(self, level: int, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner among a level's names for each row, and its mean confidence."""
        names = self.levels[level]
        total = np.zeros((len(margins), len(names)))
        for k, (a, b) in enumerate(combinations(range(len(names)), 2)):
            p = 1 / (1 + np.exp(-np.clip(3 * margins[:, k], -30, 30)))
            total[:, b] += p
            total[:, a] += 1 - p
        won = total.argmax(1)
        return won, total[np.arange(len(total)), won] / (len(names) - 1) if len(names) > 1 else np.ones(len(total))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x, known = features(texts)
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        cuts = self.cuts
        family, sure = self.vote(0, margins[:, : cuts[1]])
        names, score = np.full(len(texts), UNKNOWN, object), np.where(known, sure, 0.0)
        for k in range(1, len(self.levels)):
            mine = np.flatnonzero(known & (family == k - 1))
            won, share = self.vote(k, margins[mine, cuts[k] : cuts[k + 1]])
            names[mine] = np.array(self.levels[k], object)[won]
            score[mine] *= share
        return names.tolist(), score


def fold() -> Column:
    """CRC-32 of doc_id as text modulo ``FOLDS``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS


def learned(docs: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """The model of the rows of ``docs`` (doc_id, text, lang), or None without any."""
    rows = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("text", F.col("lang").cast("string").alias("lang"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)) / float(PARTS)).alias("draw"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return None
    model = Model(list(counts))
    roles = {x: [(k, side, min(1.0, n / counts[x])) for k, side, n in found] for x, found in model.roles(per_class).items()}
    reach = [F.when(F.col("lang") == x, F.lit(max(share for _, _, share in found))) for x, found in roles.items() if found]
    if not reach:
        return model
    sample = rows.filter(F.col("draw") < F.coalesce(*reach))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            x, _ = features(part.column(0).to_pylist())
            out = []
            for row, lang, draw in zip(x, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                at = np.flatnonzero(row).astype(np.int32)
                out += [(k, side, draw, at, row[at]) for k, side, share in roles[lang] if draw < share]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["problem", "side", "draw", "at", "x"])

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "side"], kind="stable")
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for k, (at, values) in enumerate(zip(rows["at"], rows["x"], strict=True)):
            x[k, at] = values
        return pd.DataFrame({"problem": [key[0]], "w": [machine(x, rows["side"].to_numpy())]})

    counted = sample.mapInArrow(count, "problem long, side double, draw double, at array<int>, x array<float>")
    for r in counted.groupBy("problem").applyInPandas(train, "problem long, w array<float>").collect():  # BUCKETS numbers for each problem
        model.weights[r["problem"]] = r["w"]
    return model


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ROWS`` rows whose texts have about ``BLOCK`` bytes; a longer text is a slice of its own."""
    for part in slices(batches, "text", BLOCK):
        for k in range(0, part.num_rows, ROWS):
            yield part.slice(k, ROWS)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; only the text is read to predict."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            names, score = model.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows of ``docs`` that are not held out."""
    model = learned(docs.filter(fold() != 0), per_class)
    return identify(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
