"""Best-fit packing by a configuration linear program.

Texts are tokenised in tasks and cut into pieces of at most ``LIMIT`` ids. The histogram of piece lengths
(``LIMIT`` numbers, whatever the input's size) goes to the driver, which solves the configuration program
over it by multiplicative weights: prices start at one over need and fall exponentially with coverage, a knapsack
by dynamic programming finds the dearest configurations, which get shares, and the scaled average of the shares is
rounded down to whole sequences; best fit packs what that leaves. Prices give a lower bound on the sequences of any
plan. The rounds stop within ``GAP`` of the bound or after ``ROUNDS``. Only a plan that ends above the gap is
held against greedy growth of the dearest configurations and best fit of all pieces, and the least is
taken. It is a table of at most a few thousand ranges: the pieces number r to s
of a length go to these sequences at this offset. Pieces are numbered within their length in salted groups, so a length
that a third of all pieces share is spread over ``SALTS`` tasks, and each finds its place by a join.

Rows: null text counts as empty (its ids are the end id alone). Rows that repeat a doc_id are packed like
others; a null doc_id is carried. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswave.llm.lookup import Remembered, slices
from presswave.storage import materialize

LIMIT, END, SALTS = 2048, 0, 256
#: Where the configuration program stops: relative distance of the plan from the bound, and rounds at most.
GAP, ROUNDS = 1e-3, 256
#: Unique words that a worker remembers.
REMEMBERED = 3 << 19
#: Bytes of text that are encoded together; each different word of them is looked up once.
SLICE = 1 << 22

_LETTER = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L")
_DIGIT = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N")
_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
#: Texts of these characters alone are split into words here; the vocabulary's own splitter takes the others.
PLAIN = re.compile("[\t-\r -~\xa0-ɏ‐-‧‰-⁞]*")
#: Fixed pattern: the splitter of the word vocabulary, over the characters of PLAIN.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{re.escape(_LETTER)}]+|[{re.escape(_DIGIT)}]|[^{re.escape(_LETTER + _DIGIT + _BLANK)}]+")
#: The same with the ends of words, one in a line.
PART = re.compile(WORD.pattern + "|\n")


class Words:
    """Ids of texts by the word vocabulary.

    No token spans white space, so a text's ids are its blank-separated words' ids. A new word is split
    like the vocabulary does. Words and their parts (the same with other punctuation around them) are remembered;
    only new parts meet the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # parts are normalised and split already, so the vocabulary's merges are all that is left to do
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for piece, k in self.tokenizer.get_vocab().items():
            self.ends[k] = piece.endswith("</w>")
        self.parts = Remembered(self.encode_parts, REMEMBERED)
        self.known = Remembered(self.encode_words, REMEMBERED)

    def encode_parts(self, parts: list[str]) -> list[list[int]] | tuple[np.ndarray, np.ndarray]:
        """Encode different parts as one text and cut its ids at the ends of parts."""
        ids = np.array(self.merges.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(parts):
            return ids, np.diff(cuts, prepend=0)
        return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        parts = PART.findall("\n".join([*words, ""]))
        ends = np.array([k for k, x in enumerate(parts) if x == "\n"], dtype=np.int64) - np.arange(len(words))
        flat, sizes = self.parts.flat_ids([x for x in parts if x != "\n"])
        before = np.append(0, sizes.cumsum())
        return flat, np.diff(before[np.append(0, ends)])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        plain = [x.lower().replace("\xa0", " ") if "<|" not in x and PLAIN.fullmatch(x) else None for x in texts]
        for text, ids in zip(texts, self.known.text_ids(plain), strict=True):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4") if ids is None else ids


_words: dict[str, Words] = {}


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _words:
            _words[tokenizer] = Words(tokenizer)
        words = _words[tokenizer]
        for part in slices(batches, "text", SLICE):
            rows = []
            for row, ids in enumerate(words.encode(part.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                rows += [(row, k, s, len(x := ids[s : s + limit]), zlib.crc32(x.data)) for k, s in enumerate(range(0, len(ids), limit))]
            row, *out = (np.array(x) for x in zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *map(pa.array, out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, prices: np.ndarray, limit: int, most: int, slack: float = 1e-2) -> list[list[int]]:
    """Indexes of the items (with repeats) of the dearest configurations, dearest first.

    One dynamic program over the capacities prices them all: for each item the best configuration that
    holds it, of those within ``slack`` of the best at most ``most``.
    """
    best, pick = np.zeros(limit + 1), np.full(limit + 1, -1)
    upto = np.searchsorted(lengths, np.arange(limit + 1), side="right")
    for c in range(int(lengths[0]), limit + 1):
        k = upto[c]
        value = prices[:k] + best[c - lengths[:k]]
        j = int(value.argmax())
        best[c], pick[c] = value[j], j
    with_item = prices + best[limit - lengths]
    out = []
    for j in np.argsort(-with_item, kind="stable")[:most]:
        if with_item[j] < (1 - slack) * with_item.max():
            break
        items, c = [int(j)], limit - int(lengths[j])
        while c >= lengths[0] and pick[c] >= 0:
            items.append(int(pick[c]))
            c -= int(lengths[pick[c]])
        out.append(items)
    return out


def solve(histogram: dict[int, int], limit: int = LIMIT, step: float = 0.5, eta: float = 0.25, most: int = 64, dual: dict[int, float] | None = None) -> list[tuple[dict[int, int], float]]:
    """Configurations (length: items) and their fractional numbers, covering every length of the histogram.

    A greedy growth. Prices are ``dual``; without it they start a little over proportion to length (in
    proportion they are the dual of the volume bound; long pieces are harder to place). They shrink with the
    covered share.
    A configuration grows by ``step`` of what its scarcest length still needs, at least by one sequence.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    need = np.array([histogram[k] for k in lengths], dtype=float)
    prices = np.array([dual[k] for k in lengths]) if dual else lengths * (lengths / limit) ** 0.1
    left, found = need.copy(), []
    while len(lengths):
        for items in knapsack(lengths, prices * np.exp(-eta * (1 - left / need)), limit, most):
            used, times = np.unique(items, return_counts=True)
            share = (left[used] / times).min()
            if share <= 1e-9:
                continue
            grown = min(share, max(1.0, step * share))
            found.append(({int(lengths[k]): int(n) for k, n in zip(used, times, strict=True)}, grown))
            left[used] -= grown * times
        alive = left > 1e-9
        lengths, need, left, prices = lengths[alive], need[alive], left[alive], prices[alive]
    return found


def rounded(histogram: dict[int, int], found: list[tuple[dict[int, int], float]], limit: int = LIMIT) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations that use every piece of the histogram once."""
    left, plan = dict(histogram), []
    for items, share in found:
        if times := min(int(share + 1e-9), *(left[k] // n for k, n in items.items())):
            plan.append((items, times))
            for k, n in items.items():
                left[k] -= n * times
    return plan + best_fit(left, limit)


def best_fit(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing over counts: equal sequences are one group, so cost does not grow with pieces.

    A piece goes to the least room that holds it, and so do the next of its length as long as they fit.
    """
    rooms: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(limit + 1)]
    filled = np.zeros(limit + 1, dtype=bool)
    for k, n in sorted(histogram.items(), reverse=True):
        while n:
            room = k + int(filled[k:].argmax())
            if filled[room]:
                items, times = rooms[room].pop()
                filled[room] = bool(rooms[room])
            else:
                room, items, times = limit, {}, n
            each = min(room // k, n)
            taken = min(times, n // each)
            for group, count in ((items | {k: each}, taken), (items, times - taken)):
                left = room - each * k if group is not items else room
                if count and group:
                    rooms[left].append((group, count))
                    filled[left] = True
            n -= each * taken
    return [x for groups in rooms for x in groups]


def sequences(plan: list[tuple[dict[int, int], int]]) -> int:
    return sum(times for _, times in plan)


def program(histogram: dict[int, int], limit: int = LIMIT, gap: float = GAP, rounds: int = ROUNDS, slack: float = 1e-2) -> tuple[list[tuple[dict[int, int], int]], float]:
    """The program's rounded plan and a lower bound on the sequences of any plan.

    A round adds shares of all configurations within ``slack`` of the dearest, in one step by which no
    length is covered more than once over. Averages start anew when the number of rounds has doubled, so
    that early prices do not stay in them; then the average is rounded. The rounds end within ``gap`` of the bound.
    Greedy growth at the bound's prices and best fit decreasing replace the plan only where they need fewer sequences.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    need = np.array([histogram[k] for k in lengths], dtype=float)
    if not len(lengths):
        return [], 0.0
    bound, dual = float(lengths @ need) / limit, lengths / limit
    log_prices, shares, plans = -np.log(need), Counter(), []
    for t in range(1, rounds + 1):
        prices = np.exp(log_prices - log_prices.max())
        found = knapsack(lengths, prices, limit, len(lengths), slack)
        dearest = prices[found[0]].sum()
        if need @ prices / dearest > bound:
            bound, dual = float(need @ prices / dearest), prices / dearest
        step, covered = {}, np.zeros(len(lengths))
        for items in {tuple(sorted(x)) for x in found}:
            used, times = np.unique(items, return_counts=True)
            step[items] = (need[used] / times).min()
            covered[used] += step[items] * times / need[used]
        eta = 0.5 / np.sqrt(1 + t / 8) / covered.max()
        for items, share in step.items():
            shares[items] += eta * share
        log_prices -= eta * covered
        if t >= 8 and t & (t - 1) == 0 or t == rounds:
            near = np.ceil(bound - 1e-6) * (1 + gap)
            plan, left = _whole(histogram, shares, lengths, bound)
            plans.append(plan + best_fit(left, limit))
            if sequences(plans[-1]) > near:
                priced = dict(zip(lengths.tolist(), dual.tolist(), strict=True))
                plans.append(plan + rounded(left, solve(left, limit, dual=priced), limit))
            if min(map(sequences, plans)) <= near:
                return min(plans, key=sequences), bound
            shares = Counter()
    return min(*plans, rounded(histogram, solve(histogram, limit), limit), best_fit(histogram, limit), key=sequences), bound


def _whole(histogram: dict[int, int], shares: Counter, lengths: np.ndarray, bound: float) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """The average of ``shares`` scaled to ``bound`` sequences and rounded down to whole ones, and what it leaves."""
    scale, left, plan = bound / sum(shares.values()), dict(histogram), []
    for config, share in shares.most_common():
        items = Counter(int(lengths[k]) for k in config)
        if times := min(int(share * scale + 1e-9), *(left[k] // n for k, n in items.items())):
            plan.append((dict(items), times))
            for k, n in items.items():
                left[k] -= n * times
    return plan, left


def ranges(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first and last number, first sequence, items of it in a sequence, its first offset there."""
    out, taken, sequence = [], {}, 0
    for items, times in plan:
        offset = 0
        for k, n in sorted(items.items(), reverse=True):
            begin = taken.get(k, 0)
            out.append((k, begin, begin + n * times - 1, sequence, n, offset))
            taken[k] = begin + n * times
            offset += n * k
        sequence += times
    return out


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``number``: from 0 within each length, counted in salted groups."""
    key = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    within = Window.partitionBy("length", "salt").orderBy(*key)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").count().withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1)
    return ranked.join(counts.drop("count"), ["length", "salt"]).withColumn("number", F.col("nth") + F.col("ahead")).drop("nth", "ahead", "salt")


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, limit, end), "pieces", 1000)
    histogram = {int(k): int(n) for k, n in pieces.groupBy("length").count().collect()}  # at most ``limit`` rows
    places = ranges(program(histogram, limit)[0])
    frame = spark.createDataFrame(places, "length long, begin long, last long, sequence long, each long, at long")
    # a block of numbers for the join, so that a common length is not one key
    size = 1024
    blocks = frame.withColumn("block", F.explode(F.sequence(F.col("begin") - F.pmod("begin", F.lit(size)), F.col("last"), F.lit(size)))).withColumn("block", F.floor(F.col("block") / size))
    placed = numbered(pieces).withColumn("block", F.floor(F.col("number") / size)).join(blocks, ["length", "block"]).filter(F.col("number").between(F.col("begin"), F.col("last")))
    index = F.col("number") - F.col("begin")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(index / F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(index, F.col("each")) * F.col("length")).alias("offset"),
    )
