"""Language-model scores of texts: subword lattice likelihood.

A word, with the white-space marker before it, is the sum over all paths through its lattice. The arcs are the pieces
of an existing vocabulary, drawn independently, and a log-space forward recursion gives the word's marginal. A
character outside the vocabulary is spelt by its bytes. The vocabulary's own scores (of a BPE vocabulary, 1 / rank)
start the model; one round of expectation maximisation over all distinct training words (`rounds`) refits them, as the
only public vocabularies at hand are ranks and no probabilities. Nothing else is learnt but the chance of an end. A text
is its words and its end, all independent: the product of the words' marginals, of the chance of no end for each of
them, and of the end.

A word's forward recursion is vectorised over words of all lengths; a word of more than `_LONG` characters is passed
over in blocks instead, and only the prefixes that a piece can still reach are carried from one to the next. For the
refit such a word is cut into parts of `_LONG` characters.

Words are counted by a 64-bit hash. The `head` most frequent ones, a bounded table, are looked up where the texts
are read; all others, which no longer hold a hot key, meet their counts in a shuffle join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import NOT_SPACE, Words, chunks
from .pieces import MARK, UNIGRAM, parse
from .stages import stage, text_batches

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = 150_000  # characters of words in one run
_LONG = 2_000  # characters of a word that is worked out together with others


@dataclass(frozen=True)
class LatticeSettings:
    rounds: int = 1
    head: int = 100_000
    smoothing: float = 0.1


class Vocabulary:
    """Pieces by length, as sorted hashes of their code points."""

    def __init__(self, data: bytes):
        model = parse(data)
        self.size = len(model.pieces)
        self.initial = np.full(self.size, -np.inf)
        self.bytes = np.full(256, -1)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, (piece, score, kind) in enumerate(model.pieces):
            if kind == 6:
                self.bytes[int(piece[3:5], 16)] = i
            elif kind in (1, 4):
                codes = np.array([[ord(c) for c in piece]], np.uint64)
                by_length.setdefault(len(piece), []).append((int(_hashes(codes)[0]), i))
            else:
                continue
            self.initial[i] = score if model.kind == UNIGRAM else -np.log(max(10.0, min(-score, 1e6)) + 10)
        if (self.bytes < 0).any():  # a vocabulary without byte pieces gets one of each, at its lowest score
            low = self.initial[np.isfinite(self.initial)].min()
            extra = np.flatnonzero(self.bytes < 0)
            self.bytes[extra] = self.size + np.arange(len(extra))
            self.initial = np.concatenate([self.initial, np.full(len(extra), low)])
            self.size += len(extra)
        self.initial[self.bytes] = np.where(np.isfinite(self.initial[self.bytes]), self.initial[self.bytes], -12.0)
        finite = np.isfinite(self.initial)
        self.initial[finite] -= np.log(np.exp(self.initial[finite]).sum())
        self.lengths = sorted(by_length)
        self.tables = {}
        for n, found in by_length.items():
            found.sort()
            self.tables[n] = (np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found]))


def _hashes(codes: np.ndarray) -> np.ndarray:
    value = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        value = (value ^ (codes[:, k] + np.uint64(1))) * _FACTOR
        value ^= value >> np.uint64(29)
    return value


class Lattice:
    """The arcs of a run of strings: for each piece length, the piece that begins at each character (or -1)."""

    def __init__(self, strings: list[str], vocabulary: Vocabulary):
        n = np.array([len(s) for s in strings], np.int64)
        self.order = np.argsort(-n, kind="stable")
        self.n = n[self.order]
        self.start = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        text = "".join(strings[i] for i in self.order)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        left = np.repeat(self.n, self.n) - (np.arange(len(codes)) - np.repeat(self.start, self.n))
        self.arcs: dict[int, np.ndarray] = {}
        rolling = np.zeros(len(codes), np.uint64)
        at, done = np.arange(len(codes)), 0
        for length in vocabulary.lengths:
            while done < length:
                at = at[left[at] > done]
                value = (rolling[at] ^ (codes[at + done] + np.uint64(1))) * _FACTOR
                rolling[at] = value ^ (value >> np.uint64(29))
                done += 1
            table, ids = vocabulary.tables[length]
            place = np.minimum(np.searchsorted(table, rolling[at]), len(table) - 1)
            hit = table[place] == rolling[at]
            if hit.any():
                piece = np.full(len(codes), -1)
                piece[at[hit]] = ids[place[hit]]
                self.arcs[length] = piece
        single = self.arcs.setdefault(1, np.full(len(codes), -1))
        self.spelt = np.flatnonzero(single < 0)
        encoded = [chr(c).encode("utf-8", "surrogatepass") for c in codes[self.spelt]]
        self.spelling = [vocabulary.bytes[np.frombuffer(b, np.uint8)] for b in encoded]

    def scores(self, log_p: np.ndarray) -> dict[int, np.ndarray]:
        out = {k: np.where(ids >= 0, log_p[ids], -np.inf) for k, ids in self.arcs.items()}
        if len(self.spelt):
            out[1][self.spelt] = [log_p[s].sum() for s in self.spelling]
        return out

    def forward(self, scores: dict[int, np.ndarray]) -> np.ndarray:
        """Log-space marginals of all prefixes: string w's prefix of e characters at start[w] + w + e."""
        base = self.start + np.arange(len(self.n))
        alpha = np.full(int(self.n.sum()) + len(self.n), -np.inf)
        alpha[base] = 0.0
        for e in range(1, int(self.n[0]) + 1 if len(self.n) else 0):
            k = int(np.searchsorted(-self.n, -e, side="right"))
            total = np.full(k, -np.inf)
            for length, score in scores.items():
                if length <= e:
                    total = np.logaddexp(total, alpha[base[:k] + e - length] + score[self.start[:k] + e - length])
            alpha[base[:k] + e] = total
        return alpha

    def expected(self, log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of the strings, weighted."""
        scores = self.scores(log_p)
        alpha = self.forward(scores)
        base = self.start + np.arange(len(self.n))
        beta = np.full(len(alpha), -np.inf)
        beta[base + self.n] = 0.0
        count = np.zeros(len(log_p))
        total = alpha[base + self.n]
        mass = np.zeros(len(self.spelt))
        spelt = {int(p): i for i, p in enumerate(self.spelt)}
        for back in range(1, int(self.n[0]) + 1 if len(self.n) else 0):  # characters left
            k = int(np.searchsorted(-self.n, -back, side="right"))
            at = self.n[:k] - back
            sum_ = np.full(k, -np.inf)
            for length, score in scores.items():
                if length <= back:
                    arc = score[self.start[:k] + at] + beta[base[:k] + at + length]
                    sum_ = np.logaddexp(sum_, arc)
                    share = np.exp(alpha[base[:k] + at] + arc - total[:k]) * weight[self.order[:k]]
                    ids = self.arcs[length][self.start[:k] + at]
                    known = ids >= 0
                    count += np.bincount(ids[known], share[known], len(log_p))
                    if length == 1 and spelt:
                        for w in np.flatnonzero(~known):
                            mass[spelt[int(self.start[w] + at[w])]] += share[w]
            beta[base[:k] + at] = sum_
        for share, ids in zip(mass, self.spelling):
            np.add.at(count, ids, share)
        return count

    def marginals(self, log_p: np.ndarray) -> np.ndarray:
        """The log probability of each string, in the order given."""
        alpha = self.forward(self.scores(log_p))
        out = np.zeros(len(self.n))
        out[self.order] = alpha[self.start + np.arange(len(self.n)) + self.n]
        return out


def long_marginal(string: str, vocabulary: Vocabulary, log_p: np.ndarray, block: int = 20_000) -> float:
    """The log probability of one string, worked out in blocks of characters."""
    reach = max(vocabulary.lengths + [1])
    alpha = [0.0] + [-math.inf] * (block + reach)
    for first in range(0, len(string), block):
        own = Lattice([string[first : first + block + reach - 1]], vocabulary).scores(log_p)
        here = min(block, len(string) - first)
        arcs = [(k, np.flatnonzero(np.isfinite(score[:here]))) for k, score in own.items()]
        place = np.concatenate([at for _, at in arcs])
        order = np.argsort(place, kind="stable")
        steps = np.concatenate([np.full(len(at), k) for k, at in arcs])[order].tolist()
        value = np.concatenate([own[k][at] for k, at in arcs])[order].tolist()
        for at, k, v in zip(place[order].tolist(), steps, value):
            a, b = alpha[at] + v, alpha[at + k]
            alpha[at + k] = a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
        alpha[: reach + 1] = alpha[here : here + reach + 1]
        alpha[reach + 1 :] = [-math.inf] * block
    return alpha[0]


def word_marginals(words: list[str], vocabulary: Vocabulary, log_p: np.ndarray) -> np.ndarray:
    """The log probability of each word with its marker."""
    out = np.zeros(len(words))
    short = [i for i, w in enumerate(words) if len(w) < _LONG]
    for a, b in _runs([words[i] for i in short]):
        out[short[a:b]] = Lattice([MARK + words[i] for i in short[a:b]], vocabulary).marginals(log_p)
    for i, w in enumerate(words):
        if len(w) >= _LONG:
            out[i] = long_marginal(MARK + w, vocabulary, log_p)
    return out


def _parts(word: str) -> list[str]:
    marked = MARK + word
    return [marked[a : a + _LONG] for a in range(0, len(marked), _LONG)]


def _runs(words: list[str]):
    first = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > _LIMIT:
            yield first, i
            first, size = i, 0
        size += len(w) + 1
    if first < len(words):
        yield first, len(words)


def _counted(batches):
    """The distinct words of each batch with their training counts."""
    for batch in batches:
        learn = batch.column("learn").to_numpy(zero_copy_only=False)
        hashes, counts, strings = [], [], []
        for first, last, data, offsets in chunks(batch.column("text")):
            w = Words(data, offsets, NOT_SPACE)
            if not len(w.hash):
                continue
            unique, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
            hashes.append(unique)
            counts.append(np.bincount(which, learn[first + w.row], len(unique)).astype(np.int64))
            raw = w.data.tobytes()
            strings.append(np.array([raw[a:b] for a, b in zip(w.start[at], w.end[at])], object))
        if hashes:
            unique, at, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            total = np.bincount(which, np.concatenate(counts), len(unique)).astype(np.int64)
            words = pa.array(np.concatenate(strings)[at], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), words, pa.array(total)], ["h", "word", "c"])


def _expectation(data: bytes, log_p: np.ndarray):
    def run(batches):
        vocabulary = Vocabulary(data)
        total = np.zeros(vocabulary.size)
        for batch in batches:
            strings = [p for w in batch.column("word").to_pylist() for p in _parts(w)]
            for a, b in _runs(strings):
                total += Lattice(strings[a:b], vocabulary).expected(log_p, np.ones(b - a))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], ["piece", "count"])
    return run


def _marginal(data: bytes, log_p: np.ndarray):
    def run(batches):
        vocabulary = Vocabulary(data)
        for batch in batches:
            lp = word_marginals(batch.column("word").to_pylist(), vocabulary, log_p)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(lp)], ["h", "c", "lp"])
    return run


def fit(words: DataFrame, data: bytes, settings: LatticeSettings = LatticeSettings()) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces, refitted to distinct training words, each once."""
    log_p = Vocabulary(data).initial
    usable = np.isfinite(log_p)
    for _ in range(settings.rounds):
        found = (words.select("word").mapInArrow(_expectation(data, log_p), "piece long, count double")
                 .groupBy("piece").agg(F.sum("count").alias("count"))).collect()  # a row for each piece of the vocabulary
        count = np.where(usable, settings.smoothing, 0.0)
        for r in found:
            count[r.piece] += r["count"]
        with np.errstate(divide="ignore"):
            log_p = np.log(count / count.sum())
    return log_p


_LOOKED_UP = pa.schema([(x, pa.int64()) for x in ("row", "doc_id", "h", "tf", "n_tokens", "n_known")] + [("logs", pa.float64()), ("lp", pa.float64())])


def _looked_up(keys: np.ndarray, c: np.ndarray, lp: np.ndarray):
    def run(batches):
        logs = np.log10(c + 0.5)
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for first, last, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets, NOT_SPACE)
                rows = last - first
                place = np.minimum(np.searchsorted(keys, w.hash), max(0, len(keys) - 1))
                hit = keys[place] == w.hash if len(keys) else np.zeros(len(w.hash), bool)
                row, at = w.row[hit], place[hit]
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:last]), batch.column("doc_id").slice(first, rows), none, none,
                     pa.array(np.bincount(w.row, minlength=rows)), pa.array(np.bincount(row, c[at] > 0, rows).astype(np.int64)),
                     pa.array(np.bincount(row, logs[at], rows)), pa.array(np.bincount(row, lp[at], rows))], schema=_LOOKED_UP)
                row, rest = w.row[~hit], w.hash[~hit]
                order = np.lexsort((rest, row))
                row, rest = row[order], rest[order]
                if len(row):
                    edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (rest[1:] != rest[:-1])))
                    none, nothing = pa.nulls(len(edge), pa.int64()), pa.nulls(len(edge), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[first + row[edge]]), none, pa.array(rest[edge].view(np.int64)),
                         pa.array(np.diff(np.append(edge, len(row)))), none, none, nothing, nothing], schema=_LOOKED_UP)
    return run


def score(docs: DataFrame, learn: Column, model_path: str, settings: LatticeSettings = LatticeSettings(), name: str = "lattice") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs` (doc_id, text).

    The model learns from the rows for which `learn` holds. Tokens are the words between ASCII white space, A-Z
    lower-cased, and one end; a null or empty text is an end alone. base_score is the smoothed word unigram, score
    the lattice model, both log10 probabilities. Repeated rows are scored, and counted, each; null ids as well. Words of
    any length are scored whole. Other columns are not looked at.
    """
    with open(model_path, "rb") as file:
        data = file.read()
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    words = stage(rows.select("text", "learn").mapInArrow(_counted, "h long, word string, c long")
                  .groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c")), f"{name}-words")
    texts = rows.filter("learn").count()
    seen = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (seen.n or 0) + texts, seen.v + (texts > 0)
    stop = (texts + 0.5) / (n + 1.0)  # the chance that a token is an end
    log_p = fit(words.filter("c > 0"), data, settings)
    valued = stage(words.mapInArrow(_marginal(data, log_p), "h long, c long, lp double"), f"{name}-valued")
    # counts by eighths of a doubling: as many of the highest as fit into the table, known before any row is sent
    level = F.floor(F.log2(F.col("c")) * 8)
    room, lowest = settings.head, None
    for r in sorted(valued.filter("c > 0").groupBy(level.alias("level")).count().collect(), reverse=True):
        if (room := room - r["count"]) < 0:
            break
        lowest = r.level
    top = valued.filter((F.col("c") > 0) & (level >= lowest) if lowest is not None else F.lit(False)).toPandas()
    top = top.iloc[np.argsort(top["h"].to_numpy(np.int64).view(np.uint64), kind="stable")]
    head = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(float), top["lp"].to_numpy(float)
    parts = stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _looked_up(*head), "row long, doc_id long, h long, tf long, n_tokens long, n_known long, logs double, lp double"), f"{name}-parts")
    known = F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))
    none = F.lit(None).cast("long")
    tail = parts.filter("h is not null").select("row", "h", "tf").join(valued, "h").select(
        "row", none.alias("doc_id"), none.alias("n_tokens"), known.alias("n_known"),
        (F.col("tf") * F.log10(F.col("c") + 0.5)).alias("logs"), (F.col("tf") * F.col("lp")).alias("lp"))
    sums = (parts.filter("h is null").select("row", "doc_id", "n_tokens", "n_known", "logs", "lp").union(tail)
            .groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "lp")]))
    tokens = F.col("n_tokens") + 1
    return sums.select(
        "doc_id", tokens.alias("n_tokens"), (F.col("n_known") + int(texts > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(texts + 0.5) - tokens * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (F.col("lp") / math.log(10) + F.col("n_tokens") * math.log10(1 - stop) + math.log10(stop)).alias("score"))
