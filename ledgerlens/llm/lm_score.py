"""Language-model scores: marginal likelihood over a subword lattice.

A text is its lower-cased words and one end. A word's probability is the sum over all its
segmentations into pieces of an existing vocabulary, each the product of its pieces'
probabilities; a forward recursion in log space adds them up. Characters that are no piece
go through the vocabulary's byte pieces.

The vocabulary stays as given; its scores (ranks) start the piece probabilities, which are
then learned from the training documents: one expectation step (forward and backward over
each distinct word, weighted by its count) gives the expected use of each piece.

Words are scored once each, not once per occurrence:

1. One pass over the texts counts words by chunk of neighbouring ids, so that a word that
   is frequent in a chunk is one row. A chunk of more than ``CHUNK_CHARS`` is cut by text.
2. Summed over the chunks, each distinct word has its training count; the expectation step
   and the scores run over distinct words. Only piece totals (bounded by the vocabulary)
   and a few sums reach the driver. Words of one length are walked together, their
   lattices as arrays: one row per word, one column per place, one array per piece length.
3. Counts and scores are joined back to the chunks by the words themselves, and each
   chunk's texts meet its dictionary, which is bounded by the chunk. Texts of a chunk that
   is still large (a third of the table may be one text) are spread beside copies of it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import persisted, small

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Neighbouring ids in a chunk (rows without an id are one), and the characters beyond
#: which a chunk is cut.
CHUNK_IDS = 4096
CHUNK_CHARS = 32_000_000
#: Distinct words walked at a time, and the length of those that are walked alone.
WALK = 65_536
LONG = 64
#: A task passes on its counts at so many entries, those of earlier chunks first.
COUNTS = 600_000
ROUNDS = 1
SMOOTHING = 0.1         # added to each piece's expected count
END = "</s>"
START = "▁"        # the vocabulary's mark of a word's start
LN10 = math.log(10.0)
NONE = -math.inf


class Lattice:
    """Piece log-probabilities with their prefixes, for walks over all segmentations."""

    def __init__(self, log_p: dict[str, float], bytes_p: list[float]) -> None:
        self.bytes_p, self.end = bytes_p, log_p[END]
        self.steps: dict[str, float | None] = {}
        for piece in log_p:
            for k in range(1, len(piece)):
                self.steps.setdefault(piece[:k], None)
        self.steps.update((p, w) for p, w in log_p.items() if p != END)

    def edges(self, s: str) -> list[list[tuple[int, float]]]:
        """For each position, the (next position, log-probability) of the pieces there."""
        get, n, out = self.steps.get, len(s), []
        for i in range(n):
            here, k = [], i + 1
            w = get(s[i:k], NONE)
            if w is None or w == NONE:  # the character is no piece: its bytes are
                here.append((k, sum(self.bytes_p[b] for b in s[i].encode("utf-8", "surrogatepass"))))
            while w != NONE:
                if w is not None:
                    here.append((k, w))
                k += 1
                if k > n:
                    break
                w = get(s[i:k], NONE)
            out.append(here)
        return out

    def forward(self, edges: list[list[tuple[int, float]]]) -> list[float]:
        """Log-probability of all ways to each position."""
        alpha = [0.0, *[NONE] * len(edges)]
        for i, here in enumerate(edges):
            a = alpha[i]
            for k, w in here:
                alpha[k] = _add(alpha[k], a + w)
        return alpha

    def log10(self, word: str) -> float:
        return self.forward(self.edges(START + word))[-1] / LN10

    def expect(self, word: str, times: float, into: dict[str, float], bytes_into: list[float]) -> None:
        """Add the expected use of each piece in ``times`` occurrences of the word."""
        s = START + word
        edges = self.edges(s)
        alpha = self.forward(edges)
        beta, n = [NONE] * len(s) + [0.0], len(s)
        for i in range(n - 1, -1, -1):
            b = NONE
            for k, w in edges[i]:
                b = _add(b, w + beta[k])
            beta[i] = b
        total = alpha[n]
        for i in range(n):
            for k, w in edges[i]:
                share = times * math.exp(alpha[i] + w + beta[k] - total)
                piece = s[i:k]
                if self.steps.get(piece) is None:
                    for x in piece.encode("utf-8", "surrogatepass"):
                        bytes_into[x] += share
                else:
                    into[piece] += share


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == NONE else a + math.log1p(math.exp(b - a))


def read_vocabulary(path: str = VOCABULARY) -> tuple[dict[str, float], list[float]]:
    """Pieces and byte pieces with starting log-probabilities.

    The vocabulary's scores are ranks, highest first; a piece of score s starts with a
    weight of 1 / (1 - s), Zipf's law. The end takes the place of one piece.
    """
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight, at_byte = {END: 1.0}, [1e-6] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        w = 1.0 / (1.0 + abs(sp.get_score(i)))
        if sp.is_byte(i):
            at_byte[int(piece[1:-1], 16)] = 1e-6
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            weight[piece] = w
    return _normal(weight, at_byte)


def _normal(weight: dict[str, float], at_byte: list[float]) -> tuple[dict[str, float], list[float]]:
    total = math.log(sum(weight.values()) + sum(at_byte))
    return ({p: math.log(w) - total for p, w in weight.items()},
            [math.log(w) - total for w in at_byte])


# --- lattices of many words -----------------------------------------------------------------

class Walk:
    """``Lattice`` for many words at a time, by arrays over words of one length."""

    def __init__(self, one: Lattice, log_p: dict[str, float]) -> None:
        self.one = one
        self.pieces = [p for p in log_p if p != END]
        self.weight = np.array([log_p[p] for p in self.pieces])
        self.longest = max(map(len, self.pieces))
        codes = np.zeros((len(self.pieces), self.longest), np.uint32)
        for row, p in zip(codes, self.pieces):
            row[:len(p)] = [ord(c) for c in p]
        self.sizes = np.array([len(p) for p in self.pieces])
        rolled = np.array([self._rolled(c[None, :n])[0] for c, n in zip(codes, self.sizes)], np.uint64)
        order = np.argsort(rolled, kind="stable")
        self.rolled, self.codes, self.order = rolled[order], codes[order], order
        self.sizes = self.sizes[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(rolled)] = True

    @staticmethod
    def _rolled(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.uint64)
        for c in codes.T:
            out = Walk._roll(out, c)
        return out

    @staticmethod
    def _roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h + code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(29))) >> np.uint64(44)

    def _found(self, h: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
        """The piece at each (word, place) of length ``k``, or -1."""
        ids = np.full(h.shape, -1, np.int32)
        row, at = np.nonzero(self.seen[self._slot(h)])
        place = np.searchsorted(self.rolled, h[row, at])
        place[place == len(self.rolled)] = 0
        hit = (self.rolled[place] == h[row, at]) & (self.sizes[place] == k)
        row, at, place = row[hit], at[hit], place[hit]
        same = np.ones(len(row), bool)  # the hash only finds: the characters decide
        for i in range(k):
            same &= self.codes[place, i] == codes[row, at + i]
        ids[row[same], at[same]] = self.order[place[same]]
        return ids

    def _edges(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each piece length: pieces and weights by (word, place); and the weight of the
        bytes of every character."""
        n = codes.shape[1]
        letters, where = np.unique(codes, return_inverse=True)
        spelled = np.array([sum(self.one.bytes_p[b] for b in chr(c).encode("utf-8", "surrogatepass"))
                            for c in letters.tolist()])[where.reshape(codes.shape)]
        ids, weights, h = [], [], np.zeros(codes.shape, np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            h = self._roll(h[:, :n - k + 1], codes[:, k - 1:].astype(np.uint64))
            found = self._found(h, codes, k)
            ids.append(found)
            weights.append(np.where(found >= 0, self.weight[found], spelled if k == 1 else NONE))
        return ids, weights, spelled

    @staticmethod
    def _sum(parts: list[np.ndarray]) -> np.ndarray:
        """log of the sum of exp, part by part."""
        all_ = np.stack(parts)
        top = all_.max(0)
        return top + np.log(np.exp(all_ - top).sum(0))

    def _forward(self, weights: list[np.ndarray], n: int) -> list[np.ndarray]:
        alpha = [np.zeros(len(weights[0]))]
        for j in range(1, n + 1):
            alpha.append(self._sum([alpha[j - k] + weights[k - 1][:, j - k] for k in range(1, min(len(weights), j) + 1)]))
        return alpha

    def _by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(rows, codes) of the words of one length; codes are None where they go alone."""
        texts = [START + w.decode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(t) for t in texts])
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            if n > LONG:
                yield rows, None
                continue
            joined = "".join(texts[i] for i in rows.tolist()).encode("utf-32-le", "surrogatepass")
            yield rows, np.frombuffer(joined, np.uint32).reshape(len(rows), n)

    def log10(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for rows, codes in self._by_length(words):
            if codes is None:
                out[rows] = [self.one.log10(words[i].decode("utf-8", "surrogatepass")) for i in rows.tolist()]
            else:
                out[rows] = self._forward(self._edges(codes)[1], codes.shape[1])[-1] / LN10
        return out

    def expect(self, words: list[bytes], times: np.ndarray, into: np.ndarray, at_byte: list[float]) -> None:
        """Add the expected use of each piece (in the order of ``pieces``) and byte."""
        for rows, codes in self._by_length(words):
            if codes is None:
                own: dict[str, float] = defaultdict(float)
                for i in rows.tolist():
                    self.one.expect(words[i].decode("utf-8", "surrogatepass"), float(times[i]), own, at_byte)
                for piece, share in own.items():
                    into[self._place(piece)] += share
                continue
            n = codes.shape[1]
            ids, weights, _ = self._edges(codes)
            alpha = self._forward(weights, n)
            beta = [np.zeros(len(codes))]  # from the end: beta[i] stands i places before it
            for i in range(n - 1, -1, -1):
                beta.append(self._sum([weights[k - 1][:, i] + beta[n - i - k] for k in range(1, min(len(weights), n - i) + 1)]))
            log_times = np.log(times[rows].astype(np.float64)) - alpha[n]
            for k, (found, w) in enumerate(zip(ids, weights), 1):
                a, b = np.stack(alpha[:n - k + 1], 1), np.stack([beta[n - i - k] for i in range(n - k + 1)], 1)
                share = np.exp(a + w + b + log_times[:, None])
                hit = found >= 0
                into += np.bincount(found[hit], weights=share[hit], minlength=len(into))
                if k == 1 and not hit.all():
                    letters, where = np.unique(codes[~hit], return_inverse=True)
                    for c, x in zip(letters.tolist(), np.bincount(where, weights=share[~hit]).tolist()):
                        for b in chr(c).encode("utf-8", "surrogatepass"):
                            at_byte[b] += x

    def _place(self, piece: str) -> int:
        if not hasattr(self, "_places"):
            self._places = {p: i for i, p in enumerate(self.pieces)}
        return self._places[piece]


# --- words --------------------------------------------------------------------------------

def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text, mod 5, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _chunked(docs: DataFrame, id_col: str, text: str, chunk_chars: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their chunk; chunks that are still large, with their number of parts; rows
    to learn from)."""
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(F.floor(doc_id / CHUNK_IDS).cast("long"), F.lit(-1 << 62)).alias("ids"),
                       doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)
    taught = F.count_if(~F.col("held_out") & F.col("doc_id").isNotNull())
    of_ids = persisted(rows.groupBy("ids").agg(size.alias("chars"), taught.alias("taught")))
    ends = of_ids.agg(F.coalesce(F.sum("taught"), F.lit(0))).head()[0]
    heavy = of_ids.where(F.col("chars") > chunk_chars).select(
        "ids", F.ceil(F.col("chars") / chunk_chars).alias("cuts"))
    part = F.pmod(F.xxhash64("text"), F.coalesce("cuts", F.lit(1)))
    cut = rows.join(small(persisted(heavy)), "ids", "left")
    chunked = cut.select(F.xxhash64("ids", part).alias("chunk"), "doc_id", "held_out", "text")
    if heavy.isEmpty():
        return chunked, heavy.select(F.col("ids").alias("chunk"), F.col("cuts").alias("parts")), ends
    still = chunked.groupBy("chunk").agg(size.alias("chars")).where(F.col("chars") > 2 * chunk_chars)
    return chunked, persisted(still.select("chunk", F.ceil(F.col("chars") / chunk_chars).alias("parts"))), ends


def chunk_counts(chunked: DataFrame) -> DataFrame:
    """(chunk, word, c): the words of each chunk, c counting training documents only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = defaultdict(Counter)
        entries = 0
        for b in batches:
            for chunk, held, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = counts[chunk]
                before = len(own)
                if held:
                    own.update(dict.fromkeys(_split(t), 0))
                else:
                    own.update(_split(t))
                entries += len(own) - before
                if entries > COUNTS:
                    if len(counts) > 1:  # ids mostly come in order: earlier chunks are done
                        del counts[chunk]
                    yield from _count_batches(counts)
                    counts = defaultdict(Counter, {chunk: own} if chunk not in counts else {})
                    entries = sum(map(len, counts.values()))
        yield from _count_batches(counts)

    return chunked.select("chunk", "held_out", "text").mapInArrow(run, "chunk long, word binary, c long")


def _count_batches(counts: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    for chunk, own in counts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(own), chunk, np.int64)), pa.array(list(own), pa.binary()),
             pa.array(list(own.values()), pa.int64())], ["chunk", "word", "c"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``WALK``, so that many words share a length."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= WALK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from whole


def learn(words: DataFrame, ends: int, log_p: dict[str, float], bytes_p: list[float]) -> tuple[dict, list]:
    """One expectation step over the training words, then the new probabilities."""
    model = words.sparkSession.sparkContext.broadcast(Walk(Lattice(log_p, bytes_p), log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = model.value
        into, at_byte = np.zeros(len(walk.pieces)), [0.0] * 256
        for b in _gathered(batches):
            walk.expect(b.column(0).to_pylist(), b.column(1).to_numpy(), into, at_byte)
        used = np.flatnonzero(into)
        names = [*(walk.pieces[i] for i in used.tolist()), *(f"{i}\x00" for i in range(256))]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*into[used].tolist(), *at_byte])], ["piece", "n"])

    used = words.where("c > 0").select("word", "c").mapInArrow(run, "piece string, n double").groupBy(
        "piece").agg(F.sum("n").alias("n"))
    got = dict(used.collect())  # at most the vocabulary and 256 bytes
    weight = {p: got.get(p, 0.0) + SMOOTHING for p in log_p}
    weight[END] = ends + SMOOTHING
    return _normal(weight, [got.get(f"{i}\x00", 0.0) + SMOOTHING for i in range(256)])


def score_words(words: DataFrame, log_p: dict[str, float], bytes_p: list[float]) -> DataFrame:
    """(word, c, log10) of each distinct word."""
    shared = words.sparkSession.sparkContext.broadcast(Walk(Lattice(log_p, bytes_p), log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.log10(b.column(0).to_pylist()))],
                                             ["word", "c", "log10"])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, log10 double")


class _Places(dict):
    """The place of each word in a dictionary's arrays; words that are listed twice agree."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__(zip(words, range(len(words))))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
              rounds: int = ROUNDS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``base_score`` is the add-half word model; ``score`` the lattice's log10 probability.

    Edge cases: null, empty and blank texts are one end; a null id is neither held out
    nor trained on; repeated rows count and are scored one by one; without training rows
    the starting probabilities score; very long words take time and memory in proportion
    to their length; an empty table gives an empty result; other columns play no part.
    """
    chunked, large, ends = _chunked(docs, id_col, text, chunk_chars)
    untaught = F.col("held_out") | F.col("doc_id").isNull()
    counted = persisted(chunk_counts(chunked.withColumn("held_out", untaught)))
    words = persisted(counted.groupBy("word").agg(F.sum("c").alias("c")))
    known, n = words.where("c > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).head()
    total, distinct = n + ends, known + (ends > 0)
    log_p, bytes_p = read_vocabulary(vocabulary)
    for _ in range(rounds if n else 0):
        log_p, bytes_p = learn(words, ends, log_p, bytes_p)
    below = total + 0.5 * (distinct + 1)
    base = F.log10((F.col("c") + 0.5) / F.lit(below))
    scored = persisted(score_words(words, log_p, bytes_p).select(
        "word", (F.col("c") > 0).alias("known"), base.alias("base"), "log10"))
    lists = counted.select("chunk", "word").join(scored, "word").select(
        "chunk", "word", "known", "base", "log10")
    chunked, lists = chunked.withColumn("part", F.lit(0)), lists.withColumn("part", F.lit(0))
    if not large.isEmpty():  # texts are spread, whichever part they come to: each has the dictionary
        parts = small(large)
        spread = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1))
        chunked = chunked.join(parts, "chunk", "left").withColumn("part", spread).drop("parts")
        lists = lists.join(parts, "chunk", "left").withColumn("part", every).drop("parts")
    end_base, end_score = math.log10((ends + 0.5) / below), log_p[END] / LN10

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        place = _Places(own.column("word").to_pylist()).__getitem__
        seen = np.array(own.column("known").to_pylist(), bool)
        base, log10 = own.column("base").to_numpy(), own.column("log10").to_numpy()
        cols: list[list] = [[] for _ in range(4)]
        for t in texts.column("text"):
            words = Counter(_split(t.as_py()))
            at = np.fromiter(map(place, words), np.int64, len(words))
            k = np.fromiter(words.values(), np.int64, len(words))
            row = (int(k.sum()) + 1, int(k[seen[at]].sum()) + (ends > 0),
                   end_base + float(base[at] @ k), end_score + float(log10[at] @ k))
            for c, v in zip(cols, row):
                c.append(v)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(cols[0], pa.int64()),
                         pa.array(cols[1], pa.int64()), pa.array([total] * len(cols[0]), pa.int64()),
                         pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunked.groupBy("chunk", "part").cogroup(lists.groupBy("chunk", "part")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")
