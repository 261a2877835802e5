"""Exact substring de-duplication by suffix automata over shards of repeated text.

A word goes if a window of ``window`` consecutive words covers it whose word sequence
also starts anywhere else, in the same document or another.

Streaming every document through an automaton of every other one would cost the square
of the corpus, so reference shards are cut by content:

1. Each window has an anchor, the least hash among the word ``GRAM``-grams inside it, so
   equal windows have equal anchors wherever they stand. Consecutive windows with one
   anchor form a run. One pass over the texts writes (anchor, run) rows, about two per
   ``window - GRAM`` words.
2. Anchors met only once cannot belong to a repeated window. The runs of the others are
   the candidates; their words (the run's windows) are cut out as fragments.
3. Fragments are grouped by anchor and equal ones merged to one with a count. A shard is
   a set of anchors whose different fragments make up a bounded number of words. The
   suffix automaton of a shard's fragments, with occurrence counts on its states, goes to
   the task that streams the shard's fragments: the matching statistics, cut at
   ``window`` words, give for each window the state that holds all of its occurrences.
   Anchors with too much different text (an anchor at the edge of a passage that a third
   of the corpus shares) are first cut into single windows with their own anchors.
4. The spans found are joined back to the runs and applied to the candidate documents.

Hashes only route; a word goes only if the automaton has met its window twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import is_small, persisted, row_key, small

WINDOW = 35
GRAM = 8
#: Longer runs are cut into pieces of so many windows.
RUN = 512
#: An anchor with more words of different fragments is cut into single windows.
ANCHOR_WORDS = 30_000
#: A task closes a reference shard at so many words.
SHARD_WORDS = 50_000
#: Cached word hashes of a task.
CACHE = 200_000

_WORD = re.compile("[^\\x20\\x09-\\x0D]+")


# --- anchors ----------------------------------------------------------------------------

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _weights(gram: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 9) | 1 for i in range(gram)], np.uint64)


def gram_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of each word gram."""
    n = len(hashes) - gram + 1
    x = np.zeros(n, np.uint64)
    for i, w in enumerate(_weights(gram)):
        x += hashes[i:i + n] * w
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_anchors(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbouring gram hashes."""
    reach = 1
    while reach * 2 <= span:  # minimum over 2, 4, 8, ... grams
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def runs_of(words: list[bytes], cache: dict, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, windows, times) of each run of windows with one anchor.

    ``times`` is 2 where the anchor's gram stands more than once in the run, so that the
    run may repeat a window by itself, else 1.
    """
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    span = window - gram + 1
    x = gram_hashes(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), gram)
    least = window_anchors(x, span)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(np.append(starts, n))
    if sizes.max() > RUN:
        starts = np.concatenate([np.arange(s, s + k, RUN) for s, k in zip(starts, sizes)])
        sizes = np.diff(np.append(starts, n))
    anchors, times = least[starts], np.ones(len(starts), np.int64)
    ordered = np.sort(x)
    if (ordered[1:] == ordered[:-1]).any():
        for i, (a, s, k) in enumerate(zip(anchors, starts.tolist(), sizes.tolist())):
            times[i] += np.count_nonzero(x[s:s + k + span - 1] == a) > 1
    return anchors.view(np.int64), starts, sizes, times


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchors(keyed: DataFrame, id_col: str, text: str, window: int, gram: int) -> DataFrame:
    """One row per document: key, id, words, SHA-256 of its words, and its runs as arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(3):
                words = _split(t.as_py())
                for c, v in zip(cols, (len(words), _sha(words), *runs_of(words, cache, window, gram))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1]),
                 pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int32())),
                 pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.list_(pa.int32()))],
                ["_k1", "_k2", "doc_id", "n_words", "sha", "anchor", "start", "size", "times"])

    rows = keyed.select("_k1", "_k2", F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "_k1 long, _k2 long, doc_id long, n_words long, sha string, "
                                "anchor array<long>, start array<int>, size array<int>, times array<int>")


# --- fragments --------------------------------------------------------------------------

def fragments(candidates: DataFrame, text: str, window: int) -> DataFrame:
    """One row per candidate run: its anchor, its words, their hash, and where it stands.

    ``candidates`` has ``_runs``, the document's candidate runs, beside key and text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k1, k2, t, runs in zip(*(b.column(i).to_pylist() for i in range(4))):
                words = _split(t)
                for r in runs:
                    s, n = r["start"], r["size"]
                    frag = b" ".join(words[s:s + n + window - 1])
                    rows.append((r["anchor"], _digest(frag), frag, k1, k2, s, n))
                if len(rows) > 4000:
                    yield _fragment_batch(rows)
                    rows = []
            yield _fragment_batch(rows)

    return candidates.select("_k1", "_k2", text, "_runs").mapInArrow(run, FRAGMENT_SCHEMA)


FRAGMENT_SCHEMA = "anchor long, digest long, frag binary, _k1 long, _k2 long, start int, size int"


def _digest(frag: bytes) -> int:
    d = xxhash.xxh3_64_intdigest(frag)
    return d - (1 << 64) if d >> 63 else d


def _fragment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["anchor", "digest", "frag", "_k1", "_k2", "start", "size"]
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def single_windows(frags: DataFrame, window: int) -> DataFrame:
    """Fragments cut into their single windows, each its own anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for frag, k1, k2, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                words = frag.split(b" ")
                for i in range(len(words) - window + 1):
                    one = b" ".join(words[i:i + window])
                    d = _digest(one)
                    rows.append((d ^ 0x5DEECE66D, d, one, k1, k2, s + i, 1))
                if len(rows) > 4000:
                    yield _fragment_batch(rows)
                    rows = []
            yield _fragment_batch(rows)

    return frags.select("frag", "_k1", "_k2", "start").mapInArrow(run, FRAGMENT_SCHEMA)


# --- suffix automata --------------------------------------------------------------------

class SuffixAutomaton:
    """Suffix automaton of word sequences, with the number of occurrences of each state.

    Sequences are kept apart by starting each at the root. ``times`` weighs the
    occurrences of a sequence that stands for several equal ones.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.count = [0]

    def add(self, seq: list, times: int) -> None:
        last = 0
        for c in seq:
            last = self._extend(last, c)
            self.count[last] += times

    def _copy(self, q: int, size: int) -> int:
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.size.append(size)
        self.count.append(0)
        return len(self.size) - 1

    def _redirect(self, p: int, c, q: int, to: int) -> None:
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = to
            p = self.link[p]

    def _extend(self, p: int, c) -> int:
        nxt, link, size = self.next, self.link, self.size
        q = nxt[p].get(c)
        if q is not None:  # an earlier sequence has this one's words so far
            if size[q] == size[p] + 1:
                return q
            clone = self._copy(q, size[p] + 1)
            link[q] = clone
            self._redirect(p, c, q, clone)
            return clone
        cur = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[p] + 1)
        self.count.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = self._copy(q, size[p] + 1)
                link[q] = link[cur] = clone
                self._redirect(p, c, q, clone)
        return cur

    def settle(self) -> None:
        """Carry the counts up the suffix links, longest states first."""
        for v in np.argsort(np.array(self.size), kind="stable")[:0:-1].tolist():
            self.count[self.link[v]] += self.count[v]

    def repeated(self, seq: list, window: int) -> list[bool]:
        """Matching statistics of ``seq`` cut at ``window`` words: whether the window that
        ends at each word (from the first full one on) occurs twice or more."""
        nxt, link, size, count = self.next, self.link, self.size, self.count
        v, matched, out = 0, 0, []
        for c in seq:
            while v and c not in nxt[v]:
                v = link[v]
                matched = size[v]
            v = nxt[v].get(c, 0)
            matched = matched + 1 if v else 0
            while v and size[link[v]] >= window:
                v = link[v]
                matched = size[v]
            out.append(matched >= window and count[v] >= 2)
        return out[window - 1:]


def _shard_spans(rows: list[tuple], window: int) -> list[tuple]:
    """(anchor, digest, offset, windows) of each maximal run of repeated windows."""
    ids: dict[bytes, int] = {}
    auto, seqs = SuffixAutomaton(), []
    for anchor, frag, times in rows:
        seq = [ids.setdefault(w, len(ids)) for w in frag.split(b" ")]
        auto.add(seq, times)
        seqs.append((anchor, frag, seq))
    auto.settle()
    out = []
    for anchor, frag, seq in seqs:
        hit = auto.repeated(seq, window)
        if True in hit:
            edges = np.flatnonzero(np.diff(np.array([0, *hit, 0], np.int8)))
            d = _digest(frag)
            out += [(anchor, d, int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
    return out


def repeated_in_shards(merged: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Spans of repeated windows in the merged fragments (anchor, frag, times)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        words, last = 0, None
        for b in batches:
            for anchor, frag, times in zip(*(b.column(i).to_pylist() for i in range(3))):
                if anchor != last and words >= shard_words:
                    yield _span_batch(_shard_spans(shard, window))
                    shard, words = [], 0
                shard.append((anchor, frag, times))
                words += frag.count(b" ") + 1
                last = anchor
        yield _span_batch(_shard_spans(shard, window))

    dealt = merged.select("anchor", "frag", "times").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, digest long, off int, n int")


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      ["anchor", "digest", "off", "n"])


# --- operator ---------------------------------------------------------------------------

def _merged(frags: DataFrame) -> DataFrame:
    return frags.groupBy("anchor", "frag").agg(F.count(F.lit(1)).alias("times"))


def _find(docs: DataFrame, id_col: str, text: str, window: int, gram: int, keep: list[str],
          anchor_words: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its key, words and SHA-256; candidate documents with
    their ``_spans``, the first windows and lengths of the repeated runs)."""
    keyed = row_key(docs, id_col, text)
    of_doc = persisted(anchors(keyed, id_col, text, window, gram))
    runs = of_doc.select("_k1", "_k2", F.inline(F.arrays_zip("anchor", "start", "size", "times")))
    # stored, so that the join reads two plain shuffles and the runs of a passage that many
    # documents share can be split
    again = persisted(runs.groupBy("anchor").agg(F.sum("times").alias("met")).where("met > 1").select("anchor"))
    of_runs = runs.join(again, "anchor").groupBy("_k1", "_k2").agg(
        F.collect_set(F.struct("anchor", "start", "size")).alias("_runs"))
    of_runs = persisted(of_runs)
    texts = row_key(docs.select(*dict.fromkeys([*keep, id_col, text])), id_col, text)
    ids = of_runs.select("_k1", "_k2")
    if is_small(ids):  # texts without a candidate then need no shuffle
        texts = texts.join(F.broadcast(ids), ["_k1", "_k2"], "left_semi")
    candidates = persisted(texts.join(of_runs, ["_k1", "_k2"]))
    frags = persisted(fragments(candidates, text, window))
    merged = _merged(frags)
    heavy = persisted(merged.groupBy("anchor").agg(
        F.sum(F.length("frag")).alias("bytes")).where(F.col("bytes") > 6 * anchor_words).select("anchor"))
    if not heavy.isEmpty():
        heavy = small(heavy)
        cut = single_windows(frags.join(heavy, "anchor", "left_semi"), window)
        frags = persisted(frags.join(heavy, "anchor", "left_anti").unionByName(cut))
        merged = _merged(frags)
    found = persisted(repeated_in_shards(merged, window, shard_words))
    spans = (frags.select("anchor", "digest", "_k1", "_k2", "start")
             .join(found, ["anchor", "digest"])
             .groupBy("_k1", "_k2").agg(F.collect_set(F.struct(
                 (F.col("start") + F.col("off")).alias("at"), "n")).alias("_spans")))
    return of_doc, candidates.drop("_runs").join(spans, ["_k1", "_k2"])


def _covered(n_words: int, spans: list, window: int) -> np.ndarray:
    out = np.zeros(n_words, bool)
    for s in spans:
        out[s["at"]:s["at"] + s["n"] + window - 1] = True
    return out


def removal_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                   gram: int = GRAM, anchor_words: int = ANCHOR_WORDS,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``.

    Edge cases: null, empty and blank texts have no words and lose none; texts shorter
    than the window lose none; of repeated rows every one loses its repeated words (copies
    of at least a window lose all); null ids are kept as null; an empty table gives an
    empty result; other columns of ``docs`` play no part.
    """
    of_doc, cut = _find(docs, id_col, text, window, gram, [], anchor_words, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, shas = [], []
            for t, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = _split(t)
                gone = _covered(len(words), spans, window)
                removed.append(int(gone.sum()))
                shas.append(_sha([w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                ["_k1", "_k2", "n_removed", "kept"])

    changed = cut.select("_k1", "_k2", text, "_spans").mapInArrow(
        run, "_k1 long, _k2 long, n_removed long, kept string")
    changed = changed.dropDuplicates(["_k1", "_k2"])
    return of_doc.select("_k1", "_k2", "doc_id", "n_words", "sha").join(
        changed, ["_k1", "_k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept", "sha").alias("kept_sha256"))


def cut_text(text: str, gone: np.ndarray) -> str:
    """``text`` without the words marked in ``gone`` and the white space after each."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for i in np.flatnonzero(gone).tolist():
        out.append(text[at:places[i][0]])
        at = places[i + 1][0] if i + 1 < len(places) else len(text)
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   n_chars: str | None = "n_chars", window: int = WINDOW, gram: int = GRAM,
                   anchor_words: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text`` (and ``n_chars`` counted anew).

    Untouched texts come back as they are; edge cases are those of ``removal_report``.
    """
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others or [F.lit(0)]).alias("_row"), F.col(id_col).alias("doc_id"),
                       F.col(text).alias("text"))
    _, cut = _find(rows, "doc_id", "text", window, gram, ["_row"], anchor_words, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut_text(t, _covered(len(_split(t)), spans, window))
                     for t, spans in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string())],
                                             ["_k1", "_k2", "_row", "text"])

    schema = row_key(rows, "doc_id", "text").select("_k1", "_k2", "_row", "text").schema
    changed = persisted(cut.select("_k1", "_k2", "_row", "text", "_spans").mapInArrow(run, schema))
    gone = small(persisted(changed.select("_k1", "_k2").distinct()))
    rest = row_key(rows, "doc_id", "text").join(gone, ["_k1", "_k2"], "left_anti")

    def out(df: DataFrame, anew: bool) -> DataFrame:
        count = F.char_length("text")
        return df.select(*[
            F.col("text").alias(c) if c == text else
            count.cast(docs.schema[c].dataType).alias(c) if anew and c == n_chars else
            F.col("_row").getField(c).alias(c) for c in docs.columns])

    return out(rest, False).unionByName(out(changed, True))
