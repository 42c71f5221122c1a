"""Repeated strings across a corpus: every byte that a string of LENGTH bytes covers which also starts anywhere else.

Difference-cover blockwise construction. A difference cover D modulo V holds, for any two residues, a common offset below V: any
two places i and j of the corpus have an offset d < V at which both i + d and j + d are sample places. So a string of LENGTH bytes that
stands at i and j holds, at one offset below V, a sample of both whose first LENGTH - V + 1 bytes are equal.

1. Ranks of the cover samples. Suffixes at sample places are dealt into buckets by the fingerprint of their first LENGTH - V + 1
   bytes; a task sorts one bucket at a time, and samples that tie have a rank in common. Only |D| of V places are sorted here.
2. Suffixes. A suffix without a tied sample among its first V places can't agree with any other to LENGTH bytes: the ranks decide that
   long tie and it is not sorted at all. All others (about the repeated bytes and V places around them) are dealt into buckets and
   sorted by the fingerprint of their first LENGTH bytes, one bucket at a time; neighbours that are equal are repeats. What goes back
   to the texts is the suffixes that don't tie, which are fewer.

Only equality matters here, so buckets are ordered by fingerprints (Karp and Rabin's, modulo primes: 62 bits for the samples, which are
but a filter, 93 for suffixes) and not by bytes. Identical texts are sorted once: they cover each other. In buckets a chunk of
texts stands for its places, so a passage of a third of all documents has a row for each chunk (chunks.py), and a task reads a bucket as a stream.
Memory holds a slice of a text, the repeated fingerprints of one chunk and, of windows of words, those of a batch that may be shared.

Beside what is removed, passages are told that documents share by words: n_shared_words counts a document's words in windows of WORDS words
that stand in another document, too. A passage of 51 words has often fewer than LENGTH bytes, so removal can't show it. The same two steps
find them, in the same passes over the texts: grams that stand for windows (passages.py) go with the samples, windows with a tied gram with the
suffixes. What a document repeats by itself doesn't count here; equal texts share all.

Edge cases: a null text is empty; texts shorter than LENGTH keep all. Repeated rows, equal texts and rows with null or equal doc_id
are rows of their own, so they cover each other. Matches don't cross documents. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import passages
from tidemark.llm.chunks import Chunks, attach
from tidemark.llm.common import drop_scratch, join_hot, settled, small_batches

LENGTH = 400
#: Words of the shortest passage that counts as shared: over 50.
WORDS = 51
#: Perfect difference sets, each difference modulo V once (the Singer sets of the small prime powers).
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121),
}
#: Moduli and bases of the fingerprints.
PRIMES, BASES = (2147483647, 2147483629, 2147483587), (1103515245, 1812433253, 1664525019)
#: Places of a text whose fingerprints are computed at once.
SLICE = 1 << 19

TEXTS = "chunk long, sha binary, n long, text binary"
FOUND = "sha binary, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string, n_shared_words long"


def cover_of(length: int) -> tuple[int, np.ndarray]:
    """The largest V of at most a third of *length*, and its cover."""
    v = max(v for v in COVERS if v <= max(3, length // 3))
    return v, np.array(COVERS[v], np.int64)


@lru_cache(maxsize=16)
def powers(base: int, prime: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
        k *= 2
    return out


def residues(data: np.ndarray, starts: np.ndarray, length: int, which: int) -> np.ndarray:
    """One residue of data[s : s + length] for each of the ascending *starts*, which span at most SLICE bytes."""
    prime, base, low = PRIMES[which], BASES[which] % PRIMES[which], int(starts[0])
    part, at = data[low : int(starts[-1]) + length], starts - low
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(part * powers(base, prime, SLICE + length)[: len(part)], out=sums[1:])  # below 2^60
    p = np.uint64(prime)
    return (sums[at + length] - sums[at]) % p * powers(pow(base, -1, prime), prime, SLICE)[at] % p


def span_residues(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """One residue of data[s:e] for each pair of the *starts* and *ends*, both ascending. Spans may have any length."""
    prime, base, low = PRIMES[which], BASES[which] % PRIMES[which], int(starts[0])
    p, inverse, carry, sums_at = np.uint64(prime), pow(base, -1, prime), 0, [np.zeros(len(starts), np.uint64) for _ in range(2)]
    for at in range(low, int(ends[-1]) + 1, SLICE):
        part = data[at : min(at + SLICE, int(ends[-1]))]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * powers(base, prime, SLICE)[: len(part)], out=sums[1:])
        scale = np.uint64(pow(base, at - low, prime))
        for places, out in zip((starts, ends), sums_at, strict=True):
            a, b = np.searchsorted(places, (at, at + SLICE))
            out[a:b] = (sums[places[a:b] - at] % p * scale + np.uint64(carry)) % p
        carry = (int(sums[-1]) % prime * int(scale) + carry) % prime
    far, near = np.divmod(starts - low, SLICE)
    shift = powers(inverse, prime, SLICE)[near] * np.array([pow(inverse, SLICE * k, prime) for k in range(int(far[-1]) + 1)], np.uint64)[far] % p
    return (sums_at[1] + p - sums_at[0]) % p * shift % p


def span_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62 bits for each span."""
    return ((span_residues(data, starts, ends, 0) << np.uint64(31)) | span_residues(data, starts, ends, 1)).astype(np.int64)


def window_prints(words: passages.Words, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """h and x of windows of words; x is below zero, so that none is taken for a suffix."""
    h, x = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for at in range(0, len(windows), passages.BLOCK):
        some = windows[at : at + passages.BLOCK]
        spans = words.data, words.starts[some], words.ends[some + size - 1]
        h.append(span_prints(*spans))
        x.append((-1 - span_residues(*spans, 2).astype(np.int64)).astype(np.int32))
    return np.concatenate(h), np.concatenate(x)


def sliced(starts: np.ndarray) -> Iterator[np.ndarray]:
    """Ascending places in runs that span at most SLICE bytes."""
    begin = 0
    while begin < len(starts):
        end = int(np.searchsorted(starts, starts[begin] + SLICE))
        yield starts[begin:end]
        begin = end


def fingerprints(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """62 bits for each start, in one slice."""
    return ((residues(data, starts, length, 0) << np.uint64(31)) | residues(data, starts, length, 1)).astype(np.int64)


def samples(n: int, length: int) -> np.ndarray:
    """The sample places of a text of *n* bytes."""
    v, cover = cover_of(length)
    if n < length:
        return np.zeros(0, np.int64)
    places = (np.arange(0, n, v)[:, None] + cover).ravel()
    return places[places <= n - (length - v + 1)]


def sample_prints(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    places = samples(len(data), length)
    prints = [fingerprints(data, s, length - cover_of(length)[0] + 1) for s in sliced(places)]
    return places, np.concatenate(prints) if prints else np.zeros(0, np.int64)


def candidate_runs(n: int, tied: np.ndarray, length: int) -> np.ndarray:
    """(first, last) of the places with a tied sample among their first V places, from the ascending tied places."""
    v, _ = cover_of(length)
    first, last = np.maximum(tied - v + 1, 0), np.minimum(tied, n - length)
    first, last = first[first <= last], last[first <= last]
    if not len(first):
        return np.zeros((0, 2), np.int64)
    cuts = np.flatnonzero(first[1:] > last[:-1] + 1)
    return np.stack((first[np.concatenate(([0], cuts + 1))], last[np.append(cuts, -1)]), 1)


def run_slices(runs: np.ndarray) -> Iterator[np.ndarray]:
    """The places of *runs*, at most SLICE at once."""
    for first, last in runs.tolist():
        for at in range(first, last + 1, SLICE):
            yield np.arange(at, min(last + 1, at + SLICE))


def views(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint8) for t in column]


def by_chunk(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    chunk = batch.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(chunk[a]), batch.slice(a, b - a)


ROWS = "h long, x int, chunk long"


def bucket_rows(chunk: int, h: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """ROWS: each fingerprint once, or twice where it stands more often."""
    order = np.lexsort((x, h))
    h, x = h[order], x[order]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (x[1:] == x[:-1])))
    third = same & np.concatenate(([False], same[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(h[~third]), pa.array(x[~third].astype(np.int32)), pa.array(np.full(int((~third).sum()), chunk))], names=["h", "x", "chunk"])


def sorted_buckets(rows: DataFrame, ties: bool) -> DataFrame:
    """ROWS in, ROWS out: those whose fingerprint stands at least twice (*ties*), or once. A bucket is a partition, sorted and read
    as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate((a, b)) for a, b in zip(held, columns, strict=True)]
            h, x, chunk = columns
            same = np.concatenate(([False], (h[1:] == h[:-1]) & (x[1:] == x[:-1])))
            if held is not None and done:  # the held row is known to be tied
                same[0] = True
            tied = same | np.concatenate((same[1:], [False]))
            if ties:  # once for each chunk
                told = tied & ~(same & np.concatenate(([False], chunk[1:] == chunk[:-1])))
                told[0] &= held is None or not done
            else:
                told = ~tied
                told[-1] = False  # what follows may tie with it
            held, done = [c[-1:] for c in columns], bool(tied[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[told]) for c in columns], names=["h", "x", "chunk"])
        if held is not None and not ties and not done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["h", "x", "chunk"])

    return rows.repartition("h").sortWithinPartitions("h", "x", "chunk").mapInArrow(run, ROWS)


def packed(rows: DataFrame) -> DataFrame:
    """chunk, h, x: ROWS with the fingerprints of a chunk in a batch as bytes of one row. Beside texts in one frame a row costs
    far more on its way to Python than its few bytes do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, x, chunk = (c.to_numpy() for c in batch.columns)
            order = np.argsort(chunk, kind="stable")
            own, starts = np.unique(chunk[order], return_index=True)
            parts = [[p.tobytes() for p in np.split(c[order], starts[1:])] for c in (h, x)]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(p, pa.binary()) for p in parts)], names=["chunk", "h", "x"])

    return rows.select("h", "x", "chunk").mapInArrow(run, "chunk long, h binary, x binary")


def unpacked(facts: pa.Table) -> pa.Table:
    """h and x of packed() rows."""
    h, x = (b"".join(facts.column(c).to_pylist()) for c in ("h", "x"))
    return pa.table({"h": np.frombuffer(h, np.int64), "x": np.frombuffer(x, np.int32)})


def texts_once(docs: DataFrame) -> DataFrame:
    """TEXTS: each distinct text with its number of rows, dealt into chunks; a table to be written once."""
    small_batches(docs.sparkSession)
    once = docs.groupBy("sha").agg(F.first("text").alias("text"), F.count("*").alias("n")).select("sha", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(chunks.of(sizes)), *batch.columns], names=["chunk", "sha", "n", "text"])

    return once.mapInArrow(run, TEXTS)


def sample_rows(texts: DataFrame, length: int, size: int) -> DataFrame:
    """ROWS: samples with x 0 and grams of words with x 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, part in by_chunk(batch):
                data = views(part.column(1))
                prints = [sample_prints(t, length)[1] for t in data]
                grams = passages.grams_once(passages.words_of(data), size, span_prints)
                h = np.concatenate((*prints, grams))
                yield bucket_rows(chunk, h, np.repeat((0, 1), (len(h) - len(grams), len(grams))))

    return texts.select("chunk", "text").mapInArrow(run, ROWS)


def with_runs(tied: DataFrame, texts: DataFrame, length: int, size: int) -> DataFrame:
    """TEXTS and runs: first and last places of the suffixes to be sorted, one after the other; windows: the same of windows of words."""

    def prepare(facts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, x = (c.to_numpy() for c in unpacked(facts).columns)
        return np.unique(h[x == 0]), np.unique(h[x == 1])

    def apply(both: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        known, grams = both
        data, runs = views(batch.column("text")), []
        for t in data:
            places, h = sample_prints(t, length)
            tied = places[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h] if len(known) else places[:0]
            runs.append(candidate_runs(len(t), tied, length).ravel())
        windows = passages.candidate_windows(passages.words_of(data), size, span_prints, grams)
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(r, pa.list_(pa.int64())) for r in (runs, windows))], names=["chunk", "sha", "n", "text", "runs", "windows"])

    return attach(packed(tied), texts, prepare, apply, TEXTS + ", runs array<long>, windows array<long>")


def suffix_rows(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, part in by_chunk(batch):
                h, x, held = [], [], 0
                for t, runs in zip(views(part.column(1)), part.column(2).to_pylist(), strict=True):
                    for places in run_slices(np.reshape(runs, (-1, 2))):
                        h.append(fingerprints(t, places, length))
                        x.append(residues(t, places, length, 2))
                        held += len(places)
                        if held > SLICE:
                            yield bucket_rows(chunk, np.concatenate(h), np.concatenate(x))
                            h, x, held = [], [], 0
                if held:
                    yield bucket_rows(chunk, np.concatenate(h), np.concatenate(x))

    return texts.where("size(runs) > 0").select("chunk", "text", "runs").mapInArrow(run, ROWS)


def window_rows(texts: DataFrame, size: int) -> DataFrame:
    """ROWS of windows of words. What a text repeats by itself is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, part in by_chunk(batch):
                words = passages.words_of(views(part.column(1)))
                windows = passages.windows_of(words, part.column(2).to_pylist())
                yield bucket_rows(chunk, *passages.once_each(words.text[windows], *window_prints(words, windows, size)))

    return texts.where("size(windows) > 0").select("chunk", "text", "windows").mapInArrow(run, ROWS)


def known_pairs(facts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h, x = facts.column("h").to_numpy(), facts.column("x").to_numpy()
    order = np.lexsort((x, h))
    return h[order], x[order]


def holds(known: tuple[np.ndarray, np.ndarray], h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which (h, x) are among the known pairs, which are sorted."""
    kh, kx = known
    out = np.zeros(len(h), bool)
    if len(kh):
        at, open_ = np.searchsorted(kh, h), np.arange(len(h))
        while len(open_):  # once, but for pairs that share an h
            at, open_ = at[at < len(kh)], open_[at < len(kh)]
            alike = kh[at] == h[open_]
            at, open_ = at[alike], open_[alike]
            out[open_] |= kx[at] == x[open_]
            at, open_ = at[~out[open_]] + 1, open_[~out[open_]]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans, those that meet or overlap in one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def repeated_spans(text: np.ndarray, runs: list[int], untied: tuple, length: int) -> list[tuple[int, int]]:
    """What the suffixes of *runs* cover that tie with others, i.e. are not among the *untied* ones."""
    spans = []
    for places in run_slices(np.reshape(runs, (-1, 2))):
        hit = places[~holds(untied, fingerprints(text, places, length), residues(text, places, length, 2).astype(np.int32))]
        if len(hit):
            cuts = np.flatnonzero(np.diff(hit) > length)
            spans += zip(hit[np.concatenate(([0], cuts + 1))].tolist(), (hit[np.append(cuts, -1)] + length).tolist(), strict=True)
    return merged(spans)


def shared_words(texts: list[np.ndarray], n: list[int], windows: list[list[int]], untied: tuple, size: int) -> np.ndarray:
    """How many words of each text lie in windows that stand in another one; *n* is the number of a text's rows."""
    out = np.zeros(len(texts), np.int64)
    open_ = [i for i, (k, w) in enumerate(zip(n, windows, strict=True)) if k > 1 or w]
    if open_:
        words = passages.words_of([texts[i] for i in open_])
        at = passages.windows_of(words, [windows[i] for i in open_])
        long, copied = np.diff(words.first), np.array([n[i] > 1 for i in open_])
        own = passages.covered(words, at[~holds(untied, *window_prints(words, at, size))], size)
        out[open_] = np.where(copied, np.where(long >= size, long, 0), own)
    return out


def outcome(untied: DataFrame, texts: DataFrame, length: int, size: int) -> DataFrame:
    """FOUND: the spans to remove of each distinct text, and its shared words."""

    def apply(known: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, data, counts = [], views(batch.column("text")), batch.column("n").to_pylist()
        shared = shared_words(data, counts, batch.column("windows").to_pylist(), known, size)
        for t, n, runs in zip(data, counts, batch.column("runs").to_pylist(), strict=True):
            whole = n > 1 and len(t) >= length
            spans = [(0, len(t))] if whole else repeated_spans(t, runs, known, length) if runs else []
            sha, at = hashlib.sha256(), 0
            for a, b in spans:
                sha.update(t[at:a])
                at = b
            sha.update(t[at:])
            rows.append((len(t), [a for a, _ in spans], [b for _, b in spans], sha.hexdigest()))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("sha"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), pa.array(shared)], names=["sha", "n_bytes", "starts", "ends", "kept_sha256", "n_shared_words"])

    return attach(packed(untied), texts, lambda facts: known_pairs(unpacked(facts)), apply, FOUND)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes and their SHA-256."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))


def found(docs: DataFrame, length: int = LENGTH, size: int = WORDS) -> DataFrame:
    """FOUND for each distinct text of *docs*."""
    texts = settled(texts_once(keyed(docs).select("sha", "text")), "op12-texts")
    tied = settled(sorted_buckets(sample_rows(texts, length, size), ties=True), "op12-ranks")
    ready = settled(with_runs(tied, texts, length, size), "op12-runs")
    drop_scratch(texts, tied)
    untied = settled(sorted_buckets(suffix_rows(ready, length), ties=False), "op12-untied")
    alone = settled(sorted_buckets(window_rows(ready, size), ties=False), "op12-alone")
    out = settled(outcome(untied.unionByName(alone), ready, length, size), "op12-found")
    drop_scratch(ready, untied, alone)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, size: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed runs, the remaining bytes' SHA-256 and the number of words in passages of *size* words
    or more that another document holds: one row for each document."""
    ids = keyed(docs).select("doc_id", "sha")
    return join_hot(ids, found(docs, length, size), "sha").select("doc_id", "n_bytes", "starts", "ends", "kept_sha256", "n_shared_words")


def stripped(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the remaining bytes of every document."""
    small_batches(docs.sparkSession)
    rows = join_hot(keyed(docs), found(docs, length).select("sha", "starts", "ends"), "sha").select("doc_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [b"".join(t[a:b] for a, b in zip([0, *ends], [*starts, len(t)], strict=True)) for t, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary())], names=["doc_id", "kept"])

    return rows.mapInArrow(run, "doc_id long, kept binary")
