"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which tokens of another.

The tokens of a text by two tokenizers are the two sides of a bipartite graph; tokens whose byte ranges overlap are linked.
Its connected components are the minimal groups: a group ends where both sides have a token's end, and nowhere else. Union-find
with hooking and pointer jumping over whole arrays of edges finds them. A component's members give its links: an A and
a B token of it that end together. Links are counted by id pair within a batch, a chunk, then corpus-wide by partial sums;
the counts of a chunk's pairs come back to its documents (chunks.attach), so the most frequent pair costs a row for each chunk.

Texts are cut into chunks before each space between two characters that are no white space: there both tokenizers begin a token
(the pieces of B hold no space after another character, which is checked), so chunks align one by one. A chunk's groups and
links don't depend on where it stands, so a worker remembers those of the chunks it met last, and aligns only new ones. Long texts take
PART characters at once, so memory is constant; a text without such a space is one chunk and held whole.

Edge cases: a null or empty text, and one whose joined tokens differ from a space and the text (as with U+2581, which B reads as a
space), has no tokens: all counts 0, groups_sha256 ''. Strings of special tokens are plain text. Repeated rows count as
often as they stand, and doc_id may be null. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import Chunks, attach
from tidemark.llm.common import small_batches, text_or_empty, written
from tidemark.llm.op2_bpe import Memo, byte_alphabet

#: Characters after which a text is cut, and those that are aligned at once.
PART, GROUP = 1 << 16, 1 << 18
#: Chunks whose alignment a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 400_000, 32
#: Distinct pairs of one text beyond which its pairs are added up before more come.
PAIRS = 1 << 20
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: A pair's key: B's id above 32 bits of A's.
SHIFT = 32

TOKENS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        spec = json.loads(Path(path_a).read_text(encoding="utf-8"))
        to_byte = {c: i for i, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        bytes_a = {i: t.encode() if t in special else bytes(map(to_byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in self.bytes_b):
            raise ValueError("pieces with a space after another character are not supported")
        self.size_a, self.size_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        self.memo = Memo(MEMO)
        #: An id as it stands at the beginning of a group, after an id of its own side, and after the other side's.
        self.shown = [f"{c}{i}" for c in ";,|" for i in range(self.most)]

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        return a, self.b.encode(parts, num_threads=1)

    def holds(self, part: str, a: list[int], b: list[int]) -> bool:
        """The tokens of both sides are exactly a space and *part*."""
        raw = (" " + part).encode()
        return raw == b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b))


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over edges (a, b): each node's smallest fellow."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        apart = np.flatnonzero(ra != rb)
        if not len(apart):
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while len(np.flatnonzero((up := parent[parent]) != parent)):
            parent = up


def aligned(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens' byte sizes on both sides, equal in sum: group of each A and each B token (numbered in order), and the links."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    n_a, n_b = len(end_a), len(end_b)
    # Between neighbouring ends of either side one A token and one B token overlap.
    starts = np.concatenate(([0], np.sort(np.concatenate((end_a, end_b)), kind="stable")[:-1]))
    starts = starts[: n_a + n_b][np.concatenate(([True], np.diff(starts) > 0))]
    starts = starts[starts < end_a[-1]]
    over_a, over_b = np.searchsorted(end_a, starts, "right"), np.searchsorted(end_b, starts, "right")
    root = components(n_a + n_b, over_a, n_a + over_b)
    number = np.cumsum(root[:n_a] == np.arange(n_a)) - 1
    group_a, group_b = number[root[:n_a]], number[root[n_a:]]
    at = np.minimum(np.searchsorted(end_b, end_a), n_b - 1)
    link_a = np.flatnonzero((end_b[at] == end_a) & (group_b[at] == group_a))
    return group_a, group_b, link_a, at[link_a]


def in_order(group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of A and B tokens where each group shows its A tokens, then its B tokens."""
    n = int(group_a[-1]) + 1
    before_b = np.cumsum(np.bincount(group_b, minlength=n)) - np.bincount(group_b, minlength=n)
    return np.arange(len(group_a)) + before_b[group_a], np.arange(len(group_b)) + np.cumsum(np.bincount(group_a, minlength=n))[group_b]


#: n_a, n_b, n_groups, n_links, the groups as shown (each begins with ";") and the links' pairs of a chunk; None if a token is lost.
Entry = tuple[int, int, int, int, str, tuple[int, ...]] | None


def one_text(two: Pair, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of both sides of *chunks*, and where each chunk's end, from their text as one; None if the tokens are not its bytes.

    Only for chunks that begin and end with no white space: both tokenizers begin a token at each of them.
    """
    text = " ".join(chunks)
    (a,), (b,) = two.encode([text])
    ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
    if not two.holds(text, a, b):
        return None
    ends = np.cumsum(pc.binary_length(pa.array(chunks, pa.string())).to_numpy() + 1)
    return ids_a, ids_b, *(np.searchsorted(np.cumsum(size[ids]), ends) + 1 for size, ids in ((two.size_a, ids_a), (two.size_b, ids_b)))


def apart(two: Pair, chunks: list[str]) -> tuple[list[int], tuple]:
    """The same for any chunks, encoded one by one: which of them have tokens that are their bytes, and those chunks' ids and ends."""
    all_a, all_b = two.encode(chunks)
    kept = [i for i, (a, b) in enumerate(zip(all_a, all_b, strict=True)) if two.holds(chunks[i], a, b)]
    sides = [[side[i] for i in kept] for side in (all_a, all_b)]
    return kept, (*(np.array(list(chain.from_iterable(side)), np.int64) for side in sides), *(np.cumsum([len(x) for x in side], dtype=np.int64) for side in sides))


def entries(two: Pair, chunks: list[str]) -> list[Entry]:
    """Encode and align *chunks*, all at once."""
    out: list[Entry] = [None] * len(chunks)
    plain = [i for i, c in enumerate(chunks) if not (c[0].isspace() or c[-1].isspace() or "▁" in c)]
    # A text of many new words costs the tokenizers far less than as many texts of one word.
    told = one_text(two, [chunks[i] for i in plain]) if plain else None
    single = sorted(set(range(len(chunks))) - set(plain)) if told else list(range(len(chunks)))
    kept, rest = apart(two, [chunks[i] for i in single]) if single else ([], ())
    for at, tokens_of in ((plain, told), ([single[i] for i in kept], rest)):
        if at and tokens_of:
            for i, e in zip(at, made(two, *tokens_of), strict=True):
                out[i] = e
    return out


def made(two: Pair, ids_a: np.ndarray, ids_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> list[Entry]:
    """Entries of chunks whose tokens stand one after the other."""
    group_a, group_b, link_a, link_b = aligned(two.size_a[ids_a], two.size_b[ids_b])
    place_a, place_b = in_order(group_a, group_b)
    shown = np.empty(len(ids_a) + len(ids_b), np.int64)
    follows = lambda g: np.concatenate(([False], g[1:] == g[:-1]))
    shown[place_a] = ids_a + np.where(follows(group_a), two.most, 0)
    shown[place_b] = ids_b + np.where(follows(group_b), two.most, 2 * two.most)
    words = list(map(two.shown.__getitem__, shown.tolist()))
    # A chunk begins where both sides begin a token, so no group or link leaves it.
    links = np.searchsorted(link_a, np.concatenate(([0], stop_a))).tolist()
    keys = ((ids_b[link_b] << SHIFT) | ids_a[link_a]).tolist()
    count = lambda stops: np.diff(np.concatenate(([0], stops))).tolist()
    out, begin, first = [], 0, 0
    for n_a, n_b, n_groups, end, last in zip(count(stop_a), count(stop_b), count(group_a[stop_a - 1] + 1), (stop_a + stop_b).tolist(), links[1:], strict=True):
        out.append((n_a, n_b, n_groups, last - first, "".join(words[begin:end]), tuple(keys[first:last])))
        begin, first = end, last
    return out


def looked_up_chunks(two: Pair, chunks: list[str]) -> dict[str, Entry]:
    """The entries of *chunks*: remembered ones, and all others aligned GROUP characters at once."""
    found, new, size = {}, [], 0

    def align_new() -> None:
        for c, e in zip(new, entries(two, new), strict=True):
            found[c] = e
            if e and len(c) <= MEMO_CHARS:
                two.memo.put(c, e)
        new.clear()

    for c in set(chunks):
        found[c] = e = two.memo.get(c)
        if e is None:
            new.append(c)
            size += len(c)
            if size > GROUP:
                align_new()
                size = 0
    if new:
        align_new()
    return found


def parts_of(text: str) -> Iterator[list[str]]:
    """The text's chunks, about PART characters at once: joined by spaces they are *text*."""
    at = 0
    while len(text) - at > PART and (m := SAFE.search(text, at + PART)):
        yield SAFE.split(text[at : m.start()])
        at = m.end()
    yield SAFE.split(text[at:])


class Text:
    """What is known of one document, part by part."""

    def __init__(self) -> None:
        self.n = [0, 0, 0, 0]
        self.sha, self.begun, self.lost = hashlib.sha256(), False, False
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def add(self, found: list[Entry]) -> None:
        if None in found:
            self.lost = True
        if self.lost:
            return
        *counts, shown, keys = zip(*found, strict=True)
        self.n = [n + sum(c) for n, c in zip(self.n, counts, strict=True)]
        self.sha.update("".join(shown).encode()[not self.begun :])
        self.begun = True
        pairs, times = np.unique(np.fromiter(chain.from_iterable(keys), np.int64), return_counts=True)
        self.pairs.append(pairs)
        self.times.append(times)
        self.held += len(pairs)
        if self.held > PAIRS:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) > 1:
            pairs, where = np.unique(np.concatenate(self.pairs), return_inverse=True)
            self.pairs, self.times = [pairs], [np.bincount(where, np.concatenate(self.times)).astype(np.int64)]
            self.held = len(pairs) - PAIRS  # PAIRS more may come
        return (self.pairs[0], self.times[0]) if self.pairs else (np.zeros(0, np.int64),) * 2

    def row(self) -> tuple:
        if self.lost or not self.begun:
            return (0, 0, 0, 0, "", [], [])
        return (*self.n, self.sha.hexdigest(), *self.settle())


def align_texts(two: Pair, texts: list[str]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups' digest, pairs and their times of each text."""
    out, owners, parts, size = [Text() for _ in texts], [], [], 0

    def settle() -> None:
        found = looked_up_chunks(two, list(chain.from_iterable(parts)))
        for i, part in zip(owners, parts, strict=True):
            out[i].add(list(map(found.__getitem__, part)))
        owners.clear()
        parts.clear()

    for i, text in enumerate(texts):
        for part in parts_of(text) if text else ():
            owners.append(i)
            parts.append(part)
            size += sum(map(len, part))
            if size > GROUP:
                settle()
                size = 0
    settle()
    return [t.row() for t in out]


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """TOKENS: what a document's alignment has, before counts of the corpus; a table to be written once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, chunks = load(path_a, path_b), Chunks()
        kinds = (*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = zip(*align_texts(two, texts), strict=True) if texts else ([],) * 7
            number = chunks.of([len(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return text_or_empty(docs).mapInArrow(run, TOKENS)


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """chunk, pair, n: pairs of a chunk, added up within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            chunk = np.repeat(batch.column(0).to_numpy(), pairs.value_lengths().to_numpy(zero_copy_only=False))
            keys, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            if len(keys):
                order = np.lexsort((keys, chunk))
                keys, chunk = keys[order], chunk[order]
                fresh = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (chunk[1:] != chunk[:-1]))))
                yield pa.RecordBatch.from_arrays([pa.array(chunk[fresh]), pa.array(keys[fresh]), pa.array(np.add.reduceat(n[order], fresh))], names=["chunk", "pair", "n"])

    return rows.select("chunk", "pairs", "times").mapInArrow(run, "chunk long, pair long, n long")


def pair_table(pairs: DataFrame) -> DataFrame:
    """pair, a, b, count and best: whether no other A id is linked more often with the B id."""
    b = F.shiftright("pair", SHIFT)
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", b).withColumn("a", F.col("pair") - F.shiftleft("b", SHIFT))
    # A B id has at most as many pairs as A has tokens.
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def looked_up(facts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, count, best = (facts.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    return pair[order], count[order], best[order]


def scored(state: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
    pair, count, best = state
    pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
    doc = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy(zero_copy_only=False))
    at = np.searchsorted(pair, pairs.flatten().to_numpy())
    total, most = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    if len(doc):
        np.add.at(total, doc, times * count[at])
        np.add.at(most, doc, times * best[at])
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(most), pa.array(total), batch.column("groups_sha256")], names=RESULT.replace(" long", "").replace(" string", "").split(", "))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """RESULT: one row for each document."""
    rows = written(tokens(docs, path_a, path_b), "op11-tokens")
    pairs = written(chunk_pairs(rows), "op11-pairs")
    # A pair has at most a row for each batch of a chunk: no key is hot among all pairs of all chunks.
    facts = pairs.select("chunk", "pair").distinct().join(pair_table(pairs).select("pair", "count", "best"), "pair")
    return attach(facts, rows, looked_up, scored, RESULT)
