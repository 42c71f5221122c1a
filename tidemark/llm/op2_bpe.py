"""BPE encoding and decoding as streaming transducers of constant memory.

Encoder. A merge list in rank order works like a clock: at tick r every pair (u, v) of rule r merges.
Text that is still unread can change tokens to its left only by a chain of merges, each of which takes
the token u just left of the changed zone together with what stands at the zone's edge. After that
merge the edge begins with u, so the next merge (u', v') of the chain has a later rank and a v' that
begins with u. The longest such chain, weighed by the lengths of its u, is the merge list's sufficient
lookahead L: tokens that end L or more symbols before the end of what has been read are stable. It is
found by one pass over the rules. The transducer keeps a window of symbols, merges within it, emits the
stable tokens and goes on from the last stable boundary, so its memory depends on L, not on the pre-token.
The argument needs a proper list (each rule's parts are made by earlier rules); for others L is unbounded
and a pre-token is held whole.

Texts of over LONG characters stream from end to end: they are normalized in slices that end where normalization can't
look across, split in a buffer whose last characters wait for what follows, turned to symbols and tokens one by one,
and hashed and decoded a slice of ids at a time. So beside the text itself memory holds one pre-token as text and a constant;
round_trip() never holds a text's ids. encode() and tokenized() return ids, so they hold those of a row.

Decoder. Tokens are mapped to bytes, and a state machine turns bytes to text, holding back only an
incomplete UTF-8 sequence.

The tokenizer file may hold: an NFC, white-space and lower-case normalizer, a split by regex, byte-level
symbols, an end-of-word suffix and added tokens, which are found in the raw text before all else.

Edge cases: a null or empty text has no tokens, and the hashes of the empty string. Texts are encoded
whole. Repeated rows give repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_arrow, text_or_empty

#: Symbols that the transducer reads at once beyond the lookahead.
CHUNK = 1024
#: Characters from which a text streams, those of a slice of it, and those at a buffer's end that may belong to another
#: pre-token once more is read (splits look ahead by a few characters, as in 're).
LONG, PART, EDGE = 1 << 16, 1 << 15, 64
#: Distinct chunks (pre-tokens between spaces) whose tokens a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 300_000, 48
#: The characters with the property White_Space besides U+0020.
WHITE_ASCII = "\t\n\x0b\x0c\r"
WHITE = WHITE_ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = 1 << 60

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> int | None:
    """L in symbols, an upper bound by chains of rules; None if the list is not proper."""
    made: dict[tuple[str, ...], int] = {}
    for rank, (u, v) in enumerate(merges):
        made.setdefault(u + v, rank)
    best: dict[tuple[str, ...], int] = {}
    most = longest = 0
    for rank, (u, v) in enumerate(merges):
        if made.get(u, -1) >= rank or made.get(v, -1) >= rank:
            return None
        reach = len(u) + max((best.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        if reach > best.get(u, 0):
            best[u] = reach
        most, longest = max(most, reach), max(longest, len(u) + len(v))
    return most + longest


class Memo:
    """A bounded memory of two generations: when the young one is full it becomes the old one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def get(self, key: str) -> tuple[int, ...] | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: tuple[int, ...]) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Bpe:
    """A tokenizer file's encoder and decoder."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: rank of a pair of ids, the id that each rule makes, symbols in each id.
        self.rank = {vocab[u] << 20 | vocab[v]: i for i, (u, v) in enumerate(pairs)}
        self.makes = [vocab[u + v] for u, v in pairs]
        bare = [t[: -len(suffix)] + "\0" if suffix and t.endswith(suffix) else t for t in (x for p in pairs for x in p)]
        #: For chains a word's last symbol is its byte with a mark: "a</w>" is another symbol than "a".
        units = [tuple(x[:-2]) + (x[-2:],) if x.endswith("\0") else tuple(x) for x in bare]
        self.lookahead = sufficient_lookahead(list(zip(units[::2], units[1::2])))
        self.length = {i: max(1, len(t[: -len(suffix)] if suffix and t.endswith(suffix) else t)) for t, i in vocab.items()}
        alphabet = byte_alphabet()
        self.inner = [vocab.get(c) for c in alphabet]
        self.final = [vocab.get(c + suffix) for c in alphabet]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added_re = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if spec.get("pre_tokenizer") else []
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        if split is None:
            raise ValueError("a split by regex is needed")
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"), regex.V0)
        norms = spec["normalizer"].get("normalizers", [spec["normalizer"]]) if spec.get("normalizer") else []
        self.norms = [n["type"] for n in norms]
        if set(self.norms) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"unknown normalizers: {self.norms}")
        if any(" " in p for p in self.split.findall("a b  c 1 2 . , ' 's\" é  ")):
            raise ValueError("pre-tokens with white space are not supported")
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.joiner = " " if spec.get("decoder") is None else ""
        to_byte = {c: b for b, c in enumerate(alphabet)}
        level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.bytes_of = {i: bytes(to_byte[c] for c in t) if level and t not in self.added else t.encode() for i, t in tokens.items()}
        self.text_of = {i: str(i) for i in tokens}
        self.memo, self.pieces = Memo(MEMO), Memo(MEMO)

    # -- encoding

    def merged(self, ids: list[int]) -> list[int]:
        """The ids after all merges: lowest rank first, leftmost first among equals."""
        if len(ids) > 64:
            return self._merged_long(ids)
        rank, makes = self.rank.get, self.makes
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = new = makes[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | new, NONE)
            if i < len(ranks):
                ranks[i] = rank(new << 20 | ids[i + 1], NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a linked list and a heap, for windows: O(n log n)."""
        rank, makes, n = self.rank.get, self.makes, len(ids)
        ids = [*ids, -1]  # the end
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or rank(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j] = makes[r], -1
            after[i] = k = after[j]
            before[k] = i
            if k < n and (r := rank(ids[i] << 20 | ids[k])) is not None:
                heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in ids if t >= 0]

    def transduce(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one pre-token's symbols, each emitted once no further symbol can change it."""
        if self.lookahead is None:
            yield from self.merged(list(symbols))
            return
        limit, source, window = self.lookahead + CHUNK, iter(symbols), []
        while True:
            window += islice(source, limit - len(window))
            if len(window) < limit:  # the end is in the window
                yield from self.merged(window)
                return
            stable, used = len(window) - self.lookahead, 0
            for t in self.merged(window[:]):
                if used + self.length[t] > stable:
                    break
                used += self.length[t]
                yield t
            del window[:used]
            limit += CHUNK * (not used)  # the first token is longer than what is stable

    def symbols(self, piece: str) -> list[int]:
        """Byte symbols of a pre-token, the last with the end-of-word suffix."""
        raw = piece.encode("utf-8", "replace")
        inner = self.inner
        return [*[inner[b] for b in raw[:-1]], self.final[raw[-1]]]

    def symbol_stream(self, piece: str) -> Iterator[int]:
        """The same one by one."""
        inner, last = self.inner, len(piece) - 1
        for at in range(0, last, PART):
            yield from (inner[b] for b in piece[at : min(last, at + PART)].encode("utf-8", "replace"))
        yield from self.symbols(piece[last])

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of normal text without white space."""
        ids: list[int] = []
        for piece in self.split.findall(chunk):
            found = self.pieces.get(piece)
            if found is None:
                found = tuple(self.transduce(self.symbols(piece)))
                if len(piece) <= MEMO_CHARS:
                    self.pieces.put(piece, found)
            ids += found
        out = tuple(ids)
        if len(chunk) <= MEMO_CHARS:
            self.memo.put(chunk, out)
        return out

    def normal(self, text: str) -> str:
        """Normal text; runs of white space stay as runs, as no pre-token holds any."""
        plain = text.isascii()
        for kind in self.norms:
            if kind == "NFC" and not plain:
                text = unicodedata.normalize("NFC", text)
            elif kind == "Lowercase":
                text = (text if plain else text.replace("Σ", "σ")).lower()  # by character: no final sigma
        for c in WHITE_ASCII if plain else WHITE:
            if c in text:
                text = text.replace(c, " ")
        return text

    def normal_slices(self, text: str, start: int, stop: int) -> Iterator[str]:
        """normal() of text[start:stop] in parts, cut before characters that compose with nothing before them."""
        while start < stop:
            end = min(stop, start + PART)
            while end < stop and not inert(text[end]):
                end += 1
            yield self.normal(text[start:end])
            start = end

    def stream_part(self, text: str, start: int, stop: int) -> Iterator[int]:
        """Ids of text[start:stop] without added tokens, one by one."""
        rest, waiting, need = "", [], 0
        for part in chain(self.normal_slices(text, start, stop), (None,)):
            waiting.append(part or "")
            need -= len(part or "")
            done = part is None
            if need > 0 and not done:
                continue
            buffer, at = rest + "".join(waiting), 0
            waiting.clear()
            for m in self.split.finditer(buffer):
                if not done and m.end() > len(buffer) - EDGE:
                    break
                at = m.end()
                piece = m[0]
                found = self.pieces.get(piece) if len(piece) <= MEMO_CHARS else None
                if found is None:
                    if len(piece) > MEMO_CHARS:
                        yield from self.transduce(self.symbol_stream(piece))
                        continue
                    found = tuple(self.transduce(self.symbols(piece)))
                    self.pieces.put(piece, found)
                yield from found
            rest = buffer[at:]
            need = len(rest)  # a pre-token that goes on is searched again at twice the length: linear in all

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text, one by one."""
        at = 0
        for m in self.added_re.finditer(text) if self.added_re else ():
            yield from self.stream_part(text, at, m.start())
            yield self.added[m[0]]
            at = m.end()
        yield from self.stream_part(text, at, len(text))

    def ids(self, text: str) -> Iterable[int]:
        """Ids of a text: as a list, or one by one if it is long."""
        return self.stream(text) if len(text) > LONG else self.encode(text)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if len(text) > LONG:
            ids += self.stream(text)
            return ids
        at = 0
        for m in self.added_re.finditer(text) if self.added_re else ():
            self._encode(text[at : m.start()], ids)
            ids.append(self.added[m[0]])
            at = m.end()
        self._encode(text[at:] if at else text, ids)
        return ids

    def _encode(self, text: str, ids: list[int]) -> None:
        memo, young = self.memo, self.memo.young
        for chunk in self.normal(text).split(" "):
            found = young.get(chunk)
            if found is None:
                if not chunk:
                    continue
                found = memo.get(chunk)
                if found is None:
                    found = self.chunk_ids(chunk)
                young = memo.young
            ids += found

    # -- decoding

    def decode(self, ids: Iterable[int]) -> str:
        d = Decoder(self)
        return d.feed(ids) + d.close()


class Decoder:
    """Incremental byte-to-text state machine: feed() returns the text that is complete so far."""

    def __init__(self, bpe: Bpe):
        self.bytes_of, self.joiner = bpe.bytes_of, bpe.joiner.encode()
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        raw = self.joiner.join(map(self.bytes_of.__getitem__, ids))
        if raw and self.begun:
            raw = self.joiner + raw
        self.begun = self.begun or bool(raw)
        return self.state.decode(raw)

    def close(self) -> str:
        return self.state.decode(b"", True)


def inert(c: str) -> bool:
    """No canonical composition has *c* as its second character, and it reorders with nothing."""
    return c.isascii() or (unicodedata.category(c)[0] == "L" and not "\u1100" <= c <= "\u11ff")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def let_go() -> None:
    """Drop the tables and the memory of words, as a task's end does: a worker lives on for steps that need neither."""
    load.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


#: Ids that are hashed and decoded at once.
SLICE = 16_384


def digest(bpe: Bpe, ids: Iterable[int]) -> tuple[int, str, str]:
    """Number of tokens, hash of the ids, hash of the decoded text."""
    sha_ids, sha_text, decoder, n, source = hashlib.sha256(), hashlib.sha256(), Decoder(bpe), 0, iter(ids)
    while part := list(islice(source, SLICE)):
        sha_ids.update((" " * bool(n) + " ".join(map(bpe.text_of.__getitem__, part))).encode())
        sha_text.update(decoder.feed(part).encode())
        n += len(part)
    sha_text.update(decoder.close().encode())
    return n, sha_ids.hexdigest(), sha_text.hexdigest()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every document's text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(text_or_empty(docs), run, "doc_id long, ids array<int>", let_go)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of every row's ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(i or ()) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string", let_go)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every document, with digests of both results."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        rows = [digest(bpe, bpe.ids(t)) for t in batch.column(1).to_pylist()]
        n, a, b = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(text_or_empty(docs), run, SCHEMA, let_go)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the digests of round_trip(): the last stage of a corpus."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, rows = load(path), []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text)
            rows.append((ids, *digest(bpe, ids)))
        kinds = (pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(text_or_empty(docs), run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", let_go)
