"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

The automaton recognises every run of words of every item.  A document's words stream through it; at each word
it knows the longest run of item words that ends there.  Words inside a run of at least ``window`` words, or
inside a whole shorter item, are hit.

Items are normalised to word hashes.  Only stretches of a document whose adjacent words all follow each
other somewhere in an item are walked: no run can be matched outside of them, so nothing is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_file, new_folder, write_file
from .text import ALNUM, buffers, chunks, packed, unpacked, words

#: Bytes of item texts per automaton; a larger benchmark makes more automata, which documents pass one after the other.
AUTOMATON_BYTES = 1 << 20


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.window = window
        items = [(name, h) for name, h in items if len(h)]
        self.names = [name for name, _ in items]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.prefixes = np.zeros(1 << 16, bool)
        self.prefixes[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        numbered = [np.searchsorted(self.vocabulary, h).tolist() for _, h in items]
        for row in numbered:
            last = 0
            for w in row:
                last = self._extend(last, w)
        v = len(self.vocabulary)
        pairs = [np.array(r[:-1], np.int64) * v + np.array(r[1:], np.int64) for r in numbered if len(r) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.shortest = min((min(len(r), window) for r in numbered), default=window)
        # Items by the state of each of their windows, and short items by the state of the whole.
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, row in enumerate(numbered):
            state = 0
            for i, w in enumerate(row):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items.setdefault(self._suffix(state, window), set()).add(k)
            if len(row) < window:
                self.short.setdefault(self._suffix(state, len(row)), []).append((len(row), k))
        # The nearest state up the links, itself included, where a short item ends.
        self.near = [-1] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near[s] = s if s in self.short else self.near[self.link[s]]

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        new = len(self.len)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """Part the shorter strings of ``q`` off, those that end transitions from ``p`` and up."""
        copy = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _suffix(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a string of ``state``."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def arrays(self) -> list[np.ndarray]:
        """The automaton as flat arrays, in the order of :data:`FLAT`: states' transitions, items and short items one after the other."""
        states = range(len(self.len))
        edges = [sorted(x.items()) for x in self.next]
        first = lambda rows: np.cumsum([0, *map(len, rows)])
        items = [sorted(self.items.get(s, ())) for s in states]
        short = [self.short.get(s, []) for s in states]
        raw = [b"" if n is None else n.encode() for n in self.names]
        flat = [
            [self.window, self.shortest], self.vocabulary, self.prefixes, self.pairs,
            first(edges), [w for e in edges for w, _ in e], [t for e in edges for _, t in e], self.link, self.len, self.near,
            first(items), [k for x in items for k in x], first(short), [n for x in short for n, _ in x], [k for x in short for _, k in x],
            first(raw), np.frombuffer(b"".join(raw), np.uint8), [n is None for n in self.names],
        ]
        return [np.asarray(x, kind) for x, kind in zip(flat, FLAT, strict=True)]


#: Kinds of the arrays of a flat automaton.
FLAT = (np.int64, np.uint64, bool, np.int64, *[np.int32] * 11, np.int64, np.uint8, bool)


class Mapped:
    """A flat automaton in a memory map: a worker holds the pages that it touches."""

    def __init__(self, data):
        (meta, self.vocabulary, self.prefixes, self.pairs, *states, at, raw, unnamed) = unpacked(data, *FLAT)
        self.window, self.shortest = meta.tolist()
        (self.first, self.word, self.to, self.link, self.len, self.near, self.item_at, self.item, self.short_at, self.short_len, self.short_item) = (x.data for x in states)
        self._names = at, raw, unnamed

    def name(self, k: int) -> str | None:
        at, raw, unnamed = self._names
        return None if unnamed[k] else raw[at[k] : at[k + 1]].tobytes().decode()

    def step(self, state: int, w: int) -> int:
        """The state after a word, -1 if there is none.  The root has a transition for every word."""
        if not state:
            return self.to[w]
        end = self.first[state + 1]
        i = bisect_left(self.word, w, self.first[state], end)
        return self.to[i] if i < end and self.word[i] == w else -1

    def suffix(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a string of ``state``."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def walk(self, row: list[int], base: int, spans: list[tuple[int, int]], found: set[int]) -> int:
        """Stream word numbers; add hit spans, from ``base`` on, and found items.  The longest match."""
        state = length = longest = 0
        for i, w in enumerate(row):
            while (to := self.step(state, w)) < 0:
                state = self.link[state]
                length = self.len[state]
            state, length = to, length + 1
            longest = max(longest, length)
            end = base + i + 1
            if length >= self.window:
                spans.append((end - self.window, end))
                s = self.suffix(state, self.window)
                found.update(self.item[self.item_at[s] : self.item_at[s + 1]])
            s = self.near[state]
            while s > 0:
                for j in range(self.short_at[s], self.short_at[s + 1]):
                    n = self.short_len[j]
                    if n <= length:
                        spans.append((end - n, end))
                        found.add(self.short_item[j])
                s = self.near[self.link[s]]
        return longest

    def scan(self, h: np.ndarray, off: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int], int]]:
        """``{text: (hit spans in words of the text, items, longest match)}`` of the texts with a match to report."""
        out: dict[int, tuple[list, set, int]] = {}
        if not len(self.vocabulary) or not len(h):
            return out
        maybe = np.flatnonzero(self.prefixes[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h[maybe]
        pos, num = maybe[known], at[known]
        if not len(pos):
            return out
        text = np.searchsorted(off, pos, "right") - 1
        code = num[:-1].astype(np.int64) * len(self.vocabulary) + num[1:]
        joined = (pos[1:] == pos[:-1] + 1) & (text[1:] == text[:-1])
        if len(self.pairs):
            spot = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined &= self.pairs[spot] == code
        else:
            joined[:] = False
        starts = np.concatenate([[0], np.flatnonzero(~joined) + 1])
        ends = np.concatenate([starts[1:], [len(pos)]])
        long = ends - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            t = int(text[a])
            spans, found, longest = out.setdefault(t, ([], set(), 0))
            longest = max(longest, self.walk(num[a:b].tolist(), int(pos[a] - off[t]), spans, found))
            out[t] = (spans, found, longest)
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans united where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def build(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> list[str]:
    """Automata of the benchmark in the shared folder, by URI.

    Distinct items are dealt by a hash into blocks of about ``AUTOMATON_BYTES`` bytes; a task builds each.  URIs alone come to the driver.
    """
    folder = new_folder(benchmark.sparkSession, "automata")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    size = benchmark.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(-(-size // AUTOMATON_BYTES) or 1)))

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending"), ("text", "ascending")])
        h, _, _, off = words(*buffers(table.column("text")), ALNUM)
        names = table.column("item").to_pylist()
        automaton = Automaton([(name, h[a:b]) for name, a, b in zip(names, off[:-1], off[1:], strict=True)], window)
        uri = f"{folder}/{table.column('block')[0].as_py()}"
        write_file(uri, packed(*automaton.arrays()))
        return pa.table({"uri": [uri]})

    return sorted(r["uri"] for r in blocks.groupBy("block").applyInArrow(make, "uri string").collect())


@lru_cache(maxsize=None)
def _load(uri: str) -> Mapped:
    return Mapped(map_file(uri))


def _scan_all(uris: list[str], h: np.ndarray, off: np.ndarray):
    """Spans, item names and longest match by text, over all automata."""
    out: dict[int, tuple[list, set, int]] = {}
    for uri in uris:
        automaton = _load(uri)
        for t, (spans, found, longest) in automaton.scan(h, off).items():
            s, f, n = out.get(t, ([], set(), 0))
            out[t] = (s + spans, f | {automaton.name(k) for k in found}, max(n, longest))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, longest, item_ids, spans``, one row per document.

    ``spans`` are ``(start, length)`` in words, united where they touch.  ``item_ids`` are the ids, as sorted strings, of items with
    a window in the document; items without an id are matched but not named.  Null and empty texts have no words;
    repeated rows are judged alike; without items nothing is hit.  Only the two named columns are read.
    """
    uris = build(benchmark, window)
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, _, _, off = words(*buffers(batch.column(1)), ALNUM)
            found = _scan_all(uris, h, off)
            n = batch.num_rows
            spans = [merged(found[i][0]) if i in found else [] for i in range(n)]
            names = [sorted(x for x in found[i][1] if x is not None) if i in found else [] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(off), pa.int64()),
                    pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                    pa.array([found[i][2] if i in found else 0 for i in range(n)], pa.int64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array([[{"start": a, "length": b - a} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "longest", "item_ids", "spans"],
            )

    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, longest bigint, item_ids array<string>, spans array<struct<start:bigint,length:bigint>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def _without(uris: list[str], text: str, max_coverage: float) -> str | None:
    """A text without its hit spans, repeated as long as the joined rest is hit; None where more than ``max_coverage`` was hit."""
    total = lost = 0
    while True:
        data, offs = buffers(pa.array([text], pa.large_string()))
        h, start, end, off = words(data, offs, ALNUM)
        total = total or len(h)
        spans = merged(_scan_all(uris, h, off).get(0, ([], set(), 0))[0])
        if not spans:
            return text
        lost += sum(b - a for a, b in spans)
        if lost > max_coverage * total:
            return None
        raw, keep, at = data.tobytes(), [], 0
        for a, b in spans:
            keep.append(raw[at : start[a]])
            at = int(end[b - 1])
        text = b"".join([*keep, raw[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents, all columns kept, without matched spans of ``window`` words and whole shorter items.

    Documents with a larger share of hit words than ``max_coverage`` go.  Texts without a hit, null ones too, stay
    byte for byte.  ``n_chars`` is set anew where a text was cut, if the table has that column.
    """
    uris = build(benchmark, window)
    k = docs.columns.index(text)
    c = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            h, _, _, off = words(*buffers(batch.column(k)), ALNUM)
            hit = sorted(t for t, (spans, _, _) in _scan_all(uris, h, off).items() if spans)
            if not hit:
                yield batch
                continue
            keep = np.ones(batch.num_rows, bool)
            texts = batch.column(k).to_pylist()
            lengths = batch.column(c).to_pylist() if c is not None else None
            for t in hit:
                cut = _without(uris, texts[t], max_coverage)
                keep[t] = cut is not None
                texts[t] = cut
                if lengths is not None:
                    lengths[t] = len(cut or "")
            columns = list(batch.columns)
            columns[k] = pa.array(texts, batch.schema.field(k).type)
            if c is not None:
                columns[c] = pa.array(lengths, batch.schema.field(c).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)

