"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark items, one scan of each text.

Text and items are normalised alike: A-Z in lower case, words joined by one space. A window is ``window`` consecutive words of an
item; an item of fewer words is one window. The automaton holds few of a window's words: of each item the pieces of
``(window + 1) // 2`` words that begin at multiples of that number. Every window contains one such piece as a whole, so a place
that matches a piece is compared word by word with the item to both sides, and a run of ``window`` equal words is a hit. A piece
that stands in more than ``MOST_PLACES`` places of items isn't compared; the windows that contain no other piece are in the
automaton as they are, like the short items. So every window is found, and a node serves about one word of an item. What is
found maps back to character offsets of the original text.

The items are collected, broadcast once and made into one automaton by each worker. A benchmark of more than ``most_item_bytes``
of text is refused with an error before any text is read: decontaminate it in parts.

Defined results: a null or empty text has no words and no hits, and a text of any length is scanned as a whole. Items without
words match nothing. An item with a null id counts as the id "". Items that repeat an id are one item; rows of documents that
repeat an id are scanned each by itself. Other columns pass through, whatever their names; columns named like the made ones are
replaced.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_WORD, with_made

#: Bytes of item text that one automaton holds; it takes about fifty bytes of memory for each.
MOST_ITEM_BYTES = 6_000_000
#: Places of items with which a match of a piece is compared.
MOST_PLACES = 16

MADE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


def _normal(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER_WORD).split() if text else []


class Scanner:
    """The automaton, over latin-1 strings, so that a character is a byte; and the items' words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.size = window, (window + 1) // 2
        self.items = [(item, w) for item, w in ((item, _normal(text)) for item, text in items) if w]
        places: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for i, (_, w) in enumerate(self.items):
            if len(w) >= window:
                for at in range(0, len(w) - self.size + 1, self.size):
                    places.setdefault(tuple(w[at : at + self.size]), []).append((i, at))
        places = {piece: found for piece, found in places.items() if len(found) <= MOST_PLACES}
        whole: dict[tuple[bytes, ...], set[str]] = {}
        for item, w in self.items:
            if len(w) < window:
                whole.setdefault(tuple(w), set()).add(item)
            for start in range(len(w) - window + 1):
                at = -(-start // self.size) * self.size
                if tuple(w[at : at + self.size]) not in places:
                    whole.setdefault(tuple(w[start : start + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key in places.keys() | whole.keys():
            self.automaton.add_word((b" " + b" ".join(key) + b" ").decode("latin-1"), (len(key), tuple(whole.get(key, ())), places.get(key, ())))
        if self.items:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """(number of words, hit intervals of words with their ends exclusive, items)"""
        tokens = _normal(text)
        if not self.items or not tokens:
            return len(tokens), [], set()
        matches = list(self.automaton.iter((b" " + b" ".join(tokens) + b" ").decode("latin-1")))
        if not matches:
            return len(tokens), [], set()
        ends = np.cumsum([len(t) + 1 for t in tokens])  # where the space after each word stands
        spans, found, compared = [], set(), {}
        for last, (n, items, places) in zip(np.searchsorted(ends, [e for e, _ in matches]).tolist(), (m for _, m in matches), strict=True):
            start = last - n + 1
            if items:
                spans.append([start, last + 1])
                found.update(items)
            for i, at in places:
                item, w = self.items[i]
                if compared.get((i, start - at), -1) > last:  # in the run of an earlier piece
                    continue
                low, high = start, last + 1
                while low and at > start - low and tokens[low - 1] == w[at - (start - low) - 1]:
                    low -= 1
                while high < len(tokens) and at + high - start < len(w) and tokens[high] == w[at + high - start]:
                    high += 1
                compared[i, start - at] = high
                if high - low >= self.window:
                    spans.append([low, high])
                    found.add(item)
        return len(tokens), _merged(spans), found


def _merged(spans: list[list[int]]) -> list[list[int]]:
    """The union of intervals, in order; intervals that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _offsets(text: str, spans: list[list[int]]) -> list[list[int]]:
    """Character offsets in the original text of intervals of words."""
    if not spans:
        return []
    data = text.encode()
    flat = np.frombuffer(data.translate(LOWER_WORD), np.uint8) != 32
    turn = np.flatnonzero(np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))).reshape(-1, 2)
    chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # of whole code points up to a byte
    return [[int(chars[turn[a, 0]]) - 1, int(chars[turn[b - 1, 1] - 1])] for a, b in spans]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_item_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_hit, items (ids, sorted) and spans (character offsets of the hits).

    ``items`` has item_id and text. A document is contaminated if n_hit > 0.
    """
    asked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if size > most_item_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, more than {most_item_bytes}; decontaminate it in parts")
    sent = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in asked.collect()])
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))

    def maker():
        scanner = Scanner(sent.value, window)

        def row(text: str | None) -> tuple:
            n, spans, found = scanner.scan(text)
            return n, sum(b - a for a, b in spans), sorted(found), _offsets(text, spans)

        def make(texts: list) -> list[pa.Array]:
            rows = [row(t) for t in texts]
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return make

    return with_made(docs, "text", MADE, maker)
