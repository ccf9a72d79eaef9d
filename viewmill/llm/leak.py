"""Passages of held-out test items inside corpus documents (problem 8).

The corpus is read and normalised once. A bitmap of fixed size tells which runs of ``min_words`` words (whole
passages where those are shorter) may stand in an item; documents without such a run, nearly all, end there.
The others go to the blocks of items that they share a run with. Items are cut into blocks by hash; a task
makes the words of its block one generalised suffix automaton and streams its documents through it word by
word: the current state and length are the longest run of words, ending here, that stands in any item. Where
the run has ``min_words`` words, the state on its suffix path that stands for the last ``min_words`` words
names every item that holds them; shorter passages are looked for as a whole. Documents are then trimmed of
leaked spans or dropped by coverage.

Neither items nor documents pass through the driver; only candidate documents are shuffled.

Defined results
* words are runs of letters and digits after leaving out markup tags and invisible characters,
  resolving character entities and folding with NFKC, compared without case;
* a document leaks an item if it holds ``min_words`` consecutive words of its passage, or the whole
  passage if that has fewer (but at least one) words;
* null, empty and wordless texts and passages leak nothing; very long texts are streamed like others;
* repeated items each count; repeated rows of a doc_id give their pairs once, and spans of the text they are in;
* an empty corpus or item table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewmill.session import broadcast_if_small, spread, written

MIN_WORDS = 12
BLOCK_WORDS = 100_000
GROUP_WORDS = 5_000_000
SKETCH_BITS = 26
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TAG = regex.compile(r"</?[A-Za-z!][^<>]*>")
INVISIBLE = regex.compile(r"\p{Cf}+|\p{Variation_Selector}+")
WORD = regex.compile(r"[\p{L}\p{N}]+")


def plain_text(text: str | None) -> str:
    """The text without markup and invisible characters, entities resolved, compatibility forms folded."""
    visible = INVISIBLE.sub("", html.unescape(TAG.sub(" ", text or "")))
    return unicodedata.normalize("NFKC", visible)


def words(plain: str) -> list[str]:
    return [w.casefold() for w in WORD.findall(plain)]


class ItemAutomaton:
    """Generalised suffix automaton over the words of items, with the items of each state."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], min_words: int = MIN_WORDS) -> None:
        self.min_words = min_words
        self.word_ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, [self.word_ids.setdefault(w, len(self.word_ids)) for w in ws]) for i, ws in items if ws]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.holders: list[set[int]] = [set() for _ in self.next]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]  # (words, item) of short passages
        for item, ws in items:
            state = 0
            for w in ws:
                state = up = self.next[state][w]
                while up > 0 and item not in self.holders[up]:
                    self.holders[up].add(item)
                    up = self.link[up]
            if len(ws) < min_words:
                self.whole[state].append((len(ws), item))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.long_enough = [0] * len(self.next)  # topmost state on the suffix path with min_words words
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in order:
            up = self.link[s]
            self.long_enough[s] = self.long_enough[up] or (s if self.length[s] >= min_words else 0)
            self.short[s] = self.short[up] + tuple(self.whole[s])

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, arcs: dict[int, int], length: int) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def matches(self, text_words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, first word, last word) wherever a run of min_words or a whole short passage ends."""
        state = run = 0
        known = self.word_ids.get
        for at, word in enumerate(text_words):
            w = known(word, -1)
            if w < 0:
                state = run = 0
                continue
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state, run = self.next[state][w], run + 1
            else:
                run = 0
            if run >= self.min_words and (top := self.long_enough[state]):
                for item in self.holders[top]:
                    yield item, at - self.min_words + 1, at
            for size, item in self.short[state]:
                if run >= size:
                    yield item, at - size + 1, at


def word_hashes(text_words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(text_words, dtype=object), categorize=False)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, from those of its words."""
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for j in range(size):
        out = out * MULTIPLIER + hashes[j : j + len(out)]
    return out ^ (out >> np.uint64(29))


def as_long(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view("int64"), pa.int64())


def item_windows(items: DataFrame, min_words: int, block_words: int) -> DataFrame:
    """item_id, block, the passage's words, and the hash of every run of words that makes a leak; written once.

    Blocks are hash classes of the items, as many as keep their mean below ``block_words`` words.
    """
    schema = "item_id long, words string, n_words int, size int, hashes array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, sizes, hashes = [], [], [], []
            for item, passage in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := words(plain_text(passage)):
                    ids.append(item)
                    rows.append(found)
                    sizes.append(min(min_words, len(found)))
                    hashes.append(as_long(window_hashes(word_hashes(found), sizes[-1])).to_pylist())
            columns = [pa.array(ids, pa.int64()), pa.array([" ".join(w) for w in rows], pa.string()), pa.array([len(w) for w in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "words", "n_words", "size", "hashes"]
            )

    known = items.where("item_id is not null and passage is not null").select("item_id", "passage")
    table = written(known.mapInArrow(run, schema), "leak-items")
    total = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    return table.withColumn("block", F.expr(f"pmod(xxhash64(item_id), {max(1, -(-total // block_words))})").cast("int"))


def sketch_of(windows: DataFrame) -> np.ndarray:
    """Bitmap of 2^SKETCH_BITS bits, 8 MB whatever the items: a run of words that stands in one has its bit set.

    The pages of the bitmap are made in tasks.
    """
    slot = F.shiftrightunsigned("hash", 64 - SKETCH_BITS)
    slots = windows.select(F.explode("hashes").alias("hash")).select(F.shiftright(slot, 16).cast("int").alias("page"), (slot % (1 << 16)).cast("int").alias("bit")).distinct()

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, bool)
        bits[rows["bit"]] = True
        return pd.DataFrame({"page": rows["page"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    bitmap = np.zeros(1 << (SKETCH_BITS - 3), np.uint8)
    for row in slots.groupBy("page").applyInPandas(page, "page int, bits binary").toLocalIterator():
        bitmap[row.page << 13 : (row.page + 1) << 13] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Documents that may leak: doc_id, text_key, words, n_words and the hashes of runs whose bit is set; written once.

    The one pass over the corpus: every text is normalised once, whatever the number of items and blocks.
    """
    sizes = [r.size for r in windows.select("size").distinct().collect()]  # at most min_words different ones
    shared = docs.sparkSession.sparkContext.broadcast((sorted(sizes), sketch_of(windows)))
    schema = "doc_id long, text_key string, words string, n_words int, hashes array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bitmap = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            of_text = [words(plain_text(t)) for t in texts]
            lengths = np.array([len(w) for w in of_text])
            flat = pa.array([w for ws in of_text for w in ws], pa.string()).dictionary_encode()
            hashes = word_hashes(flat.dictionary.to_pylist())[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)
            row = np.repeat(np.arange(len(texts)), lengths)
            found: dict[int, list[np.ndarray]] = {}
            for size in sizes:
                if len(hashes) < size:
                    continue
                h = window_hashes(hashes, size)
                slot = h >> np.uint64(64 - SKETCH_BITS)
                hit = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                for at in np.flatnonzero(hit & (row[: len(h)] == row[size - 1 :])):
                    found.setdefault(int(row[at]), []).append(h[at])
            at = sorted(found)
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            columns += [pa.array([hashlib.md5(texts[i].encode()).hexdigest() for i in at], pa.string()), pa.array([" ".join(of_text[i]) for i in at], pa.string())]
            columns += [pa.array(lengths[at], pa.int32()), pa.array([np.unique(np.array(found[i])).view("int64") for i in at], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "words", "n_words", "hashes"])

    source = spread(docs.select("doc_id", "text").where("text is not null"))
    return written(source.mapInArrow(run, schema), "leak-candidates")


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def leak_spans(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, text_key (MD5 of the text), item_id, first_word, last_word: numbers of the plain text's words, merged runs.

    Each document goes to the blocks that share one of its runs; a block with more than ``group_words`` words of
    documents is split by text. A task builds its block's automaton and streams its documents through it.
    """
    windows = item_windows(items, min_words, block_words)
    texts = candidates(docs, windows).dropDuplicates(["doc_id", "text_key"])
    of_block = written(windows.select(F.explode("hashes").alias("hash"), "block").distinct(), "leak-windows")
    hits = texts.select("doc_id", "text_key", "n_words", F.explode("hashes").alias("hash")).join(broadcast_if_small(of_block), "hash")
    sent = written(hits.select("doc_id", "text_key", "n_words", "block").distinct(), "leak-blocks")
    split = sent.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_words") / group_words)).cast("int").alias("parts"))
    part = F.expr("pmod(xxhash64(text_key), parts)").cast("int").alias("part")
    routed = sent.join(split, "block").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "block", part)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    left = texts.join(routed, same).select("block", "part", "doc_id", "text_key", "words")
    parts = split.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = windows.select("block", "item_id", "words").join(parts, "block")
    schema = "doc_id long, text_key string, item_id long, first_word int, last_word int"

    def search(texts: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        automaton = ItemAutomaton([(i, w.split(" ")) for i, w in zip(passages["item_id"], passages["words"], strict=True)], min_words)
        rows = []
        for doc, key, text in zip(texts["doc_id"], texts["text_key"], texts["words"], strict=True):
            spans: dict[int, list[tuple[int, int]]] = {}
            for item, a, b in automaton.matches(text.split(" ")):
                spans.setdefault(item, []).append((a, b))
            rows += [(doc, key, item, a, b) for item, of in spans.items() for a, b in merged(of)]
        return pd.DataFrame(rows, columns=["doc_id", "text_key", "item_id", "first_word", "last_word"])

    grouped = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return grouped.applyInPandas(search, schema)


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Leaked spans: doc_id, item_id, first_word, last_word."""
    return leak_spans(docs, items, min_words, block_words).select("doc_id", "item_id", "first_word", "last_word")


@F.udf(
    T.StructType(
        [T.StructField("n_words", T.IntegerType()), T.StructField("leaked_words", T.IntegerType()), T.StructField("text", T.StringType())]
    ),
    useArrow=True,
)
def without_spans(text: str, spans: list) -> dict:
    """The plain text without the given spans of words; needed only for documents with a leak."""
    plain = plain_text(text)
    at = [m.span() for m in WORD.finditer(plain)]
    out, upto, gone = [], 0, 0
    for a, b in merged(sorted((s["first_word"], s["last_word"]) for s in spans)):
        out.append(plain[upto : at[a][0]])
        upto, gone = at[b][1], gone + b - a + 1
    return {"n_words": len(at), "leaked_words": gone, "text": "".join(out) + plain[upto:]}


def decontaminated(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """Every document with its action: ``keep`` (no leak), ``trim`` (spans removed) or ``drop``.

    A document of which more than ``max_coverage`` of the words leaked is dropped: its text becomes null.
    """
    spans = leak_spans(docs, items).groupBy(F.col("doc_id").alias("id"), "text_key").agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))
    of_text = F.col("doc_id").eqNullSafe(F.col("id")) & (F.md5(F.col("text").cast("binary")) == F.col("text_key"))
    joined = docs.select("doc_id", "text").join(spans, of_text, "left").select("doc_id", "text", "spans")
    leaky = joined.where("spans is not null").withColumn("w", without_spans("text", "spans"))
    drop = F.col("w.leaked_words") > F.col("w.n_words") * max_coverage
    cleaned = leaky.select(
        "doc_id",
        F.when(drop, "drop").otherwise("trim").alias("action"),
        F.col("w.n_words").alias("n_words"),
        F.col("w.leaked_words").alias("leaked_words"),
        F.when(~drop, F.col("w.text")).alias("text"),
    )
    kept = joined.where("spans is null").select(
        "doc_id", F.lit("keep").alias("action"), F.lit(None).cast("int").alias("n_words"), F.lit(0).alias("leaked_words"), "text"
    )
    return kept.unionByName(cleaned)
