"""Corpus encoding with a public byte-level BPE vocabulary by a tokenization automaton (problem 7).

The merges are compiled one after the other into a deterministic automaton whose arcs are tokens and
whose paths from the start are exactly the token sequences that BPE produces (merge gadgets, after
Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA"). All arcs of one token lead
to one state, so a state is "what may follow this token". For a merge u v -> w the gadget
* copies the state behind u without its arc v and leads all arcs u to the copy: "u v" is no path any more;
* adds an arc w wherever there is an arc u, leading to where v led.
A copy only records what it lacks, so 50,000 merges stay a few arrays.

A pre-split word is encoded by following arcs from left to right: at each position reached, the byte
trie lists the tokens that go on there, and the automaton's table says which are arcs of the current
state. Each position is reached by at most one path, so the time is linear in the word's length (times
the longest token). Decoding emits the bytes of the arcs' labels.

Defined results
* null and empty texts keep their row with an empty list;
* strings of special tokens in a text are ordinary text; no special tokens are added;
* repeated doc_ids keep one row each; very long texts and words need no special handling.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewmill.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_CACHE = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others get the code points from 256 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """Tables of the automaton; merges are added in order of priority."""

    def __init__(self, byte_ids: list[int], size: int) -> None:
        self.labels: list[bytes] = [b""] * size
        self.left = [-1] * size
        self.born = [-1] * size  # the merge that made the token; -1 for bytes
        self.state_of = [0] * size  # the state behind the token's arcs
        self.base, self.owner, self.made = [0], [-1], [-1]  # of each state: below its owner's copies, owner, merge
        self.copies: dict[int, list[int]] = {}  # token: its states, in order of making
        self.copies_made: dict[int, list[int]] = {}
        self.lacks: dict[tuple[int, int], int] = {}  # (owner, token): merge that took the arc away
        self.next: list[dict[int, int]] = [{}]  # byte trie
        self.token_at: list[int] = [-1]
        self.merges = 0
        for byte, token in enumerate(byte_ids):
            self._label(token, bytes([byte]))

    def _label(self, token: int, label: bytes) -> None:
        self.labels[token] = label
        node = 0
        for b in label:
            if b not in self.next[node]:
                self.next[node][b] = len(self.next)
                self.next.append({})
                self.token_at.append(-1)
            node = self.next[node][b]
        self.token_at[node] = token

    def has_arc(self, state: int, token: int) -> bool:
        """Is there an arc ``token`` at ``state``?"""
        while state:
            owner, made = self.owner[state], self.made[state]
            if self.born[token] >= made:  # a later token has an arc where its left part has one
                token = self.left[token]
                continue
            if self.lacks.get((owner, token), made + 1) <= made:
                return False
            older = bisect_right(self.copies_made[owner], self.born[token])
            state = self.copies[owner][older - 1] if older else self.base[state]
        return True

    def add_merge(self, u: int, v: int, w: int) -> None:
        """The merge gadget for ``u v -> w``."""
        k = self.merges
        self.merges += 1
        self.left[w], self.born[w], self.state_of[w] = u, k, self.state_of[v]
        behind = self.state_of[u]
        if self.has_arc(behind, v):
            own = self.owner[behind] == u
            self.base.append(self.base[behind] if own else behind)
            self.owner.append(u)
            self.made.append(k)
            self.copies.setdefault(u, []).append(len(self.base) - 1)
            self.copies_made.setdefault(u, []).append(k)
            self.lacks[u, v] = k
            self.state_of[u] = len(self.base) - 1
        self._label(w, self.labels[u] + self.labels[v])

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        came: list[tuple[int, int] | None] = [None] * (n + 1)
        state = [-1] * (n + 1)
        state[0] = 0
        for i in range(n):
            here = state[i]
            if here < 0:
                continue
            node, j = 0, i
            while j < n:
                node = self.next[node].get(word[j], -1)
                if node < 0:
                    break
                j += 1
                token = self.token_at[node]
                if token >= 0 and state[j] < 0 and self.has_arc(here, token):
                    state[j], came[j] = self.state_of[token], (i, token)
        out: list[int] = []
        at = n
        while at:
            at, token = came[at]
            out.append(token)
        return out[::-1]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.labels[t] for t in ids).decode("utf-8", "replace")


def load(path: str = VOCABULARY) -> MergeAutomaton:
    """Compile a ``.json`` (vocabulary and merges) or ``.tiktoken`` (ranks) file of a byte-level BPE.

    A rank file names no merges: each token's parts are what the merges before it make of its bytes.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        automaton = MergeAutomaton([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], max(vocab.values()) + 1)
        for merge in model["merges"]:
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            automaton.add_merge(vocab[u], vocab[v], vocab[u + v])
        return automaton
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    automaton = MergeAutomaton([ranks[bytes([b])] for b in range(256)], max(ranks.values()) + 1)
    for label, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(label) > 1:
            parts = automaton.encode_word(label)
            if len(parts) != 2:
                raise ValueError(f"{path}: token {rank} isn't made by a merge of two earlier tokens")
            automaton.add_merge(*parts, rank)
    return automaton


class Encoder:
    """Splits and encodes texts; remembers the ids of up to ``WORD_CACHE`` words."""

    def __init__(self, automaton: MergeAutomaton, pattern: str = PATTERN) -> None:
        self.automaton, self.split, self.known = automaton, regex.compile(pattern), {}

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        for word in self.split.findall(text or ""):
            ids = self.known.get(word)
            if ids is None:
                ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
                if len(self.known) >= WORD_CACHE:
                    self.known.clear()
                if len(word) < 64:
                    self.known[word] = ids
            out += ids
        return out


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ids of every row. No shuffle beyond spreading a tiny scan.

    The compiled tables are broadcast; their size is that of the vocabulary, whatever the corpus.
    """
    tables = df.sparkSession.sparkContext.broadcast(load(path))
    rows = spread(df.select(id_col, text_col))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tables.value)
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and the text of every row of ids; a null list gives null."""
    tables = df.sparkSession.sparkContext.broadcast(load(path))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else tables.value.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {id_type}, text string")
