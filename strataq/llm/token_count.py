"""Token counts under a unigram model by dynamic programming shared through a trie.

A text is cut into pre-tokens by a pattern; distinct pre-tokens go into a trie of bytes. The best score of a prefix is
the best over pieces that end there of the score where the piece begins plus the piece's score, so it is computed once
at each trie node, for all pre-tokens that begin with it; the number of tokens of the best path is kept at the node
where a pre-token ends. A text's count is the sum over its pre-tokens.

The pieces that end at a node are read off an Aho-Corasick automaton of the vocabulary, whose state at a node follows from
the parent's; nodes of one depth are scored together, as arrays.

The pieces are a public vocabulary's; where it has ranks but no scores, rank r scores -ln(r + 1) (Zipf's law) less a
constant. Every byte is a piece, so every pre-token has a path. Ties go to fewer tokens.

Defined cases: null and empty texts have no tokens; pre-tokens beyond ``DEEP`` bytes continue outside the trie with the
same recurrence; a trie holds ``NODES`` nodes at most and goes when its pre-tokens are counted; the table of their counts is
emptied at ``NODES`` entries and 16-byte pieces of pre-tokens. Results don't depend on either, and a worker's memory is bounded
by them, a slice of texts and the longest text. Texts are taken whole, however long; equal texts have equal results; an empty
table gives no rows; other columns pass through, and one named like an output (in any case) is replaced.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import array_udf, quoted, runs, with_result

DEEP = 48
NODES = 300_000
#: Every piece also costs this, so that two pieces don't beat one that is not much rarer.
COST = 8.0


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[bytes, float]:
    """Scores of a rank file's pieces."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    scores = {p: -math.log(r + 1) - COST for p, r in ranks.items()}
    least = min(scores.values(), default=-COST) - COST
    return {bytes([i]): least for i in range(256)} | scores


class Automaton:
    """State: the longest end of what was read that begins a piece. ``first`` and then ``link`` lead through the states of all
    pieces that end there, 0 ends them; ``size`` and ``gain`` are a piece's length and score.

    Every state that goes on has a row of ``table`` with the next state for each byte; the others use the row of their longest
    end that goes on."""

    def __init__(self, scores: dict[bytes, float]):
        after: dict[int, int] = {}
        ends = []
        for piece in scores:
            state = 0
            for c in piece:
                state = after.setdefault(state << 8 | c, len(after) + 1)
            ends.append(state)
        n = len(after) + 1
        edges = np.fromiter(after, np.int64, n - 1)
        parent, byte = edges >> 8, edges & 255  # state k + 1 is entered by edge k
        depth = np.zeros(n, np.int32)
        for k, p in enumerate(parent.tolist(), 1):
            depth[k] = depth[p] + 1
        self.size, self.gain = np.zeros(n, np.int32), np.zeros(n)
        self.size[ends], self.gain[ends] = depth[ends], np.fromiter(scores.values(), float, len(scores))
        inner = np.zeros(n, bool)
        inner[parent] = inner[0] = True
        self.row = np.where(inner, np.cumsum(inner) - 1, 0).astype(np.int32)
        self.table = np.zeros((int(inner.sum()), 256), np.int32)
        self.first, self.link, shorter = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        order = np.argsort(depth, kind="stable")
        for states in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            if states[0]:
                p, c = parent[states - 1], byte[states - 1]
                less = np.where(p > 0, self.table[self.row[shorter[p]], c], 0)
                shorter[states], self.link[states] = less, self.first[less]
                self.table[self.row[p], c] = states
                self.first[states] = np.where(self.size[states] > 0, states, self.link[states])
                own = inner[states]
                self.row[states[~own]] = self.row[less[~own]]
                self.table[self.row[states[own]]] = self.table[self.row[less[own]]]


class Trie:
    """The table of counts, and the scores of the tries that fill it."""

    def __init__(self, scores: dict[bytes, float] | Automaton):
        self.automaton = scores if isinstance(scores, Automaton) else Automaton(scores)
        self.clear()

    def clear(self) -> None:
        self.counts: dict[str, int] = {}
        self.held = 0

    def full(self, more: int = 0) -> bool:
        return self.held + more > NODES

    def count(self, token: str) -> int:
        """Tokens of a pre-token; puts it into the table."""
        self.count_all([token])
        return self.counts[token]

    def count_all(self, tokens: Iterable[str]) -> None:
        """Puts distinct pre-tokens into the table; sorted (as their bytes would be), those that share a node are neighbours."""
        tokens = sorted(tokens)
        words = [t.encode() for t in tokens]
        for start, end in runs([min(len(w), DEEP) for w in words], NODES):
            self.counts.update(zip(tokens[start:end], self.sweep(words[start:end])))
        self.held += sum(1 + len(w) // 16 for w in words)

    def sweep(self, words: list[bytes]) -> list[int]:
        """Tokens of each of some sorted words; one trie, scored depth by depth."""
        a, n = self.automaton, len(words)
        lengths = np.array([min(len(w), DEEP) for w in words])
        width = int(lengths.max())
        text = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        within = np.arange(1, width + 1) <= lengths[:, None]
        fresh = within.copy()  # where a word has a node that the word before hasn't
        fresh[1:] &= ~(np.logical_and.accumulate(text[1:] == text[:-1], axis=1) & within[:-1])
        total = 1 + int(fresh.sum())
        best, tokens, state = np.zeros(total), np.zeros(total, np.int32), np.zeros(total, np.int32)
        nodes = np.zeros((width + 1) * n, np.int32)  # of each depth, by word; the root is 0
        made = 1
        for d in range(1, width + 1):
            here = np.flatnonzero(fresh[:, d - 1])
            new = slice(made, made + len(here))
            nodes[d * n : (d + 1) * n] = np.cumsum(fresh[:, d - 1]) + (made - 1)
            at = state[new] = a.table[a.row[state[nodes[(d - 1) * n + here]]], text[here, d - 1]]
            at = a.first[at]
            since = nodes[(d - a.size[at]) * n + here]
            top, few = best[since] + a.gain[at], tokens[since]
            at = a.link[at]
            left = np.flatnonzero(at)
            while len(left):
                at = at[at > 0]
                since = nodes[(d - a.size[at]) * n + here[left]]
                score, count = best[since] + a.gain[at], tokens[since]
                better = (score > top[left]) | ((score == top[left]) & (count < few[left]))
                top[left[better]], few[left[better]] = score[better], count[better]
                at = a.link[at]
                left = left[at > 0]
            best[new], tokens[new] = top, few + 1
            made = new.stop
        out = tokens[nodes[lengths * n + np.arange(n)]].tolist()
        for k, w in enumerate(words):
            if len(w) > DEEP:
                path = nodes[k::n]
                out[k] = self.beyond(w, best[path].tolist(), tokens[path].tolist(), int(state[path[-1]]))
        return out

    def beyond(self, word: bytes, best: list[float], tokens: list[int], state: int) -> int:
        """Tokens of a word from the scores and numbers of tokens of its first prefixes and the state after them."""
        a = self.automaton
        table, row, first, link, size, gain = map(memoryview, (a.table, a.row, a.first, a.link, a.size, a.gain))
        for end in range(len(best), len(word) + 1):
            state = table[row[state], word[end - 1]]
            at, top, few = first[state], -math.inf, 0
            while at:
                score, count = best[end - size[at]] + gain[at], tokens[end - size[at]]
                if score > top or score == top and count < few:
                    top, few = score, count
                at = link[at]
            best.append(top)
            tokens.append(few + 1)
        return tokens[-1]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(pieces(path))


def counter(vocabulary: str, pattern: str):
    """Arrow UDF: text -> struct of n_tokens and n_pretokens."""

    def make():
        import regex

        find, trie = regex.compile(pattern).findall, Trie(automaton(vocabulary))

        def work(texts: list[str | None]) -> pa.Array:
            found = [find(t) if t else [] for t in texts]
            words = set().union(*found)
            unseen = words.difference(trie.counts)
            if trie.full(len(unseen)):
                trie.clear()
                unseen = words
            trie.count_all(unseen)
            n, m = [sum(map(trie.counts.__getitem__, f)) for f in found], list(map(len, found))
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["n_tokens", "n_pretokens"])

        return work

    return array_udf(make, "struct<n_tokens:long,n_pretokens:long>")


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` and ``n_pretokens``."""
    return with_result(df, counter(vocabulary, pattern)(quoted(text)), ["n_tokens", "n_pretokens"])
