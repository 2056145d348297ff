"""Exact token counts at every prefix of a text, by dynamic programming over byte-level BPE.

The encoding of a prefix of a pre-token ends in exactly one token; what stands before it is again the encoding
of a shorter prefix. So ``last(p)`` is the one token t ending p for which ``last(p without t)`` followed by t stays
two tokens when merged, and ``count(p) = count(p without t) + 1``. Each distinct prefix is solved once (they
share a table), each distinct chunk once per worker, and a document's counts are a running sum over its chunks.
The stored counts answer how many tokens any cut text has, and where a budget ends, without encoding again.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, texts_of
from .tables import BpeTable, Ragged, bounds, kept, text_of

COUNTS = "doc_id long, n_bytes long, n_tokens long, prefix_tokens array<int>"
TOTALS = "doc_id long, n_bytes long, n_tokens long, within long"


class PrefixTable(BpeTable):
    """Token counts at every character of distinct chunks."""

    pair_limit = 600_000

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        super().__init__(json_path, ranks_path, pattern)
        self.pattern, self.gaps = regex.compile(pattern), regex.compile(r"\s\s+")
        # tokens as a tree from their last byte on: the child of a node by a byte, and the token that a node completes
        self.nodes: dict[int, int] = {}
        self.ends: list[int | None] = [None]
        for t, i in self.ranks.items():
            at = 0
            for c in reversed(t):
                if (at << 8 | c) not in self.nodes:
                    self.nodes[at << 8 | c] = len(self.ends)
                    self.ends.append(None)
                at = self.nodes[at << 8 | c]
            self.ends[at] = i
        merges = json.loads(self.exact.to_str())["model"]["merges"]
        name = {i: t for t, i in self.ranks.items()}
        of = {self.exact.id_to_token(i): t for i, t in name.items()}
        # the parts that a token's last merge joins; ranks grow with every merge
        self.halves = {of[a] + of[b]: (of[a], of[b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)}
        self.name, self.pairs = name, {}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}

    def clear(self) -> None:
        super().clear()
        self.counts = Ragged(np.int32)

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at a token's edge while it is built: each part, and the rank at which the next merge takes it up."""
        known = self.left if side == 0 else self.right
        if token not in known:
            out, part, taken = [], self.name[token], 1 << 30
            while True:
                out.append((part, taken))
                if part not in self.halves:
                    break
                taken, part = self.ranks[part], self.halves[part][side]
            known[token] = out
        return known[token]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before the merges that build both tokens (the left one first when equal)."""
        key = a, b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > self.pair_limit:
                self.pairs.clear()
            rank = self.ranks.get
            ok = True
            for x, until_x in self.spine(a, 1):
                for y, until_y in self.spine(b, 0):
                    m = rank(x + y)
                    if m is not None and m < until_x and m <= until_y:
                        ok = False
                        break
                if not ok:
                    break
            self.pairs[key] = ok
        return ok

    def solve(self, words: list[str]) -> dict[str, list[int]]:
        """Token counts at every character of each pre-token. In sorted order a word begins with what it shares with the one before it, already solved."""
        out: dict[str, list[int]] = {}
        child, ends_of, apart = self.nodes.get, self.ends, self.pairs.get
        before, last, count = b"", [0], [0]
        for raw, word in sorted((w.encode(), w) for w in words):
            same = 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for j in range(same + 1, len(raw) + 1):
                at = 0
                for i in range(j - 1, -1, -1):
                    at = child(at << 8 | raw[i])
                    t = ends_of[at]
                    if t is None:
                        continue
                    if i:
                        ok = apart((last[i], t))
                        if ok is None:
                            ok = self.stay_apart(last[i], t)
                        if not ok:
                            continue
                    last.append(t)
                    count.append(count[i] + 1)
                    break
            before = raw
            if len(raw) == len(word):
                out[word] = count[1:]
            else:
                ends, at = [], 0
                for c in word:
                    at += len(c.encode())
                    ends.append(count[at])
                out[word] = ends
        return out

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text]
        return self.pattern.findall(text)

    def needed(self, text: str) -> list[str]:
        """All strings whose counts ``ordinary`` looks up."""
        found = self.pieces(text)
        found += [w[1:] for w in found if w[0] == "'" and len(w) > 1 and w[1].isalpha()]
        return found + self.gaps.findall(text) if len(found) > 1 else found

    def ordinary(self, text: str, solved: dict[str, list[int]]) -> list[int]:
        """Counts at every character of a text without special tokens."""
        found = self.pieces(text)
        if len(found) == 1 and text[0] != "'":
            return solved[text]
        out: list[int] = []
        before = 0
        for w in found:
            got = solved[w]
            whole = got[-1]
            if w[0] == "'" and len(w) > 1 and w[1].isalpha():
                # while a contraction is incomplete, its apostrophe and letters are pre-tokens of their own
                got = [1, *[1 + x for x in solved[w[1:]][:-1]], whole]
            out.extend(before + x for x in got)
            before += whole
        for run in self.gaps.finditer(text):
            # a cut inside a run of white space leaves the run so far as one pre-token
            base = out[run.start() - 1] if run.start() else 0
            out[run.start() : run.end()] = [base + x for x in solved[run[0]]]
        return out

    def parts(self, text: str) -> list[tuple[str, int]]:
        """Stretches between special tokens, each with all but the last character of the special token after it, and that token's length."""
        if "<|" not in text or not any(x in text for x in self.special):
            return [(text, 0)]
        out, start = [], 0
        for m in regex.finditer("|".join(map(regex.escape, self.special)), text):
            out.append((text[start : m.end() - 1], len(m[0])))
            start = m.end()
        return [*out, (text[start:], 0)] if start < len(text) else out

    def prefixes(self, parts: list[tuple[str, int]], solved: dict[str, list[int]]) -> list[int]:
        """Counts at every character; special tokens count once they are complete."""
        if len(parts) == 1 and not parts[0][1]:
            return self.ordinary(parts[0][0], solved)
        out: list[int] = []
        total = 0
        for text, special in parts:
            here = self.ordinary(text, solved)
            out.extend(total + x for x in here)
            plain = len(text) - max(0, special - 1)
            total += here[plain - 1] if plain else 0
            if special:
                total += 1
                out.append(total)
        return out

    def fill(self, new: list) -> None:
        texts = [self.parts(text_of(c)) for c in new]
        solved = self.solve(list({w for parts in texts for text, _ in parts for w in self.needed(text)}))
        got = [self.prefixes(parts, solved) for parts in texts]
        lens = [len(x) for x in got]
        self.counts.extend(np.fromiter(chain.from_iterable(got), np.int32, sum(lens)), lens)
        self.note_loose(new, np.fromiter(map(self.plain, new), bool, len(new)))


def _run(batches, files: tuple, budget: int, arrays: bool):
    table = kept(PrefixTable, *files)
    for batch in slices(batches):
        texts = texts_of(batch)
        codes, counts = table.documents(texts)
        within, lens = table.counts.take(codes)
        whole = np.zeros(len(codes), np.int64)
        whole[lens > 0] = within[(np.cumsum(lens) - 1)[lens > 0]]
        before = np.cumsum(whole) - whole
        at, first = bounds(lens, counts), np.concatenate([[0], np.cumsum(counts)])
        start = np.concatenate([before, [whole.sum()]])[first]
        running = within + np.repeat(before, lens)
        n = np.diff(start)
        size = [len(t.encode()) for t in texts]
        key = batch.column(0).cast(pa.int64())
        own = [running[a:b] - s for a, b, s in zip(at[:-1], at[1:], start[:-1], strict=True)]
        if arrays:
            last = pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
        else:
            # counts never fall but where white space joins a word, so look for the last prefix within budget
            last = pa.array([int(np.flatnonzero(x <= budget)[-1]) + 1 if len(x) and x[0] <= budget else 0 for x in own], pa.int64())
        yield pa.RecordBatch.from_arrays([key, pa.array(size, pa.int64()), pa.array(n, pa.int64()), last], names=["doc_id", "n_bytes", "n_tokens", "prefix_tokens" if arrays else "within"])


def prefix_counts(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row with ``prefix_tokens``: at place i (from 0) the tokens of the first i + 1 characters.

    Null text counts as empty (no prefixes, 0 tokens); very long texts are counted whole, also where they have no white space. Null ids, ties
    and repeated rows are rows like any other; other columns are not carried, so their names cannot clash. An empty table gives no rows.
    Special strings count as the one token that they are once complete.
    """
    return _apply(docs, (json_path, ranks_path, pattern), 0, True, doc_id, text)


def budget_counts(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Totals read off the same prefix counts, and ``within``: the most characters whose text has at most ``budget`` tokens."""
    return _apply(docs, (json_path, ranks_path, pattern), budget, False, doc_id, text)


def _apply(docs: DataFrame, files: tuple, budget: int, arrays: bool, doc_id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _run(it, files, budget, arrays), COUNTS if arrays else TOTALS)


def tokens_at(prefix_tokens: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from stored counts."""
    n = F.least(n_chars, F.size(prefix_tokens))
    return F.when(n <= 0, F.lit(0)).otherwise(F.try_element_at(prefix_tokens, n.cast("int")))


def characters_within(prefix_tokens: Column, budget: Column) -> Column:
    """The most characters whose text has at most ``budget`` tokens, from stored counts."""
    fits = F.filter(F.transform(prefix_tokens, lambda c, i: F.when(c <= budget, i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(fits), F.lit(0))
