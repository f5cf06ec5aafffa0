"""Token counts that follow edits: a segment tree of pre-token counts per document.

The pattern cuts a text into pre-tokens, each of which is encoded alone. A tree keeps them in slots
of up to SLOT pre-tokens and the sums of characters and tokens over them, so a place is found and a
slot's sums are renewed in logarithmic time. An edit re-encodes from the first pre-token whose match
could see the edited place (the pattern looks at most LOOK characters past a match) up to the first
cut after the edit that is also a cut of the old text: a match depends on nothing before its start,
so from there on all cuts and counts stand.

Results in special cases: a null or empty text counts 0; edits outside a text are cut to it; an
edit with a null replacement deletes; texts are counted whole; rows are independent, so repeated
rows give repeated results and an empty table an empty one; only doc_id, text and edits are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import map_texts, table, texts_of

SLOT = 64
LOOK = 2
#: Entries of a worker's table of known pre-tokens; it starts anew when full.
KNOWN = 1 << 18

CUT = regex.compile(public_tokenizers.PATTERN)


class _Counts(dict):
    """Pre-token -> number of tokens, filled on demand."""

    def __init__(self, ranks: str):
        self.piece = bpe.from_ranks(ranks)._encode_single_piece

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        n = self[token] = len(self.piece(token.encode()))
        return n


@lru_cache(maxsize=4)
def counts(ranks: str = bpe.RANKS) -> _Counts:
    return _Counts(ranks)


class TokenTree:
    """n_tokens of a text, kept up to date by edit(start, end, replacement)."""

    def __init__(self, text: str, ranks: str = bpe.RANKS):
        self.text, self.known, self.reencoded = text, counts(ranks), 0
        self._build([(len(x), self.known[x]) for x in CUT.findall(text)])

    def _build(self, tokens: list[tuple[int, int]]) -> None:
        self.slots = [tokens[i : i + SLOT] for i in range(0, len(tokens), SLOT)] or [[]]
        self.leaves = 1 << (len(self.slots) - 1).bit_length()
        self.slots += [[] for _ in range(self.leaves - len(self.slots))]
        # sums[k] of node k: its children are 2k and 2k+1, slot i is node leaves + i; columns: characters, tokens
        self.sums = np.zeros((2 * self.leaves, 2), np.int64)
        flat = np.array(tokens, np.int64).reshape(-1, 2)
        if len(flat):
            self.sums[self.leaves : self.leaves - (-len(flat) // SLOT)] = np.add.reduceat(flat, np.arange(0, len(flat), SLOT))
        level = self.leaves
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1][1])

    def _slot(self, char: int) -> tuple[int, int]:
        """The slot that holds a character, and where the slot starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if char >= start + self.sums[node][0]:
                start += int(self.sums[node][0])
                node += 1
        return node - self.leaves, start

    def _renew(self, slot: int) -> None:
        node = self.leaves + slot
        self.sums[node] = np.array(self.slots[slot], np.int64).reshape(-1, 2).sum(0)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str | None) -> None:
        """Replace text[start:end]."""
        size, new = len(self.text), replacement or ""
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        shift = len(new) - (end - start)
        text = self.text = self.text[:start] + new + self.text[end:]
        slot, at = self._slot(max(0, start - LOOK - 1))
        kept = []
        for n, tokens in self.slots[slot]:
            if at + n >= start - LOOK:
                break
            kept.append((n, tokens))
            at += n
        place, first, old = at, slot, at
        index, fresh, settled = len(kept), [], end + shift
        rest: list[tuple[int, int]] = []
        while place < len(text) or old < size:
            if place >= settled and old + shift == place:  # an old cut after the edit
                rest = self.slots[slot][index:]
                break
            if place >= len(text) or old + shift < place:  # old pre-tokens that were in the way
                while slot < self.leaves and index >= len(self.slots[slot]):
                    slot, index = slot + 1, 0
                if slot == self.leaves:
                    break
                old += self.slots[slot][index][0]
                index += 1
                continue
            found = CUT.match(text, place)
            fresh.append((found.end() - place, self.known[found[0]]))
            place = found.end()
        self.reencoded += len(fresh)
        if slot >= self.leaves:
            slot, rest = self.leaves - 1, []
        touched = range(first, slot + 1)
        for s in touched:
            self.slots[s] = []
        self.slots[first] = kept + fresh + (rest if slot == first else [])
        if slot != first:
            self.slots[slot] = rest
        if len(self.slots[first]) > 8 * SLOT:
            self._build([x for s in self.slots for x in s])
        else:
            for s in touched:
                self._renew(s)


def count_edited(docs: DataFrame, ranks: str = bpe.RANKS) -> DataFrame:
    """Counts before and after each document's edits.

    docs: doc_id, text, edits array<struct<start, end, replacement>>, applied in order, each to the
    text that the one before left. Returns doc_id, n_tokens, n_tokens_after, n_chars_after and
    n_reencoded, the pre-tokens that the edits had to encode again.
    """

    def run(texts: list[str], rest: dict) -> dict:
        out = {k: [] for k in ("n_tokens", "n_tokens_after", "n_chars_after", "n_reencoded")}
        for text, edits in zip(texts, rest["edits"].to_pylist(), strict=True):
            tree = TokenTree(text, ranks)
            before = tree.n_tokens
            for e in edits or ():
                if e:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"])
            for k, v in zip(out, (before, tree.n_tokens, len(tree.text), tree.reencoded), strict=True):
                out[k].append(v)
        return {"doc_id": rest["doc_id"]} | out

    return map_texts(texts_of(docs, "edits"), "text", run, "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_reencoded long")


def with_review_edits(docs: DataFrame) -> DataFrame:
    """The edits of the query: a note before the text, a redaction of up to 24 characters in the middle, and the last line's end removed."""
    n = F.length(F.coalesce("text", F.lit("")))
    note, gone = F.lit("Reviewed: "), F.lit("[removed]")
    edit = lambda start, end, new: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("replacement"))
    middle = F.floor(n / 2) + 10
    after = n + 10 - F.least(F.lit(24), n + 10 - middle) + 9
    return texts_of(docs).withColumn("edits", F.array(edit(F.lit(0), F.lit(0), note), edit(middle, middle + 24, gone), edit(after - 5, after, F.lit(None).cast("string"))))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(with_review_edits(table(spark, sf_dir, "documents")))
