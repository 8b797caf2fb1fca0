"""Word-window deduplication by suffix automata of reference shards.

The reference is cut into shards by anchor; a shard's automaton is built from its distinct fragments, each state knowing
the least document in which its strings end.  Documents' fragments stream through the automaton: the matching statistic
at each word is the longest suffix known to the shard, and the state of its last 13 words tells whether a smaller
document holds them.  A shard has a bounded number of words and is never sent to tasks that hold no text for it, in
place of a broadcast of every shard to every task, whose cost would be shards times documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows

SHARD_WORDS = 20_000


class SuffixAutomaton:
    """Online automaton of several word sequences; least[s]: the least document with an occurrence ending in state s."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [windows.store.NO_ID]
        self._order: list[int] | None = None

    def _state(self, length: int, nxt: dict, link: int, least: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.length) - 1

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, w, q)
                if doc < least[last]:
                    least[last] = doc
                continue
            cur = self._state(length[last] + 1, {}, 0, doc)
            p = last
            while p != -1:
                q = nxt[p].get(w)
                if q is not None:
                    break
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        c = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q], windows.store.NO_ID)
        self.link[q] = c
        nxt, link = self.next, self.link
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def settle(self) -> None:
        """Passes each state's least document on to its suffixes."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(least)), key=self.length.__getitem__, reverse=True):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def statistics(self, words: list, k: int):
        """For each word: (length of the longest suffix known here, least document holding the last k words or None)."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        s, n = 0, 0
        for w in words:
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s, n = nxt[s][w], n + 1
            if n >= k:
                t = s
                while length[link[t]] >= k:
                    t = link[t]
                yield n, least[t]
            else:
                yield n, None


def least_documents(contents: list[bytes], least: np.ndarray, windows_of: np.ndarray, length: int) -> np.ndarray:
    """Builds one shard's automaton and streams its fragments through it."""
    names: dict[bytes, int] = {}
    shard = [[names.setdefault(w, len(names)) for w in c.split(b" ")] for c in contents]
    automaton = SuffixAutomaton()
    for words, doc in zip(shard, least.tolist(), strict=True):
        automaton.add(words, doc)
    automaton.settle()
    out = np.empty(int(windows_of.sum()), np.int64)
    at = 0
    for words in shard:
        got = [d for _, d in automaton.statistics(words, length)][length - 1 :]
        out[at : at + len(got)] = got
        at += len(got)
    return out


def automaton_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 13) -> DataFrame:
    """Removes each word covered by a window of ``length`` words whose sequence also starts in a document of smaller id.

    Returns id_col, n_words, n_removed, spans array<struct<start,end>> (bytes of the text from the first to the last word
    removed), kept binary (kept words joined by one space).  Words are [^\\x20\\x09-\\x0D]+ unchanged.  Null text: no word.
    Null id: after every other id.  Rows with one id are one document.  Texts of fewer words are kept.
    """
    out = windows.remove_repeats(docs, windows.Words(length, min(5, length), SHARD_WORDS), least_documents, id_col, text)
    return out.withColumnRenamed("n_units", "n_words")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = automaton_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
