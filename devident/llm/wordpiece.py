"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary's trie gets a failure link per node: where the search goes on once the longest pieces
matched so far are cut off. With each link stands how many pieces that cuts, so that a word's length in pieces is found
in one pass over its characters, and no piece is ever built.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devident.llm.text import utf8, words

CACHED_WORDS = 1_000_000
NONE = -1


@dataclass(frozen=True)
class Automaton:
    """`next[(node, character)]`, `fail[node]`, `popped[node]`; node 0 begins a word, node 1 goes on within one."""

    next: dict
    fail: list[int]
    popped: list[int]

    def count(self, word: str) -> int:
        """The number of pieces of a word; 0 if some rest has no piece."""
        node, pieces = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while (to := step.get((node, c))) is None:
                if fail[node] == NONE:
                    return 0
                pieces += popped[node]
                node = fail[node]
            node = to
        while node != 1:
            if fail[node] == NONE:
                return 0
            pieces += popped[node]
            node = fail[node]
        return pieces


def build(initial: list[str], inner: list[str]) -> Automaton:
    """The automaton of the pieces that begin a word and of those within one. Its size is the vocabulary's."""
    step, final, parent = {}, [False, False], [(NONE, "")] * 2
    for root, pieces in ((0, initial), (1, inner)):
        for piece in pieces:
            node = root
            for c in piece:
                if (to := step.get((node, c))) is None:
                    to = step[node, c] = len(final)
                    final.append(False)
                    parent.append((node, c))
                node = to
            if piece:
                final[node] = True
    fail, popped = [NONE] * len(final), [0] * len(final)
    children: dict = {}
    for (node, _), to in step.items():
        children.setdefault(node, []).append(to)
    level = [0, 1]
    while level := [to for node in level for to in children.get(node, ())]:  # by depth
        for node in level:
            if final[node]:
                fail[node], popped[node] = 1, 1
                continue
            above, c = parent[node]
            at, cut = fail[above], popped[above]
            while at != NONE and (at, c) not in step:
                cut += popped[at]
                at = fail[at]
            if at != NONE:
                fail[node], popped[node] = step[at, c], cut
    return Automaton(step, fail, popped)


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a model file that begin a word, without their mark, and those within one; no control or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    mark = "▁"
    return [p[1:] for p in pieces if p.startswith(mark) and mark not in p[1:] and len(p) > 1], [p for p in pieces if mark not in p]


def token_counts(docs: DataFrame, automaton: Automaton, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """`keep`, n_words, n_tokens and n_unknown of each whole text.

    A word that can't be cut into pieces is one unknown token. NULL, empty and blank texts count 0. Columns of `keep` with the names
    of the counts are replaced by these; `_wp_text` is taken.
    """
    keep = [c for c in keep if c not in ("n_words", "n_tokens", "n_unknown")]
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        count, known = shared.value.count, {}
        for batch in batches:
            rows = []
            for line in utf8(batch.column("_wp_text")):
                parts = words(line)
                if missing := [w for w in set(parts) if w not in known]:
                    if len(known) + len(missing) > CACHED_WORDS:
                        known.clear()
                        missing = list(set(parts))
                    known.update((w, count(w.decode("utf-8", "replace"))) for w in missing)
                pieces = list(map(known.__getitem__, parts))
                unknown = pieces.count(0)
                rows.append((len(parts), sum(pieces) + unknown, unknown))
            columns = [pa.array(list(c), type=pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *columns], names=[*keep, "n_words", "n_tokens", "n_unknown"]
            )

    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_wp_text"))
    return read.mapInArrow(run, f"{fields}, n_words long, n_tokens long, n_unknown long")
