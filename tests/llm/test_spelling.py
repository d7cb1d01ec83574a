"""The FM-index and the grouping against comparing every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from devident.llm.fm_index import Index
from devident.llm.queries.spelling import query
from devident.llm.spelling import group_variants, misspelt, near_pairs, roots, runs, vocabulary
from devident.session import materialize


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(count, neighbours):
    form = {}
    for word, n in count.items():
        best = min(neighbours[word], key=lambda x: (-count[x], x), default=None)
        form[word] = best if best is not None and count[best] >= 2 * n else None
    out = {}
    for word, n in count.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] = (form[word], root, n, len(neighbours[word]), count[form[word]] if form[word] else None)
    return out


def fast_neighbours(count):
    """By all single edits that are words, for larger vocabularies."""
    letters = sorted(set("".join(count)))
    out = {}
    for w in count:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[j:] for c in letters for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w)}
        out[w] = {e for e in edits if e in count and e != w}
    return out


def as_dict(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize("seed", range(40))
def test_index_against_every_pair(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc", "abcdéÿ"])
    make = lambda extra="": {"".join(rng.choices(letters + extra, k=rng.randint(2, 9))) for _ in range(rng.randint(1, 60))}
    words = sorted(make())
    queries = sorted(make("z")) + words
    index, found = Index(words), {}
    for prefix in (True, False):
        at, word = index.find(queries, prefix)
        found[prefix] = [(queries[q], index.words[w]) for q, w in zip(at, word)]
        places = list(zip(at.tolist(), word.tolist()))
        assert len(places) == len(set(places))
    expected = {(q, w) for q in queries for w in words if near(q, w)}
    assert set(found[True]) | set(found[False]) == expected
    assert {(q, w) for q, w in expected if w[: len(q) // 2] == q[: len(q) // 2]} <= set(found[True])


def test_index_without_words():
    assert len(Index([]).find(["abc"], True)[0]) == 0 and len(Index(["abc"]).find([], True)[0]) == 0


@pytest.mark.parametrize("block", [(1 << 16, 1 << 22), (40, 40), (200, 400)])
def test_blocks_against_every_pair(rows, block):
    rng = random.Random(7)
    count = {"".join(rng.choices("aaab", k=rng.randint(5, 12))): rng.choice([3, 3, 4, 7, 20, 90]) for _ in range(250)}
    count |= {"".join(rng.choices("éabcdefgh", k=rng.randint(5, 8))): rng.choice([3, 9]) for _ in range(100)}
    known = materialize(rows("word string, n long", list(count.items())))
    pairs = [(r.word, r.near) for r in near_pairs(known, block).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in count for b in count if near(a, b)}
    neighbours = {a: [b for b in count if near(a, b)] for a in count}
    assert as_dict(group_variants(known, block=block)) == grouped(count, neighbours)


def test_roots_of_chains(rows):
    got = {r.word: r.root for r in roots(rows("word string, form string", [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w5")])).collect()}
    assert got == {f"w{i}": "w11" for i in range(11)} | {"x": "w11"}
    assert roots(rows("word string, form string", [])).count() == 0


def test_runs_and_errors(rows):
    data = [(1, "Über×Straße 3D it's ABCĀd"), (2, None), (3, ""), (None, "Words words"), (3, "Äpfel" * 20)]
    docs = rows("doc_id long, text string", data).selectExpr("*", "1 AS word", "2 AS n", "'h' AS h", "'r' AS run")
    found = sorted((r.doc_id or -1, r.run) for r in runs(docs).collect())
    assert found == sorted([(1, w) for w in ("Über×straße", "d", "it", "s", "abc", "d")] + [(-1, "words")] * 2 + [(3, ("Äpfel" * 20))])
    data = [(i, f"longword{chr(97 + i % 26)}é") for i in range(600)] + [(None, "nothing")]
    got = Counter(r.word for r in misspelt(rows("doc_id long, run string", data)).collect())
    assert got == Counter(missing(i, w) for i, w in data) and set(got) != {w for _, w in data}


def missing(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % 97 == 0 else run


def test_empty_and_long(rows):
    empty = rows("doc_id long, text string", [(1, None), (2, "a b c")])
    assert group_variants(materialize(vocabulary(misspelt(runs(empty))))).count() == 0
    long_word = "ab" * 1000
    docs = [(0, f"{long_word} {long_word} {long_word}x"), (0, f"{long_word} {long_word}x {long_word}x " + "short " * 100_000)]
    got = as_dict(group_variants(materialize(vocabulary(runs(rows("doc_id long, text string", docs)).selectExpr("run AS word")))))
    assert got[long_word][3] == 1 and got["short"][2] == 100_000 and got[long_word][0] is None and len(got) == 3


def test_query_against_edits(spark):
    sf_dir = "/root/testdata/sf0.01"
    count = Counter()
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", row.text or "")).items():
            count[missing(row.doc_id, re.sub("[A-Z]+", lambda m: m[0].lower(), run))] += n
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    assert as_dict(query(spark, sf_dir)) == grouped(count, fast_neighbours(count))
