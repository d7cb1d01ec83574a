"""Golay keys, components and SimHash classes against brute force."""

import random

import numpy as np
import pytest
import xxhash

from devident.llm import golay
from devident.llm.components import components
from devident.llm.simhash import RESEMBLING, TWO_BITS, fingerprint, key_rows, links, near_duplicates, shingle_hashes

DOCS = "doc_id long, text string"


def brute_print(text):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    runs = [b" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: {doc_id: print}"""
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_codewords_keep_seven_bits_apart():
    words = np.arange(1 << 12) << 11
    found, used = golay.keys(words[:200])
    assert used.sum(axis=1).min() >= 1 and set(used.sum(axis=1)) <= {1, 6}


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, len(words))
        (a, in_a), (b, in_b) = golay.keys(words), golay.keys(other)
        assert all(set(x[u]) & set(y[v]) for x, u, y, v in zip(a, in_a, b, in_b))


def test_fingerprint_is_the_contracts():
    for text in (None, "", " \t", "one", "One two", "a b c", "A b C d\x0be é", "x " * 300):
        data = text.encode() if text is not None else None
        assert int(fingerprint(shingle_hashes(data, 3))[0]) == brute_print(text)


def test_keys_find_all_pairs_within_two_bits():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    (ra, ka), (rb, kb) = key_rows(a[:, None], TWO_BITS), key_rows(b[:, None], TWO_BITS)
    for i in range(500):
        assert set(ka[ra == i]) & set(kb[rb == i])


def test_components(spark, rows):
    found = {r.node: r.component for r in components(rows("a long, b long", [(5, 4), (4, 3), (9, 8), (3, 1), (7, 9), (2, 2)])).collect()}
    assert found == {1: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_components_of_nothing(spark, rows):
    assert components(rows("a long, b long", [])).count() == 0


@pytest.mark.parametrize("group", [1, 256])
def test_links_of_hot_groups_lose_nothing(spark, rows, group):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(30)})
    frame = rows("rep long, lane0 long", [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)])
    found = {r.node: r.component for r in components(links(frame, TWO_BITS, group)).collect()}
    want = brute_components(dict(enumerate(prints)))
    assert {i: found.get(i, i) for i in want} == want


@pytest.mark.parametrize("group", [3, 256])
def test_wide_plan_with_hot_groups(spark, rows, group):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    docs = []
    for g in range(4):
        text = rng.choices(vocabulary, k=200)
        for i in range(15):
            copy = list(text)
            if i:
                copy[rng.randrange(200)] = "changed"
            docs.append((g * 100 + i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_duplicates(rows(DOCS, docs), RESEMBLING, group=group).collect()}
    assert got == {d: d // 100 * 100 for d, _ in docs}


def test_edge_cases(spark, rows):
    data = [(1, None), (2, ""), (3, " \n"), (None, "one two three four"), (5, "one two three four"), (6, "one two three four"),
            (6, "a very different text altogether it is"), (7, "a very different text altogether it is"), (None, "nobody else")]
    got = sorted(near_duplicates(rows(DOCS, data).selectExpr("*", "'x' AS lane0", "1 AS component_id"), TWO_BITS).collect(), key=str)
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted(
        [(1, 1), (2, 1), (3, 1), (None, 5), (5, 5), (6, 5), (6, 5), (7, 5), (None, None)], key=str
    )
    assert near_duplicates(rows(DOCS, []), TWO_BITS).count() == 0


def test_query_against_brute_force(spark):
    from devident.llm.queries.simhash import query

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: brute_print(t) for d, t in texts.items()}
    want = brute_components(prints)
    got = query(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in texts}


def test_long_text(spark, rows):
    line = " ".join(f"v{i * 7919 % 5003}" for i in range(60_000))
    got = {r.doc_id: r.component_id for r in near_duplicates(rows(DOCS, [(3, line), (5, line + " end"), (9, "other " * 60_000)]), TWO_BITS).collect()}
    assert got == {3: 3, 5: 3, 9: 9}


def five(text):
    parts = text.lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}


def resembling_components(docs):
    sets = {d: five(t) for d, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_resemblance_against_brute_force(spark, rows):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    docs, near = [], 0
    for g in range(150):
        size = rng.choice([6, 12, 40, 200, 400])
        base = rng.choices(vocabulary, k=size)
        copy = list(base)
        if g % 2:  # places apart, about 0.6 to 0.95
            for at in rng.sample(range(size), max(1, round(size * rng.uniform(0.005, 0.05)))):
                copy[at] = "edited"
        else:
            copy = base[: size - round(size * rng.uniform(0.05, 0.35))]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        a, b = five(docs[-2][1]), five(docs[-1][1])
        near += 0.75 <= len(a & b) / len(a | b) <= 0.85
    line = " ".join(rng.choices(vocabulary, k=12))
    docs += [(1000 + i, " ".join([line, *rng.choices(vocabulary, k=20), line])) for i in range(60)]
    assert near >= 20
    got = {r.doc_id: r.component_id for r in near_duplicates(rows(DOCS, docs), RESEMBLING).collect()}
    assert got == resembling_components(docs)


def test_chain_in_a_hot_group(spark, rows):
    rng = random.Random(12)
    words_ = [f"w{i}" for i in range(100 + 3 * 320)]
    # each resembles its neighbours only, and all have one long run of a word in common
    docs = [(i, " ".join(words_[3 * i : 3 * i + 100])) for i in range(320)]
    head = " ".join(f"common{i}" for i in range(30))
    docs = [(i, f"{head} {t}") for i, t in docs if i != 160] + [(1000 + i, f"{head} other{i} " + " ".join(rng.sample(words_, 9))) for i in range(20)]
    rng.shuffle(docs)
    got = {r.doc_id: r.component_id for r in near_duplicates(rows(DOCS, docs), RESEMBLING).collect()}
    assert got == resembling_components(docs) and len(set(got.values())) < 25
