"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints are computed per text, equal ones fold into one class, and each distinct fingerprint gets
several keys: its bits are cut into segments of at most 23 bits, a segment is decoded to the Golay
codewords nearby, and a key joins two segments. Fingerprints with a common key are candidates and are
verified by their whole distance.

Where texts are linked by the resemblance of their sets of shingles, the keys are shingles of which resembling sets
have one in common, and candidates are verified on the sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devident.llm import golay
from devident.llm.components import components
from devident.llm.text import utf8, words
from devident.session import held, materialize

#: odd multipliers that derive further 64-bit hashes from the first
_MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_CHUNK = 1 << 14
#: one in how many texts tells which shingles are frequent, and how many of these are kept at most
SAMPLED, FREQUENT = 16, 500_000


@dataclass(frozen=True)
class Plan:
    """What links two texts, and the keys that find them.

    `shingle` words; `lanes` times 64 bits of fingerprint. Without `resemblance`, `max_bits` may differ: `bounds` cut the
    fingerprint into segments, and `pairs` are the (exact, decoded) segments that make up a key. With it, texts are linked
    whose sets of shingles have at least that Jaccard similarity; their keys are shingles (`resembling`) and no fingerprint is made.
    """

    shingle: int
    lanes: int
    bounds: tuple[int, ...] = ()
    pairs: tuple[tuple[int, int], ...] = ()
    max_bits: int = 0
    resemblance: float | None = None

    def names(self) -> list[str]:
        return [f"lane{i}" for i in range(self.lanes)]


#: At most 2 of 64 bits: of three segments one is equal, and the next differs in at most 2 bits, so it shares a codeword.
#: Every such pair is found.
TWO_BITS = Plan(3, 1, (0, 22, 43, 64), ((0, 1), (1, 2), (2, 0)), 2)
#: Five-word shingles that resemble each other by 0.8 or more. Keys of fingerprints would miss some of these pairs.
RESEMBLING = Plan(5, 0, resemblance=0.8)


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(29))) * _MIX[lane - 1]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `shingle` words, A-Z in lower case, joined by a space; fewer words: of all."""
    parts = words(text.lower() if text else text)
    if not parts:
        return np.empty(0, dtype=np.uint64)
    n = min(shingle, len(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    line = b" ".join(parts)
    of = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - n + 1].tolist(), ends[n - 1 :].tolist())
    return np.fromiter((of(line[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(parts) - n + 1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Bits that are set in over half of the hashes, per lane; no hashes: zero."""
    out = np.zeros(lanes, dtype=np.uint64)
    for lane in range(lanes):
        counts = np.zeros(64, dtype=np.int64)
        for i in range(0, len(hashes), _CHUNK):
            big = _mixed(hashes[i : i + _CHUNK], lane).astype(">u8")
            counts += np.unpackbits(big.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
        out[lane] = np.packbits(2 * counts > len(hashes)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, plan: Plan, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`carry` columns and the plan's lanes of each whole text, as signed 64-bit numbers."""
    names = plan.names()
    fields = [docs.schema[c] for c in carry]

    def run(batches):
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t, plan.shingle), plan.lanes) for t in utf8(batch.column("_sh_text"))]
            table = np.array(prints, dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(table[:, i]) for i in range(len(names))],
                names=[*carry, *names],
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} long" for n in names])
    return docs.select(*carry, F.col(text).cast("string").alias("_sh_text")).mapInArrow(run, schema)


def _segment(table: np.ndarray, low: int, high: int) -> np.ndarray:
    """Bits [low, high) of rows of unsigned 64-bit lanes."""
    lane, shift = divmod(low, 64)
    bits = table[:, lane] >> np.uint64(shift)
    if shift and shift + high - low > 64:
        bits = bits | table[:, lane + 1] << np.uint64(64 - shift)
    return (bits & np.uint64((1 << (high - low)) - 1)).astype(np.int64)


def key_rows(table: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every row. A key holds the pair's number, the exact bits and a codeword's index."""
    rows, out = [], []
    for number, (first, second) in enumerate(plan.pairs):
        exact = _segment(table, plan.bounds[first], plan.bounds[first + 1])
        index, used = golay.keys(_segment(table, plan.bounds[second], plan.bounds[second + 1]))
        key = (np.int64(number) << 40) | (exact[:, None] << 12) | index
        at = np.nonzero(used)
        rows.append(at[0])
        out.append(key[at])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(classes: DataFrame, plan: Plan) -> DataFrame:
    names = plan.names()

    def run(batches):
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            rows, keys = key_rows(table, plan)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("rep").take(pa.array(rows))], names=["key", "rep"])

    return classes.select("rep", *names).mapInArrow(run, "key long, rep long")


def _links_in_groups(keyed: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) that join all members of a key's group that lie within `max_bits` of each other.

    A group becomes one row (its size is bounded by the caller); only a spanning set of links leaves it.
    """
    lanes = plan.names()
    groups = keyed.groupBy("key").agg(F.collect_list(F.struct("rep", *lanes)).alias("members"))

    def run(batches):
        for batch in batches:
            a, b = [], []
            members = batch.column("members")
            ends = members.offsets.to_numpy()
            flat = members.values
            reps = flat.field("rep").to_numpy()
            table = np.stack([flat.field(c).to_numpy() for c in lanes], axis=1).view(np.uint64)
            for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = table[low:high]
                apart = np.bitwise_count(own[:, None, :] ^ own[None, :, :]).sum(axis=2, dtype=np.uint16)
                near = np.triu(apart <= plan.max_bits, 1)
                label = list(range(high - low))

                def root(x, label=label):
                    while label[x] != x:
                        label[x] = label[label[x]]
                        x = label[x]
                    return x

                for i, j in np.argwhere(near).tolist():
                    if (x := root(i)) != (y := root(j)):
                        label[y] = x
                        a.append(reps[low + i])
                        b.append(reps[low + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long")


def _links_by_flips(classes: DataFrame) -> DataFrame:
    """All links within 2 of 64 bits without comparing members: each fingerprint stands for itself and for
    its 64 one-bit neighbours, and all that share such a word are within 2 bits; they link to the least."""
    flips = F.array(*[F.lit(v) for v in [0] + [(1 << i) if i < 63 else -(1 << 63) for i in range(64)]])
    words_ = classes.select("rep", F.explode(flips).alias("flip"), "lane0").select(
        "rep", F.col("lane0").bitwiseXOR(F.col("flip")).alias("word")
    )
    least = words_.groupBy("word").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return words_.join(least, "word").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def links(classes: DataFrame, plan: Plan, group: int = 256) -> DataFrame:
    """Links (a, b) between representatives whose 64-bit fingerprints differ in at most 2 bits.

    `classes`: rep, lane0; one row per distinct fingerprint. Key groups up to `group` members are verified member by
    member. Members of larger groups go another way, by one-bit flips, which is exact as well.
    """
    lanes = plan.names()
    keyed = _keyed(classes, plan)
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    # rows of keys that two classes have at least, with their fingerprints
    keyed = materialize(keyed.join(sizes.select("key", "n"), "key")).join(classes.select("rep", *lanes), "rep")
    found = _links_in_groups(keyed.filter(F.col("n") <= group), plan)
    hot = keyed.filter(F.col("n") > group)
    return found.unionByName(_links_by_flips(hot.select("rep", "lane0").distinct()))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles in order, 63 bits of each."""
    return np.unique(hashes >> np.uint64(1)).view(np.int64)


def _set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def _small(batches, rows: int = 256):
    """The batches in pieces, so that few texts' shingles are held at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _prefix_length(size, resemblance: float):
    """Of two sets that resemble each other, the first so many elements have one in common, whatever the order."""
    return size - np.ceil(resemblance * size - 1e-9).astype(np.int64) + 1


def frequent_shingles(docs: DataFrame, plan: Plan) -> np.ndarray:
    """Shingles that many texts have, from a sample, at most `FREQUENT`. They only order the shingles; no result depends on them."""

    def run(batches):
        for batch in _small(batches):
            own = [shingle_set(shingle_hashes(t, plan.shingle)) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *own]))], names=["shingle"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "shingle long")
    counts = some.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= 4)
    return np.sort(counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toArrow()["shingle"].to_numpy())


def _sets(docs: DataFrame, plan: Plan, frequent: np.ndarray) -> DataFrame:
    """doc_id, and of the set of shingles its id, its size and its first elements, frequent ones last."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in _small(batches):
            ids, sizes, firsts = [], [], []
            for text in utf8(batch.column("text")):
                own = shingle_set(shingle_hashes(text, plan.shingle))
                ids.append(_set_id(own))
                sizes.append(len(own))
                known = shared.value
                often = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
                order = np.concatenate([own[~often] - np.int64((1 << 63) - 1) - 1, own[often]])
                firsts.append(order[: _prefix_length(np.int64(len(own)), plan.resemblance) if len(own) else 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
                names=["doc_id", "set_id", "size", "firsts"],
            )

    return docs.mapInArrow(run, "doc_id long, set_id long, size long, firsts array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Those of the pairs (a, b) of set ids whose sets resemble each other, compared as a whole, written down."""
    ids = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    def sets(batches):
        for batch in _small(batches):
            own = [shingle_set(shingle_hashes(t, plan.shingle)) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_id(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["set_id", "own"]
            )

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c) for c in ("own_a", "own_b"))
            kept = []
            for x, y in zip(left, right):
                x, y = np.asarray(x.values), np.asarray(y.values)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both / (len(x) + len(y) - both) >= plan.resemblance)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    with held() as hold:
        wanted = hold(classes.join(ids, "set_id").select("set_id", "rep"))
        texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        # a doc_id with several texts gives sets of its own, and some twice
        known = texts.select("text").mapInArrow(sets, "set_id long, own array<long>").join(wanted.select("set_id"), "set_id", "left_semi")
        known = hold(known.groupBy("set_id").agg(F.any_value("own").alias("own")))
        both = pairs.join(known.select(F.col("set_id").alias("a"), F.col("own").alias("own_a")), "a").join(
            known.select(F.col("set_id").alias("b"), F.col("own").alias("own_b")), "b"
        )
        return materialize(both.select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long"))


def resembling(classes: DataFrame, docs: DataFrame, plan: Plan, linked: DataFrame) -> DataFrame:
    """Links (a, b) between set ids that, with those of `linked`, join all sets with a Jaccard similarity of `plan.resemblance` or more.

    `classes`: set_id, rep, size, firsts. Resembling sets share one of their first elements, which are the keys. First each
    set is compared with one set that many of its keys name: of each key's members the one whose keys have the most members,
    as an original has more in common with its copies than these have with each other. Then all pairs with a common
    key whose members the links haven't joined are compared, in a join that a hot key's tasks share; bounds on what a
    pair can have in common, by sizes, places and number of common keys, only drop pairs that can't resemble each other.
    """
    r = plan.resemblance
    with held() as hold:
        keyed = classes.select("set_id", "size", F.posexplode("firsts").alias("place", "key"))
        several = hold(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        shared = hold(keyed.join(several, "key"))
        weights = shared.groupBy("set_id").agg(F.sum("n").alias("weight"))
        heads = shared.join(weights, "set_id").groupBy("key").agg(F.max(F.struct("weight", "set_id"))["set_id"].alias("head"))
        named = shared.join(heads, "key").filter("set_id <> head").groupBy("set_id", "size", "head").agg(F.count("*").alias("n"))
        # a quarter of the keys; pairs with fewer in common are left to the second comparison
        first = named.filter(4 * F.col("n") >= (1 - r) * F.col("size")).groupBy("set_id").agg(F.max(F.struct("n", "head")).alias("m"))
        met = _apart(first.select(F.col("set_id").alias("a"), F.col("m.head").alias("b")), hold(components(linked)))
        easy = _verified(hold(met), docs, classes, plan)
        joined = hold(components(easy.unionByName(linked)))
        # keys of members that aren't all joined
        member = hold(
            shared.join(joined, shared["set_id"] == joined["node"], "left").select(
                "key", "set_id", "size", "place", F.coalesce("component", "set_id").alias("component")
            )
        )
        open_ = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        member = hold(member.join(open_.select("key"), "key"))
        other = member.select("key", *[F.col(c).alias(f"o_{c}") for c in ("set_id", "size", "place", "component")])
        least = F.lit(r / (1 + r)) * (F.col("size") + F.col("o_size")) - 1e-6
        most = F.least("place", "o_place") + F.least(F.col("size") - F.col("place"), F.col("o_size") - F.col("o_place"))
        met = member.join(other, "key").filter(
            (F.col("set_id") < F.col("o_set_id")) & (F.col("component") != F.col("o_component")) & (most >= least)
        )
        counted = hold(met.groupBy(F.col("set_id").alias("a"), F.col("o_set_id").alias("b")).agg(F.count("*").alias("n")))
        known = classes.select("set_id", "size", F.size("firsts").alias("keys"), F.try_element_at("firsts", F.lit(-1)).alias("last"))
        for side in ("a", "b"):
            counted = counted.join(known.select(*[F.col(c).alias(f"{side}_{c}" if c != "set_id" else side) for c in known.columns]), side)
        # all elements up to the lesser last key are counted
        rest = F.when(F.col("a_last") <= F.col("b_last"), F.col("a_size") - F.col("a_keys")).otherwise(F.col("b_size") - F.col("b_keys"))
        able = counted.filter(F.col("n") + rest >= F.lit(r / (1 + r)) * (F.col("a_size") + F.col("b_size")) - 1e-6)
        return easy.unionByName(_verified(hold(able.select("a", "b")), docs, classes, plan))


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that aren't in one component of `joined(node, component)`."""
    for side in ("a", "b"):
        of = joined.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        pairs = pairs.join(of, side, "left")
    return pairs.filter("NOT c_a <=> c_b OR c_a IS NULL").select("a", "b")


def _resembling_documents(docs: DataFrame, plan: Plan, linked: DataFrame | None = None) -> DataFrame:
    """doc_id and component_id by `resembling`, and by the components of `linked(doc_id, component_id)`."""
    with held() as hold:
        marked = hold(_sets(docs, plan, frequent_shingles(docs, plan)))
        classes = hold(marked.groupBy("set_id").agg(
            F.min("doc_id").alias("rep"), F.any_value("size").alias("size"), F.any_value("firsts").alias("firsts")
        ))
        # a doc_id with several texts ties their sets together, as a component of several documents does
        ids = marked.select("doc_id", "set_id").filter("doc_id IS NOT NULL")
        if linked is None:
            ids = ids.select(F.col("doc_id").alias("group"), "set_id")
        else:
            ids = ids.join(linked.distinct(), "doc_id").select(F.col("component_id").alias("group"), "set_id")
        least = ids.groupBy("group").agg(F.min("set_id").alias("b"), F.max("set_id").alias("m")).filter("b < m")
        tied = hold(ids.join(least, "group").filter("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct())
        found = hold(components(resembling(classes.filter("rep IS NOT NULL"), docs, plan, tied).unionByName(tied)))
        own = classes.join(found, classes["set_id"] == found["node"], "left").select(
            "set_id", "rep", F.coalesce("component", "set_id").alias("component")
        )
        least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = hold(own.join(least, "component").select("set_id", "component_id"))
        return materialize(marked.join(named, "set_id").select("doc_id", "component_id"))


def near_or_resembling(docs: DataFrame, near: Plan = TWO_BITS, alike: Plan = RESEMBLING) -> DataFrame:
    """doc_id and component_id of each row, as `near_duplicates` of `near`, with links of either plan followed to the end.

    The fingerprints' links come first; sets that they join aren't compared.
    """
    with held() as hold:
        linked = hold(near_duplicates(docs, near).filter("doc_id IS NOT NULL").select("doc_id", "component_id"))
        return _resembling_documents(_texts(docs), alike, linked)


def _texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def near_duplicates(
    docs: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text", group: int = 256
) -> DataFrame:
    """Per row: `key`, the lanes and `component_id`, the smallest key reachable by links, itself included.

    NULL, empty and blank texts have fingerprint zero and are linked like any other. Rows with a
    repeated key are one node of the links. A row whose key is NULL gets the component of its
    fingerprint, NULL if no row of it has a key. With a resemblance, texts without a word are linked with
    each other, and a set of shingles stands for the fingerprint.
    """
    lanes = plan.names()
    docs = _texts(docs, key, text)
    if plan.resemblance is not None:
        return _resembling_documents(docs, plan).withColumnRenamed("doc_id", key)
    marked = materialize(fingerprints(docs, plan))
    classes = materialize(marked.groupBy(*lanes).agg(F.min("doc_id").alias("rep")))
    # a doc_id with several texts ties their fingerprints together
    repeated = marked.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    tied = marked.join(repeated, "doc_id").join(classes, lanes).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    known = classes.filter("rep IS NOT NULL")
    joined = links(known, plan, group).unionByName(tied)
    found = materialize(components(joined))
    named = classes.join(found, classes["rep"] == found["node"], "left").select(
        *lanes, F.coalesce("component", "rep").alias("component_id")
    )
    return marked.join(materialize(named), lanes).select(F.col("doc_id").alias(key), *lanes, "component_id")
