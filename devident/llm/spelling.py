"""Spelling variants: words at one inserted, deleted or replaced code point, and the frequent form they go back to.

Two such words share the first or the second half of either exactly. The vocabulary is dealt by the ends of these halves into
blocks of a bounded size; each block is a bidirectional FM-index in which a half is matched exactly and the other one
with an error (`fm_index`). A block holds all words with some beginnings (or endings); a beginning with too many words
is split into several index parts, and its queries, in as many parts, meet every index part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devident.llm.fm_index import Index
from devident.session import materialize

# fixed values: what a word is made of, and which letters are lower-cased
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: code points of a half that decide where a word is dealt; longer ones share an end of that length
END = 4
#: code points of a block at least, if there are enough, and at most
BLOCK = (1 << 16, 1 << 22)
PAIRS = "word string, n long, near string, near_n long"


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, run) for every maximal run of letters of every text, A-Z lower-cased. NULL and empty texts have none."""
    found = F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(RUN), F.lit(0))
    return docs.select(F.col("doc_id").alias("doc_id"), F.explode(found).alias("run")).select(
        "doc_id", F.translate("run", UPPER, LOWER).alias("run")
    )


def misspelt(found: DataFrame, one_in: int = 97) -> DataFrame:
    """(word) per run: its code point h mod length is deleted where `one_in` divides h, the crc32 of `<doc_id>:<run>`.

    A NULL doc_id counts as empty.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.pmod("h", F.lit(one_in)) == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the words of at least `min_length` code points with at least `min_count` rows. Counted before the exchange."""
    long_enough = words.filter(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _ends(half: Column, first: bool) -> Column:
    """The end of a half, of END code points at most, that decides the block."""
    size = F.least(half, F.lit(END))
    return F.substring("word", F.lit(1), size) if first else F.substring(F.col("word"), F.length("word") - size + 1, size)


def _dealt(known: DataFrame, first: bool) -> DataFrame:
    """(side, end, word, n, asks): every word under the ends by which a query of its length, or one more or less, looks for it.

    `asks`: it is the end by which the word itself looks.
    """
    length = F.length("word")
    halves = [(length + d) / 2 if first else (length + d) - F.floor((length + d) / 2) for d in (-1, 0, 1)]
    ends = [_ends(F.floor(h).cast("int"), first) for h in halves]
    found = known.withColumn("own", ends[1]).withColumn("end", F.explode(F.array_distinct(F.array(*ends))))
    return found.select(F.lit(first).alias("side"), "end", "word", "n", (F.col("end") == F.col("own")).alias("asks"))


def near_pairs(known: DataFrame, block: tuple[int, int] = BLOCK) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of words of `known(word, n)` at exactly one inserted, deleted or replaced
    code point, once. Words are distinct, not NULL and of two code points at least; no words, no pairs.

    A block holds between `block` code points, following the number of shuffle partitions; an end with more is split. The
    time of a block also grows with its longest word, whose letters are matched one after the other.
    """
    spark = known.sparkSession
    total = known.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    size = min(max(2 * total // int(spark.conf.get("spark.sql.shuffle.partitions")), block[0]), block[1])
    shards = max(1, -(-2 * total // size))
    dealt = _dealt(known, True).unionByName(_dealt(known, False))
    # an end over the block's size is a block of its own, in parts; there are at most 4 * total / size of these
    weights = dealt.groupBy("side", "end").agg(F.sum(F.length("word") + 1).alias("weight")).filter(F.col("weight") > size)
    large = materialize(weights.select("side", "end", F.ceil(F.col("weight") / size).cast("int").alias("parts")))
    placed = dealt.join(large, ["side", "end"], "left").withColumn("salt", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    small = F.concat(F.lit("#"), F.pmod(F.xxhash64("end"), F.lit(shards)).cast("string"))
    # (index part, query part): a row of an index part in front of every query part, a query in front of every index part
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("held"), F.col("asks")))).otherwise(
        F.concat(
            F.transform(others, lambda j: F.struct(F.col("salt").alias("i"), j.alias("j"), F.lit(True).alias("held"), F.lit(False).alias("asks"))),
            F.when(F.col("asks"), F.transform(others, lambda i: F.struct(i.alias("i"), F.col("salt").alias("j"), F.lit(False).alias("held"), F.lit(True).alias("asks")))).otherwise(
                F.array().cast("array<struct<i:int,j:int,held:boolean,asks:boolean>>")),
        )
    )
    cell = placed.select(
        "side", F.when(F.col("parts").isNull(), small).otherwise(F.col("end")).alias("shard"), "word", "n", F.explode(cells).alias("c")
    ).select("side", "shard", "c.i", "c.j", "word", "n", "c.held", "c.asks")

    def search(key, table):
        words, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
        held, asks = table.column("held").to_pylist(), table.column("asks").to_pylist()
        count = {w: n for w, n, is_held in zip(words, counts, held) if is_held}
        index, prefix = Index(list(count)), key[0].as_py()
        queries = [(w, n) for w, n, is_query in zip(words, counts, asks) if is_query]
        at, found = index.find([w for w, _ in queries], prefix)
        rows = [(*queries[q], index.words[w], count[index.words[w]]) for q, w in zip(at.tolist(), found.tolist())]
        if not prefix:  # what shares the first half as well was found by it
            rows = [r for r in rows if not r[2].startswith(r[0][: len(r[0]) // 2])]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], names=["word", "n", "near", "near_n"])

    return cell.groupBy("side", "shard", "i", "j").applyInArrow(search, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms(word, form)`, one form per word and no circles: where following the forms ends.

    Every round doubles the steps taken, so the rounds are the logarithm of the longest chain.
    """
    links = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while links.filter("moved").limit(1).count():
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(
            links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        )
    return links.select("word", "root")


def group_variants(known: DataFrame, factor: int = 2, block: tuple[int, int] = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `known(word, n)`.

    `form`: the most frequent word nearby (ties: the first in code-point order) if it is at least `factor` (2 or more) times as
    frequent, else NULL; `root`: the last of the forms' chain, the word itself without one. `known` is read more than once:
    pass a written table. No words: no rows.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form")))
    found = near_pairs(known, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.rank") >= factor * F.col("n")
    judged = known.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, -F.col("best.rank")).alias("form_n"),
    )
    judged = materialize(judged)
    ends = roots(judged.filter("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
