"""Document fingerprints by spot signatures, with DataFrame functions only.

Words are runs of letters and digits, lower-cased. A common word is an anchor; its signature hashes the anchor and the
``CHAIN`` content words that follow it, other common words skipped. The text's start is an anchor too. In a text without
common words, or with nothing else, each word is an anchor of the words after it; a text without words that isn't empty
has its own hash as its signature. The fingerprint is the whole sorted set of hashes, 16 hex digits each, so equal texts
have equal fingerprints, and the likeness of two is the Jaccard coefficient of their sets (1 if both are empty).

``near_pairs`` compares documents with each other: equal sets are one class; sets go to partitions by their length, so
that only neighbouring partitions can hold sets of the asked Jaccard; within those, sets meet at some of their signatures
only, as many as the threshold needs to lose no pair, and lengths and the Jaccard of whole sets decide. ``linked`` tells each
document's class and its number of links. All pairs are given, so of n copies that are near each other n (n - 1) / 2: these two are for tables
without groups of many thousand near copies, and op10's query, which compares two given sets for each document, needs
neither.

Defined cases: a null text is an empty one, whose set is empty; a text of any length is read whole; rows with a null id
come first in order and have one place; the next of a repeated id is the next larger id, whose text with the smallest
hash counts; the last document's next is the first; rows that repeat have a result each; an empty table has none. Only
doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import delete, matched, staged, staged_at

CHAIN = 2
#: The key that stands for a null id.
NONE = -(1 << 63)
#: Ids of a bucket, and parts of the rows of an id that many have.
ROWS, SALTS = 1000, 64
#: Sets that may share a signature before it counts as common.
OFTEN = 1000
#: Common words of four languages.
COMMON = """
the of and to a in is that for it on was with be as by are this at from or an not have but
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch
de la le et les du une que est pour qui dans par pas sur au un avec
el y los se las por con no su para al lo como del una
""".split()


def let(value: str, name: str, body: str) -> str:
    """SQL for body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def mark(*parts: str) -> str:
    """SQL for the hash of some words; those that are null are left out."""
    return f"left(md5(concat_ws(' ', {', '.join(parts)})), 16)"


def signatures(text: str, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures of a text column, as 16 hex digits each; never null."""
    common = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
    following = [f"get(w, get(c, j + {k}))" for k in range(chain)]
    after = [f"get(w, i + {k})" for k in range(chain + 1)]
    start = mark("''", *[f"get(w, {k})" for k in range(chain)])
    first = mark("''", *[f"get(w, get(c, {k}))" for k in range(chain)])
    spots = f"""concat(array({first}), flatten(transform(
        filter(sequence(0, size(c) - 1), j -> c[j] > if(j = 0, 0, c[j - 1] + 1)),
        j -> {let("if(j = 0, -1, c[j - 1])", "p", f"transform(slice(w, p + 2, c[j] - p - 1), a -> {mark('a', *following)})")})))"""
    plain = f"concat(array({start}), transform(sequence(0, size(w) - 1), i -> {mark(*after)}))"
    own = let("filter(sequence(0, size(w) - 1), i -> not (w[i] in (" + common + ")))", "c", f"if(size(c) = 0 or size(c) = size(w), {plain}, {spots})")
    words = f"regexp_extract_all(lower({text}), '[\\\\p{{L}}\\\\p{{N}}]+', 0)"
    none = "cast(array() as array<string>)"
    whole = f"if({text} is null or {text} = '', {none}, array({mark(text)}))"
    return F.expr(let(f"if({text} is null, {none}, {words})", "w", f"if(size(w) = 0, {whole}, sort_array(array_distinct({own})))"))


def fingerprint(sigs: Column | str) -> Column:
    return F.array_join(sigs, "")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two signature columns."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def neighbours(buckets: DataFrame) -> DataFrame:
    """(bucket, previous): each bucket and the one before it, round the end.

    They are put in order by ranges, each of which is ordered on its own; the ranges' ends are few.
    """
    ranged = staged(buckets.repartitionByRange("bucket").select("bucket", F.spark_partition_id().alias("part")), "order")
    ends = ranged.groupBy("part").agg(F.max("bucket").alias("last"))
    one = Window.orderBy("part")
    final = F.last("last").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lag("last").over(one), final).alias("before"))
    inner = F.lag("bucket").over(Window.partitionBy("part").orderBy("bucket"))
    return ranged.withColumn("inner", inner).join(ends, "part").select("bucket", F.coalesce("inner", "before").alias("previous"))


def keyed(docs: DataFrame) -> DataFrame:
    """(k, text) of docs: the id, and the text, neither of them null."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, edited, sigs, next_sigs) of docs (doc_id bigint, text): the last half replaced by the next one's start.

    Ids that follow each other share a bucket, which is about ROWS ids wide where ids lie evenly; texts are shuffled once, by
    bucket, and a window within each looks back from the larger ids. Only a bucket's first text goes to the bucket before.
    Rows without an id, and of ids that more than a ten-thousandth of all rows have, stay where they are: one of each such
    id takes part for all, and what follows it is dealt to the others by salted id.
    """
    own = keyed(docs)
    ids = staged(own.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "ids")
    found = ids.where(F.col("k") != NONE).agg(F.min("k"), F.max("k"), F.count(F.lit(1)), F.sum("n")).first()
    low, high, n, rows = (x or 0 for x in found)
    width = max(1, (high - low + 1) * ROWS // max(1, n))
    often = F.broadcast(ids.where((F.col("k") == NONE) | (F.col("n") > max(100, rows // 10_000))).select("k"))  # 10,001 at most
    bucket = F.when(F.col("k") == NONE, F.lit(-1).cast("bigint")).otherwise(F.expr(f"(cast(k as decimal(20,0)) - {low}BD) div {width}BD")).alias("bucket")
    one = F.struct(F.md5("text").alias("h"), "text")
    apart = own.join(often, "k", "left_semi")
    main = own.join(often, "k", "left_anti").select("k", one.alias("one"), F.lit(False).alias("for_all"))
    main = main.union(apart.groupBy("k").agg(F.min(one).alias("one")).select("k", "one", F.lit(True)))
    # the last row of an id, looking back, has its smallest hash: it stands for the id to those before
    back = Window.partitionBy("bucket").orderBy(F.desc("k"), F.desc("one.h"))
    out = main.select(bucket, "k", "one", "for_all").repartition("bucket")
    out = out.withColumn("sigs", signatures("one.text")).withColumn("later", F.lead("k").over(back))
    follows = F.when(F.col("later").isNull() | (F.col("later") != F.col("k")), F.struct("one.text", "sigs"))
    out = out.withColumn("next", F.last(follows, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    # the first text of each bucket, for the last of the bucket before: one in ROWS of all
    heads = ids.groupBy(bucket).agg(F.min("k").alias("k"))
    heads = staged(heads.join(neighbours(heads.select("bucket")), "bucket").select("k", "previous"), "heads")
    few = heads.count() <= 1_000_000  # 16 MB at most
    heads = main.join(F.broadcast(heads) if few else heads, "k").groupBy("previous").agg(F.min("one").alias("one"))
    heads = heads.select(F.col("previous").alias("bucket"), F.struct("one.text", signatures("one.text").alias("sigs")).alias("head"))
    out = out.join(heads, "bucket", "left").select("k", "one.text", "sigs", "for_all", F.coalesce("next", "head").alias("next"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    follow = out.where("for_all").select("k", "next", F.explode(salts).alias("salt"))
    others = apart.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS))).join(follow, ["k", "salt"])
    out = out.where(~F.col("for_all")).select("k", "text", "sigs", "next").union(others.select("k", "text", signatures("text").alias("sigs"), "next"))
    kept = F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)")
    start = F.expr("substring(next.text, 1, char_length(text) div 2)")
    doc_id, n_chars = F.when(F.col("k") != NONE, F.col("k")).alias("doc_id"), F.char_length("text").cast("bigint").alias("n_chars")
    return out.select(doc_id, "text", n_chars, F.concat(kept, start).alias("edited"), "sigs", F.col("next.sigs").alias("next_sigs"))


def parity(sigs: str) -> Column:
    """Four words of 64 bits, each bit the parity of the signatures (longs) that fall on it: two sets' words differ in at most
    as many bits as the sets differ in signatures."""
    return F.array(*[F.expr(f"aggregate(filter({sigs}, x -> x & 3 = {w}), 0L, (a, x) -> a ^ shiftleft(1L, cast(shiftrightunsigned(x, 2) & 63 as int)))") for w in range(4)])


def near_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(class_mark, other_mark, likeness) of unlike sets with at least this Jaccard, each pair once, and (k, h, mark, class_id) of all rows.

    docs: doc_id, text; k and h are the id and the text's MD5. Classes are equal signature sets, named by a hash of the set
    (mark) and the smallest id that has it (null if none has an id). Empty sets pair with none. Signatures that more than
    OFTEN rows have among their first ones come last in the order that tells which of a set's signatures are looked up; any
    one order of all signatures loses no pair. Pairs whose lengths, or whose parities, exclude the Jaccard go before their
    sets are fetched.
    """
    return _near(docs, least)[:2]


def _near(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """What near_pairs gives, and the folders that it's read from."""
    sets = keyed(docs).select("k", F.md5("text").alias("h"), F.array_sort(F.transform(signatures("text"), lambda x: F.xxhash64(x))).alias("sigs"))
    sets, sets_at = staged_at(sets.withColumn("mark", F.xxhash64("sigs", F.size("sigs"))), "signatures")
    classes = sets.groupBy("mark").agg(F.min(F.when(F.col("k") != NONE, F.col("k"))).alias("class_id"), F.count(F.lit(1)).alias("n"))
    members = matched(sets.select("k", "h", "mark"), classes, "mark", sets.count())
    early = sets.select(F.explode(F.expr("slice(sigs, 1, cast(ceil(0.25 * size(sigs)) as int))")).alias("sig"))
    common, common_at = staged_at(early.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OFTEN), "common")
    small = common.count() <= 1_000_000  # 16 MB at most
    own = sets.where(F.size("sigs") > 0).groupBy("mark").agg(F.first("sigs").alias("sigs"))
    ranked = own.select("mark", F.explode("sigs").alias("sig")).join(F.broadcast(common) if small else common, "sig", "left")
    ranked = ranked.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sig"))).alias("r"))
    size = F.size("r")
    head = ranked.select("mark", size.alias("size"), F.expr("transform(r, x -> x.sig)").alias("sigs"), F.floor(F.log(size) / math.log(1 / least) + 1e-9).cast("int").alias("band"))
    # the longer of two looks with more of its signatures than the shorter, which none of its pairs can miss; a signature stands
    # with its band for the key
    looks = F.expr(f"slice(sigs, 1, cast(size - ceil({least} * size - 1e-9) as int) + 1)")
    found = F.expr(f"slice(sigs, 1, cast(size - ceil({2 * least / (1 + least)} * size - 1e-9) as int) + 1)")
    left = head.select(F.col("mark").alias("a"), F.col("size").alias("a_size"), "band", F.explode(looks).alias("sig")).select("a", "a_size", F.xxhash64("sig", "band").alias("key"))
    right = head.select(F.col("mark").alias("b"), F.col("size").alias("b_size"), "band", F.explode(found).alias("sig"))
    right = right.select("b", "b_size", F.explode(F.array(F.xxhash64("sig", "band"), F.xxhash64("sig", F.col("band") + 1))).alias("key"))
    fit = (F.col("b_size") <= F.col("a_size")) & (F.col("a_size") * least <= F.col("b_size") + 1e-9) & ((F.col("b_size") < F.col("a_size")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, "key").where(fit).select("a", "b", "a_size", "b_size").distinct()
    # sets of a Jaccard of j differ in (1 - j) / (1 + j) of their signatures
    bits = own.select("mark", parity("sigs").alias("bits"))
    differ = F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)")
    pairs = pairs.join(bits.select(F.col("mark").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("mark").alias("b"), F.col("bits").alias("y")), "b")
    pairs = pairs.where(differ <= (1 - least) / (1 + least) * (F.col("a_size") + F.col("b_size")) + 1e-9).select("a", "b")
    pairs = pairs.join(own.select(F.col("mark").alias("a"), F.col("sigs").alias("x")), "a").join(own.select(F.col("mark").alias("b"), F.col("sigs").alias("y")), "b")
    pairs = pairs.select(F.col("a").alias("class_mark"), F.col("b").alias("other_mark"), likeness("x", "y").alias("likeness")).where(F.col("likeness") >= least - 1e-12)
    return pairs, members, [sets_at, common_at]


def linked(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, h, class_id, n_links) of every id and text (by its MD5): its class, and how many other classes are at least so like."""
    pairs, members, folders = _near(docs, least)
    links = pairs.select(F.explode(F.array("class_mark", "other_mark")).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n_links"))
    out = members.join(links, "mark", "left").select(F.when(F.col("k") != NONE, F.col("k")).alias("doc_id"), "h", "class_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    out = staged(out.dropDuplicates(["doc_id", "h"]), "links")
    for folder in folders:
        delete(docs.sparkSession, folder)
    return out


def brute_signatures(text: str | None, chain: int = CHAIN) -> frozenset[tuple]:
    """The signatures as tuples of words; for tests."""
    import regex

    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    if not words:
        return frozenset([(text,)]) if text else frozenset()
    common = set(COMMON)
    content = [i for i, w in enumerate(words) if w not in common]
    out = set()
    if not content or len(content) == len(words):
        out |= {(w, *words[i + 1 : i + 1 + chain]) for i, w in enumerate(words)} | {("", *words[:chain])}
    else:
        out.add(("", *(words[i] for i in content[:chain])))
        for i, w in enumerate(words):
            if w in common and (after := [words[j] for j in content if j > i][:chain]):
                out.add((w, *after))
    return frozenset(out)
