"""SpotSigs fingerprints, as DataFrame operations only.

Common words are anchors: those that make up at least 1 in COMMON of all words of a language, for languages with at
least 1 in SPREAD of all words (so there are SPREAD * COMMON anchors at most). At each anchor a spot signature is taken:
a 32-bit hash of the anchor and of the CHAIN content words that follow it, other anchors left out. A text's fingerprint is
the sorted set of its signatures, eight hex digits each. Texts without a spot are signed at every content word instead,
texts of anchors alone as a whole, and a text without words has the empty fingerprint. A word is a run of letters and digits.

Fingerprints are compared by Jaccard similarity. Sets are partitioned by their length, in steps of the least similarity that
is asked for: sets of partitions that are not next to each other cannot reach it, and count as 0 without being compared.

Defined cases: a null text is like an empty one, and two empty fingerprints have a likeness of 1 (one of them: 0); very long
texts are read whole; documents are ordered by (doc_id, digest of the text), null ids first, so ties have an order; repeated
rows are one document there and return a row each; a single document is its own next one; an empty table gives an empty
result; lang only serves to count common words, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.common import materialise
from siteledger.llm.components import components
from siteledger.llm.setjoin import linked

COMMON, SPREAD = 200, 100
CHAIN = 3
#: Likeness under this counts as 0.
LEAST = 0.1


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", -1), lambda w: w != "")


def common_words(docs: DataFrame) -> list[str]:
    """The anchors. At most COMMON words of each of at most SPREAD languages reach the driver."""
    each = docs.select(F.col("lang").cast("string").alias("of"), F.explode(words(F.col("text").cast("string"))).alias("word"))
    counts = materialise(each.groupBy("of", "word").agg(F.count("*").alias("n")), "words")
    size = counts.groupBy("of").agg(F.sum("n").alias("size"))
    whole = size.agg(F.sum("size").alias("whole"))
    large = size.join(whole, SPREAD * F.col("size") >= F.col("whole")).select(F.col("of").alias("large"), "size")
    found = counts.join(large, F.col("of").eqNullSafe(F.col("large")) & (COMMON * F.col("n") >= F.col("size")))
    return sorted({r.word for r in found.select("word").collect()})


def signatures(text: Column, anchors: list[str]) -> Column:
    """The sorted set of a text's spot signatures."""
    is_anchor = (lambda w: w.isin(anchors)) if anchors else (lambda w: F.lit(False))

    def of(all_words: Column, content: Column, spots: Column) -> Column:
        chain = lambda k: [F.get(content, k + i if i else k) for i in range(CHAIN)]
        # The j-th anchor, at place i, has i - j content words before it.
        at_spots = F.transform(spots, lambda i, j: F.when(i - j < F.size(content), F.hash(F.get(all_words, i), *chain(i - j))))
        at_spots = F.filter(at_spots, lambda s: s.isNotNull())
        everywhere = F.transform(content, lambda w, k: F.hash(F.lit(""), *chain(k)))
        only_anchors = F.when(F.size(all_words) > 0, F.array(F.hash(F.concat_ws(" ", all_words)))).otherwise(F.array().cast("array<int>"))
        plain = F.when(F.size(content) > 0, everywhere).otherwise(only_anchors)
        return F.sort_array(F.array_distinct(F.element_at(F.transform(F.array(at_spots), lambda s: F.when(F.size(s) > 0, s).otherwise(plain)), 1)))

    def split(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(is_anchor(x), i)), lambda i: i.isNotNull())
        return F.struct(w.alias("words"), F.filter(w, lambda x: ~is_anchor(x)).alias("content"), places.alias("spots"))

    parts = F.transform(F.array(words(text)), split)
    return F.element_at(F.transform(parts, lambda p: of(p["words"], p["content"], p["spots"])), 1)


def fingerprint(signs: Column) -> Column:
    return F.concat_ws("", F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")))


def partition(size: Column, least: float) -> Column:
    """Sets whose lengths differ by more than the factor 1 / least are at least two partitions apart, or one."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -F.log(F.lit(least)) + 1e-9)


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """The Jaccard similarity of two sets of signatures, 0 where it is under ``least``."""
    n, m = F.size(a), F.size(b)
    apart = F.abs(partition(n, least) - partition(m, least)) > 1
    both = F.size(F.array_intersect(a, b))
    exact = F.element_at(F.transform(F.array(both), lambda x: x / (n + m - x)), 1)
    pruned = F.when(apart | (F.least(n, m) < least * F.greatest(n, m)), 0.0).otherwise(F.when(exact >= least, exact).otherwise(0.0))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(pruned)


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id: documents whose fingerprints are linked by a likeness of ``least`` and more; the smallest id names a class.

    Equal fingerprints are one set. Sets meet only in neighbouring partitions of length and by a rare signature that both have
    early in their order; their similarity is then computed. No link between different sets is lost.
    """
    anchors = common_words(docs)
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce(F.col("text").cast("string"), F.lit("")), anchors).alias("signs")), "signatures")
    nodes = materialise(rows.groupBy("signs").agg(F.min("doc_id").alias("least_id")).withColumn("node", F.monotonically_increasing_id()), "sets")
    sets = nodes.select(F.lit("all").alias("label"), "node", F.col("signs").alias("members"))
    labels = components(linked(sets, least, partitioned=True)).select("node", F.col("label").alias("root"))
    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    classes = materialise(named.join(smallest, "root").select("signs", "class_id"), "classes")
    return rows.join(classes, "signs").select("doc_id", "class_id")


def following(docs: DataFrame) -> DataFrame:
    """doc_id, digest, next_id, next_digest: the next document, after the last the first. docs: doc_id, digest, one row a document.

    Documents are dealt by ranges; what follows the last of a range is the first of the next.
    """
    dealt = docs.select("doc_id", "digest").repartitionByRange("doc_id", "digest")
    ranged = materialise(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    here = F.struct("doc_id", "digest")
    order = Window.partitionBy("part").orderBy("doc_id", "digest")
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first")).collect()  # a row for each task
    after = {}
    firsts.sort(key=lambda r: r.part)
    for k, r in enumerate(firsts):
        after[r.part] = firsts[(k + 1) % len(firsts)].first
    starts = docs.sparkSession.createDataFrame([(p, f.doc_id, f.digest) for p, f in after.items()], "part int, first_id long, first_digest string")
    linked = ranged.withColumn("next", F.lead(here).over(order)).join(F.broadcast(starts), "part")
    ends = F.col("next").isNull()
    return linked.select("doc_id", "digest", F.when(ends, F.col("first_id")).otherwise(F.col("next.doc_id")).alias("next_id"), F.when(ends, F.col("first_digest")).otherwise(F.col("next.digest")).alias("next_digest"))


def edits(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the sizes of the sets.

    In the edited text the last quarter of the code points is replaced by the first as many (or all) of the next document.
    """
    anchors = common_words(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    sizes = materialise(texts.groupBy("doc_id", "digest").agg(F.max(F.length("text")).alias("n_chars")), "sizes")
    links = following(sizes)
    wanted = links.join(sizes.withColumnsRenamed({"doc_id": "i", "digest": "d"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).select("doc_id", "digest", "next_id", "next_digest", F.floor(F.col("n_chars") / 4).cast("int").alias("share"))
    wanted = materialise(wanted, "wanted")
    # The texts are dealt once, and serve as the next document's and as their own.
    dealt = texts.repartition(F.coalesce("doc_id", F.lit(0)), "digest")
    giver = wanted.select(F.col("doc_id").alias("to_id"), F.col("digest").alias("to_digest"), F.col("next_id").alias("doc_id"), F.col("next_digest").alias("digest"), "share")

    def same(a: DataFrame, b: DataFrame) -> list[Column]:
        null_safe = lambda c: [F.coalesce(c["doc_id"], F.lit(0)), c["doc_id"].isNull()]
        return [*(x == y for x, y in zip(null_safe(a), null_safe(b), strict=True)), a["digest"] == b["digest"]]

    given = dealt.join(giver, same(dealt, giver)).select("to_id", "to_digest", F.expr("substring(text, 1, share)").alias("piece"), signatures(F.col("text"), anchors).alias("next_signs"))
    # Repeated rows give the same piece.
    given = given.groupBy(F.col("to_id").alias("doc_id"), F.col("to_digest").alias("digest")).agg(F.first("piece").alias("piece"), F.first("next_signs").alias("next_signs"))
    n = F.length("text")
    both = dealt.join(given, same(dealt, given)).select(dealt["doc_id"], n.alias("n_chars"), "text", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.col("piece")).alias("edited"), "next_signs")
    signed = both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("text"), anchors).alias("signs"), signatures(F.col("edited"), anchors).alias("edited_signs"), "next_signs")
    signs, edited, after = F.col("signs"), F.col("edited_signs"), F.col("next_signs")
    return signed.select("doc_id", "n_chars", "edited_sha256", fingerprint(signs).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"), likeness(signs, edited, least).alias("near_edited"), likeness(signs, after, least).alias("near_next"))
