"""Links between similar sets, as DataFrame operations only: no pair is lost, and unlike sets never meet.

Two sets of sizes n and m with a Jaccard similarity of t share at least t / (1 + t) * (n + m) members. So, if the members of
a label are put in one order, their first common member stands among the first n - t * n + 1 of one and the first m - t * m + 1
of the other, and what follows it in either is long enough. The order is rarest first, and each set sends its first members
only. With ``partitioned``, sets are also parted by their size, in steps of t, and meet only in their own partition or the next.

Only connected components are wanted, so what a member's sets hand on does not grow with the square of their number where
they are copies of each other: STARS rounds compare each set with one hub of the member (another one each round), and only
then are the sets that a member has in common, but that are not yet connected, compared in pairs.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import materialise
from siteledger.llm.components import components

STARS = 2


def first_members(sets: DataFrame, least: float, partitioned: bool = False) -> DataFrame:
    """label, member, part, home, node, size, at: what each set sends; at: how many of its members stand before, in the label's order.

    sets: label, node, members (distinct), none of them empty.
    """
    flat = sets.select("label", "node", F.explode("members").alias("member"))
    counts = flat.groupBy("label", "member").agg(F.count("*").alias("n"))
    # A member of one set alone links nothing: it stands first and only counts for the set's size.
    shared = materialise(counts.filter("n > 1"), "members")
    ranked = flat.join(shared, ["label", "member"]).groupBy("label", "node").agg(F.sort_array(F.collect_list(F.struct("n", "member"))).alias("ranked"))
    sized = sets.select("label", "node", F.size("members").alias("size")).join(ranked, ["label", "node"])
    alone = F.col("size") - F.size("ranked")
    upto = (F.col("size") - F.ceil(least * F.col("size") - 1e-6) + 1 - alone).cast("int")
    sends = sized.withColumn("alone", alone).withColumn("upto", upto).filter("upto > 0")
    own = F.floor(F.log(F.col("size").cast("double")) / -log(least) + 1e-9).cast("int") if partitioned and least < 1 else F.lit(0)
    sent = sends.withColumn("own", own).select("label", "node", "size", "alone", "own", F.posexplode(F.slice("ranked", F.lit(1), F.col("upto"))).alias("place", "m"))
    parts = F.array("own", F.col("own") + 1) if partitioned else F.array("own")
    sent = sent.withColumn("part", F.explode(parts))
    return sent.select("label", F.col("m.member").alias("member"), "part", (F.col("part") == F.col("own")).alias("home"), "node", "size", (F.col("alone") + F.col("place")).alias("at"))


KEY = ["label", "member", "part"]


def _fits(a: str, b: str, least: float) -> Column:
    """Whether two sets that share a member can be similar, by their sizes and by what follows it in them. a, b: prefixes of columns."""
    n, m = F.col(f"{a}size"), F.col(f"{b}size")
    need = F.ceil(least / (1 + least) * (n + m) - 1e-6)
    follows = F.least(n - F.col(f"{a}at"), m - F.col(f"{b}at")) >= need
    return follows & (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (F.col(f"{a}home") | F.col(f"{b}home"))


def _open(sent: DataFrame, roots: DataFrame) -> DataFrame:
    """What was sent, with each set's root, for keys whose sets are not all connected."""
    rooted = sent.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy(*KEY).agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select(*KEY)
    return rooted.join(several, KEY)


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """src, dst of the pairs (a, b) of nodes whose sets are similar."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"of_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
    return both.filter(F.col("both") >= least * (F.size("of_a") + F.size("of_b") - F.col("both")) - 1e-9).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def linked(sets: DataFrame, least: float, partitioned: bool = False) -> DataFrame:
    """src, dst: links with the components of all pairs of a label that are similar by ``least`` (over 0) or more.

    sets: label, node (long, distinct over all labels), members (array of distinct values), a written table.
    """
    empty = sets.filter(F.size("members") == 0)
    hubs = empty.groupBy("label").agg(F.min("node").alias("hub"))
    found = materialise(empty.join(hubs, "label").filter("node > hub").select(F.col("node").alias("src"), F.col("hub").alias("dst")), "links")
    sent = materialise(first_members(sets.filter(F.size("members") > 0), least, partitioned), "sent")
    carried = ["node", "root", "size", "at", "home"]
    for turn in range(STARS + 1):
        roots = components(found).select("node", F.col("label").alias("root"))
        todo = materialise(_open(sent, roots), "open")
        if turn < STARS:
            hub = todo.groupBy(*KEY).agg(F.min_by(F.struct(*carried), F.xxhash64("root", F.lit(turn))).alias("hub"))
            faced = todo.join(hub, KEY).filter((F.col("root") != F.col("hub.root")) & _fits("", "hub.", least))
            pairs = faced.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        else:
            one, two = (todo.select(*KEY, F.struct(*carried).alias(n)) for n in ("x", "y"))
            both = one.join(two, KEY).filter((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _fits("x.", "y.", least))
            pairs = both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        found = materialise(found.unionByName(_similar(materialise(pairs.distinct(), "pairs"), sets, least)), "links")
    return found
