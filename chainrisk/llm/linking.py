"""Links between classes that meet in token lists, without listing the pairs inside a family.

Pivots first: the most central group of each list and size band (the one whose lists are
longest, as are those of a text that others were copied from) is tried by the others, which
links large families of near copies by as many checks as members.  What that leaves apart
tries several members of the list's largest part, and what a list still holds outside its
largest part meets the whole list.  Pairs inside a part are not enumerated; every link
between two parts is checked.  Lists are read once with the parts that the pivots left
(``first``); only those that are long or hold a large part are read again after each turn.
Turns end when the whole lists would make no more pairs than there are entries, or when a turn
has hardly lowered that number; they are shortcuts only, so none of this changes a link.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.components import components, spread_join
from chainrisk.sources.staging import release, stage

#: Members of a list's largest part that the rest of the list tries, and how often.
PIVOTS, PIVOT_TURNS = 8, 2
#: Entries up to which a list without a large part keeps the parts that the pivots left.
SHORT_LIST = 64

Verify = Callable[[DataFrame], DataFrame]


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose class is an end of the staged pairs (a, b), staged."""
    ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "ends")
    found = stage(rows.join(ends, "class", "left_semi"), "of-pairs")
    release(ends)
    return found


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` with the component (part) of every class after more links between classes."""
    of = lambda c: parts.select(F.col("class").alias(c), F.col("part").alias(f"p{c}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    label = components(edges).select(F.col("v").alias("part"), "label")
    found = spread_join(parts, label, "part", "class").withColumn("part", F.coalesce("label", "part"))
    return stage(found.select(*parts.columns), "parts")


def _open_lists(listed: DataFrame) -> DataFrame:
    """Entries of the token lists that hold several parts, with the list's largest part (main).

    ``held`` is the size of that part, ``length`` that of the list.
    """
    sizes = listed.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(
        F.max_by("part", F.struct("k", "part")).alias("main"),
        F.max("k").alias("held"),
        F.sum("k").alias("length"),
        F.count(F.lit(1)).alias("parts"),
    )
    return stage(listed.join(main.where("parts > 1").drop("parts"), "token"), "open")


def linked_parts(
    entries: DataFrame, member: DataFrame, verify: Verify, percent: int, possible: Column, overlap: int = 1
) -> DataFrame:
    """Columns class and part of every row of ``member``: the components of all links.

    ``entries`` are the token lists: token, group, head (a class of the group), n (set
    size), and the columns that ``possible`` names with 1 and 2 behind them for the two
    sides of a pair.  ``member`` has group and class.  ``verify`` stages the true links of
    staged pairs (a, b) of classes.  Pairs whose sizes are further apart than ``percent``, that
    are not ``possible``, or that share fewer than ``overlap`` lists (fewer than ``least``,
    an entry's overlap needed by its size, if that is less) are not tried.
    """
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    repeated = stage(entries.join(lists, "token"), "repeated")
    weights = repeated.groupBy("group").agg(F.sum("k").alias("weight"))
    entries = stage(repeated.drop("k").join(weights, "group"), "entries")
    release(repeated)
    banded = entries.withColumn("band", F.floor(F.log(100 / percent, F.col("n"))))
    pivots = banded.groupBy("token", "band").agg(F.max_by("head", F.struct("weight", "head")).alias("pivot"))
    # Sets that need fewer shared values than ``overlap`` (column least) meet in as many lists.
    counted = overlap > 1
    enough = lambda *least: F.col("k") >= (F.least(F.lit(overlap), *least) if counted else F.lit(1))
    met = lambda *least: [F.count(F.lit(1)).alias("k"), *(F.first(c).alias(c) for c in least if counted)]
    star = banded.join(pivots, ["token", "band"]).groupBy("group", "pivot").agg(*met("least"))
    star = star.where(enough("least")).select("group", "pivot")
    own = member.groupBy("group").agg(F.min("class").alias("pivot"))
    tries = (
        star.unionByName(own)
        .join(member, "group")
        .where(F.col("class") != F.col("pivot"))
        .select(F.col("class").alias("a"), F.col("pivot").alias("b"))
        .distinct()
    )
    alone = member.select("group", "class", F.col("class").alias("part"))
    parts = _merged(alone, verify(stage(tries, "tries"))).withColumn("first", F.col("part"))
    listed = stage(entries.join(parts.select("group", "first", "part").distinct(), "group"), "listed")
    open_lists = _open_lists(listed)
    read = listed.count()
    release(listed)
    short = (F.col("held") < PIVOTS) & (F.col("length") <= SHORT_LIST)
    settled, busy = open_lists.where(short), open_lists.where(~short)
    last = None
    for turn in range(PIVOT_TURNS):
        # Where the largest part is small, meeting the whole list costs no more.
        large = busy.where(F.col("held") >= PIVOTS)
        left = large.where("part <> main").agg(F.sum("length")).first()[0] or 0
        # No turn where whole lists make no more pairs than entries, or the last one closed few.
        if left <= read or (last is not None and left * 10 > last * 9):
            break
        last = left
        draws = [F.min_by("head", F.xxhash64("head", F.lit(turn * PIVOTS + k))) for k in range(PIVOTS - 1)]
        draws.append(F.max_by("head", F.struct("weight", "head")))
        chosen = large.where("part = main").groupBy("token").agg(F.array_distinct(F.array(*draws)).alias("heads"))
        rest = large.where("part <> main").select("token", "group", "part")
        tries = (
            rest.join(chosen, "token")
            .select("group", "part", F.explode("heads").alias("b"))
            .distinct()
            .join(parts.withColumnRenamed("class", "a"), ["group", "part"])
            .select("a", "b")
            .distinct()
        )
        parts = _merged(parts, verify(stage(tries, "tries")))
        entered = busy.drop("part", "main", "held", "length")
        listed = stage(entered.join(parts.select("group", "first", "part").distinct(), ["group", "first"]), "listed")
        busy = _open_lists(listed)
        release(listed)

    # What is still outside the largest part of a list meets the whole list.  Pairs are told
    # apart by their first parts, which both kinds of lists have, so that counts add up.
    open_lists = settled.unionByName(busy)
    of_list = ("token", "main", "held", "length")
    side = lambda k: [F.col(c).alias(f"{c}{k}") for c in open_lists.columns if c not in of_list]
    one, two = open_lists.where("part <> main").select("token", *side(1)), open_lists.select("token", "main", *side(2))
    near = (
        (F.col("part1") != F.col("part2"))
        & ((F.col("part2") == F.col("main")) | (F.col("part1") < F.col("part2")))
        & (F.col("n1") * 100 >= F.col("n2") * percent)
        & (F.col("n2") * 100 >= F.col("n1") * percent)
        & possible
    )
    pair = ["group1", "first1", "group2", "first2"]
    # A pair is ordered by its first parts, so that its lists are counted together.
    flip = F.col("first1") < F.col("first2")
    ordered = [
        F.when(flip, F.col(f"{c}{x}")).otherwise(F.col(f"{c}{y}")).alias(f"{c}{x}") for x, y in ((1, 2), (2, 1)) for c in ("group", "first")
    ]
    least = ["least1", "least2"] if counted else []
    found = one.join(two, "token").where(near).select(*ordered, *least)
    cross = found.groupBy(*pair).agg(*met(*least)).where(enough(*least))
    cross = stage(cross.select(*pair), "cross")
    of = lambda k, c: parts.select(
        F.col("group").alias(f"group{k}"), F.col("first").alias(f"first{k}"), F.col("part").alias(f"p{c}"), F.col("class").alias(c)
    )
    within = parts.groupBy("group").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    several = parts.join(within.select("group"), "group", "left_semi")
    inner = (
        several.select("group", F.col("class").alias("a"), F.col("part").alias("pa"))
        .join(several.select("group", F.col("class").alias("b"), F.col("part").alias("pb")), "group")
        .where("pa < pb")
        .select("a", "b")
    )
    outer = cross.join(of(1, "a"), ["group1", "first1"]).join(of(2, "b"), ["group2", "first2"])
    outer = outer.where("pa <> pb").select("a", "b")
    last = verify(stage(outer.unionByName(inner).distinct(), "tries"))
    return _merged(parts, last).select("class", "part")


def with_components(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Columns digest, part and component_id: the smallest ``low`` of the classes of each part.

    ``classes`` has digest, class and low.  A class without a part is one of its own.
    """
    named = classes.select("digest", "class", "low").join(parts, "class", "left")
    named = named.withColumn("part", F.coalesce("part", "class"))
    least = named.groupBy("part").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("k"))
    found = spread_join(named, least.where("k > 1").drop("k"), "part", "class")
    return found.select("digest", "part", F.coalesce("component_id", "low").alias("component_id"))
