"""Quotation linking: replies joined to the messages they quote.

Lines that begin with quote marks form passages, one for each run of a level.
A passage is normalised (marks off, lower case, white space as one blank) and
hashed, whole, by paragraph and by line, so that lines may be wrapped anew.
Messages hash their own words the same way.  Equal hashes link a passage to the
first message that said it: in the same conversation before the reply, else in
any other one.  A message's parent is what its outermost linked passage quotes;
where parents form a ring, which takes two conversations, its first message by
conversation and turn has none.  Following parents gives the thread, and in it
the order in which every reply stands after its original: a conversation is its
thread's messages by ``place``, their own words only.

A hash keeps only its first message, and the first of another conversation,
before any join, so no phrase that many messages share multiplies rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import Scratch, joined_evenly, per_text, present

#: Lines and paragraphs of fewer letters or digits link nothing on their own;
#: whole passages and messages do within their conversation.
LEAST = 12
_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_BLANK = re.compile(r"\n[ \t]*\n")
_SAID = re.compile(
    r"^[ \t]*(?:on|am|le|el|il)\b.{0,200}\b(?:wrote|schrieb|écrit|escribió|ha scritto)\b.{0,80}:[ \t]*$", re.IGNORECASE
)


def levels(text: str | None) -> Iterator[tuple[int, str]]:
    """Each line's quote level, 0 for own words, and the line without marks.

    The line that names a quote's author, just before it, is left out."""
    lines = text.split("\n") if text else []
    for i, line in enumerate(lines):
        m = _MARKS.match(line)
        if m:
            yield m[1].count(">"), line[m.end() :]
        elif not (i + 1 < len(lines) and _MARKS.match(lines[i + 1]) and _SAID.match(line)):
            yield 0, line


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str, whole: bool = False) -> int | None:
    """A 64-bit hash of a normal text; null if it says too little to link.

    The hash is odd if the text links within its conversation only: a whole one
    that says little.  No other hash is odd."""
    text = normal(text)
    short = sum(map(str.isalnum, text)) < LEAST
    if not text or short and not whole:
        return None
    hashed = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return hashed | 1 if short else hashed & ~1


def parsed(text: str | None) -> tuple[str | None, list[tuple[int, list[int]]], list[int]]:
    """Own words, quoted passages as (level, hashes: whole, then paragraphs,
    then lines, longer ones first), and the same hashes of the own words."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for level, line in levels(text):
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        last = level
    kept = lambda all_, *parts: list(dict.fromkeys(h for h in (digest(all_, True), *map(digest, parts)) if h is not None))
    said = "\n".join(own).strip("\n") if passages else text
    longest = lambda parts: sorted(parts, key=len, reverse=True)
    whole = [(level, "\n".join(lines), lines) for level, lines in passages]
    quoted = [(level, kept(text, *longest(_BLANK.split(text)), *longest(lines))) for level, text, lines in whole]
    units = kept(said or "", *_BLANK.split(said or ""), *own)
    return said, quoted, units


def _parse(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    hashes = T.ArrayType(T.LongType())
    passage = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hashes", hashes)])
    schema = T.StructType(
        [T.StructField(conv, T.LongType()), T.StructField(turn, T.LongType()), T.StructField(role, T.StringType())]
        + [T.StructField("text", T.StringType()), T.StructField("quoted", T.ArrayType(passage)), T.StructField("units", hashes)]
    )

    def make() -> Callable:
        def f(cols):
            got = [parsed(t) for t in cols[3]]
            quoted = [[{"level": level, "hashes": h} for level, h in q] for _, q, _ in got]
            return [*cols[:3], [g[0] for g in got], quoted, [g[2] for g in got]]

        return f

    columns = [present(messages, conv, "long"), present(messages, turn, "long"), present(messages, role, "string")]
    return per_text(messages, [*columns, F.col(text).cast("string")], schema, make)


def _at(conv: Column, turn: Column) -> Column:
    return F.struct(conv.alias("c"), turn.alias("t"))


def _passage_links(all_: DataFrame, conv: str, turn: str, scratch: Scratch) -> DataFrame:
    """Linked passages of parsed messages: c, t, passage (from 0), level, far
    (whether to another conversation), place (of the hash that links) and to."""
    placed = all_.where(F.col(conv).isNotNull() & F.col(turn).isNotNull())
    said = placed.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.explode("units").alias("h"))
    # a phrase that many messages quote is many rows of a join: its sides are written tables, so that Spark can split them
    here = scratch.keep(said.groupBy(F.col("c").alias("h_c"), F.col("h").alias("h_h")).agg(F.min("t").alias("h_t")))
    # a hash's first message, and its first in another conversation
    order = W.partitionBy("h_h").orderBy("h_c")
    first = here.where(F.col("h_h").bitwiseAND(1) == 0).withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    at = _at(F.col("h_c"), F.col("h_t"))
    anywhere = scratch.keep(first.groupBy(F.col("h_h").alias("a_h")).agg(F.min(at).alias("a"), F.max(at).alias("b")))

    asked = (
        placed.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.posexplode("quoted").alias("passage", "q"))
        .select("c", "t", "passage", F.col("q.level").alias("level"), F.posexplode("q.hashes").alias("place", "h"))
        .distinct()
    )
    asked = scratch.keep(asked)
    within = asked.join(here, (F.col("c") == F.col("h_c")) & (F.col("h") == F.col("h_h")), "left")
    both = within.join(anywhere, F.col("h") == F.col("a_h"), "left")
    inside = F.when(F.col("h_t") < F.col("t"), _at(F.col("c"), F.col("h_t")))
    outside = F.when(F.col("a.c") != F.col("c"), F.col("a")).when(F.col("b.c") != F.col("c"), F.col("b"))
    linked = both.withColumn("to", F.coalesce(inside, outside)).where("to is not null")
    best = F.struct((F.col("to.c") != F.col("c")).alias("far"), "place", "to")
    return linked.groupBy("c", "t", "passage", "level").agg(F.min(best).alias("best")).select("c", "t", "passage", "level", "best.*")


def passage_links(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each linked passage of each message: conv, turn, passage
    (from 0), level, to_conv and to_turn, the message that said it first.

    Null texts quote nothing; messages with a null conv or turn neither quote
    nor are quoted; repeated rows give their links once; an empty table gives no
    rows.
    """
    scratch = Scratch(messages.sparkSession)
    all_ = scratch.keep(_parse(messages, conv, turn, role, text))
    found = _passage_links(all_, conv, turn, scratch)
    return found.select(
        F.col("c").alias(conv), F.col("t").alias(turn), "passage", "level", F.col("to.c").alias("to_conv"), F.col("to.t").alias("to_turn")
    )


def linked_messages(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per row of ``messages``: conv, turn, role, text (own words only),
    n_quotes, max_level, n_linked (passages), reply_conv and reply_turn (the
    parent; null without one), thread_conv, root_turn, depth, and place, from 0
    in each thread.

    By place a thread's messages come by depth, conv and turn, so that every
    reply stands after its parent.  Null texts stay null and quote nothing.
    Messages with a null conv or turn are neither parents nor replies, and have
    no place.  Repeated rows (of one conv and turn) share their links and their
    place; an empty table gives no rows.  The first message of a ring has no parent, though its
    passages count as linked.
    """
    scratch = Scratch(messages.sparkSession)
    all_ = scratch.keep(_parse(messages, conv, turn, role, text))
    links = _passage_links(all_, conv, turn, scratch)
    best = F.struct("level", "far", "place", "passage", "to")
    parents = links.groupBy("c", "t").agg(F.min(best).alias("best"), F.count("*").alias("n_linked"))
    parents = scratch.keep(parents.select("c", "t", F.col("best.to").alias("parent"), "n_linked"))
    parents = _without_rings(parents, scratch)

    roots = scratch.keep(_roots(parents.where("parent is not null"), scratch))
    here = F.col(conv).isNotNull() & F.col(turn).isNotNull()
    known = all_.where(here).select(F.col(conv).alias("c"), F.col(turn).alias("t")).distinct().join(parents, ["c", "t"], "left")
    known = known.join(roots.select("c", "t", "root", "depth"), ["c", "t"], "left").select(
        F.col("c").alias("k_c"),
        F.col("t").alias("k_t"),
        "n_linked",
        "parent",
        F.coalesce("root", _at(F.col("c"), F.col("t"))).alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    known = scratch.keep(_with_places(scratch.keep(known), scratch))
    n_quotes = F.size("quoted").cast("long")
    max_level = F.coalesce(F.array_max(F.transform("quoted", lambda q: q.level)), F.lit(0))
    rows = all_.select(conv, turn, role, "text", n_quotes.alias("n_quotes"), max_level.alias("max_level"))
    # the one join that moves texts
    out = rows.join(known, (F.col(conv) == F.col("k_c")) & (F.col(turn) == F.col("k_t")), "left")
    return out.select(
        conv,
        turn,
        role,
        "text",
        "n_quotes",
        "max_level",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent.c").alias("reply_conv"),
        F.col("parent.t").alias("reply_turn"),
        F.coalesce("thread.c", conv).alias("thread_conv"),
        F.coalesce("thread.t", turn).alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        "place",
    )


def _with_places(known: DataFrame, scratch: Scratch) -> DataFrame:
    """``known`` with each message's place in its thread.

    All messages are sorted in ranges, so that no thread is one task; a range's
    first number is the sum of those before it, and a thread's first number is
    taken off."""
    order = ["thread", "depth", "k_c", "k_t"]
    ranged = known.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = scratch.keep(ranged.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a task
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = ranged.join(F.broadcast(starts), part == F.col("part"))
    numbered = scratch.keep(numbered.withColumn("at", F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).drop("part", "start", "id"))
    firsts = numbered.groupBy(F.col("thread").alias("its")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    joined = joined_evenly(numbered, scratch.keep(firsts), "thread", "its", "n", numbered.count())
    return joined.withColumn("place", F.col("at") - F.col("first")).drop("at", "first")


def _without_rings(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``parents`` with a null parent for the first message of each ring.

    Jumping from parent to parent's parent, chains that end drop out; the
    messages that jumps reach grow fewer until only rings are left.  On those,
    jumps gather the first message."""
    here = F.struct("c", "t")
    ahead = parents.where(F.col("parent") > here)  # each ring has such a link
    if not ahead.limit(1).count():
        return parents
    meet = (F.col("to.c") == F.col("u_c")) & (F.col("to.t") == F.col("u_t"))
    at, reached = parents.select("c", "t", F.col("parent").alias("to")), -1
    while True:
        n = at.select("to").distinct().count()
        if not n:
            return parents
        if n == reached:
            break
        up = at.select(F.col("c").alias("u_c"), F.col("t").alias("u_t"), F.col("to").alias("up"))
        at, reached = scratch.keep(at.join(up, meet).select("c", "t", F.col("up").alias("to"))), n
    rings = at.select("to.c", "to.t").distinct()
    at = scratch.keep(parents.join(rings, ["c", "t"]).select("c", "t", F.col("parent").alias("to"), here.alias("low")))
    while True:
        up = at.select(F.col("c").alias("u_c"), F.col("t").alias("u_t"), F.col("to").alias("up"), F.col("low").alias("u_low"))
        next_ = at.join(up, meet)
        if not next_.where("u_low < low").limit(1).count():
            break
        at = scratch.keep(next_.select("c", "t", F.col("up").alias("to"), F.least("low", "u_low").alias("low")))
    cut = at.where(F.col("low") == here).select(F.col("c").alias("u_c"), F.col("t").alias("u_t"))
    joined = parents.join(cut, (F.col("c") == F.col("u_c")) & (F.col("t") == F.col("u_t")), "left")
    return scratch.keep(joined.select("c", "t", F.when(F.col("u_c").isNull(), F.col("parent")).alias("parent"), "n_linked"))


def _roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Each reply's root and depth, by jumping from parent to parent's parent;
    the longest chain halves with each jump."""
    at = parents.select("c", "t", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = at.select(F.col("c").alias("u_c"), F.col("t").alias("u_t"), F.col("root").alias("up"), F.col("depth").alias("more"))
        next_ = at.join(up, (F.col("root.c") == F.col("u_c")) & (F.col("root.t") == F.col("u_t")), "left")
        if not next_.where("up is not null").limit(1).count():
            return at
        at = scratch.keep(
            next_.select("c", "t", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )
