"""Chat formatting by quotation linking.

Messages are cut into lines with their quote level ('>' marks before the text). Runs of quoted lines
of one level are passages; a passage, normalised and hashed, is joined to the earlier message
of its conversation whose own text, or a paragraph or line of it or a run of neighbouring ones, has that
hash. A passage that is no such part as a whole is joined by its own paragraphs and lines. What a
message quotes first is what it replies to. Conversations are then written in reply order
without quotes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, stored, text_column

#: A quoted line: marks, with blanks between, then the text. An attribution line that announces a quote.
MARKS = r"^\\s*((?:>[ \\t]?)+)"
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def _normal(column: Column | str) -> Column:
    """Letters and digits only count, whatever their case; runs of others are one space."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))


def _cut(texts: DataFrame, column: str) -> DataFrame:
    """With ``whole``, the text normalised, and its paragraphs ``ps`` and lines ``ls`` with some letter or digit, and their hashes ``ph`` and ``lh``."""
    def full(by: str) -> Column:
        return F.filter(F.transform(F.split("bare", by), _normal), lambda x: x != "")

    bare = F.array_join(F.filter(F.split(column, r"\r\n|\n|\r"), lambda x: ~x.rlike(ATTRIBUTION)), "\n")  # as in quotes
    out = texts.withColumn("bare", bare).withColumns({"whole": _normal("bare"), "ps": full(r"\n\s*\n"), "ls": full(r"\n")}).drop("bare")
    return out.withColumns({"ph": F.transform("ps", lambda x: F.xxhash64(x)), "lh": F.transform("ls", lambda x: F.xxhash64(x))})


def _runs(texts: DataFrame, hashes: str, lengths: str) -> DataFrame:
    """Hashes of all runs of neighbouring parts, as long as quotes in the conversation are."""
    out = texts.select("own", "source", "source_turn", hashes, F.explode(F.filter(lengths, lambda n: (n > 1) & (n <= F.size(hashes)))).alias("n"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.size(hashes) - F.col("n") + 1)).alias("i"))
    return out.select("own", "source", "source_turn", F.xxhash64(F.slice(hashes, F.col("i"), F.col("n"))).alias("h"))


def passages(messages: DataFrame) -> DataFrame:
    """(uid, seq, level, body): maximal runs of lines of one quote level, in their order; level 0 is the message's own text."""
    lines = messages.select("uid", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line", "raw"))
    lines = lines.select("uid", "line", F.expr(f"length(regexp_replace(regexp_extract(raw, '{MARKS}', 1), '[^>]', ''))").alias("level"), F.expr(f"regexp_replace(raw, '{MARKS}', '')").alias("body"))
    lines = lines.where(~F.col("body").rlike(ATTRIBUTION))  # at every level: an answer that is quoted announced its own quote
    # a message's lines are gathered by message alone, each one text long
    whole = lines.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("line", "level", "body"))).alias("l"))
    runs = F.expr("""aggregate(l, cast(array() as array<struct<level:int,body:string>>), (a, x) ->
        if(size(a) > 0 and a[size(a) - 1].level = x.level,
           concat(slice(a, 1, size(a) - 1), array(struct(x.level as level, concat(a[size(a) - 1].body, '\n', x.body) as body))),
           concat(a, array(struct(x.level as level, x.body as body)))))""")
    return whole.select("uid", F.posexplode(runs).alias("seq", "r")).select("uid", "seq", "r.level", "r.body")


def _latest(both: DataFrame) -> DataFrame:
    """``both`` with ``m`` of rows that have a ``uid`` being that of the latest row before without one, of the same ``own`` and ``h``.

    Rows are ranked over ranges, so that many of one hash don't meet in a task; what a range has before it is
    carried over for the hashes that go on from one range to the next, which are no more than there are ranges.
    """
    rows = stored(ranked(both, "own", "h", F.col("turn").asc_nulls_first(), F.col("uid").isNull(), "m.source"), "order")
    here = Window.partitionBy("range", "own", "h").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    source = F.when(F.col("uid").isNull(), F.col("m"))
    spans = stored(rows.groupBy("own", "h").agg(F.min("range").alias("a"), F.max("range").alias("b")).where("a < b").select("own", "h"), "spans")
    ends = rows.join(spans, ["own", "h"]).groupBy("own", "h", "range").agg(F.max(F.when(F.col("uid").isNull(), F.struct("rank", "m"))).alias("e"))
    gone = Window.partitionBy("own", "h").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(ends.select("own", "h", "range", F.last("e.m", ignorenulls=True).over(gone).alias("carried")), "carried")
    out = rows.withColumn("local", F.last(source, ignorenulls=True).over(here)).join(carried, ["own", "h", "range"], "left")
    return out.withColumn("m", F.when(F.col("uid").isNotNull(), F.coalesce("local", "carried"))).drop("local", "carried", "rank", "range")


def conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, content, parent_turn, depth, position, n_quotes, n_linked) for every message.

    ``content`` is the message without quoted lines and the lines that announce them.
    ``parent_turn`` is the turn replied to: the latest earlier message that the first linked quote of
    the lowest level is from, else the previous message (null for the first). ``position`` numbers a conversation's messages
    from 0 in reply order: parents before replies, replies by turn. Messages of equal turn
    follow their text, and then the table; those with a null turn come first. Null texts count as empty, null roles
    stay null, and messages with a null conversation are each a conversation of their own.
    Of sources of one hash and turn the last by place in the table is meant. Texts are read whole, however long. Other columns aren't read, whatever
    their names; an empty table gives no rows.
    """
    table = messages.select(messages[conversation].alias("conv"), messages[turn].alias("turn"), messages[role].alias("role"), text_column(messages, text).alias("text"))
    table = stored(table.withColumn("uid", F.monotonically_increasing_id()).withColumn("own", F.coalesce(F.col("conv").cast("string"), F.concat(F.lit("\0"), F.col("uid").cast("string")))), "messages")
    runs = stored(passages(table.where(F.col("text").rlike(r"(?m)^\s*>")).select("uid", "text")), "passages")
    said = runs.where("level = 0").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("b"))
    said = said.select("uid", F.regexp_replace(F.expr("array_join(transform(b, x -> x.body), '\n')"), r"^\s+|\s+$", "").alias("own_text"), F.lit(True).alias("quoting"))
    quoting = table.where(F.col("text").rlike(r"(?m)^\s*>")).select("uid")
    own = table.join(said, "uid", "left").join(quoting.withColumn("q", F.lit(True)), "uid", "left")
    own = stored(own.select("uid", "own", "conv", "turn", "role", F.expr("if(q, coalesce(own_text, ''), text)").alias("content")), "contents")
    quotes = stored(_cut(runs.where("level > 0").join(table.select("uid", "own", "turn"), "uid"), "body"), "quotes")
    # every hash that a quote of a message may have: of the whole own text, of its paragraphs and lines, and of
    # runs of these; runs only of the lengths that quotes in the conversation have
    sized = quotes.select("own", F.size("ph").alias("n_ps"), F.size("lh").alias("n_ls")).distinct().groupBy("own").agg(F.collect_set("n_ps").alias("n_ps"), F.collect_set("n_ls").alias("n_ls"))
    sources = stored(_cut(own.select("own", F.col("uid").alias("source"), F.col("turn").alias("source_turn"), "content").join(sized, "own"), "content").where("whole <> ''").drop("content", "ps", "ls"), "sources")
    parts = sources.select("own", "source", "source_turn", F.explode(F.concat(F.array(F.xxhash64("whole")), "ph", "lh")).alias("h"))
    parts = stored(parts.union(_runs(sources, "ph", "n_ps")).union(_runs(sources, "lh", "n_ls")).distinct(), "parts")

    def keys(hashes: str, whole: bool, texts: str | None = None) -> Column:
        return F.transform(hashes, lambda h, i: F.struct(F.lit(whole).alias("all"), h.alias("h"), (F.lit(0) if whole else F.length(F.col(texts)[i])).alias("letters")))

    # a passage as a whole; and, if it has several, its paragraphs and lines
    pieces = F.when(F.size("lh") > 1, F.concat(keys("ph", False, "ps"), keys("lh", False, "ls"))).otherwise(F.array().cast("array<struct<all:boolean,h:bigint,letters:int>>"))
    asked = quotes.where("whole <> ''").withColumn("wholes", F.array(F.xxhash64("whole"), F.xxhash64("ph"), F.xxhash64("lh")))
    asked = stored(asked.select("own", "uid", "turn", "seq", "level", F.explode(F.concat(keys("wholes", True), pieces)).alias("k")).select("own", "uid", "turn", "seq", "level", "k.*"), "asked")
    # of each hash the latest earlier message that has it; one pass over both in the order of turns, so that
    # neither many quotes nor many messages of one hash multiply
    both = asked.select("own", "h", "turn", "uid", "seq", "level", "all", F.lit(None).cast("struct<source_turn:long,source:long>").alias("m")).union(
        parts.select("own", "h", F.col("source_turn").alias("turn"), F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.struct(F.col("source_turn").cast("long"), "source")))
    found = _latest(both).where("uid is not null and m is not null")
    found = stored(found.select("own", "uid", "seq", "level", "all", "m").distinct(), "found")
    whole = found.where("all").groupBy("uid", "seq", "level").agg(F.max("m").alias("m"))
    # of the messages that a passage's pieces name, the one that has most of it, and of such the latest
    named = found.where("not all").drop("all").join(whole, ["uid", "seq"], "left_anti")
    named = named.join(asked.where("not all").select("uid", "seq", "h", "letters"), ["uid", "seq"]).withColumn("source", F.col("m.source"))
    named = named.join(parts.select("own", "source", "h"), ["own", "source", "h"]).groupBy("uid", "seq", "level", "m").agg(F.sum("letters").alias("letters"))
    named = named.groupBy("uid", "seq", "level").agg(F.max(F.struct("letters", "m")).alias("best")).select("uid", "seq", "level", "best.m")
    linked = whole.union(named)
    first = linked.groupBy("uid").agg(F.min(F.struct("level", "seq", "m")).alias("f"), F.count("*").alias("n_linked"))
    first = stored(first.select("uid", F.col("f.m.source").alias("parent"), "n_linked"), "replies")
    counts = stored(quotes.groupBy("uid").agg(F.count("*").alias("n_quotes")), "counts")
    rows = own.join(first, "uid", "left").join(counts, "uid", "left")
    order = stored(ranked(rows.select("uid", "own", "turn", "content"), "own", F.col("turn").asc_nulls_first(), "content", "uid").select("uid", "own", "rank"), "order")
    starts = stored(order.groupBy("own").agg(F.min("rank").alias("start"), F.count("*").alias("size")), "starts")
    before = order.select((F.col("rank") + 1).alias("rank"), F.col("own").alias("same"), F.col("uid").alias("previous"))
    places = order.join(before, "rank", "left").join(starts, "own").select("uid", F.when(F.col("same") == F.col("own"), F.col("previous")).alias("previous"), (F.col("rank") - F.col("start") + 1).alias("place"))
    rows = rows.join(places, "uid").withColumn("parent", F.coalesce("parent", "previous")).drop("previous")
    rows = stored(rows, "rows")
    # reply order: an Euler tour enters and leaves each message once; its sums to the end are found by doubling
    brothers = stored(ranked(rows.where("parent is not null").select("uid", "parent", "place"), "parent", "place").select("uid", "parent", "rank"), "brothers")
    after = brothers.select((F.col("rank") - 1).alias("rank"), F.col("parent").alias("same"), F.col("uid").alias("brother"))
    brothers = brothers.join(after, "rank").where("same = parent").select("uid", "brother")
    tree = stored(rows.select("uid", "own", "parent").join(brothers, "uid", "left"), "tree")
    eldest = stored(rows.where("parent is not null").groupBy("parent").agg(F.min(F.struct("place", "uid")).alias("m")).select(F.col("parent").alias("uid"), F.col("m.uid").alias("child")), "eldest")
    steps = tree.join(eldest, "uid", "left")
    tour = stored(
        steps.select((F.col("uid") * 2).alias("at"), F.coalesce(F.col("child") * 2, F.col("uid") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("open"))
        .union(steps.select(F.col("uid") * 2 + 1, F.coalesce(F.col("brother") * 2, F.col("parent") * 2 + 1), F.lit(0).cast("long"), F.lit(-1).cast("long"))), "tour")
    ended, going = [tour.where("next is null")], tour.where("next is not null")
    while going.limit(1).count():  # only what has not reached the end goes on
        every = reduce(DataFrame.union, [going, *ended])
        ahead = every.select(F.col("at").alias("next"), F.col("next").alias("far"), F.col("entered").alias("e"), F.col("open").alias("o"))
        tour = stored(going.join(ahead, "next").select("at", F.col("far").alias("next"), (F.col("entered") + F.col("e")).alias("entered"), (F.col("open") + F.col("o")).alias("open")), "tour")
        ended.append(tour.where("next is null"))
        going = tour.where("next is not null")
    tour = reduce(DataFrame.union, ended)
    entered = tour.where("at % 2 = 0").select((F.col("at") / 2).cast("long").alias("uid"), "entered", (-F.col("open")).alias("depth"))
    names = rows.select(F.col("uid").alias("parent"), F.col("turn").alias("parent_turn"))
    out = rows.join(entered, "uid").join(starts.select("own", "size"), "own").join(names, "parent", "left")
    return out.select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), "content", "parent_turn", "depth",
                      (F.col("size") - F.col("entered")).alias("position"),
                      F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
