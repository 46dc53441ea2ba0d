"""Quotation linking: reply-ordered conversations without their quotes.

Leading `>` marks give each line its quote level; runs of lines of one level are
passages. Hashes of normalised quoted passages are joined to the bodies,
passages, paragraphs and lines of earlier messages of the conversation, and
those of several lines that are found nowhere whole by their lines. Built from
DataFrame functions only; every join key holds a turn or a passage hash, so a
conversation of any size spreads over tasks.

Where each of some consecutive turns answers the one before it, they follow each
other in reply order as well. Such runs, cut every RUN turns, are the nodes whose
places in the tree are looked up, by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import checkpointed

#: a class, not a repeated group: the regex engine would recurse once a mark
_MARKS = r"^([ \t>]*>)"
_PASSAGES = "array<struct<level:int,body:string>>"
#: turns of a run at most
RUN = 1024


def with_passages(messages: DataFrame, text: Column) -> DataFrame:
    """`messages` with p, an array<struct(level, body)>: runs of lines of one quote level, marks removed.

    Every step is linear in the text: lines, indices at which runs start, and
    slices between them.
    """

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 1)
        bare = F.substring(x, F.length(marks) + 1, F.length(x))
        return F.struct(F.length(F.translate(marks, " \t", "")).cast("int").alias("level"), F.when(marks == "", bare).otherwise(F.regexp_replace(bare, r"^[ \t]", "")).alias("body"))

    quoted = F.contains(text, F.lit(">"))
    lines = F.when(quoted, F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line))
    level = lambda i: F.get("lines", i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    size = lambda s, k: F.coalesce(F.get("starts", k + 1), F.size("lines")) - s
    runs = F.transform("starts", lambda s, k: F.struct(level(s).alias("level"), F.array_join(F.transform(F.slice("lines", s + 1, size(s, k)), lambda x: x["body"]), "\n").alias("body")))
    plain = F.array(F.struct(F.lit(0).alias("level"), F.coalesce(text, F.lit("")).alias("body")))
    marked = messages.withColumn("lines", lines).withColumn("starts", F.when(F.col("lines").isNotNull(), starts))
    return marked.withColumn("p", F.when(F.col("lines").isNotNull(), runs).otherwise(plain).cast(_PASSAGES)).drop("lines", "starts")


def passage_key(body: Column) -> Column:
    """SHA-256 of the passage, lower-cased, with white space collapsed; null where nothing is left."""
    normal = F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))
    return F.when(normal != "", F.sha2(normal, 256))


def _partial(asked: DataFrame, found: DataFrame, held: DataFrame) -> DataFrame:
    """(c, t, key, source) of quotes of several lines without a whole match: the message where the last of their lines first occurs, if it has them all."""
    missed = asked.where(F.size("lines") > 1).join(found.select("c", "t", "key"), ["c", "t", "key"], "left_anti").select("c", "t", "key", F.explode("lines").alias("line")).distinct()
    firsts = held.join(missed.select("c", F.col("line").alias("k")).distinct(), ["c", "k"], "left_semi").groupBy("c", "k").agg(F.min("s").alias("s"))
    placed = missed.join(firsts.withColumnRenamed("k", "line"), ["c", "line"], "left")
    latest = placed.groupBy("c", "t", "key").agg(F.max("s").alias("source"), F.count(F.lit(1)).alias("n"), F.count("s").alias("known")).where("n = known and source < t")
    there = held.select("c", F.col("s").alias("source"), F.col("k").alias("line"))
    each = missed.join(latest.select("c", "t", "key", "source", "n"), ["c", "t", "key"]).join(there, ["c", "source", "line"], "left_semi")
    return each.groupBy("c", "t", "key", "source", "n").agg(F.count(F.lit(1)).alias("had")).where("had = n").select("c", "t", "key", "source")


def _tree(parents: DataFrame) -> DataFrame:
    """(c, t, head, root, depth, path) of each (c, t, parent): the run that holds it, and its place in the tree."""
    part = F.floor(F.col("t") / RUN)
    begins = F.col("parent").isNull() | (F.col("parent") != F.col("t") - 1) | (F.pmod("t", F.lit(RUN)) == 0)
    so_far = Window.partitionBy("c", part).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = checkpointed(parents.select("c", "t", "parent", F.max(F.when(begins, F.col("t"))).over(so_far).alias("head")))
    heads = placed.where("t = head").select("c", "head", F.col("parent").alias("attach"))
    holder = placed.select("c", F.col("t").alias("attach"), F.col("head").alias("up"))
    step = F.array(-F.col("attach"), F.col("head"))
    open_ = heads.join(holder, ["c", "attach"]).select("c", "head", "up", (F.col("attach") - F.col("up") + 1).alias("depth"), step.alias("path"))
    settled = heads.where("attach is null").select("c", "head", F.col("head").alias("up"), F.lit(0).cast("long").alias("depth"), F.array(F.lit(0).cast("long"), F.col("head")).alias("path"))
    open_ = checkpointed(open_)
    # a round doubles the distance looked up, and only runs whose root is not known yet take part in it
    while not open_.isEmpty():
        above = settled.withColumn("done", F.lit(True)).unionByName(open_.withColumn("done", F.lit(False))).select("c", F.col("head").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("path").alias("before"), "done")
        raised = checkpointed(open_.join(above, ["c", "up"]).select("c", "head", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("before", "path").alias("path"), "done"))
        settled = settled.unionByName(raised.where("done").drop("done"))
        open_ = raised.where("not done").drop("done")
    return placed.join(settled, ["c", "head"]).select("c", "t", "parent", "head", F.col("up").alias("root"), (F.col("depth") + F.col("t") - F.col("head")).alias("depth"), "path")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every message with its parent, its place in reply order and its text without quotes.

    Returns (conv_id, turn, role, body, n_quotes, n_linked, parent_turn,
    root_turn, depth, path, head_turn, formatted). A quoted passage links to its
    original: the first message of the conversation that holds it as its body, a
    passage, a paragraph or a line of its own, if that is earlier; or else, for
    several lines, the message in which the last of them first occurs, if it is
    earlier and holds all of them. The parent is the latest linked message of
    the outermost quotes; without a link it is the message of the turn before,
    if there is one. Ordering by (conv_id, path, turn) gives each conversation
    in reply order, every message followed by its replies; see `conversations`.

    A null text or role is empty; a text of quotes alone leaves an empty body; a
    text of any length is parsed whole, in linear time. Rows that repeat a
    conversation and turn are kept, each judged by its own text; what quotes
    them sees one message, and their thread is the first parent's. Rows with a
    null conversation or turn have no parent and are their own root. An empty
    table gives no rows. Other columns are left out, so they cannot clash.
    """
    named = messages.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(text_col).alias("text"))
    rows = with_passages(named, F.col("text")).drop("text")
    own = F.filter("p", lambda x: x["level"] == 0)
    quotes = F.filter("p", lambda x: (x["level"] > 0) & passage_key(x["body"]).isNotNull())
    line_keys = lambda x: F.array_distinct(F.filter(F.transform(F.split(x["body"], "\n"), passage_key), lambda k: k.isNotNull()))
    rows = rows.select("c", "t", "role", F.transform(own, lambda x: x["body"]).alias("own"), F.transform(quotes, lambda x: F.struct(x["level"].alias("level"), passage_key(x["body"]).alias("key"), line_keys(x).alias("lines"))).alias("quotes"))
    # written once: a filter that is pushed below the parse would parse again, and once a line
    rows = checkpointed(rows).withColumn("body", F.trim(F.concat_ws("\n", "own")))

    # the least level is taken before the quotes are spread, once a message
    levels = rows.where(F.size("quotes") > 0).select("c", "t", "quotes", F.array_min(F.transform("quotes", lambda x: x["level"])).alias("outer"))
    asked = levels.select("c", "t", "outer", F.explode("quotes").alias("q"))
    asked = checkpointed(asked.select("c", "t", "q.level", "q.key", "q.lines", "outer").distinct())
    texts = rows.join(asked.select("c").distinct(), "c", "left_semi")
    split = F.concat(F.flatten(F.transform("own", lambda x: F.split(x, "\n"))), F.flatten(F.transform("own", lambda x: F.split(x, r"\n[ \t]*\n"))))
    whole = F.array_distinct(F.concat(F.array("body"), F.col("own"), split))
    held = checkpointed(texts.select("c", F.col("t").alias("s"), F.explode(whole).alias("x")).select("c", "s", passage_key(F.col("x")).alias("k")).where("k is not null").distinct())
    wanted = asked.select("c", F.col("key").alias("k")).distinct()
    first = held.join(wanted, ["c", "k"], "left_semi").groupBy("c", F.col("k").alias("key")).agg(F.min("s").alias("source"))
    found = asked.join(first, ["c", "key"]).where("source < t").select("c", "t", "key", "source")
    links = asked.drop("lines").join(found.unionByName(_partial(asked, found, held)).distinct(), ["c", "t", "key"])
    linked = links.groupBy("c", "t").agg(F.max(F.when(F.col("level") == F.col("outer"), F.col("source"))).alias("quoted"), F.count(F.lit(1)).alias("n_linked"))

    turns = rows.where("c is not null and t is not null").select("c", "t").distinct()
    before = turns.select("c", (F.col("t") + 1).alias("t"), F.col("t").alias("previous"))
    parents = checkpointed(turns.join(before, ["c", "t"], "left").join(linked, ["c", "t"], "left").select("c", "t", F.coalesce("quoted", "previous").alias("parent"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))
    tree = _tree(parents).join(parents.select("c", "t", "n_linked"), ["c", "t"])

    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return rows.select("c", "t", "role", "body", F.size("quotes").cast("long").alias("n_quotes"), shown.alias("formatted")).join(tree, ["c", "t"], "left").select(
        F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.col("role").alias(role_col), "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"),
        F.coalesce("root", "t").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("path", F.array(F.lit(0).cast("long"), F.col("t"))).alias("path"), F.coalesce("head", "t").alias("head_turn"), "formatted",
    )


def conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv_id, root_turn, path, first_turn, last_turn, messages, text) of each run of replies, of rows of `link_quotes`.

    Ordered by (conv_id, path), the texts of a conversation's runs are its
    messages in reply order without quotes; one without quotes or gaps is a
    single run of up to RUN turns. Rows with a null conversation or turn are
    left out.
    """
    known = linked.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull())
    messages = F.array_sort(F.collect_list(F.struct(turn_col, "formatted")))
    runs = known.groupBy(conv_col, "root_turn", "path", F.col("head_turn").alias("first_turn")).agg(F.max(turn_col).alias("last_turn"), F.count(F.lit(1)).alias("messages"), messages.alias("m"))
    return runs.select(conv_col, "root_turn", "path", "first_turn", "last_turn", "messages", F.array_join(F.transform("m", lambda x: x["formatted"]), "").alias("text"))
