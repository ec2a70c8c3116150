"""Conversations without quotes, ordered by what each message answers.

Quote levels are the leading > signs of a line. Consecutive quoted lines of one level make a
passage, which is normalised, hashed in windows of words and joined to the earliest message
of the conversation whose own text holds it; a message answers the source of most of its
outermost linked quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words of a window; shorter passages are linked as whole lines only.
WINDOW = 5
_PREFIX = r"^[ \t]*((?:>[ \t]?)+)"
_ATTRIBUTION = r"^[ \t]*(On|Le|Am|El)\b.*(wrote|écrit|schrieb|escribió)[ \t]*:[ \t]*$"


def quote_level(line: Column) -> Column:
    """How many > signs open a line, blanks between them allowed."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 1), r"[^>]", ""))


def normalise_line(line: Column) -> Column:
    """Without quote signs, white space as single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _PREFIX, ""), r"\s+", " ")))


def without_quotes(text: Column) -> Column:
    """The text's own lines: quoted lines go, and so does an attribution right above them."""

    def keep(lines: Column) -> Column:
        def own(line: Column, i: Column) -> Column:
            after = F.coalesce(F.get(lines, i + 1), F.lit(""))
            return (quote_level(line) == 0) & ~(line.rlike(_ATTRIBUTION) & (quote_level(after) > 0))

        return F.regexp_replace(F.array_join(F.filter(lines, own), "\n"), r"^\n+|\n+$", "")

    return F.transform(F.array(F.split(text, "\n")), keep)[0]


def _runs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, row, place, level, lines, passage): maximal runs of lines of one quote level.

    A passage is its lines, normalised and joined by blanks, so other line breaks and blank
    quoted lines make no difference.
    """
    coded = F.transform(F.split("text", "\n"), lambda line: F.struct(quote_level(line).alias("level"), normalise_line(line).alias("line")))
    rows = messages.where("text IS NOT NULL").select("conv_id", "turn", F.xxhash64("role", "text").alias("row"), coded.alias("all"))
    level = lambda i: F.get("all", i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    rows = rows.withColumn("starts", starts)

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("all"))
        lines = F.transform(F.slice("all", start + 1, end - start), lambda x: x["line"])
        return F.struct(level(start).alias("level"), F.filter(lines, lambda line: line != "").alias("lines"))

    found = rows.select("conv_id", "turn", "row", F.posexplode(F.transform("starts", run)).alias("place", "run"))
    return found.select("conv_id", "turn", "row", "place", "run.level", "run.lines", F.array_join("run.lines", " ").alias("passage")).where("passage <> ''")


def _windows(text: Column) -> Column:
    """Hashes of a text's distinct windows of WINDOW words; none if it has fewer."""

    def hashes(words: Column) -> Column:
        at = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - WINDOW + 1))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, WINDOW), " "))))

    return F.transform(F.array(F.split(text, " ")), hashes)[0]  # split once, not for each window


def _passage_sources(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, passage, source): the first message whose own text holds a quoted passage.

    The window of a passage that the fewest texts hold brings its candidates; the texts
    themselves decide. A passage with a window that no text holds has none.
    """
    asked = quoted.select("conv_id", "passage").distinct().select("conv_id", "passage", _windows(F.col("passage")).alias("windows")).where("size(windows) > 0")
    texts = own.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "text").agg(F.min("turn").alias("source")).withColumn("key", F.xxhash64("text"))
    filed = materialise(texts.select("conv_id", "key", F.explode(_windows(F.col("text"))).alias("window")), "windows")
    holders = filed.groupBy("conv_id", "window").agg(F.count("*").alias("holders"))
    met = asked.select("conv_id", "passage", F.size("windows").alias("n"), F.explode("windows").alias("window")).join(holders, ["conv_id", "window"])
    rarest = met.groupBy("conv_id", "passage", "n").agg(F.count("*").alias("held"), F.min(F.struct("holders", "window")).alias("least")).where("held = n")
    near = rarest.select("conv_id", "passage", F.col("least.window").alias("window")).join(filed, ["conv_id", "window"]).join(texts, ["conv_id", "key"])
    holds = F.concat(F.lit(" "), "text", F.lit(" ")).contains(F.concat(F.lit(" "), "passage", F.lit(" ")))
    return near.where(holds).groupBy("conv_id", "passage").agg(F.min("source").alias("source"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source, chars): sources of quoted passages, by message and level.

    A passage of WINDOW words or more belongs to the first message whose own text holds it,
    wherever its lines break; of what is left, shorter ones included, whole lines are linked.
    """
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id").distinct()  # no other conversation has links
    runs = materialise(_runs(messages.join(quoting, "conv_id", "left_semi")), "runs")
    quoted = runs.where("level > 0")
    own = runs.where("level = 0").groupBy("conv_id", "turn", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "passage"))), lambda x: x["passage"]), " ").alias("text"))
    known = quoted.drop("row", "place").join(_passage_sources(quoted, own), ["conv_id", "passage"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    whole = known.where("source IS NOT NULL").select("conv_id", "turn", "level", "source", F.length("passage").alias("chars"))
    lines = known.where("source IS NULL").select("conv_id", "turn", "level", F.explode("lines").alias("line")).groupBy("conv_id", "turn", "level", "line").agg(F.count("*").alias("n"))
    first = runs.where("level = 0").select("conv_id", "turn", F.explode("lines").alias("line")).groupBy("conv_id", "line").agg(F.min("turn").alias("source"))
    single = lines.join(first, ["conv_id", "line"]).where("source < turn").select("conv_id", "turn", "level", "source", (F.length("line") * F.col("n")).alias("chars"))
    return whole.unionByName(single).groupBy("conv_id", "turn", "level", "source").agg(F.sum("chars").alias("chars"))


def reply_parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of messages whose quotes could be linked.

    The outermost level that links counts; most linked characters win, then the latest source.
    """
    best = F.max(F.struct((-F.col("level")).alias("level"), "chars", "source"))
    return quote_links(messages).groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.source").alias("reply_to"))


def thread_roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root): the first message up each chain of replies, by pointer doubling."""
    current = materialise(parents.select("conv_id", "turn", F.col("reply_to").alias("root")), "roots")
    while True:
        up = current.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        joined = current.join(up, ["conv_id", "root"], "left")
        following = materialise(joined.select("conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if not following.where("moved").limit(1).count():
            return following.drop("moved")
        current = following.drop("moved")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, thread, turn, role, text, reply_to, n_quoted_lines, formatted.

    thread is the turn that opens a chain of replies (a message that answers nothing by
    quotation opens its own), and rows are sorted by conv_id, thread and turn, so a reply
    follows what it answers. Rows equal in conv_id, turn, role and text count once. Rows
    without conv_id or turn link to nothing and form threads of their own; a null text
    stays null, an empty one empty. An empty table gives an empty result. In formatted, marks
    that a text holds are broken up (`< |`), and signs of a role that no name needs become `_`,
    so that no message can pass for another turn.
    """
    messages = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    parents = materialise(reply_parents(messages), "replies")
    roots = thread_roots(parents)
    linked = parents.join(roots, ["conv_id", "turn"])
    own = without_quotes(F.col("text"))
    quoted = F.size(F.filter(F.split("text", "\n"), lambda line: quote_level(line) > 0))
    named = F.regexp_replace(F.coalesce("role", F.lit("user")), r"[^\w.-]", "_")
    out = messages.join(linked, ["conv_id", "turn"], "left").select(
        "conv_id", F.coalesce("root", "turn").alias("thread"), "turn", "role", own.alias("text"), "reply_to", F.coalesce(quoted, F.lit(0)).cast("long").alias("n_quoted_lines")
    )
    body = F.concat(F.lit("<|"), named, F.lit("|>\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))
    return out.withColumn("formatted", body).sort("conv_id", "thread", "turn", "role", "text")
