"""Line dedup by a log-template tree (operator 3).  DataFrame operations only.

The tree has a fixed depth: lines are parsed by their number of tokens and
their leading tokens (digits masked).  In a leaf that holds enough lines, the
tokens that are constant at their places are kept and the others, the variable
fields, become wildcards.  Lines of one template that recur in enough different
documents are dropped, but for the first of them.

What is constant follows the size of the leaf, so that a field of few values
stays a field however many lines hold each of them.  A line takes the first of
these levels at which enough of its tokens are constant: those without digits
that stand in a half of the leaf's lines; in a quarter; in ``min_docs`` lines;
and any token in ``min_docs`` lines.  Lines alike at one level are alike at
those before it, so a more general template never splits a narrower one.

How many documents a template must recur in falls with its length: a line of
LONG or more tokens without digits is hardly written twice by chance, and recurs
with its second document, digits apart.  The first document of a template is
the same at both levels, so a line that one keeps for its template the other
does not drop for its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land
from .hot import bitmap_bits, in_bitmap, join_groups, with_few

#: Leading tokens that the tree branches on.
LEAD = 3
#: Documents (of different texts) that a template must recur in, and lines
#: that a token must stand in to be constant.
MIN_DOCS = 10
#: Tokens without digits from which a line recurs in LONG_DOCS documents.
LONG, LONG_DOCS = 20, 2
#: Shares of a leaf's lines, the most general level first.
SHARES = (0.5, 0.25)
#: Share of a template's tokens that must be constant.
MIN_CONSTANT = 0.6


def spaced(text: Column) -> Column:
    """``text`` with a space for every other ASCII white space but line feeds."""
    other = r"[\x09\x0B-\x0D]"
    return F.when(text.rlike(other), F.regexp_replace(text, other, " ")).otherwise(text)


def tokens_of(line: Column) -> Column:
    """Tokens of a ``spaced`` line; none for an empty one.  A separator of one
    character needs no pattern, which would be compiled again for every line."""
    return F.array_remove(F.split(line, " "), "")


def _leaf(tokens: Column, lead: int) -> Column:
    # tokens hold no spaces, so all heads are masked at once
    heads = F.regexp_replace(F.array_join(F.slice(tokens, 1, lead), " "), "[0-9]+", "#")
    return F.xxhash64(F.size(tokens), heads)


def _level() -> Column:
    """The first level at which a token of ``c`` of the leaf's lines is constant."""
    level = F.when(F.col("token").rlike("[0-9]"), len(SHARES) + 1)
    for i, share in enumerate(SHARES):
        level = level.when(F.col("c") >= share * F.col("held"), i)
    return level.otherwise(len(SHARES))


def line_templates(docs: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """(doc, mark, line, template, docs, first): the lines whose template
    recurs; ``first`` marks the one that stays.  ``docs``: doc, mark, text."""
    masked = F.regexp_replace(F.array_join("tokens", " "), "[0-9]+", "#")
    lines = (docs.where("text IS NOT NULL").withColumn("text", spaced(F.col("text")))
             .select("doc", "mark", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
             # asked of the line, not of its tokens, so that they are made once
             .where(F.trim("body") != "").withColumn("tokens", tokens_of(F.col("body")))
             .withColumn("leaf", _leaf(F.col("tokens"), lead)))
    wide = F.size("tokens") >= LONG
    counted = land(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("held"), F.max(wide).alias("wide"))
                   .where(F.col("held") >= F.when(F.col("wide"), LONG_DOCS).otherwise(min_docs)), "line-counts")
    leaves = land(counted.where(F.col("held") >= min_docs).select("leaf", "held"), "line-leaves")
    # a line that recurs shares its leaf: only those are masked.  Bitmaps let
    # some more through, which the join and a second count settle
    again = land(counted.where("wide").select("leaf"), "line-repeats")
    tested = lines
    for keys, name in ((leaves, "known"), (again, "again")):
        cell = F.col("leaf").bitwiseAND(F.lit(bitmap_bits(keys.count()) - 1))
        tested = in_bitmap(tested, cell, keys.select(cell.alias("__cell")), name)
    digits = F.regexp_count("body", F.lit("[0-9][^ ]*"))  # tokens that hold one
    tested = tested.withColumn("again", F.col("again") & wide & (F.size("tokens") - digits >= LONG))
    tested = tested.where("known OR again").join(leaves, "leaf", "left").where("held IS NOT NULL OR again")
    kept = land(tested.select("doc", "mark", "line", "leaf", "held", F.when(F.col("held").isNotNull(), F.md5("body")).alias("body"),
                              F.when(F.col("held").isNotNull(), F.col("tokens")).alias("tokens"),
                              F.when(F.col("again"), F.md5(masked)).alias("long")), "leaf-lines")
    held = kept.where("held IS NOT NULL")
    recurring = kept.where("long IS NOT NULL").select("doc", "mark", "line", "leaf", F.concat(F.lit("\n"), "long").alias("template"),
                                                      F.lit(LONG_DOCS).alias("need"))
    # equal lines are one class, so a line of many documents is parsed once
    classes = held.groupBy("leaf", "body").agg(F.count(F.lit(1)).alias("c"), F.min("tokens").alias("tokens"), F.min("held").alias("held"))
    words = classes.select("leaf", "body", "c", "held", F.posexplode("tokens").alias("place", "token"))
    constant = (words.groupBy("leaf", "place", "token").agg(F.sum("c").alias("c"), F.min("held").alias("held")).where(F.col("c") >= min_docs)
                .select("leaf", "place", "token", _level().alias("level")))
    need = F.ceil(F.lit(min_constant) * F.col("size")).cast("int")
    fixed = lambda x: F.coalesce(x["level"] <= F.col("level"), F.lit(False))
    parsed = (words.join(constant, ["leaf", "place", "token"], "left")
              .groupBy("leaf", "body").agg(F.array_sort(F.collect_list(F.struct("place", "level", F.when(F.col("level").isNotNull(), F.col("token")).alias("t")))).alias("p"),
                                           F.sort_array(F.collect_list("level")).alias("levels"), F.count(F.lit(1)).alias("size"))
              # the level at which so many tokens are constant
              .withColumn("level", F.when(need < 1, 0).otherwise(F.get("levels", need - 1))).where(F.col("level").isNotNull())
              .select("leaf", "body", F.array_join(F.transform("p", lambda x: F.when(fixed(x), x["t"]).otherwise("<*>")), " ").alias("template")))
    templated = (held.select("doc", "mark", "line", "leaf", "body").join(parsed, ["leaf", "body"])
                 .select("doc", "mark", "line", "leaf", "template", F.lit(min_docs).alias("need")))
    found = land(templated.unionByName(recurring), "templated-lines")
    # documents of equal text count once
    spread = (found.groupBy("leaf", "template", "mark").agg(F.min(F.struct(F.col("doc").isNull().alias("z"), "doc", "mark", "line")).alias("f"),
                                                            F.count(F.lit(1)).alias("rows"), F.min("need").alias("need"))
              .groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"), F.min("f").alias("f"), F.sum("rows").alias("rows"), F.min("need").alias("need"))
              .where(F.col("docs") >= F.col("need")).drop("need"))
    first = F.col("doc").eqNullSafe(F.col("f.doc")) & (F.col("mark") == F.col("f.mark")) & (F.col("line") == F.col("f.line"))
    placed = join_groups(found.drop("need"), land(spread, "recurring-templates"), ["leaf", "template"], "rows", found.count())
    return placed.select("doc", "mark", "line", "template", "docs", first.alias("first"))


def drop_lines(df: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` (which must not have __mark, __drop or n_lines,
    n_dropped) with the text less its recurring lines, n_lines and n_dropped.

    Null texts stay null with no lines; an empty text is one empty line; empty
    lines are never dropped; long lines are parsed whole; rows of equal id and text lose the same lines, and
    rows of equal text count as one document; a null id comes after all others
    when the first line of a template is chosen.
    """
    marked = df.withColumn("__mark", F.xxhash64(F.col(text_col)))
    docs = marked.select(F.col(id_col).alias("doc"), F.col("__mark").alias("mark"), F.col(text_col).alias("text"))
    gone = (line_templates(docs, lead, min_docs, min_constant).where(~F.col("first"))
            .groupBy("doc", F.col("mark").alias("__mark")).agg(F.collect_set("line").alias("__drop")))
    named = {"__none": lambda i: i.isNull(), "__id": lambda i: F.coalesce(i.cast("string"), F.lit(""))}
    gone = land(gone.select(*[f(F.col("doc")).alias(c) for c, f in named.items()], "__mark", "__drop"), "lines-to-drop")
    # documents that lose no line stay in place
    out = with_few(marked.withColumns({c: f(marked[id_col]) for c, f in named.items()}), gone, [*named, "__mark"])
    lines = F.split(F.col(text_col), "\n", -1)
    total = F.coalesce(F.size(lines), F.lit(0))
    # lines are looked up by number, the numbers left out through a hash set; a text is split once, not for each number
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    both = F.array(F.struct(lines.alias("lines"), stay.alias("stay")))
    joined = F.transform(both, lambda b: F.array_join(F.transform(b["stay"], lambda i: F.get(b["lines"], i)), "\n"))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.get(joined, F.lit(0)))
    return out.select(*[text.alias(c) if c == text_col else out[c] for c in df.columns],
                      F.when(F.col(text_col).isNull(), 0).otherwise(total).cast("long").alias("n_lines"),
                      F.coalesce(F.when(F.col("__drop").isNotNull(), F.size("__drop")), F.lit(0)).cast("long").alias("n_dropped"))
