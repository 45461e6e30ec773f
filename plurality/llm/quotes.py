"""Quotation linking: quoted passages to the messages they come from, and reply order without quotes.

Lines have the level of their leading ``>`` marks; runs of one level are passages. Passages are normalised
and hashed, whole and line by line, and meet an index of what messages say themselves: whole bodies, runs and
lines. A quoted passage is linked within its own conversation first, then to the first conversation that says
it, or, where that is the quoting one, to the last; a whole passage comes before a line of it, long lines before
short ones. A message that quotes an earlier one starts a branch there; one without a link goes on with the
branch before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import let, materialize, table, text_or_empty

#: Characters a normalised passage must have to be linked to another conversation; turns of a conversation in one bucket.
LEAST, BUCKET = 12, 1000
_LEAD = r"^[ \t>]*+"  # one class, possessive: Java reads any number of marks without recursion


def normalised(text: Column) -> Column:
    """Lower case, other characters than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _line(line: Column) -> Column:
    """(level, text) of a line: how many ``>`` lead it, and what follows the last of them and one blank."""

    def parts(lead):
        level = F.length(lead) - F.length(F.replace(lead, F.lit(">"), F.lit("")))
        after = F.length(F.regexp_extract(lead, "^(.*>)?", 1)) + 1
        rest = F.regexp_replace(F.substring(line, after, F.length(line)), r"^[ \t]", "")
        return F.struct(level.alias("level"), F.when(level > 0, rest).otherwise(line).alias("text"))

    return let(F.regexp_extract(line, _LEAD, 0), parts)


def passages(text: Column) -> Column:
    """Array of (level, text) of the runs of lines of one quote level, marks removed, in order.

    Each line is copied once, whatever the number of lines and runs.
    """

    def runs(lines):
        before = F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x["level"]))
        changes = F.zip_with(before, F.transform(lines, lambda x: x["level"]), lambda a, b: ~a.eqNullSafe(b))
        firsts = F.filter(F.transform(changes, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
        # The last change is the end of the lines, where there is no level.
        bounds = lambda f: F.zip_with(F.slice(f, 1, F.size(f) - 1), F.slice(f, 2, F.size(f)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        own = lambda r: F.struct(F.get(lines, r["a"])["level"].alias("level"), F.array_join(F.transform(F.slice(lines, r["a"] + 1, r["b"] - r["a"]), lambda x: x["text"]), "\n").alias("text"))
        return F.transform(let(firsts, bounds), own)

    whole = F.array(F.struct(F.lit(0).alias("level"), text.alias("text")))
    return F.when(text.rlike(r"(?m)^[ \t]*+>"), let(F.transform(F.split(text, "\n", -1), _line), runs)).otherwise(whole)


def link_quotes(messages: DataFrame, *, conv_col="conv_id", turn_col="turn", text_col="text", role_col="role") -> DataFrame:
    """One row for each message: ``conv_id, turn, role, max_level, n_quoted, n_linked, parent_conv, parent_turn,
    branch, clean_text``.

    ``clean_text`` is the message without quotes; (conv_id, branch, turn) is the reply order. The parent is the
    message that the outermost linked quote comes from, the latest of several. Null and empty texts quote
    nothing; rows with null ids are kept, never linked, and have no branch; repeated rows, and different messages
    with one key, are messages of their own. Texts of any length cost in proportion to it. Hot passages, lines
    and conversations are spread: the index has one row a hash or one a conversation and hash, and branches run
    on over distinct turns in buckets. An empty table gives no rows. Only the four named columns are read.
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text_or_empty(text_col).alias("text"))
    short = lambda h: h.startswith("-")
    hashed = lambda x: let(normalised(x), lambda n: F.when(n != "", F.concat(F.when(F.length(n) < LEAST, "-").otherwise(""), F.substring(F.sha2(n, 256), 1, 32))))
    texts = lambda p: F.transform(p, lambda x: x["text"])
    lines = lambda x: F.split(x, "\n", -1)
    quote = lambda x: F.struct(x["level"].alias("level"), hashed(x["text"]).alias("h"), F.array_distinct(F.transform(lines(x["text"]), hashed)).alias("lines"))
    runs = texts(F.filter("p", lambda x: x["level"] == 0))
    parsed = rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("msg"), passages(F.col("text")).alias("p")).select(
        "conv_id", "turn", "role", "msg", F.array_max(F.transform("p", lambda x: x["level"])).alias("max_level"),
        F.trim(F.array_join(runs, "\n")).alias("clean_text"), F.transform(F.filter("p", lambda x: x["level"] > 0), quote).alias("quotes"), runs.alias("runs"),
    )
    parsed = materialize(parsed, "quote-messages")
    keyed = parsed.filter("conv_id is not null and turn is not null")
    units = F.transform(F.concat(F.array("clean_text"), F.col("runs"), F.flatten(F.transform("runs", lines))), hashed)
    said = keyed.select("conv_id", "turn", F.explode(F.filter(F.array_distinct(units), lambda x: x.isNotNull())).alias("h"))
    inside = materialize(said.groupBy("conv_id", "h").agg(F.min("turn").alias("own_turn")), "quote-index")
    place = F.struct("conv_id", F.col("own_turn").alias("turn"))
    ends = inside.filter(~short(F.col("h"))).groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    quoted = keyed.select("conv_id", "turn", "msg", F.posexplode("quotes").alias("at", "q"))
    parts = F.concat(F.array(F.struct(F.col("q.h").alias("h"), F.lit(True).alias("whole"))), F.transform(F.array_except("q.lines", F.array("q.h")), lambda h: F.struct(h.alias("h"), F.lit(False).alias("whole"))))
    # The level is taken out first: a row of the exploded array must not carry the whole passage.
    tried = quoted.select("conv_id", "turn", "msg", "at", F.col("q.level").alias("level"), F.filter(parts, lambda x: x["h"].isNotNull()).alias("parts"))
    tried = tried.select("conv_id", "turn", "msg", "at", "level", F.explode("parts").alias("u")).select("conv_id", "turn", "msg", "at", "level", "u.h", "u.whole")
    elsewhere = lambda x: F.when(F.col(x)["conv_id"] != F.col("conv_id"), F.col(x))
    near = F.when(F.col("own_turn") < F.col("turn"), F.struct("conv_id", F.col("own_turn").alias("turn")))
    found = tried.join(inside, ["conv_id", "h"], "left").join(ends, "h", "left").withColumn("source", F.coalesce(near, elsewhere("first"), elsewhere("last"))).filter("source is not null")
    # The outermost level first, then the own conversation, whole passages, long ones, then the latest message.
    order = F.struct((-F.col("level")).alias("a"), (F.col("source.conv_id") == F.col("conv_id")).alias("b"), F.col("whole").alias("w"), (~short(F.col("h"))).alias("l"), F.col("source.turn").alias("c"), F.col("source.conv_id").alias("d"))
    linked = found.groupBy("conv_id", "turn", "msg").agg(F.countDistinct("at").alias("n_linked"), F.max_by("source", order).alias("source"))
    out = parsed.join(linked, ["conv_id", "turn", "msg"], "left").select(
        "conv_id", "turn", "role", F.col("max_level").cast("int").alias("max_level"), F.size("quotes").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("source.conv_id").alias("parent_conv"), F.col("source.turn").alias("parent_turn"), "clean_text",
    )
    return _branches(materialize(out, "quote-links"))


def _branches(out: DataFrame) -> DataFrame:
    """Adds ``branch``: the latest turn up to this one that starts a branch; running maxima over distinct turns in buckets."""
    start = F.when(F.col("parent_conv").isNotNull() & ((F.col("parent_conv") != F.col("conv_id")) | (F.col("parent_turn") < F.col("turn") - 1)), F.col("turn"))
    turns = out.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max(start).alias("_s")).withColumn("_b", F.floor(F.col("turn") / BUCKET))
    upto = Window.partitionBy("conv_id", "_b").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    carried = turns.groupBy("conv_id", "_b").agg(F.max("_s").alias("_m"), F.min("turn").alias("_f")).select("conv_id", "_b", F.max("_m").over(before).alias("_m"), F.min("_f").over(whole).alias("_first"))
    branch = turns.withColumn("_own", F.max("_s").over(upto)).join(carried, ["conv_id", "_b"]).select("conv_id", "turn", F.coalesce("_own", "_m", "_first").alias("branch"))
    return out.join(branch, ["conv_id", "turn"], "left")


def op2_quotation_linking(spark, sf_dir):
    linked = link_quotes(table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", "max_level", "n_quoted", "n_linked", "parent_conv", "parent_turn", "branch", F.sha2("clean_text", 256).alias("clean_sha256"))


#: Lines, their runs, and every quoted run or line against everything said, by the normalised text itself.
ORACLE = r"""
WITH m AS (SELECT row_number() OVER () AS rid, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM m),
lead AS (SELECT *, regexp_extract(line, '^[ \t>]*') AS marks FROM s),
v AS (SELECT rid, i, len(marks) - len(replace(marks, '>', '')) AS level, CASE WHEN contains(marks, '>') THEN regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') ELSE line END AS txt FROM lead),
c AS (SELECT *, coalesce(level <> lag(level) OVER (PARTITION BY rid ORDER BY i), true)::INT AS fresh FROM v),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c),
runs AS (SELECT rid, run, level, string_agg(txt, chr(10) ORDER BY i) AS txt FROM g GROUP BY ALL),
body AS (SELECT rid, trim(coalesce(string_agg(txt, chr(10) ORDER BY i) FILTER (level = 0), ''), ' ') AS clean_text, max(level)::INT AS max_level FROM g GROUP BY rid),
raw_units AS (SELECT rid, NULL AS run, 0 AS level, true AS whole, clean_text AS x FROM body UNION ALL SELECT rid, run, level, true, txt FROM runs UNION ALL SELECT rid, run, level, false, txt FROM g),
units AS (SELECT rid, conv_id, turn, run, level, whole, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS n FROM raw_units JOIN m USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
inside AS (SELECT conv_id, n, min(turn) AS own_turn FROM units WHERE level = 0 AND n <> '' GROUP BY ALL),
ends AS (SELECT n, min(conv_id) AS c1, arg_min(own_turn, conv_id) AS t1, max(conv_id) AS c2, arg_max(own_turn, conv_id) AS t2 FROM inside WHERE len(n) >= 12 GROUP BY n),
tried AS (SELECT rid, conv_id, turn, run, level, n, bool_or(whole) AS whole FROM units WHERE level > 0 AND n <> '' GROUP BY ALL),
met AS (SELECT t.*, CASE WHEN own_turn < turn THEN t.conv_id WHEN c1 <> t.conv_id THEN c1 WHEN c2 <> t.conv_id THEN c2 END AS sc,
  CASE WHEN own_turn < turn THEN own_turn WHEN c1 <> t.conv_id THEN t1 WHEN c2 <> t.conv_id THEN t2 END AS st
  FROM tried t LEFT JOIN inside i ON t.conv_id = i.conv_id AND t.n = i.n LEFT JOIN ends e ON t.n = e.n),
best AS (SELECT * FROM met WHERE sc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level, sc = conv_id DESC, whole DESC, len(n) >= 12 DESC, st DESC, sc DESC) = 1),
cnt AS (SELECT rid, count(DISTINCT run) AS n_linked FROM met WHERE sc IS NOT NULL GROUP BY rid),
nq AS (SELECT rid, count(*) FILTER (level > 0) AS n_quoted FROM runs GROUP BY rid),
o AS (SELECT m.rid, m.conv_id, m.turn, role, max_level, n_quoted::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, sc AS parent_conv, st AS parent_turn, sha256(clean_text) AS clean_sha256
  FROM m JOIN body USING (rid) JOIN nq USING (rid) LEFT JOIN cnt USING (rid) LEFT JOIN best b USING (rid)),
st AS (SELECT *, CASE WHEN parent_conv IS NOT NULL AND (parent_conv <> conv_id OR parent_turn < turn - 1) THEN turn END AS start FROM o)
SELECT conv_id, turn, role, max_level, n_quoted, n_linked, parent_conv, parent_turn, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN
  coalesce(max(start) OVER (PARTITION BY conv_id ORDER BY turn RANGE UNBOUNDED PRECEDING), min(turn) OVER (PARTITION BY conv_id)) END AS branch, clean_sha256 FROM st
"""
