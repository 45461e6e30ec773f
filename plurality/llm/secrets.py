"""Secret scans: fixed patterns, and a randomness test battery under false-discovery control.

Tokens with letters and digits get the smallest encoding that holds their characters. Two questions are asked.
Is the token compatible with a random string over that alphabet: chi-squared (against uneven counts), runs and
serial-correlation tests (two-sided), joined by their minimum (Bonferroni), so that none can outweigh another; the
battery turns down alphabets, counters and repeats. Can ordinary text be ruled out: the null hypothesis is that the
token's letters coincide as in ordinary text, or stand in runs, or follow each other, and its p-value is the
largest of the three. Within each band of encoding and length (powers of two) Benjamini and Hochberg's rule over
all tokens of all documents bounds the share of ordinary tokens among the reported ones by ``Q``. Short tokens
have large p-values, so lengths need no limit of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import let, materialize, table, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: (name, pattern, group whose length counts, least length); a dropped match still uses up its characters.
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
ADDED = "random"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*"
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, smallest alphabet first.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UP + "234567"),
    ("base36", _DIGITS + _LOW),
    ("BASE36", _DIGITS + _UP),
    ("base62", _UP + _LOW + _DIGITS),
    ("base64", _UP + _LOW + _DIGITS + "+/"),
    ("base64url", _UP + _LOW + _DIGITS + "-_"),
)
#: Share of ordinary tokens among those reported, and the battery's level (what it loses of random ones).
Q, LEVEL = 0.1, 0.001
MARK = "[SECRET]"
#: Ordinary text with some digits: the rate of equal pairs of letters, and what their triples add to its variance.
TEXT_COINCIDENCE, TEXT_TRIPLES = 0.055, 0.00094
#: From which correlation of neighbours, and which share of the expected changes of half, a token counts as ordered.
ORDERED, CLUSTERED = 0.7, 0.25
_GRADES = 150  # p-values are ranked in tenths of a power of ten, down to 1e-15
_BLOCK = 4096  # code points in the pieces a text is cut from


def running(values: Column, op) -> Column:
    """Running totals of an array by an associative ``op``, by doubling: each step is one pass over the array."""

    def step(acc, k):
        by = F.least(F.pow(F.lit(2), k).cast("int"), F.size(acc))
        before = F.concat(F.array_repeat(F.lit(None).cast("int"), by), F.slice(acc, 1, F.size(acc) - by))
        return F.zip_with(acc, before, lambda x, y: F.when(y.isNull(), x).otherwise(op(y, x)))

    return let(values, lambda v: F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int")), v, step))


def _spans(text: Column, pattern: str, group: int, least: int, *, with_hit: bool = False) -> Column:
    """Leftmost non-overlapping matches as structs (s, e) or (s, e, hit), in code points, end exclusive.

    The pieces between the matches and the matches themselves take turns, so running sums of their lengths give positions.
    """

    def placed(x):
        lengths = F.transform(x, lambda v: F.length(v["piece"]) + F.coalesce(F.length(v["hit"]), F.lit(0)))
        ends = F.zip_with(x, running(lengths, lambda a, b: a + b), lambda v, e: F.struct((e - F.length(v["hit"])).alias("s"), e.alias("e"), v["hit"].alias("hit"), F.length(v["value"]).alias("n")))
        fine = F.filter(ends, lambda v: v["n"] >= least)
        return F.transform(fine, lambda v: F.struct(v["s"].alias("s"), v["e"].alias("e"), *([v["hit"].alias("hit")] if with_hit else [])))

    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    none = F.array().cast("array<struct<s:int,e:int,hit:string>>" if with_hit else "array<struct<s:int,e:int>>")
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution, within some 2% of itself."""
    x = F.least(F.greatest(F.abs(z), F.lit(1e-6)), F.lit(8.0))
    upper = (1 - F.exp(-1.4 * x)) * F.exp(-x * x / 2) / (1.135 * 2.5066282746 * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def p_ordinary(index: Column, size: Column) -> Column:
    """The p-value against ordinary text; 1 if the battery finds the token not random either.

    ``index``: array of places in an alphabet of ``size``.
    """

    def battery(x):
        n = F.size(x).cast("double")
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))
        # Sorted, equal symbols stand in runs: the k-th of a run adds 2k - 1 to the sum of squared counts.
        none = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        longer = lambda a, v: F.when(v == a["last"], a["run"] + 1).otherwise(F.lit(1.0))
        squares = F.aggregate(F.array_sort(x), none, lambda a, v: F.struct(v.alias("last"), longer(a, v).alias("run"), (a["sum"] + 2 * longer(a, v) - 1).alias("sum")), lambda a: a["sum"])
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        half = F.floor(size / 2)
        mean = total(x, lambda v: v.cast("double")) / n
        sums = F.struct(
            n.alias("n"), squares.alias("squares"), total(x, lambda v: (v >= half).cast("double")).alias("upper"),
            total(pairs, lambda v: ((v["a"] >= half) != (v["b"] >= half)).cast("double")).alias("changes"),
            let(mean, lambda m: total(pairs, lambda v: (v["a"] - m) * (v["b"] - m)) / F.greatest(total(x, lambda v: (v - m) * (v - m)), F.lit(1e-9))).alias("r"),
        )
        return let(sums, judged)

    def judged(m):
        n, r = m["n"], m["r"]
        two_sided = lambda z: F.least(F.lit(1.0), 2 * _tail(F.abs(z)))
        # Against randomness.
        chi, spread = F.greatest(m["squares"] * size / n - n, F.lit(0.0)), 2 / (9 * (size - 1))
        uniform = _tail((F.pow(chi / (size - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread * (1 - 1 / n)))
        expected = 2 * m["upper"] * (n - m["upper"]) / n
        runs = F.when(expected <= 1, F.lit(0.0)).otherwise(two_sided((m["changes"] - expected) / F.sqrt(expected * (expected - 1) / (n - 1))))
        random = 3 * F.least(uniform, runs, two_sided((r + 1 / n) * F.sqrt(n)))
        # Against ordinary text: letters coincide, halves stay or alternate, neighbours correlate.
        scale = 26 / F.least(size, F.lit(26))
        rate = TEXT_COINCIDENCE * scale
        coincide = 1 - _tail(((m["squares"] - n) / (n * (n - 1)) - rate) / F.sqrt(4 * TEXT_TRIPLES * scale * scale / n + 2 * rate * (1 - rate) / (n * (n - 1))))
        change, even = m["changes"] / (n - 1), expected / (n - 1)
        error = lambda p: F.sqrt(p * (1 - p) / (n - 1))
        few, many = CLUSTERED * even, F.least((2 - CLUSTERED) * even, F.lit(0.99))
        clustered = F.greatest(_tail((change - few) / error(few)), _tail((many - change) / error(many)))
        ordered = _tail((F.atanh(F.lit(ORDERED)) - F.atanh(F.least(F.abs(r), F.lit(0.999999)))) * F.sqrt(n - 3))
        fine = (random >= LEVEL) & (expected > 1)
        return F.when(fine, F.greatest(coincide, clustered, ordered, F.lit(1e-15))).otherwise(1.0)

    return let(index, battery)


def _candidate(token: Column) -> Column:
    """(band, p) of a token, null without an encoding, a letter or a digit."""

    def scored(body):
        fits = [F.when(body.rlike("^[" + alphabet.replace("-", r"\-") + "]++$"), F.lit(at)) for at, (_, alphabet) in enumerate(ENCODINGS)]

        def judged(code):
            alphabet = F.element_at(F.array(*[F.lit(a) for _, a in ENCODINGS]), code + 1)
            index = let(alphabet, lambda a: F.transform(F.split(body, "(?!^)", -1), lambda c: F.instr(a, c) - 1))
            band = (code * 32 + F.floor(F.log2(F.length(body)))).cast("int")
            return F.when(code.isNotNull(), F.struct(band.alias("band"), let(F.length(alphabet), lambda size: p_ordinary(index, size)).alias("p")))

        return F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), let(F.coalesce(*fits), judged))

    return let(F.regexp_replace(token, "=++$", ""), scored)


def scan(text: Column) -> Column:
    """Struct of the base spans of each kind and ``cands``: (s, e, band, p) of every graded token."""

    def candidates(spans):
        graded = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _candidate(x["hit"]).alias("c")))
        kept = F.filter(graded, lambda x: x["c"].isNotNull())
        return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["c"]["band"].alias("band"), x["c"]["p"].alias("p")))

    return F.struct(*[_spans(text, p, g, n).alias(k) for k, p, g, n in BASE], let(_spans(text, TOKEN, 0, 20, with_hit=True), candidates).alias("cands"))


def reported_upto(scans: DataFrame) -> Column:
    """A map from band to the p-value up to which its tokens are reported, by Benjamini and Hochberg's rule.

    Counts of graded p-values are all it takes: at most 256 bands of 151 rows, of which one for each band
    reaches the driver. Grades round p-values up, so the rule stays on the safe side.
    """
    grade = F.least(F.lit(_GRADES), F.floor(-10 * F.log10("p"))).cast("int")
    up = Window.partitionBy("band").orderBy(F.desc("grade"))
    cuts = (
        scans.select(F.explode("scan.cands").alias("c")).select("c.band", "c.p").groupBy("band", grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
        .withColumn("edge", F.pow(F.lit(10.0), -F.col("grade") / 10))
        .filter(F.col("edge") <= Q * F.col("upto") / F.col("all"))
        .groupBy("band").agg(F.max("edge").alias("edge"))
    ).collect()
    pairs = [F.lit(x) for row in cuts for x in (row["band"], row["edge"])]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<int,double>")


def all_spans(found: Column, cuts: Column) -> Column:
    """All spans of a scan as structs (s, rank, e, kind), by start, then kind as listed; added ones overlap no base span."""
    marked = lambda spans, rank, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    base = F.concat(*[marked(found[k], i, k) for i, (k, *_) in enumerate(BASE)])
    random = F.filter(found["cands"], lambda c: c["p"] <= F.coalesce(F.element_at(cuts, c["band"]), F.lit(-1.0)))
    own = lambda x: x["rank"] < len(BASE)

    def apart(spans):
        # In order of start: an added span meets a base one if an earlier one ends beyond its start, or a later one starts before its end.
        reach = running(F.transform(spans, lambda x: F.when(own(x), x["e"]).otherwise(0)), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(own(x), x["s"]).otherwise(2**31 - 1))), F.least))
        both = F.arrays_zip(spans.alias("x"), reach.alias("reach"), ahead.alias("ahead"))
        fine = F.filter(both, lambda v: own(v["x"]) | (v["reach"] <= v["x"]["s"]) & (v["ahead"] >= v["x"]["e"]))
        return F.transform(fine, lambda v: v["x"])

    def joined(added):
        return F.when(F.size(added) == 0, F.array_sort(base)).otherwise(let(F.array_sort(F.concat(base, added)), apart))

    return let(marked(random, len(BASE), ADDED), joined)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def find_secrets(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``.

    Null and empty texts have no spans. Repeated rows and null ids give rows like any other; an empty table
    none. Only the two named columns are read, so others cannot clash.
    """
    scans = materialize(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", scan(F.col("text")).alias("scan")), "secret-scan")
    cuts = reported_upto(scans)
    found = scans.select("doc_id", all_spans(F.col("scan"), cuts).alias("x"))
    kinds = [k for k, *_ in BASE]
    count = lambda k: F.size(F.filter("x", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("x", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in (*kinds, ADDED)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("x")).alias("spans"))


def redact_secrets(docs: DataFrame, *, text_col="text", mark=MARK) -> DataFrame:
    """``docs`` with every secret span of ``text_col`` replaced by ``mark`` (overlapping spans by one); null stays null.

    The first pass only grades p-values; the second finds the spans again beside the text they cut, so
    texts are neither written nor joined.
    """
    # Only what the grades need of the first pass; the column's other parts are never computed.
    first = docs.select(F.struct(scan(text_or_empty(text_col))["cands"].alias("cands")).alias("scan"))
    cuts = reported_upto(first)
    text = F.col(text_col)

    def merged(spans):
        """Spans that overlap as one: a group starts where no earlier span reaches."""
        reach = running(F.transform(spans, lambda x: x["e"]), F.greatest)
        before = F.concat(F.array(F.lit(-1)), F.slice(reach, 1, F.size(reach) - 1))
        both = F.arrays_zip(spans.alias("x"), before.alias("before"), F.concat(F.slice(F.transform(spans, lambda x: x["s"]), 2, F.size(spans)), F.array(F.lit(2**31 - 1))).alias("next"), reach.alias("reach"))
        starts = F.transform(F.filter(both, lambda v: v["x"]["s"] >= v["before"]), lambda v: v["x"]["s"])
        ends = F.transform(F.filter(both, lambda v: v["next"] >= v["reach"]), lambda v: v["reach"])
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def cut(spans):
        froms = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
        upto = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.length(text)))

        def pieces(blocks):
            def piece(a, b):
                first, last = F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")
                at = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
                inner = F.concat(F.substring(at(first), a % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), b % _BLOCK))
                return F.when(first == last, F.substring(at(first), a % _BLOCK + 1, b - a)).otherwise(inner)

            return F.array_join(F.zip_with(froms, upto, piece), mark)

        # A piece is cut from its own blocks of the text, so that none is looked for from the start.
        return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}+" % _BLOCK), F.lit(0)), pieces)

    found = let(let(scan(text), lambda x: all_spans(x, cuts)), lambda x: F.when(F.size(x) == 0, text).otherwise(let(merged(x), cut)))
    return docs.withColumn(text_col, F.when(text.isNotNull(), found))


def op1_randomness_secrets(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
