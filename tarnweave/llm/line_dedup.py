"""Line deduplication: an edit join by segment partition, with DataFrame functions only.

A line counts if it has at least `least_chars` characters between its outer white space; with `exact_chars`, shorter lines of
at least that many count as well, but only equal ones are merged, as a few edits make another line of them. Lines that
don't count, and blank ones, always stay. Two lines of `least_chars` or more are linked if they differ by at most `edits` single-character edits. Lines are cut into edits + 1
segments; of two linked lines the longer holds one of the other's segments unchanged, at a place that their lengths
bound. So the shorter line's segments are indexed under (length, segment number, characters) and a line probes, for each
length within reach, only the substrings that can match there. Candidate pairs are verified, once what they begin and
end with in common is off, by a bit-parallel edit distance: a few machine words hold, for each number of errors, which
cells of the band 2 * edits + 1 wide are reachable.

Of equal lines the first occurrence (smallest document id, then place) stays; a line goes everywhere if it is linked to
a different line that first occurs earlier. What remains of a text keeps its order. Null texts stay null, texts may
become empty, no row is dropped; rows with equal id and text are one document and keep the same lines, rows with equal id and
different texts are different documents, of which one comes first. An empty table gives an empty result; other columns are carried
along, but for those named like the three that are added.

Equal lines are merged before anything is joined, hot ones in part before they are shuffled. Keys that many lines share are split by
where these lines differ, so what is compared grows with the lines and with the pairs that are linked. Small results are broadcast
after their size has been measured; beyond `broadcast_rows` the same joins are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from tarnweave.llm.shared import free, fresh, saved

BLANK = " \t\r\x0b\x0c"


def _shared_head(x: Column, y: Column) -> Column:
    """How many characters x and y begin with in common, 2047 at most."""
    steps = F.array(*(F.lit(1 << k) for k in range(10, -1, -1)))
    most = F.least(F.length(x), F.length(y))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & (F.substr(x, n + 1, s) == F.substr(y, n + 1, s)), n + s).otherwise(n))


def cores(x: Column, y: Column) -> Column:
    """x and y as struct (x, y), without most of what they begin and end with in common: their edit distance stays the same."""

    def headless(s: Column) -> Column:
        n = _shared_head(s["x"], s["y"])
        return F.transform(F.array(n), lambda k: F.struct(F.reverse(F.substr(s["x"], k + 1)).alias("x"), F.reverse(F.substr(s["y"], k + 1)).alias("y")))[0]

    return F.transform(F.transform(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), headless), headless), lambda s: s)[0]


def trimmed(line: Column) -> Column:
    """The line without BLANK characters around it; most lines have none, which is cheaper to see than to trim."""
    blank = lambda c: (c != "") & F.contains(F.lit(BLANK), c)
    return F.when(blank(F.left(line, F.lit(1))) | blank(F.right(line, F.lit(1))), F.btrim(line, F.lit(BLANK))).otherwise(line)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether strings a and b differ by at most `edits` edits. Bit k of word d, after j characters of b: the first j + k - edits characters of a are within d edits of them."""
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, False).otherwise(F.transform(F.array(cores(a, b)), lambda s: _within(s["x"], s["y"], edits))[0])


def _within(a: Column, b: Column, edits: int) -> Column:
    width, full = 2 * edits + 1, (1 << 2 * edits + 1) - 1
    kind = "struct<" + ",".join(f"w{d}:int" for d in range(edits + 1)) + ">"
    zero = F.struct(*(F.lit(((1 << d + 1) - 1 << edits) & full).alias(f"w{d}") for d in range(edits + 1))).cast(kind)

    def step(w: Column, m: Column) -> Column:
        out = [w["w0"].bitwiseAND(m)]
        for d in range(1, edits + 1):
            before = w[f"w{d - 1}"]
            new = w[f"w{d}"].bitwiseAND(m).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[-1], 1))
            out.append(new.bitwiseAND(F.lit(full)))
        return F.struct(*(x.alias(f"w{d}") for d, x in enumerate(out))).cast(kind)

    def reached(both: Column) -> Column:
        def match(c: Column, j: Column) -> Column:
            bits = [F.when(F.get(both["p"], j + (k - edits)) == c, 1 << k).otherwise(0) for k in range(width)]
            return sum(bits[1:], bits[0])

        return F.aggregate(F.transform(both["t"], match), zero, step)[f"w{edits}"]

    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    # As a lambda's variable, so that strings are split once and not for each character.
    last = F.get(F.transform(F.array(F.struct(chars(a).alias("p"), chars(b).alias("t"))), reached), F.lit(0))
    gap = F.length(a) - F.length(b)
    return F.when(F.abs(gap) > edits, False).otherwise(last.bitwiseAND(F.pow(F.lit(2), gap + edits).cast("int")) != 0)


def _segment(n: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line of n characters: the last n % (edits + 1) segments are one longer."""
    base, more = F.call_function("div", n, F.lit(edits + 1)).cast("int"), n % (edits + 1)
    short = edits + 1 - more
    return 1 + i * base + F.greatest(F.lit(0), F.lit(i) - short), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _key(n: Column, i: int, line: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(n, F.lit(i), F.substr(line, start, size))


def index_keys(line: Column, n: Column, edits: int) -> Column:
    """The line's segments as keys."""
    return F.array(*(_key(n, i, line, *_segment(n, i, edits)) for i in range(edits + 1)))


def shifts(i: int, gap: int, edits: int) -> range:
    """By how much segment i of a line may be displaced in a linked line that is `gap` longer: i errors at most lie before it, and what is left behind it must make up for the rest."""
    left = edits - i
    return range(max(-i, gap - left), min(i, gap + left) + 1)


def probes(lines: DataFrame, edits: int) -> DataFrame:
    """Rows (key, id) of the substrings that can equal a segment of a linked line that is at most as long; but for the line's own segments, which index_keys has. Places are rows before keys are made, so that the generated code stays small enough to be compiled."""
    n, places, starts = F.col("n"), [], []
    for gap in range(edits + 1):
        for i in range(edits + 1):
            start, size = _segment(n - gap, i, edits)
            starts += [start.alias(f"start {gap} {i}"), size.alias(f"size {gap} {i}")]
            places += [F.struct(F.lit(gap).alias("gap"), F.lit(i).alias("i"), (F.col(f"start {gap} {i}") + shift).alias("at"), F.col(f"size {gap} {i}").alias("size")) for shift in shifts(i, gap, edits) if gap or shift]
    rows = lines.select("id", "line", "n", *starts).select("id", "line", "n", F.explode(F.array(*places)).alias("p")).where("p.at >= 1 and p.at + p.size <= n + 1")
    return rows.select(F.xxhash64(n - F.col("p.gap"), "p.i", F.substr("line", "p.at", "p.size")).alias("key"), "id")


#: Letters whose counts are compared before a pair is verified: any set is right, frequent letters tell most.
LETTERS = "etaoinsrhlducm"


def letter_counts(line: Column) -> list[Column]:
    return [(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).alias(f"n_{c}") for c in LETTERS]


def _small(df: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """df, to be broadcast if it has at most `limit` rows, or rows of that weight in all."""
    size = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def possible(probe: DataFrame, index: DataFrame, n_keys: int, most_bits: int = 27) -> DataFrame:
    """Probes whose key may be in the index: by a bitmap with 20 places for each key, which is all that is broadcast, in at most 2**(most_bits - 6) rows. More keys than that let more through and lose none."""
    bits = min(most_bits, max(12, (20 * n_keys - 1).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bitmap = index.select(word.alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("ones"))
    met = probe.join(F.broadcast(bitmap), word == F.col("word"))
    return met.where(F.getbit("ones", bit) == 1).select(*probe.columns)


#: Pairs under one key beyond which the key is split.
HOT_PAIRS = 1 << 16
#: Lines of a key whose characters decide where its lines are cut; any cut is right, a good one makes small groups.
SAMPLE = 32
#: How often keys are split; pairs that still meet under a hot key are dealt to blocks of this many indexed lines.
ROUNDS = 5
BLOCK = 256


def _variety(lines: Column, n: Column) -> Column:
    """At each of the first n places, how many characters beyond one the lines have there."""
    return F.transform(F.array(F.transform(lines, lambda x: F.filter(F.split(x, ""), lambda c: c != ""))), lambda chars: F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.size(F.array_distinct(F.transform(chars, lambda c: F.get(c, p)))) - 1))[0]


def free_places(lines: Column, n: Column, edits: int) -> Column:
    """The places, `edits` of them at most, at which lines of n characters differ most."""
    ranked = F.sort_array(F.filter(F.transform(_variety(lines, n), lambda v, p: F.struct(v.alias("v"), p.alias("p"))), lambda x: x["v"] > 0), asc=False)
    return F.sort_array(F.transform(F.slice(ranked, 1, edits), lambda x: x["p"]))


def cuts(lines: Column, n: Column, edits: int) -> Column:
    """Where to cut lines of n characters, as `edits` numbers of characters: so that each segment has an equal share of the places' variety in the sample `lines`, and at least one character."""
    parts = edits + 1
    variety = _variety(lines, n)
    total = F.aggregate(variety, F.lit(0), lambda t, v: t + v)
    kind = "struct<sum:int," + ",".join(f"c{j}:int" for j in range(1, parts)) + ">"
    zero = F.struct(*(F.lit(0) for _ in range(parts))).cast(kind)

    def step(acc: Column, v: Column, total: Column) -> Column:
        now = acc["sum"] + v
        return F.struct(now, *(acc[f"c{j}"] + F.when(now * parts <= total * j, 1).otherwise(0) for j in range(1, parts))).cast(kind)

    found = F.transform(F.array(F.struct(variety.alias("v"), total.alias("t"))), lambda s: F.aggregate(s["v"], zero, lambda acc, v: step(acc, v, s["t"])))[0]

    def placed(c: Column) -> Column:
        out = []
        for j in range(1, parts):
            at = F.least(c[f"c{j}"], n - (parts - j))
            out.append(F.greatest(at, out[-1] + 1 if out else F.lit(1)))
        return F.array(*out)

    return F.transform(F.array(found), placed)[0]


def _narrowed(hot: DataFrame, lines: DataFrame, edits: int, broadcast_rows: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Rows (key, id, indexed, parent) of hot keys under narrower keys, one for each segment of lines cut where this key's lines differ. Lines linked to each other that share the old key share a new one."""
    known = saved(hot.join(lines.select("id", "line", F.col("n").alias("length")), "id"), "line-hot")
    sample = known.where("indexed").groupBy("key", F.pmod("id", F.lit(SAMPLE)).alias("part")).agg(F.min_by("line", "id").alias("line"), F.min("length").alias("n"))
    cut = sample.groupBy("key").agg(F.collect_list("line").alias("sample"), F.min("n").alias("n"))
    cut = saved(cut.select("key", "n", cuts(F.col("sample"), F.col("n"), edits).alias("cuts")), "line-cuts")
    rows = known.join(_small(cut, broadcast_rows), "key")
    length, edge, places = F.col("length"), [F.lit(0), *(F.col("cuts")[j] for j in range(edits)), F.col("n")], []
    for i in range(edits + 1):
        for gap in range(edits + 1):
            for shift in shifts(i, gap, edits):
                at, size = edge[i] + 1 + shift, edge[i + 1] - edge[i]
                # A line that the old key met by a displaced substring isn't indexed under the new ones.
                own = F.lit(False) if gap or shift else F.col("indexed")
                places.append(F.struct(F.lit(i).alias("i"), F.lit(gap).alias("gap"), at.alias("at"), size.alias("size"), own.alias("own")))
    spread = rows.select("key", "id", "line", "n", "length", F.explode(F.array(*places)).alias("p"))
    fits = spread.where("p.at >= 1 and p.at + p.size <= length + 1 and length = n + p.gap")
    narrow = fits.select(F.xxhash64("key", "p.i", F.substr("line", "p.at", "p.size")).alias("its key"), "id", F.col("p.own").alias("indexed"), F.col("key").alias("parent"))
    narrow = narrow.groupBy(F.col("its key").alias("key"), "id", "parent").agg(F.bool_or("indexed").alias("indexed"))
    return saved(narrow.select("key", "id", "indexed", "parent"), "line-narrow"), (known, cut)


def _met(rows: DataFrame, *more: str) -> DataFrame:
    """Of rows (key, id, indexed): the keys under which an indexed line meets another, with pairs, their number, and crowd, the key's number of indexed lines, or 0 if its pairs are few."""
    sizes = rows.groupBy("key", *more).agg(F.count_if("indexed").alias("n_indexed"), F.count("*").alias("n")).where("n_indexed > 0 and n > 1")
    return sizes.select("key", *more, (F.col("n_indexed") * F.col("n")).alias("pairs"), F.when(F.col("n_indexed") * F.col("n") > HOT_PAIRS, F.col("n_indexed")).otherwise(0).alias("crowd"))


def _meeting(rows: DataFrame, broadcast_rows: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """Of rows (key, id, indexed): those under keys where an indexed line meets another, and the same under keys with too many pairs, with the key's number of pairs and of indexed lines."""
    active = saved(_met(rows), "line-active")
    met = saved(rows.join(_small(active, broadcast_rows), "key"), "line-met")
    return met.where("crowd = 0").select("key", "id", "indexed"), met.where("crowd > 0").select("key", "id", "indexed", "pairs", "crowd"), (active, met)


def _split(hot: DataFrame, lines: DataFrame, edits: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """Hot keys split once: rows under few-paired narrower keys, rows under hot narrower keys, and rows of keys that have no less pairs when split (at least half as many), which stay as they are."""
    narrow, used = _narrowed(hot.select("key", "id", "indexed"), lines, edits, broadcast_rows)
    free(*used)
    own = hot.groupBy("key").agg(F.max("pairs").alias("pairs"))
    after = _met(narrow, "parent").groupBy("parent").agg(F.sum("pairs").alias("after"))
    stay = saved(after.join(own, F.col("parent") == F.col("key")).where("2 * after > pairs").select("parent"), "line-stay")
    few = _small(stay, broadcast_rows)
    still = hot.join(few, F.col("key") == F.col("parent"), "left_semi")
    cool, more, made = _meeting(narrow.join(few, "parent", "left_anti").drop("parent"), broadcast_rows)
    free(narrow)
    return cool, more, still, (stay, *made)


def _cliques(crowd: DataFrame, lines: DataFrame, edits: int, broadcast_rows: int) -> DataFrame:
    """Of lines under hot keys (key, id, indexed): id, clique. Lines of a clique are of one length and equal but for the same few places, so each is linked to each other one; a line is in one clique at most, the largest that it fits."""
    known = saved(crowd.select("key", "id", "indexed").join(lines.select("id", "line", F.col("n").alias("length")), "id"), "line-crowd")
    sample = known.where("indexed").groupBy("key", F.pmod("id", F.lit(SAMPLE)).alias("part")).agg(F.min_by("line", "id").alias("line"), F.min("length").alias("n"))
    places = sample.groupBy("key").agg(F.collect_list("line").alias("sample"), F.min("n").alias("n"))
    places = saved(places.select("key", "n", free_places(F.col("sample"), F.col("n"), edits).alias("places")), "line-places")
    rows = known.join(_small(places, broadcast_rows), "key").where("length = n")
    masked = F.col("line")
    for j in range(edits):
        at = F.get("places", F.lit(j))
        masked = F.when(at.isNull(), masked).otherwise(F.overlay(masked, F.lit("\0"), at + 1, F.lit(1)))
    fits = saved(rows.select("id", F.xxhash64("places", masked).alias("clique")).distinct(), "line-fits")
    sizes = fits.groupBy("clique").agg(F.count("*").alias("size")).where("size > 1")
    return saved(fits.join(sizes, "clique").groupBy("id").agg(F.max_by("clique", F.struct("size", "clique")).alias("clique")), "line-cliques")


def line_links(lines: DataFrame, edits: int, broadcast_rows: int) -> DataFrame:
    """From distinct lines (id, line, n, least) to id, links (the number of lines that it is linked to) and late (one of them first occurs earlier).

    Keys under which lines meet are found by counting, which doesn't grow with the square of a key's lines. Keys with many pairs are split again
    by where their own lines differ, as long as that makes their pairs less; what is left are lines alike in nearly all places, which are linked for the
    most part. Those that differ in the same few places only are counted as cliques, without comparing them; others are dealt to blocks. Only lines that have such keys get their texts. Two lines are compared under the smallest of the keys at which they meet and no
    other, so that verified pairs are counted where they are found and never come together.
    """
    index = saved(lines.select(F.explode(index_keys(F.col("line"), F.col("n"), edits)).alias("key"), "id", F.lit(True).alias("indexed")), "line-index")
    probe = possible(probes(lines, edits), index, (edits + 1) * max(1, lines.count()))
    probe = saved(probe.withColumn("indexed", F.lit(False)), "line-probes")
    once = index.unionAll(probe).groupBy("key", "id").agg(F.bool_or("indexed").alias("indexed")) if edits else index
    cool, hot, made = _meeting(once, broadcast_rows)
    free(index, probe)
    held, few, crowded = list(made), cool, []
    for turn in range(ROUNDS + 1):
        if hot.isEmpty():
            break
        if turn == ROUNDS:
            crowded.append(hot)
            break
        cool, hot, still, made = _split(hot, lines, edits, broadcast_rows)
        few = few.unionAll(cool)
        crowded.append(still)
        held += made
    crowded = [x for x in crowded if not x.isEmpty()]
    cliques = _cliques(reduce(DataFrame.unionAll, crowded), lines, edits, broadcast_rows) if crowded else None
    zero = F.lit(0).alias("block")
    firsts, seconds, keys = [few.where("indexed").select("key", "id", zero)], [few.select("key", "id", "indexed", zero)], [few]
    for rows in crowded:
        # A block of a key has few of its indexed lines, and each line to compare them with.
        n_blocks = F.ceil(F.col("crowd") / BLOCK)
        firsts.append(rows.where("indexed").select("key", "id", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block")))
        seconds.append(rows.select("key", "id", "indexed", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))).alias("block")))
        keys.append(rows.select("key", "id", "indexed"))
    joined = lambda parts: reduce(DataFrame.unionAll, parts)
    own = joined(keys).groupBy("id").agg(F.collect_set(F.when(F.col("indexed"), F.col("key"))).alias("own"), F.collect_set("key").alias("keys"))
    some = saved(own, "line-ids")
    counts = [f"n_{c}" for c in LETTERS]
    texts = lines.join(_small(some, broadcast_rows // 4), "id")
    texts = texts.withColumn("clique", F.lit(None).cast("long")) if cliques is None else texts.join(_small(cliques, broadcast_rows), "id", "left")
    texts = saved(texts.select("id", "line", "least", "own", "keys", "clique", *letter_counts(F.col("line"))), "line-texts")
    a = joined(firsts).join(texts, "id").select("key", "block", F.col("id").alias("a"), F.col("line").alias("x"), F.col("least").alias("first_a"), F.col("own").alias("own_a"), F.col("keys").alias("keys_a"), F.col("clique").alias("clique_a"), *(F.col(n).alias(f"x{n}") for n in counts))
    b = joined(seconds).join(texts, "id").select(F.col("key").alias("its key"), F.col("block").alias("its block"), F.col("id").alias("b"), F.col("line").alias("y"), F.col("least").alias("first_b"), F.col("indexed").alias("both"), F.col("own").alias("own_b"), F.col("keys").alias("keys_b"), F.col("clique").alias("clique_b"), *counts)
    other = (F.col("key") == F.col("its key")) & (F.col("block") == F.col("its block")) & F.when(F.col("both"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    # An edit changes two letters' counts by one at most.
    alike = sum((F.abs(F.col(f"x{n}") - F.col(n)) for n in counts), F.lit(0)) <= 2 * edits
    here = F.least(F.array_min(F.array_intersect("own_a", "keys_b")), F.array_min(F.array_intersect("keys_a", "own_b"))) == F.col("key")
    apart = F.coalesce(F.col("clique_a") != F.col("clique_b"), F.lit(True))
    pairs = a.join(b, other & apart & F.when(alike, F.when(here, within(F.col("x"), F.col("y"), edits)).otherwise(False)).otherwise(False))
    before = F.col("first_a") < F.col("first_b")
    sides = F.array(F.struct(F.col("a").alias("id"), (~before).alias("late")), F.struct(F.col("b").alias("id"), before.alias("late")))
    ends = pairs.select(F.explode(sides).alias("e")).select("e.id", F.lit(1).cast("long").alias("n"), "e.late")
    if cliques is not None:
        groups = texts.where("clique is not null").groupBy("clique").agg(F.count("*").alias("size"), F.min("least").alias("first")).where("size > 1")
        ends = ends.unionAll(texts.join(_small(groups, broadcast_rows), "clique").select("id", (F.col("size") - 1).alias("n"), (F.col("least") > F.col("first")).alias("late")))
    out = saved(ends.groupBy("id").agg(F.sum("n").alias("links"), F.bool_or("late").alias("late")), "line-links")
    free(*held, some, texts, *([] if cliques is None else [cliques]))
    return out


def _place(kind: DataType) -> Column:
    """What orders a line's occurrences, from columns doc, at and body. For whole-number ids it is one number, which needs no sorting to be aggregated (31 bits of the body's hash tell documents of one id apart); a null id comes first."""
    if not isinstance(kind, IntegralType):
        return F.struct("doc", "at", "body")
    size = F.lit(1 << 31).cast("decimal(11,0)")
    doc = F.coalesce(F.col("doc"), F.lit(-(1 << 63))).cast("decimal(20,0)")
    inner = F.col("at").cast("long") * F.lit(1 << 31) + F.col("body").bitwiseAND(F.lit((1 << 31) - 1))
    return (doc * F.lit(1 << 62).cast("decimal(19,0)") + inner.cast("decimal(20,0)")).cast("decimal(38,0)")


def dedup_lines(docs: DataFrame, edits: int = 2, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1 << 20, exact_chars: int | None = None) -> DataFrame:
    """docs with text_col deduplicated, and columns n_lines (lines that count), n_removed, n_links (links of its lines to other lines), which replace columns of these names."""
    counting = least_chars if exact_chars is None else max(1, min(exact_chars, least_chars))
    least_chars = max(least_chars, edits + 1)
    kind = docs.schema[id_col].dataType
    broken = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("body"), F.posexplode(F.split(text_col, "\n")).alias("at", "whole"))
    lines = broken.select("doc", "body", "at", trimmed(F.col("whole")).alias("line")).where(F.length("line") >= counting)
    # Equal lines become one, under a 64-bit id of the text; the text itself is the grouping key.
    place = _place(kind)
    merged = lines.groupBy("line").agg(F.min(place).alias("least"), F.count("*").alias("n_copies"))
    distinct = saved(merged.select(F.xxhash64("line").alias("id"), F.length("line").alias("n"), "least", "n_copies", "line"), "lines")
    marks = line_links(distinct.where(F.col("n") >= least_chars).select("id", "line", "n", "least"), edits, broadcast_rows)
    # Lines that are linked or occur again: the others need no decision.
    decided = distinct.select("id", "least", "n_copies").join(marks, "id", "left").where("n_copies > 1 or links is not null").select("id", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("late", F.lit(False)).alias("late"))
    decided = saved(decided, "line-decisions")
    free(distinct, marks)
    wide = None if isinstance(kind, IntegralType) else 1 + F.coalesce(F.octet_length(F.col("least.doc").cast("string")), F.lit(0)) / 32
    placed = lines.select("doc", "body", "at", F.xxhash64("line").alias("id"), place.alias("here")).join(_small(decided, broadcast_rows, wide), "id")
    gone = F.col("late") | ~F.col("least").eqNullSafe(F.col("here"))
    per_doc = placed.groupBy("doc", "body").agg(F.sort_array(F.collect_set(F.when(gone, F.col("at")))).alias("places"), F.sum("links").alias("links"))
    per_doc = saved(per_doc, "line-places")
    free(decided)
    hashed, doc, body, gone_at, links = (fresh(x, *docs.columns) for x in ("body hash", "of doc", "of body", "gone places", "links of lines"))
    marked = per_doc.select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("places").alias(gone_at), F.col("links").alias(links))
    keyed = docs.withColumn(hashed, F.xxhash64(text_col))
    joined = keyed.join(_small(marked, 2 * broadcast_rows, F.lit(2) + F.size(gone_at) / 4), F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(hashed) == F.col(body)), "left")
    split = F.split(text_col, "\n")
    places = F.coalesce(gone_at, F.array().cast("array<int>"))
    text = F.when(F.size(places) > 0, F.array_join(F.filter(split, lambda x, k: ~F.array_contains(places, k)), "\n")).otherwise(F.col(text_col))
    counted = F.coalesce(F.size(F.filter(split, lambda x: (F.length(x) >= counting) & (F.length(trimmed(x)) >= counting))), F.lit(0))
    counts = {"n_lines": counted.cast("long"), "n_removed": F.size(places).cast("long"), "n_links": F.coalesce(links, F.lit(0)).cast("long")}
    own = [text.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns if c.lower() not in counts]
    return joined.select(*own, *(v.alias(k) for k, v in counts.items()))
