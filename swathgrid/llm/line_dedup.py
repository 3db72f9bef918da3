"""Line dedup: MinHash over character shingles, banding, exact Jaccard verification, distributed union-find.

DataFrame and SQL functions only. A line's shingles are its strings of eight characters at every position (UTF-16 units; a
shorter line is one shingle). Their hashes, sorted, stand on a circle; from each of six fixed points on it the three next
hashes are one band: min-wise hashes by rotation, three to a band, from one hash a shingle.

Every pair of lines that share a band is decided, in two passes:

1. Each line of a band is compared with the band's least and greatest line, which is all pairs up to three lines. Links make
   components.
2. In bands whose lines are still of several components every pair across components is looked at, whatever the band's size:
   bands are cut into blocks and each two blocks are one cell of a join on bitmaps, which bound the symmetric difference of
   two sets from below, so that no link is lost. What they leave is compared by texts (``_across``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import again, components, forget, marked, maybe_in, written

SHINGLE_CHARS = 8
THRESHOLD = 0.8
#: Bands of a line and hashes in a band: a pair at the threshold shares a band with odds of 0.987.
BANDS, ROWS = 6, 3
#: Entries of the circle after a point in which its hashes are looked for first.
AHEAD = 8
#: 64-bit words of a line's bitmap.
WORDS = 16
#: Bands of more rows than about HOT are dealt in so many parts.
HOT, SALTS = 1024, 64
#: Lines of an open band's block, about, and pairs of lines that a task looks at.
BLOCK, TASK_PAIRS = 2048, 1 << 24
#: Pairs a line with candidates that are looked at at once; of more, lines meet so many pivots of each of their bands first.
AT_ONCE, PIVOTS = 8, 8


def _hashes(text: str, size: int) -> str:
    """SQL for the hashes of the shingles, at every position, of a string that is not blank."""
    return f"transform(array(encode({text}, 'UTF-16BE')), raw -> transform(sequence(1, greatest(length(raw) - {2 * size - 1}, 1), 2), i -> xxhash64(substring(raw, i, {2 * size}))))[0]"


def _signed(lines: DataFrame, size: int) -> DataFrame:
    """lines with ``second`` and ``bands``, the distinct band keys of each, in place of the text.

    Hashes and points are sorted as one, repeats included. Where the ``ROWS`` entries after each point are all distinct hashes,
    as in most lines, they are the bands; else the next ``AHEAD`` are searched, and where these hold too few the whole circle.
    """
    points, kept = [-(1 << 63) + k * ((1 << 64) // BANDS) for k in range(BANDS)], [c for c in lines.columns if c != "text"]
    inner, near = f"array({', '.join(f'{p}L' for p in points[1:])})", [f"n{k}" for k in range(BANDS)]
    circle = lines.select(*kept, _second().alias("second"), F.expr(f"sort_array(concat({_hashes('text', size)}, {inner}))").alias("g"))
    after = circle.select(*kept, "second", "g", *[F.slice("g", F.array_position("g", p).cast("int") + 1 if k else 1, AHEAD).alias(near[k]) for k, p in enumerate(points)])
    next_of = [f"slice({n}, 1, {ROWS})" for n in near]
    plain = f"size(array_distinct(concat({', '.join(next_of)}, {inner}))) = {ROWS * BANDS + BANDS - 1}"
    first = f"slice(array_except({{}}, {inner}), 1, {ROWS})"
    around = first.format(f"concat(slice(g, if(k = 0, 1, array_position(g, array(0L, {inner[6:-1]})[k]) + 1), size(g)), g)")
    other = f"transform(transform(array({', '.join(near)}), n -> {first.format('n')}), (n, k) -> xxhash64(if(size(n) = {ROWS}, n, {around})))"
    keys = f"array({', '.join(f'xxhash64({x})' for x in next_of)})"
    return after.select(*kept, "second", F.expr(f"array_distinct(if({plain}, {keys}, {other}))").alias("bands"))


def lines_of(docs: DataFrame) -> DataFrame:
    """``dkey, doc_id, line_no, lid, text`` of every line that is not blank.

    text: the line in lower case, blanks (tab, CR, VT, FF) as spaces, none outside. dkey and lid are 64-bit hashes of the
    document's text and of the line's; ``_second`` tells unequal lines of one lid apart.
    """
    flat = F.col("text")
    for blank in "\t\r\x0b\x0c":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    lines = docs.select(F.xxhash64("text").alias("dkey"), F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.lower(flat), "\n")).alias("line_no", "line"))
    return lines.select("dkey", "doc_id", "line_no", F.trim("line").alias("text")).where("text <> ''").withColumn("lid", F.xxhash64("text"))


def _second() -> Column:
    """Another 64 bits of a line's identity."""
    return F.xxhash64(F.lit(1), F.col("text"))


def _bitmaps(texts: DataFrame, size: int) -> DataFrame:
    """``lid, n, w0, w1, ...``: size of a line's set of shingles, and a bitmap in which each shingle flips one bit."""
    sets = texts.select("lid", F.expr(f"explode(array(array_distinct({_hashes('text', size)})))").alias("s"))  # evaluated once
    flips = [F.expr(f"bit_xor(if((shiftright(h, 6) & {WORDS - 1}) = {k}, shiftleft(1L, cast(h & 63 as int)), 0L))").alias(f"w{k}") for k in range(WORDS)]
    return sets.select("lid", F.explode("s").alias("h")).groupBy("lid").agg(F.count("*").alias("n"), *flips)


def _may_link(threshold: float) -> Column:
    """False only for lines, with their bitmaps as ``x`` and ``y``, whose Jaccard similarity is below the threshold.

    Two bitmaps differ in no more bits than their sets in elements, of which a pair at similarity j has (1 - j) / (1 + j) of
    both sizes' sum.
    """
    n, m = F.col("x.n"), F.col("y.n")
    bits = sum((F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(WORDS)), F.lit(0))
    return (F.least(n, m) + 1e-6 >= threshold * F.greatest(n, m)) & (bits * (1 + threshold) <= (n + m) * (1 - threshold) + 1e-6)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of lids whose sets of shingles have at least the Jaccard similarity.

    Texts travel, not the sets, which take some eight times the bytes.
    """
    left = again(texts).select(F.col("lid").alias("a"), F.col("text").alias("ta"))
    right = again(texts).select(F.col("lid").alias("b"), F.col("text").alias("tb"))
    sets = F.expr(f"inline(array(named_struct('x', {_hashes('ta', size)}, 'y', {_hashes('tb', size)})))")  # evaluated once
    both = pairs.join(left, "a").join(right, "b").select("a", "b", sets)
    return both.where(F.size(F.array_intersect("x", "y")) >= threshold * F.size(F.array_union("x", "y"))).select("a", "b")


def _pair(a: str, b: str) -> Column:
    return F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))


def _ends(members: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` of each member's lid with the least and the greatest of its group."""
    both = members.select(F.explode(F.array(_pair("lid", "lo"), _pair("lid", "hi"))).alias("p"))
    return both.select("p.a", "p.b").where("a <> b").distinct()


def _grouped(signed: DataFrame) -> DataFrame:
    """``band, lid, lo, hi, n`` of the lines that share a band with another: its least and greatest line and its rows.

    Bands that a sample of the lines shows to be hot are dealt in ``SALTS`` parts; the ends of the parts stand for them in
    a group of the whole band. One shuffle; its keys are those of the window.
    """
    keyed = signed.select("lid", F.explode("bands").alias("band"))
    hot = keyed.where(F.pmod("lid", F.lit(SALTS)) == 0).groupBy("band").count().where(f"count >= {HOT // SALTS}").select("band")
    parts = F.when(F.col("hot"), F.pmod(F.xxhash64("lid"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    salted = marked(keyed, written(hot, "hot"), "band", "hot").select("band", "lid", parts.alias("salt"))

    def ends(rows: DataFrame, *by: str) -> DataFrame:
        own = W.partitionBy(*by)
        return rows.select("*", F.min("lid").over(own).alias("lo"), F.max("lid").over(own).alias("hi"), F.count("*").over(own).alias("n"))

    found = written(ends(salted, "band", "salt").where("lo < hi or salt >= 0"), "members")
    top = again(found).where("salt >= 0").select("band", F.explode(F.array("lo", "hi")).alias("lid")).distinct()
    return found.where("lo < hi").select("band", "lid", "lo", "hi", "n").union(ends(top, "band").where("lo < hi").select("band", "lid", "lo", "hi", "n"))


def _placed(held: DataFrame, known: DataFrame) -> DataFrame:
    """``band, lid, c`` of the lines ``held`` by bands, with their components; one row for each."""
    return held.select("band", "lid").join(again(known), F.col("lid") == F.col("node"), "left").select("band", "lid", F.coalesce("component", "lid").alias("c"))


def _open(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``band, lid, c, main, parts, others, block, apart, own`` and bitmaps of those lines of bands in which several components meet.

    main: the band's largest component; block, apart: a line's block among all lines of the band and among those outside
    main; own: the line's bands of this kind, six at most.
    """
    sizes = again(rows).groupBy("band", "c").agg(F.count("*").alias("s")).groupBy("band").agg(F.sum("s").alias("g"), F.max(F.struct("s", "c")).alias("m")).where("m.s < g")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = sizes.select("band", F.col("m.c").alias("main"), blocks(F.col("g")).alias("parts"), blocks(F.col("g") - F.col("m.s")).alias("others"))
    of = lambda n: F.pmod(F.xxhash64(F.lit(2), "lid"), F.col(n)).cast("int")
    own = F.collect_list("band").over(W.partitionBy("lid")).alias("own")
    return rows.join(parts, "band").select("*", of("parts").alias("block"), of("others").alias("apart"), own).join(again(bitmaps), "lid")


def _across(opened: DataFrame, threshold: float, looked_at: float) -> DataFrame:
    """Pairs ``a, b`` of the lines of an open band, of different components, that their bitmaps do not rule out.

    One line of each such pair is outside the band's largest component, so that lines inside it never meet each other. A pair
    comes once, from the least band that it shares. Two blocks of a band meet in one cell, so that a large band is dealt to many tasks.
    """
    tasks = max(int(opened.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(looked_at / TASK_PAIRS))
    x = opened.where("c <> main").select("*", F.col("apart").alias("i"), F.explode(F.expr("sequence(0, parts - 1)")).alias("j"))
    y = again(opened).select("*", F.explode(F.expr("sequence(0, others - 1)")).alias("i"), F.col("block").alias("j"))
    x, y = x.repartition(tasks, "band", "i", "j").alias("x"), y.repartition(tasks, "band", "i", "j").alias("y")
    cell = (F.col("x.band") == F.col("y.band")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    apart = (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.lid") > F.col("y.lid")))
    here = F.array_min(F.array_intersect("x.own", "y.own")) == F.col("x.band")
    return x.join(y.hint("merge"), cell & apart & _may_link(threshold) & here).select(_pair("x.lid", "y.lid").alias("p")).select("p.a", "p.b")


def _to_pivots(opened: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Distinct pairs ``a, b`` of an open band's lines with ``PIVOTS`` of them, others each turn, that may link across components."""
    chance = F.xxhash64(F.lit(turn + 3), "lid")
    least = opened.select("band", chance.alias("r")).groupBy("band", F.pmod("r", F.lit(PIVOTS))).agg(F.min("r").alias("r")).select("band", "r")
    pivots = again(opened).withColumn("r", chance).join(least, ["band", "r"])
    both = (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & _may_link(threshold)
    return opened.alias("x").join(pivots.alias("y"), both).select(_pair("x.lid", "y.lid").alias("p")).select("p.a", "p.b").distinct()


def _connected(known: DataFrame, more: DataFrame) -> DataFrame:
    """``node, component`` by the stars of what is known and by more links, written."""
    out = written(components(again(known).select(F.col("node").alias("a"), F.col("component").alias("b")).union(again(more))), "known")
    forget(known)
    return out


def _completed(known: DataFrame, held: DataFrame, texts: DataFrame, bitmaps: DataFrame, size: int, threshold: float) -> DataFrame:
    """``node, component`` once every pair of lines that share a band of ``held`` is decided.

    While the open bands have more than ``AT_ONCE`` pairs a line of ``texts`` to look at, their lines meet a few pivots first: a
    crowd of near copies becomes one component, of which no other pair is needed. Where that joins few lines, all are compared.
    """
    most, whole, few, turn, rows = AT_ONCE * texts.count(), False, False, 0, held
    while not whole:
        placed = written(_placed(again(rows), known), "placed")
        opened = written(_open(placed, bitmaps), "open")
        forget(placed)
        if turn:
            forget(rows)
        rows = opened  # components only grow: a band that is closed stays so
        counted = opened.groupBy("band").agg(F.count("*").cast("double").alias("g"), F.count_if(F.col("c") != F.col("main")).alias("others"))
        left = counted.agg(F.coalesce(F.sum(F.col("g") * F.col("others")), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("rows")).first()
        whole = few or left.pairs <= most
        pairs = written(_across(opened, threshold, left.pairs) if whole else _to_pivots(opened, threshold, turn), "pairs")
        more = written(_verified(pairs, texts, size, threshold), "links")
        joined = more.count()
        few, turn = joined * 16 < left.rows, turn + 1
        known = _connected(known, more) if joined else known
        for done in (pairs, more):
            forget(done)
    forget(rows)
    return known


def line_components(lines: DataFrame, signed: DataFrame, size: int = SHINGLE_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """``node, second, component`` of the lids that are near copies of others; signed, written: as ``_signed`` has lines."""
    members = written(_grouped(again(signed)), "members")
    pairs = written(_ends(members), "pairs")
    candidates = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    # one row a line before the shuffle: copies of a common line collapse in the partial aggregate
    few = maybe_in(lines.select("lid", "text"), candidates, "lid").groupBy("lid").agg(F.min("text").alias("text"))
    texts = written(few.join(candidates.hint("shuffle_hash"), "lid").select("lid", "text"), "texts")
    links = written(_verified(again(pairs), texts, size, threshold), "links")
    known = written(components(links), "known")
    # all pairs of three lines are compared by now
    rows = again(members).select("band", "lid").distinct()
    held = written(rows.join(rows.groupBy("band").agg(F.count("*").alias("g")).where("g > 3").select("band"), "band"), "held")
    bitmaps = written(_bitmaps(texts.join(again(held).select("lid").distinct().hint("shuffle_hash"), "lid"), size), "bitmaps")
    known = _completed(known, held, texts, bitmaps, size, threshold)
    out = written(known.join(again(texts).select(F.col("lid").alias("node"), _second().alias("second")), "node").select("node", "second", "component"), "lines")
    for done in (members, pairs, texts, bitmaps, links, known, held):
        forget(done)
    return out


def line_classes(docs: DataFrame, size: int = SHINGLE_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per line that is not blank: ``doc_id, line_no, dkey, lid, keep_doc_id, keep_line_no, kept``.

    The line kept of a component stands in the document with the smallest doc_id (nulls last), ties by text and line. Lines
    count as copies with equal text (128 bits of hash) or at least ``threshold`` Jaccard similarity of their sets of shingles.
    """
    lines = lines_of(docs)
    signed = written(_signed(lines, size), "signed")
    components_of = line_components(lines, signed, size, threshold)
    own = again(signed).select("dkey", "doc_id", "line_no", "lid", F.col("second").alias("lid2"))
    same = (F.col("lid") == F.col("node")) & (F.col("lid2") == F.col("second"))
    placed = own.join(components_of.hint("shuffle_hash"), same, "left").select("dkey", "doc_id", "line_no", "lid", F.coalesce("component", "lid").alias("c"), F.when(F.col("component").isNull(), F.col("lid2")).otherwise(F.lit(0)).alias("c2"))
    placed = written(placed, "placed")
    forget(signed)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "dkey", "line_no")
    # written, so that the join's large side is a plain shuffle whose hot parts adaptive execution can split
    least = written(placed.groupBy("c", "c2").agg(F.min(order).alias("k"), F.count("*").alias("n")).where("n > 1").select("c", "c2", "k"), "least")
    out = placed.join(least.hint("shuffle_hash"), ["c", "c2"], "left")
    here, alone = F.struct("doc_id", "line_no", "dkey"), F.col("k").isNull()
    keep = F.when(alone, here).otherwise(F.struct("k.doc_id", "k.line_no", "k.dkey")).alias("keep")
    found = out.select("doc_id", "line_no", "dkey", "lid", keep)
    kept = F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.dkey") == F.col("dkey")) & (F.col("keep.line_no") == F.col("line_no"))
    return found.select("doc_id", "line_no", "dkey", "lid", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, size: int = SHINGLE_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one line left of each component of near copies; columns as they are.

    Blank lines stay with their document. A document whose every line went goes itself; null, empty and blank texts stay.
    Rows that repeat both doc_id and text share their fate. Line ends stay single line feeds.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    classes = line_classes(docs.select("doc_id", "text"), size, threshold).where("not kept")
    gone = written(classes.groupBy("dkey", F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("gone")), "gone")  # bounded by one document
    packed = docs.select(F.struct(*own).alias("row"), F.xxhash64("text").alias("dkey"), F.col("doc_id").cast("long").alias("__own"))
    # only documents that may have lost lines are shuffled
    packed = marked(packed, again(gone), "dkey", "hit")
    hit = packed.where("hit").drop("hit").alias("d")
    joined = hit.join(gone, (F.col("d.dkey") == gone["dkey"]) & F.col("__own").eqNullSafe(F.col("__id")), "left")
    left = F.expr("transform(array(split(row.text, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\\n'))[0]")
    out = joined.withColumn("left", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)).where(F.col("gone").isNull() | (F.trim("left") != ""))
    out = out.select(*[F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    return packed.where("not hit").select(*[F.col(f"row.`{c}`") for c in docs.columns]).union(out)
