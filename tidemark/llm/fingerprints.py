"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations alone.

A text's paragraphs (lines, and sentences within them) are hashed; each digest is entered in three cells of a small table, which holds the number,
the exclusive-or of digests and that of their check hashes. Tables of two versions subtract cell by cell, and what is left is peeled: a cell with one
digest gives it, and it is taken out of its other cells, until nothing is left. If that fails the tables are made anew, larger, in as
many parts as the two texts have paragraphs for; a part that fails is made anew by itself with more cells and other places, twice, and
only then are its digests compared plainly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells in each third of the fingerprint's table; digests for each part of a larger one, and the cells in its thirds, by attempt.
CELLS, PER_PART, LARGER = 4, 12, (9, 24, 64)
ROUNDS = 12
PARAGRAPHS = r"\n+|(?<=[.!?]) +"


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs; null counts as empty, and the empty text has one empty paragraph."""
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPHS), lambda p: F.xxhash64(p)))


def _places(array: str, cells: int, parts: str, salt: int, sign: int = 1) -> str:
    """Of each digest: itself, its check hash, its sign, its part and its cell of each third."""
    third = lambda k: f"cast((shiftrightunsigned(h, {16 * k}) & 65535) % {cells} AS int)"
    part = "0" if parts == "1" else f"cast((shiftrightunsigned(h, 48) & 65535) % ({parts}) AS int)"
    inner = f"named_struct('d', d, 'c', xxhash64(d, 77), 's', {sign}, 'g', {part}, 'p0', {third(0)}, 'p1', {third(1)}, 'p2', {third(2)})"
    if not salt:
        return f"transform({array}, h -> {inner.replace('(d, 77)', '(h, 77)').replace("'d', d", "'d', h")})"
    return f"transform({array}, d -> transform(array(xxhash64(d, {salt})), h -> {inner})[0])"


def _entered(elements: str, cell: str, third: int, place: str) -> str:
    """A cell with those of the elements in it that belong there. Each is one step, and only those that belong there make a new cell."""
    return f"aggregate({elements}, {cell}, (x, e) -> if(e.p{third} = {place}, named_struct('n', x.n + e.s, 'k', x.k ^ e.d, 'c', x.c ^ e.c), x))"


def _table(elements: str, cells: int, less: str | None = None) -> str:
    """The cells of a sketch of these elements, less those of a sketch of others, which have the other sign."""
    cell = lambda k: _entered(elements, "named_struct('n', 0, 'k', 0L, 'c', 0L)", k, "j")
    both = lambda k: _entered(less, cell(k), k, "j") if less else cell(k)
    return _thirds(lambda k: f"transform(sequence(0, {cells - 1}), j -> {both(k)})")


def _thirds(make: Callable[[int], str]) -> str:
    return "concat(" + ", ".join(make(k) for k in range(3)) + ")"


def _peeled(table: str, cells: int, salt: int) -> str:
    """(whether all was recovered, how many digests only the first has, and only the second) of a difference of tables."""
    pure = lambda sign: f"array_distinct(transform(filter(t, x -> x.n = {sign} AND xxhash64(x.k, 77) = x.c), x -> x.k))"
    known = f"'more', {pure(1)}, 'less', {pure(-1)}"
    # what is peeled is entered with the other sign, which takes it out
    out = f"concat({_places('st.more', cells, '1', salt, -1)}, {_places('st.less', cells, '1', salt, 1)})"
    taken = _thirds(lambda k: f"transform(slice(st.t, {k * cells + 1}, {cells}), (x, i) -> {_entered('out', 'x', k, 'i')})")
    step = f"transform(array({out}), out -> transform(array({taken}), t -> named_struct('t', t, 'a', st.a + size(st.more), 'b', st.b + size(st.less), {known}))[0])[0]"
    start = f"transform(array({table}), t -> named_struct('t', t, 'a', 0, 'b', 0, {known}))[0]"
    end = "st -> named_struct('ok', forall(st.t, x -> x.n = 0 AND x.k = 0 AND x.c = 0), 'a', st.a, 'b', st.b)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> if(size(st.more) + size(st.less) = 0, st, {step}), {end})"


def _less(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def sketch(array: str, cells: int = CELLS) -> Column:
    """The table of a column of digests, in one part."""
    return F.expr(f"transform(array({_places(array, cells, '1', 0)}), el -> {_table('el', cells)})[0]")


def written(table: str) -> Column:
    """A table as text: of each cell the number, digests and check hashes in hexadecimal."""
    return F.expr(f"array_join(transform({table}, x -> concat(hex(x.n), '.', hex(x.k), '.', hex(x.c & 65535))), '-')")


def _kept(result: str, a: str, b: str) -> str:
    """A part's result, with its digests if they must be tried again."""
    none = "cast(array() AS array<bigint>)"
    return f"transform(array({result}), r -> named_struct('ok', r.ok, 'a', r.a, 'b', r.b, 'da', if(r.ok, {none}, {a}), 'db', if(r.ok, {none}, {b})))[0]"


def _parts(a: str, b: str) -> str:
    """_kept of every part of two columns of digests, in as many parts as their sizes ask for.

    Digests are first dealt to runs of about the root of the number of parts, then from a run to its parts, so long texts cost n sqrt(n).
    """
    cells = LARGER[0]
    parts = f"greatest(1, cast(ceil((size({a}) + size({b})) / {PER_PART}D) AS int))"
    bound = f"transform(array({parts}), m -> named_struct('m', m, 'w', cast(ceil(sqrt(m)) AS int)))"
    tried = _kept(_peeled(_table("ea", cells, "eb"), cells, 0), "transform(ea, e -> e.d)", "transform(eb, e -> e.d)")
    split = f"transform(array(filter(ra, e -> e.g = s)), ea -> transform(array(filter(rb, e -> e.g = s)), eb -> {tried})[0])[0]"
    each = f"transform(sequence(u * v.w, least(u * v.w + v.w, v.m) - 1), s -> {split})"
    run = lambda p: f"array(filter({p}, e -> e.g >= u * v.w AND e.g < u * v.w + v.w))"
    runs = f"transform(sequence(0, cast((v.m - 1) div v.w AS int)), u -> transform({run('pa')}, ra -> transform({run('pb')}, rb -> {each})[0])[0])"
    placed = [_places(x, cells, "v.m", 0, sign) for x, sign in ((a, 1), (b, -1))]
    return f"transform({bound}, v -> flatten(transform(array({placed[0]}), pa -> transform(array({placed[1]}), pb -> {runs})[0])[0]))[0]"


def _again(before: str, attempt: int) -> str:
    """Parts that failed, made anew with more cells and other places."""
    cells = LARGER[attempt]
    tried = _kept(_peeled(_table("ea", cells, "eb"), cells, attempt), "q.da", "q.db")
    ea, eb = (_places(x, cells, "1", attempt, sign) for x, sign in (("q.da", 1), ("q.db", -1)))
    return f"transform({before}, q -> if(q.ok, q, transform(array({ea}), ea -> transform(array({eb}), eb -> {tried})[0])[0]))"


def with_likeness(frame: DataFrame, pairs: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """frame with a column for each pair (digests, table, other digests, other table): the share of digests in both among those in either, 0 to 1."""
    for name, (a, ta, b, tb) in pairs.items():
        frame = frame.withColumn(f"__{name}f", F.expr(_peeled(_less(ta, tb), CELLS, 0)))
        first = F.col(f"__{name}f")
        frame = frame.withColumn(f"__{name}0", F.when(~first["ok"], F.expr(_parts(a, b))))
        for attempt in range(1, len(LARGER)):
            frame = frame.withColumn(f"__{name}{attempt}", F.expr(_again(f"__{name}{attempt - 1}", attempt)))
        last = f"__{name}{len(LARGER) - 1}"
        less = lambda x, y, last=last: F.expr(f"aggregate({last}, 0, (n, q) -> n + if(q.ok, q.{x}, size(array_except(q.d{x}, q.d{y}))))")
        frame = frame.withColumn(f"__{name}a", F.when(first["ok"], first["a"]).otherwise(less("a", "b"))).withColumn(f"__{name}b", F.when(first["ok"], first["b"]).otherwise(less("b", "a")))
        frame = frame.withColumn(name, (F.size(a) - F.col(f"__{name}a")) / (F.size(a) + F.col(f"__{name}b")))
    return frame.drop(*(c for c in frame.columns if c.startswith("__")))


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text", least_rows: int = 512, most_ranges: int = 1 << 16) -> DataFrame:
    """docs with next_<column> of the row that follows by descending key (after the last comes the first); equal keys follow by descending text.

    Rows are dealt to ranges of keys, found from quantiles, and each range also gets the last row of the range before it, so no window spans more than a
    range. There are most_ranges ranges at most, so their table is small. A null key counts as the least. Keys are integers.
    """
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    size = docs.agg(F.count("*").alias("n"), F.expr(f"percentile_approx(`{key}`, array({', '.join(str(k / 32) for k in range(33))}), 5000)").alias("q")).first()
    cuts = sorted({int(x) for x in size.q or [0]})
    ranges = max(1, min(most_ranges, size.n // least_rows))
    each = max(1, ranges // max(1, len(cuts) - 1))
    bounds = "array(" + ", ".join(f"{c}L" for c in cuts) + ")"
    segment = F.expr(f"greatest(1, least({max(1, len(cuts) - 1)}, size(filter({bounds}, b -> b <= __at))))")
    low, high = F.expr(f"element_at({bounds}, __seg)"), F.expr(f"coalesce(try_element_at({bounds}, __seg + 1), element_at({bounds}, __seg) + 1)")
    within = F.floor((F.col("__at").cast("double") - low) / (high.cast("double") - low) * each)
    dealt = docs.withColumn("__at", place).withColumn("__seg", segment)
    dealt = dealt.withColumn("__range", F.col("__seg").cast("long") * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), within)))
    table = dealt.groupBy("__range").agg(F.max("__at").alias("__top"))
    order = Window.orderBy("__range")  # over ranges, not rows
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumn("__to", F.coalesce(F.lead("__range").over(order), F.min("__range").over(whole)))
    own = F.struct(F.col("__range").alias("r"), F.lit(1).alias("own"))
    guest = F.struct(F.col("__to").alias("r"), F.lit(0).alias("own"))
    goes = F.explode(F.when(F.col("__at") == F.col("__top"), F.array(own, guest)).otherwise(F.array(own))).alias("__go")
    dealt = dealt.join(F.broadcast(table), "__range").select(*docs.columns, "__at", goes).select(*docs.columns, "__at", "__go.r", "__go.own")
    before = Window.partitionBy("r").orderBy("own", "__at", text)
    moved = dealt.select(*docs.columns, "own", *(F.lag(c).over(before).alias(f"next_{c}") for c in columns))
    return moved.where("own = 1").drop("own")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    edited is the text whose last floor(n_chars / 2) code points are replaced by the first as many, or all, of the next document by descending key. near_*
    compare the fingerprint with that of the edited text and of the next document. Null texts count as empty; repeated rows stay, each with
    the row after it; a table of one row is followed by itself. Other columns aren't read.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("digests", digests(F.col("text"))).withColumn("table", sketch("digests"))
    rows = with_next(docs, ["text", "digests", "table"])
    half = F.expr("int(length(text) div 2)")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "digests", "table", "next_digests", "next_table")
    rows = rows.withColumn("edited_digests", digests(F.col("edited"))).withColumn("edited_table", sketch("edited_digests"))
    rows = with_likeness(rows, {"near_edited": ("digests", "table", "edited_digests", "edited_table"), "near_next": ("digests", "table", "next_digests", "next_table")})
    return rows.select("doc_id", "n_chars", "edited", written("table").alias("fingerprint"), written("edited_table").alias("edited_fingerprint"), "near_edited", "near_next")
