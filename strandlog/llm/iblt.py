"""Document fingerprints by invertible Bloom lookup tables, in SQL functions only.

A text is a set of paragraphs: each line is cut after every WIDE words, and the first FINE_HEAD words of a text after
every FINE words, so that short texts have several. A paragraph's digest is a 64-bit hash. A long text's digests are
dealt into groups of about GROUP by some of their bits, so that the work grows with its length. A table has three
sub-tables of 2^i cells each, and a digest goes to one cell of each, by other bits of its own. A cell holds the count, the
XOR of digests and the XOR of their 32-bit check hashes; only cells that aren't empty are kept, in order. Subtracting a
table from another merges the two lists. Peeling takes cells that hold one digest (count 1 or -1, a fitting check), takes
those digests out of their other cells, and goes on until the table is empty.

The fingerprint of a text is its tables, each of the first size at which it peels by itself: cells in hex (place, count,
digest, check), so that a fingerprint gives back its digests. As sizes are powers of two, a table also folds to a smaller
one. Two fingerprints are subtracted at the larger one's least size (if one has more groups, the other's digests are
dealt anew). The cells that are left tell about how many digests differ; where that is too many for the size, both are
made anew at the size for that number, and again larger when peeling fails (RETRIES). What peels are the digests that only
one version has. The last resort, the set difference of a group's digests, is counted (`fallbacks`): two digests that
share all their cells at the largest size lead there. A table that does not peel alone even then lists its digests.

The likeness of two versions is the Jaccard index of their paragraph sets, from the numbers of paragraphs and of
recovered digests: (a + b - d) / (a + b + d). It follows from the two fingerprints alone.

Edge cases: null text is empty; an empty text has no paragraph, two of them are alike (1), and an empty and a
non-empty text are not (0). Equal texts have equal fingerprints; repeated paragraphs count once.

The next document (in descending doc_id, the first after the last) is found without one task that holds all: doc_ids
are cut into buckets of about BUCKET rows at approximate quantiles and evenly between them; the first document of each
bucket is copied into the bucket before, and a window inside a bucket finds the next. Rows that share a doc_id follow
each other by text; a null doc_id is after all others. A table of one row is its own next document. An empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.runtime import cut

WIDE, FINE, FINE_HEAD = 32, 4, 32
#: Digests of a group at most, on average; how much larger tables get when peeling fails, rounds of peeling.
GROUP, RETRIES, ROUNDS = 64, (1, 2, 4, 16), 12
BUCKET, QUANTILES = 400, 64
#: Bits of a digest from which on its places in the three sub-tables are read, bits of a place at most, and the group's first bit.
PLACES, PLACE_BITS, GROUP_BIT = (10, 22, 34), 12, 46

#: A cell: its place (the sub-table, then PLACE_BITS bits), and the count, digests and checks in it.
_CELLS = "array<struct<p:int,n:int,k:bigint,c:bigint>>"
_FOUND = "array<struct<k:bigint,n:int,c:bigint>>"


def paragraphs(text: str) -> str:
    """SQL for the sorted distinct digests of a text's paragraphs."""
    cuts = lambda t, n: rf"regexp_extract_all({t}, '(?: *[^ \\n]+){{1,{n}}}', 0)"
    head = rf"regexp_extract({text}, '^(?:[ \\n]*[^ \\n]+){{0,{FINE_HEAD}}}', 0)"
    both = f"concat({cuts('h', FINE)}, {cuts(f'substring({text}, length(h) + 1)', WIDE)})"
    return f"sort_array(array_distinct(transform(transform(array({head}), h -> {both})[0], p -> xxhash64(p))))"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _check(k: str) -> str:
    return f"(xxhash64({k}, 7) & 4294967295L)"


def _power(x: str, least: int) -> str:
    """The least power of two that is x or more."""
    return f"cast(pow(2, ceil(log2(greatest({x}, {least})))) as int)"


def groups(n: str) -> str:
    """The number of groups for n digests."""
    return f"least({_power(f'{n} / {GROUP}', 1)}, {1 << (64 - GROUP_BIT)})"


def _dealt(digests: str, of: str) -> str:
    """For each of so many groups its entries (digest, count 1, check): by 6 bits first, then by the rest."""
    entries = f"transform({digests}, d -> named_struct('k', d, 'n', 1, 'c', {_check('d')}))"
    bits = lambda at, n: f"cast(shiftrightunsigned(e.k, {at}) & ({n} - 1) as int)"
    part = lambda all_, at, n, name: f"transform(sequence(0, {n} - 1), {name} -> filter({all_}, e -> {bits(at, n)} = {name}))"
    many = f"flatten(transform({part('en', GROUP_BIT, '64', 'g')}, eg -> {part('eg', GROUP_BIT + 6, f'cast({of} / 64 as int)', 'h')}))"
    return _let("en", entries, f"if({of} = 1, array(en), if({of} <= 64, {part('en', GROUP_BIT, of, 'g')}, {many}))")


def _placed(entries: str, m: str, sign: str = "") -> str:
    """The cells of m that entries go to, one for each entry and sub-table."""
    cell = lambda j: f"named_struct('p', cast(shiftrightunsigned(e.k, {PLACES[j]}) & ({m} - 1) as int) + {j << PLACE_BITS}, 'n', {sign}e.n, 'k', e.k, 'c', e.c)"
    return f"flatten(transform({entries}, e -> array({cell(0)}, {cell(1)}, {cell(2)})))"


def _merged(cells: str) -> str:
    """The list with one entry a cell, in order of place, without empty ones.

    Runs of equal places are cut out and each is added up: what a fold carries along is copied at each step, so the list
    itself must not be.
    """
    first = "filter(transform(e, (x, i) -> if(i = 0, 0, if(e[i - 1].p = x.p, -1, i))), i -> i >= 0)"
    add = "named_struct('p', x.p, 'n', a.n + x.n, 'k', a.k ^ x.k, 'c', a.c ^ x.c)"
    total = f"aggregate(slice(e, v + 1, coalesce(get(at, i + 1), size(e)) - v), named_struct('p', 0, 'n', 0, 'k', 0L, 'c', 0L), (a, x) -> {add})"
    runs = f"filter(transform(at, (v, i) -> if(coalesce(get(at, i + 1), size(e)) - v = 1, e[v], {total})), z -> z.n != 0 or z.k != 0 or z.c != 0)"
    return _let("e", f"sort_array({cells})", _let("at", first, runs))


def _peeled(cells: str, m: str) -> str:
    """struct(cells that are left, found digests with the sign of their count, whether the last round found any)."""
    pure = f"array_distinct(transform(filter(b.cells, x -> abs(x.n) = 1 and x.c = {_check('x.k')}), x -> named_struct('k', x.k, 'n', x.n, 'c', x.c)))"
    go = f"named_struct('cells', {_merged('concat(b.cells, ' + _placed('pure', m, '-') + ')')}, 'found', concat(b.found, pure), 'on', true)"
    stop = "named_struct('cells', b.cells, 'found', b.found, 'on', false)"
    start = f"named_struct('cells', {cells}, 'found', cast(array() as {_FOUND}), 'on', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (b, r) -> if(b.on and size(b.cells) > 0, {_let('pure', pure, f'if(size(pure) = 0, {stop}, {go})')}, b))"


def fingerprint(digests: str) -> str:
    """SQL for a digest list's fingerprint: the number of digests; for each group the size of its table and the cells."""
    cell = "concat(lpad(hex(x.p), 4, '0'), lpad(hex(x.n), 3, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.c), 8, '0'))"
    attempt = _let("t", _merged(_placed("l", "m")), f"named_struct('done', size({_peeled('t', 'm')}.cells) = 0, 'm', m, 'cells', t)")
    start = f"named_struct('done', false, 'm', 0, 'cells', cast(array() as {_CELLS}))"
    listed = "named_struct('done', true, 'm', 0, 'cells', transform(l, e -> named_struct('p', 0, 'n', 1, 'k', e.k, 'c', e.c)))"
    sizes = _let("m0", _power("size(l) / 2", 4), f"transform(array{RETRIES}, x -> x * m0)")
    sized = f"aggregate({sizes}, {start}, (f, m) -> if(f.done, f, {attempt}), f -> if(f.done, f, {listed}))"
    text = f"concat(hex(f.m), chr(58), array_join(transform(f.cells, x -> {cell}), '.'))"
    each = f"transform({_dealt(digests, groups(f'size({digests})'))}, l -> {_let('f', sized, text)})"
    return f"lower(concat(hex(size({digests})), '/', array_join({each}, '/')))"


def difference(left: str, right: str) -> str:
    """SQL for struct(mine, yours, fallbacks): the sorted digests that only one of two digest lists has, by subtract and peel."""
    table = lambda m: _merged(f"concat({_placed('w.l', m)}, {_placed('w.r', m, '-')})")
    # So many cells of m0 in each sub-table are left by about this number of digests.
    about = "-m0 * ln(greatest(1 - size(t0) / 3.0D / m0, 0.02D))"
    sizes = f"transform(array{RETRIES}, x -> least(x * if({about} <= 2 * m0, m0, {_power(about + ' / 1.5D', 4)}), {1 << PLACE_BITS}))"
    attempt = _let("t", _peeled(f"if(m = m0, t0, {table('m')})", "m"), "named_struct('done', size(t.cells) = 0, 'found', t.found, 'last', 0)")
    side = lambda a, b, n: f"transform(array_except(transform({a}, e -> e.k), transform({b}, e -> e.k)), k -> named_struct('k', k, 'n', {n}, 'c', 0L))"
    last = f"named_struct('done', true, 'found', concat({side('w.l', 'w.r', '1')}, {side('w.r', 'w.l', '-1')}), 'last', 1)"
    start = f"named_struct('done', false, 'found', cast(array() as {_FOUND}), 'last', 0)"
    tries = f"aggregate({sizes}, {start}, (f, m) -> if(f.done, f, {attempt}), f -> if(f.done, f, {last}))"
    one = _let("m0", _power("greatest(size(w.l), size(w.r)) / 2", 4), _let("t0", table("m0"), tries))
    most = groups(f"greatest(size({left}), size({right}))")
    both = _let("of", most, f"zip_with({_dealt(left, 'of')}, {_dealt(right, 'of')}, (l, r) -> named_struct('l', l, 'r', r))")
    keys = lambda n: f"sort_array(transform(filter(f, x -> x.n = {n}), x -> x.k))"
    made = f"named_struct('mine', {keys(1)}, 'yours', {keys(-1)}, 'fallbacks', aggregate(u, 0, (a, x) -> a + x.last))"
    return _let("u", f"transform({both}, w -> {one})", _let("f", "flatten(transform(u, x -> x.found))", made))


def likeness(left: str, right: str, diff: str) -> str:
    """SQL for the Jaccard index of two digest lists, whose difference is `diff`."""
    both, d = f"(size({left}) + size({right}))", f"(size({diff}.mine) + size({diff}.yours))"
    return f"if({both} = 0, 1.0D, cast({both} - {d} as double) / ({both} + {d}))"


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mine, next_text, following) in descending doc_id, with the digests of both texts; null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES)], 10_000).alias("at")).first()
    low, high = known["low"] or 0, known["high"] or 0
    bounds = sorted({low, *(known["at"] or [])})
    tops = [*bounds[1:], high + 1]
    fine = max(1, -(-known["n"] // (len(bounds) * BUCKET)))
    # The key of a null is below all others; a bucket's number rises with the key.
    key = F.coalesce(F.col("doc_id"), F.lit(low - 1 if low > -(1 << 63) else low))
    begin, end = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, tops))
    part = F.greatest(F.lit(0), F.size(F.filter(begin, lambda b: b <= F.col("key"))) - 1)
    inside = (F.col("key") - begin[F.col("part")]).cast("double") / (end[F.col("part")] - begin[F.col("part")]).cast("double")
    bucket = F.col("part").cast("long") * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor(inside * fine))).cast("long")
    rows = rows.withColumn("key", key).withColumn("part", part).withColumn("bucket", bucket)
    heads = cut(rows.groupBy("part", "bucket").agg(F.max("key").alias("head")), "heads")
    # Each bucket's first row is wanted in the next higher bucket, the very first in the lowest.
    higher = F.lead("bucket").over(Window.partitionBy("part").orderBy("bucket"))
    edge = heads.groupBy("part").agg(F.min("bucket").alias("lowest"))
    edge = edge.select("part", F.lead("lowest").over(Window.orderBy("part")).alias("above"), F.min("lowest").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
    sent = cut(heads.withColumn("higher", higher).join(edge, "part").select(F.col("head").alias("key"), F.coalesce("higher", "above", "least").alias("target")), "heads-sent")
    here = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ghost"))
    there = F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("b"), F.lit(True).alias("ghost")))
    dealt = rows.withColumn("mine", F.expr(paragraphs("text"))).join(sent, "key", "left")
    dealt = dealt.select("doc_id", "text", "mine", "key", F.explode(F.array_compact(F.array(here, there))).alias("to"))
    dealt = dealt.select("doc_id", "text", "mine", "key", "to.b", "to.ghost")
    order = Window.partitionBy("b").orderBy("ghost", F.desc("key"), "text")
    after = dealt.withColumns({"next_text": F.lead("text").over(order), "following": F.lead("mine").over(order)})
    return after.filter(~F.col("ghost")).select("doc_id", "text", "mine", "next_text", "following")


def edited(text: Column, following: Column) -> Column:
    """The text with the last third of its code points replaced by the first as many of the next text."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, fallbacks, lost and new digests."""
    rows = with_next(docs).withColumn("changed", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        "mine",
        F.expr(paragraphs("changed")).alias("altered"),
        "following",
    )
    # One generated row a document, so that no later projection works the differences out again.
    both = f"named_struct('d_edited', {difference('mine', 'altered')}, 'd_next', {difference('mine', 'following')})"
    rows = rows.select("*", F.expr(f"inline(array({both}))"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(fingerprint("mine")).alias("fingerprint"),
        F.expr(fingerprint("altered")).alias("edited_fingerprint"),
        F.expr(likeness("mine", "altered", "d_edited")).alias("near_edited"),
        F.expr(likeness("mine", "following", "d_next")).alias("near_next"),
        (F.col("d_edited.fallbacks") + F.col("d_next.fallbacks")).alias("fallbacks"),
        F.col("d_edited.mine").alias("lost"),
        F.col("d_edited.yours").alias("gained"),
    )
