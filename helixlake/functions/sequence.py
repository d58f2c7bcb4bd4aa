"""DNA functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions import mathx as m
from helixlake.sources import constants as k


def bases(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), "[^ACGT]", "")


def gc_content(x: Column) -> Column:
    u = F.upper(x)
    return m.js_round(m.ratio(F.length(u) - F.length(F.translate(u, "GC", "")), F.length(u)), 3)


def reverse_complement(x: Column) -> Column:
    """Other signs pass through."""
    return F.reverse(F.translate(F.upper(x), "ATCG", "TAGC"))


def _energies(s: Column) -> Column:
    """Running sums (h, s) of enthalpy and entropy over the neighbours of a sequence of A, C, G and T: entry n is for n + 1 bases."""
    table = lambda i: F.array(*[F.lit(float(k.NEAREST_NEIGHBOUR[a + b][i])) for a in "ACGT" for b in "ACGT"])
    zero = F.array(F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("s"), F.lit(-1).alias("last")))

    def step(acc, c):
        last, code = F.get(acc, F.size(acc) - 1), F.position(c, F.lit("ACGT")) - 1
        at = last["last"] * 4 + code
        grown = F.struct((last["h"] + F.get(table(0), at)).alias("h"), (last["s"] + F.get(table(1), at)).alias("s"), code.alias("last"))
        return F.when(last["last"] < 0, F.array(F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("s"), code.alias("last")))).otherwise(F.array_append(acc, grown))

    return F.aggregate(F.split(s, ""), zero, step)


def _melting(s: Column, n: Column, sums: Column, sodium: float, primer: float) -> Column:
    ends = F.when(F.substring(s, 1, 1).isin("A", "T"), 1).otherwise(0) + F.when(F.substr(s, n, F.lit(1)).isin("A", "T"), 1).otherwise(0)
    entropy = sums["s"] + ends * 4.1 + F.lit(0.368 * math.log(sodium)) * (n - 1)
    return F.when(n < 2, 0.0).otherwise(m.js_round(F.try_divide(sums["h"] + ends * 2300.0, entropy + F.lit(1.987 * math.log(primer / 4))) - 273.15, 1))


def melting_temp(x: Column, sodium: float = 0.05, primer: float = 250e-9) -> Column:
    """Nearest-neighbour melting temperature in degrees Celsius, one decimal; 0 under two bases."""
    s = bases(x)
    table = lambda i: F.array(*[F.lit(float(k.NEAREST_NEIGHBOUR[a + b][i])) for a in "ACGT" for b in "ACGT"])
    start = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("s"), F.lit(-1).alias("last"))

    def step(acc, c):
        code = F.position(c, F.lit("ACGT")) - 1
        at = acc["last"] * 4 + code
        grown = F.struct((acc["h"] + F.get(table(0), at)).alias("h"), (acc["s"] + F.get(table(1), at)).alias("s"), code.alias("last"))
        return F.when(acc["last"] < 0, F.struct(acc["h"].alias("h"), acc["s"].alias("s"), code.alias("last"))).otherwise(grown)

    return _melting(s, F.length(s), F.aggregate(F.split(s, ""), start, step), sodium, primer)


def _runs(t: Column, run: int) -> Column:
    """Every ``run`` successive letters as one number, ten bits a letter; letters are read once, as positions in a text are found by counting."""
    letters = F.array(F.transform(F.split(t, ""), lambda c: F.ascii(c).cast("long") % 1024))  # in a list, so that the inner function gets it ready
    number = lambda a, i: sum((F.get(a, i + j) * (1 << 10 * (run - 1 - j)) for j in range(1, run)), F.get(a, i) * (1 << 10 * (run - 1)))
    return F.flatten(F.transform(letters, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - run), lambda i: number(a, i))))


def self_complementary(x: Column, run: int = 6) -> Column:
    """Whether some ``run`` bases, 6 at most, also lie on the opposite strand."""
    s = F.upper(x)
    return F.when(F.length(s) >= run, F.arrays_overlap(_runs(s, run), _runs(reverse_complement(s), run))).otherwise(F.when(s.isNotNull(), False))


def identity(a: Column, b: Column) -> Column:
    """Share of equal places; 0 for different lengths."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), same / F.length(a)).otherwise(0.0)


def fragments(rows: DataFrame, max_length: int = 800, overlap: int = 30) -> DataFrame:
    """(id, fragment, start, length, gc): a target cut into equal pieces that overlap the next by ``overlap`` bases."""
    n = F.length("seq")
    count = F.greatest(F.lit(2), F.ceil(n / (max_length - overlap))).cast("int")
    size = F.ceil(n / count).cast("int")
    f = rows.where("length(seq) > 0").select("id", "seq", size.alias("size"), F.explode(F.sequence(F.lit(0), count - 1)).alias("fragment"))
    start = F.least(F.col("fragment") * F.col("size"), n)
    piece = F.substr("seq", start + 1, F.least(start + F.col("size") + overlap, n) - start)
    return f.select("id", "fragment", start.alias("start"), F.length(piece).alias("length"), gc_content(piece).alias("gc"), piece.alias("seq"))


def primers(rows: DataFrame, target: float = 62.0, shortest: int = 18, longest: int = 25, sodium: float = 0.05, primer: float = 250e-9) -> DataFrame:
    """(id, fragment, binding, tm): of the first 18 to 25 bases of each fragment those whose melting point is nearest the target; the shortest wins ties.

    Running sums over the first bases serve all lengths, and a fragment never leaves its row.
    """
    head = F.substring("seq", 1, longest)

    def candidate(sums, i):
        n = i + shortest
        tm = _melting(head, n, sums, sodium, primer)
        return F.struct(F.abs(tm - target).alias("off"), n.alias("n"), tm.alias("tm"))

    best = F.array_min(F.transform(F.slice(_energies(head), shortest, longest - shortest + 1), candidate))
    c = rows.where(F.length("seq") >= shortest).select("id", "fragment", "seq", best.alias("b"))
    return c.select("id", "fragment", F.substr("seq", F.lit(1), F.col("b.n")).alias("binding"), "b.tm")


def mispriming(binding: Column, target: Column, start: Column, end: Column) -> Column:
    """Whether the binding region or its reverse complement lies elsewhere in the target than at the fragment, give or take 5 bases."""
    n = F.length(binding)
    places = F.when(F.length(target) >= n, F.sequence(F.lit(0), F.length(target) - n)).otherwise(F.array().cast("array<int>"))
    away = lambda i: (i < start - 5) | (i > end + 5)
    here = lambda i: F.substr(target, i + 1, n)
    return F.exists(places, lambda i: away(i) & ((here(i) == binding) | (here(i) == reverse_complement(binding))))


def mutation_text(mutations: Column) -> Column:
    """Sorted by place as ``A12V / ...``; none is the wild type."""
    parts = F.transform(F.array_sort(mutations), lambda x: F.concat(x["before"], x["place"].cast("string"), x["after"]))
    return F.when(F.size(mutations) > 0, F.array_join(parts, " / ")).otherwise("WT")


def consensus_motifs(designs: DataFrame, size: int = 5, most: int = 20) -> DataFrame:
    """(place, motif): the ``size``-mers that all designs (id, seq) share at a place."""
    n = designs.agg(F.count("*").alias("n"))
    sets = designs.where(F.length("seq") >= size).groupBy("id").agg(F.collect_set("seq").alias("seqs"))  # a design's own; all designs of a motif are only counted
    at = lambda q: F.transform(F.sequence(F.lit(1), F.length(q) - (size - 1)), lambda i: F.struct(i.alias("place"), F.substr(q, i, F.lit(size)).alias("motif")))
    p = sets.select(F.explode(F.array_distinct(F.flatten(F.transform("seqs", at)))).alias("m"))
    g = p.groupBy("m.place", "m.motif").agg(F.count("*").alias("k"))
    return g.crossJoin(F.broadcast(n)).where("k = n").orderBy("place").limit(most).select("place", "motif")
