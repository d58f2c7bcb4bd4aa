"""Shapes of stored JSON: what a value keeps, what stands in for the rest, and why something was dropped.

A shape reads a Variant column as ``ok``, whether an item of this shape may stay in a list; ``value``, the typed value;
and ``dropped``, a list of (path, reason) for everything that was there and isn't kept. Shapes nest. ``staged`` reads a document's
records in plain columns, a select for each depth, which Spark compiles and of which it leaves out what isn't asked for; what lies in lists and
maps is one expression for each of them (as is a whole document with ``sanitised``). There every value is bound to a variable
with its kind, and what is read of a field is bound before a record uses it. So all is worked out once a row, however deep it lies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = "array<struct<path:string,reason:string>>"
#: Why something isn't kept: it is of another kind, not among the known values or names, or a required part is missing.
KIND, VALUE, UNKNOWN, INCOMPLETE = "kind", "value", "unknown", "incomplete"
#: What is made of a value.
ALL = ("ok", "value", "dropped")
#: Types that only objects and only arrays can be read as; nothing in them is.
_BARE = {"OBJECT": "struct<>", "ARRAY": "array<struct<>>"}


def none() -> Column:
    return F.expr(f"CAST(array() AS {DROPPED})")


def note(when: Column, path: Column, reason: str | Column) -> Column:
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(when, F.array(F.struct(path.alias("path"), why.alias("reason")))).otherwise(none())


def bound(v: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a column that is worked out once, as a variable."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def kind(v: Column, likely: str = "") -> Column:
    """STRING, BOOLEAN, VOID for JSON's null, OBJECT or ARRAY, of which the last two may be followed by what is inside, or a type of number; null where there is no value.

    The schema of an object or array takes a walk through all of it, so where one is ``likely`` that is tried first.
    """
    if likely not in _BARE:
        return F.schema_of_variant(v)
    return F.when(F.try_variant_get(v, "$", _BARE[likely]).isNotNull(), likely).otherwise(F.schema_of_variant(v))


def deep(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def child(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _struct_of(names) -> str:
    return "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">"


def children(v: Column, names) -> Column:
    """The values of an object's fields of these names, as a struct; null for anything else."""
    return F.try_variant_get(v, "$", _struct_of(names))


def names(v: Column) -> Column:
    """The names of an object's fields, sorted."""
    return F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,struct<>>")))


def items(v: Column) -> Column:
    """The items of an array; none for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))


class Shape:
    """``wanted`` is the kind of value a shape takes.

    ``_inner`` is what has to be bound before ``_ok``, ``_value`` and ``_dropped`` are made of it and of a bound value with its kind; it holds as much as ``what`` needs.
    """

    wanted = "OBJECT"

    def kind(self, v: Column) -> Column:
        return kind(v, self.wanted)

    def read(self, v: Column, path: Column, what: tuple[str, ...] = ALL) -> Column:
        """A struct of ``ok``, ``value`` and ``dropped``, or of those in ``what``."""
        return bound(F.struct(v.alias("v"), self.kind(v).alias("kind")), lambda x: self._read(x["v"], x["kind"], path, what))

    def _read(self, v: Column, kind: Column, path: Column, what: tuple[str, ...]) -> Column:
        inner = self._inner(v, kind, path, what)
        if inner is None:
            return Part(self, v, kind, None, path).struct(what)
        return bound(inner, lambda x: Part(self, v, kind, x, path).struct(what))

    def _inner(self, v: Column, kind: Column, path: Column, what: tuple[str, ...]) -> Column | None:
        return None

    def _ok(self, v: Column, kind: Column, inner) -> Column:
        return self._is(kind)

    def _value(self, v: Column, kind: Column, inner) -> Column:
        raise NotImplementedError

    def _dropped(self, v: Column, kind: Column, inner, path: Column) -> Column | None:
        """None where nothing ever is."""
        return note(kind.isNotNull() & ~self._ok(v, kind, inner), path, KIND)

    def _is(self, kind: Column) -> Column:
        return kind.eqNullSafe(self.wanted)


@dataclass
class Part:
    """A bound value that a shape reads."""

    shape: Shape
    v: Column
    kind: Column
    inner: object
    path: Column

    @property
    def ok(self) -> Column:
        return self.shape._ok(self.v, self.kind, self.inner)

    @property
    def value(self) -> Column:
        return self.shape._value(self.v, self.kind, self.inner)

    @property
    def dropped(self) -> Column | None:
        return self.shape._dropped(self.v, self.kind, self.inner, self.path)

    def struct(self, what: tuple[str, ...]) -> Column:
        made = {name: getattr(self, name) for name in what}
        return F.struct(*[(none() if c is None else c).alias(name) for name, c in made.items()])


class Inside(Part):
    """A record inside a record of a list or map: ``inner`` is its struct, null where a record that may be null isn't there."""

    @property
    def ok(self) -> Column:
        return F.coalesce(self.inner["ok"], F.lit(False))

    @property
    def value(self) -> Column:
        return self.inner["value"]

    @property
    def dropped(self) -> Column:
        return F.coalesce(self.inner["dropped"], self.shape._other(self.kind, self.path))


@dataclass
class Text(Shape):
    """A text; not an empty one where it must be ``filled``."""

    default: str | None = None
    filled: bool = False
    wanted = "STRING"

    def _ok(self, v, kind, inner):
        return self._is(kind) & (v.cast("string") != "") if self.filled else self._is(kind)

    def _value(self, v, kind, inner):
        return F.when(self._ok(v, kind, inner), v.cast("string")).otherwise(F.lit(self.default).cast("string"))


@dataclass
class Number(Shape):
    """A finite number, not under ``least``."""

    default: float | None = None
    least: float | None = None
    wanted = "number"

    def _is(self, kind):
        return F.coalesce(F.substring(kind, 1, 3).isin("BIG", "DEC", "DOU", "FLO"), F.lit(False))  # BIGINT, DECIMAL(3,1): what JSON's numbers are read as

    def _value(self, v, kind, inner):
        own = F.when(self._is(kind), v.cast("double")).otherwise(F.lit(self.default).cast("double"))
        return own if self.least is None else F.greatest(own, F.lit(float(self.least)))


@dataclass
class Flag(Shape):
    """True for what counts as true: not null, false, 0 or an empty text. Takes any value."""

    wanted = ""

    def _ok(self, v, kind, inner):
        return F.lit(True)

    def _value(self, v, kind, inner):
        return F.when(kind.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", v.cast("boolean")).when(kind == "STRING", v.cast("string") != "").when(deep(kind), True).otherwise(v.cast("double") != 0)

    def _dropped(self, v, kind, inner, path):
        return None


@dataclass
class Choice(Shape):
    """One of ``known``, else the default."""

    known: tuple[str, ...]
    default: str | None = None
    wanted = "STRING"

    def _own(self, v, kind):
        return F.when(self._is(kind), v.cast("string"))

    def _ok(self, v, kind, inner):
        return F.coalesce(self._own(v, kind).isin(*self.known), F.lit(False))

    def _value(self, v, kind, inner):
        return F.when(self._ok(v, kind, inner), self._own(v, kind)).otherwise(F.lit(self.default).cast("string"))

    def _dropped(self, v, kind, inner, path):
        return note(kind.isNotNull() & ~self._ok(v, kind, inner), path, F.when(self._is(kind), VALUE).otherwise(KIND))


@dataclass
class Whole(Shape):
    """An object as it is, as canonical JSON, if it has what ``needs`` says."""

    needs: dict[str, Shape] = field(default_factory=dict)

    def _inner(self, v, kind, path, what):
        if not self.needs:
            return None

        def has(o):
            ok = F.lit(True)
            for name, shape in self.needs.items():
                ok = ok & shape._ok(o[name], shape.kind(o[name]), None)
            return ok

        return F.coalesce(F.when(self._is(kind), bound(children(v, self.needs), has)), F.lit(False))

    def _ok(self, v, kind, inner):
        return inner if self.needs else self._is(kind)

    def _value(self, v, kind, inner):
        return F.when(self._ok(v, kind, inner), canonical(v))

    def _dropped(self, v, kind, inner, path):
        return note(kind.isNotNull() & ~self._ok(v, kind, inner), path, F.when(self._is(kind), INCOMPLETE).otherwise(KIND))


@dataclass
class Record(Shape):
    """An object of known fields; null where one of ``needs`` isn't of its kind.

    With ``always`` it is never null: where there is no object, fields have their defaults, or the values of ``absent``.
    ``inner`` are its fields' parts.
    """

    fields: dict[str, Shape]
    needs: tuple[str, ...] = ()
    always: bool = False
    absent: dict[str, str | list[str]] = field(default_factory=dict)

    def _read(self, v, kind, path, what):
        r = self._struct(v, kind, path, what)
        return r if self.always else bound(r, lambda r: Inside(self, v, kind, r, path).struct(what))

    def _struct(self, v: Column, kind: Column, path: Column, what: tuple[str, ...]) -> Column:
        """As ``_read``, but null where a record that may be null isn't there."""
        read = bound(children(v, self.fields), lambda o: self.of(o, v, kind, path, what))
        return read if self.always else F.when(self._is(kind), read)  # an object that isn't there has no fields to read

    def of(self, o: Column, v: Column, kind: Column, path: Column, what: tuple[str, ...]) -> Column:
        """A struct of ``what`` from the values ``o`` of the fields."""

        def whole(k):
            under = lambda name: F.concat(path, F.lit(f".{name}")) if "dropped" in what else path
            parts = {name: Part(shape, o[name], k[name], None, under(name)) for name, shape in self.fields.items()}
            inner = {}
            for name, p in parts.items():
                x = p.shape._struct(p.v, p.kind, p.path, what) if isinstance(p.shape, Record) else p.shape._inner(p.v, p.kind, p.path, what)
                if x is not None:
                    inner[name] = x

            def made(i):
                own = {name: (Inside if isinstance(p.shape, Record) else Part)(p.shape, p.v, p.kind, i[name], p.path) if name in inner else p for name, p in parts.items()}
                return Part(self, v, kind, own, path).struct(what)

            return bound(F.struct(*[x.alias(name) for name, x in inner.items()]), made) if inner else made({})

        return bound(F.struct(*[shape.kind(o[name]).alias(name) for name, shape in self.fields.items()]), whole)

    def _other(self, kind: Column, path: Column) -> Column:
        return note(kind.isNotNull() & (kind != "VOID") & ~self._is(kind), path, KIND)

    def _ok(self, v, kind, inner):
        ok = self._is(kind)
        for name in self.needs:
            ok = ok & inner[name].ok
        return ok

    def own(self, kind: Column, inner: dict[str, Part]) -> Column:
        """A struct of the fields' values, whether or not the record may stay."""
        there = self._is(kind)

        def part(name):
            other, own = self.absent.get(name), inner[name].value
            if other is None:
                return own
            return F.when(there, own).otherwise(F.array(*map(F.lit, other)) if isinstance(other, list) else F.lit(other))

        return F.struct(*[part(name).alias(name) for name in self.fields])

    def _value(self, v, kind, inner):
        return self.own(kind, inner) if self.always else F.when(self._ok(v, kind, inner), self.own(kind, inner))

    def _dropped(self, v, kind, inner, path):
        other = F.array_except(F.coalesce(names(v), F.array().cast("array<string>")), F.array(*map(F.lit, self.fields)))
        unknown = F.transform(other, lambda n: F.struct(F.concat(path, F.lit("."), n).alias("path"), F.lit(UNKNOWN).alias("reason"))).cast(DROPPED)
        kept = F.concat(*[d for d in (inner[name].dropped for name in self.fields) if d is not None], unknown)
        bad = F.concat(self._other(kind, path), note(self._is(kind), path, INCOMPLETE))
        return F.when(self._ok(v, kind, inner), kept).otherwise(bad)


@dataclass
class List(Shape):
    """The items of an array that fit; no items for anything else."""

    item: Shape
    wanted = "ARRAY"

    def _inner(self, v, kind, path, what):
        if "dropped" not in what and isinstance(self.item, Record):  # other items than objects leave nothing
            each = F.try_variant_get(v, "$", f"array<{_struct_of(self.item.fields)}>")
            there = F.filter(F.coalesce(each, F.expr(f"CAST(array() AS array<{_struct_of(self.item.fields)}>)")), lambda o: o.isNotNull())
            return F.transform(there, lambda o: self.item.of(o, v, F.lit(self.item.wanted), path, what))
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        return F.transform(items(v), lambda x, i: self.item.read(x, at(i), what))

    def _value(self, v, kind, inner):
        return F.transform(F.filter(inner, lambda x: x["ok"]), lambda x: x["value"])

    def _dropped(self, v, kind, inner, path):
        return F.concat(super()._dropped(v, kind, inner, path), F.flatten(F.transform(inner, lambda x: x["dropped"])).cast(DROPPED))


@dataclass
class Map(Shape):
    """The entries of an object that fit, under known names if there are any ``keys``."""

    item: Shape
    keys: tuple[str, ...] = ()

    def _at(self, path: Column, n: Column) -> Column:
        return F.concat(path, F.lit("."), n)

    def _inner(self, v, kind, path, what):
        if "dropped" not in what and self.keys:  # other names leave nothing
            one = lambda o, n: F.when(o[n].isNotNull(), F.struct(F.lit(n).alias("name"), self.item.read(o[n], path, what).alias("r")))
            return bound(children(v, sorted(self.keys)), lambda o: F.array(*[one(o, n) for n in sorted(self.keys)]))
        known = lambda n: n.isin(*self.keys) if self.keys else F.lit(True)
        read = lambda m, n: F.struct(n.alias("name"), F.when(known(n), self.item.read(F.element_at(m, n), self._at(path, n), what)).alias("r"))
        entries = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        return bound(entries, lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda n: read(m, n)))

    def _value(self, v, kind, inner):
        return F.map_from_entries(F.transform(F.filter(inner, lambda x: F.coalesce(x["r"]["ok"], F.lit(False))), lambda x: F.struct(x["name"], x["r"]["value"])))

    def _dropped(self, v, kind, inner, path):
        gone = F.flatten(F.transform(inner, lambda x: F.coalesce(x["r"]["dropped"], note(F.lit(True), self._at(path, x["name"]), UNKNOWN)))).cast(DROPPED)
        return F.concat(note(kind.isNotNull() & (kind != "VOID") & ~self._is(kind), path, KIND), gone)


def canonical(v: Column) -> Column:
    """JSON of a Variant with the names of all objects sorted and no spaces: equal values have equal texts.

    Whole numbers lose their trailing ``.0`` however they were written. Numbers that are written with an exponent and not
    whole keep a form of their own; a name may not occur twice in an object.
    """
    return F.regexp_replace(F.to_json(v), r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0(?=[,}\]]|$)', "$1$2")


def canonical_json(text: Column) -> Column:
    """The canonical form of a JSON text; null where it is none."""
    return canonical(F.try_parse_json(text))


def sanitised(parsed: Column, shape: Shape) -> Column:
    """A struct of ``value`` and ``dropped`` for a parsed document."""
    return shape.read(parsed, F.lit("$"))


def staged(docs: DataFrame, parsed: Column, shape: Record, *keep: str) -> DataFrame:
    """(keep, ok, value, dropped) of parsed documents: whether one has the shape, its fields' values as a struct that is never null, and what was dropped.

    One select parses, one for each depth of records takes their fields, one finds the kinds of all values, one reads lists and maps; the rest are plain columns over these.
    Lists and maps are read for values and for what was dropped each by itself, so that a query of one of the two has no work with the other.
    """
    df = docs.select(*keep, parsed.alias("v"))
    level, depth, found = [(("$",), shape, F.col("v"))], 0, {}
    while level:  # records at one depth
        df = df.select("*", *[children(v, record.fields).alias(f"o{depth}_{i}") for i, (_, record, v) in enumerate(level)])
        below = []
        for i, (at, record, v) in enumerate(level):
            o = F.col(f"o{depth}_{i}")
            found[at] = (record, v, F.when(o.isNotNull(), record.wanted).otherwise(record.kind(v)))
            for name, part in record.fields.items():
                if isinstance(part, Record):
                    below.append(((*at, name), part, o[name]))
                else:
                    found[(*at, name)] = (part, o[name], part.kind(o[name]))
        level, depth = below, depth + 1
    parts = {at: Part(part, v, F.col(f"k{i}"), None, F.lit(".".join(at))) for i, (at, (part, v, _)) in enumerate(found.items())}
    df = df.select("*", *[k.alias(f"k{i}") for i, (_, _, k) in enumerate(found.values())])
    inner = []

    def tree(at: tuple[str, ...], what: str) -> Part:
        p = parts[at]
        if isinstance(p.shape, Record):
            own = {name: tree((*at, name), what) for name in p.shape.fields}
        else:
            own = p.shape._inner(p.v, p.kind, p.path, ("ok", what))
            if own is not None:
                inner.append(own.alias(f"i{len(inner)}"))
                own = F.col(f"i{len(inner) - 1}")
        return Part(p.shape, p.v, p.kind, own, p.path)

    values, dropped = tree(("$",), "value"), tree(("$",), "dropped")
    return df.select("*", *inner).select(*keep, values.ok.alias("ok"), shape.own(values.kind, values.inner).alias("value"), dropped.dropped.alias("dropped"))
