"""Line dedup with a log-template tree of fixed depth.

A line descends by its number of tokens and its leading tokens to a leaf; tokens that hold a digit,
an ``@`` or ``://`` are variable fields from the start. In a leaf, a token that too few lines
have at its position is a variable field too, so lines that differ there share a template. This is
decided by counts and not by the order of arrival, so the tree is the same however the lines are
dealt out. Where the constants of a template are too few, its lines only share one with lines that are
the same in their original words; so it is with all lines of fewer than ``MIN_CONSTANT`` tokens.
Templates found in ``min_docs`` documents recur; of each, the lines stay in the document
with the smallest id, where they were seen first, and are dropped everywhere else. A line of more than
``LONG`` tokens also recurs where just two documents have it word for word, by a digest of the line.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common

FIELD = "<*>"
DEPTH = 3
#: Documents in which a template must lie to recur; also what keeps a token of a leaf constant.
MIN_DOCS = 5
#: Lines of more tokens recur from two documents on where they are the same word for word.
LONG, LONG_DOCS = 50, 2
#: Constant tokens that a template with variable fields needs, and their least share of its tokens.
MIN_CONSTANT, SHARE = 5, 0.7
_VARIABLE = re.compile(r"[0-9@]|://")


def tokens_of(line: str) -> list[str]:
    """White-space tokens with the obvious variable fields replaced."""
    tokens = line.split()
    if _VARIABLE.search(line):
        tokens = [FIELD if _VARIABLE.search(t) else t for t in tokens]
    return tokens


def leaf_of(tokens: list[str], depth: int = DEPTH) -> str:
    return f"{len(tokens)} {' '.join(tokens[:depth])}"


def _hash(x: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, with_text: bool = True) -> DataFrame:
    """(row, doc_id, line_no, leaf, line, own, long) of every line that has a token; without text, the leaves of each row.

    ``row`` stands for a row with its id and text: ids may be null or repeat, equal rows are one document.
    ``line`` has its obvious variable fields replaced, ``own`` is the 128-bit digest of the line's words as
    they were; lines of more than ``LONG`` tokens are long.
    """
    own = docs.select(common.row_key(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    kinds = pa.schema([("row", pa.binary()), ("doc_id", common.arrow_type(own, "doc_id")), ("line_no", pa.int32()), ("leaf", pa.int64()), ("line", pa.string()), ("own", pa.binary()), ("long", pa.bool_())])

    def parse(frames):
        import xxhash

        def rows():
            for frame in frames:
                for row, key, value in zip(*(c.to_pylist() for c in frame.columns)):
                    seen = set()
                    for number, line in enumerate(value.split("\n")):
                        tokens = tokens_of(line)
                        if not tokens:
                            continue
                        leaf = _hash(leaf_of(tokens, depth))
                        if with_text:
                            yield row, key, number, leaf, " ".join(tokens), xxhash.xxh3_128_digest(" ".join(line.split())), len(tokens) > LONG
                        elif leaf not in seen:
                            seen.add(leaf)
                            yield row, key, number, leaf, None, None, len(tokens) > LONG

        yield from common.batches(rows(), kinds, 4)

    return own.mapInArrow(parse, T.StructType([T.StructField("row", T.BinaryType()), own.schema["doc_id"], T.StructField("line_no", T.IntegerType()), T.StructField("leaf", T.LongType()), T.StructField("line", T.StringType()), T.StructField("own", T.BinaryType()), T.StructField("long", T.BooleanType())]))


def generalised(distinct: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """(leaf, hash, template) of the ``distinct`` lines (leaf, hash, line, n); null where the constants are too few.

    Tokens are counted by (leaf, position, token), never by leaf alone: a leaf may hold a third of all lines.
    """
    shared = common.cut(distinct.groupBy("leaf").agg(F.count("*").alias("k")).where("k > 1").select("leaf"))  # alone, a line has no variable token
    able = distinct.where(F.size(F.split("line", " ")) >= MIN_CONSTANT)
    several = common.cut(able.join(shared, "leaf", "left_semi").repartition("leaf", "hash"))
    each = several.select("leaf", "hash", "n", F.posexplode(F.split("line", " ")).alias("at", "token")).where(F.col("at") >= depth)
    each = each.select("leaf", "hash", "n", "at", F.xxhash64("token").alias("token"))
    rare = common.cut(each.groupBy("leaf", "at", "token").agg(F.sum("n").alias("total")).where(F.col("total") < min_docs).select("leaf", "at", "token"))
    # a line that is there so often has no rare token
    fields = each.where(F.col("n") < min_docs).join(rare, ["leaf", "at", "token"], "left_semi").groupBy("leaf", "hash").agg(F.collect_list("at").alias("fields"))
    formed = able.select("leaf", "hash", "line").join(fields, ["leaf", "hash"], "left")

    def form(frames):
        for frame in frames:
            made = []
            for line, variable in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist()):
                tokens = line.split(" ")
                for at in variable or ():
                    tokens[at] = FIELD
                constant = len(tokens) - tokens.count(FIELD)
                made.append(" ".join(tokens) if constant >= max(MIN_CONSTANT, SHARE * len(tokens)) else None)
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(made, pa.string())], names=["leaf", "hash", "template"])

    return formed.mapInArrow(form, "leaf long, hash long, template string").where("template IS NOT NULL").select("leaf", "hash", F.unhex(F.md5(F.col("template").cast("binary"))).alias("template"))


def template_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """(row, doc_id, line_no, template, least) of every line in a leaf that ``min_docs`` rows have, ``LONG_DOCS`` if its lines are long.

    ``template`` is a digest, ``least`` the number of rows from which it recurs. Long lines come twice, once by themselves.
    """
    rows = {"doc_id": doc_id, "text": text, "depth": depth}
    leaves = lines(docs, with_text=False, **rows).groupBy("leaf").agg(F.count("*").alias("count"), F.max("long").alias("long")).where((F.col("count") >= min_docs) | F.col("long") & (F.col("count") >= LONG_DOCS)).select("leaf")
    there = lines(docs, **rows).join(common.cut(leaves), "leaf", "left_semi")
    there = common.cut(there.withColumn("hash", F.xxhash64("line")))
    distinct = common.cut(there.groupBy("leaf", "hash").agg(F.first("line").alias("line"), F.count("*").alias("n")))
    formed = common.cut(generalised(distinct, min_docs, depth))  # so that the join below may split a hot line
    exact = lambda kind: F.unhex(F.md5(F.concat(F.lit(kind).cast("binary"), F.col("own"))))
    general = there.drop("line").join(formed, ["leaf", "hash"], "left").select("row", "doc_id", "line_no", F.coalesce("template", exact("=")).alias("template"), F.lit(min_docs).alias("least"))
    return general.union(there.where("long").select("row", "doc_id", "line_no", exact("=long").alias("template"), F.lit(LONG_DOCS).alias("least")))


def templates(found: DataFrame) -> DataFrame:
    """Recurring templates (template, n_docs, first) of :func:`template_lines`; ``first`` names the row that keeps its lines."""
    once = found.groupBy("template", "row").agg(F.min("doc_id").alias("doc_id"), F.first("least").alias("least"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    return once.groupBy("template").agg(F.count("*").alias("n_docs"), F.min(place).alias("first"), F.first("least").alias("least")).where("n_docs >= least").drop("least")


def dropped_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """(row, lines): numbers, from 0, of the lines to drop from each row that loses any."""
    found = common.cut(template_lines(docs, doc_id=doc_id, text=text, min_docs=min_docs, depth=depth))
    known = common.cut(templates(found))  # so that the join below may split a hot template
    gone = found.join(known, "template").where(F.col("row") != F.col("first.row"))
    return gone.groupBy("row").agg(F.collect_set("line_no").alias("lines"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, count: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with the lines of recurring templates cut out of ``text``.

    ``count`` names a column to hold the number of dropped lines; one of that name, in whatever case, is replaced. Null and
    empty texts stay as they are; a text all of whose lines go becomes empty. Equal rows are one document.
    An empty table gives an empty one, and columns of any name are carried.
    """
    gone = dropped_lines(docs, doc_id=doc_id, text=text, min_docs=min_docs, depth=depth)
    base = docs.select(common.quoted(c for c in docs.columns if not count or c.lower() != count.lower()))
    names = base.columns
    key = common.free_name("row", names)
    numbers = common.free_name("lines", [*names, key])
    joined = base.withColumn(key, common.row_key(doc_id, text)).join(gone.select(F.col("row").alias(key), F.col("lines").alias(numbers)), key, "left").select(*common.quoted(names), numbers)
    at = names.index(text)
    schema = T.StructType([*base.schema.fields, *([T.StructField(count, T.LongType())] if count else [])])

    def rewrite(frames):
        for frame in frames:
            value, found = frame.column(at).to_pylist(), frame.column(len(names)).to_pylist()
            for i, own in enumerate(found):
                if own:
                    own = set(own)
                    value[i] = "\n".join(x for k, x in enumerate(value[i].split("\n")) if k not in own)
            columns = frame.columns[: len(names)]
            columns[at] = pa.array(value, pa.string())
            if count:
                columns.append(pa.array([len(x or ()) for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *([count] if count else [])])

    return common.plain_names(joined).mapInArrow(rewrite, schema)
